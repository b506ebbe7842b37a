"""Queries that run over the whole input, against plain counts of it."""

import pandas as pd

from eddyline.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def test_range_join_over_all_orders(spark):
    events, orders = (pd.read_parquet(f"{SF}/{n}.parquet") for n in ("events", "orders"))
    low = orders.o_totalprice / 1000
    want = sum(int(((low <= v) & (v <= low + 0.05)).sum()) for v in events.value)
    got = QUERIES["join_range"](spark, SF).collect()
    assert len(got) == len(set(got)) == want
    assert any(r["o_orderkey"] % 10 for r in got)


def test_exact_numbers_of_all_lines(spark):
    assert QUERIES["scalar_exact"](spark, SF).count() == len(pd.read_parquet(f"{SF}/lineitem.parquet"))


def test_every_element_of_an_array(spark):
    vectors = pd.read_parquet(f"{SF}/embeddings.parquet").embedding
    assert QUERIES["contained_array"](spark, SF).count() == sum(map(len, vectors)) > 3 * len(vectors)
