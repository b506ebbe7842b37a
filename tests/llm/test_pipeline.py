"""The pipeline's stages against brute force on the smallest table, and on odd rows."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline as C
from eddyline.llm import decontaminate, secrets, tokens
from eddyline.llm.common import stored
from test_shingles import classes

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(C.STAGES)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}

    kept = stored(stages["language"](spark, docs, SF), "t1")
    assert kept.columns == columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, t in texts.items() if t and any(map(str.isalpha, t))}

    ids = sorted(r["doc_id"] for r in kept.collect())
    group = classes({i: texts[i] for i in ids})
    kept = stored(stages["near_duplicates"](spark, kept, SF), "t2")
    assert kept.columns == columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(group.values()))

    items = [(r["item_id"], decontaminate.normal(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {r["doc_id"] for r in kept.collect() if any(decontaminate.Myers(t).best(decontaminate.normal(r["text"]))[0] <= int(len(t) * 0.1) for _, t in items)}
    clean = stored(stages["benchmark_leaks"](spark, kept, SF), "t3")
    assert leaks and {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in kept.collect()} - leaks

    hidden = stored(stages["secrets"](spark, clean, SF), "t4")
    assert hidden.columns == columns and hidden.count() == clean.count()
    scan = secrets.Scanner()
    for r in hidden.collect():
        assert not scan.scan([r["text"]])[0]
        assert r["n_chars"] == len(r["text"])
        if not scan.scan([texts[r["doc_id"]]])[0]:
            assert r["text"] == texts[r["doc_id"]]

    last = stages["packing"](spark, hidden, SF).collect()
    got = defaultdict(list)
    for r in last:
        got[r["doc_id"]].append(r)
    bpe = tokens.bpe(tokens.default_path())
    for r in hidden.collect():
        want = np.append(bpe.encode(r["text"]), 0).astype("<u4")
        at = 0
        for p in sorted(got[r["doc_id"]], key=lambda p: p["start"]):
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(want[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(want)
    assert C.run(spark, SF).count() == len(last)


@pytest.mark.parametrize("name", [n for n, _ in C.STAGES])
def test_odd_rows(spark, name):
    rows = [
        (1, None, None, None, None, "e", [1]),
        (None, "some words of text here", "en", "s", 23, None, None),
        (2, "", "en", None, 0, "e", []),
        (3, "the same text twice, with a token = abcdefgh123", "en", "s", 9, "e", [2]),
        (3, "the same text twice, with a token = abcdefgh123", "en", "s", 9, "e", [2]),
        (4, "word " * 60000, None, "s", 300000, "e", None),
        (5, "12345 !!", "en", "s", 8, "e", None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id string, ids array<int>")
    stage = dict(C.STAGES)[name]
    out = stage(spark, docs, SF)
    found = out.collect()
    if name != "packing":
        assert out.columns == docs.columns
        assert len(found) == {"language": 4, "near_duplicates": 5, "benchmark_leaks": 7, "secrets": 7}[name]
    else:
        assert {r["doc_id"] for r in found} == {None, 1, 2, 3, 4, 5}
    empty = stage(spark, docs.where("false"), SF)
    assert empty.count() == 0
