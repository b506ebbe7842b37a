"""The near-duplicate stage against brute-force Jaccard on five-word shingles."""

from fractions import Fraction
from itertools import combinations

import pytest

import corpus_pipeline as C
from eddyline.llm import shingles as S


def classes(texts, least=0.8):
    """Smallest id reachable over similar pairs; all pairs are compared."""
    sets = {i: S.shingles(t) for i, t in texts.items()}
    group = {i: i for i in texts}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in combinations(sorted(texts), 2):
        a, b = sets[i], sets[j]
        if a == b or min(len(a), len(b)) >= least * max(len(a), len(b)) and len(a & b) * 5 >= 4 * len(a | b):
            low, high = sorted((root(i), root(j)))
            group[high] = low
    return {i: root(i) for i in texts}


def test_stage_keeps_one_of_each_group(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = classes({r["doc_id"]: r["text"] for r in docs.collect()})
    kept = dict(C.STAGES)["near_duplicates"](spark, docs, sf).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(want.values()))


@pytest.mark.parametrize("block_nodes, block_shingles", [(500, 10**6), (7, 10**6), (500, 900)])
def test_blocks_of_one_large_group(spark, block_nodes, block_shingles):
    base = [f"w{i}" for i in range(200)]
    texts = {}
    for i in range(60):  # edits of one text, from close to far, some of them edits of edits
        words = list(base)
        for k in range(i % 9):
            words[(i * 31 + k * 23) % 200] = f"x{i % 5}_{k}"
        texts[i] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in S.near_copies(docs, block_nodes=block_nodes, block_shingles=block_shingles).collect()}
    want = classes(texts)
    assert got == want and 1 < len(set(want.values())) < 60


def test_similarity_at_the_edge():
    texts = ["a b c d e f g h i j k l m", "a b c d e f g h i j k l x", "a b c d e f g h i j k y z"]  # 9 shingles; 8 of 10, 7 of 11
    assert S.unit_links(texts, [0] * 3, False, 5, Fraction("0.8")) == [(1, 0)]
    assert S.unit_links(texts, [0, 0, 1], True, 5, Fraction("0.8")) == []


def edits(n):
    """Long texts and light edits of each, by id."""
    out = {}
    for i in range(n):
        words = [f"w{i}_{k}" for k in range(1500)]
        out[2 * i] = " ".join(words)
        words[700] = "edit"
        out[2 * i + 1] = " ".join(words)
    return out


def test_trie_links_every_pair_within_its_bits(spark):
    sets = {S.key(h): S.fingerprints(h).view("u8").tolist() for h in map(S.hashed, edits(20).values())}
    near = {k: k for k in sets}
    for a, b in combinations(sorted(sets), 2):  # the smaller one leads each pair of texts
        if any((x ^ y).bit_count() <= S.BITS for x, y in zip(sets[a], sets[b], strict=True)):
            near[b] = a
    nodes = spark.createDataFrame([(k, [x - (1 << 64) if x >> 63 else x for x in f]) for k, f in sets.items()], "key long, fps array<long>")
    got = {(r["key"], r["centre"]) for r in S.trie_rows(nodes).collect()}
    assert got == {(b, a) for b, a in near.items() if a != b} and len(got) > 10


def test_near_copies_come_through_the_trie(spark, monkeypatch):
    rows = S.band_rows
    monkeypatch.setattr(S, "band_rows", lambda nodes: rows(nodes).where("false"))
    texts = edits(20)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in S.near_copies(docs).collect()}
    assert sum(got[2 * i + 1] == 2 * i for i in range(20)) > 10 and all(got[i] in (i, i - i % 2) for i in got)
