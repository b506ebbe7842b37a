"""SimHash links and components against comparing all pairs."""

import random
import re

import numpy as np
import xxhash

from eddyline.llm import simhash as H
from eddyline.llm.components import components, local_forest


def slow(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in ("", "  ", "One", "one two", "A b\tC\nd é É", "a b c a b c a b c", "x y z", "w " * 3000):
        assert H.fingerprint(text) == slow(text)


def groups(ids, fps, budget=2):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in zip(ids, fps, strict=True):
        for j, b in zip(ids, fps, strict=True):
            if i < j and (a ^ b).bit_count() <= budget:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_links_with_plain_and_divided_runs(spark):
    rnd = random.Random(2)
    fps = []
    for _ in range(60):
        base = rnd.getrandbits(64)
        for _ in range(6):
            base ^= sum(1 << b for b in rnd.sample(range(64), rnd.randrange(4)))
            fps.append(base)
    fps = list(dict.fromkeys(fps))
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(fps)], "fp long, node long")
    want = groups(range(len(fps)), fps)
    for hot in (10**9, 3):  # no run divided, or nearly all
        made = {r["node"]: r["component"] for r in components(H.links(nodes, 2, hot, 4), "t").collect()}
        assert {i: made.get(i, i) for i in range(len(fps))} == want


def test_long_chain_settles(spark):
    edges = [(i, i + 1) for i in range(300)] + [(500, 500), (7, 3), (None, 2)]
    made = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long"), "chain").collect()}
    assert made == {i: 0 for i in range(301)}
    assert components(spark.createDataFrame([], "u long, v long"), "none").count() == 0


def test_local_forest():
    assert local_forest(5, np.array([0, 3]), np.array([3, 4])).tolist() == [0, 1, 2, 0, 0]


def test_documents(spark):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(5, long), (3, long), (9, long.replace("w7 ", "w7x ")), (1, None), (2, ""), (4, "other words here"), (4, "other words here"), (None, long), (8, "x")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, fp string")
    fps = [H.fingerprint(t or "") for _, t in rows]
    want = groups(range(len(rows)), fps)
    got = sorted((r["doc_id"] or -1, r["fingerprint"], r["component_id"]) for r in H.near_duplicates(docs).collect())
    ids = [d for d, _ in rows]
    expected = sorted((d or -1, f"{fps[k]:016x}", min(ids[j] for j in range(len(rows)) if want[j] == want[k] and ids[j] is not None)) for k, d in enumerate(ids))
    assert got == expected
    kept = H.keep_first(docs)
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted({-1, 8, 4, 1, *(r["component_id"] for r in H.near_duplicates(docs).collect())})
    assert kept.columns == docs.columns
    assert H.near_duplicates(docs.where("false")).count() == 0
