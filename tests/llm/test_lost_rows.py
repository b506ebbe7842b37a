"""Rows that once went missing or lingered: ids with several texts, whole private keys, short items, long tokens."""

import random

import numpy as np
import pytest

from eddyline.llm import decontaminate as D
from eddyline.llm import langid as L
from eddyline.llm import secrets as S
from eddyline.llm import shingles, simhash

A = " ".join(f"a{i}" for i in range(60))
B = " ".join(f"b{i}" for i in range(60))
ROWS = [(5, A, 1), (7, A, 2), (5, B, 3), (2, B, 4)]


@pytest.mark.parametrize("classes", [simhash.classes, shingles.near_copies])
def test_an_id_with_two_texts_loses_copies_only(spark, classes):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, n int")
    kept = simhash.first_of(docs, classes(docs))
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(2, B), (5, A)]
    assert kept.columns == docs.columns


@pytest.mark.parametrize("classes", [simhash.classes, shingles.near_copies])
def test_an_id_does_not_join_its_texts(spark, classes):
    docs = spark.createDataFrame([(5, A), (5, B), (6, A), (6, B), (6, B), (None, A), (None, None), (8, None), (9, "")], "doc_id long, text string")
    got = {(r["doc_id"], r["mark"], r["component_id"]) for r in classes(docs).collect()}
    assert len({m for d, m, c in got if d == 5 and c == 5}) == 2
    assert {c for d, _, c in got if d is None} == {5, 8}
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in simhash.first_of(docs, classes(docs)).collect())
    assert kept == sorted([(5, A), (5, B), (0, A), (0, ""), (8, "")])


@pytest.mark.parametrize("classes", [simhash.classes, shingles.near_copies])
def test_first_of_each_class_against_brute_force(spark, classes):
    rnd = random.Random(3)
    pool = [" ".join(rnd.choice("abcdefghij") + str(rnd.randrange(40)) for _ in range(50)) for _ in range(12)] + [None, "", "x"]
    rows = [(rnd.choice([*range(15), None]), rnd.choice(pool), rnd.choice([1, 2, None])) for _ in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(5)
    same = lambda t: t or ""  # noqa: E731  null and empty texts are copies
    smallest = {}
    for i, t, _ in rows:
        if i is not None:
            smallest[same(t)] = min(i, smallest.get(same(t), i))
    kept = simhash.first_of(docs, classes(docs)).collect()
    ids = sorted((r["doc_id"], same(r["text"])) for r in kept if r["doc_id"] is not None)
    assert ids == sorted((i, t) for t, i in smallest.items())
    assert sum(r["doc_id"] is None for r in kept) == sum(i is None for i, *_ in rows)


def test_deep_division_of_hot_runs(spark):
    rnd = random.Random(5)
    base = rnd.getrandbits(64)
    fps = list({base ^ sum(1 << b for b in rnd.sample(range(30), rnd.randrange(6))) for _ in range(300)})
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(fps)], "fp long, node long")
    from eddyline.llm.components import components

    parent = list(range(len(fps)))
    for _ in fps:
        before = list(parent)
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 2:
                    parent[i] = min(parent[i], parent[j])
        if before == parent:
            break
    for hot, levels in ((1, 3), (2, 6), (20, 2)):
        made = {r["node"]: r["component"] for r in components(simhash.links(nodes, 2, hot, levels), "t").collect()}
        assert [made.get(i, i) for i in range(len(fps))] == parent


def test_long_texts_are_cut_into_lists_of_words(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(5000))
    whole = simhash.fingerprint(text), shingles.hashed(text), shingles.shingles(text)
    monkeypatch.setattr(simhash, "SLICE_BYTES", 100)
    assert simhash.fingerprint(text) == whole[0] and np.array_equal(shingles.hashed(text), whole[1]) and shingles.shingles(text) == whole[2]


@pytest.mark.parametrize("block_nodes", [500, 4])
def test_large_group_makes_no_pairs(spark, block_nodes):
    """Many copies of one text, each with its own word changed: joined through the centre, nothing is left open."""
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join([*words[:i], f"x{i}", *words[i + 1 :]]) for i in range(100)]
    docs = spark.createDataFrame(list(enumerate([" ".join(words), *texts])), "doc_id long, text string")
    got = {r["component_id"] for r in shingles.near_copies(docs, block_nodes=block_nodes).collect()}
    assert got == {0}


# ---- secrets -----------------------------------------------------------------------------------------------

BODY = "\n".join("".join(random.Random(i).choice("ABCxyz012+/") for _ in range(64)) for i in range(20)) + "\nabc="
KEY = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00\n\n{BODY}\n-----END RSA PRIVATE KEY-----"


def masked(spark, text):
    return S.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["text"]


def test_whole_private_keys_are_masked(spark):
    label = "A B C D E F G"
    for key in (KEY, KEY.replace("\n", "\\n"), KEY.replace("\n", "\r\n"), KEY.replace("RSA ", ""), KEY.replace("RSA", label), KEY.replace("RSA", "X" * 50)):
        out = masked(spark, f"before {key} after - dash")
        assert out == "before [secret:pem] after - dash"
    two = masked(spark, f"{KEY}\nbetween\n{KEY}")
    assert two == "[secret:pem]\nbetween\n[secret:pem]"
    cut_off = masked(spark, "x " + KEY.replace("Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00\n\n", "").split("\nabc=")[0])
    assert not any(line in cut_off for line in BODY.split("\n")[:-1])
    prose = "the line -----BEGIN PRIVATE KEY----- starts a key; prose stays"
    assert masked(spark, prose) == "the line [secret:pem] starts a key; prose stays"


@pytest.mark.parametrize("n", [36, 255, 256, 4096, 4097, 100_000])
def test_tokens_of_any_length(spark, n):
    w = "aB3_-" * (n // 5 + 1)
    for token, kind in ((f"eyJ{w[:n]}.eyJ{w[:n]}.{w[:n]}", "jwt"), ("ghp_" + "aB3d" * (n // 4 + 1), "github"), ("xoxb-" + "1-a2" * (n // 4 + 1), "slack")):
        assert masked(spark, f"see {token}, end") == f"see [secret:{kind}], end"
    assert masked(spark, f"eyJ{w[:20]}.eyJ{w[:20]} no third part") == f"eyJ{w[:20]}.eyJ{w[:20]} no third part"


def test_matching_is_linear():
    import time

    texts = ["eyJ" * 300_000, "-----BEGIN A B " * 60_000, ("-----BEGIN PRIVATE KEY-----" + "- " * 40) * 5_000, "-----BEGIN PRIVATE KEY-----" + "a-b" * 500_000, "xoxb-" * 200_000, "gho_" * 200_000]
    began = time.process_time()
    S.Scanner().scan(texts)
    assert time.process_time() - began < 20


def test_index_slices(monkeypatch):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(["token = abcdefgh12", "x", "ghp_" + "a" * 36, " ", "ü"]) for _ in range(40)) for _ in range(30)]
    want = S.Scanner().scan(texts)
    monkeypatch.setattr(S, "INDEX_BYTES", 7)
    assert S.Scanner().scan(texts) == want and any(want)


# ---- benchmark items ---------------------------------------------------------------------------------------


def test_short_items_are_found_between_words(spark):
    items = spark.createDataFrame([(1, "What is 17 times 23?"), (2, "cat"), (3, "?"), (4, None), (None, "two  words here")], "item_id long, text string")
    rows = [(1, "so: what IS 17\ntimes 23? yes"), (2, "what is 17 times 234?"), (3, "concatenate"), (4, "a cat."), (5, "what is 17 tmes 23"), (6, "two words here"), (None, "cat")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["distance"], r["start_char"], r["end_char"]) for r in D.find_leaks(docs, items).collect()}
    assert got == {(1, 1, 0, 4, 24), (1, 3, 0, 23, 24), (2, 3, 0, 20, 21), (4, 2, 0, 2, 5), (6, None, 0, 0, 14), (None, 2, 0, 0, 3)}
    assert sorted(r["doc_id"] or 0 for r in D.drop_leaks(docs, items).collect()) == [0, 2, 3, 4, 5]  # one or two words drop nothing


def test_items_of_hundreds_of_pieces():
    rnd = random.Random(4)
    item = D.normal(" ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(600)))
    x = list(item)
    for q in rnd.sample(range(len(x)), int(len(x) * 0.08)):
        x[q] = "z"
    m = D.Matcher([(1, item)], 0.1, D.LEAST_CHARS)
    assert len(m.items[0].pieces) > 400
    [(_, d, a, b)] = m.find("front " + "".join(x) + " back")
    assert d <= int(len(item) * 0.1) and a >= 5 and b <= 7 + len(item)
    assert not m.find("front " + "".join(x)[: len(x) * 3 // 4] + " back")


# ---- language sample ---------------------------------------------------------------------------------------


def test_training_windows_come_from_whole_texts(spark):
    """The languages differ only far behind the texts' start."""
    same = "zz yy xx ww " * 120
    rnd = random.Random(6)
    far = lambda words: same + " ".join(rnd.choice(words) for _ in range(1500))
    rows = [(i, far(["the", "of", "and"]) if i % 2 else far(["der", "und", "die"]), "en" if i % 2 else "de") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.train(docs, most_windows=800)
    got = {r["doc_id"]: r["lang_pred"] for r in L.identify(docs, model).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) >= 57


def test_sample_is_bounded_and_independent_of_the_layout(spark):
    rows = [(7, f"text number {i % 50} " * 30, "en") for i in range(4000)] + [(9, "same text here " * 50, "de")] * 3000 + [(i, f"wort {i} " * 90, "de") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    counts = {"en": 4000 * 3, "de": 5000}
    shares = {k: min(1.0, 100 / n) for k, n in counts.items()}
    a = sorted(map(tuple, L.sample(docs, shares).collect()))
    b = sorted(map(tuple, L.sample(docs.repartition(7, F.col("text")), shares).collect()))
    assert a == b and 0 < len(a) < 200
    langs = spark.createDataFrame([(i, f"the text {i}", f"l{i:04d}") for i in range(600)], "doc_id long, text string, lang string")
    assert len(L.train(langs, most_windows=300).languages) == L.MOST_LANGUAGES


def test_predictions_of_repeated_rows_and_ties(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = L.train(docs)
    twice = spark.createDataFrame([(1, "the weather of the day"), (1, "the weather of the day"), (2, None)], "doc_id long, text string")
    got = [tuple(r) for r in L.identify(twice, model).orderBy("doc_id").collect()]
    assert got[0] == got[1] and got[2][2] == "und"
    flat = L.ByteCnn(["b", "a"])
    for k in flat.weights:
        flat.weights[k][:] = 0
    assert flat.predict(["word"])[0] == ("b", 0.5)


def test_probabilities_against_plain_loops():
    """The table look-ups of a prediction against the convolution written out."""
    rng = np.random.default_rng(1)
    m = L.ByteCnn(["a", "b", "c"], seed=3)
    x = rng.integers(0, 256, (3, 40)).astype(np.uint8)
    for row, got in zip(x, m.probabilities(x), strict=True):
        pooled = []
        for w in L.WIDTHS:
            for f in range(L.FILTERS):
                best = max(sum(float(m.weights["embed"][row[at + o]] @ m.weights[f"conv{w}"][o * L.EMBEDDING : (o + 1) * L.EMBEDDING, f]) for o in range(w)) for at in range(len(row) - w + 1))
                pooled.append(max(0.0, best + float(m.weights[f"shift{w}"][f])))
        z = np.array(pooled) @ m.weights["out"] + m.weights["bias"]
        e = np.exp(z - z.max())
        assert np.allclose(got, e / e.sum(), atol=1e-4)
