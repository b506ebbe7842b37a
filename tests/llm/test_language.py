"""The byte network: gradients, held-out accuracy, edge cases."""

import zlib

import numpy as np

from eddyline.llm import langid as L


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    m = L.ByteCnn(["a", "b", "c"], seed=1)
    x, y = rng.integers(0, 256, (5, L.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1, 0])

    def loss():
        m.tables = None
        return float(-np.log(m.probabilities(x)[np.arange(5), y]).mean())

    grads = m._gradients(x, y)
    for name in m.weights:
        w = m.weights[name]
        at = np.unravel_index(int(np.abs(grads[name]).argmax()), w.shape)
        keep, step = w[at], 1e-2
        w[at] = keep + step
        up = loss()
        w[at] = keep - step
        down = loss()
        w[at] = keep
        assert abs((up - down) / (2 * step) - grads[name][at]) < 0.15 * abs(grads[name][at]) + 1e-3


def test_windows_cover_every_byte():
    for n in (0, 1, 255, 256, 257, 509, 5000):
        raw = (np.arange(n) % 251 + 1).astype(np.uint8).tobytes()
        cut, has = L.windows(raw)
        assert all((cut[i, : has[i]] > 0).all() and not cut[i, has[i] :].any() for i in range(len(cut)))
        joined = cut[0].tobytes() + b"".join(c[3:].tobytes() for c in cut[1:])
        assert joined.rstrip(b"\0") == raw


def test_held_out_accuracy_and_edge_cases(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.train(docs)
    got = {r["doc_id"]: r for r in L.identify(docs, model).collect()}
    held = [(got[r["doc_id"]]["lang_pred"], r["lang"]) for r in docs.collect() if got[r["doc_id"]]["held_out"]]
    assert len(held) > 100 and sum(a == b for a, b in held) / len(held) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    odd = spark.createDataFrame([(1, None, "x"), (2, "12 34 !!", "x"), (3, "", "x"), (None, "the word and", "x")], "doc_id long, text string, held_out string")
    found = {r["doc_id"]: r for r in L.identify(odd, model).collect()}
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (1, 2, 3))
    assert found[None]["held_out"] is False and 0 <= found[None]["score"] <= 1
    assert [r["doc_id"] for r in L.keep_known(odd, model).collect()] == [None]
    nothing = L.train(docs.where("false"))
    assert L.identify(docs.limit(3), nothing).first()["lang_pred"] == "und"
