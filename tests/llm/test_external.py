"""External merges in several passes, examples of chats, and texts too long to be held as one."""

import hashlib
import random

import pytest

from eddyline.llm import avi, chat, tokens, warc, wordpiece


def captures(rnd, n, archive):
    out = []
    for k in range(n):
        url = rnd.choice(["com,hot)/", "com,a)/x", "org,b)/" + str(rnd.randrange(20))])
        out.append((url, f"2000-01-01T00:00:{rnd.randrange(60):02d}Z", rnd.randrange(50), archive, k, 1, k, 5, "d", "response", None))
    return sorted(out, key=lambda e: e[:5])


@pytest.mark.parametrize("fan_in, range_bytes", [(256, 1 << 30), (256, 3000), (3, 5000), (2, 1 << 30)])
def test_merge_in_passes_against_sorting(spark, tmp_path, fan_in, range_bytes):
    rnd = random.Random(fan_in)
    runs = [captures(rnd, rnd.randrange(1, 90), f"w{i:02d}") for i in range(11)]
    index = []
    for i, entries in enumerate(runs):
        for batch in warc.write_run(entries, i - 5, f"file://{tmp_path}/{i}.run", block_rows=7):
            index += batch.to_pylist()
    frame = spark.createDataFrame([tuple(r[c] for c in ("run", "path", "at", "bytes")) + (tuple(r["least"].values()), tuple(r["last"].values())) for r in index], warc.RUNS)
    merged = warc.merge_runs(frame, fan_in, range_bytes, block_rows=7)
    rows = sorted(merged.collect(), key=lambda r: r["position"])
    want = sorted((e for x in runs for e in x), key=lambda e: e[:5])
    assert [tuple(r)[:11] for r in rows] == want and len({r["position"] for r in rows}) == len(want)
    if range_bytes < 10_000:
        assert len({r["position"] >> 40 for r in rows}) > 2  # the hot key is spread over ranges
        parts = merged.rdd.glom().map(lambda p: [r["position"] for r in p]).collect()
        flat = [x for p in parts for x in p]
        assert flat == sorted(flat)  # partition by partition one ordered history


def test_streams_hold_one_block(tmp_path, monkeypatch):
    entries = captures(random.Random(1), 500, "w")
    [batch] = warc.write_run(entries, 1, f"file://{tmp_path}/r.run", block_rows=50)
    opened = []
    real = warc.content
    monkeypatch.setattr(warc, "content", lambda *a: opened.append(a) or real(*a))
    places = [(r["path"], r["at"], r["bytes"]) for r in batch.to_pylist()]
    stream = warc.read_run(places, None, None)
    assert [next(stream) for _ in range(60)] == entries[:60] and len(opened) == 2
    low, high = entries[100][:5], entries[200][:5]
    assert list(warc.read_run(places, low, high)) == [e for e in entries if low <= e[:5] < high]


def test_wrong_revisits_are_seen(spark):
    cols = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    good = [(1, 200, "d", "response", None), (2, 200, "d", "revisit", 1), (3, 200, "d", "revisit", 1)]
    warc.check_revisits(spark.createDataFrame(good, cols))
    for bad in ((4, 201, "d", "revisit", 1), (4, 200, "x", "revisit", 1), (4, 200, "d", "revisit", 9)):
        with pytest.raises(ValueError):
            warc.check_revisits(spark.createDataFrame([*good, bad], cols))


def test_pages_without_id_and_long_pages(spark, tmp_path):
    rows = [(None, "http://a.b/", "A" * 300), (None, "http://a.b/", "A" * 300), (5, "http://a.b/", "A" * 300), (6, None, None), (7, "http://x.y/", "é" * 2_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = warc.write_archives(pages, f"file://{tmp_path}/w", archive_bytes=1000)
    merged = warc.merge_runs(warc.capture_runs(manifest))
    warc.check_revisits(merged)
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in merged.collect())
    assert got == [(0, "revisit", 5, 300), (0, "revisit", 5, 300), (5, "response", None, 300), (6, "response", None, 0), (7, "response", None, 4_000_000)]


# ---- chats -------------------------------------------------------------------------------------------------


def test_an_example_for_each_reply_with_all_before_it(spark):
    rows = [(1, i, role, f"t{i} <|im_end|>") for i, role in enumerate(["system", "user", "assistant", "user", "assistant", "assistant"])] + [(2, 0, "user", "q")]
    made = chat.expand(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    pieces = [r["piece"] for r in sorted(made.where("conv_id = 1 and piece is not null").collect(), key=lambda r: r["position"])]
    shown = {r["reply"]: r for r in chat.examples(made).collect()}
    assert sorted(shown) == [2, 4, 5]
    whole = "".join(pieces)
    for k, e in shown.items():
        context = "".join(pieces[:k])
        assert e["context_chars"] == len(context) and e["context_sha256"] == hashlib.sha256(context.encode()).hexdigest()
        assert chat.unescape(whole[e["mask_start"] : e["mask_end"]]) == rows[k][3]
    written = {r["reply"]: r for r in chat.render(made).collect()}
    assert all(written[k]["context"] == whole[: e["mask_start"]] and written[k]["target"] == whole[e["mask_start"] : e["mask_end"]] for k, e in shown.items())


def test_examples_with_another_context_are_refused(spark):
    from pyspark.errors import PythonException
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], "conv_id long, turn long, role string, text string")
    made = chat.expand(rows).coalesce(1)
    for column, value in (("context_chars", F.col("context_chars") + 1), ("context_sha256", F.lit("x")), ("mask_end", F.col("mask_end") + 50)):
        broken = made.withColumn(column, F.when(F.col("mask_start").isNotNull(), value))
        with pytest.raises(PythonException):
            chat.read_back(broken).collect()


def test_an_own_conversation_minus_one_stays_apart(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(-1, 0, "user", "table", 0), (-1, 0, "user", "added", 1), (-1, 1, "assistant", "x", 1)], "conv_id long, turn long, role string, text string, added int")
    got = sorted((r["conv_id"], r["n_turns"], r["loss_chars"]) for r in chat.read_back(chat.expand(rows, F.col("added"))).collect())
    assert got == [(-1, 1, 0), (-1, 2, 1)]


def test_a_conversation_over_many_blocks(spark, monkeypatch):
    texts = [f"text {i} " * 40 for i in range(300)]
    rows = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        [r] = chat.read_back(chat.expand(rows)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert (r["n_turns"], r["n_examples"], r["loss_chars"]) == (300, 150, sum(len(t) for t in texts[1::2]))
    assert r["loss_sha256"] == hashlib.sha256("".join(texts[1::2]).encode()).hexdigest()


# ---- long texts --------------------------------------------------------------------------------------------


def test_long_texts_are_counted_in_parts(monkeypatch):
    count = wordpiece.counter(tokens.default_path())
    text = "some plain words, 12 numbers\nand é more " * 300
    want = count(text)
    monkeypatch.setattr(wordpiece, "LONG_TEXT", 10)
    assert count(text) == want


def test_long_payloads_are_coded_in_slices(monkeypatch):
    payloads = [random.Random(i).randbytes(3000 * (i + 1)) for i in range(4)]
    want = avi.encode(payloads)
    monkeypatch.setattr(avi, "LINES", 5)
    monkeypatch.setattr(avi, "CODED_BYTES", 700)
    assert avi.encode(payloads) == want
    for data, raw in zip(want, payloads, strict=True):
        [(back, n, _, _)] = avi.read([data])
        assert back[:n] == raw


def test_clips_against_plain_histograms():
    """A feature's clips and change from the payload itself, frame by frame."""
    rnd = random.Random(3)
    raw = b"".join(bytes(rnd.choice(kind) for _ in range(avi.WIDTH * avi.HEIGHT)) for kind in (b"abc", b"abc", b"\xf0\xff\xe1", b"abc", b"\x05\x00"))
    [(_, _, clips, diffs)] = avi.read(avi.encode([raw]))
    size = avi.WIDTH * avi.HEIGHT
    hists = [[sum(b >> 4 == k for b in raw[i : i + size]) / size for k in range(16)] for i in range(0, len(raw), size)]
    want = [sum(abs(x - y) for x, y in zip(a, b, strict=True)) / 2 for a, b in zip(hists, hists[1:], strict=False)]
    assert len(diffs) == 4 and all(abs(a - b) < 1e-9 for a, b in zip(diffs, want, strict=True))
    cuts = []
    for i, d in enumerate(want):
        recent = want[max(0, i - 8) : i]
        mean = sum(recent) / len(recent) if recent else 0
        level = max(0.15, mean + 2.5 * (sum((x - mean) ** 2 for x in recent) / len(recent)) ** 0.5) if recent else 0.15
        if d > level:
            cuts.append(i + 1)
    bounds = [0, *cuts, 5]
    assert cuts and [(a // avi.FRAME_MS, b // avi.FRAME_MS) for a, b, _ in clips] == list(zip(bounds, bounds[1:], strict=False))


def test_intermediate_results_are_deleted(spark):
    from eddyline.llm import common
    from eddyline.llm.files import open_fs

    kept = common.stored(spark.range(3), "gone")
    path = common._made[-1]
    system, at = open_fs(path)
    assert system.get_file_info(at).type.name == "Directory" and kept.count() == 3
    common.discard_all(spark)
    assert system.get_file_info(at).type.name == "NotFound" and not common._made
