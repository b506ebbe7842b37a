"""Training order: every slot against brute force, however the table is split; resumed reads; odd rows."""

import zlib

import numpy as np
import pytest

from eddyline.llm import ordering, tokens

TEXTS = ["", None, "a", "é" * 50, "plain words " * 700, "\0\xffĀ" * 40, "x" * 64, "x" * 64, "Ж" * 30]


def expected(texts, key, length, end_id=0):
    """Slot -> (length, CRC): one stream of ids cut every `length`, permuted."""
    bpe = tokens.bpe(tokens.default_path())
    stream = np.concatenate([np.append(bpe.encode(t or ""), end_id) for t in texts]).astype("<u4")
    n = -(-len(stream) // length)
    p = ordering.Permutation(n, key)
    return {int(p.slot(np.array([k]))[0]): (len(s := stream[k * length : (k + 1) * length]), zlib.crc32(s.tobytes())) for k in range(n)}


def found(manifest, length):
    return {r["slot"]: (r["n_tokens"], r["ids_crc32"]) for r in ordering.read_back(manifest, length=length).collect()}


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_slots_do_not_depend_on_partitions(spark, tmp_path, parts):
    rows = [(i if i % 5 else None, TEXTS[i % len(TEXTS)], "x") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot string").repartition(parts)
    ordered = sorted(((-1 if i is None else i, "" if t is None else "\0" + t) for i, t, _ in rows))
    texts = [t[1:] for _, t in ordered]
    manifest = ordering.materialise(docs, f"file://{tmp_path}/o", "key", length=32, shard=8)
    assert found(manifest, 32) == expected(texts, "key", 32)
    sizes = [r["n_sequences"] for r in manifest.orderBy("shard").collect()]
    assert len(sizes) > 3 and all(s == 8 for s in sizes[:-1]) and 0 < sizes[-1] <= 8


@pytest.mark.parametrize("split", ["128m", "6k", "3k"])
def test_files_however_they_are_split(spark, tmp_path, split):
    rows = [(i, TEXTS[(i * 7) % len(TEXTS)]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = f"file://{tmp_path}/docs"
    for k in range(3):  # three files with several row groups each
        docs.where(f"doc_id % 3 = {k}").coalesce(1).sortWithinPartitions("doc_id").write.option("parquet.block.size", 4096).mode("append").parquet(path)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        read = spark.read.parquet(path)
        from pyspark.sql import functions as F

        order = read.select("text", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r")).collect()
        texts = [r["text"] for r in sorted(order, key=lambda r: (r["f"], r["r"]))]
        manifest = ordering.materialise(read, f"file://{tmp_path}/o", "key", length=64, shard=16)
        assert found(manifest, 64) == expected(texts, "key", 64)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_resumed_reads_and_another_key(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 4)], "doc_id long, text string")
    a = ordering.materialise(docs, f"file://{tmp_path}/a", "key", length=32, shard=8)
    b = ordering.materialise(docs, f"file://{tmp_path}/b", "other", length=32, shard=8)
    assert sorted(found(a, 32).values()) == sorted(found(b, 32).values()) and found(a, 32) != found(b, 32)
    for m in a.collect():
        own = [x.tolist() for x in ordering.read_from(m["path"], m["lengths"], 0, 32)]
        assert [x.tolist() for x in ordering.read_from(m["path"], m["lengths"], 3, 32)] == own[3:]
        assert m["first_slot"] == m["shard"] * 8 and m["n_bytes"] == 64 * m["n_sequences"]


def test_columns_that_clash_and_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text", "f", 5)], "doc_id long, text string, file string, _metadata int")
    assert ordering.read_back(ordering.materialise(docs, f"file://{tmp_path}/c", "k")).count() == 1
    assert ordering.read_back(ordering.materialise(docs.where("false"), f"file://{tmp_path}/d", "k")).count() == 0
    assert ordering.read_back(ordering.materialise(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("false"), f"file://{tmp_path}/e", "k")).count() == 0


@pytest.mark.parametrize("bits, at_once", [(20, 1 << 17), (6, 200)])
def test_many_texts_at_once_are_encoded_like_each(monkeypatch, bits, at_once):
    monkeypatch.setattr(tokens, "SLOT_BITS", bits)
    monkeypatch.setattr(tokens, "AT_ONCE", at_once)
    bpe = tokens.Bpe(tokens.default_path())
    rng = np.random.default_rng(7)
    parts = ["a", "word", "s", "t", "ll", "ve", "re", "l", "m", "'", "'s", "'ll", " '", " ", " ", "  ", "\n", "\t", "\r", "1", "²", "!", "...", "é", "Ž", "€", "x" * 13, "don't", "we're'd"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(3000)] + TEXTS + ["Ж'", "\0", "word " * 100]
    for _ in range(2):  # the second time from the table
        got, counts = bpe.encode_all([t or "" for t in texts]), bpe.count_all([t or "" for t in texts])
        for text, ids, n in zip(texts, got, counts, strict=True):
            assert ids.tolist() == bpe.reference(text or "").tolist() and n == len(ids)
    assert 2 * bpe._table.rows <= 1 << bits
