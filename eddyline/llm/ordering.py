"""Training-order materialisation.

The documents in their stable order are one stream of token ids, each document ended by the end token, and the stream
is cut into sequences of a fixed number of ids. A first pass counts the ids of every stretch of the input, so that
the second one knows where in the stream each document lies and so the number of each sequence, 0..n-1. A keyed
permutation of 0..n-1, a Feistel network on the smallest even number of bits that holds them, walked again wherever
it leaves the range, gives every sequence its global slot. So the order is a function of the key and the table alone,
however the table is split into tasks; ids are shuffled once and are not stored between the passes.

Slot s stands in shard s // SHARD at place s % SHARD: shards are full but for the last one, and a reader that resumes
at slot s seeks to place * stride in that shard. Each range of shards is one task, which puts together the pieces of
sequences that stretches of the input share and writes records of one stride.

The stable order is that of files by name and of rows within each, where the table is read from Parquet files. Any
other table is first written out in order of doc_id and text, which does not depend on its partitions either.

Rows: null and empty texts are their end token alone; repeated rows are documents of their own (without files, equal
rows cannot be told apart, so their order does not matter); a null doc_id comes first; the last sequence is filled up
with the end token and its true length is kept; an empty table has no shard. A very long text is encoded whole by one
task and leaves it in bounded batches. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eddyline.llm import tokens
from eddyline.llm.common import blocks, shared_dir, stored, table
from eddyline.llm.files import content, whole

SEQUENCE = 1024
#: Sequences in a shard: 16 MB of 16-bit ids.
SHARD = 8192
ROUNDS = 6
#: Tasks that read shards back at most.
MOST_TASKS = 100_000
#: Sequences in one Arrow batch.
BATCH = 2048


class Permutation:
    """A keyed permutation of 0..n-1."""

    def __init__(self, n: int, key: str):
        self.n = n
        self.half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
        digest = hashlib.shake_256(f"{key}/{n}".encode()).digest(8 * ROUNDS)
        self.keys = np.frombuffer(digest, "<u8")
        self.mask = np.uint64((1 << self.half) - 1)

    def _mix(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(29))) & self.mask

    def _once(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for k in keys:
            left, right = right, left ^ self._mix(right, k)
        return right << np.uint64(self.half) | left  # halves swapped: the same network with keys reversed undoes it

    def _walk(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        out = self._once(np.asarray(x, np.uint64), keys)
        while (outside := out >= self.n).any():
            out[outside] = self._once(out[outside], keys)
        return out.astype(np.int64)

    def slot(self, number: np.ndarray) -> np.ndarray:
        return self._walk(number, self.keys)

    def number(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self.keys[::-1])


def in_order(docs: DataFrame) -> DataFrame:
    """Rows (text, file, row) of the table in its stable order."""
    text = F.col("text").cast("string").alias("text")
    place = lambda df: (df.metadataColumn("_metadata")["file_path"].alias("file"), df.metadataColumn("_metadata")["row_index"].alias("row"))
    try:
        out = docs.select(text, *place(docs))
        out.schema  # noqa: B018  analysed here
        return out
    except AnalysisException:
        id_ = F.col("doc_id").cast("long").alias("doc_id") if "doc_id" in docs.columns else F.lit(None).cast("long").alias("doc_id")
        kept = stored(docs.select(id_, text).orderBy("doc_id", "text"), "order-input")
        return kept.select("text", *place(kept))


def _stretches(batches: Iterator[pa.RecordBatch], take) -> Iterator[tuple[str, int, bool, list]]:
    """(file, first row, whether it begins here, what `take` makes of its texts): the input's stretches of one file, block by block."""
    file, first, last = None, 0, -1
    for block in blocks(batches, 0):
        texts, files, rows = (c.to_pylist() for c in block.columns)
        own: list = []
        new = False
        for made, f, r in zip(take([t or "" for t in texts]), files, rows, strict=True):
            if f != file or r <= last:
                if own:
                    yield file, first, new, own
                file, first, own, new = f, r, [], True
            last = r
            own.append(made)
        yield file, first, new, own


STRETCH = "file string, first long, n_ids long"


def stretches(ordered: DataFrame, path: str) -> DataFrame:
    """One row for each stretch of a file that a task reads: its first row and its ids, end tokens included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list = []
        for file, first, new, counts in _stretches(batches, tokens.bpe(path).count_all):
            if new:
                now.append([file, first, 0])
            now[-1][2] += sum(counts) + len(counts)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*now, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["file", "first", "n_ids"])

    return ordered.mapInArrow(run, STRETCH)


def _name(file: str, first: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{first}:{file}".encode(), digest_size=8).digest(), "little", signed=True)


def starts(counted: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Names of the stretches, sorted, where in the stream each begins, and the stream's length.

    The driver holds one small row for each file split, two numbers of which go to the tasks.
    """
    rows = sorted((r["file"], r["first"], r["n_ids"]) for r in counted.collect())
    ends = np.cumsum([n for *_, n in rows], dtype=np.int64) if rows else np.zeros(0, np.int64)
    names = np.array([_name(f, i) for f, i, _ in rows], np.int64)
    order = np.argsort(names)
    if (np.diff(names[order]) == 0).any():
        raise ValueError("two stretches of the input have one name: rows were read twice")
    begins = ends - np.array([n for *_, n in rows], np.int64)
    return names[order], begins[order], int(ends[-1]) if rows else 0


PIECES = "slot long, at int, ids binary"


def pieces(ordered: DataFrame, path: str, names: np.ndarray, begins: np.ndarray, permutation: Permutation, length: int, end_id: int) -> DataFrame:
    """Rows (slot of a sequence, place in it, ids of 16 bits): whole sequences but for those that stretches share."""
    shared = ordered.sparkSession.sparkContext.broadcast((names, begins))  # two numbers a file split

    def batch(at: int, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The pieces of ids that begin at a place of the stream."""
        if ids.max(initial=0) > 0xFFFF:
            raise ValueError("ids of this vocabulary do not fit 16 bits")
        raw = ids.astype("<u2").tobytes()
        cuts = np.arange(at // length, (at + len(ids) - 1) // length + 1)
        lo = np.maximum(cuts * length, at) - at
        hi = np.minimum((cuts + 1) * length, at + len(ids)) - at
        slots = permutation.slot(cuts)
        for i in range(0, len(cuts), BATCH):
            part = slice(i, i + BATCH)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slots[part]), pa.array((lo[part] + at - cuts[part] * length).astype(np.int32)), pa.array([raw[2 * a : 2 * b] for a, b in zip(lo[part].tolist(), hi[part].tolist(), strict=True)], pa.binary())],
                names=["slot", "at", "ids"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, places = shared.value
        end = np.array([end_id], np.uint32)
        at, rest = 0, np.empty(0, np.uint32)
        for file, first, new, docs in _stretches(batches, tokens.bpe(path).encode_all):
            if new:
                if len(rest):
                    yield from batch(at, rest)
                i = int(np.searchsorted(known, _name(file, first)))
                if i == len(known) or known[i] != _name(file, first):
                    raise RuntimeError("the input is split in another way than when it was counted")
                at, rest = int(places[i]), np.empty(0, np.uint32)
            ids = np.concatenate([rest, *(x for d in docs for x in (d, end))])
            full = max(0, (at + len(ids)) // length * length - at)  # up to the last whole sequence's end
            if full:
                yield from batch(at, ids[:full])
            at, rest = at + full, ids[full:]
        if len(rest):
            yield from batch(at, rest)

    return ordered.mapInArrow(run, PIECES)


MANIFEST = "shard long, first_slot long, n_sequences long, n_bytes long, sha256 string, lengths binary, path string"


def materialise(docs: DataFrame, out: str, key: str, path: str | None = None, length: int = SEQUENCE, shard: int = SHARD, end_id: int = 0) -> DataFrame:
    """Write the shards below `out` and return their manifest, which is stored there too.

    A shard holds `shard` sequences, the last one what is left. lengths: the true length of each sequence of the
    shard, 16 bits each.
    """
    spark = docs.sparkSession
    path = path or tokens.default_path()
    ordered = in_order(docs)
    names, begins, total = starts(stretches(ordered, path))
    n = -(-total // length)
    permutation = Permutation(max(1, n), key)
    shards = max(1, -(-n // shard))
    tasks = min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shards // 16)))
    placed = pieces(ordered, path, names, begins, permutation, length, end_id).withColumn("task", F.expr(f"cast((slot div {shard}) * {tasks} div {shards} as int)"))
    ranges = placed.repartitionById(tasks, F.col("task")).sortWithinPartitions("slot", "at").select("slot", "at", "ids")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sizes, last = -1, [], [], -1

        def flush() -> pa.RecordBatch:
            name = f"{out}/shards/{now:09d}.bin"
            sizes_now = np.array(sizes, np.int64)
            for k in np.flatnonzero(sizes_now < length):
                ids[k] = ids[k] + np.full(length - sizes[k], end_id, "<u2").tobytes()
            data = b"".join(ids)
            with whole(name) as f:
                f.write(data)
            row = (now, now * shard, len(sizes), len(data), hashlib.sha256(data).hexdigest(), sizes_now.astype("<u2").tobytes(), name)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in MANIFEST.split(", ")])

        for block in batches:
            for slot, at, raw in zip(*(c.to_pylist() for c in block.columns), strict=True):
                if slot // shard != now:
                    if sizes:
                        yield flush()
                    now, ids, sizes, last = slot // shard, [], [], -1
                if slot == last:
                    if at != sizes[-1]:
                        raise ValueError(f"sequence at slot {slot} lacks ids")
                    ids[-1] += raw
                    sizes[-1] += len(raw) // 2
                else:
                    ids.append(raw)
                    sizes.append(len(raw) // 2)
                    last = slot
        if sizes:
            yield flush()

    ranges.mapInArrow(write, MANIFEST).write.parquet(f"{out}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{out}/manifest")


def read_from(shard_path: str, lengths: bytes, first: int = 0, length: int = SEQUENCE) -> Iterator[np.ndarray]:
    """The sequences of a shard from its record `first` on, without what fills up the last ones: a resumed read."""
    sizes = np.frombuffer(lengths, "<u2")
    raw = content(shard_path, first * 2 * length)
    for k, n in enumerate(sizes[first:]):
        yield np.frombuffer(raw, "<u2", int(n), k * 2 * length)


READ = "slot long, shard long, place long, n_tokens long, ids_crc32 long"


def read_back(manifest: DataFrame, length: int = SEQUENCE) -> DataFrame:
    """One row a sequence, read from the shard files: slot, shard, place there, ids and their CRC (32 bits each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in batches:
            for number, first, lengths, path in zip(*(c.to_pylist() for c in block.columns), strict=True):
                rows = [(first + k, number, k, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for k, ids in enumerate(read_from(path, lengths, length=length))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[x.split()[0] for x in READ.split(", ")])

    tasks = max(1, min(manifest.count(), MOST_TASKS))  # given as a number, so that the few small rows still spread
    return manifest.select("shard", "first_slot", "lengths", "path").repartition(tasks).mapInArrow(run, READ)


def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(materialise(table(spark, sf_dir, "documents"), shared_dir(spark, "order"), key="epoch-0"))
