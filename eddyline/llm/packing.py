"""Harmonic packing of documents into token sequences of a fixed capacity.

A piece of length n belongs to class k = capacity // n, and a bin of class k takes exactly k pieces: no search
over open bins, no state besides one open bin a class, and so no exchange between workers. Documents may be cut,
so they are cut where classes waste nothing: whole sequences first, then, as long as the rest is longer than
`whole_below`, the longest piece capacity // k that fits. The last piece keeps its length.

At the end of a partition, bins that lack pieces are emptied and their pieces, a bounded number, are placed best
fit decreasing; a remaining gap is closed with sequences of a power of two, which need no padding, by cutting.

No row leaves its partition: nothing is shuffled, a hot source is like any other, and a lost task is computed
again from its file split with the same result. Sequence ids are unique over all partitions.

Null texts count as empty: such a document is its end token alone. Repeated rows are documents of their own.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eddyline.llm import tokens
from eddyline.llm.common import blocks, table

#: A piece: number of its document within the partition, first id, length.
Piece = tuple[int, int, int]
#: Bits of a sequence id below the partition's number.
LOCAL_BITS = 36


def cut(length: int, capacity: int, whole_below: int) -> list[int]:
    """Lengths of the pieces that a document of so many ids is cut into; all but the last waste nothing in their class."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest > whole_below:
        piece = capacity // -(-capacity // rest)
        out.append(piece)
        rest -= piece
    return out + [rest] * (rest > 0)


class Packer:
    """The open bins of one partition. `emit` gets each finished sequence: its pieces in order."""

    def __init__(self, capacity: int, emit: Callable[[list[Piece]], None], whole_below: int | None = None):
        self.capacity, self.emit = capacity, emit
        self.whole_below = max(1, capacity // 16) if whole_below is None else whole_below
        self.open: dict[int, list[Piece]] = {}

    def add(self, doc: int, length: int) -> None:
        start = 0
        for n in cut(length, self.capacity, self.whole_below):
            k = self.capacity // n
            pieces = self.open.setdefault(k, [])
            pieces.append((doc, start, n))
            if len(pieces) == k:
                self.emit(pieces)
                del self.open[k]
            start += n

    def close(self) -> None:
        """Pack what unfinished bins hold: fewer than k pieces of each class, at most."""
        rest = sorted((p for pieces in self.open.values() for p in pieces), key=lambda p: (-p[2], p))
        self.open.clear()
        bins: list[list[Piece]] = []
        gaps: list[tuple[int, int]] = []  # free ids of each bin, and the bin, in order
        for p in rest:
            i = bisect_left(gaps, (p[2], -1))
            if i < len(gaps):
                free, b = gaps.pop(i)
            else:
                bins.append([])
                free, b = self.capacity, len(bins) - 1
            bins[b].append(p)
            if free > p[2]:
                insort(gaps, (free - p[2], b))
        for pieces in bins:
            self._without_padding(pieces)

    def _without_padding(self, pieces: list[Piece]) -> None:
        total = sum(p[2] for p in pieces)
        if self.capacity - total <= self.capacity // 64:  # not worth more cuts
            return self.emit(pieces)
        queue = pieces[::-1]
        while total:
            size = 1 << total.bit_length() - 1
            out, have = [], 0
            while have < size:
                doc, start, n = queue.pop()
                if have + n > size:
                    queue.append((doc, start + size - have, n - (size - have)))
                    n = size - have
                out.append((doc, start, n))
                have += n
            self.emit(out)
            total -= size


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str | None = None, capacity: int = 1024, end_id: int = 0) -> DataFrame:
    """One row a piece: its document, its place there, the CRC of its ids, its sequence and its place in that.

    path: a byte-level BPE vocabulary file that all workers have. Each document's ids end with `end_id`.
    """
    path = path or tokens.default_path()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.bpe(path).encode
        base = TaskContext.get().partitionId() << LOCAL_BITS
        done: list[list[Piece]] = []
        packer = Packer(capacity, done.append)
        known: dict[int, list] = {}  # documents with pieces in open bins: id, ids, ids not yet emitted
        made = docs_seen = 0

        def rows() -> Iterator[pa.RecordBatch]:
            nonlocal made
            out: list[tuple] = []
            for pieces in done:
                at = 0
                for doc, start, n in pieces:
                    entry = known[doc]
                    ids = entry[1]
                    out.append((entry[0], start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids), base + made, at))
                    at += n
                    entry[2] -= n
                    if not entry[2]:
                        del known[doc]
                made += 1
            done.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for block in blocks(batches, 1):
            for doc_id, text in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or "").astype("<u4"), np.array([end_id], "<u4"))
                known[docs_seen] = [doc_id, ids, len(ids)]
                packer.add(docs_seen, len(ids))
                docs_seen += 1
            yield from rows()
        packer.close()
        yield from rows()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
