"""Benchmark decontamination by pigeonhole edit matching.

A test item may be found with up to `budget` edits. Cut into budget + 1 pieces, one piece at least survives any
such edits unchanged, so exact piece hits (one automaton over all pieces of all items) give every place worth a
look; Myers' bit-parallel distance of the whole item decides there. Both sides are compared in lower case with
runs of white space as one blank.

The items are the query set and are taken in blocks of bounded size, each searched against all documents in one
scan; no document leaves its task. Items shorter than `least_chars` are searched without edits, between word
boundaries; as long as a name or two, such an item may be ordinary vocabulary, so `drop_leaks` drops no document for
an item of fewer than `least_words` words (`find_leaks` reports them all).

Rows: null and empty texts match nothing; null and empty items are not searched; a null item_id stays null; repeated
documents and repeated items give repeated rows; a very long text is searched as a whole; other columns are kept by
`drop_leaks` and not read by `find_leaks`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eddyline.llm.common import blocks, table

#: Edits allowed for each character of an item.
ERROR_RATE = 0.1
#: Items of fewer characters are searched exactly.
LEAST_CHARS = 24
#: Words of an item that a document is dropped for.
LEAST_WORDS = 3
#: Characters of items that one scan searches for.
BLOCK_CHARS = 4 << 20


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces that cover the item, with their places; lengths differ by one at most."""
    n = budget + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


class Myers:
    """Distances of one pattern to the substrings of a text that end at each place."""

    def __init__(self, pattern: str):
        self.m = len(pattern)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.masks[c] = self.masks.get(c, 0) | 1 << i
        self.all, self.top = (1 << self.m) - 1, 1 << self.m - 1

    def best(self, text: str) -> tuple[int, int]:
        """The least distance and the first end (exclusive) that has it; the empty substring counts at 0."""
        plus, minus, score = self.all, 0, self.m
        least, end = self.m, 0
        masks, all_, top = self.masks, self.all, self.top
        for j, c in enumerate(text):
            eq = masks.get(c, 0)
            across = (((eq & plus) + plus) ^ plus) | eq | minus
            up, down = minus | all_ & ~(across | plus), plus & across
            if up & top:
                score += 1
            elif down & top:
                score -= 1
                if score < least:
                    least, end = score, j + 1
            up, down = up << 1 & all_, down << 1 & all_
            eq |= minus
            plus, minus = down | all_ & ~(eq | up), up & eq
        return least, end


class Item:
    """A test item, its pieces, and for each piece the runs of pieces that contain it, smallest first, the whole last."""

    def __init__(self, key: int, text: str, error_rate: float, least_chars: int = 0):
        self.short = len(text) < least_chars
        self.key, self.text, self.budget = key, text, 0 if self.short else int(len(text) * error_rate)
        self.pieces = pieces(text, self.budget)
        self.cuts = [at for at, _ in self.pieces] + [len(text)]
        self.runs: list[list[tuple[int, int]]] = [[] for _ in self.pieces]
        self._halve(0, len(self.pieces))
        self._patterns: dict[tuple[int, int], Myers] = {}

    def _halve(self, a: int, b: int) -> None:
        if b - a > 1:
            self._halve(a, (a + b) // 2)
            self._halve((a + b) // 2, b)
            for p in range(a, b):
                self.runs[p].append((a, b))

    def pattern(self, a: int, b: int) -> Myers:
        if (a, b) not in self._patterns:
            self._patterns[a, b] = Myers(self.text[self.cuts[a] : self.cuts[b]])
        return self._patterns[a, b]

    def span(self, text: str, piece: int, start: int, a: int, b: int) -> tuple[int, int]:
        """Where the run a..b of pieces can lie in a text that has the piece at `start`."""
        edits = b - a - 1
        return max(0, start - (self.cuts[piece] - self.cuts[a]) - edits), min(len(text), start + self.cuts[b] - self.cuts[piece] + edits)

    def bounded(self, text: str, start: int) -> bool:
        """Whether the whole item at `start` is not a part of longer words."""
        end = start + len(self.text)
        before = start and text[start - 1].isalnum() and self.text[0].isalnum()
        return not before and not (end < len(text) and text[end].isalnum() and self.text[-1].isalnum())

    def survives(self, text: str, piece: int, start: int) -> bool:
        for a, b in self.runs[piece][:-1]:
            lo, hi = self.span(text, piece, start, a, b)
            if self.pattern(a, b).best(text[lo:hi])[0] > b - a - 1:
                return False
        return True


class Matcher:
    """One automaton over the pieces of a block of items."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float, least_chars: int = 0):
        import ahocorasick

        self.items = [Item(key, text, error_rate, least_chars) for key, text in items]
        where: dict[str, list[tuple[int, int]]] = {}
        for i, item in enumerate(self.items):
            for p, (_, piece) in enumerate(item.pieces):
                where.setdefault(piece, []).append((i, p))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()

    def find(self, text: str, first_only: bool = False) -> list[tuple[int, int, int, int]]:
        """(number of the item, distance, start, end) of the best place of each item within its budget."""
        if not self.items or not text:
            return []
        spans: dict[int, list[list[int]]] = {}
        for last, (n, places) in self.automaton.iter(text):
            start = last + 1 - n
            for i, p in places:
                item = self.items[i]
                if item.short and (i in spans or not item.bounded(text, start)):
                    continue
                lo, hi = item.span(text, p, start, 0, len(item.pieces))
                own = spans.get(i)
                if own and own[-1][0] <= lo and hi <= own[-1][1] or not item.survives(text, p, start):
                    continue
                if own and lo <= own[-1][1]:  # hits come in order of their ends
                    own[-1][0], own[-1][1] = min(lo, own[-1][0]), max(hi, own[-1][1])
                else:
                    spans.setdefault(i, []).append([lo, hi])
        out = []
        for i, own in sorted(spans.items()):
            item = self.items[i]
            best = None
            for lo, hi in own:
                least, end = item.pattern(0, len(item.pieces)).best(text[lo:hi])
                if least <= item.budget and (best is None or least < best[0]):
                    best = (least, lo, lo + end)
            if best:
                least, lo, end = best
                _, length = Myers(item.text[::-1]).best(text[lo:end][::-1])
                out.append((i, least, end - length, end))
                if first_only:
                    break
        return out


_matchers: dict[tuple, Matcher] = {}


def matcher(items: list[tuple[int, str]], error_rate: float, least_chars: int) -> Matcher:
    """The matcher of this worker for a block of items; the last few are kept."""
    key = (tuple(items), error_rate, least_chars)
    if key not in _matchers:
        if len(_matchers) > 3:
            _matchers.clear()
        _matchers[key] = Matcher(items, error_rate, least_chars)
    return _matchers[key]


def item_blocks(benchmark: DataFrame, least_words: int, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The normalised items in blocks of bounded size; the driver holds one block at a time."""
    block: list[tuple[int, str]] = []
    size = 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text").toLocalIterator():
        text = normal(r["text"])
        if not text or text.count(" ") + 1 < least_words:
            continue
        if block and size + len(text) > block_chars:
            yield block
            block, size = [], 0
        block.append((r["item_id"], text))
        size += len(text)
    if block:
        yield block


FOUND = "doc_id long, item_id long, distance int, start_char int, end_char int"


def find_leaks(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, least_chars: int = LEAST_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for a document and an item found in it: edits, start and end of its best place in the normal form."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = spark.createDataFrame([], FOUND)
    for block in item_blocks(benchmark, 1, block_chars):
        shared = spark.sparkContext.broadcast(block)  # at most block_chars characters, or one item

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            m = matcher(items, error_rate, least_chars)
            for part in blocks(batches, 1):
                rows = [(d, items[i][0], *rest) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for i, *rest in m.find(normal(t))]
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in FOUND.split(", ")])

        out = out.unionByName(texts.mapInArrow(run, FOUND))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, least_chars: int = LEAST_CHARS, block_chars: int = BLOCK_CHARS, least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents, all columns kept, in which no item of `least_words` words or more is found."""
    at = docs.columns.index("text")
    for block in item_blocks(benchmark, least_words, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = matcher(shared.value, error_rate, least_chars)
            for part in blocks(batches, at):
                yield part.filter(pa.array([not m.find(normal(t), first_only=True) for t in part.column(at).to_pylist()]))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
