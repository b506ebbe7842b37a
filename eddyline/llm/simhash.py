"""SimHash near-duplicates through a self-join of a binary trie.

Equal fingerprints are one leaf. The trie is walked in pairs of nodes of one depth: a pair carries the bits in
which its prefixes differ, its children are the pairs of children, and a pair beyond the budget is dropped with
all that lies below it. Small pairs of subtrees are compared leaf by leaf.

To spread the walk over a cluster the 64 bits are cut into budget + 1 runs. Two fingerprints within the budget
agree on one run at least, so each run in turn leads the trie, its levels have budget 0, and subtrees below
different leading runs need not meet: they go to different tasks. A leading run that very many fingerprints
share is divided further, at a depth below it that grows with their number, into the pairs of nodes that the walk
would reach there.

A task returns a spanning forest of the links it found, which loses no connection; components over all forests
come from alternating stars. Nothing is gathered on the driver.

Rows: null and empty texts have no word and the fingerprint zero, linked like any other; a very long text is cut
into overlapping lists of words. Repeated rows are repeated in the result; rows of one doc_id with several texts have
a fingerprint and a component each. A null doc_id joins no component: its component_id is the smallest id of the
component that its text belongs to, or null if that has none. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eddyline.llm.common import blocks, stored, table
from eddyline.llm.components import components, local_forest

#: Pairs of leaves compared at once, and in one pair of nodes before it is divided instead.
CHUNK, LEAF = 1 << 21, 512
#: Fingerprints that share a leading run before it is divided, by how many levels at a time, and how often at most.
HOT_RUN, HOT_LEVELS, HOT_STEPS = 200_000, 6, 4
#: Pairs of nodes that a fingerprint is sent to at most, besides the first step.
MOST_MASKS = 1000
#: Fingerprints, counted once for each run of bits, that one task joins.
TASK_ROWS = 3_000_000
#: Bytes of a text whose words are held at once.
SLICE_BYTES = 8 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _word_lists(raw: bytes, words: int) -> Iterator[list[bytes]]:
    """The words of a text in lists that overlap by words - 1: one list, but for very long texts."""
    carry: list[bytes] = []
    at = 0
    while at < len(raw):
        end = len(raw)
        if end - at > SLICE_BYTES:
            m = _BLANK.search(raw, at + SLICE_BYTES)
            end = m.start() if m else end
        carry += raw[at:end].split()
        yield carry
        carry = carry[max(0, len(carry) - words + 1) :]
        at = end


def fingerprint(text: str, words: int = 3) -> int:
    """SimHash of the word shingles of a text: a bit is set if over half of the shingles' XXH64 have it."""
    raw = text.encode("utf-8", "surrogatepass").lower()  # bytes: only A-Z fold, only ASCII blanks part words
    counts, n, short = np.zeros(64, np.int64), 0, []
    for w in _word_lists(raw, words):
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False))), np.uint64)
        n += len(hashes)
        short = w
        for i in range(0, len(hashes), 1 << 15):
            part = hashes[i : i + (1 << 15)]
            counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(short), 42) if short else 0
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def row_mark() -> F.Column:
    """A number of a row's text; with the doc_id it names the row."""
    return F.xxhash64(F.col("text").cast("string")).alias("mark")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, the mark of the text and the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 2):
            fps = np.array([fingerprint(t or "", words) for t in block.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array(fps)], names=["doc_id", "mark", "fp"])

    return docs.select(F.col("doc_id").cast("long"), row_mark(), F.col("text").cast("string")).mapInArrow(run, "doc_id long, mark long, fp long")


def runs(budget: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the runs that lead the trie in turn; bits count from the highest."""
    cuts = np.linspace(0, 64, budget + 2).round().astype(int)
    return [(int(a), int(b - a)) for a, b in zip(cuts, cuts[1:], strict=False)]


def trie_links(fp: np.ndarray, lows: np.ndarray, highs: np.ndarray, lows2: np.ndarray, highs2: np.ndarray, differ: np.ndarray, depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs within the budget, in chunks.

    fp: unsigned fingerprints, sorted within each node's range. A pair of nodes is [lows, highs) and
    [lows2, highs2), equal for a node with itself, both at `depth`, with `differ` bits apart so far.
    """
    ones: dict[int, np.ndarray] = {}
    stack = [(depth, lows, highs, lows2, highs2, differ)]
    while stack:
        depth, alo, ahi, blo, bhi, diff = stack.pop()
        own = alo == blo
        size = (ahi - alo) * (bhi - blo)
        leaf = (size <= LEAF) | (depth >= 64)
        if leaf.any():
            yield from _leaves(fp, *(x[leaf] for x in (alo, ahi, blo, bhi)), budget)
        if leaf.all():
            continue
        alo, ahi, blo, bhi, diff, own = (x[~leaf] for x in (alo, ahi, blo, bhi, diff, own))
        if depth not in ones:
            ones[depth] = np.concatenate([[0], np.cumsum((fp >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)])
        c = ones[depth]
        amid, bmid = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo])
        kids = [
            np.concatenate(x)
            for x in zip(
                (alo, amid, blo, bmid, diff),
                (amid, ahi, bmid, bhi, diff),
                (alo, amid, bmid, bhi, diff + 1),
                (amid[~own], ahi[~own], blo[~own], bmid[~own], diff[~own] + 1),
                strict=True,
            )
        ]
        alive = (kids[0] < kids[1]) & (kids[2] < kids[3]) & (kids[4] <= budget) & ~((kids[0] == kids[2]) & (kids[1] - kids[0] < 2))
        kids = [x[alive] for x in kids]
        for i in range(0, len(kids[0]), CHUNK):
            stack.append((depth + 1, *(x[i : i + CHUNK] for x in kids)))


def _leaves(fp, alo, ahi, blo, bhi, budget) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    wide = bhi - blo
    size = (ahi - alo) * wide
    ends = np.cumsum(size)
    first = 0
    while first < len(size):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + CHUNK, "right")))
        part = slice(first, last)
        of = np.repeat(np.arange(first, last), size[part])
        k = np.arange(len(of)) - np.repeat(ends[part] - size[part] - (ends[first] - size[first]), size[part])
        i, j = alo[of] + k // wide[of], blo[of] + k % wide[of]
        near = (np.bitwise_count(fp[i] ^ fp[j]) <= budget) & ((alo[of] != blo[of]) | (i < j))
        yield i[near], j[near]
        first = last


def links(nodes: DataFrame, budget: int = 2, hot_run: int = HOT_RUN, hot_levels: int = HOT_LEVELS) -> DataFrame:
    """A spanning forest (u, v), for each task, of the links between the distinct fingerprints (fp, node)."""
    turns = runs(budget)
    rotated = F.array(*(F.shiftleft("fp", a).bitwiseOR(F.shiftrightunsigned("fp", 64 - a)) if a else F.col("fp") for a, _ in turns))
    led = nodes.where("node is not null").select("node", F.posexplode(rotated).alias("turn", "fp"))
    width = F.element_at(F.array(*(F.lit(64 - n) for _, n in turns)), F.col("turn") + 1)
    led = led.withColumn("w", width).selectExpr("node", "turn", "fp", "shiftrightunsigned(fp, w) as run")
    hot = led.groupBy("turn", "run").count().where(F.col("count") > hot_run)
    deep = [hot_levels * i for i in range(1, HOT_STEPS + 1) if i == 1 or sum(comb(hot_levels * i, n) for n in range(budget + 1)) <= MOST_MASKS]
    steps = F.least(F.lit(len(deep)), F.ceil(F.log(F.col("count") / hot_run) / F.log(F.lit(2.0**hot_levels)))).cast("int")
    hot = hot.select("turn", "run", (F.greatest(F.lit(1), steps) * hot_levels).alias("level"))
    led = led.join(hot, ["turn", "run"], "left").withColumn("level", F.coalesce("level", F.lit(0)))
    start = F.element_at(F.array(*(F.lit(n) for _, n in turns)), F.col("turn") + 1)
    low = led.withColumn("s", start).selectExpr("*", "cast(if(level = 0, 0, shiftrightunsigned(shiftleft(fp, s), 64 - level)) as int) as prefix")
    # the differences within the budget of prefixes of so many bits
    masks = F.array(F.lit(-1))
    for level in deep:
        own = [sum(1 << b for b in bits) for n in range(budget + 1) for bits in combinations(range(level), n)]
        masks = F.when(F.col("level") == level, F.array(*map(F.lit, own))).otherwise(masks)
    low = low.select("node", "turn", "run", "fp", "level", "prefix", F.explode(masks).alias("mask"))
    # a pair of nodes below a hot run is named by its smaller prefix and what they differ in
    low = low.selectExpr("node", "turn", "run", "fp", "level", "mask", "case when mask >= 0 then least(prefix, prefix ^ mask) else -1 end as pair", "case when mask > 0 and prefix > (prefix ^ mask) then 1 else 0 end as side")
    spark = nodes.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), nodes.count() * len(turns) // TASK_ROWS)
    dealt = low.repartition(tasks, "turn", "run", "pair", "mask")

    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        got = {n: np.concatenate([b.column(n).to_numpy(zero_copy_only=False) for b in parts]) for n in ("node", "turn", "run", "fp", "level", "mask", "pair", "side")}
        fp = got["fp"].view(np.uint64)
        order = np.lexsort((fp, got["side"], got["mask"], got["pair"], got["run"], got["turn"]))
        got, fp = {n: x[order] for n, x in got.items()}, fp[order]
        key = np.stack([got[n] for n in ("turn", "run", "pair", "mask")])
        new = np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)])
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(fp))
        ids, at = np.unique(got["node"], return_inverse=True)
        labels = np.arange(len(ids))
        right = np.concatenate([[0], np.cumsum(got["side"], dtype=np.int64)])
        middle = ends - (right[ends] - right[starts])
        turn, mask, level = got["turn"][starts], got["mask"][starts], got["level"][starts]
        for t, (_, n) in enumerate(turns):
            for below in np.unique(level[turn == t]).tolist():
                pick = (turn == t) & (level == below)
                across = pick & (mask > 0)
                self_ = pick & ~across & (ends - starts > 1)
                lo, hi = np.concatenate([starts[self_], starts[across]]), np.concatenate([ends[self_], middle[across]])
                lo2, hi2 = np.concatenate([starts[self_], middle[across]]), np.concatenate([ends[self_], ends[across]])
                diff = np.concatenate([np.zeros(self_.sum(), np.int64), np.bitwise_count(mask[across]).astype(np.int64)])
                full = (lo < hi) & (lo2 < hi2)
                if full.any():
                    for i, j in trie_links(fp, lo[full], hi[full], lo2[full], hi2[full], diff[full], n + below, budget):
                        labels = local_forest(len(ids), at[i], at[j], labels)
        other = np.flatnonzero(labels != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[other]), pa.array(ids[labels[other]])], names=["u", "v"])

    return dealt.mapInArrow(run_task, "u long, v long")


def classes(docs: DataFrame, words: int = 3, budget: int = 2, hot_run: int = HOT_RUN, hot_levels: int = HOT_LEVELS) -> DataFrame:
    """doc_id, mark, fp, class (a number of the component) and component_id: the smallest doc_id reachable over links."""
    marked = stored(fingerprints(docs, words), "simhash")
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    linked = nodes.where("least is not null").select("fp", F.col("fp").alias("node"))
    return with_components(marked, nodes, components(links(linked, budget, hot_run, hot_levels), "simhash-links"), "fp")


def with_components(marked: DataFrame, nodes: DataFrame, joined: DataFrame, key: str) -> DataFrame:
    """The marked rows with their node's component, `class`, and the smallest `least` of its nodes (key, least), component_id."""
    named = nodes.join(joined.withColumnRenamed("node", key), key, "left").select(key, "least", "component")
    smallest = named.where("component is not null").groupBy("component").agg(F.min("least").alias("smallest"))
    of = named.join(smallest, "component", "left").select(key, F.coalesce("component", key).alias("class"), F.coalesce("smallest", "least").alias("component_id"))
    return marked.join(of, key, "left")


def near_duplicates(docs: DataFrame, words: int = 3, budget: int = 2, hot_run: int = HOT_RUN, hot_levels: int = HOT_LEVELS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id: the smallest doc_id reachable over links."""
    made = classes(docs, words, budget, hot_run, hot_levels)
    return made.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, words: int = 3, budget: int = 2) -> DataFrame:
    """The documents, all columns kept, that stand first in each group of near-duplicates; see `first_of`."""
    return first_of(docs, classes(docs, words, budget))


def first_of(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """One document, all columns kept, of each class (doc_id, mark, class, component_id): the row with the smallest id.

    A row is named by its doc_id and the mark of its text, so an id with several texts may stand in several classes
    and loses only the rows that are copies. Several texts of that id in one class: the smallest mark stays. Rows
    that are equal in both: the first in order of the other columns that can be ordered stays. Rows without an id
    are no one's copies and stay.
    """
    marks = stored(classes.where("doc_id is not null").groupBy("doc_id", "mark", "class", "component_id").agg(F.count("*").alias("rows")), "first-marks")
    best = marks.where("doc_id = component_id").groupBy("class").agg(F.min("mark").alias("best"))
    # stored, so that the planner knows its size: below its threshold for broadcasts no text is shuffled
    later = stored(marks.join(best, "class").where("doc_id <> component_id or mark <> best").select("doc_id", "mark"), "first-later")
    marked = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__mark": row_mark()})
    kept = marked.join(later.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")), ["__id", "__mark"], "left_anti")
    repeated = marks.where("rows > 1").select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"))
    if repeated.isEmpty():
        return kept.select(docs.columns)
    plain = [c for c, kind in docs.dtypes if not any(x in kind for x in ("map<", "variant")) and c != "text"]
    row = F.struct(*(F.col(c) for c in docs.columns))
    first = kept.join(repeated, ["__id", "__mark"], "left_semi").groupBy("__id", "__mark").agg(F.min_by(row, F.struct(*plain)).alias("__row"))
    return kept.join(repeated, ["__id", "__mark"], "left_anti").select(docs.columns).unionByName(first.select("__row.*"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
