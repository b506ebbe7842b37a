"""Near copies by the Jaccard similarity of word shingles: SimHash tries and MinHash propose, exact sets decide.

Texts with one set of shingles are one node. A node has several SimHash fingerprints of its shingles. Each is joined
with itself in operator 9's trie, with a wider budget of bits, and a node is compared with the smallest one of each
component that a task of that walk finds, or of its own leaf. A fingerprint of 64 bits cannot hold all pairs that are
asked for: at a similarity of 0.8 two differ in 10 bits on average, and a trie of such a budget prunes nothing. For
the rest a node's MinHash is cut into bands; nodes that share a band are candidates, which misses a pair of similarity
0.8 with a chance of (1 - 0.8^4)^24 = 3e-6 and a closer one more rarely.

With these, every node is compared with the smallest node of each of its bands: as many pairs as there are nodes,
however large a band is, and enough to join a text and its copies. A band whose nodes are then in one component is settled.
In an open band the nodes of different components are compared with each other, those of one component are passed
over. All comparisons are exact. The nodes of a centre, or of an open band, are cut into blocks of bounded rows and
shingles; a block with its centre, or a pair of blocks, is a task's unit of work, so a very large group is dealt out
and no pair becomes a row. Within a pair of blocks candidates are found by prefixes: shingles are ordered by their
number in the unit, rarest first, and two sets of similarity t share one of the first n - ceil(t n) + 1 of each.
A unit returns links; components over all of them come from alternating stars.

Rows: words are those of operator 9 (only A-Z fold, only ASCII blanks part words; very long texts are cut into
overlapping lists of words). A text of fewer words than a shingle is one shingle; null and empty texts have none and
are copies of each other. Repeated rows are one node. A null doc_id joins no component: its component_id is that of
its text, or null if no row with an id has it. Rows of one doc_id with several texts are nodes of their own. Other
columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddyline.llm.common import blocks, stored
from eddyline.llm.components import components
from eddyline.llm.simhash import _word_lists, links, row_mark, with_components

#: SimHash fingerprints of a node, and the bits in which two of one number may differ to be linked in its trie.
FINGERPRINTS, BITS = 4, 4

#: Bands of a MinHash and hashes in a band.
BANDS, ROWS = 24, 4
#: Nodes and shingles of one block of a centre's or an open band's nodes.
BLOCK_NODES, BLOCK_SHINGLES = 500, 1_000_000
_ODD = (np.random.default_rng(17).integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_MIX = np.random.default_rng(19).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, words: int = 5) -> set[bytes]:
    """The word shingles of a text as they are."""
    out: set[bytes] = set()
    last: list[bytes] = []
    for last in _word_lists((text or "").encode("utf-8", "surrogatepass").lower(), words):
        out.update(map(b" ".join, zip(*(last[k:] for k in range(words)), strict=False)))
    return out or ({b" ".join(last)} if last else out)


def hashed(text: str | None, words: int = 5) -> np.ndarray:
    """64-bit hashes of the distinct shingles, sorted."""
    parts, last = [], []
    for last in _word_lists((text or "").encode("utf-8", "surrogatepass").lower(), words):
        h = np.fromiter(map(xxhash.xxh64_intdigest, last), np.uint64, len(last))
        n = len(h) - words + 1
        if n > 0:
            s = h[:n] * _MIX[0]
            for k in range(1, words):
                s = (s ^ (s >> np.uint64(29))) * _MIX[k] + h[k : k + n]
            s = (s ^ (s >> np.uint64(32))) * _MIX[words]
            parts.append(s ^ (s >> np.uint64(29)))
    if not parts:
        return np.array([xxhash.xxh64_intdigest(b" ".join(last), 42)] if last else [], np.uint64)
    return np.unique(np.concatenate(parts))


def key(hashes: np.ndarray) -> int:
    """One number for a set of shingles, as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 7)).view(np.int64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A number for each band of the MinHash; none for an empty set."""
    if not len(hashes):
        return np.array([], np.int64)
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.min([(high[i : i + 4096] * _ODD).min(1) for i in range(0, len(high), 4096)], axis=0)
    return np.array([xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)], np.uint64).view(np.int64)


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    """The SimHash fingerprints of a set of shingles as signed longs, each from hashes of its own."""
    out = np.zeros(FINGERPRINTS, np.int64)
    for k in range(FINGERPRINTS if len(hashes) else 0):
        counts = np.zeros(64, np.int64)
        for i in range(0, len(hashes), 1 << 15):
            h = hashes[i : i + (1 << 15)]
            if k:
                h = (h ^ (h >> np.uint64(31))) * _MIX[-k]
                h ^= h >> np.uint64(32)
            counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[k] = np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0]
    return out


def marks(docs: DataFrame, words: int = 5) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 2):
            sets = [hashed(t, words) for t in block.column(2).to_pylist()]
            columns = [block.column(0), block.column(1), pa.array([key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([bands(s) for s in sets], pa.list_(pa.int64())), pa.array([fingerprints(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "key", "n", "bands", "fps"])

    return docs.select(F.col("doc_id").cast("long"), row_mark(), F.col("text").cast("string")).mapInArrow(run, "doc_id long, mark long, key long, n long, bands array<long>, fps array<long>")


def trie_rows(nodes: DataFrame) -> DataFrame:
    """Rows (key, centre) of the nodes that a trie of fingerprints links; the centre is the smallest node of a leaf or of what a task links."""
    found = []
    for k in range(FINGERPRINTS):
        own = nodes.select("key", F.element_at("fps", k + 1).alias("fp"))
        leaves = own.groupBy("fp").agg(F.min("key").alias("node"))
        found += [own.join(leaves, "fp").where("key <> node").select("key", F.col("node").alias("centre")), links(leaves, BITS).toDF("key", "centre")]
    return reduce(DataFrame.unionByName, found).distinct()


def band_rows(nodes: DataFrame) -> DataFrame:
    """Rows (band, key, centre) of the nodes that share a band with others; the centre is the band's smallest node."""
    rows = nodes.select("key", F.explode("bands").alias("band"))
    centres = rows.groupBy("band").agg(F.min("key").alias("centre"), F.max("key").alias("last")).where("centre <> last")
    return rows.join(centres.drop("last"), "band").where("key <> centre")


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i


def unit_links(texts: list[str], sides: list[int], across: bool, words: int, least: Fraction, joined: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of texts with at least this similarity; `across`: of different sides only.

    joined: for each text the number of a component that it is in already.
    """
    sets = [hashed(t, words) for t in texts]
    sizes = [len(s) for s in sets]
    _, rank, number = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.empty(len(number), np.int64)
    order[np.argsort(number, kind="stable")] = np.arange(len(number))
    ends = np.cumsum(sizes)
    ranked = [np.sort(order[rank[e - n : e]]) for e, n in zip(ends, sizes, strict=True)]
    union, postings, out = _Union(len(texts)), defaultdict(list), []
    first: dict[int, int] = {}
    for i, c in enumerate(joined or ()):
        union.up[i] = first.setdefault(c, i)
    for i in sorted(range(len(texts)), key=lambda i: sizes[i]):
        n = sizes[i]
        prefix = ranked[i][: n - -(-least.numerator * n // least.denominator) + 1].tolist()
        for j in sorted({j for s in prefix for j in postings[s]}):
            if across and sides[i] == sides[j] or sizes[j] * least.denominator < n * least.numerator or union.root(i) == union.root(j):
                continue
            both = n + sizes[j] - len(np.union1d(ranked[i], ranked[j]))
            if _enough(both, n, sizes[j], least) and similar(texts[i], texts[j], words, least):
                union.up[union.root(i)] = union.root(j)
                out.append((i, j))
        for s in prefix:
            postings[s].append(i)
    return out


def _enough(both: int, n: int, m: int, least: Fraction) -> bool:
    return both * least.denominator >= (n + m - both) * least.numerator


def similar(a: str, b: str, words: int, least: Fraction) -> bool:
    """Whether the sets of shingles themselves, not their hashes, are that similar."""
    x, y = shingles(a, words), shingles(b, words)
    return _enough(len(x & y), len(x), len(y), least)


def _cuts(rows: DataFrame, group: str, block_nodes: int, block_shingles: int) -> DataFrame:
    """Blocks (group, cut) that the rows (group, n) of each group are dealt to."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("rows"), F.sum("n").alias("all"))
    return sizes.select(group, F.greatest(F.lit(1), F.ceil(F.col("rows") / block_nodes), F.ceil(F.col("all") / block_shingles)).cast("int").alias("cut"))


def _block() -> F.Column:
    return F.pmod(F.xxhash64("key"), F.col("cut")).cast("int")


def _texts(docs: DataFrame, nodes: DataFrame, asked: DataFrame, deal: list[str], order: list[str]) -> DataFrame:
    """The asked rows (key, ...) with the text of each one's node, dealt by `deal` and sorted by `order`, then key."""
    texts = docs.select(F.col("doc_id").cast("long").alias("least"), row_mark(), F.col("text").cast("string").alias("text"))
    # stored, so that the planner knows its size: below its threshold for broadcasts the texts that no one asks for stay
    asked = stored(nodes.select("key", "least", "mark").join(asked, "key"), "shingles-asked")
    rows = texts.join(asked, ["least", "mark"]).drop("least", "mark")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, *deal).sortWithinPartitions(*order, "key")


def _units(batches: Iterator[pa.RecordBatch], deal: list[str]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    def rows() -> Iterator[dict]:
        for batch in batches:
            for block in blocks([batch], batch.schema.get_field_index("text")):
                yield from block.to_pylist()

    def once(unit: Iterator[dict]) -> Iterator[dict]:
        last = None
        for r in unit:
            if r["key"] != last:  # rows that are repeated in the table
                last = r["key"]
                yield r

    for name, unit in groupby(rows(), lambda r: tuple(r[d] for d in deal)):
        yield name, once(unit)


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["u", "v"])


def star_links(docs: DataFrame, nodes: DataFrame, shared: DataFrame, words: int, least: Fraction, block_nodes: int, block_shingles: int) -> DataFrame:
    """Links (u, v) of the nodes that are similar to a centre that they are shared with."""
    pairs = stored(shared.select("key", "centre").distinct().join(nodes.select("key", "n"), "key"), "shingles-stars")
    cuts = _cuts(pairs, "centre", block_nodes, block_shingles)
    members = pairs.join(cuts, "centre").select("key", "centre", _block().alias("block"), F.lit(1).alias("side"))
    middles = cuts.select(F.col("centre").alias("key"), "centre", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)).alias("block"), F.lit(0).alias("side"))
    deal = ["centre", "block", "side"]
    dealt = _texts(docs, nodes, members.unionByName(middles), deal[:2], deal)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, middle, text = None, None, ""
        for (centre, block, side), unit in _units(batches, deal):
            found = []
            for r in unit:
                own = hashed(r["text"], words)
                if not side:
                    at, middle, text = (centre, block), own, r["text"]
                elif at == (centre, block):
                    both = len(own) + len(middle) - len(np.union1d(own, middle))
                    if _enough(both, len(own), len(middle), least) and similar(r["text"], text, words, least):
                        found.append((r["key"], centre))
            if found:
                yield _links(found)

    return dealt.mapInArrow(run, "u long, v long")


def open_links(docs: DataFrame, nodes: DataFrame, shared: DataFrame, joined: DataFrame, words: int, least: Fraction, block_nodes: int, block_shingles: int) -> DataFrame:
    """Links (u, v) that connect the components (node, component) of nodes that share a band."""
    label = lambda n: joined.select(F.col("node").alias(n), F.col("component").alias(f"{n}_in"))
    named = shared.join(label("key"), "key", "left").join(label("centre"), "centre", "left")
    named = named.select("band", "key", "centre", F.coalesce("key_in", "key").alias("key_in"), F.coalesce("centre_in", "centre").alias("centre_in"))
    unsettled = named.where("key_in <> centre_in").select("band").distinct()
    inside = named.join(unsettled, "band", "left_semi")
    rows = inside.select("band", "key", F.col("key_in").alias("label")).unionByName(inside.select("band", F.col("centre").alias("key"), F.col("centre_in").alias("label")).distinct())
    asked = stored(rows.join(nodes.select("key", "n"), "key"), "shingles-open")
    asked = asked.join(_cuts(asked, "band", block_nodes, block_shingles), "band").withColumn("block", _block())
    other = F.explode(F.sequence(F.lit(0), F.col("cut") - 1)).alias("other")
    asked = asked.select("band", "key", "label", "block", other).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other")
    deal = ["band", "low", "high"]
    dealt = _texts(docs, nodes, asked, deal, deal)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, low, high), rows in _units(batches, deal):
            unit = list(rows)  # at most two blocks
            if len({r["label"] for r in unit}) < 2:
                continue
            found = unit_links([r["text"] for r in unit], [r["block"] for r in unit], low != high, words, least, [r["label"] for r in unit])
            if found:
                yield _links([(unit[i]["key"], unit[j]["key"]) for i, j in found])

    return dealt.mapInArrow(run, "u long, v long")


def near_copies(docs: DataFrame, words: int = 5, least: str = "0.8", block_nodes: int = BLOCK_NODES, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, mark, class and component_id: the smallest doc_id reachable over pairs with at least this similarity."""
    t, sizes = Fraction(least), (block_nodes, block_shingles)
    marked = stored(marks(docs, words), "shingles")
    place = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "mark")))
    nodes = marked.groupBy("key").agg(place.alias("at"), *(F.first(c).alias(c) for c in ("n", "bands", "fps")))
    nodes = stored(nodes.select("key", F.col("at.doc_id").alias("least"), "at.mark", "n", "bands", "fps"), "shingles-nodes")
    with_id = nodes.where("least is not null")
    shared = stored(band_rows(with_id), "shingles-bands")
    tries = stored(trie_rows(with_id), "shingles-tries")
    stars = stored(star_links(docs, with_id, tries.unionByName(shared.select("key", "centre")), words, t, *sizes), "shingles-links")
    joined = stored(components(stars, "shingles-forest"), "shingles-joined")
    more = stored(open_links(docs, with_id, shared, joined, words, t, *sizes), "shingles-more")
    if not more.isEmpty():
        joined = components(stars.unionByName(more), "shingles-forest")
    return with_components(marked.select("doc_id", "mark", "key"), nodes, joined, "key").drop("key")
