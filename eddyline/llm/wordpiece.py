"""Token counts by a linear longest-match automaton.

Greedy word pieces take the longest vocabulary entry at each place. Done naively that goes back to the start of
the rest after every piece. Here the vocabulary is a trie whose nodes have failure links: where no edge fits, the
link names the node that stands for what is left after popping the pieces that greedy matching would have taken,
and the node knows how many those are. Each byte is read once, and a word's length is a sum of counts; no piece is
built.

The words are those of the vocabulary's own splitting pattern, the pieces byte strings, so a public byte-level
vocabulary serves as it is; vocabularies that mark continuing pieces by a prefix such as ## work as well. A word
that no sequence of entries covers counts as one unknown token.

Rows: null and empty texts have no word and no token; repeated rows give repeated rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eddyline.llm import tokens
from eddyline.llm.common import blocks, table

#: Words whose counts one worker remembers at most; forgotten all at once.
REMEMBERED = 400_000
LONG_TEXT = 4 << 20


class LongestMatch:
    """The automaton of a vocabulary. `marker` is the prefix of pieces that continue a word."""

    def __init__(self, vocabulary: Iterable[bytes], marker: bytes = b""):
        edges: dict[int, int] = {}  # node << 8 | byte -> node
        entry, depth_first = [False], []

        def insert(word: bytes) -> int:
            u = 0
            for c in word:
                v = edges.get(u << 8 | c)
                if v is None:
                    v = edges[u << 8 | c] = len(entry)
                    entry.append(False)
                    depth_first.append((u, c, v))
                u = v
            return u

        self.next_root = insert(marker)
        for word in vocabulary:
            if word:
                entry[insert(word)] = True
        children: list[list[tuple[int, int]]] = [[] for _ in entry]
        for u, c, v in depth_first:
            children[u].append((c, v))
        fail, pops = [-1] * len(entry), [0] * len(entry)
        level = list(dict.fromkeys((0, self.next_root)))
        while level:
            below = []
            for u in level:
                for c, v in children[u]:
                    if v == self.next_root:
                        continue
                    if entry[v]:
                        fail[v], pops[v] = self.next_root, 1
                    else:
                        z, n = fail[u], pops[u]
                        while z >= 0 and (z << 8 | c) not in edges:
                            n += pops[z]
                            z = fail[z]
                        if z >= 0:
                            fail[v], pops[v] = edges[z << 8 | c], n
                    below.append(v)
            level = below
        self.edges, self.fail, self.pops = edges, fail, pops

    def count(self, word: bytes) -> int:
        """How many pieces greedy longest match cuts a word into; 1 if it cannot."""
        if not word:
            return 0
        edges, fail, pops = self.edges, self.fail, self.pops
        u = n = 0
        for c in word:
            v = edges.get(u << 8 | c)
            while v is None:
                if fail[u] < 0:
                    return 1
                n += pops[u]
                u = fail[u]
                v = edges.get(u << 8 | c)
            u = v
        while u != self.next_root:
            if fail[u] < 0:
                return 1
            n += pops[u]
            u = fail[u]
        return n


class _Counts(dict):
    def __init__(self, automaton: LongestMatch):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self.automaton.count(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            self[word] = n
        return n


_loaded: dict[str, tuple] = {}


def counter(path: str):
    """A function of this worker: text -> (words, tokens)."""
    if path not in _loaded:
        import regex

        _loaded[path] = (regex.compile(tokens.pattern()), _Counts(LongestMatch(tokens.vocabulary(path))))
    words_of, counts = _loaded[path]

    def count(text: str) -> tuple[int, int]:
        if len(text) > LONG_TEXT:  # its words are not held together
            n = total = 0
            for m in words_of.finditer(text):
                n, total = n + 1, total + counts[m[0]]
            return n, total
        words = words_of.findall(text)
        return len(words), sum(map(counts.__getitem__, words))

    return count


SCHEMA = "doc_id long, n_words long, n_tokens long, n_bytes long"


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row a document: words, greedy pieces of them, and bytes. path: a byte-level vocabulary on every worker."""
    path = path or tokens.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for block in blocks(batches, 1):
            texts = [t or "" for t in block.column(1).to_pylist()]
            found = [count(t) for t in texts]
            columns = [[w for w, _ in found], [n for _, n in found], [len(t.encode("utf-8", "surrogatepass")) for t in texts]]
            yield pa.RecordBatch.from_arrays([block.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "n_words", "n_tokens", "n_bytes"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
