"""Secret scans through a trigram inverted index.

Each rule is a regular expression. `trigram_query` walks its parse tree and derives a Boolean query over
trigrams that every match must contain. A block of documents is indexed once: the postings of the trigrams
that any rule asks for. Rules intersect and unite postings to candidates, and only candidates are matched.
A rule without mandatory trigrams (the hex rule: any run of a character class) scans every document.

The index folds A-Z to a-z, so it never loses a match of a rule that ignores case; the expression itself
decides on case when a candidate is verified.

Rows: null texts count as empty and give zero counts, the hash of nothing and an empty span list; repeated
rows give repeated rows; a null doc_id stays null; other columns of the input are not read. A very long text is
indexed in slices and matched as a whole, spans of any length included.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from re import _parser as rx

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eddyline.llm.common import blocks, table


def any_case(word: str) -> str:
    """A pattern for an ASCII word in either case, without what Unicode case folding would add."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else re.escape(c) for c in word)


_KEYWORD = "|".join((any_case("password"), any_case("passwd"), any_case("secret"), any_case("token"), any_case("api") + "_?" + any_case("key")))

_KEY = r"(?:[A-Z0-9]++ )*PRIVATE KEY-----"
_WORD = "[A-Za-z0-9_-]{10,}+"

#: kind, pattern, group whose length counts, least length. The first three are the base kinds of the contract.
#: Runs are possessive: no run is cut at a length, and none is looked at again where its match fails.
RULES: tuple[tuple[str, str, int, int], ...] = (
    ("assign", rf"""({_KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),  # runs are maximal, so this equals [0-9a-f]+ with shorter runs dropped
    ("github", r"gh[opusr]_[A-Za-z0-9]{36,}+", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}+", 0, 15),
    # a private key from BEGIN to END; if no END follows before other dashes, the lines that look like its body
    ("pem", rf"-----BEGIN {_KEY}(?:(?:[^-]++|-{{1,4}}+[^-])*+-----END {_KEY}|(?:[ \t\r\n]*[A-Za-z0-9+/=]{{20,}}+)*+)", 0, 0),
    ("jwt", rf"eyJ{_WORD}(?:\.eyJ{_WORD}(\.{_WORD})?)?", 1, 11),  # one with all three parts
)
BASE = ("assign", "access", "hex")
#: Bytes of a block that are indexed at once.
INDEX_BYTES = 8 << 20

# ---- Boolean trigram queries -------------------------------------------------------------------------------
# A query is True (no constraint), a trigram, or ("and" | "or", frozenset of queries).

Query = bool | str | tuple


def both(a: Query, b: Query) -> Query:
    if a is True or b is True:
        return b if a is True else a
    parts = frozenset().union(*(q[1] if isinstance(q, tuple) and q[0] == "and" else {q} for q in (a, b)))
    return next(iter(parts)) if len(parts) == 1 else ("and", parts)


def either(options: list[Query]) -> Query:
    if not options or any(q is True for q in options):
        return True
    parts = frozenset().union(*(q[1] if isinstance(q, tuple) and q[0] == "or" else {q} for q in options))
    asks = {q: q[1] if isinstance(q, tuple) and q[0] == "and" else frozenset({q}) for q in parts}
    parts = frozenset(q for q in parts if not any(asks[x] < asks[q] for x in parts))  # a stricter option adds nothing
    return next(iter(parts)) if len(parts) == 1 else ("or", parts)


def holds(strings: frozenset[str]) -> Query:
    """What a text must contain that has one of the strings."""
    options = []
    for s in strings:
        q: Query = True
        for i in range(len(s) - 2):
            q = both(q, s[i : i + 3])
        options.append(q)
    return either(options)


class Shape:
    """What is known of all matches of an expression: the exact strings, or else their ends and a query."""

    LIMIT = 96

    def __init__(self, exact=None, head=frozenset({""}), tail=frozenset({""}), query: Query = True):
        if exact is not None and len(exact) > self.LIMIT:
            head, tail, query, exact = frozenset(s[:2] for s in exact), frozenset(s[-2:] for s in exact), both(query, holds(exact)), None
        self.exact, self.query = exact, query
        self.head = exact if exact is not None else head if len(head) <= self.LIMIT else frozenset({""})
        self.tail = exact if exact is not None else tail if len(tail) <= self.LIMIT else frozenset({""})

    def then(self, other: Shape) -> Shape:
        if self.exact is not None and other.exact is not None:
            return Shape(frozenset(a + b for a in self.exact for b in other.exact), query=both(self.query, other.query))
        seam = frozenset(a + b for a in self.tail for b in other.head)
        query = both(both(self.query, other.query), holds(seam))
        head = frozenset(s[:2] for s in seam) if self.exact is not None else self.head
        tail = frozenset(s[-2:] for s in seam) if other.exact is not None else other.tail
        return Shape(None, head, tail, query)

    def closed(self) -> Query:
        return both(self.query, holds(self.exact)) if self.exact is not None else self.query


def _shape(tree) -> Shape:
    out = Shape(frozenset({""}))
    for op, arg in tree:
        out = out.then(_atom(op, arg))
    return out


def _atom(op, arg) -> Shape:
    if op is rx.LITERAL:
        return Shape(frozenset({_fold(arg)}))
    if op is rx.IN:
        chars = _members(arg)
        return Shape(chars) if chars is not None else Shape()
    if op is rx.SUBPATTERN:
        return _shape(arg[-1])
    if op is rx.BRANCH:
        options = [_shape(x) for x in arg[1]]
        if all(x.exact is not None for x in options):
            return Shape(frozenset().union(*(x.exact for x in options)), query=either([x.query for x in options]))
        return Shape(None, frozenset().union(*(x.head for x in options)), frozenset().union(*(x.tail for x in options)), either([x.closed() for x in options]))
    if op in (rx.MAX_REPEAT, rx.MIN_REPEAT, rx.POSSESSIVE_REPEAT):
        least, most, inner = arg
        x = _shape(inner)
        if least == 0:
            return Shape(x.exact | {""}, query=True) if most == 1 and x.exact is not None else Shape()
        if least == most and least <= 8 and x.exact is not None:
            out = x
            for _ in range(least - 1):
                out = out.then(x)
            return out
        return Shape(None, x.head, x.tail, x.closed())
    if op in (rx.AT, rx.ASSERT, rx.ASSERT_NOT):
        return Shape(frozenset({""}))
    return Shape()


def _fold(code: int) -> str:
    return chr(code + 32 if 65 <= code <= 90 else code)


def _members(items) -> frozenset[str] | None:
    """The folded characters of a small class; None for one too large or negated to enumerate."""
    out: set[str] = set()
    for op, arg in items:
        if op is rx.LITERAL:
            out.add(_fold(arg))
        elif op is rx.RANGE and arg[1] - arg[0] < 8:
            out.update(_fold(c) for c in range(arg[0], arg[1] + 1))
        else:
            return None
    return frozenset(out) if len(out) <= 8 else None


def trigram_query(pattern: str) -> Query:
    """The Boolean query over folded trigrams that every text with a match satisfies; True if there is none.

    Characters beyond ASCII in a pattern are left out of the query, as the index holds bytes.
    """
    query = _shape(rx.parse(pattern)).closed()

    def ascii_only(q: Query) -> Query:
        if isinstance(q, tuple):
            parts = [ascii_only(x) for x in q[1]]
            if q[0] == "or":
                return either(parts)
            out: Query = True
            for x in parts:
                out = both(out, x)
            return out
        return q if q is True or q.isascii() else True

    return ascii_only(query)


def _trigrams(q: Query) -> set[str]:
    return set().union(*(_trigrams(x) for x in q[1])) if isinstance(q, tuple) else set() if q is True else {q}


class Scanner:
    """The compiled rules and, for a block of texts, the index that picks each rule's candidates."""

    def __init__(self, rules=RULES):
        self.rules = [(kind, re.compile(pattern), group, least, trigram_query(pattern)) for kind, pattern, group, least in rules]
        wanted = sorted(set().union(*(_trigrams(q) for *_, q in self.rules)))
        self.slot = {t: i + 1 for i, t in enumerate(wanted)}
        self.lut = np.zeros(1 << 24, np.uint8 if len(wanted) < 255 else np.uint16)
        for t, i in self.slot.items():
            a, b, c = t.encode()
            self.lut[a << 16 | b << 8 | c] = i

    def index(self, raw: list[bytes]) -> dict[int, np.ndarray]:
        """Postings (numbers of documents in the block) of every trigram that a rule asks for."""
        joined = np.frombuffer(b"\0".join(raw) + b"\0\0\0", np.uint8)
        ends = np.cumsum([len(x) + 1 for x in raw])
        found = []
        for i in range(0, len(joined) - 2, INDEX_BYTES):  # a text of any length is indexed in slices
            data = joined[i : i + INDEX_BYTES + 2].astype(np.uint32)
            data += ((data >= 65) & (data <= 90)).astype(np.uint32) << 5
            slots = self.lut[data[:-2] << 16 | data[1:-1] << 8 | data[2:]]
            at = np.flatnonzero(slots)
            found.append(np.unique(slots[at].astype(np.int64) << 32 | np.searchsorted(ends, at + i, "right")))
        pairs = np.unique(np.concatenate(found))
        cuts = np.searchsorted(pairs >> 32, np.arange(1, len(self.slot) + 2))
        return {i: pairs[cuts[i - 1] : cuts[i]] & 0xFFFFFFFF for i in range(1, len(self.slot) + 1)}

    def candidates(self, query: Query, postings: dict[int, np.ndarray], n: int) -> np.ndarray:
        if query is True:
            return np.arange(n)
        if isinstance(query, str):
            return postings[self.slot[query]]
        lists = sorted((self.candidates(q, postings, n) for q in query[1]), key=len)
        out = lists[0]
        for x in lists[1:]:
            out = np.intersect1d(out, x, assume_unique=True) if query[0] == "and" else np.union1d(out, x)
        return out

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text its spans (start, number of the kind, end), sorted; offsets count code points."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        postings = self.index([t.encode("utf-8", "surrogatepass") for t in texts])
        for k, (_, pattern, group, least, query) in enumerate(self.rules):
            for i in self.candidates(query, postings, len(texts)):
                for m in pattern.finditer(texts[i]):
                    if m.end(group) - m.start(group) >= least:  # -1 less -1: the group is not there
                        found[i].append((m.start(), k, m.end()))
        for spans in found:
            spans.sort()
        return found


_scanners: dict[tuple, Scanner] = {}


def scanner(rules=RULES) -> Scanner:
    if rules not in _scanners:
        _scanners[rules] = Scanner(rules)
    return _scanners[rules]


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame, rules=RULES) -> DataFrame:
    """One row a document: counts of the base kinds, the hash of the base spans and all spans as kind:start:end."""
    kinds = [r[0] for r in rules]
    base = [k for k, kind in enumerate(kinds) if kind in BASE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(rules)
        for block in blocks(batches, 1):
            found = s.scan([t or "" for t in block.column(1).to_pylist()])
            show = lambda spans: ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)
            counts = [[sum(k == b for _, k, _ in spans) for spans in found] for b in (kinds.index(x) for x in BASE)]
            digests = [hashlib.sha256(show([x for x in spans if x[1] in base]).encode()).hexdigest() for spans in found]
            yield pa.RecordBatch.from_arrays(
                [block.column(0).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array([show(x) for x in found], pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, rules=RULES, mark: str = "[secret:{}]") -> DataFrame:
    """The documents, all columns kept, with every span replaced by a mark that names its kind.

    Overlapping spans are replaced together under the kind of the first. A column n_chars, if there is one, is
    set to the new length of the texts that change.
    """
    kinds = [r[0] for r in rules]
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(rules)
        for block in blocks(batches, at):
            texts = block.column(at).to_pylist()
            found = s.scan([t or "" for t in texts])
            changed = {}
            for i, spans in enumerate(found):
                if not spans:
                    continue
                out, end, text = [], 0, texts[i]
                for a, k, b in spans:
                    if a >= end:
                        out += [text[end:a], mark.format(kinds[k])]
                    end = max(end, b)
                changed[i] = "".join(out) + text[end:]
            columns = list(block.columns)
            if changed:
                columns[at] = pa.array([changed.get(i, t) for i, t in enumerate(texts)], columns[at].type)
                if "n_chars" in names:
                    c = names.index("n_chars")
                    columns[c] = pa.array([len(changed[i]) if i in changed else v for i, v in enumerate(columns[c].to_pylist())], columns[c].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def _oracle(rules=RULES) -> str:
    """DuckDB SQL for the query's rows: matches are marked by control characters, which texts must lack, and counted off.

    Its expressions have no possessive runs, and never go back over one in another way than these rules allow.
    """
    parts = []
    for k, (kind, pattern, group, least) in enumerate(rules):
        p = re.sub(r"(?<=[*+}])\+", "", pattern).replace("'", "''")
        parts.append(
            f"""select doc_id, '{kind}' as kind, {k} as k, i, length(part) - (i > 1)::int as n, length(regexp_extract(string_split(part, chr(2))[1], '{p}', {group})) as least, length(string_split(part, chr(2))[1]) as wide, {least} as need
            from (select doc_id, unnest(parts) as part, generate_subscripts(parts, 1) as i from (
              select doc_id, string_split(regexp_replace(coalesce(text, ''), '{p}', chr(1) || '\\0' || chr(2), 'g'), chr(1)) as parts from documents))"""
        )
    base = ", ".join(f"'{b}'" for b in BASE)
    counts = ", ".join(f"count(*) filter (where kind = '{b}') as n_{b}" for b in BASE)
    return f"""
    with parts as ({" union all ".join(parts)}),
    placed as (select *, sum(n) over (partition by doc_id, k order by i rows between unbounded preceding and 1 preceding) as s from parts),
    found as (select doc_id, kind, k, cast(s as bigint) as s, cast(s + wide as bigint) as e from placed where i > 1 and least >= need),
    sums as (select doc_id, {counts},
      string_agg(kind || ':' || s || ':' || e, ',' order by s, k) filter (where kind in ({base})) as base,
      string_agg(kind || ':' || s || ':' || e, ',' order by s, k, e) as spans from found group by doc_id)
    select d.doc_id, {", ".join(f"coalesce(n_{b}, 0) as n_{b}" for b in BASE)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
    from documents d left join sums using (doc_id)
    """


ORACLE = _oracle()
