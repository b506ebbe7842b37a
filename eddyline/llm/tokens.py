"""Token ids of a public byte-level BPE vocabulary.

Texts of ASCII and Latin letters are cut into words by an expression of this module, and each word's ids come from
a bounded memory of words or else from `tiktoken`, whose ranks are read from the same vocabulary file; texts with any
other character go to the `tokenizers` library, since the two may class rare characters differently. Control tokens'
strings in a text are ordinary text.

`Bpe.encode_all` and `Bpe.count_all` do so for many texts at once: the words' ends come from the classes of the
characters, and words of at most 12 characters, packed into two numbers, are looked up in a table of arrays. A very long
text is encoded by itself.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np

#: Characters that both libraries are known to class alike, white space other than blank, tab and line ends excluded.
_SAME = re.compile(r"[\t\n\r -~¡-¬®-ɏ–—‘-“”•…€]*")
#: Letters, numbers and white space among them, and the words that the public pattern cuts such a text into.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", r" \t\n\r"
_WORDS = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: Words whose ids a worker remembers, and characters of such a word.
MOST_WORDS, WORD_CHARS = 1 << 19, 32
#: Characters of the texts that are cut into words at once; a longer text is taken by itself.
AT_ONCE = 1 << 17
#: Slots of the table of words, a power of two of which half are filled at most, and characters of half a word in it.
SLOT_BITS, HALF = 20, 6


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pattern() -> str:
    """The pattern of the public byte-level vocabularies that cuts a text into words before merging."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next one from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary(path: str) -> dict[bytes, int]:
    """The byte strings of a byte-level vocabulary and their ids, without its control tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    control = {x["content"] for x in spec.get("added_tokens", [])}
    letters = _byte_letters()
    return {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in control}


class _Known(dict):
    """The ids of words as little-endian 32-bit numbers. The first MOST_WORDS short words are remembered."""

    def __init__(self, encode):
        super().__init__()
        self._encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self._encode(word)).tobytes()
        if len(self) < MOST_WORDS and len(word) <= WORD_CHARS:
            self[word] = ids
        return ids


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """By character: its class (0 blank, 1 other white space, 2 letter, 3 number, 4 other) and a number from 1 below 1,024."""
    same = [chr(i) for i in range(0x20AD) if _SAME.fullmatch(chr(i))]
    kinds = [re.compile(p) for p in (" ", f"[{_S}]", f"[{_L}]", f"[{_N}]", ".")]
    kind, number = np.zeros(0x20AD, np.uint8), np.zeros(0x20AD, np.uint64)
    for n, c in enumerate(same):
        kind[ord(c)] = next(k for k, p in enumerate(kinds) if p.match(c))
        number[ord(c)] = n + 1
    return kind, number


_KIND, _NUMBER = _classes()


def word_starts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the words of `_WORDS` start; codes: the characters of texts that are not empty, first: where each begins."""
    kind = _KIND[codes]
    blank, begins = kind < 2, np.zeros(len(codes) + 3, bool)
    begins[first] = True
    before_word = np.append(~blank[1:], False) & ~begins[1 : len(codes) + 1]
    start = np.ones(len(codes), bool)
    # white space keeps its last character for what follows; other runs are of one class, with a blank before them
    start[1:] = np.where(blank[1:], ~blank[:-1] | before_word[1:], (kind[:-1] != 0) & (kind[:-1] != kind[1:]))
    start[first] = True
    quotes = np.flatnonzero((codes == 39) & start)
    if len(quotes):  # 's and the like, where a word starts with the quote itself
        ahead = np.concatenate([codes, np.zeros(3, codes.dtype)])
        one = np.where(begins[quotes + 1], 0, ahead[quotes + 1])
        two = np.where(begins[quotes + 2], 0, ahead[quotes + 2])
        short = np.isin(one, [ord(c) for c in "sdmt"])
        long = ~short & np.logical_or.reduce([(one == ord(a)) & (two == ord(b)) for a, b in ("ll", "ve", "re")])
        for at, n in ((quotes[short], 2), (quotes[long], 3)):
            start[at + 1] = False
            inside = at + n < len(codes)
            start[at[inside] + n] = True
    return np.flatnonzero(start)


class _Table:
    """Words of at most 2 * HALF characters, as two packed numbers, with the place and number of their ids in a pool."""

    def __init__(self, encode):
        self.encode, self.rows = encode, 0
        self.low, self.high = np.zeros(1 << SLOT_BITS, np.uint64), np.zeros(1 << SLOT_BITS, np.uint64)
        self.at, self.n = np.zeros(1 << SLOT_BITS, np.int32), np.zeros(1 << SLOT_BITS, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _find(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each word, or the free one where its search ends, and whether it is there."""
        mixed = (low ^ (high * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x9E3779B97F4A7C15)
        slot = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        there = (self.low[slot] == low) & (self.high[slot] == high)
        todo = np.flatnonzero(~there & (self.low[slot] != 0))
        while len(todo):
            slot[todo] = now = (slot[todo] + 1) & ((1 << SLOT_BITS) - 1)
            hit = (self.low[now] == low[todo]) & (self.high[now] == high[todo])
            there[todo[hit]] = True
            todo = todo[~hit & (self.low[now] != 0)]
        return slot, there

    def _add(self, words: list[str], low: np.ndarray, high: np.ndarray, slot: np.ndarray, which: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Put new words' ids into the pool, as many as there is room for to stay, and return their places and numbers."""
        raw = list(map(self.encode, words))
        n = np.fromiter(map(len, raw), np.int64, len(raw)) >> 2
        stay = np.fromiter(map(len, words), np.int64, len(words)) <= 2 * HALF
        stay &= np.cumsum(stay) <= (1 << SLOT_BITS - 1) - self.rows
        order = np.argsort(~stay, kind="stable")
        at = np.empty(len(n), np.int64)
        at[order] = self.used + np.cumsum(n[order]) - n[order]
        end = self.used + int(n.sum())
        if end > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(end, len(self.pool)), np.uint32)])
        self.pool[self.used : end] = np.frombuffer(b"".join([raw[i] for i in order]), np.uint32)
        self.used += int(n[stay].sum())
        self.rows += int(stay.sum())
        row = np.empty(len(words), np.int64)
        row[which] = np.arange(len(which))  # one place of each word
        todo = np.flatnonzero(stay)
        to = slot[row]
        while len(todo):
            taken = self.low[to[todo]] != 0
            free = todo[~taken]
            free = free[np.unique(to[free], return_index=True)[1]]
            self.low[to[free]], self.high[to[free]] = low[row[free]], high[row[free]]
            self.at[to[free]], self.n[to[free]] = at[free], n[free]
            todo = np.setdiff1d(todo, free)
            to[todo] = (to[todo] + (self.low[to[todo]] != 0)) & ((1 << SLOT_BITS) - 1)
        return at, n

    def look(self, text: str, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the pool and number of ids of each word; places hold until the next call."""
        sizes = np.diff(starts, append=len(codes))
        packed = np.zeros(len(codes) + 2 * HALF, np.uint64)
        packed[: len(codes)] = _NUMBER[codes]
        packed[:-1] |= packed[1:] << np.uint64(10)
        packed[:-4] |= (packed[2:-2] << np.uint64(20) & np.uint64((1 << 40) - 1)) | (packed[4:] << np.uint64(40))
        masks = np.array([(1 << 10 * k) - 1 for k in range(HALF + 1)], np.uint64)
        low = packed[starts] & masks[np.minimum(sizes, HALF)]
        high = packed[starts + HALF] & masks[np.clip(sizes - HALF, 0, HALF)]
        slot, there = self._find(low, high)
        there &= sizes <= 2 * HALF
        at, n = self.at[slot], self.n[slot]
        missed = np.flatnonzero(~there)
        if len(missed):
            new: dict[str, int] = {}
            which = [new.setdefault(text[a : a + size], len(new)) for a, size in zip(starts[missed].tolist(), sizes[missed].tolist(), strict=True)]
            at[missed], n[missed] = (x[which] for x in self._add(list(new), low[missed], high[missed], slot[missed], which))
        return at.astype(np.int64), n.astype(np.int64)


class Bpe:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.ranked = tiktoken.Encoding("ranked", pat_str=pattern(), mergeable_ranks=vocabulary(path), special_tokens={})
        # a word is one piece already: cutting it once more, as the public call does, takes half of its time
        one = getattr(self.ranked, "_encode_single_piece", self.ranked.encode_ordinary)
        self._ids = _Known(one).__getitem__
        self._table = _Table(lambda w: self._ids(w) if len(w) > 2 * HALF else array("I", one(w)).tobytes())

    def reference(self, text: str) -> np.ndarray:
        """The ids as the `tokenizers` library gives them."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, text: str) -> np.ndarray:
        if _SAME.fullmatch(text):
            return np.frombuffer(b"".join(map(self._ids, _WORDS.findall(text))), np.uint32)
        return self.reference(text)

    def count(self, text: str) -> int:
        """How many ids `encode` gives."""
        if _SAME.fullmatch(text):
            return sum(map(len, map(self._ids, _WORDS.findall(text)))) // 4
        return len(self.reference(text))


    def _many(self, texts: list[str], by_itself, joined) -> list:
        """`joined` of the words of texts in groups of AT_ONCE characters, `by_itself` of each text that has to be."""
        out: list = [None] * len(texts)
        group, chars = [], 0

        def flush() -> None:
            if group:
                sizes = np.array([len(texts[i]) for i in group])
                first = np.cumsum(sizes) - sizes
                text = "".join([texts[i] for i in group])
                codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
                starts = word_starts(codes, first)
                at, n = self._table.look(text, codes, starts)
                for i, x in zip(group, joined(at, n, np.searchsorted(starts, first)), strict=True):
                    out[i] = x
            group.clear()

        for i, t in enumerate(texts):
            if not t or len(t) > AT_ONCE or not _SAME.fullmatch(t):
                out[i] = by_itself(t)
                continue
            if chars + len(t) > AT_ONCE:
                flush()
                chars = 0
            group.append(i)
            chars += len(t)
        flush()
        return out

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """`encode` of each text."""

        def joined(at: np.ndarray, n: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
            ends = np.cumsum(n)
            places = np.repeat(at - (ends - n), n)
            places += np.arange(len(places))
            return np.split(self._table.pool[places], (ends - n)[words[1:]])

        return self._many(texts, self.encode, joined)

    def count_all(self, texts: list[str]) -> list[int]:
        """`count` of each text."""
        return self._many(texts, self.count, lambda at, n, words: np.add.reduceat(n, words).tolist())


_loaded: dict[str, Bpe] = {}


def bpe(path: str) -> Bpe:
    """The tokenizer of this worker; one for each file."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]
