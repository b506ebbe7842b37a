"""Language identification by a convolutional network over bytes, in numpy alone.

Bytes are embedded; filters of several widths slide over a window of fixed length; each filter keeps its maximum
and a softmax over those names the language. The network is trained on the driver on a bounded sample of
labelled windows, drawn from all windows of the whole labelled texts. A whole text is cut into windows that overlap by the widest filter less one, so no byte
sequence is missed; a document's probabilities are the means over its windows, weighted by their bytes.

When predicting, embedding and filter collapse into one table a filter offset (256 rows), so a window costs table
look-ups and additions only.

Rows: a null text, or one without a letter, is `und` with score 0; if no row is labelled, every text is. Only the
text is looked at in a prediction. Repeated rows give repeated rows and are learned from once; a null doc_id is not
held out and is not learned from; of languages with equal probabilities the first by name counts. A very long text is
read whole, one window after another. Other columns are kept by the filters and not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eddyline.llm.common import blocks, table

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS, EMBEDDING = 24, 8
#: Most labelled windows that are learned from, shared equally by the languages.
TRAIN_WINDOWS = 6000
#: Most languages that are learned, those with the most windows.
MOST_LANGUAGES = 256
#: Least characters of a made-up text.
FOREIGN_CHARS = 600
UNKNOWN = "und"
#: Class of a network with rejection: texts in none of the learned languages.
REJECT = "\0reject"
#: Least labelled held-out rows that a bound is set by; share of them that may lie above it.
LEAST_HELD_OUT, MOST_LOST = 20, 0.001
#: Gradient steps of a network with rejection at least.
LEAST_STEPS = 600
#: First and last letters of scripts that texts in no learned language are drawn from.
SCRIPTS = ((0x391, 0x3C9), (0x410, 0x44F), (0x531, 0x556), (0x5D0, 0x5EA), (0x621, 0x64A), (0x905, 0x939), (0x985, 0x9B9), (0xB85, 0xBB9), (0xE01, 0xE2E), (0x10D0, 0x10F0), (0x1200, 0x1357), (0x1780, 0x17B3), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))


def windows(raw: bytes, window: int = WINDOW, overlap: int = max(WIDTHS) - 1) -> tuple[np.ndarray, np.ndarray]:
    """The windows of a text, zeros after its end, and how many bytes each one has."""
    step = window - overlap
    n = max(1, -(-(len(raw) - overlap) // step))
    padded = np.zeros(step * (n - 1) + window, np.uint8)
    padded[: len(raw)] = np.frombuffer(raw, np.uint8)
    out = np.lib.stride_tricks.sliding_window_view(padded, window)[::step]
    return out, np.clip(len(raw) - step * np.arange(n), 0, window)


class ByteCnn:
    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.weights = {"embed": draw(256, EMBEDDING, scale=0.5), "out": draw(FILTERS * len(WIDTHS), len(languages), scale=0.1), "bias": np.zeros(len(languages), np.float32)}
        for w in WIDTHS:
            self.weights[f"conv{w}"] = draw(w * EMBEDDING, FILTERS, scale=(w * EMBEDDING) ** -0.5)
            self.weights[f"shift{w}"] = np.zeros(FILTERS, np.float32)
        self.tables: dict[int, np.ndarray] | None = None

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 11) -> None:
        """Adam on the cross entropy. x: windows of bytes; y: numbers of their languages."""
        rng = np.random.default_rng(seed)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.weights.items()}
        step = 0
        total = epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                grads = self._gradients(x[order[i : i + batch]], y[order[i : i + batch]])
                step += 1
                now = rate * (1 - 0.9 * step / total)
                for k, g in grads.items():
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.weights[k] -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.tables = None

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.weights, len(x)
        emb = p["embed"][x]
        pooled, places = [], []
        for w in WIDTHS:
            patches = np.lib.stride_tricks.sliding_window_view(emb, w, axis=1).swapaxes(2, 3).reshape(n, -1, w * EMBEDDING)
            act = patches @ p[f"conv{w}"] + p[f"shift{w}"]
            at = act.argmax(1)
            places.append(at)
            pooled.append(np.take_along_axis(act, at[:, None], 1)[:, 0])
        pool = np.maximum(np.concatenate(pooled, 1), 0)
        probs = softmax(pool @ p["out"] + p["bias"])
        probs[np.arange(n), y] -= 1
        probs /= n
        back = (probs @ p["out"].T) * (pool > 0)
        grads = {"out": pool.T @ probs, "bias": probs.sum(0), "embed": np.zeros_like(p["embed"])}
        rows = np.arange(n)[:, None]
        for k, w in enumerate(WIDTHS):
            g, at = back[:, k * FILTERS : (k + 1) * FILTERS], places[k]
            conv = np.zeros_like(p[f"conv{w}"])
            for o in range(w):
                part = slice(o * EMBEDDING, (o + 1) * EMBEDDING)
                conv[part] = np.einsum("nf,nfe->ef", g, emb[rows, at + o])
                np.add.at(grads["embed"], x[rows, at + o], g[:, :, None] * p[f"conv{w}"][part].T[None])
            grads[f"conv{w}"], grads[f"shift{w}"] = conv, g.sum(0)
        return grads

    def probabilities(self, x: np.ndarray, at_once: int = 48) -> np.ndarray:
        """One row of probabilities a window."""
        p = self.weights
        if self.tables is None:
            self.tables = {w: np.stack([p["embed"] @ p[f"conv{w}"][o * EMBEDDING : (o + 1) * EMBEDDING] for o in range(w)]) for w in WIDTHS}
        out = np.empty((len(x), len(self.languages)), np.float32)
        for i in range(0, len(x), at_once):
            part = x[i : i + at_once]
            pooled = []
            for w in WIDTHS:
                span = part.shape[1] - w + 1
                act = self.tables[w][0][part[:, :span]]
                for o in range(1, w):
                    act += self.tables[w][o][part[:, o : o + span]]
                pooled.append(act.max(1) + p[f"shift{w}"])
            out[i : i + at_once] = softmax(np.maximum(np.concatenate(pooled, 1), 0) @ p["out"] + p["bias"])
        return out

    def means(self, texts: list[str | None]) -> tuple[list[int], np.ndarray]:
        """Places of the texts with a letter, and their mean probabilities."""
        number, parts, sizes = [], [], []
        for i, t in enumerate(texts):
            if t and any(map(str.isalpha, t)):
                cut, has = windows(t.encode("utf-8", "surrogatepass"))
                number.append(np.full(len(cut), i))
                parts.append(cut)
                sizes.append(has)
        if not number:
            return [], np.empty((0, len(self.languages)))
        of, weight = np.concatenate(number), np.concatenate(sizes).astype(np.float64)
        probs = self.probabilities(np.concatenate(parts)) * weight[:, None]
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        return of[starts].tolist(), np.add.reduceat(probs, starts) / np.add.reduceat(weight, starts)[:, None]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and its probability for each text."""
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        if not self.languages:
            return out
        for i, row in zip(*self.means(texts), strict=True):
            best = int(row.argmax())
            out[i] = (self.languages[best], float(min(1.0, row[best])))
        return out

    def rejected(self, texts: list[str | None]) -> list[float]:
        """The probability that a text is in none of the languages; 1 without a letter. For a network with rejection."""
        out = [1.0] * len(texts)
        for i, row in zip(*self.means(texts), strict=True):
            out[i] = float(min(1.0, row[-1]))
        return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fold() -> F.Column:
    """Fold of a document: rows of fold 0 are held out."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))


def foreign(n: int, texts: list[str], seed: int = 13) -> list[str]:
    """Made-up texts in none of the languages of `texts`: scripts they do not use, random letters, junk without words."""
    rng = np.random.default_rng(seed)
    seen = np.unique(np.array([ord(c) for t in texts for c in set(t)] or [0]))
    scripts = [(a, b) for a, b in SCRIPTS if not ((seen >= a) & (seen <= b)).any()]
    latin = [chr(c) for c in range(97, 123)]
    marks = list("0123456789" * 3 + "!#$%&()*+,-./:;<=>?@[]^_{|}~")
    out = []
    for i in range(n):
        kind, parts, size = i % 3 if scripts else 1 + i % 2, [], 0
        a, b = scripts[int(rng.integers(len(scripts)))] if scripts else (0, 0)
        short = a >= 0x3041  # scripts that write few blanks or short words
        while size < FOREIGN_CHARS:
            k = int(rng.integers(1, 13))
            if kind == 0:
                w = "".join(map(chr, rng.integers(a, b + 1, k + 8 * (short and i % 2))))
            elif kind == 1:
                w = "".join(rng.choice(latin, k))
                w = w.upper() if i % 5 == 0 else w.title() if rng.random() < 0.1 else w
            else:
                w = "".join(rng.choice(marks, k))
                if rng.random() < 0.15:
                    w = str(rng.choice(latin))
            parts.append(w + str(rng.choice([".", ",", "!", "\n"])) * (rng.random() < 0.1))
            size += len(w) + 1
        out.append(" ".join(parts))
    return out


def window_count(size: F.Column, overlap: int = max(WIDTHS) - 1) -> F.Column:
    """How many windows `windows` cuts a text of so many bytes into."""
    return F.greatest(F.lit(1), F.ceil((size - overlap) / (WINDOW - overlap))).cast("long")


def sample(rows: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Windows (lang, ticket, number, window) of labelled texts, each with its language's chance.

    A text's ticket, a hash of it, decides how many of its windows are drawn, and which: all have the same chance,
    wherever in the text they stand. So the sample does not depend on how the table is laid out, and its size, the
    chance times all windows, not on the table's. Only texts that give a window reach Python, each text once.
    """
    chance = F.element_at(F.create_map(*(F.lit(v) for lang, p in shares.items() for v in (lang, float(p)))), F.col("lang"))
    ticket = F.xxhash64(F.col("text"), F.lit("sample"))
    drawn = rows.where(F.col("lang").isin(*shares)).select("lang", "text", ticket.alias("ticket"), (chance * window_count(F.octet_length("text"))).alias("due"))
    drawn = drawn.where(F.pmod("ticket", F.lit(1 << 40)) < F.col("due") * (1 << 40)).dropDuplicates(["lang", "ticket"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 1):
            out: list[tuple] = []
            for lang, text, ticket, due in zip(*(c.to_pylist() for c in block.columns), strict=True):
                cut, has = windows(text.encode("utf-8", "surrogatepass"))
                rng = np.random.default_rng(ticket % (1 << 64))
                n = int(due) + ((ticket % (1 << 40)) / (1 << 40) < due - int(due))
                for k in sorted(rng.choice(len(cut), min(n, len(cut)), replace=False).tolist()):
                    out.append((lang, ticket, k, cut[k][: has[k]].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["lang", "ticket", "number", "window"])

    return drawn.mapInArrow(run, "lang string, ticket long, number long, window binary")


def train(docs: DataFrame, most_windows: int = TRAIN_WINDOWS, reject: bool = False) -> ByteCnn:
    """The network, learned from at most `most_windows` windows of all labelled rows that are not held out.

    With `reject` it also learns a class of made-up texts, as many as a language has windows on average. Counts of
    windows by language come first; they set each language's chance for its share and somewhat more, and of what is
    drawn the excess with the largest tickets goes.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold() != 0)).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(window_count(F.octet_length("text"))).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()}
    languages = sorted(counts)
    model = ByteCnn(languages + [REJECT] * (reject and bool(languages)))
    if not languages:
        return model
    share = max(1, most_windows // len(languages))
    rng = np.random.default_rng(5)
    xs, ys = [], []
    left = dict.fromkeys(languages, share)
    texts = []

    def learn(raw: bytes, number: int) -> None:
        short = raw[(a := int(rng.integers(0, max(1, len(raw) - 20)))) : a + int(rng.integers(12, 120))]  # texts may be short
        for piece in (raw, short):
            xs.append(np.frombuffer(piece.ljust(WINDOW, b"\0"), np.uint8))
            ys.append(number)

    kept = sample(rows, {lang: min(1.0, 1.3 * (share + 30) / n) for lang, n in counts.items()})
    for r in sorted(kept.collect(), key=lambda r: (r["ticket"], r["lang"], r["number"])):
        text = bytes(r["window"]).decode("utf-8", "ignore")
        if not left[r["lang"]] or not has_letter(text):
            continue
        left[r["lang"]] -= 1
        learn(bytes(r["window"]), languages.index(r["lang"]))
        texts.append(text)
    if reject:
        for t in foreign(-(-len(texts) // len(languages)), texts):
            cut, has = windows(t.encode())
            k = int(rng.integers(len(cut)))
            learn(cut[k][: has[k]].tobytes(), len(languages))
    if xs:
        least = -(-LEAST_STEPS * 64 // len(xs)) if reject else 0
        model.train(np.stack(xs), np.array(ys), epochs=max(6, least))
    return model


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def identify(docs: DataFrame, model: ByteCnn) -> DataFrame:
    """One row a document: whether it was held out, its language and that language's probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 2):
            found = model.predict(block.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(fold() == 0, F.lit(False)).alias("held_out")
    return docs.select(F.col("doc_id").cast("long"), held, F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def keep_known(docs: DataFrame, model: ByteCnn, least_score: float = 0.0) -> DataFrame:
    """The documents, all columns kept, whose text is in some language with at least this probability."""
    return _keep(docs, lambda texts: [lang != UNKNOWN and score >= least_score for lang, score in model.predict(texts)])


def keep_learned(docs: DataFrame) -> DataFrame:
    """The documents, all columns kept, whose text is in a language that the labelled rows teach.

    A network with a class of rejection judges each text. A text goes if that class is likelier than the bound, which
    all labelled rows that are held out set: at most one in a thousand of them lies above it, none if they are fewer.
    With fewer than LEAST_HELD_OUT such rows, as without any label, nothing is known about the languages, and every
    text with a letter stays.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold() == 0))
    if labelled.limit(LEAST_HELD_OUT).count() < LEAST_HELD_OUT:
        return _keep(docs, lambda texts: [has_letter(t) for t in texts])
    model = train(docs, reject=True)
    if not model.languages:
        return _keep(docs, lambda texts: [has_letter(t) for t in texts])
    bound = reject_bound(labelled, model)
    return _keep(docs, lambda texts: [has_letter(t) and p <= bound for t, p in zip(texts, model.rejected(texts), strict=True)])


def reject_bound(labelled: DataFrame, model: ByteCnn) -> float:
    """The probability of rejection above which at most MOST_LOST of the labelled rows lie; a half at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 0):
            texts = [t for t in block.column(0).to_pylist() if has_letter(t)]
            steps = np.ceil(np.array(model.rejected(texts)) * 10000).astype(np.int64)
            at, rows = np.unique(steps, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(rows)], names=["step", "rows"])

    found = labelled.select("text").mapInArrow(run, "step long, rows long").groupBy("step").agg(F.sum("rows").alias("rows")).collect()
    left = int(sum(r["rows"] for r in found) * MOST_LOST)
    for r in sorted(found, key=lambda r: -r["step"]):
        left -= r["rows"]
        if left < 0:
            return max(0.5, r["step"] / 10000)
    return 0.5


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _keep(docs: DataFrame, judge: Callable[[list[str | None]], list[bool]]) -> DataFrame:
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, at):
            yield block.filter(pa.array(judge(block.column(at).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
