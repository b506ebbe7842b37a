"""WARC archives and an external merge of their capture index.

Writing: every page becomes a record of its own gzip member. Of equal payloads of at least `least_revisit` bytes
the one with the smallest page_id is a response, the others are revisits that refer to it and carry headers only.
Which payloads repeat is found on digests alone; the few repeated digests are stored and joined back, so that the
pages themselves are shuffled only if that table is too large to broadcast by the session's threshold.

Indexing: each archive, read back, becomes a capture run: its captures sorted by URL key and time, written to a file
in blocks of bounded size, with the first and last key of every block as a sparse index. Runs are merged externally:
the sparse index is cut into ranges of keys of about equal bytes, so that one URL with a third of all captures spreads
over many tasks, and the task of a range opens each run at the blocks that meet its range and merges the streams with
a loser tree, holding one block of each. With more runs than the fan-in, groups of runs are merged into longer runs
first, in as many passes as that takes. Range by range the result is one ordered history.

A revisit's digest and size are checked against the response that it refers to, as that was read back.

Rows: a null html is an empty payload, a null url has no target URI and the key ""; without page_id a record is
named after its payload. Rows that share the smallest page_id of their payload are all responses. Blanks and
control characters in URLs are percent-encoded. Other columns are not read. An empty table makes no archive. A very
long page is one record, held whole by one task at a time.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eddyline.llm.common import blocks, shared_dir, stored, table
from eddyline.llm.files import content, open_fs, whole

LEAST_REVISIT = 100
#: Compressed bytes after which an archive is closed.
ARCHIVE_BYTES = 32 << 20
#: Tasks that read archives back at most.
MOST_TASKS = 100_000
FIRST_CAPTURE = dt.datetime(2000, 1, 1, tzinfo=dt.UTC)

# ---- records -----------------------------------------------------------------------------------------------

_UNNAMED = 0b10 << 126


def record_id(page_id: int | None, digest: str) -> str:
    """A record's URN; it holds the page_id, or without one a part of the digest."""
    n = page_id & (1 << 128) - 1 if page_id is not None else _UNNAMED | int(digest[:31], 16)
    return f"<urn:uuid:{uuid.UUID(int=n)}>"


def page_of(urn: str) -> int | None:
    n = uuid.UUID(urn.strip("<>").removeprefix("urn:uuid:")).int
    if n >> 126 == 0b10:
        return None
    return n - (1 << 128) if n >> 127 else n


def _uri(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f-\xa0  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, uncompressed. The time of capture, which pages lack, follows from the page_id."""
    when = FIRST_CAPTURE + dt.timedelta(seconds=(page_id or 0) % (1 << 31))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {when:%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of the gzip members of an archive."""
    view, at = memoryview(data), 0
    while at < len(data):
        d, parts, pos = zlib.decompressobj(31), [], at
        while not d.eof:
            if pos >= len(data):
                raise ValueError("the archive ends within a record")
            parts.append(d.decompress(view[pos : pos + (1 << 16)]))
            pos += 1 << 16
        end = min(pos, len(data)) - len(d.unused_data)
        yield at, end - at, b"".join(parts)
        at = end


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")[1:]
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}


def url_key(url: str | None) -> str:
    """Sort-friendly key: the host's labels from the last to the first, then path and query, all in lower case."""
    m = re.match(r"(?i)[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?([^#]*)", url or "")
    if not m:
        return (url or "").lower()
    host = m[1].lower().removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (m[2].lower() or "/")


Entry = tuple  # url_key, captured, page_id (0 if none), archive, offset, then the other columns


def index_entries(archive: str, data: bytes) -> list[Entry]:
    """The captures of an archive in order of URL key, time and page: a sorted run."""
    out = []
    for offset, length, raw in members(data):
        head, _, block = raw.partition(b"\r\n\r\n")
        fields = _fields(head)
        block = block[: int(fields["content-length"])]
        http, _, payload = block.partition(b"\r\n\r\n")
        page = page_of(fields["warc-record-id"])
        if fields["warc-type"] == "response":
            digest, size, refers = hashlib.sha256(payload).hexdigest(), len(payload), None
        else:
            digest, size = fields["warc-payload-digest"].removeprefix("sha256:"), int(_fields(http)["content-length"])
            refers = page_of(fields["warc-refers-to"])
        out.append((url_key(fields.get("warc-target-uri")), fields["warc-date"], page or 0, archive, offset, length, page, size, digest, fields["warc-type"], refers))
    out.sort(key=lambda e: e[:5])
    return out


# ---- merging -----------------------------------------------------------------------------------------------


class LoserTree:
    """Merges k sorted streams: inner nodes keep the loser of their match, so one path is replayed for each item."""

    def __init__(self, streams: Iterable[Iterable[Entry]], key=lambda e: e[:5]):
        self.key = key
        self.rest = [iter(x) for x in streams]
        self.items = [next(x, None) for x in self.rest]
        self.heads = [None if e is None else key(e) for e in self.items]  # None: the stream is at its end
        k = len(self.rest)
        self.losers = [-1] * k
        for leaf in range(k):
            self._play(leaf)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and (x, a) < (y, b)

    def _play(self, leaf: int) -> None:
        """From a leaf to the root. While the tree is built, the first to reach a node waits there."""
        k, winner = len(self.rest), leaf
        node = (leaf + k) // 2
        while node:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = winner
                return
            if self._beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[Entry]:
        while self.rest and self.heads[w := self.losers[0]] is not None:
            yield self.items[w]
            e = self.items[w] = next(self.rest[w], None)
            self.heads[w] = None if e is None else self.key(e)
            self._play(w)


# ---- operators ---------------------------------------------------------------------------------------------


def write_archives(pages: DataFrame, out: str, least_revisit: int = LEAST_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write `pages` (page_id, url, html) as archives below `out`; returns the stored manifest (path, records, bytes)."""
    spark = pages.sparkSession
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    repeated = rows.where(F.length("payload") >= least_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    repeated = stored(repeated.where("n > 1 and first is not null").select("digest", "first"), "warc-repeated")
    dealt = rows.join(repeated, "digest", "left").select("page_id", "url", "payload", "digest", F.expr("case when first <> page_id or (first is not null and page_id is null) then first end").alias("refers_to"))
    kinds = "path string, records long, bytes long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        stem = f"{out}/part-{context.partitionId():06d}-{context.taskAttemptId()}"
        number, held, size, done = 0, [], 0, []

        def close() -> None:
            nonlocal number, held, size
            path = f"{stem}-{number:04d}.warc.gz"
            with whole(path) as f:
                for x in held:
                    f.write(x)
            done.append((path, len(held), size))
            number, held, size = number + 1, [], 0

        for block in blocks(batches, 2):
            for row in zip(*(c.to_pylist() for c in block.columns), strict=True):
                c = zlib.compressobj(4, zlib.DEFLATED, 31)
                held.append(c.compress(record(*row)) + c.flush())
                size += len(held[-1])
                if size >= archive_bytes:
                    close()
        if held:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["path", "records", "bytes"])

    dealt.mapInArrow(run, kinds).write.parquet(f"{out}/manifest")
    return spark.read.schema(kinds).parquet(f"{out}/manifest")


CAPTURE = "url_key string, captured string, page_key long, archive string, offset long, length long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_NAMES = [x.split()[0] for x in CAPTURE.split(", ")]
_KINDS = [pa.string() if x.endswith("string") else pa.int64() for x in CAPTURE.split(", ")]
#: Captures in a block of a run, and in one Arrow batch; runs that are merged at once; bytes of blocks to a range.
BLOCK_ROWS, BATCH_ROWS, FAN_IN, RANGE_BYTES = 512, 20_000, 256, 32 << 20
_KEY = ("url_key", "captured", "page_key", "archive", "offset")
_END = ", ".join(f"{c} {'long' if c in ('page_key', 'offset') else 'string'}" for c in _KEY)
#: Blocks of runs: which run, their place in its file, and their first and last key.
RUNS = f"run long, path string, at long, bytes long, least struct<{_END.replace(' ', ': ').replace(',:', ',')}>, last struct<{_END.replace(' ', ': ').replace(',:', ',')}>"
_END_KIND = pa.struct([(c, pa.int64() if c in ("page_key", "offset") else pa.string()) for c in _KEY])
_RUN_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.int64(), _END_KIND, _END_KIND]


def _rows(entries: list[Entry]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*entries, strict=True), _KINDS, strict=True)], names=_NAMES)


def _end(e: Entry) -> dict:
    return dict(zip(_KEY, e[:5], strict=True))


def _key(end: dict) -> tuple:
    return tuple(end[c] for c in _KEY)


def write_run(entries: Iterable[Entry], run: int, path: str, block_rows: int = BLOCK_ROWS) -> Iterator[pa.RecordBatch]:
    """Write sorted captures as a file of blocks; yields the sparse index, one row a block."""
    index: list[tuple] = []
    held: list[Entry] = []
    at = 0

    def block(out) -> None:
        nonlocal at
        sink = pa.BufferOutputStream()
        rows = _rows(held)
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_batch(rows)
        data = sink.getvalue()
        out.write(data)
        index.append((run, path, at, data.size, _end(held[0]), _end(held[-1])))
        at += data.size
        held.clear()

    with whole(path) as out:
        for e in entries:
            held.append(e)
            if len(held) == block_rows:
                block(out)
        if held:
            block(out)
    if index:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*index, strict=True), _RUN_KINDS, strict=True)], names=["run", "path", "at", "bytes", "least", "last"])


def read_run(places: Iterable[tuple[str, int, int]], least: tuple | None, end: tuple | None) -> Iterator[Entry]:
    """The captures of a run's blocks (path, at, bytes) from key `least` on, before key `end`: one block is held at a time."""
    for path, at, size in places:
        with pa.ipc.open_stream(content(path, at, size)) as reader:
            for batch in reader:
                for e in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if end is not None and e[:5] >= end:
                        return
                    if least is None or e[:5] >= least:
                        yield e


def capture_runs(manifest: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The sparse index of the capture runs, one for each archive, read back from its file and sorted."""
    spark = manifest.sparkSession
    out = shared_dir(spark, "warc-runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                entries = index_entries(path, content(path))  # an archive has a bounded size, or one record
                name = int.from_bytes(hashlib.blake2b(path.encode(), digest_size=8).digest(), "little", signed=True)
                yield from write_run(entries, name, f"{out}/{name & (1 << 64) - 1:016x}.run", block_rows)

    tasks = max(1, min(manifest.count(), MOST_TASKS))  # given as a number, so that the few small rows still spread
    return stored(manifest.select("path").repartition(tasks).mapInArrow(run, RUNS), "warc-index")


def range_ends(runs: DataFrame, ranges: int) -> list[tuple]:
    """First keys of all ranges but the first: the driver holds one key for each RANGE_BYTES of runs."""
    if ranges < 2:
        return []
    firsts = runs.select("least.*").repartitionByRange(ranges, *_KEY).sortWithinPartitions(*_KEY)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.slice(0, 1)
                return

    return sorted(tuple(r) for r in firsts.mapInArrow(first, _END).collect())[1:]


def _slices(runs: DataFrame, ends: list[tuple], fan_in: int, spread: bool) -> DataFrame:
    """Rows (team, range, run, path, at, bytes, least key): blocks of runs for each range that they meet, teams of `fan_in` runs."""
    names = runs.select("run").distinct()
    if spread:
        from pyspark.sql import Window

        numbered = names.withColumn("team", F.floor((F.row_number().over(Window.orderBy("run")) - 1) / fan_in).cast("long"))  # one small row a run
        runs = runs.join(numbered, "run")
    else:
        runs = runs.withColumn("team", F.lit(0).cast("long"))
    kinds = [pa.int64(), pa.int64(), *_RUN_KINDS[:5]]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for team, run, path, at, size, least, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k in range(bisect_right(ends, _key(least)), bisect_right(ends, _key(last)) + 1):
                    out.append((team, k, run, path, at, size, least))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["team", "range", "run", "path", "at", "bytes", "least"])

    rows = runs.select("team", "run", "path", "at", "bytes", "least", "last")
    return rows.mapInArrow(meet, "team long, range long, " + RUNS.rpartition(", last")[0])


def _merged(slices: Iterator[pa.RecordBatch], ends: list[tuple]) -> Iterator[tuple[int, int, Iterator[Entry]]]:
    """(team, range, its captures in order) from the blocks of each, sorted by team, range, run and key."""

    def rows() -> Iterator[tuple]:
        for batch in slices:
            yield from zip(*(batch.column(n).to_pylist() for n in ("team", "range", "run", "path", "at", "bytes")), strict=True)

    for (team, k), own in groupby(rows(), lambda r: r[:2]):
        least, end = ends[k - 1] if k else None, ends[k] if k < len(ends) else None
        streams = [read_run([r[3:] for r in places], least, end) for _, places in groupby(list(own), lambda r: r[2])]
        yield team, k, iter(LoserTree(streams))


def merge_runs(runs: DataFrame, fan_in: int = FAN_IN, range_bytes: int = RANGE_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Globally ordered capture histories from the sparse index of runs. `position` grows along the whole order."""
    spark = runs.sparkSession
    while True:
        size = runs.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count_distinct("run").alias("runs")).first()
        ends = range_ends(runs, min(MOST_TASKS, -(-size["bytes"] // range_bytes)))
        if size["runs"] <= fan_in:
            break
        out = shared_dir(spark, "warc-runs")

        def longer(batches: Iterator[pa.RecordBatch], ends=ends, out=out) -> Iterator[pa.RecordBatch]:
            for team, k, entries in _merged(batches, ends):
                yield from write_run(entries, team, f"{out}/{team:09d}-{k:09d}.run", block_rows)

        # a team's ranges may be narrow: several pairs of team and range share a task
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(ends) + 1)
        slices = _slices(runs, ends, fan_in, True).repartition(tasks, "team", "range").sortWithinPartitions("team", "range", "run", "least")
        runs = stored(slices.mapInArrow(longer, RUNS), "warc-index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, k, entries in _merged(batches, ends):
            out: list[Entry] = []
            base = k << 40

            def batch(out=out) -> pa.RecordBatch:
                nonlocal base
                rows = _rows(out)
                made = pa.RecordBatch.from_arrays([*rows.columns, pa.array(range(base, base + len(out)), pa.int64())], names=[*_NAMES, "position"])
                base += len(out)
                out.clear()
                return made

            for entry in entries:
                out.append(entry)
                if len(out) == BATCH_ROWS:
                    yield batch()
            if out:
                yield batch()

    slices = _slices(runs, ends, fan_in, False).repartitionById(len(ends) + 1, F.col("range").cast("int")).sortWithinPartitions("team", "range", "run", "least")
    return slices.mapInArrow(run, CAPTURE + ", position long")


def check_revisits(captures: DataFrame) -> None:
    """Raise if a revisit's digest or size is not that of the response it refers to, as read back."""
    claimed = captures.where("record_type = 'revisit'").groupBy("refers_to", "payload_digest").agg(F.min("payload_bytes").alias("low"), F.max("payload_bytes").alias("high"))
    there = captures.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.min("payload_bytes").alias("size"))
    wrong = claimed.join(there, ["refers_to", "payload_digest"], "left").where("size is null or low <> size or high <> size").first()
    if wrong is not None:
        raise ValueError(f"a revisit of page {wrong['refers_to']} has another payload than the response")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"), shared_dir(spark, "warc"))
    merged = stored(merge_runs(capture_runs(manifest)), "warc-merged")
    check_revisits(merged)
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")


#: The same result from the table itself.
ORACLE = r"""
with p as (
  select page_id, coalesce(html, '') as html, coalesce(url, '') as url,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/?#:]*)(:[0-9]+)?([^#]*)', ['login', 'host', 'port', 'rest']) as u,
    regexp_matches(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://') as absolute from pages
), d as (
  select *, sha256(html) as digest, strlen(html) as bytes, min(page_id) over (partition by html) as first from p
)
select page_id, cast(bytes as bigint) as payload_bytes, digest as payload_digest,
  case when bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
  case when bytes >= 100 and page_id <> first then first end as refers_to,
  case when absolute then array_to_string(list_reverse(string_split(regexp_replace(lower(u.host), '^www\.', ''), '.')), ',') || ')' || case when u.rest = '' then '/' else lower(u.rest) end else lower(url) end as url_key,
  strftime(timestamp '2000-01-01' + to_seconds(page_id % 2147483648), '%Y-%m-%dT%H:%M:%SZ') as captured
from d
"""
