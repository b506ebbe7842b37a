"""Media columns as AVI motion-JPEG.

A payload of 8-bit samples becomes grey frames 64 samples wide and at most 64 high, each a lossless JPEG image
(SOF3, left predictor, one restart interval a line), in an AVI file with a stream header and an idx1 index. As the
coding restarts with every line, all lines of a block of files decode side by side, one symbol a step, in numpy.

Reading walks the RIFF chunks, takes the frames from the index, decodes them and looks for shots: a cut is where
two frames' grey histograms differ by more than what the last differences make likely (their mean and 2.5
standard deviations, and a floor). Clips are the runs between cuts, timed by the frame rate.

Rows: null texts count as empty; every payload is padded with zero bytes to a positive multiple of 64, and the
number of unpadded bytes stands in the file's comment; equal texts give equal files; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eddyline.llm.common import blocks, table

WIDTH = HEIGHT = 64
FRAME_MS = 40
#: Lines coded at once, and bytes of coded frames decoded at once.
LINES, CODED_BYTES = 1 << 14, 1 << 20

# The category table of the JPEG standard's annex K.3 (numbers of codes of 1 to 16 bits; the
# categories in order are 0 to 11).
COUNTS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)


def _codes(counts: tuple[int, ...], values: tuple[int, ...]) -> dict[int, tuple[int, int]]:
    """category -> (code, bits) of a canonical Huffman table."""
    out, code, at = {}, 0, 0
    for bits, n in enumerate(counts, 1):
        for _ in range(n):
            out[values[at]] = (code, bits)
            code, at = code + 1, at + 1
        code <<= 1
    return out


_TABLE = _codes(COUNTS, tuple(range(sum(COUNTS))))
_CODE = np.array([_TABLE[c][0] for c in sorted(_TABLE)], np.uint32)
_BITS = np.array([_TABLE[c][1] for c in sorted(_TABLE)], np.uint32)
_CATEGORY = np.array([i.bit_length() for i in range(256)], np.uint32)


def _header(height: int) -> bytes:
    return b"".join(
        (
            b"\xff\xd8",
            b"\xff\xc3" + struct.pack(">HBHHBBBB", 11, 8, height, WIDTH, 1, 1, 0x11, 0),
            b"\xff\xc4" + struct.pack(">HB", 19 + sum(COUNTS), 0) + bytes(COUNTS) + bytes(range(sum(COUNTS))),
            b"\xff\xdd" + struct.pack(">HH", 4, WIDTH),
            b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 1, 0, 0),
        )
    )


_HEADERS = [_header(h) for h in range(HEIGHT + 1)]


def code_lines(x: np.ndarray, number: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Entropy-coded lines, each followed by its restart marker, and where each one starts.

    x: lines of samples; number: each line's place in its frame. Lines do not depend on each other, so a text of
    any length is coded in slices.
    """
    parts, starts, size = [], [np.zeros(1, np.int64)], 0
    for i in range(0, len(x), LINES):
        data, own = _code_slice(x[i : i + LINES], number[i : i + LINES])
        parts.append(data)
        starts.append(own[1:] + size)
        size += len(data)
    return b"".join(parts), np.concatenate(starts)


def _code_slice(x: np.ndarray, number: np.ndarray) -> tuple[bytes, np.ndarray]:
    diff = np.diff(x.astype(np.int32), axis=1, prepend=128)
    cat = _CATEGORY[np.abs(diff)]
    value = _CODE[cat] << cat | np.where(diff < 0, diff + (1 << cat.astype(np.int32)) - 1, diff).astype(np.uint32)
    bits = _BITS[cat] + cat
    ends = np.cumsum(bits, axis=1, dtype=np.int64)
    size = ends[:, -1]
    wide = (size + 7) // 8
    first = np.concatenate([[0], np.cumsum(wide)])
    at = first[:-1, None] * 8 + ends - bits
    word = (value << (24 - (at & 7).astype(np.uint32) - bits)).ravel()
    at = (at >> 3).ravel()
    n = int(first[-1])
    data = sum(np.bincount(at + k, (word >> 16 - 8 * k) & 255, n + 2) for k in range(3))[:n].astype(np.uint8)
    data[first[1:] - 1] |= ((1 << (wide * 8 - size)) - 1).astype(np.uint8)
    full = data == 255  # a zero byte follows
    line = np.repeat(np.arange(len(x)), wide)
    place = np.arange(n) + np.cumsum(full) - full + 2 * line
    out = np.zeros(n + int(full.sum()) + 2 * len(x), np.uint8)
    out[place] = data
    starts = np.concatenate([[0], (place + full)[first[1:] - 1] + 3])
    out[starts[1:] - 2] = 255
    out[starts[1:] - 1] = 0xD0 + number % 8
    return out.tobytes(), starts


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def file_of(frames: list[bytes], height: int, n_bytes: int) -> bytes:
    """An AVI file of MJPG frames with an index."""
    biggest = max(map(len, frames))
    avih = struct.pack("<14I", FRAME_MS * 1000, biggest * 1000 // FRAME_MS, 0, 0x10, len(frames), 0, 1, biggest, WIDTH, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, FRAME_MS, 1000, 0, len(frames), biggest, 10000, 0, 0, 0, WIDTH, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, height, 1, 8, b"MJPG", WIDTH * height, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"bytes=%d\0" % n_bytes))
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        movi.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(movi[-1])
    body = b"AVI " + head + info + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def encode(payloads: list[bytes]) -> list[bytes]:
    """The file of each payload."""
    padded = [p + b"\0" * (-len(p) % WIDTH if p else WIDTH) for p in payloads]
    lines = [len(p) // WIDTH for p in padded]
    x = np.frombuffer(b"".join(padded), np.uint8).reshape(-1, WIDTH)
    number = np.concatenate([np.arange(n) % HEIGHT for n in lines])
    data, starts = code_lines(x, number)
    out, line = [], 0
    for payload, n in zip(payloads, lines, strict=True):
        frames = []
        for a in range(line, line + n, HEIGHT):
            b = min(a + HEIGHT, line + n)
            frames.append(_HEADERS[b - a] + data[starts[a] : starts[b] - 2] + b"\xff\xd9")
        out.append(file_of(frames, min(n, HEIGHT), len(payload)))
        line += n
    return out


# ---- reading -----------------------------------------------------------------------------------------------


def riff_chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, end) of the chunks between two places."""
    while at + 8 <= end:
        name, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        yield name, at + 8, at + 8 + n
        at += 8 + n + (n & 1)


def parse(data: bytes) -> tuple[list[tuple[int, int]], dict]:
    """Places of the frames, from the index, and what the headers say."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    frames, about, movi, index = [], {}, 0, None
    for name, a, b in riff_chunks(data, 12, 8 + struct.unpack_from("<I", data, 4)[0]):
        kind = data[a : a + 4]
        if name == b"LIST" and kind == b"movi":
            movi = a
        elif name == b"LIST" and kind == b"hdrl":
            for inner, c, _ in riff_chunks(data, a + 4, b):
                if inner == b"avih":
                    about["frame_us"] = struct.unpack_from("<I", data, c)[0]
        elif name == b"LIST" and kind == b"INFO":
            for inner, c, d in riff_chunks(data, a + 4, b):
                if inner == b"ICMT" and data[c:d].startswith(b"bytes="):
                    about["n_bytes"] = int(data[c + 6 : d].rstrip(b"\0"))
        elif name == b"idx1":
            index = (a, b)
    if not movi or index is None:
        raise ValueError("no frames or no index")
    for at in range(*index, 16):
        name, _, offset, n = struct.unpack_from("<4sIII", data, at)
        if name[2:] in (b"dc", b"db"):
            frames.append((movi + offset + 8, movi + offset + 8 + n))
    return frames, about


def image_parts(data: bytes, a: int, b: int) -> tuple[int, int, bytes, int]:
    """Height, width, the Huffman table's bytes and where the coded lines start."""
    at, height, width, huffman, interval = a + 2, 0, 0, b"", 0
    while True:
        marker, n = struct.unpack_from(">HH", data, at)
        if marker == 0xFFC3:
            bits, height, width, parts = struct.unpack_from(">BHHB", data, at + 4)
            if bits != 8 or parts != 1:
                raise ValueError("only one component of 8 bits is read")
        elif marker == 0xFFC4:
            huffman = data[at + 5 : at + 2 + n]
        elif marker == 0xFFDD:
            interval = struct.unpack_from(">H", data, at + 4)[0]
        elif marker == 0xFFDA:
            if interval != width or data[at + 7] != 1:
                raise ValueError("only frames with the left predictor and one restart interval a line are read")
            return height, width, huffman, at + 2 + n
        elif 0xFFC0 <= marker <= 0xFFCF:
            raise ValueError("only lossless frames are read")
        at += 2 + n


_lookups: dict[bytes, np.ndarray] = {}


def lookup(huffman: bytes) -> np.ndarray:
    """For each 16 bits ahead: category << 8 | bits of the code."""
    if huffman not in _lookups:
        out = np.zeros(1 << 16, np.uint32)
        for category, (code, bits) in _codes(tuple(huffman[:16]), tuple(huffman[16:])).items():
            out[code << 16 - bits : code + 1 << 16 - bits] = category << 8 | bits
        _lookups[huffman] = out
    return _lookups[huffman]


def decode(coded: list[bytes], width: int, huffman: bytes) -> np.ndarray:
    """The lines of frames whose coded parts, up to and with the end marker, are given."""
    out, held, size = [], [], 0
    for frame in coded:
        held.append(frame)
        size += len(frame)
        if size >= CODED_BYTES:
            out.append(_decode_slice(held, width, huffman))
            held, size = [], 0
    if held:
        out.append(_decode_slice(held, width, huffman))
    return np.concatenate(out)


def _decode_slice(coded: list[bytes], width: int, huffman: bytes) -> np.ndarray:
    raw = np.frombuffer(b"".join(coded), np.uint8)
    after = np.append(raw[1:], 0)
    mark = (raw == 255) & (((after >= 0xD0) & (after <= 0xD7)) | (after == 0xD9))
    zero = np.append(False, (raw[:-1] == 255) & (raw[1:] == 0))
    keep = ~(mark | np.append(False, mark[:-1]) | zero)
    ends = np.cumsum(keep)[np.flatnonzero(mark)]
    starts = np.append(0, ends[:-1])
    data = np.append(raw[keep], np.full(8, 255, np.uint8)).astype(np.uint64)
    words = data[:-4] << np.uint64(32) | data[1:-3] << np.uint64(24) | data[2:-2] << np.uint64(16) | data[3:-1] << np.uint64(8) | data[4:]
    table_, at = lookup(huffman), starts.astype(np.int64) * 8
    out = np.empty((width, len(starts)), np.uint8)
    value = np.full(len(starts), 128, np.int64)
    for k in range(width):
        ahead = (words[np.minimum(at >> 3, len(words) - 1)] >> (np.uint64(8) - (at & 7).astype(np.uint64))) & np.uint64(0xFFFFFFFF)
        entry = table_[(ahead >> np.uint64(16)).astype(np.int64)].astype(np.int64)
        bits, cat = entry & 255, entry >> 8
        extra = (ahead.astype(np.int64) >> (32 - bits - cat)) & ((1 << cat) - 1)
        value += np.where(extra < (1 << cat) >> 1, extra - (1 << cat) + 1, extra)
        out[k] = value
        at += bits + cat
    return out.T


def histogram_cuts(frames: list[np.ndarray], bins: int = 16, last: int = 8, floor: float = 0.15) -> tuple[list[int], list[float]]:
    """Frames that start a shot, besides the first, and all differences."""
    hists = [np.bincount(f >> 4, minlength=bins) / len(f) for f in frames]
    diffs = [float(np.abs(a - b).sum() / 2) for a, b in zip(hists, hists[1:], strict=False)]
    cuts = []
    for i, d in enumerate(diffs):
        recent = diffs[max(0, i - last) : i]
        level = max(floor, float(np.mean(recent) + 2.5 * np.std(recent))) if recent else floor
        if d > level:
            cuts.append(i + 1)
    return cuts, diffs


def read(files: list[bytes]) -> list[tuple[bytes, int, list[tuple[int, int, int]], list[float]]]:
    """For each file: its samples, unpadded bytes, clips (start ms, end ms, frames) and histogram differences."""
    plans, coded, heights = [], [], []
    kinds = set()
    for data in files:
        frames, about = parse(data)
        own = []
        for a, b in frames:
            height, width, huffman, start = image_parts(data, a, b)
            kinds.add((width, huffman))
            coded.append(data[start:b])
            own.append(height)
        plans.append((own, about))
        heights += own
    if len(kinds) > 1:
        return [x for f in files for x in read([f])] if len(files) > 1 else _refuse()
    lines = decode(coded, *kinds.pop()) if kinds else np.empty((0, 1), np.uint8)
    out, at = [], 0
    for own, about in plans:
        samples = lines[at : at + sum(own)]
        pictures = [p.ravel() for p in np.split(samples, np.cumsum(own)[:-1])]
        cuts, diffs = histogram_cuts(pictures)
        ms = about["frame_us"] // 1000
        bounds = [0, *cuts, len(own)]
        clips = [(a * ms, b * ms, b - a) for a, b in zip(bounds, bounds[1:], strict=False)]
        payload = samples.tobytes()
        out.append((payload, about.get("n_bytes", len(payload)), clips, diffs))
        at += sum(own)
    return out


def _refuse():
    raise ValueError("frames of different shapes in one file")


# ---- operators ---------------------------------------------------------------------------------------------


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id and the AVI file of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 1, 2 << 20):
            files = encode([(t or "").encode("utf-8", "surrogatepass") for t in block.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(files, pa.binary())], names=["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, media binary")


def clip_rows(media: DataFrame) -> DataFrame:
    """One row a clip: its file, number, start and end in ms, frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 1, 2 << 20):
            found = read(block.column(1).to_pylist())
            rows = [(d, k, *clip) for d, (_, _, clips, _) in zip(block.column(0).to_pylist(), found, strict=True) for k, clip in enumerate(clips)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "clip", "start_ms", "end_ms", "frames"])

    return media.mapInArrow(run, "doc_id long, clip long, start_ms long, end_ms long, frames long")


READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(media: DataFrame) -> DataFrame:
    """What reading each file back gives: the payload's size and hashes, the file's, and its clips."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 1, 2 << 20):
            files = block.column(1).to_pylist()
            rows = []
            for data, (payload, n, clips, diffs) in zip(files, read(files), strict=True):
                feature = f"clips={'|'.join(f'{a}-{b}' for a, b, _ in clips)};frames={sum(c for *_, c in clips)};change={max(diffs, default=0):.4f}"
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([block.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=[x.split()[0] for x in READ.split(", ")])

    return media.mapInArrow(run, READ)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(to_media(table(spark, sf_dir, "documents")))
