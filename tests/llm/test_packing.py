"""Packing: every id once, no overlap, little padding."""

import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from eddyline.llm import packing as P
from eddyline.llm import tokens


def test_cut_covers_and_wastes_nothing_but_the_last():
    for n in range(1, 3000):
        parts = P.cut(n, 1024, 64)
        assert sum(parts) == n and all(0 < p <= 1024 for p in parts)
        assert all(1024 // p * p > 1024 - p and 1024 - 1024 // p * p < 1024 // p for p in parts[:-1])


def check(sequences, docs, capacity=1024):
    seen = defaultdict(list)
    padded = used = 0
    for pieces in sequences:
        total = sum(p[2] for p in pieces)
        assert 0 < total <= capacity
        padded += total if total & (total - 1) == 0 else capacity
        used += total
        for d, a, n in pieces:
            seen[d].append((a, n))
    for d, length in docs.items():
        at = 0
        for a, n in sorted(seen[d]):
            assert a == at
            at += n
        assert at == length
    return 1 - used / padded


def test_packer_places_each_id_once_with_little_padding():
    rnd = random.Random(1)
    docs = {i: max(1, int(rnd.expovariate(1 / 600))) for i in range(3000)}
    out = []
    packer = P.Packer(1024, lambda pieces: out.append(list(pieces)))
    for d, n in docs.items():
        packer.add(d, n)
    packer.close()
    assert check(out, docs) < 0.005
    few = []
    packer = P.Packer(1024, lambda pieces: few.append(list(pieces)))
    packer.add(0, 1)
    packer.add(1, 700)
    packer.close()
    assert check(few, {0: 1, 1: 700}) < 0.02


def test_frame_against_the_tokenizers_library(spark):
    texts = ["Hello, world! It's  fine.", "", None, "ünï cödé 漢字 　 x", "<|endoftext|> as text\t\n\n  end ", "word " * 5000, "Hello, world! It's  fine."]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, start string")
    rows = P.pack(docs.repartition(2)).collect()
    t = Tokenizer.from_file(tokens.default_path())
    t.encode_special_tokens = True
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        assert at <= 1024
    assert P.pack(docs.where("false")).count() == 0


def test_fast_and_reference_encoders_agree():
    rnd = random.Random(3)
    bpe = tokens.bpe(tokens.default_path())
    letters = "abcXYZ é ñß'st 'll 12 ½²ª \n\t.,!?-–“”  \x85漢٣á"
    for _ in range(400):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randrange(40)))
        assert bpe.encode(text).tolist() == bpe.reference(text).tolist(), repr(text)
