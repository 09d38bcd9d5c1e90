"""BPE against the tokenizers library, and packing against its ids."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from strataplan.llm import bpe, packing

NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


@pytest.mark.parametrize("name", NAMES)
def test_codec_equals_library(name, document_rows, odd_rows):
    path = bpe.public_path(name)
    own, lib = bpe.Codec(path), Tokenizer.from_file(path)
    assert own.known
    rng = random.Random(3)
    strange = ["".join(chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(1, 0x3000), 32, 39, 97 + rng.randrange(26)])) for _ in range(120)) for _ in range(150)]
    for text in [t or "" for _, t in document_rows[:60] + odd_rows] + strange + ["a" * 500 + "b" * 300, "<|startoftext|><|endoftext|>"]:
        ids = lib.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("name", NAMES)
def test_words_in_step_equal_words_alone(name, document_rows, odd_rows):
    own = bpe.codec(bpe.public_path(name))
    words = sorted({w for _, t in document_rows + odd_rows for run, _ in own.pieces(t or "") for w in run}) + ["", "q" * 100, "zqx" * 40]
    ids, at = own.encode_words(words)
    assert [ids[i:j].tolist() for i, j in zip(at, at[1:])] == [own.encode_word(w) for w in words]


def test_cuts_are_forced():
    own = bpe.codec(bpe.public_path(NAMES[0]))
    for token in list(own.vocab)[:5000]:
        b = bytes(own.byte_of[c] for c in token.removesuffix(own.suffix) if c in own.byte_of)
        assert all(own.joined[x << 8 | y] for x, y in zip(b, b[1:]))


def test_digests(odd, odd_rows, none):
    lib = Tokenizer.from_file(bpe.public_path(NAMES[0]))
    want = Counter()
    for d, t in odd_rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.digests(odd, bpe.public_path(NAMES[0])).collect())) == want
    assert bpe.digests(none, bpe.public_path(NAMES[0])).count() == 0


def test_columns_round_trip(spark, odd, odd_rows):
    path = bpe.public_path("byte_bpe_50k.json")
    back = bpe.decode_column(bpe.encode_column(odd, path), path).collect()
    assert Counter(map(tuple, back)) == Counter((d, t or "") for d, t in odd_rows)


def test_cut():
    for n in [*range(1, 3000), 10**6]:
        pieces = packing.cut(n)
        assert sum(pieces) == n and all(p <= 1024 for p in pieces) and sum(p & (p - 1) > 0 for p in pieces) <= 1


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_packing(which, request, odd_rows, document_rows):
    docs = request.getfixturevalue(which)
    rows = odd_rows if which == "odd" else document_rows
    path = bpe.public_path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    got = [r.asDict() for r in packing.packed(docs, path).collect()]
    want = Counter()
    for d, t in rows:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for size in packing.cut(len(ids)):
            want[d, at, size, zlib.crc32(ids[at : at + size].tobytes()), len(ids)] += 1
            at += size
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    by = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == by.get(r["sequence_id"], 0)
        by[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(by) == list(range(len(by))) and max(by.values()) <= 1024
    total = sum(by.values())
    padding = sum(1024 - n for n in by.values() if n & (n - 1))
    assert padding <= max(1024, 0.01 * total)


def test_packing_nothing(none):
    assert packing.packed(none, bpe.public_path("byte_bpe_50k.json")).count() == 0
