"""Tokenising, packing and token files against the library itself and exact round trips."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from dosewright.llm import packing, tokenfile
from dosewright.llm.common import scratch_path
from dosewright.llm.tokens import Encoder, public_vocabulary


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_vocabulary())


def brute(library, text):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_encoder_equals_library(library):
    rng = random.Random(2)
    letters = " \n\t'sa1é.,- 日$"
    texts = ["", " ", "  a", "a  b", "a \n b", "x\u0085  y", "don't 's", "<|endoftext|> a", "end <|endoftext|> next", "x<|endoftext|>y<|endoftext|>", " <|endoftext|> <|endoftext", "a ", "\x1c b \x1c"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    found = [x for _, own in Encoder(public_vocabulary(), memo=500).batches(pa.array([*texts, None]), 0, rows=64) for x in own]
    assert len(found) == len(texts) + 1
    for text, own in zip([*texts, ""], found, strict=True):
        assert np.array_equal(own, brute(library, text)), text


def test_other_tokenizers_get_whole_texts():
    from tokenizers import Tokenizer

    path = public_vocabulary("word_bpe_49k.json")
    own = Encoder(path)
    assert not own.cuts
    text = "Hello  World again"
    (_, [ids]), = own.batches(pa.array([text]), 1)
    assert ids.tolist() == [*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("width", [1, 3, 8, 13, 16, 17, 32])
def test_bits_round_trip(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, 7, 1000, 70_000):
        ids = rng.integers(0, 2**width, n, dtype=np.uint64).astype(np.uint32)
        payload = tokenfile.pack_bits(ids, width)
        assert len(payload) == -(-n * width // 8)
        assert np.array_equal(tokenfile.unpack_bits(payload, width, 0, n), ids)
        if n > 10:
            assert np.array_equal(tokenfile.unpack_bits(payload, width, 5, n - 9), ids[5 : n - 4])


@pytest.mark.parametrize("rows", ["small", "odd"])
def test_store(request, spark, library, rows):
    own, table = request.getfixturevalue(rows)
    path = tokenfile.write_store(table, scratch_path(spark, "t"), public_vocabulary(), block_ids=3000)
    found = sorted(tokenfile.read_documents(spark, path, with_ids=True).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in found]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    at = 0
    for r in found:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    expected = sorted((r[0] is not None, r[0] or 0, brute(library, r[1]).tolist()) for r in own)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, list(r["ids"])) for r in found) == expected
    everything = [x for r in found for x in r["ids"]]
    for start, n in ((0, 10), (2990, 40), (len(everything) - 5, 5)):
        assert tokenfile.read_range(spark, path, start, n).tolist() == everything[start : start + n]


def test_empty_store(spark, empty):
    assert tokenfile.round_trip(empty, public_vocabulary()).count() == 0


def check_packing(library, own, found, capacity):
    texts = defaultdict(list)
    for r in own:
        texts[r[0]].append(brute(library, r[1]))
    held, n = defaultdict(list), 0
    for r in found:
        assert any(r["start"] + r["length"] <= len(x) and zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in texts[r["doc_id"]])
        assert r["piece"] == 0 or r["length"] == capacity
        held[r["sequence_id"]].append((r["offset"], r["length"]))
        n += r["length"]
    assert n == sum(len(x) for t in texts.values() for x in t)
    for parts in held.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(held), -(-n // capacity)


@pytest.mark.parametrize("rows", ["small", "odd"])
def test_packing(request, library, rows):
    own, table = request.getfixturevalue(rows)
    used, least = check_packing(library, own, packing.pack_documents(table, public_vocabulary()).collect(), 2048)
    assert used <= least * 1.02 + 1


def test_packing_of_nothing(empty):
    assert packing.pack_documents(empty, public_vocabulary()).count() == 0


def test_sequences(library, odd):
    rows, table = odd
    packed = packing.pack_documents(table, public_vocabulary(), 256, with_ids=True)
    found = packing.sequences(packed).collect()
    assert sum(len(r["ids"]) for r in found) == sum(len(brute(library, r[1])) for r in rows)
    assert all(len(r["ids"]) <= 256 for r in found)


@pytest.mark.parametrize("n", [0, 1, 50, 3000, 100_000])
def test_plan_is_near_the_bound(n):
    rng = np.random.default_rng(n)
    lengths = np.minimum(512, np.maximum(1, rng.lognormal(4.8, 1.0, n).astype(int)))
    histogram = np.bincount(lengths, minlength=513)
    made = np.zeros(513, int)
    packing_ = packing.plan(histogram, 512)
    for held, many in packing_:
        assert sum(x * k for x, k in held) <= 512
        for x, k in held:
            made[x] += k * many
    assert (made == histogram).all()
    assert sum(many for _, many in packing_) <= 1.01 * -(-lengths.sum() // 512) + 1


def test_fit_reaches_the_histogram():
    histogram = np.zeros(101, np.int64)
    histogram[[60, 40, 30, 70]] = [500, 500, 200, 200]
    patterns = packing.enumerate_patterns(100, histogram > 0)
    fitted = packing.fit_counts(patterns, histogram)
    used = np.zeros(101)
    for p, x in zip(patterns, fitted, strict=True):
        for length in p[p > 0]:
            used[length] += x
    assert np.allclose(used[[60, 40, 30, 70]], [500, 500, 200, 200], rtol=0.02)
