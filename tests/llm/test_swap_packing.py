"""Swap-based packing: ids against the tokenizer, sequences against their rules, the search against best fit."""

import collections
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from groundwell.llm import chunk_encoder, swap_packing, swap_search
from groundwell.llm.arrays import text_slices
from groundwell.llm.chunk_encoder import ChunkEncoder
from groundwell.llm.swap_packing import pack, packing_digest, piece_bounds
from groundwell.llm.swap_search import Search, best_fit, packed_lengths
from tests.conftest import SMALL
from tests.llm.frames import awkward, none

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def sliced(encoder, texts, most):
    out = []
    for _, _, buffer, starts in text_slices(pa.record_batch([pa.array(texts, pa.string())], ["text"]), "text", most):
        ids, ends = encoder.slice_ids(buffer, starts)
        out += [ids[a:b].tolist() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
    return out


PARTS = ["a", "Z", "é", "'", "'s", "n't", " ", "  ", "\n", "\t", "1", "23", ".", ",", "<|endoftext|>", "<|", "|>", " ", " ", "　"]
PARTS += ["漢字", "×", "😀", "_", "-", "$", "\u0085", "\x1c", "\x01", "x" * 70, "привет", "ß", "l'eau", "\r\n", "٣", "́", "​", " "]


@pytest.mark.parametrize("cached", [1_000_000, 40])
def test_ids_equal_the_tokenizers(tokenizer, monkeypatch, cached):
    monkeypatch.setattr(chunk_encoder, "CACHED", cached)
    draw = random.Random(5)
    texts = ["".join(draw.choices(PARTS, k=draw.randint(0, 30))) for _ in range(3000)] + ["", None]
    wanted = [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert sliced(ChunkEncoder(PATH), texts, 1 << 13) == wanted


def test_chunks_of_one_hash(tokenizer, monkeypatch):
    monkeypatch.setattr(chunk_encoder, "hash_words", lambda buffer, first, length, seed=0: length.astype(np.uint64))
    texts = ["one two six ten", "ten six two one", "red, blue; green"]
    assert sliced(ChunkEncoder(PATH), texts, 20) == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def check_packing(rows, limit):
    """Sequences are full from 0 on without gap or overlap, and no longer than the limit."""
    by_sequence = collections.defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= limit
    return len(by_sequence)


def test_awkward_rows(spark, tokenizer):
    docs = awkward(spark)
    got = pack(docs, PATH).collect()
    wanted = collections.Counter()
    for r in docs.collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        for piece, (a, b) in enumerate(piece_bounds(len(ids), 1024)):
            wanted[(r["doc_id"], piece, a, b - a, np.array(ids[a:b], "<u4").tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in got) == wanted
    assert check_packing(got, 1024) == math.ceil(sum(r["length"] for r in got) / 1024)
    digest = packing_digest(pack(docs, PATH)).collect()
    assert collections.Counter(r["ids_crc32"] for r in digest) == collections.Counter(zlib.crc32(r["ids"]) for r in got)
    assert pack(none(spark), PATH).count() == 0


@pytest.mark.parametrize("most", [20_000, 60])
def test_slices_meet_in_later_rounds(spark, monkeypatch, most):
    """Bins that one slice could not fill are filled in the next round: few sequences more than without slices, however small these are."""
    monkeypatch.setattr(swap_packing, "SLICE_PIECES", most)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = pack(docs.unionByName(docs), PATH).collect()
    lengths = [r["length"] for r in got]
    assert len({(r["doc_id"], r["piece"]) for r in got}) * 2 == len(got)
    whole = len(packed_lengths(best_fit(lengths, 1024), 1024))
    assert check_packing(got, 1024) <= whole * (1 if most > 1000 else 1.02)


def test_hot_length(spark):
    """Over a third of all rows of one length, and none that fits beside two of them: no endless rounds."""
    docs = spark.range(900).selectExpr("id AS doc_id", "if(id % 2 = 0, repeat('word ', 500), repeat('a b ', id % 90)) AS text")
    got = pack(docs, PATH, 600).collect()
    lengths = [r["length"] for r in got]
    assert check_packing(got, 600) <= len(best_fit(lengths, 600))


def test_cut_rule():
    assert piece_bounds(1, 4) == [(0, 1)]
    assert piece_bounds(4, 4) == [(0, 4)]
    assert piece_bounds(9, 4) == [(0, 1), (1, 5), (5, 9)]


@pytest.mark.parametrize("seed", range(6))
def test_search_keeps_documents_and_saves_bins(seed):
    draw = np.random.default_rng(seed)
    low, high = [(1, 100), (20, 60), (30, 45), (24, 27), (45, 56), (1, 12)][seed]
    lengths = draw.integers(low, high, 400).tolist()
    first = best_fit(lengths, 100)
    found = packed_lengths(first, 100)
    assert sorted(a for b in found for a in b) == sorted(lengths)
    assert all(0 < sum(b) <= 100 for b in found)
    assert math.ceil(sum(lengths) / 100) <= len(found) <= len(first)
    squares = lambda bins: sum(sum(b) ** 2 for b in bins)
    assert squares(found) >= squares(first)


@pytest.mark.parametrize(
    "bins, wanted",
    [
        ([[5, 4], [6, 3], [1, 1]], 2),  # moves
        ([[6, 2], [8, 1], [3]], 2),  # 3 for 2, then a move
        ([[4, 4], [5, 3, 1], [3, 0 + 2], [1]], 2),  # two for one
    ],
)
def test_single_exchanges(bins, wanted):
    found = packed_lengths(bins, 10)
    assert len(found) <= len(bins) - 1 and sorted(a for b in found for a in b) == sorted(a for b in bins for a in b)
    assert len(found) >= min(wanted, math.ceil(sum(map(sum, bins)) / 10))


def test_every_step_raises_the_squares():
    draw = np.random.default_rng(9)
    for _ in range(60):
        bins = best_fit(draw.integers(10, 48, 40).tolist(), 100)
        search = Search(bins, 100)
        light = max((k for k in range(len(bins)) if search.room[k]), key=lambda k: search.room[k], default=None)
        if light is None:
            continue
        search.leave(light)
        before = sum(sum(b) ** 2 for b in search.bins)
        while search.bins[light] and search.step(light):
            after = sum(sum(b) ** 2 for b in search.bins)
            assert after > before
            before = after


def test_patience_ends_hopeless_searches(monkeypatch):
    monkeypatch.setattr(swap_search, "PATIENCE", 3)
    assert len(packed_lengths([[60]] * 500, 100)) == 500
