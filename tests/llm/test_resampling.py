"""Importance resampling against brute force, and on awkward rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from groundwell.llm import crc_buckets, importance_resampling
from groundwell.llm.importance_resampling import gumbel, ranked_from, resample
from tests.llm.frames import awkward, lowered, none

TARGET = "item_id long, text string"


def features_of(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    return words, words + [" ".join(pair) for pair in zip(words, words[1:])]


def brute(docs, target, buckets=10_000, percent=25, min_words=20):
    """(doc_id, n_features, weight, score) of every row, and the ranks of the drawn ids."""
    raw, wanted = collections.Counter(), collections.Counter()
    for _, text in docs:
        raw.update(zlib.crc32(f.encode()) % buckets for f in features_of(text)[1])
    for text in target:
        wanted.update(zlib.crc32(f.encode()) % buckets for f in features_of(text)[1])
    s, t = sum(raw.values()), sum(wanted.values())
    rows, able = [], []
    for doc_id, text in docs:
        words, found = features_of(text)
        own = [zlib.crc32(f.encode()) % buckets for f in found]
        gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s + buckets) / ((raw[b] + 1) * (t + buckets)))) for b in own]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc_id, len(found), weight, score))
        if len(words) >= min_words:
            able.append((-score, doc_id is None, doc_id or 0))
    return rows, sorted(able)[: len(able) * percent // 100]


def check(docs, target, **options):
    got = resample(docs, target, **options).collect()
    rows, drawn = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()], **options)
    assert collections.Counter((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got) == collections.Counter(rows)
    ranked = sorted((r["rank"], -r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in got if r["rank"] is not None)
    assert [r[0] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [r[1:] for r in ranked] == drawn
    return got


def test_awkward_rows(spark):
    target = spark.createDataFrame([(1, "word1 of word2 alpha"), (2, None), (3, "É é"), (None, "...")], TARGET)
    check(awkward(spark), target, percent=60)
    check(awkward(spark), target, percent=100, min_words=0)
    check(awkward(spark), spark.createDataFrame([], TARGET), percent=50, min_words=1)
    assert resample(none(spark), target).count() == 0
    assert all(r["rank"] is None for r in resample(awkward(spark).filter("doc_id = 4"), target).collect())


def test_hot_id_and_ranges(spark, monkeypatch):
    """A third of all rows with one id and one text: one score, ranks without a gap over several ranges."""
    monkeypatch.setattr(importance_resampling, "RANGE_ROWS", 50)
    docs = spark.range(600).selectExpr(
        "if(id % 3 = 0, 7L, id) AS doc_id", "if(id % 3 = 0, repeat('hot words here ', 9), repeat(concat('w', id % 50, ' target '), 12)) AS text"
    )
    got = check(docs, spark.createDataFrame([(1, "target w3 target w4")], TARGET), percent=90)
    assert sum(r["rank"] is not None for r in got) == 540


def test_ranks_need_no_hot_partition(spark, monkeypatch):
    monkeypatch.setattr(importance_resampling, "RANGE_ROWS", 100)
    rows = spark.range(1000).selectExpr("5L AS score", "if(id % 2 = 0, null, 1L) AS doc_id", "id AS uid")
    got = ranked_from(rows, 1000).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 1001))
    assert [r["doc_id"] for r in got] == [1] * 500 + [None] * 500


def test_crcs_of_all_lengths(spark):
    rng = np.random.default_rng(1)
    buffer = rng.integers(0, 256, 5000, dtype=np.uint8)
    length = np.concatenate((np.arange(300), rng.integers(0, 40, 700), [2000]))
    first = rng.integers(0, 2900, len(length))
    got = crc_buckets.crc_of_spans(buffer, first, length)
    assert got.tolist() == [zlib.crc32(buffer[a : a + n].tobytes()) for a, n in zip(first.tolist(), length.tolist())]


def test_words_of_one_hash_are_told_apart(monkeypatch):
    """Were all hashes the same, every word would still have its own number."""
    monkeypatch.setattr(crc_buckets, "hash_words", lambda flat, first, length, seed=0: np.zeros(len(first), np.uint64))
    flat = np.frombuffer(b" ab cd ab e cd ab " + bytes(40), np.uint8)
    first, length = np.array([1, 4, 7, 10, 12, 15]), np.array([2, 2, 2, 1, 2, 2])
    number, place = crc_buckets.word_numbers(flat, first, length)
    assert len(set(number.tolist())) == 3 == len(place)
    assert [flat[first[place[n]] : first[place[n]] + length[place[n]]].tobytes() for n in number] == [b"ab", b"cd", b"ab", b"e", b"cd", b"ab"]


def test_gumbel_of_ids(spark):
    got = spark.range(50).select(gumbel(F.col("id"), 7).alias("g")).collect()
    h = [int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16) for i in range(50)]
    assert [r["g"] for r in got] == [math.floor(-1000 * math.log(-math.log((x + 0.5) / 4294967296))) for x in h]
