"""Periodic runs of words in documents, and the texts with all but the first period of each run removed.

A run is a stretch of words with smallest period q and at least max(24, 3 q) words that no neighbouring word extends.
Runs come from a suffix automaton with link-cut access (suffix_access) over the stretches of a text that can hold one:
in a run each 16 words in a row stand again q words on or q words back, which covers it whole, so words that no repeated
16 words cover are in no run. The stretches so covered are narrowed by the distance at which their 16 words repeat, which in
a run is at most a third of it. This leaves out nothing that is a run; what it leaves in, the automaton decides.

Everything is per document, so nothing is shuffled. Repeated words are found by a hash of 16 word numbers of one document,
word numbers by a hash and the words' bytes.

Defined results: null and empty texts and texts without words have no runs and an empty collapsed text; repeated rows come out each;
with `tails`, a row without an id is left as it is; an empty table gives no rows. Columns other than doc_id and text are not
read.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwell.llm.arrays import NOT_SPACE, PAD, mix, ranges, text_slices, words_in
from groundwell.llm.crc_buckets import word_numbers
from groundwell.llm.suffix_access import MIN_LENGTH, MIN_PERIODS, periodic_runs

GRAM = 16
RUNS = "array<struct<start:long,length:long,period:long>>"
FOUND = f"doc_id long, n_words long, runs {RUNS}, collapsed string"

_FAR = np.int64(1) << 60


def spaced_words(buffer: np.ndarray, starts: np.ndarray):
    """(flat, first, length, bounds): the slice's words with one space before, between and behind them, their places, and text k's
    words bounds[k] to bounds[k + 1]."""
    data = buffer[: int(starts[-1])]
    inside = NOT_SPACE[data]
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    kept = data[keep]
    kept[~inside[keep]] = 32
    flat = np.concatenate((np.full(1, 32, np.uint8), kept, np.zeros(PAD, np.uint8)))
    first, length = words_in(flat, len(kept) + 1, NOT_SPACE)
    return flat, first, length, np.searchsorted(first, np.concatenate(([0], np.cumsum(keep)))[starts] + 1)


def repeated_tail(doc_id, n: int) -> tuple[int, int] | None:
    """(a, p) where a document's words from a on are its p words from a on over and over; by the hash of its id for
    one document in ten."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    return g % n, 1 + (n - g % n) // (3 + g % 8)


def tail_order(doc_ids: list, bounds: np.ndarray) -> np.ndarray:
    """For each place of the slice the word that stands there."""
    order = np.arange(int(bounds[-1]))
    for doc_id, b, e in zip(doc_ids, bounds[:-1].tolist(), bounds[1:].tolist()):
        tail = repeated_tail(doc_id, e - b)
        if tail:
            a, p = b + tail[0], tail[1]
            order[a:e] = a + np.arange(e - a) % p
    return order


def gram_gaps(number: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each place the distance to the nearest place of the same text where the same GRAM words begin, or _FAR."""
    n = len(number)
    near = np.full(n, _FAR)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    gram, width = mix(number.astype(np.uint64) + (owner.astype(np.uint64) << np.uint64(32)) + np.uint64(1)), 1
    while width < GRAM:
        gram = mix(gram[:-width] * np.uint64(0x9E3779B97F4A7C15) ^ gram[width:]) if len(gram) > width else gram[:0]
        width *= 2
    if not len(gram):
        return near
    places = np.flatnonzero(owner[: len(gram)] == owner[GRAM - 1 :])
    places = places[np.argsort(gram[places], kind="stable")]
    same = gram[places[1:]] == gram[places[:-1]]
    here, there = places[:-1][same], places[1:][same]
    near[here] = there - here
    near[there] = np.minimum(near[there], there - here)
    return near


def stretches(near: np.ndarray, bounds: np.ndarray, least: int, periods: int):
    """(first word, end) of the stretches that can hold a run."""
    n = len(near)
    opens = np.zeros(n + 1, bool)
    opens[bounds] = True
    first = end = np.zeros(0, np.int64)
    places = np.flatnonzero(near < _FAR)
    while places.size:
        cover = np.zeros(n + 1, np.int32)
        np.add.at(cover, places, 1)
        np.subtract.at(cover, places + GRAM, 1)
        covered = np.cumsum(cover[:-1]) > 0
        edge = covered.copy()
        edge[1:] &= ~covered[:-1] | opens[1:n]
        first = np.flatnonzero(edge)
        last = covered.copy()
        last[:-1] &= ~covered[1:] | opens[1:n]
        end = np.flatnonzero(last) + 1
        room = end - first
        room[room < least] = 0
        own = np.searchsorted(first, places, "right") - 1
        kept = places[near[places] * periods <= room[own]]
        if len(kept) == len(places):
            break
        places = kept
        first = end = np.zeros(0, np.int64)
    return first, end


def runs_of_slice(number: np.ndarray, bounds: np.ndarray, least: int, periods: int) -> dict[int, list]:
    """Text number to its runs, for the texts that have any."""
    found: dict[int, list] = {}
    first, end = stretches(gram_gaps(number, bounds), bounds, least, periods)
    owner = np.searchsorted(bounds, first, "right") - 1
    for a, b, k in zip(first.tolist(), end.tolist(), owner.tolist()):
        runs = periodic_runs(number[a:b].tolist(), least, periods)
        if runs:
            at = a - int(bounds[k])
            found.setdefault(k, []).extend((s + at, size, q) for s, size, q in runs)
    return found


def kept_words(runs: list, n: int) -> np.ndarray:
    """Which of n words stay: all that no run holds behind its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, size, q in runs:
        change[start + q] += 1
        change[start + size] -= 1
    return np.cumsum(change[:-1]) == 0


def find_runs(documents: DataFrame, tails: bool = False, least: int = MIN_LENGTH, periods: int = MIN_PERIODS) -> DataFrame:
    """doc_id, n_words, runs by start and period, collapsed text (the words that stay, one space between) of every document row.
    With `tails`, one document in ten has its last words repeated first (repeated_tail). `periods` is at least 3 and
    `least` at least 24."""
    if periods < MIN_PERIODS or least < MIN_LENGTH:
        raise ValueError("runs of fewer than 24 words or 3 periods need not repeat 16 words")

    def found(batches):
        for batch in batches:
            for i, j, buffer, starts in text_slices(batch, "text"):
                flat, first, length, bounds = spaced_words(buffer, starts)
                number, _ = word_numbers(flat, first, length)
                ids = batch.column(0).slice(i, j - i)
                order = tail_order(ids.to_pylist(), bounds) if tails else np.arange(len(number))
                runs = runs_of_slice(number[order], bounds, least, periods)
                collapsed, sizes, rows = [], np.zeros(j - i, np.int64), []
                for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    own = order[a:b]
                    if k in runs:
                        rows += runs[k]
                        sizes[k] = len(runs[k])
                        own = own[kept_words(runs[k], b - a)]
                    if k not in runs and (b == a or own[-1] == b - 1 and (own == np.arange(a, b)).all()):
                        text = flat[first[a] : first[b - 1] + length[b - 1]] if b > a else flat[:0]
                    else:
                        text = flat[ranges(first[own], length[own] + 1)][:-1]
                    collapsed.append(text.tobytes())
                columns = np.array(rows, np.int64).reshape(-1, 3)
                structs = pa.StructArray.from_arrays([pa.array(c) for c in columns.T.copy()], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), structs)
                texts = pa.array(collapsed, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(bounds)), lists, texts], ["doc_id", "n_words", "runs", "collapsed"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(found, FOUND)


def runs_digest(found: DataFrame) -> DataFrame:
    """One row per document: number of runs, the run with the greatest length over period, hashes of the runs and the text."""
    none = F.expr("cast(null as struct<start:long,length:long,period:long>)")
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.aggregate("runs", none, lambda best, r: F.when(better(best, r), r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.concat_ws("", F.transform(lines, lambda line: F.concat(line, F.lit("\n"))))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best.alias("best"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    ).select(
        "doc_id",
        "n_runs",
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
