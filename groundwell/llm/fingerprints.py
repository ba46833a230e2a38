"""SimHash fingerprints of word shingles."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwell.llm.arrays import LANE_MASK, NOT_SPACE, flat_words, lanes, text_slices

SHINGLE_WORDS = 3

# Fixed values of XXH64.
P1 = np.uint64(0x9E3779B185EBCA87)
P2 = np.uint64(0xC2B2AE3D27D4EB4F)
P3 = np.uint64(0x165667B19E3779F9)
P4 = np.uint64(0x85EBCA77C2B2AE63)
P5 = np.uint64(0x27D4EB2F165667C5)
SEED = np.uint64(42)


def _turn(x, k):
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def xxh64(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """XXH64 with seed 42 of buffer[start:start + length] for many spans at once; the buffer has
    eight spare bytes behind the last span."""
    with np.errstate(over="ignore"):
        view = lanes(buffer)
        h = np.full(len(starts), SEED + P5, np.uint64)
        at = starts.astype(np.int64)
        end = at + lengths
        long = np.flatnonzero(lengths >= 32)
        if long.size:
            first = np.array([SEED + P1 + P2, SEED + P2, SEED, SEED - P1], np.uint64)
            sums = np.tile(first, (long.size, 1))
            live = np.arange(long.size)
            while live.size:
                own = at[long[live]]
                for k in range(4):
                    sums[live, k] = _turn(sums[live, k] + view[own + 8 * k] * P2, 31) * P1
                at[long[live]] += 32
                live = live[end[long[live]] - at[long[live]] >= 32]
            total = _turn(sums[:, 0], 1) + _turn(sums[:, 1], 7) + _turn(sums[:, 2], 12) + _turn(sums[:, 3], 18)
            for k in range(4):
                total = (total ^ (_turn(sums[:, k] * P2, 31) * P1)) * P1 + P4
            h[long] = total
        h += lengths.astype(np.uint64)
        live = np.flatnonzero(end - at >= 8)
        while live.size:
            lane = _turn(view[at[live]] * P2, 31) * P1
            h[live] = _turn(h[live] ^ lane, 27) * P1 + P4
            at[live] += 8
            live = live[end[live] - at[live] >= 8]
        live = np.flatnonzero(end - at >= 4)
        lane = (view[at[live]] & LANE_MASK[4]) * P1
        h[live] = _turn(h[live] ^ lane, 23) * P2 + P3
        at[live] += 4
        live = np.flatnonzero(end > at)
        while live.size:
            h[live] = _turn(h[live] ^ (buffer[at[live]].astype(np.uint64) * P5), 11) * P1
            at[live] += 1
            live = live[end[live] > at[live]]
        h ^= h >> np.uint64(33)
        h *= P2
        h ^= h >> np.uint64(29)
        h *= P3
        h ^= h >> np.uint64(32)
        return h


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For groups of counts[k] consecutive hashes the bits set in over half of them; none: zero."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not some.size:
        return out
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    first = (np.cumsum(counts) - counts)[some]
    tally = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    majority = 2 * tally > counts[some][:, None]
    out[some] = np.packbits(majority, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def slice_fingerprints(buffer: np.ndarray, starts: np.ndarray, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Fingerprints of the texts of one slice."""
    flat, at, length, bounds = flat_words(buffer, starts, NOT_SPACE)
    n_words = np.diff(bounds)
    counts = np.where(n_words > 0, np.maximum(n_words - words + 1, 1), 0)
    first = np.repeat(bounds[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    last = first + np.repeat(np.minimum(n_words, words), counts) - 1
    return majority_bits(xxh64(flat, at[first], at[last] + length[last] - at[first]), counts)


def fingerprints(documents: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """uid, doc_id and the fingerprint as a signed long of every document row; null text has none
    of the words and so, like any text without words, fingerprint zero."""

    def hashed(batches):
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            for i, j, buffer, starts in text_slices(batch, "text"):
                found = slice_fingerprints(buffer, starts, words).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(uid, uid + j - i)), batch.column(0).slice(i, j - i), pa.array(found)], ["uid", "doc_id", "fp"]
                )
                uid += j - i

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(hashed, "uid long, doc_id long, fp long")
