"""Hashed word features of texts: runs of one and two words, each with the CRC-32 of its bytes as bucket.

The distinct features of a slice are grouped by length. Those of one length form a uint8 matrix, a row for
each byte place, and the CRCs of all of them advance one place a step; the buckets go back to the
features' places and from there to every occurrence. Features of more than LONG bytes are taken one by one by
zlib, so that a single huge word is not a matrix of one column.
"""

import zlib

import numpy as np
import pyarrow as pa

from groundwell.llm.arrays import WORD_BYTES, equal_words, flat_words, hash_words, text_slices

LONG = 256
MATRIX_BYTES = 1 << 20
POLYNOMIAL = np.uint32(0xEDB88320)


def byte_table() -> np.ndarray:
    """What each byte does to a CRC, from the polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), POLYNOMIAL, np.uint32(0))
    return table


TABLE = byte_table()


def crc_of_spans(buffer: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRC-32 of buffer[first[k] : first[k] + length[k]] for each k."""
    out = np.zeros(len(first), np.uint32)
    order = np.argsort(length, kind="stable")
    sizes, begin = np.unique(length[order], return_index=True)
    for size, rows in zip(sizes.tolist(), np.split(order, begin[1:])):
        if size > LONG:
            out[rows] = [zlib.crc32(buffer[a : a + size]) for a in first[rows].tolist()]
            continue
        step = max(1, MATRIX_BYTES // max(1, size))
        for k in range(0, len(rows), step):
            own = rows[k : k + step]
            matrix = buffer[first[own] + np.arange(size)[:, None]]
            crc = np.full(len(own), 0xFFFFFFFF, np.uint32)
            for column in matrix:
                crc = TABLE[(crc ^ column) & np.uint32(255)] ^ (crc >> np.uint32(8))
            out[own] = ~crc
    return out


def word_numbers(flat: np.ndarray, first: np.ndarray, length: np.ndarray):
    """(number of each word, place of each number's first word); equal numbers are equal bytes."""
    _, place, number = np.unique(hash_words(flat, first, length), return_index=True, return_inverse=True)
    apart = np.flatnonzero(~equal_words(flat, first, length, np.arange(len(first)), place[number]))
    if apart.size:  # two words of one hash
        own: dict[bytes, int] = {}
        for k in apart.tolist():
            word = flat[first[k] : first[k] + length[k]].tobytes()
            if word not in own:
                own[word] = len(place) + len(own)
            number[k] = own[word]
        place = np.append(place, [apart[number[apart] == n][0] for n in own.values()])
    return number, place


def slice_buckets(buffer: np.ndarray, starts: np.ndarray, buckets: int):
    """(words of each text, buckets of the single words, their texts' bounds, buckets of the pairs, their bounds)."""
    flat, first, length, bounds = flat_words(buffer, starts, WORD_BYTES)
    number, place = word_numbers(flat, first, length)
    n_words = np.diff(bounds)
    opens = np.ones(len(first) + 1, bool)
    opens[bounds[:-1][n_words > 0]] = False
    second = np.flatnonzero(opens[: len(first)])  # words with a word of the same text before them
    keys = number[second - 1] * np.int64(len(place)) + number[second]
    _, at, pair = np.unique(keys, return_index=True, return_inverse=True)
    head = second[at] - 1
    spans = np.concatenate((first[place], first[head]))
    sizes = np.concatenate((length[place], first[head + 1] + length[head + 1] - first[head]))
    found = (crc_of_spans(flat, spans, sizes) % np.uint32(buckets)).astype(np.uint32)
    pair_bounds = np.concatenate(([0], np.cumsum(np.maximum(n_words - 1, 0))))
    return n_words, found[: len(place)][number], bounds, found[len(place) :][pair], pair_bounds


FEATURES = "doc_id long, n_words long, n_features long, buckets binary"


def number_type(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def feature_rows(batches, buckets: int):
    """Of (doc_id, text): the words, the features and their buckets as little-endian numbers, single words first."""
    kind = number_type(buckets)
    for batch in batches:
        for i, j, buffer, starts in text_slices(batch, "text"):
            n_words, words, bounds, pairs, pair_bounds = slice_buckets(buffer, starts, buckets)
            words, pairs = words.astype(kind), pairs.astype(kind)
            raw = [
                words[a:b].tobytes() + pairs[c:d].tobytes()
                for a, b, c, d in zip(bounds[:-1].tolist(), bounds[1:].tolist(), pair_bounds[:-1].tolist(), pair_bounds[1:].tolist())
            ]
            columns = [batch.column(0).slice(i, j - i), pa.array(n_words), pa.array(n_words + np.maximum(n_words - 1, 0)), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "buckets"])


def bucket_lists(batch: pa.RecordBatch, buckets: int):
    """(all buckets of a batch of feature rows, the rows' bounds in them)."""
    column = batch.column(batch.schema.get_field_index("buckets")).cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    kind = np.dtype(number_type(buckets))
    held = data.slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes() if data is not None else b""
    return np.frombuffer(held, kind), (ends - ends[0]) // kind.itemsize


def bucket_totals(batches, buckets: int):
    """Counts of the buckets over a task's feature rows."""
    total = np.zeros(buckets, np.int64)
    for batch in batches:
        total += np.bincount(bucket_lists(batch, buckets)[0], minlength=buckets)
    own = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["bucket", "n"])
