"""Text columns as byte arrays: slices of bounded size, words, hashes, varints.

Arrow batches reach Python as whole columns. Every function here works on a slice of a few
megabytes, so a task holds one slice and its index arrays whatever the size of a partition; a
single text longer than a slice is a slice of its own.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
PAD = 40

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False

# Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]: digits, small letters and all of a non-ASCII character.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[48:58] = WORD_BYTES[97:123] = WORD_BYTES[128:] = True

# The first k bytes of a little-endian lane.
LANE_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_S33 = np.uint64(33)

# The lower of each two neighbours of 8, 16 or 32 bits.
_LOW_HALVES = {1: np.uint64(0x00FF00FF00FF00FF), 2: np.uint64(0x0000FFFF0000FFFF), 4: np.uint64(0x00000000FFFFFFFF)}


def text_slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES):
    """Yields (first row, last row + 1, buffer, starts) for runs of rows of at most `most` bytes.

    The buffer holds the rows' UTF-8 texts, a newline before, between and after them, and PAD
    zero bytes; text k is buffer[starts[k]:starts[k + 1] - 1]. Null counts as empty.
    """
    texts = batch.column(batch.schema.get_field_index(column))
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if len(texts) == 0:
        return
    _, raw_offsets, raw = texts.buffers()
    offsets = np.frombuffer(raw_offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        sizes = np.diff(offsets[i : j + 1])
        starts = np.concatenate(([1], 1 + np.cumsum(sizes + 1)))
        buffer = np.zeros(int(starts[-1]) + PAD, np.uint8)
        buffer[0] = 10
        buffer[starts[1:] - 1] = 10
        for k, (at, end) in enumerate(zip(offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist())):
            buffer[starts[k] : starts[k] + end - at] = data[at:end]
        yield i, j, buffer, starts
        i = j


def words_in(buffer: np.ndarray, end: int, word_bytes: np.ndarray):
    """Starts and lengths of the maximal runs of word bytes in buffer[:end]."""
    inside = word_bytes[buffer[:end]]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    return edges[0::2], edges[1::2] - edges[0::2]


def flat_words(buffer: np.ndarray, starts: np.ndarray, word_bytes: np.ndarray):
    """(flat, first, length, bounds): the slice in lower case with one space before, between and behind
    its words and PAD zero bytes, the words' places in it, and for text k its words bounds[k] to
    bounds[k + 1]."""
    low = LOWER[buffer[: int(starts[-1])]]
    inside = word_bytes[low]
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    kept = low[keep]
    kept[~inside[keep]] = 32
    flat = np.concatenate((np.full(1, 32, np.uint8), kept, np.zeros(PAD, np.uint8)))
    first, length = words_in(flat, len(kept) + 1, word_bytes)
    return flat, first, length, np.searchsorted(first, np.concatenate(([0], np.cumsum(keep)))[starts] + 1)


def lanes(buffer: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one little-endian number."""
    return np.ndarray(len(buffer) - 7, "<u8", buffer, strides=(1,))


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _S33)
    x *= _M1
    x ^= x >> _S33
    x *= _M2
    x ^= x >> _S33
    return x


def hash_words(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes a step."""
    view = lanes(buffer)
    h = mix((view[starts] & LANE_MASK[np.minimum(lengths, 8)]) ^ (lengths.astype(np.uint64) + np.uint64(seed)) * _SPREAD)
    active = np.flatnonzero(lengths > 8)
    done = 8
    while active.size:
        left = lengths[active] - done
        lane = view[starts[active] + done] & LANE_MASK[np.minimum(left, 8)]
        h[active] = mix(h[active] * _M2 ^ lane)
        active, done = active[left > 8], done + 8
    return h


def equal_words(buffer, starts, lengths, a, b) -> np.ndarray:
    """Whether words a[i] and b[i] are the same bytes."""
    view = lanes(buffer)
    same = lengths[a] == lengths[b]
    active, done = np.flatnonzero(same), 0
    while active.size:
        left = lengths[a[active]] - done
        mask = LANE_MASK[np.clip(left, 0, 8)]
        equal = (view[starts[a[active]] + done] & mask) == (view[starts[b[active]] + done] & mask)
        same[active[~equal]] = False
        active, done = active[equal & (left > 8)], done + 8
    return same


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then those from starts[1] on, and so forth."""
    total = int(counts.sum())
    first = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(starts - first, counts)


def pack_varints(values: np.ndarray) -> bytes:
    """Non-negative integers, seven bits a byte, the last byte of each below 128."""
    rest = values.astype(np.uint64)
    own = np.flatnonzero(rest > np.uint64(127))
    if not own.size:
        return rest.astype(np.uint8).tobytes()
    size, longer, high = np.ones(len(rest), np.int64), own, rest[own] >> np.uint64(7)
    while longer.size:
        size[longer] += 1
        more = high > np.uint64(127)
        longer, high = longer[more], high[more] >> np.uint64(7)
    at = np.cumsum(size) - size
    out = np.zeros(int(at[-1] + size[-1]), np.uint8)
    out[at] = (rest & np.uint64(127)).astype(np.uint8) | (size > 1).view(np.uint8) << np.uint8(7)
    at, rest = at[own] + 1, rest[own] >> np.uint64(7)
    while at.size:
        more = rest > np.uint64(127)
        out[at] = (rest & np.uint64(127)).astype(np.uint8) | more.view(np.uint8) << np.uint8(7)
        at, rest = at[more] + 1, rest[more] >> np.uint64(7)
    return out.tobytes()


def unpack_varints(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(data < 128)
    if len(ends) == len(data):
        return data.astype(np.uint64)
    at = np.concatenate(([0], ends[:-1] + 1)).astype(np.int64) if ends.size else ends
    size = ends - at + 1
    # eight bytes at once, whose groups of seven bits are moved together in pairs
    out = lanes(np.concatenate((data, np.zeros(8, np.uint8))))[at]
    out &= LANE_MASK[np.minimum(size, 8)]
    out &= np.uint64(0x7F7F7F7F7F7F7F7F)
    for gap, half in _LOW_HALVES.items():
        low = out & half
        out ^= low
        out >>= np.uint64(gap)
        out |= low
    for k in range(8, int(size.max(initial=0))):
        own = np.flatnonzero(size > k)
        out[own] |= (data[at[own] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    return out


def binary(parts: list) -> pa.Array:
    return pa.array(parts, pa.binary())
