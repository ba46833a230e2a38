"""Monotone integer sequences in Elias-Fano form, with vectorised access and successor search."""

import numpy as np

# Searches at a time, so that what they work on stays in the cores' caches.
BLOCK = 1 << 14


def _bits(value: int) -> int:
    return max(0, int(value).bit_length())


class EliasFano:
    """n non-decreasing numbers below `universe`: the low bits of each side by side, the high parts as
    a bit set at place high + i for number i. One flat buffer, so that a level can be memory-mapped
    or read from a table as it is; only the places of the high bits, and how many numbers lie up to each
    high part, are spread out on opening. A search looks among the numbers of one high part only."""

    def __init__(self, raw):
        data = np.frombuffer(raw, np.uint8) if not isinstance(raw, np.ndarray) else raw
        self.n, self.width, high = (int(x) for x in data[:24].view("<i8"))
        low_bytes = (self.n * self.width + 7) // 8 + 8
        low = data[24 : 24 + low_bytes]
        self.lanes = np.ndarray(max(1, len(low) - 7), "<u8", np.ascontiguousarray(low), strides=(1,))
        bits = np.unpackbits(data[24 + low_bytes : 24 + low_bytes + high], bitorder="little")
        kind = np.int32 if len(bits) < 1 << 31 else np.int64
        self.places = np.flatnonzero(bits).astype(kind)
        # a clear bit ends each high part: the numbers up to it are the bits set before
        clear = np.flatnonzero(bits == 0)
        self.upto = np.empty(len(clear) + 2, kind)
        self.upto[0], self.upto[-1] = 0, self.n
        self.upto[1:-1] = clear - np.arange(len(clear))
        self.mask = np.uint64((1 << self.width) - 1)

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> bytes:
        n = len(values)
        width = min(56, max(0, _bits(universe // max(1, n)) - 1))
        values = values.astype(np.uint64)
        low = np.zeros((n * width + 7) // 8 + 8, np.uint8)
        if n and width:
            size = (width + 7) // 8
            places = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(n, 8)[:, :size].ravel(), bitorder="little")
            packed = np.packbits(places.reshape(n, 8 * size)[:, :width].ravel(), bitorder="little")
            low[: len(packed)] = packed
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        high = np.packbits(high, bitorder="little")
        return np.array([n, width, len(high)], "<i8").tobytes() + low.tobytes() + high.tobytes()

    def at(self, i: np.ndarray) -> np.ndarray:
        bit = i * self.width
        low = (self.lanes[bit >> 3] >> (bit & 7).astype(np.uint64)) & self.mask
        return (((self.places[i] - i).astype(np.uint64) << np.uint64(self.width)) | low).astype(np.int64)

    def successor(self, first: np.ndarray, last: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """In each range [first, last) the first place whose number is at least `wanted`, else last."""
        found = np.empty(len(wanted), np.int64)
        for i in range(0, len(wanted), BLOCK):
            found[i : i + BLOCK] = self._successor(first[i : i + BLOCK], last[i : i + BLOCK], wanted[i : i + BLOCK])
        return found

    def _successor(self, first, last, wanted):
        part = np.minimum(np.maximum(wanted, 0) >> self.width, len(self.upto) - 2)
        low = np.minimum(np.maximum(first, self.upto[part]), last)
        high = np.maximum(np.minimum(last, self.upto[part + 1]), low)
        live = np.flatnonzero(low < high)
        while live.size:
            middle = (low[live] + high[live]) >> 1
            less = self.at(middle) < wanted[live]
            low[live[less]] = middle[less] + 1
            high[live[~less]] = middle[~less]
            live = live[low[live] < high[live]]
        return low
