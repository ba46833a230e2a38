"""Token ids by chunks that a byte-level tokenizer never joins, each distinct chunk encoded once.

Such a tokenizer first parts a text into runs of letters, of digits, of other signs and of white space, a single space
going with the run behind it, and never joins ids across two of these. A chunk here begins only where such a run must begin
whatever stands around it: at white space behind a sign that is none, behind a single tab or line break, at a change
between letters, ASCII digits and marks (not behind an apostrophe, which can begin a contraction). So a text's ids are its chunks' ids in order. Texts with a special token are
encoded whole.

A slice's chunks are told apart by a 64-bit hash and then by their bytes; those not yet held are encoded. Holds at most CACHED
chunks of at most CACHED_BYTES bytes each; when these no longer serve most of a slice, they give way to others.
"""

from itertools import repeat

import numpy as np

from groundwell.llm.arrays import LANE_MASK, hash_words, lanes, ranges

CACHED = 400_000
CACHED_BYTES = 64
JOINED = 1000

_SPACE, _BREAK, _LETTER, _DIGIT, _MARK, _APOSTROPHE, _OTHER = range(7)
KIND = np.full(256, _OTHER, np.uint8)
KIND[0x21:0x7F] = _MARK
KIND[0x20], KIND[9:14] = _SPACE, _BREAK
KIND[0x30:0x3A] = _DIGIT
KIND[0x41:0x5B] = KIND[0x61:0x7B] = _LETTER
KIND[0x27] = _APOSTROPHE

# STARTS[a, b]: a chunk begins at a byte of kind b behind one of kind a.
STARTS = np.zeros((7, 7), bool)
STARTS[[_LETTER, _DIGIT, _MARK, _APOSTROPHE], _SPACE] = True
STARTS[[_LETTER, _DIGIT, _MARK, _APOSTROPHE], _BREAK] = True
STARTS[_LETTER, [_DIGIT, _MARK, _APOSTROPHE]] = True
STARTS[_DIGIT, [_LETTER, _MARK, _APOSTROPHE]] = True
STARTS[_MARK, [_LETTER, _DIGIT]] = True


def chunk_starts(buffer: np.ndarray, starts: np.ndarray):
    """(places where chunks begin, bounds of the texts in them) of a slice; the separators are chunks of their own."""
    end = int(starts[-1])
    data = buffer[:end]
    kind = KIND[data]
    opens = np.zeros(end, bool)
    opens[1:] = STARTS[kind[:-1], kind[1:]]
    # white space behind the last byte of a character from U+00C0 to U+07FF or from U+4000 on: none of these is white space
    space = kind <= _BREAK
    for size, low, high in ((2, 0xC3, 0xDF), (3, 0xE4, 0xEF), (4, 0xF0, 0xF4)):
        if end > size:
            opens[size:] |= space[size:] & (data[:-size] >= low) & (data[:-size] <= high)
    # marks behind letters from U+00C0 to U+00FF
    latin = (data[:-2] == 0xC3) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7)
    opens[2:] |= latin & ((kind[2:] == _MARK) | (kind[2:] == _APOSTROPHE))
    # a single tab or line break: of several in a row the last may go apart
    opens[1:] |= opens[:-1] & (kind[:-1] == _BREAK) & (kind[1:] > _BREAK) & (kind[1:] < _OTHER)
    opens[0] = True
    opens[starts[:-1]] = True
    opens[starts[1:] - 1] = True
    places = np.flatnonzero(opens)
    return places, np.searchsorted(places, starts)


def equal_spans(a, a_first, a_length, b, b_first, b_length) -> np.ndarray:
    """Whether span k of buffer a and span k of buffer b are the same bytes."""
    left, right = lanes(a), lanes(b)
    same = a_length == b_length
    active, done = np.flatnonzero(same), 0
    while active.size:
        rest = a_length[active] - done
        mask = LANE_MASK[np.clip(rest, 0, 8)]
        equal = (left[a_first[active] + done] & mask) == (right[b_first[active] + done] & mask)
        same[active[~equal]] = False
        active, done = active[equal & (rest > 8)], done + 8
    return same


class ChunkEncoder:
    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special, self.special_number = [t.content.encode() for t in added.values()], next(iter(added), None)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() < 1 << 16 else np.uint32
        self.clear()

    def clear(self):
        self.slot: dict[int, int] = {}
        self.first, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)  # the chunks' ids
        self.at, self.length = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)  # the chunks' bytes
        self.ids, self.data = np.zeros(1 << 14, self.kind), np.zeros(1 << 16, np.uint8)
        self.ids_used = self.data_used = 0

    def encoded(self, texts: list[bytes]):
        """(ids side by side, how many of each)."""
        if not texts:
            return np.zeros(0, self.kind), np.zeros(0, np.int64)
        if not self.special or any(mark in t for t in texts for mark in self.special):
            found = [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
            return np.concatenate(found), np.array([len(x) for x in found], np.int64)
        # a thousand at a time with a special token behind each, which parts them before anything else does
        mark, number = self.special[0], self.special_number
        joined = [b"".join(t + mark for t in texts[k : k + JOINED]).decode() for k in range(0, len(texts), JOINED)]
        flat = np.concatenate([np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
        ends = np.flatnonzero(flat == number)
        return np.delete(flat, ends), np.diff(ends, prepend=-1) - 1

    def hold(self, names: list[int], buffer, first, length, ids, size):
        n, m, total = len(self.slot), len(names), int(length.sum())
        while n + m > len(self.first):
            self.first, self.size, self.at, self.length = (np.resize(x, 2 * len(x)) for x in (self.first, self.size, self.at, self.length))
        while self.ids_used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        while self.data_used + total + 8 > len(self.data):
            self.data = np.resize(self.data, 2 * len(self.data))
        self.ids[self.ids_used : self.ids_used + len(ids)] = ids
        self.data[self.data_used : self.data_used + total] = buffer[ranges(first, length)]
        self.first[n : n + m], self.size[n : n + m] = self.ids_used + np.cumsum(size) - size, size
        self.at[n : n + m], self.length[n : n + m] = self.data_used + np.cumsum(length) - length, length
        self.slot.update(zip(names, range(n, n + m)))
        self.ids_used += len(ids)
        self.data_used += total

    def slots(self, keys: list[int], buffer, at, size) -> np.ndarray:
        """The place of each distinct chunk among those held, which the new ones join as long as there is room; else -1."""
        slot = np.fromiter(map(self.slot.get, keys, repeat(-1)), np.int64, len(keys))
        known = np.flatnonzero(slot >= 0)
        held = slot[known]
        right = equal_spans(buffer, at[known], size[known], self.data, self.at[held], self.length[held])
        slot[known[~right]] = -2  # the hash of another chunk
        fresh = np.flatnonzero((slot == -1) & (size <= CACHED_BYTES))
        if len(self.slot) + len(fresh) > CACHED:
            if 2 * len(fresh) < len(keys):
                return slot  # what is held still serves most
            self.clear()
            slot[:] = -1
            fresh = np.flatnonzero(size <= CACHED_BYTES)[:CACHED]
        n = len(self.slot)
        texts = [buffer[a : a + m].tobytes() for a, m in zip(at[fresh].tolist(), size[fresh].tolist())]
        self.hold([keys[k] for k in fresh.tolist()], buffer, at[fresh], size[fresh], *self.encoded(texts))
        slot[fresh] = np.arange(n, n + len(fresh))
        return slot

    def slice_ids(self, buffer: np.ndarray, starts: np.ndarray):
        """(ids of all texts of a slice side by side, the texts' bounds in them)."""
        places, bounds = chunk_starts(buffer, starts)
        # without the separators in front of the texts
        inner = np.ones(len(places), bool)
        inner[np.searchsorted(places, starts - 1)] = False
        length = np.diff(np.append(places, int(starts[-1])))[inner]
        places = places[inner]
        bounds = np.searchsorted(places, starts)
        names, one, number = np.unique(hash_words(buffer, places, length), return_index=True, return_inverse=True)
        at, size = places[one], length[one]  # the distinct chunks
        slot = self.slots(names.tolist(), buffer, at, size)
        # ids of the distinct chunks, those not held behind those that are
        loose = np.flatnonzero(slot < 0)
        held = np.maximum(slot, 0)
        first, ids_of = self.first[held], self.size[held]
        extra, own = self.encoded([buffer[a : a + n].tobytes() for a, n in zip(at[loose].tolist(), size[loose].tolist())])
        first[loose], ids_of[loose] = self.ids_used + np.cumsum(own) - own, own
        ids = np.concatenate((self.ids[: self.ids_used], extra)) if loose.size else self.ids
        first, size = first[number], ids_of[number]
        same = equal_spans(buffer, places, length, buffer, at[number], length[one][number])
        apart = np.flatnonzero(~same)
        if apart.size:  # other chunks of one hash
            more, own = self.encoded([buffer[a : a + n].tobytes() for a, n in zip(places[apart].tolist(), length[apart].tolist())])
            first[apart], size[apart] = len(ids) + np.cumsum(own) - own, own
            ids = np.concatenate((ids, more))
        out = ids[ranges(first, size)]
        ends = np.concatenate(([0], np.cumsum(size)))[bounds]
        if any(mark in buffer.tobytes() for mark in self.special):
            return self.with_special(buffer, starts, out, ends)
        return out, ends

    def with_special(self, buffer, starts, ids, ends):
        """As slice_ids, with the texts that hold a special token encoded whole."""
        parts = []
        for k, (a, b) in enumerate(zip(starts[:-1].tolist(), (starts[1:] - 1).tolist())):
            text = buffer[a:b].tobytes()
            whole = any(mark in text for mark in self.special)
            parts.append(self.encoded([text])[0] if whole else ids[ends[k] : ends[k + 1]])
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


_ENCODERS: dict[str, ChunkEncoder] = {}


def chunk_encoder(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]
