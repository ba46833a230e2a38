"""Packing of tokenised documents by shortest-pack-first over the length histogram.

Documents longer than a sequence are cut into full sequences and a rest. The histogram of piece
lengths (at most one row per length up to the limit) goes to the driver, where lengths are placed
longest first: each into the packs with the most room, as counts of equal packs and not pack
by pack, so the work depends on the number of lengths and not of documents. When nothing is open
that a length fits, new packs take as many pieces of it as fit. Where the packs so made leave
more than MOST_PADDING unused, the emptiest packs are given up and their pieces cut to fill the
room left in the others. The plan is a list of rank ranges per length; pieces get ranks within
their length, dealt and counted in slices, and find their sequence and offset by rank.

Defined results: null text is empty; every document has at least its end token, so an empty one is a piece of
one token; repeated rows are packed each; an empty table gives no rows.
"""

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwell.llm.arrays import NOT_SPACE, hash_words, ranges, text_slices, words_in
from groundwell.llm.chunk_encoder import equal_spans
from groundwell.llm.ranks import slices_for, with_group_ranks
from groundwell.session import staged

SEQUENCE = 4096
END_TOKEN = 2
MOST_PADDING = 0.002
CACHED_WORDS = 1_200_000
CACHED_BYTES = 64

PIECES = "uid long, piece int, doc_id long, start long, length int, doc_tokens long, ids binary"
PACKED = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"

_ENCODERS: dict[str, "Encoder"] = {}


# ASCII letters, and marks that a pre-tokenizer parts from a letter before them. Marks that occur in
# special tokens or contractions are not among them.
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?#$%&*)"]] = True
_LATIN = np.zeros(256, bool)  # second bytes of letters behind 0xC3
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False

SEPARATOR = "\x01"


def parted(buffer: np.ndarray):
    """(buffer, places): a space between each letter and a mark behind it, and where each byte went."""
    letter = _LETTER[buffer]
    letter[1:] |= _LATIN[buffer[1:]] & (buffer[:-1] == 0xC3)
    cut = np.zeros(len(buffer), bool)
    cut[1:] = letter[:-1] & _MARK[buffer[1:]]
    places = np.arange(len(buffer)) + np.cumsum(cut)
    out = np.full(int(places[-1]) + 1, 32, np.uint8)
    out[places] = buffer
    return out, places


class Encoder:
    """Token ids by words between ASCII white space, each distinct word encoded once.

    For tokenizers that drop white space and never join tokens across it, so that a text's ids are its
    words' ids in order. New words are encoded a thousand at a time, parted by a separator. Holds at most
    CACHED_WORDS words of at most CACHED_BYTES bytes, or those of one slice where it has more, in flat arrays: an
    open-addressed table of 64-bit hashes, and the words' bytes, which are compared.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.separator = self.tokenizer.encode(SEPARATOR, add_special_tokens=False).ids
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() < 1 << 16 else np.uint32
        self.clear()

    def clear(self):
        self.table = np.full(1 << 13, -1, np.int32)  # hash -> number of a word, at most half full
        self.names = np.zeros(1 << 12, np.uint64)
        self.first, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)  # the words' ids
        self.at, self.length = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)  # the words' bytes
        self.ids, self.data = np.zeros(1 << 14, self.kind), np.zeros(1 << 16, np.uint8)
        self.held = self.ids_used = self.data_used = 0

    def lists(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of words, none of which has the separator's character."""
        if len(self.separator) != 1:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            return np.array([t for x in found for t in x], np.int64), np.array([len(x) for x in found], np.int64)
        joined = [f" {SEPARATOR} ".join(words[k : k + 1000]) for k in range(0, len(words), 1000)]
        found = self.tokenizer.encode_batch_fast([f"{x} {SEPARATOR}" for x in joined], add_special_tokens=False)
        flat = np.concatenate([np.array(e.ids, np.int64) for e in found])
        ends = np.flatnonzero(flat == self.separator[0])
        return np.delete(flat, ends), np.diff(ends, prepend=-1) - 1

    def encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids side by side, how many of each word)."""
        marked = [k for k, w in enumerate(words) if b"\x01" in w]
        if not marked:
            return self.lists([w.decode() for w in words]) if words else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        found = [None] * len(words)
        for k in marked:
            found[k] = np.array(self.tokenizer.encode(words[k].decode(), add_special_tokens=False).ids, np.int64)
        plain = [k for k, x in enumerate(found) if x is None]
        flat, size = self.encoded([words[k] for k in plain])
        for k, ids in zip(plain, np.split(flat, np.cumsum(size)[:-1])):
            found[k] = ids
        return np.concatenate(found), np.array([len(x) for x in found], np.int64)

    def find(self, names: np.ndarray) -> np.ndarray:
        """The number of the word held under each hash, -1 where there is none."""
        mask = np.uint64(len(self.table) - 1)
        place, found = (names & mask).astype(np.int64), np.full(len(names), -1, np.int64)
        active = np.arange(len(names))
        while active.size:
            held = self.table[place[active]]
            taken = held >= 0
            active, held = active[taken], held[taken]
            same = self.names[held] == names[active]
            found[active[same]] = held[same]
            active = active[~same]
            place[active] = (place[active] + 1) & int(mask)
        return found

    def enter(self, numbers: np.ndarray):
        """Puts words into the table, each at the first free place from its hash on."""
        mask = len(self.table) - 1
        place = (self.names[numbers] & np.uint64(mask)).astype(np.int64)
        while numbers.size:
            free = self.table[place] < 0
            self.table[place[free]] = numbers[free]
            left = self.table[place] != numbers
            numbers, place = numbers[left], (place[left] + 1) & mask

    def hold(self, names, buffer, at, length, ids, size):
        n, m, total = self.held, len(names), int(length.sum())
        while n + m > len(self.names):
            self.names, self.first, self.size, self.at, self.length = (
                np.resize(x, 2 * len(x)) for x in (self.names, self.first, self.size, self.at, self.length)
            )
        while self.ids_used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        while self.data_used + total + 8 > len(self.data):
            self.data = np.resize(self.data, 2 * len(self.data))
        self.names[n : n + m] = names
        self.ids[self.ids_used : self.ids_used + len(ids)] = ids
        self.data[self.data_used : self.data_used + total] = buffer[ranges(at, length)]
        self.first[n : n + m], self.size[n : n + m] = self.ids_used + np.cumsum(size) - size, size
        self.at[n : n + m], self.length[n : n + m] = self.data_used + np.cumsum(length) - length, length
        self.held, self.ids_used, self.data_used = n + m, self.ids_used + len(ids), self.data_used + total
        if 2 * self.held > len(self.table):
            while 2 * self.held > len(self.table):
                self.table = np.full(2 * len(self.table), -1, np.int32)
            self.enter(np.arange(self.held))
        else:
            self.enter(np.arange(n, n + m))

    def slots(self, buffer: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The number of each word, which new ones get here; -2 for words too long to be held and others of one hash."""
        names = hash_words(buffer, at, length)
        slot = self.find(names)
        known = np.flatnonzero(slot >= 0)
        held = slot[known]
        right = equal_spans(buffer, at[known], length[known], self.data, self.at[held], self.length[held].astype(np.int64))
        slot[known[~right]] = -2
        slot[length > CACHED_BYTES] = -2
        missed = np.flatnonzero(slot == -1)
        if not missed.size:
            return slot
        new, one, number = np.unique(names[missed], return_index=True, return_inverse=True)
        one = missed[one]
        if self.held and self.held + len(new) > CACHED_WORDS:
            self.clear()
            return self.slots(buffer, at, length)
        same = equal_spans(buffer, at[missed], length[missed], buffer, at[one][number], length[one][number])
        words = [buffer[a : a + n].tobytes() for a, n in zip(at[one].tolist(), length[one].tolist())]
        slot[missed] = np.where(same, self.held + number, -2)
        self.hold(new, buffer, at[one], length[one], *self.encoded(words))
        return slot

    def encode(self, buffer: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a slice side by side, the texts' bounds in them)."""
        at, length = words_in(buffer, int(starts[-1]), NOT_SPACE)
        slot = self.slots(buffer, at, length)
        loose = np.flatnonzero(slot < 0)
        slot[loose] = 0
        first, size, ids = self.first[slot], self.size[slot].astype(np.int64), self.ids
        if loose.size:
            words = [buffer[a : a + n].tobytes() for a, n in zip(at[loose].tolist(), length[loose].tolist())]
            number = {w: k for k, w in enumerate(dict.fromkeys(words))}
            extra, own = self.encoded(list(number))
            place = np.array([number[w] for w in words])
            first[loose], size[loose] = (self.ids_used + np.cumsum(own) - own)[place], own[place]
            ids = np.concatenate((self.ids[: self.ids_used], extra.astype(self.kind)))
        ends = np.concatenate(([0], np.cumsum(size)))[np.searchsorted(at, starts)]
        return ids[ranges(first, size)], ends


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def token_pieces(documents: DataFrame, tokenizer: str, limit: int = SEQUENCE) -> DataFrame:
    """Pieces of at most `limit` ids of every document row; the ids in 16 bits where the vocabulary
    allows, else in 32, little-endian."""

    def cut(batches):
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 33
        own = encoder(tokenizer)
        for batch in batches:
            for i, j, buffer, starts in text_slices(batch, "text", 1 << 20):
                spaced, places = parted(buffer)
                flat, ends = own.encode(spaced, places[starts])
                rows = []
                for k, doc_id in enumerate(batch.column(0).slice(i, j - i).to_pylist()):
                    ids = np.append(flat[ends[k] : ends[k + 1]], flat.dtype.type(END_TOKEN))
                    for piece, start in enumerate(range(0, len(ids), limit)):
                        part = ids[start : start + limit]
                        rows.append((uid, piece, doc_id, start, len(part), len(ids), part.tobytes()))
                    uid += 1
                names = ["uid", "piece", "doc_id", "start", "length", "doc_tokens", "ids"]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECES)


def place_lengths(histogram: dict[int, int], limit: int) -> list[tuple[int, tuple]]:
    """(number of packs, ((length, pieces of it), ...)) for all pieces, longest lengths first."""
    room: dict[int, list] = {}  # free tokens -> open packs of that much room, as (packs, contents)
    sizes: list[int] = []  # the free amounts that occur, ascending

    def put(free, packs, contents):
        if free not in room:
            room[free] = []
            bisect.insort(sizes, free)
        room[free].append((packs, contents))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if sizes and sizes[-1] >= length:
                free = sizes[-1]
                packs, contents = room[free].pop()
                if not room[free]:
                    del room[free]
                    sizes.pop()
                used = min(packs, left)
                if used < packs:
                    put(free, packs - used, contents)
                last = contents[-1]
                more = contents[:-1] + ((length, last[1] + 1),) if last[0] == length else contents + ((length, 1),)
                put(free - length, used, more)
                left -= used
            else:
                fit = limit // length
                if left >= fit:
                    put(limit - fit * length, left // fit, ((length, fit),))
                    left %= fit
                else:
                    put(limit - left * length, 1, ((length, left),))
                    left = 0
    return [pack for free in sizes for pack in room[free]]


class Plan:
    """Where the pieces of each length go, by rank.

    whole[k] = (length, first rank, sequence, pieces per sequence, offset): from that rank on, pieces fill
    `pieces` slots a sequence. `cut` maps single (length, rank) to parts (sequence, offset, tokens).
    """

    def __init__(self, histogram: dict[int, int], limit: int = SEQUENCE, most_padding: float = MOST_PADDING):
        packs = place_lengths(histogram, limit)
        filled = lambda contents: sum(a * b for a, b in contents)
        total = sum(a * b for a, b in histogram.items())
        packs.sort(key=lambda p: -filled(p[1]))
        padding = sum(n * (limit - filled(c)) for n, c in packs)
        self.dissolved: list = []
        kept = [[n, c] for n, c in packs]
        if total and padding > most_padding * total:
            # the emptiest packs that all the room in the others can hold
            spare, moved = padding, 0
            while kept:
                n, c = kept[-1]
                size = filled(c)
                # giving up one pack moves `size` tokens and takes its own free room away
                can = min(n, max(0, (spare - moved) // limit))
                if not can or size == limit:
                    break
                spare -= can * (limit - size)
                moved += can * size
                self.dissolved.append((can, c))
                kept[-1][0] -= can
                if kept[-1][0]:
                    break
                kept.pop()
        ranks = dict.fromkeys(histogram, 0)
        sequence, self.whole, self.gaps = 0, [], []
        for n, contents in kept:
            offset = 0
            for length, pieces in contents:
                self.whole.append((length, ranks[length], sequence, pieces, offset))
                ranks[length] += n * pieces
                offset += length * pieces
            if offset < limit:
                self.gaps.append((sequence, n, offset, limit - offset))
            sequence += n
        self.sequences, self.limit = sequence, limit
        # given-up pieces stand end to end in one stream, by length and rank, and fill the gaps in order
        self.stream, at = [], 0
        given: dict[int, int] = {}
        for n, contents in self.dissolved:
            for length, pieces in contents:
                given[length] = given.get(length, 0) + n * pieces
        for length in sorted(given, reverse=True):
            self.stream.append((length, ranks[length], at))
            at += length * given[length]
        self.streamed = at
        self.whole.sort()
        self.whole_keys = np.array([(a << 40) + b for a, b, *_ in self.whole], np.int64)
        self.whole_rows = np.array(self.whole, np.int64).reshape(-1, 5)
        self.stream_keys = np.array([[a, b, c] for a, b, c in sorted(self.stream)], np.int64).reshape(-1, 3)
        self.gap_rows = np.array(self.gaps, np.int64).reshape(-1, 4)
        self.gap_ends = np.cumsum(self.gap_rows[:, 1] * self.gap_rows[:, 3])

    def locate(self, length: np.ndarray, rank: np.ndarray):
        """(row, start within the piece, length, sequence, offset) of the parts of each piece."""
        whole = np.ones(len(length), bool)
        if len(self.stream_keys):
            slot = np.searchsorted(self.stream_keys[:, 0], length)
            slot[slot == len(self.stream_keys)] = 0
            whole = ~((self.stream_keys[slot, 0] == length) & (rank >= self.stream_keys[slot, 1]))
        rows = np.flatnonzero(whole)
        found = self.whole_rows[np.searchsorted(self.whole_keys, (length[rows] << 40) + rank[rows], "right") - 1]
        place = rank[rows] - found[:, 1]
        parts = [(rows, np.zeros(len(rows), np.int64), length[rows], found[:, 2] + place // found[:, 3], found[:, 4] + place % found[:, 3] * length[rows])]
        for row in np.flatnonzero(~whole).tolist():
            at = int(self.stream_keys[slot[row], 2] + (rank[row] - self.stream_keys[slot[row], 1]) * length[row])
            done, size = 0, int(length[row])
            while done < size:
                k = int(np.searchsorted(self.gap_ends, at, "right"))
                sequence, _, offset, room = self.gap_rows[k].tolist()
                inside = at - (int(self.gap_ends[k - 1]) if k else 0)
                step = min(size - done, room - inside % room)
                parts.append(tuple(np.array([v]) for v in (row, done, step, sequence + inside // room, offset + inside % room)))
                done, at = done + step, at + step
        return [np.concatenate(c) for c in zip(*parts)]


def pack(documents: DataFrame, tokenizer: str, limit: int = SEQUENCE) -> DataFrame:
    """Pieces with their sequence, offset and ids: doc_id, start, length, doc_tokens, sequence_id,
    offset, ids (little-endian 32-bit)."""
    pieces = staged(token_pieces(documents, tokenizer, limit), "pieces")
    lengths = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = Plan(lengths, limit)
    keys = pieces.select("uid", "piece", "length")
    ranked = with_group_ranks(keys, "length", ["uid", "piece"], "rank", slices_for(max(lengths.values(), default=0)))
    ranked = staged(ranked.select("uid", "piece", "rank"), "ranks")

    def placed(batches):
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("rank").to_numpy(zero_copy_only=False).astype(np.int64)
            row, at, size, sequence, offset = plan.locate(length, rank)
            rows = batch.take(pa.array(row))
            parts = zip(rows.column("ids").to_pylist(), rows.column("length").to_pylist(), at.tolist(), size.tolist())
            ids = [np.frombuffer(x, f"<u{len(x) // whole}")[a : a + n].astype("<u4").tobytes() for x, whole, a, n in parts]
            start = rows.column("start").to_numpy(zero_copy_only=False) + at
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(start), pa.array(size), rows.column("doc_tokens"), pa.array(sequence), pa.array(offset), pa.array(ids, pa.binary())],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    # a merge join at every size: ranks small enough to be broadcast would make small inputs run otherwise than large ones
    return pieces.join(ranked.hint("shuffle_merge"), ["uid", "piece"]).mapInArrow(placed, PACKED)


def packing_digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
