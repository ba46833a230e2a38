"""Benchmark decontamination over a positional inverted index of the training documents.

`build_index` writes one row per segment of about SEGMENT_BYTES of text: the segment's sorted term
hashes, its dictionary, and for every term the word positions of all its occurrences as varint
gaps. Positions count on through a segment with a gap of one between documents, so adjacency never
crosses a document. Two words of one hash would give wrong postings, so the words behind equal
hashes are compared byte by byte and a segment takes another seed if any differ; at search time the
dictionary's words are compared with the benchmark's, so matches are exact.

`search` intersects, for each benchmark window and segment, the offset-adjusted position lists from
the segment's rarest term on. Benchmark items are a stated query set, sent to the segments in
blocks of at most BLOCK_BYTES. Building and searching are narrow: no posting is shuffled, and the
hottest term or passage is spread over all segments that hold it.

Defined results: null text has no words; null item ids count as the item ''; rows of one item_id
are one item; an item without words has no window; repeated document rows are reported each.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundwell.llm.arrays import (
    LOWER,
    WORD_BYTES,
    equal_words,
    hash_words,
    pack_varints,
    text_slices,
    unpack_varints,
    words_in,
)
from groundwell.session import staged

SEGMENT_BYTES = 8 << 20
BLOCK_BYTES = 4 << 20
WINDOW_WORDS = 10

INDEX = """segment long, seed int, doc_ids array<long>, doc_words array<int>, terms binary, counts binary,
dictionary binary, postings binary"""
MATCHES = "segment long, ordinal int, doc_id long, item_id string, kind string, start int, stop int"


def invert(buffer: np.ndarray, starts: np.ndarray) -> dict:
    """The index of one segment; `starts` as from text_slices."""
    low = LOWER[buffer]
    at, length = words_in(low, int(starts[-1]), WORD_BYTES)
    bounds = np.searchsorted(at, starts)
    doc_words = np.diff(bounds)
    position = np.arange(len(at)) + np.repeat(np.arange(len(doc_words)), doc_words)
    seed = 0
    while True:
        h = hash_words(low, at, length, seed)
        order = np.argsort(h, kind="stable")
        h = h[order]
        same = h[1:] == h[:-1]
        pairs = np.flatnonzero(same)
        if equal_words(low, at, length, order[pairs], order[pairs + 1]).all():
            break
        seed += 1
    first = np.flatnonzero(np.concatenate(([True], ~same))) if len(h) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(h)))
    listed = position[order]
    gaps = np.diff(listed, prepend=0)
    gaps[first] = listed[first]
    kept, size = at[order[first]], length[order[first]]
    ends = np.cumsum(size + 1)
    dictionary = np.full(int(ends[-1]) if len(ends) else 0, 10, np.uint8)
    shift = np.repeat(kept - (ends - size - 1), size)
    inside = np.ones(len(dictionary), bool)
    inside[ends - 1] = False
    slots = np.flatnonzero(inside)
    dictionary[slots] = low[slots + shift]
    return {
        "seed": seed,
        "doc_words": doc_words.astype(np.int32),
        "terms": h[first].tobytes(),
        "counts": pack_varints(counts),
        "dictionary": dictionary.tobytes(),
        "postings": pack_varints(gaps),
    }


def build_index(documents: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Segments of documents(doc_id, text), staged in the work folder."""

    def segments(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column(0)
            for i, j, buffer, starts in text_slices(batch, "text", segment_bytes):
                part = invert(buffer, starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], pa.int64()),
                        pa.array([part["seed"]], pa.int32()),
                        pa.array([ids.slice(i, j - i).to_pylist()], pa.list_(pa.int64())),
                        pa.array([part["doc_words"]], pa.list_(pa.int32())),
                        *(pa.array([part[k]], pa.binary()) for k in ("terms", "counts", "dictionary", "postings")),
                    ],
                    ["segment", "seed", "doc_ids", "doc_words", "terms", "counts", "dictionary", "postings"],
                )
                number += 1

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return staged(rows.mapInArrow(segments, INDEX), "index")


class Segment:
    """One index row; lists are decoded for the terms that are asked for."""

    def __init__(self, row: dict):
        self.doc_ids, doc_words = row["doc_ids"], np.asarray(row["doc_words"], np.int64)
        self.doc_at = np.cumsum(doc_words + 1) - doc_words - 1
        self.doc_end = self.doc_at + doc_words
        self.seed, self.terms = row["seed"], np.frombuffer(row["terms"], np.uint64)
        self.counts = unpack_varints(row["counts"]).astype(np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self.dictionary = row["dictionary"]
        self.word_ends = np.flatnonzero(np.frombuffer(self.dictionary, np.uint8) == 10)
        self.gaps = unpack_varints(row["postings"]).astype(np.int64)
        self.lists = {}

    def find(self, hashes: np.ndarray, words: list) -> np.ndarray:
        """The term number of each word, -1 where the segment has none."""
        slot = np.searchsorted(self.terms, hashes)
        slot[slot == len(self.terms)] = -1
        if len(self.terms):
            slot[self.terms[slot] != hashes] = -1
        for k in np.flatnonzero(slot >= 0).tolist():
            end = int(self.word_ends[slot[k]])
            if self.dictionary[end - len(words[k]) : end] != words[k] or (slot[k] and self.word_ends[slot[k] - 1] != end - len(words[k]) - 1):
                slot[k] = -1
        return slot

    def positions(self, term: int) -> np.ndarray:
        if term not in self.lists:
            at = self.first[term]
            self.lists[term] = np.cumsum(self.gaps[at : at + self.counts[term]])
        return self.lists[term]

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Starts of the exact sequence: lists less their offsets, intersected from the rarest on."""
        found = None
        for k in np.argsort(self.counts[terms], kind="stable").tolist():
            listed = self.positions(int(terms[k]))
            if found is None:
                found = listed - k
            else:
                slot = np.searchsorted(listed, found + k)
                slot[slot == len(listed)] = 0
                found = found[listed[slot] == found + k]
            if not len(found):
                break
        return found

    def near(self, terms: np.ndarray, within: int) -> np.ndarray:
        """Positions of the rarest term with every other term at most `within` words away in its document."""
        order = np.argsort(self.counts[terms], kind="stable").tolist()
        found = self.positions(int(terms[order[0]]))
        for k in order[1:]:
            if terms[k] == terms[order[0]]:
                continue
            listed = self.positions(int(terms[k]))
            doc = np.searchsorted(self.doc_at, found, "right") - 1
            low = np.maximum(found - within, self.doc_at[doc])
            high = np.minimum(found + within, self.doc_end[doc] - 1)
            found = found[np.searchsorted(listed, low) < np.searchsorted(listed, high, "right")]
        return found


class Queries:
    """Windows of a block of benchmark items as rows of word numbers."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        numbers: dict[bytes, int] = {}
        self.items, self.windows, seen = [], [], set()
        for item_id, text in items:
            raw = np.frombuffer(b"\n" + text.encode() + b"\n" + bytes(8), np.uint8)
            low = LOWER[raw]
            at, length = words_in(low, len(raw) - 8, WORD_BYTES)
            flat = low.tobytes()
            words = [numbers.setdefault(flat[a : a + n], len(numbers)) for a, n in zip(at.tolist(), length.tolist())]
            for k in range(max(1, len(words) - window + 1) if words else 0):
                key = (item_id, *words[k : k + window])
                if key not in seen:
                    seen.add(key)
                    self.items.append(item_id)
                    self.windows.append(np.array(words[k : k + window]))
        self.words = list(numbers)
        self.by_seed: dict[int, np.ndarray] = {}

    def hashes(self, seed: int) -> np.ndarray:
        if seed not in self.by_seed:
            flat = np.frombuffer(b"\n".join(self.words) + bytes(41), np.uint8)
            length = np.array([len(w) for w in self.words], np.int64)
            self.by_seed[seed] = hash_words(flat, np.cumsum(length + 1) - length - 1, length, seed)
        return self.by_seed[seed]


def matches_in(row: dict, queries: Queries, within: int) -> list[tuple]:
    """(ordinal, doc_id, item_id, kind, start, stop) of a segment; runs of one item's overlapping phrases are one."""
    part, out = Segment(row), []
    if not queries.words:
        return out
    slot = part.find(queries.hashes(part.seed), queries.words)
    spans: dict[str, list] = {}
    for item, window in zip(queries.items, queries.windows):
        terms = slot[window]
        if terms.min() < 0:
            continue
        starts = part.phrase(terms)
        if len(starts):
            spans.setdefault(item, []).append(np.stack([starts, starts + len(window)]))
        if within:
            for at in part.near(terms, within).tolist():
                doc = int(np.searchsorted(part.doc_at, at, "right")) - 1
                shift = at - int(part.doc_at[doc])
                out.append((doc, part.doc_ids[doc], item, "near", shift, shift + 1))
    for item, found in spans.items():
        start, stop = np.concatenate(found, axis=1)
        order = np.argsort(start, kind="stable")
        start, stop = start[order], np.maximum.accumulate(stop[order])
        new = np.flatnonzero(np.concatenate(([True], start[1:] > stop[:-1])))
        doc = np.searchsorted(part.doc_at, start[new], "right") - 1
        shift = part.doc_at[doc]
        for d, a, b in zip(doc.tolist(), (start[new] - shift).tolist(), (stop[np.append(new[1:], len(start)) - 1] - shift).tolist()):
            out.append((d, part.doc_ids[d], item, "phrase", a, b))
    return out


def blocks_of(benchmark: DataFrame, block_bytes: int):
    """The items in lists of about `block_bytes` of text."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, math.ceil(size / block_bytes))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(count)))
    for k in range(count):
        yield [(r["item_id"], r["text"]) for r in dealt.filter(F.col("block") == k).collect()]


def search(index: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, within: int = 0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Matches of benchmark(item_id, text): words [start, stop) of a document that an item's windows
    cover exactly (kind 'phrase'), and with `within` the places where all words of a window stand at
    most so many words from its rarest one (kind 'near')."""
    found = None
    for block in blocks_of(benchmark, block_bytes):

        def matched(batches, block=block):
            queries = Queries(block, window)
            for batch in batches:
                for row in batch.to_pylist():
                    hits = matches_in(row, queries, within)
                    columns = list(zip(*hits)) if hits else [[]] * 6
                    kinds = (pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["segment"]] * len(hits), pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                        ["segment", "ordinal", "doc_id", "item_id", "kind", "start", "stop"],
                    )

        rows = index.mapInArrow(matched, MATCHES)
        found = rows if found is None else found.unionByName(rows)
    return found


def contamination(index: DataFrame, matches: DataFrame) -> DataFrame:
    """Per document row of the index: its words, those under a phrase match, and the items."""
    docs = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "doc_words")).alias("ordinal", "d")).select(
        "segment", "ordinal", F.col("d.doc_ids").alias("doc_id"), F.col("d.doc_words").cast("long").alias("n_words")
    )
    own = Window.partitionBy("segment", "ordinal")
    before = own.orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    spans = matches.filter("kind = 'phrase'").withColumn("reach", F.coalesce(F.max("stop").over(before), F.lit(0)))
    hits = spans.groupBy("segment", "ordinal").agg(
        F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "reach"))).cast("long").alias("n_hit"),
        F.sort_array(F.collect_set("item_id")).alias("items"),
    )
    items = F.coalesce("items", F.array().cast("array<string>"))
    return docs.join(hits, ["segment", "ordinal"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document row."""
    index = build_index(documents)
    return contamination(index, staged(search(index, benchmark), "matches"))
