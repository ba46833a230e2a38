"""Language-model scores from an Elias-Fano n-gram trie.

The trie is cut into shards. A shard of level k holds the k-grams of some contexts: the contexts' ids, pointers to
their successors, and the successors' word ids shifted by the context's number times the
vocabulary, so that each sequence is monotone and kept in Elias-Fano form, with a 16-bit code of
the smoothed probability for each k-gram: steps of STEP (log10) down to any probability that counts give. A k-gram is looked up by its context and then by successor search within
the context's range. Its place in the shard, shifted by the sizes of earlier shards, is its
id as a context of the next level.

Documents are tokenised into segments, kept as a table bucketed by segment. Level by level a segment
sends each shard its distinct k-grams, counted in the training documents, and the shard answers in the
same order: so hot words and n-grams are a row per segment, answers need no keys, and only
answers are shuffled to the segments. A context with more than HOT_COUNT tokens spreads over
several shards by the following word.

Probabilities are hierarchical Dirichlet: P(w | context) = (c(context w) + m P(w | shorter context)) / (c(context) + m);
words by absolute discounting, uncoded as their counts are sent, whose mass goes to one unknown word. Contexts are used from
one occurrence on; counts are never cut. A word is a 64-bit hash.

Defined results: null text is empty and has the end token alone; documents without an id train; with nothing to
learn from all probabilities are one; repeated rows count each.
"""

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwell.llm.arrays import NOT_SPACE, flat_words, hash_words, mix, pack_varints, text_slices, unpack_varints
from groundwell.llm.elias_fano import EliasFano
from groundwell.llm.ranks import training_fold
from groundwell.session import staged, work_path

SEGMENT_BYTES = 8 << 20
SHARD_BYTES = 12 << 20
HOT_COUNT = 200_000
ORDER = 3
WEIGHTS = {2: 60.0, 3: 4.0}
FOLDS, HELD = 7, 2
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
STEP = 0.03
UNSEEN = 0
# Up to so many bits a context, a word and a token's place are sorted as one number.
PACKED_BITS = 63
END = np.uint64(0xFFFFFFFFFFFFFFFF)

SEGMENTS = "segment long, doc_ids array<long>, held array<boolean>, doc_tokens array<int>, words binary, tokens binary, counts binary"


def segment_rows(batches):
    """Segments of (doc_id, held, text): sorted word hashes, tokens as places among them, training counts."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for i, j, buffer, starts in text_slices(batch, "text", SEGMENT_BYTES):
            flat, first, length, bounds = flat_words(buffer, starts, NOT_SPACE)
            n_words = np.diff(bounds)
            ends = np.cumsum(n_words + 1) - 1
            hashes = np.full(int(ends[-1]) + 1, END, np.uint64)
            slots = np.ones(len(hashes), bool)
            slots[ends] = False
            hashes[slots] = np.minimum(hash_words(flat, first, length), END - np.uint64(1))
            words, tokens = np.unique(hashes, return_inverse=True)
            held = batch.column(1).slice(i, j - i).to_numpy(zero_copy_only=False).astype(bool)
            train = np.repeat(~held, n_words + 1)
            counts = np.bincount(tokens[train], minlength=len(words))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()),
                    pa.array([batch.column(0).slice(i, j - i).to_pylist()], pa.list_(pa.int64())),
                    pa.array([held.tolist()], pa.list_(pa.bool_())),
                    pa.array([(n_words + 1).tolist()], pa.list_(pa.int32())),
                    pa.array([words.tobytes()], pa.binary()),
                    pa.array([tokens.astype("<u4").tobytes()], pa.binary()),
                    pa.array([pack_varints(counts)], pa.binary()),
                ],
                ["segment", "doc_ids", "held", "doc_tokens", "words", "tokens", "counts"],
            )
            number += 1


class Words:
    """Totals of the first level and the shards' shifts of every level; small, sent with the tasks."""

    def __init__(self, shards: int):
        self.shards, self.shifts, self.n, self.types, self.discount = shards, {}, 0, 0, 0.5

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        """P(w) for words of these counts, 0 standing for the unknown word."""
        if not self.n:
            return np.ones(len(counts))
        unknown = self.discount * self.types / self.n
        return np.where(counts > 0, (counts - self.discount) / self.n, unknown)


def quantised(p: np.ndarray) -> np.ndarray:
    """-log10 of probabilities in steps, from UNSEEN + 1 for probability one; 1e-300 is code 10001."""
    return (np.rint(-np.log10(np.maximum(p, 1e-300)) / STEP) + (UNSEEN + 1)).astype(np.uint16)


def probability(codes: np.ndarray) -> np.ndarray:
    """The probabilities of codes, 0 for UNSEEN."""
    return np.where(codes != UNSEEN, 10.0 ** (-STEP * (codes.astype(float) - (UNSEEN + 1))), 0.0)


def pack_codes(codes: np.ndarray) -> bytes:
    """All low bytes, then all high bytes, which are mostly zero and compress away."""
    return codes.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()


def unpack_codes(raw: bytes) -> np.ndarray:
    low, high = np.frombuffer(raw, np.uint8).reshape(2, -1).astype(np.uint16)
    return low | high << np.uint16(8)


def joint(context: np.ndarray, word: np.ndarray, types: int) -> np.ndarray:
    """One number for each (context, word), in their order; contexts are renumbered where the product would not fit."""
    if len(context) and int(context.max()) >= (1 << 63) // max(1, types) - 1:
        context = np.unique(context, return_inverse=True)[1]
    return context * max(1, types) + word


def changes(values: np.ndarray) -> np.ndarray:
    """Where a new value begins in values in order."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return np.flatnonzero(new)


class Resolved:
    """A segment with the answers of the levels so far: per token the context and, if these were `last`, the probability.

    A context is kept as its number in the segment, of the word or k-gram there; these have the order of the shards' ids."""

    def __init__(self, row: dict, answers: dict, model: Words, weights: dict, last: bool = False):
        self.row, self.model = row, model
        self.doc_tokens = np.array(row["doc_tokens"], np.int64)
        self.words = np.frombuffer(row["words"], np.uint64)
        self.tokens = np.frombuffer(row["tokens"], "<u4").view("<i4")
        if 1 not in answers:
            return
        shard = self.shard_of_words()
        self.counts, rank = self.joined(answers.pop(1))
        self.word_id = np.where(self.counts > 0, rank + np.array(model.shifts[1], np.int64)[shard], -1)
        self.known = (self.counts > 0)[self.tokens]
        if last:
            self.p = model.unigram(self.counts)[self.tokens]
        # what stands before each token: the word before it, or the end token at a text's start
        doc_starts = np.cumsum(self.doc_tokens) - self.doc_tokens
        before = np.concatenate((np.zeros(1, np.int32), self.tokens[:-1]))
        before[doc_starts] = len(self.words) - 1
        self.ids, self.id_counts = self.word_id, self.counts
        self.context = np.where(self.counts > 0, np.arange(len(self.words), dtype=np.int32), np.int32(-1))[before]
        del before
        for level in sorted(answers):
            own, number = self.numbered()
            code, key_ids, key_counts = self.contexts_of(answers.pop(level), np.array(model.shifts[level], np.int64))
            if last:
                # an unknown word has no key, its context is known all the same
                m = weights[level]
                share = np.append(m / (self.id_counts + m), 1.0)
                self.p *= share[self.context]
                self.p[own] += probability(code)[number]
                if not answers:
                    return
            # the context of a token is the k-gram that ends before it
            following = np.where(key_ids >= 0, np.arange(len(key_ids), dtype=np.int32), np.int32(-1))[number]
            behind = np.full(len(self.tokens) + 1, -1, np.int32)
            behind[own + 1] = following
            self.context = behind[:-1]
            self.context[doc_starts] = -1
            self.ids, self.id_counts = key_ids, key_counts

    def shard_of_words(self) -> np.ndarray:
        return (self.words >> np.uint64(64 - self.bits())).astype(np.int64) if self.bits() else np.zeros(len(self.words), np.int64)

    def bits(self) -> int:
        return int(math.log2(self.model.shards))

    def numbered(self):
        """(tokens that this level asks for, the number of each one's distinct (shard, context, word)), by context and word. Sets the
        distinct ones' shards, contexts, words and first places in it."""
        asked = np.flatnonzero(self.known & (self.context >= 0))
        if len(asked) < 1 << 31:
            asked = asked.astype(np.int32)
        context, word = self.context[asked], self.tokens[asked]
        word_bits, place_bits = len(self.words).bit_length(), len(self.tokens).bit_length()
        if len(self.ids).bit_length() + word_bits + place_bits <= PACKED_BITS:
            # key and token in one number, sorted by value
            packed = context.astype(np.int64)
            packed <<= word_bits
            packed |= word
            packed <<= place_bits
            packed |= asked
            packed.sort()
            own = (packed & ((1 << place_bits) - 1)).astype(asked.dtype)
            packed >>= place_bits
            begin = changes(packed)
            key = packed[begin]
            del packed
            context, word = key >> word_bits, key & ((1 << word_bits) - 1)
        else:
            order = np.lexsort((word, context))
            own, context, word = asked[order], context[order], word[order]
            begin = np.union1d(changes(context), changes(word))
            context, word = context[begin], word[begin]
        del asked
        # the distinct keys by shard; tokens then by the number of their key
        context_count = self.id_counts[context]
        context, word = self.ids[context], self.word_id[word]
        part = mix(context.astype(np.uint64))
        hot = np.flatnonzero(context_count >= 2 * HOT_COUNT)
        part[hot] += mix(word[hot].astype(np.uint64)) % (context_count[hot] // HOT_COUNT).astype(np.uint64)
        shard = (part & np.uint64(self.model.shards - 1)).astype(np.uint16 if self.model.shards <= 1 << 16 else np.int32)
        by_shard = np.argsort(shard, kind="stable")
        place = np.empty(len(context), np.int32)
        place[by_shard] = np.arange(len(context), dtype=np.int32)
        self.shard, self.key_context, self.key_word = shard[by_shard], context[by_shard], word[by_shard]
        self.begin, self.context_count = begin[by_shard], context_count[by_shard]
        return own, np.repeat(place, np.diff(np.append(begin, len(own))))

    def joined(self, parts: list):
        """(counts, places) of the words from the shards' answers in order."""
        counts, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _, raw, gaps, _ in sorted(parts):
            own = unpack_varints(raw).astype(np.int64)
            place = np.zeros(len(own), np.int64)
            place[own > 0] = np.cumsum(unpack_varints(gaps).astype(np.int64))
            counts.append(own)
            places.append(place)
        return np.concatenate(counts), np.concatenate(places)

    @staticmethod
    def contexts_of(parts: list, shifts: np.ndarray):
        """(codes, ids, counts) of the keys; id -1 and count 0 for what is no context of the next level."""
        codes, ids, counts = [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for shard, raw, gaps, own in sorted(parts):
            code = unpack_codes(own)
            number, count = np.full(len(code), -1, np.int64), np.zeros(len(code), np.int64)
            if raw:
                slot = np.flatnonzero(code != UNSEEN)
                number[slot], count[slot] = np.cumsum(unpack_varints(gaps).astype(np.int64)) + shifts[shard], unpack_varints(raw).astype(np.int64)
            codes.append(code)
            ids.append(number)
            counts.append(count)
        return np.concatenate(codes), np.concatenate(ids), np.concatenate(counts)

    def queries(self, level: int):
        """(shard, contexts, words, counts, context counts) for each shard that is asked."""
        if level == 1:
            shard = self.shard_of_words()
            counts = unpack_varints(self.row["counts"]).astype(np.int64)
            for s, a, b in runs(shard):
                yield s, self.words[a:b].tobytes(), b"", pack_varints(counts[a:b]), b""
            return
        own, number = self.numbered()
        train = np.repeat(~np.array(self.row["held"], bool), self.doc_tokens)
        key_count = np.bincount(number[train[own]], minlength=len(self.shard))
        del own, number, train
        for s, a, b in runs(self.shard):
            context, word = self.key_context[a:b], self.key_word[a:b]
            first = changes(context)
            gap = np.diff(word, prepend=0)
            gap[first] = word[first]
            sizes = np.diff(np.append(first, b - a))
            head = pack_varints(np.diff(context[first], prepend=0))
            yield s, pack_varints(np.array([len(head), len(first)])) + head + pack_varints(sizes), pack_varints(gap), pack_varints(key_count[a:b]), pack_varints(self.context_count[a:b][first])


def runs(shard: np.ndarray):
    if len(shard):
        first = changes(shard)
        for a, b in zip(first.tolist(), np.append(first[1:], len(shard)).tolist()):
            yield int(shard[a]), a, b


def read_query(raw: dict):
    """(contexts, keys of each, words, counts, context counts) of one query row."""
    numbers = unpack_varints(raw["contexts"]).astype(np.int64)
    n = int(numbers[1])
    context, sizes = np.cumsum(numbers[2 : 2 + n]), numbers[2 + n : 2 + 2 * n]
    gaps = unpack_varints(raw["words"]).astype(np.int64)
    total = np.cumsum(gaps)
    first = np.cumsum(sizes) - sizes
    word = total - np.repeat(total[first] - gaps[first], sizes)
    return context, sizes, word, unpack_varints(raw["counts"]).astype(np.int64), unpack_varints(raw["context_counts"]).astype(np.int64)


ANSWERS = "shard int, segment long, level int, counts binary, places binary, codes binary, stats array<long>, trie binary"


def answers_frame(shard, level, rows, stats, trie):
    n = len(rows)
    columns = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.table(
        {
            "shard": pa.array([shard] * (n + 1), pa.int32()),
            "segment": pa.array([*columns[0], None], pa.int64()),
            "level": pa.array([level] * (n + 1), pa.int32()),
            "counts": pa.array([*columns[1], None], pa.binary()),
            "places": pa.array([*columns[2], None], pa.binary()),
            "codes": pa.array([*columns[3], None], pa.binary()),
            "stats": pa.array([None] * n + [stats], pa.list_(pa.int64())),
            "trie": pa.array([None] * n + [trie], pa.binary()),
        }
    )


def word_shard(table: pa.Table, keep: bool) -> pa.Table:
    """The first level of one shard: words by hash, with counts."""
    rows = sorted(table.to_pylist(), key=lambda r: r["segment"])
    hashes = [np.frombuffer(r["contexts"], np.uint64) for r in rows]
    counts = [unpack_varints(r["counts"]).astype(np.int64) for r in rows]
    names, number = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(number, np.concatenate(counts), len(names)).astype(np.int64)
    rank = np.cumsum(total > 0) - 1
    known = names[total > 0]
    answers, at = [], 0
    for r, own in zip(rows, hashes):
        k = number[at : at + len(own)]
        at += len(own)
        c = total[k]
        answers.append((r["segment"], pack_varints(c), pack_varints(np.diff(rank[k][c > 0], prepend=0)), b""))
    stats = [len(known), int(total.sum()), int((total == 1).sum()), int((total == 2).sum())]
    return answers_frame(rows[0]["shard"], 1, answers, stats, known.tobytes() if keep else None)


class TrieShard:
    """Contexts, pointers, successors and codes of one shard, over its flat buffer."""

    def __init__(self, raw: bytes):
        sizes = np.frombuffer(raw, "<i8", 5)
        self.words = int(sizes[4])
        ends = 40 + np.cumsum(sizes[:4])
        self.contexts, self.pointers, self.successors = (EliasFano(raw[ends[k] - sizes[k] : ends[k]]) for k in range(3))
        self.codes = np.frombuffer(raw[ends[2] : ends[3]], "<u2")

    @staticmethod
    def build(context, word, p, words: int) -> bytes:
        """From (context, word) pairs in order with their probabilities."""
        first = changes(context)
        names = context[first]
        number = np.repeat(np.arange(len(names)), np.diff(np.append(first, len(context))))
        parts = [
            EliasFano.encode(names, int(names[-1]) + 1 if len(names) else 1),
            EliasFano.encode(np.append(first, len(context)), len(context) + 1),
            EliasFano.encode(number * words + word, max(1, len(names)) * words),
            quantised(p).astype("<u2").tobytes(),
        ]
        return np.array([*map(len, parts), words], "<i8").tobytes() + b"".join(parts)

    def find(self, context, sizes, word) -> np.ndarray:
        """The place of sizes[k] words behind each context[k], -1 where the trie has none."""
        n = self.contexts.n
        place = np.full(len(word), -1, np.int64)
        if not n or not len(word):
            return place
        zero = np.zeros(len(context), np.int64)
        slot = self.contexts.successor(zero, zero + n, context)
        there = slot < n
        there[there] = self.contexts.at(slot[there]) == context[there]
        slot = np.where(there, slot, 0)
        a, b = self.pointers.at(slot), self.pointers.at(slot + 1)
        own = np.flatnonzero(np.repeat(there, sizes))
        slot, a, b = (np.repeat(x, sizes)[own] for x in (slot, a, b))
        wanted = slot * self.words + word[own]
        at = self.successors.successor(a, b, wanted)
        hit = at < b
        hit[hit] = self.successors.at(at[hit]) == wanted[hit]
        place[own[hit]] = at[hit]
        return place


def gram_shard(table: pa.Table, level: int, weight: float, words: int, last: bool, keep: bool) -> pa.Table:
    """A higher level's shard: built from the training counts, then asked for every segment's keys."""
    rows = sorted(table.to_pylist(), key=lambda r: r["segment"])
    asked = [read_query(r) for r in rows]
    context, word = np.concatenate([np.repeat(c, s) for c, s, _, _, _ in asked]), np.concatenate([w for _, _, w, _, _ in asked])
    sent, key = np.concatenate([n for _, _, _, n, _ in asked]), joint(context, word, words)
    # the distinct keys of all segments, of which those with a count are in the trie
    distinct = np.sort(key)
    distinct = distinct[changes(distinct)]
    number = np.searchsorted(distinct, key).astype(np.int32 if len(key) < 1 << 31 else np.int64)
    first = np.empty(len(distinct), number.dtype)
    first[number] = np.arange(len(key), dtype=number.dtype)
    total = np.bincount(number, sent, len(distinct)).astype(np.int64)
    del key, distinct, sent
    context, word = context[first], word[first]
    context_count = np.concatenate([np.repeat(cc, s) for _, s, _, _, cc in asked])[first]
    del first
    own = np.flatnonzero(total > 0)
    total = total[own]
    raw = TrieShard.build(context[own], word[own], total / (context_count[own] + weight), words)
    trie = TrieShard(raw)
    begin = changes(context)
    places = trie.find(context[begin], np.diff(np.append(begin, len(context))), word)
    there = np.flatnonzero(places >= 0)
    codes = np.full(len(places), UNSEEN, np.uint16)
    codes[there] = trie.codes[places[there]]
    answers, at = [], 0
    for r, (_, _, own, _, _) in zip(rows, asked):
        k = number[at : at + len(own)]
        at += len(own)
        counts = gaps = b""
        if not last:
            # contexts of the next level, those with a code; keys come in the order of the trie, so places only grow
            place = places[k]
            place = place[place >= 0]
            counts = pack_varints(total[place])
            gaps = pack_varints(np.diff(place, prepend=0))
        answers.append((r["segment"], counts, gaps, pack_codes(codes[k])))
    return answers_frame(rows[0]["shard"], level, answers, [len(total)], raw if keep else None)


def kept(df: DataFrame, name: str) -> DataFrame:
    """As `staged`, in the smaller form."""
    path = work_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def score_documents(documents: DataFrame, order: int = ORDER, weights: dict = WEIGHTS, folds: int = FOLDS, held: int = HELD, model_path: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document row. With
    `model_path` the shards' flat buffers are kept there, as (level, shard, trie)."""
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), training_fold(F.col("doc_id"), folds, held).alias("held"), F.col("text").cast("string").alias("text"))
    name = f"segments_{uuid.uuid4().hex}"
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows.mapInArrow(segment_rows, SEGMENTS).write.format("parquet").option("compression", "zstd").bucketBy(parts, "segment").saveAsTable(name)
    segments = spark.table(name)
    # a segment is some tens of megabytes with its answers: one a batch
    batch_rows = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, 1)
    try:
        size = segments.agg(F.coalesce(F.sum(F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()[0]
        model = Words(1 << max(0, math.ceil(math.log2(max(1, size * 6 / SHARD_BYTES)))))
        given = None
        for level in range(1, order + 1):
            answered = kept(level_answers(segments, given, model, level, weights, order, model_path is not None), f"level{level}")
            if model_path is not None:
                tries = answered.filter("stats IS NOT NULL").select("level", "shard", "trie")
                tries.write.mode("overwrite" if level == 1 else "append").parquet(model_path)
            stats = {r["shard"]: r["stats"] for r in answered.filter("stats IS NOT NULL").select("shard", "stats").collect()}
            sizes = [stats.get(s, [0])[0] for s in range(model.shards)]
            model.shifts[level] = (np.cumsum(sizes) - sizes).tolist()
            if level == 1:
                model.types, model.n, once, twice = (sum(s[k] for s in stats.values()) for k in range(4))
                model.discount = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5
            own = answered.filter("segment IS NOT NULL").select("segment", "level", "shard", "counts", "places", "codes")
            given = own if given is None else given.unionByName(own)
        return staged(final_scores(segments, given, model, weights), "scores")
    finally:
        spark.conf.set(BATCH_ROWS, batch_rows)
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def with_answers(segments: DataFrame, given: DataFrame | None) -> DataFrame:
    """Each segment's row with its answers; the answers go to the segments' buckets."""
    kind = "array<struct<level:int,shard:int,counts:binary,places:binary,codes:binary>>"
    if given is None:
        return segments.withColumn("answers", F.expr(f"cast(array() as {kind})"))
    lists = given.groupBy("segment").agg(F.collect_list(F.struct("level", "shard", "counts", "places", "codes")).alias("answers"))
    return segments.join(lists.hint("shuffle_merge"), "segment", "left").withColumn("answers", F.coalesce("answers", F.expr(f"cast(array() as {kind})")))


def resolved_rows(batches, model: Words, weights: dict, levels: int, last: bool = False):
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            answers: dict[int, list] = {level: [] for level in range(1, levels + 1)}
            for a in row.pop("answers"):
                answers[a["level"]].append((a["shard"], a["counts"], a["places"], a["codes"]))
            yield row, Resolved(row, answers, model, weights, last)


def level_answers(segments: DataFrame, given: DataFrame | None, model: Words, level: int, weights: dict, levels: int, keep: bool) -> DataFrame:
    """Queries of one level from all segments to the shards, and the shards' answers."""
    schema = "shard int, segment long, contexts binary, words binary, counts binary, context_counts binary"

    def asked(batches):
        for row, own in resolved_rows(batches, model, weights, level - 1):
            found = list(own.queries(level))
            columns = list(zip(*found)) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), pa.array([row["segment"]] * len(found), pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])],
                ["shard", "segment", "contexts", "words", "counts", "context_counts"],
            )

    words, weight = max(1, model.types), weights.get(level, 0.0)
    if level == 1:
        answer = lambda table: word_shard(table, keep)
    else:
        answer = lambda table: gram_shard(table, level, weight, words, level == levels, keep)
    queries = with_answers(segments, given).mapInArrow(asked, schema)
    return queries.groupBy("shard").applyInArrow(answer, ANSWERS)


def final_scores(segments: DataFrame, given: DataFrame, model: Words, weights: dict) -> DataFrame:
    levels = max(model.shifts)

    def scored(batches):
        for row, own in resolved_rows(batches, model, weights, levels, True):
            first = np.cumsum(own.doc_tokens) - own.doc_tokens
            base = np.log10((own.counts + 1) / (model.n + model.types + 1))[own.tokens]
            columns = [
                pa.array(row["doc_ids"], pa.int64()),
                pa.array(row["held"], pa.bool_()),
                pa.array(own.doc_tokens),
                pa.array(np.add.reduceat((own.counts > 0)[own.tokens].astype(np.int64), first)),
                pa.array(np.full(len(first), model.n)),
                pa.array(np.add.reduceat(base, first)),
                pa.array(np.add.reduceat(np.log10(own.p), first)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return with_answers(segments, given).mapInArrow(scored, schema)
