"""Cosine top-k of a table of questions against the passage store.

Store:     record_id, category, embedding (plus any payload).
Questions: query_id, vector, and optionally top_k, category, min_similarity.

The question set, whatever its size, is dealt by a hash of `query_id` into passes of bounded size.
For each pass its questions are broadcast; each group of them has a scan of the store in place, whose tasks
score their part block by block and hand on at most k rows per question. The store is never shuffled.
The more groups a pass has, the fewer tasks share a group's scan, so that many questions do not make many lists each.
Products are taken in single precision; what they leave in reach of a question's list is scored in doubles.
The partial lists are merged per question; where there could be very many of them, first per slice of a question's rows, so
no task sees more than a slice of one question's candidates. A question is in one pass and group only, so
their number does not change the rows.
"""

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundwell.functions.text import blank_to_null
from groundwell.functions.vectors import (
    ROUND_OUT,
    ROUND_RANK,
    cosine_distance,
    l2_norm,
    passes_floor,
    similarity,
)
from groundwell.schemas import DEFAULT_MIN_SIMILARITY, DEFAULT_TOP_K
from groundwell.session import broadcast_if_small, staged, work_path

# About what one pass over the store broadcasts at most.
PASS_QUESTIONS = 32768
PASS_BYTES = 64 * 1024 * 1024
# Scan tasks for each core of the session, where the caller names no number.
TASKS_PER_CORE = 4
# Rows and questions scored by one matrix product inside a task.
BLOCK_ROWS = 2048
BLOCK_QUESTIONS = 1024
# Questions that share one scan of the store, and pairs scored in doubles at a time.
GROUP_QUESTIONS = 8192
EXACT_PAIRS = 65_536
# Scores of one question of which the highest tells whether the others are compared.
PART_SCORES = range(96, 257)
# Candidates of one question that a single step merges; more of them are cut by slices before.
MERGE_ROWS = 65_536
MERGE_SLICES = 64
# Pairs that wait before the lists are cut; ties and low floors cannot hold more than a block above.
PENDING_PAIRS = 1_000_000
# So many category names are pushed to the scan as they are, more of them as their range.
LITERAL_NAMES = 16


def with_defaults(questions: DataFrame) -> DataFrame:
    """The question columns, with the request defaults where a column is absent or null."""

    def given(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in questions.columns else F.lit(None).cast(kind)

    return questions.select(
        "query_id",
        "vector",
        F.coalesce(given("top_k", "int"), F.lit(DEFAULT_TOP_K)).alias("top_k"),
        blank_to_null(given("category", "string")).alias("category"),
        F.coalesce(given("min_similarity", "double"), F.lit(DEFAULT_MIN_SIMILARITY)).alias(
            "min_similarity"
        ),
        *(["cells"] if "cells" in questions.columns else []),
    )


def unit_rows(vectors: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers with a usable vector, their unit vectors as doubles).

    Null, zero, non-finite and wrongly sized vectors are not usable: they never match.
    """
    sizes = np.nan_to_num(vectors.value_lengths().to_numpy(zero_copy_only=False)).astype(int)
    width = int(sizes.max(initial=0)) if width is None else width
    rows = np.flatnonzero((sizes == width) & (sizes > 0))
    if not len(rows):
        return rows, np.zeros((0, width))
    flat = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
    matrix = flat.reshape(len(rows), width).astype(np.float64)
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    usable = np.isfinite(norms) & (norms > 0)
    return rows[usable], matrix[usable] / norms[usable, None]


def packed(store: DataFrame) -> DataFrame:
    """The store with its vectors as the bytes of their floats, which Spark hands to a task's Python as a whole; it takes
    arrays apart element by element. Vectors of doubles stay as they are."""
    if store.schema["embedding"].dataType.simpleString() != "array<float>":
        return store

    def pack(batches):
        for batch in batches:
            vectors = batch.column("embedding")
            sizes = np.nan_to_num(vectors.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            ends = np.append(0, np.cumsum(sizes) * 4).astype(np.int32)
            values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
            held = [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))]
            made = {n: batch.column(n) for n in batch.schema.names}
            made["embedding"] = pa.BinaryArray.from_buffers(pa.binary(), len(vectors), held)
            yield pa.RecordBatch.from_pydict(made)

    schema = T.StructType([T.StructField(f.name, T.BinaryType() if f.name == "embedding" else f.dataType) for f in store.schema])
    return store.mapInArrow(pack, schema)


def unpacked(vectors: pa.Array) -> pa.Array:
    """Vectors from the bytes that `packed` made of them, without copying; null ones come back empty. Others stay as they are."""
    if not pa.types.is_binary(vectors.type):
        return vectors
    _, ends, data = vectors.buffers()
    ends = np.frombuffer(ends, np.int32, len(vectors) + 1, vectors.offset * 4) // 4
    values = pa.Array.from_buffers(pa.float32(), int(ends[-1]), [None, data])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _members(values: pa.Array) -> dict:
    """Value -> positions, nulls left out."""
    coded = values.dictionary_encode()
    codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    present, starts = np.unique(codes[order], return_index=True)
    known = coded.dictionary.to_pylist()
    groups = zip(present.tolist(), np.split(order, starts[1:]))
    return {known[code]: positions for code, positions in groups if code >= 0}


def parts_in_reach(scores: np.ndarray, bar: np.ndarray, above: float = 0.0):
    """(parts of a block's scores with one that reaches the bar of its question by `above`, their questions, their numbers).

    One pass over the scores finds the questions that have any to look at, which few have once their bars are up. The scores of
    these are looked at in parts of one size, of which few have one in reach. The parts stand in the order of the scores.
    """
    rows = scores.shape[1]
    size = next((n for n in PART_SCORES if rows % n == 0), rows)
    some = np.flatnonzero(scores.max(axis=1) + above >= bar)
    parts, each = scores[some].reshape(-1, size), rows // size
    open_ = np.flatnonzero(parts.max(axis=1) + above >= np.repeat(bar[some], each))
    return parts[open_], some[open_ // each], open_ % each


class QuestionBlock:
    """A bounded set of questions in array form, and the best rows found for them so far."""

    def __init__(self, table: pa.Table, keys: int):
        rows, vectors = unit_rows(table.column("vector").combine_chunks())
        # questions of like top_k share a product, so that one long list does not lower the bars of the others
        order = np.argsort(table.column("top_k").to_numpy()[rows], kind="stable")
        self.vectors, self.narrow = vectors[order], vectors[order].astype(np.float32)
        table = table.take(pa.array(rows[order], pa.int64()))
        self.ids = table.column("query_id").combine_chunks()
        self.top_k = table.column("top_k").to_numpy()
        self.floor = table.column("min_similarity").to_numpy()
        categories = table.column("category").combine_chunks()
        self.free = categories.is_null().to_numpy(zero_copy_only=False)
        self.by_category = _members(categories)
        self.by_cell = None
        if "cells" in table.column_names:
            cells = table.column("cells").combine_chunks()
            asked = np.repeat(np.arange(len(cells)), cells.value_lengths().to_numpy())
            flat = cells.flatten().to_numpy()
            order = np.argsort(flat, kind="stable")
            values, starts = np.unique(flat[order], return_index=True)
            self.by_cell = dict(zip(values.tolist(), np.split(asked[order], starts[1:])))
        # The score a row must reach to enter a question's list. The floor works on the clamped
        # score, so a floor of zero lets negative cosines in.
        self.bar = np.where(self.floor > 0, self.floor, -np.inf)
        self.barred = np.zeros(len(self.bar), dtype=bool)
        # what a product of single precision is off by, at most, and the rounding of ranks
        self.slack = (vectors.shape[1] + 8) * 2.0**-23 + 10.0**-ROUND_RANK
        self.found = (np.zeros(0, int), np.zeros(0), np.zeros((0, keys), int))
        self.pending, self.waiting = [], 0

    def meet(self, rows: np.ndarray, keys: np.ndarray, category=None, cell=None) -> None:
        """Scores store rows (unit vectors, key columns) against the questions open to them."""
        if cell is not None:
            for value, members in _members(cell).items():
                asked = self.by_cell.get(value)
                if asked is not None:
                    part = None if category is None else category.take(pa.array(members))
                    self._meet(rows[members], keys[members], part, asked)
        else:
            self._meet(rows, keys, category, np.arange(len(self.ids)))
        # as many again as the lists hold: each doubling of the rows met costs one cut
        if self.waiting >= len(self.found[0]):
            self._settle()

    def _meet(self, rows, keys, category, asked) -> None:
        self._score(rows, keys, asked[self.free[asked]])
        if category is not None and self.by_category:
            present = np.zeros(len(self.ids), dtype=bool)
            present[asked] = True
            for value, members in _members(category).items():
                named = self.by_category.get(value)
                if named is not None:
                    self._score(rows[members], keys[members], named[present[named]])

    def _score(self, rows, keys, asked) -> None:
        narrow = rows.astype(np.float32)
        for q0 in range(0, len(asked), BLOCK_QUESTIONS):
            some = asked[q0 : q0 + BLOCK_QUESTIONS]
            left = self.narrow[some]
            for r0 in range(0, len(rows), BLOCK_ROWS):
                part = slice(r0, r0 + BLOCK_ROWS)
                self._keep(left @ narrow[part].T, rows[part], keys[part], some)

    def _raise(self, lower, asked, slack) -> None:
        """First bars: the k-th best of some rows alone bounds the k-th best overall from below."""
        most = max(1, int(self.top_k[asked].max()))
        if lower.shape[1] > most and not self.barred[asked].all():
            kth = np.partition(lower, -most, axis=1)[:, -most]
            self.bar[asked] = np.maximum(self.bar[asked], kth - slack)
            self.barred[asked] = True

    def _wait(self, *pairs) -> None:
        self.pending.append(pairs)
        self.waiting += len(pairs[0])
        if self.waiting > max(PENDING_PAIRS, len(self.found[0])):
            self._settle()

    def _keep(self, scores, rows, keys, asked) -> None:
        self._raise(scores, asked, self.slack)
        bar = (self.bar[asked] - self.slack).astype(np.float32)
        parts, place, number = parts_in_reach(scores, bar)
        near = np.flatnonzero(parts >= bar[place, None])
        for start in range(0, len(near), EXACT_PAIRS):
            part, row = np.divmod(near[start : start + EXACT_PAIRS], parts.shape[1])
            question, row = asked[place[part]], row + number[part] * parts.shape[1]
            exact = np.einsum("ij,ij->i", self.vectors[question], rows[row])
            kept = exact >= self.bar[question] - 10.0**-ROUND_RANK
            kept &= np.clip(exact, 0.0, 1.0) >= self.floor[question]
            if kept.any():
                self._wait(question[kept], exact[kept], keys[row[kept]])

    def _settle(self) -> None:
        """Cuts each question's rows to its top_k by (rounded score, record id)."""
        if not self.pending:
            return
        question, exact, keys = (np.concatenate(p) for p in zip(self.found, *self.pending))
        rounded = np.round(exact, ROUND_RANK)
        order = np.lexsort((keys[:, 0], -rounded, question))
        question, exact, keys = question[order], exact[order], keys[order]
        starts = np.flatnonzero(np.r_[True, question[1:] != question[:-1]])
        rank = np.arange(len(question)) - np.repeat(starts, np.diff(np.r_[starts, len(question)]))
        last = rank == self.top_k[question] - 1
        self.bar[question[last]] = np.maximum(self.bar[question[last]], rounded[order][last])
        keep = rank < self.top_k[question]
        self.found, self.pending, self.waiting = (question[keep], exact[keep], keys[keep]), [], 0

    def results(self, names) -> pa.RecordBatch:
        self._settle()
        question, exact, keys = self.found
        return pa.RecordBatch.from_arrays(
            [
                self.ids.take(pa.array(question, pa.int64())),
                pa.array(self.top_k[question], pa.int32()),
                *(pa.array(keys[:, i], pa.int64()) for i in range(keys.shape[1])),
                pa.array(exact, pa.float64()),
            ],
            names=["query_id", "top_k", *names, "score"],
        )


def question_blocks(table: pa.Table, keys: int, kind: type = QuestionBlock) -> list[QuestionBlock]:
    """One block per vector width, so that a question meets the rows of its own width whatever
    other questions share its pass."""
    widths = table.column("vector").combine_chunks().value_lengths()
    known = [width for width in pc.unique(widths).to_pylist() if width]
    parts = [table.filter(pc.equal(widths, width)) for width in known]
    return [kind(part, keys) for part in parts or [table.slice(0, 0)]]


def _meet_batch(block: QuestionBlock, batch: pa.RecordBatch, keys) -> None:
    if not len(block.ids):
        return
    rows, matrix = unit_rows(unpacked(batch.column("embedding")), block.vectors.shape[1])
    if not len(rows):
        return
    key_columns = np.stack([batch.column(k).to_numpy()[rows].astype(np.int64) for k in keys], 1)
    named = batch.schema.names

    def values(name):
        if name not in named:
            return None
        return batch.column(name).take(pa.array(rows))

    block.meet(matrix, key_columns, values("category"), values("cell"))


def of_categories(store: DataFrame, block: pa.Table, buckets=None) -> DataFrame:
    """The store's rows of the categories asked for, where every question of the pass names one.

    Names are joined as a broadcast, which the pass bounds; the scan gets a few of them as literals and many as their
    range. With `buckets`, the array of buckets that may hold a category, the store is also joined to these: Spark then
    prunes its directories at run time, however many categories there are.
    """
    if not block.num_rows or block.column("category").null_count:
        return store
    spark, names = store.sparkSession, pc.unique(block.column("category"))
    if len(names) <= LITERAL_NAMES:
        store = store.where(F.col("category").isin(names.to_pylist()))
    else:
        ends = pc.min_max(names).as_py()
        store = store.where(F.col("category").between(ends["min"], ends["max"]))
    named = spark.createDataFrame(pa.table({"category": names}))
    if len(names) > LITERAL_NAMES:
        store = store.join(F.broadcast(named), "category", "left_semi")
    if buckets is None or "bucket" not in store.columns:
        return store
    # a table with a filter on it is what Spark's dynamic partition pruning looks for
    held = staged(named.select(F.explode(buckets(F.col("category"))).alias("bucket")).distinct(), "buckets")
    return store.join(F.broadcast(held.where("bucket >= 0")), "bucket", "left_semi")


def scan_shape(block: pa.Table, spark, tasks: int | None) -> tuple[int, int]:
    """(groups of the questions of a pass, scan tasks for each)."""
    tasks = tasks or TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    groups = max(1, -(-block.num_rows // GROUP_QUESTIONS))
    return groups, max(1, -(-tasks // groups))


def in_groups(store: DataFrame, block: pa.Table, schema: T.StructType, tasks: int | None, search):
    """(what search(questions, batches) finds for each group of the pass in a scan of its own, the broadcast)."""
    spark = store.sparkSession
    groups, tasks = scan_shape(block, spark, tasks)
    size = max(1, -(-block.num_rows // groups))
    shared = spark.sparkContext.broadcast(block)

    def scan(number):
        own = lambda batches: search(shared.value.slice(number * size, size), batches)
        return store.coalesce(tasks).mapInArrow(own, schema)

    return reduce(DataFrame.unionAll, (scan(number) for number in range(groups))), shared


def _scan(store: DataFrame, block: pa.Table, keys, schema: T.StructType, tasks, buckets=None):
    """(partial top-k per task, the broadcast) of the questions of one pass."""
    names = list(keys) + ["embedding"]
    if block.column("category").null_count < block.num_rows:
        names.append("category")
    store = of_categories(store, block, buckets)
    if "cells" in block.column_names:
        names.append("cell")
        probed = pc.unique(block.column("cells").combine_chunks().flatten()).to_pylist()
        store = store.where(F.col("cell").isin(probed))
    elif block.num_rows > GROUP_QUESTIONS and not block.column("category").null_count:
        store = staged(packed(store.select(*names)), "scanned", compression="zstd")

    def search(asked, batches):
        blocks = question_blocks(asked, len(keys))
        for batch in batches:
            for block in blocks:
                _meet_batch(block, batch, keys)
        for block in blocks:
            yield block.results(keys)

    return in_groups(store.select(*names), block, schema, tasks, search)


def _row_bytes(asked: DataFrame) -> Column:
    """About what a question takes in a broadcast."""
    held = [F.size(name) for name in ("vector", "cells") if name in asked.columns]
    sizes = [F.coalesce(size, F.lit(0)).cast("long") * 8 for size in held]
    return sum(sizes, F.lit(64) + F.coalesce(F.octet_length("category"), F.lit(0)))


def merge_candidates(
    candidates: DataFrame, keys, most: int, scored: bool = False, lists: int | None = None
) -> DataFrame:
    """TOP-1/TOP-2: merges partial lists to `rank` 1..top_k per question; `scored` keeps top_k and the score, so that
    the lists can be merged with others. `lists`: how many of them a question has at most, where that is known.

    Ordered by the score at nine decimals, ties by record id. Many lists are first cut by slices of a
    question's rows; the constant bound lets Spark prune before each shuffle.
    """
    order = [F.round("score", ROUND_RANK).desc(), F.col(keys[0])]
    in_slice = Window.partitionBy("query_id", "slice").orderBy(*order)
    overall = Window.partitionBy("query_id").orderBy(*order)
    if lists is None or lists * most > MERGE_ROWS:
        candidates = (
            candidates.withColumn("slice", F.pmod(F.xxhash64(keys[0]), F.lit(MERGE_SLICES)))
            .withColumn("rank", F.row_number().over(in_slice))
            .where(F.col("rank") <= most)
        )
    return (
        candidates.withColumn("rank", F.row_number().over(overall))
        .where((F.col("rank") <= most) & (F.col("rank") <= F.col("top_k")))
        .select(
            "query_id",
            "rank",
            *keys,
            F.round(similarity(F.lit(1.0) - F.col("score")), ROUND_OUT).alias("similarity"),
            *(("top_k", "score") if scored else ()),
        )
    )


def list_schema(questions: DataFrame, keys) -> T.StructType:
    """Rows that a scan task hands on."""
    fields = [("query_id", questions.schema["query_id"].dataType), ("top_k", T.IntegerType())]
    fields += [(key, T.LongType()) for key in keys] + [("score", T.DoubleType())]
    return T.StructType([T.StructField(*field) for field in fields])


def in_passes(asked: DataFrame, pass_questions: int, search) -> DataFrame:
    """Measures the questions, deals them into passes and runs search(questions, their Arrow table, the largest top_k),
    which returns (found rows, the broadcast), for each."""
    n, held, most = asked.agg(
        F.count("*"), F.coalesce(F.sum(_row_bytes(asked)), F.lit(0)), F.max("top_k")
    ).first()
    most = most or DEFAULT_TOP_K
    passes = max(1, -(-n // pass_questions), -(-held // PASS_BYTES))
    if passes == 1:
        return search(asked, asked.toArrow(), most)[0]
    dealt = asked.withColumn("pass", F.pmod(F.xxhash64("query_id"), F.lit(passes)))
    dealt = staged(dealt, "asked")
    path = work_path(asked.sparkSession, "passes")
    for number in range(passes):
        part = dealt.where(F.col("pass") == number).drop("pass")
        found, shared = search(part, part.toArrow(), most)
        found.write.parquet(f"{path}/pass={number}")
        shared.destroy()
    return asked.sparkSession.read.schema(found.schema).parquet(path).select(*found.columns)


def top_k(
    store: DataFrame,
    questions: DataFrame,
    keys=("record_id",),
    tasks: int | None = None,
    pass_questions: int = PASS_QUESTIONS,
    scored: bool = False,
    buckets=None,
) -> DataFrame:
    """JN-1, TOP-1, TOP-2, FLT-5, FLT-6: (query_id, rank, *keys, similarity).

    A question with a category meets only rows of that category. Questions with a `cells` array
    meet only store rows of those cells (operators/cells.py).
    `keys`: integer columns naming a store row; the first breaks ties.
    `tasks`: number of scan tasks at most, a few per core by default. A task hands on its lists
    once, so fewer and longer tasks than one per file split mean less to merge.
    `pass_questions`: about how many questions one broadcast takes. The questions are
    measured first; where they need several passes, these run one after another, each writes its
    lists to the work folder and gives its broadcast back.
    `scored`: adds the columns top_k and score.
    `buckets`: the store layout's buckets_of, for a store with a `bucket` column.
    """
    asked = with_defaults(questions)
    schema = list_schema(questions, keys)

    held = []

    def source(block):
        """The store; what a scan needs of it as files of their own where several read all of it or its cells, so that
        the joins of a saved store, say, run once and its vectors are taken apart once."""
        celled = "cells" in block.column_names
        if block.num_rows <= GROUP_QUESTIONS or not celled and not block.column("category").null_count:
            return store
        if not held:
            names = [c for c in (*keys, "category", "embedding", *(["cell"] if celled else [])) if c in store.columns]
            read = store.select(*names)
            if celled:
                probed = asked.select(F.explode("cells").alias("cell")).distinct().collect()  # at most one row per cell
                read = read.where(F.col("cell").isin([r["cell"] for r in probed]))
            held.append(staged(packed(read), "scanned", by=["cell"] if celled else (), compression="zstd"))
        return held[0]

    def search(_, block, most):
        part, shared = _scan(source(block), block, keys, schema, tasks, buckets)
        lists = scan_shape(block, store.sparkSession, tasks)[1]
        return merge_candidates(part, keys, most, scored, lists), shared

    return in_passes(asked, pass_questions, search)


def top_k_single(
    store: DataFrame,
    vector: list[float],
    k: int = DEFAULT_TOP_K,
    category: str | None = None,
    min_similarity: float = DEFAULT_MIN_SIMILARITY,
) -> DataFrame:
    """One question against the store, in Spark expressions: a take-ordered scan.

    The category becomes a pushed-down equality, present only when one is given.
    """
    if category is not None and category.strip():
        store = store.where(F.col("category") == category.strip())
    question = F.lit([float(x) for x in vector])
    norms = {"norm_b": F.col("norm")} if "norm" in store.columns else {}
    distance = cosine_distance(question, F.col("embedding"), l2_norm(question), **norms)
    scored = store.where(F.col("embedding").isNotNull()).withColumn("distance", distance)
    return (
        scored.withColumn("similarity", similarity(F.col("distance")))
        .where(passes_floor(F.col("similarity"), F.lit(min_similarity)))
        .orderBy(F.round("distance", ROUND_RANK), "record_id")
        .limit(k)
        .select(
            "record_id",
            *(text.alias(name) for name, text in hit_text().items()),
            F.round("similarity", ROUND_OUT).alias("similarity"),
        )
    )


def hit_text() -> dict[str, Column]:
    """PRJ-4: the passage columns of a hit, null text as ''."""
    return {name: F.coalesce(F.col(name), F.lit("")) for name in ("category", "chunk_text")}


def attach_passages(hits: DataFrame, store: DataFrame, keys=("record_id",)) -> DataFrame:
    """Late lookup of category and text for the few rows that won.

    With `bucket` among the keys only the buckets that hold hits are read. Counts the hits: where
    they fit one broadcast the store is scanned and not shuffled. Pass staged hits, or the search
    runs once more for the count.
    """
    if "bucket" in keys:
        # at most one row per bucket of the layout
        buckets = [row["bucket"] for row in hits.select("bucket").distinct().collect()]
        store = store.where(F.col("bucket").isin(buckets))
    passages = store.select(*keys, *(c.alias(n) for n, c in hit_text().items()))
    return passages.join(broadcast_if_small(hits), list(keys)).select(
        "query_id", "rank", "record_id", "category", "chunk_text", "similarity"
    )
