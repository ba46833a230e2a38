"""Top-k from one-byte codes with certified re-ranking (TOP-3).

Beside each row stand a byte per dimension, their scale and a bound on what the bytes are off by: with unit vectors the
score of the bytes differs from the true one by no more than the length of the difference. A scan of the codes, a quarter of
the vectors' bytes, gives each question an interval of scores per row. Rows whose upper end reaches the k-th highest
lower end can be among its k best, and no others can; only these are looked up and scored by their full vectors. So the result is
the exact one whatever the data, and coarse codes cost time and no hits.

As in the exact search the questions go out in bounded passes, the code table is scanned in place, and every task hands on what
can still win among its rows.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundwell.functions.vectors import ROUND_RANK
from groundwell.operators.similarity import (
    BLOCK_QUESTIONS,
    BLOCK_ROWS,
    EXACT_PAIRS,
    MERGE_SLICES,
    PASS_QUESTIONS,
    QuestionBlock,
    in_groups,
    in_passes,
    list_schema,
    merge_candidates,
    of_categories,
    parts_in_reach,
    question_blocks,
    unit_rows,
    with_defaults,
)
from groundwell.session import staged

LEVELS = 127
# Pairs of a pass that may go out as a broadcast.
BROADCAST_PAIRS = 65_536
# Besides the codes' own error: single-precision products and the rounding of ranks.
SLACK_PER_DIMENSION = 2.0**-22
RANK_SLACK = 2 * 10.0**-ROUND_RANK


def encode(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scale, error) of unit vectors: |vector - scale * codes| <= error."""
    scale = np.abs(matrix).max(axis=1, initial=0) / LEVELS
    codes = np.rint(matrix / scale[:, None]).astype(np.int8)
    off = matrix - codes * scale[:, None]
    error = np.sqrt(np.einsum("ij,ij->i", off, off))
    return codes, scale, error + matrix.shape[1] * SLACK_PER_DIMENSION


def code_rows(store: DataFrame, keys=("record_id",)) -> DataFrame:
    """The code table of a store: its keys, category, code (a byte per dimension), scale and error. Rows without a usable vector,
    which no search finds, are left out. Narrow: no shuffle."""
    names = [*keys, "category", "embedding"]

    def coded(batches):
        for batch in batches:
            vectors = batch.column("embedding")
            sizes = np.nan_to_num(vectors.value_lengths().to_numpy(zero_copy_only=False)).astype(int)
            for width in np.unique(sizes[sizes > 0]).tolist():
                rows, matrix = unit_rows(vectors, width)
                codes, scale, error = encode(matrix)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k).take(pa.array(rows)) for k in names[:-1]),
                        pa.array([c.tobytes() for c in codes], pa.binary()),
                        pa.array(scale),
                        pa.array(error),
                    ],
                    names=[*names[:-1], "code", "scale", "error"],
                )

    schema = T.StructType([store.schema[n] for n in names[:-1]])
    schema = schema.add("code", T.BinaryType()).add("scale", "double").add("error", "double")
    return store.select(*names).mapInArrow(coded, schema)


class IntervalBlock(QuestionBlock):
    """Questions with the rows that can still be among their best, as lower and upper ends of scores. Rows come as
    single-precision vectors with the error behind the last dimension."""

    def __init__(self, table: pa.Table, keys: int):
        super().__init__(table, keys)
        self.found = (np.zeros(0, int), np.zeros(0), np.zeros(0), np.zeros((0, keys), int))

    def _score(self, rows, keys, asked) -> None:
        narrow, error = np.ascontiguousarray(rows[:, :-1]), rows[:, -1]
        for q0 in range(0, len(asked), BLOCK_QUESTIONS):
            some = asked[q0 : q0 + BLOCK_QUESTIONS]
            left = self.narrow[some]
            for r0 in range(0, len(rows), BLOCK_ROWS):
                part = slice(r0, r0 + BLOCK_ROWS)
                self._keep_intervals(left @ narrow[part].T, error[part], keys[part], some)

    def _keep_intervals(self, scores, error, keys, asked) -> None:
        if not self.barred[asked].all():
            self._raise(scores - error, asked, 2.0**-23)
        bar = (self.bar[asked] - RANK_SLACK - 2.0**-23).astype(np.float32)
        parts, place, number = parts_in_reach(scores, bar, error.max())
        near = np.flatnonzero(parts + error.reshape(-1, parts.shape[1])[number] >= bar[place, None])
        for start in range(0, len(near), EXACT_PAIRS):
            pairs = near[start : start + EXACT_PAIRS]
            part, row = np.divmod(pairs, parts.shape[1])
            row += number[part] * parts.shape[1]
            middle, off, question = parts.ravel()[pairs].astype(float), error[row].astype(float), asked[place[part]]
            kept = middle + off >= self.bar[question] - RANK_SLACK
            kept &= np.clip(middle + off, 0.0, 1.0) >= self.floor[question]
            if kept.any():
                self._wait(question[kept], (middle - off)[kept], (middle + off)[kept], keys[row[kept]])

    def _settle(self) -> None:
        """Drops the rows whose upper end is below the question's k-th highest lower end."""
        if not self.pending:
            return
        question, lower, upper, keys = (np.concatenate(p) for p in zip(self.found, *self.pending))
        order = np.lexsort((-lower, question))
        question, lower, upper, keys = question[order], lower[order], upper[order], keys[order]
        starts = np.flatnonzero(np.r_[True, question[1:] != question[:-1]])
        rank = np.arange(len(question)) - np.repeat(starts, np.diff(np.r_[starts, len(question)]))
        last = rank == self.top_k[question] - 1
        self.bar[question[last]] = np.maximum(self.bar[question[last]], lower[last])
        keep = upper >= self.bar[question] - RANK_SLACK
        self.found, self.pending, self.waiting = (question[keep], lower[keep], upper[keep], keys[keep]), [], 0

    def intervals(self, names) -> pa.RecordBatch:
        self._settle()
        question, lower, upper, keys = self.found
        return pa.RecordBatch.from_arrays(
            [
                self.ids.take(pa.array(question, pa.int64())),
                pa.array(self.top_k[question], pa.int32()),
                *(pa.array(keys[:, i], pa.int64()) for i in range(keys.shape[1])),
                pa.array(lower, pa.float64()),
                pa.array(upper, pa.float64()),
            ],
            names=["query_id", "top_k", *names, "lower", "upper"],
        )


def scan_codes(codes: DataFrame, block: pa.Table, keys, schema: T.StructType, tasks: int | None):
    """(rows that can win per task, the broadcast) of the questions of one pass."""

    def search(asked, batches):
        blocks = question_blocks(asked, len(keys), IntervalBlock)
        for batch in batches:
            raw = batch.column("code")
            widths = raw.cast(pa.binary()).to_pylist()
            sizes = np.array([len(c) for c in widths])
            for own in blocks:
                if not len(own.ids):
                    continue
                width = own.vectors.shape[1]
                rows = np.flatnonzero(sizes == width)
                if not len(rows):
                    continue
                bytes_of = np.frombuffer(b"".join(widths[r] for r in rows.tolist()), np.int8).reshape(-1, width)
                matrix = np.empty((len(rows), width + 1), np.float32)
                scale = batch.column("scale").to_numpy()[rows]
                matrix[:, :-1] = bytes_of * scale[:, None]
                matrix[:, -1] = batch.column("error").to_numpy()[rows]
                key_columns = np.stack([batch.column(k).to_numpy()[rows].astype(np.int64) for k in keys], 1)
                own.meet(matrix, key_columns, batch.column("category").take(pa.array(rows)))
        for own in blocks:
            yield own.intervals(keys)

    names = [*keys, "category", "code", "scale", "error"]
    return in_groups(codes.select(*names), block, schema, tasks, search)


def survivors(intervals: DataFrame, keys, most: int) -> DataFrame:
    """The rows whose upper end reaches the k-th highest lower end of all tasks' rows. The bars, one a question of the
    pass, are a bounded broadcast."""
    order = [F.col("lower").desc(), F.col(keys[0])]
    dealt = intervals.withColumn("slice", F.pmod(F.xxhash64(keys[0]), F.lit(MERGE_SLICES)))
    best = (
        dealt.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "slice").orderBy(*order)))
        .where(F.col("rank") <= most)
        .withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
        .where((F.col("rank") <= most) & (F.col("rank") == F.col("top_k")))
        .select("query_id", F.col("lower").alias("bar"))
    )
    reached = F.col("bar").isNull() | (F.col("upper") >= F.col("bar") - RANK_SLACK)
    return intervals.join(F.broadcast(best), "query_id", "left").where(reached).drop("bar", "lower", "upper")


class AskedVectors:
    """The unit vectors of a pass's questions by id, one block per width."""

    def __init__(self, table: pa.Table):
        coded = table.column("query_id").combine_chunks().dictionary_encode()
        codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        self.ids, self.order = coded.dictionary, np.argsort(codes, kind="stable")
        known = np.arange(len(self.ids))
        self.first = np.searchsorted(codes[self.order], known)
        self.count = np.searchsorted(codes[self.order], known, "right") - self.first
        self.vectors = table.column("vector").combine_chunks()
        self.floor = table.column("min_similarity").to_numpy()
        self.units = {}

    def of(self, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(places in `ids`, questions): every question of each id."""
        code = pc.index_in(ids, value_set=self.ids).fill_null(-1).to_numpy(zero_copy_only=False)
        place = np.flatnonzero(code >= 0)
        count = self.count[code[place]]
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(place, count), self.order[np.repeat(self.first[code[place]], count) + within]

    def unit(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(place of each question's vector or -1, the unit vectors of this width)."""
        if width not in self.units:
            rows, matrix = unit_rows(self.vectors, width)
            place = np.full(len(self.vectors), -1)
            place[rows] = np.arange(len(rows))
            self.units[width] = place, matrix
        return self.units[width]


def exact_scores(pairs: DataFrame, shared, schema: T.StructType) -> DataFrame:
    """The cosine of each pair (query_id, embedding) with the vector that the pass's broadcast has for the question, where it
    reaches the question's floor; pairs of different widths or without a direction are left out."""
    names = schema.names[:-1]

    def scored(batches):
        asked = AskedVectors(shared.value)
        for batch in batches:
            place, question = asked.of(batch.column("query_id"))
            sizes = np.nan_to_num(batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False)).astype(int)
            for width in np.unique(sizes[sizes > 0]).tolist():
                rows, right = unit_rows(batch.column("embedding"), width)
                own, left = asked.unit(width)
                row = np.full(batch.num_rows, -1)
                row[rows] = np.arange(len(rows))
                both = np.flatnonzero((row[place] >= 0) & (own[question] >= 0))
                score = np.einsum("ij,ij->i", left[own[question[both]]], right[row[place[both]]])
                # the floor, as the exact search has it, on the true score
                kept = np.clip(score, 0.0, 1.0) >= asked.floor[question[both]]
                at = pa.array(place[both[kept]])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(n).take(at) for n in names), pa.array(score[kept])], names=schema.names
                )

    return pairs.select(*names, "embedding").mapInArrow(scored, schema)


def certified_top_k(
    store: DataFrame,
    codes: DataFrame,
    questions: DataFrame,
    keys=("record_id",),
    tasks: int | None = None,
    pass_questions: int = PASS_QUESTIONS,
    buckets=None,
) -> DataFrame:
    """TOP-3: the rows of similarity.top_k, found by way of the store's code table (code_rows with the same keys).

    The rows that can win are staged and the vectors of only these are read, with `bucket` among the keys from the
    buckets that hold them.
    """
    asked = with_defaults(questions)
    lists = list_schema(questions, keys)
    ends = T.StructType(lists.fields[:-1]).add("lower", "double").add("upper", "double")

    def search(_, block, most):
        found, shared = scan_codes(of_categories(codes, block, buckets), block, keys, ends, tasks)
        # the scan's rows are read twice, for the bars and for what reaches them; the scan itself runs once
        left = staged(survivors(staged(found, "intervals"), keys, most), "survivors")
        rows = store.select(*(F.col(k).cast("long").alias(k) for k in keys), "embedding")
        if "bucket" in keys:
            # at most one row per bucket of the layout
            held = [r["bucket"] for r in left.select("bucket").distinct().collect()]
            rows = rows.where(F.col("bucket").isin(held))
        # beyond a few pairs neither side goes through the driver: the vectors meet the pairs in a merge join, and the
        # questions are in the tasks' reach already
        few = left.count() <= BROADCAST_PAIRS
        pairs = rows.join(F.broadcast(left) if few else left.hint("shuffle_merge"), list(keys))
        return merge_candidates(exact_scores(pairs, shared, lists), keys, most), shared

    return in_passes(asked, pass_questions, search)
