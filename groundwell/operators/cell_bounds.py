"""Exact top-k over cells, each question's visit ended by bounds (TOP-1, JN-1).

For each cell and category the smallest cosine of a row to the cell's centroid is kept. All its rows lie within that angle of
the centroid, so the best a question can find there follows from its own angle to the centroid. A question first visits the
most promising cells that hold top_k rows it may return; the k-th score found there ends its visit: of the other cells only those
whose bound still reaches it are read, in a second search. Two searches are enough, as the second one knows all cells
that can matter, and the rows are those of the exact search whatever the data. On the cell layout both
read the directories of the cells visited only.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundwell.functions.vectors import ROUND_RANK
from groundwell.operators.cells import CENTROID_BYTES, SCORE_CELLS, _centroid_matrix
from groundwell.operators.similarity import PASS_QUESTIONS, merge_candidates, top_k, unit_rows, with_defaults
from groundwell.session import broadcast_if_small, staged

# Angles near zero are known to about the root of a double's precision only.
BOUND_SLACK = 1e-7


def cell_bounds(celled: DataFrame, centroids: DataFrame) -> DataFrame:
    """(cell, category, n, nearest): rows and smallest cosine to the centroid, by cell and category."""
    shared = celled.sparkSession.sparkContext.broadcast(_centroid_matrix(centroids))

    def cosines(batches):
        numbers, matrix = shared.value
        place = np.full(int(numbers.max(initial=0)) + 1, -1)
        place[numbers] = np.arange(len(numbers))
        for batch in batches:
            rows, vectors = unit_rows(batch.column("embedding"), matrix.shape[1])
            cell = batch.column("cell").take(pa.array(rows)).to_numpy(zero_copy_only=False).astype(int)
            score = np.einsum("ij,ij->i", vectors, matrix[place[cell]])
            category = batch.column("category").take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), category, pa.array(score)], names=["cell", "category", "score"])

    placed = celled.where(F.col("cell").isNotNull()).select("cell", "category", "embedding")
    rows = placed.mapInArrow(cosines, "cell int, category string, score double")
    return rows.groupBy("cell", "category").agg(F.count("*").alias("n"), F.min("score").alias("nearest"))


def highest(cosine: np.ndarray, nearest: np.ndarray) -> np.ndarray:
    """The highest cosine a question at `cosine` from a centroid can have with rows that are at `nearest` from it or closer."""
    apart = np.arccos(np.clip(cosine, -1.0, 1.0)) - np.arccos(np.clip(nearest, -1.0, 1.0))
    return np.cos(np.maximum(apart, 0.0)) + BOUND_SLACK


def _by_cell(bounds: DataFrame, place: dict, known: int):
    """(rows, smallest cosine) per cell of a few rows of bounds."""
    n, nearest = np.zeros(known, np.int64), np.ones(known)
    for r in bounds:
        k = place[r["cell"]]
        n[k] += r["n"]
        nearest[k] = min(nearest[k], r["nearest"])
    return n, nearest


def bounded_cells(questions: DataFrame, bounds: DataFrame, centroids: DataFrame) -> DataFrame:
    """Adds `cells`, those visited first, and `others`, array<struct<cell, bound>>: the rest, as far as they hold rows
    the question may return and may reach its floor.

    The bounds of the categories asked for go out as one small table where they are few enough; else the cells' bounds over all
    categories serve, which are wider and as safe.
    """
    asked = with_defaults(questions)
    numbers, matrix = _centroid_matrix(centroids)
    place = {int(c): i for i, c in enumerate(numbers)}
    totals = bounds.groupBy("cell").agg(F.sum("n").alias("n"), F.min("nearest").alias("nearest"))
    overall = _by_cell(totals.collect(), place, len(numbers))
    named = asked.select("category").where("category IS NOT NULL").distinct()
    wanted = staged(bounds.join(broadcast_if_small(named), "category", "left_semi"), "bounds")
    own = None
    if wanted.count() * 32 <= CENTROID_BYTES:
        own = {}
        for r in wanted.toLocalIterator():
            own.setdefault(r["category"], []).append(r)
        own = {c: _by_cell(rows, place, len(numbers)) for c, rows in own.items()}
    shared = asked.sparkSession.sparkContext.broadcast((numbers, matrix, overall, own))
    nothing = (np.zeros(len(numbers), np.int64), np.ones(len(numbers)))

    def choose(batches):
        numbers, matrix, overall, own = shared.value
        for batch in batches:
            first, others = [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)]
            top, floor = batch.column("top_k").to_numpy(), batch.column("min_similarity").to_numpy()
            category = batch.column("category").to_pylist()
            rows, vectors = unit_rows(batch.column("vector"), matrix.shape[1])
            step = max(1, SCORE_CELLS // max(1, len(numbers)))
            for start in range(0, len(rows), step):
                scores = vectors[start : start + step] @ matrix.T
                for row, score in zip(rows[start : start + step].tolist(), scores):
                    n, nearest = overall if category[row] is None or own is None else own.get(category[row], nothing)
                    bound = highest(score, nearest)
                    able = np.flatnonzero((n > 0) & ((floor[row] <= 0) | (bound >= floor[row])))
                    able = able[np.argsort(-bound[able], kind="stable")]
                    before = np.cumsum(n[able]) - n[able]
                    visited = int((before < top[row]).sum())
                    first[row] = numbers[able[:visited]].tolist()
                    others[row] = [(int(numbers[c]), float(bound[c])) for c in able[visited:]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in kept] + [pa.array(first, pa.list_(pa.int32())), pa.array(others, pa.list_(pair))],
                names=[*kept, "cells", "others"],
            )

    kept = ["query_id", "vector", "top_k", "category", "min_similarity"]
    pair = pa.struct([("cell", pa.int32()), ("bound", pa.float64())])
    other = T.StructType().add("cell", "integer").add("bound", "double")
    schema = T.StructType([asked.schema[n] for n in kept]).add("cells", T.ArrayType(T.IntegerType())).add("others", T.ArrayType(other))
    return asked.mapInArrow(choose, schema)


def still_open(asked: DataFrame, first: DataFrame) -> DataFrame:
    """The questions that have cells left after the lists of the first visit, with these cells."""
    kth = F.col("kth") - 2 * 10.0**-ROUND_RANK  # the k-th score, where a list is full
    full = first.where(F.col("rank") == F.col("top_k")).select("query_id", F.col("score").alias("kth"))
    left = F.filter("others", lambda c: F.col("kth").isNull() | (c["bound"] >= kth))
    # rows below the k-th score need not be handed on; a floor of zero lets negative cosines in and stays
    floor = F.greatest(F.col("min_similarity"), F.coalesce(kth, F.lit(0.0)))
    reached = asked.drop("cells").join(full, "query_id", "left")
    return reached.select(
        "query_id", "vector", "top_k", "category", floor.alias("min_similarity"), left["cell"].alias("cells")
    ).where(F.size("cells") > 0)


def bounded_top_k(
    store: DataFrame,
    questions: DataFrame,
    centroids: DataFrame,
    bounds: DataFrame,
    keys=("record_id",),
    tasks: int | None = None,
    pass_questions: int = PASS_QUESTIONS,
) -> DataFrame:
    """The rows of similarity.top_k over a store with a `cell` column, reading the cells that can hold them."""
    chosen = staged(bounded_cells(questions, bounds, centroids), "chosen")
    asked = chosen.where(F.size("cells") > 0)
    first = staged(top_k(store, asked.drop("others"), keys, tasks, pass_questions, scored=True), "first")
    again = staged(still_open(asked, first), "again")
    second = top_k(store, again, keys, tasks, pass_questions, scored=True)
    most = chosen.agg(F.max("top_k")).first()[0] or 1
    columns = ["query_id", "top_k", *keys, "score"]
    return merge_candidates(first.select(*columns).unionByName(second.select(*columns)), keys, most, lists=2)
