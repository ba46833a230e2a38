"""Approximate top-k over an inverted-file layout of the store (TOP-3).

Each store row belongs to the cell of its nearest centroid. A question visits cells in order of
centroid similarity until they hold at least max(breadth, top_k) rows - rows of its own category,
when it has one - so it never gets fewer than top_k rows because of the breadth alone. The visited
rows are then ranked exactly. With enough breadth to visit every cell the result is the exact one.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundwell.functions.vectors import ROUND_RANK
from groundwell.operators.similarity import PASS_QUESTIONS, top_k, unit_rows, with_defaults
from groundwell.schemas import SEARCH_BREADTH
from groundwell.session import broadcast_if_small, staged

# Bound of the broadcast centroid matrix, and of one block of centroid scores inside a task.
CENTROID_BYTES = 256 * 1024 * 1024
SCORE_CELLS = 4 * 1024 * 1024
KMEANS_ROWS = 64


def train_centroids(
    store: DataFrame,
    cells: int,
    method: str = "sample",
    seed: int = 7,
    rows_per_cell: int = KMEANS_ROWS,
) -> DataFrame:
    """(cell, centroid): `cells` sampled store vectors, or k-means centres over a sample.

    The sample is the usable rows with the lowest hash of their id, so it does not change between
    runs; each task keeps `cells` rows of the ordered cut at most. K-means takes about
    `rows_per_cell` usable rows per cell. A store without a usable vector raises ValueError.
    """
    width = store.select(F.size("embedding")).where(F.col("embedding").isNotNull()).first()
    if width is not None and cells * width[0] * 4 > CENTROID_BYTES:
        raise ValueError("the centroids would be over the broadcast bound; use fewer cells")
    draws = store.select(
        "embedding", F.md5(F.col("record_id").cast("string")).alias("draw")
    ).where(F.exists("embedding", lambda x: x != 0))
    if method == "kmeans":
        share = rows_per_cell * cells / max(draws.count(), 1)
        if share < 1.0:
            draws = draws.where(F.col("draw") < f"{int(share * 16**8):08x}")
        return _kmeans(draws, cells, seed)
    drawn = draws.orderBy("draw").limit(cells).select("embedding").collect()
    if not drawn:
        raise ValueError("the store has no usable vector to take centroids from")
    return _centroid_table(store, [row["embedding"] for row in drawn])


def _centroid_table(store: DataFrame, vectors: list) -> DataFrame:
    """At most `cells` vectors, numbered, as a local table."""
    rows = [(cell, [float(x) for x in vector]) for cell, vector in enumerate(vectors)]
    return store.sparkSession.createDataFrame(rows, "cell int, centroid array<float>")


def _kmeans(draws: DataFrame, cells: int, seed: int) -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    features = draws.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("f"))
    model = KMeans(k=cells, seed=seed, featuresCol="f", distanceMeasure="cosine").fit(features)
    return _centroid_table(draws, model.clusterCenters())


def _centroid_matrix(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(cell numbers, unit centroids), refused when over the broadcast bound."""
    table = centroids.orderBy("cell").toArrow()
    if table.nbytes > CENTROID_BYTES:
        raise ValueError("the centroids are over the broadcast bound; use fewer cells")
    rows, matrix = unit_rows(table.column("centroid").combine_chunks())
    return table.column("cell").to_numpy()[rows], matrix


def _rounded_scores(vectors: np.ndarray, centroids: np.ndarray):
    """(first row, centroid scores) block by block, within a bounded number of scores."""
    step = max(1, SCORE_CELLS // max(len(centroids), 1))
    for start in range(0, len(vectors), step):
        yield start, np.round(vectors[start : start + step] @ centroids.T, ROUND_RANK)


def assign_cells(store: DataFrame, centroids: DataFrame) -> DataFrame:
    """Adds `cell`, the number of the nearest centroid (ties to the lower number), without a shuffle.

    Rows without a usable vector get a null cell and are never visited.
    """
    shared = store.sparkSession.sparkContext.broadcast(_centroid_matrix(centroids))

    def assign(batches):
        numbers, matrix = shared.value
        for batch in batches:
            rows, vectors = unit_rows(batch.column("embedding"), matrix.shape[1])
            cell = np.zeros(batch.num_rows, np.int32)
            missing = np.ones(batch.num_rows, bool)
            missing[rows] = False
            for start, scores in _rounded_scores(vectors, matrix):
                cell[rows[start : start + len(scores)]] = numbers[scores.argmax(axis=1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell, mask=missing)], names=[*batch.schema.names, "cell"]
            )

    schema = T.StructType(list(store.schema.fields)).add("cell", T.IntegerType())
    return store.mapInArrow(assign, schema)


def cell_population(store: DataFrame) -> DataFrame:
    """(cell, category, n): the rows of each cell by category, kept beside the cells by write_cells."""
    placed = store.where(F.col("cell").isNotNull())
    return placed.groupBy("cell", "category").agg(F.count("*").alias("n"))


def choose_cells(
    questions: DataFrame, population: DataFrame, centroids: DataFrame, breadth: int = SEARCH_BREADTH
) -> DataFrame:
    """Adds `cells`, the cells each question visits; reads the population and not the store.

    The breadth of a filtered question counts only rows it may return: cell sizes are counted for
    the categories asked for as well.
    """
    asked = with_defaults(questions)
    totals = population.groupBy("cell").agg(F.sum("n").alias("n"))
    overall = {r["cell"]: r["n"] for r in totals.collect()}
    named = broadcast_if_small(asked.select("category").where("category IS NOT NULL").distinct())
    of_category = (
        population.join(named, "category", "left_semi")
        .groupBy("category")
        .agg(F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("sizes"))
    )
    # Questions without a category stay out of the join, where they would all meet in one task.
    free = asked.where("category IS NULL").withColumn("sizes", F.lit(None).cast("map<int,bigint>"))
    filtered = asked.where("category IS NOT NULL").join(of_category, "category", "left")
    asked = free.unionByName(filtered)
    numbers, matrix = _centroid_matrix(centroids)
    totals = np.array([overall.get(int(c), 0) for c in numbers])
    shared = asked.sparkSession.sparkContext.broadcast((numbers, matrix, totals))

    def choose(batches):
        numbers, matrix, totals = shared.value
        place = {int(c): i for i, c in enumerate(numbers)}
        for batch in batches:
            chosen = [[] for _ in range(batch.num_rows)]
            top = batch.column("top_k").to_numpy()
            filtered = batch.column("category").is_valid().to_pylist()
            by_category = batch.column("sizes")
            rows, vectors = unit_rows(batch.column("vector"), matrix.shape[1])
            for start, scores in _rounded_scores(vectors, matrix):
                order = np.argsort(-scores, axis=1, kind="stable")
                for row, nearest in zip(rows[start : start + len(scores)], order):
                    size = totals
                    if filtered[row]:
                        size = np.zeros(len(numbers), int)
                        for cell, n in by_category[row].as_py() or []:
                            size[place[cell]] = n
                    before = np.cumsum(size[nearest]) - size[nearest]
                    visited = nearest[(before < max(breadth, top[row])) & (size[nearest] > 0)]
                    chosen[row] = numbers[visited].tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in kept] + [pa.array(chosen, pa.list_(pa.int32()))],
                names=[*kept, "cells"],
            )

    kept = ["query_id", "vector", "top_k", "category", "min_similarity"]
    schema = T.StructType([asked.schema[n] for n in kept]).add("cells", T.ArrayType(T.IntegerType()))
    return asked.mapInArrow(choose, schema)


def approx_top_k(
    store: DataFrame,
    questions: DataFrame,
    centroids: DataFrame,
    breadth: int = SEARCH_BREADTH,
    keys=("record_id",),
    tasks: int | None = None,
    population: DataFrame | None = None,
    pass_questions: int = PASS_QUESTIONS,
) -> DataFrame:
    """TOP-3: top-k over the visited cells of a store that has a `cell` column.

    On a store written by sources.store.write_cells the visited cells are a partition filter, and
    `population` (read_population) spares the count of the store's rows by cell. Chosen cells are
    staged: they are measured before they are sent out.
    """
    if population is None:
        population = staged(cell_population(store), "population")
    chosen = staged(choose_cells(questions, population, centroids, breadth), "chosen")
    return top_k(store, chosen, keys, tasks, pass_questions)
