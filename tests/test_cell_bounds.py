import numpy as np
import pytest
from pyspark.sql import functions as F

from groundwell.operators import cell_bounds as B
from groundwell.operators.cell_bounds import bounded_cells, bounded_top_k, cell_bounds, highest, still_open
from groundwell.operators.cells import assign_cells, train_centroids
from groundwell.operators.similarity import top_k
from groundwell.session import staged
from groundwell.sources.store import read_cells, write_cells
from tests.conftest import SMALL, plan_of

SCHEMA = "record_id long, category string, embedding array<float>"


def rows(frame):
    return sorted(map(tuple, frame.collect()))


@pytest.fixture(scope="module")
def given(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    store = table.selectExpr("vec_id as record_id", "cast(label as string) as category", "embedding")
    asked = table.selectExpr(
        "vec_id as query_id",
        "embedding as vector",
        "cast(vec_id % 50 + 1 as int) as top_k",
        "case when vec_id % 3 != 0 then cast(label as string) end as category",
        "case when vec_id % 7 = 0 then 0.35 else 0 end as min_similarity",
    )
    return store, asked


@pytest.fixture(scope="module")
def clustered(spark):
    """40 clusters of 50 rows each, in 16 dimensions."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    points = centres[np.arange(2000) % 40] + 0.08 * rng.normal(size=(2000, 16))
    data = [(i, f"c{i % 3}", p.tolist()) for i, p in enumerate(points)]
    return spark.createDataFrame(data, SCHEMA).cache()


def test_no_row_beats_its_bound():
    rng = np.random.default_rng(1)
    for width in (2, 3, 50):
        centre, question = (v / np.linalg.norm(v) for v in rng.normal(size=(2, width)))
        held = centre + 0.7 * rng.random((300, 1)) * rng.normal(size=(300, width))
        held /= np.linalg.norm(held, axis=1)[:, None]
        for some in (held[:1], held[:20], held, centre[None], -question[None]):
            bound = highest(np.array([question @ centre]), np.array([(some @ centre).min()]))
            assert (some @ question).max() <= bound[0]


@pytest.mark.parametrize("most", [130, 10_000])
def test_equal_to_the_exact_search(spark, given, most):
    store, asked = given
    centroids = train_centroids(store, 12)
    celled = assign_cells(store, centroids).cache()
    found = bounded_top_k(celled, asked, centroids, cell_bounds(celled, centroids), pass_questions=most)
    assert rows(found) == rows(top_k(store, asked))


def test_wider_bounds_are_as_safe(spark, given, monkeypatch):
    """Too many categories for a small table: the bounds over all categories serve."""
    monkeypatch.setattr(B, "CENTROID_BYTES", 31)
    monkeypatch.setattr(B, "_centroid_matrix", lambda c: (np.arange(c.count()), B.unit_rows(c.orderBy("cell").toArrow().column("centroid").combine_chunks())[1]))
    store, asked = given
    centroids = train_centroids(store, 12)
    celled = assign_cells(store, centroids).cache()
    found = bounded_top_k(celled, asked.limit(60), centroids, cell_bounds(celled, centroids))
    assert rows(found) == rows(top_k(store, asked.limit(60)))


def test_clustered_vectors_skip_most_cells(spark, clustered, tmp_path):
    """The two searches of a question together read under a quarter of the cells, each as a partition filter."""
    centroids = train_centroids(clustered, 40, "kmeans")
    path = str(tmp_path / "cells")
    celled = assign_cells(clustered, centroids)
    write_cells(celled, path)
    stored = read_cells(spark, path, celled.schema)
    asked = clustered.where("record_id % 20 = 0").selectExpr("record_id as query_id", "embedding as vector", "10 as top_k")
    bounds = staged(cell_bounds(stored, centroids), "bounds")
    assert rows(bounded_top_k(stored, asked, centroids, bounds)) == rows(top_k(clustered, asked))
    chosen = staged(bounded_cells(asked, bounds, centroids), "chosen")
    first = top_k(stored, chosen.drop("others"), scored=True)
    read = sum(len(r["cells"]) for f in (chosen, still_open(chosen, first)) for r in f.select("cells").collect())
    share = read / (asked.count() * centroids.count())
    print(f"cells read: {share:.3f}")
    assert share < 0.25
    one = chosen.where("query_id = 0").drop("others")
    assert "cell" in plan_of(top_k(stored, one)).split("PartitionFilters: [")[1].split("]")[0]


def test_short_lists_floors_and_unusable_vectors(spark):
    data = [(i, "a" if i % 2 else "b", [float(i % 7) - 3, 1.0]) for i in range(40)]
    data += [(90, "a", None), (91, "a", [0.0, 0.0]), (92, None, [1.0, 0.5])]
    store = spark.createDataFrame(data, SCHEMA)
    asked = [(1, [1.0, 0.0], 30, "a", 0.0), (2, [1.0, 0.0], 50, None, 0.9), (3, [-1.0, -1.0], 45, None, 0.0)]
    asked += [(4, [0.0, 0.0], 5, None, 0.0), (5, None, 5, "a", 0.0), (6, [1.0, 1.0], 5, "none", 0.0), (7, [0.0, 1.0], 3, "b", 0.999)]
    questions = spark.createDataFrame(asked, "query_id long, vector array<float>, top_k int, category string, min_similarity double")
    centroids = train_centroids(store, 4)
    celled = assign_cells(store, centroids).cache()
    bounds = cell_bounds(celled, centroids)
    assert bounds.agg(F.sum("n")).first()[0] == 41
    assert rows(bounded_top_k(celled, questions, centroids, bounds)) == rows(top_k(store, questions))
    assert bounded_top_k(celled, questions.limit(0), centroids, bounds).count() == 0
