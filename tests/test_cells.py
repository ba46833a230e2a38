import numpy as np
import pytest

from groundwell.operators import cells as C
from groundwell.operators.cells import (
    approx_top_k,
    assign_cells,
    cell_population,
    choose_cells,
    train_centroids,
)
from groundwell.operators.similarity import top_k
from groundwell.sources.store import read_cells, read_population, write_cells
from tests.conftest import SMALL, plan_of


@pytest.fixture(scope="module")
def frames(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    store = table.selectExpr("vec_id as record_id", "cast(label as string) as category", "embedding")
    asked = table.selectExpr(
        "vec_id as query_id",
        "embedding as vector",
        "cast(vec_id % 50 + 1 as int) as top_k",
        "case when vec_id % 2 = 0 then cast(label as string) end as category",
    )
    return store, asked


def rows(frame):
    return sorted(map(tuple, frame.collect()))


@pytest.mark.parametrize("method", ["sample", "kmeans"])
@pytest.mark.parametrize("most", [30, 1000])
def test_every_cell_is_exact(spark, frames, method, most):
    store, asked = frames
    centroids = train_centroids(store, 12, method)
    celled = assign_cells(store, centroids).cache()
    found = approx_top_k(celled, asked, centroids, 10**9, pass_questions=most)
    assert rows(found) == rows(top_k(store, asked))


def test_recall_grows_and_lists_are_full(spark, frames):
    store, asked = frames
    exact = {(r[0], r[2]) for r in rows(top_k(store, asked))}
    full = {}
    for q, *_ in exact:
        full[q] = full.get(q, 0) + 1
    centroids = train_centroids(store, 12)
    celled = assign_cells(store, centroids).cache()
    recall = []
    for breadth in (1, 100, 400):
        found = rows(approx_top_k(celled, asked, centroids, breadth))
        count = {}
        for q, *_ in found:
            count[q] = count.get(q, 0) + 1
        assert count == full
        recall.append(len({(r[0], r[2]) for r in found} & exact) / len(exact))
    assert recall[0] < recall[1] < recall[2] and recall[2] > 0.9


def test_cells_on_disk_are_a_partition_filter(spark, frames, tmp_path):
    store, asked = frames
    centroids = train_centroids(store, 12)
    path = str(tmp_path / "cells")
    celled = assign_cells(store, centroids)
    write_cells(celled, path)
    stored = read_cells(spark, path, celled.schema)
    few = asked.where("query_id = 3")
    plan = plan_of(approx_top_k(stored, few, centroids, 20))
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "cell" in filters
    assert rows(approx_top_k(stored, asked, centroids, 60)) == rows(
        approx_top_k(celled, asked, centroids, 60)
    )


def test_unusable_vectors_get_no_cell(spark):
    store = spark.createDataFrame(
        [(1, "a", [1.0, 0.0]), (2, "a", [0.0, 0.0]), (3, "a", None), (4, "a", [0.0, 1.0])],
        "record_id long, category string, embedding array<float>",
    )
    centroids = train_centroids(store, 2)
    celled = {r["record_id"]: r["cell"] for r in assign_cells(store, centroids).collect()}
    assert celled[2] is None and celled[3] is None and {celled[1], celled[4]} == {0, 1}


def test_hot_cell_in_several_passes(spark):
    """Two thirds of the rows in one cell, and every question visits it."""
    rng = np.random.default_rng(1)
    data = [(i, "a", ([1.0, 0.0] if i % 3 else rng.normal(size=2).tolist())) for i in range(300)]
    store = spark.createDataFrame(data, "record_id long, category string, embedding array<float>")
    asked = store.limit(60).selectExpr("record_id as query_id", "embedding as vector", "7 as top_k")
    centroids = train_centroids(store, 4)
    celled = assign_cells(store, centroids).cache()
    assert rows(approx_top_k(celled, asked, centroids, 50, pass_questions=10)) == rows(
        approx_top_k(celled, asked, centroids, 50)
    )


def test_the_written_population_spares_the_count(spark, frames, tmp_path, monkeypatch):
    store, asked = frames
    centroids = train_centroids(store, 12)
    celled, path = assign_cells(store, centroids), str(tmp_path / "cells")
    write_cells(celled, path)
    stored = read_cells(spark, path, celled.schema)
    counted = rows(approx_top_k(stored, asked, centroids, 30))
    monkeypatch.setattr(C, "cell_population", None)
    known = read_population(spark, path)
    assert rows(approx_top_k(stored, asked, centroids, 30, population=known)) == counted


def test_centroids_over_the_bound_are_refused(spark, frames, monkeypatch):
    monkeypatch.setattr(C, "CENTROID_BYTES", 100)
    with pytest.raises(ValueError):
        train_centroids(frames[0], 12)


def test_breadth_counts_the_category_only(spark, frames):
    store, asked = frames
    centroids = train_centroids(store, 12)
    celled = assign_cells(store, centroids).cache()
    sizes = {(r["category"], r["cell"]): r["count"] for r in celled.groupBy("category", "cell").count().collect()}
    for r in choose_cells(asked, cell_population(celled), centroids, 30).where("category is not null").collect():
        own = sum(sizes.get((r["category"], c), 0) for c in r["cells"])
        total = sum(n for (cat, _), n in sizes.items() if cat == r["category"])
        assert own >= min(max(30, r["top_k"]), total)


def test_cells_are_zstd_files(spark, frames, tmp_path):
    store, _ = frames
    write_cells(assign_cells(store, train_centroids(store, 3)), str(tmp_path / "cells"))
    files = list((tmp_path / "cells").glob("cell=*/*.parquet"))
    assert files and all(file.name.endswith(".zstd.parquet") for file in files)
