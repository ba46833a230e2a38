import pytest
from pyspark.sql import functions as F

from groundwell.operators.codes import certified_top_k, code_rows
from groundwell.operators.similarity import top_k
from groundwell.session import staged
from groundwell.sources.store import Layout, append_chunks, read_store, replace_and_insert, store_rows
from tests.conftest import SMALL, plan_of

LAYOUT = Layout(category_slots=32, text_slots=4)
KEYS = ("record_id", "bucket")


def passages(spark, categories):
    rows = spark.range(4 * categories).selectExpr(
        f"concat('c', id % {categories}) AS category",
        "id AS doc_id",
        "0 AS chunk_index",
        "concat('text ', id) AS chunk_text",
        "array(cast(id % 17 - 8 AS float), cast(id % 5 AS float), 1f) AS embedding",
    )
    return store_rows(rows, LAYOUT)


def questions(spark, categories, n):
    return spark.range(n).selectExpr(
        "id AS query_id", f"concat('c', id * 3 % {categories}) AS category", "array(1f, cast(id % 7 AS float), -1f) AS vector"
    )


def rows(frame):
    return sorted(map(tuple, frame.collect()))


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pruned") / "store")
    append_chunks(passages(spark, 3000), path)
    replace_and_insert(spark, path, passages(spark, 3000).where("doc_id < 40"), LAYOUT)
    return read_store(spark, path, layout=LAYOUT)


@pytest.mark.parametrize("n", [3, 2500])
def test_buckets_are_pruned_by_the_questions(spark, store, n):
    """A few categories or thousands of them: a partition filter on the bucket that comes from the questions."""
    asked = questions(spark, 3000, n)
    found = top_k(store, asked, KEYS, buckets=LAYOUT.buckets_of)
    plan = plan_of(found)
    scans = [part.split("], ")[0] for part in plan.split("PartitionFilters: [")[1:]]
    assert any("dynamicpruning" in s and "bucket" in s for s in scans)
    assert len(plan) < 40_000 and ("c2997" in plan) == (n == 3 and "c2997" in plan)
    assert rows(found) == rows(top_k(store, asked, KEYS))


def test_a_few_categories_read_a_few_directories(spark, store):
    """Directories left after pruning, by the names of the files that the rows came from."""
    asked = questions(spark, 3000, 2)
    held = {r["b"] for r in asked.select(F.explode(LAYOUT.buckets_of(F.col("category"))).alias("b")).collect()}
    assert len(held) <= 8 < store.select("bucket").distinct().count()
    found = top_k(store, asked, KEYS, buckets=LAYOUT.buckets_of)
    assert {r["bucket"] for r in found.collect()} <= held


def test_one_question_without_a_category_reads_all(spark, store):
    asked = questions(spark, 3000, 20).withColumn("category", F.when(F.col("query_id") != 3, F.col("category")))
    found = top_k(store, asked, KEYS, buckets=LAYOUT.buckets_of)
    assert "dynamicpruning" not in plan_of(found)
    assert rows(found) == rows(top_k(store, asked, KEYS))


def test_codes_are_pruned_alike(spark, store, tmp_path):
    path = str(tmp_path / "codes")
    code_rows(store, KEYS).write.partitionBy("bucket").parquet(path)
    codes = spark.read.parquet(path)
    asked = questions(spark, 3000, 100)
    found = certified_top_k(store, codes, asked, KEYS, buckets=LAYOUT.buckets_of)
    assert rows(found) == rows(top_k(store, asked, KEYS))


def test_no_question_and_no_row(spark, store):
    asked = questions(spark, 3000, 5)
    assert top_k(store, asked.limit(0), KEYS, buckets=LAYOUT.buckets_of).count() == 0
    assert top_k(store.limit(0), asked, KEYS, buckets=LAYOUT.buckets_of).count() == 0


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_of_the_registered_approximate_search(spark, size):
    from checks.queries import topk_approx, topk_by_category

    path = SMALL.replace("sf0.001", size)
    exact = {(r["query_id"], r["record_id"]) for r in topk_by_category(spark, path).collect()}
    found = {(r["query_id"], r["record_id"]) for r in topk_approx(spark, path).collect()}
    print(size, len(found & exact) / len(exact))
    assert len(found & exact) >= 0.9 * len(exact)
