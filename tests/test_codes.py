import numpy as np
import pytest
from pyspark.sql import functions as F

from groundwell.operators import codes as C
from groundwell.operators.codes import certified_top_k, code_rows, encode, scan_codes, survivors
from groundwell.operators.similarity import list_schema, top_k, with_defaults
from groundwell.plans.answer import SearchSettings, retrieve
from groundwell.plans.ingest import IngestSettings, ingest
from groundwell.session import staged
from groundwell.sources.store import Layout, read_store
from tests.conftest import SMALL, plan_of

SF01 = SMALL.replace("sf0.001", "sf0.1")


def table(spark, path):
    rows = spark.read.parquet(f"{path}/embeddings.parquet")
    store = rows.selectExpr("vec_id as record_id", "cast(label as string) as category", "embedding")
    asked = rows.selectExpr(
        "vec_id as query_id",
        "embedding as vector",
        "cast(vec_id % 50 + 1 as int) as top_k",
        "case when vec_id % 3 != 0 then cast(label as string) end as category",
        "case when vec_id % 7 = 0 then 0.35 else 0 end as min_similarity",
    )
    return store, asked


def rows(frame):
    return sorted(map(tuple, frame.collect()))


def test_errors_are_bounds():
    rng = np.random.default_rng(0)
    for width in (1, 3, 64, 1536):
        matrix = rng.normal(size=(50, width)) * (rng.random((50, width)) < 0.5) + 1e-9
        matrix /= np.linalg.norm(matrix, axis=1)[:, None]
        codes, scale, error = encode(matrix)
        assert codes.dtype == np.int8 and (np.linalg.norm(matrix - codes * scale[:, None], axis=1) <= error).all()


@pytest.mark.parametrize("most", [120, 10_000])
def test_equal_to_the_exact_search(spark, most):
    store, asked = table(spark, SMALL)
    found = certified_top_k(store, staged(code_rows(store), "codes"), asked, pass_questions=most)
    assert rows(found) == rows(top_k(store, asked))


def test_few_vectors_are_read(spark):
    """At sf0.1: recall 1.0, and under a tenth of the (question, row) pairs are scored by their vectors."""
    store, asked = table(spark, SF01)
    coded = staged(code_rows(store), "codes")
    asked_all = with_defaults(asked)
    lists = list_schema(asked, ("record_id",))
    ends = type(lists)(lists.fields[:-1]).add("lower", "double").add("upper", "double")
    found, _ = scan_codes(coded, asked_all.toArrow(), ("record_id",), ends, None)
    pairs = survivors(found, ("record_id",), 50).count()
    assert pairs < 0.1 * store.count() * asked.count()
    exact = rows(top_k(store, asked))
    assert len(exact) <= pairs < 2 * len(exact)
    assert rows(certified_top_k(store, coded, asked)) == exact


def test_coarse_codes_cost_no_hits(spark, monkeypatch):
    """Two levels a dimension: wide intervals, the same rows."""
    monkeypatch.setattr(C, "LEVELS", 1)
    store, asked = table(spark, SMALL)
    coded = staged(code_rows(store), "codes")
    some = asked.where("query_id % 5 = 0")
    assert rows(certified_top_k(store, coded, some)) == rows(top_k(store, some))


def test_ties_and_unusable_vectors(spark):
    """A third of the rows the same vector; null, zero, infinite and wrongly sized ones are never found."""
    data = [(i, "a" if i % 2 else None, [1.0, 1.0, 0.0]) for i in range(30)]
    data += [(30 + i, "b", [float(i), 1.0, -2.0]) for i in range(40)]
    data += [(90, "a", None), (91, "a", [0.0, 0.0, 0.0]), (92, "a", [float("inf"), 0.0, 0.0]), (93, "a", [1.0, 1.0])]
    store = spark.createDataFrame(data, "record_id long, category string, embedding array<float>")
    asked = [(1, [1.0, 1.0, 0.0], 4, None), (2, [1.0, 1.0, 0.01], 40, None), (3, [0.0, 1.0, 0.0], 3, "b"), (4, [1.0, 2.0], 5, None)]
    asked += [(5, None, 5, None), (6, [0.0, 0.0, 0.0], 5, None), (7, [-1.0, -1.0, 0.0], 50, None), (8, [1.0, 1.0, 0.0], 2, "none")]
    questions = spark.createDataFrame(asked, "query_id long, vector array<float>, top_k int, category string")
    coded = code_rows(store)
    assert {r["record_id"] for r in coded.collect()} == set(range(70)) | {93}
    assert rows(certified_top_k(store, coded, questions)) == rows(top_k(store, questions))
    assert certified_top_k(store.limit(0), coded.limit(0), questions).count() == 0
    assert certified_top_k(store, coded, questions.limit(0)).count() == 0


def test_retrieval_reads_the_buckets_of_survivors(spark, tmp_path):
    path, layout = str(tmp_path / "store"), Layout(8, 2)
    words = ["river", "stone", "cloud", "grass", "field", "light", "night", "water"]
    corpus = spark.createDataFrame(
        [(i, f"d{i}.md", words[i % 8], " ".join(words[(i * k + k) % 8] for k in range(1, 30))) for i in range(64)],
        "doc_id long, file_name string, category string, text string",
    )
    ingest(corpus, path, IngestSettings(layout=layout))
    store = read_store(spark, path, layout=layout)
    asked = spark.createDataFrame(
        [(1, "stone water", 3, None, None), (2, "cloud grass light", 5, "river", None)],
        "query_id long, query string, top_k int, category string, min_similarity double",
    )
    keys = ("record_id", "doc_id", "chunk_index", "bucket")
    settings = SearchSettings(codes=staged(code_rows(store, keys), "codes"))
    assert rows(retrieve(store, asked, settings).hits) == rows(retrieve(store, asked).hits)


def test_code_table_is_narrow(spark):
    store, _ = table(spark, SMALL)
    plan = plan_of(code_rows(store))
    assert "Exchange" not in plan
    coded = code_rows(store)
    assert coded.where(F.length("code") != 64).count() == 0 and "embedding" not in coded.columns


def test_no_vectors_go_through_the_driver(spark, monkeypatch):
    monkeypatch.setattr(C, "BROADCAST_PAIRS", 0)
    store, asked = table(spark, SMALL)
    found = certified_top_k(store, staged(code_rows(store), "codes"), asked)
    assert "Broadcast" not in plan_of(found)
    assert rows(found) == rows(top_k(store, asked))


def test_the_codes_are_scanned_once(spark, monkeypatch):
    """Bars and survivors are both taken from the scan's rows, which are files by then."""
    seen = []
    real = C.survivors
    monkeypatch.setattr(C, "survivors", lambda found, keys, most: seen.append(plan_of(found)) or real(found, keys, most))
    rows = [(k, "a", [float(k % 3), 1.0]) for k in range(20)]
    store = spark.createDataFrame(rows, "record_id long, category string, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 1.0])], "query_id long, vector array<float>")
    found = C.certified_top_k(store, C.code_rows(store), asked)
    assert [r["record_id"] for r in found.orderBy("rank").collect()][:3] == [1, 4, 7]
    assert len(seen) == 1 and "MapInArrow" not in seen[0] and "parquet" in seen[0]
