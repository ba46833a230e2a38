import glob

import numpy as np
import pytest

from groundwell.operators.cells import assign_cells, train_centroids
from groundwell.plans.answer import SearchSettings, answer_questions, retrieve
from groundwell.plans.ingest import IngestSettings, check_corpus, ingest
from groundwell.session import work_path
from groundwell.sources.documents import read_documents
from groundwell.sources.store import Layout, read_store, store_audit
from groundwell.streaming.ingest import start_ingest, watch_folder, watch_table
from checks.queries import hashing_model

LAYOUT = Layout(2, 2)
SETTINGS = IngestSettings(max_chars=120, overlap=20, layout=LAYOUT)
CORPUS = "doc_id long, file_name string, category string, text string"
PLAN = (
    "Eligibility\nA new employee can join on the first day of the quarter after ninety days.\n\n"
    "Vesting\nThe employer match vests over four years.\n\nLoans\nA member may borrow half of the balance."
)
REQUEST = "query_id long, query string, top_k int, category string, min_similarity double"


@pytest.fixture
def corpus(spark):
    return spark.createDataFrame(
        [
            (1, "plan.md", None, PLAN),
            (2, "notes.txt", " hr ", "Holiday notes.\nOffices close in December."),
            (3, "../up.md", None, "x"),
            (4, "blank.md", None, " \n"),
            (5, "huge.md", None, "y" * 5000),
            (6, "minutes.pdf", None, "x"),
        ],
        CORPUS,
    )


def test_ingest_twice(spark, corpus, tmp_path):
    path = str(tmp_path / "store")
    settings = SETTINGS._replace(max_bytes=4000)
    first = ingest(corpus, path, settings)
    rows = {r["doc_id"]: r for r in first.summary.collect()}
    assert rows[1]["category"] == "plan" and rows[2]["category"] == "hr"
    assert rows[1]["character_count"] == len(PLAN)
    assert first.saved.replaced == 0
    assert first.saved.inserted == sum(r["chunks_inserted"] for r in rows.values())
    assert {r["row_key"]: r["error_code"] for r in first.rejects.collect()} == {
        "3": "file_name.not_a_bare_name",
        "4": "document.empty",
        "5": "document.too_large",
        "6": "file_name.extension_not_allowed",
    }
    size = read_store(spark, path, layout=LAYOUT).count()
    again = ingest(corpus, path, settings)
    assert again.saved == (size, size)
    assert all(r["chunks_inserted"] == r["chunks_replaced"] for r in again.summary.collect())
    overall = store_audit(read_store(spark, path, layout=LAYOUT)).where("scope = 'store'").first()
    assert overall["row_count"] == overall["vector_count"] == size


def test_saved_passages_leave_the_work_folder(spark, corpus, tmp_path):
    folders = work_path(spark, "passages").removeprefix("file:").rsplit("-", 1)[0] + "-*"
    before, path = set(glob.glob(folders)), str(tmp_path / "store")
    first, again = (ingest(corpus, path, SETTINGS) for _ in range(2))
    assert set(glob.glob(folders)) == before
    assert first.rejects.count() == again.rejects.count() == 3
    assert first.summary.count() == again.summary.count() == 3


def test_embedding_failure_refuses_the_whole_document(spark, corpus, tmp_path):
    def model(texts):
        return [[1.0, 2.0] if "vests" not in t else [1.0] for t in texts]

    path = str(tmp_path / "store")
    done = ingest(corpus, path, SETTINGS._replace(embedder=model, width=2))
    assert {r["doc_id"] for r in read_store(spark, path, layout=LAYOUT).collect()} == {2, 5}
    codes = {r["row_key"]: r["error_code"] for r in done.rejects.collect()}
    assert codes["1"] == "embedding.wrong_dimensions"


def test_the_model_runs_once_per_passage(spark, corpus, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def model(texts):
        calls.add(len(texts))
        return np.ones((len(texts), 3))

    done = ingest(corpus, str(tmp_path / "store"), SETTINGS._replace(embedder=model, width=3))
    assert calls.value == done.saved.inserted


def test_check_corpus_takes_the_first_failure(spark):
    frame = spark.createDataFrame([(1, ".md", None, " "), (2, "a.md", " ", "t")], CORPUS)
    rows = {r["doc_id"]: r for r in check_corpus(frame).collect()}
    assert rows[1]["error_code"] == "file_name.stem_missing"
    assert rows[2]["error_code"] is None and rows[2]["category"] == "a"


@pytest.fixture
def store(spark, corpus, tmp_path):
    path = str(tmp_path / "answers")
    ingest(corpus, path, SETTINGS)
    return read_store(spark, path, layout=LAYOUT)


def test_answers(spark, store):
    asked = spark.createDataFrame(
        [
            (1, "when can a new employee join", None, None, None),
            (2, "when can a new employee join", 2, "hr", None),
            (3, "zebra quantum", None, None, 0.9),
            (4, " ", None, None, None),
            (5, "when can a new employee join", 1, "plan", 0.3),
        ],
        REQUEST,
    )
    done = answer_questions(store, asked)
    rows = {r["query_id"]: r for r in done.answers.collect()}
    assert set(rows) == {1, 2, 3, 5}
    assert rows[1]["answered"] and rows[1]["retrieved_chunks"] == 5
    assert rows[5]["answer"].startswith("Eligibility") and "[S1]" in rows[5]["answer"]
    assert not rows[3]["answered"] and rows[3]["retrieved_chunks"] == 0
    for r in rows.values():
        assert set(r["cited_record_ids"]) <= set(r["context_record_ids"])
    assert [tuple(r) for r in done.rejects.collect()] == [(4, "query.missing")]


def test_no_evidence_no_call(spark, store):
    calls = spark.sparkContext.accumulator(0)

    def model(instructions, prompts, limit):
        calls.add(len(prompts))
        return [("said [S1]", "stop", 1, 1) for _ in prompts]

    asked = spark.createDataFrame([(1, "zebra", None, None, 1.0), (2, "balance", None, None, None)], REQUEST)
    rows = answer_questions(store, asked, SearchSettings(generator=model)).answers.collect()
    assert calls.value == 1
    assert {r["query_id"]: r["answered"] for r in rows} == {1: False, 2: True}


def test_a_user_model_finds_the_same(spark, store):
    asked = spark.createDataFrame([(1, "employer match vests", None, None, None)], REQUEST)
    own = SearchSettings(embedder=hashing_model)
    assert retrieve(store, asked, own).hits.collect() == retrieve(store, asked).hits.collect()


def test_approximate_retrieval(spark, store):
    asked = spark.createDataFrame([(1, "employer match vests", 3, None, None)], REQUEST)
    centroids = train_centroids(store, 3)
    settings = SearchSettings(centroids=centroids, breadth=10**6)
    celled = assign_cells(store, centroids)
    assert sorted(retrieve(celled, asked, settings).hits.collect()) == sorted(retrieve(store, asked).hits.collect())


def test_questions_of_the_wrong_width_are_rejected(spark, store):
    asked = spark.createDataFrame([(1, "a", None, None, None)], REQUEST)
    found = retrieve(store, asked, SearchSettings(embedder=lambda texts: np.ones((len(texts), 3))))
    assert found.hits.count() == 0
    assert [tuple(r) for r in found.rejects.collect()] == [(1, "embedding.wrong_dimensions")]


def test_folder_to_store(spark, tmp_path):
    root = tmp_path / "docs"
    root.mkdir()
    (root / "plan.md").write_text(PLAN)
    documents, rejects = read_documents(spark, str(root))
    done = ingest(documents, str(tmp_path / "store"), SETTINGS)
    assert done.saved.inserted == 2 and rejects.count() == 0
    assert done.summary.first()["category"] == "plan"


def test_the_size_of_the_file_counts(spark, tmp_path):
    """Bad bytes grow when they are decoded; the cap is on the bytes of the file."""
    root = tmp_path / "docs"
    root.mkdir()
    (root / "plan.md").write_bytes(b"word " + b"\xff " * 1000)
    documents, rejects = read_documents(spark, str(root), max_bytes=3000)
    done = ingest(documents, str(tmp_path / "store"), SETTINGS._replace(max_bytes=3000))
    assert done.saved.inserted > 0 and rejects.count() == 0 and done.rejects.count() == 0


def test_stream_of_files(spark, tmp_path):
    root, store, point = tmp_path / "docs", str(tmp_path / "store"), str(tmp_path / "point")
    rejects = str(tmp_path / "rejects")
    root.mkdir()
    (root / "plan.md").write_text(PLAN)
    (root / "blank.md").write_text(" \n")

    def run():
        start_ingest(watch_folder(spark, str(root)), store, point, rejects, SETTINGS).awaitTermination()
        return read_store(spark, store, layout=LAYOUT)

    first = run().count()
    assert first == 2
    assert [r["error_code"] for r in spark.read.parquet(rejects).collect()] == ["document.empty"]
    assert run().count() == first
    (root / "other.txt").write_text("Another document.\nWith two lines.")
    assert {r["category"] for r in run().collect()} == {"plan", "other"}


def test_stream_of_tables_in_several_batches(spark, corpus, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    corpus.repartition(3, "doc_id").write.parquet(source)
    stream = watch_table(spark, source, corpus.schema, files_per_batch=1)
    point, rejects = str(tmp_path / "point"), str(tmp_path / "rejects")
    start_ingest(stream, store, point, rejects, SETTINGS).awaitTermination()
    ingest(corpus, str(tmp_path / "once"), SETTINGS)
    texts = lambda p: sorted((r["category"], r["chunk_text"]) for r in read_store(spark, p, layout=LAYOUT).collect())
    assert texts(store) == texts(str(tmp_path / "once"))
