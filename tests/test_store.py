import random

import pytest
from pyspark.sql import functions as F

from groundwell.schemas import STORE
from groundwell.sources import store as S
from groundwell.sources.store import (
    Layout,
    SaveResult,
    append_chunks,
    compact,
    dead_shares,
    last_requests,
    left_over_files,
    merged_store,
    read_commits,
    read_store,
    replace_and_insert,
    replaced_rows,
    save_counts,
    store_audit,
    store_rows,
    vacuum,
)
from tests.conftest import plan_of

LAYOUT = Layout(category_slots=3, text_slots=2)


def rows_of(spark, passages):
    """Store rows from (doc_id, category, [texts])."""
    data = [
        (category, doc, i, text, [float(doc), 1.0])
        for doc, category, texts in passages
        for i, text in enumerate(texts)
    ]
    schema = "category string, doc_id long, chunk_index int, chunk_text string, embedding array<float>"
    return store_rows(spark.createDataFrame(data, schema), LAYOUT)


def content(store):
    return sorted((r["category"], r["chunk_text"], r["doc_id"]) for r in store.collect())


class OneByOne:
    """The store as a list, documents saved one after another."""

    def __init__(self):
        self.rows = []

    def save(self, doc, category, texts):
        gone = [r for r in self.rows if r[0] == category and r[1] in texts]
        self.rows = [r for r in self.rows if r not in gone] + [(category, t, doc) for t in texts]
        return len(texts), len(gone)

    def content(self):
        return sorted(self.rows)


def batches(seed):
    rng = random.Random(seed)
    doc = 0
    for _ in range(3):
        batch = []
        for _ in range(rng.randrange(1, 12)):
            doc += rng.randrange(1, 200)
            texts = [rng.choice("aaaabcdefgh") for _ in range(rng.randrange(1, 6))]
            batch.append((doc, rng.choice(["hot", "hot", "x", "y"]), texts))
        yield batch


@pytest.mark.parametrize("seed", range(2))
def test_batches_equal_one_document_after_another(spark, tmp_path, seed):
    path, model = str(tmp_path / "store"), OneByOne()
    for batch in batches(seed):
        incoming = rows_of(spark, batch).cache()
        store = read_store(spark, path, layout=LAYOUT)
        counts = {
            r["doc_id"]: (r["chunks_inserted"], r["chunks_replaced"])
            for r in save_counts(store, incoming).collect()
        }
        plan_only = content(merged_store(store, incoming))
        saved = replace_and_insert(spark, path, incoming, LAYOUT)
        expected = {doc: model.save(doc, category, texts) for doc, category, texts in batch}
        assert counts == expected
        assert saved == tuple(map(sum, zip(*expected.values())))
        assert content(read_store(spark, path, layout=LAYOUT)) == model.content() == plan_only


def test_first_load_then_again(spark, tmp_path):
    path = str(tmp_path / "store")
    incoming = rows_of(spark, [(1, "a", ["p", "q", "q"]), (2, "b", ["p"])])
    assert replace_and_insert(spark, path, incoming, LAYOUT) == SaveResult(4, 0)
    first = content(read_store(spark, path, layout=LAYOUT))
    assert replace_and_insert(spark, path, incoming, LAYOUT) == SaveResult(4, 4)
    assert content(read_store(spark, path, layout=LAYOUT)) == first


def test_documented_limits_of_matching_by_text(spark, tmp_path):
    path = str(tmp_path / "store")
    for batch in ([(1, "a", ["old", "kept"])], [(1, "a", ["new", "kept"])], [(1, "b", ["new", "kept"])]):
        replace_and_insert(spark, path, rows_of(spark, batch), LAYOUT)
    texts = [(c, t) for c, t, _ in content(read_store(spark, path, layout=LAYOUT))]
    assert texts == [("a", "kept"), ("a", "new"), ("a", "old"), ("b", "kept"), ("b", "new")]


def test_empty_batch_writes_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    empty = rows_of(spark, [(1, "a", ["p"])]).limit(0)
    assert replace_and_insert(spark, path, empty, LAYOUT) == SaveResult(0, 0)
    assert not (tmp_path / "store").exists()
    assert read_store(spark, path).count() == 0


def test_new_documents_rewrite_no_file(spark, tmp_path):
    path = tmp_path / "store"
    replace_and_insert(spark, str(path), rows_of(spark, [(1, "a", list("pqrs"))]), LAYOUT)
    before = set(path.rglob("*.parquet"))
    replace_and_insert(spark, str(path), rows_of(spark, [(2, "a", list("tuvw"))]), LAYOUT)
    assert before < set(path.rglob("*.parquet"))


def test_category_filter_prunes(spark, tmp_path):
    path = str(tmp_path / "store")
    append_chunks(rows_of(spark, [(i, f"c{i % 7}", [f"t{i}"]) for i in range(40)]), path)
    scan = read_store(spark, path, " c3 ", LAYOUT).select("record_id")
    assert scan.count() == 6
    plan = plan_of(scan)
    assert "EqualTo(category,c3)" in plan and "embedding" not in plan
    filters = plan.split("PartitionFilters: [")[1].split("], ")[0]
    assert "bucket" in filters
    assert read_store(spark, path, "  ", LAYOUT).count() == 40


def test_schema_is_read_as_declared(spark, tmp_path):
    path = str(tmp_path / "store")
    append_chunks(rows_of(spark, [(1, "401", ["p"]), (2, "007", ["q"])]), path)
    store = read_store(spark, path, layout=LAYOUT)
    assert store.schema.simpleString() == STORE.simpleString()
    assert {r["category"] for r in store.collect()} == {"401", "007"}


def test_hot_category_spreads_over_buckets(spark):
    rows = rows_of(spark, [(i, "hot", [f"t{i}"]) for i in range(64)])
    assert rows.select("bucket").distinct().count() == LAYOUT.text_slots


def test_record_ids_repeat(spark):
    first = rows_of(spark, [(1, "a", ["p", "p"])]).collect()
    again = rows_of(spark, [(1, "a", ["p", "p"])]).collect()
    assert [r["record_id"] for r in first] == [r["record_id"] for r in again]
    assert first[0]["record_id"] != first[1]["record_id"]


def test_replaced_rows_count_every_copy(spark):
    store = rows_of(spark, [(1, "a", ["p", "p", "q"])])
    assert replaced_rows(store, rows_of(spark, [(9, "a", ["p", "z", "p"])])).count() == 2


def test_untouched_batch_is_kept_whole(spark):
    incoming = rows_of(spark, [(1, "a", ["p", "p"]), (2, "b", ["p"])])
    assert content(last_requests(incoming)) == content(incoming)


def test_audit(spark):
    rows = rows_of(spark, [(1, "a", ["p", "q"]), (2, "b", ["r"])])
    holed = rows.withColumn("embedding", F.when(F.col("chunk_text") != "q", F.col("embedding")))
    got = {(r["scope"], r["category"]): r[2:] for r in store_audit(holed).collect()}
    assert got == {("category", "a"): (2, 1), ("category", "b"): (1, 1), ("store", None): (3, 2)}
    assert store_audit(rows.limit(0)).collect()[0][2:] == (0, 0)


def test_one_outlying_id_leaves_the_slices_even(spark, tmp_path):
    """Every document brings the same passage, one of them under a far larger id."""
    docs = [*range(1, 100), 2**59]
    incoming = rows_of(spark, [(doc, "a", ["same"]) for doc in docs])
    counts = save_counts(rows_of(spark, []), incoming).collect()
    assert {r["doc_id"]: r["chunks_replaced"] for r in counts} == {d: int(d != 1) for d in docs}


def files_of(path):
    """Every file of the store and the tables beside it, with its bytes."""
    return {f: f.read_bytes() for f in path.parent.rglob("*.parquet")}


def test_sending_a_document_again_rewrites_no_file(spark, tmp_path):
    path = tmp_path / "store"
    replace_and_insert(spark, str(path), rows_of(spark, [(1, "a", list("pqrs")), (2, "b", list("pq"))]), LAYOUT)
    before = files_of(path)
    assert replace_and_insert(spark, str(path), rows_of(spark, [(1, "a", list("pqrs"))]), LAYOUT) == SaveResult(4, 4)
    after = files_of(path)
    assert before.items() < after.items()
    assert content(read_store(spark, str(path), layout=LAYOUT)) == [("a", t, 1) for t in "pqrs"] + [("b", t, 2) for t in "pq"]


@pytest.mark.parametrize("step", ["append_chunks", "_commit"])
def test_a_broken_save_changes_no_read(spark, tmp_path, monkeypatch, step):
    """It stops before its rows are written, or with rows and retired keys written and no commit."""
    path = str(tmp_path / "store")
    replace_and_insert(spark, path, rows_of(spark, [(1, "a", ["p", "q"])]), LAYOUT)
    before = content(read_store(spark, path, layout=LAYOUT))

    def broken(*_):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as patch:
        patch.setattr(S, step, broken)
        with pytest.raises(RuntimeError):
            replace_and_insert(spark, path, rows_of(spark, [(2, "a", ["p", "z"])]), LAYOUT)
    assert content(read_store(spark, path, layout=LAYOUT)) == before
    assert read_commits(spark, path).count() == 1
    assert replace_and_insert(spark, path, rows_of(spark, [(2, "a", ["p", "z"])]), LAYOUT) == SaveResult(2, 1)
    assert content(read_store(spark, path, layout=LAYOUT)) == [("a", "p", 2), ("a", "q", 1), ("a", "z", 2)]
    left = left_over_files(spark, path).count()
    assert left == (0 if step == "append_chunks" else vacuum(spark, path)) and (step == "append_chunks" or left > 0)
    assert content(read_store(spark, path, layout=LAYOUT)) == [("a", "p", 2), ("a", "q", 1), ("a", "z", 2)]


def test_compaction_keeps_every_live_row(spark, tmp_path):
    path, model = str(tmp_path / "store"), OneByOne()
    append_chunks(rows_of(spark, [(0, "x", ["a", "old"])]), path)
    model.save(0, "x", ["a", "old"])
    for batch in batches(5):
        replace_and_insert(spark, path, rows_of(spark, batch), LAYOUT)
        for doc, category, texts in batch:
            model.save(doc, category, texts)
    shares = {r["bucket"]: (r["stored"], r["live"]) for r in dead_shares(spark, path).collect()}
    assert sum(live for _, live in shares.values()) == len(model.rows) < sum(n for n, _ in shares.values())
    renewed = compact(spark, path, 0.0)
    assert renewed == sorted(b for b, (n, live) in shares.items() if live < n)
    assert content(read_store(spark, path, layout=LAYOUT)) == model.content()
    assert vacuum(spark, path) > 0 and left_over_files(spark, path).count() == 0
    assert content(read_store(spark, path, layout=LAYOUT)) == model.content()
    assert {b: v for b, v in shares.items() if b not in renewed and v[0] != v[1]} == {}
    assert all(r["stored"] == r["live"] for r in dead_shares(spark, path).collect())
    assert compact(spark, path) == []
    # saves go on after it
    batch = [(10**6, "hot", ["a", "new"]), (10**6 + 1, "x", ["old"])]
    replace_and_insert(spark, path, rows_of(spark, batch), LAYOUT)
    for doc, category, texts in batch:
        model.save(doc, category, texts)
    assert content(read_store(spark, path, layout=LAYOUT)) == model.content()


def test_retired_keys_are_read_by_bucket_too(spark, tmp_path):
    path = str(tmp_path / "store")
    for _ in range(2):
        replace_and_insert(spark, path, rows_of(spark, [(i, f"c{i % 7}", [f"t{i}"]) for i in range(40)]), LAYOUT)
    scan = read_store(spark, path, "c3", LAYOUT).select("record_id")
    assert scan.count() == 6
    plan = plan_of(scan)
    assert plan.count("bucket") and "embedding" not in plan and "SortMergeJoin" not in plan
    filters = [part.split("], ")[0] for part in plan.split("PartitionFilters: [")[1:]]
    assert len([f for f in filters if "bucket" in f]) >= 2


def test_passages_and_store_are_zstd_files(spark, tmp_path):
    import pyarrow.parquet as pq

    from groundwell.plans.ingest import IngestSettings, ingest

    corpus = spark.createDataFrame([(1, "a.md", "c", "some words")], "doc_id long, file_name string, category string, text string")
    path = tmp_path / "zstd"
    ingest(corpus, str(path), IngestSettings())
    files = list(path.rglob("*.parquet"))
    assert files and {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files} == {"ZSTD"}
