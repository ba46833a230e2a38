"""The pipeline's stages against brute force, and with ids that do not tell rows apart."""

import collections
import hashlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from groundwell.llm.fingerprints import fingerprints
from groundwell.llm.positive_unlabelled import score_toxicity
from groundwell.llm.positional_index import decontaminate
from tests.conftest import SMALL, plan_of
from tests.llm.frames import awkward, lowered

SF = SMALL.replace("sf0.001", "sf0.01")


def test_stages_equal_brute_force(spark):
    """Each stage on what its predecessor kept: scores, equal texts, chains of near fingerprints, windows of the benchmark."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    toxic = {r["doc_id"] for r in score_toxicity(docs, labels).filter("predicted = 1").collect()}
    clean = corpus_pipeline.staged(corpus_pipeline.toxicity(spark, docs, SF), "clean")
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] not in toxic}
    assert toxic and {r["doc_id"] for r in clean.collect()} == texts.keys()

    single = corpus_pipeline.staged(corpus_pipeline.exact_dedup(spark, clean, SF), "single")
    last = {}
    for i in sorted(texts):
        last[lowered(texts[i])] = i
    assert {r["doc_id"] for r in single.collect()} == set(last.values())

    apart = corpus_pipeline.staged(corpus_pipeline.near_dedup(spark, single, SF), "apart")
    marks = {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in fingerprints(single).collect()}
    ids, parent = sorted(marks), {i: i for i in marks}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (marks[a] ^ marks[b]).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert {r["doc_id"] for r in apart.collect()} == {root(i) for i in ids}

    kept = corpus_pipeline.decontamination(spark, apart, SF)
    leaks = {r["doc_id"] for r in decontaminate(apart, spark.read.parquet(f"{SF}/benchmark.parquet")).filter("contaminated").collect()}
    assert leaks and {r["doc_id"] for r in kept.collect()} == {root(i) for i in ids} - leaks


def test_null_ids_spread_over_the_ranges(spark):
    """Half of all ids null: no range of the numbering holds more than its share, and the order is that of the ids."""
    docs = spark.range(0, 4000, 1, 16).selectExpr("if(id % 2 = 0, null, id) AS doc_id", "concat('text ', id) AS text", "id AS __row")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these are small
    rows = corpus_pipeline.numbered(docs, corpus_pipeline.free_name(docs, "__row"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert rows.columns == [*docs.columns, "___row"]
    sizes = [r["count"] for r in rows.groupBy(F.shiftright("___row", 33)).count().collect()]
    assert len(sizes) > 1 and max(sizes) <= 2 * 4000 / len(sizes)
    ordered = [r["doc_id"] for r in rows.orderBy("___row").select("doc_id").collect()]
    assert ordered == [None] * 2000 + list(range(1, 4000, 2))


def test_dropped_rows_are_no_shuffle_of_texts(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    few = corpus_pipeline.rows_without(docs, lambda rows: rows.filter("doc_id % 10 = 0"))
    assert "BroadcastHashJoin" in plan_of(few) and "hashpartitioning" not in plan_of(few)
    monkeypatch.setattr("groundwell.session.BROADCAST_ROWS", 3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    many = corpus_pipeline.rows_without(docs, lambda rows: rows.filter("doc_id % 10 = 0"))
    assert "SortMergeJoin" in plan_of(many)
    assert sorted(r["doc_id"] for r in many.collect()) == sorted(r["doc_id"] for r in few.collect())
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan_of(corpus_pipeline.rows_below(docs, *empty_model(), 0.5))


def empty_model():
    return np.zeros(0, np.uint64), np.zeros(0), 0.0


def test_repeated_rows_and_clashing_columns(spark):
    docs = awkward(spark).withColumn("__row", F.lit(1)).withColumn("__place", F.lit(2))
    kept = corpus_pipeline.exact_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    texts = collections.Counter(hashlib.sha256(lowered(r["text"]).encode()).hexdigest() for r in kept.collect())
    assert set(texts.values()) == {1} and len(texts) == len({lowered(r["text"]) for r in docs.collect()})
    assert corpus_pipeline.exact_dedup(spark, docs.limit(0), "").count() == 0
