from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from groundwell.functions.vectors import cosine_distance, passes_floor, similarity
from groundwell.operators import similarity as S
from groundwell.operators.similarity import attach_passages, top_k, top_k_single
from tests.conftest import plan_of

STORE = "record_id long, category string, chunk_text string, embedding array<float>"
HAND = [
    (1, "a", "same", [1.0, 0.0]),
    (2, "a", "orthogonal", [0.0, 2.0]),
    (3, "b", "opposite", [-1.0, 0.0]),
    (4, "b", "zero", [0.0, 0.0]),
    (5, None, None, [1.0, 1.0]),
    (6, "a", "null", None),
    (7, "b", "same again", [3.0, 0.0]),
    (8, "b", "not a number", [float("nan"), 1.0]),
]
QUESTIONS = "query_id long, vector array<float>, top_k int, category string, min_similarity double"


def ranked(frame):
    return [tuple(r) for r in frame.orderBy("query_id", "rank").collect()]


@pytest.mark.parametrize("most", [2, 1000])
def test_hand_made(spark, most):
    store = spark.createDataFrame(HAND, STORE)
    asked = spark.createDataFrame(
        [
            (1, [2.0, 0.0], 50, None, None),
            (2, [2.0, 0.0], 50, "b", None),
            (3, [2.0, 0.0], 50, None, 0.5),
            (4, [2.0, 0.0], 1, None, None),
            (5, [0.0, 0.0], 5, None, None),
            (6, [2.0, 0.0], 5, "absent", None),
        ],
        QUESTIONS,
    )
    root = round(0.5**0.5, 6)
    assert ranked(top_k(store, asked, pass_questions=most)) == [
        (1, 1, 1, 1.0), (1, 2, 7, 1.0), (1, 3, 5, root), (1, 4, 2, 0.0), (1, 5, 3, 0.0),
        (2, 1, 7, 1.0), (2, 2, 3, 0.0),
        (3, 1, 1, 1.0), (3, 2, 7, 1.0), (3, 3, 5, root),
        (4, 1, 1, 1.0),
    ]


def test_single_question(spark):
    store = spark.createDataFrame(HAND, STORE)
    rows = top_k_single(store, [2.0, 0.0], 4).collect()
    assert [r["record_id"] for r in rows] == [1, 7, 5, 2]
    assert rows[2]["category"] == "" and rows[2]["chunk_text"] == ""
    assert [r["record_id"] for r in top_k_single(store, [2.0, 0.0], 4, " b ").collect()] == [7, 3]
    assert [r["record_id"] for r in top_k_single(store, [2.0, 0.0], 4, " ").collect()] == [1, 7, 5, 2]
    assert [r["record_id"] for r in top_k_single(store, [2.0, 0.0], 9, None, 0.9).collect()] == [1, 7]
    assert "TakeOrderedAndProject" in plan_of(top_k_single(store, [2.0, 0.0]))


def brute_force(rows, asked):
    out = []
    for qid, vector, k, category, floor in asked:
        scored = []
        for rid, cat, _, emb in rows:
            if category is None or cat == category:
                a, b = np.array(vector, np.float32).astype(float), np.array(emb, np.float32).astype(float)
                c = a @ b / (np.linalg.norm(a) * np.linalg.norm(b))
                if min(max(c, 0), 1) >= floor:
                    scored.append((-round(c, 9), rid, round(min(max(c, 0), 1), 6)))
        out += [(qid, i + 1, rid, s) for i, (_, rid, s) in enumerate(sorted(scored)[:k])]
    return out


@pytest.fixture
def skewed():
    """A third of the store is one vector and one category."""
    rng = np.random.default_rng(5)
    rows = []
    hot = rng.normal(size=8).tolist()
    for i in rng.permutation(900):
        vector = hot if i % 3 == 0 else rng.normal(size=8).tolist()
        rows.append((int(i), "hot" if i % 3 == 0 else f"c{i % 40}", "t", vector))
    asked = []
    for q in range(120):
        vector = hot if q % 3 == 0 else rng.normal(size=8).tolist()
        category = [None, "hot", f"c{q % 40}"][q % 3 if q % 2 else 0]
        asked.append((q, vector, q % 50 + 1, category, [0.0, 0.4][q % 2]))
    return rows, asked


@pytest.mark.parametrize("most", [30, 1000])
def test_skewed_store_against_brute_force(spark, skewed, most, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_ROWS", 64)
    monkeypatch.setattr(S, "BLOCK_QUESTIONS", 16)
    rows, asked = skewed
    store = spark.createDataFrame(rows, STORE).repartition(5)
    got = ranked(top_k(store, spark.createDataFrame(asked, QUESTIONS), pass_questions=most))
    assert got == brute_force(rows, asked)


def test_question_sets_over_the_byte_bound_take_several_passes(spark, skewed, monkeypatch):
    rows, asked = skewed
    store, questions = spark.createDataFrame(rows, STORE), spark.createDataFrame(asked, QUESTIONS)
    small = ranked(top_k(store, questions))
    sizes, scan = [], S._scan
    monkeypatch.setattr(S, "PASS_BYTES", 4000)
    monkeypatch.setattr(S, "_scan", lambda *a: sizes.append(a[1].num_rows) or scan(*a))
    assert ranked(top_k(store, questions)) == small
    assert len(sizes) >= 4 and sum(sizes) == len(asked) and max(sizes) < len(asked) / 2


def test_plan_prunes_before_each_shuffle(spark, skewed):
    rows, asked = skewed
    store, questions = spark.createDataFrame(rows, STORE), spark.createDataFrame(asked, QUESTIONS)
    plan = plan_of(top_k(store, questions))
    assert plan.count("WindowGroupLimit") >= 2
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    # the store itself is not shuffled: only lists found in the scan are
    below = plan[plan.index("MapInArrow") :]
    assert "Exchange" not in below


def test_texts_are_read_from_the_buckets_of_the_hits(spark, tmp_path):
    path = str(tmp_path / "store")
    data = [(i, "a", f"t{i}", [1.0, float(i)], i % 4) for i in range(40)]
    frame = spark.createDataFrame(data, STORE + ", bucket int")
    frame.write.partitionBy("bucket").parquet(path)
    store = spark.read.parquet(path)
    asked = spark.createDataFrame([(1, [1.0, 0.0], 1, None, None)], QUESTIONS)
    hits = top_k(store, asked, ("record_id", "bucket"))
    found = attach_passages(hits, store, ("record_id", "bucket"))
    assert [(r["record_id"], r["chunk_text"]) for r in found.collect()] == [(0, "t0")]
    parts = plan_of(found).split("PartitionFilters: [")[1:]
    assert any(part.split("]")[0].strip() for part in parts)


def test_store_scan_reads_no_text(spark, tmp_path):
    spark.createDataFrame(HAND, STORE).write.parquet(str(tmp_path / "s"))
    store = spark.read.parquet(str(tmp_path / "s"))
    asked = spark.createDataFrame([(1, [2.0, 0.0])], "query_id long, vector array<float>")
    plan = plan_of(top_k(store, asked))
    assert "chunk_text" not in plan and "category" not in plan
    hits = attach_passages(top_k(store, asked), store)
    assert [r["chunk_text"] for r in hits.orderBy("rank").collect()][:3] == ["same", "same again", ""]


def test_extra_keys_are_carried(spark):
    rows = [(1, "a", "x", [1.0, 0.0], 10), (1, "a", "y", [0.0, 1.0], 11)]
    store = spark.createDataFrame(rows, STORE + ", doc_id long")
    asked = spark.createDataFrame([(1, [1.0, 0.1])], "query_id long, vector array<float>")
    keys = ("record_id", "doc_id")
    hits = attach_passages(top_k(store, asked, keys), store, keys).orderBy("rank").collect()
    assert [r["chunk_text"] for r in hits] == ["x", "y"]


def test_empty_sides(spark):
    store = spark.createDataFrame(HAND, STORE)
    none = spark.createDataFrame([], QUESTIONS)
    asked = spark.createDataFrame([(1, [1.0, 0.0], 5, None, None)], QUESTIONS)
    assert top_k(store, none).count() == 0
    assert top_k(store.limit(0), asked).count() == 0


def test_string_question_ids(spark):
    store = spark.createDataFrame(HAND, STORE)
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<float>")
    assert top_k(store, asked).orderBy("rank").first()[:3] == ("q", 1, 1)


def test_expressions(spark):
    frame = spark.createDataFrame(
        [([1.0, 0.0], [2.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])],
        "a array<float>, b array<float>",
    ).withColumn("d", cosine_distance(F.col("a"), F.col("b")))
    rows = frame.select("d", similarity(F.col("d")).alias("s")).collect()
    assert [(r["d"], r["s"]) for r in rows] == [(0.0, 1.0), (2.0, 0.0), (None, None)]
    nan = spark.range(1).select(
        similarity(F.lit(float("nan"))).alias("s"),
        passes_floor(F.lit(float("nan")), F.lit(0.0)).alias("p"),
    ).first()
    assert nan["s"] != nan["s"] and nan["p"] is False


def test_category_is_trimmed_and_blank_means_none(spark):
    store = spark.createDataFrame(HAND, STORE)
    asked = [(1, [2.0, 0.0], 50, "a", None), (2, [2.0, 0.0], 50, " a ", None), (3, [2.0, 0.0], 50, None, None), (4, [2.0, 0.0], 50, " ", None)]
    rows = ranked(top_k(store, spark.createDataFrame(asked, QUESTIONS)))
    lists = {q: [r[1:] for r in rows if r[0] == q] for q in range(1, 5)}
    assert lists[1] and lists[1] == lists[2]
    assert lists[3] and lists[3] == lists[4]


def test_a_floor_keeps_few_pairs_waiting():
    import pyarrow as pa

    table = pa.table(
        {
            "query_id": pa.array(range(64), pa.int64()),
            "vector": [[1.0, 0.0]] * 64,
            "top_k": pa.array([5] * 64, pa.int32()),
            "min_similarity": [0.2] * 64,
            "category": pa.array([None] * 64, pa.string()),
        }
    )
    block = S.QuestionBlock(table, 1)
    angle = np.linspace(0, 1, 20_000)
    rows = np.stack([np.cos(angle), np.sin(angle)], 1)
    block.meet(rows, np.arange(20_000)[:, None])
    assert len(block.found[0]) == 64 * 5
    same = np.tile([[1.0, 0.0]], (40_000, 1))
    block._score(same, np.arange(40_000)[:, None], np.arange(64))
    assert sum(len(p[0]) for p in block.pending) <= S.PENDING_PAIRS


def test_questions_of_other_widths_do_not_matter(spark):
    store = spark.createDataFrame([(1, None, [1.0, 0.0])], "record_id long, category string, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0])], "query_id int, vector array<float>")
    for most in (1, 2):
        assert [r["query_id"] for r in S.top_k(store, asked, pass_questions=most).collect()] == [1], most


def test_named_categories_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "store")
    spark.range(10).selectExpr("id AS record_id", "CAST(id % 5 AS STRING) AS category", "array(1f, 0f) AS embedding").write.parquet(path)
    asked = spark.createDataFrame([(1, [1.0, 0.0], " 3 ")], "query_id int, vector array<float>, category string")
    found = S.top_k(spark.read.parquet(path), asked)
    assert [r["record_id"] for r in found.collect()] == [3, 8]
    assert "EqualTo(category,3)" in found._jdf.queryExecution().toString().replace("In(category, [3])", "EqualTo(category,3)")


def test_more_questions_make_fewer_lists_each(spark, skewed, monkeypatch):
    """Groups of questions share the tasks, so that a question has lists of two tasks and not of twelve."""
    monkeypatch.setattr(S, "GROUP_QUESTIONS", 20)
    rows, asked = skewed
    store, questions = spark.createDataFrame(rows, STORE).repartition(12), spark.createDataFrame(asked, QUESTIONS)
    block = S.with_defaults(questions).toArrow()
    found, _ = S._scan(store, block, ("record_id",), S.list_schema(questions, ("record_id",)), 12)
    parts = found.select("query_id", F.spark_partition_id().alias("part"))
    lists = parts.groupBy("query_id").agg(F.countDistinct("part").alias("n"))
    assert found.rdd.getNumPartitions() == 12 and lists.agg(F.max("n")).first()[0] <= 2
    assert ranked(top_k(store, questions, tasks=12)) == brute_force(rows, asked)
    named = [a for a in asked if a[3] is not None]
    assert ranked(top_k(store, spark.createDataFrame(named, QUESTIONS))) == brute_force(rows, named)


@pytest.mark.parametrize("celled", [False, True])
def test_several_scans_read_vectors_as_bytes(spark, skewed, monkeypatch, celled):
    """What several groups of questions scan is staged once, its vectors as bytes and its cells as directories."""
    written = []

    def staged(frame, name, by=(), **options):
        written.append((name, frame.schema["embedding"].dataType.simpleString(), list(by)) if name == "scanned" else name)
        return real(frame, name, by, **options)

    real = S.staged
    monkeypatch.setattr(S, "staged", staged)
    monkeypatch.setattr(S, "GROUP_QUESTIONS", 20)
    rows, asked = skewed
    store, questions = spark.createDataFrame(rows, STORE), spark.createDataFrame(asked, QUESTIONS)
    if celled:
        store = store.withColumn("cell", (F.col("record_id") % 3).cast("int"))
        questions = questions.withColumn("cells", F.array(F.lit(0), F.lit(1), F.lit(2)))
    assert ranked(top_k(store, questions, pass_questions=30)) == brute_force(rows, asked)
    assert [w for w in written if w[0] == "scanned"] == [("scanned", "binary", ["cell"] if celled else [])]


def test_packed_vectors_come_back(spark):
    store = spark.createDataFrame(HAND + [(9, "c", "none", []), (10, "c", "wide", [1.0, 2.0, 3.0])], STORE)
    frame = S.packed(store.select("record_id", "embedding").coalesce(1)).toArrow()
    back = S.unpacked(frame.column("embedding").combine_chunks())
    given = [(i, vector or []) for i, _, _, vector in HAND] + [(9, []), (10, [1.0, 2.0, 3.0])]
    assert np.array_equal(np.concatenate(back.to_pylist()), np.concatenate([v for _, v in given]), equal_nan=True)
    assert list(map(len, back.to_pylist())) == [len(v) for _, v in given]
    part = S.unpacked(frame.column("embedding").combine_chunks().slice(1, 2))
    assert part.to_pylist() == [[0.0, 2.0], [-1.0, 0.0]]
    wide = store.withColumn("embedding", F.col("embedding").cast("array<double>"))
    assert S.packed(wide) is wide


def test_close_scores_keep_their_order():
    """Scores that single precision cannot tell apart."""
    import pyarrow as pa

    table = pa.table(
        {
            "query_id": pa.array([1], pa.int64()),
            "vector": [[1.0, 0.0]],
            "top_k": pa.array([3], pa.int32()),
            "min_similarity": [0.0],
            "category": pa.array([None], pa.string()),
        }
    )
    angle = 0.5 + np.random.default_rng(0).permutation(30_000) * 1e-8
    block = S.QuestionBlock(table, 1)
    for start in range(0, 30_000, 10_000):
        part = angle[start : start + 10_000]
        block.meet(np.stack([np.cos(part), np.sin(part)], 1), np.arange(start, start + 10_000)[:, None])
    best = sorted(zip((-np.round(np.cos(angle), 9)).tolist(), range(30_000)))[:3]
    assert block.results(("record_id",)).column("record_id").to_pylist() == [n for _, n in best]


def test_a_full_pass_reads_the_store_four_times():
    """Each group of questions is a scan of the store, whose rows are read and brought to unit length again."""
    spark = SimpleNamespace(sparkContext=SimpleNamespace(defaultParallelism=12))
    assert S.scan_shape(SimpleNamespace(num_rows=S.PASS_QUESTIONS), spark, None) == (4, 12)


def test_only_questions_with_scores_in_reach_are_compared(monkeypatch):
    """Questions whose bars no score of a block reaches take no part in the comparison of its scores."""
    rng = np.random.default_rng(1)
    table = pa.table({
        "query_id": [1, 2], "vector": [[1.0, 0.0], [0.0, 1.0]], "top_k": pa.array([1, 1], pa.int32()),
        "category": pa.array([None, None], pa.string()), "min_similarity": [0.0, 0.0],
    })
    block = S.QuestionBlock(table, 1)
    block.bar[:], block.barred[:] = [0.9, -np.inf], True
    rows = np.stack([rng.random(50) * 0.1, np.ones(50)], 1)
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    compared = []
    kept = np.flatnonzero
    monkeypatch.setattr(S.np, "flatnonzero", lambda x: compared.append(np.shape(x)) or kept(x))
    block._keep((block.narrow @ rows.T.astype(np.float32)), rows, np.arange(50)[:, None], np.arange(2))
    assert (1, 50) in compared and (2, 50) not in compared
    assert set(block.pending[0][0]) == {1} and len(block.pending[0][0]) == 50


def test_only_parts_with_scores_in_reach_are_compared(monkeypatch):
    """Of a long block of scores only the part around the one in reach is compared; the rows found are the same."""
    table = pa.table({
        "query_id": [1, 2], "vector": [[1.0, 0.0], [0.0, 1.0]], "top_k": pa.array([1, 1], pa.int32()),
        "category": pa.array([None, None], pa.string()), "min_similarity": [0.0, 0.0],
    })
    angle = np.full(2048, 0.8)
    angle[1300] = 0.1
    rows = np.stack([np.cos(angle), np.sin(angle)], 1)
    block = S.QuestionBlock(table, 1)
    block.bar[:], block.barred[:] = 0.9, True
    compared = []
    kept = np.flatnonzero
    monkeypatch.setattr(S.np, "flatnonzero", lambda x: compared.append(np.shape(x)) or kept(x))
    block._keep((block.narrow @ rows.T.astype(np.float32)), rows, np.arange(2048)[:, None], np.arange(2))
    assert max(np.prod(shape) for shape in compared) < 2048
    (found,) = block.pending
    assert found[0].tolist() == [0] and found[2].tolist() == [[1300]]


@pytest.mark.parametrize("rows", [1, 97, 128, 1808, 2048, 2053])
def test_parts_hold_every_score_in_reach(rows):
    scores = np.random.default_rng(rows).random((40, rows)).astype(np.float32)
    bar = np.quantile(scores, 0.95, axis=1).astype(np.float32) + np.where(np.arange(40) % 2, 0.5, 0).astype(np.float32)
    parts, place, number = S.parts_in_reach(scores, bar)
    part, at = np.nonzero(parts >= bar[place, None])
    found = list(zip(place[part].tolist(), (number[part] * parts.shape[1] + at).tolist()))
    assert found == list(zip(*(x.tolist() for x in np.nonzero(scores >= bar[:, None]))))
