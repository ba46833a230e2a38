import math
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from groundwell.operators.embedding import (
    check_embeddings,
    chunks_without_vectors,
    embed_hashed,
    embed_with,
    pair_vectors,
    with_norm,
    words_of,
)
from groundwell.operators.model_calls import Calls
from tests.conftest import plan_of


def test_hashed_vectors(spark):
    texts = ["Ab ab, C1!", "", None, "...", "Ünïcode ünïcode"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, chunk_text string")
    rows = {r["id"]: r["embedding"] for r in embed_hashed(frame, width=16).collect()}
    slot = lambda w: int(md5(w.encode()).hexdigest()[:8], 16) % 16
    want = np.zeros(16)
    want[slot("ab")] += 2
    want[slot("c1")] += 1
    want /= np.linalg.norm(want)
    assert np.allclose(rows[0], want, atol=1e-7)
    assert rows[1] == [0.0] * 16 and rows[3] == [0.0] * 16
    assert rows[2] is None
    assert max(rows[4]) == 1.0


def test_words_are_runs_of_letters_and_digits():
    """Words cut out of the texts' bytes are those that splitting at all other characters leaves."""
    texts = [None, "", " ", "a", "b c", "ÄÖ ß", "x\u0301y", "١٢٣ abc", "日本語 テキスト", "😀 a😀b", "Ⅷ ½ ² İ ǅ", "é", "é", "\0a\0", "𝒜𝒷 𝟙-_ﬁ", None]
    texts += ["".join(chr(c) for c in range(start, start + 97)) for start in range(1, 0xD000, 97)]
    for given in (pa.array(texts), pa.array(texts).slice(3, 9), pa.array(texts, pa.large_string()), pa.array([None, ""])):
        split = pc.split_pattern_regex(pc.utf8_lower(given), pattern=r"[^\p{L}\p{N}]+")
        want = [(row, word) for row, words in enumerate(split.to_pylist()) for word in words or [] if word]
        rows, words = words_of(given)
        assert list(zip(rows.tolist(), words.to_pylist())) == want


def test_hashed_needs_no_shuffle(spark):
    frame = spark.range(10).selectExpr("id", "'a b' as chunk_text")
    assert "Exchange" not in plan_of(embed_hashed(frame))


def test_wide_hashed_vectors(spark):
    frame = spark.range(3000).selectExpr("id", "concat('w', id, ' x') as chunk_text").repartition(3)
    rows = with_norm(embed_hashed(frame, width=1536)).collect()
    assert len(rows) == 3000 and all(len(r["embedding"]) == 1536 for r in rows)
    assert all(math.isclose(r["norm"], 1, rel_tol=1e-6) for r in rows)


def test_callable_gets_slices(spark):
    def model(texts):
        return [[float(len(texts)), float(t)] for t in texts]

    frame = spark.range(150).selectExpr("id", "cast(id as string) as chunk_text").coalesce(1)
    rows = embed_with(frame, model, width=2, batch_size=64).collect()
    assert sorted(r["embedding"][0] for r in rows) == [22.0] * 22 + [64.0] * 128
    assert all(r["embedding"][1] == r["id"] and r["error_code"] is None for r in rows)


def test_callable_failures_become_codes(spark):
    def short(texts):
        return np.zeros((len(texts) - 1, 2))

    def uneven(texts):
        return [[1.0, 2.0] if t != "2" else [1.0] for t in texts]

    frame = spark.range(4).selectExpr("id", "cast(id as string) as chunk_text").coalesce(1)
    rows = check_embeddings(embed_with(frame, short, width=2), 2).collect()
    assert {r["error_code"] for r in rows} == {"embedding.batch_count_mismatch"}
    rows = check_embeddings(embed_with(frame, uneven, width=2), 2).collect()
    assert [r["error_code"] for r in rows] == [None, None, "embedding.wrong_dimensions", None]


def test_audit_and_pairing(spark):
    chunks = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "doc_id long, chunk_index int, chunk_text string")
    vectors = spark.createDataFrame([(1, 1, [1.0, 0.0])], "doc_id long, chunk_index int, embedding array<float>")
    assert [r["chunk_text"] for r in pair_vectors(chunks, vectors).collect()] == ["b"]
    missing = chunks_without_vectors(chunks, vectors).collect()
    assert [tuple(r) for r in missing] == [(1, 0, "embedding.count_mismatch")]
    assert check_embeddings(vectors, 3).first()["error_code"] == "embedding.wrong_dimensions"
    assert check_embeddings(vectors, 2).first()["error_code"] is None


def test_built_in_passes_its_width_check(spark):
    frame = spark.range(5).selectExpr("id", "concat('w', id) as chunk_text")
    assert check_embeddings(embed_hashed(frame, width=64), 64).where("error_code is not null").count() == 0


def test_a_failing_model_costs_its_own_calls_only(spark):
    def model(texts):
        if "b" in texts:
            raise ConnectionError("no model")
        return [[1.0, 2.0] for _ in texts]

    frame = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id int, chunk_text string").coalesce(1)
    rows = check_embeddings(embed_with(frame, model, width=2, batch_size=1), 2).collect()
    assert {r["doc_id"]: r["error_code"] for r in rows} == {1: None, 2: "embedding.unavailable", 3: None}


def test_the_cause_of_a_failure_is_kept(spark):
    texts = spark.createDataFrame([(i, "bad" if i == 2 else "good") for i in range(5)], "doc_id long, chunk_text string").coalesce(1)

    def model(batch):
        if "bad" in batch:
            raise TimeoutError("no reply in 30 s")
        return [[1.0, 2.0]] * len(batch)

    rows = embed_with(texts, model, width=2, batch_size=1).collect()
    assert {r["doc_id"]: r["error_cause"] for r in rows} == {0: None, 1: None, 2: "TimeoutError: no reply in 30 s", 3: None, 4: None}


def test_a_broken_callable_ends_the_job(spark):
    """Every call of a task raises the same: no outage of single calls, and no corpus of rejects."""
    texts = spark.range(200).selectExpr("id AS doc_id", "'text' AS chunk_text").coalesce(1)

    def model(batch):
        return len(batch) + "1"

    with pytest.raises(Exception, match="unsupported operand"):
        embed_with(texts, model, width=2, batch_size=4).collect()


def test_failures_of_several_kinds_do_not_end_it():
    def model(k):
        raise OSError(f"line {k}")

    calls = Calls(model)
    assert [calls(k)[1] for k in range(40)] == [f"OSError: line {k}" for k in range(40)]


def test_the_stand_in_model_hashes_a_word_once(monkeypatch):
    from checks import queries

    texts = ["Once upon a time, once more", "", "a time"]
    first = queries.hashing_model(texts)
    monkeypatch.setattr(queries, "md5", None)
    again = queries.hashing_model(texts)
    assert (first == again).all() and not first[1].any() and first.dtype == np.float32


def test_vectors_of_a_model_come_as_they_are(spark):
    """Rows of one call with and without a vector, in the order of the texts; a float that is none stays one."""
    made = {"a": [1.5, -2.0], "b": None, "c": [1.0], "d": np.array([float("inf"), 0.25]), "e": (0.1, 3)}
    frame = spark.createDataFrame([(t,) for t in made], "chunk_text string").coalesce(1)
    rows = embed_with(frame, lambda texts: [made[t] for t in texts], width=2, batch_size=3).collect()
    fits = [1.5, -2.0], None, None, [float("inf"), 0.25], [float(np.float32(0.1)), 3.0]
    assert [r["embedding"] for r in rows] == list(fits)
    assert [r["error_code"] for r in rows] == [None, *["embedding.wrong_dimensions"] * 2, None, None]
