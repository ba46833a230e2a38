import random
import re
import time

import pytest
from pyspark.sql import functions as F

from groundwell.functions.text import WHITESPACE, utf16_length
from groundwell.operators.chunking import (
    check_chunks,
    chunk_documents,
    chunk_fixed_width,
    documents_without_chunks,
)


def expected_chunks(text, limit, overlap):
    """The cutting rules step by step."""
    room = limit - overlap - 1 if overlap else limit
    atoms = []
    for line in re.sub("\r\n?", "\n", text).split("\n"):
        pieces = [line] if len(line) <= room else re.split(r"(?<=[.!?])[\t\n\x0b\f\r ]+", line)
        for piece in pieces:
            atoms += [piece[i : i + room] for i in range(0, len(piece), room)] or [""]
    atoms = [a for a in atoms if a.strip(WHITESPACE)]
    bodies = []
    for atom in atoms:
        if bodies and len(bodies[-1]) + 1 + len(atom) <= room:
            bodies[-1] += "\n" + atom
        else:
            bodies.append(atom)
    out = bodies[:1]
    for before, body in zip(bodies, bodies[1:]):
        if not overlap:
            out.append(body)
            continue
        tail = before[-overlap:]
        cut = len(before) > overlap and not {before[-overlap - 1], tail[0]} & set(WHITESPACE)
        blanks = [i for i, c in enumerate(tail) if c in WHITESPACE]
        if cut and blanks:
            tail = tail[blanks[0] + 1 :]
        out.append(tail + "\n" + body)
    return out


def random_text(rng):
    words = ["a", "bé.", "c!", "long" * 9, "😀", "?", " ", "word", " x", "...", "x" * 70]
    gaps = [" ", " ", "  ", "\n", "\r\n", "\r", "\n\n", "\t", "　"]
    return "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(0, 90)))


@pytest.mark.parametrize("limit, overlap", [(60, 15), (40, 0), (25, 20), (1000, 150), (1, 0)])
def test_boundary_chunks_follow_the_rules(spark, limit, overlap):
    rng = random.Random(limit)
    texts = [random_text(rng) for _ in range(60)] + ["", " \n\t", "one line"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = chunk_documents(frame, max_chars=limit, overlap=overlap).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["chunk_index"])):
        assert len(r["chunk_text"]) <= limit
        got.setdefault(r["doc_id"], []).append(r["chunk_text"])
    for i, text in enumerate(texts):
        assert got.get(i, []) == expected_chunks(text, limit, overlap), repr(text)


@pytest.mark.parametrize("limit, overlap", [(50, 10), (50, 0), (50, 45), (1000, 150)])
def test_fixed_width(spark, limit, overlap):
    rng = random.Random(overlap)
    texts = [random_text(rng) for _ in range(40)] + ["", "  ", "x" * 51, "y" * 50, "z" * 60]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in chunk_fixed_width(frame, max_chars=limit, overlap=overlap).collect():
        got.setdefault(r["doc_id"], {})[r["chunk_index"]] = r["chunk_text"]
    for i, text in enumerate(texts):
        if not text.strip(WHITESPACE):
            assert i not in got
            continue
        starts = range(0, max(len(text) - overlap, 1), limit - overlap)
        assert got[i] == {n: text[s : s + limit] for n, s in enumerate(starts)}


def test_every_line_is_covered(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    joined = chunk_documents(frame, max_chars=500, overlap=50).groupBy("doc_id").agg(
        F.concat_ws("\n", F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_text")))["chunk_text"]).alias("all")
    )
    lines = frame.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(
        "trim(line) <> '' AND length(line) <= 449"
    )
    assert lines.join(joined, "doc_id").where(~F.contains("all", "line")).count() == 0


def test_one_huge_line_is_linear(spark):
    frame = spark.createDataFrame(
        [(1, "x" * 5_000_000), (2, "a b. " * 900_000)], "doc_id long, text string"
    )
    started = time.time()
    counts = chunk_documents(frame).groupBy("doc_id").count().collect()
    assert chunk_fixed_width(frame).count() > 10_000
    assert {r["doc_id"]: r["count"] for r in counts}[1] == 5890
    assert time.time() - started < 60


def test_measure_is_pluggable_and_audited(spark):
    frame = spark.createDataFrame([(1, "😀" * 30 + "\n" + "😀" * 10)], "doc_id long, text string")
    chunks = chunk_documents(frame, max_chars=50, overlap=0, measure=utf16_length)
    assert [r["chunk_text"] for r in chunks.orderBy("chunk_index").collect()] == ["😀" * 30, "😀" * 10]
    codes = [r["error_code"] for r in check_chunks(chunks, 50, utf16_length).orderBy("chunk_index").collect()]
    assert codes == ["chunking.limit_exceeded", None]


def test_documents_without_chunks(spark):
    frame = spark.createDataFrame([(1, "a"), (2, "b"), (3, " ")], "doc_id long, text string")
    chunks = chunk_documents(frame).where("doc_id <> 2")
    assert [tuple(r) for r in documents_without_chunks(frame, chunks).collect()] == [
        (2, "document.no_chunks_produced")
    ]


def test_limits_are_checked(spark):
    frame = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for limit, overlap in [(0, 0), (8001, 0), (1000, 4001), (100, 99), (1000, -1)]:
        with pytest.raises(ValueError):
            chunk_documents(frame, max_chars=limit, overlap=overlap)


def test_no_shuffle(spark):
    from tests.conftest import plan_of

    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for cut in (chunk_documents, chunk_fixed_width):
        plan = plan_of(cut(frame))
        assert "Exchange" not in plan and "n_chars" not in plan
