"""Turning texts into vectors, and auditing the vectors."""

from collections.abc import Callable, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundwell.functions.vectors import l2_norm
from groundwell.operators.model_calls import Calls
from groundwell.schemas import EMBED_BATCH_SIZE, EMBEDDING_WIDTH, VECTOR

# Fixed value: the characters of words, all others separate them.
WORD_CHARACTER = r"[\p{L}\p{N}]"

# Rows turned into dense counts at a time inside a task, to bound its memory for wide vectors.
DENSE_ROWS = 1024


def vector_array(matrix: np.ndarray, valid=None) -> pa.Array:
    """A matrix as an Arrow list<float> column; rows where `valid` is false become null."""
    rows, width = matrix.shape
    values = pa.array(np.ascontiguousarray(matrix, dtype=np.float32).ravel())
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * width)
    mask = None if valid is None else pa.array(~np.asarray(valid, dtype=bool))
    return pa.ListArray.from_arrays(offsets, values, mask=mask)


def _word_hashes(words: pa.Array) -> np.ndarray:
    """The first four bytes of each word's MD5 as a number. Words hold no blank, so one split makes them Python's."""
    if not len(words):
        return np.zeros(0, np.int64)
    whole = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.binary()))
    parts = pc.binary_join(whole, b" ")[0].as_py().split(b" ")
    return np.frombuffer(b"".join([md5(word).digest() for word in parts]), ">u4")[::4].astype(np.int64)


def _ascii_words() -> np.ndarray:
    """Which of the 256 byte values are a word's character by themselves."""
    single = pa.array([chr(c) for c in range(128)])
    inside = np.zeros(256, dtype=bool)
    inside[:128] = pc.match_substring_regex(single, WORD_CHARACTER).to_numpy(zero_copy_only=False)
    return inside


def _mark_wide(data: np.ndarray, inside: np.ndarray) -> None:
    """Marks the bytes of the word characters beyond ASCII; each distinct character is looked at once."""
    lead = np.flatnonzero(data >= 0xC0)
    if not len(lead):
        return
    size = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
    code = np.zeros(len(lead), np.uint32)
    for i in range(4):
        has = size > i
        code[has] |= data[lead[has] + i].astype(np.uint32) << np.uint32(24 - 8 * i)
    distinct, which = np.unique(code, return_inverse=True)
    characters = [int(c).to_bytes(4, "big").rstrip(b"\0").decode() for c in distinct]
    known = pc.match_substring_regex(pa.array(characters), WORD_CHARACTER)
    word = known.to_numpy(zero_copy_only=False)[which]
    for i in range(4):
        inside[lead[word & (size > i)] + i] = True


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row of each word, the lower-case words) of an Arrow array of texts: the longest runs of letters and digits."""
    lower = pc.utf8_lower(texts).fill_null("")
    kind = np.int64 if pa.types.is_large_string(lower.type) else np.int32
    ends = np.frombuffer(lower.buffers()[1], kind, len(lower) + 1, lower.offset * np.dtype(kind).itemsize)
    held = lower.buffers()[2]
    whole = np.zeros(0, np.uint8) if held is None else np.frombuffer(held, np.uint8)
    data, ends = whole[ends[0] : ends[-1]], ends - ends[0]
    inside = _ascii_words()[data]
    _mark_wide(data, inside)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = ends[:-1][ends[:-1] < len(data)]
    begins[first] = inside[first]  # no word goes on into the next text
    starts = np.flatnonzero(begins)
    sizes = np.add.reduceat(inside, starts, dtype=np.int64) if len(starts) else starts
    bounds = np.append(0, np.cumsum(sizes)).astype(kind)
    array = pa.LargeStringArray if kind is np.int64 else pa.StringArray
    words = array.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data[inside]))
    return np.searchsorted(ends, starts, side="right") - 1, words


def _hashed_counts(width: int) -> Callable:
    """Arrow function: texts to unit-length vectors of hashed word counts."""

    def dense(texts: pa.Array) -> pa.Array:
        rows, words = words_of(texts)
        words = words.dictionary_encode()
        known = _word_hashes(words.dictionary) % width
        cells = rows * width + known[words.indices.to_numpy(zero_copy_only=False)]
        counts = np.bincount(cells, minlength=len(texts) * width).reshape(-1, width)
        norms = np.sqrt((counts.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
        unit = np.divide(counts, norms, out=np.zeros(counts.shape), where=norms > 0)
        return vector_array(unit, texts.is_valid().to_numpy(zero_copy_only=False))

    def embed(texts: pa.Array) -> pa.Array:
        parts = [dense(texts.slice(start, DENSE_ROWS)) for start in range(0, len(texts), DENSE_ROWS)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float32()))

    return embed


def embed_hashed(texts: DataFrame, text: str = "chunk_text", width: int = 64) -> DataFrame:
    """TRF-5: the built-in deterministic embedder; a text without words gets the zero vector.

    Lower-case words hash into `width` counts, scaled to unit length. Works on whole Arrow batches:
    words are cut out of their bytes, each distinct word is hashed once and one bincount builds the vectors. No shuffle.
    Declared non-deterministic only so that no filter on the vector makes Spark compute it twice.
    """
    hashed = F.arrow_udf(_hashed_counts(width), returnType=VECTOR).asNondeterministic()
    return texts.withColumn("embedding", hashed(F.col(text)))


def embed_with(
    texts: DataFrame,
    embedder: Callable[[Sequence[str]], np.ndarray],
    text: str = "chunk_text",
    width: int = EMBEDDING_WIDTH,
    batch_size: int = EMBED_BATCH_SIZE,
) -> DataFrame:
    """TRF-4: vectors from a user-supplied model, `batch_size` texts per call, no shuffle.

    The key columns travel with the text, so pairing does not depend on order. A call that returns
    another number of vectors than it got texts, or vectors of another width, gives those rows a
    null embedding and an `error_code` in place of vectors paired by guess. A call that raises costs
    its own rows only: they get `embedding.unavailable`, and what was raised in `error_cause`. A model that fails
    from a task's first call on, over and over in the same way, ends the job (model_calls).
    """
    schema = T.StructType(list(texts.schema.fields)).add("embedding", VECTOR)
    schema = schema.add("error_code", "string").add("error_cause", "string")

    def call(calls: Calls, batch: list, out: np.ndarray) -> tuple[list, list, list]:
        """(which rows of `out` got a vector, codes, causes) of one call."""
        vectors, cause = calls(batch)
        nothing, missing = [None] * len(batch), [False] * len(batch)
        if cause is not None:
            return missing, ["embedding.unavailable"] * len(batch), [cause] * len(batch)
        if len(vectors) != len(batch):
            return missing, ["embedding.batch_count_mismatch"] * len(batch), nothing
        fits = [v is not None and len(v) == width for v in vectors]
        for row, ok in enumerate(fits):
            if ok:
                out[row] = np.asarray(vectors[row], dtype=np.float32)
        return fits, [None if ok else "embedding.wrong_dimensions" for ok in fits], nothing

    def embed(batches):
        calls = Calls(embedder)
        for batch in batches:
            inputs = batch.column(text).to_pylist()
            vectors = np.zeros((len(inputs), width), np.float32)
            valid, codes, causes = [], [], []
            for start in range(0, len(inputs), batch_size):
                some = slice(start, start + batch_size)
                fits, code, cause = call(calls, inputs[some], vectors[some])
                valid += fits
                codes += code
                causes += cause
            made = [vector_array(vectors, valid), pa.array(codes, pa.string()), pa.array(causes, pa.string())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *made],
                names=[*batch.schema.names, "embedding", "error_code", "error_cause"],
            )

    return texts.mapInArrow(embed, schema)


def check_embeddings(vectors: DataFrame, width: int) -> DataFrame:
    """TRF-6, per row: a code where the vector is missing or not `width` wide."""
    wrong = F.col("embedding").isNull() | (F.size("embedding") != width)
    found = F.when(wrong, "embedding.wrong_dimensions")
    if "error_code" in vectors.columns:
        found = F.coalesce(F.col("error_code"), found)
    return vectors.withColumn("error_code", found)


def chunks_without_vectors(
    chunks: DataFrame, vectors: DataFrame, key=("doc_id", "chunk_index")
) -> DataFrame:
    """TRF-6, per set: texts that no vector came back for."""
    return (
        chunks.select(*key)
        .join(vectors.select(*key), list(key), "left_anti")
        .withColumn("error_code", F.lit("embedding.count_mismatch"))
    )


def pair_vectors(
    chunks: DataFrame, vectors: DataFrame, key=("doc_id", "chunk_index")
) -> DataFrame:
    """JN-4: joins vectors computed elsewhere to their texts by key instead of by position."""
    return chunks.join(vectors, list(key), "inner")


def with_norm(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("norm", l2_norm(F.col("embedding")))
