"""Language identification by hyperdimensional profiles.

Each letter has a random vector of DIMENSIONS signs, drawn from its code point. A trigram is the product
of its letters' vectors, the first rotated twice and the second once, so that order matters; a
text is the sum of its trigrams, a language the sum of its training texts brought to length one.
A text gets the language whose vector has the largest cosine with its own. Letters are what Unicode
calls so, in lower case; everything between them is one space, which counts as a letter.

Signs are kept as bits, where the product is an exclusive or. A task unpacks the distinct
trigrams of a slice TRIGRAMS at a time and multiplies them with the texts' counts.

Learning takes at most about SAMPLE_TEXTS texts per language, drawn by a hash of the id from the rows outside the
held-out fold. Defined results: `und` and score 0 for texts that are null or without a letter, and for all
texts when there is nothing to learn from; ties go to the first language by name; the score is the
cosine, at least 0.
"""

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwell.llm.arrays import mix, text_slices
from groundwell.llm.ranks import training_fold
from groundwell.session import broadcast_if_small

DIMENSIONS = 1024
TRIGRAMS = 4096
SAMPLE_TEXTS = 2000
FOLDS = 5
UNKNOWN = "und"

_LETTERS = None


def letters() -> np.ndarray:
    """For each code point its letter in lower case, 32 for what is no letter."""
    global _LETTERS
    if _LETTERS is None:
        table = np.full(sys.maxunicode + 1, 32, np.uint32)
        for code in range(sys.maxunicode + 1):
            if (c := chr(code)).isalpha():
                small = c.lower()
                table[code] = ord(small) if len(small) == 1 else code
        _LETTERS = table
    return _LETTERS


def signs(codes: np.ndarray) -> np.ndarray:
    """The letters' bits, a row of DIMENSIONS for each."""
    seeds = codes.astype(np.uint64)[:, None] * np.uint64(DIMENSIONS) + np.arange(DIMENSIONS // 64, dtype=np.uint64)
    return np.unpackbits(mix(mix(seeds + np.uint64(0x9E3779B97F4A7C15))).view(np.uint8).reshape(len(codes), -1), axis=1)


def trigram_vectors(trigrams: np.ndarray) -> np.ndarray:
    """Rows of +1 and -1 for trigrams given as three 21-bit code points in one number."""
    codes = np.stack([(trigrams >> np.uint64(s)) & np.uint64((1 << 21) - 1) for s in (42, 21, 0)])
    names, number = np.unique(codes, return_inverse=True)
    number = number.reshape(codes.shape)
    own = signs(names)
    turned = [np.packbits(np.roll(own, k, axis=1), axis=1) for k in (2, 1, 0)]
    bound = turned[0][number[0]] ^ turned[1][number[1]] ^ turned[2][number[2]]
    return 1 - 2 * np.unpackbits(bound, axis=1).astype(np.float32)


def slice_vectors(buffer: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The vectors of the texts of a slice, brought to length one; zero without a letter."""
    n = len(starts) - 1
    # a newline stands between the texts; newlines within them are marked apart from it
    raw = buffer[: int(starts[-1])].copy()
    raw[raw == 10] = 32
    raw[starts - 1] = 10
    codes = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    owner = np.cumsum(codes == 10) - 1
    code = letters()[codes]
    keep = (code != 32) | (codes == 10)
    keep[1:] |= code[:-1] != 32
    code, owner = code[keep].astype(np.uint64), owner[keep]
    trigrams = (code[:-2] << np.uint64(42)) | (code[1:-1] << np.uint64(21)) | code[2:]
    owner = owner[:-2]
    # within one text, and the middle a letter or a space between letters
    inside = owner == np.minimum(owner, np.searchsorted(np.cumsum(np.bincount(owner, minlength=n + 1)), np.arange(len(owner)), "right"))
    some = inside & ((code[:-2] != 32) | (code[1:-1] != 32)) & ((code[1:-1] != 32) | (code[2:] != 32))
    names, number = np.unique(trigrams[some], return_inverse=True)
    owner = owner[some]
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    out = np.zeros((n, DIMENSIONS), np.float32)
    for first in range(0, len(names), TRIGRAMS):
        a, b = np.searchsorted(number, [first, first + TRIGRAMS])
        width = min(TRIGRAMS, len(names) - first)
        tally = np.bincount(owner[a:b] * width + number[a:b] - first, minlength=n * width)[: n * width]
        out += tally.reshape(n, width).astype(np.float32) @ trigram_vectors(names[first : first + TRIGRAMS])
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def learn(documents: DataFrame, sample_texts: int = SAMPLE_TEXTS):
    """(languages by name, their unit vectors) from documents(doc_id, text, lang)."""
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    )
    rows = rows.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~training_fold(F.col("doc_id"), FOLDS, 0))
    rates = rows.groupBy("lang").agg((F.lit(float(sample_texts)) / F.count("*")).alias("__rate"))
    drawn = rows.join(broadcast_if_small(rates), "lang")
    drawn = drawn.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("__rate") * (1 << 30)).select("lang", "text")

    def bundled(batches):
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for i, j, buffer, starts in text_slices(batch, "text"):
                vectors = slice_vectors(buffer, starts)
                names, number = np.unique(langs[i:j].astype(str), return_inverse=True)
                sums = [vectors[number == k].astype(np.float64).sum(axis=0).tobytes() for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([pa.array(names.tolist(), pa.string()), pa.array(sums, pa.binary())], ["lang", "vector"])

    def summed(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v, np.float64) for v in table.column("vector").to_pylist())
        return pa.table({"lang": [table.column("lang")[0].as_py()], "vector": [total.tobytes()]})

    schema = "lang string, vector binary"
    found = drawn.mapInArrow(bundled, schema).groupBy("lang").applyInArrow(summed, schema).collect()
    profiles = {r["lang"]: np.frombuffer(r["vector"], np.float64) for r in found}
    names = sorted(k for k, v in profiles.items() if v.any())
    return names, np.array([profiles[k] / np.linalg.norm(profiles[k]) for k in names], np.float32).reshape(len(names), DIMENSIONS)


def identify(documents: DataFrame, names: list[str], vectors: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score of every document row."""

    def predicted(batches):
        for batch in batches:
            for i, j, buffer, starts in text_slices(batch, "text"):
                own = slice_vectors(buffer, starts)
                cosine = own @ vectors.T if len(names) else np.zeros((j - i, 1), np.float32)
                best = cosine.argmax(axis=1)
                empty = ~own.any(axis=1) | (not names)
                langs = [UNKNOWN if e else names[k] for e, k in zip(empty.tolist(), best.tolist())]
                score = np.where(empty, 0, np.clip(cosine.max(axis=1).astype(np.float64), 0, 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(langs, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"]
                )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(predicted, "doc_id long, lang_pred string, score double")


def language_of(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document row."""
    found = identify(documents, *learn(documents))
    return found.select("doc_id", training_fold(F.col("doc_id"), FOLDS, 0).alias("held_out"), "lang_pred", "score")
