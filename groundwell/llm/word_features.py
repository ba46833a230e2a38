"""Sparse text features: five-byte strings within words and at their starts, and whole words."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwell.llm.arrays import LANE_MASK, WORD_BYTES, flat_words, hash_words, lanes, text_slices

GRAM = 5
_FILTER_BITS = 20


def slice_features(buffer: np.ndarray, starts: np.ndarray):
    """(feature numbers, text numbers) of all occurrences in a slice. A five-byte string is its own
    40-bit number, a whole word a hash with the top bit set."""
    flat, first, length, bounds = flat_words(buffer, starts, WORD_BYTES)
    end = len(flat) - 40
    space = np.flatnonzero(flat[:end] == 32)
    at = np.arange(max(0, end - GRAM + 1))
    # a string may begin with the space before a word, and holds no other
    nearest = np.full(end + 1, end, np.int64)
    nearest[space] = space
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]
    grams = at[nearest[at + 1] >= at + GRAM]
    values = lanes(flat)[grams] & LANE_MASK[GRAM]
    words = hash_words(flat, first, length) | np.uint64(1 << 63)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(bounds))
    text_ends = np.concatenate((first, [end]))[bounds[1:]] - 1
    of_gram = np.searchsorted(text_ends, grams, "right")
    return np.concatenate((values, words)), np.concatenate((of_gram, owner))


class Picked:
    """Finds which of a small set of features occur; a bitmap of their hashes turns nearly all away."""

    def __init__(self, features: np.ndarray):
        self.features = np.sort(features.astype(np.uint64))
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self._slot(self.features)] = True

    @staticmethod
    def _slot(values):
        return (values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _FILTER_BITS)

    def present(self, buffer: np.ndarray, starts: np.ndarray):
        """(text, feature) numbers, each pair once, ordered."""
        values, owner = slice_features(buffer, starts)
        maybe = np.flatnonzero(self.filter[self._slot(values)])
        values, owner = values[maybe], owner[maybe]
        slot = np.searchsorted(self.features, values)
        slot[slot == len(self.features)] = 0
        hit = self.features[slot] == values if len(self.features) else np.zeros(len(slot), bool)
        n = max(1, len(self.features))
        pairs = np.unique(owner[hit] * n + slot[hit])
        return pairs // n, pairs % n


def document_counts(texts: DataFrame, classes: list[str]) -> DataFrame:
    """feature and, for each of the 0/1 columns `classes`, the number of its texts that hold it."""

    def counted(batches):
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in classes])
            for i, j, buffer, starts in text_slices(batch, "text"):
                values, owner = slice_features(buffer, starts)
                names, number = np.unique(values, return_inverse=True)
                pairs = np.unique(number * np.int64(j - i) + owner)
                number, owner = pairs // (j - i), pairs % (j - i)
                columns = [np.bincount(number, marks[k, i:j][owner], len(names)).astype(np.int64) for k in range(len(classes))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names.view(np.int64)), *map(pa.array, columns)], ["feature", *classes]
                )

    schema = "feature long, " + ", ".join(f"{c} long" for c in classes)
    rows = texts.select("text", *classes).mapInArrow(counted, schema)
    return rows.groupBy("feature").agg(*(F.sum(c).alias(c) for c in classes))


def presence(texts: DataFrame, features: np.ndarray, columns: list[str]):
    """(values of `columns`, matrix of 0/1) of texts in collected form; for bounded samples."""

    def found(batches):
        picked = Picked(features)
        for batch in batches:
            for i, j, buffer, starts in text_slices(batch, "text"):
                matrix = np.zeros((j - i, len(picked.features)), np.uint8)
                matrix[picked.present(buffer, starts)] = 1
                bits = [row.tobytes() for row in np.packbits(matrix, axis=1)]
                own = [batch.column(c).slice(i, j - i) for c in columns]
                yield pa.RecordBatch.from_arrays([*own, pa.array(bits, pa.binary())], [*columns, "bits"])

    rows = texts.select("text", *(F.col(c).cast("double").alias(c) for c in columns))
    rows = rows.mapInArrow(found, ", ".join(f"{c} double" for c in columns) + ", bits binary").collect()
    marks = np.array([[r[c] for c in columns] for r in rows], float).reshape(-1, len(columns))
    bits = np.frombuffer(b"".join(r["bits"] for r in rows), np.uint8).reshape(len(rows), -1)
    return marks, np.unpackbits(bits, axis=1)[:, : len(features)] if len(rows) else np.zeros((0, len(features)), np.uint8)


def linear_scores(documents: DataFrame, features: np.ndarray, weights: np.ndarray, bias: float) -> DataFrame:
    """doc_id and score = sigmoid(bias + weights of the features present) of every document row;
    `weights` in the order of the sorted features."""

    def scored(batches):
        picked = Picked(features)
        for batch in batches:
            for i, j, buffer, starts in text_slices(batch, "text"):
                text, feature = picked.present(buffer, starts)
                margin = bias + np.bincount(text, weights[feature], j - i)
                score = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(score)], ["doc_id", "score"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scored, "doc_id long, score double")


def rows_below(documents: DataFrame, features: np.ndarray, weights: np.ndarray, bias: float, most: float) -> DataFrame:
    """The rows of `documents`, all their columns, whose score (linear_scores) is below `most`; narrow."""

    def kept(batches):
        picked = Picked(features)
        for batch in batches:
            for i, j, buffer, starts in text_slices(batch, "text"):
                text, feature = picked.present(buffer, starts)
                margin = bias + np.bincount(text, weights[feature], j - i)
                score = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
                yield batch.slice(i, j - i).filter(pa.array(score < most))

    return documents.mapInArrow(kept, documents.schema)
