"""Resampling of documents towards a target corpus, by importance weights over hashed word features.

Each document's features (crc_buckets) are written once as bucket numbers. Their counts over all documents and
over all target texts give every bucket a gain, the scaled log ratio of the two smoothed
frequencies; a document's weight is the floored mean gain of its features. A Gumbel variate from the hash of the
document's id is added, and the documents with the highest sums are drawn, which is sampling without
replacement in proportion to exp(weight / 1000).

Driver: one count a bucket, one count a distinct score (scores are integers of a bounded range) and one a range of
about RANGE_ROWS drawn rows. The ranks come from a range partitioning of the rows at or above the cut score, numbered
within their partitions and shifted by the partitions before; rows of one score, and repeated rows, part by id and row
number, so none is hot.

Defined results: null and empty texts, and texts without words, have no features and weight 0; a document of one word has one
feature; a null id hashes as empty and ranks behind the other ids of its score; repeated rows are ranked each; without
target texts T is 0; an empty table gives no rows. Columns other than doc_id and text are not read.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwell.llm.crc_buckets import FEATURES, bucket_lists, bucket_totals, feature_rows
from groundwell.session import staged

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 25
SEED = 7
RANGE_ROWS = 200_000


def features(texts: DataFrame, buckets: int, name: str) -> DataFrame:
    """doc_id, n_words, n_features, buckets of every row of (doc_id, text), in the work folder."""
    rows = texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return staged(rows.mapInArrow(lambda batches: feature_rows(batches, buckets), FEATURES), name)


def counts(found: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs."""
    out = np.zeros(buckets, np.int64)
    rows = found.select("buckets").mapInArrow(lambda batches: bucket_totals(batches, buckets), "bucket long, n long")
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the target frequency over the corpus frequency), each count plus one."""
    ratio = (target + 1.0) * float(raw.sum() + len(raw)) / ((raw + 1.0) * float(target.sum() + len(raw)))
    return np.floor(1000.0 * np.log(ratio)).astype(np.int64)


def weights(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: the floored mean gain of each row's features."""

    def weighed(batches):
        for batch in batches:
            own, bounds = bucket_lists(batch, len(gain))
            total = np.concatenate(([0], np.cumsum(gain[own])))[bounds]
            n = np.diff(bounds)
            mean = np.where(n > 0, np.diff(total) // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(mean, pa.int64())], ["doc_id", "n_words", "n_features", "weight"]
            )

    return found.mapInArrow(weighed, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id, seed: int):
    """floor of 1000 times a Gumbel variate, fixed by the seed and the id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked_from(rows: DataFrame, n: int) -> DataFrame:
    """The n rows of (score, doc_id, uid, ...) with `rank` 1, 2, ... by score downwards, then by id."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("uid").asc()]
    parts = max(1, math.ceil(n / RANGE_ROWS))
    held = staged(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "drawn")
    held = held.withColumn("part", F.shiftright("at", 33))
    sizes = sorted((r["part"], r["n"]) for r in held.groupBy("part").agg(F.count("*").alias("n")).collect())
    before, shifts = 0, []
    for part, size in sizes:
        shifts.append((part, before))
        before += size
    shift = rows.sparkSession.createDataFrame(shifts, "part long, shift long")
    place = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return held.join(F.broadcast(shift), "part").withColumn("rank", F.col("shift") + place + 1).drop("part", "at", "shift")


def resample(
    documents: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = SEED
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document row; `target` has a column text. Of the rows
    with at least `min_words` words the floor of `percent` in a hundred is drawn; rank is null for the others."""
    found = features(documents, buckets, "features")
    wanted = features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets, "target_features")
    gain = gains(counts(found, buckets), counts(wanted, buckets))
    scored = weights(found, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).withColumn("uid", F.monotonically_increasing_id())
    scored = staged(scored, "weights")
    able = F.col("n_words") >= min_words
    histogram = scored.filter(able).groupBy("score").agg(F.count("*").alias("n")).collect()
    draw = sum(r["n"] for r in histogram) * percent // 100
    reached, cut = 0, None
    for r in sorted(histogram, key=lambda r: -r["score"]):
        if reached >= draw:
            break
        reached, cut = reached + r["n"], r["score"]
    if cut is None:
        return scored.withColumn("rank", F.lit(None).cast("long")).drop("uid")
    above = able & (F.col("score") >= cut)
    drawn = ranked_from(scored.filter(above), reached).withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    rest = scored.filter(~above).withColumn("rank", F.lit(None).cast("long"))
    return rest.unionByName(drawn).drop("uid")


def resampling_digest(resampled: DataFrame) -> DataFrame:
    return resampled.select("doc_id", "n_features", "weight", "score", "rank")
