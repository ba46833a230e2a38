"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over presence features is trained in numpy from texts known to be toxic and from
texts of unknown kind. With class prior p the risk of taking all unlabelled texts as clean
is corrected by the toxic share among them:

    p * E_toxic[loss(g)] + max(0, E_unlabelled[loss(-g)] - p * E_toxic[loss(-g)])

While a mini-batch has the second term below zero the step goes the other way on that
term, so the classifier does not fit the unlabelled texts beyond what the prior allows.

Labels that say "not toxic" are used for the prior only: p is the toxic share of the labelled rows
outside the held-out fold. The fit uses at most about POSITIVES toxic and UNLABELLED other texts, drawn
by a hash of the id; FEATURES features are kept, those whose shares in the two sets
differ most clearly. Every document is scored from its whole text alone.

Defined results: null and empty texts have no features and score as the bias says; without toxic
training rows every score is 0; labels repeated for an id count as toxic if any is; rows without an id
are never training rows.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwell.llm.ranks import training_fold
from groundwell.llm.word_features import document_counts, linear_scores, presence
from groundwell.session import staged

POSITIVES = 4000
UNLABELLED = 8000
FEATURES = 2048
FOLDS = 5


def draw(share: float, salt: int):
    """About `share` of the ids, always the same ones."""
    return F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, share))


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 100, batch: int = 1024, rate: float = 0.05, decay: float = 1e-5, seed: int = 7):
    """Weights and bias of the non-negative risk's minimum by Adam; sigmoid loss, whose bound keeps
    the difference of the two clean risks from drowning in far-off margins."""
    rng = np.random.default_rng(seed)
    n = positive.shape[1]
    w = np.zeros(n + 1)
    m, v, step = np.zeros(n + 1), np.zeros(n + 1), 0
    w[n] = -1.0
    rounds = max(2, -(-len(unlabelled) // batch))
    for _ in range(epochs):
        p_order, u_order = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
        for p_rows, u_rows in zip(np.array_split(np.resize(p_order, max(len(p_order), rounds)), rounds), np.array_split(np.resize(u_order, max(len(u_order), rounds)), rounds)):
            p, u = positive[p_rows].astype(np.float32), unlabelled[u_rows].astype(np.float32)
            gp, gu = p @ w[:n] + w[n], u @ w[:n] + w[n]
            sp, su = 1 / (1 + np.exp(-np.clip(gp, -60, 60))), 1 / (1 + np.exp(-np.clip(gu, -60, 60)))
            rest = su.mean() - prior * sp.mean()
            # derivatives of the two terms by the margins
            toxic = clean_p = -prior * sp * (1 - sp) / len(p)
            clean_u = su * (1 - su) / len(u)
            if rest >= 0:
                dp, du = toxic + clean_p, clean_u
            else:
                dp, du = -clean_p, -clean_u
            g = np.concatenate((dp @ p + du @ u, [dp.sum() + du.sum()])) + decay * np.append(w[:n], 0)
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:n], float(w[n])


def train(documents: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, features: int = FEATURES):
    """(features, weights, bias, prior), or None without a toxic training row."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.filter(F.col("doc_id").isNotNull() & ~training_fold(F.col("doc_id"), FOLDS, 0))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marks = marks.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~training_fold(F.col("doc_id"), FOLDS, 0))
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known, toxic = marks.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    total = rows.count()
    if not toxic or not total:
        return None
    prior = min(0.9, max(0.001, toxic / known))
    # only drawn ids meet the texts; the two draws are bounded by their shares
    chosen = marks.filter((F.col("toxic") == 1) & draw(positives / toxic, 1)).select("doc_id", F.lit(1).alias("p"))
    drawn = rows.filter(draw(unlabelled / total, 2)).select(F.lit(0).alias("p"), F.lit(1).alias("u"), "text")
    ids = {r["doc_id"] for r in chosen.limit(2 * positives).collect()}
    marked = rows.filter(F.col("doc_id").isin(*ids)).select(F.lit(1).alias("p"), F.lit(0).alias("u"), "text") if ids else rows.limit(0).select(F.lit(1).alias("p"), F.lit(0).alias("u"), "text")
    sample = staged(drawn.unionByName(marked), "toxicity_sample")
    n = sample.agg(F.sum("p"), F.sum("u")).first()
    if not n[0] or not n[1]:
        return None
    counts = document_counts(sample, ["p", "u"])
    share_p, share_u = F.col("p") / n[0], F.col("u") / n[1]
    both = (F.col("p") + F.col("u")) / (n[0] + n[1])
    spread = F.sqrt(both * (1 - both) * (1 / n[0] + 1 / n[1]) + 1e-9)
    best = counts.filter("p + u >= 3").withColumn("z", F.abs(share_p - share_u) / spread).orderBy(F.desc("z"), "feature").limit(features)
    picked = np.sort(np.array([r["feature"] for r in best.collect()], np.int64).view(np.uint64))
    side, matrix = presence(sample, picked, ["p", "u"])
    w, b = fit_pu(matrix[side[:, 0] == 1], matrix[side[:, 1] == 1], prior)
    return picked, w, b, prior


def score_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document row."""
    model = train(documents, labels)
    if model is None:
        scored = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0.0).alias("score"))
    else:
        scored = linear_scores(documents, *model[:3])
    return scored.select(
        "doc_id",
        training_fold(F.col("doc_id"), FOLDS, 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
