"""Small tables with the awkward rows, and formulas that several tests hold results against."""

import collections
import math

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text):
    return (text or "").translate(str.maketrans(UPPER, LOWER))


def awkward(spark):
    """Nulls in every column, empty and very long texts, copies, repeated rows, a null id and extra
    columns named as results are."""
    long = " ".join(f"word{i % 977} of" for i in range(30_000))
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "en", "a", 60),
        (2, "alpha BETA gamma delta epsilon zeta eta theta iota kappa lambda", "en", "a", 60),
        (3, None, None, None, None),
        (4, "", "en", "b", 0),
        (5, long, "de", "b", len(long)),
        (6, long, "de", None, len(long)),
        (7, long + " x", "de", "b", None),
        (8, "der die das und nicht", "de", "b", 21),
        (8, "der die das und nicht", "de", "b", 21),
        (None, "alpha beta", "en", "a", 10),
        (9, "\t \n", "fr", "a", 3),
        (10, "É é à \U0001f600 ß", "fr", "c", 9),
        (-11, "Licensed under the Apache License, Version 2.0.", "en", "c", 47),
    ]
    frame = spark.createDataFrame(rows, DOCS)
    for name in ("score", "keep_id", "shard", "n_words", "uid"):
        frame = frame.selectExpr("*", f"'clash' AS {name}")
    return frame


def none(spark):
    return spark.createDataFrame([], DOCS)


def trigram_scores(rows, weights):
    """log10 scores of (held out, tokens with the end) rows, by the docstring of ngram_trie: every context seen in
    training counts, and a word without a count backs off like any other."""
    grams = [collections.Counter() for _ in range(3)]
    after = [collections.Counter() for _ in range(3)]
    padded = [(held, [None, *x]) for held, x in rows]
    for held, y in padded:
        for k in range(1, len(y) if not held else 0):
            for order in range(min(3, k + 1)):
                grams[order][tuple(y[k - order : k + 1])] += 1
                after[order][tuple(y[k - order : k])] += 1
    n, types = sum(grams[0].values()), len(grams[0])
    once, twice = (sum(c == k for c in grams[0].values()) for k in (1, 2))
    d = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5
    out = []
    for _, y in padded:
        score = 0.0
        for k in range(1, len(y)):
            c = grams[0][(y[k],)]
            p = (c - d) / n if c else d * types / n
            for order in range(1, min(3, k + 1)):
                m, context = weights[order + 1], tuple(y[k - order : k])
                p = (grams[order][tuple(y[k - order : k + 1])] + m * p) / (after[order][context] + m)
            score += math.log10(p)
        out.append(score)
    return out
