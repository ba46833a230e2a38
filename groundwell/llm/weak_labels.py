"""Quality scores from weak labels.

Heuristic labellers vote good, bad or nothing on every document. The votes of all documents are counted
by pattern (at most 3 ** labellers rows, whatever the corpus), and expectation-maximisation over that
table estimates how often each labeller gives each vote for good and for bad documents, taking votes as
independent given the class. Each pattern so has a posterior, the label of the documents that show it.
Posteriors of a sample of at most about SAMPLE_TEXTS documents, drawn by a hash of the id, train a logistic scorer
over hashed byte trigrams, which scores every document from its whole text. No given label is used.

Defined results: null and empty texts get votes like any other, the length labeller's among them, and the
scorer's bias; repeated rows count each; an empty table gives no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwell.llm.arrays import LANE_MASK, LOWER, NOT_SPACE, hash_words, lanes, mix, text_slices, words_in
from groundwell.session import staged

BUCKETS = 4096
SAMPLE_TEXTS = 3000
BAD, GOOD, NOTHING = 0, 1, 2

# Frequent function words of the languages at hand; a fixed list.
FUNCTION_WORDS = (
    "the of and to in a is that it for on as with was at by be this are from "
    "der die und das von zu den mit des im ist nicht ein eine auf dem "
    "le la les des du et en un une que pour dans est par sur "
    "el los las de que y en un una por con para del se no"
).split()

LABELLERS = ["symbols", "capitals", "variety", "length", "function_words", "word_length", "repeated_lines"]


def votes(buffer: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of votes per text of a slice."""
    n, end = len(starts) - 1, int(starts[-1])
    raw = buffer[:end]
    low = LOWER[raw]
    size = np.maximum(np.diff(starts) - 1, 1)

    def share(mask):
        total = np.concatenate(([0], np.cumsum(mask)))
        return (total[starts[1:] - 1] - total[starts[:-1]]) / size

    odd = np.zeros(256, bool)
    odd[[ord(c) for c in "#$%&*@^~|<>{}[]=_\\"]] = True
    capital = np.zeros(256, bool)
    capital[65:91] = True
    letter = capital.copy()
    letter[97:123] = True
    at, length = words_in(low, end, NOT_SPACE)
    hashes = hash_words(buffer_padded(low, buffer), at, length)
    bounds = np.searchsorted(at, starts)
    n_words = np.diff(bounds)
    owner = np.repeat(np.arange(n), n_words)
    order = np.lexsort((hashes, owner))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][new], minlength=n)
    many = np.maximum(n_words, 1)
    flat = np.frombuffer(b" ".join(w.encode() for w in FUNCTION_WORDS) + bytes(40), np.uint8)
    wl = np.array([len(w.encode()) for w in FUNCTION_WORDS])
    function = hash_words(flat, np.cumsum(wl + 1) - wl - 1, wl)
    functional = np.bincount(owner, np.isin(hashes, function), n) / many
    mean = np.bincount(owner, length, n) / many
    breaks = np.flatnonzero(low == 10)
    line_at, line_size = breaks[:-1] + 1, np.diff(breaks) - 1
    own = np.flatnonzero(line_size > 0)
    line_at, line_size = line_at[own], line_size[own]
    line_hash = hash_words(buffer_padded(low, buffer), line_at, line_size)
    line_owner = np.searchsorted(starts, line_at, "right") - 1
    order = np.lexsort((line_hash, line_owner))
    again = np.zeros(len(order), bool)
    again[1:] = (line_hash[order][1:] == line_hash[order][:-1]) & (line_owner[order][1:] == line_owner[order][:-1])
    n_lines = np.bincount(line_owner, minlength=n)
    repeated = np.bincount(line_owner[order], again, n) / np.maximum(n_lines, 1)

    def vote(bad, good, valid=True):
        return np.where(bad & valid, BAD, np.where(good & valid, GOOD, NOTHING))

    symbols, letters = share(odd[raw]), share(letter[raw])
    capitals = share(capital[raw]) / np.maximum(letters, 1e-9)
    variety = distinct / many
    return np.stack(
        [
            vote(symbols > 0.03, symbols < 0.005),
            vote(capitals > 0.4, capitals < 0.15, letters > 0),
            vote(variety < 0.35, variety > 0.5, n_words >= 20),
            vote(n_words < 8, n_words >= 50),
            vote(functional < 0.05, functional > 0.12, n_words >= 8),
            vote((mean < 2.5) | (mean > 12), (mean > 3.5) & (mean < 9), n_words > 0),
            vote(repeated > 0.25, repeated < 0.05, n_lines >= 3),
        ],
        axis=1,
    ).astype(np.int64)


def buffer_padded(low, buffer):
    return np.concatenate((low, buffer[len(low) :]))


def pattern_of(cast: np.ndarray) -> np.ndarray:
    return cast @ (3 ** np.arange(cast.shape[1]))


def fit_labellers(counts: dict[int, int], labellers: int, rounds: int = 200):
    """(prior of good, table [class, labeller, vote], posterior of good by pattern) by EM."""
    patterns = np.array(sorted(counts), np.int64)
    weight = np.array([counts[p] for p in patterns.tolist()], float)
    cast = (patterns[:, None] // 3 ** np.arange(labellers)) % 3
    good, bad = (cast == GOOD).sum(axis=1), (cast == BAD).sum(axis=1)
    # starts from the vote, bad weighing more: most heuristics fire on their own kind of junk only
    posterior = np.clip((good + 1) / (good + 3 * bad + 1.5), 0.02, 0.98)
    prior, table = 0.5, None
    for _ in range(rounds):
        q = np.stack([1 - posterior, posterior]) * weight
        prior = float(np.clip(q[1].sum() / max(q.sum(), 1e-9), 0.01, 0.99))
        table = np.stack([[[(q[c] * (cast[:, k] == v)).sum() + 0.5 for v in range(3)] for k in range(labellers)] for c in range(2)])
        table /= table.sum(axis=2, keepdims=True)
        logs = np.stack([np.log(p) + np.log(table[c][np.arange(labellers), cast]).sum(axis=1) for c, p in enumerate((1 - prior, prior))])
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60)))
        moved, posterior = float(np.abs(new - posterior).max(initial=0)), new
        if moved < 1e-9:
            break
    return prior, table, dict(zip(patterns.tolist(), posterior.tolist()))


def trigram_rows(buffer: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rows of hashed byte trigrams: square roots of their shares in the text."""
    n, end = len(starts) - 1, int(starts[-1])
    at = np.arange(max(0, end - 2))
    slot = (mix(lanes(buffer)[at] & LANE_MASK[3]) % np.uint64(BUCKETS)).astype(np.int64)
    owner = np.repeat(np.arange(n), np.diff(starts))[: len(at) - 1] if n else at[:0]
    tally = np.bincount(owner * BUCKETS + slot[1 : 1 + len(owner)], minlength=n * BUCKETS)[: n * BUCKETS].reshape(n, BUCKETS)
    return np.sqrt(tally / np.maximum(tally.sum(axis=1, keepdims=True), 1)).astype(np.float32)


def fit_scorer(x: np.ndarray, target: np.ndarray, rounds: int = 300, rate: float = 0.05, decay: float = 1e-4):
    """Logistic weights and bias for soft targets, by Adam on all rows."""
    w, m, v = (np.zeros(x.shape[1] + 1) for _ in range(3))
    target = target.astype(np.float32)
    for step in range(1, rounds + 1):
        margin = x @ w[:-1].astype(np.float32) + np.float32(w[-1])
        miss = (1 / (1 + np.exp(-np.clip(margin, -60, 60))) - target) / max(1, len(x))
        g = np.append(miss @ x + decay * w[:-1], miss.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1].astype(np.float32), float(w[-1])


def score_quality(documents: DataFrame, sample_texts: int = SAMPLE_TEXTS) -> DataFrame:
    """doc_id, n_votes, posterior, score, predicted of every document row."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def cast_votes(batches):
        for batch in batches:
            total: dict[int, int] = {}
            for i, j, buffer, starts in text_slices(batch, "text"):
                names, n = np.unique(pattern_of(votes(buffer, starts)), return_counts=True)
                for p, k in zip(names.tolist(), n.tolist()):
                    total[p] = total.get(p, 0) + k
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["pattern", "n"])

    tally = rows.mapInArrow(cast_votes, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    counts = {r["pattern"]: r["n"] for r in tally.collect()}
    posterior = fit_labellers(counts, len(LABELLERS))[2]
    total = max(1, sum(counts.values()))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample_texts / total))

    def sampled(batches):
        for batch in batches:
            for i, j, buffer, starts in text_slices(batch, "text"):
                x = trigram_rows(buffer, starts).astype(np.float16)
                y = [posterior[p] for p in pattern_of(votes(buffer, starts)).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), pa.array(y, pa.float64())], ["x", "y"])

    drawn = staged(rows.filter(draw).limit(2 * sample_texts).mapInArrow(sampled, "x binary, y double"), "quality_sample").collect()
    x = np.frombuffer(b"".join(r["x"] for r in drawn), np.float16).reshape(-1, BUCKETS).astype(np.float32)
    w, b = fit_scorer(x, np.array([r["y"] for r in drawn]))

    def scored(batches):
        for batch in batches:
            for i, j, buffer, starts in text_slices(batch, "text"):
                cast = votes(buffer, starts)
                score = 1 / (1 + np.exp(-np.clip(trigram_rows(buffer, starts) @ w + b, -60, 60)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array((cast != NOTHING).sum(axis=1).astype(np.int64)),
                        pa.array([posterior[p] for p in pattern_of(cast).tolist()], pa.float64()),
                        pa.array(score.astype(np.float64)),
                        pa.array((score >= 0.5).astype(np.int32)),
                    ],
                    ["doc_id", "n_votes", "posterior", "score", "predicted"],
                )

    return rows.mapInArrow(scored, "doc_id long, n_votes long, posterior double, score double, predicted int")
