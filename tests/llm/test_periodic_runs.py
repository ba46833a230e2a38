"""Periodic runs against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from groundwell.llm import periodic_runs as operator
from groundwell.llm.periodic_runs import find_runs, runs_digest
from groundwell.llm.suffix_access import LastOccurrences, SuffixAutomaton, periodic_runs
from tests.conftest import SMALL
from tests.llm.frames import awkward, none


def brute(words, least=24, periods=3):
    names = {w: k for k, w in enumerate(dict.fromkeys(words))}
    own, n, out = np.array([names[w] for w in words], np.int64), len(words), []
    for q in range(1, n // periods + 1):
        edges = np.flatnonzero(np.diff(own[:-q] == own[q:], prepend=False, append=False))
        first, size = edges[0::2], edges[1::2] - edges[0::2] + q
        long = np.flatnonzero(size >= max(least, periods * q))
        for j, size in zip(first[long].tolist(), size[long].tolist()):
            part = own[j : j + size]
            if not any((part[r:] == part[:-r]).all() for r in range(1, q)):
                out.append((j, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def tailed(doc_id, words):
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def digest_of(doc_id, text):
    words = tailed(doc_id, re.findall("[^\x20\x09-\x0D]+", text or ""))
    runs = brute(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + size for s, size, q in runs)]
    best = None
    for s, size, q in runs:
        if best is None or size * best[2] > best[1] * q:
            best = (s, size, q)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *shown, sha(lines), sha(" ".join(kept)))


def check(docs):
    got = collections.Counter(tuple(r) for r in runs_digest(find_runs(docs, tails=True)).collect())
    assert got == collections.Counter(digest_of(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    return got


@pytest.mark.parametrize("least, periods", [(1, 2), (4, 2), (6, 3), (24, 3)])
def test_runs_of_random_sequences(least, periods):
    draw = random.Random(least)
    for _ in range(600):
        n = draw.randint(0, 70)
        words = [draw.randrange(draw.choice([1, 2, 2, 3, 5])) for _ in range(n)]
        if n > 3 and draw.random() < 0.5:
            a, p = draw.randrange(n), draw.randint(1, max(1, n // 4))
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)] if a + p <= n else words
        assert periodic_runs(words, least, periods) == brute(words, least, periods)


def test_access_meets_last_occurrences():
    """Each piece is the longest suffix that ends at its colour and nowhere in between."""
    draw = random.Random(2)
    words = [draw.randrange(2) for _ in range(120)]
    automaton = SuffixAutomaton()
    nodes = [automaton.append(c) for c in words]
    paths = LastOccurrences(automaton.link)
    for i, node in enumerate(nodes):
        got = {(e, automaton.length[x]) for e, x in paths.access(node, i)}
        last = {}
        for size in range(1, i + 1):
            ends = [e for e in range(size - 1, i) if words[e - size + 1 : e + 1] == words[i - size + 1 : i + 1]]
            if ends:
                last[ends[-1]] = size
        assert got == set(last.items())


def test_stretches_hold_every_run():
    """Numbers for words: runs of all periods between words that do not repeat, and runs side by side."""
    draw = random.Random(4)
    for _ in range(300):
        texts = []
        for _ in range(draw.randint(1, 4)):
            words = []
            for _ in range(draw.randint(0, 4)):
                words += [draw.randrange(1000) for _ in range(draw.randint(0, 40))]
                q = draw.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 30])
                block = [draw.randrange(draw.choice([2, 50])) for _ in range(q)]
                words += (block * 30)[: max(24, 3 * q) + draw.randint(-2, 20)]
            texts.append(words)
        bounds = np.cumsum([0, *map(len, texts)])
        got = operator.runs_of_slice(np.array([w for t in texts for w in t], np.int64), bounds, 24, 3)
        assert got == {k: runs for k, t in enumerate(texts) if (runs := brute(t))}


def test_awkward_rows(spark):
    check(awkward(spark))
    assert find_runs(none(spark)).count() == 0
    with pytest.raises(ValueError):
        find_runs(none(spark), least=10)


def test_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter("n_chars < 8000")
    assert sum(n for row, n in check(docs).items() if row[1]) > 5


def test_planted_texts(spark):
    line = "this line of seven words stands here"
    texts = [
        (line + "\n") * 20,
        "before " + "word " * 24 + "after",
        "before " + "word " * 23 + "after",
        "A a " * 12,
        "a b c d e f g h " * 3,
        " ".join(f"w{i}" for i in range(40)) + " " + line + " x " + line,
        "\t" + "x y " * 20 + " x y x y " + "x " * 30,
        "é ü " * 15 + "\U0001f600 " * 30,
        ("ab ab ac " * 9 + "stop ") * 4,
    ]
    rows = [(7 * k, text) for k, text in enumerate(texts)] + [(100 + k, text) for k, text in enumerate(texts)] + [(None, texts[0])]
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10 == 0][:40]
    rows += [(i, " ".join(f"t{k}" for k in range(3 * n))) for n, i in enumerate(ids)]
    got = check(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sum(row[1] > 0 for row in got) > 25


def test_real_outputs(spark):
    docs = spark.createDataFrame([(1, "say " + "la di " * 15 + "da")], "doc_id long, text string")
    (row,) = find_runs(docs).collect()
    assert row["n_words"] == 32 and [tuple(r) for r in row["runs"]] == [(1, 30, 2)] and row["collapsed"] == "say la di da"
