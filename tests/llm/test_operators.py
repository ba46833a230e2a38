"""The dealt operators against brute force, and on awkward rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from checks.compare import connect, differences
from groundwell.llm import ngram_trie, positional_index, queries
from groundwell.llm.arrays import pack_varints, unpack_varints
from groundwell.llm.block_naming import exact_groups
from groundwell.llm.elias_fano import EliasFano
from groundwell.llm.fingerprints import fingerprints
from groundwell.llm.histogram_packing import Plan, pack, packing_digest
from groundwell.llm.hyperdimensional import identify, language_of, learn
from groundwell.llm.kd_shards import metadata_shards
from groundwell.llm.oracle import ORACLE
from groundwell.llm.positive_unlabelled import fit_pu, score_toxicity
from groundwell.llm.sentence_rules import license_digest, license_scan, match_rules
from groundwell.llm.vantage_points import fit_tree, linked, near_groups, route, stars
from groundwell.llm.weak_labels import BAD, GOOD, fit_labellers, pattern_of, score_quality
from tests.conftest import SMALL
from tests.llm.frames import awkward, lowered, none, trigram_scores

LABELS = "doc_id long, quality int, toxic int"


def rows(frame):
    return [r.asDict() for r in frame.collect()]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equal_to_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SMALL), connect(SMALL), ORACLE[name]) is None


def test_varints_and_elias_fano():
    values = np.array([0, 1, 127, 128, 2**40, 2**63], np.uint64)
    assert (unpack_varints(pack_varints(values)) == values).all()
    held = np.sort(np.random.default_rng(0).integers(0, 10**9, 3000))
    ef = EliasFano(EliasFano.encode(held, 10**9))
    assert (ef.at(np.arange(3000)) == held).all()
    asked, zero = np.arange(0, 10**9, 10**7), np.zeros(100, np.int64)
    assert (ef.successor(zero, zero + 3000, asked) == np.searchsorted(held, asked)).all()


def test_exact_groups(spark):
    docs = awkward(spark)
    got = rows(exact_groups(docs))
    groups = collections.defaultdict(list)
    for r in docs.collect():
        groups[lowered(r["text"])].append(r["doc_id"])
    assert len(got) == docs.count()
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_sha[r["text_sha256"]]
        largest = max((i for i in ids if i is not None), default=None)
        assert (r["keep_id"], r["group_size"]) == (largest, len(ids))
    assert sum(r["kept"] for r in got) == len(groups)
    assert exact_groups(none(spark)).count() == 0


def test_fingerprints_and_components(spark):
    docs = awkward(spark).unionByName(awkward(spark).filter("doc_id = 1").withColumn("doc_id", F.lit(77).cast("long")))
    got = rows(near_groups(docs))

    def brute(text):
        words = re.findall("[^\x20\x09-\x0D]+", lowered(text))
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
        return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))

    wanted = collections.Counter((r["doc_id"], f"{brute(r['text']):016x}") for r in docs.collect())
    assert collections.Counter((r["doc_id"], r["fingerprint"]) for r in got) == wanted
    prints = {int(r["fingerprint"], 16) for r in got}
    for r in got:
        reached, todo = set(), [int(r["fingerprint"], 16)]
        while todo:
            p = todo.pop()
            if p not in reached:
                reached.add(p)
                todo += [q for q in prints if (p ^ q).bit_count() <= 2]
        ids = [x["doc_id"] for x in got if int(x["fingerprint"], 16) in reached and x["doc_id"] is not None]
        assert r["component_id"] == min(ids, default=None)
    assert near_groups(none(spark)).count() == 0
    assert fingerprints(none(spark)).count() == 0


def test_tree_loses_no_link():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    near = base[:900] ^ (np.uint64(1) << rng.integers(0, 64, 900, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 900, dtype=np.uint64))
    centre = base[0] ^ np.array([(1 << a) | (1 << b) for a in range(30) for b in range(30)], np.uint64)
    points = np.unique(np.concatenate([base, near, centre]))
    shards = collections.defaultdict(list)
    for shard, held in route(fit_tree(points[::4], 8, 2), points, 2):
        shards[shard].append(held)
    assert len(shards) > 2
    found = [linked(np.unique(np.concatenate(v)), 2) for v in shards.values()]
    got = stars(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
    x, y = np.nonzero(np.triu(np.bitwise_count(points[:, None] ^ points[None, :]) <= 2, 1))
    wanted = stars(points[x], points[y])
    assert [a.tolist() for a in got] == [a.tolist() for a in wanted]


def test_index_matches(spark):
    docs = awkward(spark)
    items = [(1, "BETA gamma delta"), (2, "of word1 of word2 of word3 of word4 of word5 of word6"), (3, None), (4, "..."), (None, "iota kappa"), (1, "und nicht")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = collections.Counter(tuple(r) for r in positional_index.decontaminate(docs, benchmark).collect())

    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))

    wanted = collections.Counter()
    for r in docs.collect():
        own, hit, found = words(r["text"]), set(), set()
        for item, text in items:
            w = words(text)
            for k in range(max(1, len(w) - 9) if w else 0):
                window = w[k : k + 10]
                for s in range(len(own) - len(window) + 1):
                    if own[s : s + len(window)] == window:
                        hit.update(range(s, s + len(window)))
                        found.add("" if item is None else str(item))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        wanted[(r["doc_id"], len(own), len(hit), len(found), sha, bool(hit))] += 1
    assert got == wanted
    small = positional_index.build_index(docs)
    one = positional_index.search(small, benchmark, block_bytes=20)
    assert sorted(map(str, one.collect())) == sorted(map(str, positional_index.search(small, benchmark).collect()))
    near = spark.createDataFrame([(5, "kappa beta")], "item_id long, text string")
    assert {r["doc_id"] for r in positional_index.search(small, near, within=8).filter("kind = 'near'").collect()} == {1, 2}
    assert positional_index.search(small, near, within=7).count() == 0
    assert positional_index.decontaminate(none(spark), benchmark).count() == 0


def test_language_model(spark, monkeypatch):
    monkeypatch.setattr(ngram_trie, "SHARD_BYTES", 20_000)
    monkeypatch.setattr(ngram_trie, "HOT_COUNT", 300)
    docs = awkward(spark).select("doc_id", "text").unionByName(spark.read.parquet(f"{SMALL}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    got = collections.Counter()
    scores = collections.defaultdict(list)
    for r in ngram_trie.score_documents(docs).collect():
        got[(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4))] += 1
        scores[r["doc_id"]].append(r["score"])
    texts = [(r["doc_id"], re.findall("[^\x20\x09-\x0D]+", lowered(r["text"])) + [None]) for r in docs.collect()]
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in texts}
    c1 = collections.Counter(t for i, x in texts if not held[i] for t in x)
    n, v = sum(c1.values()), len(c1)
    wanted = collections.Counter()
    for i, x in texts:
        base = sum(math.log10((c1[t] + 1) / (n + v + 1)) for t in x)
        wanted[(i, held[i], len(x), sum(c1[t] > 0 for t in x), n, round(base, 4))] += 1
    for (i, x), score in zip(texts, trigram_scores([(held[i], x) for i, x in texts], ngram_trie.WEIGHTS)):
        assert min(abs(s - score) for s in scores[i]) <= 0.016 * len(x)
    assert got == wanted
    assert ngram_trie.score_documents(none(spark)).count() == 0


def test_toxicity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    found = score_toxicity(docs, labels).join(labels, "doc_id").filter("held_out").groupBy("toxic").agg(F.avg("predicted").alias("p"))
    share = {r["toxic"]: r["p"] for r in found.collect()}
    assert share[1] > 0.8 and share[0] < 0.01
    odd = awkward(spark)
    marks = spark.createDataFrame([(1, 1, 1), (1, 1, None), (None, 1, 1), (8, 0, 0), (5, None, 0)], LABELS)
    got = rows(score_toxicity(odd, marks))
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert {r["score"] for r in rows(score_toxicity(odd, marks.limit(0)))} == {0.0}
    assert score_toxicity(none(spark), marks).count() == 0


def test_risk_estimator_separates():
    rng = np.random.default_rng(1)
    toxic = (rng.random((300, 20)) < np.r_[[0.8] * 5, [0.2] * 15]).astype(np.uint8)
    clean = (rng.random((2700, 20)) < np.r_[[0.02] * 5, [0.2] * 15]).astype(np.uint8)
    hidden = (rng.random((300, 20)) < np.r_[[0.8] * 5, [0.2] * 15]).astype(np.uint8)
    w, b = fit_pu(toxic, np.concatenate((clean, hidden)), 0.1)
    assert ((hidden @ w + b) > 0).mean() > 0.9 and ((clean @ w + b) > 0).mean() < 0.05


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_of(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    model = learn(docs)
    odd = awkward(spark)
    got = collections.Counter((r["doc_id"], r["lang_pred"]) for r in identify(odd, *model).collect())
    assert got[(3, "und")] == got[(4, "und")] == got[(9, "und")] == 1 and got[(8, "de")] == 2
    empty = language_of(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in empty} == {("und", 0.0)}
    assert language_of(none(spark)).count() == 0


def test_shards(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = metadata_shards(docs.unionByName(docs.filter("doc_id < 10"))).collect()
    assert len(got) == docs.count() + 10
    sizes = collections.defaultdict(list)
    for r in got:
        sizes[r["shard"]].append(r)
    assert sorted(sizes) == list(range(16))
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in sizes.values())
    totals = [sum(r["size"] for r in v) for v in sizes.values()]
    assert max(totals) - min(totals) < 2 * max(r["size"] for r in got)
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert all((r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 1, zlib.crc32(texts[r["doc_id"]])) for r in got)
    odd = awkward(spark)
    assert metadata_shards(odd).count() == odd.count()
    assert metadata_shards(none(spark)).count() == 0


def test_hot_value_is_split(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'same text' AS text", "'en' AS lang", "'s' AS source", "9L AS n_chars")
    counts = [r["count"] for r in metadata_shards(docs).groupBy("shard").count().collect()]
    assert len(counts) == 16 and max(counts) - min(counts) <= 8


def test_packing(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    docs = awkward(spark).select("doc_id", "text").unionByName(spark.createDataFrame([(20, "don't. <|endoftext|>, a\x01b 4a's; ́x"), (21, "x" * 9000 + " y")], "doc_id long, text string"))
    packed = pack(docs, path)
    got, digest = rows(packed), rows(packing_digest(packed))
    by_doc = collections.defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
    for doc_id, group in [(r["doc_id"], r["text"]) for r in docs.collect()]:
        ids = tokenizer.encode(group or "", add_special_tokens=False).ids + [2]
        held = sorted((r["start"], np.frombuffer(r["ids"], "<u4").tolist()) for r in by_doc[doc_id])
        copies = sum(r["start"] == 0 for r in by_doc[doc_id])
        flat = [t for _, part in (held if copies == 1 else []) for t in part]
        assert copies > 1 or flat == ids
        assert all(r["doc_tokens"] == len(ids) for r in by_doc[doc_id])
    places = collections.defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(places) == list(range(len(places)))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    assert collections.Counter(r["ids_crc32"] for r in digest) == collections.Counter(zlib.crc32(bytes(r["ids"])) for r in got)
    assert pack(none(spark), path).count() == 0


@pytest.mark.parametrize("histogram", [{3000: 500}, {100: 5}, {4096: 10, 1: 3}, {2500: 77, 1400: 5, 3: 9}, {k: 4097 - k for k in range(1, 4097, 7)}])
def test_plan_covers_each_token_once(histogram):
    plan = Plan(histogram)
    length = np.concatenate([np.full(n, k) for k, n in histogram.items()])
    rank = np.concatenate([np.arange(n) for n in histogram.values()])
    row, start, size, sequence, offset = plan.locate(length, rank)
    cover = np.zeros((plan.sequences, 4096), int)
    for s, o, n in zip(sequence, offset, size):
        cover[s, o : o + n] += 1
    assert cover.max() == 1 and cover.sum() == length.sum()
    assert (np.bincount(row, size) == length).all()
    assert cover.sum() >= 0.98 * cover.size or plan.sequences <= 50


def test_license_scan(spark):
    docs = awkward(spark)
    got = {r["doc_id"]: r for r in license_digest(license_scan(docs)).collect()}
    assert got[-11]["licenses"] == "Apache-2.0" and got[1]["licenses"] == "" and got[3]["n_sentences"] == 0
    notice = "Some text here.\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and\nassociated documentation files (the \"Software\"), to deal in the Software without restriction, including\nwithout limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.\n"
    some = spark.createDataFrame([(1, notice), (2, "Released under the MIT License.\nIt. Use our own licence\nLicensed under CC BY-NC 4.0."), (3, "Released under the MIT")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in license_digest(license_scan(some)).collect()}
    assert found[1]["identifiers"] == "MitGrant,MitNotice,AsIsWarranty" and found[1]["licenses"] == "MIT"
    assert found[2]["licenses"] == "CC-BY-NC-4.0,MIT,Unknown" and found[3]["licenses"] == ""
    assert license_scan(none(spark)).count() == 0


def test_rules_prefer_longer_ones():
    found = [(0, "MitRef"), (9, "MitGrant"), (50, "MitNotice"), (70, "AsIsWarranty"), (90, "ApacheRef")]
    assert match_rules(found) == [("MIT", 0, 0), ("MIT", 9, 70), ("Apache-2.0", 90, 90)]


def test_scan_equals_sentence_by_sentence(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r["doc_id"]: r["licenses"] for r in license_digest(license_scan(docs)).collect()}
    known = {
        "licensed under cc by nc 4 0": "CC-BY-NC-4.0",
        "this work is licensed under the gnu general public license version 3": "GPL-3.0-only",
        "licensed under the apache license version 2 0": "Apache-2.0",
        "released under the mit license": "MIT",
        "all rights reserved": "Proprietary",
    }
    for r in docs.collect():
        parts = re.split(r"[.!?;:](?=\s|$)|\n", lowered(r["text"]))
        plain = {" ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", p)) for p in parts}
        assert got[r["doc_id"]] == ",".join(sorted({known[p] for p in plain if p in known}))


def test_labellers_and_quality(spark):
    rng = np.random.default_rng(5)
    truth = rng.random(5000) < 0.8
    accuracy = [0.95, 0.9, 0.85, 0.8, 0.75]
    cast = np.stack([np.where(rng.random(5000) < a, truth, ~truth) for a in accuracy], axis=1)
    cast = np.where(cast, GOOD, BAD)
    names, counts = np.unique(pattern_of(cast), return_counts=True)
    prior, table, posterior = fit_labellers(dict(zip(names.tolist(), counts.tolist())), 5)
    assert abs(prior - truth.mean()) < 0.05
    assert all(abs(table[1][k][GOOD] - a) < 0.05 for k, a in enumerate(accuracy))
    guessed = np.array([posterior[p] for p in pattern_of(cast).tolist()]) >= 0.5
    assert (guessed == truth).mean() > 0.95
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = score_quality(docs).join(labels, "doc_id")
    assert found.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] > 0.88
    odd = awkward(spark)
    assert score_quality(odd).count() == odd.count()
    assert score_quality(none(spark)).count() == 0


def test_pipeline(spark, tmp_path):
    docs = awkward(spark).drop("uid")
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, "der die das und nicht")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{sf}/labels.parquet")
    read = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        read = corpus_pipeline.staged(stage(spark, read, sf), name)
        assert read.columns == docs.columns
        sizes.append(read.count())
    # copies: 1 and 2, 3 and 4, 5 and 6, 8 twice; near: 3/4 and 9, 5/6 and 7; benchmark: 8
    assert sizes == [13, 9, 7, 6]
    assert {r["doc_id"] for r in read.collect()} <= {None, 1, 2, 4, 6, 7, 9, 10, -11}
    packed = corpus_pipeline.STAGES[-1][1](spark, read, sf)
    assert packed.filter("start = 0").count() == 6
    assert corpus_pipeline.run(spark, sf).filter("start = 0").count() == 6
