"""Cases that earlier versions of the dealt operators cut."""

import collections
import zlib

import numpy as np
import pytest

from groundwell.llm import kd_shards, ngram_trie
from groundwell.llm.kd_shards import metadata_shards
from groundwell.llm.sentence_rules import license_digest, license_scan
from tests.llm.frames import trigram_scores


def scores_by_formula(texts, weights):
    """doc_id to (log10 score, tokens)."""
    rows = [(zlib.crc32(str(i).encode()) % 7 == 2, [*text.split(), None]) for i, text in texts]
    return {i: (score, len(x)) for (i, _), (_, x), score in zip(texts, rows, trigram_scores(rows, weights))}


def folds(n):
    """The first n ids that train, the first n that are held out."""
    held = [i for i in range(40 * n) if zlib.crc32(str(i).encode()) % 7 == 2]
    return [i for i in range(40 * n) if i not in held][:n], held[:n]


def check_scores(spark, texts):
    wanted = scores_by_formula(texts, ngram_trie.WEIGHTS)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in ngram_trie.score_documents(docs).collect()}
    assert got.keys() == wanted.keys()
    for i, (score, tokens) in wanted.items():
        assert abs(got[i] - score) <= 0.016 * tokens, (i, got[i], score)


def test_codes_reach_the_rarest_words_and_ngrams():
    """Counts of a corpus of billions of tokens: no floor, no mass over one."""
    model = ngram_trie.Words(1)
    counts = np.array([1, 2, 3, 50, 98, 99, 10**4, 10**6, 10**9, 3 * 10**9])
    model.types, model.discount = 9 * 10**6, 0.5
    model.n = int(counts.sum()) + model.types - len(counts)
    p = model.unigram(counts)
    half = ngram_trie.STEP / 2 + 1e-9
    assert (np.abs(np.log10(p) - np.log10((counts - 0.5) / model.n)) <= half).all()
    mass = p.sum() + (model.types - len(counts)) * p[0] + model.unigram(np.array([0]))[0]
    assert abs(mass - 1) < 1e-9
    exact = np.concatenate([counts / (c + 60) for c in (4 * 10**7, 4 * 10**9, 10**12)])
    exact = np.concatenate((exact[exact <= 1], [1.0, 1e-300]))
    codes = ngram_trie.unpack_codes(ngram_trie.pack_codes(ngram_trie.quantised(exact)))
    assert (codes != ngram_trie.UNSEEN).all()
    assert (np.abs(np.log10(ngram_trie.probability(codes)) - np.log10(exact)) <= half).all()
    raw = ngram_trie.TrieShard.build(np.array([3, 3, 8]), np.array([0, 5, 2]), np.array([1e-12, 0.5, 3e-9]), 6)
    held = ngram_trie.probability(ngram_trie.TrieShard(raw).codes)
    assert (np.abs(np.log10(held) - np.log10([1e-12, 0.5, 3e-9])) <= half).all()
    assert len(ngram_trie.unpack_codes(b"")) == 0 and ngram_trie.probability(np.array([ngram_trie.UNSEEN])) == 0


def test_unknown_words_back_off(spark):
    train, held = folds(6)
    # each training text stands twice, so every context does
    texts = list(zip(train, ["a " * 300 + "b c"] * 2 + ["b c d a"] * 2 + ["c a b"] * 2))
    texts += list(zip(held, ["a new", "b c new other d", "new", "new a a new b c", "", "a b c d"]))
    check_scores(spark, texts)


def test_contexts_seen_once_count(spark):
    train, held = folds(4)
    texts = list(zip(train, ["one passage stands here only once", "other words stand here twice", "once only here", ""]))
    texts += list(zip(held, ["a passage stands here only once", "passage stands here twice", "one passage", "here only new once"]))
    check_scores(spark, texts)


GPL = """    This program is free software%s you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation%s either version %d of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
GPL_3 = """
    You should have received a copy of the GNU General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
GPL_2 = """
    You should have received a copy of the GNU General Public License along
    with this program; if not, write to the Free Software Foundation, Inc.,
    51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.
"""
APACHE = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
"""
BSD = """Copyright (c) 2001, Someone
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
NAMES = """
3. Neither the name of %s nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
NOTICES = [
    (GPL % (":", ",", 3) + GPL_3, "GPL-3.0-or-later"),
    (GPL % (":", ",", 3), "GPL-3.0-or-later"),
    (GPL % (";", ";", 2) + GPL_2, "GPL-2.0-or-later"),
    (GPL % (";", ";", 3) + GPL_3, "GPL-3.0-or-later"),
    (GPL % (":", ",", 2) + GPL_3, "GPL-2.0-or-later"),
    ((GPL % (":", ",", 3)).split("\n\n")[0], "GPL-3.0-or-later"),
    (GPL.replace("This program is free", "Frob is free") % (":", ",", 3) + GPL_3, "GPL-3.0-or-later"),
    (APACHE, "Apache-2.0"),
    (BSD, "BSD-2-Clause"),
    *((BSD + NAMES % party, "BSD-3-Clause") for party in ("the copyright holder", "the University of Somewhere, its schools", "Frob Inc.", "Frob")),
    ("// SPDX-License-Identifier: Apache-2.0\nint x;", "Apache-2.0"),
    ("# SPDX-License-Identifier: MIT\n", "MIT"),
    ("/* SPDX-License-Identifier: GPL-3.0-only */", "GPL-3.0-only"),
    ("SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"),
    ("SPDX-License-Identifier: Frob-1.0", "Unknown"),
    ("Neither the name of Frob is known.\nMit\nWithout a license: mit", "Unknown"),
]


def test_published_notices(spark):
    texts = [(k, text) for k, (text, _) in enumerate(NOTICES)] + [(100 + k, f"Some text.\n\n{text}\nMore text.") for k, (text, _) in enumerate(NOTICES)]
    got = {r["doc_id"]: r for r in license_digest(license_scan(spark.createDataFrame(texts, "doc_id long, text string"))).collect()}
    for k, (text, wanted) in enumerate(NOTICES):
        for at in (k, 100 + k):
            assert (got[at]["licenses"], got[at]["n_spans"]) == (wanted, 1), (text, got[at])


@pytest.mark.parametrize("most", [200_000, 10])
def test_sources_of_one_prefix_part(spark, monkeypatch, most):
    """Sources that differ far behind their sixth byte split the rows, in their order."""
    monkeypatch.setattr(kd_shards, "BROADCAST_VALUES", most)
    docs = spark.range(1600).selectExpr("id AS doc_id", "'same text' AS text", "'en' AS lang", "concat('https://example.org/', lpad(pmod(id * 7, 1600), 5, '0')) AS source", "9L AS n_chars")
    one = docs.withColumn("doc_id", docs["doc_id"] * 0)
    got = metadata_shards(one.withColumn("text", docs["source"]), 8).collect()
    shard = {r["text_crc32"]: r["shard"] for r in got}
    in_order = [shard[zlib.crc32(f"https://example.org/{k:05d}".encode())] for k in range(1600)]
    assert len(got) == 1600 and in_order == sorted(in_order)
    assert set(collections.Counter(in_order)) == set(range(8))
    assert metadata_shards(docs.withColumn("source", docs["source"].substr(99, 1)), 8).count() == 1600


def test_keys_of_huge_contexts_stay_apart():
    """Products beyond 63 bits: contexts are renumbered in their order."""
    context, word = np.array([5 * 10**10, 1, 5 * 10**10, 3 * 10**10]), np.array([7, 10**9 - 1, 8, 7])
    key = ngram_trie.joint(context, word, 10**9)
    assert np.argsort(key).tolist() == [1, 3, 0, 2] and len(set(key.tolist())) == 4 and (key >= 0).all()
    assert ngram_trie.joint(np.array([2, 3]), np.array([1, 0]), 4).tolist() == [9, 12]
    assert ngram_trie.joint(np.zeros(0, np.int64), np.zeros(0, np.int64), 4).tolist() == []
