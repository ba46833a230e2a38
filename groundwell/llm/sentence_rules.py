"""License scan by sentence rules.

A text is cut into sentences, a sentence is normalised to its words (small letters and digits), and known
sentences get identifiers. The identifiers of a text, in order, are matched against rules, each an
ordered sequence that stands for a license; longer rules go first, and a sentence serves one rule.
Sentences of a rule follow each other among the identified ones; other text may stand between.
Sentences that speak of a license but are not known get the identifier Unknown.

Sentences end at . ! ? ; or : before white space and at the text's end; they are taken both with every
line end as an end and with blank lines only, so wrapped notices and bare lines are both found. Words are
hashed a slice at a time, and a sentence's hash only selects candidates: its words are compared before
it gets an identifier. A `*` in a known sentence stands for one or more words. A sentence that speaks of a license
and is not known is tried together with the next one, as tags are cut at their colon.

Defined results: null and empty texts have no sentences and the empty license list; repeated rows are
reported each.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwell.llm.arrays import LOWER, NOT_SPACE, WORD_BYTES, hash_words, mix, text_slices, words_in

# Known sentences as published with the licenses, in normalised words.
SENTENCES = {
    "ApacheRef": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license"],
    "ApacheComply": ["you may not use this file except in compliance with the license"],
    "ApacheCopy": ["you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at"],
    "ApacheUrl": ["http www apache org licenses license 2 0", "https www apache org licenses license 2 0"],
    "ApacheAsIs": [
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"
    ],
    "ApacheSee": ["see the license for the specific language governing permissions and limitations under the license"],
    "MitRef": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "the mit license", "mit license", "the mit license mit"],
    "MitGrant": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
    ],
    "MitNotice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "AsIsWarranty": [
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
    ],
    "NoLiability": [
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
    ],
    "Gpl3Ref": [
        "this work is licensed under the gnu general public license version 3",
        "licensed under the gnu general public license version 3",
        "released under the gnu general public license version 3",
    ],
    "Gpl2Ref": ["licensed under the gnu general public license version 2", "this work is licensed under the gnu general public license version 2"],
    "Gpl3OrLater": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"
    ],
    "Gpl2OrLater": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"
    ],
    "GplFree": ["this program is free software"],
    "GplTerms": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "Gpl3Terms": [
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"
    ],
    "Gpl2Terms": [
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"
    ],
    "Gpl3Later": ["either version 3 of the license or at your option any later version"],
    "Gpl2Later": ["either version 2 of the license or at your option any later version"],
    "GplHope": [
        "this program is distributed in the hope that it will be useful but without any warranty",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    ],
    "GplImplied": ["without even the implied warranty of merchantability or fitness for a particular purpose"],
    "GplSee": ["see the gnu general public license for more details"],
    "GplCopy": ["you should have received a copy of the gnu general public license along with this program"],
    "GplUrl": ["if not see http www gnu org licenses", "if not see https www gnu org licenses"],
    "CcByRef": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "CcBySaRef": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "CcByNcRef": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "BsdGrant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "BsdSource": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "BsdBinary": [
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
    ],
    "BsdNames": [
        "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "SpdxApache": ["spdx license identifier apache 2 0"],
    "SpdxMit": ["spdx license identifier mit"],
    "SpdxGpl3": ["spdx license identifier gpl 3 0 only", "spdx license identifier gpl 3 0"],
    "SpdxBsd3": ["spdx license identifier bsd 3 clause"],
    "AllRights": ["all rights reserved"],
}

UNKNOWN = "Unknown"

# What may follow the first sentences of a GPL notice; the second sentence of the hope stands behind a semicolon.
GPL_TAILS = [[], *([*hope, *rest] for hope in (["GplHope"], ["GplHope", "GplImplied"]) for rest in (["GplSee"], ["GplSee", "GplCopy"], ["GplSee", "GplCopy", "GplUrl"]))]

# Rules in words of identifiers; longer ones first when matching.
RULES = [
    ("Apache-2.0", ["ApacheRef", "ApacheComply", "ApacheCopy", "ApacheUrl", "ApacheAsIs", "ApacheSee"]),
    ("Apache-2.0", ["ApacheRef", "ApacheComply", "ApacheCopy", "ApacheUrl"]),
    ("Apache-2.0", ["ApacheRef", "ApacheComply", "ApacheCopy", "ApacheAsIs", "ApacheSee"]),
    ("Apache-2.0", ["ApacheRef", "ApacheComply", "ApacheCopy"]),
    ("Apache-2.0", ["ApacheRef"]),
    ("Apache-2.0", ["SpdxApache"]),
    ("MIT", ["MitRef", "MitGrant", "MitNotice", "AsIsWarranty", "NoLiability"]),
    ("MIT", ["MitGrant", "MitNotice", "AsIsWarranty", "NoLiability"]),
    ("MIT", ["MitGrant", "MitNotice", "AsIsWarranty"]),
    ("MIT", ["MitRef"]),
    ("MIT", ["SpdxMit"]),
    *(
        (f"GPL-{v}.0-or-later", [*head, *tail])
        for v in "32"
        for head in ([f"Gpl{v}OrLater"], ["GplFree", f"Gpl{v}Terms"], [f"Gpl{v}Terms"], ["GplFree", "GplTerms", f"Gpl{v}Later"], ["GplTerms", f"Gpl{v}Later"])
        for tail in GPL_TAILS
    ),
    ("GPL-3.0-only", ["Gpl3Ref"]),
    ("GPL-3.0-only", ["SpdxGpl3"]),
    ("GPL-2.0-only", ["Gpl2Ref"]),
    ("CC-BY-4.0", ["CcByRef"]),
    ("CC-BY-SA-4.0", ["CcBySaRef"]),
    ("CC-BY-NC-4.0", ["CcByNcRef"]),
    ("BSD-3-Clause", ["AllRights", "BsdGrant", "BsdSource", "BsdBinary", "BsdNames"]),
    ("BSD-2-Clause", ["AllRights", "BsdGrant", "BsdSource", "BsdBinary"]),
    ("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdNames"]),
    ("BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary"]),
    ("BSD-3-Clause", ["SpdxBsd3"]),
    ("Proprietary", ["AllRights"]),
    ("Unknown", [UNKNOWN]),
]

LICENSE_WORDS = ["license", "licence", "licensed", "licenced", "licenses", "licences"]

_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?;:"]] = True


def match_rules(found: list[tuple[int, str]], rules=RULES) -> list[tuple[str, int, int]]:
    """(license, first place, last place) of the rules that a sequence of (place, identifier) meets."""
    names = [n for _, n in found]
    free, out = [True] * len(found), []
    for license_id, rule in sorted(rules, key=lambda r: -len(r[1])):
        k = 0
        while k + len(rule) <= len(names):
            if names[k : k + len(rule)] == rule and all(free[k : k + len(rule)]):
                free[k : k + len(rule)] = [False] * len(rule)
                out.append((license_id, found[k][0], found[k + len(rule) - 1][0]))
                k += len(rule)
            else:
                k += 1
    return sorted(out, key=lambda m: m[1:])


class Scanner:
    def __init__(self, sentences: dict = SENTENCES, rules: list = RULES):
        self.rules = rules
        self.identifier = {s.encode(): name for name, group in sentences.items() for s in group if "*" not in s}
        self.open = [(*s.encode().split(b"*"), name) for name, group in sentences.items() for s in group if "*" in s]
        texts = pa.RecordBatch.from_arrays([pa.array([s.decode() for s in self.identifier])], ["text"])
        (_, _, buffer, starts), = text_slices(texts, "text", 1 << 62)
        low, at, length, hashes, bounds = self.words(buffer, starts)
        first = np.searchsorted(at, starts[:-1])
        self.known = np.sort(self.sums(hashes, first)[0])
        self.speaks = self.hashes_of([w.encode() for w in LICENSE_WORDS])
        self.heads = self.hashes_of(sorted({head.split()[0] for head, _, _ in self.open}))

    @staticmethod
    def hashes_of(names: list) -> np.ndarray:
        flat = np.frombuffer(b" ".join(names) + bytes(40), np.uint8)
        size = np.array([len(w) for w in names], np.int64)
        return hash_words(flat, np.cumsum(size + 1) - size - 1, size)

    def name_of(self, words: bytes):
        """The identifier of a known sentence."""
        whole = self.identifier.get(words)
        return whole or next((name for head, tail, name in self.open if words.startswith(head) and words.endswith(tail) and len(words) > len(head) + len(tail)), None)

    @staticmethod
    def words(buffer, starts):
        low = LOWER[buffer]
        at, length = words_in(low, int(starts[-1]), WORD_BYTES)
        return low, at, length, hash_words(low, at, length), np.searchsorted(at, starts)

    @staticmethod
    def sums(hashes, first):
        """An order-dependent hash of the words of each sentence, and the sentences' word counts."""
        counts = np.diff(np.append(first, len(hashes)))
        place = np.arange(len(hashes)) - np.repeat(first, counts)
        mixed = mix(hashes + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return np.add.reduceat(mixed, first) if len(first) else mixed[:0], counts

    def scan(self, buffer, starts):
        """Per text (number of sentences, [(word place, words, identifier)])."""
        low, at, length, hashes, bounds = self.words(buffer, starts)
        n = len(starts) - 1
        end = int(starts[-1])
        stop = np.flatnonzero(_ENDS[low[: end - 1]] & ~NOT_SPACE[low[1:end]])
        lines = np.flatnonzero(low[:end] == 10)
        blank = lines[:-1][np.diff(lines) == 1] if len(lines) else lines
        found: list[dict] = [{} for _ in range(n)]
        totals = np.zeros(n, np.int64)
        for breaks in (np.concatenate((stop, lines)), np.concatenate((stop, blank, starts - 1))):
            first = np.unique(np.searchsorted(at, np.sort(breaks)))
            first = first[first < len(at)]
            if not len(first):
                continue
            if first[0] != 0:
                first = np.concatenate(([0], first))
            sums, counts = self.sums(hashes, first)
            owner = np.searchsorted(bounds, first, "right") - 1
            if not totals.any():
                totals = np.bincount(owner, minlength=n)[:n]
            slot = np.searchsorted(self.known, sums)
            slot[slot == len(self.known)] = 0
            speaks = np.add.reduceat(np.isin(hashes, self.speaks), first, dtype=np.int64) > 0
            longest = max(map(len, self.identifier))

            def words_of(k, most=None):
                own = slice(first[k], first[k] + (counts[k] if most is None else min(counts[k], most)))
                return b" ".join(low[a : a + m].tobytes() for a, m in zip(at[own].tolist(), length[own].tolist()))

            for k in np.flatnonzero((self.known[slot] == sums) | speaks | np.isin(hashes[first], self.heads)).tolist():
                words, size = words_of(k), int(counts[k])
                name = self.name_of(words)
                if name is None and speaks[k]:
                    name = UNKNOWN
                    if len(words) < longest and k + 1 < len(first) and owner[k + 1] == owner[k]:
                        # known sentences are far shorter than a long text without ends
                        whole = self.identifier.get(words + b" " + words_of(k + 1, longest))
                        if whole:
                            name, size = whole, size + int(counts[k + 1])
                if name:
                    place = int(first[k] - bounds[owner[k]])
                    found[owner[k]].setdefault((name == UNKNOWN, place), (place, size, name))
        out = []
        for total, own in zip(totals.tolist(), found):
            sure = sorted(v for (unknown, _), v in own.items() if not unknown)
            covered = [(a, a + m) for a, m, _ in sure]
            rest = [v for (unknown, _), v in own.items() if unknown and not any(v[0] < b and a < v[0] + v[1] for a, b in covered)]
            kept, reach = [], 0
            for v in sorted(rest):  # of overlapping unknown sentences the first
                if v[0] >= reach:
                    kept.append(v)
                    reach = v[0] + v[1]
            out.append((total, sorted(sure + kept)))
        return out


SPANS = "array<struct<license:string,first_word:int,last_word:int>>"


def license_scan(documents: DataFrame, sentences: dict = SENTENCES, rules: list = RULES) -> DataFrame:
    """doc_id, n_sentences, n_identified, identifiers, spans of every document row. A span has its license and
    the places of the first words of its first and last sentence."""

    def scanned(batches):
        scanner = Scanner(sentences, rules)
        kind = pa.list_(pa.struct([("license", pa.string()), ("first_word", pa.int32()), ("last_word", pa.int32())]))
        for batch in batches:
            for i, j, buffer, starts in text_slices(batch, "text"):
                found = scanner.scan(buffer, starts)
                spans = [[dict(zip(("license", "first_word", "last_word"), m)) for m in match_rules([(p, name) for p, _, name in own], rules)] for _, own in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array([t for t, _ in found], pa.int64()),
                        pa.array([len(own) for _, own in found], pa.int64()),
                        pa.array([",".join(name for _, _, name in own) for _, own in found], pa.string()),
                        pa.array(spans, kind),
                    ],
                    ["doc_id", "n_sentences", "n_identified", "identifiers", "spans"],
                )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scanned, f"doc_id long, n_sentences long, n_identified long, identifiers string, spans {SPANS}")


def license_digest(scan: DataFrame) -> DataFrame:
    return scan.select(
        "doc_id",
        "n_sentences",
        "n_identified",
        "identifiers",
        F.concat_ws(",", F.array_sort(F.array_distinct(F.col("spans.license")))).alias("licenses"),
        F.size("spans").cast("long").alias("n_spans"),
    )
