"""The trie's searches and the segments' numbering: the same results, and work in step with the keys."""

import numpy as np

from groundwell.llm import ngram_trie
from groundwell.llm.arrays import pack_varints, unpack_varints
from groundwell.llm.elias_fano import EliasFano


def test_successor_looks_at_few_numbers(monkeypatch):
    """Was log2 of the range for each search, 17 here, which made most of op2's CPU seconds."""
    rng = np.random.default_rng(7)
    held = np.sort(rng.integers(0, 10**9, 100_000))
    wanted = np.concatenate((rng.integers(0, 10**9, 30_000), held[::5], [0, held[-1], held[-1] + 1, 10**12]))
    ef = EliasFano(EliasFano.encode(held, 10**9))
    seen, at = [], EliasFano.at
    monkeypatch.setattr(EliasFano, "at", lambda self, i: seen.append(len(i)) or at(self, i))
    first = np.zeros(len(wanted), np.int64)
    assert (ef.successor(first, first + len(held), wanted) == np.searchsorted(held, wanted)).all()
    assert sum(seen) < 3 * len(wanted)


def test_successor_in_ranges():
    rng = np.random.default_rng(8)
    for values, universe in ((rng.integers(0, 50, 300), 50), (rng.integers(0, 10**15, 40), 10**15), (np.full(9, 4), 5), (np.zeros(0, np.int64), 1)):
        held = np.sort(values)
        ef = EliasFano(EliasFano.encode(held, universe))
        assert (ef.at(np.arange(len(held))) == held).all()
        ends = np.sort(rng.integers(0, len(held) + 1, (200, 2)), axis=1)
        wanted = np.concatenate((rng.integers(0, universe + 5, 150), rng.choice(held, 50) if len(held) else np.zeros(50, np.int64)))
        expected = [a + int(np.searchsorted(held[a:b], w)) for (a, b), w in zip(ends.tolist(), wanted.tolist())]
        assert ef.successor(ends[:, 0], ends[:, 1], wanted).tolist() == expected


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def test_varints_of_every_length():
    values = [0, 1, 127, *(v for k in range(1, 10) for v in ((1 << 7 * k) - 1, 1 << 7 * k, (1 << 7 * k) + 1) if v < 1 << 64), (1 << 64) - 1, 5]
    for some in (values, values[::-1], [3] * 5, []):
        raw = pack_varints(np.array(some, np.uint64))
        assert raw == b"".join(map(varint, some))
        assert unpack_varints(raw).tolist() == some


def test_numbering_packed_or_not(monkeypatch):
    rng = np.random.default_rng(9)
    n_words, n = 40, 3000
    own = ngram_trie.Resolved.__new__(ngram_trie.Resolved)
    own.model = ngram_trie.Words(4)
    own.words, own.tokens = np.arange(n_words, dtype=np.uint64), rng.integers(0, n_words, n).astype(np.int32)
    own.word_id = np.where(np.arange(n_words) % 7, np.arange(n_words) * 3 + 1, -1)
    own.known = own.word_id[own.tokens] >= 0
    own.ids, own.id_counts = np.arange(25) * 10 + 5, np.where(np.arange(25) == 3, 10**6, 2)
    own.context = rng.integers(-1, 25, n).astype(np.int32)
    found = []
    for bits in (ngram_trie.PACKED_BITS, 0):
        monkeypatch.setattr(ngram_trie, "PACKED_BITS", bits)
        at, number = own.numbered()
        asked = np.flatnonzero(own.known & (own.context >= 0))
        assert sorted(at.tolist()) == asked.tolist()
        assert (own.key_context[number] == own.ids[own.context[at]]).all() and (own.key_word[number] == own.word_id[own.tokens[at]]).all()
        keys = list(zip(own.shard.tolist(), own.key_context.tolist(), own.key_word.tolist()))
        assert keys == sorted(set(keys)) and own.context_count.tolist() == own.id_counts[(own.key_context - 5) // 10].tolist()
        by_token = np.full(n, -1)
        by_token[at] = number
        found.append((keys, by_token.tolist()))
    assert found[0] == found[1]
    # the words behind a hot context are spread over the shards
    assert len({s for s, c, _ in found[0][0] if c == 35}) > 1 and len({s for s, c, _ in found[0][0] if c == 45}) == 1
