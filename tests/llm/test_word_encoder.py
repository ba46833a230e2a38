"""The word encoder of op10 against the tokenizer on whole texts."""

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from groundwell.llm import histogram_packing
from groundwell.llm.arrays import text_slices
from groundwell.llm.histogram_packing import Encoder, parted
from groundwell.llm.queries import tokenizer_path

TEXTS = [
    "Plain words, and plain words again.",
    "",
    " \t\n ",
    None,
    "caf\u00e9; na\u00efve! \u4e2d\u6587 \U0001f600 don't 3,14 a" + "b" * 90 + " end",
    "x" * 64 + " " + "x" * 65 + " " + "x" * 65,
    "left\x01right \x01 words",
    "\r\n".join(f"word{k} other{k % 7}" for k in range(400)),
    "Plain words, and plain words again.",
]


def encoded(own, texts, most):
    out = []
    for _, _, buffer, starts in text_slices(pa.RecordBatch.from_pydict({"text": texts}), "text", most):
        spaced, places = parted(buffer)
        ids, ends = own.encode(spaced, places[starts])
        out += [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]
    return out


@pytest.mark.parametrize("most", [30, 1 << 20])
@pytest.mark.parametrize("cached", [5, 1_000_000])
@pytest.mark.parametrize("collide", [False, True])
def test_ids_are_those_of_whole_texts(monkeypatch, most, cached, collide):
    monkeypatch.setattr(histogram_packing, "CACHED_WORDS", cached)
    if collide:
        monkeypatch.setattr(histogram_packing, "hash_words", lambda buffer, at, length: length.astype(np.uint64))
    tokenizer = Tokenizer.from_file(tokenizer_path())
    wanted = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    own = Encoder(tokenizer_path())
    assert encoded(own, TEXTS, most) == wanted
    assert encoded(own, TEXTS[::-1], most) == wanted[::-1]


def test_a_held_word_takes_few_bytes():
    """What a worker keeps between tasks: flat arrays, no objects by word."""
    own = Encoder(tokenizer_path())
    encoded(own, [" ".join(f"w{k}" for k in range(60_000))], 1 << 20)
    arrays = [x for x in vars(own).values() if isinstance(x, np.ndarray)]
    assert own.held >= 60_000 and sum(x.nbytes for x in arrays) < 100 * own.held
    assert not any(isinstance(x, dict) for x in vars(own).values())
