import random

import numpy as np
import pyarrow as pa
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm.common import repeated, whole_groups
from cairn.llm.textkernel import grams, spans_hash, words
from cairn.llm.tokens import encoder

WORD = regex.compile("[a-z0-9À-῿⁀-\U0010ffff]+")


def _lower(t):
    return "".join(k if len((k := c.lower()).encode()) == len(c.encode()) else c for c in t)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=8))
def test_words_are_those_of_the_regular_expression(texts):
    w = words(pa.array(texts, pa.string()))
    got = [[w.flat[s:e].tobytes().decode() for s, e in zip(w.start[a:b], w.end[a:b])] for a, b in zip(w.first[:-1], w.first[1:])]
    low = [_lower(t or "") for t in texts]
    assert got == [WORD.findall(t) for t in low]


def test_grams_of_short_and_long_texts():
    w = words(pa.array(["a b c d", "a b", "", None, "c d a b"]))
    h, at, row = grams(w, 3)
    assert row.tolist() == [0, 0, 1, 4, 4]
    h2, _, row2 = grams(w, 2)
    assert h2[row2 == 1][0] == h2[row2 == 0][0] == h2[row2 == 4][2]


def test_hashes_of_equal_slices_are_equal():
    v = np.array([1, 2, 3, 1, 2, 3, 1], np.uint64)
    h = spans_hash(v, np.array([0, 3, 0, 6]), np.array([3, 6, 2, 7]))
    assert h[0] == h[1] and len(set(h.tolist())) == 3


def test_token_ids_are_the_encoder_s_own():
    r = random.Random(3)
    letters = list("ab 's'tlvre  \n\t,.12é中  'dmT$")
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(3000)] + ["don't  we'll 'tis", "", None, " "]
    e = encoder()
    ids, off = e.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert e.direct.encode_ordinary(t or "") == ids[off[i] : off[i + 1]].tolist()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=20), st.integers(1, 5))
def test_repeated_keys_over_batches(keys, size):
    keys = sorted(keys)
    batches = [pa.RecordBatch.from_pydict({"key": keys[i : i + size], "at": list(range(i, min(len(keys), i + size)))}) for i in range(0, len(keys), size)]
    got = [x for b in repeated(iter(batches), "key", ["at"]) for x in b.column(0).to_pylist()]
    assert got == [i for i, k in enumerate(keys) if keys.count(k) > 1]
    groups = [t.column("key").to_pylist() for t in whole_groups(iter(batches), "key")]
    assert sum(groups, []) == keys and all(a[-1] != b[0] for a, b in zip(groups, groups[1:]))
