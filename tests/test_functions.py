import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.functions.codecs import NAMES, decode, encode
from cairn.functions.hashing import gram_hashes
from cairn.functions.match import LITERAL, Index, suffix_array


@pytest.mark.parametrize("codec", NAMES)
def test_random_arrays(codec):
    r = random.Random(4711)
    top = 100 if codec == "fixed-7" else 100_000
    for _ in range(20):
        v = np.array(sorted({r.randint(1, top) for _ in range(r.randint(1, 3000))}), np.uint32)
        assert (decode(codec, encode(codec, v), len(v)) == v).all()
        b = np.array([r.randint(1, 100) for _ in range(r.randint(1, 500))], np.uint8)
        assert (decode(codec, encode(codec, b), len(b), np.uint8) == b).all()


@pytest.mark.parametrize("codec", [*NAMES, "fixed-1", "fixed-5", "fixed-32"])
def test_edges_of_arrays(codec):
    top = {"fixed-7": 127, "fixed-1": 1, "fixed-5": 31}.get(codec, 2**32 - 1)
    for values in ([], [0], [top], [0, top, 0], [v for v in (127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28 - 1, 2**28) if v <= top]):
        v = np.array(values, np.uint32)
        assert decode(codec, encode(codec, v), len(v)).tolist() == values


def test_vbyte_bytes_and_refusals():
    assert encode("vbyte", np.array([1, 127, 128, 300], np.uint32)) == bytes([1, 127, 0x80, 1, 0xAC, 2])
    with pytest.raises(TypeError):
        encode("vbyte", np.array([-1], np.int32))
    with pytest.raises(ValueError):
        encode("fixed-3", np.array([8], np.uint32))
    with pytest.raises(ValueError):
        encode("what", np.array([8], np.uint32))


def brute(d, b, t, times=1):
    off, size, p, last = [], [], 0, 0
    seen = lambda s: sum(d.startswith(s, i) for i in range(len(d))) if times > 1 else d.find(s) + 1
    while p < len(b):
        n = 0
        while p + n < len(b) and seen(b[p : p + n + 1]) >= times:
            n += 1
        w = d.find(b[p : p + n]) if n else -1
        n = max(n, 1)
        if n > t and w >= 0:
            off.append(w)
            size.append(n)
            last = 0
        elif last and last + n <= t:
            last += n
            size[-1] = last
        else:
            off.append(LITERAL)
            size.append(n)
            last = n
        p += n
    return off, size


@settings(max_examples=150, deadline=None)
@given(st.text("ab", max_size=90), st.lists(st.text("abz", max_size=60), max_size=4), st.integers(0, 4))
def test_parse_is_greedy_and_leftmost(d, blocks, threshold):
    data, raw = d.encode(), [b.encode() for b in blocks]
    offsets, lengths = Index.of(data).parse(raw, threshold)
    for b, o, n in zip(raw, offsets, lengths):
        assert (o.tolist(), n.tolist()) == brute(data, b, threshold)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=60), st.binary(max_size=60), st.integers(1, 2))
def test_parse_of_any_bytes(data, block, times):
    o, n = Index.of(data).parse([block], 3, times)
    assert (o[0].tolist(), n[0].tolist()) == brute(data, block, 3, times)


def test_long_matches_are_maximal():
    r = random.Random(8)
    data = bytes(r.choice(b"abcdefgh \xc3\xa9") for _ in range(20_000))
    block = data[500:3000] + b"?" + data[10:700] + bytes(r.choice(b"abcdefgh") for _ in range(2000)) + data[-900:]
    (o,), (n,) = Index.of(data).parse([block], 3)
    p = 0
    for w, k in zip(o.tolist(), n.tolist()):
        if w >= 0:
            assert data[w : w + k] == block[p : p + k] and data.find(block[p : p + k]) == w
            assert p + k == len(block) or data.find(block[p : p + k + 1]) < 0
        p += k
    assert p == len(block) and n.max() > 2000


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=80))
def test_suffix_array(data):
    assert suffix_array(np.frombuffer(data, np.uint8)).tolist() == sorted(range(len(data)), key=lambda i: data[i:])


def test_gram_hashes():
    h = gram_hashes(b"abcabc", 3)
    assert len(h) == 4 and h[0] == h[3] and len(set(h.tolist())) == 3 and not len(gram_hashes(b"ab", 3))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([0, 0, 1, 255]), max_size=120), st.lists(st.lists(st.sampled_from([0, 0, 1, 7, 255]), max_size=90), max_size=4), st.integers(0, 4))
def test_zero_bytes_are_bytes_like_others(d, blocks, threshold):
    data, raw = bytes(d), [bytes(b) for b in blocks]
    offsets, lengths = Index.of(data).parse(raw, threshold)
    for b, o, n in zip(raw, offsets, lengths):
        assert (o.tolist(), n.tolist()) == brute(data, b, threshold)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 2]), min_size=1, max_size=120), st.data())
def test_factors_by_repeats_are_those_of_the_restricted_parse(d, draw):
    data = bytes(d)
    cuts = sorted(draw.draw(st.lists(st.integers(0, len(data)), min_size=2, max_size=6)))
    begin, end = np.array(cuts[:-1]), np.array(cuts[1:])
    want = [len(brute(data, data[a:b], 0, 2)[1]) for a, b in zip(begin, end)]
    assert Index.of(data).factors_by_repeats(begin, end).tolist() == want


def test_equal_blocks_and_literals_at_block_ends():
    blocks = [b"zz", b"zz", b"", b"zabcdz", b"z", b"zz", b"zabcdz"]
    for t in range(4):
        offsets, lengths = Index.of(b"abcdabc").parse(blocks, t)
        for b, o, n in zip(blocks, offsets, lengths):
            assert (o.tolist(), n.tolist()) == brute(b"abcdabc", b, t)


def test_rabin_karp_of_a_long_string(spark):
    """Codes of characters are worked out once a string: with all of them for each run this would take 3,000 times as long."""
    from cairn.functions.hashing import rabin_karp

    text = "".join(chr(97 + i * i % 23) for i in range(3000))
    (got,) = spark.createDataFrame([(text,)], "t string").select(rabin_karp(F.col("t"), 8)).first()
    assert got == [int.from_bytes(text[i : i + 8].encode(), "big") % 2147483647 for i in range(2993)]
