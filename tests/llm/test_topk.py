import numpy as np
import pytest

from cairn.llm import topk


def brute(rows, k):
    out = {}
    for a, x in rows:
        near = sorted({((x ^ y).bit_count(), b) for b, y in rows if b != a})[:k]
        out.setdefault(a, []).append(near)
    return {a: sorted(v) for a, v in out.items()}


def got(spark, rows, k, bits=64, **options):
    word = lambda c, w: ((c >> 64 * w & (1 << 64) - 1) ^ 1 << 63) - (1 << 63)
    df = spark.createDataFrame([(i, [word(c, w) for w in range((bits - 1) // 64 + 1)]) for i, c in rows], "id bigint, code array<bigint>")
    out = {}
    for r in topk.nearest(df, bits, k, **options).collect():
        out.setdefault(r.id, []).append((r.rank, r.distance, r.neighbour_id))
    return {i: [[(d, n) for _, d, n in sorted(v)]] for i, v in out.items()}


@pytest.mark.parametrize("shard_bytes", [64 << 20, 1600])
def test_random_codes(spark, shard_bytes):
    r = np.random.default_rng(4)
    base = [int(x) for x in r.integers(0, 1 << 63, 30)]
    rows = [(i, base[i % 30] ^ (1 << int(r.integers(0, 64))) ^ (1 << int(r.integers(0, 64)))) for i in range(300)] + [(1000 + i, base[0]) for i in range(15)]
    assert got(spark, rows, 7, shard_bytes=shard_bytes) == brute(rows, 7)


@pytest.mark.parametrize("bits", [3, 40, 65, 200])
def test_codes_of_any_width_and_some_queries(spark, bits):
    r = np.random.default_rng(bits)
    base = [int.from_bytes(r.bytes(32), "big") % (1 << bits) for _ in range(20)]
    rows = [(i, base[i % 20] ^ (1 << int(r.integers(0, bits)))) for i in range(150)]
    assert got(spark, rows, 5, bits, asked="id % 3 = 0", shard_bytes=2000) == {i: v for i, v in brute(rows, 5).items() if i % 3 == 0}


def test_a_third_of_all_rows_with_one_code(spark):
    rows = [(i, 12345) for i in range(400)] + [(1000 + i, 12345 ^ (1 << i % 60)) for i in range(800)]
    assert got(spark, rows, 4, asked="id % 100 = 0") == {i: v for i, v in brute(rows, 4).items() if i % 100 == 0}


def test_few_rows_and_far_codes(spark):
    rows = [(1, 0), (2, (1 << 64) - 1), (3, 0)]
    assert got(spark, rows, 10) == brute(rows, 10)
    assert got(spark, [(1, 5)], 3) == {}


def test_edges(spark):
    rows = [(1, [1.0, -1.0, 2.0], "x"), (2, None, "y"), (None, [1.0], "z"), (3, [1.0, float("nan"), 3.0], "x"), (4, [], "w"), (1, [1.0, -1.0, 2.0], "v"), (5, [None, 0.5] + [1.0] * 100, "u")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, id string")
    c, bits = topk.codes(df.drop("id"))
    c = {r.id: r.code for r in c.collect()}
    assert bits == 102 and c[1] == [5, 0] and c[3] == [5, 0] and c[4] == [0, 0] and set(c) == {1, 3, 4, 5} and c[5] == [-2, (1 << 38) - 1]
    near = topk.nearest(*topk.codes(df), 2).collect()
    assert {(r.id, r.rank, r.neighbour_id, r.distance) for r in near if r.id == 1} == {(1, 1, 3, 0), (1, 2, 4, 2)}
    assert topk.nearest(*topk.codes(df.limit(0))).count() == 0
