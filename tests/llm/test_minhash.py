import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from cairn.llm import minhash
from cairn.llm.components import components


def parts_of(pairs):
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in pairs:
        root[find(a)] = find(b)
    out = {}
    for x in list(root):
        out.setdefault(find(x), set()).add(x)
    return {frozenset(v) for v in out.values()}


@pytest.mark.parametrize(("parts", "most"), [(64, 24), (64, 10), (32, 6), (16, 3)])
def test_all_pairs_within_the_threshold_share_a_key(parts, most):
    chunks = minhash.plan(parts, most)
    r = np.random.default_rng(1)
    for d in (0, 1, most // 2, most):
        a = r.integers(0, 1 << 16, (200, parts)).astype(np.uint16)
        b = a.copy()
        for i in range(200):
            b[i, r.choice(parts, d, replace=False)] ^= 1
        assert (minhash.keys_of(a, chunks) == minhash.keys_of(b, chunks)).any(1).all()


def test_edges_join_just_what_pairs_join(spark):
    r = np.random.default_rng(2)
    base = r.integers(0, 4, (40, 16)).astype(np.uint16)
    sig = np.concatenate([base, base ^ (r.random((40, 16)) < 0.15), base ^ (r.random((40, 16)) < 0.3)]).astype(np.uint16)
    sig = np.unique(sig, axis=0)
    df = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sig)], "node bigint, sig binary")
    got = parts_of([(x.a, x.b) for x in minhash.near_edges(df, 16, 4).collect()])
    assert got == parts_of([(i, j) for i, j in combinations(range(len(sig)), 2) if (sig[i] != sig[j]).sum() <= 4])


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(50)] + [(100, x) for x in range(101, 140)] + [(300, 200)]
    got = {}
    for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect():
        got.setdefault(r.root, set()).add(r.node)
    assert got == {0: set(range(51)), 100: set(range(100, 140)), 200: {200, 300}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def text(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(n))


def test_planted_copies_and_clean_documents(spark):
    r = random.Random(7)
    docs, want = [], {}
    for g in range(20):
        base = text(r, 200).split()
        for c in range(r.randint(2, 6)):
            w = list(base)
            for _ in range(6):
                w[r.randrange(200)] = text(r, 1)
            want[len(docs)] = g
            docs.append((len(docs), " ".join(w)))
    docs += [(1000 + i, text(r, 150)) for i in range(50)] + [(2000, docs[0][1].upper())]
    pairs = [(x.doc_id, x.duplicate_of) for x in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()]
    assert all(a > b for a, b in pairs) and len({a for a, _ in pairs}) == len(pairs)
    assert (2000, 0) in pairs and not any(1000 <= a < 2000 for a, _ in pairs)
    found = sum(g == want[b] for a, b in pairs if (g := want.get(a)) is not None)
    assert found >= 0.95 * (len(want) - 20)


def test_edges(spark, edges, nothing):
    got = sorted((r.doc_id, r.duplicate_of) for r in minhash.near_duplicates(edges).collect())
    assert got == [(4, 1)]
    kept = minhash.keep_one(edges)
    assert kept.columns == edges.columns
    ids = sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect())
    assert ids == sorted([1, 2, 3, -1, -1, 5, 6, 6, 7, 8, 9, 10])
    assert minhash.near_duplicates(nothing).count() == 0 and minhash.keep_one(nothing).count() == 0


def test_same_id_with_near_texts(spark):
    r = random.Random(1)
    t = text(r, 100)
    docs = spark.createDataFrame([(1, t, "x"), (1, t + " end", "y"), (2, text(r, 100), "z")], "doc_id bigint, text string, x string")
    assert minhash.keep_one(docs).count() == 2


def test_signature_of_nothing():
    sig, at = minhash.signatures(pa.array(["", None, "!!"], pa.string()))
    assert sig.shape == (0, 64) and not len(at)
