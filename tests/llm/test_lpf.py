import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import lpf
from conftest_words import word_list


def brute(docs, least):
    """Islands of words under windows that occurred before, with the first occurrence of each island's first window."""
    first, out = {}, set()
    for d, t in sorted(set(docs)):
        w, late = word_list(t), []
        for i in range(len(w) - least + 1):
            k = tuple(w[i : i + least])
            if k in first:
                late.append((i, first[k]))
            else:
                first[k] = (d, i)
        while late:
            a, src = late[0]
            b = a + least
            while late and late[0][0] <= b:
                b = late.pop(0)[0] + least
            out.add((d, a, b, *src))
    return out


def found(df, least=10, gram=3):
    return {(r.doc_id, r.start_word, r.end_word, r.first_doc_id, r.first_word) for r in lpf.later_copies(df, least, gram).collect()}


def test_random_against_brute_force(spark):
    r = random.Random(3)
    text = lambda n, v: [f"w{r.randrange(v)}" for _ in range(n)]
    shared = [text(r.randint(8, 30), 500) for _ in range(6)]
    docs = []
    for i in range(80):
        w = text(r.randint(0, 40), 500)
        for _ in range(r.randint(0, 3)):
            at = r.randint(0, len(w))
            w[at:at] = r.choice(shared)
        docs.append((i, ", ".join(w)))
    docs += [(100 + i, " ".join(text(60, 2))) for i in range(4)] + [(200, "a " * 100), (201, docs[3][1])]
    assert found(spark.createDataFrame(docs, "doc_id bigint, text string")) == brute(docs, 10)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=40))
def test_longest_previous_factors(values):
    tokens = np.array(values, np.uint32)
    n = len(tokens)
    at = np.arange(n)
    order, lcp = lpf.suffix_order(tokens, np.full(n, n), at, at, n)
    assert order.tolist() == sorted(range(n), key=lambda i: values[i:])
    got = np.zeros(n, int)
    got[order] = lpf.previous_factors(order.tolist(), lcp.tolist())
    for i in range(n):
        want = max((next((k for k in range(n - i) if values[j + k] != values[i + k]), n - i) for j in range(i)), default=0)
        assert got[i] == want


def test_edges(spark, edges, nothing):
    assert found(edges, 5, 2) == {(4, 0, 24, 1, 0)}
    assert found(nothing) == set()
    kept = lpf.without_copies(edges, 5, 2)
    assert kept.columns == edges.columns and kept.count() == edges.count()
    text = {r.doc_id: r.text for r in kept.collect() if r.doc_id is not None}
    assert text[4] == "" and text[1].startswith("The house") and text[2] is None and len(text[7]) > 100_000
    assert lpf.without_copies(nothing).count() == 0


def test_cutting_leaves_the_rest(spark):
    same = " ".join(f"s{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"Avant; {same}."), (2, f"Début — «{same.upper()}», fin é.")], "doc_id bigint, text string")
    assert [r.text for r in lpf.without_copies(docs).orderBy("doc_id").collect()] == [f"Avant; {same}.", "Début — «», fin é."]
