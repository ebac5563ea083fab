import random

import pytest

from cairn.llm import linededup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(docs):
    lines = sorted({(d, n, s) for d, t in docs if d is not None for n, s in enumerate((t or "").split("\n")) if s})
    out = set()
    for i, (d, n, s) in enumerate(lines):
        for e, m, z in lines[:i]:
            if abs(len(s) - len(z)) <= 1 and distance(s, z) <= 1:
                out.add((d, n, e, m, int(s != z)))
                break
    return out


def found(df):
    return {(r.doc_id, r.line_no, r.keep_doc_id, r.keep_line_no, r.distance) for r in linededup.repeated_lines(df).collect()}


def earliest(rows):
    return {r[:4] for r in rows}


def test_random_against_brute_force(spark):
    r = random.Random(2)
    line = lambda: "".join(r.choice("abé𝄞 ") for _ in range(r.randint(0, 12)))

    def edit(s):
        i, c = r.randint(0, len(s)), r.choice("abé𝄞z")
        return r.choice([s[:i] + c + s[i:], s[: max(0, i - 1)] + s[i:], s[: max(0, i - 1)] + c + s[i:]])

    pool = [line() for _ in range(150)]
    docs = [(i, "\n".join(edit(r.choice(pool)) if r.random() < 0.6 else r.choice(pool) for _ in range(r.randint(0, 6)))) for i in range(80)]
    docs += [(500, "x" * 5000 + "y"), (501, "x" * 5001), (502, "x" * 2000 + "q" + "x" * 3000 + "y")]
    got, want = found(spark.createDataFrame(docs, "doc_id bigint, text string")), brute(docs)
    assert earliest(got) == earliest(want) and got == want


def test_edges(spark, edges, nothing):
    assert found(edges) == {(4, 0, 1, 0, 0), (8, 1, 8, 0, 1), (10, 0, 8, 0, 1)}
    assert found(nothing) == set()
    none = spark.createDataFrame([(None, "a line"), (None, "a line"), (1, None)], "doc_id bigint, text string")
    assert found(none) == set()


def test_one_id_with_two_texts(spark):
    docs = spark.createDataFrame([(1, "first line here\nsecond line"), (1, "another text\nsecond lines\nthird"), (2, "second line"), (3, "third!")], "doc_id bigint, text string")
    assert found(docs) == {(1, 1, 1, 1, 1), (2, 0, 1, 1, 0), (3, 0, 1, 2, 1)} or found(docs) == {(1, 1, 1, 1, 1), (2, 0, 1, 1, 1), (3, 0, 1, 2, 1)}


def test_keys_of_alike_lines_meet():
    import numpy as np

    r = random.Random(9)
    for _ in range(300):
        a = "".join(r.choice("abc") for _ in range(r.randint(1, 9)))
        b = "".join(r.choice("abc") for _ in range(r.randint(1, 9)))
        if a == b:
            continue  # equal lines are one before
        p = linededup.Points([a, b])
        _, key, kind = linededup.variants(p, p.offsets[:-1], p.offsets[1:], np.array([15, 15]))
        line = linededup.variants(p, p.offsets[:-1], p.offsets[1:], np.array([15, 15]))[0]
        away, _ = linededup.earliest(key, kind, line)
        assert bool(len(away)) == (distance(a, b) <= 1), (a, b)


def test_lines_that_go_are_taken_out(spark):
    docs = [(1, "alpha line one\nbeta\n\nalpha line one", "x"), (2, "alpha line onE\nnew here\n\n", "y"), (3, None, "z"), (None, "beta", "w"), (4, "beta", None)]
    got = linededup.without_repeats(spark.createDataFrame(docs, "doc_id bigint, text string, _lines string"))
    assert got.columns == ["doc_id", "text", "_lines"]
    assert {(r.doc_id, r.text) for r in got.collect()} == {(1, "alpha line one\nbeta\n"), (2, "new here\n\n"), (3, None), (None, "beta"), (4, "")}
    with pytest.raises(ValueError):
        linededup.without_repeats(spark.createDataFrame([(1, "a"), (1, "b")], "doc_id bigint, text string"))
