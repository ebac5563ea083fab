import random

from cairn.llm import decontam
from conftest_words import word_list


def brute(docs, items, window=8, shortest=1):
    out = {}
    for item, text in set(items):
        w = word_list(text)
        if len(w) < shortest:
            continue
        n = min(window, len(w))
        tests = {" " + " ".join(w[i : i + n]) + " " for i in range(len(w) - n + 1)}
        for doc, t in docs:
            hits = sum(s in " " + " ".join(word_list(t)) + " " for s in tests)
            if hits:
                out[doc, item] = max(hits, out.get((doc, item), 0))
    return out


def test_random_against_brute_force(spark):
    r = random.Random(5)
    vocab = ["alpha", "be", "gamma", "d", "epsilon", "Ünder", "x1"]
    text = lambda n: r.choice([" ", ", ", "\n"]).join(r.choice(vocab) for _ in range(n))
    items = [(i, text(r.choice([1, 2, 3, 4, 9, 20]))) for i in range(12)]
    docs = [(i, text(r.randint(0, 60)) + (" " + items[r.randrange(12)][1].upper() + "! " if i % 3 == 0 else "") + text(5)) for i in range(60)]
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), table_bytes=400).collect()
    assert {(g.doc_id, g.item_id): g.windows for g in got} == brute(docs, items)


def test_edges(spark, edges, nothing):
    from conftest_words import EN

    bench = spark.createDataFrame([(1, EN), (2, EN), (3, None), (4, ""), (None, EN), (5, "too short")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(edges, bench).collect()}
    assert got == {(d, i) for d in (1, 4, None) for i in (1, 2, None)}
    kept = decontam.keep_clean(edges, bench)
    assert kept.columns == edges.columns and kept.count() == edges.count() - 3
    assert decontam.contaminated(nothing, bench).count() == 0 and decontam.keep_clean(nothing, bench).count() == 0
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.contaminated(edges, none).count() == 0 and decontam.keep_clean(edges, none).count() == edges.count()


def test_occurrence_at_the_end_of_a_long_text(spark):
    from conftest_words import EN

    docs = spark.createDataFrame([(1, "filler " * 200_000 + EN), (2, "filler " * 10)], "doc_id bigint, text string")
    assert [r.doc_id for r in decontam.contaminated(docs, spark.createDataFrame([(7, EN)], "item_id bigint, text string")).collect()] == [1]


def test_short_items_are_searched_for_like_others(spark):
    """Items of one word, of a few bytes, and in scripts without spaces."""
    items = [(1, "Yes."), (2, "x"), (3, "问题是什么"), (4, "two words")]
    docs = [(1, "he said yes to all"), (2, "yesterday xx"), (3, "问题是什么"), (4, "an x marks"), (5, "Two,words"), (6, "two other words")]
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (3, 3), (4, 2), (5, 4)}
