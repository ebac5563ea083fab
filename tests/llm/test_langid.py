import numpy as np
import pyarrow as pa

from cairn.llm import langid
from cairn.llm.textkernel import words


def test_held_out_accuracy(spark, documents):
    rows = documents.collect()
    model = langid.train(spark.createDataFrame([r for r in rows if r.doc_id % 2]))
    held = [r for r in rows if r.doc_id % 2 == 0]
    p = model.predict(words(pa.array([r.text for r in held])))
    long = np.array([len(r.text) >= 60 for r in held])
    right = np.array([r.lang == v for r, v in zip(held, p["predicted"])])
    assert right[long].mean() >= 0.99 and right.mean() >= 0.95
    assert all(langid.family_of(v) == f for v, f in zip(p["predicted"], p["family"]))


def test_one_machine_parts_two_groups():
    r = np.random.default_rng(0)
    x = r.random((200, 6)).astype(np.float32)
    y = np.where(x[:, 0] > x[:, 1], 1.0, -1.0)
    w, b = langid.linear_svm(x, y, cost=10.0, epochs=200)
    assert (np.sign(x @ w + b) == y).mean() > 0.95


def test_sample_is_bounded(spark, documents):
    many = documents.withColumn("text", documents.text)
    model = langid.train(many, per_language=5)
    assert set(model.languages) == {"germanic", "romance"}


def test_every_labelled_language_is_in_the_model(spark):
    """More languages than a fixed number would hold; the rarest too."""
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    texts = [(i, " ".join(alphabet[(i * 7 + j) % 26] * 2 + alphabet[i % 26] + alphabet[i // 26] for j in range(12)), f"x{i}") for i in range(70) for _ in range(1 + i % 2)]
    model = langid.train(spark.createDataFrame(texts, "doc_id bigint, text string, lang string"))
    assert len(model.languages) == 70 and all(len(v[0]) == 1 for v in model.languages.values())


def test_edges(spark, edges, documents, nothing):
    model = langid.train(documents)
    got = langid.identify(edges, model).collect()
    assert len(got) == edges.count()
    by = [(r.doc_id, r.accepted, r.predicted) for r in got]
    assert (2, False, None) in by and (3, False, None) in by and (8, False, None) in by
    kept = langid.keep_identified(edges, model)
    assert kept.columns == edges.columns
    assert kept.count() == sum(r.accepted for r in got)
    assert langid.identify(nothing, model).count() == 0
    empty = langid.train(nothing)
    assert not any(r.accepted for r in langid.identify(edges, empty).collect())


def test_other_scripts_are_rejected_and_clean_documents_stay(spark, documents):
    model = langid.train(documents)
    other = spark.createDataFrame([(1, "Это совсем другой язык и другие буквы, которых модель не знает"), (2, "这是另一种语言")], "doc_id bigint, text string")
    assert not any(r.accepted for r in langid.identify(other, model).collect())
    assert langid.keep_identified(documents, model).count() == documents.count()
