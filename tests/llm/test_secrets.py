import random

import numpy as np
import pyarrow as pa

from cairn.llm import secrets


def test_held_out_findings():
    forest = secrets.train(secrets.findings(2000, seed=1))
    held = secrets.findings(1000, seed=77)
    p = forest.score(np.array([secrets.features(*r[:4]) for r in held])) >= 0.5
    y = np.array([r[4] for r in held], bool)
    assert (p == y).mean() > 0.97


def test_candidates_stand_where_they_say():
    r = random.Random(1)
    texts = ["".join(r.choice("aé Z9=:'\"_-/\n中") for _ in range(r.randint(0, 80))) for _ in range(300)] + ["x" * 100 + "1", None, ""]
    row, byte, char, size, found, before, after = secrets.candidates(pa.array(texts))
    for i, c, n, f, b in zip(row, char, size, found, before):
        assert texts[i][c : c + n] == f and texts[i][:c].endswith(b.lstrip("�"))
    assert "x" * 100 + "1" in found


def test_planted_tokens_and_cards(spark):
    docs = spark.createDataFrame([(1, 'some words token = "3c4226790fc3f8022bcc4434e93601b2005f1325" more words', "src1"), (2, "the number 4194092253540301 was here", "src2"), (3, "plain prose without anything of the kind", "src3")], "doc_id bigint, text string, source string")
    rows = secrets.scan(docs, secrets.train(secrets.findings())).collect()
    assert {(r.doc_id, r.is_secret) for r in rows} == {(1, True), (2, False)}
    assert rows[0].length in (16, 40)


def test_edges(spark, edges, nothing):
    forest = secrets.train(secrets.findings(300))
    assert secrets.scan(edges, forest).count() == 0
    assert secrets.scan(nothing, forest).count() == 0
    twice = spark.createDataFrame([(None, 'secret: "Zx81kfJJq0192hhQ77aa"', None)] * 2, "doc_id bigint, text string, source string")
    assert secrets.scan(twice, forest).count() == 2
    only = secrets.train([r for r in secrets.findings(100) if r[4] == 0])
    assert not any(r.is_secret for r in secrets.scan(twice, only).collect())
