import pytest

import corpus_pipeline
from cairn.llm import decontam, langid, minhash, mixing, sstable
from cairn.llm.common import table
from conftest_words import word_list

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = table(spark, SF, "documents"), [table(spark, SF, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_columns(stages):
    for s in stages[1:-1]:
        assert s.columns == corpus_pipeline.COLUMNS
    assert stages[-1].columns == [c.split()[0] for c in sstable.SCHEMA.split(", ")]


def test_decisions_take_effect(spark, stages):
    docs, identified, single, clean, mixed, shards = stages
    verdict = {r.doc_id for r in langid.identify(docs, langid.train(docs)).collect() if r.accepted}
    assert {r.doc_id for r in identified.collect()} == verdict
    gone = {r.doc_id for r in minhash.near_duplicates(identified).collect()}
    assert {r.doc_id for r in single.collect()} == verdict - gone and gone
    bench = [r.text for r in table(spark, SF, "benchmark").collect()]
    tests = [s for t in decontam.test_strings(bench) for s in t]
    leak = {r.doc_id for r in single.collect() if any(s.decode() in " " + " ".join(word_list(r.text)) + " " for s in tests)}
    assert leak and {r.doc_id for r in clean.collect()} == verdict - gone - leak
    words = {w for r in clean.collect() for w in r.text.split()}
    assert mixed.count() > 0 and all(set(r.text.split()) <= words for r in mixed.collect())
    assert sorted((r.doc_id, r.text) for r in sstable.scan(shards).collect()) == sorted((r.doc_id, r.text) for r in mixed.collect())


def test_run_is_the_stages_one_after_another(spark, stages):
    a = sstable.scan(corpus_pipeline.run(spark, SF)).collect()
    b = sstable.scan(stages[-1]).collect()
    assert sorted(map(str, a)) == sorted(map(str, b)) and len(corpus_pipeline.STAGES) == 5 and mixing.BLOCK


def test_edges(spark, edges, nothing):
    for start in (edges, nothing):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            docs.count()
