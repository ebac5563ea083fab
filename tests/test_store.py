import os
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from cairn.functions.hashing import gram_hashes
from cairn.operators import dictionary, prune, sketch, stats, store
from cairn.operators.blocks import extract, spread, to_blocks
from cairn.plans import queries as Q
from cairn.plans.scratch import write_table
from cairn.sources.corpus import doc_order, read_files, read_trec, sanitize, to_corpus

SF = "/root/testdata/sf0.001"
TABLES = ["part", "events", "documents", "pages", "conversations", "lineitem"]
SLOW = {"kgram_counts", "count_of_counts"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(set(Q.oracle_sql()) - SLOW))
def test_queries_against_sql(spark, duck, name):
    got, want = Q.queries()[name](spark, SF).toPandas(), duck.sql(Q.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    rows = lambda d: sorted(map(str, d[cols].astype(str).values.tolist()))
    assert rows(got) == rows(want)


def test_queries_without_sql(spark):
    for name in sorted(set(Q.queries()) - set(Q.oracle_sql())):
        assert Q.queries()[name](spark, SF).count() > 0


def blocks_of(spark, texts, size=64):
    return to_blocks(to_corpus(spark.createDataFrame(list(enumerate(texts)), "id bigint, text string"), ["id"], "text"), size)


@pytest.mark.parametrize("texts", [[], ["", None], ["short"], ["x" * 64], ["é" * 100, "", "abc"], ["ab" * 200, None, "ab" * 31]])
@pytest.mark.parametrize("kind", ["none", "uniform", "coverage", "assemble"])
def test_round_trips_of_odd_texts(spark, texts, kind):
    b = blocks_of(spark, texts)
    s = store.build(b, store.StoreConfig(dictionary=kind, dict_bytes=128, sample=32, block_size=64, options={"k": 4} if kind == "assemble" else {}))
    whole = b"".join(bytes(r.content) for r in s.scan().orderBy("block_id").collect())
    assert whole == "".join(t or "" for t in texts).encode()
    check = store.verify(s.scan(), b).first()
    assert check.n_blocks == -(-len(whole) // 64) and check.n_bad == 0
    assert s.size() == len(whole)


def test_verify_notices_damage(spark):
    b = blocks_of(spark, ["some text " * 30])
    bad = b.filter("block_id > 0").unionByName(b.filter("block_id = 0").selectExpr("block_id", "raw_len", "cast('x' as binary) as content"))
    assert store.verify(bad, b).first().n_bad == 1
    assert store.verify(b.filter("block_id > 1"), b).first().n_bad == 2


def test_save_load_and_reuse(spark, tmp_path):
    b = blocks_of(spark, ["the quick brown fox " * 50])
    cfg = store.StoreConfig(dict_bytes=64, sample=16, block_size=64)
    s = store.build_or_load(b, str(tmp_path), cfg)
    before = os.stat(f"{tmp_path}/{cfg.name()}/manifest").st_mtime_ns
    again = store.build_or_load(b, str(tmp_path), cfg)
    assert os.stat(f"{tmp_path}/{cfg.name()}/manifest").st_mtime_ns == before
    assert again.data == s.data and store.verify(again.scan(), b).first().n_bad == 0
    assert {r.block_id for r in again.block([1, 3]).collect()} == {1, 3}
    with pytest.raises(Exception, match="(?i)path"):
        store.load(spark, str(tmp_path / "nowhere"))
    re = again.reencode(("lzma-6", "lz4", "vbyte"), "two")
    assert store.verify(re.scan(), b).first().n_bad == 0 and re.factors().count() == again.factors().count()
    assert again.size_in_bytes() > len(again.data)
    assert again.block_factors([0]).columns[-3:] == ["len_bytes", "lit_bytes", "off_bytes"]


def test_ranges_clip_at_the_end(spark):
    b = blocks_of(spark, ["0123456789" * 20])
    asked = spark.createDataFrame([(1, 0, 5), (2, 60, 10), (3, 195, 50), (4, 300, 5), (5, 10, 0), (6, 0, 200)], "req_id bigint, off bigint, len bigint")
    got = {r.req_id: bytes(r.content).decode() for r in extract(b, asked, 64).collect()}
    text = "0123456789" * 20
    assert got == {1: text[:5], 2: text[60:70], 3: text[195:], 6: text}


def test_pruning(spark):
    data = bytes(range(1, 101)) * 2
    use = spark.createDataFrame([(False, 0, 50), (False, 10, 20), (True, None, 2)], "is_literal boolean, offset int, len int")
    changes = prune.usage(use)
    want = [1] * 10 + [2] * 20 + [1] * 20 + [0] * 150
    assert prune.dense(changes, 200).tolist() == want
    assert [r.freq for r in prune.per_byte(changes, 200).orderBy("pos").collect()] == want
    assert prune.prune_rem(data, changes, 100, 50) == data[:50] + data[150:]
    for method in ("FF", "FFT"):
        out = prune.prune_care(data, changes, 120, 1, 8, method)
        assert out == data[:30] + data[110:]
    assert len(prune.prune_care(data, changes, 1, 1, 8)) == 1 and prune.prune_care(data, changes, 500) == data
    assert {(r.offset, r.length) for r in stats.zero_runs(prune.per_byte(changes, 200)).collect()} == {(50, 150)}


def test_sketch_merges_and_bounds(spark):
    a = spark.range(0, 3000).selectExpr("id % 500 as x")
    b = spark.range(0, 2000).selectExpr("id % 700 as x")
    one = sketch.CountMin(bytes(sketch.cms_build(a, "x").first()[0])).merge(sketch.CountMin(bytes(sketch.cms_build(b, "x").first()[0])))
    both = sketch.CountMin(bytes(sketch.cms_build(a.union(b), "x").first()[0]))
    items = np.arange(700)
    assert one.total == both.total == 5000 and (one.estimate(items) == both.estimate(items)).all()
    true = np.bincount(np.r_[np.arange(3000) % 500, np.arange(2000) % 700], minlength=700)
    assert (one.estimate(items) >= true).all() and one.error() < 1 and one.noise() >= 0 and 0 < one.error_probability() < 0.01


def test_kgrams_over_block_ends(spark):
    b = blocks_of(spark, ["abcdefghij" * 30])
    assert sketch.kgram_hashes(b, 8, 64).count() == 293


def test_sources(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x\0y\1z")
    (tmp_path / "t.trec").write_text("<DOC>\n<DOCNO> A-1 </DOCNO>\none\n</DOC>\n<DOC>\n<DOCNO>B</DOCNO>\ntwo\n</DOC>\n")
    raw = read_files(spark, str(tmp_path / "a.bin"))
    assert bytes(raw.select(sanitize(raw.content).alias("c")).first().c) == b"x\xfey\xffz"
    trec = read_trec(spark, str(tmp_path / "t.trec"))
    assert [r.docno for r in trec.orderBy("docno").collect()] == ["A-1", "B"]
    corpus = to_corpus(trec, ["docno"], "text")
    whole = b"".join(bytes(r.content) for r in corpus.orderBy("start").collect())
    assert [(r.docno, r.pos) for r in doc_order(corpus).orderBy("pos").collect()] == [("A-1", whole.find(b"<DOCNO>")), ("B", whole.rfind(b"<DOCNO>"))]


def test_random_requests_and_checksums(spark):
    b = blocks_of(spark, ["0123456789" * 500], 256)
    s = store.build(b, store.StoreConfig(dict_bytes=256, sample=64, block_size=256))
    asked = stats.random_requests(s.encoded, s.size(), 50, 100)
    assert s.extract(asked).count() == 50
    assert stats.checksum(s.scan()).first() == stats.checksum(b).first()
    assert stats.factor_checksum(s.factors()).first().lengths == 5000


def test_dictionary_strategies(spark):
    b = blocks_of(spark, ["".join(chr(97 + (i * i) % 23) for i in range(4000))], 256)
    for kind in ("uniform", "coverage"):
        d = dictionary.STRATEGIES[kind](b, 512, sample=64, block_size=256)
        assert 448 <= len(d) <= 700
    assert dictionary.uniform(b, 10, 64, 256) and dictionary.none(b, 10) == b""
    seq = dictionary.coverage(b, 512, 64, order="seq", block_size=256)
    assert seq == dictionary.coverage(b, 512, 64, order="seq", block_size=256)
    assert dictionary.closest_offset(1000, 4000, 512, 64) == 128


def test_streamed_documents(spark, tmp_path):
    from cairn.streaming.append import append, appended

    s = store.build(blocks_of(spark, ["some words to share " * 40]), store.StoreConfig(dict_bytes=256, sample=64, block_size=64))
    spark.createDataFrame([(1, "some words to share"), (2, None), (3, "new é words")], "doc_id bigint, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id bigint, text string").parquet(str(tmp_path / "in"))
    append(stream, s, str(tmp_path / "out"), checkpointLocation=str(tmp_path / "c")).awaitTermination()
    got = {r.block_id: bytes(r.content).decode() for r in appended(s, str(tmp_path / "out")).collect()}
    assert got == {1: "some words to share", 2: "", 3: "new é words"}


def test_sampling_rate_and_dictionaries_do_not_depend_on_what_fits_a_task(spark, monkeypatch):
    b = write_table(Q._blocks(spark, SF).filter("block_id < 8"), "blocks")
    run = lambda: (dictionary.coverage(b, 8 << 10, down=32, block_size=Q.B), sorted((r.text_pos, bytes(r.content)) for d in (False, True) for r in dictionary.segments(b, down=8, disjoint=d, block_size=Q.B).collect()))
    whole = run()
    monkeypatch.setattr(dictionary, "MAX_SAMPLED", 1500, raising=False)
    monkeypatch.setattr(dictionary, "SHARD", 1500, raising=False)
    assert whole[0] and whole[1] and run() == whole


@pytest.mark.parametrize("names", [("a", "b"), ("part", "start"), ("content", "n_bytes"), ("ids", "turn"), ("within", "before")])
def test_corpus_of_odd_ids_keeps_every_byte(spark, names):
    """Null and repeated ids, names that clash, zero bytes, empty texts, repeated rows; in any partitioning."""
    rows = [(None, 1, b"null\0"), (1, None, b"aa"), (1, None, b"b"), (None, None, b""), (2, 2, b"same"), (2, 2, b"same"), (0, 5, None), (None, 1, b"other"), (3, 1, bytes(range(256)))]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"{names[0]} int, {names[1]} int, t binary, total int").repartition(3)
    got = to_corpus(df, list(names), "t").orderBy("start", "n_bytes").collect()
    assert len(got) == len(rows) and got[0].start == 0
    key = lambda r: tuple((x is not None, x) for x in r)
    assert [tuple(r)[:2] for r in got if r.n_bytes] == sorted(((a, b) for a, b, t in rows if t), key=key)
    assert all(a.start + a.n_bytes == b.start for a, b in zip(got, got[1:]))
    whole = b"".join(bytes(r.content) for r in got)
    blocks = to_blocks(to_corpus(df, list(names), "t"), 8).orderBy("block_id").collect()
    assert b"".join(bytes(r.content) for r in blocks) == whole and all(len(r.content) == 8 for r in blocks[:-1])
    assert sorted(bytes(r.content) for r in got) == sorted(t or b"" for _, _, t in rows)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_part_parses_are_spread_and_each_query_parses_once(spark):
    assert spread(spark.range(1000, numPartitions=1), 100).rdd.getNumPartitions() == 10 and spread(spark.range(0), 100).count() == 0
    for name in ("greedy_parse", "usage_thresholds", "zero_runs", "zero_places", "heatmap", "prune_rem_blocks", "care_runs"):
        p = plan(Q.queries()[name](spark, SF))
        assert p.count("MapInArrow") == 2 and p.count("REPARTITION_BY_NUM") == 1, name  # encoded once, taken apart once


def test_thresholds_of_unused_and_fully_used_dictionaries(spark):
    of = lambda freq: sorted(tuple(r) for r in stats.usage_thresholds(spark.createDataFrame(list(enumerate(freq)), "pos int, freq bigint")).collect())
    assert of([5, 1]) == [(0, 0), (1, 2), (2, 1), (4, 1)] and of([0, 0]) == [(0, 2)] and of([]) == [(0, None)]


@pytest.mark.parametrize("limits", [{}, {"PART": 1 << 14, "GROUP": 1 << 15, "HELD": 500}, {"LEAST_HOT": 1, "GROUP": 1 << 14}])
def test_sampled_runs_are_found_in_one_pass_whatever_their_number(spark, monkeypatch, limits):
    """Against a search of every place; the dictionaries' steps read the blocks a fixed number of times."""
    for name, value in limits.items():
        monkeypatch.setattr(dictionary, name, value)
    b = write_table(Q._blocks(spark, SF).filter("block_id < 8"), "blocks")
    sample = {r.h: r.n for r in dictionary.kgram_sample(b, 16, 8, block_size=Q.B).collect()}
    for disjoint in (False, True):
        step, want = 16 if disjoint else 1, {}
        for r in b.orderBy("block_id").collect():
            on = [h in sample for h in gram_hashes(bytes(r.content), 16).tolist()[::step]]
            for a in range(len(on)):
                if on[a] and (not a or not on[a - 1]):
                    e = next((i for i in range(a, len(on)) if not on[i]), len(on))
                    if (size := (e - 1 - a) * step + 16) <= 1024:
                        want.setdefault(bytes(r.content)[a * step : a * step + size], r.block_id * Q.B + a * step)
        got = dictionary.segments(b, down=8, disjoint=disjoint, block_size=Q.B)
        assert {bytes(r.content): r.text_pos for r in got.collect()} == want and want
    text, covered, out = b"".join(bytes(r.content) for r in b.orderBy("block_id").collect()), set(), b""
    per = max(1, -(-len(text) // 512) // 8)
    for e in range(-(-len(text) // 512 // per) + 1)[:8]:
        best, score, has = e * per, 0.0, set()
        for c in range(e * per, min((e + 1) * per, -(-len(text) // 512))):
            at = [i for i in range(c * 512, min(len(text), (c + 1) * 512)) if i % Q.B <= Q.B - 16 and i + 16 <= len(text)]
            h = {int(gram_hashes(text[i : i + 16], 16)[0]) for i in at} & sample.keys()
            value = float((np.array([sample[x] for x in sorted(h - covered)], float) ** 0.5).sum() ** 2)
            if value > 0 and value >= score:
                best, score, has = c, value, h
        covered |= has
        out += text[best * 512 : (best + 1) * 512]
    assert dictionary.coverage(b, 8 * 512, 512, down=8, order="seq", block_size=Q.B) == out


@pytest.mark.parametrize("kind", ["rem", "care"])
def test_usage_of_blocks_is_that_of_their_factors(spark, monkeypatch, kind):
    b = write_table(blocks_of(spark, ["the same words again " * 40, "and others " * 30] + ["x" * 64] * 3), "blocks")
    cfg = store.StoreConfig(dict_bytes=256, sample=32, block_size=64, prune=kind, pruned_bytes=128)
    data = dictionary.uniform(b, 256, 32, 64)
    want = prune.usage(store.factors_of(store.encode_blocks(b, data, cfg), cfg))
    got = store.usage_of(b, data, cfg)
    assert prune.dense(got, len(data)).tolist() == prune.dense(want, len(data)).tolist() and plan(got).count("MapInArrow") == 1
    monkeypatch.setattr(store, "factors_of", None)  # a trial's factors aren't coded and listed
    s = store.build(b, cfg)
    assert s.data == prune.STRATEGIES[kind](data, want, 128) and store.verify(s.scan(), b).first().n_bad == 0


def test_codec_arrays_hold_the_keys_of_many_orders(spark, tmp_path):
    rows = [(i, (i * i + j) % 90_000) for i in range(3000) for j in range(i % 5 + 1)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r.l_orderkey: (r.n, r.total) for r in Q.codec_arrays(spark, str(tmp_path)).collect()}
    assert got == {i: (i % 5 + 1, 8 * sum(k for o, k in rows if o == i)) for i in range(3000)}


def test_sketch_bounds_by_parts(spark, monkeypatch):
    """Frequent runs too, in parts and batches of any size: against exact counts. A sketch of half the text counts too little."""
    monkeypatch.setattr(sketch, "PART", 700)
    monkeypatch.setattr(sketch, "HELD", 900)
    text = "".join(chr(97 + i * i * i % 25) for i in range(5000)) + "a" * 6000
    b = write_table(blocks_of(spark, [text], 256), "blocks")
    raw = text.encode()
    want = Counter(gram_hashes(raw, 16).tolist())
    half = sketch.cms_build(sketch.kgram_hashes(b, 16, 256).limit(4000), "h", 0.01, 0.01)
    for data in (bytes(sketch.cms_build(sketch.kgram_hashes(b, 16, 256), "h", 0.01, 0.01).first()[0]), bytes(half.first()[0])):
        cms = sketch.CountMin(data)
        h = np.array(list(want))
        more = cms.estimate(h) - np.array(list(want.values()))
        r = sketch.cms_bounds(data, b, 16, 256).selectExpr("sum(runs) runs", "sum(less) less", "sum(within) within").first()
        assert tuple(r) == (len(want), (more < 0).sum(), (more <= cms.error()).sum())
    assert r.less > 0


@pytest.mark.parametrize("codec", ["zlib-1", "lzma-6"])
def test_blocks_of_a_batch_are_compressed_few_at_a_time(codec):
    class Rows:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            self.run = run
            return self

    texts = [bytes([i]) * (1 << 20) for i in range(20)]
    batch = pa.RecordBatch.from_pydict({"block_id": pa.array(range(20)), "raw_len": pa.array([1 << 20] * 20, pa.int32()), "content": pa.array(texts, pa.binary())})
    coded = list(store.lz_encode(Rows(), codec).run(iter([batch])))
    back = list(store.lz_decode(Rows()).run(iter([pa.Table.from_batches(coded).combine_chunks().to_batches()[0]])))
    assert b"".join(x for b in back for x in b.column("content").to_pylist()) == b"".join(texts)
    assert all(2 <= len(x) and max(b.num_rows for b in x) <= 8 for x in (coded, back))
