"""Queries of the store's own operators, and their SQL. Each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.codecs import NAMES
from cairn.functions.hashing import rabin_karp
from cairn.operators import dictionary, prune, sketch, stats, store
from cairn.operators.blocks import extract, spread, to_blocks
from cairn.plans.scratch import write_table
from cairn.sources.corpus import doc_order, replaced, sanitize, to_corpus

B = 16 << 10
REQUESTS = 9973  #: ranges that are read, spread over the whole text
CFG = store.StoreConfig(block_size=B, dict_bytes=256 << 10)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_corpus(_table(spark, sf_dir, "documents"), ["doc_id"], "text")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_blocks(_corpus(spark, sf_dir), B)


def _digest(blocks: DataFrame) -> DataFrame:
    return blocks.select("block_id", "raw_len", F.sha2("content", 256).alias("sha"))


def _saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks as a table: building a store reads them several times."""
    return write_table(_blocks(spark, sf_dir), "blocks")


def _store(spark: SparkSession, sf_dir: str, **changes: object) -> store.Store:
    return store.build(_saved(spark, sf_dir), replace(CFG, **changes))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Builds a store of all documents, decodes it, and gives each block's factors and digest."""
    s = _store(spark, sf_dir)
    return s.encoded.select("block_id", "n_factors").join(_digest(s.scan()), "block_id")


# --- corpus and blocks


def corpus_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir).select("doc_id", "start", F.col("n_bytes").cast("bigint").alias("n_bytes"))


def turn_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_corpus(_table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text").select("conv_id", "turn", "start")


def odd_ids_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of events under an id that is null for some and shared by many, and whose columns are called as the corpus' own."""
    e = _table(spark, sf_dir, "events")
    odd = e.select(F.when(F.col("event_id") % 7 == 0, None).otherwise(F.col("event_id") % 100).alias("start"), F.col("event_type").alias("content"), F.col("event_type").alias("part"), F.col("event_id").cast("string").alias("t"))
    c = to_corpus(odd, ["start", "content"], "t")
    return c.groupBy(F.coalesce("id_start", F.lit(-1)).alias("id_start"), "id_content").agg(F.count("*").alias("n"), F.min("start").alias("begin"), (F.max(F.col("start") + F.col("n_bytes"))).alias("stop"), F.sum(F.col("content").cast("string").cast("bigint")).alias("total"))


def sanitized(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.encode(F.expr("replace(replace(url, '/', chr(0)), ':', chr(1))"), "UTF-8")
    return _table(spark, sf_dir, "pages").select("page_id", F.hex(sanitize(raw)).alias("clean"), F.coalesce(replaced(raw), F.lit(0)).cast("bigint").alias("n_replaced"))


def docno_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = _table(spark, sf_dir, "documents").withColumn("text", F.concat(F.lit("<DOC>\n<DOCNO> D-"), F.col("doc_id").cast("string"), F.lit(" </DOCNO>\n"), "text", F.lit("\n</DOC>\n")))
    return doc_order(to_corpus(tagged, ["doc_id"], "text"))


def blocks_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(_blocks(spark, sf_dir))


def _requests(spark: SparkSession, blocks: DataFrame) -> DataFrame:
    size = dictionary.text_size(blocks)
    return spark.range(REQUESTS).select(F.col("id").alias("req_id"), F.expr(f"id * 1000003 % {REQUESTS} * {size}L div {REQUESTS}").alias("off"), F.lit(16384).cast("bigint").alias("len"))


def raw_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _saved(spark, sf_dir)
    return extract(b, _requests(spark, b), B).select("req_id", F.sha2("content", 256).alias("sha"))


# --- dictionaries


def uniform_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.uniform_samples(_saved(spark, sf_dir), CFG.dict_bytes, block_size=B).select("sample_id", "text_pos", F.sha2("content", 256).alias("sha"))


def coverage_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = dictionary.coverage(_saved(spark, sf_dir), CFG.dict_bytes, block_size=B)
    return spark.createDataFrame([(dictionary.fingerprint(data), len(data))], "dict_id bigint, n_bytes bigint")


def assembled_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.segments(_saved(spark, sf_dir), block_size=B).select("text_pos", F.octet_length("content").alias("n_bytes"))


# --- stores


def store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(_store(spark, sf_dir).scan())


def store_empty_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(_store(spark, sf_dir, dictionary="none").scan())


def store_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(_store(spark, sf_dir, dictionary="coverage").scan())


def store_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(_store(spark, sf_dir, dictionary="assemble").scan())


def store_assemble_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(_store(spark, sf_dir, dictionary="assemble_disjoint").scan())


def store_pruned_rem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(_store(spark, sf_dir, prune="rem", pruned_bytes=128 << 10).scan())


def store_pruned_care(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(_store(spark, sf_dir, prune="care", pruned_bytes=192 << 10).scan())


def store_pruned_care_fft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(_store(spark, sf_dir, prune="care_fft", pruned_bytes=192 << 10).scan())


def store_u32v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(_store(spark, sf_dir, codecs=store.PRESETS["u32v"].codecs).scan())


def store_two_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(_store(spark, sf_dir, coder="two").scan())


def store_reencoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(_store(spark, sf_dir).reencode(("vbyte", "brotli-6", "bzip2-9")).scan())


def store_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir)
    return s.extract(_requests(spark, s.encoded)).select("req_id", F.sha2("content", 256).alias("sha"))


def store_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _corpus(spark, sf_dir)
    return store.build(write_table(to_blocks(c, B), "blocks"), CFG).documents(c.drop("content"), ["doc_id"]).select("doc_id", F.sha2("content", 256).alias("sha"))


def store_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _saved(spark, sf_dir)
    return store.verify(store.build(b, CFG).scan(), b)


def store_factor_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors of every block from the streams alone: their lengths make up the block."""
    f = _store(spark, sf_dir).factors()
    ok = F.min(F.when(F.col("is_literal"), (F.col("len") <= 3) & (F.octet_length("literal") == F.col("len"))).otherwise((F.col("len") > 3) & (F.col("offset") >= 0)))
    return f.groupBy("block_id").agg(F.sum("len").alias("raw_len"), ok.alias("well_formed"))


def _lz(codec: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _digest(store.lz_decode(store.lz_encode(_blocks(spark, sf_dir), codec)))


def codec_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's part keys through every codec that takes any number, and back. As in a store many orders make up one coded array, all those of a batch; where
    each order's keys are in it follows from their number."""
    import numpy as np
    import pyarrow as pa

    from cairn.functions.codecs import decode, encode

    names = [n for n in NAMES if not n.startswith("fixed")] + ["fixed-32"]
    rows = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_partkey")).alias("keys"))

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            keys = b.column("keys")
            v, n = np.asarray(keys.flatten().cast(pa.uint32())), np.asarray(keys.value_lengths()).astype(np.int64)
            total, end = np.zeros(len(n), np.int64), np.cumsum(n)
            for c in names:
                upto = np.r_[0, np.cumsum(decode(c, encode(c, v), len(v)).astype(np.int64))]
                total += upto[end] - upto[end - n]
            yield pa.RecordBatch.from_pydict({"l_orderkey": b.column("l_orderkey"), "n": pa.array(n), "total": pa.array(total)})

    return rows.mapInArrow(run, "l_orderkey bigint, n bigint, total bigint")


# --- a parse that SQL can follow: every part against a dictionary of brands, types and nouns


def _part_dictionary(spark: SparkSession, sf_dir: str) -> bytes:
    p = _table(spark, sf_dir, "part")
    few = p.select(F.col("p_brand").alias("w")).union(p.select("p_type")).union(p.select(F.substring_index("p_name", " ", -1))).distinct()
    return few.agg(F.expr("listagg(w, ' ') within group (order by w)")).first()[0].encode()


def _part_factors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, bytes]:
    data = _part_dictionary(spark, sf_dir)
    text = F.encode(F.concat_ws(" ", "p_name", "p_brand", "p_type"), "UTF-8")
    rows = spread(_table(spark, sf_dir, "part")).select(F.col("p_partkey").alias("block_id"), F.octet_length(text).alias("raw_len"), text.alias("content"))
    cfg = replace(CFG, threshold=1, codecs=store.PRESETS["u32v"].codecs)
    return store.factors_of(store.encode_blocks(rows, data, cfg), cfg), data


def greedy_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, _ = _part_factors(spark, sf_dir)
    return f.select("block_id", "seq", "is_literal", F.coalesce("offset", F.lit(-1)).alias("offset"), "len")


def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.length_histogram(_part_factors(spark, sf_dir)[0])


def literal_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.literal_share(_part_factors(spark, sf_dir)[0])


def _part_usage(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, bytes]:
    f, data = _part_factors(spark, sf_dir)
    return prune.per_byte(prune.usage(f), len(data)), data


def dictionary_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_usage(spark, sf_dir)[0]


def usage_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.usage_thresholds(_part_usage(spark, sf_dir)[0])


def zero_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.zero_runs(_part_usage(spark, sf_dir)[0])


def zero_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.zero_places(_part_usage(spark, sf_dir)[0], 16)


def heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    use, data = _part_usage(spark, sf_dir)
    return stats.heatmap(use, data, 0, len(data), 20).select("cell", "start", "stop", "freq", "content")


def prune_rem_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    use, data = _part_usage(spark, sf_dir)
    return prune.rem_blocks(use, len(data), len(data) // 2, 16)


def care_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prune.runs(_part_usage(spark, sf_dir)[0], 100, 4)


# --- counts, sketches, statistics


def kgram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.kgram_counts(_table(spark, sf_dir, "documents"), F.encode("text", "UTF-8"), 8)


def count_of_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.count_of_counts(sketch.kgram_counts(_table(spark, sf_dir, "documents"), F.encode("text", "UTF-8"), 8))


def rabin_karp_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(_table(spark, sf_dir, "part"))
    return p.select("p_partkey", F.posexplode(rabin_karp(F.concat_ws(" ", "p_name", "p_brand", "p_type"), 8)).alias("place", "h"))


def sketch_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A count-min sketch of all 16-byte runs never counts too little, and seldom much too much."""
    b = _saved(spark, sf_dir)
    data = sketch.cms_build(sketch.kgram_hashes(b, 16, B), "h").first()[0]
    return sketch.cms_bounds(data, b, 16, B).select((F.sum("less") == 0).alias("never_less"), (F.sum("within") / F.sum("runs") > 0.999).alias("seldom_more"))


def encoding_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir)
    return stats.encoding_summary(s.encoded, len(s.data))


def block_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir)
    return stats.block_sizes(s.encoded).withColumn("of", F.lit("bytes")).union(stats.factors_per_block(s.encoded).withColumn("of", F.lit("factors")))


def document_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.distribution(_table(spark, sf_dir, "documents").filter("text is not null"), F.octet_length(F.encode("text", "UTF-8")))


def archive_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir)
    lz = store.lz_encode(_blocks(spark, sf_dir), "zlib-9")
    return stats.archive_ratio(s.encoded, s.data).select(F.lit("dictionary").alias("codec"), "ratio").union(stats.lz_archive_ratio(lz))


_OWN = [
    corpus_offsets, turn_offsets, odd_ids_blocks, sanitized, docno_order, blocks_raw, raw_ranges, uniform_dictionary, coverage_dictionary, assembled_segments, store_roundtrip, store_empty_dictionary,
    store_coverage, store_assemble, store_assemble_disjoint, store_pruned_rem, store_pruned_care, store_pruned_care_fft, store_u32v, store_two_stream, store_reencoded, store_ranges, store_documents, store_verify,
    store_factor_bytes, codec_arrays, greedy_parse, length_histogram, literal_share, dictionary_usage, usage_thresholds, zero_runs, zero_places, heatmap, prune_rem_blocks, care_runs, kgram_counts,
    count_of_counts, rabin_karp_hashes, sketch_bounds, encoding_summary, block_sizes, document_sizes, archive_ratios,
]
_LZ = {f"lz_{c.partition('-')[0]}": c for c in ("zlib-9", "bzip2-9", "lzma-6", "lz4", "brotli-6", "aligned", "vbyte")}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _OWN} | {name: _lz(codec) for name, codec in _LZ.items()}


_TEXT = "t AS (SELECT encode(string_agg(text, '' ORDER BY doc_id)) AS b FROM documents), n AS (SELECT octet_length(b) AS n FROM t)"
_BLOCKS = f"""WITH {_TEXT} SELECT CAST(i AS BIGINT) AS block_id, CAST(least({B}, n - i * {B}) AS INTEGER) AS raw_len, sha256(b[i * {B} + 1:(i + 1) * {B}]) AS sha
    FROM t, n, range(0, (SELECT (n + {B} - 1) // {B} FROM n)) r(i)"""
_RANGES = f"""WITH {_TEXT}, q AS (SELECT i, (i * 1000003 % {REQUESTS}) * n // {REQUESTS} AS off FROM n, range(0, {REQUESTS}) r(i))
    SELECT CAST(i AS BIGINT) AS req_id, sha256(b[off + 1:least(off + 16384, n)]) AS sha FROM t, n, q"""
_SAMPLES = f"""WITH {_TEXT}, s AS (SELECT greatest(1024, n // {CFG.dict_bytes // 1024}) AS step FROM n)
    SELECT CAST(i AS BIGINT) AS sample_id, CAST(i * step AS BIGINT) AS text_pos, sha256(b[i * step + 1:least(i * step + 1024, n)]) AS sha
    FROM t, n, s, range(0, (SELECT (n + step - 1) // step FROM n, s)) r(i)"""
_DICT = "d AS (SELECT string_agg(w, ' ' ORDER BY w) AS d FROM (SELECT p_brand AS w FROM part UNION SELECT p_type FROM part UNION SELECT split_part(p_name, ' ', -1) FROM part))"
_PARSE = f"""WITH RECURSIVE {_DICT}, x AS (SELECT p_partkey AS k, concat_ws(' ', p_name, p_brand, p_type) AS s FROM part),
    u AS (SELECT DISTINCT s FROM x),
    m AS (SELECT s, p, coalesce(max(l) FILTER (WHERE instr(d, substr(s, p, l)) > 0), 1) AS l
          FROM (SELECT s, p, unnest(range(1, length(s) - p + 2)) AS l FROM (SELECT s, unnest(range(1, length(s) + 1)) AS p FROM u)), d GROUP BY s, p),
    w AS (SELECT s, CAST(0 AS BIGINT) AS seq, CAST(1 AS BIGINT) AS p FROM u UNION ALL SELECT w.s, w.seq + 1, w.p + m.l FROM w JOIN m ON m.s = w.s AND m.p = w.p WHERE w.p + m.l <= length(w.s)),
    f AS (SELECT x.k AS block_id, w.seq, m.l <= 1 AS is_literal, CASE WHEN m.l > 1 THEN instr(d, substr(w.s, w.p, m.l)) - 1 END AS "offset", m.l AS len
          FROM x JOIN w USING (s) JOIN m ON m.s = w.s AND m.p = w.p, d)"""
_USE = f"""{_PARSE}, g AS (SELECT "offset", len, count(*) AS c FROM f WHERE NOT is_literal GROUP BY ALL),
    use AS (SELECT i AS pos, coalesce(sum(c), 0) AS freq FROM (SELECT unnest(range(0, length(d))) AS i FROM d) LEFT JOIN g ON i >= "offset" AND i < "offset" + len GROUP BY i)"""

_SQL = {
    "corpus_offsets": """SELECT doc_id, CAST(sum(n) OVER (ORDER BY doc_id) - n AS BIGINT) AS start, n AS n_bytes
        FROM (SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n FROM documents)""",
    "turn_offsets": """SELECT conv_id, turn, CAST(sum(n) OVER (ORDER BY conv_id, turn) - n AS BIGINT) AS start
        FROM (SELECT conv_id, turn, coalesce(octet_length(encode(text)), 0) AS n FROM conversations)""",
    "odd_ids_blocks": """WITH e AS (SELECT CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 100 END AS id_start, event_type AS id_content, CAST(event_id AS VARCHAR) AS t FROM events),
        g AS (SELECT id_start, id_content, count(*) AS n, sum(length(t)) AS b, CAST(sum(CAST(t AS BIGINT)) AS BIGINT) AS total FROM e GROUP BY ALL)
        SELECT coalesce(id_start, -1) AS id_start, id_content, n, CAST(sum(b) OVER o - b AS BIGINT) AS "begin", CAST(sum(b) OVER o AS BIGINT) AS stop, total FROM g WINDOW o AS (ORDER BY id_start NULLS FIRST, id_content NULLS FIRST)""",
    "sanitized": """SELECT page_id, replace(replace(hex(encode(translate(url, '/:', chr(254) || chr(255)))), 'C3BE', 'FE'), 'C3BF', 'FF') AS clean,
        CAST(length(url) - length(translate(url, '/:', '')) AS BIGINT) AS n_replaced FROM pages""",
    "docno_order": """SELECT 'D-' || doc_id AS docno, CAST(sum(n) OVER (ORDER BY doc_id) - n + 6 AS BIGINT) AS pos
        FROM (SELECT doc_id, octet_length(encode('<DOC>' || chr(10) || '<DOCNO> D-' || doc_id || ' </DOCNO>' || chr(10) || text || chr(10) || '</DOC>' || chr(10))) AS n FROM documents)""",
    "raw_ranges": _RANGES,
    "store_ranges": _RANGES,
    "uniform_dictionary": _SAMPLES,
    "store_documents": "SELECT doc_id, sha256(encode(coalesce(text, ''))) AS sha FROM documents",
    "store_verify": f"WITH {_TEXT} SELECT CAST((n + {B} - 1) // {B} AS BIGINT) AS n_blocks, CAST(0 AS BIGINT) AS n_bad FROM n",
    "store_factor_bytes": f"WITH {_TEXT} SELECT CAST(i AS BIGINT) AS block_id, CAST(least({B}, n - i * {B}) AS BIGINT) AS raw_len, true AS well_formed FROM n, range(0, (SELECT (n + {B} - 1) // {B} FROM n)) r(i)",
    "codec_arrays": f"SELECT l_orderkey, count(*) AS n, CAST({len(NAMES)} * sum(l_partkey) AS BIGINT) AS total FROM lineitem GROUP BY l_orderkey",
    "greedy_parse": f'{_PARSE} SELECT block_id, CAST(seq AS INTEGER) AS seq, is_literal, CAST(coalesce("offset", -1) AS INTEGER) AS "offset", CAST(len AS INTEGER) AS len FROM f',
    "length_histogram": f"{_PARSE} SELECT CAST(CASE WHEN is_literal THEN 0 ELSE len END AS INTEGER) AS len, count(*) AS n FROM f GROUP BY 1",
    "literal_share": f"{_PARSE} SELECT count(*) AS n_factors, CAST(sum(CASE WHEN is_literal THEN 1 ELSE 0 END) AS BIGINT) AS n_literals, CAST(sum(CASE WHEN is_literal THEN len ELSE 0 END) AS BIGINT) AS literal_bytes, CAST(sum(len) AS BIGINT) AS text_bytes FROM f",
    "dictionary_usage": f"{_USE} SELECT CAST(pos AS INTEGER) AS pos, CAST(freq AS BIGINT) AS freq FROM use",
    "usage_thresholds": f"""{_USE} SELECT CAST(0 AS BIGINT) AS at_least, CAST(sum(CASE WHEN freq = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM use
        UNION ALL SELECT CAST(pow(2, i) AS BIGINT), count(*) FROM use, range(0, 40) r(i) WHERE freq >= pow(2, i) GROUP BY 1""",
    "zero_runs": f"""{_USE} SELECT CAST(min(pos) AS INTEGER) AS "offset", count(*) AS length FROM (SELECT pos, pos - row_number() OVER (ORDER BY pos) AS k FROM use WHERE freq = 0) GROUP BY k""",
    "zero_places": f"{_USE} SELECT CAST(pos % 16 AS INTEGER) AS place, count(*) AS n FROM use WHERE freq = 0 GROUP BY 1",
    "heatmap": f"""{_USE}, z AS (SELECT length(d) AS n, greatest(1, (length(d) + 19) // 20) AS width FROM d)
        SELECT CAST(pos // width AS BIGINT) AS cell, CAST((pos // width) * width AS BIGINT) AS start, CAST(least((pos // width + 1) * width, n) AS BIGINT) AS stop, CAST(sum(freq) AS BIGINT) AS freq,
        any_value(substr(d, (pos // width) * width + 1, width)) AS content FROM use, z, d GROUP BY pos // width, width, n""",
    "prune_rem_blocks": f"""{_USE} SELECT CAST(pos // 16 AS BIGINT) AS dict_block, CAST(max(freq) AS BIGINT) AS weight FROM use GROUP BY 1 ORDER BY 2, 1 LIMIT (SELECT (length(d) - length(d) // 2) // 16 FROM d)""",
    "care_runs": f"""{_USE} SELECT CAST(min(pos) AS INTEGER) AS "offset", count(*) AS length, CAST(sum(freq) AS BIGINT) AS total_usage
        FROM (SELECT pos, freq, pos - row_number() OVER (ORDER BY pos) AS k FROM use WHERE freq <= 100) GROUP BY k HAVING count(*) >= 4""",
    "kgram_counts": """SELECT substr(h, 2 * i + 1, 16) AS gram, count(*) AS freq FROM (SELECT h, unnest(range(0, length(h) // 2 - 7)) AS i FROM (SELECT hex(encode(text)) AS h FROM documents) WHERE length(h) >= 16) GROUP BY 1""",
    "count_of_counts": """SELECT freq, count(*) AS n FROM (SELECT substr(h, 2 * i + 1, 16) AS gram, count(*) AS freq FROM (SELECT h, unnest(range(0, length(h) // 2 - 7)) AS i FROM (SELECT hex(encode(text)) AS h FROM documents) WHERE length(h) >= 16) GROUP BY 1) GROUP BY 1""",
    "rabin_karp_hashes": """SELECT p_partkey, CAST(i AS INTEGER) AS place, list_reduce(list_transform(range(i + 1, i + 9), lambda j: CAST(ascii(s[j]) AS BIGINT)), lambda a, b: (a * 256 + b) % 2147483647) AS h
        FROM (SELECT p_partkey, s, unnest(range(0, length(s) - 7)) AS i FROM (SELECT p_partkey, concat_ws(' ', p_name, p_brand, p_type) AS s FROM part) WHERE length(s) >= 8)""",
    "sketch_bounds": "SELECT true AS never_less, true AS seldom_more",
    "document_sizes": """WITH s AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS r, count(*) OVER () AS c FROM (SELECT octet_length(encode(text)) AS n FROM documents WHERE text IS NOT NULL))
        SELECT min(n) AS "min", min(n) FILTER (WHERE r >= floor(c * 0.25)) AS q1, min(n) FILTER (WHERE r >= floor(c * 0.5)) AS median, avg(n) AS mean, min(n) FILTER (WHERE r >= floor(c * 0.75)) AS q3, max(n) AS "max" FROM s""",
}


def oracle_sql() -> dict[str, str]:
    same = ["blocks_raw", *_LZ, *(f.__name__ for f in _OWN if f.__name__.startswith("store_") and f.__name__ not in _SQL)]
    return _SQL | dict.fromkeys(same, _BLOCKS)
