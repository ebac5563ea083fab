"""The queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import decontam, hmm, langid, linededup, lpf, minhash, mixing, secrets, sstable, topk
from cairn.llm.common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_corpus(table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op4_nearest_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, bits = topk.codes(table(spark, sf_dir, "embeddings"))
    return topk.nearest(coded, bits, asked="id % 50 = 0").withColumnRenamed("id", "vec_id")


def op5_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.write_shards(table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), secrets.train(secrets.findings()))


def op8_later_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lpf.later_copies(table(spark, sf_dir, "documents"))


def op9_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.repeated_lines(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


_WORDS = r"regexp_extract_all(lower(text), '[a-z0-9\x{C0}-\x{1FFF}\x{2040}-\x{10FFFF}]+')"

ORACLE = {
    "op1_decontaminate": f"""
        WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
        test AS (SELECT DISTINCT item_id, ' ' || array_to_string(w[i:i + 7], ' ') || ' ' AS s
                 FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM item WHERE len(w) >= 1)),
        doc AS (SELECT doc_id, ' ' || array_to_string({_WORDS}, ' ') || ' ' AS t FROM documents WHERE text IS NOT NULL),
        hit AS (SELECT doc_id, t, item_id, count(*) AS windows FROM doc, test WHERE contains(t, s) GROUP BY ALL)
        SELECT doc_id, item_id, max(windows) AS windows FROM hit GROUP BY doc_id, item_id
    """,
    "op4_nearest_codes": """
        WITH n AS (SELECT max(len(embedding)) AS n FROM embeddings), c AS (SELECT DISTINCT vec_id, list_transform(range(1, (SELECT n FROM n) + 1), lambda i: CASE WHEN embedding[i] > 0 AND NOT isnan(embedding[i]) THEN 1 ELSE 0 END) AS b
                   FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
        d AS (SELECT x.vec_id, y.vec_id AS neighbour_id, CAST(list_sum(list_transform(list_zip(x.b, y.b), lambda p: abs(p[1] - p[2]))) AS INTEGER) AS distance
              FROM c x JOIN c y ON x.vec_id <> y.vec_id WHERE x.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour_id) AS k FROM d)
        SELECT vec_id, CAST(k AS INTEGER) AS rank, neighbour_id, distance FROM r WHERE k <= 10
    """,
    "op8_later_copies": f"""
        WITH doc AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
        win AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) AS h
                FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM doc WHERE len(w) >= 50)),
        seen AS (SELECT doc_id, i, row_number() OVER o AS n, first_value(doc_id) OVER o AS fd, first_value(i) OVER o AS fi
                 FROM win WINDOW o AS (PARTITION BY h ORDER BY doc_id, i)),
        late AS (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM seen WHERE n > 1),
        part AS (SELECT *, sum(CASE WHEN p IS NULL OR i > p + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM late)
        SELECT doc_id, CAST(min(i) AS INTEGER) AS start_word, CAST(max(i) + 50 AS INTEGER) AS end_word,
               arg_min(fd, i) AS first_doc_id, CAST(arg_min(fi, i) AS INTEGER) AS first_word
        FROM part GROUP BY doc_id, k
    """,
    "op9_repeated_lines": """
        WITH line AS (SELECT doc_id, i - 1 AS line_no, l[i] AS s
                      FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL))),
        one AS (SELECT s, min((doc_id, line_no)) AS f, length(s) AS n FROM line WHERE s <> '' GROUP BY s),
        var AS (SELECT s, f, n, i, md5(substr(s, 1, i - 1) || substr(s, i + 1)) AS v FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM one)),
        near AS (SELECT b.s, a.f FROM var a JOIN var b ON a.v = b.v AND a.n = b.n AND a.i = b.i WHERE a.f < b.f
                 UNION ALL SELECT a.s, b.f FROM one a JOIN var b ON md5(a.s) = b.v AND a.n = b.n - 1 WHERE b.f < a.f
                 UNION ALL SELECT b.s, a.f FROM one a JOIN var b ON md5(a.s) = b.v AND a.n = b.n - 1 WHERE a.f < b.f),
        best AS (SELECT s, min(f) AS e FROM near GROUP BY s)
        SELECT DISTINCT doc_id, CAST(line_no AS INTEGER) AS line_no, coalesce(e, f)[1] AS keep_doc_id, CAST(coalesce(e, f)[2] AS INTEGER) AS keep_line_no,
               CASE WHEN e IS NULL THEN 0 ELSE 1 END AS distance
        FROM line JOIN one USING (s) LEFT JOIN best USING (s) WHERE e IS NOT NULL OR f < (doc_id, line_no)
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
