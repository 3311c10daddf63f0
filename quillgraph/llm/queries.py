"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .exact_dedup import exact_dedup
from .jaccard import near_duplicates
from .mixing import mix
from .packing import pack_documents
from .pii import find_pii
from .quality import classify
from .secrets import find_secrets
from .suffix_dedup import remove_repeats
from .warc import round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """Of the public tokenizer whose files are installed on every node."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=90)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer or tokenizer_path())


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_ngram_jaccard, op3_secret_scan, op4_warc, op5_nearest, op6_mixing, op7_quality, op8_suffix_dedup, op9_packing, op10_pii)}

ORACLE_SQL = {
    "op1_exact_dedup": r"""
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
              FROM documents)
        WINDOW g AS (PARTITION BY text_sha256)""",
    "op4_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
             k AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keep FROM p)
        SELECT page_id, strlen(html) AS payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
                   (CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT), 1)),
                   'string_agg', '') AS payload_digest,
               CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> keep THEN keep END AS refers_to
        FROM k""",
    "op6_mixing": r"""
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                          md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM documents),
             s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank
                   FROM d GROUP BY source),
             w AS (SELECT *, [3, 1, 2][CAST((rank - 1) % 3 + 1 AS INT)] AS weight, 2 * source_size AS cap FROM s),
             f AS (SELECT *, CAST(source_size AS DOUBLE) / weight AS filling, CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS BIGINT) AS budget FROM w),
             l AS (SELECT *, (budget - CAST(coalesce(sum(cap) OVER (ORDER BY filling, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
                             / CAST(sum(weight) OVER (ORDER BY filling, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level FROM f),
             o AS (SELECT *, row_number() OVER (ORDER BY filling, rank) AS place_of FROM l),
             x AS (SELECT min(place_of) AS at, arg_min(level, place_of) AS level FROM o WHERE level * weight <= cap),
             t AS (SELECT source, source_size, rank, budget, CASE WHEN place_of >= x.at THEN x.level * weight ELSE CAST(cap AS DOUBLE) END AS target FROM o, x),
             r AS (SELECT doc_id, place, size, source_size, rank, target, budget,
                          CAST(sum(size) OVER (PARTITION BY rank ORDER BY place, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run
                   FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
             c AS (SELECT doc_id, place, size, rank, budget, (run + k * source_size) / target AS finish FROM r, (VALUES (0), (1)) v(k) WHERE size > 0),
             m AS (SELECT doc_id, size, budget, CAST(sum(size) OVER (ORDER BY finish, rank, place, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM c),
             n AS (SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM m WHERE total <= budget GROUP BY doc_id)
        SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM r LEFT JOIN n USING (doc_id)""",
    "op2_ngram_jaccard": r"""
        WITH RECURSIVE w AS (
               SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x20\x09-\x0D]+') AS ws FROM documents),
             l AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                          ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) END AS ss FROM w),
             s AS (SELECT doc_id, len(ss) AS n, unnest(ss) AS s FROM l),
             o AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c
                   FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
             e AS (SELECT x, y FROM o WHERE 100 * c >= 90 * (n + m - c)),
             d AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
             r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, d.y FROM r JOIN d ON r.y = d.x),
             k AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x),
             h AS (SELECT x AS doc_id, count(*) AS n_links FROM d GROUP BY x)
        SELECT doc_id, CAST(len(ss) AS BIGINT) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links FROM l JOIN k USING (doc_id) LEFT JOIN h USING (doc_id)""",
}
