"""The queries of the operators, each over its whole table, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.llm import bpe, chat, filter_audit, jpeg, language, line_dedup, merkle, near_dup, packing, toxicity, url_filter, vectors, warc
from murmura.session import materialize, ship, table

Query = Callable[[SparkSession, str], DataFrame]

RULES = [
    url_filter.Rule("com", "/en/", "block"),
    url_filter.Rule("example.com", "/en/7", "allow"),
    url_filter.Rule("net", "/de/", "block"),
    url_filter.Rule("example.net", "/de/8", "block"),
    url_filter.Rule("org", "/es/", "block"),
]


def prepare(spark: SparkSession) -> None:
    """Ship the package, and bound the rows that go to Python at once, as texts may be long."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    archives = materialize(warc.write_archives(warc.mark_revisits(table(spark, sf_dir, "pages"))), "warc")
    found = warc.read_archives(archives, with_payload=False).where("kind = 'record'")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return bpe.digest_rows(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return vectors.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    media = jpeg.store_texts(table(spark, sf_dir, "documents"))
    found = jpeg.media_features(media, keep=("n_bytes",))
    feature = F.concat_ws(":", F.concat_ws("x", "width", "height"), "average_hash", "thumb_sha256")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    network = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, network)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    out = line_dedup.drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=("n_lines", "n_dropped"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), words=2)


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit(docs))
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return merkle.manifest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = (
        op1_warc, op2_url_filters, op3_bpe, op4_nearest, op5_media, op6_chat, op7_toxicity, op8_packing, op9_line_dedup, op10_near_dup, op11_language_id, op12_filter_audit, op13_merkle_manifest,
    )
    return {f.__name__: f for f in found}


_WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages
), f AS (
  SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY html) ELSE page_id END AS first_id FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

_URLS = """
WITH u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/7%' THEN 'example.com/en/7'
    WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/de/8%' THEN 'example.net/de/8'
    WHEN ('.' || host) LIKE '%.com' AND path LIKE '/en/%' THEN 'com/en/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/de/%' THEN 'net/de/'
    WHEN ('.' || host) LIKE '%.org' AND path LIKE '/es/%' THEN 'org/es/' END AS rule
  FROM u
)
SELECT page_id, host, path, rule, CASE WHEN rule IS NULL OR rule = 'example.com/en/7' THEN 'allow' ELSE 'block' END AS verdict FROM r
"""

_NEAREST = """
WITH e AS (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), n AS (
  SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM e
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2])) / (q.norm * c.norm) AS score
  FROM n q JOIN n c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 AND q.norm > 0 AND c.norm > 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

_NEAR_DUP = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN [words[1]]
    ELSE list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) END AS shingles FROM w
), e AS (
  SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS common FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY ALL
), links AS (
  SELECT a, b FROM shared WHERE 100 * common >= 80 * (na + nb - common)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS node, doc_id AS root FROM documents
  UNION
  SELECT e.b AS node, r.root FROM reach r JOIN edges e ON r.node = e.a
), least AS (
  SELECT node, min(root) AS component_id FROM reach GROUP BY node
)
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN least ON doc_id = node
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": _WARC,
        "op2_url_filters": _URLS,
        "op4_nearest": _NEAREST,
        "op6_chat": chat.ORACLE,
        "op9_line_dedup": line_dedup.ORACLE,
        "op10_near_dup": _NEAR_DUP,
        "op12_filter_audit": filter_audit.ORACLE,
        "op13_merkle_manifest": merkle.ORACLE,
    }
