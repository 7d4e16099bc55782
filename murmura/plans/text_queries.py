"""Sources, chunks and sensitivity over the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmura.functions import sensitivity as S
from murmura.operators import chunking as C
from murmura.operators import classifier as K
from murmura.operators import noise as N
from murmura.plans.builder import Registry
from murmura.session import scratch_folder, ship, table
from murmura.sources import files
from murmura.sources.tables import register

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles

# DuckDB's patterns know no Unicode flag
_EMAIL = S.ENTITIES["email"].removeprefix("(?U)")
_URL = S.ENTITIES["url"].replace("(?iU)", "(?i)").replace("'", "''")
_ASCII_EMAIL = _EMAIL.replace(r"\w", "0-9A-Za-z_")
_LIKE = {k: v.replace("'", "''") for k, v in S.KEYWORDS.items()}


def _docs(spark, sf):
    return table(spark, sf, "documents")


@_R.add("src2_src9_dispatch", """
SELECT doc_id, CASE WHEN lower(regexp_extract(source || '.' || lang, '\\.([^.]*)$', 1)) IN ('txt', 'md') THEN 'text' ELSE '' END AS strict_kind,
  CASE WHEN regexp_matches(CAST(doc_id AS VARCHAR), '^[0-9]+$') THEN 'text' ELSE '' END AS lenient_kind FROM documents""")
def src_dispatch(spark, sf):
    named = F.concat_ws(".", "source", "lang")
    return _docs(spark, sf).select("doc_id", files.kind(named).alias("strict_kind"), files.kind(F.col("doc_id").cast("string"), True).alias("lenient_kind"))


@_R.add("src17_count", "SELECT count(*) AS documents, count(text) AS texts FROM documents")
def src_count(spark, sf):
    """Documents and texts counted as they pass on their way to a file."""
    path = scratch_folder(spark, "counted")
    seen = files.write_counted(_docs(spark, sf).select("doc_id", "text"), lambda rows: rows.write.parquet(path), texts=F.count("text"))
    return spark.createDataFrame([(seen["rows"], seen["texts"])], "documents long, texts long")


@_R.add("txt2_paragraphs", r"""
SELECT doc_id, CAST(len(p) AS INTEGER) AS paragraphs, CAST(list_sum(list_transform(p, lambda x: length(x))) AS BIGINT) AS chars FROM (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM documents)""")
def txt_paragraphs(spark, sf):
    p = C.paragraphs(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.size(p).alias("paragraphs"), F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"))


@_R.add("txt3_sentences", r"""
WITH m AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '([。！？；!?;])\s*', '\1' || chr(1), 'g'), '([A-Za-z0-9][.])\s+', '\1' || chr(1), 'g'), chr(1)) AS p FROM documents),
s AS (SELECT doc_id, list_filter(list_transform(p, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM m)
SELECT doc_id, CAST(len(s) AS INTEGER) AS sentences, md5(array_to_string(s, '|')) AS sentences_md5 FROM s""")
def txt_sentences(spark, sf):
    parts = F.filter(F.transform(F.split("text", C.SENTENCE), C.strip), lambda s: s != "")
    return _docs(spark, sf).select("doc_id", F.size(parts).alias("sentences"), F.md5(F.array_join(parts, "|")).alias("sentences_md5"))


@_R.add("txt4_txt7_semantic_chunks")
def txt_semantic(spark, sf):
    ship(spark)
    scored = C.semantic(_docs(spark, sf)).withColumn("p", S.profile(F.col("content")))
    return scored.select("doc_id", "chunk_id", "content", F.col("p.raw_score").alias("raw_sensitivity_score"), F.col("p.epsilon").alias("privacy_epsilon"), F.col("p.delta").alias("dynamic_delta"))


@_R.add("txt9_sliding_chunks", """
WITH s AS (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 200, 1), 800)) AS start FROM documents WHERE length(text) > 0)
SELECT doc_id, CAST(start // 800 AS INTEGER) AS chunk_id, CAST(start AS INTEGER) AS start, substring(text, CAST(start + 1 AS BIGINT), 1000) AS content FROM s""")
def txt_sliding(spark, sf):
    return C.sliding(_docs(spark, sf), 1000, 200)


@_R.add("txt4_txt9_chunk_function", """
WITH s AS (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 100, 1), 400)) AS start FROM documents WHERE length(text) > 0)
SELECT doc_id, CAST(start // 400 AS INTEGER) AS chunk_id, substring(text, CAST(start + 1 AS BIGINT), 500) AS content FROM s""")
def txt_chunk_function(spark, sf):
    """Chunks by the table function, called in SQL with a document's rows together."""
    register(spark)
    return spark.sql(
        "SELECT CAST(filename AS BIGINT) AS doc_id, chunk_id, content FROM chunks(TABLE(SELECT CAST(doc_id AS STRING) AS filename, text AS content FROM {docs}) PARTITION BY (filename), 500, 100, 'sliding')", docs=_docs(spark, sf)
    )


_CHUNKED = "s AS (SELECT doc_id, source, text, unnest(range(0, greatest(length(text) - 200, 1), 800)) AS start FROM documents WHERE length(text) > 0), c AS (SELECT doc_id, source, CAST(start // 800 AS INTEGER) AS chunk_id, substring(text, CAST(start + 1 AS BIGINT), 1000) AS content FROM s)"


@_R.add("txt10_prefix_sample", f"WITH {_CHUNKED} SELECT source || '/' || doc_id AS filename, chunk_id, content FROM c ORDER BY filename, chunk_id LIMIT 100")
def txt_prefix(spark, sf):
    """The first 100 chunks in the order of their files."""
    docs = _docs(spark, sf).select("doc_id", F.concat_ws("/", "source", "doc_id").alias("filename"), "text")
    return C.sliding(docs, 1000, 200, "filename").select("filename", "chunk_id", "content").orderBy("filename", "chunk_id").limit(100)


@_R.add("txt11_txt12_terms", """
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_''-]{2,}|[一-鿿]{2,}') AS w FROM documents),
t AS (SELECT doc_id, len(w) AS n, list_filter(list_transform(w, lambda x: lower(x)), lambda x: length(x) >= 3) AS l FROM w)
SELECT doc_id, CAST(n AS INTEGER) AS words, CAST(len(list_distinct(l)) AS INTEGER) AS terms, array_to_string(l[1:1], '') AS first_term FROM t""")
def txt_terms(spark, sf):
    rows = _docs(spark, sf).select("doc_id", C.words(F.col("text")).alias("w"), C.distinct_terms(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("w").alias("words"), F.size("t").alias("terms"), F.coalesce(F.get("t", F.lit(0)), F.lit("")).alias("first_term"))


_ASKED = r"""CASE WHEN len(l) >= 4 THEN array_to_string(list_transform(list_sort(list_transform(l, lambda x: {'h': md5('2026|' || doc_id || '|' || chunk_id || '|' || x), 'x': x}))[1:8], lambda s: s.x), ' ')
  WHEN len(b) > 0 THEN array_to_string(b[1:16], ' ') ELSE 'general document topic' END"""
_TERMED = r"""t AS (SELECT doc_id, chunk_id, list_distinct(list_filter(list_transform(regexp_extract_all(content, '[A-Za-z][A-Za-z0-9_''-]{2,}|[一-鿿]{2,}'), lambda x: lower(x)), lambda x: length(x) >= 3)) AS l, list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '') AS b FROM c),
p AS (SELECT *, row_number() OVER (ORDER BY md5('2026|' || doc_id || '|' || chunk_id), doc_id, chunk_id) AS query_no FROM t)"""


@_R.add("txt13_queries", f"WITH {_CHUNKED}, {_TERMED} SELECT query_no, doc_id, chunk_id, {_ASKED} AS query FROM p WHERE query_no <= 30")
def txt_queries(spark, sf):
    """30 queries made from chunks."""
    return C.generated_queries(C.sliding(_docs(spark, sf), 1000, 200), 30, 2026)


@_R.add("txt13_queries_all", f"""WITH {_CHUNKED}, {_TERMED} SELECT query_no, doc_id, chunk_id, {_ASKED} AS query FROM p
UNION ALL SELECT i + n, NULL, NULL, 'general document topic ' || (i + n) FROM (SELECT count(*) AS n FROM c), (SELECT unnest(range(1, 8)) AS i)""")
def txt_queries_all(spark, sf):
    """A query of every chunk, and seven more than there are chunks."""
    chunks = C.sliding(_docs(spark, sf), 1000, 200)
    return C.generated_queries(chunks, chunks.count() + 7, 2026)


@_R.add("txt14_txt17_display", r"""
WITH o AS (SELECT doc_id, text, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS line FROM documents)
SELECT doc_id, CASE WHEN length(line) > 80 THEN substring(line, 1, 79) || '…' ELSE line END AS preview, substring(text, 1, 1000) || '...' AS prompt,
  CASE WHEN contains(text, '</think>') THEN string_split(text, '</think>')[1] ELSE '' END AS thought FROM o""")
def txt_display(spark, sf):
    t = F.col("text")
    return _docs(spark, sf).select("doc_id", C.preview(t, 80).alias("preview"), C.prompt_cut(t).alias("prompt"), C.answer_parts(t).thought.alias("thought"))


def _case(pattern: str, weight: float) -> str:
    return f"CASE WHEN regexp_matches(text, '{pattern}') THEN {weight}::DOUBLE ELSE 0::DOUBLE END"


_KEYWORD_SQL = "least(1.0::DOUBLE, " + " + ".join(_case(_LIKE[k], w) for k, w in S.KEYWORD_WEIGHTS.items()) + ")"
_HEURISTIC_SQL = f"""least(1.0::DOUBLE, CASE WHEN regexp_matches(text, '{S.HEURISTICS['Name']}') AND regexp_matches(text, '{S.HEURISTICS['Private']}') AND NOT regexp_matches(text, '{_LIKE['Public']}') THEN 0.12::DOUBLE ELSE 0::DOUBLE END
  + {_case(S.HEURISTICS['Finance'], 0.18)} + {_case(S.HEURISTICS['Internal'], 0.12)})"""


@_R.add("prv2_prv4_keywords", f"SELECT doc_id, round({_KEYWORD_SQL}, 9) AS keyword_score, round({_HEURISTIC_SQL}, 9) AS heuristic_score, regexp_matches(text, '{_LIKE['Public']}') AS is_public FROM documents")
def prv_keywords(spark, sf):
    t = F.col("text")
    return _docs(spark, sf).select("doc_id", F.round(S.keyword_score(t), 9).alias("keyword_score"), F.round(S.heuristic_score(t), 9).alias("heuristic_score"), S.is_public(t).alias("is_public"))


_ALONE = lambda body: f"len(regexp_extract_all(wide, '(?:^|[^0-9])(?:{body})(?:$|[^0-9])'))"  # noqa: E731  # numbers that stand alone: without look-behind, each other character is doubled before
_COUNTS = {
    "ID": _ALONE("[0-9]{17}[0-9Xx]|[0-9]{15}"), "Phone": _ALONE("1[3-9][0-9]{9}"), "Bank": _ALONE("4[0-9]{15}|5[1-5][0-9]{14}|62[0-9]{14,17}"),
    "Money": f"len(regexp_extract_all(text, '(?i){S.IDENTIFIERS['Money'][4:]}'))", "Email": f"len(regexp_extract_all(text, '{_ASCII_EMAIL}'))",
}
_IDENTIFIER_SQL = "least(1.0::DOUBLE, " + " + ".join(f"{w}::DOUBLE * {_COUNTS[k]}" for k, w in S.IDENTIFIER_WEIGHTS.items()) + ")"


def profile_sql(rows: str, key: str, p: str = "f") -> str:
    """CTE {p}score (key, score, raw_score, epsilon, delta) for rows (key, text), as sensitivity.profile() gives it."""
    return f"""{p}w AS (SELECT {key}, text, regexp_replace(text, '([^0-9])', '\\1\\1', 'g') AS wide FROM {rows}),
{p}p AS (SELECT {key}, {_IDENTIFIER_SQL} AS identifiers, {_KEYWORD_SQL} + {_HEURISTIC_SQL} AS words FROM {p}w),
{p}f AS (SELECT {key}, least(1.0::DOUBLE, identifiers + words) * CASE WHEN identifiers > 0.8 THEN 1.0::DOUBLE ELSE 0.65::DOUBLE END AS score FROM {p}p),
{p}score AS (SELECT {key}, score, least(greatest(0.1::DOUBLE + 9.9::DOUBLE * score, 0.1), 10) AS raw_score, least(greatest(0.1::DOUBLE + 9.9::DOUBLE * pow(1 - score, 2.2), 0.1), 10) AS epsilon, 2 * (1 + 0.5::DOUBLE * score) AS delta FROM {p}f)"""


@_R.add("prv1_identifiers", f"""WITH w AS (SELECT doc_id, text, regexp_replace(text, '([^0-9])', '\\1\\1', 'g') AS wide FROM documents)
SELECT doc_id, {', '.join(f'CAST({sql} AS INTEGER) AS {k.lower()}' for k, sql in _COUNTS.items())}, round({_IDENTIFIER_SQL}, 9) AS identifier_score FROM w""")
def prv_identifiers(spark, sf):
    t = F.col("text")
    counts = [F.regexp_count(t, F.lit(S.IDENTIFIERS[k])).alias(k.lower()) for k in _COUNTS]
    return _docs(spark, sf).select("doc_id", *counts, F.round(S.identifier_score(t), 9).alias("identifier_score"))


@_R.add("prv6_prv10_profile", f"WITH {profile_sql('documents', 'doc_id')} SELECT doc_id, round(score, 9) AS score, round(raw_score, 9) AS raw_score, round(epsilon, 9) AS epsilon, round(delta, 9) AS delta FROM fscore")
def prv_profile(spark, sf):
    rows = _docs(spark, sf).select("doc_id", S.profile(F.col("text")).alias("p"))
    return rows.select("doc_id", *[F.round(F.col(f"p.{c}"), 9).alias(c) for c in ("score", "raw_score", "epsilon", "delta")])


@_R.add("prv5_classifier_profile")
def prv_classified(spark, sf):
    """Profiles with a classifier's share, which is learned from the labelled documents of good quality."""
    ship(spark)
    docs = _docs(spark, sf).select("doc_id", "text")
    good = table(spark, sf, "labels").where("quality = 1").select("doc_id").distinct()
    model = K.TermClassifier.fit(docs.join(good, "doc_id", "left_semi"))
    rows = model.scored(docs).withColumn("p", S.profile(F.col("text"), F.col("nlp")))
    return rows.select("doc_id", F.round("nlp", 6).alias("nlp"), *[F.round(F.col(f"p.{c}"), 6).alias(c) for c in ("score", "raw_score", "epsilon", "delta")])


@_R.add("prv7_prv9_scores", """
WITH s AS (SELECT doc_id, (doc_id % 101) / 100.0::DOUBLE AS s FROM documents)
SELECT doc_id, round(least(greatest(0.1 + 9.9 * s, 0.1), 10), 9) AS raw_score, round(least(greatest(0.1 + 9.9 * pow(1 - s, 2.2), 0.1), 10), 9) AS epsilon, round(2 * (1 + 0.5 * s), 9) AS delta FROM s""")
def prv_scores(spark, sf):
    s = (F.col("doc_id") % 101) / F.lit(100.0)
    return _docs(spark, sf).select("doc_id", F.round(S.raw_score(s), 9).alias("raw_score"), F.round(S.legacy_epsilon(s), 9).alias("epsilon"), F.round(S.legacy_delta(s), 9).alias("delta"))


_FIND = f"regexp_matches(text, '{_ASCII_EMAIL}') AS e, regexp_matches(text, '{_URL}') AS u"


@_R.add("prv11_prv13_entities", f"""
WITH f AS (SELECT doc_id, {_FIND}, len(regexp_extract_all(text, '{_ASCII_EMAIL}')) + len(regexp_extract_all(text, '{_URL}')) AS n FROM documents)
SELECT doc_id, array_to_string(list_filter([CASE WHEN e THEN 'email' END, CASE WHEN u THEN 'url' END], lambda x: x IS NOT NULL), ',') AS entity_types, CAST(n AS INTEGER) AS entity_count FROM f WHERE n > 0""")
def prv_entities(spark, sf, kinds=("email", "url")):
    t = F.col("text")
    n = sum((S.entity_count(t, k) for k in kinds), F.lit(0))
    return _docs(spark, sf).select("doc_id", F.array_join(S.entity_types(t, kinds), ",").alias("entity_types"), n.alias("entity_count")).where("entity_count > 0")


@_R.add("prv11_prv13_entities_all")
def prv_entities_all(spark, sf):
    """With phone numbers, whose look-behind SQL can't express; so are the other queries of this suffix."""
    return prv_entities(spark, sf, tuple(S.ENTITIES))


@_R.add("prv14_redaction", f"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '{_ASCII_EMAIL}', ' ', 'g'), '{_URL}', ' ', 'g')) AS redacted_md5 FROM documents")
def prv_redaction(spark, sf, kinds=("email", "url")):
    return _docs(spark, sf).select("doc_id", F.md5(S.redact(F.col("text"), kinds)).alias("redacted_md5"))


@_R.add("prv14_redaction_all")
def prv_redaction_all(spark, sf):
    return prv_redaction(spark, sf, tuple(S.ENTITIES))


@_R.add("prv15_attack_queries")
def prv_attack(spark, sf):
    clean = S.redact(F.col("text"))
    rows = _docs(spark, sf).where(F.size(S.entity_types(F.col("text"))) > 0).select(F.col("doc_id").alias("target_id"), S.entity_types(F.col("text")).alias("entity_types"), C.distinct_terms(clean).alias("l")).where("size(l) >= 4")
    drawn = F.slice(F.array_sort(F.transform("l", lambda x: F.struct(F.md5(F.concat_ws("|", F.lit("2027"), F.col("target_id").cast("string"), x)).alias("h"), x.alias("x")))), 1, 8)
    return rows.select("target_id", "entity_types", F.array_join(F.transform(drawn, lambda s: s.x), " ").alias("query"))


@_R.add("prv16_prv18_label_counts", f"""
WITH f AS (SELECT {_FIND} FROM documents)
SELECT 'has_email' AS attribute, sum(e::INT)::BIGINT AS positives, sum((NOT e)::INT)::BIGINT AS negatives FROM f
UNION ALL SELECT 'has_url', sum(u::INT)::BIGINT, sum((NOT u)::INT)::BIGINT FROM f
UNION ALL SELECT 'has_any_sensitive', sum((e OR u)::INT)::BIGINT, sum((NOT (e OR u))::INT)::BIGINT FROM f""")
def prv_labels(spark, sf, kinds=("email", "url")):
    found = [F.col("text").rlike(S.ENTITIES[k]).cast("int") for k in kinds]
    names = [*(f"has_{k}" for k in kinds), "has_any_sensitive"]
    flags = _docs(spark, sf).select(*[c.alias(n) for c, n in zip([*found, F.greatest(*found)], names)])
    long = flags.unpivot([], names, "attribute", "label")
    return long.groupBy("attribute").agg(F.sum("label").alias("positives"), F.sum(1 - F.col("label")).alias("negatives"))


@_R.add("prv16_prv18_label_counts_all")
def prv_labels_all(spark, sf):
    return prv_labels(spark, sf, tuple(S.ENTITIES))


@_R.add("prv19_eligible", f"""
WITH f AS (SELECT {_FIND} FROM documents), c AS (
SELECT 'has_email' AS attribute, sum(e::INT)::BIGINT AS positives, sum((NOT e)::INT)::BIGINT AS negatives FROM f UNION ALL SELECT 'has_url', sum(u::INT)::BIGINT, sum((NOT u)::INT)::BIGINT FROM f
UNION ALL SELECT 'has_any_sensitive', sum((e OR u)::INT)::BIGINT, sum((NOT (e OR u))::INT)::BIGINT FROM f)
SELECT attribute FROM c WHERE positives >= 5 AND negatives >= 5""")
def prv_eligible(spark, sf, kinds=("email", "url")):
    return prv_labels(spark, sf, kinds).where("positives >= 5 AND negatives >= 5").select("attribute")


@_R.add("prv19_eligible_all")
def prv_eligible_all(spark, sf):
    return prv_eligible(spark, sf, tuple(S.ENTITIES))


@_R.add("txt15_panel", """WITH l AS (SELECT doc_id, array_to_string(list_transform(string_split(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), chr(10)), lambda x: rtrim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13))), chr(10)) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 120 THEN t ELSE rtrim(substring(t, 1, 117), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) || '...' END AS panel FROM l""")
def txt_panel(spark, sf):
    return _docs(spark, sf).select("doc_id", C.panel(F.col("text"), 120).alias("panel"))


_ECHOED = "'问题：' || doc_id || '  ' || doc_id || CASE WHEN doc_id % 5 = 0 THEN '' ELSE ' the answer ' || (doc_id % 7) || '  ' END"


@_R.add("txt18_answer_cleanup", f"""WITH a AS (SELECT doc_id, doc_id::VARCHAR AS q, trim({_ECHOED}) AS t FROM documents), b AS (SELECT doc_id, q, trim(substring(t, length('问题：' || q) + 1)) AS t FROM a), c AS (SELECT doc_id, CASE WHEN starts_with(t, q) THEN trim(substring(t, length(q) + 1)) ELSE t END AS t FROM b)
SELECT doc_id, CASE WHEN t = '' THEN '{C.NO_ANSWER}' ELSE t END AS answer FROM c""")
def txt_cleanup(spark, sf):
    """Answers that repeat the question with a heading and then without it."""
    i = F.col("doc_id").cast("string")
    rest = F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit(" the answer "), (F.col("doc_id") % 7).cast("string"), F.lit("  ")))
    return _docs(spark, sf).select("doc_id", C.cleaned_answer(F.concat(F.lit("问题："), i, F.lit("  "), i, rest), i).alias("answer"))


@_R.add("ret18_src12_prompt_parts", """SELECT doc_id, '📄【' || source || '#chunk-' || (doc_id % 9) || '】' || chr(10) || substring(text, 1, 1000) || '...' AS entry, '[系统角色提示]' || chr(10) || lang || chr(10) || chr(10) AS identity FROM documents""")
def prompt_parts(spark, sf):
    """What a prompt shows of a chunk, and the heading of the text that sets its role."""
    return _docs(spark, sf).select("doc_id", C.prompt_entry(F.col("source"), F.col("doc_id") % 9, F.col("text")).alias("entry"), C.identity(F.col("lang")).alias("identity"))


@_R.add("dp10_score_fallback", "SELECT doc_id, coalesce(CASE WHEN doc_id % 4 <> 0 THEN (doc_id % 10)::DOUBLE END, 0.1)::DOUBLE AS score, 0.1::DOUBLE AS missing FROM documents")
def score_fallback(spark, sf):
    """The first score column that is there; 0.1 for what is no number, or without one."""
    docs = _docs(spark, sf)
    scored = docs.withColumn("raw_score", F.when(F.col("doc_id") % 4 != 0, (F.col("doc_id") % 10).cast("string")).otherwise(F.lit("none"))).withColumn("sensitivity_score", F.lit(9.0))
    return scored.select("doc_id", N.score_column(scored).alias("score"), N.score_column(docs).alias("missing"))
