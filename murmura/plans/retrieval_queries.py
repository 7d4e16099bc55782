"""Search and ranking metrics over the embeddings table; queries are the rows whose id 20 divides."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from murmura.functions import randomness, sensitivity, vector as V
from murmura.operators import chunking as C
from murmura.operators import embedding
from murmura.operators import experiments as E
from murmura.operators import metrics as M
from murmura.operators import noise as N
from murmura.operators import projection as P
from murmura.operators import retrieval as R
from murmura.operators.cells import CellConfig, CellIndex
from murmura.plans import sql_parts as S
from murmura.plans.builder import Registry
from murmura.plans.text_queries import profile_sql
from murmura.session import materialize, ship, table

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles



_PAIRS = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM e),
p AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, q.v AS a, d.v AS b, q.n AS an, d.n AS bn FROM n q, n d WHERE q.vec_id % 20 = 0),
s AS (SELECT query_id, doc_id, round(list_sum(list_transform(list_zip(a, b), lambda x: x[1] * x[2])) / (an * bn), 9) AS cosine,
  round(list_sum(list_transform(list_zip(a, b), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 9) AS l2, round(list_sum(list_transform(list_zip(a, b), lambda x: x[1] * x[2])), 9) AS ip FROM p)"""


def _top(score: str, order: str, k: int) -> str:
    return f"SELECT query_id, rank, doc_id, round(score, 6) AS score FROM (SELECT query_id, doc_id, {score} AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {score} {order}, doc_id) AS INTEGER) AS rank FROM s) WHERE rank <= {k}"


def _tables(spark, sf):
    ship(spark)
    docs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vec"))
    return docs.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id"), docs


def _shown(found):
    return found.withColumn("score", F.round("score", 6))


@_R.add("ret3_ret7_cosine", f"{_PAIRS} {_top('cosine', 'DESC', 10)}")
def ret_cosine(spark, sf):
    return _shown(R.top_k(*_tables(spark, sf), 10, "cosine"))


@_R.add("ret1_ret2_flat_l2", f"{_PAIRS} {_top('l2', 'ASC', 3)}")
def ret_l2(spark, sf):
    return _shown(R.top_k(*_tables(spark, sf), 3, "l2"))


@_R.add("ret6_inner_product", f"{_PAIRS} {_top('ip', 'DESC', 5)}")
def ret_ip(spark, sf):
    return _shown(R.top_k(*_tables(spark, sf), 5, "ip"))


def _moved(rows, id_col, stream):
    return rows.withColumn("ref", F.col("vec")).withColumn("vec", V.added(F.col("vec"), N.noise_vector(F.col(id_col), F.size("vec"), F.lit(0.02), 5, stream)))


_GAUSS = lambda stream, row: randomness.gaussian_sql(5, stream, row, "i")
_REFINE = f"""{_PAIRS}, u AS (SELECT vec_id, unnest(v) AS x, unnest(range(64)) AS i FROM n), qm AS (SELECT vec_id, list(x + 0.02 * {_GAUSS('q', 'vec_id')} ORDER BY i) AS w FROM u WHERE vec_id % 20 = 0 GROUP BY vec_id), dm AS (SELECT vec_id, list(x + 0.02 * {_GAUSS('d', 'vec_id')} ORDER BY i) AS w FROM u GROUP BY vec_id),
f AS (SELECT qm.vec_id AS query_id, dm.vec_id AS doc_id FROM qm, dm QUALIFY row_number() OVER (PARTITION BY qm.vec_id ORDER BY round(list_sum(list_transform(list_zip(qm.w, dm.w), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 9), dm.vec_id) <= 20)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY l2, doc_id) AS INTEGER) AS rank, doc_id, round(l2, 6) AS score FROM s JOIN f USING (query_id, doc_id) QUALIFY rank <= 5"""


@_R.add("ret8_ret10_filter_refine", _REFINE)
def ret_refine(spark, sf):
    """The 5 nearest by raw distance among 20 found with protected vectors."""
    queries, docs = _tables(spark, sf)
    return _shown(R.filter_refine(materialize(_moved(queries, "query_id", "q"), "moved"), materialize(_moved(docs, "doc_id", "d"), "moved"), 5, 4))


@_R.add("ret9_full_scan", f"""{_PAIRS}, t AS ({_top('l2', 'ASC', 5)}) SELECT count(*) AS results, round(avg(score), 6) AS mean_distance FROM t""")
def ret_full_scan(spark, sf):
    top = _shown(R.top_k(*_tables(spark, sf), 5, "l2"))
    return top.agg(F.count(F.lit(1)).alias("results"), F.round(F.avg("score"), 6).alias("mean_distance"))


@_R.add("ret16_linkage", """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM e),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_sum(list_transform(list_zip(q.v, d.v), lambda x: x[1] * x[2])) / (q.n * d.n), 9) AS cosine FROM n q, n d),
t AS (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, doc_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, doc_id FROM t WHERE rank <= 5""")
def ret_linkage(spark, sf):
    _, docs = _tables(spark, sf)
    return R.linkage(docs.withColumnRenamed("doc_id", "query_id"), docs, 5).select("query_id", "rank", "doc_id")


_PROMPT_SQL = " || ".join("'" + x.replace("'", "''") + "'" if i % 2 == 0 else {"role": "'知识管家'", "identity": "'The text of de' || chr(10)", "found": "coalesce(string_agg('📄【' || source || '/' || d.doc_id || '#chunk-0】' || chr(10) || substring(d.text, 1, 1000) || '...', chr(10) || chr(10) ORDER BY rank), '')", "question": "'What is like ' || query_id || '?'"}[x] for i, x in enumerate(re.split(r"\{(\w+)\}", C.PROMPT.replace("{context}", C.CONTEXT))))


@_R.add("ret18_prompt", f"""{_PAIRS}, t AS ({_top('cosine', 'DESC', 3)}), d AS (SELECT doc_id, source, text FROM documents WHERE length(text) > 0) SELECT query_id, {_PROMPT_SQL} AS prompt FROM t LEFT JOIN d ON d.doc_id = t.doc_id GROUP BY query_id""")
def ret_prompt(spark, sf):
    """The whole prompt of each query: who answers, the chunks that were found, and the question."""
    queries, docs = _tables(spark, sf)
    top = R.top_k(queries, docs, 3, "cosine")
    texts = table(spark, sf, "documents")
    records = C.sliding(texts, 1000, 200).where("chunk_id = 0").join(texts.select("doc_id", F.concat_ws("/", "source", "doc_id").alias("filename")), "doc_id")
    questions = queries.select("query_id", F.concat(F.lit("What is like "), F.col("query_id").cast("string"), F.lit("?")).alias("question"))
    return C.prompts(top, records, questions, F.lit("The text of de\n"))


_TWO = f"""{_PAIRS}, a AS ({_top('cosine', 'DESC', 10)}), b AS ({_top('l2', 'ASC', 10)}),
o AS (SELECT a.query_id, count(b.doc_id) / 5.0::DOUBLE AS overlap FROM a LEFT JOIN b ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND b.rank <= 5 WHERE a.rank <= 5 GROUP BY ALL),
r AS (SELECT a.query_id, coalesce(max(1.0::DOUBLE / b.rank), 0) AS rr FROM a LEFT JOIN b ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND b.rank <= 5 WHERE a.rank = 1 GROUP BY ALL)"""


@_R.add("met1_met4_agreement", f"{_TWO} SELECT query_id, round(overlap, 6) AS overlap, round(rr, 6) AS rr FROM o JOIN r USING (query_id)")
def met_agreement(spark, sf):
    tables = _tables(spark, sf)
    a, b = R.top_k(*tables, 10, "cosine"), R.top_k(*tables, 10, "l2")
    rr = M.reciprocal_rank(a.where("rank = 1").select("query_id", "doc_id"), b, 5)
    return M.overlap_at(a, b, 5).join(rr, "query_id").select("query_id", F.round("overlap", 6).alias("overlap"), F.round("rr", 6).alias("rr"))


@_R.add("met12_met14_stage_comparison", f"""{_PAIRS}, a AS ({_top('cosine', 'DESC', 10)}), b AS ({_top('l2', 'ASC', 10)}), depths AS (SELECT unnest([1, 3, 5, 10]) AS depth),
o AS (SELECT depth AS k, a.query_id, count(b.doc_id) / CAST(depth AS DOUBLE) AS overlap FROM depths JOIN a ON a.rank <= depth LEFT JOIN b ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND b.rank <= depth GROUP BY depth, a.query_id),
r AS (SELECT a.query_id, coalesce(max(1.0::DOUBLE / b.rank), 0) AS rr FROM a LEFT JOIN b ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND b.rank <= 5 WHERE a.rank = 1 GROUP BY ALL)
SELECT round(avg(CASE WHEN k = 1 THEN overlap END), 6) AS recall_at_1, round(avg(CASE WHEN k = 3 THEN overlap END), 6) AS recall_at_3, round(avg(CASE WHEN k = 5 THEN overlap END), 6) AS recall_at_5,
  round(avg(CASE WHEN k = 10 THEN overlap END), 6) AS recall_at_10, (SELECT round(avg(rr), 6) FROM r) AS mrr_at_5 FROM o""")
def met_stages(spark, sf):
    tables = _tables(spark, sf)
    row = M.stage_comparison(R.top_k(*tables, 10, "cosine"), R.top_k(*tables, 10, "l2"))
    return row.select(*[F.round(c, 6).alias(c) for c in row.columns])


_STAGED = f"""WITH {S.VECTORS}, w AS (SELECT i, j, {randomness.gaussian_sql(42, 'jl', 'i', 'j')} AS w FROM range(64) a(i), range(32) b(j)), u AS (SELECT vec_id, n, unnest(v) AS x, unnest(range(64)) AS i FROM n),
y AS (SELECT vec_id, j, sum(x / greatest(n, 1e-12) * w) AS y FROM u JOIN w USING (i) GROUP BY ALL), z AS (SELECT vec_id, j AS i, y / sqrt(sum(y * y) OVER (PARTITION BY vec_id)) AS x FROM y),
m AS (SELECT vec_id, list(x ORDER BY i) AS z, list(x + 0.1 * {randomness.gaussian_sql(42, 'dp', 'vec_id', 'i')} ORDER BY i) AS w FROM z GROUP BY vec_id),
p AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round({S.dot('nq.v', 'nd.v')} / (nq.n * nd.n), 9) AS raw, round({S.dot('q.z', 'd.z')}, 9) AS jl, round({S.dot('q.z', 'd.w')} / sqrt({S.dot('d.w', 'd.w')}), 9) AS jl_dp
  FROM m q JOIN m d ON q.vec_id % 20 = 0 JOIN n nq ON nq.vec_id = q.vec_id JOIN n nd ON nd.vec_id = d.vec_id),
ku AS (SELECT vec_id, list_transform(w, lambda x: x / sqrt(list_sum(list_transform(w, lambda t: t * t)))) AS v FROM m), kq AS (SELECT vec_id AS query_id, z AS v FROM m WHERE vec_id % 20 = 0), {S.cells('ku')}, {S.probes('kq')},
k AS (SELECT p.query_id, doc_id, row_number() OVER (PARTITION BY p.query_id ORDER BY raw DESC, doc_id) AS raw, row_number() OVER (PARTITION BY p.query_id ORDER BY jl DESC, doc_id) AS jl, row_number() OVER (PARTITION BY p.query_id ORDER BY jl_dp DESC, doc_id) AS jl_dp,
  CASE WHEN place <= 64 THEN row_number() OVER (PARTITION BY p.query_id ORDER BY place <= 64 DESC, jl_dp DESC, doc_id) END AS ix FROM p JOIN kown o ON o.vec_id = doc_id JOIN kprobe b ON b.query_id = p.query_id AND b.cell = o.cell),
s AS (SELECT 'jl vs raw' AS comparison, query_id, raw AS a, jl AS b FROM k UNION ALL SELECT 'jl_dp vs jl', query_id, jl, jl_dp FROM k UNION ALL SELECT 'jl_dp vs raw', query_id, raw, jl_dp FROM k UNION ALL SELECT 'index vs jl_dp', query_id, jl_dp, ix FROM k UNION ALL SELECT 'index vs raw', query_id, raw, ix FROM k),
o AS (SELECT comparison, query_id, sum((a <= 1 AND b <= 1)::INT)::DOUBLE AS r1, sum((a <= 3 AND b <= 3)::INT) / 3.0::DOUBLE AS r3, sum((a <= 5 AND b <= 5)::INT) / 5.0::DOUBLE AS r5, sum((a <= 10 AND b <= 10)::INT) / 10.0::DOUBLE AS r10, max(CASE WHEN a = 1 AND b <= 5 THEN 1.0::DOUBLE / b ELSE 0 END) AS rr FROM s GROUP BY ALL)
SELECT comparison, round(avg(r1), 6) AS recall_at_1, round(avg(r3), 6) AS recall_at_3, round(avg(r5), 6) AS recall_at_5, round(avg(r10), 6) AS recall_at_10, round(avg(rr), 6) AS mrr_at_5, round(1 - avg(r5), 6) AS loss FROM o GROUP BY comparison"""


@_R.add("met13_decomposition", _STAGED)
def met_decomposition(spark, sf):
    """Recall of each stage (raw, projected, noised, noised in an approximate index) against earlier ones."""
    queries, docs = _tables(spark, sf)
    projector = P.Projector(64, 32)
    jl = [materialize(P.project(t, projector, "vec").drop("vec").withColumnRenamed("projected", "vec"), "jl") for t in (queries, docs)]
    dp = jl[1].withColumn("vec", V.added(F.col("vec"), N.noise_vector(F.col("doc_id"), F.size("vec"), F.lit(0.1), 42)))
    dp = materialize(dp.withColumn("vec", V.normalize(F.col("vec"))), "dp")
    stages = {n: materialize(R.top_k(*t, 10), n) for n, t in {"raw": (queries, docs), "jl": jl, "jl_dp": (jl[0], dp)}.items()}
    stages["index"] = materialize(CellIndex.build(dp, CellConfig(dim=32), "doc_id").search(jl[0], 10), "index")
    out = None
    for a, b in (("raw", "jl"), ("jl", "jl_dp"), ("raw", "jl_dp"), ("jl_dp", "index"), ("raw", "index")):
        part = M.stage_comparison(stages[a], stages[b]).withColumn("comparison", F.lit(f"{b} vs {a}")).withColumn("loss", 1 - F.col("recall_at_5"))
        out = part if out is None else out.unionByName(part)
    return out.select(*[F.round(c, 6).alias(c) if c != "comparison" else F.col(c) for c in out.columns])


@_R.add("grd4_scale_slices", f"""WITH {S.VECTORS}, {S.DRAWS}, sig AS (SELECT size AS variant, vec_id, 0.5 / 8::DOUBLE AS sigma FROM n, (SELECT unnest([100, 300, 500, 1000]) AS size) WHERE vec_id < size), {S.NOISED}, {S.PAIRS.replace('q.vec_id % 20 = 0', 'q.vec_id % 20 = 0 AND q.vec_id < variant')},
per AS (SELECT variant, query_id, sum((ra <= 5 AND rb <= 5)::INT) / 5.0::DOUBLE AS r5, max(CASE WHEN ra = 1 AND rb <= 5 THEN 1.0::DOUBLE / rb ELSE 0 END) AS rr FROM r GROUP BY ALL)
SELECT variant::INTEGER AS size, round(avg(r5), 6) AS recall_at_5, round(avg(rr), 6) AS mrr_at_5 FROM per GROUP BY variant""")
def grd_slices(spark, sf):
    """Agreement of noised with raw search over the first rows, for each number of rows."""
    queries, docs = _tables(spark, sf)
    noised = materialize(E.noised(docs, "", F.lit(0.5 / 8)), "noised")
    out = None
    for n in (100, 300, 500, 1000):
        few = queries.where(F.col("query_id") < n)
        raw = R.top_k(few, docs.where(F.col("doc_id") < n), 5)
        part = E.agreement(raw, R.top_k(few, noised.where(F.col("doc_id") < n), 5).withColumn("variant", F.lit("")), (5,))
        part = part.select(F.lit(n).alias("size"), F.round("recall_at_5", 6).alias("recall_at_5"), F.round("mrr_at_5", 6).alias("mrr_at_5"))
        out = part if out is None else out.unionByName(part)
    return out


_PIPELINE = f"""WITH RECURSIVE s AS (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 200, 1), 800)) AS start FROM documents WHERE length(text) > 0),
c AS (SELECT doc_id * 16777216 + start // 800 AS row_id, doc_id, substring(text, CAST(start + 1 AS BIGINT), 1000) AS text FROM s), {profile_sql('c', 'row_id')},
tt AS (SELECT row_id, list_distinct(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_''-]{{2,}}|[一-鿿]{{2,}}'), lambda x: lower(x)), lambda x: length(x) >= 3)) AS terms FROM c), {embedding.sql('tt')},
e AS (SELECT row_id, list_transform(v, lambda x: x / greatest(n, 1e-12)) AS v FROM tvec), {S.calibration('(SELECT row_id, raw_score AS raw FROM fscore)', 'row_id')},
u AS (SELECT row_id, unnest(v) AS x, unnest(range(64)) AS i FROM e), z AS (SELECT u.row_id, i, x + sigma * 0.01::DOUBLE / 8 * {randomness.gaussian_sql(42, 'dp', 'u.row_id', 'i')} AS x FROM u JOIN cal ON cal.row_id = u.row_id),
m AS (SELECT row_id, list(x ORDER BY i) AS w, greatest(sqrt(sum(x * x)), 1e-12) AS n FROM z GROUP BY row_id), q AS (SELECT c.row_id, v, greatest(sqrt({S.dot('v', 'v')}), 1e-12) AS n FROM c JOIN e ON e.row_id = c.row_id WHERE doc_id % 20 = 0),
p AS (SELECT q.row_id AS query_id, m.row_id AS doc_id, round({S.dot('q.v', 'm.w')} / (q.n * m.n), 9) AS score FROM q, m)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM p QUALIFY rank <= 3"""


@_R.add("pipeline_private_retrieval", _PIPELINE)
def pipeline(spark, sf):
    """Documents to chunks, scores, embeddings, noise and nearest chunks.

    Queries are all chunks of the documents whose id 20 divides. A chunk's number is its document's times 2^24, plus its place.
    """
    ship(spark)
    chunks = C.sliding(table(spark, sf, "documents"), 1000, 200)
    buckets = embedding.buckets_of(C.distinct_terms(F.col("content")))
    number = F.shiftleft("doc_id", 24) + F.col("chunk_id")
    rows = materialize(chunks.select("doc_id", number.alias("row_id"), sensitivity.profile(F.col("content"))["raw_score"].alias("raw"), buckets.alias("buckets")), "buckets")
    model = embedding.TermEmbedding.fit(rows, F.col("buckets"))
    embedded = rows.select("doc_id", "row_id", "raw", model.column(rows, F.col("buckets")).alias("vec"))
    safe = N.apply_noise(N.calibrate(embedded, "raw"), "row_id", "vec", "sigma").select(F.col("row_id").alias("doc_id"), V.normalize(F.col("noised")).alias("vec"))
    queries = embedded.where("doc_id % 20 = 0").select(F.col("row_id").alias("query_id"), "vec")
    return _shown(R.top_k(materialize(queries, "queries"), materialize(safe, "noised"), 3))
