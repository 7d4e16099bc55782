"""The approximate index over the embeddings table: sweeps, files with chunk records, stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmura.operators import cells as I
from murmura.operators import chunking as C
from murmura.operators import experiments as E
from murmura.operators import schemes as X
from murmura.plans import sql_parts as S
from murmura.plans.builder import Registry
from murmura.plans.retrieval_queries import _PAIRS, _tables, _top
from murmura.session import materialize, scratch_folder, table

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles

WIDTHS = [16, 32, 128, 256]  # the default of 64 is put between them
_UNITS = "ku AS (SELECT vec_id, list_transform(v, lambda x: x / greatest(n, 1e-12)) AS v FROM n), kq AS (SELECT vec_id AS query_id, v FROM ku WHERE vec_id % 20 = 0)"
_INDEX = f"{_PAIRS}, {_UNITS}, {S.cells('ku')}, {S.probes('kq')}"


@_R.add("ret6_ret7_grd3_met14_sweep", f"""{_INDEX}, widths AS (SELECT unnest([16, 32, 64, 128, 256]) AS ef),
kc AS (SELECT s.query_id, s.doc_id, cosine, place FROM s JOIN kown o ON o.vec_id = s.doc_id JOIN kprobe p ON p.query_id = s.query_id AND p.cell = o.cell),
f AS (SELECT ef, query_id, doc_id, row_number() OVER (PARTITION BY ef, query_id ORDER BY cosine DESC, doc_id) AS rank FROM kc JOIN widths ON place <= ef QUALIFY rank <= 10),
x AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, doc_id) AS rank FROM s QUALIFY rank <= 10),
b AS (SELECT ef, x.query_id, x.rank AS a, f.rank AS b FROM x CROSS JOIN widths LEFT JOIN f USING (ef, query_id, doc_id)),
per AS (SELECT ef, query_id, sum(CASE WHEN a <= 1 AND b <= 1 THEN 1 ELSE 0 END)::DOUBLE AS r1, sum(CASE WHEN a <= 3 AND b <= 3 THEN 1 ELSE 0 END) / 3.0::DOUBLE AS r3, sum(CASE WHEN a <= 5 AND b <= 5 THEN 1 ELSE 0 END) / 5.0::DOUBLE AS r5,
  sum(CASE WHEN a <= 10 AND b <= 10 THEN 1 ELSE 0 END) / 10.0::DOUBLE AS r10, max(CASE WHEN a = 1 AND b <= 5 THEN 1.0::DOUBLE / b ELSE 0 END) AS rr FROM b GROUP BY ALL),
sizes AS (SELECT cell, count(*) AS n FROM kown GROUP BY cell), looked AS (SELECT ef, query_id, sum(n) AS scored FROM kprobe JOIN sizes USING (cell) JOIN widths ON place <= ef GROUP BY ALL), l AS (SELECT ef, avg(scored) AS scored FROM looked GROUP BY ef)
SELECT ef::INTEGER AS ef_search, round(avg(r1), 6) AS recall_at_1, round(avg(r3), 6) AS recall_at_3, round(avg(r5), 6) AS recall_at_5, round(avg(r10), 6) AS recall_at_10, round(avg(rr), 6) AS mrr_at_5, round(avg(r5), 6) AS overlap_at_5,
  round(any_value(scored), 6) AS mean_scored, round((SELECT count(*) FROM n) / any_value(scored), 6) AS speedup_ratio FROM per JOIN l USING (ef) GROUP BY ef""")
def sweep(spark, sf):
    """Recall of the index against exact search, and the rows it looks at, for each number of probed cells."""
    queries, docs = _tables(spark, sf)
    index = I.CellIndex.build(docs, I.CellConfig(), "doc_id")
    rows = I.evaluate(index, queries, I.ef_values(WIDTHS, index.config.ef_search))
    return rows.select("ef_search", *[F.round(c, 6).alias(c) for c in rows.columns if c != "ef_search"])


def chunk_records(docs, size=1000, overlap=200):
    """(doc_id, filename, chunk_id, content): the first chunk of each document."""
    return C.sliding(docs, size, overlap).where("chunk_id = 0").join(docs.select("doc_id", F.concat_ws("/", "source", "doc_id").alias("filename")), "doc_id").select("doc_id", "filename", "chunk_id", "content")


@_R.add("snk1_snk2_snk7_index", f"""{_INDEX}, f AS (SELECT s.query_id, s.doc_id, cosine, CAST(row_number() OVER (PARTITION BY s.query_id ORDER BY cosine DESC, s.doc_id) AS INTEGER) AS rank FROM s JOIN kown o ON o.vec_id = s.doc_id JOIN kprobe p ON p.query_id = s.query_id AND p.cell = o.cell WHERE place <= 64 QUALIFY rank <= 5)
SELECT query_id, rank, f.doc_id, round(cosine, 6) AS score, source || '/' || d.doc_id AS filename, 0 AS chunk_id, substring(text, 1, 1000) AS content FROM f JOIN documents d ON d.doc_id = f.doc_id WHERE length(text) > 0""")
def index_files(spark, sf):
    """Search on an index that was written with its chunk records and loaded again; partitions that aren't probed aren't read."""
    queries, docs = _tables(spark, sf)
    folder = scratch_folder(spark, "index")
    I.CellIndex.build(docs, I.CellConfig(dim=64), "doc_id", chunks=chunk_records(table(spark, sf, "documents"))).save(folder)
    return I.CellIndex.load(spark, folder, dim=64, space="cosine").search_records(queries, 5).withColumn("score", F.round("score", 6))


_SCHEMES = f"""WITH {S.VECTORS}, {S.DRAWS}, sig AS (SELECT 'dp' AS variant, vec_id, 0.1 / 8::DOUBLE AS sigma FROM n), {S.NOISED}, {_UNITS}, ju AS (SELECT vec_id, list_transform(w, lambda x: x / greatest(wn, 1e-12)) AS v FROM m),
{S.cells('ku')}, {S.probes('kq')}, {S.cells('ju', p='j')}, {S.probes('kq', p='j')}, widths AS (SELECT unnest([16, 64]) AS ef),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round({S.dot('q.v', 'd.v')} / (q.n * d.n), 9) AS cosine, round({S.dot('q.v', 'm.w')} / (q.n * m.wn), 9) AS moved, greatest(round({S.dot('q.v', 'q.v')} + {S.dot('d.v', 'd.v')} - 2 * {S.dot('q.v', 'd.v')}, 9), 0) AS gap
  FROM n q JOIN n d ON q.vec_id % 20 = 0 JOIN m ON m.vec_id = d.vec_id),
x AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, doc_id) AS a FROM s QUALIFY a <= 10),
near AS (SELECT ef, s.query_id, s.doc_id, gap, row_number() OVER (PARTITION BY ef, s.query_id ORDER BY moved DESC, s.doc_id) AS b FROM s JOIN jown o ON o.vec_id = s.doc_id JOIN jprobe p ON p.query_id = s.query_id AND p.cell = o.cell JOIN widths ON place <= ef),
f AS (SELECT 'dp|index' AS scheme, ef, query_id, doc_id, b FROM near WHERE b <= 10
  UNION ALL SELECT 'sap', ef, query_id, doc_id, row_number() OVER (PARTITION BY ef, query_id ORDER BY gap, doc_id) AS b FROM near WHERE b <= 20
  UNION ALL SELECT 'scan', 64, query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY gap, doc_id) AS b FROM s),
per AS (SELECT scheme, ef, f.query_id, sum(CASE WHEN a <= 5 AND b <= 5 THEN 1 ELSE 0 END) / 5.0::DOUBLE AS r5, max(CASE WHEN a = 1 AND b <= 5 THEN 1.0::DOUBLE / b ELSE 0 END) AS rr FROM f LEFT JOIN x ON x.query_id = f.query_id AND x.doc_id = f.doc_id GROUP BY ALL),
t AS (SELECT avg(nsr) AS nsr, count(*) AS n FROM m)
SELECT scheme, CASE scheme WHEN 'sap' THEN 'filter_refine' WHEN 'scan' THEN 'full_scan' ELSE 'index' END AS backend_type, ef::INTEGER AS ef_search, 64 AS vector_dim, round(avg(r5), 6) AS recall_at_5, round(avg(rr), 6) AS mrr_at_5,
  CASE WHEN scheme = 'dp|index' THEN round(any_value(nsr), 6) END AS mean_noise_signal_ratio, CASE scheme WHEN 'sap' THEN 0.1::DOUBLE WHEN 'scan' THEN 1.0::DOUBLE END AS beta, CASE scheme WHEN 'sap' THEN 4.0::DOUBLE END AS ratio_k, CASE scheme WHEN 'scan' THEN 40.8::DOUBLE END AS cipher_expansion_ratio,
  CASE scheme WHEN 'sap' THEN '0.1' WHEN 'scan' THEN 'true' END AS metadata_beta, CASE scheme WHEN 'scan' THEN 40.8::DOUBLE END AS metadata_cipher_expansion_ratio, CASE scheme WHEN 'dp|index' THEN round(any_value(nsr), 6) END AS metadata_mean_noise_signal_ratio,
  CASE scheme WHEN 'dp|index' THEN 'normal' WHEN 'scan' THEN 'none' END AS metadata_note, CASE scheme WHEN 'scan' THEN false ELSE true END AS metadata_private, CASE scheme WHEN 'sap' THEN 4::BIGINT END AS metadata_ratio_k, CASE scheme WHEN 'dp|index' THEN any_value(n)::BIGINT END AS metadata_rows,
  CASE scheme WHEN 'sap' THEN 20::BIGINT END AS retrieval_candidates, scheme = 'scan' AS retrieval_exact, CASE scheme WHEN 'dp|index' THEN 'cosine' ELSE 'l2' END AS retrieval_measure
FROM per, t GROUP BY scheme, ef"""


@_R.add("met10_met11_ret14_scheme_rows", _SCHEMES)
def scheme_rows(spark, sf):
    """Three schemes, each searched by its own backend at two widths, with open metadata."""
    queries, docs = _tables(spark, sf)
    noised = materialize(E.noised(docs, "dp", F.lit(0.1 / 8)), "noised")
    both = queries.withColumn("ref", F.col("vec"))
    schemes = [
        X.Scheme("dp|index", "index", noised, both, X.metadata_from(noised, F.avg("nsr").alias("mean_noise_signal_ratio"), F.count(F.lit(1)).alias("rows"), private=True, note="normal", grid={"scales": [0.1]}), 64),
        X.Scheme("sap", "filter_refine", noised, both, X.metadata_of(spark, beta="0.1", ratio_k=4, private=True, note={"a": 1}, nothing=None), 64),
        X.Scheme("scan", "full_scan", docs, queries, X.metadata_of(spark, beta=True, private=False, cipher_expansion_ratio=40.8, note="none", mean_sigma="unknown"), 64),
    ]
    rows = X.scheme_rows(schemes, 5, [16, 64])
    shown = [c for c in rows.columns if not rows.schema[c].dataType.simpleString() == "double" or c.startswith("metadata_")]
    keep = [*shown, "recall_at_5", "mrr_at_5", "mean_noise_signal_ratio", "beta", "ratio_k", "cipher_expansion_ratio"]
    dropped = {"metadata_mean_sigma"}
    number = lambda c: F.round(F.nanvl(F.col(c), F.lit(None).cast("double")), 6).alias(c)
    return rows.select(*[number(c) if rows.schema[c].dataType.simpleString() == "double" else F.col(c) for c in dict.fromkeys(keep) if c not in dropped])
