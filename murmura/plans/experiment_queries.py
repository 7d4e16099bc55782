"""Experiments: utility, ablations, linkage, exposure and membership of protected vectors, and the grids over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmura.functions import randomness, sensitivity, vector as V
from murmura.operators import chunking as C
from murmura.operators import embedding
from murmura.operators import experiments as E
from murmura.operators import grids as G
from murmura.operators import noise as N
from murmura.operators import projection as P
from murmura.operators import retrieval as R
from murmura.operators import security as X
from murmura.operators import summaries as Y
from murmura.operators.asof import as_of
from murmura.plans import sql_parts as S
from murmura.plans import text_queries as T
from murmura.plans.builder import Registry
from murmura.plans.retrieval_queries import _tables
from murmura.plans.security_queries import _GRID, _ROWS, _grid, _scored
from murmura.session import materialize, scratch_folder, ship, table

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles

SCALES = (0.001, 0.01, 0.05, 0.1, 0.2, 0.5)


def _rounded(df, keep, digits=6):
    return df.select(*[F.col(c) if c in keep else F.round(c, digits).alias(c) for c in df.columns])


_FLAT = f"WITH {S.VECTORS}, {S.DRAWS}, sig AS (SELECT 'scale ' || s AS variant, vec_id, s::DOUBLE / 8 AS sigma FROM n, (SELECT unnest(['0.001', '0.01', '0.05', '0.1', '0.2', '0.5']) AS s)), {S.NOISED}, {S.PAIRS}"


def _by_scale(docs, scales=SCALES):
    names = [f"scale {s:g}" for s in scales]
    return materialize(E.noised_all(docs, {n: F.lit(s / 8) for n, s in zip(names, scales)}), "variants"), names


@_R.add("met6_met9_grd1_utility_rows", f"{_FLAT}, {S.UTILITY}")
def utility(spark, sf):
    """The utility row of each noise scale."""
    queries, docs = _tables(spark, sf)
    return _rounded(E.utility_rows(queries, docs, *_by_scale(docs)), ("variant",))


@_R.add("met16_similarity", f"{_FLAT} SELECT variant, query_id, round(avg(a), 6) AS mean_raw, round(avg(b), 6) AS mean_moved, round(avg(abs(a - b)), 6) AS mean_drift, round(max(abs(a - b)), 6) AS max_drift, round(corr(a, b), 6) AS pearson FROM r GROUP BY variant, query_id")
def similarity(spark, sf):
    """Mean scores, drift and correlation of each query and scale."""
    queries, docs = _tables(spark, sf)
    return _rounded(E.score_changes(queries, *_by_scale(docs)), ("variant", "query_id"))


_ABLATION = f"""WITH RECURSIVE {S.VECTORS}, {S.CALIBRATION}, {S.DRAWS}, sig AS (
SELECT k.name || ' ' || c.s AS variant, vec_id, CASE k.name WHEN 'full' THEN cal.sigma / 8 WHEN 'no_dp' THEN 0 WHEN 'no_dimension_scaling' THEN cal.sigma ELSE (SELECT sigma FROM matched) / 8 END * c.s::DOUBLE AS sigma
FROM cal, (SELECT unnest(['full', 'no_dp', 'no_dimension_scaling', 'fixed_calibration']) AS name) k, (SELECT unnest(['0.01', '0.1', '0.5']) AS s) c), {S.NOISED}, {S.PAIRS}, {S.UTILITY}"""


def _calibrated(spark, sf):
    _, docs = _tables(spark, sf)
    return materialize(N.calibrate(docs.withColumn("raw", F.lit(0.1) + (F.col("doc_id") % 100) * F.lit(0.1)), "raw"), "calibrated")


def no_jl_variants(docs, scales):
    """Four variants on raw vectors; the fixed one has the mean epsilon and sensitivity of the others."""
    mean = docs.agg(F.avg("epsilon").alias("e"), F.avg("local_sensitivity").alias("s")).first()
    fixed = N.multiplier(mean.e, N.NoiseConfig().delta)[0] * mean.s if mean.e is not None else 0.0
    width = F.sqrt(F.size("vec").cast("double"))
    kinds = {"full": F.col("sigma") / width, "no_dp": F.lit(0.0), "no_dimension_scaling": F.col("sigma"), "fixed_calibration": F.lit(fixed) / width}
    sigmas = {f"{k} {s:g}": sigma * s for k, sigma in kinds.items() for s in scales}
    return materialize(E.noised_all(docs, sigmas), "variants"), list(sigmas)


def noise_parameters(docs, scales):
    """(variant, utility_scale, mean_sigma, max_sigma, mean_sigma_per_dim, mean_epsilon, min_epsilon) of no_jl_variants(); no epsilon where there is no noise."""
    mean = docs.agg(F.avg("epsilon").alias("e"), F.avg("local_sensitivity").alias("s")).first()
    fixed = N.multiplier(mean.e, N.NoiseConfig().delta)[0] * mean.s if mean.e is not None else 0.0
    width, none = F.sqrt(F.size("vec").cast("double")), F.lit(None).cast("double")
    kinds = {"full": (F.col("sigma"), width, F.col("epsilon")), "no_dp": (F.lit(0.0), width, none), "no_dimension_scaling": (F.col("sigma"), F.lit(1.0), F.col("epsilon")), "fixed_calibration": (F.lit(fixed), width, F.lit(mean.e))}
    parts = [
        docs.agg(F.avg(sigma).alias("mean_sigma"), F.max(sigma).alias("max_sigma"), F.avg(sigma * s / by).alias("mean_sigma_per_dim"), F.avg(eps).alias("mean_epsilon"), F.min(eps).alias("min_epsilon")).select(F.lit(f"{k} {s:g}").alias("variant"), F.lit(s).alias("utility_scale"), "*")
        for k, (sigma, by, eps) in kinds.items() for s in scales
    ]
    return E.union(parts)


_NOISE_SHOWN = """np AS (SELECT k.name || ' ' || c.s AS variant, c.s::DOUBLE AS utility_scale, CASE k.name WHEN 'no_dp' THEN 0 WHEN 'fixed_calibration' THEN (SELECT sigma FROM matched) ELSE cal.sigma END AS total, CASE k.name WHEN 'no_dimension_scaling' THEN 1 ELSE 8 END AS width,
  CASE k.name WHEN 'no_dp' THEN NULL WHEN 'fixed_calibration' THEN (SELECT avg(eps) FROM cal) ELSE cal.eps END AS eps FROM cal, (SELECT unnest(['full', 'no_dp', 'no_dimension_scaling', 'fixed_calibration']) AS name) k, (SELECT unnest(['0.01', '0.1', '0.5']) AS s) c),
ns AS (SELECT variant, any_value(utility_scale) AS utility_scale, round(avg(total), 6) AS mean_sigma, round(max(total), 6) AS max_sigma, round(avg(total * utility_scale / width), 6) AS mean_sigma_per_dim, round(avg(eps), 6) AS mean_epsilon, round(min(eps), 6) AS min_epsilon FROM np GROUP BY variant)"""


@_R.add("dp17_grd2_grd17_ablation_grid", f"WITH RECURSIVE {_ABLATION.removeprefix('WITH RECURSIVE ').replace(S.UTILITY, S.UTILITY_PARTS)}, ut AS ({S.UTILITY_ROW}), {_NOISE_SHOWN} SELECT ut.*, ns.* EXCLUDE (variant) FROM ut JOIN ns ON ns.variant = ut.variant")
def ablation_grid(spark, sf):
    """The utility row of each ablation and scale on raw vectors, with what its noise was."""
    queries, docs = _tables(spark, sf)
    calibrated, scales = _calibrated(spark, sf), (0.01, 0.1, 0.5)
    rows = E.utility_rows(queries, docs, *no_jl_variants(calibrated, scales)).join(noise_parameters(calibrated, scales), "variant")
    return _rounded(rows, ("variant", "utility_scale"))


_FOUR = (("eps", "epsilon"), ("sens", "sensitivity"), ("sigma", "sigma"), ("raw", "raw_score"))
_RAW = "cal0 AS (SELECT *, 0.1::DOUBLE + (vec_id % 100) * 0.1::DOUBLE AS raw FROM cal)"


@_R.add("met15_calibration_report", f"WITH RECURSIVE {S.VECTORS}, {S.CALIBRATION}, {_RAW} SELECT " + ", ".join(f"round({f}({c}), 6) AS {n}_{name}" for c, name in _FOUR for n, f in (("min", "min"), ("mean", "avg"), ("max", "max"))) + ", count(*) AS solved, count(*) AS pairs FROM cal0")
def calibration_report(spark, sf):
    rows = _calibrated(spark, sf)
    out = [f(c).alias(f"{n}_{name}") for c, name in (("epsilon", "epsilon"), ("local_sensitivity", "sensitivity"), ("sigma", "sigma"), ("raw", "raw_score")) for n, f in (("min", F.min), ("mean", F.avg), ("max", F.max))]
    return _rounded(rows.agg(*out, F.sum(F.col("solved").cast("long")).alias("solved"), F.count(F.lit(1)).alias("pairs")), ("solved", "pairs"))


@_R.add("met15_first_pairs", f"WITH RECURSIVE {S.VECTORS}, {S.CALIBRATION}, {_RAW} SELECT vec_id AS row_id, round(raw, 6) AS raw_score, round(eps, 6) AS epsilon, round(sigma, 6) AS sigma, round(sigma * 0.01::DOUBLE / 8, 8) AS sigma_per_dim FROM cal0 ORDER BY vec_id LIMIT 10")
def first_pairs(spark, sf):
    """What the first ten rows' scores became."""
    rows = _calibrated(spark, sf).orderBy("doc_id").limit(10)
    return rows.select(F.col("doc_id").alias("row_id"), F.round("raw", 6).alias("raw_score"), F.round("epsilon", 6).alias("epsilon"), F.round("sigma", 6).alias("sigma"), F.round(N.sigma_per_dim(F.col("sigma"), F.size("vec"), 0.01), 8).alias("sigma_per_dim"))


@_R.add("met15_dp11_summaries", f"""WITH RECURSIVE {S.VECTORS}, {S.CALIBRATION}, {_RAW}, g AS (SELECT c.*, label % 3 AS grp FROM cal0 c JOIN embeddings USING (vec_id))
SELECT grp::INTEGER AS grp, count(*) AS pairs, round(min(sigma), 6) AS min_sigma, round(avg(sigma), 6) AS mean_sigma, round(max(sigma), 6) AS max_sigma, true AS quantiles_within, true AS distinct_within FROM g GROUP BY grp
UNION ALL SELECT NULL, count(*), round(min(sigma), 6), round(avg(sigma), 6), round(max(sigma), 6), true, true FROM g""")
def summaries(spark, sf):
    """Sketches by label, merged to groups and to all rows (null), and whether their quantiles and counts are as near as they promise."""
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    rows = materialize(_calibrated(spark, sf).join(labels, "doc_id").withColumn("grp", (F.col("label") % 3).cast("int")), "labelled")
    fine = materialize(Y.summarize(rows, ["label", "grp"], ["sigma"], "doc_id"), "summaries")
    by_group = Y.merged(fine, ["grp"])
    both = by_group.unionByName(Y.merged(by_group.withColumn("all", F.lit(None).cast("int")), ["all"]).withColumnRenamed("all", "grp"))
    shares = (0.1, 0.5, 0.9)
    told = materialize(both.select("grp", F.col("rows").alias("pairs"), F.col("sigma_min").alias("min_sigma"), Y.mean("sigma").alias("mean_sigma"), F.col("sigma_max").alias("max_sigma"), *[Y.quantile("sigma", s).alias(f"q{i}") for i, s in enumerate(shares)], Y.distinct().alias("ids")), "told")
    # how many rows lie below each quantile, and how many not above it
    ranks = rows.select("sigma", F.explode(F.array(F.col("grp"), F.lit(None).cast("int"))).alias("in_grp")).join(F.broadcast(told), F.col("in_grp").eqNullSafe(F.col("grp")))  # one row a group
    off = lambda i, s: (F.avg((F.col("sigma") < F.col(f"q{i}")).cast("int")) <= s + Y.RANK_ERROR) & (F.avg((F.col("sigma") <= F.col(f"q{i}")).cast("int")) >= s - Y.RANK_ERROR)
    fits = off(0, shares[0]) & off(1, shares[1]) & off(2, shares[2])
    out = ranks.groupBy("grp", "pairs", "min_sigma", "mean_sigma", "max_sigma", "ids").agg(fits.alias("quantiles_within"))
    near = F.abs(F.col("ids") - F.col("pairs")) <= Y.DISTINCT_ERROR * F.col("pairs") + 1
    return out.select("grp", "pairs", *[F.round(c, 6).alias(c) for c in ("min_sigma", "mean_sigma", "max_sigma")], "quantiles_within", near.alias("distinct_within"))


# -- attacks

_PROTECTED = f"WITH {S.VECTORS}, {S.DRAWS}, sig AS (SELECT s AS variant, vec_id, CASE s WHEN 'raw' THEN 0 ELSE 0.1 / 8 END::DOUBLE AS sigma FROM n, (SELECT unnest(['raw', 'noised']) AS s)), {S.NOISED}"


def _protected(docs):
    return materialize(E.noised_all(docs, {"raw": F.lit(0.0), "noised": F.lit(0.1 / 8)}), "variants"), ["raw", "noised"]


@_R.add("sec3_sec4_ret17_linkage", f"""{_PROTECTED}, s AS (SELECT variant, m.vec_id AS query_id, d.vec_id AS doc_id, row_number() OVER (PARTITION BY variant, m.vec_id ORDER BY round({S.dot('m.w', 'd.v')} / (m.wn * d.n), 9) DESC, d.vec_id) AS k FROM m, n d),
h AS (SELECT variant, query_id, min(CASE WHEN query_id = doc_id AND k <= 5 THEN k END) AS k FROM s GROUP BY ALL)
SELECT variant, round(avg((coalesce(k, 99) = 1)::INT), 6) AS top1, round(avg((k IS NOT NULL)::INT), 6) AS recall_at_5, round(avg(coalesce(1.0::DOUBLE / k, 0)), 6) AS mrr_at_5, round(avg(CASE WHEN query_id % 3 = 0 THEN (coalesce(k, 99) = 1)::INT END), 6) AS sensitive_top1,
  round(avg(CASE WHEN query_id % 3 = 0 THEN (k IS NOT NULL)::INT END), 6) AS sensitive_recall_at_5, round(avg(CASE WHEN query_id % 3 = 0 THEN coalesce(1.0::DOUBLE / k, 0) END), 6) AS sensitive_mrr_at_5 FROM h GROUP BY variant""")
def linkage(spark, sf):
    """Protected vectors of every row against the public candidates that can be rebuilt without noise."""
    _, docs = _tables(spark, sf)
    public = docs.select("doc_id", V.normalize(F.col("vec")).alias("vec"))
    variants, names = _protected(docs)
    out = []
    for name in names:
        found = R.linkage(variants.where(F.col("variant") == name).select(F.col("doc_id").alias("query_id"), "vec"), public, 5)
        out.append(X.linkage_metrics(found, docs.where("doc_id % 3 = 0")).select(F.lit(name).alias("variant"), "*"))
    return _rounded(E.union(out), ("variant",))


@_R.add("sec2_exposure_experiment", f"""{_PROTECTED}, s AS (SELECT variant, q.vec_id AS query_id, m.vec_id AS doc_id, row_number() OVER (PARTITION BY variant, q.vec_id ORDER BY round({S.dot('q.v', 'm.w')} / (q.n * m.wn), 9) DESC, m.vec_id) AS k FROM n q, m WHERE q.vec_id % 20 = 0),
f AS (SELECT * FROM s WHERE k <= 5), k AS (SELECT variant, query_id, CASE WHEN query_id % 3 = 0 THEN 'attack' ELSE 'normal' END AS kind, max(CASE WHEN doc_id = query_id THEN k END) AS k, sum((doc_id % 3 = 0)::INT) AS n FROM f GROUP BY ALL)
SELECT variant, kind, round(avg((coalesce(k, 99) = 1)::INT), 6) AS recall_at_1, round(avg((k IS NOT NULL)::INT), 6) AS recall_at_5, round(avg(k), 6) AS mean_rank, count(DISTINCT CASE WHEN k IS NOT NULL THEN query_id END) AS distinct_targets, round(avg(n), 6) AS mean_sensitive FROM k GROUP BY ALL""")
def exposure(spark, sf):
    """What queries for sensitive rows (attack) and for others (normal) find in raw and in noised vectors."""
    queries, docs = _tables(spark, sf)
    variants, names = _protected(docs)
    found = materialize(R.top_k(queries, variants, 5, by="variant", variants=names), "found")
    out = []
    for name in names:
        for kind, rows in (("attack", queries.where("query_id % 3 = 0")), ("normal", queries.where("query_id % 3 <> 0"))):
            mine = found.where(F.col("variant") == name).join(rows.select("query_id"), "query_id", "left_semi")
            row = X.exposure(mine, rows.select("query_id", F.col("query_id").alias("doc_id")), docs.where("doc_id % 3 = 0"))
            out.append(row.select(F.lit(name).alias("variant"), F.lit(kind).alias("kind"), "*"))
    return _rounded(E.union(out), ("variant", "kind", "distinct_targets"))


def _terms_sql(text):
    return f"list_distinct(list_filter(list_transform(regexp_extract_all({text}, '[A-Za-z][A-Za-z0-9_''-]{{2,}}|[一-鿿]{{2,}}'), lambda x: lower(x)), lambda x: length(x) >= 3))"


def _drawn_sql(seed):
    return f"list_transform(list_sort(list_transform(l, lambda x: {{'h': md5('{seed}|' || doc_id || '|' || x), 'x': x}}))[1:8], lambda s: s.x)"


_TEXT_ATTACKS = f"""WITH d AS (SELECT doc_id, doc_id AS row_id, text, {_terms_sql('text')} AS terms, regexp_matches(text, '{T._ASCII_EMAIL}') OR regexp_matches(text, '{T._URL}') AS hot FROM documents), tt AS (SELECT row_id, terms FROM d), {embedding.sql('tt')},
a AS (SELECT doc_id, {_terms_sql(f"regexp_replace(regexp_replace(text, '{T._ASCII_EMAIL}', ' ', 'g'), '{T._URL}', ' ', 'g')")} AS l FROM d WHERE hot),
asked AS (SELECT 'attack' AS kind, doc_id, doc_id * 2 AS row_id, {_drawn_sql(2027)} AS terms FROM a WHERE len(l) >= 4 UNION ALL SELECT 'normal', doc_id, doc_id * 2 + 1, {_drawn_sql(2026)} FROM (SELECT doc_id, terms AS l FROM d WHERE doc_id % 20 = 0 AND NOT hot AND len(terms) >= 4)),
qt AS (SELECT row_id, terms FROM asked), {embedding.sql('qt', 'q', 'tt')},
n AS (SELECT row_id AS vec_id, list_transform(v, lambda x: x / greatest(n, 1e-12)) AS v, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0 END AS n FROM tvec), {S.DRAWS}, sig AS (SELECT s AS variant, vec_id, CASE s WHEN 'raw' THEN 0 ELSE 0.1 / 8 END::DOUBLE AS sigma FROM n, (SELECT unnest(['raw', 'noised']) AS s)), {S.NOISED},
s AS (SELECT variant, q.row_id AS query_id, m.vec_id AS doc_id, row_number() OVER (PARTITION BY variant, q.row_id ORDER BY round({S.dot('q.v', 'm.w')} / (greatest(q.n, 1e-12) * greatest(m.wn, 1e-12)), 9) DESC, m.vec_id) AS k FROM qvec q, m),
f AS (SELECT * FROM s WHERE k <= 5), k AS (SELECT f.variant, kind, f.query_id, max(CASE WHEN f.doc_id = asked.doc_id THEN k END) AS k, max(CASE WHEN f.doc_id = asked.doc_id THEN f.doc_id END) AS hit, sum(hot::INT) AS n FROM f JOIN asked ON asked.row_id = f.query_id JOIN d ON d.doc_id = f.doc_id GROUP BY ALL)
SELECT variant, kind, round(avg((coalesce(k, 99) = 1)::INT), 6) AS recall_at_1, round(avg((k IS NOT NULL)::INT), 6) AS recall_at_5, round(avg(k), 6) AS mean_rank, count(DISTINCT hit) AS distinct_targets, round(avg(n), 6) AS mean_sensitive FROM k GROUP BY ALL"""


def _asked(docs, kinds):
    """(doc_id, hot, buckets, asked): the buckets of a text's terms and of its query, in one pass over the texts; asked is null where there is none."""
    def query(text, seed):
        terms = lambda l: C.drawn_terms(l, F.lit(str(seed)), F.col("doc_id").cast("string"))  # noqa: E731, E741
        return F.get(F.transform(F.array(C.distinct_terms(text)), lambda l: F.when(F.size(l) >= 4, embedding.buckets_of(terms(l)))), F.lit(0))  # noqa: E741

    text = F.col("text")
    asked = F.when(F.col("hot"), query(sensitivity.redact(text, kinds), 2027)).when(F.col("doc_id") % 20 == 0, query(text, 2026))
    return docs.select("doc_id", "hot", embedding.buckets_of(C.distinct_terms(text)).alias("buckets"), asked.alias("asked"))


@_R.add("sec2_text_attacks", _TEXT_ATTACKS)
def text_attacks(spark, sf):
    """Queries made from the texts of documents that hold addresses, without these (attack), and from others (normal): what they find in raw and in noised embeddings."""
    ship(spark)
    kinds = ("email", "url")
    docs = table(spark, sf, "documents").select("doc_id", "text", (F.size(sensitivity.entity_types(F.col("text"), kinds)) > 0).alias("hot"))
    rows = materialize(_asked(docs, kinds), "texts")
    model = embedding.TermEmbedding.fit(rows, F.col("buckets"))
    vectors = materialize(rows.select("doc_id", model.column(rows, F.col("buckets")).alias("vec")), "embedded")
    attacked = X.targets(rows.where("hot"), ["doc_id"])
    parts = []
    for i, (kind, texts) in enumerate((("attack", attacked), ("normal", rows.where("NOT hot")))):
        parts.append(texts.where("asked IS NOT NULL").select(F.lit(kind).alias("kind"), "doc_id", (F.col("doc_id") * 2 + i).alias("query_id"), F.col("asked").alias("buckets")))
    asked = E.union(parts)
    asked = materialize(asked.select("kind", "doc_id", "query_id", model.column(asked, F.col("buckets")).alias("vec")), "asked")
    variants, names = _protected(vectors)
    found = materialize(R.top_k(asked.select("query_id", "vec"), variants, 5, by="variant", variants=names), "found")
    out = []
    for name in names:
        for kind in ("attack", "normal"):
            own = asked.where(F.col("kind") == kind)
            mine = found.where(F.col("variant") == name).join(own.select("query_id"), "query_id", "left_semi")
            out.append(X.exposure(mine, own.select("query_id", "doc_id"), rows.where("hot").select("doc_id")).select(F.lit(name).alias("variant"), F.lit(kind).alias("kind"), "*"))
    return _rounded(E.union(out), ("variant", "kind", "distinct_targets"))


@_R.add("sec10_fold_summary", f"""{_ROWS}, f AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY md5('2028|' || doc_id), doc_id) - 1) % 5 AS fold FROM r),
c AS (SELECT fold, sum((label = 1 AND prediction = 1)::INT)::DOUBLE AS tp, sum((label = 0 AND prediction = 1)::INT)::DOUBLE AS fp, sum((label = 1 AND prediction = 0)::INT)::DOUBLE AS fn, sum((label = 0 AND prediction = 0)::INT)::DOUBLE AS tn FROM f GROUP BY fold),
s AS (SELECT (tp / (tp + fn) + tn / (tn + fp)) / 2 AS b, 2 * tp / (2 * tp + fp + fn) AS f1 FROM c)
SELECT round(avg(b), 6) AS balanced_accuracy_mean, round(stddev_pop(b), 6) AS balanced_accuracy_std, round(avg(f1), 6) AS f1_mean, round(stddev_pop(f1), 6) AS f1_std FROM s""")
def fold_summary(spark, sf):
    rows = X.stratified_folds(_scored(spark, sf), "doc_id", "label", 5, 2028)
    return _rounded(X.fold_summary(X.classification(rows, "fold"), ["balanced_accuracy", "f1"]), ())


_CHUNKED = "SELECT doc_id, greatest(1, ceil((n_chars - 200) / 800.0))::INTEGER AS chunks FROM documents"


@_R.add("sec14_sec15_cyclic_split", f"""WITH d AS ({_CHUNKED}), a AS (SELECT *, row_number() OVER (ORDER BY md5('2030|' || doc_id), doc_id) AS k FROM d), c AS (SELECT *, (k - 1) // 4 AS cycle FROM a),
g AS (SELECT *, row_number() OVER (PARTITION BY cycle ORDER BY md5('2030c|' || doc_id), doc_id) AS grp FROM c), s AS (SELECT *, sum(chunks) OVER (PARTITION BY grp ORDER BY k) AS upto FROM g)
SELECT doc_id, grp::INTEGER AS grp, least(chunks, greatest(0, 100 - (upto - chunks)))::BIGINT AS taken FROM s WHERE upto - chunks < 100""")
def cyclic_split(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.greatest(F.lit(1), F.ceil((F.col("n_chars") - 200) / 800.0)).cast("int").alias("chunks"))
    out = X.cyclic_split(docs, "doc_id", "chunks", 2030, 100)
    if not X.overlapping(out, "doc_id").isEmpty():
        raise ValueError("the groups of a split share documents")
    return out.select("doc_id", "grp", "taken")


_NEAREST_MEMBERS = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS w FROM embeddings), n AS (SELECT vec_id, list_transform(w, lambda x: x / greatest(sqrt(list_sum(list_transform(w, lambda y: y * y))), 1e-12)) AS v, ntile(4) OVER (ORDER BY md5('2030|' || vec_id), vec_id) AS grp FROM e),
p AS (SELECT q.vec_id, q.grp, d.vec_id AS other, greatest(round(list_sum(list_transform(list_zip(q.v, d.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 9), 0) AS d FROM n q JOIN n d ON d.grp = 3 AND d.vec_id <> q.vec_id WHERE q.vec_id % 5 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, other) AS k FROM p), z AS (SELECT vec_id, grp, round(-avg(sqrt(d)), 5) AS score FROM k WHERE k <= 5 GROUP BY ALL)"""


@_R.add("sec20_sec21_membership_row", f"""{_NEAREST_MEMBERS}, t AS (SELECT score, (grp = 1)::INT AS label FROM z WHERE grp <= 2), c AS (SELECT score, sum(label)::DOUBLE AS p, sum(1 - label)::DOUBLE AS n FROM t GROUP BY score),
o AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp, sum(p) OVER () AS pos, sum(n) OVER () AS neg FROM c)
SELECT round(sum(n * (tp - p / 2)) / any_value(pos * neg), 6) AS auc, round(max(CASE WHEN fp <= 0.01 * neg THEN tp / pos ELSE 0 END), 6) AS tpr, round(greatest(max(tp / pos - fp / neg), 0), 6) AS advantage, any_value(neg) < 100 AS low_resolution FROM o""")
def membership_row(spark, sf):
    """The density attack on target members and non-members together, told apart by their label."""
    ship(spark)
    docs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), V.normalize(F.col("embedding").cast("array<double>")).alias("vec"))
    docs = materialize(X.disjoint_split(docs, "doc_id", 2030), "groups")
    asked = docs.where("doc_id % 5 = 0")
    found = R.top_k(asked.select(F.col("doc_id").alias("query_id"), "vec"), docs.where("grp = 3"), 6, "l2").where("doc_id <> query_id")
    scored = X.knn_density(R.ranked(found.drop("rank"), 5, False), 5).join(asked.select(F.col("doc_id").alias("row_id"), "grp"), "row_id")
    rows = materialize(scored.where("grp <= 2").select(F.round("score", 5).alias("score"), (F.col("grp") == 1).cast("int").alias("label")), "scored")
    return _rounded(X.rates(rows, 0.01).select("auc", "tpr", "advantage", (F.col("negatives") < 100).alias("low_resolution")), ("low_resolution",))


@_R.add("sec16_shadow_attack")
def shadow_attack(spark, sf):
    """A logistic fit on the shadow groups scores the target groups."""
    _, docs = _tables(spark, sf)
    docs = materialize(X.disjoint_split(docs, "doc_id", 2030), "groups").withColumn("label", F.col("grp").isin(1, 3).cast("int"))
    out = X.shadow_attack(docs.where("grp >= 3"), docs.where("grp <= 2").select("doc_id", "label", "vec"))
    return out.select("doc_id", "label", F.round("score", 6).alias("score"), "prediction")


# -- grids

_RP = f"""WITH {S.VECTORS}, w AS (SELECT i, j, 0.1::DOUBLE * {randomness.gaussian_sql(7, 'jl', 'i', 'j')} AS w FROM range(64) a(i), range(48) b(j)), u AS (SELECT vec_id, n, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM n),
y AS (SELECT vec_id, j, sum(x / greatest(n, 1e-12) * w) AS y FROM u JOIN w USING (i) GROUP BY ALL), z AS (SELECT dim, vec_id, list(y ORDER BY j) AS z FROM y JOIN (SELECT unnest([8, 16, 32, 48]) AS dim) ON j < dim GROUP BY ALL),
p AS (SELECT a.dim, a.vec_id AS query_id, b.vec_id AS doc_id, round({S.dot('q.v', 'd.v')} / (q.n * d.n), 9) AS a, greatest(round(list_sum(list_transform(list_zip(a.z, b.z), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 9), 0) AS b
  FROM z a JOIN z b ON a.dim = b.dim AND a.vec_id % 20 = 0 JOIN n q ON q.vec_id = a.vec_id JOIN n d ON d.vec_id = b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY dim, query_id ORDER BY a DESC, doc_id) AS ra, row_number() OVER (PARTITION BY dim, query_id ORDER BY b, doc_id) AS rb FROM p),
per AS (SELECT dim, query_id, sum((ra <= 5 AND rb <= 5)::INT) / 5.0::DOUBLE AS r5, max(CASE WHEN ra = 1 AND rb <= 5 THEN 1.0::DOUBLE / rb ELSE 0 END) AS rr FROM r GROUP BY ALL)
SELECT dim::INTEGER AS dim, round(avg(r5), 6) AS recall_at_5, round(avg(rr), 6) AS mrr_at_5, round(500 * dim * 4 / 1048576.0, 6)::DOUBLE AS storage_mb FROM per GROUP BY dim""".replace("500 * dim", "(SELECT count(*) FROM n) * dim")


@_R.add("grd5_projection_dimensions", _RP)
def projection_dimensions(spark, sf):
    """Agreement of distance search on random projections of several widths with raw search."""
    queries, docs = _tables(spark, sf)
    raw, n, parts = R.top_k(queries, docs, 5), docs.count(), []
    for dim in (8, 16, 32, 48):
        moved = P.project(docs, P.Projector(64, dim, seed=7, deviation=0.1), "vec", after=False)
        parts.append(moved.select(F.lit(str(dim)).alias("variant"), "doc_id", F.col("projected").alias("vec")))
    moved = materialize(E.union(parts), "projected")
    asked = moved.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    found = R.top_k(asked, moved, 5, "l2", by="variant")
    dim = F.col("variant").cast("int")
    return E.agreement(raw, found, (5,)).select(dim.alias("dim"), F.round("recall_at_5", 6).alias("recall_at_5"), F.round("mrr_at_5", 6).alias("mrr_at_5"), F.round(dim * n * 4 / F.lit(1048576.0), 6).alias("storage_mb"))


_JOINT = f"""WITH {S.VECTORS}, w AS (SELECT i, j, {randomness.gaussian_sql(42, 'jl', 'i', 'j')} AS w FROM range(64) a(i), range(32) b(j)), u AS (SELECT vec_id, n, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM n),
y AS (SELECT vec_id, j, sum(x / greatest(n, 1e-12) * w) AS y FROM u JOIN w USING (i) GROUP BY ALL), zz AS (SELECT dim, vec_id, list(y ORDER BY j) AS z FROM y JOIN (SELECT unnest([16, 32]) AS dim) ON j < dim GROUP BY ALL UNION ALL SELECT 64, vec_id, v FROM n),
z AS (SELECT dim, vec_id, list_transform(z, lambda x: x / sqrt(list_sum(list_transform(z, lambda t: t * t)))) AS z FROM zz), q AS (SELECT dim, vec_id, unnest(z) AS x, unnest(range(dim)) AS i FROM z), h AS (SELECT *, {randomness.gaussian_sql(42, 'dp', 'vec_id', 'i')} AS g FROM q),
m AS (SELECT dim, s AS scale, vec_id, list(x + s / sqrt(dim) * g ORDER BY i) AS m, sqrt(sum(s / sqrt(dim) * g * s / sqrt(dim) * g)) / greatest(sqrt(sum(x * x)), 1e-12) AS nsr FROM h, (SELECT unnest([0.01::DOUBLE, 0.1, 0.5]) AS s) GROUP BY ALL),
p AS (SELECT a.dim, scale, a.vec_id AS query_id, b.vec_id AS doc_id, round({S.dot('q.v', 'd.v')} / (q.n * d.n), 9) AS a, round({S.dot('a.z', 'c.z')}, 9) AS c, round({S.dot('a.z', 'b.m')} / sqrt(list_sum(list_transform(b.m, lambda x: x * x))), 9) AS b
  FROM z a JOIN m b ON a.dim = b.dim AND a.vec_id % 20 = 0 JOIN z c ON c.dim = b.dim AND c.vec_id = b.vec_id JOIN n q ON q.vec_id = a.vec_id JOIN n d ON d.vec_id = b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY dim, scale, query_id ORDER BY a DESC, doc_id) AS ra, row_number() OVER (PARTITION BY dim, scale, query_id ORDER BY b DESC, doc_id) AS rb, row_number() OVER (PARTITION BY dim, scale, query_id ORDER BY c DESC, doc_id) AS rc FROM p),
per AS (SELECT dim, scale, query_id, sum((ra <= 5 AND rb <= 5)::INT) / 5.0::DOUBLE AS ab, sum((ra <= 5 AND rc <= 5)::INT) / 5.0::DOUBLE AS ac, sum((rc <= 5 AND rb <= 5)::INT) / 5.0::DOUBLE AS cb, max(CASE WHEN ra = 1 AND rb <= 5 THEN 1.0::DOUBLE / rb ELSE 0 END) AS mab,
  max(CASE WHEN ra = 1 AND rc <= 5 THEN 1.0::DOUBLE / rc ELSE 0 END) AS mac, max(CASE WHEN rc = 1 AND rb <= 5 THEN 1.0::DOUBLE / rb ELSE 0 END) AS mcb FROM r GROUP BY ALL),
g AS (SELECT m.dim, scale, round(avg(nsr), 6) AS nsr, round(avg({S.dot('z', 'm')} / sqrt(list_sum(list_transform(m, lambda x: x * x)))), 6) AS dc FROM m JOIN z ON z.dim = m.dim AND z.vec_id = m.vec_id GROUP BY ALL)
SELECT per.dim::INTEGER AS vector_dim, CASE per.dim WHEN 64 THEN 'No-JL' ELSE 'JL' END AS representation_type, CASE per.dim WHEN 64 THEN 'No-JL 64d' ELSE per.dim || 'd JL' END AS representation_label, per.dim = 64 AS is_no_jl, per.scale AS utility_scale, (SELECT count(*) FROM n) AS sampled_rows, count(*) AS num_queries,
  round(avg(ac), 6) AS jl_recall_at_5, round(avg(mac), 6) AS jl_mrr_at_5, round(avg(ab), 6) AS final_exact_recall_at_5, round(avg(mab), 6) AS final_exact_mrr_at_5, round(avg(cb), 6) AS dp_recall_at_5, round(avg(mcb), 6) AS dp_mrr_at_5, round(1 - avg(cb), 6) AS dp_loss_at_5,
  any_value(nsr) AS mean_noise_signal_ratio, any_value(dc) AS mean_direction_cosine, round((SELECT count(*) FROM n) * per.dim * 4 / 1048576.0, 6)::DOUBLE AS estimated_storage_mb FROM per JOIN g ON g.dim = per.dim AND g.scale = per.scale GROUP BY per.dim, per.scale"""


@_R.add("grd6_joint_grid", _JOINT)
def joint_grid(spark, sf):
    """Projection width (64: none) by noise scale: what projection, noise and both lose against search before them."""
    queries, docs = _tables(spark, sf)
    raw, lows, parts, asked, plain, scales = materialize(R.top_k(queries, docs, 5), "raw"), {}, [], [], [], (0.01, 0.1, 0.5)
    for dim in (16, 32, 64):
        low = docs.select("doc_id", V.normalize(F.col("vec")).alias("vec")) if dim == 64 else P.project(docs, P.Projector(64, dim), "vec").select("doc_id", F.col("projected").alias("vec"))
        lows[dim] = low = materialize(low, "projected")
        plain.append(low.select(F.lit(str(dim)).alias("variant"), "doc_id", "vec"))
        for s in scales:
            parts.append(E.noised(low, f"{dim}|{s:g}", F.lit(s) / F.sqrt(F.lit(float(dim))), clip=1e9))
            asked.append(low.where("doc_id % 20 = 0").select(F.lit(f"{dim}|{s:g}").alias("variant"), F.col("doc_id").alias("query_id"), "vec"))
    noised = materialize(E.union(parts), "variants")
    by_dim = lambda t: t.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    jl = materialize(R.top_k(by_dim(E.union(plain)), E.union(plain), 5, by="variant"), "jl")
    found = materialize(R.top_k(E.union(asked), noised, 5, by="variant"), "found")
    dim_of = F.split("variant", r"\|")[0]
    ends = E.agreement(raw, found, (5,)).select("variant", F.col("recall_at_5").alias("final_exact_recall_at_5"), F.col("mrr_at_5").alias("final_exact_mrr_at_5"))
    first = E.agreement(raw, jl, (5,)).select(F.col("variant").alias("dim"), F.col("recall_at_5").alias("jl_recall_at_5"), F.col("mrr_at_5").alias("jl_mrr_at_5"))
    own = E.agreement(jl.withColumnRenamed("variant", "scheme"), found.withColumn("scheme", dim_of), (5,)).select("variant", F.col("recall_at_5").alias("dp_recall_at_5"), F.col("mrr_at_5").alias("dp_mrr_at_5"), (1 - F.col("recall_at_5")).alias("dp_loss_at_5"))
    shape = noised.groupBy("variant").agg(F.avg("nsr").alias("mean_noise_signal_ratio"), F.avg(V.cosine(F.col("ref"), F.col("vec"))).alias("mean_direction_cosine"), F.count(F.lit(1)).alias("sampled_rows"))
    rows = ends.join(own, "variant").join(shape, "variant").withColumn("dim", dim_of).join(first, "dim")
    dim, whole = F.col("dim").cast("int"), F.col("dim") == "64"
    out = rows.select(
        dim.alias("vector_dim"), F.when(whole, "No-JL").otherwise("JL").alias("representation_type"), F.when(whole, "No-JL 64d").otherwise(F.concat("dim", F.lit("d JL"))).alias("representation_label"), whole.alias("is_no_jl"),
        F.split("variant", r"\|")[1].cast("double").alias("utility_scale"), "sampled_rows", F.lit(queries.count()).cast("long").alias("num_queries"),
        *[c for c in rows.columns if c.endswith("_at_5")], "mean_noise_signal_ratio", "mean_direction_cosine", (F.col("sampled_rows") * dim * 4 / F.lit(1048576.0)).alias("estimated_storage_mb"),
    )
    return out.select(*[F.round(c, 6).alias(c) if t == "double" and c != "utility_scale" else F.col(c) for c, t in out.dtypes])


@_R.add("grd8_recommendation", f"""{_GRID}, r AS (SELECT *, CASE scheme WHEN 'en' THEN 0.45 ELSE 0.9 END::DOUBLE AS threshold FROM g WHERE scheme IN ('en', 'de')),
k AS (SELECT *, row_number() OVER (PARTITION BY scheme ORDER BY nsr >= threshold DESC, CASE WHEN nsr >= threshold THEN recall ELSE nsr END DESC, CASE WHEN nsr >= threshold THEN mrr ELSE recall END DESC, mrr, nsr, recall, scheme, variant) AS n FROM r)
SELECT scheme, variant, recall, mrr, nsr, threshold, CASE WHEN nsr >= threshold THEN NULL ELSE 'no candidate satisfied nsr threshold' END AS fallback_reason FROM k WHERE n = 1""")
def recommendation(spark, sf):
    out = G.recommendation(_grid(spark, sf), {"en": ("nsr", 0.45), "de": ("nsr", 0.9)})
    return out.select("scheme", "variant", "recall", "mrr", "nsr", "threshold", "fallback_reason")


@_R.add("grd9_scale_resolution", f"{_GRID}, b AS (SELECT variant, max(nsr) AS base FROM g WHERE scheme = 'en' GROUP BY variant) SELECT g.scheme, g.variant, coalesce(CASE WHEN g.recall > 0.5 THEN g.recall END, CASE WHEN base > 0.45 THEN base END, 0.01)::DOUBLE AS utility_scale FROM g LEFT JOIN b ON g.variant = b.variant")
def scale_resolution(spark, sf):
    g = _grid(spark, sf)
    base = g.where("scheme = 'en'").groupBy("variant").agg(F.max("nsr").alias("base"))
    own, shared = F.when(F.col("recall") > 0.5, F.col("recall")), F.when(F.col("base") > 0.45, F.col("base"))
    return g.join(base, "variant", "left").select("scheme", "variant", G.resolved(own, shared, 0.01).alias("utility_scale"))


@_R.add("grd11_best_by_loss", f"{_GRID}, l AS (SELECT scheme, variant, recall, round(1 - recall, 6) AS dp_loss FROM g), k AS (SELECT *, row_number() OVER (PARTITION BY scheme ORDER BY dp_loss <= 0.5 DESC, CASE WHEN dp_loss <= 0.5 THEN -recall ELSE dp_loss END, dp_loss, recall, variant) AS n FROM l) SELECT scheme, variant, recall, dp_loss FROM k WHERE n = 1")
def best_by_loss(spark, sf):
    rows = _grid(spark, sf).select("scheme", "variant", "recall", F.round(1 - F.col("recall"), 6).alias("dp_loss"))
    return G.best_by_loss(rows, "scheme", "dp_loss", 0.5)


@_R.add("grd13_losses", f"{_GRID} SELECT variant, round(1 - max(CASE WHEN scheme = 'en' THEN recall END), 6) AS en, round(1 - max(CASE WHEN scheme = 'de' THEN recall END), 6) AS de FROM g GROUP BY variant")
def losses(spark, sf):
    wide = G.heat_map(_grid(spark, sf), "variant", "scheme", "recall", ["en", "de"])
    return wide.select("variant", *[F.round(1 - F.col(c), 6).alias(c) for c in ("en", "de")])


@_R.add("grd14_grd15_chart_rows", f"{_GRID}, s AS (SELECT *, length(variant) AS size, coalesce(CASE WHEN NOT isnan(CASE WHEN recall > 0.5 THEN 'nan'::DOUBLE ELSE recall END) AND recall > 0 THEN recall END, CASE WHEN mrr > 0 THEN mrr END) AS shown FROM g WHERE contains(scheme, 'e')) SELECT scheme, variant, shown FROM s WHERE size = (SELECT max(size) FROM s)")
def chart_rows(spark, sf):
    """Rows whose scheme contains a text, at the largest size, with the first valid of two values."""
    g = _grid(spark, sf).where(F.contains("scheme", F.lit("e"))).withColumn("size", F.length("variant"))
    recall = F.when(F.col("recall") > 0.5, F.lit(float("nan"))).otherwise(F.col("recall"))
    return G.largest_slice(g.withColumn("shown", G.first_valid(recall, F.col("mrr"))), "size").select("scheme", "variant", "shown")


# -- encrypted distances as plain numbers, weights


_PAIRED = f"WITH {S.VECTORS}, p AS (SELECT a.vec_id AS row_id, a.v AS a, b.v AS b FROM n a JOIN n b ON b.vec_id = a.vec_id + 1), d AS (SELECT row_id, list_transform(list_zip(a, b), lambda x: (x[1] - x[2]) * (x[1] - x[2])) AS s FROM p), x AS (SELECT row_id, list_sum(s) AS plain, round(list_sum(s[1:24]), 4) + round(list_sum(s[25:48]), 4) + round(list_sum(s[49:64]), 4) AS measured FROM d)"


def _paired(spark, sf):
    """Squared distances of neighbours by parts of 24 numbers, each part rounded as a stand-in for an inexact measurement."""
    _, rows = _tables(spark, sf)
    after = rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("vec").alias("b"))
    parts = rows.join(after, "doc_id").select(F.col("doc_id").alias("row_id"), V.squared_l2(F.col("vec"), F.col("b")).alias("plain"), V.chunked_l2(F.col("vec"), F.col("b"), 24).alias("parts"))
    parts = parts.withColumn("measured", F.aggregate("parts", F.lit(0.0), lambda s, x: s + F.round(x, 4)))
    gap, relative = V.errors(F.col("measured"), F.col("plain"))
    return parts.select("row_id", "plain", "measured", gap.alias("absolute"), relative.alias("relative"))


@_R.add("ret11_chunked_distance", f"{_PAIRED} SELECT row_id, round(plain, 6) AS plain, round(measured, 6) AS measured, round(abs(measured - plain), 6) AS absolute, round(CASE WHEN abs(plain) < 1e-12 THEN abs(measured - plain) ELSE abs(measured - plain) / abs(plain) END, 6) AS relative FROM x")
def chunked_distance(spark, sf):
    return _rounded(_paired(spark, sf), ("row_id",))


@_R.add("ret13_error_summary", f"{_PAIRED} SELECT round(avg(abs(measured - plain)), 7) AS mean_absolute, round(avg(abs(measured - plain) / abs(plain)), 7) AS mean_relative, round(count(*) * 64 * 8 / 1024.0, 6)::DOUBLE AS plain_kb FROM x")
def error_summary(spark, sf):
    return _paired(spark, sf).agg(F.round(F.avg("absolute"), 7).alias("mean_absolute"), F.round(F.avg("relative"), 7).alias("mean_relative"), F.round(F.count(F.lit(1)) * 64 * 8 / F.lit(1024.0), 6).alias("plain_kb"))


@_R.add("rwd6_weight_prefix", "WITH e AS (SELECT vec_id, embedding::DOUBLE[][1:32] AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM e), r AS (SELECT v, n FROM n ORDER BY vec_id LIMIT 1) SELECT vec_id AS row_id, round(list_sum(list_transform(list_zip(n.v, r.v), lambda x: x[1] * x[2])) / (n.n * r.n), 6) AS cosine FROM n, r".replace("::DOUBLE[][1:32]", "[1:32]::DOUBLE[]"))
def weight_prefix(spark, sf):
    """Cosine of the first weights of each model with those of the first model."""
    _, rows = _tables(spark, sf)
    first = rows.select("doc_id", V.normalize(F.slice("vec", 1, 32)).alias("v"))
    return first.join(F.broadcast(first.orderBy("doc_id").limit(1).select(F.col("v").alias("r")))).select(F.col("doc_id").alias("row_id"), F.round(V.dot(F.col("v"), F.col("r")), 6).alias("cosine"))  # one row


@_R.add("rwd7_timing_table", "SELECT (event_id % 4)::INTEGER AS degree, event_type AS dimension, count(*) AS iterations, round(avg(value), 6) AS mean_time, round(max(value), 6) AS max_time FROM events GROUP BY ALL")
def timing_table(spark, sf):
    """Means of measurements by two parameters, read from CSV with a header."""
    path = scratch_folder(spark, "timings")
    table(spark, sf, "events").select((F.col("event_id") % 4).cast("int").alias("degree"), F.col("event_type").alias("dimension"), F.col("value").alias("time")).write.option("header", True).csv(path)
    rows = spark.read.option("header", True).schema("degree int, dimension string, time double").csv(path)
    return rows.groupBy("degree", "dimension").agg(F.count(F.lit(1)).alias("iterations"), F.round(F.avg("time"), 6).alias("mean_time"), F.round(F.max("time"), 6).alias("max_time"))


@_R.add("rwd4_event_settlement", """WITH p AS (SELECT user_id, ts, event_id AS paid_by, value AS payout FROM events WHERE event_type = 'purchase'), e AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'purchase')
SELECT event_id, e.user_id, paid_by, payout FROM e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def event_settlement(spark, sf):
    """Each event with its user's last payout at or before it."""
    events = table(spark, sf, "events")
    paid = events.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("paid_by"), F.col("value").alias("payout"))
    found = as_of(events.where("event_type <> 'purchase'").select("event_id", "user_id", "ts"), paid, "ts", "user_id", ["paid_by", "payout"])
    return found.select("event_id", "user_id", "paid_by", "payout")


@_R.add("grd12_grd15_subtotals", f"""{_GRID}, s AS (SELECT scheme, substr(variant, 1, 4) AS variant, recall, mrr FROM g)
SELECT scheme, variant, (CASE WHEN scheme IS NULL THEN 2 ELSE 0 END + CASE WHEN variant IS NULL THEN 1 ELSE 0 END)::BIGINT AS level, count(*) AS rows, round(avg(recall), 9) AS mean_recall, round(max(mrr), 6) AS max_mrr FROM s GROUP BY GROUPING SETS ((scheme, variant), (scheme), (variant), ())""")
def subtotals(spark, sf):
    """Report rows by scheme and variant, by either, and over all; level says which of the two are summed up."""
    rows = _grid(spark, sf).select("scheme", F.substring("variant", 1, 4).alias("variant"), "recall", "mrr")
    return G.subtotals(rows, ["scheme", "variant"], F.count(F.lit(1)).alias("rows"), F.round(F.avg("recall"), 9).alias("mean_recall"), F.round(F.max("mrr"), 6).alias("max_mrr"))
