"""Vector algebra, projection and noise over the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmura.functions import randomness, vector as V
from murmura.operators import noise as N
from murmura.operators import projection as P
from murmura.plans import sql_parts as S
from murmura.plans.builder import Registry
from murmura.session import ship, table

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles

_N = "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM e)"


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


@_R.add("vec1_vec3_norms", f"""{_N}
SELECT vec_id AS row_id, round(n, 6) AS norm, round(v[1] / greatest(n, 1e-12), 6) AS unit_first, round(v[1] / greatest(1.0, n / 0.5), 6) AS clipped_first FROM n""")
def vec_norms(spark, sf):
    v = F.col("vec")
    return _vectors(spark, sf).select("row_id", F.round(V.norm(v), 6).alias("norm"), F.round(V.normalize(v)[0], 6).alias("unit_first"), F.round(V.clip_norm(v, 0.5)[0], 6).alias("clipped_first"))


@_R.add("vec5_vec7_pairs", f"""{_N}, p AS (
SELECT a.vec_id AS row_id, a.v AS a, b.v AS b, a.n AS an, b.n AS bn FROM n a JOIN n b ON b.vec_id = a.vec_id + 1), d AS (
SELECT *, list_sum(list_transform(list_zip(a, b), lambda x: x[1] * x[2])) AS dot, list_sum(list_transform(list_zip(a, b), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS l2 FROM p)
SELECT row_id, round(dot, 6) AS ip, round(l2, 6) AS l2, round(dot / (an * bn), 6) AS cosine, round(dot / (an * bn + 1e-9), 6) AS guarded FROM d""")
def vec_pairs(spark, sf):
    rows = _vectors(spark, sf).select("row_id", "vec")
    after = rows.select((F.col("row_id") - 1).alias("row_id"), F.col("vec").alias("b"))
    a, b = F.col("vec"), F.col("b")
    return rows.join(after, "row_id").select("row_id", F.round(V.dot(a, b), 6).alias("ip"), F.round(V.squared_l2(a, b), 6).alias("l2"), F.round(V.cosine(a, b), 6).alias("cosine"), F.round(V.guarded_cosine(a, b), 6).alias("guarded"))


@_R.add("vec8_jl_dimension", "SELECT source, n::INTEGER AS n, eps, CASE WHEN n <= 1 THEN 1 ELSE CAST(ceil(4 * ln(n) / (eps * eps / 2 - eps * eps * eps / 3)) AS INTEGER) END AS dim FROM (SELECT source, count(*) AS n FROM documents GROUP BY source UNION ALL SELECT 'all', count(*) FROM documents), (SELECT unnest([0.1::DOUBLE, 0.3]) AS eps)")
def vec_jl_dimension(spark, sf):
    """The least width for the documents of each source, and for all of them, at two tolerances."""
    docs = table(spark, sf, "documents")
    sizes = docs.groupBy("source").count().unionByName(docs.agg(F.lit("all").alias("source"), F.count(F.lit(1)).alias("count")))
    rows = sizes.select("source", F.col("count").cast("int").alias("n"), F.explode(F.array(F.lit(0.1), F.lit(0.3))).alias("eps"))
    return rows.select("source", "n", "eps", V.jl_min_dim_column(F.col("n"), F.col("eps")).alias("dim"))


_MATRIX = f"m AS (SELECT i, j, {randomness.gaussian_sql(42, 'jl', 'i', 'j')} / sqrt(16.0::DOUBLE) AS w FROM range(64) a(i), range(16) b(j))"


@_R.add("vec9_vec12_projection", f"""{_N}, {_MATRIX}, u AS (SELECT vec_id, n, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM n),
p AS (SELECT vec_id, j, sum(x / greatest(n, 1e-12) * w) AS y FROM u JOIN m USING (i) GROUP BY ALL), q AS (SELECT vec_id, sqrt(sum(y * y)) AS s FROM p GROUP BY ALL)
SELECT vec_id AS row_id, round(max(CASE WHEN j = 0 THEN y / s END), 6) AS first, round(max(CASE WHEN j = 15 THEN y / s END), 6) AS last FROM p JOIN q USING (vec_id) GROUP BY vec_id""")
def vec_projection(spark, sf):
    ship(spark)
    out = P.project(_vectors(spark, sf), P.Projector(64, 16), "vec")
    return out.select("row_id", F.round(F.col("projected")[0], 6).alias("first"), F.round(F.col("projected")[15], 6).alias("last"))


@_R.add("vec13_random_projection", f"""{_N}, m AS (SELECT i, j, 0.1::DOUBLE * {randomness.gaussian_sql(7, 'jl', 'i', 'j')} AS w FROM range(64) a(i), range(32) b(j)),
u AS (SELECT vec_id, n, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM n), p AS (SELECT vec_id, j, sum(x / greatest(n, 1e-12) * w) AS y FROM u JOIN m USING (i) GROUP BY ALL)
SELECT vec_id AS row_id, round(sqrt(sum(y * y)), 6) AS norm FROM p GROUP BY vec_id""")
def vec_random_projection(spark, sf):
    ship(spark)
    out = P.project(_vectors(spark, sf), P.Projector(64, 32, seed=7, deviation=0.1), "vec", after=False)
    return out.select("row_id", F.round(V.norm(F.col("projected")), 6).alias("norm"))


_BALL = f"""{_N}, u AS (SELECT vec_id, v, unnest(range(64)) AS i, unnest(v) AS x FROM n), g AS (SELECT vec_id, i, x, {randomness.gaussian_sql(11, 'sap', 'vec_id', 'i')} AS z FROM u),
s AS (SELECT vec_id, sqrt(sum(z * z)) AS zn, pow((('0x' || substr(md5('11|sapr|' || vec_id), 1, 13))::BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE, 1.0 / 64) AS r FROM g GROUP BY ALL)
SELECT vec_id AS row_id, round(sqrt(sum(pow(8.0 * x + z / zn * r * 8.0 * 0.1 / 4, 2))), 6) AS norm, round(sum((8.0 * x + z / zn * r * 8.0 * 0.1 / 4) * (i + 1)), 5) AS places FROM g JOIN s USING (vec_id) GROUP BY vec_id"""


def _places(v):
    """The sum of a vector's numbers times their places: differs where any number does."""
    return F.aggregate(F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)


@_R.add("vec14_vec15_scale_perturb", _BALL)
def vec_scale_perturb(spark, sf):
    rows = N.scale_and_perturb(_vectors(spark, sf), "row_id", "vec", 0.1, 11)
    return rows.select("row_id", F.round(V.norm(F.col("perturbed")), 6).alias("norm"), F.round(_places(F.col("perturbed")), 5).alias("places"))


@_R.add("vec12_representation", f"{_N} SELECT vec_id AS row_id, 'no_jl' AS mode, 64 AS width, round(v[1] / greatest(n, 1e-12), 6) AS first FROM n")
def vec_representation(spark, sf):
    rows = P.represent(_vectors(spark, sf), "No-JL", "vec")
    return rows.select("row_id", F.lit(P.mode_of("No-JL")).alias("mode"), F.size("represented").alias("width"), F.round(F.col("represented")[0], 6).alias("first"))


@_R.add("vec16_vec18_stats", f"""{_N}, x AS (SELECT unnest(v) AS x FROM n), a AS (SELECT round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, count(*) AS numbers FROM x)
SELECT round(min(n), 6) AS min_norm, round(avg(n), 6) AS mean_norm, round(max(n), 6) AS max_norm, bool_and(n <= 1.000001) AS in_ball, mean, std, round(numbers * 4 / 1048576.0, 6)::DOUBLE AS storage_mb FROM n, a GROUP BY ALL""")
def vec_stats(spark, sf):
    rows = _vectors(spark, sf)
    norms = rows.select(V.norm(F.col("vec")).alias("n")).agg(F.round(F.min("n"), 6).alias("min_norm"), F.round(F.avg("n"), 6).alias("mean_norm"), F.round(F.max("n"), 6).alias("max_norm"), F.bool_and(F.col("n") <= 1.000001).alias("in_ball"))
    values = rows.select(F.explode("vec").alias("x")).agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("std"), F.round(F.count("x") * 4 / F.lit(1048576.0), 6).alias("storage_mb"))
    return norms.join(values)  # single rows


@_R.add("vec19_mean_model", "WITH u AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) SELECT label, pos::INTEGER AS pos, round(avg(x), 6) AS mean FROM u GROUP BY ALL")
def vec_mean_model(spark, sf):
    return _vectors(spark, sf).select("label", F.posexplode("vec").alias("pos", "x")).groupBy("label", "pos").agg(F.round(F.avg("x"), 6).alias("mean"))


_RAW = "0.1 + (vec_id % 100) * 0.1"


@_R.add("dp2_dp4_calibration_inputs", f"""
WITH s AS (SELECT vec_id, (least(greatest({_RAW}, 0.1), 10)::DOUBLE - 0.1) / 9.9 AS s FROM embeddings)
SELECT vec_id AS row_id, round(s, 6) AS normalized_score, round(least(greatest(1.25 + 8.75 * pow(1 - s, 1.5), 0.5), 10), 6) AS epsilon, round(0.25 + 0.25 * s, 6) AS local_sensitivity FROM s""")
def dp_inputs(spark, sf):
    s = N.normalized_score(F.lit(0.1) + (F.col("row_id") % 100) * F.lit(0.1))
    return _vectors(spark, sf).select("row_id", F.round(s, 6).alias("normalized_score"), F.round(N.epsilon(s), 6).alias("epsilon"), F.round(N.sensitivity(s), 6).alias("local_sensitivity"))


def noised(spark, sf):
    ship(spark)
    rows = _vectors(spark, sf).withColumn("raw", F.lit(0.1) + (F.col("row_id") % 100) * F.lit(0.1))
    return N.apply_noise(N.calibrate(rows, "raw"), "row_id", "vec", "sigma")


@_R.add("dp5_dp6_calibrate", f"WITH RECURSIVE {S.CALIBRATION} SELECT vec_id AS row_id, round(eps, 9) AS epsilon, round(sens, 9) AS local_sensitivity, round(sigma, 9) AS sigma, true AS solved FROM cal")
def dp_calibrate(spark, sf):
    ship(spark)
    rows = _vectors(spark, sf).withColumn("raw", F.lit(0.1) + (F.col("row_id") % 100) * F.lit(0.1))
    return N.calibrate(rows, "raw").select("row_id", *[F.round(c, 9).alias(c) for c in ("epsilon", "local_sensitivity", "sigma")], "solved")


_NOISE = f"WITH RECURSIVE {S.VECTORS}, {S.CALIBRATION}, {S.DRAWS}, q AS (SELECT g.vec_id, i, cal.sigma, cal.sigma * 0.01::DOUBLE / 8 AS step, x, z FROM g JOIN cal ON cal.vec_id = g.vec_id)"


@_R.add("dp7_dp9_noise", f"{_NOISE} SELECT vec_id AS row_id, round(any_value(step), 9) AS sigma_per_dim, round(sqrt(sum(step * z * step * z)), 8) AS noise_norm, 1.0::DOUBLE AS final_norm, round(sum((x + step * z) * (i + 1)) / sqrt(sum((x + step * z) * (x + step * z))), 6) AS final_places FROM q GROUP BY vec_id")
def dp_noise(spark, sf):
    out = noised(spark, sf)
    final = V.normalize(F.col("noised"))
    return out.select("row_id", F.round("sigma_per_dim", 9).alias("sigma_per_dim"), F.round(V.norm(F.col("noise")), 8).alias("noise_norm"), F.round(V.norm(final), 8).alias("final_norm"), F.round(_places(final), 6).alias("final_places"))


@_R.add("dp8_fixed_noise", f"""{_N}, u AS (SELECT vec_id, n, unnest(v) AS x, unnest(range(len(v))) AS i FROM n),
g AS (SELECT vec_id, x / greatest(1.0, n) AS x, 0.05::DOUBLE * {randomness.gaussian_sql(42, 'dp', 'vec_id', 'i')} AS z FROM u)
SELECT vec_id AS row_id, round(sqrt(sum((x + z) * (x + z))), 6) AS noised_norm, round(sqrt(sum(z * z)) / greatest(sqrt(sum(x * x)), 1e-12), 6) AS noise_to_signal FROM g GROUP BY vec_id""")
def dp_fixed(spark, sf):
    rows = _vectors(spark, sf).withColumn("clipped", V.clip_norm(F.col("vec"), 1.0)).withColumn("z", N.noise_vector(F.col("row_id"), F.size("vec"), F.lit(0.05), 42))
    return rows.select("row_id", F.round(V.norm(V.added(F.col("clipped"), F.col("z"))), 6).alias("noised_norm"), F.round(N.noise_to_signal(F.col("z"), F.col("clipped")), 6).alias("noise_to_signal"))


@_R.add("dp11_noise_report", f"""{_NOISE}, r AS (SELECT vec_id, any_value(sigma) AS sigma, sqrt(sum(step * z * step * z)) / greatest(sqrt(sum(x * x)), 1e-12) AS nsr FROM q GROUP BY vec_id)
SELECT round(avg(nsr), 8) AS mean_nsr, round(min(sigma), 8) AS min_sigma, round(max(sigma), 8) AS max_sigma, count(*) AS solved FROM r""")
def dp_report(spark, sf):
    out = noised(spark, sf)
    return out.agg(F.round(F.avg(N.noise_to_signal(F.col("noise"), F.col("clipped"))), 8).alias("mean_nsr"), F.round(F.min("sigma"), 8).alias("min_sigma"), F.round(F.max("sigma"), 8).alias("max_sigma"), F.sum(F.col("solved").cast("long")).alias("solved"))


_JL = f"""w AS (SELECT i, j, {randomness.gaussian_sql(42, 'jl', 'i', 'j')} / sqrt(32.0::DOUBLE) AS w FROM range(64) a(i), range(32) b(j)), u0 AS (SELECT vec_id, n, unnest(v) AS x, unnest(range(64)) AS i FROM n),
y AS (SELECT vec_id, j, sum(x / greatest(n, 1e-12) * w) AS y FROM u0 JOIN w USING (i) GROUP BY ALL), jl AS (SELECT vec_id, j AS i, y / sqrt(sum(y * y) OVER (PARTITION BY vec_id)) AS x FROM y)"""
_ABLATIONS = f"""WITH RECURSIVE {S.VECTORS}, {S.CALIBRATION}, {_JL}, base AS (SELECT 'jl' AS kind, vec_id, i, x FROM jl UNION ALL SELECT 'raw', vec_id, i, x / greatest(1.0, n) FROM u0),
d AS (SELECT kind, vec_id, i, x, {randomness.gaussian_sql(42, 'dp', 'vec_id', 'i')} AS z FROM base),
k(variant, kind, form) AS (VALUES ('full', 'jl', 1), ('no_dp', 'jl', 2), ('no_dimension_scaling', 'jl', 3), ('fixed_calibration', 'jl', 4), ('dp_before_jl', 'raw', 5), ('no_jl', 'raw', 5)),
t AS (SELECT variant, d.vec_id, i, x, z * CASE form WHEN 1 THEN cal.sigma * 0.01 / sqrt(32.0) WHEN 2 THEN 0 WHEN 3 THEN cal.sigma * 0.01 WHEN 4 THEN f.u * 0.35 * 0.01 / sqrt(32.0) ELSE cal.sigma * 0.01 / 8 END AS e
  FROM d JOIN k ON k.kind = d.kind JOIN cal ON cal.vec_id = d.vec_id, (SELECT {N.multiplier(4.0, 1e-5)[0]!r}::DOUBLE AS u) f),
c AS (SELECT variant, vec_id, sqrt(sum(e * e)) / greatest(sqrt(sum(x * x)), 1e-12) AS nsr, sum(x * (x + e)) / (sqrt(sum(x * x)) * sqrt(sum((x + e) * (x + e)))) AS cosine FROM t GROUP BY ALL),
o AS (SELECT vec_id, j, sum((x + e) * w) AS y FROM t JOIN w USING (i) WHERE variant = 'dp_before_jl' GROUP BY ALL),
b AS (SELECT o.vec_id, sum(jl.x * o.y) / sqrt(sum(o.y * o.y)) AS cosine FROM o JOIN jl ON jl.vec_id = o.vec_id AND jl.i = o.j GROUP BY ALL)
SELECT variant, round(avg(nsr), 8) AS mean_nsr, round(CASE WHEN variant = 'dp_before_jl' THEN (SELECT avg(cosine) FROM b) ELSE avg(cosine) END, 8) AS mean_cosine FROM c GROUP BY variant"""


@_R.add("dp12_dp16_ablations", _ABLATIONS)
def dp_ablations(spark, sf):
    """Mean noise-to-signal and direction cosine of each variant, in one pass."""
    ship(spark)
    projector, config = P.Projector(64, 32), N.NoiseConfig()
    base = _vectors(spark, sf).withColumn("raw", F.lit(0.1) + (F.col("row_id") % 100) * F.lit(0.1))
    base = P.project(N.calibrate(base, "raw"), projector, "vec")
    fixed = N.multiplier(4.0, config.delta)[0] * 0.35
    variants = {
        "full": ("projected", F.col("sigma") * config.utility_scale / F.sqrt(F.lit(32.0))), "no_dp": ("projected", F.lit(0.0)),
        "no_dimension_scaling": ("projected", F.col("sigma") * config.utility_scale), "fixed_calibration": ("projected", F.lit(fixed * config.utility_scale) / F.sqrt(F.lit(32.0))),
        "dp_before_jl": ("vec", F.col("sigma") * config.utility_scale / 8.0), "no_jl": ("vec", F.col("sigma") * config.utility_scale / 8.0),
    }
    out = None
    for name, (column, sigma) in variants.items():
        rows = base.withColumn("clipped", V.clip_norm(F.col(column), 1.0)).withColumn("noise", N.noise_vector(F.col("row_id"), F.size(column), sigma, 42))
        rows = rows.withColumn("noised", V.added(F.col("clipped"), F.col("noise"))).withColumn("signal", F.col("clipped"))
        nsr = N.noise_to_signal(F.col("noise"), F.col("clipped"))
        if name == "dp_before_jl":
            rows = P.project(rows, projector, "noised", "noised").withColumn("signal", F.col("projected"))
        part = rows.agg(F.lit(name).alias("variant"), F.round(F.avg(nsr), 8).alias("mean_nsr"), F.round(F.avg(V.cosine(F.col("signal"), F.col("noised"))), 8).alias("mean_cosine"))
        out = part if out is None else out.unionByName(part)
    return out
