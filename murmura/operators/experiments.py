"""Rows that experiments report: variants of protected vectors against search on raw ones.

A variant table has (variant, doc_id, vec, ref, nsr): a protected vector, the raw one and its
noise-to-signal ratio. All variants are searched in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmura.functions import vector as V
from murmura.operators import noise as N
from murmura.operators import retrieval as R

NAN = float("nan")
DEPTHS = (1, 3, 5, 10)


def variant(rows: DataFrame, name: str, moved: Column, signal: Column, noise: Column | None = None) -> DataFrame:
    nsr = F.lit(0.0) if noise is None else N.noise_to_signal(noise, signal)
    return rows.select(F.lit(name).alias("variant"), "doc_id", V.normalize(moved).alias("vec"), F.col("vec").alias("ref"), nsr.alias("nsr"))


def noised(rows: DataFrame, name: str, sigma: Column, seed: int = 42, clip: float = 1.0) -> DataFrame:
    """A variant whose vectors are clipped and get noise of a deviation in each dimension."""
    drawn = rows.withColumn("clipped", V.clip_norm(F.col("vec"), clip)).withColumn("noise", N.noise_vector(F.col("doc_id"), F.size("vec"), sigma, seed))
    return variant(drawn, name, V.added(F.col("clipped"), F.col("noise")), F.col("clipped"), F.col("noise"))


def noised_all(rows: DataFrame, sigmas: dict[str, Column], seed: int = 42, clip: float = 1.0) -> DataFrame:
    """The variants that noised() gives for each name and deviation; vectors are clipped, and draws made, once for all of them."""
    drawn = rows.withColumns({"clipped": V.clip_norm(F.col("vec"), clip), "drawn": N.noise_vector(F.col("doc_id"), F.size("vec"), F.lit(1.0), seed)})
    each = drawn.select("doc_id", "vec", "clipped", "drawn", F.inline(F.array(*[F.struct(F.lit(n).alias("variant"), s.cast("double").alias("by")) for n, s in sigmas.items()])))
    moved = each.withColumn("noise", V.scaled(F.col("drawn"), F.col("by"))).withColumn("moved", V.added(F.col("clipped"), F.col("noise")))
    return moved.select("variant", "doc_id", V.normalize(F.col("moved")).alias("vec"), F.col("vec").alias("ref"), N.noise_to_signal(F.col("noise"), F.col("clipped")).alias("nsr"))


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def agreement(reference: DataFrame, found: DataFrame, depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    """(variant, recall_at_*, mrr_at_5): means over the reference's queries of the overlap at each depth, and of the rank of its first.

    With a column `scheme` in both tables each variant is held against its own scheme's reference.
    """
    by = ["scheme"] if "scheme" in reference.columns else []
    sizes = reference.groupBy(*by, "query_id").agg(F.count(F.lit(1)).alias("size"))
    asked = sizes.groupBy(*by).agg(F.count(F.lit(1)).alias("asked"))
    variants = found.select(*by, "variant").distinct()
    asked = variants.join(asked, by) if by else variants.join(F.broadcast(asked))  # without schemes a single row
    ref = reference.join(sizes, [*by, "query_id"]).select(*by, "query_id", "doc_id", F.col("rank").alias("ref_rank"), "size")
    both = found.join(ref, [*by, "query_id", "doc_id"])
    part = lambda k: F.sum(F.when((F.col("rank") <= k) & (F.col("ref_rank") <= k), 1.0 / F.greatest(F.lit(1), F.least(F.lit(k), F.col("size")))))
    mrr = F.sum(F.when((F.col("ref_rank") == 1) & (F.col("rank") <= 5), 1.0 / F.col("rank")))
    sums = both.groupBy("variant").agg(*[part(k).alias(f"recall_at_{k}") for k in depths], mrr.alias("mrr_at_5"))
    names = [*(f"recall_at_{k}" for k in depths), "mrr_at_5"]
    return asked.join(sums, "variant", "left").select("variant", *[(F.coalesce(n, F.lit(0.0)) / F.col("asked")).alias(n) for n in names])


def score_changes(queries: DataFrame, variants: DataFrame, names: list[str]) -> DataFrame:
    """(variant, query_id, mean_raw, mean_moved, mean_drift, max_drift, pearson) of the cosines of a query with all documents."""
    sums = R.pair_sums(queries, variants, names)
    n = F.col("n")
    cov, var_a, var_b = (F.col(x) / n - F.col(a) / n * F.col(b) / n for x, a, b in (("sum_ab", "sum_a", "sum_b"), ("sum_aa", "sum_a", "sum_a"), ("sum_bb", "sum_b", "sum_b")))
    flat = (n < 2) | (var_a <= 1e-15) | (var_b <= 1e-15)
    r = F.when(flat, F.lit(NAN)).otherwise(F.try_divide(cov, F.sqrt(var_a) * F.sqrt(var_b)))
    return sums.select("variant", "query_id", (F.col("sum_a") / n).alias("mean_raw"), (F.col("sum_b") / n).alias("mean_moved"), (F.col("sum_drift") / n).alias("mean_drift"), F.col("most_drift").alias("max_drift"), r.alias("pearson"))


def utility_rows(queries: DataFrame, docs: DataFrame, variants: DataFrame, names: list[str]) -> DataFrame:
    """A row for each variant: recalls, MRR, Pearson and drift of scores, noise-to-signal ratio, direction cosines."""
    raw = R.top_k(queries, docs, max(DEPTHS))
    found = R.top_k(queries, variants, max(DEPTHS), by="variant", variants=names)
    nan_mean = lambda c: F.coalesce(F.avg(F.when(~F.isnan(c), F.col(c))), F.lit(NAN))
    changes = score_changes(queries, variants, names).groupBy("variant").agg(nan_mean("pearson").alias("mean_pearson"), F.avg("mean_drift").alias("mean_drift"), F.max("max_drift").alias("max_drift"))
    same = V.cosine(F.col("ref"), F.col("vec"))
    shape = variants.groupBy("variant").agg(F.avg("nsr").alias("mean_nsr"), F.min(same).alias("min_direction_cosine"), F.avg(same).alias("mean_direction_cosine"), F.max(same).alias("max_direction_cosine"))
    return agreement(raw, found).join(changes, "variant").join(shape, "variant")
