"""Agreement of ranked lists, given as (query_id, rank, doc_id) tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAN = float("nan")


def overlap_at(reference: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(query_id, overlap): the share of the reference's first k that the other list has in its first k."""
    ref = reference.where(F.col("rank") <= k).select("query_id", "doc_id")
    hit = found.where(F.col("rank") <= k).select("query_id", "doc_id", F.lit(1).alias("hit"))
    both = ref.join(hit, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.count("hit").alias("n"), F.count(F.lit(1)).alias("of"))
    return both.select("query_id", (F.col("n") / F.greatest(F.lit(1), F.least(F.lit(k), F.col("of")))).alias("overlap"))


def reciprocal_rank(targets: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(query_id, rr) for targets (query_id, doc_id); 0 where the target isn't among the first k."""
    hit = found.where(F.col("rank") <= k).select("query_id", "doc_id", "rank")
    return targets.join(hit, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.coalesce(F.max(F.lit(1.0) / F.col("rank")), F.lit(0.0)).alias("rr"))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson's r; NaN under two rows or without spread."""
    flat = (F.count(F.lit(1)) < 2) | (F.stddev_pop(x) == 0) | (F.stddev_pop(y) == 0)
    return F.when(flat, F.lit(NAN)).otherwise(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def nan_mean(x: Column) -> Column:
    return F.coalesce(F.avg(F.when(~F.isnan(x), x)), F.lit(NAN))


def stage_comparison(reference: DataFrame, found: DataFrame, depths: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """One row: mean overlap at each depth, and the mean reciprocal rank of the reference's first."""
    out = None
    for k in depths:
        part = overlap_at(reference, found, k).agg(nan_mean(F.col("overlap")).alias(f"recall_at_{k}"))
        out = part if out is None else out.join(part)  # single rows
    first = reference.where("rank = 1").select("query_id", "doc_id")
    return out.join(reciprocal_rank(first, found, 5).agg(nan_mean(F.col("rr")).alias("mrr_at_5")))
