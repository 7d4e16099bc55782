"""Summaries that merge: counts, extremes and sketches by group, added up to coarser groups without the rows.

Quantiles come from KLL sketches (a rank is off by RANK_ERROR of the rows, nearly always), numbers of
distinct ids from HLL sketches (DISTINCT_ERROR: three standard errors). Merging summaries gives what
summarising the rows would, within the same bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANK_ERROR, DISTINCT_ERROR = 0.0133, 0.05


def summarize(rows: DataFrame, by: list[str], values: list[str], id_col: str | None = None) -> DataFrame:
    """(by, rows, <value>_min, _max, _sum, _n, _sketch ..., ids): one row a group; nulls and NaN count in `rows` only."""
    out = [F.count(F.lit(1)).alias("rows")]
    for v in values:
        x = F.nanvl(F.col(v).cast("double"), F.lit(None).cast("double"))
        out += [F.min(x).alias(f"{v}_min"), F.max(x).alias(f"{v}_max"), F.sum(x).alias(f"{v}_sum"), F.count(x).alias(f"{v}_n"), F.kll_sketch_agg_double(x).alias(f"{v}_sketch")]
    if id_col is not None:
        out.append(F.hll_sketch_agg(id_col).alias("ids"))
    return rows.groupBy(*by).agg(*out)


def merged(summaries: DataFrame, by: list[str]) -> DataFrame:
    """Summaries of coarser groups."""
    kinds = {"rows": F.sum, "ids": F.hll_union_agg}
    ends = {"_min": F.min, "_max": F.max, "_sum": F.sum, "_n": F.sum, "_sketch": F.kll_merge_agg_double}
    columns = [c for c in summaries.columns if c == "rows" or c == "ids" or any(c.endswith(e) for e in ends)]
    columns = [c for c in columns if c not in by]
    pick = lambda c: kinds.get(c) or next(f for e, f in ends.items() if c.endswith(e))
    return summaries.groupBy(*by).agg(*[pick(c)(F.col(c)).alias(c) for c in columns])


def mean(value: str) -> Column:
    return F.try_divide(F.col(f"{value}_sum"), F.col(f"{value}_n"))


def quantile(value: str, share: float) -> Column:
    """A value of about that rank; null for a group without numbers."""
    return F.when(F.col(f"{value}_n") > 0, F.kll_sketch_get_quantile_double(f"{value}_sketch", F.lit(share)))


def distinct() -> Column:
    return F.hll_sketch_estimate("ids")
