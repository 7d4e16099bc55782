"""Selection among the rows of parameter grids, and settlement of rewards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def constrained_best(rows: DataFrame, key: str, least: float, score: str = "recall", second: str = "mrr", by: tuple[str, ...] = ()) -> DataFrame:
    """The row of highest (score, second) with key >= least; without such a row the one of highest (key, score), marked fallback."""
    ok = F.coalesce(F.col(key) >= least, F.lit(False))
    first, then = F.when(ok, F.col(score)).otherwise(F.col(key)), F.when(ok, F.col(second)).otherwise(F.col(score))
    w = Window.partitionBy(*by).orderBy(ok.desc(), first.desc_nulls_last(), then.desc_nulls_last(), *sorted(rows.columns))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n").withColumn("fallback", ~ok)


def nearest_row(rows: DataFrame, column: str, value: float, by: str) -> DataFrame:
    """For each group the row whose column is nearest to the value, the smaller one of two."""
    w = Window.partitionBy(by).orderBy(F.abs(F.col(column) - value), column)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def heat_map(rows: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    return rows.groupBy(row).pivot(column, columns).agg(F.max(value))


def union_rows(*tables: DataFrame) -> DataFrame:
    """All rows with all columns, in name order; what a table lacks is null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.select(*sorted(out.columns))


def subtotals(rows: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    """rows by all keys, by each set of them, and over all; level has a bit for each key that is summed up, the last key's the lowest."""
    sets = [[F.col(k) for i, k in enumerate(keys) if not gone >> (len(keys) - 1 - i) & 1] for gone in range(1 << len(keys))]
    return rows.groupingSets(sets, *map(F.col, keys)).agg(F.grouping_id().cast("long").alias("level"), *aggregates)


def payouts(rows: DataFrame, bounty: float = 100.0, margin: float = 0.015) -> DataFrame:
    """rows (round, node, sim) with threshold, payout and balance; payouts share the bounty by what exceeds the threshold."""
    limit = rows.groupBy("round").agg((F.percentile("sim", 0.5) - margin).alias("threshold"))
    over = rows.join(limit, "round").withColumn("extra", F.when(F.col("sim") < F.col("threshold"), 0.0).otherwise(F.col("sim") - F.col("threshold")))
    total = over.groupBy("round").agg(F.sum("extra").alias("total"))
    paid = over.join(total, "round").withColumn("payout", F.when(F.col("total") > 0, F.col("extra") / F.col("total") * bounty).otherwise(F.lit(0.0)))
    w = Window.partitionBy("node").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    return paid.withColumn("balance", F.sum("payout").over(w)).select("round", "node", "threshold", "payout", "balance")


def settled(effective: Column, bounty: Column, total: Column) -> Column:
    """Whole-number shares: scores times 10^4, rounded down."""
    e, t = F.floor(effective * 10000).cast("long"), F.floor(total * 10000).cast("long")
    return F.when(t > 0, F.floor(e * bounty / t).cast("long")).otherwise(F.lit(0).cast("long"))


def recommendation(rows: DataFrame, rules: dict[str, tuple[str, float]]) -> DataFrame:
    """For each scheme of rules (scheme: key, least value) its constrained best row, with the key, the bound and a reason for a fallback."""
    out = None
    for scheme, (key, least) in rules.items():
        best = constrained_best(rows.where(F.col("scheme") == scheme), key, least).withColumns({"threshold_key": F.lit(key), "threshold": F.lit(least)})
        best = best.withColumn("fallback_reason", F.when(F.col("fallback"), F.lit(f"no candidate satisfied {key} threshold")))
        out = best if out is None else out.unionByName(best)
    return out


def resolved(variant: Column, base: Column, default: float) -> Column:
    """A variant's own parameter, else its base scheme's, else the default."""
    return F.coalesce(variant.cast("double"), base.cast("double"), F.lit(float(default)))


def best_by_loss(rows: DataFrame, by: str, loss: str, most: float, score: str = "recall") -> DataFrame:
    """For each group the row of highest score with a loss up to a bound, else the one of smallest loss."""
    ok = F.coalesce(F.col(loss) <= most, F.lit(False))
    w = Window.partitionBy(by).orderBy(ok.desc(), F.when(ok, -F.col(score)).otherwise(F.col(loss)).asc_nulls_last(), *sorted(c for c in rows.columns if c != by))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def largest_slice(rows: DataFrame, size: str) -> DataFrame:
    """The rows of the largest size."""
    return rows.join(F.broadcast(rows.agg(F.max(size).alias("__most"))), F.col(size) == F.col("__most")).drop("__most")


def first_valid(*columns: Column) -> Column:
    """The first value that is there, is a number and is positive."""
    return F.coalesce(*[F.when(~F.isnan(c) & (c > 0), c) for c in columns])


def numbers(listed: str, kind: type = float, default: float | None = None) -> list:
    """The positive numbers of a comma-separated list, sorted and once each, with a default among them."""
    found = [kind(x) for x in listed.split(",") if x.strip()]
    if not found or min(found) <= 0:
        raise ValueError("a list of positive numbers is needed")
    return sorted({*found, *([] if default is None else [kind(default)])})
