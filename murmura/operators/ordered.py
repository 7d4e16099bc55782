"""Running sums over the order of a whole table, in two passes: no task sees more than its range of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmura.session import forget, materialize, materialize_at

SMALL_ROWS = 10_000


def running_sums(rows: DataFrame, order: list[Column], sums: dict[str, Column], by: tuple[str, ...] = (), written: bool = False) -> DataFrame:
    """rows with running sums (own row included) of long or double columns, in an order without ties, for each group of by.

    Rows are dealt to tasks by ranges of the order. What stands before a range is the sum of the ranges
    before it: one row for each range and group. Up to SMALL_ROWS rows, which one task holds with ease, are
    counted first and summed in one window instead, with the same result. Counting, finding the ranges and
    dealing each read all rows, so these are written first, unless they are a table already (written).
    """
    path = None
    if not written:
        rows, path = materialize_at(rows, "unsummed")
    if rows.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumns({name: F.sum(c).over(upto) for name, c in sums.items()})
    values = {f"value_{i}": c for i, c in enumerate(sums.values())}
    dealt = rows.withColumns(values).repartitionByRange(*order).withColumn("range_no", F.spark_partition_id())
    dealt = materialize(dealt, "ranges")
    if path is not None:
        forget(rows.sparkSession, path)
    totals = dealt.groupBy("range_no", *by).agg(*[F.sum(v).alias(v) for v in values])
    before = Window.partitionBy(*by).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("range_no", *by, *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"before_{v}") for v in values])
    keys = [F.col("range_no") == F.col("o_range"), *[F.col(c).eqNullSafe(F.col(f"o_{c}")) for c in by]]
    offsets = offsets.withColumnsRenamed({"range_no": "o_range", **{c: f"o_{c}" for c in by}})
    upto = Window.partitionBy("range_no", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumns({f"own_{v}": F.sum(v).over(upto) for v in values}).join(offsets, _all(keys))
    return out.select(*rows.columns, *[(F.col(f"own_{v}") + F.col(f"before_{v}")).alias(name) for name, v in zip(sums, values)])


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def numbered(rows: DataFrame, order: list[Column], name: str, by: tuple[str, ...] = (), written: bool = False) -> DataFrame:
    """rows with their number (from 1) in the order."""
    return running_sums(rows, order, {name: F.lit(1).cast("long")}, by, written)
