"""As-of join: each row meets the last row of the other table at or before its time, for its key.

Both tables are put into one order (key, time, the other table's rows first) and dealt to tasks by ranges of
it. In each range a running last value does the rest; what a key's earlier ranges leave is carried in, one
row for each range and key. No key's rows need to fit one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmura.operators.ordered import _all
from murmura.session import materialize


def as_of(left: DataFrame, right: DataFrame, time: str, by: str, take: list[str], strict: bool = False) -> DataFrame:
    """left's rows with take's columns of right (null where nothing came before); equal times meet unless strict.

    Of several right rows of one key and time the one with the largest take, in order, is the last. Rows
    without a key or a time meet nothing.
    """
    usable = F.col(by).isNotNull() & F.col(time).isNotNull()
    side = (F.lit(2) if strict else F.lit(0)).alias("__side")
    value = F.struct(*[F.col(c).alias(f"t{i}") for i, c in enumerate(take)])
    empty = F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType)
    row = F.struct(*left.columns)
    rights = right.where(usable).select(F.col(by).alias("__by"), F.col(time).alias("__time"), side, value.alias("__value"), F.lit(None).cast(left.select(row.alias("r")).schema["r"].dataType).alias("__row"))
    lefts = left.where(usable).select(F.col(by).alias("__by"), F.col(time).alias("__time"), F.lit(1).alias("__side"), empty.alias("__value"), row.alias("__row"))
    order = [F.col(c) for c in ("__by", "__time", "__side", "__value")]
    dealt = materialize(lefts.unionByName(rights).repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "asof")
    known = F.max(F.when(F.col("__value").isNotNull(), F.struct("__time", "__side", "__value"))).alias("last")
    ends = dealt.groupBy("__range", "__by").agg(known)
    before = Window.partitionBy("__by").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col("__range").alias("c_range"), F.col("__by").alias("c_by"), F.last("last", ignorenulls=True).over(before)["__value"].alias("carried"))
    upto = Window.partitionBy("__range", "__by").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, 0)
    found = dealt.withColumn("own", F.last("__value", ignorenulls=True).over(upto)).where("__row IS NOT NULL")
    found = found.join(carried, _all([F.col("__range") == F.col("c_range"), F.col("__by") == F.col("c_by")])).withColumn("got", F.coalesce("own", "carried"))
    named = [F.col(f"got.t{i}").alias(c) for i, c in enumerate(take)]
    out = found.select("__row.*", *named)
    return out.unionByName(left.where(~F.coalesce(usable, F.lit(False))).select("*", *[F.lit(None).cast(out.schema[c].dataType).alias(c) for c in take]))
