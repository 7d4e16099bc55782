"""Vector algebra on array columns, inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def _each(v: Column, by: Column) -> Column:
    """by for each number of v: worked out once, as what stands in a function of numbers is worked out for each of them."""
    return F.array_repeat(by, F.size(v))


def scaled(v: Column, by: Column) -> Column:
    return F.zip_with(doubles(v), _each(v, by), lambda x, b: x * b)


def divided(v: Column, by: Column) -> Column:
    return F.zip_with(doubles(v), _each(v, by), lambda x, b: x / b)


def normalize(v: Column) -> Column:
    return divided(v, F.greatest(norm(v), F.lit(TINY)))


def clip_norm(v: Column, limit: float) -> Column:
    return divided(v, F.greatest(F.lit(1.0), norm(v) / F.lit(limit)))


def added(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(TINY)) * F.greatest(norm(b), F.lit(TINY)))


def guarded_cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + F.lit(1e-9))


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def storage_mb(n: int, width: int) -> float:
    return n * width * 4 / 1024**2


def jl_min_dim(n: int, eps: float) -> int:
    """The least width that keeps distances of n points within 1 +- eps."""
    if not 0 < eps < 1:
        raise ValueError("eps must lie between 0 and 1")
    return 1 if n <= 1 else math.ceil(4 * math.log(n) / (eps**2 / 2 - eps**3 / 3))


def jl_min_dim_column(n: Column, eps: Column) -> Column:
    return F.when(n <= 1, F.lit(1)).otherwise(F.ceil(F.lit(4.0) * F.log(n.cast("double")) / (eps * eps / 2 - eps * eps * eps / 3)).cast("int"))


def chunked_l2(a: Column, b: Column, slots: int) -> Column:
    """The squared distances of the parts of `slots` numbers; their sum is the whole distance."""
    parts = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / slots).cast("int"))
    return F.transform(parts, lambda i: squared_l2(F.slice(a, i * slots + 1, slots), F.slice(b, i * slots + 1, slots)))


def errors(measured: Column, plain: Column) -> tuple[Column, Column]:
    """Absolute and relative error; relative to nothing, the absolute one."""
    gap = F.abs(measured - plain)
    return gap, F.when(F.abs(plain) < 1e-12, gap).otherwise(gap / F.abs(plain))
