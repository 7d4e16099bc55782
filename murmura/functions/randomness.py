"""Counter-based draws: each is a function of (seed, stream, row, dimension), so plans can be repartitioned and rerun."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPAN = float(1 << 52)


def draw(seed: int, stream: str, *parts: Column) -> Column:
    """A whole number under 2^52, as double."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(stream), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")


def uniform(seed: int, stream: str, *parts: Column) -> Column:
    return draw(seed, stream, *parts) / F.lit(_SPAN)


def gaussian(seed: int, stream: str, *parts: Column) -> Column:
    radius = F.sqrt(F.lit(-2.0) * F.log((draw(seed, f"{stream}a", *parts) + 1) / F.lit(_SPAN + 1)))
    return radius * F.cos(F.lit(2 * math.pi) * uniform(seed, f"{stream}b", *parts))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def gaussians(prefix_a: pd.Series, prefix_b: pd.Series, width: pd.Series, sigma: pd.Series) -> pd.Series:
    """Rows of gaussian() times sigma for dimensions 0 to width - 1; a prefix is what stands before the dimension."""
    def draws(prefix: str, n: int) -> list[int]:
        base = hashlib.md5(prefix.encode())
        out = []
        for tail in _TAILS[:n] if n <= len(_TAILS) else [str(i).encode() for i in range(n)]:
            h = base.copy()
            h.update(tail)
            out.append(int.from_bytes(h.digest()[:7], "big") >> 4)
        return out

    def row(a: str, b: str, n: int, s: float) -> np.ndarray | None:
        if s != s:
            return None
        u, v = np.array(draws(a, n), float), np.array(draws(b, n), float)
        return s * (np.sqrt(-2.0 * np.log((u + 1) / (_SPAN + 1))) * np.cos(2 * math.pi * (v / _SPAN)))

    return pd.Series([row(*x) for x in zip(prefix_a, prefix_b, width, sigma)], dtype=object)


_TAILS = [str(i).encode() for i in range(1024)]


def gaussian_row(seed: int, stream: str, row: Column, width: Column, sigma: Column) -> Column:
    """The array of sigma * gaussian(seed, stream, row, i), drawn in batches instead of one by one."""
    prefix = lambda s: F.concat_ws("|", F.lit(str(seed)), F.lit(f"{stream}{s}"), row.cast("string"), F.lit(""))
    return gaussians(prefix("a"), prefix("b"), width.cast("int"), sigma.cast("double"))


def gaussian_sql(seed: int, stream: str, *parts: str) -> str:
    """The same draw for DuckDB."""
    u = lambda s: f"(('0x' || substr(md5(concat_ws('|', '{seed}', '{stream}{s}', {', '.join(parts)})), 1, 13))::BIGINT)::DOUBLE"
    return f"(sqrt(-2.0::DOUBLE * ln(({u('a')} + 1) / {_SPAN + 1!r}::DOUBLE)) * cos({2 * math.pi!r}::DOUBLE * {u('b')} / {_SPAN!r}::DOUBLE))"


def gaussian_matrix(seed: int, stream: str, rows: int, columns: int) -> np.ndarray:
    """gaussian(seed, stream, row, column) of a matrix, on the driver."""
    def one(s: str, i: int, j: int) -> int:
        return int(hashlib.md5(f"{seed}|{stream}{s}|{i}|{j}".encode()).hexdigest()[:13], 16)

    u = np.array([[(one("a", i, j), one("b", i, j)) for j in range(columns)] for i in range(rows)], float).reshape(rows, columns, 2)
    return np.sqrt(-2 * np.log((u[..., 0] + 1) / (_SPAN + 1))) * np.cos(2 * math.pi * u[..., 1] / _SPAN)
