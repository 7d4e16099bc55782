"""Exact nearest neighbours by blocks of a matrix product in 8-bit numbers.

Queries and candidates are dealt to tiles by a hash of their ids; a cell of the grid multiplies one
block of queries with one tile of candidates, so a task holds two bounded blocks however large the
table is. Both are as large as fits (_CELL_BYTES of doubles), as each row travels once for each block or
tile of the other side, in the table's own type of number. A cell takes _STEP queries at a time: there, unit vectors are rounded to 8-bit integers; with the rounding's residual norms the
product of the integers bounds each cosine from both sides:

    |u.w - s_u s_w (q_u.q_w)| <= |e_u| |s_w q_w| + |e_w|

A pair whose upper bound is under the k-th best lower bound of its query can't be among its nearest;
the pairs that survive are computed again from the original vectors in double precision, and a heap
keeps each query's k best of the cell. The cells' lists meet in a ranking of k rows for each query.

Defined results: vectors that are null, zero, or hold null or non-finite numbers take no part; neither
do pairs of different lengths. Fewer than k candidates give all of them. Equal scores are ordered by
id. Rows that repeat an id and its vector count once; a candidate never is a row with the query's own
id; a null id takes no part. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OUT_SCHEMA = "query_id long, vec_id long, score double"
_CELL_BYTES = 32 << 20
_STEP = 512


def quantise(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, residual norms and norms of what the codes stand for."""
    scale = np.abs(units).max(1) / 127
    codes = np.rint(units / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    return codes, scale, np.linalg.norm(units - back, axis=1), np.linalg.norm(back, axis=1)


def cell(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query, candidate, cosine) of each query's k nearest in the tile."""
    queries, vectors = scaled(queries), scaled(vectors)
    c_norm = np.sqrt((vectors * vectors).sum(1))
    right = quantise(vectors / c_norm[:, None])
    out = []
    for i in range(0, len(queries), _STEP):
        out += _step(query_ids[i : i + _STEP], queries[i : i + _STEP], ids, vectors, c_norm, right, k)
    return out


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that squares neither overflow nor vanish; cosines stay the same to the last bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _step(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, c_norm: np.ndarray, right: tuple, k: int) -> list[tuple[int, int, float]]:
    q_norm = np.sqrt((queries * queries).sum(1))
    q, q_scale, q_off, q_back = quantise(queries / q_norm[:, None])
    c, c_scale, c_off, c_back = right
    exact = np.float32 if queries.shape[1] * 127 * 127 < 1 << 24 else np.float64  # the sums stay whole numbers
    rough = (q.astype(exact) @ c.astype(exact).T) * q_scale[:, None] * c_scale
    error = q_off[:, None] * c_back + c_off + 1e-9
    own = query_ids[:, None] == ids
    low = np.where(own, -np.inf, rough - error)
    kth = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] >= k else np.full(len(q), -np.inf)
    row, column = np.nonzero((rough + error >= kth[:, None]) & ~own)
    score = np.empty(len(row))
    for i in range(0, len(row), 1 << 16):
        a, b = row[i : i + (1 << 16)], column[i : i + (1 << 16)]
        score[i : i + (1 << 16)] = (queries[a] * vectors[b]).sum(1) / (q_norm[a] * c_norm[b])
    out, edges = [], np.searchsorted(row, np.arange(len(q) + 1))
    for i, query in enumerate(query_ids.tolist()):
        part = slice(edges[i], edges[i + 1])
        best = heapq.nsmallest(k, zip((-score[part]).tolist(), ids[column[part]].tolist()))
        out += [(query, vec, -s) for s, vec in best]
    return out


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v, width) of the vectors that take part, once for each id and vector."""
    kind = df.schema[vector_col].dataType.simpleString()
    v = F.col(vector_col) if kind == "array<float>" else F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull())).where(finite_of("v")).where(F.exists("v", lambda x: x != 0))
    return rows.dropDuplicates(["vec_id", "v"]).withColumn("width", F.size("v"))


def finite_of(name: str):
    return F.forall(name, lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.float64)


def nearest(df: DataFrame, is_query: F.Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", cell_rows: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each row for which is_query (on vec_id) holds.

    cell_rows, by default as many as fit in _CELL_BYTES, bounds the rows of a block and of a tile.
    """
    rows = usable(df, id_col, vector_col)
    queries = rows.where(is_query)
    n_rows, n_queries, width = rows.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1)), F.max("width")).first()
    most = cell_rows or max(256, _CELL_BYTES // (8 * (width or 1)))
    spread = min(2 * df.sparkSession.sparkContext.defaultParallelism, n_rows // 1024)  # tiles worth having, to use all cores
    tiles, blocks = max(1, spread, math.ceil(n_rows / most)), max(1, math.ceil(n_queries / most))
    # both sides' keys must have one type: cogroup deals rows by the keys' hashes, which differ between int and long
    place = F.xxhash64("vec_id", "v")
    right = rows.select("vec_id", "v", "width", F.pmod(place, F.lit(tiles)).cast("int").alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    left = queries.select("vec_id", "v", "width", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"), F.pmod(F.xxhash64(place), F.lit(blocks)).cast("int").alias("block"))

    def join(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(q) and len(c):
            found = cell(q["vec_id"].to_numpy(), _matrix(q["v"]), c["vec_id"].to_numpy(), _matrix(c["v"]), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    keys = ("tile", "block", "width")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(join, OUT_SCHEMA)
    best_first = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
