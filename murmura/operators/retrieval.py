"""Exact top-k search, filter-refine search and linkage.

Queries are dealt to blocks and candidates to tiles by hashes of their ids; a cell of the grid scores one
block against one tile, _STEP candidates and _ROWS queries at a time, and gives its k best for each query.
Nothing is gathered on the driver, and a cell holds two bounded tables however many queries and candidates
there are. Scores are rounded to 9 digits before ranking, ties go to the smaller id.

Queries and candidates whose vector is null, or holds a null or a number that isn't finite, take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmura.functions import vector

#: Rows of a block and of a tile.
BLOCK_ROWS, TILE_ROWS = 32_768, 65_536
#: Candidates and queries that are scored at a time, so that their scores stay in a core's cache, and candidates that share a maximum.
_STEP, _ROWS, _GROUP = 1024, 512, 32
#: Candidates for exact scores, or scores in double precision, that a task holds at a time.
_SCORES = 2_000_000
#: For each measure, whether higher is nearer.
MEASURES = {"cosine": True, "ip": True, "l2": False}


def usable(rows: DataFrame, vec: str = "vec") -> DataFrame:
    """rows whose vector holds finite numbers only."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return rows.where(F.col(vec).isNotNull() & F.forall(F.col(vec).cast("array<double>"), finite))


def top_k(
    queries: DataFrame, docs: DataFrame, k: int, measure: str = "cosine", q_id: str = "query_id", d_id: str = "doc_id", vec: str = "vec", by: str | None = None, variants: list[str] | None = None
) -> DataFrame:
    """(query_id, rank, doc_id, score); with by, for each of the variants that docs (and queries, if they have the column) hold there."""
    if measure not in MEASURES or k < 1:
        raise ValueError("k must be positive and the measure one of " + ", ".join(MEASURES))
    left = queries.select(F.col(q_id).alias("id"), F.col(vec).cast("array<double>").alias("v"), *_variant(queries, by, variants))
    right = docs.select(F.col(d_id).alias("id"), F.col(vec).cast("array<double>").alias("v"), *([] if by is None else [F.col(by).alias("variant")]))
    if by is None:
        left, right = (t.withColumn("variant", F.lit("")) for t in (left, right))
    left, right = usable(left, "v"), usable(right, "v")
    schema = "variant string, query_id long, doc_id long, score double"
    found = ranked(_cells(left, right).applyInArrow(_search(k, measure), schema), k, MEASURES[measure], "query_id", "variant")
    return found.drop("variant") if by is None else found.withColumnRenamed("variant", by)


def _variant(queries: DataFrame, by: str | None, variants: list[str] | None) -> list:
    """The variants that a query is asked of: its own, or all."""
    if by is None:
        return []
    return [F.col(by).alias("variant") if by in queries.columns else F.explode(F.array(*map(F.lit, variants or []))).alias("variant")]


def _cells(left: DataFrame, right: DataFrame):
    """(variant, id, v) tables of queries and candidates, cogrouped by the cells of a grid."""
    n_left, n_right = (t.groupBy("variant").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0 for t in (left, right))
    blocks = max(1, math.ceil(n_left / BLOCK_ROWS))
    spread = min(right.sparkSession.sparkContext.defaultParallelism, n_right // 1024)  # tiles worth having, to use all cores
    tiles = max(1, spread // blocks, math.ceil(n_right / TILE_ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = left.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("tile", every(tiles))
    right = right.withColumn("tile", F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int")).withColumn("block", every(blocks))
    keys = ("variant", "block", "tile")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys))


def pair_sums(queries: DataFrame, variants: DataFrame, names: list[str]) -> DataFrame:
    """(variant, query_id, n, sum_a ... most_drift): over all documents, of cosines with ref (a) and vec (b).

    Sums of cosines and of their products come from sums over the documents; only drifts need each pair.
    """
    left = queries.select(F.col("query_id").alias("id"), F.col("vec").alias("v"), *_variant(queries, "variant", names))
    right = variants.select("variant", F.col("doc_id").alias("id"), F.col("vec").alias("v"), "ref")
    left, right = usable(left, "v"), usable(usable(right, "v"), "ref")
    names_of = ["sum_a", "sum_b", "sum_aa", "sum_bb", "sum_ab", "sum_drift", "most_drift"]

    def add(q: pa.Table, c: pa.Table) -> pa.Table:
        found = [np.zeros(0)] * len(names_of)
        if q.num_rows and c.num_rows:
            x, a, b = (_units(_matrix(t)) for t in (q["v"], c["ref"], c["v"]))
            squares = lambda y, z: np.einsum("ij,ij->i", x @ (y.T @ z), x)
            found = [x @ a.sum(0), x @ b.sum(0), squares(a, a), squares(b, b), squares(a, b), *_drifts(x, a, b)]
        size = len(found[0])
        first = [q["variant"].slice(0, size), q["id"].slice(0, size), pa.array(np.full(size, c.num_rows))]
        return pa.table([*first, *map(pa.array, found)], names=["variant", "query_id", "n", *names_of])

    parts = _cells(left, right).applyInArrow(add, "variant string, query_id long, n long, " + ", ".join(f"{n} double" for n in names_of))
    return parts.groupBy("variant", "query_id").agg(*[F.sum(n).alias(n) for n in ["n", *names_of[:-1]]], F.max("most_drift").alias("most_drift"))


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """The rows' vectors, which are of one width."""
    widths = pc.list_value_length(vectors).unique().to_pylist()
    if len(widths) > 1:
        raise ValueError("vectors of different widths: " + ", ".join(map(str, sorted(widths))))
    values = [x.flatten().to_numpy(zero_copy_only=False) for x in vectors.chunks]
    return np.concatenate(values).astype(float, copy=False).reshape(len(vectors), -1)


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), vector.TINY)


def _groups(q: np.ndarray, c: np.ndarray, change) -> Iterator[tuple[int, int, np.ndarray]]:
    """(query, candidate, scores): single-precision products of the queries and candidates from there on, changed in place, as (group, candidate of it, query); what stands past the last candidate is -inf."""
    c = np.ascontiguousarray(c, np.float32)
    held = np.empty((-(-min(_STEP, len(c)) // _GROUP) * _GROUP, min(_ROWS, len(q))), np.float32)
    for i in range(0, len(q), _ROWS):
        x = np.ascontiguousarray(q[i : i + _ROWS], np.float32).T
        for j in range(0, len(c), _STEP):
            n = min(_STEP, len(c) - j)
            scores = held[: -(-n // _GROUP) * _GROUP, : x.shape[1]] if x.shape[1] == held.shape[1] else np.empty((-(-n // _GROUP) * _GROUP, x.shape[1]), np.float32)
            np.matmul(c[j : j + n], x, out=scores[:n])
            change(scores[:n], j)
            scores[n:] = -np.inf
            yield i, j, scores.reshape(-1, _GROUP, x.shape[1])


def _drifts(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum and the largest of the absolute differences of each query's cosines with a and with b; the largest one is that of cosines to 9 digits."""
    gap, total, most, place = b - a, np.zeros(len(x)), np.full(len(x), -1.0), np.zeros(len(x), np.int64)
    for i in range(0, len(x), _ROWS):
        own = slice(i, min(i + _ROWS, len(x)))
        y = x[own].T
        for j in range(0, len(a), _STEP):
            drift = gap[j : j + _STEP] @ y
            np.abs(drift, out=drift)
            total[own] += drift.sum(0)
            top = drift.max(0)
            more = np.nonzero(top > most[own])[0]
            most[own][more], place[own][more] = top[more], j + drift[:, more].argmax(0)
    s, t = (np.round(np.einsum("ij,ij->i", x, y[place]), 9) for y in (a, b))
    return total, np.abs(s - t)


def _search(k: int, measure: str):
    sign = -1 if MEASURES[measure] else 1

    def run(queries: pa.Table, docs: pa.Table) -> pa.Table:
        row, ids, costs = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if queries.num_rows and docs.num_rows:
            q, c = _matrix(queries["v"]), _matrix(docs["v"])
            if q.shape[1] != c.shape[1]:
                raise ValueError(f"queries of {q.shape[1]} numbers and candidates of {c.shape[1]}")
            if measure == "cosine":
                q, c = _units(q), _units(c)
            ids = docs["id"].to_numpy()
            kept = _first_copies(c, ids, k)
            row, ids, costs = _nearest(q, c[kept], ids[kept], k, measure)
        return pa.table({"variant": queries["variant"].take(row), "query_id": queries["id"].take(row), "doc_id": ids, "score": sign * costs + 0.0})

    return run


def _first_copies(c: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The rows without those that k equal vectors of smaller ids stand before in any ranking."""
    mixed = (c.view(np.uint64) * np.random.default_rng(0).integers(1 << 62, size=c.shape[1], dtype=np.uint64)).sum(1)
    order = np.lexsort((ids, mixed))
    mixed = mixed[order]
    start = np.searchsorted(mixed, mixed)
    late = np.nonzero(np.arange(len(order)) - start >= k)[0]
    if not len(late):
        return np.arange(len(ids))
    crowded = np.nonzero(np.isin(start, start[late]))[0]
    unlike = start[crowded[(c[order[crowded]] != c[order[start[crowded]]]).any(1)]]  # runs that only chance brought together stay
    return np.sort(np.delete(order, late[~np.isin(start[late], unlike)]))


def _costs(q: np.ndarray, c: np.ndarray, measure: str) -> np.ndarray:
    """What is smallest for the nearest, to 9 digits: squared distances, or negative products, of the rows of two tables."""
    return np.round(((q - c) ** 2).sum(1) if measure == "l2" else -np.einsum("ij,ij->i", q, c), 9)


def _nearest(q: np.ndarray, c: np.ndarray, ids: np.ndarray, k: int, measure: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, cost) of each query's k nearest candidates, of equal ones those of the smallest ids.

    Single precision only discards: what lies beyond the k-th best score by more than twice its error is
    out, and the rest is worked out in double precision. The k-th best score so far is that of groups of
    candidates, so most groups are discarded by their best one. Numbers too large for that are all worked out.
    """
    if max(float(np.abs(x).max(initial=0)) for x in (q, c)) > 1e12:
        return _nearest_plain(q, c, ids, k, measure)
    norms = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
    size, half = norms[0] * norms[1].max(), None
    if measure == "l2":  # half of what depends on the candidate
        half = (norms[1] ** 2 / 2).astype(np.float32)[:, None]
        size = size + norms[1].max() ** 2
    slack = 2 * (1e-9 + 6e-8 * (q.shape[1] + 8) * size)

    def change(scores: np.ndarray, j: int) -> None:
        if half is not None:
            scores -= half[j : j + len(scores)]

    done, held, kept, pending, best, low = [], 0, None, [], np.zeros(0), np.zeros(0)

    def settle(i: int) -> None:
        """Exact costs of what is pending and may still be among the k nearest; the k nearest of these and the kept ones are kept."""
        nonlocal kept, pending, held
        if not pending:
            return
        row, column, scores = (np.concatenate(x) for x in zip(*pending))
        near = scores >= low[row]
        row, column = row[near], column[near]
        costs = np.empty(len(row))
        for n in range(0, len(row), 1 << 16):
            costs[n : n + (1 << 16)] = _costs(q[row[n : n + (1 << 16)] + i], c[column[n : n + (1 << 16)]], measure)
        found = row + i, ids[column], costs
        kept = _first(*(found if kept is None else map(np.concatenate, zip(kept, found))), k)
        pending, held = [], 0

    at = 0
    for i, j, scores in _groups(q, c, change):
        if j == 0:
            if i:
                settle(at)
                done.append(kept)
            at, kept, pending, held = i, None, [], 0
            best = np.full((k, scores.shape[2]), -np.inf, np.float32)
            low = best[0]
        top = scores.max(1)
        better = np.nonzero((top > best[0]).any(0))[0]
        if len(better):
            both = np.concatenate([best[:, better], top[:, better]])
            both.partition(len(top), axis=0)
            best[:, better] = both[len(top) :]
            low = (best[0] - slack[i : i + scores.shape[2]]).astype(np.float32)
        group, row = np.nonzero(top >= low)
        near = scores[group, :, row]
        hit, place = np.nonzero((near >= low[row, None]) & (near > -np.inf))
        if len(hit):
            pending.append((row[hit], group[hit] * _GROUP + place + j, near[hit, place]))
            held += len(hit)
            if held > _SCORES:
                settle(i)
    settle(at)
    return tuple(map(np.concatenate, zip(*done, kept)))


def _nearest_plain(q: np.ndarray, c: np.ndarray, ids: np.ndarray, k: int, measure: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_nearest() with all scores in double precision."""
    out, step = [], max(1, _SCORES // len(c))
    for i in range(0, len(q), step):
        x = q[i : i + step]
        costs = np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T, 0) if measure == "l2" else -(x @ c.T)
        row, column = (n.reshape(-1) for n in np.indices(costs.shape))
        out.append(_first(row + i, ids[column], np.round(costs, 9).reshape(-1), k))
    return tuple(map(np.concatenate, zip(*out)))


def _first(row: np.ndarray, ids: np.ndarray, values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k entries of each row with the smallest values; row ascends, and of equal values the smaller id is first."""
    order = np.lexsort((ids, values, row))
    row, ids, values = row[order], ids[order], values[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], ids[keep], values[keep]


def ranked(scores: DataFrame, k: int, higher: bool, *by: str) -> DataFrame:
    """The k best rows of each query."""
    by = by or ("query_id",)
    order = F.col("score").desc() if higher else F.col("score").asc()
    w = Window.partitionBy(*by).orderBy(order, "doc_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*by, "rank", "doc_id", "score")


def filter_refine(queries: DataFrame, docs: DataFrame, k: int, ratio: int, reference: str = "ref", protected: str = "vec", measure: str = "l2") -> DataFrame:
    """The k best by squared distance of reference vectors among max(k, ratio k) found with protected ones."""
    first = top_k(queries, docs, max(k, ratio * k), measure, vec=protected)
    q = queries.select("query_id", F.col(reference).alias("q_ref"))
    d = docs.select("doc_id", F.col(reference).alias("d_ref"))
    again = first.select("query_id", "doc_id").join(q, "query_id").join(d, "doc_id")
    return ranked(again.select("query_id", "doc_id", F.round(vector.squared_l2(F.col("q_ref"), F.col("d_ref")), 9).alias("score")), k, False)


def linkage(protected: DataFrame, public: DataFrame, k: int, measure: str = "cosine") -> DataFrame:
    """For each protected vector the k nearest public ones."""
    return top_k(protected, public, k, measure)
