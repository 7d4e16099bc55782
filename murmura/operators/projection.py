"""Random projections of vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.functions import randomness, vector


@dataclass(frozen=True)
class Projector:
    """A Gaussian matrix N(0, 1/sqrt(width)), or N(0, deviation) where one is given; a function of its seed."""

    in_dim: int
    target: int | None = 256
    eps: float = 0.3
    seed: int = 42
    n_points: int = 1000
    deviation: float | None = None

    @property
    def out_dim(self) -> int:
        return min(self.target or vector.jl_min_dim(self.n_points, self.eps), self.in_dim)

    def matrix(self) -> np.ndarray:
        return randomness.gaussian_matrix(self.seed, "jl", self.in_dim, self.out_dim) * (self.deviation or 1 / np.sqrt(self.out_dim))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.in_dim, self.target, self.eps, self.seed, self.n_points, self.deviation)], "in_dim int, target int, eps double, seed long, n_points long, deviation double").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Projector:
        return Projector(**spark.read.parquet(path).first().asDict())


def project(rows: DataFrame, projector: Projector, vector_col: str, out_col: str = "projected", after: bool = True) -> DataFrame:
    """rows with unit vectors times the matrix, brought to unit length again unless after is false."""
    weights = rows.sparkSession.sparkContext.broadcast(projector.matrix())  # in_dim x out_dim numbers

    @F.pandas_udf("array<double>")
    def times(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            if not len(v):
                yield pd.Series([], dtype=object)
                continue
            x = np.stack(v.to_list()).astype(float)
            if x.shape[1] != projector.in_dim:
                raise ValueError(f"vectors of {x.shape[1]} numbers; the projector takes {projector.in_dim}")
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), vector.TINY) @ weights.value
            if after:
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), vector.TINY)
            yield pd.Series(list(x))

    return rows.withColumn(out_col, times(F.col(vector_col)))


def mode_of(name: str) -> str:
    """'jl' or 'no_jl', however it is written."""
    mode = name.strip().lower().replace("-", "_")
    if mode not in ("jl", "no_jl"):
        raise ValueError(f"unknown representation: {name}")
    return mode


def represent(rows: DataFrame, mode: str, vector_col: str, projector: Projector | None = None, out_col: str = "represented") -> DataFrame:
    """rows with unit vectors, projected in mode 'jl'; queries and documents take the same projector."""
    if mode_of(mode) == "no_jl":
        return rows.withColumn(out_col, vector.normalize(F.col(vector_col)))
    if projector is None:
        raise ValueError("mode jl needs a projector")
    return project(rows, projector, vector_col, out_col)
