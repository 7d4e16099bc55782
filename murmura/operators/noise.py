"""Calibrated noise on vectors. The scale is lowered by utility_scale: sigma_effective is no (epsilon, delta) guarantee."""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmura.functions import randomness, vector
from murmura.functions.sensitivity import clip


@dataclass(frozen=True)
class NoiseConfig:
    delta: float = 1e-5
    clip_norm: float = 1.0
    utility_scale: float = 0.01
    low: float = 0.1
    high: float = 10.0
    seed: int = 42

    def __post_init__(self):
        if not 0 < self.delta < 1:
            raise ValueError("delta must lie between 0 and 1")
        if not 0 < self.low < self.high:
            raise ValueError("the score interval must be positive and increasing")
        if self.clip_norm <= 0 or self.utility_scale <= 0:
            raise ValueError("clip_norm and utility_scale must be positive")


def normalized_score(raw: Column) -> Column:
    return (clip(raw, 0.1, 10.0) - F.lit(0.1)) / F.lit(9.9)


def epsilon(score: Column) -> Column:
    return clip(F.lit(1.25) + F.lit(8.75) * F.pow(F.lit(1.0) - score, F.lit(1.5)), 0.5, 10.0)


def sensitivity(score: Column) -> Column:
    return F.lit(0.25) + F.lit(0.25) * score


def _phi(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def multiplier(eps: float, delta: float) -> tuple[float, bool]:
    """The noise multiplier of the analytic Gaussian mechanism, and whether it was solved for."""
    def excess(u: float) -> float:
        tail = _phi(-1 / (2 * u) - eps * u)
        return _phi(1 / (2 * u) - eps * u) - (math.exp(eps + math.log(tail)) if tail > 0 else 0.0) - delta

    low, high = 1e-4, 100.0
    if excess(low) * excess(high) > 0:
        return math.sqrt(2 * math.log(1.25 / delta)) / eps, False
    for _ in range(200):  # halving; excess falls with u
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) > 0 else (low, mid)
    return (low + high) / 2, True


def calibrate(rows: DataFrame, raw_col: str, config: NoiseConfig = NoiseConfig()) -> DataFrame:
    """rows with epsilon, local_sensitivity, sigma and solved; the root is found once for each epsilon of an Arrow batch."""
    score = normalized_score(F.col(raw_col))

    @F.pandas_udf("struct<m double, solved boolean>")
    def solve(eps: pd.Series) -> pd.DataFrame:
        found = {e: multiplier(e, config.delta) for e in eps.unique()}
        return pd.DataFrame([found[e] for e in eps], columns=["m", "solved"])

    out = rows.withColumns({"normalized_score": score, "epsilon": epsilon(score), "local_sensitivity": sensitivity(score)})
    out = out.withColumn("__m", solve("epsilon"))
    return out.withColumns({"sigma": F.col("__m.m") * F.col("local_sensitivity"), "solved": F.col("__m.solved")}).drop("__m")


def sigma_per_dim(sigma: Column, width: Column, utility_scale: float) -> Column:
    return sigma * F.lit(utility_scale) / F.sqrt(width.cast("double"))


def noise_vector(row_id: Column, width: Column, sigma: Column, seed: int, stream: str = "dp") -> Column:
    return randomness.gaussian_row(seed, stream, row_id, width, sigma)


def apply_noise(rows: DataFrame, id_col: str, vector_col: str, sigma_col: str, config: NoiseConfig = NoiseConfig()) -> DataFrame:
    """rows with clipped, noise and noised vectors; what is noised isn't clipped again."""
    width = F.size(vector_col)
    step = sigma_per_dim(F.col(sigma_col), width, config.utility_scale)
    out = rows.withColumns({"clipped": vector.clip_norm(F.col(vector_col), config.clip_norm), "sigma_per_dim": step})
    out = out.withColumn("noise", noise_vector(F.col(id_col), F.size(vector_col), F.col("sigma_per_dim"), config.seed))
    return out.withColumn("noised", vector.added(F.col("clipped"), F.col("noise")))


def noise_to_signal(noise: Column, clipped: Column) -> Column:
    return vector.norm(noise) / F.greatest(vector.norm(clipped), F.lit(vector.TINY))


def ball(row_id: Column, width: Column, radius: Column, seed: int, stream: str = "sap") -> tuple[Column, Column]:
    """A normal direction, and what to scale it by so that it is uniform in a ball."""
    z = randomness.gaussian_row(seed, stream, row_id, width, F.lit(1.0))
    return z, F.pow(randomness.uniform(seed, f"{stream}r", row_id), F.lit(1.0) / width) * radius


def scale_and_perturb(rows: DataFrame, id_col: str, vector_col: str, beta: float, seed: int, scale: float | None = None) -> DataFrame:
    """rows with perturbed: vectors times scale (the root of their width by default) plus a draw from the ball of radius scale * beta / 4; queries are moved by the same call, under their own ids."""
    width = F.size(vector_col)
    s = F.sqrt(width.cast("double")) if scale is None else F.lit(float(scale))
    direction, by = ball(F.col(id_col), width, s * beta / 4, seed)
    out = rows.withColumn("__direction", direction)
    moved = vector.added(vector.scaled(F.col(vector_col), s), vector.scaled(F.col("__direction"), by / vector.norm(F.col("__direction"))))
    return out.withColumn("perturbed", moved).drop("__direction")


def score_column(rows: DataFrame, names: tuple[str, ...] = ("raw_sensitivity_score", "raw_score", "sensitivity_score"), default: float = 0.1) -> Column:
    """The first of the columns that rows has, as a number; the default without any, or for what is no number."""
    found = [c for c in names if c in rows.columns]
    return F.coalesce(F.col(found[0]).try_cast("double"), F.lit(default)) if found else F.lit(default)
