"""Wall-clock times of searches: never part of a result that is to be repeatable."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame


def seconds(make: Callable[[], DataFrame], repeats: int = 1, warm_up: bool = True) -> list[float]:
    """How long it takes to make all rows of a DataFrame, which go nowhere; a first run that isn't counted compiles code and starts workers."""
    if repeats < 1:
        raise ValueError("repeats must be greater than 0")
    out = []
    for i in range(repeats + warm_up):
        start = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        if i or not warm_up:
            out.append(time.perf_counter() - start)
    return out


def per_query(make: Callable[[], DataFrame], queries: DataFrame, repeats: int = 1) -> float:
    """Mean seconds for each query of a search over all of them; NaN without any."""
    n, took = queries.count(), seconds(make, repeats)
    return sum(took) / len(took) / n if n else float("nan")
