"""Session helpers: shipping the package, shared folders and table access."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Tables of materialize() that are still there.
_TABLES: dict[str, SparkSession] = {}
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def ship(spark: SparkSession) -> None:
    """Make this package importable on every Python worker (once per application).

    The zip is served by the driver, so executors need no shared code folder.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    handle, name = tempfile.mkstemp(prefix="murmura-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    sc.addPyFile(name)
    atexit.register(lambda: os.path.exists(name) and os.remove(name))
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir).

    A temporary folder is made only for a local master, as in tests: executors of a cluster can't see it.
    """
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="murmura-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(_remove_local, found)
    return found.rstrip("/")


def _remove_local(uri: str) -> None:
    import shutil

    shutil.rmtree(uri.removeprefix("file://"), ignore_errors=True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a table written to the shared folder, and read it back."""
    return materialize_at(df, name)[0]


def materialize_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """materialize(), and the table's path for forget(); tables that are left go when the driver ends."""
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes as tables of materialize() do."""
    path = f"{shared_dir(spark)}/murmura-{name}-{uuid.uuid4().hex}"
    if not _TABLES:
        atexit.register(_forget_all)
    _TABLES[path] = spark
    if (made := _MADE.get()) is not None:
        made.append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that materialize() makes inside go at its end, but those whose paths are taken out of the list."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield made
    finally:
        _MADE.reset(token)
    for path in made:
        forget(spark, path)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table made by materialize_at() that no later plan reads."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    _TABLES.pop(path, None)


def _forget_all() -> None:
    for path, spark in list(_TABLES.items()):
        if spark.sparkContext._jsc is None:  # stopped before
            return
        forget(spark, path)
