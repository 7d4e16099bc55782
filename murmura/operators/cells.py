"""An approximate index: trained cells, an inverted list of each cell, and a search that probes the nearest ones.

Training. Cells are the means of a k-means run over a bounded sample: the first `sample_rows` rows in the
order of a hash of their ids (`rounds` rounds, from the first `cells` of them). Only this sample and the
means are on the driver. Every row is then assigned to its nearest mean, in Spark.

Search. A query probes the `ef_search` cells whose means are nearest; with as many as there are cells the
search is exact. The rows of a cell meet the queries that probe it on the grid of `retrieval.top_k`, so a
large cell is dealt to many tasks. Distances to means are rounded to 9 digits, ties go to the smaller cell.

Files. `save` writes vectors, and chunk records if there are any, partitioned by cell; a search on a
loaded index reads the probed partitions only. A manifest says what was written; it comes last, each
write has a path of its own, and what it supersedes is deleted.

Vectors that are null or hold a null or a number that isn't finite are left out; an empty table gives an
index without cells and searches without rows.
"""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.functions import vector
from murmura.operators import retrieval as R
from murmura.operators.ordered import numbered
from murmura.session import materialize

FORMAT = 1
FILE_ROWS = 1 << 20


@dataclass(frozen=True)
class CellConfig:
    """Parameters of an index; dim None takes any one width."""

    dim: int | None = None
    space: str = "cosine"
    cells: int = 128
    rounds: int = 3
    ef_search: int = 64
    seed: int = 42
    sample_rows: int = 16_384

    def __post_init__(self):
        if self.space not in R.MEASURES:
            raise ValueError("space must be one of " + ", ".join(R.MEASURES))
        for name in ("dim", "cells", "rounds", "ef_search", "sample_rows"):
            value = getattr(self, name)
            if value is not None and value < 1:
                raise ValueError(f"{name} must be greater than 0")


def ef_values(listed: list[int], default: int) -> list[int]:
    """The widths of a sweep in order, each once, the default among them."""
    return sorted({*map(int, listed), int(default)})


def _distances(v: np.ndarray, means: np.ndarray, space: str) -> np.ndarray:
    """What orders cells: squared distances, or for inner products their negatives."""
    return np.round(-v @ means.T if space == "ip" else np.maximum((v * v).sum(1)[:, None] + (means * means).sum(1) - 2 * v @ means.T, 0), 9)


def _prepared(vec: Column, space: str) -> Column:
    """A vector as cells see it: of length 1 for cosines."""
    return vector.normalize(vec) if space == "cosine" else vector.doubles(vec)


def k_means(sample: np.ndarray, cells: int, rounds: int) -> np.ndarray:
    """Means of a sample, from its first rows; a cell that loses all rows stays where it was."""
    means = sample[:cells].copy()
    for _ in range(rounds):
        own = np.concatenate([_distances(sample[i : i + 4096], means, "l2").argmin(1) for i in range(0, len(sample), 4096)] or [np.zeros(0, int)])
        for k in range(len(means)):
            if (mine := own == k).any():
                means[k] = sample[mine].mean(0)
    return means


def _sample(rows: DataFrame, config: CellConfig) -> np.ndarray:
    """The first rows in hash order; only hashes below a bound are sorted, which is raised should it leave too few."""
    hashed = rows.withColumn("hash", F.md5(F.concat(F.lit(f"{config.seed}|"), F.col("doc_id").cast("string")).cast("binary")))
    n, share = rows.count(), 1.5
    while True:
        bound = min(1.0, share * config.sample_rows / max(n, 1))
        few = hashed if bound == 1 else hashed.where(F.col("hash") < f"{int(bound * (1 << 60)):015x}")
        found = few.orderBy("hash", "doc_id").limit(config.sample_rows).select("unit").collect()
        if bound == 1 or len(found) == config.sample_rows:
            return np.array([r.unit for r in found], float)
        share *= 4


class CellIndex:
    """Rows (doc_id, vec, cell) with the means of their cells; chunks: records (doc_id, ..., cell) or None."""

    def __init__(self, config: CellConfig, means: np.ndarray, rows: DataFrame, chunks: DataFrame | None = None):
        self.config, self.means, self.rows, self.chunks = config, means, rows, chunks

    @classmethod
    def build(cls, rows: DataFrame, config: CellConfig = CellConfig(), id_col: str | None = None, vec: str = "vec", chunks: DataFrame | None = None) -> CellIndex:
        """Train and assign; without id_col rows are numbered from 0 as they are read. chunks: records with the same ids in doc_id."""
        if id_col is None:
            rows = numbered(rows.select(vec).withColumn("read", F.monotonically_increasing_id()), [F.col("read")], "no").withColumn("doc_id", F.col("no") - 1)
        else:
            rows = rows.withColumnRenamed(id_col, "doc_id")
        rows = R.usable(rows.select("doc_id", vector.doubles(F.col(vec)).alias("vec")), "vec")
        width = rows.agg(F.min(F.size("vec")).alias("least"), F.max(F.size("vec")).alias("most")).first()
        if width.least is not None and (width.least != width.most or config.dim not in (None, width.most)):
            raise ValueError(f"vectors of {width.least} to {width.most} numbers, {config.dim or 'one width'} expected")
        config = replace(config, dim=config.dim or width.most)
        units = rows.withColumn("unit", _prepared(F.col("vec"), config.space))
        means = k_means(_sample(units, config), config.cells, config.rounds)
        index = cls(config, means, rows)
        index.rows = materialize(units.withColumn("cell", F.element_at(index._nearest(1)(F.col("unit")), 1)).drop("unit"), "cells")
        if chunks is not None:
            index.chunks = chunks.join(index.rows.select("doc_id", "cell"), "doc_id")
        return index

    def _nearest(self, n: int, probing: bool = False):
        """A column function: the n cells nearest to a prepared vector."""
        means, space = self.means, self.config.space if probing else "l2"

        @F.pandas_udf("array<int>")
        def of(vectors: pd.Series) -> pd.Series:
            out = []
            for i in range(0, len(vectors), 4096):
                d = _distances(np.stack(vectors.iloc[i : i + 4096].to_list()), means, space)
                out += list((d.argmin(1)[:, None] if n == 1 else np.argsort(d, axis=1, kind="stable")[:, :n]).astype(np.int32))
            return pd.Series(out, dtype=object)

        return of

    def probes(self, queries: DataFrame, ef_search: int | None = None) -> DataFrame:
        """(query_id, vec, cell, place): the cells that each query probes, nearest first from 1."""
        ef = ef_search or self.config.ef_search
        if ef < 1:
            raise ValueError("ef_search must be greater than 0")
        asked = R.usable(queries.select("query_id", vector.doubles(F.col("vec")).alias("vec")), "vec")
        if not len(self.means):
            return asked.select("query_id", "vec", F.lit(0).alias("cell"), F.lit(1).alias("place")).limit(0)
        if wrong := asked.where(F.size("vec") != self.config.dim).select(F.size("vec").alias("n")).first():
            raise ValueError(f"queries of {wrong.n} numbers, vectors of {self.config.dim}")
        near = asked.withColumn("near", self._nearest(min(ef, len(self.means)), True)(_prepared(F.col("vec"), self.config.space)))
        return near.select("query_id", "vec", F.posexplode("near").alias("place", "cell")).withColumn("place", F.col("place") + 1)

    def _by_cell(self, probes: DataFrame, k: int) -> DataFrame:
        """The k best rows of each probed cell, from these cells' partitions only."""
        cells = sorted(r.cell for r in probes.select("cell").distinct().collect())  # as many as there are cells, at most
        rows = self.rows.where(F.col("cell").isin(cells))
        key = F.col("cell").cast("string").alias("cell")
        found = R.top_k(probes.select("query_id", "vec", key), rows.select("doc_id", "vec", key), k, self.config.space, by="cell")
        return found.drop("rank").withColumn("cell", F.col("cell").cast("int"))

    def search(self, queries: DataFrame, k: int = 5, ef_search: int | None = None) -> DataFrame:
        """(query_id, rank, doc_id, score) for queries (query_id, vec)."""
        probes = materialize(self.probes(queries, ef_search), "probes")
        return R.ranked(self._by_cell(probes, k), k, R.MEASURES[self.config.space])

    def search_records(self, queries: DataFrame, k: int = 5, ef_search: int | None = None) -> DataFrame:
        """search(), with the columns of the found rows' chunk records."""
        if self.chunks is None:
            raise ValueError("the index has no chunk records")
        probes = materialize(self.probes(queries, ef_search), "probes")
        found = self._by_cell(probes, k)
        best = materialize(R.ranked(found, k, R.MEASURES[self.config.space]).join(found.select("query_id", "doc_id", "cell"), ["query_id", "doc_id"]), "best")
        cells = sorted(r.cell for r in best.select("cell").distinct().collect())
        return best.join(self.chunks.where(F.col("cell").isin(cells)), ["cell", "doc_id"]).drop("cell")

    def sweep(self, queries: DataFrame, k: int, widths: list[int]) -> DataFrame:
        """(ef_search, query_id, rank, doc_id, score): searches of several widths, whose cells are scored once."""
        probes = materialize(self.probes(queries, max(widths)), "probes")
        found = self._by_cell(probes, k).join(probes.select("query_id", "cell", "place"), ["query_id", "cell"])
        each = found.withColumn("ef_search", F.explode(F.array(*map(F.lit, widths)))).where("place <= ef_search")
        return R.ranked(each, k, R.MEASURES[self.config.space], "ef_search", "query_id")

    def scored(self, queries: DataFrame, widths: list[int]) -> DataFrame:
        """(ef_search, query_id, scored): how many rows a search of each width looks at."""
        sizes = self.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("size"))
        probes = self.probes(queries, max(widths)).drop("vec").join(sizes, "cell", "left")
        each = probes.withColumn("ef_search", F.explode(F.array(*map(F.lit, widths)))).where("place <= ef_search")
        return each.groupBy("ef_search", "query_id").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("scored"))

    # -- files

    def save(self, folder: str) -> str:
        """Write a new version below a folder, delete those before it, and return its path."""
        spark = self.rows.sparkSession
        before = _versions(spark, folder)
        number = max((int(p.rsplit("/v", 1)[1].split("-")[0]) for p in before), default=0) + 1
        path = f"{folder.rstrip('/')}/v{number:08d}-{uuid.uuid4().hex}"
        tables = {"vectors": self.rows} | ({"chunks": self.chunks} if self.chunks is not None else {})
        # a file holds a cell, or a part of one should the largest have over FILE_ROWS rows
        parts = -(-(self.rows.groupBy("cell").count().agg(F.max("count")).first()[0] or 1) // FILE_ROWS)
        part = F.pmod(F.xxhash64("doc_id"), F.lit(parts))
        for name, rows in tables.items():
            rows.repartition("cell", part).write.partitionBy("cell").parquet(f"{path}/{name}")
        means = [(i, [float(x) for x in m]) for i, m in enumerate(self.means)]
        spark.createDataFrame(means, "cell int, mean array<double>").coalesce(1).write.parquet(f"{path}/means")
        counts = {f"{name}_rows": spark.read.schema(rows.schema).parquet(f"{path}/{name}").count() for name, rows in tables.items()}
        told = asdict(self.config) | {"format": FORMAT, "has_chunks": self.chunks is not None, "vectors_rows": 0, "chunks_rows": 0} | counts
        spark.createDataFrame([tuple(told.values())], _MANIFEST).coalesce(1).write.json(f"{path}/manifest")
        for old in before:
            _delete(spark, old)
        return path

    @classmethod
    def load(cls, spark: SparkSession, folder: str, dim: int | None = None, space: str | None = None, ef_search: int | None = None) -> CellIndex:
        """The latest version that was written whole; what is asked for must be what its manifest says."""
        found = [p for p in _versions(spark, folder) if _exists(spark, f"{p}/manifest/_SUCCESS")]
        if not found:
            raise ValueError(f"no index in {folder}")
        path = max(found)
        told = spark.read.schema(_MANIFEST).json(f"{path}/manifest").first().asDict()
        if told["format"] != FORMAT:
            raise ValueError(f"an index of format {told['format']}")
        for name, want in (("dim", dim), ("space", space)):
            if want is not None and told[name] != want:
                raise ValueError(f"an index with {name} {told[name]}, not {want}")
        config = CellConfig(**{k: told[k] for k in CellConfig.__dataclass_fields__})
        tables = {"vectors": "doc_id long, vec array<double>, cell int"} if told["vectors_rows"] else {}
        tables |= {"chunks": None} if told["chunks_rows"] else {}
        read = {n: (spark.read.schema(s) if s else spark.read).parquet(f"{path}/{n}") for n, s in tables.items()}
        for name, rows in read.items():
            if (n := rows.count()) != told[f"{name}_rows"]:
                raise ValueError(f"{n} rows in {name}, {told[f'{name}_rows']} were written")
        means = np.array([r["mean"] for r in spark.read.parquet(f"{path}/means").orderBy("cell").collect()], float)
        rows = read.get("vectors", spark.createDataFrame([], "doc_id long, vec array<double>, cell int"))
        return cls(config if ef_search is None else replace(config, ef_search=ef_search), means, rows, read.get("chunks"))


_MANIFEST = "dim int, space string, cells int, rounds int, ef_search int, seed int, sample_rows int, format int, has_chunks boolean, vectors_rows long, chunks_rows long"


def _versions(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the versions below a folder, in order."""
    top, fs = _at(spark, folder)
    if not fs.exists(top):
        return []
    return sorted(str(s.getPath()) for s in fs.listStatus(top) if s.isDirectory() and s.getPath().getName().startswith("v"))


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _at(spark, path)
    return fs.exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    p, fs = _at(spark, path)
    fs.delete(p, True)


def evaluate(index: CellIndex, queries: DataFrame, widths: list[int]) -> DataFrame:
    """A row for each width: how far its lists agree with exact search, how many rows it looks at, and how many fewer these are."""
    from murmura.operators.experiments import agreement

    exact = R.top_k(queries, index.rows, 10, index.config.space)
    found = index.sweep(queries, 10, widths).withColumn("variant", F.col("ef_search").cast("string"))
    looked = index.scored(queries, widths).groupBy("ef_search").agg(F.avg("scored").alias("mean_scored"))
    rows = agreement(exact, found).withColumn("ef_search", F.col("variant").cast("int")).drop("variant")
    n = index.rows.count()
    return rows.join(looked, "ef_search").select("ef_search", *[f"recall_at_{k}" for k in (1, 3, 5, 10)], "mrr_at_5", F.col("recall_at_5").alias("overlap_at_5"), "mean_scored", F.try_divide(F.lit(float(n)), F.col("mean_scored")).alias("speedup_ratio"))
