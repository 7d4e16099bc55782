"""The approximate index: recall, exactness at full width, files that are pruned, checked and replaced, odd rows."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmura.operators import cells as I
from murmura.operators import retrieval as R
from murmura.session import scratch_folder

INF = float("inf")


def vectors(spark, n=300, dim=8, seed=1, extra=()):
    r = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in r.normal(size=dim)]) for i in range(n)]
    return spark.createDataFrame([*rows, *extra], "doc_id long, vec array<double>")


def asked(docs):
    return docs.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")


def listed(df):
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in df.collect())


def brute(v, q, k, space):
    score = {"cosine": lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b), "ip": lambda a, b: a @ b, "l2": lambda a, b: ((a - b) ** 2).sum()}[space]
    sign = 1 if space == "l2" else -1
    found = sorted((round(sign * score(v[q], x), 9), i) for i, x in v.items())[:k]
    return [(q, n, i, round(sign * s, 6) + 0.0) for n, (s, i) in enumerate(found, 1)]


@pytest.mark.parametrize("space", ["cosine", "ip", "l2"])
def test_recall_rises_with_width_and_all_cells_are_exact(spark, space):
    docs = vectors(spark)
    index = I.CellIndex.build(docs, I.CellConfig(space=space, cells=20, ef_search=10), "doc_id")
    v = {r.doc_id: np.array(r.vec) for r in docs.collect()}
    exact = sorted(x for q in range(0, 300, 20) for x in brute(v, q, 5, space))
    assert listed(index.search(asked(docs), 5, 20)) == exact == listed(R.top_k(asked(docs), docs, 5, space))
    rows = {r.ef_search: r for r in I.evaluate(index, asked(docs), [1, 5, 10, 20]).collect()}
    recalls = [rows[w].recall_at_5 for w in (1, 5, 10, 20)]
    assert recalls == sorted(recalls) and recalls[2] > 0.7 and recalls[3] == pytest.approx(1) and rows[1].mean_scored < rows[20].mean_scored == 300
    assert listed(index.search(asked(docs), 5)) == listed(index.sweep(asked(docs), 5, [10]))


def test_default_reaches_nine_tenths(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    index = I.CellIndex.build(docs, I.CellConfig(dim=64), "doc_id")
    row = I.evaluate(index, asked(docs), [index.config.ef_search]).first()
    assert min(row.recall_at_1, row.recall_at_3, row.recall_at_5, row.recall_at_10) > 0.9 and row.speedup_ratio > 1.8


def test_means_are_those_of_plain_loops(spark):
    docs = vectors(spark, 60, 3)
    index = I.CellIndex.build(docs, I.CellConfig(space="l2", cells=4, rounds=2, sample_rows=40), "doc_id")
    import hashlib

    rows = sorted((hashlib.md5(f"42|{r.doc_id}".encode()).hexdigest(), r.vec) for r in docs.collect())[:40]
    means = [list(x) for _, x in rows[:4]]
    near = lambda x: min(range(4), key=lambda k: (round(sum((a - b) ** 2 for a, b in zip(x, means[k])), 9), k))
    for _ in range(2):
        groups = [[x for _, x in rows if near(x) == k] for k in range(4)]
        means = [[sum(c) / len(g) for c in zip(*g)] if g else m for g, m in zip(groups, means)]
    assert np.allclose(index.means, means)
    assert {r.doc_id: r.cell for r in index.rows.collect()} == {r.doc_id: near(r.vec) for r in docs.collect()}


def test_odd_rows(spark):
    odd = [(900, None), (901, [None] * 8), (902, [float("nan")] * 8), (903, [INF] * 8), (904, [0.0] * 8)]
    docs = vectors(spark, 40, extra=odd)
    index = I.CellIndex.build(docs, I.CellConfig(cells=4), "doc_id")
    assert {r.doc_id for r in index.rows.collect()} == {*range(40), 904}
    queries = docs.where("doc_id >= 900 OR doc_id = 0").withColumnRenamed("doc_id", "query_id")
    found = index.search(queries, 100).collect()
    assert {r.query_id for r in found} == {0, 904} and {r.doc_id for r in R.top_k(queries, docs, 100).collect()} == {*range(40), 904}
    empty = I.CellIndex.build(docs.limit(0), I.CellConfig(), "doc_id")
    assert empty.search(queries, 5).count() == 0
    empty.save(folder := scratch_folder(spark, "empty"))
    assert I.CellIndex.load(spark, folder).search(queries, 5).count() == 0


def test_ids_default_to_row_numbers(spark):
    docs = vectors(spark, 50).orderBy("doc_id").coalesce(1)
    index = I.CellIndex.build(docs.drop("doc_id"), I.CellConfig(cells=4))
    assert {r.doc_id: r.vec for r in index.rows.collect()} == {r.doc_id: r.vec for r in docs.collect()}


def test_parameters_are_checked(spark):
    for wrong in ({"space": "x"}, {"dim": 0}, {"cells": 0}, {"rounds": 0}, {"ef_search": 0}, {"sample_rows": -1}):
        with pytest.raises(ValueError):
            I.CellConfig(**wrong)
    docs = vectors(spark, 30)
    with pytest.raises(ValueError):
        I.CellIndex.build(docs, I.CellConfig(dim=9), "doc_id")
    with pytest.raises(ValueError):
        I.CellIndex.build(vectors(spark, 3, extra=[(9, [1.0])]), I.CellConfig(), "doc_id")
    index = I.CellIndex.build(docs, I.CellConfig(cells=3), "doc_id")
    for wrong in (lambda: index.search(docs.selectExpr("doc_id AS query_id", "slice(vec, 1, 3) AS vec")), lambda: index.search(asked(docs), 0), lambda: index.search_records(asked(docs)), lambda: index.probes(asked(docs), -1)):
        with pytest.raises(ValueError):
            wrong()
    assert I.ef_values([32, 16, 32], 64) == [16, 32, 64] and I.ef_values([64], 64) == [64]


def test_files_are_pruned_checked_and_replaced(spark):
    docs = vectors(spark)
    records = docs.select("doc_id", F.concat(F.lit("f"), "doc_id").alias("filename"), F.lit(0).alias("chunk_id"))
    index = I.CellIndex.build(docs, I.CellConfig(cells=12, ef_search=3), "doc_id", chunks=records)
    folder = scratch_folder(spark, "files")
    first = index.save(folder)
    again = I.CellIndex.load(spark, folder, dim=8, space="cosine")
    assert listed(again.search(asked(docs), 5)) == listed(index.search(asked(docs), 5)) and np.array_equal(again.means, index.means)
    one = docs.where("doc_id = 20").withColumnRenamed("doc_id", "query_id")
    probed = [r.cell for r in again.probes(one).collect()]
    plan = again.rows.where(F.col("cell").isin(probed))
    assert re.search(r"PartitionFilters: \[cell#\d+ IN", plan._jdf.queryExecution().toString()) and plan.select(F.input_file_name()).distinct().count() <= len(probed) == 3 < len(again.rows.inputFiles())
    found = again.search_records(one, 5).collect()
    assert len(found) == 5 and all(r.filename == f"f{r.doc_id}" for r in found)
    second = index.save(folder)
    assert second != first and I._versions(spark, folder) == [p for p in I._versions(spark, folder) if p.endswith(second.rsplit("/", 1)[1])]
    for wrong in ({"dim": 9}, {"space": "l2"}):
        with pytest.raises(ValueError):
            I.CellIndex.load(spark, folder, **wrong)
    I._delete(spark, f"{second}/vectors/cell={probed[0]}")
    with pytest.raises(ValueError, match="were written"):
        I.CellIndex.load(spark, folder)
    I._delete(spark, f"{second}/manifest")
    with pytest.raises(ValueError, match="no index"):
        I.CellIndex.load(spark, folder)
