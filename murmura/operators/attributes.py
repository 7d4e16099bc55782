"""Attribute inference: out-of-fold attacks on protected vectors, and their report rows."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.operators import security as X
from murmura.session import materialize

MACRO = ("macro_f1", "macro_precision", "macro_recall")


def attack(rows: DataFrame, folds: int = 5, seed: int = 2028, rounds: int = 100) -> DataFrame:
    """(row_id, fold, label, score, prediction) for rows (row_id, label 0/1, vec).

    A fold's rows are scored by a balanced logistic fit of standardised vectors of the other folds, which
    are dealt class by class; the attack never sees a label of the fold.
    """
    if folds < 2:
        raise ValueError("at least two folds are needed")
    dealt = X.stratified_folds(rows.select("row_id", "label", array_to_vector(F.col("vec").cast("array<double>")).alias("raw")), "row_id", "label", folds, seed)
    dealt = materialize(dealt.select("row_id", "label", "raw", "fold"), "folds")
    sizes = {(r["fold"], r["label"]): r["count"] for r in dealt.groupBy("fold", "label").count().collect()}  # two rows a fold
    whole = [sum(n for (_, own), n in sizes.items() if own == label) for label in (0, 1)]
    if min(whole) < folds:
        raise ValueError("each class needs as many rows as there are folds")

    def scored(fold: int) -> DataFrame:
        train = dealt.where(F.col("fold") != fold)
        scaler = StandardScaler(withMean=True, inputCol="raw", outputCol="features").fit(train)
        n = [whole[label] - sizes.get((fold, label), 0) for label in (0, 1)]
        weight = F.when(F.col("label") == 1, sum(n) / (2 * n[1])).otherwise(sum(n) / (2 * n[0]))
        model = LogisticRegression(weightCol="weight", regParam=1 / sum(n), maxIter=rounds).fit(scaler.transform(train).withColumn("weight", weight))
        part = scaler.transform(dealt.where(F.col("fold") == fold)).withColumn("score", X.logistic(vector_to_array("features"), model))
        return part.select("row_id", "fold", "label", "score", (F.col("score") > 0.5).cast("int").alias("prediction"))

    with ThreadPoolExecutor(folds) as pool:  # the folds' fits don't wait for each other
        parts = list(pool.map(inheritable_thread_target(rows.sparkSession)(scored), range(folds)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return materialize(out, "attack")


def report(scored: DataFrame, limit: float = 0.01) -> DataFrame:
    """One row for scored rows of attack(): pooled rates, their means and deviations over the folds, and sizes.

    low_resolution: fewer negatives than a false alarm rate of `limit` can tell apart.
    """
    counts = scored.agg(F.count(F.lit(1)).alias("rows"), F.sum("label").alias("positives"), F.sum(1 - F.col("label")).alias("negatives"), F.countDistinct("fold").alias("folds"))
    named = [F.col("auc").alias("roc_auc"), F.col("tpr").alias("tpr_at_fpr_1pct")]
    pooled = X.rates(scored, limit).select(*named).join(X.classification(scored).select(*MACRO))  # single rows
    folds = X.rates(scored, limit, "fold").select("fold", *named).join(X.classification(scored, "fold").select("fold", *MACRO), "fold")
    names = ["roc_auc", "tpr_at_fpr_1pct", *MACRO]
    over = folds.agg(*[f(n).alias(f"{n}_fold_{kind}") for n in names for kind, f in (("mean", F.avg), ("std", F.stddev_pop))])
    return pooled.join(over).join(counts).withColumn("low_resolution", F.col("negatives") < round(1 / limit))
