"""Attack metrics as aggregations of scored rows (label 0/1, score, prediction)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmura.functions import randomness, vector
from murmura.operators import ordered
from murmura.session import materialize


def roc(rows: DataFrame, *by: str) -> DataFrame:
    """(by, score, tp, fp, pos, neg) for each distinct score: what predicting 1 from it on gives.

    Rows are added up by score first, so the running sums see distinct scores only.
    """
    label = F.col("label").cast("double")
    counts = rows.groupBy(*by, "score").agg(F.sum(label).alias("p"), F.sum(F.lit(1.0) - label).alias("n"))
    sums = ordered.running_sums(counts, [F.col("score").desc(), *map(F.col, by)], {"tp": F.col("p"), "fp": F.col("n")}, by)
    return _beside(sums, sums.groupBy(*by).agg(F.sum("p").alias("pos"), F.sum("n").alias("neg")), by)


def _beside(rows: DataFrame, totals: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """rows with what totals has for their group (one row a group)."""
    if not by:
        return rows.join(F.broadcast(totals))
    totals = totals.withColumnsRenamed({c: f"t_{c}" for c in by})
    on = [F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in by]  # of any number of groups
    return rows.join(totals, ordered._all(on)).drop(*[f"t_{c}" for c in by])


def _area() -> Column:
    whole = F.max(F.col("pos") * F.col("neg"))
    return F.when(whole > 0, F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2.0)) / whole).otherwise(F.lit(float("nan")))


def _hits(limit: float) -> Column:
    return F.max(F.when(F.col("fp") <= limit * F.col("neg"), F.try_divide("tp", "pos")).otherwise(F.lit(0.0)))


def _gap() -> Column:
    return F.greatest(F.max(F.try_divide("tp", "pos") - F.try_divide("fp", "neg")), F.lit(0.0))


def auc(rows: DataFrame, *by: str) -> DataFrame:
    """(by, auc); equal scores count half, a single class gives NaN."""
    return roc(rows, *by).groupBy(*by).agg(_area().alias("auc"))


def tpr_at_fpr(rows: DataFrame, limit: float, *by: str) -> DataFrame:
    """(by, tpr): the best rate of hits with a false alarm rate up to the limit."""
    return roc(rows, *by).where("pos > 0 AND neg > 0").groupBy(*by).agg(_hits(limit).alias("tpr"))


def advantage(rows: DataFrame, *by: str) -> DataFrame:
    return roc(rows, *by).where("pos > 0 AND neg > 0").groupBy(*by).agg(_gap().alias("advantage"))


def rates(rows: DataFrame, limit: float, *by: str) -> DataFrame:
    """(by, auc, tpr, advantage, negatives) from one curve; without both classes auc is NaN and the others null."""
    both = F.max(F.col("pos") * F.col("neg")) > 0
    return roc(rows, *by).groupBy(*by).agg(_area().alias("auc"), F.when(both, _hits(limit)).alias("tpr"), F.when(both, _gap()).alias("advantage"), F.max("neg").cast("long").alias("negatives"))


def targets(rows: DataFrame, order: list[str], least: int = 1, most: int = 0) -> DataFrame:
    """The rows to be attacked: the first `most` in an order, or all for 0; an error if there are fewer than `least`."""
    if least < 1 or most < 0:
        raise ValueError("least must be positive and most not negative")
    if (n := rows.limit(least).count()) < least:
        raise ValueError(f"{n} sensitive rows; at least {least} are needed")
    return rows.orderBy(*order).limit(most) if most else rows


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def classification(rows: DataFrame, *by: str) -> DataFrame:
    """Macro and binary F1, precision and recall, and balanced accuracy; 0 for what is undefined."""
    n = lambda y, p: F.sum(F.when((F.col("label") == y) & (F.col("prediction") == p), 1.0).otherwise(0.0))
    c = rows.groupBy(*by).agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))
    p1, r1, p0, r0 = (ratio(F.col(a), F.col(a) + F.col(b)) for a, b in (("tp", "fp"), ("tp", "fn"), ("tn", "fn"), ("tn", "fp")))
    f1, f0 = ratio(2 * p1 * r1, p1 + r1), ratio(2 * p0 * r0, p0 + r0)
    return c.select(*by, ((f1 + f0) / 2).alias("macro_f1"), ((p1 + p0) / 2).alias("macro_precision"), ((r1 + r0) / 2).alias("macro_recall"), f1.alias("f1"), p1.alias("precision"), r1.alias("recall"), ((r1 + r0) / 2).alias("balanced_accuracy"))


def best_threshold(rows: DataFrame) -> DataFrame:
    """(threshold, balanced_accuracy): the smallest score with the highest balanced accuracy when predicting 1 from it on."""
    both = (F.col("tp") / F.col("pos") + 1.0 - F.col("fp") / F.col("neg")) / 2.0
    return roc(rows).where("pos > 0 AND neg > 0").select(F.col("score").alias("threshold"), F.round(both, 12).alias("balanced_accuracy")).orderBy(F.col("balanced_accuracy").desc(), "threshold").limit(1)


def stratified_folds(rows: DataFrame, id_col: str, label_col: str, folds: int, seed: int) -> DataFrame:
    """rows with fold: each class is dealt evenly in a hashed order."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")))
    found = ordered.numbered(rows.withColumn("fold_key", key), [F.col("fold_key"), F.col(id_col)], "fold_no", (label_col,))
    return found.withColumn("fold", ((F.col("fold_no") - 1) % folds).cast("int")).drop("fold_key", "fold_no")


def exposure(found: DataFrame, targets: DataFrame, sensitive: DataFrame) -> DataFrame:
    """One row on lists (query_id, rank, doc_id), targets (query_id, doc_id) and sensitive ids (doc_id)."""
    top = found.where("rank <= 5")
    hit = targets.join(top.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left")
    a = hit.agg(F.avg((F.coalesce("rank", F.lit(99)) == 1).cast("double")).alias("recall_at_1"), F.avg(F.col("rank").isNotNull().cast("double")).alias("recall_at_5"), F.avg("rank").alias("mean_rank"), F.countDistinct(F.when(F.col("rank").isNotNull(), F.col("doc_id"))).alias("distinct_targets"))
    n = top.join(sensitive.select("doc_id"), "doc_id", "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    b = targets.select("query_id").distinct().join(n, "query_id", "left").agg(F.avg(F.coalesce("n", F.lit(0))).alias("mean_sensitive"))
    return a.join(b)  # single rows


def knn_density(neighbours: DataFrame, k: int) -> DataFrame:
    """(row_id, score): minus the mean distance to k nearest; neighbours: (query_id, rank, score = squared distance)."""
    return neighbours.where(F.col("rank") <= k).groupBy(F.col("query_id").alias("row_id")).agg((-F.avg(F.sqrt("score"))).alias("score"))


#: Where the distribution of Poisson(1) reaches 0, 1, ...
POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(6)]


def _drawn(rows: DataFrame, id_col: str, resamples: int, seed: int) -> DataFrame:
    """(b, label, score, times) of the rows that resample b has, dealt to all cores as they become many.

    Draws are made inside the array that is taken apart, once each: a filter on a drawn column would draw
    anew for each of its steps.
    """
    draws = F.transform(F.sequence(F.lit(0), F.lit(resamples - 1)), lambda b: F.struct(b.alias("b"), randomness.uniform(seed, "boot", F.col(id_col), b).alias("u")))
    times = sum((F.when(F.col("u") >= s, 1).otherwise(0) for s in POISSON), F.lit(0))
    dealt = rows.select(id_col, "label", "score").repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, id_col)
    return dealt.select("label", "score", F.inline(draws)).where(F.col("u") >= POISSON[0]).select("b", "label", "score", times.alias("times"))


def bootstrap(rows: DataFrame, id_col: str, resamples: int, seed: int, limit: float) -> DataFrame:
    """One row: percentiles 2.5 and 97.5 of AUC, TPR at a false alarm rate up to limit, and advantage over stratified resamples, drawn by hash.

    Each row is drawn a Poisson(1) number of times, so no resample needs the table's size; rows are
    added up by (resample, score) before anything is sorted.
    """
    drawn = _drawn(rows, id_col, resamples, seed)
    label, times = F.col("label").cast("double"), F.col("times").cast("double")
    counts = drawn.groupBy("b", "score").agg(F.sum(label * times).alias("p"), F.sum((F.lit(1.0) - label) * times).alias("n"))
    sums = ordered.running_sums(counts, [F.col("b"), F.col("score").desc()], {"tp": F.col("p"), "fp": F.col("n")}, ("b",))
    curve = sums.join(sums.groupBy("b").agg(F.sum("p").alias("pos"), F.sum("n").alias("neg")), "b")
    hits, alarms = F.col("tp") / F.col("pos"), F.col("fp") / F.col("neg")
    each = curve.where("pos > 0 AND neg > 0").groupBy("b").agg(
        (F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2.0)) / F.max(F.col("pos") * F.col("neg"))).alias("roc_auc"),
        F.max(F.when(F.col("fp") <= limit * F.col("neg"), hits).otherwise(F.lit(0.0))).alias("tpr_at_fpr"),
        F.greatest(F.max(hits - alarms), F.lit(0.0)).alias("attack_advantage"),
    )
    return each.agg(*[F.percentile(m, p).alias(f"{m}_ci_{side}") for m in ("roc_auc", "tpr_at_fpr", "attack_advantage") for side, p in (("low", 0.025), ("high", 0.975))])


#: What the groups of disjoint_split stand for, from 1 on.
GROUPS = ("target_member", "target_nonmember", "shadow_member", "shadow_nonmember")


def disjoint_split(docs: DataFrame, name_col: str, seed: int, groups: int = 4) -> DataFrame:
    """docs with grp 1 to groups, of sizes that differ by one at most; with fewer documents than groups an error."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(name_col).cast("string")))
    found = ordered.numbered(docs.withColumn("split_key", key), [F.col("split_key"), F.col(name_col)], "split_no")
    n = docs.count()
    if n < groups:
        raise ValueError(f"a split needs at least {groups} source documents")
    size, more = divmod(n, groups)
    at, long = F.col("split_no") - 1, (size + 1) * more
    grp = F.when(at < long, F.floor(at / (size + 1))).otherwise(more + F.floor((at - long) / size)) + 1
    return found.withColumn("grp", grp.cast("int")).drop("split_key", "split_no")


def cyclic_split(docs: DataFrame, name_col: str, size_col: str, seed: int, cap: int, groups: int = 4) -> DataFrame:
    """docs with grp 1 to groups and taken: of its chunks (size_col), those that fit until the group has cap of them.

    Documents in a hashed order are dealt in cycles, each cycle in its own hashed order; a group that
    can't be filled is an error.
    """
    hashed = lambda salt: F.md5(F.concat_ws("|", F.lit(f"{seed}{salt}"), F.col(name_col).cast("string")))
    found = ordered.numbered(docs.withColumn("split_key", hashed("")), [F.col("split_key"), F.col(name_col)], "split_no")
    found = found.withColumn("cycle", F.floor((F.col("split_no") - 1) / groups))
    in_cycle = Window.partitionBy("cycle").orderBy(hashed("c"), name_col)  # at most `groups` rows each
    found = found.withColumn("grp", F.row_number().over(in_cycle))
    found = ordered.running_sums(found, [F.col("split_no")], {"upto": F.col(size_col).cast("long")}, ("grp",))
    before = F.col("upto") - F.col(size_col)
    out = found.withColumn("taken", F.least(F.col(size_col).cast("long"), F.greatest(F.lit(0), cap - before))).where("taken > 0")
    out = materialize(out.drop("split_key", "split_no", "cycle", "upto"), "split")
    if out.groupBy("grp").agg(F.sum("taken").alias("n")).where(F.col("n") >= cap).count() < groups:
        raise ValueError(f"the documents don't give {groups} groups of {cap} chunks")
    return out


def overlapping(rows: DataFrame, name_col: str) -> DataFrame:
    """Names that lie in several groups: none, if a split is disjoint."""
    return rows.groupBy(name_col).agg(F.countDistinct("grp").alias("groups")).where("groups > 1")


def linkage_metrics(found: DataFrame, sensitive: DataFrame) -> DataFrame:
    """One row on ranked lists (query_id, rank, doc_id) whose target is the query's own id: top-1, recall at 5 and MRR, for all and for sensitive queries (doc_id)."""
    hit = found.groupBy("query_id").agg(F.min(F.when((F.col("doc_id") == F.col("query_id")) & (F.col("rank") <= 5), F.col("rank"))).alias("rank"))
    marked = hit.join(sensitive.select(F.col("doc_id").alias("query_id"), F.lit(True).alias("sensitive")), "query_id", "left")
    nan = F.lit(float("nan"))
    out = []
    for name, ok in (("", F.lit(True)), ("sensitive_", F.coalesce("sensitive", F.lit(False)))):
        mean = lambda x: F.coalesce(F.avg(F.when(ok, x)), nan)  # noqa: B023, E731
        out += [mean((F.coalesce("rank", F.lit(99)) == 1).cast("double")).alias(f"{name}top1"), mean(F.col("rank").isNotNull().cast("double")).alias(f"{name}recall_at_5"), mean(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias(f"{name}mrr_at_5")]
    return marked.agg(*out)


def logistic(features: Column, model) -> Column:
    """The probability of 1 that a binary fit gives an array of features, by its coefficients.

    A fitted model carries the summary of its training and by it the session, which tasks can't be
    sent once it has observed counts; its coefficients can.
    """
    return 1 / (1 + F.exp(-(vector.dot(features, F.array(*[F.lit(float(x)) for x in model.coefficients])) + F.lit(float(model.intercept)))))


def shadow_attack(shadow: DataFrame, targets: DataFrame, vec: str = "vec", limit: float = 0.5) -> DataFrame:
    """targets with score and prediction of a balanced logistic fit on shadow rows (label, vec) only."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    raw = array_to_vector(F.col(vec).cast("array<double>"))
    train = materialize(shadow.select("label", F.col(vec)), "shadow").withColumn("raw", raw)
    counts = train.groupBy("label").count().collect()  # two rows
    total = sum(r["count"] for r in counts)
    weight = F.coalesce(*[F.when(F.col("label") == r["label"], F.lit(total / (len(counts) * r["count"]))) for r in counts], F.lit(1.0))
    scaler = StandardScaler(withMean=True, inputCol="raw", outputCol="features").fit(train)
    model = LogisticRegression(weightCol="weight", regParam=1 / max(1, total), maxIter=100).fit(scaler.transform(train).withColumn("weight", weight))
    out = scaler.transform(targets.withColumn("raw", raw)).withColumn("score", logistic(vector_to_array("features"), model))
    return out.select(*targets.columns, "score", (F.col("score") >= limit).cast("int").alias("prediction"))


def fold_summary(rows: DataFrame, values: list[str]) -> DataFrame:
    """One row: mean and population deviation of each value over folds, without NaN."""
    ok = lambda c: F.when(~F.isnan(c), F.col(c))
    return rows.agg(*[f(ok(c)).alias(f"{c}_{n}") for c in values for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
