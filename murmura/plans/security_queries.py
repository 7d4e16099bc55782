"""Attack metrics, grids and rewards over the labels, documents, embeddings and events tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmura.functions import sensitivity, vector as V
from murmura.operators import attributes as A
from murmura.operators import experiments as E
from murmura.operators import grids as G
from murmura.operators import retrieval as R
from murmura.operators import security as X
from murmura.plans.builder import Registry
from murmura.session import materialize, ship, table

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles

_ROWS = "WITH r AS (SELECT l.doc_id, quality AS label, round((d.n_chars % 97) / 97.0::DOUBLE + quality * 0.2::DOUBLE, 6) AS score, CASE WHEN (d.n_chars % 97) > 48 THEN 1 ELSE 0 END AS prediction, lang FROM labels l JOIN documents d USING (doc_id))"
_ROC = f"{_ROWS}, c AS (SELECT score, sum(label)::DOUBLE AS p, sum(1 - label)::DOUBLE AS n FROM r GROUP BY score), o AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp, sum(p) OVER () AS pos, sum(n) OVER () AS neg FROM c)"


def _scored(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    rest = F.col("n_chars") % 97
    score = F.round(rest / F.lit(97.0) + F.col("quality") * F.lit(0.2), 6)
    return table(spark, sf, "labels").join(docs, "doc_id").select("doc_id", F.col("quality").alias("label"), score.alias("score"), F.when(rest > 48, 1).otherwise(0).alias("prediction"), "lang")


@_R.add("sec7_auc", f"{_ROWS}, k AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS k FROM r) SELECT round((sum(CASE WHEN label = 1 THEN k END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * sum(1 - label)::DOUBLE), 6) AS auc FROM k")
def sec_auc(spark, sf):
    return X.auc(_scored(spark, sf)).select(F.round("auc", 6).alias("auc"))


@_R.add("sec7_auc_by_lang", f"{_ROWS}, k AS (SELECT lang, label, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0::DOUBLE AS k FROM r) SELECT lang, round((sum(CASE WHEN label = 1 THEN k END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * sum(1 - label)::DOUBLE), 6) AS auc FROM k GROUP BY lang")
def sec_auc_lang(spark, sf):
    return X.auc(_scored(spark, sf), "lang").select("lang", F.round("auc", 6).alias("auc"))


@_R.add("sec8_sec12_rates", f"{_ROC} SELECT round(max(CASE WHEN fp <= 0.1 * neg THEN tp / pos ELSE 0 END), 6) AS tpr, round(greatest(max(tp / pos - fp / neg), 0), 6) AS advantage, any_value(neg) < 10 AS low_resolution FROM o")
def sec_rates(spark, sf):
    found = X.rates(_scored(spark, sf), 0.1)
    return found.select(F.round("tpr", 6).alias("tpr"), F.round("advantage", 6).alias("advantage"), (F.col("negatives") < round(1 / 0.1)).alias("low_resolution"))


@_R.add("sec9_classification", f"""{_ROWS}, c AS (SELECT sum((label = 1 AND prediction = 1)::INT)::DOUBLE AS tp, sum((label = 0 AND prediction = 1)::INT)::DOUBLE AS fp, sum((label = 1 AND prediction = 0)::INT)::DOUBLE AS fn, sum((label = 0 AND prediction = 0)::INT)::DOUBLE AS tn FROM r),
s AS (SELECT tp / (tp + fp) AS p1, tp / (tp + fn) AS r1, tn / (tn + fn) AS p0, tn / (tn + fp) AS r0 FROM c)
SELECT round((2 * p1 * r1 / (p1 + r1) + 2 * p0 * r0 / (p0 + r0)) / 2, 6) AS macro_f1, round((p1 + p0) / 2, 6) AS macro_precision, round((r1 + r0) / 2, 6) AS macro_recall, round(2 * p1 * r1 / (p1 + r1), 6) AS f1,
  round(p1, 6) AS precision, round(r1, 6) AS recall, round((r1 + r0) / 2, 6) AS balanced_accuracy FROM s""")
def sec_classification(spark, sf):
    out = X.classification(_scored(spark, sf))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@_R.add("sec5_folds", f"{_ROWS} SELECT doc_id, CAST((row_number() OVER (PARTITION BY label ORDER BY md5('2028|' || doc_id), doc_id) - 1) % 5 AS INTEGER) AS fold FROM r")
def sec_folds(spark, sf):
    return X.stratified_folds(_scored(spark, sf), "doc_id", "label", 5, 2028).select("doc_id", "fold")


@_R.add("sec6_sec21_attribute_rows")
def sec_attribute(spark, sf):
    """Whether vectors tell that a document holds an identifier: a row for raw and for noised vectors."""
    ship(spark)
    marked = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), (F.size(sensitivity.entity_types(F.col("text"))) > 0).cast("int").alias("label"))
    marked = materialize(marked, "marked")  # texts are read once
    docs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vec"))
    out = None
    for name, sigma in (("raw", 0.0), ("noised", 0.1 / 8)):
        rows = E.noised(docs, name, F.lit(sigma)).select(F.col("doc_id").alias("row_id"), "vec").join(marked, "row_id")
        row = A.report(A.attack(rows)).select(F.lit(name).alias("scheme"), F.lit("has_any_sensitive").alias("target_attribute"), F.lit(64).alias("vector_dim"), F.lit(2028).alias("attack_seed"), "*")
        out = row if out is None else out.unionByName(row)
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@_R.add("sec13_sec15_disjoint_split", "WITH s AS (SELECT doc_id, CAST(ntile(4) OVER (ORDER BY md5('2030|' || doc_id), doc_id) AS INTEGER) AS grp FROM documents) SELECT grp, count(*) AS documents FROM s GROUP BY grp")
def sec_split(spark, sf):
    return X.disjoint_split(table(spark, sf, "documents").select("doc_id"), "doc_id", 2030).groupBy("grp").agg(F.count(F.lit(1)).alias("documents"))


@_R.add("sec17_density", """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings), p AS (
SELECT q.vec_id AS row_id, d.vec_id AS other, round(list_sum(list_transform(list_zip(q.v, d.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 9) AS d FROM e q JOIN e d ON d.vec_id % 2 = 0 AND d.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d, other) AS k FROM p) SELECT row_id, round(-avg(sqrt(d)), 5) AS score FROM k WHERE k <= 5 GROUP BY row_id""")
def sec_density(spark, sf):
    ship(spark)
    docs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vec"))
    found = R.top_k(docs.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id"), docs.where("doc_id % 2 = 0"), 6, "l2").where("doc_id <> query_id")
    again = R.ranked(found.drop("rank"), 5, False)
    return X.knn_density(again, 5).withColumn("score", F.round("score", 5))


@_R.add("sec17_membership", """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS w FROM embeddings), n AS (SELECT vec_id, list_transform(w, lambda x: x / greatest(sqrt(list_sum(list_transform(w, lambda y: y * y))), 1e-12)) AS v, ntile(4) OVER (ORDER BY md5('2030|' || vec_id), vec_id) AS grp FROM e),
p AS (SELECT q.vec_id, q.grp, d.vec_id AS other, greatest(round(list_sum(list_transform(list_zip(q.v, d.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 9), 0) AS d FROM n q JOIN n d ON d.grp = 3 AND d.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, other) AS k FROM p), z AS (SELECT vec_id, grp, round(-avg(sqrt(d)), 5) AS score FROM k WHERE k <= 5 GROUP BY ALL),
c AS (SELECT score, sum((grp = 3)::INT)::DOUBLE AS p, sum((grp = 4)::INT)::DOUBLE AS n FROM z WHERE grp >= 3 GROUP BY score), o AS (SELECT score, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp, sum(p) OVER () AS pos, sum(n) OVER () AS neg FROM c),
t AS (SELECT score AS threshold FROM o ORDER BY round((tp / pos + 1 - fp / neg) / 2, 12) DESC, score LIMIT 1)
SELECT vec_id AS row_id, ['target_member', 'target_nonmember', 'shadow_member', 'shadow_nonmember'][grp] AS member_of, score, (score >= threshold)::INTEGER AS predicted FROM z, t""")
def sec_membership(spark, sf):
    """Scores of rows whose id 20 divides, of all groups, by distance to the shadow members (group 3); the threshold comes from groups 3 and 4."""
    ship(spark)
    docs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), V.normalize(F.col("embedding").cast("array<double>")).alias("vec"))
    docs = materialize(X.disjoint_split(docs, "doc_id", 2030), "groups")
    asked = docs.where("doc_id % 20 = 0")
    found = R.top_k(asked.select(F.col("doc_id").alias("query_id"), "vec"), docs.where("grp = 3"), 6, "l2").where("doc_id <> query_id")  # only members meet themselves
    scored = X.knn_density(R.ranked(found.drop("rank"), 5, False), 5).join(asked.select(F.col("doc_id").alias("row_id"), "grp"), "row_id").withColumn("score", F.round("score", 5))
    scored = materialize(scored, "scored")
    limit = X.best_threshold(scored.where("grp >= 3").select("score", (F.col("grp") == 3).cast("int").alias("label")))
    return scored.join(F.broadcast(limit.select("threshold")), how="left").select("row_id", F.element_at(F.array(*map(F.lit, X.GROUPS)), F.col("grp")).alias("member_of"), "score", (F.col("score") >= F.col("threshold")).cast("int").alias("predicted"))


@_R.add("sec18_threshold", f"{_ROC} SELECT score AS threshold, round((tp / pos + 1 - fp / neg) / 2, 6) AS balanced_accuracy FROM o ORDER BY round((tp / pos + 1 - fp / neg) / 2, 12) DESC, score LIMIT 1")
def sec_threshold(spark, sf):
    return X.best_threshold(_scored(spark, sf)).withColumn("balanced_accuracy", F.round("balanced_accuracy", 6))


_DRAWN = "(('0x' || substr(md5('2031|boot|' || doc_id || '|' || b), 1, 13))::BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE"
_STEPS = " + ".join(f"(t >= {x!r}::DOUBLE)::INT" for x in X.POISSON)


@_R.add("sec19_bootstrap", f"""{_ROWS}, d AS (SELECT b, label, score, {_DRAWN} AS t FROM r, (SELECT unnest(range(1000)) AS b)), w AS (SELECT b, label, score, {_STEPS} AS times FROM d),
c AS (SELECT b, score, sum(label * times)::DOUBLE AS p, sum((1 - label) * times)::DOUBLE AS n FROM w WHERE times > 0 GROUP BY ALL),
o AS (SELECT *, sum(p) OVER (PARTITION BY b ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY b ORDER BY score DESC) AS fp, sum(p) OVER (PARTITION BY b) AS pos, sum(n) OVER (PARTITION BY b) AS neg FROM c),
e AS (SELECT b, sum(n * (tp - p / 2)) / max(pos * neg) AS roc_auc, max(CASE WHEN fp <= 0.01 * neg THEN tp / pos ELSE 0 END) AS tpr_at_fpr, greatest(max(tp / pos - fp / neg), 0) AS attack_advantage FROM o WHERE pos > 0 AND neg > 0 GROUP BY b)
SELECT {', '.join(f"round(quantile_cont({m}, {q}), 6) AS {m}_ci_{side}" for m in ('roc_auc', 'tpr_at_fpr', 'attack_advantage') for side, q in (('low', 0.025), ('high', 0.975)))} FROM e""")
def sec_bootstrap(spark, sf):
    out = X.bootstrap(_scored(spark, sf), "doc_id", 1000, 2031, 0.01)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@_R.add("sec1_sec3_exposure", """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM e),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_sum(list_transform(list_zip(q.v, d.v), lambda x: x[1] * x[2])) / (q.n * d.n), 9) AS c FROM n q, n d WHERE q.vec_id % 20 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, doc_id) AS rank FROM s), f AS (SELECT * FROM t WHERE rank <= 5),
h AS (SELECT q.vec_id AS query_id, f.rank, f.doc_id FROM n q LEFT JOIN f ON f.query_id = q.vec_id AND f.doc_id = q.vec_id WHERE q.vec_id % 20 = 0),
m AS (SELECT q.vec_id, count(f.doc_id) AS n FROM n q LEFT JOIN f ON f.query_id = q.vec_id AND f.doc_id % 3 = 0 WHERE q.vec_id % 20 = 0 GROUP BY ALL)
SELECT round(avg((coalesce(rank, 99) = 1)::INT), 6) AS recall_at_1, round(avg((rank IS NOT NULL)::INT), 6) AS recall_at_5, round(avg(rank), 6) AS mean_rank, count(DISTINCT doc_id) AS distinct_targets, (SELECT round(avg(n), 6) FROM m) AS mean_sensitive FROM h""")
def sec_exposure(spark, sf):
    ship(spark)
    docs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vec"))
    queries = docs.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    out = X.exposure(R.top_k(queries, docs, 5), queries.select("query_id", F.col("query_id").alias("doc_id")), docs.where("doc_id % 3 = 0"))
    return out.select(*[F.round(c, 6).alias(c) if c != "distinct_targets" else F.col(c) for c in out.columns])


_GRID = "WITH g AS (SELECT lang AS scheme, source AS variant, round(avg(n_chars % 100) / 100.0::DOUBLE, 6) AS recall, round(avg(n_chars % 37) / 37.0::DOUBLE, 6) AS mrr, round(avg(n_chars % 11) / 11.0::DOUBLE, 6) AS nsr FROM documents GROUP BY ALL)"


def _grid(spark, sf):
    mean = lambda n: F.round(F.avg(F.col("n_chars") % n) / F.lit(float(n)), 6)
    return table(spark, sf, "documents").groupBy(F.col("lang").alias("scheme"), F.col("source").alias("variant")).agg(mean(100).alias("recall"), mean(37).alias("mrr"), mean(11).alias("nsr"))


@_R.add("grd7_grd11_constrained_best", f"{_GRID}, r AS (SELECT *, NOT (nsr >= 0.45) AS fallback, row_number() OVER (PARTITION BY scheme ORDER BY nsr >= 0.45 DESC, CASE WHEN nsr >= 0.45 THEN recall ELSE nsr END DESC, CASE WHEN nsr >= 0.45 THEN mrr ELSE recall END DESC, mrr, nsr, recall, scheme, variant) AS n FROM g) SELECT scheme, variant, recall, mrr, nsr, fallback FROM r WHERE n = 1")
def grd_best(spark, sf):
    return G.constrained_best(_grid(spark, sf), "nsr", 0.45, by=("scheme",))


@_R.add("grd10_nearest_row", f"{_GRID}, r AS (SELECT *, row_number() OVER (PARTITION BY scheme ORDER BY abs(recall - 0.5), recall) AS n FROM g) SELECT scheme, round(recall, 6) AS recall FROM r WHERE n = 1")
def grd_nearest(spark, sf):
    return G.nearest_row(_grid(spark, sf), "recall", 0.5, "scheme").select("scheme", "recall")


@_R.add("grd12_heat_map", f"{_GRID} SELECT variant, max(CASE WHEN scheme = 'en' THEN recall END) AS en, max(CASE WHEN scheme = 'de' THEN recall END) AS de, max(CASE WHEN scheme = 'fr' THEN recall END) AS fr, max(CASE WHEN scheme = 'es' THEN recall END) AS es FROM g GROUP BY variant")
def grd_heat(spark, sf):
    return G.heat_map(_grid(spark, sf), "variant", "scheme", "recall", ["en", "de", "fr", "es"])


@_R.add("snk4_union_rows", f"{_GRID} SELECT NULL::DOUBLE AS dp_loss, mrr, nsr, recall, scheme, variant FROM g UNION ALL SELECT round(1 - recall, 6), NULL, NULL, NULL, scheme, variant FROM g")
def snk_union(spark, sf):
    g = _grid(spark, sf)
    return G.union_rows(g, g.select("scheme", "variant", F.round(1 - F.col("recall"), 6).alias("dp_loss")))


_SIMS = "WITH s AS (SELECT vec_id // 50 AS round, label AS node, avg(embedding[1])::DOUBLE AS sim FROM embeddings GROUP BY ALL)"


@_R.add("rwd2_rwd4_payouts", f"""{_SIMS}, t AS (SELECT round, quantile_cont(sim, 0.5) - 0.015 AS threshold FROM s GROUP BY round), x AS (SELECT s.round, node, threshold, CASE WHEN sim < threshold THEN 0 ELSE sim - threshold END AS extra FROM s JOIN t ON s.round = t.round),
p AS (SELECT *, sum(extra) OVER (PARTITION BY round) AS total FROM x), q AS (SELECT round, node, threshold, CASE WHEN total > 0 THEN extra / total * 100 ELSE 0 END AS payout FROM p)
SELECT round, node, round(threshold, 6) AS threshold, round(payout, 6) AS payout, round(sum(payout) OVER (PARTITION BY node ORDER BY round), 5) AS balance FROM q""")
def rwd_payouts(spark, sf):
    sims = table(spark, sf, "embeddings").groupBy(F.floor(F.col("vec_id") / 50).alias("round"), F.col("label").alias("node")).agg(F.avg(F.col("embedding")[0]).alias("sim"))
    out = G.payouts(sims)
    return out.select("round", "node", F.round("threshold", 6).alias("threshold"), F.round("payout", 6).alias("payout"), F.round("balance", 5).alias("balance"))


@_R.add("rwd5_settlement", "WITH t AS (SELECT c_custkey AS node, (c_custkey % 7) / 7.0::DOUBLE AS e FROM customer), s AS (SELECT sum(e) AS total FROM t) SELECT node, CAST(floor(floor(e * 10000)::BIGINT * 1000000 / floor(round(total, 6) * 10000)::BIGINT) AS BIGINT) AS paid FROM t, s")
def rwd_settlement(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("node"), ((F.col("c_custkey") % 7) / F.lit(7.0)).alias("e"))
    total = rows.agg(F.round(F.sum("e"), 6).alias("total"))
    return rows.join(total).select("node", G.settled(F.col("e"), F.lit(1_000_000), F.col("total")).alias("paid"))  # one total
