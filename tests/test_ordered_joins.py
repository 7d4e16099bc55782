"""As-of joins, mergeable summaries, subtotals, attribute attacks, generated queries and prompts against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmura.operators import attributes as A
from murmura.operators import chunking as C
from murmura.operators import grids as G
from murmura.operators import summaries as Y
from murmura.operators.asof import as_of


def brute_as_of(left, right, strict):
    out = []
    for row in left:
        k, t = row[1], row[2]
        found = [(r[1], r[2]) for r in right if k is not None and t is not None and r[0] == k and r[1] is not None and (r[1] < t if strict else r[1] <= t)]
        out.append((*row, max(found)[1] if found else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("strict", [False, True])
def test_as_of_join_with_a_hot_key(spark, strict):
    r = random.Random(5)
    key = lambda: r.choice(["hot"] * 6 + ["a", "b", None])
    left = [(i, key(), r.choice([None, *range(300)])) for i in range(400)] + [(0, "hot", 7), (0, "hot", 7)]
    right = [(key(), r.choice([None, *range(0, 300, 7)]), i) for i in range(120)] + [("hot", 5, 999), ("hot", 5, 998)]
    a = spark.createDataFrame(left, "id long, key string, time int")
    b = spark.createDataFrame(right, "key string, time int, value int")
    found = as_of(a, b, "time", "key", ["value"], strict)
    assert found.columns == ["id", "key", "time", "value"]
    assert sorted((tuple(x) for x in found.collect()), key=str) == brute_as_of(left, right, strict)
    assert as_of(a, b.limit(0), "time", "key", ["value"]).where("value IS NOT NULL").count() == 0 and as_of(a.limit(0), b, "time", "key", ["value"]).count() == 0


def test_summaries_merge_within_their_bounds(spark):
    r = np.random.default_rng(6)
    rows = [(int(i % 7), int(i % 3), float(x), int(i % 5000)) for i, x in enumerate(r.lognormal(size=20_000))] + [(0, 0, None, 1), (0, 1, float("nan"), 2), (9, 9, None, None)]
    df = spark.createDataFrame(rows, "a int, b int, x double, id int")
    fine = Y.summarize(df, ["a", "b"], ["x"], "id")
    for by in (["a"], []):
        once, twice = Y.summarize(df, by, ["x"], "id"), Y.merged(fine, by)
        shown = lambda t: {tuple(r[c] for c in by): r for r in t.select(*by, "rows", "x_n", "x_min", "x_max", Y.mean("x").alias("mean"), Y.quantile("x", 0.25).alias("q"), Y.distinct().alias("ids")).collect()}  # noqa: E731, B023
        got, direct = shown(twice), shown(once)
        assert got.keys() == direct.keys()
        for k, g in got.items():
            mine = [x for x in rows if not by or (x[0],) == k]
            xs = sorted(x[2] for x in mine if x[2] is not None and x[2] == x[2])
            assert (g.rows, g.x_n) == (len(mine), len(xs)) == (direct[k].rows, direct[k].x_n)
            if not xs:
                assert g.q is None and g["mean"] is None
                continue
            assert (g.x_min, g.x_max) == (xs[0], xs[-1]) and g["mean"] == pytest.approx(sum(xs) / len(xs))
            assert abs(np.searchsorted(xs, g.q) / len(xs) - 0.25) <= Y.RANK_ERROR + 1 / len(xs)
            n = len({x[3] for x in mine if x[3] is not None})
            assert abs(g.ids - n) <= Y.DISTINCT_ERROR * n + 1


def test_subtotals(spark):
    rows = [("x", "p", 1.0), ("x", "q", 2.0), ("y", "p", 4.0), (None, "p", 8.0)]
    got = {(r.level, r.a, r.b): r.s for r in G.subtotals(spark.createDataFrame(rows, "a string, b string, v double"), ["a", "b"], F.sum("v").alias("s")).collect()}
    assert got == {(0, "x", "p"): 1, (0, "x", "q"): 2, (0, "y", "p"): 4, (0, None, "p"): 8, (1, "x", None): 3, (1, "y", None): 4, (1, None, None): 8, (2, None, "p"): 13, (2, None, "q"): 2, (3, None, None): 15}


def test_attribute_attack(spark, tmp_path):
    from murmura.sources import files

    files.write_counted(spark.range(5), lambda df: df.write.parquet(f"file://{tmp_path}/seen"))  # a session that has observed counts can't be sent to tasks
    r = np.random.default_rng(7)
    rows = spark.createDataFrame([(i, i % 2, [float(x) for x in (i % 2) * 4 + r.normal(0, 0.15, 2)]) for i in range(40)], "row_id long, label int, vec array<double>")
    scored = A.attack(rows, 4, 2028, 20)
    found = scored.collect()
    assert sorted(x.row_id for x in found) == list(range(40)) and {x.fold for x in found} == {0, 1, 2, 3}
    assert all((x.prediction == 1) == (x.score > 0.5) for x in found) and np.mean([x.prediction == x.label for x in found]) > 0.95
    row = A.report(scored).first()
    assert row.roc_auc > 0.95 and row.tpr_at_fpr_1pct > 0.9 and row.macro_f1 > 0.95 and row.roc_auc_fold_mean > 0.95 and row.roc_auc_fold_std < 0.1
    assert (row.rows, row.positives, row.negatives, row.folds, row.low_resolution) == (40, 20, 20, 4, True)
    with pytest.raises(ValueError):
        A.attack(rows, 1)
    with pytest.raises(ValueError):
        A.attack(rows.where("label = 0 OR row_id < 4"), 4)


def test_generated_queries(spark):
    chunks = spark.createDataFrame([(1, 0, "alpha beta gamma delta alpha"), (2, 0, "x　y  12 " + "z " * 30), (3, 0, " \n "), (3, 1, None)], "doc_id long, chunk_id int, content string")
    found = {(r.doc_id, r.chunk_id): r.query for r in C.generated_queries(chunks, 6, 1).collect()}
    assert sorted(found[1, 0].split()) == ["alpha", "beta", "delta", "gamma"] and found[2, 0] == " ".join(["x", "y", "12", *["z"] * 13]) and found[3, 0] == found[3, 1] == C.TOPIC
    rows = C.generated_queries(chunks, 6, 1).collect()
    assert sorted(r.query_no for r in rows) == [1, 2, 3, 4, 5, 6] and sorted(r.query for r in rows if r.doc_id is None) == [f"{C.TOPIC} 5", f"{C.TOPIC} 6"]
    assert sorted(r.query_no for r in C.generated_queries(chunks, 2, 1).collect()) == [1, 2] and C.generated_queries(chunks.limit(0), 3, 1).count() == 0


def test_prompts(spark):
    found = spark.createDataFrame([(1, 2, 11), (1, 1, 10), (2, 1, 99)], "query_id long, rank int, doc_id long")
    records = spark.createDataFrame([(10, "a.txt", 3, "x" * 2000), (11, "b.txt", 0, "short")], "doc_id long, filename string, chunk_id int, content string")
    questions = spark.createDataFrame([(1, "why?"), (2, "who?")], "query_id long, question string")
    got = {r.query_id: r.prompt for r in C.prompts(found, records, questions, F.lit("I am.")).collect()}
    listed = "📄【a.txt#chunk-3】\n" + "x" * 1000 + "...\n\n📄【b.txt#chunk-0】\nshort..."
    assert f"AI Identity/Persona\nI am.\n\n【知识库检索结果】\n{listed}\n\n" in got[1] and "用户的问题：why?" in got[1] and got[1].startswith("你是一名") and got[1].endswith("回答：")
    assert "【知识库检索结果】\n\n\n请遵守" in got[2]


def test_running_sums_work_out_their_rows_once(spark):
    from murmura.operators import ordered

    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def noted(x):
        seen.add(1)
        return x

    n = ordered.SMALL_ROWS + 2000
    out = ordered.numbered(spark.range(n).select(noted("id").alias("id")), [F.col("id").desc()], "no")
    assert out.agg(F.sum((F.col("id") + F.col("no") == n).cast("int"))).first()[0] == n and seen.value == n


def test_resamples_are_drawn_once(spark):
    from murmura.operators import security as X

    rows = spark.range(50).selectExpr("id", "id % 2 AS label", "id / 50D AS score")
    drawn = X._drawn(rows, "id", 20, 7)
    assert drawn._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
    assert drawn.rdd.getNumPartitions() > 1 and {r.b for r in drawn.collect()} == set(range(20))


def test_terms_of_a_query_are_sought_once(spark):
    rows = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "to be"), (3, None)], "doc_id long, content string")
    asked = rows.select("doc_id", C.query_text(F.col("content"), F.lit("7"), F.col("doc_id").cast("string")).alias("query"))
    assert asked._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1
    found = {r.doc_id: r["query"] for r in asked.collect()}
    assert set(found[1].split()) == {"alpha", "beta", "gamma", "delta"} and found[2] == "to be" and found[3] == C.TOPIC


def test_variants_are_drawn_once(spark):
    from murmura.operators import experiments as E
    from murmura.plans import experiment_queries as Q

    docs = spark.createDataFrame([(i, [float(i % 7 - 3), float(i % 5), 0.5]) for i in range(40)], "doc_id long, vec array<double>")
    sigmas = {"none": F.lit(0.0), "some": F.lit(0.3), "own": F.col("doc_id") * 0.01}
    shown = lambda df: sorted((r.variant, r.doc_id, tuple(r.vec), tuple(r.ref), r.nsr) for r in df.collect())
    together = E.noised_all(docs, sigmas)
    assert shown(together) == shown(E.union([E.noised(docs, n, s) for n, s in sigmas.items()]))
    assert together._jdf.queryExecution().optimizedPlan().toString().count("gaussians(") == 1
    assert Q._by_scale(docs)[0].count() == 40 * len(Q.SCALES)


def test_pair_sums_against_all_pairs(spark):
    import numpy as np

    from murmura.operators import retrieval as R

    draws = np.random.default_rng(5)
    a = draws.normal(size=(1100, 8))
    moved = {"near": a + 0.01 * draws.normal(size=a.shape), "far": a + draws.normal(size=a.shape), "same": a}
    rows = [(n, i, [float(x) for x in b[i]], [float(x) for x in a[i]]) for n, b in moved.items() for i in range(len(a))]
    variants = spark.createDataFrame(rows, "variant string, doc_id long, vec array<double>, ref array<double>")
    queries = spark.createDataFrame([(i, [float(x) for x in a[i]]) for i in range(0, 1100, 2)], "query_id long, vec array<double>")
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    found = R.pair_sums(queries, variants, list(moved)).collect()
    assert len(found) == 3 * 550
    for n, b in moved.items():
        s, t = (np.round(unit(a[::2]) @ unit(x).T, 9) for x in (a, b))
        want = np.stack([x.sum(1) for x in (s, t, s * s, t * t, s * t, abs(s - t))] + [abs(s - t).max(1)], 1)
        for r in found:
            if r.variant == n:
                assert r.n == 1100 and np.allclose(tuple(r)[3:], want[r.query_id // 2], atol=1e-6)


def test_an_attack_reads_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def noted(i):
        seen.add(1)
        return int(i % 3 == 0)

    rows = spark.range(60).select(F.col("id").alias("row_id"), noted("id").alias("label"), F.array((F.col("id") % 7).cast("double"), (F.col("id") % 5).cast("double")).alias("vec"))
    assert A.attack(rows, 3, 2028, 5).count() == 60 and seen.value <= 60


def test_kinds_of_entities_are_those_of_their_patterns(spark):
    from murmura.functions import sensitivity as S

    texts = ["a@b.com", "é@b.com", "@", "a@b", "see HTTP://x.y", "://x", "wWw.x.y", "www", "ww.w.x", "call 123 4567", "555-1234-5678", "12-3456", "123.4567", "+1 (20) 300-4000", "1234567", "", None, "a@b.com www.x.y 123-4567"]
    t = F.col("t")
    plain = F.array_compact(F.array(*[F.when(t.rlike(p), F.lit(k)) for k, p in S.ENTITIES.items()]))
    found = spark.createDataFrame([(x,) for x in texts], "t string").select("t", S.entity_types(t).alias("a"), plain.alias("b")).collect()
    assert all(r.a == r.b for r in found) and {len(r.a) for r in found} == {0, 1, 3}
