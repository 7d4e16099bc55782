"""Values of sensitivity scores, the classifier's share, the learned embedding, and scheme rows."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmura.functions import sensitivity as S
from murmura.operators import classifier as K
from murmura.operators import embedding
from murmura.operators import schemes as X
from murmura.plans import registry

SF = "/root/testdata/sf0.001"
# text, identifiers, keywords, heuristics, score, raw score, epsilon, delta
FIXTURES = [
    ("北京是中国的首都，2024年人口约2150万。", 0, 0, 0, 0, 0.1, 10, 2),
    ("张三的身份证号是110101199003071234。", 0.82, 0.22, 0, 1, 10, 0.1, 3),
    ("我的银行卡号是6228481234567890123，余额10000元。", 0.96, 0.22, 0.18, 1, 10, 0.1, 3),
    ("本公司2024年营收目标为50亿元，内部资料请勿外传。", 0.18, 0.73, 0.12, 0.65, 6.535, 1.08307, 2.65),
    ("会议将于下周一召开，参会人员包括张三。", 0, 0.34, 0.12, 0.299, 3.0601, 4.63122, 2.299),
    ("plain text", 0, 0, 0, 0, 0.1, 10, 2),
    ("mail a@b.com and c@d.org", 0.7, 0, 0, 0.455, 4.6045, 2.7044, 2.455),
]


def test_scores_of_the_known_texts(spark):
    t = F.col("text")
    rows = spark.createDataFrame([(x[0],) for x in FIXTURES], "text string").select("text", S.identifier_score(t).alias("i"), S.keyword_score(t).alias("k"), S.heuristic_score(t).alias("h"), S.profile(t).alias("p")).collect()
    got = {r.text: (r.i, r.k, r.h, r.p.score, r.p.raw_score, r.p.epsilon, r.p.delta) for r in rows}
    for text, *want in FIXTURES:
        assert got[text] == pytest.approx(want, abs=1e-5), text


def brute_profile(text):
    found = {k: len(re.findall(re.sub(r"^\(\?U\)", "", v), text, 0 if k == "Email" else re.ASCII)) for k, v in S.IDENTIFIERS.items()}
    identifiers = min(1, sum(S.IDENTIFIER_WEIGHTS[k] * n for k, n in found.items()))
    has = lambda p: re.search(p, text) is not None
    words = min(1, sum(w for k, w in S.KEYWORD_WEIGHTS.items() if has(S.KEYWORDS[k])))
    meeting = has(S.HEURISTICS["Name"]) and has(S.HEURISTICS["Private"]) and not has(S.KEYWORDS["Public"])
    rule = min(1, identifiers + words + min(1, 0.12 * meeting + 0.18 * has(S.HEURISTICS["Finance"]) + 0.12 * has(S.HEURISTICS["Internal"])))
    score = rule if identifiers > 0.8 else 0.65 * rule
    return score, min(10, max(0.1, 0.1 + 9.9 * score)), min(10, max(0.1, 0.1 + 9.9 * (1 - score) ** 2.2)), 2 * (1 + 0.5 * score)


def test_profiles_of_a_table_against_plain_loops(spark):
    numbers = ["1" * 15, "1" * 16, "1" * 17 + "x", "a" + "1" * 18, "13812345678", "113812345678", "13812345678 13912345678", "4" + "0" * 15, "62" + "1" * 14, "62" + "1" * 18, "5112345678901234", "3 元 12,345.50 USD 7dollars", "é@b.com"]
    rows = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + numbers + [x[0] for x in FIXTURES]
    got = spark.createDataFrame(list(enumerate(rows)), "i long, text string").select("i", S.profile(F.col("text")).alias("p")).collect()
    for r in got:
        assert tuple(r.p) == pytest.approx(brute_profile(rows[r.i]), abs=1e-9), rows[r.i][:80]


def test_fused_score_takes_a_classifiers_share(spark):
    rows = spark.createDataFrame([("plain", 0.8), ("北京是首都", 0.8), ("北京是首都", 0.05), (FIXTURES[1][0], 0.8), ("a@b.com 首都", 0.8)], "text string, nlp double")
    got = [r.s for r in rows.select(S.fused_score(F.col("text"), F.col("nlp")).alias("s")).collect()]
    assert got == pytest.approx([0.28, 0.35 * 0.12, 0.35 * 0.05, 1.0, 0.65 * 0.35 + 0.35 * 0.8])  # alone; capped; under the cap; direct identifier; rule of 0.35 isn't capped


def test_classifier(spark, tmp_path):
    from murmura.sources import files

    files.write_counted(spark.range(5), lambda df: df.write.parquet(f"file://{tmp_path}/seen"))
    docs = [("common public words about weather and history",)] * 12 + [("invoice amount due 500 dollars payable account",)] * 12 + [("write to jane@corp.com about her private phone",)] * 12 + [("内部资料 project roadmap confidential",)] * 12
    rows = spark.createDataFrame(docs, "text string")
    model = K.TermClassifier.fit(rows)
    asked = ["invoice amount payable", "weather and history", "", " \n ", None, "1 2 3", "private phone"]
    got = {r.text: r.nlp for r in model.scored(spark.createDataFrame([(t,) for t in asked], "text string")).collect()}
    assert got["invoice amount payable"] > 0.3 and got["private phone"] > 0.3 and got["weather and history"] == 0
    assert [got[t] for t in ("", " \n ", None, "1 2 3")] == [0.0] * 4
    p = spark.createDataFrame([(0, [0.1, 0.7, 0.1, 0.1]), (1, [0.9, 0.1, 0.0, 0.0]), (2, [float("nan"), 0.7, 0.1, 0.1]), (3, [0.1, None, 0.1, 0.1]), (4, None), (5, [0.0, 1.0, 0.0, 0.0])], "i int, p array<double>")
    assert [r.s for r in p.orderBy("i").select(K.score_of(F.col("p")).alias("s")).collect()] == pytest.approx([0.6, 0, 0, 0, 0, 1])
    alone = K.TermClassifier.fit(rows.limit(0))
    assert alone.model is None and {r.nlp for r in alone.scored(rows).collect()} == {0.0}
    two = K.TermClassifier.fit(rows.where("text LIKE 'common%' OR text LIKE 'invoice%'"))
    assert all(0 <= r.nlp <= 1 for r in two.scored(rows).collect())


def test_attack_queries_against_plain_loops(spark):
    import hashlib

    kinds = {k: re.compile(re.sub(r"^\(\?(i?)U\)", lambda m: "(?i)" if m[1] else "", v), re.ASCII if k == "phone" else 0) for k, v in S.ENTITIES.items()}
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        types, clean = [k for k, p in kinds.items() if p.search(r.text)], r.text
        for p in kinds.values():
            clean = p.sub(" ", clean)
        words = list(dict.fromkeys(w.lower() for w in re.findall(r"[A-Za-z][A-Za-z0-9_'-]{2,}|[一-鿿]{2,}", clean) if len(w) >= 3))
        if types and len(words) >= 4:
            want[r.doc_id] = (types, " ".join(x for _, x in sorted((hashlib.md5(f"2027|{r.doc_id}|{w}".encode()).hexdigest(), w) for w in words)[:8]))
    got = {r.target_id: (r.entity_types, r.query) for r in registry.queries()["prv15_attack_queries"](spark, SF).collect()}
    assert got == want and len(got) > 5


def test_embedding_weighs_rare_terms_more(spark):
    rows = spark.createDataFrame([(i, ["every", f"own{i}"] if i else ["every"]) for i in range(50)] + [(50, []), (51, None)], "i int, terms array<string>")
    model = embedding.TermEmbedding.fit(rows, embedding.buckets_of(F.col("terms")))
    bucket = dict(spark.createDataFrame([(["every", "own7"],)], "t array<string>").select(F.explode(F.arrays_zip("t", embedding.buckets_of(F.col("t")).alias("b"))).alias("x")).select("x.t", "x.b").collect())
    assert model.weights[bucket["every"]] == pytest.approx(math.log(53 / 51) + 1) and model.weights[bucket["own7"]] > 4
    found = {r.i: np.array(r.v) for r in rows.select("i", model.column(rows, embedding.buckets_of(F.col("terms"))).alias("v")).collect()}
    assert all(abs(np.linalg.norm(found[i]) - 1) < 1e-9 for i in range(50)) and not found[50].any() and not found[51].any()
    assert abs(found[1] @ found[2]) < 0.7 and len(found[0]) == embedding.WIDTH


# -- schemes


def test_numbers_of_open_metadata(spark):
    values = {"whole": 4, "real": 0.5, "text": "0.25", "odd": "abc", "yes": True, "no": False, "nested": {"a": 1}, "many": [1], "nothing": None, "space": " 7 "}
    data = X.metadata_of(spark, **values)
    row = data.select(*[X.number(F.col("metadata"), k).alias(k) for k in [*values, "missing"]]).first()
    assert (row.whole, row.real, row.text, row.yes, row.no, row.space) == (4, 0.5, 0.25, 1, 0, 7)
    assert all(math.isnan(row[k]) for k in ("odd", "nested", "many", "nothing", "missing"))
    both = data.withColumn("own", F.parse_json(F.lit('{"real": "x", "whole": 9}')))
    either = both.select(*[X.number_of_either(F.col("own"), F.col("metadata"), k).alias(k) for k in ("whole", "real", "text")]).first()
    assert either.whole == 9 and math.isnan(either.real) and either.text == 0.25


def test_columns_follow_the_types_in_the_data(spark):
    rows = X.E.union([X.metadata_of(spark, a=1, b=True, c="x", d=1, e={"n": 1}, f=None, **{"odd key": 2}), X.metadata_of(spark, a=2.5, b=False, c=3, d=[1], e=[2], g="y")])
    columns = X.flattened(rows, "metadata", "m")
    found = rows.select(*columns)
    assert dict(found.dtypes) == {"m_a": "double", "m_b": "boolean", "m_c": "string", "m_d": "bigint", "m_odd key": "bigint", "m_g": "string"}
    assert sorted(map(str, (tuple(r) for r in found.select("m_a", "m_b", "m_c", "m_d", "m_g").collect()))) == sorted(map(str, [(1.0, True, "x", 1, None), (2.5, False, "3", None, "y")]))


def test_schemes_are_checked_and_refined(spark):
    r = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, [float(x) for x in r.normal(size=6)]) for i in range(80)], "doc_id long, vec array<double>").withColumn("ref", F.col("vec"))
    queries = docs.where("doc_id < 5").withColumnRenamed("doc_id", "query_id")
    meta = X.metadata_from(docs, F.count(F.lit(1)).alias("rows"), note="n", deep={"a": [1]})
    assert meta.select(F.to_json("metadata").alias("j")).first().j == '{"deep":{"a":[1]},"note":"n","rows":80}'
    with pytest.raises(ValueError, match="reference"):
        X.Scheme("s", "filter_refine", docs.drop("ref"), queries, meta, 6)
    with pytest.raises(ValueError, match="backend"):
        X.Scheme("s", "other", docs, queries, meta, 6)
    wide = X.CellConfig(cells=8, ef_search=8)
    schemes = [X.Scheme(b, b, docs, queries, meta, 6, config=wide) for b in X.BACKENDS]
    rows = {(r.scheme, r.ef_search): r for r in X.scheme_rows(schemes, 5, [2, 8], 8).collect()}
    assert len(rows) == 7 and rows["full_scan", 8].retrieval_exact and rows["index", 8].recall_at_5 == pytest.approx(1) and rows["filter_refine", 2].retrieval_candidates == 20
    with pytest.raises(ValueError):
        X.retrieve(schemes[0], 0, [1], 1)


def test_the_classifier_reads_its_texts_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def noted(x):
        seen.add(1)
        return x

    texts = ["plain words about weather", "write to someone@example.com today", "it costs 300 dollars there"] * 20
    rows = spark.createDataFrame([(t,) for t in texts], "raw string").select(noted("raw").alias("text"))
    assert K.TermClassifier.fit(rows, rounds=3).model is not None and seen.value <= 2 * len(texts)  # its features and the filter on null texts


def test_attack_queries_are_made_in_one_pass(spark):
    from murmura.plans import experiment_queries as Q

    rows = [(1, "alpha beta gamma delta someone@example.com", True), (2, "alpha beta gamma delta", False), (20, "alpha beta gamma delta", False), (40, "alpha beta", False), (60, None, False)]
    found = {r.doc_id: r for r in Q._asked(spark.createDataFrame(rows, "doc_id long, text string, hot boolean"), ("email", "url")).collect()}
    assert {i for i, r in found.items() if r.asked is not None} == {1, 20}
    assert set(found[1].asked) == set(found[20].asked) == set(found[2].buckets) and len(found[1].buckets) > 4


def test_a_cell_of_the_search_grid_is_small(spark):
    from murmura.operators import retrieval as R

    assert (R.BLOCK_ROWS + R.TILE_ROWS) * 64 * 8 <= 50_331_648  # bytes of one task's two tables of doubles


def test_a_vectors_norm_is_worked_out_once(spark):
    import time

    from murmura.functions import vector as V

    rows = spark.range(16).select(F.transform(F.sequence(F.lit(1), F.lit(8000)), lambda x: x * (F.col("id") + 1.5)).alias("v"))
    start = time.perf_counter()
    found = rows.select(V.norm(V.normalize(F.col("v"))).alias("n"), V.norm(V.clip_norm(F.col("v"), 2.0)).alias("c")).collect()
    assert time.perf_counter() - start < 10 and [tuple(r) for r in found] == [pytest.approx((1.0, 2.0))] * 16


def test_search_against_all_scores_in_double_precision():
    from murmura.operators import retrieval as R

    draws = np.random.default_rng(3)
    for queries, rows, width, k in ((1, 1, 3, 2), (513, 1025, 8, 3), (600, 3000, 64, 10), (5, 31, 1, 10)):
        q, c = draws.normal(size=(queries, width)), draws.normal(size=(rows, width))[draws.integers(0, rows, rows)]
        c[: rows // 2] = c[0]
        ids = draws.permutation(3 * rows)[:rows]
        for measure in R.MEASURES:
            kept = R._first_copies(c, ids, k)
            assert (c[kept] == c[0]).all(1).sum() == min(k, (c == c[0]).all(1).sum())
            got = R._nearest(q, c[kept], ids[kept], k, measure)
            for a, b in zip(got[:2], R._nearest_plain(q, c, ids, k, measure)[:2]):
                assert (a == b).all(), (queries, rows, measure)
