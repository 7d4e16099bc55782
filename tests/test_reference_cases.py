import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmura.functions import sensitivity as S
from murmura.functions import vector as V
from murmura.operators import chunking as C
from murmura.operators import grids, metrics, noise, projection, retrieval, security
from murmura.sources import files

TEXTS = ["Contact alice@example.com at 555-123-4567 and visit https://example.org/project details.", "General public documentation without private identifiers."]


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_entities_and_redaction(spark):
    assert [one(spark, t, S.entity_types) for t in TEXTS] == [["email", "url", "phone"], []]
    clean = one(spark, TEXTS[0], S.redact)
    assert not any(x in clean for x in ("alice@", "555-123", "https://"))


def test_sensitive_kinds():
    assert S.sensitive_kinds(" URL,email,url ") == ("url", "email")
    with pytest.raises(ValueError):
        S.sensitive_kinds("iris")


def test_jl_dimension():
    assert [V.jl_min_dim(n, e) for n, e in ((1, 0.3), (100, 0.3), (1000, 0.3), (1000, 0.1))] == [1, 512, 768, 5921]


def test_chunks_keep_every_sentence():
    text = "第一段。有两句！\n\n第二段很长，" + "没有停顿" * 60 + "。\n\nA third. With more text. " + "x" * 450
    found = C.greedy_chunks(text, 200, 50)
    kept = "".join("".join(found).split())
    assert kept == "".join(text.split()) and all(len(c) <= 200 for c in found)
    with pytest.raises(ValueError):
        C.check_sizes(100, 100)


def test_multiplier_solves_its_equation():
    u, solved = noise.multiplier(4.0, 1e-5)
    phi = lambda x: 0.5 * math.erfc(-x / math.sqrt(2))
    assert solved and abs(phi(1 / (2 * u) - 4 * u) - math.exp(4) * phi(-1 / (2 * u) - 4 * u) - 1e-5) < 1e-9
    with pytest.raises(ValueError):
        noise.NoiseConfig(delta=1.5)


def test_projector_round_trip(spark, tmp_path):
    p = projection.Projector(20, 5)
    p.save(spark, f"file://{tmp_path}/p")
    assert (projection.Projector.load(spark, f"file://{tmp_path}/p").matrix() == p.matrix()).all()


def test_linkage_and_exposure(spark):
    rows = [(i, [float(i == j) for j in range(6)]) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, vec array<double>")
    top = retrieval.linkage(docs.withColumnRenamed("doc_id", "query_id"), docs, 5)
    assert top.where("rank = 1 AND doc_id = query_id").count() == 6
    lists = [(0, [2, 1, 0, 3, 4]), (1, [1, 4, 2, 0, 3])]
    found = spark.createDataFrame([(q, r, d) for q, ds in lists for r, d in enumerate(ds, 1)], "query_id long, rank int, doc_id long")
    row = security.exposure(found, spark.createDataFrame([(0, 2), (1, 4)], "query_id long, doc_id long"), spark.createDataFrame([(2,), (4,)], "doc_id long")).first()
    assert (row.recall_at_1, row.recall_at_5, row.mean_sensitive, row.mean_rank) == (0.5, 1.0, 2.0, 1.5)


def test_roc(spark):
    rows = spark.createDataFrame(list(zip([0, 0, 0, 1, 1, 1], [0.01, 0.05, 0.1, 0.8, 0.9, 0.99])), "label int, score double")
    assert security.tpr_at_fpr(rows, 0.01).first().tpr == 1.0 and security.auc(rows).first().auc == 1.0 and security.advantage(rows).first().advantage == 1.0
    assert math.isnan(security.auc(rows.where("label = 1")).first().auc)


def test_rates_of_one_curve(spark):
    rows = spark.createDataFrame([(g, y, s) for g in ("a", "b") for y, s in zip((0, 0, 1, 1, 0, 1), (0.1, 0.4, 0.35, 0.8, 0.8, 0.9))] + [("c", 1, 0.5)], "g string, label int, score double")
    both = {r.g: r for r in security.rates(rows, 0.4, "g").collect()}
    for g in "ab":
        own = rows.where(F.col("g") == g)
        assert (both[g].auc, both[g].tpr, both[g].advantage, both[g].negatives) == (security.auc(own).first().auc, security.tpr_at_fpr(own, 0.4).first().tpr, security.advantage(own).first().advantage, 3)
    assert math.isnan(both["c"].auc) and both["c"].tpr is None and both["c"].negatives == 0
    with pytest.raises(ValueError, match="at least 14"):
        security.targets(rows, ["score"], 14)
    assert [r.score for r in security.targets(rows, ["score", "g"], 1, 2).collect()] == [0.1, 0.1] and security.targets(rows, ["score"]).count() == 13


def test_safe_corr(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert math.isnan(rows.agg(metrics.safe_corr(F.col("x"), F.col("y")).alias("r")).first().r)


def test_constrained_best_falls_back(spark):
    rows = spark.createDataFrame([("a", 0.9, 0.1, 0.1), ("b", 0.5, 0.2, 0.2)], "scheme string, recall double, mrr double, nsr double")
    best = grids.constrained_best(rows, "nsr", 0.5).first()
    assert best.scheme == "b" and best.fallback
    assert grids.constrained_best(rows, "nsr", 0.05).first().scheme == "a"


def test_folder_of_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello", encoding="utf-8")
    (tmp_path / "b.md").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "c.bin").write_bytes(b"x")
    strict = files.load_documents(spark, f"file://{tmp_path}").collect()
    assert [(r.filename, r.content) for r in strict] == [("a.txt", "hello")]
    lenient = files.load_documents(spark, f"file://{tmp_path}", recursive=True, lenient=True).collect()
    assert [(r.filename, r.content) for r in lenient] == [("a.txt", "hello"), ("b.md", "café")]
    files.write_params(spark, {"b": 1, "a": 2}, f"file://{tmp_path}/p")
    assert files.read_params(spark, f"file://{tmp_path}/p") == {"a": 2, "b": 1} and files.read_params(spark, f"file://{tmp_path}/no") == {}


def test_all_chunks_of_every_twentieth_document_are_queries(spark):
    from murmura.plans import registry

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 20 = 0")
    want = {(r.doc_id << 24) + r.chunk_id for r in C.sliding(docs, 1000, 200).collect()}
    found = registry.queries()["pipeline_private_retrieval"](spark, sf).collect()
    assert {r.query_id for r in found} == want and len(found) == 3 * len(want) and any(i % (1 << 24) for i in want)


def test_all_kinds_of_entities_against_brute_force(spark):
    from murmura.plans import registry

    sf, queries = "/root/testdata/sf0.001", registry.queries()
    kinds = {k: re.compile(re.sub(r"^\(\?(i?)U\)", lambda m: "(?i)" if m[1] else "", v), re.ASCII if k == "phone" else 0) for k, v in S.ENTITIES.items()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = {d: {k: sum(1 for _ in p.finditer(t)) for k, p in kinds.items()} for d, t in texts.items()}
    got = {r.doc_id: (r.entity_types, r.entity_count) for r in queries["prv11_prv13_entities_all"](spark, sf).collect()}
    assert got == {d: (",".join(k for k in kinds if n[k]), sum(n.values())) for d, n in found.items() if any(n.values())}
    assert any(types == "phone" for types, _ in got.values())
    clean = {}
    for d, t in texts.items():
        for p in kinds.values():
            t = p.sub(" ", t)
        clean[d] = hashlib.md5(t.encode()).hexdigest()
    assert {r.doc_id: r.redacted_md5 for r in queries["prv14_redaction_all"](spark, sf).collect()} == clean
    flags = {f"has_{k}": [n[k] > 0 for n in found.values()] for k in kinds} | {"has_any_sensitive": [any(n.values()) for n in found.values()]}
    assert {(r.attribute, r.positives, r.negatives) for r in queries["prv16_prv18_label_counts_all"](spark, sf).collect()} == {(k, sum(v), len(v) - sum(v)) for k, v in flags.items()}
    assert {r.attribute for r in queries["prv19_eligible_all"](spark, sf).collect()} == {k for k, v in flags.items() if min(sum(v), len(v) - sum(v)) >= 5}


def test_membership_scores_all_groups_against_brute_force(spark):
    from murmura.plans import registry

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids = sorted((hashlib.md5(f"2030|{r.vec_id}".encode()).hexdigest(), r.vec_id) for r in rows)
    group = {i: int(g) for g, part in enumerate(np.array_split([i for _, i in ids], 4)) for i in part.tolist()}
    vec = {r.vec_id: np.array(r.embedding) / np.linalg.norm(r.embedding) for r in rows}
    got = {r.row_id: r for r in registry.queries()["sec17_membership"](spark, sf).collect()}
    assert set(got) == {i for i in vec if i % 20 == 0} and len({r.member_of for r in got.values()}) > 2
    for i, r in got.items():
        near = sorted(float(np.linalg.norm(vec[i] - vec[j])) for j in vec if group[j] == 2 and j != i)[:5]
        assert abs(r.score + sum(near) / 5) < 2e-5 and r.member_of == security.GROUPS[group[i]]
    shadow = [(r.score, group[i] == 2) for i, r in got.items() if group[i] > 1]
    rate = lambda t, y: np.mean([(s >= t) == y for s, m in shadow if m == y])
    best = min({s for s, _ in shadow}, key=lambda t: (-round((rate(t, True) + rate(t, False)) / 2, 12), t))
    assert all(r.predicted == (r.score >= best) for r in got.values())


def test_bootstrap_covers_all_three_metrics(spark):
    from murmura.plans import registry, security_queries

    rows = registry.queries()["sec19_bootstrap"](spark, "/root/testdata/sf0.001").first()
    scored = security_queries._scored(spark, "/root/testdata/sf0.001")
    whole = {"roc_auc": security.auc(scored).first().auc, "tpr_at_fpr": security.tpr_at_fpr(scored, 0.01).first().tpr, "attack_advantage": security.advantage(scored).first().advantage}
    for m, v in whole.items():
        assert rows[f"{m}_ci_low"] <= rows[f"{m}_ci_high"] and (m != "roc_auc" or rows[f"{m}_ci_low"] < v < rows[f"{m}_ci_high"])


def test_slices_of_all_sizes(spark):
    from murmura.plans import registry

    assert {r["size"] for r in registry.queries()["grd4_scale_slices"](spark, "/root/testdata/sf0.1").collect()} == {100, 300, 500, 1000}


@pytest.mark.parametrize("small", [0, 10_000])
def test_running_sums_over_many_ranges(spark, monkeypatch, small):
    from murmura.operators import ordered

    monkeypatch.setattr(ordered, "SMALL_ROWS", small)
    rows = [(i, i % 3, float(i % 7)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, grp int, x double").repartition(7)
    out = {r.id: r for r in ordered.running_sums(df, [F.col("id").desc()], {"upto": F.col("x"), "no": F.lit(1).cast("long")}, ("grp",)).collect()}
    for i, g, _ in rows:
        before = [r for r in rows if r[1] == g and r[0] >= i]
        assert out[i].no == len(before) and out[i].upto == sum(r[2] for r in before)
    assert ordered.numbered(df.limit(0), [F.col("id")], "no").count() == 0


def test_splits(spark):
    docs = spark.createDataFrame([(f"d{i}", 2) for i in range(12)], "name string, chunks int")
    assert sorted(r["count"] for r in security.disjoint_split(docs, "name", 7).groupBy("grp").count().collect()) == [3, 3, 3, 3]
    with pytest.raises(ValueError, match="source documents"):
        security.disjoint_split(docs.limit(3), "name", 7)
    out = security.cyclic_split(docs, "name", "chunks", 7, 5)
    assert [r.n for r in out.groupBy("grp").agg(F.sum("taken").alias("n")).orderBy("grp").collect()] == [5, 5, 5, 5] and security.overlapping(out, "name").count() == 0
    with pytest.raises(ValueError, match="chunks"):
        security.cyclic_split(docs, "name", "chunks", 7, 7)


def test_shadow_attack_tells_clusters_apart(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 2, (rng.normal(size=4) + (2 if i % 2 else -2)).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, label int, vec array<double>")
    out = security.shadow_attack(df.where("id < 60"), df.where("id >= 60"))
    assert out.count() == 60 and security.auc(out).first().auc > 0.95 and out.where("prediction <> label").count() <= 3


def test_linkage_needs_one_width(spark):
    a = spark.createDataFrame([(0, [1.0, 0.0, 0.0])], "query_id long, vec array<double>")
    b = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0])], "doc_id long, vec array<double>")
    with pytest.raises(Exception, match="numbers"):
        retrieval.linkage(a, b, 1).collect()
    with pytest.raises(ValueError):
        retrieval.top_k(a, b, 0)


def test_no_jl_ablations_keep_their_width(spark):
    from murmura.operators import noise
    from murmura.plans import experiment_queries

    rows = spark.createDataFrame([(i, [float(i + j % 5) for j in range(1024)], float(i + 1)) for i in range(6)], "doc_id long, vec array<double>, raw double")
    variants, names = experiment_queries.no_jl_variants(noise.calibrate(rows, "raw"), (0.01,))
    assert [n.split()[0] for n in names] == ["full", "no_dp", "no_dimension_scaling", "fixed_calibration"]
    assert {(r["variant"], r["size(vec)"]) for r in variants.select("variant", F.size("vec")).collect()} == {(n, 1024) for n in names} and variants.count() == 24


def test_answers_and_panels(spark):
    rows = spark.createDataFrame([("  问题：why  why 请直接给出简洁且专业的回答： so  ", "why"), ("why", "why"), ("plain", "why"), (None, "why")], "a string, q string")
    assert [r[0] for r in rows.select(C.cleaned_answer(F.col("a"), F.col("q"))).collect()] == ["so", C.NO_ANSWER, "plain", C.NO_ANSWER]
    lines = spark.createDataFrame([("a  \nb\t\n" + "c" * 30,), ("short",)], "t string")
    assert [r[0] for r in lines.select(C.panel(F.col("t"), 10)).collect()] == ["a\nb\nccc...", "short"]


def test_lists_of_numbers():
    assert grids.numbers(" 64, 16,64", int, 32) == [16, 32, 64] and grids.numbers("0.5") == [0.5]
    for bad in ("", "0,1", "-1"):
        with pytest.raises(ValueError):
            grids.numbers(bad)


def test_single_documents_and_chats(spark, tmp_path):
    (tmp_path / "identity.md").write_text("be brief", encoding="utf-8")
    (tmp_path / "a.csv").write_text("x,y", encoding="utf-8")
    (tmp_path / "c.json").write_text('[{"role": "user", "content": "hi"}]', encoding="utf-8")
    read = lambda n: [tuple(r) for r in files.load_document(spark, f"file://{tmp_path}", n).collect()]
    assert read("identity.md") == [("identity.md", "[系统角色提示]\nbe brief\n\n")] and read("a.csv") == [("a.csv", "x,y")] and read("no.txt") == []
    assert [tuple(r) for r in files.read_chat(spark, f"file://{tmp_path}/c.json").collect()] == [("user", "hi")]
    assert files.read_chat(spark, f"file://{tmp_path}/none.json").count() == 0
