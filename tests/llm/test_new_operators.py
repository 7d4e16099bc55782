"""Brute force and edge cases of the language model, the filter audit and the Merkle manifest."""

import hashlib
import re
import zlib
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest

from murmura.llm import filter_audit, language, merkle
from murmura.operators import ordered

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, digest string, part string, n long, tree string, no long"


def documents(spark, rows):
    """Rows (doc_id, text, lang, source, n_chars), with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", "y", 5, "z", 9) for r in rows], SCHEMA)


WORDS = " ".join(f"w{i}" for i in range(250))
ROWS = [
    (1, WORDS, "en", "a", 1), (2, WORDS, "en", None, 2), (2, WORDS, None, "", 2), (2, WORDS, "en", None, 2), (3, WORDS + " #", "de", "a", None), (None, WORDS, "en", "a", 4), (4, None, "en", "b", 0), (5, "", "en", "b", 0),
    (6, "a b " * 300, "en", "c", 7), (7, "A B\u0085C\nD", "fr", "c", 7), (8, "A B\u0085C\nD", "fr", "ü", 7), (8, "other\n" * 300, "fr", "ü", 7), (9, " \t\n\v\f\r ", "fr", "日", 7), (10, "Ab" * 200_000, "en", "a", 3), (-3, "x" * 99 + " W", "en", "a", 3),
    (None, "", None, None, None), (None, "", None, None, None),
]


# -- 11


def brute_subwords(text):
    """Runs of 1 to 4 places with letters only, but for a boundary at either end and not alone."""
    mark = "\0"
    t = mark + "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else mark for c in text) + mark
    runs = [t[i : i + n] for n in (1, 2, 3, 4) for i in range(len(t) - n + 1)]
    return sorted(r for r in runs if mark not in r[1:-1] and (r.strip(mark) if len(r) < 3 else True) and r != mark)


@pytest.mark.parametrize("text", ["", "a", "1", "Ab c", "don't É ẞİ", "日本語 x", "ab" * 9 + "  \n" + "abc " * 5])
def test_subwords_are_those_of_plain_loops(monkeypatch, text):
    want = brute_subwords(text)
    ids = {r: i for i, r in enumerate(dict.fromkeys(want))}
    for size in (1, 2, 3, 5, 1 << 18):  # pieces of any length give the same subwords
        monkeypatch.setattr(language, "_CHARS", size)
        found = []
        for letters, n in language.pieces(text):
            rows, there = language.subwords(letters, n)
            found += [(k, int(r)) for k, (row, t) in enumerate(zip(rows, there)) for r in row[t]]
        assert len(found) == len(want)
        hashes = sorted(found)
        again = sorted((len(r) - 1, hash_of(r)) for r in ids for _ in range(want.count(r)))
        assert hashes == again


def hash_of(run):
    cps = np.array([ord(c) if c != "\0" else 0 for c in run] + [0, 0, 0], np.uint32)
    return int(language.subwords(cps, 1)[0][len(run) - 1, 0])


def toy(n=60):
    import random

    r = random.Random(3)
    say = {"aa": "ba be bi".split(), "bb": "ку ки ко".split(), "cc": "xoz xuz xyz".split()}
    return [(" ".join(r.choice(w) for _ in range(r.randint(3, 30))), y) for _ in range(n) for y, w in say.items()]


def test_scores_do_not_depend_on_batches_or_pieces(monkeypatch):
    model = language.train(toy())
    texts = [t for t, _ in toy(9)] + ["", "12", "ba" * 40, "ku xoz", "ba be"]
    whole, alone = model.sums(texts), [model.sums([t]) for t in texts]
    assert np.array_equal(whole[0], np.concatenate([x for x, _ in alone])) and np.array_equal(whole[1], np.concatenate([x for _, x in alone]))
    monkeypatch.setattr(language, "_CHARS", 7)
    assert all(np.array_equal(a, b) for a, b in zip(whole, model.sums(texts)))
    found = model.predict(texts)
    assert found["lang_pred"][:27].tolist() == [y for _, y in toy(9)] and found["lang_pred"][27:29].tolist() == ["und", "und"]
    assert found["score"][27] == 0 and found["rejected"][27] and (found["score"].between(0, 1)).all()


def test_a_model_of_many_languages_keeps_its_rows():
    r = np.random.default_rng(2)
    texts = [("".join(chr(97 + k) if r.random() < 0.8 else chr(97 + r.integers(26)) for _ in range(60)), f"l{k:02}") for _ in range(30) for k in range(20)]
    model = language.train(texts)
    assert model.table.shape[1] == language.WIDTH and (model.predict([t for t, _ in texts])["lang_pred"] == [y for _, y in texts]).mean() > 0.95


def test_what_cannot_be_learned():
    assert language.train([]) is None and language.train([("12 !", "en")]) is None
    one = language.train([("some words", "en")] * 3).predict(["anything", "77"])
    assert one["lang_pred"].tolist() == ["en", "und"] and one["score"].tolist() == [1.0, 0.0]


def test_languages_of_tables(spark):
    rows = [(i, t, y, "s", 1) for i, (t, y) in enumerate(toy())] + [(500, None, "aa", "s", 1), (501, "", None, "s", 1), (502, "ba be " * 90_000, None, "s", 1), (None, "ba bi", "aa", "s", 1), (0, toy()[0][0], "aa", "s", 1)]
    docs = documents(spark, rows)
    found = language.identify(docs, language.fit(docs)).collect()
    got = {r.doc_id: (r.lang_pred, r.score) for r in found}
    assert len(found) == len(rows) and got[500] == got[501] == ("und", 0.0) and got[502][0] == got[None][0] == "aa"
    assert all(got[i][0] == y for i, (_, y) in enumerate(toy()))
    unknown = documents(spark, [(1, "text", None, "s", 1)])
    assert [tuple(r) for r in language.identify(unknown, language.fit(unknown)).collect()] == [(1, "und", 0.0, True)]
    assert language.identify(docs.limit(0), language.fit(docs.limit(0))).count() == 0


def test_op11_on_rows_held_out(spark):
    from murmura.llm.queries import op11_language_id

    found = op11_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(found) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    held = [r for r in found if r.held_out]
    kept = [r for r in held if not r.rejected]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97 and len(kept) > 0.9 * len(held) and np.mean([r.lang_pred == r.lang for r in kept]) > 0.98


# -- 12


def brute_audit(rows, labels):
    first = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    counts = defaultdict(lambda: defaultdict(lambda: [0] * 3))
    for doc_id, text, _, source, _ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = "".join(
            f for f, x in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), re.search("[#$%&*|]", t), doc_id is not None and first[t] < doc_id)) if x
        )
        own = [x for x in labels if doc_id is not None and x[0] == doc_id]
        for i, x in enumerate((True, any(q == 1 for _, q, _ in own), any(t == 1 for _, _, t in own))):
            counts[source or ""][fails][i] += bool(x)
    out = {}
    for part, sets in counts.items():
        shapley = defaultdict(int)
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                gone = set(order[: step - 1])
                here = [v for k, v in sets.items() if f in k and not gone & set(k)]
                removed, good, toxic = ([v[i] for v in here] for i in range(3))
                shapley[f] += sum(removed)
                out[part, "".join(order), step] = [
                    sum(v[0] for k, v in sets.items() if not (gone | {f}) & set(k)), sum(removed), sum(v[0] for k, v in sets.items() if f in k and gone & set(k)), sets[f][0] if f in sets else 0, sum(good), sum(toxic), f,
                ]
        for k, v in out.items():
            if k[0] == part:
                v[6] = shapley[v[6]]
    return out


def test_audit_agrees_with_brute_force(spark):
    marks = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, None, None), (6, 0, 1), (6, 0, 1), (None, 1, 1), (99, 1, 1), (8, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    found = filter_audit.audit(documents(spark, ROWS).repartition(3), labels).collect()
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in found}
    assert len(found) == len(got) and got == brute_audit(ROWS, marks)
    assert filter_audit.audit(documents(spark, []), labels).count() == 0


def test_audit_of_a_text_in_many_parts(spark):
    rows = [(i, "same", "en", f"s{i % 40}", 1) for i in range(400)]
    labels = spark.createDataFrame([(0, 1, 1)], "doc_id long, quality int, toxic int")
    found = filter_audit.audit(documents(spark, rows), labels).where("filter_order = 'EABCD' AND step = 1").collect()
    assert {r.part: r.removed for r in found} == {f"s{i}": 10 - (i == 0) for i in range(40)}


# -- 13


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(row, text):
    return sha(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (row[0], row[3], row[2], row[4], text)))


def brute_tree(nodes):
    """The root, and each node's path as (left, right) texts."""
    paths, spans = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, wide = [], []
        for i in range(0, len(nodes), 3):
            run = nodes[i : i + 3]
            for j, span in enumerate(spans[i : i + 3]):
                for x in span:
                    paths[x].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(sha(*run))
            wide.append(sum(spans[i : i + 3], []))
        nodes, spans = up, wide
    return nodes[0], paths


def brute_manifest(rows):
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[3]].append((r, brute_leaf(r, r[1])))
    for x in by_source.values():
        x.sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: brute_tree([leaf for _, leaf in by_source[s]]) for s in order}
    root, over = brute_tree([trees[s][0] for s in order])
    out = []
    for s, above in zip(order, over):
        for (r, leaf), path in zip(by_source[s], trees[s][1]):
            text = r[1].replace("\n", "") if r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[1]
            fold = brute_leaf(r, text)
            for left, right in path + above:
                fold = sha(left, fold, right)
            out.append((r[0], leaf, trees[s][0], root, sha(*(x for p in path + above for x in p)), fold, fold == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest_agrees_with_brute_force(spark, monkeypatch, height):
    if height < 6:  # nodes are numbered in ranges
        monkeypatch.setattr(ordered, "SMALL_ROWS", 0)
    rows = ROWS + [(i, f"line {i}\nand\n", "en", "big" if i % 3 else f"s{i % 7}", i) for i in range(100, 160)]
    found = merkle.manifest(documents(spark, rows).repartition(3), height)
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r[c] for c in columns) for r in found.collect()), key=str) == brute_manifest(rows)


@pytest.mark.parametrize("n", [0, 1, 3, 4])
def test_manifest_of_few_rows(spark, n):
    rows = [(i, "a\nb", "en", None, 1) for i in range(n)]
    found = merkle.manifest(documents(spark, rows)).collect()
    assert sorted((tuple(r) for r in found), key=str) == (brute_manifest(rows) if rows else [])


def test_a_full_first_block_is_raised_like_others():
    for n in range(1, 60):
        nodes = [sha(str(i)) for i in range(n)]
        root, paths = brute_tree(nodes)
        if n <= 9:
            assert merkle.walk(nodes, 0, 2) == (root, ["".join(f"{a},{b};" for a, b in p) for p in paths])
