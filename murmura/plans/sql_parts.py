"""Pieces of the SQL that checks noise and search: normal distribution, calibration, noised vectors, score pairs."""

from __future__ import annotations

from murmura.functions import randomness


def erfc(z: str) -> str:
    """The complementary error function: a series of positive terms near 0, a continued fraction beyond."""
    series = f"exp(-pow({z}, 2)) * 1.1283791670955126::DOUBLE * list_sum(list_transform(range(0, 50), lambda n: pow(4.0::DOUBLE, n) * gamma(n + 1) * pow({z}, 2 * n + 1) / gamma(2 * n + 2)))"
    tail = lambda x: f"exp(-pow({x}, 2)) * 0.5641895835477563::DOUBLE / list_reduce(list_transform(range(80, 0, -1), lambda k: k / 2.0::DOUBLE), lambda t, k: {x} + k / t, {x})"
    return f"(CASE WHEN abs({z}) < 2 THEN 1 - {series} WHEN {z} > 0 THEN {tail(f'greatest({z}, 1)')} ELSE 2 - {tail(f'greatest(-({z}), 1)')} END)"


def phi(x: str) -> str:
    return f"(0.5::DOUBLE * {erfc(f'((-({x})) / 1.4142135623730951::DOUBLE)')})"


#: (vec_id, v, n): vectors and their norms.
VECTORS = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM e)"

_EXCESS = f"{phi('1 / (2 * u) - eps * u')} - exp(eps) * {phi('-1 / (2 * u) - eps * u')} - 1e-5::DOUBLE"


def calibration(scores: str, key: str = "vec_id") -> str:
    """CTEs up to cal (key, eps, sens, sigma), the calibration of scores (key, raw); needs WITH RECURSIVE."""
    return f"""
sc AS (SELECT {key}, (least(greatest(raw, 0.1), 10)::DOUBLE - 0.1) / 9.9 AS s FROM {scores}),
ca AS (SELECT {key}, least(greatest(1.25 + 8.75 * pow(1 - s, 1.5), 0.5), 10)::DOUBLE AS eps, 0.25 + 0.25 * s AS sens FROM sc),
ro AS (SELECT DISTINCT eps, 1e-4::DOUBLE AS lo, 100.0::DOUBLE AS hi, 0 AS it FROM (SELECT eps FROM ca UNION SELECT avg(eps) FROM ca)
  UNION ALL SELECT eps, CASE WHEN f > 0 THEN u ELSE lo END, CASE WHEN f > 0 THEN hi ELSE u END, it + 1 FROM (SELECT *, {_EXCESS} AS f FROM (SELECT eps, lo, hi, it, (lo + hi) / 2 AS u FROM ro WHERE it < 60))),
cal AS (SELECT ca.{key}, ca.eps, ca.sens, (lo + hi) / 2 * ca.sens AS sigma FROM ca JOIN ro ON ro.eps = ca.eps AND it = 60)"""


#: (vec_id, eps, sens, sigma): the calibration of scores 0.1 + (vec_id % 100) / 10; needs WITH RECURSIVE.
CALIBRATION = f"""{calibration("(SELECT vec_id, 0.1 + (vec_id % 100) * 0.1 AS raw FROM embeddings)")},
matched AS (SELECT any_value((lo + hi) / 2) * (SELECT avg(sens) FROM ca) AS sigma FROM ro WHERE it = 60 AND eps = (SELECT avg(eps) FROM ca))"""

#: (vec_id, i, x, z): clipped vectors' numbers and normal draws.
DRAWS = f"u AS (SELECT vec_id, n, unnest(v) AS x, unnest(range(len(v))) AS i FROM n), g AS (SELECT vec_id, i, x / greatest(1.0, n) AS x, {randomness.gaussian_sql(42, 'dp', 'vec_id', 'i')} AS z FROM u)"

#: With sig (variant, vec_id, sigma): m (variant, vec_id, w, wn, nsr), the noised vectors.
NOISED = """mm AS (SELECT variant, g.vec_id, list(x + sigma * z ORDER BY i) AS w, sqrt(sum(sigma * z * sigma * z)) / greatest(sqrt(sum(x * x)), 1e-12) AS nsr FROM g JOIN sig ON sig.vec_id = g.vec_id GROUP BY variant, g.vec_id),
m AS (SELECT *, sqrt(list_sum(list_transform(w, lambda x: x * x))) AS wn FROM mm)"""


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda x: x[1] * x[2]))"


#: (variant, query_id, doc_id, a, b, ra, rb): cosines with raw and with noised vectors, and their ranks; queries are ids that 20 divides.
PAIRS = f"""p AS (SELECT variant, q.vec_id AS query_id, d.vec_id AS doc_id, round({dot('q.v', 'd.v')} / (q.n * d.n), 9) AS a, round({dot('q.v', 'm.w')} / (q.n * m.wn), 9) AS b FROM n q JOIN m ON q.vec_id % 20 = 0 JOIN n d ON d.vec_id = m.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY variant, query_id ORDER BY a DESC, doc_id) AS ra, row_number() OVER (PARTITION BY variant, query_id ORDER BY b DESC, doc_id) AS rb FROM p)"""

#: A row for each variant, as utility_rows() gives it.
UTILITY_PARTS = f"""per AS (SELECT variant, query_id, sum((ra <= 1 AND rb <= 1)::INT) / 1.0 AS r1, sum((ra <= 3 AND rb <= 3)::INT) / 3.0::DOUBLE AS r3, sum((ra <= 5 AND rb <= 5)::INT) / 5.0::DOUBLE AS r5, sum((ra <= 10 AND rb <= 10)::INT) / 10.0::DOUBLE AS r10,
  max(CASE WHEN ra = 1 AND rb <= 5 THEN 1.0::DOUBLE / rb ELSE 0 END) AS rr, corr(a, b) AS pearson, avg(abs(a - b)) AS drift, max(abs(a - b)) AS most FROM r GROUP BY variant, query_id),
sh AS (SELECT variant, nsr, {dot('n.v', 'm.w')} / (n.n * m.wn) AS c FROM m JOIN n ON n.vec_id = m.vec_id),
t AS (SELECT variant, round(avg(nsr), 6) AS mean_nsr, round(min(c), 6) AS min_direction_cosine, round(avg(c), 6) AS mean_direction_cosine, round(max(c), 6) AS max_direction_cosine FROM sh GROUP BY variant)"""
UTILITY_ROW = """SELECT variant, round(avg(r1), 6)::DOUBLE AS recall_at_1, round(avg(r3), 6) AS recall_at_3, round(avg(r5), 6) AS recall_at_5, round(avg(r10), 6) AS recall_at_10, round(avg(rr), 6) AS mrr_at_5, round(avg(pearson), 6) AS mean_pearson, round(avg(drift), 6) AS mean_drift,
  round(max(most), 6) AS max_drift, any_value(mean_nsr) AS mean_nsr, any_value(min_direction_cosine) AS min_direction_cosine, any_value(mean_direction_cosine) AS mean_direction_cosine, any_value(max_direction_cosine) AS max_direction_cosine FROM per JOIN t USING (variant) GROUP BY variant"""
UTILITY = f"{UTILITY_PARTS}\n{UTILITY_ROW}"


def _gap(a: str, b: str) -> str:
    return f"greatest(round({dot(a, a)} + {dot(b, b)} - 2 * {dot(a, b)}, 9), 0)"


def cells(units: str, rounds: int = 3, n: int = 128, seed: int = 42, p: str = "k") -> str:
    """CTEs for units (vec_id, v): {p}own (vec_id, cell) and {p}means (cell, m), as operators.cells trains them on up to 16,384 rows."""
    out = [f"{p}s AS (SELECT *, row_number() OVER (ORDER BY md5('{seed}|' || vec_id), vec_id) AS o FROM {units})", f"{p}m0 AS (SELECT o - 1 AS cell, v AS m FROM {p}s WHERE o <= {n})"]
    near = lambda rows, means: f"(SELECT vec_id, v, cell FROM (SELECT s.vec_id, s.v, cell, row_number() OVER (PARTITION BY s.vec_id ORDER BY {_gap('s.v', 'm')}, cell) AS place FROM {rows} s, {means}) WHERE place = 1)"
    for i in range(rounds):
        out.append(f"{p}a{i} AS (SELECT cell, i, avg(x) AS x FROM (SELECT cell, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM {near(f'(SELECT * FROM {p}s WHERE o <= 16384)', f'{p}m{i}')}) GROUP BY cell, i)")
        out.append(f"{p}m{i + 1} AS (SELECT o.cell, coalesce(a.m, o.m) AS m FROM {p}m{i} o LEFT JOIN (SELECT cell, list(x ORDER BY i) AS m FROM {p}a{i} GROUP BY cell) a ON a.cell = o.cell)")
    out += [f"{p}means AS (SELECT * FROM {p}m{rounds})", f"{p}own AS (SELECT vec_id, cell FROM {near(units, f'{p}means')})"]
    return ", ".join(out)


def probes(queries: str, p: str = "k") -> str:
    """CTE {p}probe (query_id, cell, place) for queries (query_id, v)."""
    return f"{p}probe AS (SELECT q.query_id, cell, row_number() OVER (PARTITION BY q.query_id ORDER BY {_gap('q.v', 'm')}, cell) AS place FROM {queries} q, {p}means)"
