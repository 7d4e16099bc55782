"""Schemes side by side: each searched by the backend that it names, one metric row for each scheme and width.

A scheme has documents (doc_id, vec) and queries (query_id, vec), either with `ref` vectors where a
reference is searched instead, and open metadata: one VARIANT that may hold anything. All schemes'
searches and rows are one plan; only the indexes' cells are trained before.

A row has fixed fields, whose values are coerced to numbers (NaN for what is missing or no number, as for
texts that aren't numbers and for nested values), and the metadata itself: a column `metadata_<key>` or
`retrieval_<key>` for each key whose values are numbers, texts or truth values somewhere in the data, typed
by what is found there. Nested values and nulls give no column and are null beside others. Times aren't
part of a row.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.functions import vector as V
from murmura.operators import experiments as E
from murmura.operators import retrieval as R
from murmura.operators.cells import CellConfig, CellIndex

NAN = float("nan")
BACKENDS = ("index", "filter_refine", "full_scan", "index_refine")
#: Fields that are numbers of the metadata, the second ones of the retrieval's metadata before.
FROM_METADATA = ("mean_noise_signal_ratio", "mean_sigma", "mean_epsilon", "sap_noise_signal_ratio", "beta", "ratio_k")
FROM_EITHER = ("he_absolute_error_mean", "he_relative_error_mean", "he_scan_time", "he_refine_time", "ciphertext_size_kb", "plain_size_kb", "cipher_expansion_ratio")


def metadata_of(spark: SparkSession, **values) -> DataFrame:
    """One row (metadata): values known beforehand, as a VARIANT."""
    return spark.range(1).select(F.parse_json(F.lit(json.dumps(values))).alias("metadata"))


def metadata_from(rows: DataFrame, *aggregates: Column, **values) -> DataFrame:
    """One row (metadata): aggregates of rows, to be worked out with the scheme's row, and known values."""
    known = [F.to_json(F.struct(*aggregates, *[F.lit(v).alias(k) for k, v in values.items() if not isinstance(v, (dict, list))]))]
    nested = {k: v for k, v in values.items() if isinstance(v, (dict, list))}
    text = F.concat(F.regexp_replace(known[0], r"\}$", ""), F.lit("," + json.dumps(nested)[1:])) if nested else known[0]
    return rows.agg(text.alias("text")).select(F.parse_json("text").alias("metadata"))


@dataclass(frozen=True)
class Scheme:
    name: str
    backend: str
    docs: DataFrame
    queries: DataFrame
    metadata: DataFrame
    dim: int
    ratio: int = 4
    config: CellConfig = field(default_factory=CellConfig)

    def __post_init__(self):
        if self.backend not in BACKENDS:
            raise ValueError("backend must be one of " + ", ".join(BACKENDS))
        if self.backend == "filter_refine" and not ("ref" in self.docs.columns and "ref" in self.queries.columns):
            raise ValueError(f"{self.name} needs reference vectors to refine with")


def _refined(candidates: DataFrame, queries: DataFrame, docs: DataFrame, vec: str, k: int) -> DataFrame:
    """The k candidates (ef_search, query_id, doc_id) of each query that are nearest by squared distance."""
    q, d = queries.select("query_id", F.col(vec).alias("q_vec")), docs.select("doc_id", F.col(vec).alias("d_vec"))
    scored = candidates.select("ef_search", "query_id", "doc_id").join(q, "query_id").join(d, "doc_id")
    return R.ranked(scored.select("ef_search", "query_id", "doc_id", F.round(V.squared_l2(F.col("q_vec"), F.col("d_vec")), 9).alias("score")), k, False, "ef_search", "query_id")


def retrieve(scheme: Scheme, top_k: int, widths: list[int], default: int) -> tuple[DataFrame, dict]:
    """(ef_search, query_id, rank, doc_id, score) for each width, and what the retrieval tells about itself.

    A full scan has no width; its rows carry the default one.
    """
    if top_k < 1:
        raise ValueError("top_k must be greater than 0")
    if scheme.backend == "full_scan":
        found = R.top_k(scheme.queries, scheme.docs, max(top_k, 5), "l2")
        return found.withColumn("ef_search", F.lit(default)), {"measure": "l2", "exact": True}
    index = CellIndex.build(scheme.docs, scheme.config, "doc_id")
    if scheme.backend == "index":
        return index.sweep(scheme.queries, max(top_k, 10), widths), {"measure": scheme.config.space, "exact": False}
    candidates = max(top_k, scheme.ratio * top_k, 5)
    found = index.sweep(scheme.queries, candidates, widths)
    vec = "ref" if scheme.backend == "filter_refine" else "vec"
    return _refined(found, scheme.queries, scheme.docs, vec, max(top_k, 5)), {"measure": "l2", "exact": False, "candidates": candidates}


def number(data: Column, key: str) -> Column:
    """A key's value as a number: NaN where it is missing or can't be one."""
    flag = F.try_variant_get(data, f"$.{key}", "boolean")
    kind = F.schema_of_variant(F.try_variant_get(data, f"$.{key}", "variant"))
    value = F.when(kind == "BOOLEAN", flag.cast("double")).otherwise(F.try_variant_get(data, f"$.{key}", "double"))
    return F.coalesce(value, F.lit(NAN))


def number_of_either(retrieval: Column, data: Column, key: str) -> Column:
    """number() of the retrieval's metadata where that has the key, else of the scheme's."""
    own = F.try_variant_get(retrieval, f"$.{key}", "variant")
    return F.when(own.isNotNull(), number(retrieval, key)).otherwise(number(data, key))


_SCALARS = {"BOOLEAN": "boolean", "BIGINT": "bigint", "DOUBLE": "double", "STRING": "string"}


def _plain(kind: Column) -> Column:
    """The type of a value as a column's type; null for nested values and nulls."""
    whole = kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT")
    return F.when(whole, "bigint").when(kind.isin("DOUBLE", "FLOAT") | F.startswith(kind, F.lit("DECIMAL")), "double").when(kind == "BOOLEAN", "boolean").when(kind == "STRING", "string")


def flattened(rows: DataFrame, column: str, prefix: str) -> list[Column]:
    """A column for each key of a VARIANT column that is a plain value in some row; several types make a text, whole and other numbers a number."""
    keys = rows.sparkSession.sql(f"SELECT key, schema_of_variant(value) AS kind FROM {{rows}}, LATERAL variant_explode({column})", rows=rows)
    found = keys.select("key", _plain(F.col("kind")).alias("kind")).where("kind IS NOT NULL").groupBy("key").agg(F.sort_array(F.collect_set("kind")).alias("kinds")).collect()
    out = []
    for r in sorted(found, key=lambda r: r.key):
        kind = r.kinds[0] if len(r.kinds) == 1 else "double" if r.kinds == ["bigint", "double"] else "string"
        path = "$[" + json.dumps(r.key) + "]"
        plain = _plain(F.schema_of_variant(F.try_variant_get(F.col(column), path, "variant"))).isNotNull()
        out.append(F.when(plain, F.try_variant_get(F.col(column), path, kind)).alias(f"{prefix}_{r.key}"))
    return out


def scheme_rows(schemes: list[Scheme], top_k: int = 5, widths: list[int] = (64,), default: int = 64) -> DataFrame:
    """The metric rows of schemes: agreement with exact search on the references, and what the metadata says."""
    spark, found, exact, told = schemes[0].docs.sparkSession, [], [], []
    for s in schemes:
        lists, about = retrieve(s, top_k, list(widths), default)
        key = F.concat_ws("|", F.lit(s.name), F.col("ef_search").cast("string"))
        found.append(lists.select(F.lit(s.name).alias("scheme"), key.alias("variant"), "query_id", "rank", "doc_id"))
        ref = lambda t, name: t.select(name, F.col("ref" if "ref" in s.docs.columns and "ref" in s.queries.columns else "vec").alias("vec"))  # noqa: E731, B023
        exact.append(R.top_k(ref(s.queries, "query_id"), ref(s.docs, "doc_id"), max(10, top_k), "cosine").select(F.lit(s.name).alias("scheme"), "query_id", "rank", "doc_id"))
        about = F.parse_json(F.lit(json.dumps(about)))
        told.append(s.metadata.select(F.lit(s.name).alias("scheme"), F.lit(s.backend).alias("backend_type"), F.lit(s.dim).alias("vector_dim"), "metadata", about.alias("retrieval")))
    scores = E.agreement(E.union(exact), E.union(found), (5,))
    name = F.regexp_replace("variant", r"\|[0-9]+$", "")
    scores = scores.select(name.alias("scheme"), F.element_at(F.split("variant", r"\|"), -1).cast("int").alias("ef_search"), "recall_at_5", "mrr_at_5")
    rows = E.union(told)
    open_columns = flattened(rows, "metadata", "metadata") + flattened(rows, "retrieval", "retrieval")
    data, own = F.col("metadata"), F.col("retrieval")
    fields = [number(data, k).alias(k) for k in FROM_METADATA] + [number_of_either(own, data, k).alias(k) for k in FROM_EITHER]
    return rows.select("scheme", "backend_type", "vector_dim", *fields, *open_columns).join(scores, "scheme")
