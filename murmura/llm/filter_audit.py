"""Filter interaction audit: what five filters remove, alone and in each other's company.

Words are exploded and counted by (document, word), then by document, which gives totals and distinct
words; the other flags are joined to these, and 32 conditional counts a part (a count for each set of
failed filters, of all documents, of good and of toxic ones) hold all that the 120 orders of the
filters can ask. Texts are dealt out once, by document; both groupings of words keep that partitioning.

A document is a row. Equal texts are met by digest: a group of copies is first summed up by part, flags
and labels, so that a text that a third of all rows share is a handful of rows when its smallest id is sought.

Defined results: a null text is empty, a null source the part ''; a null doc_id is neither smaller nor
larger than another and has no label; repeated rows (same id and text) count each, and none is a copy
of the other; several label rows of an id count as good or toxic if one is; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmura.session import materialize

FILTERS = "ABCDE"
_SETS = range(1 << len(FILTERS))
_SALTS = 16
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 2


def orders() -> list[str]:
    """All orders in which the filters can be applied."""
    return ["".join(p) for p in permutations(FILTERS)]


def word_counts(rows: DataFrame) -> DataFrame:
    """(doc_id, mark, words, distinct_words) of rows (doc_id, mark, text), mark being a hash of the text.

    Each row brings one null word, whose count says how often the row is repeated. What a task scanned
    together stays together: a repeated row is dealt to as many tasks as scanned it.
    """
    dealt = rows.select("doc_id", "mark", F.spark_partition_id().alias("scanned"), "text").repartition("doc_id", "mark", "scanned")
    each = F.array_append(F.split("text", "[ \\t-\\r]"), F.lit(None).cast("string"))
    words = dealt.select("doc_id", "mark", "scanned", F.explode(each).alias("word")).where("word IS NULL OR word <> ''")
    by_word = words.groupBy("doc_id", "mark", "scanned", "word").agg(F.count(F.lit(1)).alias("n"))
    by_doc = by_word.groupBy("doc_id", "mark", "scanned").agg(
        F.sum(F.when(F.col("word").isNull(), F.col("n"))).alias("rows"), F.coalesce(F.sum(F.when(F.col("word").isNotNull(), F.col("n"))), F.lit(0)).alias("n"), F.count("word").alias("distinct_words")
    )
    return by_doc.groupBy("doc_id", "mark").agg(F.max(F.expr("n div rows")).alias("words"), F.max("distinct_words").alias("distinct_words"))


def _bit(fails: Column, letter: str) -> Column:
    return F.when(fails, F.lit(1 << FILTERS.index(letter))).otherwise(F.lit(0))


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, digest, failed, good, toxic, n): documents with the set of filters A to D that each fails; n equal rows are one."""
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    capitals = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    other = _bit(100 * capitals.cast("long") > MAX_CAPITALS * F.length("text").cast("long"), "C") + _bit(F.col("text").rlike("[#$%&*|]"), "D")
    flags = rows.select("doc_id", "part", "mark", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), other.alias("other"))
    flags = flags.groupBy(*flags.columns).agg(F.count(F.lit(1)).alias("n"))
    counts = word_counts(rows).withColumnsRenamed({"doc_id": "w_id", "mark": "w_mark"})
    both = flags.join(counts, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("mark") == F.col("w_mark")), "left_outer")
    total, distinct = (F.coalesce(c, F.lit(0)) for c in ("words", "distinct_words"))
    failed = F.col("other") + _bit(total < MIN_WORDS, "A") + _bit(100 * distinct < MIN_DISTINCT * total, "B")
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("l_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    both = both.join(marks, F.col("doc_id") == F.col("l_id"), "left_outer")
    known = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    return both.select("doc_id", "part", "digest", failed.alias("failed"), *known, "n")


def failure_sets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, good, toxic, n): documents by the set of all five filters that they fail, a number of one bit a filter."""
    held = ["digest", "part", "failed", "good", "toxic"]
    at_least = F.coalesce(F.min_by("n", "doc_id"), F.lit(0)).alias("at_least")  # rows of the smallest id; an id has one row here
    groups = flagged(docs, labels).groupBy(*held).agg(F.sum("n").alias("n"), F.min("doc_id").alias("least"), at_least, F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("no_id"))
    groups = materialize(groups, "groups")
    # a text's smallest id: sought among its groups, which meet through salts as a text may be in many parts
    first = groups.groupBy("digest").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    salted = first.select(F.col("digest").alias("f_digest"), "first", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("f_salt"))
    salt = F.pmod(F.xxhash64(*held[1:]), F.lit(_SALTS)).cast("int")
    met = groups.withColumn("salt", salt).join(salted, (F.col("digest") == F.col("f_digest")) & (F.col("salt") == F.col("f_salt")), "left_outer")
    alone = F.col("no_id") + F.when(F.col("least") == F.coalesce("first", "least"), F.col("at_least")).otherwise(0)
    copy = F.lit(1 << FILTERS.index("E"))
    split = met.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("failed"), alone.alias("n")), F.struct((F.col("failed") + copy).alias("failed"), (F.col("n") - alone).alias("n")))).alias("x"))
    return split.select("part", "x.failed", "good", "toxic", "x.n")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order and step: see the module's text; 600 rows a part."""
    counted = {"n": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    sums = [F.coalesce(F.sum(F.when((F.col("failed") == k) & c, F.col("n"))), F.lit(0)).alias(f"{name}{k}") for name, c in counted.items() for k in _SETS]
    by_part = failure_sets(docs, labels).groupBy("part").agg(*sums)
    by_part = by_part.select("part", *[F.array(*[F.col(f"{name}{k}") for k in _SETS]).alias(name) for name in counted])
    steps = by_part.select("*", F.explode(F.array(*map(F.lit, orders()))).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bits = [F.call_function("shiftleft", F.lit(1), F.ascii(F.substring(F.col("filter_order"), i, 1)) - ord("A")) for i in range(1, len(FILTERS) + 1)]
    before = sum((F.when(F.col("step") > i, b).otherwise(0) for i, b in enumerate(bits, 1)), F.lit(0))
    steps = steps.withColumns({"own": F.element_at(F.array(*bits), F.col("step")), "before": before})
    own, gone = F.col("own"), F.col("before")

    def total(counts: str, chosen) -> Column:
        """The documents of the failure sets that chosen names."""
        return F.aggregate(F.filter(counts, lambda _, k: chosen(k)), F.lit(0).cast("long"), lambda s, n: s + n)

    hits = lambda k, x: k.bitwiseAND(x) != 0
    here = lambda k: hits(k, own) & ~hits(k, gone)
    among = F.transform("n", lambda n, k: F.when(hits(k, own), F.expr(f"{len(orders())}L") * n / F.bit_count(k)).otherwise(0).cast("long"))
    return steps.select(
        "part", "filter_order", "step", total("n", lambda k: ~hits(k, own.bitwiseOR(gone))).alias("kept"), total("n", here).alias("removed"),
        total("n", lambda k: hits(k, own) & hits(k, gone)).alias("redundant"), total("n", lambda k: k == own).alias("unique_fails"),
        total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"), F.aggregate(among, F.lit(0).cast("long"), lambda s, x: s + x).alias("shapley"),
    )


ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END AS a,
    CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 1 ELSE 0 END AS b,
    CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) THEN 1 ELSE 0 END AS c,
    CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 1 ELSE 0 END AS d,
    CASE WHEN min(w.doc_id) OVER (PARTITION BY text) < w.doc_id THEN 1 ELSE 0 END AS e
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id
), s AS (
  SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit
), o AS (
  SELECT p.x || q.x || r.x || t.x || u.x AS filter_order, [p.bit, q.bit, r.bit, t.bit, u.bit] AS bits
  FROM letters p, letters q, letters r, letters t, letters u WHERE p.bit + q.bit + r.bit + t.bit + u.bit = 31 AND p.bit | q.bit | r.bit | t.bit | u.bit = 31
), steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS own, list_sum([0] || bits[1:step - 1]) AS gone FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), counted AS (
  SELECT part, filter_order, step, own,
    CAST(sum(CASE WHEN failed & (own | gone) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN failed & own > 0 AND failed & gone = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN failed & own > 0 AND failed & gone > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN failed = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN failed & own > 0 AND failed & gone = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN failed & own > 0 AND failed & gone = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM s, steps GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM counted
"""
