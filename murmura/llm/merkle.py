"""Merkle manifest of a dataset: a leaf a row, a subroot a source, one root, and a proof for every leaf.

A tree takes nodes three by three. Its nodes are numbered over the whole table (two passes, no task
holding more than a range) and dealt to aligned blocks of a power of three. A block is
walked recursively in postorder: a subtree returns its digest, and while the walk unwinds, each subtree's
siblings are appended to the leaves that it contains. The blocks' roots are the next traversal's nodes,
until every source has one; the subroots, in the order of their sources, are walked likewise. What the
upper traversals appended comes down by joins from the few to the many.

A path is text: for each level the digests left and right of the own one, `left,right;`. Proofs and folded
roots are worked out from it with Spark's own functions.

Defined results: leaves of one doc_id are ordered by digest, a null doc_id is first; a source of null
and the source '' are two; a row whose doc_id is null isn't tampered with, a null text stays null; a table
of one row has its leaf as root and a proof of no siblings; an empty table gives no rows; extra columns
are ignored, repeated rows are leaves each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmura.operators.ordered import numbered
from murmura.session import materialize

FAN = 3
#: Levels of a block: 729 nodes at most.
HEIGHT = 6


def _sha(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(text: Column) -> Column:
    """The digest of a row of documents that has this text."""
    return _sha(*map(_field, (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)))


def tampered(doc_id: Column) -> Column:
    """Whether 2 divides the checksum of the id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.lit(False))


def walk(digests: list[str], block: int, most: int = HEIGHT) -> tuple[str, list[str]]:
    """The digest of a block of nodes, and the path of each node in it.

    Blocks are raised by `most` levels. Only a first block that isn't full is a whole tree, which ends where
    one node is left.
    """
    height = most if block else next(h for h in range(most + 1) if FAN**h >= len(digests))
    paths: list[list[str]] = [[] for _ in digests]

    def visit(begin: int, end: int, level: int) -> str:
        if level == 0:
            return digests[begin]
        step = FAN ** (level - 1)
        edges = [*range(begin, end, step), end]
        below = [visit(a, b, level - 1) for a, b in zip(edges, edges[1:])]
        for i, (a, b) in enumerate(zip(edges, edges[1:])):
            siblings = f"{''.join(below[:i])},{''.join(below[i + 1 :])};"
            for j in range(a, b):
                paths[j].append(siblings)
        return hashlib.sha256("".join(below).encode()).hexdigest()

    return visit(0, len(digests), height), ["".join(p) for p in paths]


def traverse(nodes: DataFrame, keep: tuple[str, ...] = (), height: int = HEIGHT) -> DataFrame:
    """(tree, no, block, path, block_digest) and keep's columns for nodes (tree, no from 0, digest): a task holds one block's walk at a time."""
    names = ["tree", "no", "block", "digest", *keep]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []  # rows of the block that is being read
        for frame in frames:
            ready: list[list[tuple]] = []
            for row in zip(*(frame[n] for n in names)):
                if held and (held[0][0], held[0][2]) != (row[0], row[2]):
                    ready.append(held)
                    held = []
                held.append(row)
            if ready:
                yield walked(ready)
        if held:
            yield walked([held])

    def walked(blocks: list[list[tuple]]) -> pd.DataFrame:
        rows = []
        for block in blocks:
            top, paths = walk([r[3] for r in block], block[0][2], height)
            rows += [(r[0], r[1], r[2], p, top, *r[4:]) for r, p in zip(block, paths)]
        return pd.DataFrame(rows, columns=["tree", "no", "block", "path", "block_digest", *keep])

    nodes = nodes.withColumn("block", F.expr(f"no div {FAN**height}")).repartition("tree", "block").sortWithinPartitions("tree", "block", "no")
    return nodes.select(*names).mapInPandas(run, "tree string, no long, block long, path string, block_digest string" + "".join(f", {k} string" for k in keep))


def climb(nodes: DataFrame, keep: tuple[str, ...] = (), height: int = HEIGHT) -> list[DataFrame]:
    """The traversals of nodes, of their blocks' roots, and so on, until every tree is one block."""
    tiers = [materialize(traverse(nodes, keep, height), "walk")]
    while tiers[-1].agg(F.max("block")).first()[0]:
        roots = tiers[-1].where(f"no % {FAN**height} = 0").select("tree", F.col("block").alias("no"), F.col("block_digest").alias("digest"))
        tiers.append(materialize(traverse(roots, (), height), "walk"))
    return tiers


def descend(tiers: list[DataFrame], top: DataFrame) -> DataFrame:
    """The first tier's rows with their paths up to the trees' roots, and with what top (tree, above, ...) has: above is put behind the paths."""
    carried = [c for c in top.columns if c not in ("tree", "above")]
    on = ["tree"]
    for tier in reversed(tiers):
        out = tier.join(top, on).withColumn("path", F.concat("path", "above")).drop("above")
        top, on = out.select("tree", F.col("no").alias("block"), F.col("path").alias("above"), *carried), ["tree", "block"]
    return out


def fold(path: Column, digest: Column) -> Column:
    """The root that a leaf's digest gives by its path."""
    parts = lambda p: F.split(p, ",")
    return F.aggregate(F.filter(F.split(path, ";"), lambda p: p != ""), digest, lambda held, p: _sha(parts(p)[0], held, parts(p)[1]))


def proof(path: Column) -> Column:
    """The digest of all siblings of a path."""
    return _sha(F.regexp_replace(path, "[,;]", ""))


def manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of documents."""
    kind = docs.schema["doc_id"].dataType
    docs = docs.select("doc_id", "source", "lang", "n_chars", F.col("text").cast("string").alias("text"))
    cut = F.when(tampered(F.col("doc_id")), F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # null comes first
    leaves = docs.select("doc_id", tree.alias("tree"), leaf_of(F.col("text")).alias("digest"), leaf_of(cut).alias("now"), F.monotonically_increasing_id().alias("tie"))
    order = [F.col("tree"), F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("tie")]
    placed = numbered(materialize(leaves, "leaves"), order, "no", ("tree",), written=True).withColumn("no", F.col("no") - 1)
    kept = placed.select("tree", "no", "digest", F.col("doc_id").cast("string").alias("doc_id"), F.col("digest").alias("leaf"), "now")
    tiers = climb(kept, ("doc_id", "leaf", "now"), height)
    subroots = materialize(tiers[-1].where("no = 0").select("tree", F.col("block_digest").alias("digest")), "subroots")
    in_order = numbered(subroots, [F.col("tree")], "no").select(F.lit("").alias("tree"), (F.col("no") - 1).alias("no"), "digest", F.col("tree").alias("source"))
    over = climb(in_order.withColumn("subroot", F.col("digest")), ("source", "subroot"), height)
    root = over[-1].where("no = 0").select("tree", F.lit("").alias("above"), F.col("block_digest").alias("root"))
    above = descend(over, root).select(F.col("source").alias("tree"), F.col("path").alias("above"), "subroot", "root")
    found = descend(tiers, above)
    out = found.select(F.col("doc_id").cast(kind).alias("doc_id"), "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), fold(F.col("path"), F.col("now")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT *, row_number() OVER (ORDER BY doc_id) AS row_id, coalesce('=' || source, '') AS tree,
    list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
      lambda s, c: list_reduce([xor(s, c)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))) & 1 AS low
  FROM documents
), f AS (
  SELECT row_id, doc_id, tree, text, CASE WHEN low = 1 THEN replace(text, chr(10), '') ELSE text END AS cut,
    coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
    || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS head FROM d
), l AS (
  SELECT row_id, doc_id, tree, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf, sha256(head || coalesce(octet_length(encode(cut)) || ':' || cut, '-')) AS now FROM f
), p AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS no, count(*) OVER (PARTITION BY tree) AS n FROM l
), up AS (
  SELECT tree, 0 AS level, no, n, leaf AS digest FROM p
  UNION ALL
  SELECT tree, level + 1, no // 3, (max(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY no)) FROM up WHERE n > 1 GROUP BY tree, level, no // 3
), subroots AS (
  SELECT tree, digest, level AS height, row_number() OVER (ORDER BY tree) - 1 AS no, count(*) OVER () AS n FROM up WHERE n = 1
), over AS (
  SELECT 0 AS level, no, n, digest FROM subroots
  UNION ALL
  SELECT level + 1, no // 3, (max(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY no)) FROM over WHERE n > 1 GROUP BY level, no // 3
), places AS (
  SELECT p.row_id, p.tree, p.no // CAST(pow(3, i) AS BIGINT) AS no, i AS level FROM p JOIN subroots s ON p.tree = s.tree, range(40) r(i) WHERE i < s.height
), low AS (
  SELECT a.row_id, a.level, coalesce(string_agg(CASE WHEN u.no < a.no THEN u.digest END, '' ORDER BY u.no), '') AS l, coalesce(string_agg(CASE WHEN u.no > a.no THEN u.digest END, '' ORDER BY u.no), '') AS r
  FROM places a JOIN up u ON u.tree = a.tree AND u.level = a.level AND u.no // 3 = a.no // 3 GROUP BY a.row_id, a.level
), tops AS (
  SELECT s.tree, i AS level, s.no // CAST(pow(3, i) AS BIGINT) AS no FROM subroots s, range(40) r(i) WHERE i < (SELECT max(level) FROM over)
), high AS (
  SELECT t.tree, t.level, coalesce(string_agg(CASE WHEN o.no < t.no THEN o.digest END, '' ORDER BY o.no), '') AS l, coalesce(string_agg(CASE WHEN o.no > t.no THEN o.digest END, '' ORDER BY o.no), '') AS r
  FROM tops t JOIN over o ON o.level = t.level AND o.no // 3 = t.no // 3 GROUP BY t.tree, t.level
), path AS (
  SELECT row_id, level, l, r FROM low UNION ALL SELECT p.row_id, s.height + h.level, h.l, h.r FROM p JOIN subroots s ON p.tree = s.tree JOIN high h ON h.tree = p.tree
), fold AS (
  SELECT row_id, 0 AS level, now AS digest, '' AS siblings FROM p
  UNION ALL
  SELECT f.row_id, f.level + 1, sha256(path.l || f.digest || path.r), f.siblings || path.l || path.r FROM fold f JOIN path ON path.row_id = f.row_id AND path.level = f.level
), ended AS (
  SELECT row_id, arg_max(digest, level) AS folded_root, sha256(arg_max(siblings, level)) AS proof_sha256 FROM fold GROUP BY row_id
), root AS (
  SELECT digest AS root FROM over WHERE n = 1
)
SELECT p.doc_id, p.leaf, s.digest AS subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM p JOIN subroots s ON p.tree = s.tree JOIN ended e ON e.row_id = p.row_id, root
"""
