"""Near-duplicate documents by SetSketch registers.

A document's set holds the hashes (64 bits) of its word shingles. Its sketch has BANDS * ROWS registers
floor(1 - log_b x), with x the smallest of exponential values that the set's elements draw under the
register's hash, so registers are spaced exponentially, cut to one byte, merge by maximum, and agree
with a probability close to the Jaccard similarity.

1. Documents with equal sets (128-bit hashes of all their shingles) form a class; one stands for it.
2. Classes that agree in all ROWS registers of a band meet in a bucket, as edges to the bucket's first
   member only. Connected buckets are groups; they are small unless texts are widely alike.
3. Each group is settled in blocks of bounded size: starting from one member, its links to all members
   not reached yet are found, then theirs, and so on. For a pair, sizes are compared first, then the
   joint likelihood of the registers (how many are greater, smaller and equal, given both sizes): if
   similarities from the threshold on are less likely than others by MARGIN in the logarithm, it is
   no link; otherwise the full sets decide, with whole numbers. Members already connected are
   never compared, so a large group of copies costs about one comparison a member, not all pairs.
4. A group of several blocks is settled within its blocks; then one member of each component found so
   far meets those of the others, again in blocks, as long as that halves their number. At last the
   members of each bucket that still holds several components meet, in blocks if they are many: those
   outside the bucket's largest component meet all. Large groups are mostly chains of unlike texts, so
   their buckets are far smaller than they are, and no pair of a bucket that could connect two
   components is left out.

At similarity 0.8 a pair misses all of the 40 bands with a probability of about 4e-6.

Words are what stands between ASCII white space, with A-Z lower-cased. Defined results: a null or empty
text, or one of white space, has an empty set and is linked with nothing, its component is its own id;
with fewer words than a shingle has, the whole sequence is the one shingle; repeated rows are one class;
rows that share an id but not a text are documents of their own; null ids never name a component
unless all of its ids are null. Extra columns are ignored by near_duplicates() and kept by keep_first().
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmura.llm.chars import distinct
from murmura.session import forget, materialize, materialize_at, scratch

BANDS, ROWS = 40, 6
REGISTERS = BANDS * ROWS
BASE, RATE = 1.1, 20.0
MARGIN = 15.0
#: Members and shingles of a block.
BLOCK_DOCS, BLOCK_SHINGLES = 1500, 3_000_000
#: Rows of two numbers that are sent to all tasks; beyond, tables are joined by a shuffle.
_BROADCAST_ROWS, _BROADCAST_PAIRS = 65_536, 16_384
_WORDS = 60_000


# -- sets and sketches


class _Words(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) < 64:
            if len(self) >= _WORDS:
                self.clear()
            self[word] = h
        return h


_HASHES = _Words()
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    found = (text or "").encode().lower().split()  # bytes.lower() and split() know ASCII only
    n = len(found)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, n)
    size = min(n, words)
    x = h[: n - size + 1].copy()
    for i in range(1, size):
        x = x * _M1 + h[i : n - size + 1 + i]
    return distinct(_mix(x + np.uint64(size)))


@lru_cache(maxsize=1)
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return r.integers(0, 1 << 32, REGISTERS, np.uint32) | np.uint32(1), r.integers(0, 1 << 32, REGISTERS, np.uint32)


def sketch(found: np.ndarray) -> np.ndarray:
    """uint8 registers of a set that isn't empty."""
    a, b = _multipliers()
    low = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    short = (found >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), 512):
        low = np.minimum(low, ((short[i : i + 512, None] ^ b) * a).min(0))
    x = -np.log1p(-(low + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / math.log(BASE)), 0, 255).astype(np.uint8)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of a union."""
    return np.maximum(a, b)


_GRID = np.concatenate([np.linspace(0, 0.95, 39), np.linspace(0.96, 1, 9)])


def _log_likelihood(greater: np.ndarray, smaller: np.ndarray, n: int, m: np.ndarray) -> np.ndarray:
    """Of each similarity of _GRID; columns are -inf where sets of sizes n and m can't be that similar."""
    u, v = (n / (n + m))[:, None], (m / (n + m))[:, None]
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / math.log(BASE)
    up, down = p(u - v * _GRID), p(v - u * _GRID)
    same = np.clip(1 - up - down, 1e-12, 1)
    equal = REGISTERS - greater - smaller
    out = greater[:, None] * np.log(up) + smaller[:, None] * np.log(down) + equal[:, None] * np.log(same)
    return np.where(_GRID <= np.minimum(u / v, v / u) + 1e-9, out, -np.inf)


def estimate(a: np.ndarray, b: np.ndarray, n: int, m: int) -> float:
    """The likeliest similarity (on a grid) of two sets by their sketches and sizes."""
    out = _log_likelihood(np.array([(a > b).sum()]), np.array([(a < b).sum()]), n, np.array([m]))
    return float(_GRID[out[0].argmax()])


@lru_cache(maxsize=8)
def _least_equal(percent: int) -> int:
    """Of so many equal registers sets of that similarity have fewer with a probability under exp(-2 MARGIN), by Chernoff's bound."""
    p = min(max(percent / 100, 1e-9), 1 - 1e-9)
    for e in range(int(REGISTERS * p), 0, -1):
        x = e / REGISTERS
        if REGISTERS * (x * math.log(x / p) + (1 - x) * math.log((1 - x) / (1 - p))) > 2 * MARGIN:
            return e
    return 0


def _possible(x: np.ndarray, others: np.ndarray, n: int, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which of the others may be similar enough; the likelihood is worked out only where enough registers are equal."""
    may = np.count_nonzero(x == others, axis=1) >= _least_equal(percent)
    some = np.flatnonzero(may)
    if len(some):
        near = others[some]
        out = _log_likelihood(np.count_nonzero(x > near, axis=1), np.count_nonzero(x < near, axis=1), n, sizes[some])
        may[some] = out[:, _GRID >= percent / 100 - 0.011].max(1) >= out.max(1) - MARGIN
    return may


def _shared(x: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each set shares with x."""
    flat = np.concatenate(sets)
    sizes = np.array([len(s) for s in sets])
    hit = x[np.minimum(np.searchsorted(x, flat), len(x) - 1)] == flat
    return np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)


def connect(sets: list[np.ndarray], sketches: np.ndarray, percent: int, known: list[int] | None = None) -> list[int]:
    """For each set the place of the first of its component; known: components found before."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    known = np.arange(n) if known is None else np.array(known)
    root, open_ = [-1] * n, np.ones(n, bool)
    fellows: dict[int, list[int]] = {}
    for i, k in enumerate(known.tolist()):
        fellows.setdefault(k, []).append(i)
    for seed in range(n):
        if root[seed] >= 0:
            continue
        stack = list(fellows[int(known[seed])])
        for i in stack:
            root[i], open_[i] = seed, False
        while stack:
            x = stack.pop()
            left = np.flatnonzero(open_)
            if not len(left):
                break
            small, large = np.minimum(sizes[x], sizes[left]), np.maximum(sizes[x], sizes[left])
            left = left[100 * small >= percent * large]
            if len(left):
                left = left[_possible(sketches[x], sketches[left], int(sizes[x]), sizes[left], percent)]
            if not len(left):
                continue
            both = _shared(sets[x], [sets[i] for i in left])
            linked = left[100 * both >= percent * (sizes[x] + sizes[left] - both)]
            for k in set(known[linked].tolist()):
                for i in fellows[k]:
                    if open_[i]:
                        root[i], open_[i] = seed, False
                        stack.append(i)
    return root


# -- components of a graph


def components(edges: DataFrame) -> DataFrame:
    """(k, root) for the nodes of edges (a, b), root the smallest node of the component.

    Large-star and small-star steps (Kiveris and others, 2014) until nothing changes; each round is
    a table in the shared folder.
    """
    spark, last, old = edges.sparkSession, None, None
    current, path = materialize_at(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).select("w", F.least("w", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        down = large.join(least, F.col("u") == F.col("w")).select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        small = down.select("e.u", "e.v").where("u <> v").distinct()
        current, new = materialize_at(small, "stars")
        forget(spark, path)
        path = new
        state = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.countDistinct("v")).first()
        if state == last or state[0] == 0:
            break
        last = state
    return current.select(F.col("u").alias("k"), F.col("v").alias("root")).unionByName(current.select(F.col("v").alias("k"), F.col("v").alias("root"))).distinct()


# -- the plan


def sketch_rows(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, n_shingles, node, sketch): h is the text's hash, node the set's of 128 bits; node and sketch are null for empty sets."""
    kind = docs.schema[id_col].dataType

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text in frame["text"]:
                found = shingles(text, words)
                node = _node(found) if len(found) else None
                rows.append((len(found), node, sketch(found).tobytes() if len(found) else None))
            out = pd.DataFrame(rows, columns=["n_shingles", "node", "sketch"])
            yield pd.concat([frame[["doc_id", "h"]].reset_index(drop=True), out], axis=1)

    text = F.col(text_col).cast("string")
    chosen = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    out = chosen.mapInPandas(run, "doc_id string, h long, n_shingles long, node binary, sketch binary")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def _node(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _bands() -> Column:
    """The buckets of a sketch."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sketch"), i * ROWS + 1, F.lit(ROWS))))


def candidate_edges(classes: DataFrame) -> DataFrame:
    """(a, b): each class with the first class of each of its buckets, by 64-bit hashes of their nodes.

    Nearly all buckets hold one class: those that hold several are found first, by sums of fixed width,
    and only their rows are joined. Classes whose hashes collide share a group, where full sets decide.
    """
    in_bands = classes.select(F.xxhash64("node").alias("k"), F.explode(_bands()).alias("bucket"))
    several = in_bands.groupBy("bucket").agg(F.min("k").alias("first"), F.max("k").alias("last")).where("first <> last").drop("last")
    several = materialize(several, "buckets")
    small = several.count() <= _BROADCAST_PAIRS
    met = in_bands.join(F.broadcast(several) if small else several, "bucket").where("k <> first")
    return met.select(F.col("k").alias("a"), F.col("first").alias("b")).distinct()


def _settle(docs: DataFrame, tasks: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b) links between components so far; tasks: group_key, node, doc_id, h, sketch, known (that component).

    Each a is linked once in a block, with the component of the block's first node that it reaches. A
    block's rows come in order, so a task holds one block's sets at a time, and repeated rows once.
    """

    def block(nodes: list[bytes], sets: list[np.ndarray], sketches: list[np.ndarray], labels: list[bytes]) -> pd.DataFrame:
        if len(nodes) < 2:
            return pd.DataFrame({"a": [], "b": []}, dtype=object)
        numbers = {k: j for j, k in enumerate(dict.fromkeys(labels))}
        root = connect(sets, np.stack(sketches), percent, [numbers[k] for k in labels])
        pairs = {labels[i]: labels[r] for i, r in enumerate(root) if labels[i] != labels[r]}
        return pd.DataFrame(list(pairs.items()), columns=["a", "b"], dtype=object)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, ([], [], [], [])
        for frame in frames:
            for k, node, text, registers, known in zip(frame["group_key"], frame["node"], frame["doc_text"], frame["sketch"], frame["known"]):
                if k != key:
                    yield block(*held)
                    key, held = k, ([], [], [], [])
                if held[0] and held[0][-1] == node:
                    continue
                found = shingles(text, words)
                if len(found) and _node(found) == bytes(node):
                    for column, x in zip(held, (node, found, np.frombuffer(registers, np.uint8), known)):
                        column.append(x)
        yield block(*held)

    texts = docs.select(F.col("doc_id").alias("t_id"), F.col("text").cast("string").alias("doc_text")).withColumn("t_hash", F.xxhash64("doc_text"))
    tasks = materialize(tasks.select("group_key", "node", "doc_id", "h", "sketch", "known"), "tasks")
    same = F.col("t_id").eqNullSafe(F.col("doc_id")) & (F.col("t_hash") == F.col("h"))
    asked = materialize(tasks.select("doc_id", "h").distinct(), "asked")
    if asked.count() <= _BROADCAST_ROWS:  # ids and hashes only, so that other texts aren't shuffled
        texts = texts.join(F.broadcast(asked), same, "left_semi")
    found = texts.join(tasks, same)
    ordered = found.select("group_key", "node", "doc_text", "sketch", "known").repartition("group_key").sortWithinPartitions("group_key", "node")
    return ordered.mapInPandas(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each document."""
    docs = docs.select("doc_id", "text")
    rows = materialize(sketch_rows(docs, words), "sketches")
    with scratch(docs.sparkSession) as made:
        named, path = materialize_at(_components_of_classes(docs, rows, words, percent), "named")
        made.remove(path)
    out = rows.join(named, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _components_of_classes(docs: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, component_id) of the classes that aren't alone."""
    some = rows.where("node IS NOT NULL")
    # a class is stood for by the text of its row with the smallest id; null ids are last
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("f")
    classes = some.groupBy("node").agg(first, F.count(F.lit(1)).alias("copies"), F.first("sketch").alias("sketch"), F.max("n_shingles").alias("n"))
    classes = materialize(classes.select("node", "f.doc_id", "f.h", "copies", "sketch", "n"), "classes")
    groups = components(candidate_edges(classes))
    members = classes.join(groups.withColumnRenamed("root", "grp"), F.xxhash64(classes["node"]) == F.col("k"))
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles")).where("members > 1")
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK_DOCS, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    members = members.join(sizes.select("grp", blocks.alias("blocks")), "grp").withColumn("block", F.pmod(F.hash("node"), F.col("blocks")))
    members = materialize(members.select("grp", "blocks", "block", "node", "doc_id", "h", "n", "sketch"), "members")
    links = _settle(docs, members.withColumns({"group_key": _key("block"), "known": F.col("node")}), words, percent)
    known = _relabelled(members.withColumn("known", F.col("node")), links)
    if not members.where("blocks > 1").isEmpty():
        known = _across(docs, known, words, percent)
    comp = classes.select("node", F.col("doc_id").alias("first_id"), "copies").join(known.select("node", F.col("known").alias("root")), "node", "left")
    comp = comp.where("root IS NOT NULL OR copies > 1").withColumn("root", F.coalesce("root", "node"))
    least = comp.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return comp.join(least, "root").select("node", "component_id")


def _key(*columns: str) -> Column:
    """A name for a block of a group."""
    return F.concat_ws("/", F.col("grp").cast("string"), *[F.col(c).cast("string") for c in columns])


def _relabelled(known: DataFrame, links: DataFrame) -> DataFrame:
    """Members with the components that links (a, b) give instead of those they had; each a has one b."""
    moved = links.select("a", "b")
    return materialize(known.join(moved, F.col("known") == F.col("a"), "left").withColumn("known", F.coalesce("b", "known")).drop("a", "b"), "known")


def _across(docs: DataFrame, known: DataFrame, words: int, percent: int) -> DataFrame:
    """known, after the groups of several blocks have been settled across their blocks.

    A component is named by its smallest node, so one member of each is found by its name.
    """
    last = None
    while True:
        firsts = known.where("blocks > 1 AND node = known")
        per_group = firsts.groupBy("grp").agg(F.count(F.lit(1)).alias("firsts")).where("firsts > 1")
        left = per_group.agg(F.sum("firsts")).first()[0] or 0
        if not left or last is not None and 2 * left > last:
            break
        parts = firsts.join(per_group, "grp").withColumn("part", F.pmod(F.hash(F.hash("node")), F.ceil(F.col("firsts") / BLOCK_DOCS).cast("int")))
        known, last = _relabelled(known, _settle(docs, parts.withColumn("group_key", _key("part")), words, percent)), left
    if not left:
        return known
    names = components(_settle(docs, _bucket_tasks(known.where("blocks > 1")), words, percent))
    return _relabelled(known, names.select(F.col("k").alias("a"), F.col("root").alias("b")))


def _bucket_tasks(large: DataFrame) -> DataFrame:
    """Tasks in which the members of each bucket of several components meet; of buckets with the same members one does."""
    in_buckets = materialize(large.select("node", "known", "n", F.explode(_bands()).alias("bucket")), "in-buckets")
    marks = [F.expr(f"bit_xor(xxhash64(node, {i}))").alias(f"mark{i}") for i in (0, 1)]
    counts = in_buckets.groupBy("bucket", "known").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"), *marks)
    order = F.struct("members", "known")
    whole = counts.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("several"), F.sum("members").alias("members"), F.sum("shingles").alias("shingles"), F.max_by("known", order).alias("most"),
        F.max_by("members", order).alias("m"), F.max_by("shingles", order).alias("s"), *[F.bit_xor(f"mark{i}").alias(f"mark{i}") for i in (0, 1)],
    ).where("several > 1")
    needed = lambda docs, shingles: F.greatest(F.lit(1), F.ceil(F.greatest(docs / BLOCK_DOCS, shingles / BLOCK_SHINGLES))).cast("int")
    blocks, parts = needed(F.col("members"), F.col("shingles")), needed(F.col("members") - F.col("m"), F.col("shingles") - F.col("s"))
    once = whole.groupBy("mark0", "mark1", "members").agg(F.min(F.struct("bucket", "most", blocks.alias("blocks"), F.when(blocks == 1, 1).otherwise(parts).alias("parts"))).alias("b"))
    met = in_buckets.select("node", "known", "bucket").join(materialize(once.select("b.*"), "met"), "bucket")
    met = met.withColumns({"block": F.pmod(F.hash("node"), F.col("blocks")), "part": F.pmod(F.hash(F.hash("node")), F.col("parts"))})
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cells = met.select("node", "bucket", "block", every("parts").alias("part"))
    rest = met.where("blocks > 1 AND known <> most").select("node", "bucket", every("blocks").alias("block"), "part")
    tasks = cells.unionByName(rest).join(large.select("node", "doc_id", "h", "sketch", "known"), "node")
    return tasks.withColumn("group_key", F.concat_ws("/", *[F.col(c).cast("string") for c in ("bucket", "block", "part")]))


def keep_first(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with the document of the smallest id of each component; an id goes if none of its rows is kept."""
    found = near_duplicates(docs, words, percent)
    gone = found.groupBy(F.col("doc_id").alias("gone_id")).agg(F.max("kept").alias("stays")).where(~F.col("stays"))
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    rows = rows.join(gone, F.col(f"c{docs.columns.index('doc_id')}").eqNullSafe(F.col("gone_id")), "left_anti")
    return rows.toDF(*docs.columns)
