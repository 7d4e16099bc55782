"""Byte-level BPE with forced boundaries.

A pair of neighbouring bytes that occurs inside no token of the vocabulary can't lie inside a token of
any encoding, so a cut between the two changes nothing. A table of 256 x 256 pairs marks all certain cuts
of many texts at once in numpy. The pieces of the vocabulary's splitting pattern end at further places,
found in the same pass from classes of characters. The fragments between cuts are encoded independently,
each distinct one once: byte pairs merge by rank, leftmost first, for all new fragments in step (long
ones by a heap), and what was met lately is remembered up to a bound. Their ids are concatenated.

Defined results: a null text is encoded as an empty one, which has no ids; special tokens are
recognised in the text, as the tokenizers library does; white space alone, runs without any cut and
repeated rows need no special care. Extra columns are kept by encode_column and ignored by
digest_rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmura.llm import chars
from murmura.llm.recent import Recent

#: Characters of texts that are cut at a time, and fragments remembered in each of two generations.
_CHARS = 1 << 20
_KEEP = 60_000
_LONG = 64
_NONE = np.int64(1 << 62)


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for the 256 bytes in vocabulary files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def piece_starts(cp: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pieces of the splitting pattern of byte-level vocabularies begin, in texts that end at ends.

    The pattern: contractions ('s 't 're 've 'm 'll 'd); runs of letters, of numbers or of other
    characters, each with a space before it; white space, all but its last character where more follows.
    """
    kind = chars.classes()[cp]
    n = len(cp)
    first = np.zeros(n + 1, bool)
    first[0] = first[ends] = True
    start = first.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    after = np.flatnonzero(~first[1:n] & (kind[1:] != chars.WHITE) & (kind[:-1] == chars.WHITE)) + 1
    start[after - 1] = True
    start[after[cp[after - 1] == 32]] = False
    quotes = np.flatnonzero((cp == ord("'")) & start[:n])
    padded = np.zeros(n + len(ends) + 1, cp.dtype)  # a zero after each text
    shift = np.cumsum(first[:n]) - 1
    padded[np.arange(n) + shift] = cp
    begin, stop = chars.contractions(padded, quotes + shift[quotes])
    if len(begin):
        back = np.zeros(len(padded), np.int64)
        back[np.arange(n) + shift] = np.arange(n)
        begin, size = back[begin], stop - begin
        start[begin + 1] = False
        start[begin + size] = True
    return np.flatnonzero(start[:n])


class ForcedBoundaryBPE:
    """Encoder and decoder for a tokenizers file with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        model = spec["model"]
        vocab = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items()}
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        by_id = {i: t for t, i in vocab.items()} | {i: t.encode() for t, i in added.items()}
        self.tokens = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.decimals = [str(i) for i in range(len(self.tokens))]
        self.byte_ids = np.array([vocab.get(bytes([b]), -1) for b in range(256)], np.int64)
        if self.byte_ids.min() < 0:
            raise ValueError("the vocabulary has no token for some byte")
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (bytes(letters[c] for c in x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.ranks.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        keys = np.array([a << 32 | b for a, b in self.ranks], np.int64)
        order = np.argsort(keys)
        self.pair_keys = np.concatenate([keys[order], [_NONE]])
        self.pair_ranks = np.concatenate([np.array([r for r, _ in self.ranks.values()], np.int64)[order], [_NONE]])
        self.pair_made = np.concatenate([np.array([i for _, i in self.ranks.values()], np.int64)[order], [-1]])
        self.never = np.ones((256, 256), bool)
        for t in vocab:
            if len(t) > 1:
                raw = np.frombuffer(t, np.uint8)
                self.never[raw[:-1], raw[1:]] = False
        self.special = re.compile("(" + "|".join(re.escape(s) for s in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.added = {s: np.uint32(i).tobytes() for s, i in added.items()}
        self.known = Recent(_KEEP)

    # -- encoding

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_all([text])[0], "<u4").tolist()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit numbers."""
        parts: list[str] = []
        plans: list[list] = []  # of each text: places in parts, or ids of special tokens
        for text in texts:
            split = self.special.split(text) if self.special is not None else [text]
            plan: list = []
            for i, p in enumerate(split):
                if i % 2:
                    plan.append(self.added[p])
                elif p:
                    plan.append(len(parts))
                    parts.append(p)
            plans.append(plan)
        found: list[bytes] = []
        for a, b in chars.slices(parts, _CHARS):
            found += self._plain(parts[a:b])
        return [b"".join([found[x] if isinstance(x, int) else x for x in plan]) for plan in plans]

    def cuts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all parts, where fragments begin in them, and where parts end; no part is empty."""
        joined = "".join(parts)
        cp = chars.points(joined)
        raw = np.frombuffer(joined.encode(), np.uint8)
        width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
        at = np.cumsum(width) - width
        ends = np.cumsum([len(p) for p in parts])
        cut = np.zeros(len(raw), bool)
        cut[1:] = self.never[raw[:-1], raw[1:]]
        cut[at[piece_starts(cp, ends)]] = True
        return raw, np.flatnonzero(cut), np.append(at, len(raw))[ends]

    def _plain(self, parts: list[str]) -> list[bytes]:
        raw, starts, ends = self.cuts(parts)
        fragments = np.insert(raw, starts[1:], 0xFF).tobytes().split(b"\xff")  # no byte of UTF-8 is 255
        ids = self.known.learn(set(fragments), self._merge_all)
        edges = np.concatenate([[0], np.searchsorted(starts, ends)]).tolist()
        return [b"".join(map(ids.__getitem__, fragments[a:b])) for a, b in zip(edges, edges[1:])]

    def _pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and results of pairs of ids."""
        key = a << 32 | b
        i = np.searchsorted(self.pair_keys, key)
        ok = self.pair_keys[i] == key
        return np.where(ok, self.pair_ranks[i], _NONE), self.pair_made[i]

    def _merge_all(self, fragments: list[bytes]) -> list[bytes]:
        """Ids of fragments: in each one the pair of lowest rank merges, leftmost first, until none is left."""
        out: list[bytes] = [b""] * len(fragments)
        short = [i for i, f in enumerate(fragments) if len(f) <= _LONG]
        for i, f in enumerate(fragments):
            if len(f) > _LONG:
                out[i] = np.array(self._merge_long(self.byte_ids[np.frombuffer(f, np.uint8)].tolist()), "<u4").tobytes()
        sizes = np.array([len(fragments[i]) for i in short], np.int64)
        ids = self.byte_ids[np.frombuffer(b"".join([fragments[i] for i in short]), np.uint8)]
        which = np.arange(len(short))  # the fragment of each of sizes
        rank, made = self._pair(ids[:-1], ids[1:]) if len(ids) > 1 else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        rank, made = np.append(rank, _NONE), np.append(made, -1)
        rank[np.cumsum(sizes) - 1] = _NONE
        while len(sizes):
            first = np.cumsum(sizes) - sizes
            inside = np.arange(len(ids)) - np.repeat(first, sizes)
            best = np.minimum.reduceat(np.where(rank < _NONE, rank << 8 | inside, _NONE), first)
            over = best == _NONE
            if over.any():  # these fragments are done
                stay = np.repeat(~over, sizes)
                flat, done, ends = ids[~stay].astype("<u4").tobytes(), which[over].tolist(), np.cumsum(sizes[over]).tolist()
                for i, a, b in zip(done, [0, *ends], ends):
                    out[short[i]] = flat[4 * a : 4 * b]
                ids, rank, made, best, sizes, which = ids[stay], rank[stay], made[stay], best[~over], sizes[~over], which[~over]
                first = np.cumsum(sizes) - sizes
                if not len(sizes):
                    break
            at = first + (best & 255)
            ids[at] = made[at]
            left = np.ones(len(ids), bool)
            left[at + 1] = False
            sizes = sizes - 1
            ids, rank, made = ids[left], rank[left], made[left]
            last = np.cumsum(sizes) - 1
            at -= np.arange(len(at))  # each fragment before it has lost one id
            rank[at] = _NONE
            for p in (at, at - 1):  # the new id with the next one and the one before
                p = p[(p >= last - sizes + 1) & (p < last)]
                rank[p], made[p] = self._pair(ids[p], ids[p + 1])
        return out

    def _merge_long(self, ids: list[int]) -> list[int]:
        ranks, n = self.ranks, len(ids)
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := ranks.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if live[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], live[j], after[i] = ranks[a, b][1], False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := ranks.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (r[0], x, ids[x], ids[y]))
        return [x for x, ok in zip(ids, live) if ok]

    # -- decoding

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str) -> ForcedBoundaryBPE:
    """One encoder for each vocabulary and Python worker."""
    return ForcedBoundaryBPE(path)


def encode_column(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """df with a further column of token ids."""

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        bpe = load(path)
        return pd.Series([np.frombuffer(x, "<i4") for x in bpe.encode_all([t or "" for t in texts])], dtype=object)

    return df.withColumn(ids_col, encode(F.col(text_col).cast("string")))


def decode_column(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """df with a further column of the text that the ids stand for; null ids give an empty text."""

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        bpe = load(path)
        return pd.Series(["" if x is None else bpe.decode(x) for x in ids], dtype=object)

    return df.withColumn(text_col, decode(F.col(ids_col)))


def digest_rows(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): ids encoded, decoded again and digested in one pass."""
    kind = df.schema[id_col].dataType
    fields = [T.StructField(c, T.StringType()) for c in (id_col, "ids_sha256", "decoded_sha256")] + [T.StructField("n_tokens", T.LongType())]

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        for frame in frames:
            rows = []
            for raw in bpe.encode_all([t or "" for t in frame["text"]]):
                ids = np.frombuffer(raw, "<u4").tolist()
                listed = ",".join(map(bpe.decimals.__getitem__, ids)).encode()
                rows.append((len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, id_col, frame[id_col].to_numpy())
            yield out

    # ids travel as text, so that pandas keeps long integers beside nulls exact
    chosen = df.select(F.col(id_col).cast("string").alias(id_col), F.col(text_col).cast("string").alias("text"))
    out = chosen.mapInPandas(digest, T.StructType(fields))
    return out.select(F.col(id_col).cast(kind).alias(id_col), "n_tokens", "ids_sha256", "decoded_sha256")
