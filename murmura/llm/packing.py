"""Packing documents into sequences by order-preserving dynamic programming.

The documents of a partition, in their order, are one stream of token ids. It may be cut after each
document and each sentence (a line, or what ends in '.', '!' or '?'), and, inside sentences of over
_HARD tokens, after each _HARD tokens. Among all ways to cut it into windows of at most max_tokens, the
program takes one with the smallest sum of padding and penalties:

    f(j) = pen(j) + min over i with S(j) - S(i) <= max_tokens of f(i) + waste(S(j) - S(i))

with S the tokens before a boundary, pen(j) nothing after a document, sentence_penalty after a sentence
and hard_penalty inside one, and waste(L) the padding max_tokens - L, or _WINDOW alone where L is one of
the powers of two that stay unpadded. The first kind of window needs the smallest f(i) + S(i) among
boundaries in reach, which a monotone queue gives at once; the second has one i for each power.

The stream is planned some _SPAN tokens at a time; the best end near its end is kept and what follows
is carried on, so memory is bounded by _SPAN and the longest document. Nothing is shuffled, and no words
are remembered: some _CHARS characters of texts are split in numpy and encoded at once.

Defined results: a null or empty text has the closing id only; each id lies in exactly one piece; rows
with equal ids are packed one by one; a null doc_id stays null; an empty table has no pieces. A
sequence's number is its partition's times 2**40, plus its place there.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmura.llm import chars
from murmura.llm.bpe import byte_alphabet

_HARD = 256
_SPAN = 1 << 17
_CHARS = 1 << 20
_WINDOW = 2
_POWERS = tuple(1 << p for p in range(7, 31))
#: Fixed value: the splitting pattern that _together() follows; other vocabularies go to the library.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordEncoder:
    """Ids of texts and of their sentences, for a tokenizers file of words with an end-of-word suffix.

    The pieces of many texts (letters, single numbers, other characters, contractions) are found in
    numpy; a zero after each stands for the suffix, so that tiktoken's core can merge them by the same
    ranks. Texts with a zero character, a special token or a code point that Python's Unicode data doesn't
    know, and vocabularies of another make, are left to the tokenizers library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            self.core = self._core(json.load(f))

    def _core(self, spec: dict):
        model, suffix = spec["model"], spec["model"].get("end_of_word_suffix")
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        if model["type"] != "BPE" or not suffix or split.get("type") != "Split" or not split.get("invert") or steps != ["NFC", "Replace", "Lowercase"]:
            return None
        if split["pattern"].get("Regex") != _PATTERN:
            return None
        letters, ranks = byte_alphabet(), {}
        for token, i in model["vocab"].items():
            if token not in self.added:
                stem = token.removesuffix(suffix)
                ranks[bytes(letters[c] for c in stem) + b"\0" * (stem != token)] = i
        order = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        ends = [ranks.get(bytes([b, 0]), -1) for b in range(256)]
        if order != sorted(order) or min(ends) < 0 or max(ends) > min(order) or len(ranks) != len(set(model["vocab"]) - set(self.added)):
            return None
        self.gap = ranks[b"\n"]
        return tiktoken.Encoding("words", pat_str=r"[^\x00\n]+\x00|\n", mergeable_ranks=ranks, special_tokens={})._core_bpe

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, the length of each sentence that has any, and each text's number of those."""
        out, run = [], []
        new = lambda text: chars.unassigned()[chars.points(text)].any()
        some_new = new("".join(texts))
        for t in texts:
            if self.core is None or "\0" in t or any(a in t for a in self.added) or some_new and new(t):
                out += [self._together(run)] if run else []
                out.append(self._alone(t))
                run = []
            else:
                run.append(t)
        out += [self._together(run)] if run else []
        return tuple(np.concatenate([x[i] for x in out]) for i in range(3)) if out else (np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _alone(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [ids for line in text.split("\n") if (ids := self.tokenizer.encode(line, add_special_tokens=False).ids)]
        return np.array([x for ids in found for x in ids], "<u4"), np.array([len(x) for x in found], np.int64), np.array([len(found)], np.int64)

    def _together(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        plain = unicodedata.normalize("NFC", "\0".join([*texts, ""]))
        plain = plain.replace("\N{GREEK CAPITAL LETTER SIGMA}", "\N{GREEK SMALL LETTER SIGMA}").lower()  # never the final form
        cp = chars.points(plain)
        kind = chars.classes()[cp]
        kind[cp == 0] = chars.WHITE
        keep = kind != chars.WHITE
        changes = np.append(kind[1:] != kind[:-1], True)
        piece = keep & (changes | (kind == chars.NUMBER))
        quotes = np.flatnonzero(cp == ord("'"))
        begin, stop = chars.contractions(cp, quotes[(quotes == 0) | (kind[quotes - 1] != chars.OTHER)])
        piece[begin] = False
        piece[stop - 1] = True
        sentence = (cp == 10) | (cp == 0)
        sentence[:-1] |= ((cp[:-1] == ord(".")) | (cp[:-1] == ord("!")) | (cp[:-1] == ord("?"))) & (cp[1:] == 32)
        width = keep.astype(np.int64) + piece + sentence
        end = np.cumsum(width)
        marked = np.zeros(int(end[-1]), "<u4")
        marked[(end - width)[keep]] = cp[keep]
        marked[end[sentence] - 1] = 10
        ids = np.frombuffer(self.core.encode_to_tiktoken_buffer(marked.tobytes().decode("utf-32-le"), set()), np.uint32)
        gaps = np.flatnonzero(ids == self.gap)
        lengths = np.diff(gaps, prepend=-1) - 1
        closes = cp[sentence] == 0
        owner = np.cumsum(closes) - closes
        some = lengths > 0
        return ids[ids != self.gap], lengths[some], np.bincount(owner[some], minlength=len(texts))


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def units_of(ids: np.ndarray, lengths: np.ndarray, counts: np.ndarray, closing: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids with each text's closing id; each unit's length, the kind of the boundary after it, and its text.

    Kinds: 0 document, 1 sentence, 2 inside a sentence.
    """
    n = len(counts)
    parts = -(-lengths // _HARD)
    last = np.cumsum(parts) - 1
    size, kind = np.full(int(parts.sum()), _HARD, np.int64), np.full(int(parts.sum()), 2, np.int8)
    size[last], kind[last] = lengths - (parts - 1) * _HARD, 1
    owner = np.repeat(np.repeat(np.arange(n), counts), parts)
    tokens = np.bincount(owner, size, n).astype(np.int64)
    after = np.searchsorted(owner, np.arange(n), side="right")  # of each text's last unit
    room = np.zeros(n, bool)
    some = counts > 0
    room[some] = size[after[some] - 1] < _HARD
    size[after[room] - 1] += 1
    kind[after[room] - 1] = 0
    own = np.flatnonzero(~room)
    size, kind, owner = np.insert(size, after[own], 1), np.insert(kind, after[own], 0), np.insert(owner, after[own], own)
    return np.insert(ids, np.cumsum(tokens), closing).astype("<u4"), size, kind, owner


def plan(lengths: list[int], kinds: list[int], max_tokens: int, penalties: tuple[float, float, float], final: bool) -> list[int]:
    """The ends of the windows, as numbers of units.

    Unless final, the plan ends at the best boundary among the last max_tokens, not at the very end.
    """
    n = len(lengths)
    before = [0]
    for x in lengths:
        before.append(before[-1] + x)
    cost, back = [0.0] * (n + 1), [0] * (n + 1)
    queue: deque[int] = deque([0])
    place = {0: 0}
    powers = [p for p in _POWERS if p <= max_tokens]
    for j in range(1, n + 1):
        at = before[j]
        while at - before[queue[0]] > max_tokens:
            queue.popleft()
        i = queue[0]
        best, source = cost[i] + max_tokens - (at - before[i]) + _WINDOW, i
        for p in powers:
            i = place.get(at - p)
            if i is not None and cost[i] + _WINDOW < best:
                best, source = cost[i] + _WINDOW, i
        best += penalties[kinds[j - 1]]
        cost[j], back[j], place[at] = best, source, j
        key = best + at
        while queue and cost[queue[-1]] + before[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    end = n
    if not final:
        near = [j for j in range(1, n + 1) if before[j] > before[n] - max_tokens]
        end = min(near, key=lambda j: (cost[j], -j))
    ends = []
    while end > 0:
        ends.append(end)
        end = back[end]
    return ends[::-1]


class Packer:
    """The stream of one partition."""

    def __init__(self, max_tokens: int, penalties: tuple[float, float, float], first: int):
        self.max_tokens, self.penalties, self.sequence = max_tokens, penalties, first
        self.ids, self.sizes, self.kinds, self.owners = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)], [np.zeros(0, np.int8)], [np.zeros(0, np.int64)]
        self.docs: list[object] = []
        self.tokens: list[int] = []  # of each document
        self.done = 0  # ids of the first document that are packed
        self.held = 0

    def add(self, doc_ids: list, units: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> None:
        ids, size, kind, owner = units
        self.ids.append(ids)
        self.sizes.append(size)
        self.kinds.append(kind)
        self.owners.append(owner + len(self.docs))
        self.docs += doc_ids
        self.tokens += np.bincount(owner, size, len(doc_ids)).astype(np.int64).tolist()
        self.held += len(ids)

    def flush(self, final: bool) -> Iterator[tuple]:
        """Rows (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of the windows decided on."""
        ids, size, kind, owner = map(np.concatenate, (self.ids, self.sizes, self.kinds, self.owners))
        if not len(size):
            return
        ends = np.array(plan(size.tolist(), kind.tolist(), self.max_tokens, self.penalties, final), np.int64)
        stop, before = int(ends[-1]), np.concatenate([[0], np.cumsum(size)])
        cut = np.zeros(stop + 1, bool)
        cut[0] = cut[ends] = True
        cut[1:stop] |= owner[1:stop] != owner[: stop - 1]
        units = np.flatnonzero(cut)
        at, doc = before[units], owner[units[:-1]]
        of_doc = np.concatenate([[0], np.cumsum(self.tokens)]) - self.done
        window = np.searchsorted(ends, units[:-1], side="right")
        offset = at[:-1] - np.concatenate([[0], before[ends]])[window]
        raw = memoryview(ids.tobytes())
        starts = at[:-1] - of_doc[doc]
        for d, start, a, b, w, o in zip(doc.tolist(), starts.tolist(), at[:-1].tolist(), at[1:].tolist(), window.tolist(), offset.tolist()):
            yield self.docs[d], start, b - a, raw[4 * a : 4 * b], self.tokens[d], self.sequence + w, o
        self.sequence += len(ends)
        packed = int(before[stop])
        first = int(owner[stop]) if stop < len(owner) else len(self.docs)
        self.done = packed - int(of_doc[first])
        del self.docs[:first], self.tokens[:first]
        self.ids, self.sizes, self.kinds, self.owners = [ids[packed:]], [size[stop:]], [kind[stop:]], [owner[stop:] - first]
        self.held = len(ids) - packed


def _parts(text: str) -> Iterator[str]:
    """A long text in parts, cut at white space where there is any near."""
    at = 0
    while len(text) - at > _CHARS:
        end = max(text.rfind(" ", at + _CHARS // 2, at + _CHARS), text.rfind("\n", at + _CHARS // 2, at + _CHARS))
        if end < 0:  # one run of characters
            break
        yield text[at:end]
        at = end
    yield text[at:]


def units_of_texts(words: WordEncoder, texts: list[str], closing: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    if len(texts) == 1:
        found = [words.encode([p]) for p in _parts(texts[0])]
        ids, lengths, counts = (np.concatenate([x[i] for x in found]) for i in range(3))
        return units_of(ids, lengths, counts.sum(keepdims=True), closing)
    return units_of(*words.encode(texts), closing)


def pack(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_tokens: int = 2048,
    closing_id: int = 1,
    sentence_penalty: float = 4.0,
    hard_penalty: float = 24.0,
    with_ids: bool = True,
) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    fields = [T.StructField("doc_id", docs.schema[id_col].dataType)]
    fields += [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    names = [f.name for f in fields]

    def rows(found: Iterator[tuple]) -> pd.DataFrame:
        out = []
        for doc_id, start, length, ids, total, sequence, offset in found:
            row = (doc_id, start, length, zlib.crc32(ids), total, sequence, offset)
            out.append((*row, np.frombuffer(ids, "<i4")) if with_ids else row)
        frame = pd.DataFrame(out, columns=names)
        return frame.astype({"doc_id": object})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        words = encoder(path)
        packer = Packer(max_tokens, (0.0, sentence_penalty, hard_penalty), TaskContext.get().partitionId() << 40)
        for frame in frames:
            doc_ids, texts = frame["doc_id"].tolist(), [t or "" for t in frame["text"]]
            for a, b in chars.slices(texts, _CHARS):
                packer.add(doc_ids[a:b], units_of_texts(words, texts[a:b], closing_id))
                if packer.held >= _SPAN:
                    yield rows(packer.flush(False))
        yield rows(packer.flush(True))

    # null ids would turn a pandas column of integers into floats: ids travel as text
    kind = docs.schema[id_col].dataType
    chosen = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = T.StructType([T.StructField("doc_id", T.StringType()), *fields[1:]])
    return chosen.mapInPandas(run, out).withColumn("doc_id", F.col("doc_id").cast(kind))
