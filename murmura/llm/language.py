"""Language identification: averaged embeddings of hashed subwords, and a linear softmax over them.

Subwords. A text is read as code points; what isn't a letter is a boundary, letters are lower-cased one by
one. Its subwords are the runs of 1 to 4 places that hold letters only, but for a boundary at either end.
Each is hashed to one of 2**BITS rows. What counts is local, so a text may be read in pieces that overlap
by three places, with the same subwords.

Model. A text's vector is the mean of its subwords' rows, and a linear layer with softmax gives the
languages. Rows and layer are trained in numpy by stochastic gradient descent with a falling rate. For
scoring, rows times layer are one table of each row's part in each language's sum, in whole multiples of
2**-SHIFT, whose sums are exact: a score depends neither on the batch nor on the pieces.

Rejection. Every fourth text of a language is kept aside: the temperature that makes its scores likeliest is
sought there, and then the least score from on which at most `max_error` of what is accepted is wrong.
`rejected` says that a text scores below it.

Training reads at most about `max_rows` labelled texts, an equal share for each language, chosen by a hash
of their ids, and of each `max_chars` characters from a place chosen by hash. These are the documented
bounds of the sample; texts to be scored are read whole.

Defined results: a null text, or one without a letter, is `und` with score 0 and rejected; so is every text if
nothing can be learned from; with one language learned every other text is of it; ties go to the language that
comes first in order; a null doc_id isn't held out; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmura.llm.chars import LETTER, classes, points, slices
from murmura.llm.toxicity import held_out

UNDETERMINED = "und"
BITS, SIZES, WIDTH, SHIFT = 16, (1, 2, 3, 4), 16, 20
#: Code points read at a time.
_CHARS = 1 << 18


@lru_cache(maxsize=1)
def lower_letters() -> np.ndarray:
    """The lower-case form of each code point that is a letter; 0 for the others."""
    out = np.zeros(0x110000, np.uint32)
    for c in np.flatnonzero(classes() == LETTER).tolist():
        low = chr(c).lower()
        out[c] = ord(low) if len(low) == 1 else c
    return out


def subwords(letters: np.ndarray, n_starts: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows int32[len(SIZES), n_starts] of the subwords that begin at the first places of letters, and which are there.

    letters holds 0 for boundaries, and three more places than there are starts.
    """
    is_letter = letters != 0
    rows, there = np.empty((len(SIZES), n_starts), np.uint32), np.empty((len(SIZES), n_starts), bool)
    h = np.zeros(n_starts, np.uint32)
    inner = np.ones(n_starts, bool)  # all places between the first and the last are letters
    for i, size in enumerate(SIZES):
        last = is_letter[size - 1 : size - 1 + n_starts]
        h = (h ^ letters[size - 1 : size - 1 + n_starts]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        mixed = (h + np.uint32(size)) * np.uint32(0x85EBCA6B)
        rows[i] = mixed >> np.uint32(32 - BITS)
        first = is_letter[:n_starts]
        there[i] = first if size == 1 else (first | last) if size == 2 else inner
        if size > 1:
            inner = inner & last
    return rows, there


def pieces(text: str) -> Iterator[tuple[np.ndarray, int]]:
    """What subwords() takes, for all of a text: a boundary stands before it and behind it."""
    table, pad = lower_letters(), max(SIZES) - 1
    for at in range(0, max(1, len(text)), _CHARS):
        before, end = (1 if at == 0 else 0), min(len(text), at + _CHARS)
        own = table[points(text[at : end + pad])]
        n = end - at + before
        yield np.concatenate([np.zeros(before, np.uint32), own, np.zeros(n + pad - before - len(own), np.uint32)]), n


@dataclass
class Model:
    """Languages in order; table: whole numbers as doubles [rows + 1, languages], or [rows + 1, WIDTH] beside a layer, the last row 0; what makes scores of sums."""

    languages: list[str]
    table: np.ndarray
    layer: np.ndarray
    offset: np.ndarray
    sharpness: float = 1.0
    threshold: float = 0.0

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the table's rows and numbers of subwords of each text; exact, as they are whole numbers."""
        total, count = np.zeros((len(texts), self.table.shape[1])), np.zeros(len(texts), np.int64)
        pad = np.zeros(max(SIZES) - 1, np.uint32)
        for i, j in slices(texts, _CHARS):
            if j == i + 1:
                for letters, n in pieces(texts[i]):
                    self._add(letters, np.array([n]), total[i:j], count[i:j])
            else:  # the next text begins with a boundary, as the places behind a text do
                parts = [next(pieces(t)) for t in texts[i:j]]
                self._add(np.concatenate([*[p[:n] for p, n in parts], pad]), np.array([n for _, n in parts]), total[i:j], count[i:j])
        return total, count

    def _add(self, letters: np.ndarray, sizes: np.ndarray, total: np.ndarray, count: np.ndarray) -> None:
        """Add up the subwords of texts that stand one behind the other, sizes[i] places each, none 0."""
        rows, there = subwords(letters, int(sizes.sum()))
        first = np.cumsum(sizes) - sizes
        for r, t in zip(rows, there):
            total += np.add.reduceat(self.table.take(np.where(t, r, np.uint32(1 << BITS)), axis=0), first, axis=0)
            count += np.add.reduceat(t, first, dtype=np.int64)

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each language's sum, and whether a text has any letter."""
        total, count = self.sums(texts)
        mean = total / (np.maximum(count, 1)[:, None] * float(1 << SHIFT))
        return (mean @ self.layer if len(self.layer) else mean) + self.offset, count > 0

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        """lang_pred, score and rejected of each text."""
        logits, some = self.logits([t or "" for t in texts])
        p = _softmax(logits * self.sharpness)
        best = np.round(p, 12).argmax(1) if len(texts) else np.zeros(0, int)
        score = np.where(some, p[np.arange(len(texts)), best], 0.0)
        names = [self.languages[k] if ok else UNDETERMINED for k, ok in zip(best, some)]
        return pd.DataFrame({"lang_pred": pd.Series(names, dtype=object), "score": score, "rejected": (score < self.threshold) | ~some})


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True)) if len(x) else x
    return e / e.sum(1, keepdims=True)


def bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct rows and their shares."""
    out = []
    for text in texts:
        found = [np.zeros(0, np.uint32)]
        for letters, n in pieces(text):
            rows, there = subwords(letters, n)
            found.append(rows[there])
        rows, counts = np.unique(np.concatenate(found), return_counts=True)
        out.append((rows.astype(np.int64), (counts / max(1, counts.sum())).astype(np.float32)))
    return out


def train(texts: list[tuple[str, str]], epochs: int = 5, rate: float = 20.0, batch: int = 32, least_steps: int = 600, max_error: float = 0.01, seed: int = 11) -> Model | None:
    """A model of (text, language) pairs; None without a text that has letters. Each pair is also learned by a short part of it."""
    texts = [(t, y) for t, y in texts if lower_letters()[points(t)].any()]
    if not texts:
        return None
    languages = sorted({y for _, y in texts})
    rng = np.random.default_rng(seed)
    by_language = {y: [p for p in texts if p[1] == y] for y in languages}
    aside = [p for own in by_language.values() for p in own[3::4]]
    learned = [p for own in by_language.values() for i, p in enumerate(own) if i % 4 != 3]
    short = []
    for t, y in learned:
        at, size = int(rng.integers(0, max(1, len(t) - 20))), int(rng.integers(10, 80))
        short.append((t[at : at + size], y))
    pairs = learned + [p for p in short if lower_letters()[points(p[0])].any()]
    found, label = bags([t for t, _ in pairs]), np.array([languages.index(y) for _, y in pairs])
    table = rng.normal(0, 0.05, (1 << BITS, WIDTH)).astype(np.float32)
    layer, offset = rng.normal(0, 0.3, (WIDTH, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    batches = -(-len(pairs) // batch)
    epochs = max(epochs, -(-least_steps // batches)) if len(languages) > 1 else 0
    steps, step = epochs * batches, 0
    for _ in range(epochs):
        order = rng.permutation(len(pairs))
        for i in range(0, len(order), batch):
            own = order[i : i + batch]
            now = 1 - step / steps
            step += 1
            rows, share = (np.concatenate([found[k][j] for k in own]) for j in (0, 1))
            which = np.repeat(np.arange(len(own)), [len(found[k][0]) for k in own])
            first = np.searchsorted(which, np.arange(len(own)))
            vectors = np.add.reduceat(table.take(rows, axis=0) * share[:, None], first, axis=0)
            d = _softmax(vectors @ layer + offset)
            d[np.arange(len(own)), label[own]] -= 1
            d /= len(own)
            d_vectors = (d @ layer.T).astype(np.float32)
            layer -= 0.5 * now * (vectors.T @ d)
            offset -= 0.5 * now * d.sum(0)
            in_order = np.argsort(rows.astype(np.uint16), kind="stable")
            rows, steps_of = rows[in_order], (share[:, None] * d_vectors.take(which, axis=0)).take(in_order, axis=0)
            first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            table[rows[first]] -= (rate * now) * np.add.reduceat(steps_of, first, axis=0)
    # the narrower of the two tables is kept for scoring
    wide = len(languages) > WIDTH
    whole = np.round((table.astype(np.float64) if wide else table.astype(np.float64) @ layer) * (1 << SHIFT))
    model = Model(languages, np.concatenate([whole, np.zeros((1, whole.shape[1]))]), layer.astype(np.float64) if wide else np.zeros((0, 0)), offset.astype(np.float64))
    _calibrate(model, aside, max_error)
    return model


def _calibrate(model: Model, aside: list[tuple[str, str]], max_error: float) -> None:
    """Sharpness with the highest likelihood on texts that weren't learned, and the least score at which few of those accepted are wrong."""
    if not aside or len(model.languages) < 2:
        return
    logits, _ = model.logits([t for t, _ in aside])
    label = np.array([model.languages.index(y) for _, y in aside])
    loss = lambda s: -np.log(_softmax(logits * s)[np.arange(len(label)), label] + 1e-12).mean()
    model.sharpness = float(min(np.geomspace(0.1, 10, 81), key=loss))
    p = _softmax(logits * model.sharpness)
    score, wrong = p.max(1), p.argmax(1) != label
    order = np.argsort(-score, kind="stable")
    fine = np.flatnonzero(np.cumsum(wrong[order]) <= max_error * np.arange(1, len(order) + 1))
    model.threshold = float(score[order[fine[-1]]]) if len(fine) else 1.0


def fit(docs: DataFrame, max_rows: int = 6000, max_chars: int = 1500) -> Model | None:
    """Train on rows with a language that aren't held out."""
    lang = F.col("lang").cast("string")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), lang.alias("y")).where(lang.isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = rows.groupBy("y").count().orderBy(F.desc("count"), "y").limit(max_rows).collect()  # one number a language; the most frequent ones, should there be more than texts to learn from
    if not sizes:
        return None
    share = max_rows // len(sizes)
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))  # by row, as an id may be repeated or null
    bounds = F.create_map(*[F.lit(x) for r in sizes for x in (r.y, int((1 << 40) * min(1.0, share / r["count"])))])
    chosen = rows.withColumn("o", draw).where(F.col("o") < F.element_at(bounds, F.col("y")))
    room = F.greatest(F.length("text") - max_chars, F.lit(0)) + 1
    part = F.substring(F.col("text"), (F.pmod(F.xxhash64("o"), room.cast("long")) + 1).cast("int"), F.lit(max_chars))
    found = sorted(chosen.select("o", "y", part.alias("part")).distinct().limit(2 * max_rows).collect())
    return train([(r.part, r.y) for r in found])


def identify(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """docs' columns of keep, with lang_pred, score and rejected."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kinds = {c: docs.schema[c].dataType for c in keep}
    names = [f"k{i}" for i in range(len(keep))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if held.value is None:
                yield frame[names].assign(lang_pred=UNDETERMINED, score=0.0, rejected=True)
            else:
                found = held.value.predict([t or "" for t in frame["text"]])
                yield frame[names].assign(**{c: found[c].to_numpy() for c in found.columns})

    chosen = docs.select(*[F.col(c).cast("string").alias(n) for c, n in zip(keep, names)], F.col(text_col).cast("string").alias("text"))
    out = chosen.mapInPandas(run, ", ".join(f"{n} string" for n in names) + ", lang_pred string, score double, rejected boolean")
    back: list[Column] = [F.col(n).cast(kinds[c]).alias(c) for c, n in zip(keep, names)]
    return out.select(*back, "lang_pred", "score", "rejected")
