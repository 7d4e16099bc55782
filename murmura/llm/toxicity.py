"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

Inputs. A word's vector is the sum of a row for the word and rows for its characters: its beginnings
and ends of 3 to 5 characters and its runs of 3, as far as MIN_TEXTS training texts have them. So
unknown forms of known stems are near them, and what is rare carries no weight. Runs of over 40
characters, as in texts without blanks, are cut into pieces of up to 40, each beginning 20 after the last
one. A text's words are scored in windows of WINDOW words, each STRIDE words on from the last one; all
windows count, and the highest is the text's score.

Network. Two gated recurrent units read a window in both directions; a learned attention weighs their
states into one vector, from which a logistic unit gives the window's score. Training (Adam, written
out below) starts with every window carrying its text's label and goes on with each toxic text's best
windows and the clean texts' worst ones, as a text is toxic by some window of its own.

Training reads at most `max_toxic` and `max_clean` labelled texts, those first in the order of a hash
of their ids (of an id's several texts the least), and at most `max_windows` windows of each (chosen over
the whole text). These are the
documented bounds of the sample; texts to be scored are read whole.

Defined results: a null text is an empty one, scored as a window without words; without labelled rows
of both labels every score is 0; a null doc_id isn't held out; repeated rows get equal scores; an empty
table gives none; extra columns are ignored by score() and kept by keep_clean().
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.llm.chars import distinct, points, slices

WINDOW, STRIDE = 48, 36
MIN_TEXTS = 5
_DECAY = 0.05
_WIDTH, _HIDDEN = 12, 8
#: Words remembered in each of two generations; windows scored, and characters read, at a time.
_KEEP = 50_000
_STEP = 1024
_CHARS = 1 << 20
_PIECE = 40
_WORDS = regex.compile(r"[\p{L}\p{M}\p{N}']+")


def words_of(text: str) -> list[str]:
    """Runs of letters, marks, digits and apostrophes; one of over _PIECE characters gives pieces, each half in the next."""
    found = _WORDS.findall(text.lower())
    if max(map(len, found), default=0) <= _PIECE:
        return found
    return [p for w in found for p in _pieces(w)]


def _pieces(word: str) -> list[str]:
    return [word[i : i + _PIECE] for i in range(0, max(1, len(word) - _PIECE // 2), _PIECE // 2)]


def features_of(word: str) -> set[str]:
    """The word and its characters' runs; '<' and '>' mark its ends."""
    w = f"<{word}>"
    return {w, *(w[: k + 1] for k in (3, 4, 5)), *(w[-k - 1 :] for k in (3, 4)), *(w[i : i + 3] for i in range(len(w) - 2))}


_M = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _edges(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends in their concatenation."""
    size = np.array(list(map(len, words)), np.int64)
    end = np.cumsum(size)
    return end - size, end


def _hashes(text: str, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of parts of a text, by running sums of its characters times powers of _M."""
    cp = points(text).astype(np.uint64)
    powers = np.cumprod(np.full(len(cp), _M))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((cp + np.uint64(1)) * powers)])
    back = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(cp), _INVERSE))])
    x = (sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def starts(n_words: int) -> list[int]:
    """Where the windows of a text begin; the last one reaches its end."""
    return [0] if n_words <= WINDOW else [*range(0, n_words - WINDOW, STRIDE), n_words - WINDOW]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Network:
    """Weights by name; each direction d has wd (width, 3h), ud (h, 3h), bd (3h)."""

    w: dict[str, np.ndarray]
    rows: dict[str, int]
    scale: tuple[float, float] = (1.0, 0.0)
    _keys: tuple[np.ndarray, np.ndarray] | None = None  # hashes of rows' names in order, and the rows

    @classmethod
    def fresh(cls, rows: dict[str, int], seed: int = 7) -> Network:
        r, h = np.random.default_rng(seed), _HIDDEN
        w = {"table": r.normal(0, 0.05, (len(rows) + 1, _WIDTH))}
        for d in "fb":
            w |= {f"w{d}": r.normal(0, 0.35, (_WIDTH, 3 * h)), f"u{d}": r.normal(0, 0.3, (h, 3 * h)), f"b{d}": np.zeros(3 * h)}
        w |= {"att": r.normal(0, 0.3, 2 * h), "out": r.normal(0, 0.3, 2 * h), "bias": np.array([-2.0])}
        w["table"][0] = 0
        return cls({k: v.astype(np.float32) for k, v in w.items()}, rows)

    def rows_of(self, word: str) -> list[int]:
        """The table rows of a word; row 0, which stays zero, always is among them."""
        get = self.rows.get
        return [0, *(r for f in features_of(word) if (r := get(f)))]

    def rows_of_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """rows_of() for many words at once: all rows in a line, and how many each word has."""
        if self._keys is None:
            found = sorted(self.rows.items(), key=lambda x: x[1])
            hashed = _hashes("".join(f for f, _ in found), *_edges([f for f, _ in found])) if found else np.zeros(0, np.uint64)
            order = np.argsort(hashed)
            self._keys = hashed[order], np.array([r for _, r in found], np.int64)[order]
        keys, rows = self._keys
        start, end = _edges([f"<{w}>" for w in words])
        which = np.arange(len(words))
        runs = end - start - 2
        inner = np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(start, runs)
        begins = [start, start, start, start, np.maximum(end - 4, start), np.maximum(end - 5, start), inner]
        ends = [end, *(np.minimum(start + k, end) for k in (4, 5, 6)), end, end, inner + 3]
        owner = np.concatenate([*[which] * 6, np.repeat(which, runs)])
        hashed = _hashes("".join(f"<{w}>" for w in words), np.concatenate(begins), np.concatenate(ends))
        at = np.minimum(np.searchsorted(keys, hashed), max(0, len(keys) - 1))
        hit = keys[at] == hashed if len(keys) else np.zeros(len(hashed), bool)
        n_rows = len(self.w["table"])
        both = distinct(np.concatenate([which * n_rows, owner[hit] * n_rows + rows[at[hit]]]))
        return both % n_rows, np.bincount(both // n_rows, minlength=len(words))

    # The recurrent unit: z, r = sigmoid(x_zr + h u_zr); c = tanh(x_c + (r h) u_c); h' = h + z (c - h).
    # Steps beyond a window's length leave the state as it is.

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States [T, B, h] of one direction for inputs [T, B, 3h] and mask [T, B, 1]."""
        h, u = _HIDDEN, self.w[f"u{d}"]
        u_zr, u_c = np.ascontiguousarray(u[:, : 2 * h]), np.ascontiguousarray(u[:, 2 * h :])
        steps, n, _ = x.shape
        state, out = np.zeros((n, h), np.float32), np.empty((steps, n, h), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            zr = state @ u_zr
            zr += x[t, :, : 2 * h]
            np.tanh(zr * np.float32(0.5), out=zr)
            zr += 1
            zr *= np.float32(0.5)
            z, r = zr[:, :h], zr[:, h:]
            c = (r * state) @ u_c
            c += x[t, :, 2 * h :]
            np.tanh(c, out=c)
            if keep is not None:
                keep.append((t, state, z, r, c))
            state = state + z * mask[t] * (c - state)
            out[t] = state
        return out

    def _pool(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        logit = states @ self.w["att"] + (mask[:, :, 0] - 1) * np.float32(30)
        a = np.exp(logit - logit.max(0))
        a /= a.sum(0)
        pooled = np.einsum("tb,tbh->bh", a, states)
        return a, pooled, pooled @ self.w["out"] + self.w["bias"][0]

    def project(self, vectors: np.ndarray) -> np.ndarray:
        """What words add to both directions' gates: [n, 2, 3h]."""
        return np.stack([vectors @ self.w[f"w{d}"] + self.w[f"b{d}"] for d in "fb"], 1).astype(np.float32)

    def logits(self, projected: np.ndarray, at: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Scores of windows; at: int[T, B] into projected."""
        both = [self._run(d, projected[:, i][at], mask) for i, d in enumerate("fb")]
        return self._pool(np.concatenate(both, 2), mask)[2]

    def gradients(self, vectors: np.ndarray, at: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Loss, gradients of the weights, and of the word vectors."""
        h, w = _HIDDEN, self.w
        x, logs, halves = vectors[at], {}, []
        for d in "fb":
            logs[d] = []
            halves.append(self._run(d, x @ w[f"w{d}"] + w[f"b{d}"], mask, logs[d]))
        states = np.concatenate(halves, 2)
        a, pooled, logit = self._pool(states, mask)
        p = _sigmoid(logit)
        loss = float(-np.mean(label * np.log(p + 1e-7) + (1 - label) * np.log(1 - p + 1e-7)))
        g = {k: np.zeros_like(v) for k, v in w.items() if k != "table"}
        d_logit = ((p - label) / len(label)).astype(np.float32)
        g["out"], g["bias"] = pooled.T @ d_logit, np.array([d_logit.sum()], np.float32)
        d_pooled = d_logit[:, None] * w["out"]
        score = np.einsum("tbh,bh->tb", states, d_pooled)
        d_att = a * (score - (a * score).sum(0))
        g["att"] = np.einsum("tb,tbh->h", d_att, states)
        d_states = a[:, :, None] * d_pooled + d_att[:, :, None] * w["att"]
        d_x = np.zeros_like(x)
        for i, d in enumerate("fb"):
            u, d_gate = w[f"u{d}"], np.zeros((*x.shape[:2], 3 * h), np.float32)
            d_next = np.zeros((x.shape[1], h), np.float32)
            for t, state, z, r, c in reversed(logs[d]):
                d_h = d_next + d_states[t, :, i * h : (i + 1) * h]
                zm = z * mask[t]
                d_c = d_h * zm * (1 - c * c)
                d_z = d_h * mask[t] * (c - state) * z * (1 - z)
                d_rs = d_c @ u[:, 2 * h :].T
                d_r = d_rs * state * r * (1 - r)
                d_zr = np.concatenate([d_z, d_r], 1)
                g[f"u{d}"][:, : 2 * h] += state.T @ d_zr
                g[f"u{d}"][:, 2 * h :] += (r * state).T @ d_c
                d_gate[t, :, : 2 * h], d_gate[t, :, 2 * h :] = d_zr, d_c
                d_next = d_h * (1 - zm) + d_rs * r + d_zr @ u[:, : 2 * h].T
            g[f"w{d}"] = x.reshape(-1, _WIDTH).T @ d_gate.reshape(-1, 3 * h)
            g[f"b{d}"] = d_gate.sum((0, 1))
            d_x += d_gate @ w[f"w{d}"].T
        d_x *= mask
        d_vectors = np.stack([np.bincount(at.reshape(-1), d_x[:, :, e].reshape(-1), len(vectors)) for e in range(_WIDTH)], 1).astype(np.float32)
        return loss, g, d_vectors


class Words:
    """Words as places in a growing table of what project() makes of them; place 0 is no word.

    There are two generations: words that the last _KEEP new ones brought no text with are forgotten.
    """

    def __init__(self, network: Network):
        self.network = network
        self.old: tuple[dict[str, int], np.ndarray] = {}, np.empty((0, 0, 0), np.float32)
        self._fresh()

    def _fresh(self) -> None:
        self.place: dict[str, int] = {}
        first = self.network.project(np.zeros((1, _WIDTH), np.float32))
        self.projected, self.used = np.empty((1 << 12, *first.shape[1:]), np.float32), 1
        self.projected[0] = first[0]

    def _add(self, words: list[str], rows: np.ndarray) -> None:
        n = self.used
        self.place.update(zip(words, range(n, n + len(words))))
        self.used += len(words)
        if self.used > len(self.projected):
            more = np.empty((max(self.used, 3 * len(self.projected) // 2) - len(self.projected), *self.projected.shape[1:]), np.float32)
            self.projected = np.concatenate([self.projected, more])
        self.projected[n : self.used] = rows

    def learn(self, found: set[str]) -> None:
        if len(self.place) >= _KEEP:
            self.old = self.place, self.projected
            self._fresh()
        new = found - self.place.keys()
        old_place, old_rows = self.old
        if back := list(new & old_place.keys()):
            self._add(back, old_rows[list(map(old_place.__getitem__, back))])
        if not (new := list(new - old_place.keys())):
            return
        flat, sizes = self.network.rows_of_all(new)
        self._add(new, self.network.project(np.add.reduceat(self.network.w["table"][flat], np.cumsum(sizes) - sizes)))


def window_grid(places: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places [T, B] and mask [T, B, 1] of windows of a flat array."""
    steps = np.arange(min(WINDOW, max(1, int(sizes.max(initial=1)))))[:, None]
    mask = steps < sizes
    at = np.where(mask, places[np.minimum(begin + steps, len(places) - 1)], 0) if len(places) else np.zeros(mask.shape, int)
    return at, mask[:, :, None].astype(np.float32)


class Scorer:
    """Scores whole texts with a trained network; without one every score is 0."""

    def __init__(self, network: Network | None):
        self.network = network
        self.words = Words(network) if network else None

    def scores(self, texts: list[str]) -> np.ndarray:
        """Of any number of texts, some _CHARS characters at a time."""
        if self.network is None:
            return np.zeros(len(texts))
        a, b = self.network.scale
        each = [self.logits(texts[i:j]) for i, j in slices(texts, _CHARS)]
        return _sigmoid(a * np.concatenate(each) + b) if each else np.zeros(0)

    def logits(self, texts: list[str]) -> np.ndarray:
        """The highest window of each text, before scaling."""
        each = [words_of(t) for t in texts]
        self.words.learn(set().union(*each) if each else set())
        get = self.words.place.__getitem__
        places = np.array([get(x) for ws in each for x in ws], np.int64)
        begin, owner, base = [], [], 0
        for i, ws in enumerate(each):
            s = starts(len(ws))
            begin += [base + x for x in s]
            owner += [i] * len(s)
            base += len(ws)
        sizes = np.array([min(WINDOW, len(ws)) for ws in each], np.int64)[owner] if owner else np.zeros(0, np.int64)
        best, begin, owner = np.full(len(texts), -np.inf), np.array(begin, np.int64), np.array(owner, np.int64)
        order = np.argsort(sizes, kind="stable")
        for i in range(0, len(order), _STEP):
            own = order[i : i + _STEP]
            at, mask = window_grid(places, begin[own], sizes[own])
            np.maximum.at(best, owner[own], self.network.logits(self.words.projected, at, mask))
        return best


def train(texts: list[tuple[str, int]], max_windows: int = 16, rounds: int = 6, seed: int = 7) -> Network | None:
    """A network for (text, label) pairs; None unless both labels occur."""
    if len({y for _, y in texts}) < 2:
        return None
    aside = [p for i, p in enumerate(texts) if i % 4 == 3]
    network = _fit_windows([p for i, p in enumerate(texts) if i % 4 != 3], max_windows, rounds, seed)
    best = np.concatenate([Scorer(network).logits([t for t, _ in aside[i : i + 256]]) for i in range(0, len(aside), 256)] or [np.zeros(0)])
    network.scale = _logistic(best, np.array([y for _, y in aside]))
    return network


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit with targets short of 0 and 1, by Newton steps."""
    if len(set(y.tolist())) < 2:
        return 1.0, 0.0
    n1, n0 = int(y.sum()), int((1 - y).sum())
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    m, s = x.mean(), x.std() + 1e-6
    design, w = np.stack([(x - m) / s, np.ones(len(x))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(design @ w)
        hessian = design.T @ (design * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hessian, design.T @ (p - target) + 1e-3 * w), -2, 2)
    return float(w[0] / s), float(w[1] - w[0] * m / s)


def _fit_windows(texts: list[tuple[str, int]], max_windows: int, rounds: int, seed: int) -> Network:
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    flat, begin, sizes, owner = [], [], [], []
    for i, (text, _) in enumerate(texts):
        ws = words_of(text)
        s = starts(len(ws))
        if len(s) > max_windows:
            s = [s[k] for k in np.sort(rng.choice(len(s), max_windows, replace=False))]
        for b in s:
            begin.append(len(flat))
            part = ws[b : b + WINDOW]
            sizes.append(len(part))
            owner.append(i)
            flat += [vocabulary.setdefault(x, len(vocabulary)) for x in part]
    n_texts: Counter[str] = Counter()
    for text, _ in texts:
        n_texts.update({f for x in set(words_of(text)) for f in features_of(x)})
    network = Network.fresh({f: i for i, f in enumerate(sorted(f for f, n in n_texts.items() if n >= MIN_TEXTS), 1)}, seed)
    rows = [network.rows_of(x) for x in vocabulary]
    counts = np.array([len(r) for r in rows] or [0])
    row_flat = np.concatenate([*map(np.array, rows), np.zeros(0)]).astype(np.int64)
    row_start = np.cumsum(counts) - counts
    flat, begin, sizes, owner = np.array(flat, np.int64), np.array(begin), np.array(sizes), np.array(owner)
    label = np.array([y for _, y in texts])
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.w.items()}
    clock = 0

    def batch_vectors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors of distinct words, and the rows (and each one's word) that they are means of."""
        n = counts[words]
        which = np.repeat(np.arange(len(words)), n)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        used = row_flat[np.repeat(row_start[words], n) + inside]
        v = np.zeros((len(words) + 1, _WIDTH), np.float32)
        if len(words):
            v[1:] = np.add.reduceat(network.w["table"][used], np.cumsum(n) - n)
        return v, used, which

    def layout(own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, mask = window_grid(flat + 1, begin[own], sizes[own])
        words = np.unique(at)
        words = words[words > 0]
        return words - 1, np.where(at > 0, np.searchsorted(words, at) + 1, 0), mask

    def all_logits() -> np.ndarray:
        out = np.empty(len(owner), np.float32)
        for i in range(0, len(owner), _STEP):
            own = np.arange(i, min(i + _STEP, len(owner)))
            words, at, mask = layout(own)
            out[own] = network.logits(network.project(batch_vectors(words)[0]), at, mask)
        return out

    def update(name: str, g: np.ndarray, rate: float) -> None:
        m, v = moments[name]
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        step = (m / (1 - 0.9**clock)) / (np.sqrt(v / (1 - 0.99**clock)) + 1e-5)
        network.w[name] -= (rate * (step + _DECAY * network.w[name])).astype(np.float32)

    for turn in range(rounds):
        window_label = label[owner]
        if turn < 2:
            chosen = np.arange(len(owner))
            heavy = np.flatnonzero(window_label == 0)
            limit = max(64, 2 * int((window_label == 1).sum()))
            if len(heavy) > limit:
                chosen = np.concatenate([np.flatnonzero(window_label == 1), rng.choice(heavy, limit, replace=False)])
        else:
            logit = all_logits()
            order = np.lexsort((-logit, owner))
            rank = np.empty(len(owner), np.int64)
            first = np.concatenate([[0], np.flatnonzero(np.diff(owner[order])) + 1])
            rank[order] = np.arange(len(owner)) - np.repeat(first, np.diff(np.concatenate([first, [len(owner)]])))
            toxic = (window_label == 1) & ((rank == 0) | (logit > 1))
            clean = (window_label == 0) & ((rank < 2) | (rng.random(len(owner)) < 0.03))
            chosen = np.flatnonzero(toxic | clean)
        rng.shuffle(chosen)
        size = 256
        passes = max(1, -(-50 // max(1, len(chosen) // size)))
        for _ in range(passes):
            for i in range(0, len(chosen), size):
                own = chosen[i : i + size]
                clock += 1
                words, at, mask = layout(own)
                vectors, used, which = batch_vectors(words)
                _, g, d_vectors = network.gradients(vectors, at, mask, window_label[own].astype(np.float32))
                d_table = np.zeros_like(network.w["table"])
                d_words = d_vectors[1:][which]
                for e in range(_WIDTH):
                    d_table[:, e] = np.bincount(used, d_words[:, e], len(d_table))
                d_table[0] = 0
                rate = 0.02 * (1 - turn / (rounds + 1))
                update("table", d_table, rate)
                for k, v in g.items():
                    update(k, v, rate * 0.5)
    return network


def held_out(id_col) -> F.Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = 2000, max_clean: int = 5000, max_chars: int = 12_000) -> Network | None:
    """Train on labelled rows that aren't held out; at most max_toxic and max_clean texts of each label.

    Texts over max_chars characters are left out of training (not of scoring), which bounds what the
    driver gathers.
    """
    marked = labels.select(F.col("doc_id").alias("labelled_id"), F.col("toxic").cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out(F.col("labelled_id")))
    marked = marked.withColumn("o", F.xxhash64("labelled_id"))
    chosen = marked.where("y = 0").orderBy("o", "labelled_id").limit(2 * max_clean).unionByName(marked.where("y = 1").orderBy("o", "labelled_id").limit(2 * max_toxic))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.length("text") <= max_chars)
    joined = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id"))
    rows = joined.groupBy("o", "doc_id", "y").agg(F.min("text").alias("text")).collect()  # one text an id, however often it is repeated
    rows.sort(key=lambda r: (r.o, r.doc_id, r.text))
    pairs = []
    for y, most in ((0, max_clean), (1, max_toxic)):
        pairs += [(r.text, y) for r in rows if r.y == y][:most]
    return train(pairs)


def score(docs: DataFrame, network: Network | None, threshold: float = 0.7, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """docs' columns of keep, with score and predicted (1 from threshold on)."""
    held = docs.sparkSession.sparkContext.broadcast(network)
    kinds = {c: docs.schema[c].dataType for c in keep}
    names = [f"k{i}" for i in range(len(keep))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(held.value)
        for frame in frames:
            yield frame[names].assign(score=scorer.scores([t or "" for t in frame["text"]]))

    chosen = docs.select(*[F.col(c).cast("string").alias(n) for c, n in zip(keep, names)], F.col(text_col).cast("string").alias("text"))
    out = chosen.mapInPandas(run, ", ".join(f"{n} string" for n in names) + ", score double")
    back = [F.col(n).cast(kinds[c]).alias(c) for c, n in zip(keep, names)]
    return out.select(*back, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, network: Network | None, threshold: float = 0.7) -> DataFrame:
    """docs without the rows whose text is predicted toxic; all columns stay as they are."""
    held = docs.sparkSession.sparkContext.broadcast(network)

    @F.pandas_udf("double")
    def of(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(held.value)
        for texts in frames:
            yield pd.Series(scorer.scores([t or "" for t in texts]))

    return docs.where(of(F.col("text").cast("string")) < threshold)
