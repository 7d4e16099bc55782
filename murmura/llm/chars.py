"""Classes of characters, and texts as arrays of code points, for splitting many texts at once in numpy."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

OTHER, LETTER, NUMBER, WHITE = 0, 1, 2, 3
#: The code points with the property White_Space.
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[_WHITE] = WHITE
    return out


@lru_cache(maxsize=1)
def unassigned() -> np.ndarray:
    """Which code points Python's Unicode data doesn't know; newer data may."""
    return np.fromiter((unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)), bool, 0x110000)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct numbers in order; for these, sorting is faster than np.unique()'s hashing."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def contractions(cp: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where 's, 't, 'm, 'd, 're, 've or 'll begin among starts (places of apostrophes), and where they end.

    cp ends with a code point that is none of these letters.
    """
    last = len(cp) - 1
    a, b = cp[np.minimum(starts + 1, last)], cp[np.minimum(starts + 2, last)]
    one = np.isin(a, list(map(ord, "stmd")))
    two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    hit = one | two
    return starts[hit], starts[hit] + np.where(one, 2, 3)[hit]


def slices(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters together; a longer text is a range of its own."""
    at = 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) <= most:
            size += len(texts[end])
            end += 1
        yield at, end
        at = end
