"""Vectorised hashing of words and n-grams for the operators that run in Python blocks."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from wellspring.llm.common import WHITE_SPACE

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_SPREAD = 4096


@lru_cache(maxsize=1)
def _powers() -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[_U(1)], np.full(_SPREAD - 1, _BASE | _U(1), dtype=_U)]))


@lru_cache(maxsize=4)
def _table(kind: str) -> np.ndarray:
    """For each code point, whether it is part of a word."""
    if kind == "space":
        out = np.ones(0x110000, dtype=bool)
        out[[ord(c) for c in WHITE_SPACE]] = False
    elif kind == "alnum":
        out = np.fromiter((chr(i).isalnum() for i in range(0x110000)), dtype=bool, count=0x110000)
    else:
        out = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def code_points(texts: list[str], sep: str = " ") -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, one ``sep`` after each, and where each text starts (one more at the end)."""
    joined = sep.join(texts) + sep if texts else ""
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    return points, starts


def words(texts: list[str], kind: str = "space") -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, and for each text where its words start.

    ``kind``: "space" takes runs without white space, "alnum" runs of letters and digits.
    """
    points, starts = code_points(texts)
    inside = _table(kind)[points]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    at = np.flatnonzero(inside)
    first = np.flatnonzero(begin)
    if not len(first):
        return np.zeros(0, _U), np.zeros(len(texts) + 1, np.int64)
    word = np.cumsum(begin)[at] - 1
    within = at - first[word]
    with np.errstate(over="ignore"):
        value = mix(points[at].astype(_U) + _U(1)) * _powers()[within % _SPREAD]
        hashed = mix(np.add.reduceat(value, np.flatnonzero(within == 0)) + _BASE)
    return hashed, np.searchsorted(first, starts).astype(np.int64)


def owners(offsets: np.ndarray) -> np.ndarray:
    """The text of each word."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def runs(hashed: np.ndarray, offsets: np.ndarray, n: int, gap: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and texts of the runs of ``n`` words; with ``gap``, of pairs with ``gap`` words between."""
    span = n + gap
    count = len(hashed) - span + 1
    if count <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    own = owners(offsets)
    ok = own[:count] == own[span - 1:]
    with np.errstate(over="ignore"):
        steps = range(n) if not gap else (0, span - 1)
        value = np.full(count, _U(n * 131 + gap), dtype=_U)
        for j in steps:
            value = mix(value * _BASE + hashed[j:j + count])
    return value[ok], own[:count][ok]
