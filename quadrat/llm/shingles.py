"""Word shingles as 64-bit numbers."""

from __future__ import annotations

import numpy as np

from quadrat.llm.common import SPACES

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Base of the rolling sums over bytes and places, odd, and its inverse modulo 2 ** 64.
BASE = 0xC2B2AE3D27D4EB4F
INVERSE = pow(BASE, -1, 1 << 64)
#: Powers of a base that a task keeps.
KEPT_POWERS = 1 << 21
_kept: dict[int, np.ndarray] = {}


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers, another for each seed."""
    x = x ^ np.uint64(seed * 0xD6E8FEB86659FD93 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, count: int) -> np.ndarray:
    """The first ``count`` powers of the base, from the base itself, modulo 2 ** 64."""
    have = _kept.get(base)
    if have is None or len(have) < count:
        have = np.cumprod(np.full(max(count, 1 << 16), base, np.uint64), dtype=np.uint64)
        if count <= KEPT_POWERS:
            _kept[base] = have
    return have[:count]


def _byte_values(fold_case: bool) -> np.ndarray:
    byte = np.arange(256, dtype=np.uint64)
    upper = (byte >= 65) & (byte <= 90) & fold_case
    values = mix(np.where(upper, byte + np.uint64(32), byte), 30)
    values[[ord(c) for c in SPACES]] = 0
    return values


_VALUES = {fold: _byte_values(fold) for fold in (False, True)}


def words_in_a_row(texts: list[str | None], fold_case: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The number of every word of the texts, one after the other, and the place of each text's first word; last, how many words there are.

    Words are split at space and 9 to 13 and A-Z is lower-cased, as bytes do.  A word's number
    is a sum over its bytes, each with a scrambled value and a power of its place.
    """
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b" ".join([b"", *raw, b""]), np.uint8)
    value = _VALUES[fold_case][data]
    inside = value != 0
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1  # first byte of a word, then the first one behind it
    first, end = edges[::2], edges[1::2]
    sums = np.cumsum(value * powers(BASE, len(data)), dtype=np.uint64)
    numbers = (sums[end - 1] - sums[first - 1]) * powers(INVERSE, len(data))[first]
    begins = np.cumsum([1, *(len(r) + 1 for r in raw)])
    return mix(numbers, 3), np.searchsorted(first, begins)


def shingled(own: np.ndarray, size: int) -> np.ndarray:
    """Numbers of all runs of ``size`` word numbers."""
    out = np.full(max(len(own) - size + 1, 0), size, np.uint64)
    for k in range(size):
        out = mix(out, 1) * _ODD + own[k : k + len(out)]
    return mix(out, 2)


def sequence(text: str | None, size: int, fold_case: bool = True) -> np.ndarray:
    """Number of the shingle at each place; a text with fewer words than ``size`` is one shingle, one without words none."""
    own, _ = words_in_a_row([text], fold_case)
    return shingled(own, min(size, len(own))) if len(own) else own
