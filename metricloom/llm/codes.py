"""Texts as arrays of code points: words and n-grams hashed without loops over characters."""

from __future__ import annotations

import functools

import numpy as np

#: Zeros behind each text, so that no n-gram of up to GAP + 1 characters joins two texts unseen.
GAP = 8
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads each bit of a 64-bit value over all of them."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def encode(texts: list[str], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts with GAP zeros behind each, and where each text starts and ends.

    Lower case keeps the places of characters: the one letter whose lower
    case is two code points (dotted capital I) becomes a plain i.
    """
    if lower:
        texts = [x.replace("\u0130", "i").lower() for x in texts]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    gap = "\0" * GAP
    codes = np.frombuffer((gap.join(texts) + gap).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(sizes + GAP) - GAP
    return codes, ends - sizes, ends


@functools.cache
def _kinds() -> np.ndarray:
    return np.array([chr(i).isalnum() for i in range(0x30000)], bool)


def alnum(codes: np.ndarray) -> np.ndarray:
    kinds = _kinds()
    return kinds[np.minimum(codes, len(kinds) - 1)]


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, 1 << 20)
        base = 0xD6E8FEB86659FD93
        powers = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            powers.append(np.multiply.accumulate(p))
        _POWERS[:] = powers
    return _POWERS[0], _POWERS[1]


def words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the runs of letters and digits."""
    inside = alnum(codes)
    turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        turns = np.concatenate(([0], turns))
    if len(turns) % 2:
        turns = np.append(turns, len(codes))
    starts, ends = turns[::2], turns[1::2]
    power, inverse = _powers(len(codes) + 1)
    spread = (codes.astype(np.uint64) + ODD) * ODD
    spread ^= spread >> np.uint64(29)
    spread *= power[: len(codes)]
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(spread, out=sums[1:])
    return starts, ends, mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def owners(positions: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The text to which each (ascending) position belongs."""
    return np.searchsorted(ends, positions, side="right")
