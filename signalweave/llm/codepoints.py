"""Texts as one array of code points, with look-up tables for letters and lower case."""

from __future__ import annotations

from functools import cache

import numpy as np

TOP = 0x110000


def pack(texts: list[str], gap: str = " ") -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by ``gap``, and the text that each belongs to."""
    points = np.frombuffer(gap.join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + len(gap)
    return points, np.repeat(np.arange(len(texts)), lengths)


@cache
def lowered() -> np.ndarray:
    """Lower case of each code point, itself where that is not a single one."""
    out = np.arange(TOP, dtype=np.uint32)
    for i in range(0x1E944):
        if len(x := chr(i).lower()) == 1:
            out[i] = ord(x)
    return out


@cache
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(TOP)), dtype=bool, count=TOP)


@cache
def powers() -> np.ndarray:
    """Powers of an odd number modulo 2^64, for hashes of runs; they repeat after 4096 places."""
    out = np.empty(4096, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        for i in range(1, 4096):
            out[i] = out[i - 1] * np.uint64(0x9E3779B97F4A7C15)
    return out


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).view(np.int8)))
    return edge[::2], edge[1::2]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the values of each run. Values between the runs have to be zero."""
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    place = np.arange(len(values)) - np.repeat(starts, np.diff(np.append(starts, len(values)))) if starts[0] == 0 else None
    if place is None:
        place = np.arange(len(values))
        place[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(values))))
    with np.errstate(over="ignore"):
        h = np.add.reduceat(values.astype(np.uint64) * powers()[place & 4095], starts)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))
