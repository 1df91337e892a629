"""Hashes of words and of runs of words, with numpy, over the bytes of whole texts.

A word is a run of bytes other than blank, tab, LF, VT, FF and CR. Its hash is
a polynomial of random values of its bytes, taken from running sums, so that a
block of text costs a few array passes however its words lie.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 20
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FOLDED = _VALUE.copy()
_FOLDED[65:91] = _VALUE[97:123]
_BASE = 0x5851F42D4C957F2D
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int, name: str = "up") -> np.ndarray:
    """Powers 0 to n-1 of the base ('up') or of its inverse ('down'), modulo 2**64."""
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        size = 1 << max(10, (n - 1).bit_length())
        base = _BASE if name == "up" else pow(_BASE, -1, 1 << 64)
        row = np.full(size, base, np.uint64)
        row[0] = 1
        _POWERS[name] = have = np.cumprod(row, dtype=np.uint64)
    return have[:n]


def _block(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_GAP[data]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * powers(len(data)), out=sums[1:])
    raw = (sums[ends] - sums[starts]) * powers(len(data), "down")[starts]
    return mixed(raw + (ends - starts).astype(np.uint64)), starts, ends


def words(text: bytes, fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of every word; ``fold`` lower-cases A-Z.

    A long text is taken in blocks that end between words.
    """
    data, table = np.frombuffer(text, np.uint8), _FOLDED if fold else _VALUE
    at, parts = 0, []
    while at < len(data):
        to = min(len(data), at + BLOCK)
        while to < len(data):  # the last gap of the block, or the first one after it
            gaps = np.flatnonzero(_GAP[data[at:to]])
            if len(gaps):
                to = at + int(gaps[-1]) + 1
                break
            to = min(len(data), to + BLOCK)
        h, s, e = _block(data[at:to], table)
        parts.append((h, s + at, e + at))
        at = to
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def words_of(texts: list[bytes], fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of many texts in a row, and where each text's words begin (one more at the end)."""
    h, starts, _ = words(b"\n".join(texts), fold)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return h, np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; empty where fewer words are left."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(h) - k + 1, np.uint64)
    for i, p in enumerate(powers(k)):
        total += h[i : i + len(total)] * p
    return mixed(total + np.uint64(k))


def spans(h: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words from ``first`` to before ``end``, for many spans of any length."""
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(len(h)), out=sums[1:])
    raw = (sums[end] - sums[first]) * powers(len(h) + 1, "down")[first]
    return mixed(raw + (end - first).astype(np.uint64))
