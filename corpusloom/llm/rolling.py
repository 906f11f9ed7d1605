"""Hashes of all k-character windows of many texts at once (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        _powers[name] = have = np.cumprod(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def window_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of codes[i:i+k] for every i; depends on the window's content only."""
    n = len(codes)
    if n < k:
        return np.empty(0, dtype=np.uint64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, n), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * _power("down", _INVERSE, n - k + 1))


def _sliding(a: np.ndarray, w: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over every w consecutive entries, by doubling."""
    size = 1
    while size * 2 <= w:
        a = pick(a[:-size], a[size:])
        size *= 2
    return pick(a[: len(a) - (w - size)], a[w - size :]) if w > size else a


def sampled_windows(texts: list[str], k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Winnowing: (text index, start, hash) of the k-windows that are smallest among some w consecutive ones.

    Any stretch of k + w - 1 characters holds at least one selected window, and which it is follows
    from those characters alone, so equal stretches select equal windows.
    """
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    codes = codes_of("".join(texts))
    hashes = window_hashes(codes, k)
    none = np.empty(0, dtype=np.int64)
    if len(hashes) < w:
        return none, none, np.empty(0, dtype=np.uint64)
    ends = np.repeat(np.cumsum(lengths), lengths)[: len(hashes)]
    inside = np.arange(len(hashes)) + k <= ends
    hashes[~inside] = _TOP
    least = _sliding(hashes, w, np.minimum)
    padded = np.zeros(len(least) + 2 * (w - 1), dtype=np.uint64)
    padded[w - 1 : w - 1 + len(least)] = least
    at = np.flatnonzero((hashes == _sliding(padded, w, np.maximum)) & inside)
    starts = np.cumsum(lengths) - lengths
    which = np.searchsorted(starts, at, side="right") - 1
    return which, at - starts[which], hashes[at]
