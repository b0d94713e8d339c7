"""Rolling character hashes over many texts at once, in NumPy."""

from __future__ import annotations

import numpy as np

#: An odd multiplier, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power_row(base: int, n: int) -> np.ndarray:
    row = _powers.get(base)
    if row is None or len(row) < n:
        row = np.full(max(n, 1 << 16), base, np.uint64)
        row[0] = 1
        row = np.multiply.accumulate(row)
        _powers[base] = row
    return row[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and where each text starts (with the end as last)."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return chars, starts


def rolling(chars: np.ndarray, k: int) -> np.ndarray:
    """Hash of chars[i:i+k] for every i; equal content has an equal hash wherever it stands."""
    n = len(chars)
    if n < k:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(chars.astype(np.uint64) + np.uint64(1)) * _power_row(BASE, n), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * _power_row(INVERSE, n - k + 1))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i:i+w]) for every i, from running minima within blocks of w."""
    n = len(x)
    if n < w:
        return np.zeros(0, x.dtype)
    pad = -n % w
    padded = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]) if pad else x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def window_minima(texts: list[str], k: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """MinHash of the k-grams of every window of `span` characters, each minimum once.

    Returns (text index, position in the text, hash). Two texts with an identical run
    of `span` characters have the same window there, so they share a returned hash.
    """
    chars, starts = joined(texts)
    h = rolling(chars, k)
    if len(h) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    bits = np.uint64(max(1, int(len(h)).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    keyed = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    for b in starts[1:-1]:  # no k-gram reaches into the next text
        keyed[max(0, b - k + 1) : b] = np.iinfo(np.uint64).max
    least = sliding_min(keyed, span - k + 1)
    least = least[np.concatenate([[True], least[1:] != least[:-1]])] if len(least) else least
    at = np.unique((least[least != np.iinfo(np.uint64).max] & low).astype(np.int64))
    which = np.searchsorted(starts, at, side="right") - 1
    return which, at - starts[which], h[at]
