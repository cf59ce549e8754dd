"""64-bit hashes of runs of words and characters, in numpy."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_ODD = np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    for _ in range(2):
        h = (h ^ (h >> np.uint64(32))) * _ODD
    return h ^ (h >> np.uint64(32))


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k values, in order: a polynomial built from runs of powers of two, mixed."""
    if k < 1 or len(h) < k:
        return np.empty(0, np.uint64)
    n = len(h) - k + 1
    out, done, part, size = None, 0, mix(h + np.uint64(_BASE)), 1
    while done < k:
        if k & size:  # what is done comes first
            at = part[done : done + n]
            out = at.copy() if out is None else out * np.uint64(pow(_BASE, size, 1 << 64)) + at
            done += size
        part = part[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + part[size:]
        size *= 2
    return mix(out + np.uint64(k))


def distinct(h: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    s = np.sort(h)
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def points(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct k-word shingles of word hashes; fewer words are one shingle, none are none."""
    return distinct(runs(words, min(k, len(words))))
