"""Hashes of words and of word shingles, as arrays."""

from __future__ import annotations

import numpy as np
import xxhash

_FIRST, _SECOND = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xD6E8FEB86659FD93)


class _Hashes(dict):
    """64-bit hashes of words, of as many as are in use."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


_hashes = _Hashes()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _SECOND
    return h ^ (h >> np.uint64(32))


def word_hashes(text: str | None) -> np.ndarray:
    """A hash for each word of a text: A-Z lower-cased, words are runs without blanks (U+0020, U+0009 to U+000D)."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def shingle_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """The distinct hashes of ``size`` words in a row, in order; of fewer words the whole sequence makes one."""
    if not len(h):
        return h
    n = max(1, len(h) - size + 1)
    joined = np.zeros(n, np.uint64)
    for k in range(min(size, len(h))):
        joined = mixed(joined * _FIRST + h[k : k + n])
    return np.unique(joined)
