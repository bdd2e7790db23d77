"""Sets of distinct five-word shingles as sorted 64-bit hashes, in numpy.

Words are what the contracts take: A-Z lower-cased, runs of anything but space
and U+0009 to U+000D, which is what ``bytes.split`` cuts at.
"""

from __future__ import annotations

import numpy as np
import xxhash

from sparkredact.llm.common import worker_memo

WIDTH = 5
# Odd multipliers of the window's words, and one for sequences shorter than a window.
_FACTORS = np.array([xxhash.xxh3_64_intdigest(b"shingle", seed=i) | 1 for i in range(WIDTH + 1)], np.uint64)


class WordHashes(dict):
    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def word_hashes(limit: int = 300_000) -> WordHashes:
    """One memo per worker."""
    return worker_memo(("words", limit), lambda: WordHashes(limit))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes; of the whole sequence if it is shorter than a window; none without words."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(word_hashes().__getitem__, words), np.uint64, len(words))
    if len(words) < WIDTH:
        h = np.append(h, np.uint64(len(h)))
        own = (h * np.append(_FACTORS[:len(h) - 1], _FACTORS[WIDTH])).sum(dtype=np.uint64, keepdims=True)
        return _mixed(own)
    n = len(h) - WIDTH + 1
    total = h[:n] * _FACTORS[0]
    for i in range(1, WIDTH):
        total += h[i:i + n] * _FACTORS[i]
    return np.unique(_mixed(total))
