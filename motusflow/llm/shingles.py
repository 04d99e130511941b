"""Hashes of words and of shingles of five words, for many texts at once.

Words are runs of letters and digits in lower case. A text of fewer than five words has one shingle, all its words; a text
without words has one shingle, the hash of its stripped characters; an empty or null text has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

from .encode import lowered
from .pieces import chunks, cut

WORDS = 5
_STEP, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit value for each 64-bit value."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x = x ^ (x >> np.uint64(33))
    x = x * _M2
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each chunk of texts: the place of its first text, the 64-bit hash of every word, and each text's bounds."""
    lower = [lowered(t or "") for t in texts]
    for first, some in chunks(lower):
        p = cut(some, "words")
        one = xxhash.xxh64_intdigest
        by_word = np.fromiter((one(w) for w in p.words.to_pylist()), np.uint64, len(p.words))
        yield first, by_word[p.codes] if len(by_word) else np.zeros(0, np.uint64), p.bounds


def shingles(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """For each text the hashes of its shingles in order, repeats included."""
    out: list[np.ndarray] = []
    for first, h, bounds in word_hashes(texts):
        n = len(h)
        sizes = np.diff(bounds)
        full = max(n - words + 1, 0)
        acc = h[:full].copy()
        for j in range(1, words):
            acc = acc * _STEP + h[j : full + j]
        acc = mixed(acc)
        for i, (a, size) in enumerate(zip(bounds[:-1].tolist(), sizes.tolist(), strict=True)):
            if size >= words:
                out.append(acc[a : a + size - words + 1])
            elif size:
                one = np.uint64(xxhash.xxh64_intdigest(h[a : a + size].tobytes()))
                out.append(mixed(np.array([one], np.uint64)))
            else:
                bare = (texts[first + i] or "").strip()
                out.append(mixed(np.array([xxhash.xxh64_intdigest(bare)], np.uint64)) if bare else np.zeros(0, np.uint64))
    return out
