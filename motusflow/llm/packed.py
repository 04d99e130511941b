"""Sorted 64-bit keys of a chunk of documents on their way to key ranges and back, as compressed blocks.

Counts of words, word pairs or shingles over all documents meet by key range. A chunk sends each distinct key once, with the counts
of all its documents together, so the most frequent key of the corpus has one entry a chunk, and a chunk and range that share
no key exchange nothing. The totals return to the chunk in the order in which its sorted keys went.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import zstandard


def packed(a: np.ndarray) -> bytes:
    """Bytes by place, then compressed."""
    return zstandard.compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes(), 1)


def unpacked(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return raw.reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).reshape(-1)


def key_mask(size: int) -> tuple[np.uint64, np.uint64]:
    """The bits of a hash that are sent, the highest ones, as a mask and the number of the others.

    There are 2 ** 14 times as many values as characters, 2 ** 48 at least, so that a key shares its value with another one of the
    corpus with a probability of about 1e-5, at every size; and a sorted chunk's differences take half of the bytes of whole hashes.
    """
    bits = min(64, max(48, int(np.ceil(np.log2(max(size, 2)))) + 14))
    return np.uint64((2**bits - 1) << (64 - bits)), np.uint64(64 - bits)


def distinct(a: np.ndarray) -> np.ndarray:
    """Sorted distinct values; by sorting, which here is faster than NumPy's hash table."""
    a = np.sort(a)
    return a[np.concatenate([np.ones(min(len(a), 1), bool), a[1:] != a[:-1]])]


def range_bits(size: int, each: int) -> int:
    """Ranges, as a power of two, so that each holds about ``each`` of ``size``; 64 ranges at least."""
    return max(6, int(np.ceil(np.log2(max(size / each, 1)))))


def by_range(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(range, first, end) of the sorted keys of every range that has any."""
    if not len(keys):
        return
    held = (keys >> np.uint64(64 - bits)).astype(np.int64)
    heads = np.flatnonzero(np.diff(held, prepend=-1))
    yield from zip(held[heads].tolist(), heads.tolist(), np.append(heads[1:], len(held)).tolist(), strict=True)


def gaps(keys: np.ndarray, drop: np.uint64) -> bytes:
    """Sorted keys without their ``drop`` lowest bits, as differences, the first from 0."""
    return packed(np.diff(keys >> drop, prepend=np.uint64(0)))


def from_gaps(data: bytes) -> np.ndarray:
    """The keys without their lowest bits."""
    return np.cumsum(unpacked(data, "<u8"), dtype=np.uint64)


def summed(keys: list[np.ndarray], *counts: list[np.ndarray]) -> tuple[int, list[list[np.ndarray]]]:
    """The number of distinct keys of several blocks, and for every kind of count each block's keys' totals over all blocks."""
    if not keys:
        return 0, [[] for _ in counts]
    found, place = np.unique(np.concatenate(keys), return_inverse=True)
    ends = np.cumsum([len(k) for k in keys])[:-1]
    totals = (np.bincount(place, np.concatenate(c), len(found)).astype(np.int64)[place] for c in counts)  # exact below 2 ** 53
    return len(found), [np.split(t, ends) for t in totals]
