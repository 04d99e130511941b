"""Token ids of whole texts, equal to the tokenizers library's encode(text, add_special_tokens=False).

A byte-pair model merges inside a piece only, so a text's ids are its pieces' ids end to end. Each distinct piece goes
through the library's model once and is kept in a two-generation cache bounded by its bytes; the texts are then put together by
array operations. A text that holds the string of a special token goes through the library as a whole.

Defined cases: a null text counts as empty and has no ids; texts of any length are encoded whole.
"""

from __future__ import annotations

import os
import unicodedata
from array import array

import numpy as np

from .pieces import chunks, cut, unknown_chars

#: Bytes of each of a cache's two generations, and what an entry takes besides its characters and ids.
CACHE_BYTES, ENTRY_BYTES = 20_000_000, 200


class Cache:
    """The latest entries by word: when a generation is full it becomes the old one, and the one before it goes."""

    def __init__(self, limit: int = CACHE_BYTES):
        self.limit, self.used = limit, 0
        self.young: dict = {}
        self.old: dict = {}

    def get(self, word: str):
        got = self.young.get(word)
        if got is None:
            got = self.old.get(word)
            if got is not None:
                self.put(word, got)
        return got

    def put(self, word: str, entry, size: int = 0) -> None:
        self.used += ENTRY_BYTES + len(word) + (size or len(entry))
        if self.used > self.limit:
            self.old, self.young, self.used = self.young, {}, 0
        self.young[word] = entry


def byte_chars() -> dict[int, str]:
    """The printable character by which byte-level vocabularies write each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


def lowered(text: str) -> str:
    """Lower case without regard to neighbours (no final sigma), as the library's normalizer does."""
    return text.lower() if "Σ" not in text else text.replace("Σ", "σ").lower()


class Encoder:
    """how: ``gpt`` for the byte-level file, ``clip`` for the one with word ends."""

    def __init__(self, path: str, how: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.how = how
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.to_chars = byte_chars()
        self.blank = self.to_chars[32]
        self.cache = Cache()

    def normal(self, text: str) -> str:
        if self.how != "clip":
            return text
        if not text.isascii():
            if unknown_chars()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any():
                return self.tokenizer.normalizer.normalize_str(text)
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
        return lowered(text)  # white space separates pieces and is dropped, so its folding changes nothing

    def piece_ids(self, piece: str) -> bytes:
        if piece.isascii() and piece[1:].isalnum() and (piece[0] == " " or piece[0].isalnum()):
            chars = self.blank + piece[1:] if piece[0] == " " else piece  # letters and digits are written as they are
        else:
            chars = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.to_chars)
        return array("i", [t.id for t in self.model.tokenize(chars)]).tobytes()

    def looked_up(self, words: list[str]) -> list[bytes]:
        cache = self.cache
        out = list(map(cache.young.get, words))
        for i in [i for i, ids in enumerate(out) if ids is None]:
            w = words[i]
            ids = cache.old.get(w)
            if ids is None:
                ids = self.piece_ids(w)
            cache.put(w, ids)
            out[i] = ids
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end (int32), and each text's first place, and the end."""
        texts = [t or "" for t in texts]
        whole = {i for i, t in enumerate(texts) if any(s in t for s in self.special)}
        plain = [self.normal(t) if i not in whole else "" for i, t in enumerate(texts)] if whole or self.how == "clip" else texts
        parts, sizes = [], []
        for first, some in chunks(plain):
            p = cut(some, self.how)
            ids, bounds = joined_ids(self.looked_up(p.words.to_pylist()), p.codes, p.bounds)
            size = np.diff(bounds)
            if whole and any(first <= i < first + len(some) for i in whole):
                rows = np.split(ids, bounds[1:-1])
                for i in whole:
                    if first <= i < first + len(some):
                        rows[i - first] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.int32)
                        size[i - first] = len(rows[i - first])
                ids = np.concatenate(rows)
            parts.append(ids)
            sizes.append(size)
        if not parts:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def joined_ids(by_word: list[bytes], codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of every piece in order, and each text's bounds among them."""
    flat = np.frombuffer(b"".join(by_word), np.int32)
    sizes = np.fromiter(map(len, by_word), np.int64, len(by_word)) // 4
    starts = np.cumsum(sizes) - sizes
    n = sizes[codes]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total) + np.repeat(starts[codes] - (ends - n), n)
    return flat[at], np.concatenate([[0], ends])[bounds]


_held: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, how: str) -> Encoder:
    """One encoder for each worker process, so that its cache lasts over tasks."""
    if (path, how) not in _held:
        _held[path, how] = Encoder(path, how)
    return _held[path, how]
