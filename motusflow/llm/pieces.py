"""Whole texts cut into pieces with array operations, many texts at once.

Three cuts: ``gpt`` (the public byte-level pattern: contractions, runs with one leading blank, white space),
``clip`` (contractions, letter runs, single digits, other runs; white space dropped) and ``words`` (runs of letters
and digits). The texts of a chunk are laid end to end as code points, one lookup gives each its class, and a piece
begins where the class changes. Equal pieces get one code, so all costly work is done once per distinct piece.

Defined cases: a null text counts as empty and has no pieces; a very long text forms a chunk of its own.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

OTHER, LETTER, NUMBER, SPACE, END = 0, 1, 2, 3, 4
#: Code points handled at once, unless one text is longer.
CHUNK_CHARS = 1_000_000


@lru_cache(maxsize=1)
def categories() -> np.ndarray:
    """Python's general category of each code point, by its first letter; ``?`` where Python knows no character."""
    known = "".join(unicodedata.category(chr(c)) for c in range(0x110000))
    pairs = np.frombuffer(known.encode(), "S2")
    return np.where(pairs == b"Cn", b"?", pairs.astype("S1"))


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of each code point (letter, number, Unicode white space or other) as the tokenizers library sees it.

    The library's Unicode tables are newer than Python's, so it is asked for the code points that Python does not know (planes 4 to
    13 have never had a character).
    """
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    held = categories()
    table = np.zeros(0x110000, np.uint8)
    table[held == b"L"], table[held == b"N"] = LETTER, NUMBER
    new = np.flatnonzero(held == b"?")
    new = new[(new < 0x40000) | (new >= 0xE0000)]
    text = new.astype("<u4").tobytes().decode("utf-32-le")
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for _, (a, z) in Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text):
            table[new[a:z]] = kind
    white = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    table[white] = SPACE
    return table


@lru_cache(maxsize=1)
def unknown_chars() -> np.ndarray:
    """Whether each code point is one that Python's Unicode tables do not know; the library's may."""
    return categories() == b"?"


def chunks(texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about ``limit`` code points together, with the place of the first."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield first, texts[first:i]
            first, held = i, 0
        held += len(t) + 1
    if first < len(texts):
        yield first, texts[first:]


class Pieces:
    """codes: the distinct piece at each place; words: the distinct pieces; bounds: each text's first place, and the end."""

    def __init__(self, codes: np.ndarray, words: pa.StringArray, bounds: np.ndarray):
        self.codes, self.words, self.bounds = codes, words, bounds


def _contractions(cp: np.ndarray, cls: np.ndarray, start: np.ndarray, blank_joins: bool) -> None:
    at = np.flatnonzero((cp[:-3] == 39) & start[:-3])
    if blank_joins and len(at):
        before = np.where(at > 0, cp[at - 1], 0)
        at = at[(before != 32) | (cls[at - 1] == END)]
    if not len(at):
        return
    a, b = cp[at + 1], cp[at + 2]
    inside = cls[at + 1] == LETTER
    one = inside & np.isin(a, [115, 116, 109, 100])  # s t m d
    two = inside & (cls[at + 2] == LETTER) & (((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108))  # re ve ll
    start[at[one] + 1] = False
    start[at[one] + 2] = True
    start[at[two] + 1] = False
    start[at[two] + 2] = False
    start[at[two] + 3] = True


def cut(texts: list[str], how: str) -> Pieces:
    """The pieces of one chunk of texts; ``how`` is ``gpt``, ``clip`` or ``words``."""
    n_texts = len(texts)
    joined = "￿".join(texts) + "￿"
    raw = joined.encode("utf-8", "surrogatepass")
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, n_texts)) - 1
    cls = char_classes()[cp]
    if how == "words":
        cls = np.where(cls == NUMBER, np.uint8(LETTER), cls)
        cls[cls == SPACE] = OTHER
    cls[ends] = END
    cp, cls = np.append(cp, np.zeros(4, np.uint32)), np.append(cls, np.full(4, END, np.uint8))
    start = np.empty(len(cp), bool)
    start[0] = True
    np.not_equal(cls[1:], cls[:-1], out=start[1:])
    start[ends] = True
    start[ends + 1] = True
    if how == "clip":
        start |= cls == NUMBER
        _contractions(cp, cls, start, False)
    elif how == "gpt":
        _contractions(cp, cls, start, True)
        last = np.flatnonzero((cls[:-1] == SPACE) & (cls[1:] != SPACE) & (cls[1:] != END))
        start[last] = True
        start[last[cp[last] == 32] + 1] = False
    n = len(cp) - 4
    begin = np.flatnonzero(start[:n])
    if len(raw) == n:
        at = begin
    else:
        width = np.ones(n + 1, np.int64)
        width[0] = 0
        body = cp[:n]
        width[1:] += (body > 0x7F).astype(np.int64) + (body > 0x7FF) + (body > 0xFFFF)
        at = np.cumsum(width)[begin]
    kind = cls[begin]
    offsets = np.append(at, len(raw)).astype(np.int32)
    pieces = pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(raw)).dictionary_encode()
    keep = kind != END
    if how == "clip":
        keep &= kind != SPACE
    elif how == "words":
        keep &= kind == LETTER
    closes = np.flatnonzero(kind == END)
    bounds = np.concatenate([[0], np.cumsum(keep)[closes]]) if len(closes) else np.zeros(n_texts + 1, np.int64)
    codes = pieces.indices.to_numpy(zero_copy_only=False)[keep]
    return Pieces(codes, pieces.dictionary, bounds)
