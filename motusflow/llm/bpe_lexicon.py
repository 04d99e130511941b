"""Byte-pair encoding with a lexicon: a minimal acyclic transducer for frequent words, exact merging for the others.

The words that occur most in all documents (LEXICON at most) are compiled into an automaton in which equal endings share their
states. Its transitions carry numbers whose sum along a word is the word's place in a table of ids. States, numbers and ids are one
flat buffer that each worker maps into memory; many words walk it together, a byte at a time. A word outside the lexicon is merged
by the library's byte-pair model. Decoding writes each id's token, with a blank between tokens, as a tokenizer without a decoder
does.

Defined cases: a null or empty text has no ids and decodes to ""; a text with a special token's string is encoded whole by the
library; texts of any length are handled whole; equal rows one by one; other columns are not read.
"""

from __future__ import annotations

import hashlib
import mmap
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, written
from .encode import Cache, Encoder, encoder
from .pieces import chunks, cut

LEXICON = 65_536
#: Words a task counts before it passes their counts on.
HELD = 150_000


def minimal_automaton(words: list[bytes]) -> tuple[list[dict[int, int]], list[bool], int]:
    """Transitions and finality by state, and the first state, for sorted distinct words (Daciuk et al. 2000)."""
    edges: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path = [0]
    free: list[int] = []
    last = b""

    def settle(depth: int) -> None:
        """States of the last word below ``depth`` are replaced by equal ones, or become the ones to compare with."""
        while len(path) - 1 > depth:
            state = path.pop()
            sign = (final[state], tuple(edges[state].items()))
            same = register.setdefault(sign, state)
            if same != state:
                edges[path[-1]][last[len(path) - 1]] = same
                edges[state], final[state] = {}, False
                free.append(state)

    for word in words:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        settle(common)
        for b in word[common:]:
            if free:
                state = free.pop()
            else:
                state = len(edges)
                edges.append({})
                final.append(False)
            edges[path[-1]][b] = state
            path.append(state)
        final[path[-1]] = True
        last = word
    settle(0)
    return edges, final, 0


class Lexicon:
    """A transducer over one buffer. ids of word number k: flat[starts[k]:starts[k + 1]]."""

    NAMES = ("keys", "targets", "adds", "final", "starts", "flat")

    def __init__(self, arrays: dict[str, np.ndarray]):
        for name in self.NAMES:
            setattr(self, name, arrays[name])

    @classmethod
    def build(cls, words: dict[bytes, bytes]) -> Lexicon:
        """words: UTF-8 to the ids as int32 bytes."""
        order = sorted(words)
        edges, final, first = minimal_automaton(order)
        # states in order of first visit; the number of words a state accepts tells what each transition adds
        place, stack, seen = {first: 0}, [first], []
        while stack:
            state = stack.pop()
            seen.append(state)
            for to in edges[state].values():
                if to not in place:
                    place[to] = len(place)
                    stack.append(to)
        accepts: dict[int, int] = {}

        def count(state: int) -> int:
            todo = [state]
            while todo:
                s = todo[-1]
                missing = [t for t in edges[s].values() if t not in accepts]
                if missing:
                    todo += missing
                else:
                    accepts[s] = final[s] + sum(accepts[t] for t in edges[s].values())
                    todo.pop()
            return accepts[state]

        count(first)
        rows = []
        for state in seen:
            before = int(final[state])
            for b, to in sorted(edges[state].items()):
                rows.append((place[state] << 8 | b, place[to], before))
                before += accepts[to]
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 3)
        ends = np.zeros(len(place), np.uint8)
        for state in seen:
            ends[place[state]] = final[state]
        size = np.fromiter((len(words[w]) // 4 for w in order), np.int64, len(order))
        return cls(
            {
                "keys": table[:, 0].copy(),
                "targets": table[:, 1].astype(np.int32),
                "adds": table[:, 2].astype(np.int32),
                "final": ends,
                "starts": np.concatenate([[0], np.cumsum(size)]).astype(np.int64),
                "flat": np.frombuffer(b"".join(words[w] for w in order), np.int32),
            }
        )

    def to_bytes(self) -> bytes:
        parts = [np.ascontiguousarray(getattr(self, n)) for n in self.NAMES]
        head = np.array([len(p) for p in parts], np.int64).tobytes()
        return head + b"".join(p.tobytes() + b"\0" * (-p.nbytes % 8) for p in parts)

    @classmethod
    def mapped(cls, data: bytes) -> Lexicon:
        """The buffer in an unnamed file, mapped into memory; the file goes with the process."""
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            held = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        sizes = np.frombuffer(held, np.int64, len(cls.NAMES))
        at, arrays = 8 * len(cls.NAMES), {}
        for name, n, kind in zip(cls.NAMES, sizes.tolist(), (np.int64, np.int32, np.int32, np.uint8, np.int64, np.int32), strict=True):
            arrays[name] = np.frombuffer(held, kind, n, at)
            at += arrays[name].nbytes + -arrays[name].nbytes % 8
        return cls(arrays)

    def numbers(self, words: pa.StringArray) -> np.ndarray:
        """The number of each word, -1 outside the lexicon."""
        n = len(words)
        if not n or not len(self.keys):
            return np.full(n, -1, np.int64)
        at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2] or b"\0", np.uint8)
        size = np.diff(at)
        state, number = np.zeros(n, np.int64), np.zeros(n, np.int64)
        live = np.arange(n)
        for step in range(int(size.max(initial=0))):
            live = live[size[live] > step]
            if not len(live):
                break
            key = state[live] << 8 | data[at[live] + step]
            row = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[row] == key
            number[live[~hit]] = -1
            state[live[~hit]] = -1
            live, row = live[hit], row[hit]
            state[live] = self.targets[row]
            number[live] += self.adds[row]
        good = (state >= 0) & (size > 0)
        good[good] = self.final[state[good]] > 0
        return np.where(good, number, -1)

    def ids(self, number: int) -> np.ndarray:
        return self.flat[self.starts[number] : self.starts[number + 1]]


def word_counts(docs: DataFrame, path: str, how: str = "clip") -> DataFrame:
    """word, n: how often each piece occurs in all documents."""

    def run(frames):
        enc, held = encoder(path, how), {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for b in batches(frames):
            for _, some in chunks([enc.normal(t or "") for t in b.column("text").to_pylist()]):
                p = cut(some, how)
                counts = np.bincount(p.codes, minlength=len(p.words))
                for w, n in zip(p.words.to_pylist(), counts.tolist(), strict=True):
                    if n:
                        held[w] = held.get(w, 0) + n
                if len(held) > HELD:
                    yield out()
                    held = {}
        if held:
            yield out()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, path: str, how: str = "clip", most: int = LEXICON) -> Lexicon:
    """The ``most`` most frequent words of all documents, compiled."""
    counts = written(word_counts(docs, path, how).filter("n > 1"), "words")
    # words by the power of two of their count: where the last wanted one lies, so that no more than a few times ``most`` are sorted
    powers = sorted(((r["p"], r["k"]) for r in counts.groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count("*").alias("k")).collect()), reverse=True)
    least, held = 2, 0
    for p, k in powers:  # at most 64 rows
        held += k
        if held >= most:
            least = 2**p
            break
    top = counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(most).collect()  # bounded by ``most``
    enc = Encoder(path, how)
    return Lexicon.build({r["word"].encode(): enc.piece_ids(r["word"]) for r in top})


class Codec:
    """Encodes and decodes with a lexicon; pieces are kept as (number of ids, ids as text, tokens as text)."""

    def __init__(self, held: Lexicon, enc: Encoder):
        self.lexicon, self.enc = held, enc
        vocabulary = enc.tokenizer.get_vocab(with_added_tokens=True)
        self.tokens = [""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            self.tokens[i] = token
        self.known: list[tuple | None] = [None] * (len(held.starts) - 1)
        self.cache = Cache()

    def decode(self, ids) -> str:
        return " ".join([self.tokens[i] for i in ids])

    def entry(self, ids: np.ndarray) -> tuple[int, str, str]:
        ids = ids.tolist()
        return len(ids), " ".join(map(str, ids)), self.decode(ids)

    def entries(self, words: pa.StringArray) -> list[tuple[int, str, str]]:
        out = []
        cache, known = self.cache, self.known
        for k, w in zip(self.lexicon.numbers(words).tolist(), words.to_pylist(), strict=True):
            if k >= 0:
                e = known[k]
                if e is None:
                    e = known[k] = self.entry(self.lexicon.ids(k))
            else:
                e = cache.get(w)
                if e is None:
                    e = self.entry(np.frombuffer(self.enc.piece_ids(w), np.int32))
                    cache.put(w, e, 150 + len(e[1]) + len(e[2]))
            out.append(e)
        return out

    def texts(self, texts: list[str | None]):
        """For each text: number of ids, ids as decimal text, decoded text."""
        texts = [t or "" for t in texts]
        special = [any(s in t for s in self.enc.special) for t in texts]
        plain = ["" if s else self.enc.normal(t) for t, s in zip(texts, special, strict=True)]
        for first, some in chunks(plain):
            p = cut(some, self.enc.how)
            entries = self.entries(p.words)
            size = np.fromiter((e[0] for e in entries), np.int64, len(entries))
            total = np.concatenate([[0], np.cumsum(size[p.codes])])[p.bounds]
            ids, tokens = (np.array([e[i] for e in entries], object)[p.codes].tolist() if entries else [] for i in (1, 2))
            for i, (a, z) in enumerate(zip(p.bounds[:-1].tolist(), p.bounds[1:].tolist(), strict=True)):
                if special[first + i]:
                    yield self.entry(np.array(self.enc.tokenizer.encode(texts[first + i], add_special_tokens=False).ids, np.int64))
                else:
                    yield int(total[i + 1] - total[i]), " ".join(ids[a:z]), " ".join(tokens[a:z])


_held: dict[tuple, Codec] = {}


def _codec(data: bytes, path: str, how: str) -> Codec:
    """One codec for each worker process and lexicon, so that its cache lasts over tasks."""
    key = (xxhash.xxh64_digest(data), path, how)
    if key not in _held:
        _held.clear()
        _held[key] = Codec(Lexicon.mapped(data), encoder(path, how))
    return _held[key]


def round_trip(docs: DataFrame, path: str, how: str = "clip", most: int = LEXICON) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text."""
    held = docs.sparkSession.sparkContext.broadcast(lexicon(docs, path, how, most).to_bytes())

    def run(frames):
        codec = _codec(held.value, path, how)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for b in batches(frames):
            rows = [(n, sha(i), sha(t)) for n, i, t in codec.texts(b.column("text").to_pylist())]
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str, how: str = "clip", most: int = LEXICON) -> DataFrame:
    """doc_id, ids (array) of every text."""
    held = docs.sparkSession.sparkContext.broadcast(lexicon(docs, path, how, most).to_bytes())

    def run(frames):
        codec = _codec(held.value, path, how)
        for b in batches(frames):
            ids = [[int(x) for x in i.split()] for _, i, _ in codec.texts(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str, how: str = "clip") -> DataFrame:
    """doc_id, text from doc_id, ids."""

    def run(frames):
        codec = Codec(Lexicon.build({}), encoder(path, how))
        for b in frames:
            text = [None if ids is None else codec.decode(ids) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(text, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
