"""Cross-entropy difference: a target and a background bigram model over one vocabulary score every document.

Both models are matched: the same vocabulary (the words by their 64-bit hashes), the same order and the same smoothing,
P(w|v) = (c(v,w) + MU P(w)) / (c(v) + MU), P(w) = (c(w) + 1) / (N + V), where V is the number of distinct words, LEAST_V at
least, and c(v) at the beginning of a text is the number of texts with words. The target model counts the target documents, the
background model counts all. A document's score is its mean loss a word under the target model less that under the background
model; low means close to the target. When a document is scored, all its own counts are left out: of its bigrams, its words, N
and its beginning.

All counts are over the whole corpus (words and bigrams by 48 to 64 bits of their hashes, packed.key_mask); none meet in one place. Documents are taken in chunks. A chunk sends its distinct
bigrams and words, each once with the chunk's counts, as sorted and compressed blocks to key ranges; the ranges' totals return
to the chunk, beside its documents as numbers of words, and there every document is scored. A bigram of every document of the
corpus is thus one entry a chunk, never one a document.

Defined cases: a null or empty text, or one without words, has 0 words and null losses and score; without target documents
the target model is uniform; rows with equal or null doc_id are scored one by one; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, count_in, spread, written
from .packed import by_range, from_gaps, gaps, key_mask, packed, range_bits, summed, unpacked
from .shingles import mixed, word_hashes

MU = 8.0
#: The least V, and what stands for the beginning of a text as a history.
LEAST_V = START = 1 << 18
#: Words of a chunk of documents, characters of all texts for each key range, and rows to broadcast at most.
CHUNK_WORDS, RANGE_CHARS, SMALL = 1_500_000, 16_000_000, 1_000_000

BLOCKS = "range long, chunk long, {} binary, docs binary, v long, n_target long, n_all long, d_target long, d_all long"
SENT, BACK = BLOCKS.format("pairs binary, pairs_target binary, pairs_all binary, words binary, words_target binary, words_all"), BLOCKS.format("pairs_target binary, pairs_all binary, words_target binary, words_all")


def with_target(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, text and whether the document is in the target; ``target`` holds doc_ids. Broadcast only if small."""
    ids = target.select(F.col("doc_id").cast("long").alias("_t")).filter("_t is not null").distinct().withColumn("_hit", F.lit(True))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    take = lambda rows, ids: rows.join(ids, rows["doc_id"] == ids["_t"], "left").select("doc_id", "text", F.coalesce("_hit", F.lit(False)).alias("target"))
    if count_in(ids, SMALL):
        return take(docs, F.broadcast(ids))
    bare = docs.filter("doc_id is null").withColumn("target", F.lit(False))  # would all go to one task
    return take(docs.filter("doc_id is not null"), ids).union(bare)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def _pairs(w: np.ndarray, size: np.ndarray, mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """For every word the hash of it and the one before, and whether it begins its text."""
    ends = np.cumsum(size)
    begins = np.zeros(len(w), bool)
    begins[(ends - size)[size > 0]] = True
    before = np.roll(w, 1)
    before[begins] = START
    return mixed(before * np.uint64(0x9E3779B97F4A7C15) + mixed(w)) & mask, begins


def _blocks(docs: DataFrame, bits: int, mask: np.uint64, drop: np.uint64) -> DataFrame:
    """Chunks of documents as rows for key ranges (SENT); a chunk's documents go as a range of their own, -1 - chunk."""
    schema = _arrow(SENT)

    def deal(frames):
        chunk, held, words = TaskContext.get().partitionId() << 32, [], 0
        for b in batches(frames):
            doc, hit = b.column("doc_id").to_pylist(), b.column("target").to_pylist()
            for first, w, bounds in word_hashes(b.column("text").to_pylist()):
                last = first + len(bounds) - 1
                held.append((doc[first:last], hit[first:last], w & mask, np.diff(bounds)))
                words += len(w)
                if words >= CHUNK_WORDS:
                    yield closed(chunk, held)
                    chunk, held, words = chunk + 1, [], 0
        if held:
            yield closed(chunk, held)

    def closed(chunk, held):
        ids = [x for h in held for x in h[0]]
        hit = np.array([x for h in held for x in h[1]], bool)
        w, size = np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held])
        of = np.repeat(hit, size)
        words, code = np.unique(w, return_inverse=True)
        pairs, place = np.unique(_pairs(w, size, mask)[0], return_inverse=True)
        rows: dict[int, dict] = {}
        for name, keys, at in (("pairs", pairs, place), ("words", words, code)):
            every, target = (np.bincount(x, minlength=len(keys)).astype("<u4") for x in (at, at[of]))
            for k, a, z in by_range(keys, bits):
                rows.setdefault(k, {}).update({name: gaps(keys[a:z], drop), f"{name}_target": packed(target[a:z]), f"{name}_all": packed(every[a:z])})
        whole = [np.array([x or 0 for x in ids], "<i8"), np.array([x is None for x in ids], np.uint8), hit.astype(np.uint8), size.astype("<i8"), code.astype("<u4")]
        parts = [*(packed(x) for x in whole), gaps(words, drop)]
        spoken = size > 0
        head = {
            "docs": np.array([len(p) for p in parts], "<i8").tobytes() + b"".join(parts),
            "v": 0,
            "n_target": int(size[hit].sum()),
            "n_all": int(size.sum()),
            "d_target": int((spoken & hit).sum()),
            "d_all": int(spoken.sum()),
        }
        out = [{"range": -1 - chunk, "chunk": chunk} | head, *({"range": k, "chunk": chunk} | r for k, r in rows.items())]
        return pa.RecordBatch.from_pylist(out, schema)

    return docs.mapInArrow(deal, SENT)


def _totals(t: pa.Table) -> pa.Table:
    """One range: every block's keys with their totals over all blocks, and once the number of distinct words."""
    if t.column("range")[0].as_py() < 0:
        return t.select(_arrow(BACK).names)
    rows = t.to_pylist()
    out = [{"range": r["range"], "chunk": r["chunk"], "v": 0} for r in rows]
    for name in ("pairs", "words"):
        some = [i for i, r in enumerate(rows) if r[name] is not None]
        keys = [from_gaps(rows[i][name]) for i in some]
        distinct, totals = summed(keys, *([unpacked(rows[i][f"{name}_{model}"], "<u4") for i in some] for model in ("target", "all")))
        for model, total in zip(("target", "all"), totals, strict=True):
            for i, one in zip(some, total, strict=True):
                out[i][f"{name}_{model}"] = packed(one.astype("<u8"))
        if name == "words":
            out[0]["v"] = distinct
    return pa.Table.from_pylist(out, _arrow(BACK))


def _scored(t: pa.Table, mask: np.uint64, drop: np.uint64, v: int, n: dict[str, int], d: dict[str, int]) -> pa.Table:
    """One chunk: its documents, scored with the totals that came back."""
    rows = sorted(t.to_pylist(), key=lambda r: r["range"])
    data, at, parts = rows[0]["docs"], 48, []
    for length, kind in zip(np.frombuffer(data, "<i8", 6).tolist(), ("<i8", "<u1", "<u1", "<i8", "<u4", None), strict=True):
        part = data[at : at + length]
        parts.append(unpacked(part, kind) if kind else from_gaps(part) << drop)
        at += length
    ids, none, hit, size, code, words = parts
    hit, code = hit.astype(bool), code.astype(np.int64)
    pair, begins = _pairs(words[code], size, mask)
    pairs, place = np.unique(pair, return_inverse=True)
    doc = np.repeat(np.arange(len(size)), size)

    def own(at: np.ndarray, kinds: int) -> np.ndarray:
        """How often the document of each word has that word, or pair."""
        _, which, times = np.unique(doc * kinds + at, return_inverse=True, return_counts=True)
        return times[which]

    own_pair, own_word = own(place, len(pairs)), own(code, len(words))
    mean = []
    for model in ("target", "all"):
        held = {name: np.concatenate([np.zeros(0, "<u8"), *(unpacked(r[f"{name}_{model}"], "<u8") for r in rows[1:] if r[f"{name}_{model}"] is not None)]).astype(np.int64) for name in ("pairs", "words")}
        speaks = hit if model == "target" else np.ones(len(hit), bool)
        mine = np.repeat(speaks, size)
        spoken = held["words"][code] - own_word * mine
        history = np.roll(spoken, 1)
        history[begins] = d[model] - mine[begins]
        single = (spoken + 1.0) / (n[model] - np.repeat(speaks * size, size) + v)
        lost = -np.log((held["pairs"][place] - own_pair * mine + MU * single) / (history + MU))
        mean.append(np.bincount(doc, lost, len(size)) / np.maximum(size, 1))
    bare = size == 0
    return pa.table([pa.array(ids, mask=none.astype(bool)), pa.array(size), pa.array(mean[0], mask=bare), pa.array(mean[1], mask=bare), pa.array(mean[0] - mean[1], mask=bare)], names=["doc_id", "n_words", "loss_target", "loss_background", "score"])


def score(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_words, loss_target, loss_background, score."""
    docs = with_target(docs, target)
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    bits, (mask, drop) = range_bits(chars, RANGE_CHARS), key_mask(chars)
    back = written(spread(_blocks(docs, bits, mask, drop), "range", 1 + chars // RANGE_CHARS).groupBy("range").applyInArrow(_totals, BACK), "totals", "none")
    sums = back.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("v", "n_target", "n_all", "d_target", "d_all"))).first()
    v, n, d = max(LEAST_V, sums["v"]), *({"target": sums[f"{x}_target"], "all": sums[f"{x}_all"]} for x in "nd")
    return spread(back, "chunk", 1 + chars // (6 * CHUNK_WORDS)).groupBy("chunk").applyInArrow(lambda t: _scored(t, mask, drop, v, n, d), "doc_id long, n_words long, loss_target double, loss_background double, score double")
