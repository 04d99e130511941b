"""Threshold-scaled sketches: every shingle hash below a fixed share of the hash space is kept.

The kept hashes of a union are the union of the kept hashes, so sketches merge, and the share of one sketch found in
another estimates containment however unequal the two documents are. A fingerprint is the sorted hashes as hex digits.

A short text may have no hash under the threshold. So that it is not blank, its sketch is its lowest hash, which is known for
such a stand-in by being over the threshold. Merging leaves stand-ins out beside kept hashes and else takes the lower one, so the
merged sketch of any two texts is the sketch of both. Two stand-ins are alike 1 if equal and else 0; a stand-in has nothing in
common with kept hashes.

Each document is also compared with the next one in ascending doc_id and with an edited copy of itself. Texts move once:
rows are dealt into ranges of doc_id, every range also gets the row that follows it, and a sorted range is read as a stream.

Defined cases: a null or empty text has the fingerprint "", alike 1 to another "" and 0 to anything else; equal doc_ids
are ordered by text and null doc_ids come first; after the last document the first is next (a lone document follows
itself); other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches
from .packed import distinct
from .shingles import shingles

#: One of so many hashes is kept.
SCALE = 8
#: Documents of a range, and ranges at most (then ranges grow; they are streamed).
RANGE_DOCS, RANGES = 1000, 100_000


def kept(hashes: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The sketch: distinct hashes below the threshold, in order; if there are none, the lowest as a stand-in."""
    low = hashes[hashes < np.uint64(2**64 // scale)]
    return distinct(low) if len(low) or not len(hashes) else hashes.min(keepdims=True)


def sketches(texts: list[str | None], scale: int = SCALE) -> list[np.ndarray]:
    return [kept(h, scale) for h in shingles(texts)]


def written_out(sketch: np.ndarray) -> str:
    return sketch.astype(">u8").tobytes().hex()


def read_in(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype(np.uint64)


def merged(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The sketch of both documents together."""
    return kept(np.concatenate([a, b]), scale)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The share of the smaller sketch that is in the other one. A stand-in is over the threshold, so only a stand-in can equal it."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def edited(text: str, following: str) -> str:
    """The last quarter replaced by as much of the next text's beginning."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def fingerprints(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """doc_id and the fingerprint of every text; needs no shuffle."""

    def run(frames):
        for b in batches(frames):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([written_out(s) for s in sketches(b.column("text").to_pylist(), scale)])], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """Every document's fingerprint beside its edited copy's and the next document's."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.select("doc_id")
    count = ids.count()
    ranges = int(min(RANGES, max(1, count // RANGE_DOCS)))
    cuts = sorted(set(ids.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.25 / ranges))) if ranges > 1 else []
    cuts = np.array(cuts, np.int64)

    def range_of(ids: pa.Array) -> np.ndarray:
        held = ids.fill_null(-(2**63)).to_numpy(zero_copy_only=False)
        return np.searchsorted(cuts, held, "right").astype(np.int32)

    def ranged(frames):
        for b in frames:
            yield pa.RecordBatch.from_arrays([pa.array(range_of(b.column("doc_id"))), b.column("doc_id")], names=["range", "doc_id"])

    heads = ids.mapInArrow(ranged, "range int, doc_id long").groupBy("range").agg(F.min(F.struct("doc_id")).alias("head"))
    found = sorted((r["range"], r["head"]["doc_id"]) for r in heads.collect())  # one row a range
    before = {head: found[i - 1][0] for i, (_, head) in enumerate(found)}

    def dealt(frames):
        held = pa.array([h for h in before if h is not None], pa.int64())
        for b in frames:
            if not b.num_rows:
                continue
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(range_of(b.column("doc_id"))), pa.array(np.zeros(n, bool)), *b.columns], names=["range", "tail", "doc_id", "text"])
            ids = b.column("doc_id")
            import pyarrow.compute as pc

            is_head = pc.is_in(ids, held)
            if None in before:
                is_head = pc.or_(is_head, pc.is_null(ids))
            rows = np.flatnonzero(is_head.to_numpy(zero_copy_only=False))
            if len(rows):
                t = b.take(pa.array(rows))
                to = [before[x] for x in t.column("doc_id").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(np.ones(len(rows), bool)), *t.columns], names=["range", "tail", "doc_id", "text"])

    def run(frames):
        rows: list[tuple] = []
        for b in batches(frames, 1_000_000):
            rows += zip(*(b.column(x).to_pylist() for x in ("range", "tail", "doc_id", "text")), strict=True)
            yield from out(rows)
            rows = rows[-1:]

    def out(rows):
        pairs = [(a[2], a[3], b[3]) for a, b in zip(rows, rows[1:], strict=False) if not a[1] and a[0] == b[0]]
        if not pairs:
            return
        texts = [x[1] for x in pairs]
        new = [edited(x, y) for _, x, y in pairs]
        both = sketches([*texts, pairs[-1][2]], scale)
        own = dict(zip(texts, both, strict=False))
        after = [own[p[2]] if p[2] in own else sketches([p[2]], scale)[0] for p in pairs]
        changed = sketches(new, scale)
        cols = [
            [p[0] for p in pairs],
            [len(t) for t in texts],
            [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in new],
            [written_out(s) for s in both[: len(texts)]],
            [written_out(s) for s in changed],
            [containment(a, b) for a, b in zip(both, changed, strict=False)],
            [containment(a, b) for a, b in zip(both, after, strict=False)],
        ]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in OUT.split(", ")])

    rows = docs.mapInArrow(dealt, "range int, tail boolean, doc_id long, text string")
    return rows.repartition("range").sortWithinPartitions("range", "tail", "doc_id", "text").mapInArrow(run, OUT)
