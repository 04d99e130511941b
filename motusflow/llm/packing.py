"""Best-fit packing of documents into sequences of a fixed number of tokens.

The instance is the histogram of piece lengths: at most one number for each length, however many documents there are.
Martello and Toth's dominance criterion fixes small sets first (an item that stands alone, a pair that fills the
sequence, a pair or triple that dominates every other set with that item), then best-fit decreasing packs the rest, many
equal sequences at a time. What comes out is patterns with multiplicities; a document finds its sequence from the rank
of its piece among the pieces of its length, so no task sees more than its own rows.

Defined cases: a null text is empty and has the end id alone; longer documents are cut into full pieces, the first may be
shorter; repeated doc_ids are packed as separate documents; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batches, written
from .encode import encoder

CAPACITY = 1024
Pattern = tuple[tuple[tuple[int, int], ...], int]  # ((length, how many), ...), number of equal sequences


def fixed_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Sets that dominate every other set holding their largest item, and what is left. counts: length to number."""
    left = {s: n for s, n in counts.items() if n > 0}
    sizes = sorted(left)
    found: list[Pattern] = []

    def take(items: list[int]) -> None:
        need = {s: items.count(s) for s in items}
        times = min(left[s] // n for s, n in need.items())
        found.append((tuple(sorted(need.items(), reverse=True)), times))
        for s, n in need.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
                sizes.remove(s)

    def others(j: int, how_many: int) -> list[int]:
        """The smallest items besides one of length j."""
        out: list[int] = []
        for s in sizes:
            out += [s] * min(how_many - len(out), left[s] - (s == j))
            if len(out) >= how_many:
                break
        return out

    def largest(most: int, used: list[int]) -> int:
        """The largest item of at most that length besides those used; 0 if there is none."""
        i = bisect_right(sizes, most) - 1
        while i >= 0:
            if left[sizes[i]] > used.count(sizes[i]):
                return sizes[i]
            i -= 1
        return 0

    for j in sorted(sizes, reverse=True):
        while j in left:
            room = capacity - j
            k = largest(room, [j])
            small = others(j, 3)
            if not k:
                take([j])
                continue
            if k == room or len(small) < 2 or small[0] + small[1] > room:
                take([j, k])
                continue
            if len(small) == 3 and sum(small) <= room:
                break  # four fit: nothing is proven for j
            best, second = 0, 0
            for x in sizes[: bisect_right(sizes, room)]:
                if left[x] > (x == j) and (y := largest(min(room - x, x), [j, x])):
                    best, second = max(best, x + y), max(second, y)
            if k >= best:
                take([j, k])
                continue
            b = largest(room - k, [j, k])
            if b and b >= second:
                take([j, k, b])
                continue
            break
    return found, left


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing on a histogram: equal open sequences are filled together."""
    rooms: list[int] = []
    opened: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    done: list[Pattern] = []

    def put(items: tuple[tuple[int, int], ...], room: int, times: int) -> None:
        if not times:
            return
        if not room:
            done.append((items, times))
            return
        if room not in opened:
            opened[room] = []
            insort(rooms, room)
        opened[room].append((items, times))

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            i = bisect_right(rooms, s - 1)
            if i == len(rooms):
                items, times, room = (), -(-n // (capacity // s)), capacity
            else:
                room = rooms[i]
                items, times = opened[room].pop()
                if not opened[room]:
                    del opened[room]
                    rooms.pop(i)
            each = room // s
            full = min(times, n // each)
            put((*items, (s, each)), room - each * s, full)
            n, times = n - full * each, times - full
            if times and n:
                part = min(n, each)
                put((*items, (s, part)), room - part * s, 1)
                n, times = n - part, times - 1
            if items:
                put(items, room, times)
    return done + [x for group in opened.values() for x in group]


def packed(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    fixed, rest = fixed_by_dominance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def segments(patterns: list[Pattern]) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces a sequence, first offset), by length and rank."""
    rows, ranks, sequence = [], {}, 0
    for items, times in patterns:
        offset = 0
        for s, each in items:
            rows.append((s, ranks.get(s, 0), sequence, each, offset))
            ranks[s] = ranks.get(s, 0) + each * times
            offset += s * each
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def piece_rows(docs: DataFrame, path: str, how: str = "gpt", end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """A row a piece: doc_id, piece, start, length, ids_crc32, and its place among its task's pieces of that length."""

    def run(frames):
        enc, part = encoder(path, how), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches(frames):
            ids, bounds = enc.encode(b.column("text").to_pylist())
            ids = np.insert(ids, bounds[1:], end_id).astype("<u4")
            total = np.diff(bounds) + 1
            n = -(-total // capacity)
            doc = np.repeat(np.arange(len(total)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            first = (total - 1) % capacity + 1
            start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[doc], capacity)
            at = (np.cumsum(total) - total)[doc] + start
            raw = memoryview(ids.tobytes())
            crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist(), strict=True)), np.int64, len(doc))
            order = np.argsort(length, kind="stable")
            heads = np.flatnonzero(np.diff(length[order], prepend=-1))
            runs = np.diff(np.append(heads, len(order)))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order)) - np.repeat(heads, runs) + seen[length[order]]
            seen[length[order][heads]] += runs
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc), pa.array(np.full(len(doc), part, np.int32)), pa.array(place)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long")


def pack(docs: DataFrame, path: str, how: str = "gpt", end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    pieces = written(piece_rows(docs, path, how, end_id, capacity), "pieces")
    each = pieces.groupBy("part", "length").agg((F.max("place") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    each = written(each.select("part", "length", "n", before.alias("before")), "ranks")
    counts = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most one row a length
    plan = segments(packed(counts, capacity))
    keys = (plan[:, 0] << 40) + plan[:, 1]

    def place(frames):
        for b in frames:
            if not b.num_rows:
                continue
            length, rank = (b.column(x).to_numpy(zero_copy_only=False) for x in ("length", "rank"))
            row = plan[np.searchsorted(keys, (length << 40) + rank, "right") - 1]
            q = rank - row[:, 1]
            sequence, offset = row[:, 2] + q // row[:, 3], row[:, 4] + q % row[:, 3] * length
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    # a (task, length) has a row, so the table grows with the corpus and is merged, not broadcast; a key holds one task's pieces at most
    ranked = pieces.join(each.select("part", "length", "before").hint("merge"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
