"""Near-duplicates by improved consistent weighted sampling (Ioffe 2010) over TF-IDF shingles of five words.

1. Document frequencies of all shingles, by 48 to 64 bits of their hashes (packed.key_mask): each chunk of documents sends its
   distinct shingles, sorted and packed, to key ranges, whose sums return to the chunks.
2. A weight for each shingle: its count times an inverse document frequency between 1 and 2, so that no shared shingle is
   worth less than half of a rare one.
3. SAMPLES consistent weighted samples a document; equal texts are folded into one class by content first.
4. Bands of samples give buckets. The members of all buckets with the same first member, their leader, form a group, so that texts
   which share several bands meet once; no pairs are listed.
5. Every member of similar signature is compared with its leader by whole texts, in parts of bounded size that each get the
   leader: work in proportion to the members. In a cluster of near copies that settles nearly all.
6. Members that this leaves apart from their leader are compared with the members of their group from which they are still
   apart, in cells of bounded size: by signatures first, then by whole texts. The weighted Jaccard similarity is exact.

A pair of similarity 0.8 shares no band with a probability of about (1 - 0.8 ** 4) ** 16 = 0.0002.

Defined cases: null and empty texts form one class, as do texts without words that are equal; shorter texts than five words
have one shingle. A class is known by its content, so rows with one doc_id or none are told apart by their texts; of each
component one row stays, that of the smallest doc_id, and one without doc_id only if no row has one (component_id is null then);
rows equal in doc_id and text are flagged alike in ``near_duplicates`` and come once in ``deduplicated``; an empty table gives
no rows; extra columns, whatever their names, pass through ``deduplicated`` and are otherwise not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, count_in, fresh, split_join, spread, written
from .graph import components
from .packed import by_range, distinct, from_gaps, gaps, key_mask, packed, range_bits, summed, unpacked
from .shingles import mixed, shingles

THRESHOLD = 0.8
SAMPLES, ROWS = 64, 4
#: Share of equal samples below which a candidate is not compared in full: a pair at the threshold falls below with p < 1e-6.
ESTIMATE = 0.55
#: Distinct shingles of a chunk of documents, and characters of all texts for each range of shingles.
CHUNK_SHINGLES, RANGE_CHARS = 1_000_000, 12_000_000
#: Members of a part or a side of a cell, and rows that are broadcast at most.
BLOCK, SMALL = 1024, 500_000
#: Leaders whose signatures are broadcast at most.
LEADERS = 1 << 14


def document_frequencies(docs: DataFrame) -> tuple[dict[int, int], int]:
    """Documents that hold each shingle, and all documents, gathered on the driver: for corpora that fit it."""

    def run(frames):
        for b in batches(frames):
            found = [np.unique(s) for s in shingles(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["s"])

    rows = docs.select("text").mapInArrow(run, "s long").groupBy("s").count().toPandas()
    return dict(zip(rows["s"].to_numpy().view(np.uint64).tolist(), rows["count"].tolist(), strict=True)), docs.count()


def inverse(df: np.ndarray, n: int) -> np.ndarray:
    """1 + ln((n + 1) / (df + 1)) / ln(n + 1), at least 1."""
    return (1 + np.maximum(np.log((n + 1) / (df + 1.0)), 0) / np.log(max(n, 1) + 1)).astype(np.float32)


def idf_table(df: dict[int, int], n: int):
    """The inverse document frequencies of shingles, as a function of them."""
    return lambda s: inverse(np.array([df[x] for x in s.tolist()], np.int64), n)


def weighted(found: np.ndarray, idf) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in order, with TF-IDF weights."""
    s, n = np.unique(found, return_counts=True)
    return s, n.astype(np.float32) * idf(s)


def _held_idf(df: bytes | None, n: int):
    """The inverse document frequencies of one document's distinct shingles, of which ``df`` are the frequencies; none: all are 1."""
    return lambda s: inverse(unpacked(df, "<u4") if df else np.ones(len(s), np.uint32), n)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    either = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64)) - both
    return both / either if either else 1.0


_drawn: list = []


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fixed odd factors of both halves of a hash for three draws of each sample, and 2 ** 16 gamma variates."""
    if not _drawn:
        rng = np.random.Generator(np.random.PCG64(20100512))
        low, high = (rng.integers(0, 2**32, (3, 1, SAMPLES), np.uint32) | np.uint32(1) for _ in range(2))
        _drawn.extend((low, high, np.maximum(-np.log1p(-rng.random((2, 1 << 16))).sum(0), 1e-6).astype(np.float32)))
    return tuple(_drawn)


def _draws(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each shingle and sample: gamma r, its inverse, log of gamma c, uniform beta; all from the whole hash."""
    low, high, gamma = _tables()
    a, z = (s & np.uint64(0xFFFFFFFF)).astype(np.uint32)[:, None], (s >> np.uint64(32)).astype(np.uint32)[:, None]

    def bits(k: int) -> np.ndarray:
        """32 bits, the higher ones mixed well."""
        x = a * low[k]
        x += z * high[k]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x85EBCA6B)
        return x

    one, unit = bits(0), np.float32(2.0**-24)
    one ^= one >> np.uint32(16)
    r = np.take(gamma, one >> np.uint32(16))
    beta = (one & np.uint32(0xFFFF)).astype(np.float32) * np.float32(2.0**-16)
    both = ((bits(1) >> np.uint32(8)).astype(np.float32) + np.float32(0.5)) * unit
    both *= ((bits(2) >> np.uint32(8)).astype(np.float32) + np.float32(0.5)) * unit
    return r, 1 / r, np.log(np.maximum(-np.log(both), np.float32(1e-9))), beta


def samples(s: np.ndarray, w: np.ndarray) -> np.ndarray:
    """SAMPLES consistent weighted samples, each hashed to 32 bits."""
    log_w = np.log(w.astype(np.float32))[:, None]
    best, who, level = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, np.uint64), np.zeros(SAMPLES, np.float32)
    lane = np.arange(SAMPLES)
    for a in range(0, len(s), 1024):
        part = s[a : a + 1024]
        r, inverse, log_c, beta = _draws(part)
        step = np.floor(log_w[a : a + 1024] * inverse + beta)
        cost = log_c - r * (step - beta + 1)
        at = cost.argmin(0)
        low = cost[at, lane]
        new = low < best
        best[new], who[new], level[new] = low[new], part[at[new]], step[at[new], lane[new]]
    return (mixed(who ^ (level.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(32)).astype("<u4")


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """A 64-bit key for every band of every signature."""
    rows = sigs.reshape(len(sigs), -1, ROWS).astype(np.uint64)
    acc = np.arange(rows.shape[1], dtype=np.uint64)[None, :] + np.uint64(1)
    for j in range(ROWS):
        acc = mixed(acc * np.uint64(0x100000001B3) + rows[:, :, j])
    return acc.view(np.int64)


def _mark():
    """Equal for rows of the same doc_id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))


DEALT = pa.schema([("range", pa.int64()), ("chunk", pa.int64()), *((x, pa.binary()) for x in ("gaps", "times", "docs"))])


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """rid, mark, doc_id, node (equal for texts of the same words in the same order), sig (binary; null without shingles), df.

    ``df`` is the packed document frequencies of the distinct shingles in order, null if all are 1. docs: rid, mark, doc_id, text.
    """
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    bits, (mask, drop) = range_bits(chars, RANGE_CHARS), key_mask(chars)

    def deal(frames):
        chunk = TaskContext.get().partitionId() << 32
        held, found, size = [], [], 0
        for b in batches(frames):
            some = [distinct(s & mask) for s in shingles(b.column("text").to_pylist())]
            held.append(b)
            found += some
            size += sum(map(len, some))
            if size >= CHUNK_SHINGLES:
                yield closed(chunk, held, found)
                chunk, held, found, size = chunk + 1, [], [], 0
        if held:
            yield closed(chunk, held, found)

    def closed(chunk, held, found):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for b in held:
                out.write_batch(b)
        rows = [(-1 - chunk, chunk, None, None, sink.getvalue().to_pybytes())]  # a group of its own, on its way to its chunk
        key, times = np.unique(np.concatenate(found), return_counts=True)
        rows += [(k, chunk, gaps(key[a:z], drop), packed(times[a:z].astype("<u4")), None) for k, a, z in by_range(key, bits)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), DEALT, strict=True)], schema=DEALT)

    def totals(t: pa.Table) -> pa.Table:
        if t.column("range")[0].as_py() < 0:
            return t.select(["range", "chunk", "times", "docs"])
        keys = [from_gaps(g) for g in t.column("gaps").to_pylist()]
        _, (df,) = summed(keys, [unpacked(x, "<u4") for x in t.column("times").to_pylist()])
        back = pa.array([packed(x.astype("<u4")) for x in df], pa.binary())
        return pa.table([t.column("range"), t.column("chunk"), back, pa.nulls(len(back), pa.binary())], names=["range", "chunk", "times", "docs"])

    def signed(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["range"])
        docs = pa.ipc.open_stream(rows[0]["docs"]).read_all()
        found = shingles(docs.column("text").to_pylist())
        df = np.concatenate([np.zeros(0, "<u4"), *(unpacked(r["times"], "<u4") for r in rows[1:])])
        df = df[np.unique(np.concatenate(found) & mask, return_inverse=True)[1]]  # of every shingle in its place
        node, sig, dfs, at = [], [], [], 0
        for s in found:
            node.append(xxhash.xxh3_64_intdigest(s.tobytes()))
            key, first, times = np.unique(s, return_index=True, return_counts=True)
            own = df[at : at + len(s)][first]
            at += len(s)
            dfs.append(packed(own) if (own > 1).any() else None)
            sig.append(samples(key, times.astype(np.float32) * inverse(own, n)).tobytes() if len(s) else None)
        new = [pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(sig, pa.binary()), pa.array(dfs, pa.binary())]
        return pa.table([*(docs.column(x) for x in ("rid", "mark", "doc_id")), *new], names=["rid", "mark", "doc_id", "node", "sig", "df"])

    dealt = docs.select("rid", "mark", "doc_id", "text").mapInArrow(deal, "range long, chunk long, gaps binary, times binary, docs binary")
    part = spread(dealt, "range", 1 + chars // RANGE_CHARS).groupBy("range").applyInArrow(totals, "range long, chunk long, times binary, docs binary")
    return spread(part, "chunk", 1 + chars // (6 * CHUNK_SHINGLES)).groupBy("chunk").applyInArrow(signed, "rid long, mark long, doc_id long, node long, sig binary, df binary")


def _signs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u4").reshape(len(column), -1)


def _blocks_of(times: str):
    return F.ceil(F.col(times) / BLOCK).cast("int")


def _block_in(blocks):
    return F.pmod(F.xxhash64("v"), blocks).cast("int")


def _runs(frames, keys: list[str], columns: list[str]):
    """The rows of each key of sorted batches, as lists of columns; only of keys with more than one row."""
    key, held = None, []
    for b in frames:
        for row in zip(*(b.column(x).to_pylist() for x in (*keys, *columns)), strict=True):
            if row[: len(keys)] != key:
                if len(held) > 1:
                    yield key, list(zip(*held, strict=True))
                key, held = row[: len(keys)], []
            held.append(row[len(keys) :])
    if len(held) > 1:
        yield key, list(zip(*held, strict=True))


def linked(weights: list[tuple[np.ndarray, np.ndarray]], asks: list[int], label: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Pairs of the threshold or more that connect all that such pairs with one of ``asks`` connect; fewer pairs than there are texts.

    Each of ``asks`` is compared exactly with all texts of other labels at once; linked texts then have one label.
    """
    sizes = np.array([len(s) for s, _ in weights])
    starts = np.cumsum(sizes) - sizes
    _, place = np.unique(np.concatenate([s for s, _ in weights]), return_inverse=True)
    w = np.concatenate([x for _, x in weights]).astype(np.float64)
    total = np.add.reduceat(w, starts)
    own, label, out = np.zeros(int(place.max()) + 1), label.copy(), []
    for b in asks:
        other = (label != label[b]) & (np.minimum(total, total[b]) >= (threshold - 1e-9) * np.maximum(total, total[b]))
        if not other.any():
            continue
        mine = slice(starts[b], starts[b] + sizes[b])
        own[place[mine]] = w[mine]
        both = np.add.reduceat(np.minimum(w, own[place]), starts)
        own[place[mine]] = 0
        for a in np.flatnonzero(other & (both >= threshold * (total + total[b] - both))).tolist():
            if label[a] != label[b]:
                out.append((b, a))
                label[label == label[a]] = label[b]
    return out


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([min(p) for p in pairs], pa.int64()), pa.array([max(p) for p in pairs], pa.int64())], names=["u", "v"])


class _Classes:
    """The tables that the steps share: ``own`` (node, sig, df: one row a class with shingles), ``reps`` (node, head), ``rows``."""

    def __init__(self, rows: DataFrame, threshold: float):
        self.rows, self.threshold, self.n = rows, threshold, rows.count()
        self.sigs = written(signatures(rows, self.n), "signatures")
        head = F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "mark", "rid")
        self.reps = written(self.sigs.groupBy("node").agg(F.min(head).alias("head")), "classes")
        self.own = written(self.sigs.filter("sig is not null").select("node", "sig", "df").dropDuplicates(["node"]), "own")

    def groups(self) -> DataFrame:
        """(u, v): leader and member, for the members of all buckets of two classes or more; u <> v."""

        def banded(frames):
            for b in frames:
                if b.num_rows:
                    keys = band_keys(_signs(b.column("sig").to_pylist()))
                    yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(b.column("node").to_numpy(), keys.shape[1]))], names=["band", "node"])

        bands = written(self.own.select("node", "sig").mapInArrow(banded, "band long, node long"), "bands")
        leaders = bands.groupBy("band").agg(F.min("node").alias("u"), F.count("*").alias("times")).filter("times > 1")
        return written(split_join(bands, leaders, "band", "times", bands.count()).select("u", F.col("node").alias("v")).filter("u <> v").distinct(), "groups")

    def texts(self, nodes: DataFrame) -> DataFrame:
        """v, text of the classes in ``nodes`` (v, distinct)."""
        need = nodes.join(self.reps.select(F.col("node").alias("v"), F.col("head.rid").alias("rid")), "v")
        if count_in(nodes, SMALL):  # then only their texts are shuffled
            need = F.broadcast(written(need, "need"))
        return self.rows.select("rid", "text").join(need, "rid").select("v", "text")

    def compared(self, cells: DataFrame, keys: list[str]) -> DataFrame:
        """Links (u, v) within cells by the whole texts. cells: keys, v, label, asks."""
        cells = written(cells, "cells")
        texts, n, threshold = self.texts(cells.select("v").distinct()), self.n, self.threshold

        def run(frames):
            for _, (v, label, asks, text, df) in _runs(frames, keys, ["v", "label", "asks", "text", "df"]):
                found = [weighted(s, _held_idf(d, n)) for s, d in zip(shingles(list(text)), df, strict=True)]
                _, label = np.unique(np.array(label, np.int64), return_inverse=True)
                pairs = linked(found, [i for i, a in enumerate(asks) if a], label, threshold)
                if pairs:
                    yield _links([(v[a], v[b]) for a, b in pairs])

        rows = cells.join(self.own.select(F.col("node").alias("v"), "df"), "v").join(texts, "v").select(*keys, "v", "label", "asks", "text", "df")
        return written(rows.repartition(*keys).sortWithinPartitions(*keys, "v").mapInArrow(run, "u long, v long"), "pairs")

    def with_leader(self, groups: DataFrame) -> DataFrame:
        """Links of members with their leader."""
        sizes = groups.groupBy("u").agg(F.count("*").alias("n"))
        own = self.own.select("node", "sig")
        leaders = written(sizes.join(own.withColumnRenamed("node", "u"), "u").select("u", "n", F.col("n").alias("times"), F.col("sig").alias("sig_u")), "leaders")
        rows = split_join(groups, leaders, "u", "times", groups.count(), LEADERS).join(own.withColumnRenamed("node", "v"), "v").select("u", "v", "n", "sig_u", "sig")

        def near(frames):
            for b in frames:
                if b.num_rows:
                    share = (_signs(b.column("sig_u").to_pylist()) == _signs(b.column("sig").to_pylist())).mean(1)
                    yield b.filter(pa.array(share >= ESTIMATE)).select(["u", "v", "n"])

        kept = written(rows.mapInArrow(near, "u long, v long, n long").withColumn("part", _block_in(_blocks_of("n"))), "near")
        heads = kept.select("u", "part", F.col("u").alias("v")).distinct()
        cells = kept.select("u", "part", "v", F.lit(False).alias("asks")).union(heads.select("u", "part", "v", F.lit(True).alias("asks")))
        return self.compared(cells.withColumn("label", F.col("v")), ["u", "part"])

    def apart(self, groups: DataFrame, links: DataFrame) -> DataFrame | None:
        """Links between members that are apart from their leader and others of their group; nothing if there are no such members."""
        members = groups.union(groups.select("u", F.col("u").alias("v")).distinct())
        members = members.join(components(links).withColumnRenamed("node", "v"), "v", "left").select("u", "v", F.coalesce("component", "v").alias("label"))
        members = written(members, "members")
        mixed_ = members.groupBy("u").agg(F.max(F.when(F.col("u") == F.col("v"), F.col("label"))).alias("mine"), F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("times")).filter("low < high")
        rest = split_join(members, mixed_.select("u", "mine", "times"), "u", "times", members.count())
        rest = written(rest.select("u", "v", "label", (F.col("label") != F.col("mine")).alias("asks")), "rest")
        if rest.isEmpty():
            return None
        signed = _cells(rest).join(self.own.select(F.col("node").alias("v"), "sig"), "v")

        def near(frames):
            for key, (v, label, asks, sig) in _runs(frames, CELL, ["v", "label", "asks", "sig"]):
                sig, label, asks = _signs(sig), np.array(label, np.int64), np.array(asks)
                keep = np.zeros(len(v), bool)
                for a in np.array_split(np.flatnonzero(asks), -(-int(asks.sum()) // 16) or 1):
                    hit = ((sig[a, None, :] == sig[None, :, :]).mean(2) >= ESTIMATE) & (label[a, None] != label[None, :])
                    keep[a[hit.any(1)]] = True
                    keep |= hit.any(0)
                if keep.any():
                    some = np.flatnonzero(keep)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), key[0], np.int64)), pa.array(np.array(v, np.int64)[some]), pa.array(label[some]), pa.array(asks[some])], names=["u", "v", "label", "asks"])

        kept = signed.select(*CELL, "v", "label", "asks", "sig").repartition(*CELL).sortWithinPartitions(*CELL, "v").mapInArrow(near, "u long, v long, label long, asks boolean")
        kept = written(kept.groupBy("u", "v", "label").agg(F.max("asks").alias("asks")), "kept")
        return self.compared(_cells(kept), CELL)

    def components(self) -> DataFrame:
        """node, component for every class that is linked with another."""
        groups = self.groups()
        links = self.with_leader(groups)
        more = self.apart(groups, links)
        return components(links if more is None else links.union(more))


CELL = ["u", "i", "j"]


def _cells(members: DataFrame) -> DataFrame:
    """Members (u, v, label, asks) dealt so that each that asks meets every member of its group: cells (u, i, j) of one block of
    those that ask and one block of all. So a group is copied as often as it has blocks that ask, not blocks of members."""
    sizes = members.groupBy("u").agg(F.ceil(F.count(F.when(F.col("asks"), 1)) / BLOCK).cast("int").alias("ni"), F.ceil(F.count("*") / BLOCK).cast("int").alias("nj"), F.count("*").alias("times"))
    rows = split_join(members, sizes.filter("ni > 0"), "u", "times", members.count())
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = rows.filter("asks").select("u", _block_in(F.col("ni")).alias("i"), every("nj").alias("j"), "v", "label", "asks")
    others = rows.select("u", every("ni").alias("i"), _block_in(F.col("nj")).alias("j"), "v", "label", F.lit(False).alias("asks"))
    return asking.union(others).groupBy(*CELL, "v", "label").agg(F.max("asks").alias("asks"))


def _numbered(docs: DataFrame, rid: str) -> DataFrame:
    """The rows as a table, each with a number of its own."""
    return written(docs.withColumn(rid, F.monotonically_increasing_id()), "rows")


def _classes(rows: DataFrame, rid: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """rid, mark, doc_id, node of every row, and for every node the doc_id, mark and rid of the row that stays of its component."""
    rows = rows.select(F.col(rid).alias("rid"), _mark().alias("mark"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    held = _Classes(rows, threshold)
    classes = written(held.reps.join(held.components(), "node", "left").select("node", F.coalesce("component", "node").alias("component"), "head"), "members")
    kept = classes.groupBy("component").agg(F.min("head").alias("kept"), F.count("*").alias("times"))
    stays = split_join(classes.select("node", "component"), kept, "component", "times", classes.count())
    return held.sigs.select("rid", "mark", "doc_id", "node"), written(stays.select("node", "kept"), "stays")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, component_id (smallest doc_id of its group), keep, for every row of ``docs``."""
    rows, stays = _classes(_numbered(docs.select("doc_id", "text"), "rid"), "rid", threshold)
    sizes = rows.groupBy("node").agg(F.count("*").alias("times")).join(stays, "node")
    rows = split_join(rows, sizes, "node", "times", rows.count())
    return rows.select("doc_id", F.col("kept.doc_id").alias("component_id"), (F.col("mark") == F.col("kept.mark")).alias("keep"))


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each group (of the smallest doc_id), with all its columns."""
    rid = fresh(docs, "rid")
    rows = _numbered(docs, rid)
    kept = _classes(rows, rid, threshold)[1].select(F.col("kept.rid").alias(rid)).distinct()
    return rows.join(kept, rid, "left_semi").select(docs.columns)
