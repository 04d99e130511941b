"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Vectors are scaled to length 1 and turned to the principal axes of the whole table. Sorted by the first axis they are packed
into blocks of some megabytes; blocks and tiles whose intervals on that axis are too far apart are never paired. As blocks are in
order, each has its partners in one stretch, and what moves is a block for each of its partners, so large blocks keep that small.
Within a pair of blocks, tiles are compared
on the leading axes first: the norms of what is left bound the rest of the product, so a tile (then a row or column of it) is
given up as soon as no cosine can reach the threshold. What survives is decided by the full product of the original vectors in
double precision. A pair of blocks returns link counts and one label a vector, never the pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and stand alone;
vectors of different lengths are not compared; equal vectors are compared once and counted as often as they occur; rows equal in
vec_id and vector are one vector, rows of one vec_id with different vectors are vectors of their own; a null vec_id stands alone; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import split_join, written
from .graph import components

THRESHOLD = 0.9
#: Bytes of a block, vectors of a tile within a pair of blocks, and bytes of vectors of many copies that are broadcast at most.
BLOCK_BYTES, TILE, HOT_BYTES = 4_000_000, 512, 16_000_000
#: Shares of the axes after which a bound is taken.
STAGES = (0.25, 0.6)
SLACK = 1e-4


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow and no underflow in the norm
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def usable(column: str = "embedding"):
    """Whether a vector can be compared."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(column).isNotNull() & (F.size(column) > 0) & ~bad & F.exists(column, lambda x: x != 0)


def principal_axes(vectors: DataFrame, width: int) -> np.ndarray:
    """Eigenvectors of the second moments of all unit vectors, largest first; ``width`` rows reach the driver."""

    def run(frames):
        total = np.zeros((width, width))
        for b in frames:
            if b.num_rows:
                x = _unit(_matrix(b.column("embedding")))
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], names=["i", "row"])

    def add(t: pa.Table) -> pa.Table:
        return pa.table([t.column("i")[:1], pa.array([sum(np.frombuffer(r, np.float64) for r in t.column("row").to_pylist()).tobytes()], pa.binary())], names=["i", "row"])

    rows = vectors.select("embedding").mapInArrow(run, "i int, row binary").groupBy("i").applyInArrow(add, "i int, row binary").collect()
    moments = np.zeros((width, width))
    for r in rows:
        moments[r["i"]] = np.frombuffer(bytes(r["row"]), np.float64)
    return np.linalg.eigh((moments + moments.T) / 2)[1][:, ::-1].copy()


BLOCKS = "block long, low double, high double, ids binary, weights binary, data binary"


def blocks(vectors: DataFrame, axes: np.ndarray) -> DataFrame:
    """Blocks of vectors (rep, n, embedding), in order of the first axis."""
    size = max(1, BLOCK_BYTES // (4 * len(axes)))

    def first_axis(frames):
        for b in frames:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_unit(_matrix(b.column("embedding"))) @ axes[:, 0])], names=[*b.schema.names, "y"])

    def run(frames):
        part, k, held, n = TaskContext.get().partitionId(), 0, [], 0
        for b in frames:
            held.append(b)
            n += b.num_rows
            while n >= size:
                t = pa.Table.from_batches(held)
                yield out(part << 32 | k, t.slice(0, size))
                held, n, k = t.slice(size).to_batches(), n - size, k + 1
        if n:
            yield out(part << 32 | k, pa.Table.from_batches(held))

    def out(block, t):
        t = t.combine_chunks()
        y = t.column("y").to_numpy()
        data = _matrix(t.column("embedding").chunk(0))
        row = [[block], [y.min()], [y.max()], [t.column("rep").to_numpy().astype("<i8").tobytes()], [t.column("n").to_numpy().astype("<i8").tobytes()], [data.astype("<f8").tobytes() if wide else data.astype("<f4").tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, (pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["block", "low", "high", "ids", "weights", "data"])

    wide = vectors.schema["embedding"].dataType.elementType.simpleString() == "double"
    kind = vectors.schema["embedding"].dataType.simpleString()
    # so many ranges that each fills blocks; a table without many vectors needs few
    ranges = max(1, vectors.count() // size)
    rows = vectors.select("rep", "n", "embedding").mapInArrow(first_axis, f"rep long, n long, embedding {kind}, y double")
    return rows.repartitionByRange(ranges, "y").sortWithinPartitions("y", "rep").mapInArrow(run, BLOCKS)


def _tile_links(a: np.ndarray, z: np.ndarray, ya: list[np.ndarray], yz: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Rows, columns and the links among them (a boolean matrix) of one tile; nothing if no cosine can reach the threshold."""
    reach = np.sqrt(2 - 2 * threshold) + SLACK
    if ya[0][:, 0].min() - yz[0][:, 0].max() > reach or yz[0][:, 0].min() - ya[0][:, 0].max() > reach:
        return None
    rows, cols = None, None
    for pa_, pz in zip(ya, yz, strict=True):
        pa_, pz = (pa_, pz) if rows is None else (pa_[rows], pz[cols])
        bound = pa_ @ pz.T  # leading products, and as one more axis the product of the norms of the rest
        if bound.max(initial=-1) < threshold - SLACK:
            return None
        can = bound >= threshold - SLACK
        r, c = can.any(1), can.any(0)
        rows = np.flatnonzero(r) if rows is None else rows[r]
        cols = np.flatnonzero(c) if cols is None else cols[c]
    hit = a[rows] @ z[cols].T >= threshold
    return (rows, cols, hit) if hit.any() else None


def _prepared(row: dict, prefix: str, axes: np.ndarray, wide: bool):
    x = np.frombuffer(row[f"data_{prefix}"], "<f8" if wide else "<f4").astype(np.float64).reshape(-1, len(axes))
    x = _unit(x)
    y = x @ axes
    left = np.sqrt(np.maximum(1 - np.cumsum(y * y, 1), 0))
    cuts = sorted({max(1, min(len(axes), round(len(axes) * s))) for s in STAGES})
    lead = [np.concatenate([y[:, :k], left[:, k - 1 : k]], 1).astype(np.float32) for k in cuts]
    return np.frombuffer(row[f"ids_{prefix}"], "<i8"), np.frombuffer(row[f"weights_{prefix}"], "<i8"), x, lead


def _pair(row: dict, axes: np.ndarray, wide: bool, threshold: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For two blocks: vec ids, their links in a tile, and one id each is connected with there."""
    same = row["a"] == row["z"]
    ia, wa, xa, la = _prepared(row, "a", axes, wide)
    iz, wz, xz, lz = (ia, wa, xa, la) if same else _prepared(row, "z", axes, wide)
    out = []
    for p in range(0, len(ia), TILE):
        for q in range(p if same else 0, len(iz), TILE):
            got = _tile_links(xa[p : p + TILE], xz[q : q + TILE], [y[p : p + TILE] for y in la], [y[q : q + TILE] for y in lz], threshold)
            if got is None:
                continue
            rows, cols, hit = got[0] + p, got[1] + q, got[2]
            twice = same and p == q  # the tile holds each link in both directions, and each vector beside itself
            self_ = rows[:, None] == cols[None, :] if twice else False
            of_row, of_col = _labels(hit | self_)  # beside itself, a vector's row and column are one
            hit &= ~self_ if twice else True
            u = np.flatnonzero(hit.any(1))
            out.append((ia[rows[u]], hit[u] @ wz[cols], ia[rows[of_row[u]]]))
            if not twice:
                v = np.flatnonzero(hit.any(0))
                out.append((iz[cols[v]], wa[rows] @ hit[:, v], ia[rows[of_col[v]]]))
    return out


def _labels(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and column of a boolean matrix the least row it is connected with (the number of rows, if none)."""
    rows = len(hit)
    label = np.where(hit.any(1), np.arange(rows), rows)
    while True:
        of_col = np.where(hit, label[:, None], rows).min(0)
        new = np.minimum(label, np.where(hit, of_col[None, :], rows).min(1))
        if (new == label).all():
            return label, of_col
        label = new


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every vector."""
    spark = table.sparkSession
    rows = written(table.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(usable() & F.col("vec_id").isNotNull(), F.col("embedding")).alias("embedding")), "table")
    good = rows.filter("embedding is not null")
    # n: vectors that are equal; times: rows that hold them; rep: a number for them
    folded = good.groupBy("embedding", "vec_id").agg(F.count("*").alias("times")).groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"), F.sum("times").alias("times"))
    folded = written(folded.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    wide = table.schema["embedding"].dataType.elementType.simpleString() == "double"
    found = None
    widths = sorted(r["w"] for r in folded.select(F.size("embedding").alias("w")).distinct().collect())  # lengths, not vectors
    for width in widths:
        part = folded.filter(F.size("embedding") == width)
        axes = spark.sparkContext.broadcast(principal_axes(part, width))
        linked = _linked(written(blocks(part, axes.value), "blocks"), part.count(), axes, wide, threshold)
        found = linked if found is None else found.union(linked)
    if found is None:
        found = spark.createDataFrame([], "rep long, n_links long, label long")
    found = written(found, "linked")
    direct = found.groupBy("rep").agg(F.sum("n_links").alias("n_links"))
    groups = components(found.select(F.col("rep").alias("u"), F.col("label").alias("v"))).withColumnRenamed("node", "rep")
    small = folded.select("rep", "first", "n").join(direct, "rep", "left").join(groups, "rep", "left")
    small = written(small.select("rep", "first", (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")), "reps")
    heads = small.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("times"))
    small = split_join(small.select("rep", "n_links", "component"), heads, "component", "times", small.count())
    reps = folded.select("rep", "embedding", "times").join(small.select("rep", "n_links", "component_id"), "rep").drop("rep")
    out = split_join(good, reps, "embedding", "times", good.count(), max(1, HOT_BYTES // (8 * max(widths, default=1)))).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    bare = rows.filter("embedding is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(bare).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _linked(held: DataFrame, n: int, axes, wide: bool, threshold: float) -> DataFrame:
    """rep, n_links, label: for each pair of blocks, each vector with its links there and one it is connected with."""
    reach = float(np.sqrt(2 - 2 * threshold)) + 1e-6  # unit vectors of such a cosine differ by no more on any axis
    # blocks are in order, so those that a block can reach are the next ones up to the last that begins within reach of its end,
    # which is no later than the next block's beginning; one row a block, some megabytes of vectors each
    order = W.orderBy("low", "block")
    upto = F.expr(f"count(*) over (order by low range between unbounded preceding and {reach!r}D following)")
    spans = held.select("block", "low").withColumn("place", F.row_number().over(order)).withColumn("upto", upto)
    spans = written(spans.withColumn("last", F.coalesce(F.lead("upto").over(order), F.col("place"))).select("block", "place", F.greatest("last", "place").cast("int").alias("last")), "spans")
    pairs = spans.select(F.col("block").alias("a"), F.explode(F.sequence("place", "last")).alias("place")).join(spans.select(F.col("block").alias("z"), "place"), "place").select("a", "z")
    side = lambda x: held.select(F.col("block").alias(x), F.col("ids").alias(f"ids_{x}"), F.col("weights").alias(f"weights_{x}"), F.col("data").alias(f"data_{x}"))
    rows = pairs.join(side("a").hint("merge"), "a").join(side("z").hint("merge"), "z")
    # a row holds two whole blocks, so partitions are made by the pairs of full blocks, not by the bytes Spark expects of them
    full = 1 + n // max(1, BLOCK_BYTES // (4 * len(axes.value)))
    rows = rows.repartition(min(full * full, 10_000), F.xxhash64("a", "z"))

    def run(frames):
        for b in frames:
            for i in range(b.num_rows):
                for ids, n, label in _pair(b.slice(i, 1).to_pylist()[0], axes.value, wide, threshold):
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.array(label)], names=["rep", "n_links", "label"])

    return rows.mapInArrow(run, "rep long, n_links long, label long")
