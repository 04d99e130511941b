"""What the operators share: the shared folder, written steps that cut lineage, streaming Arrow maps."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session has one of its own.

    On a cluster a folder of the driver's machine would be lost on the executors, so there the setting is required.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = held.get() if held.isDefined() else None
    if not at:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="motusflow-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """The frame as a table in the shared folder: computed once, its lineage cut, safe from lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def text_of(column: str = "text"):
    """A null text is an empty one."""
    return F.coalesce(F.col(column), F.lit("")).alias(column)


def batches(frames: Iterator[pa.RecordBatch], limit_chars: int = 2_000_000, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that each holds about ``limit_chars`` bytes of ``column``, whole rows only."""
    for b in frames:
        rows = b.num_rows
        if not rows:
            continue
        if b.column(column).nbytes <= limit_chars:
            yield b
            continue
        import numpy as np
        import pyarrow.compute as pc

        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < rows:
            base = size[first - 1] if first else 0
            last = max(int(np.searchsorted(size, base + limit_chars, "right")), first + 1)
            yield b.slice(first, last - first)
            first = last


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def count_in(df: DataFrame, most: int) -> bool:
    """Whether the frame has at most ``most`` rows; looks no further than that."""
    return df.limit(most + 1).count() <= most


#: Keys that a split join broadcasts at most.
HOT = 1 << 16


def split_join(rows: DataFrame, one: DataFrame, key: str, times: str, total: int, hot: int = HOT) -> DataFrame:
    """``rows`` inner-joined on ``key`` with ``one``, which has one row a key and, as ``times``, how many of the ``total`` rows hold it.

    A key of more than one of ``hot`` rows (there can be no more than ``hot`` such keys) is broadcast, so its rows stay where they are;
    the others are shuffled, and none of them fills a task. Both frames are read twice, but for no more than ``hot`` rows in all.
    """
    if total <= hot:
        return rows.join(F.broadcast(one.drop(times)), key)
    often = F.col(times) * F.lit(hot) > F.lit(int(total))
    held = F.broadcast(one.filter(often).drop(times))
    rest = rows.join(F.broadcast(one.filter(often).select(key)), key, "left_anti")
    there = rows.join(held, key)
    return there.union(rest.join(one.filter(~often).drop(times), key).select(there.columns))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def spread(df: DataFrame, key: str, groups: int) -> DataFrame:
    """The rows dealt by ``key`` for work on about ``groups`` heavy groups: by their number, as their compressed bytes say little.

    From some thousands of groups on, a task takes several, one after another.
    """
    most = max(4000, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(max(1, min(2 * groups, most)), key)
