"""Connected components of a graph of links, by alternating star operations (Kiveris et al. 2014), as joins and aggregates.

No task and no driver holds more than its share of the links: a node of very many links is only ever reduced by a minimum
that is combined before the shuffle, and that minimum comes back to its links by a broadcast of few rows, so they stay in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import split_join, written

#: Links of a file.
LINKS = 50_000


def _large_star(e: DataFrame, n: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour. n: links. No more links come out; some may be equal."""
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("times")).select("u", F.least("u", "m").alias("m"), "times")
    return split_join(both.filter("v > u"), low, "u", "times", 2 * n).select(F.col("m").alias("u"), "v").filter("u <> v")


def _small_star(e: DataFrame, n: int) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them. n: an upper bound of the links' number, or near it."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("times"))
    moved = split_join(down, low, "u", "times", n).filter("v <> m").select(F.col("m").alias("u"), "v")
    return moved.union(low.select(F.col("m").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of ``links`` (columns u, v, long); nodes without links are absent."""
    e = written(links.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    mark = None
    while True:
        now = e.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if (now["n"], now["h"]) == mark or not now["n"]:
            break
        mark = (now["n"], now["h"])
        parts = 8 + now["n"] // LINKS  # a round never has more links than the one before, so small graphs need not be many small files
        large = written(_large_star(e, now["n"]).coalesce(parts), "links")
        e = written(_small_star(large, now["n"]).coalesce(parts), "links")
    return e.select(F.col("v").alias("node"), F.col("u").alias("component")).union(e.select(F.col("u").alias("node"), F.col("u").alias("component"))).distinct()
