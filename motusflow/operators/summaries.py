"""Summaries of sensors, annotations and files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.times import SECOND_MS, floor_to
from ..functions.vectors import AXES, enmo

DAY_MS = 86_400_000


def annotation_duration(annotations: DataFrame, keys: Sequence[str] = ("pid", "annotator")) -> DataFrame:
    """Seconds of each label."""
    return annotations.groupBy(*keys, "label_name").agg(F.sum((F.col("stop_ms") - F.col("start_ms")) / 1000.0).alias("duration_in_seconds"))


def binned(rows: DataFrame, seconds: int, keys: Sequence[str], method: str = "enmo", time: str = "t_ms") -> DataFrame:
    """``enmo`` (mean norm above one) or ``sr`` (number of samples) for bins of whole seconds.

    Bins count from midnight of the first day, which for lengths that divide a day is the same as from 1970. With keys only bins
    with samples appear; without keys empty bins in between do too, with a null mean or a count of zero.
    """
    size = seconds * SECOND_MS
    if DAY_MS % size:
        first = floor_to(F.lit(rows.agg(F.min(time)).first()[0] or 0), DAY_MS)  # one row
        start = (floor_to(F.col(time) - first, size) + first).alias("bin_ms")
    else:
        start = floor_to(time, size).alias("bin_ms")
    measure = F.avg(enmo()).alias("enmo") if method == "enmo" else F.count("*").alias("sr")
    got = rows.groupBy(*keys, start).agg(measure)
    if keys:
        return got
    ends = got.agg(F.min("bin_ms").alias("a"), F.max("bin_ms").alias("z")).filter("a is not null")
    spine = ends.select(F.explode(F.sequence("a", "z", F.lit(size).cast("long"))).alias("bin_ms"))
    out = spine.join(got, "bin_ms", "left")
    return out if method == "enmo" else out.withColumn("sr", F.coalesce("sr", F.lit(0)))


def extremes(rows: DataFrame, keys: Sequence[str] = ("pid", "sid")) -> DataFrame:
    """Lines, largest and smallest value over all axes, and how often each occurs."""
    per = rows.withColumn("_v", F.explode(F.array(*AXES)))
    counts = per.groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    ends = counts.groupBy(*keys).agg(F.max("_v").alias("max_g"), F.min("_v").alias("min_g"), F.max_by("_n", "_v").alias("max_g_count"), F.min_by("_n", "_v").alias("min_g_count"), (F.sum("_n") / 3).cast("long").alias("lines"))
    return ends.select(*keys, "lines", "max_g", "min_g", "max_g_count", "min_g_count")


def na_rows(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows, and rows with a missing value in any column."""
    gone = F.lit(False)
    for c in columns:
        gone = gone | F.col(c).isNull()
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_if(gone).alias("na_rows"))


def extracted_sessions(rows: DataFrame, keys: Sequence[str] = ("pid", "sid"), order: Sequence[str] = ("t_ms",)) -> DataFrame:
    """Start (floor of the first row's second) and stop (floor of the last row's, plus one) of each file; by row order, not extremes."""
    place = F.struct(*order)
    ends = rows.groupBy(*keys).agg(F.min_by("t_ms", place).alias("_a"), F.max_by("t_ms", place).alias("_z"))
    return ends.select(*keys, floor_to("_a", SECOND_MS).alias("start_ms"), (floor_to("_z", SECOND_MS) + SECOND_MS).alias("stop_ms"))


def file_summary(files: DataFrame) -> DataFrame:
    """A row a file (columns path, length, content as text): size, lines, validity. Lines include the header."""
    p = F.col("path")
    lines = F.size(F.split("content", "\n")) - F.when(F.col("content").endswith("\n"), 1).otherwise(0)
    header = F.element_at(F.split("content", "\n"), 1)
    return files.select(
        paths.participant(p).alias("pid"),
        paths.file_id(p).alias("id"),
        paths.file_type(p).alias("type"),
        paths.file_date(p).alias("date"),
        paths.file_hour(p).alias("hour"),
        (F.col("length") / 1024.0).alias("size_kb"),
        lines.cast("long").alias("n_lines"),
        paths.valid_folder(p).alias("validate_folder_structure"),
        paths.valid_name(p).alias("validate_filename"),
        paths.header_report(header, paths.file_type(p)).alias("validate_csv_header"),
    ).orderBy("pid", "id", "type", "date", "hour")


def listed(files: DataFrame) -> DataFrame:
    """Participants with their sensors and annotators, and bytes. files: path, length."""
    p = F.col("path")
    kind = paths.file_type(p)
    rows = files.select(paths.participant(p).alias("pid"), kind.alias("kind"), paths.file_id(p).alias("id"), "length")
    return rows.groupBy("pid").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == "sensor", F.col("id")))), ",").alias("sensors"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == "annotation", F.col("id")))), ",").alias("annotators"),
        F.sum("length").alias("bytes"),
    )


def united(*frames: DataFrame) -> DataFrame:
    """Rows of all frames; columns in the order of the widest one, what a frame lacks as null."""
    widest = max(frames, key=lambda f: len(f.columns))
    out = widest.limit(0)
    for f in frames:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def chart_frame(rows: DataFrame, locations: DataFrame | None = None) -> DataFrame:
    """Tidy rows for charts: with ``sid_location``, which a line's colour follows (sid alone where no location is known)."""
    if locations is not None:
        rows = rows.join(locations.select("pid", "sid", "location").dropDuplicates(["pid", "sid"]), ["pid", "sid"], "left")
    return rows.withColumn("sid_location", F.concat_ws("_", "sid", "location") if "location" in rows.columns else F.col("sid"))
