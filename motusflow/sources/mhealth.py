"""Files of the sensor data set: readers with explicit schemas, partitioned and plain sinks."""

from __future__ import annotations

import uuid

import pandas as pd
import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, times

SENSOR = "HEADER_TIME_STAMP string, X string, Y string, Z string"
ANNOTATION = "HEADER_TIME_STAMP string, START_TIME string, STOP_TIME string, LABEL_NAME string"


def _with_names(df: DataFrame) -> DataFrame:
    file = F.col("_metadata.file_path")
    return df.select("*", file.alias("file"), paths.participant(file).alias("pid"), paths.file_id(file).alias("sid"), paths.file_date(file).alias("date"), paths.file_hour(file).alias("hour"))


def read_sensor(spark: SparkSession, path: str, glob: str = "*.sensor.csv") -> DataFrame:
    """file, pid, sid, date, hour, t_ms, x, y, z. Comments and rows that do not parse go, as do rows with a missing value."""
    raw = spark.read.schema(SENSOR).option("header", True).option("comment", "#").option("mode", "PERMISSIVE").option("enforceSchema", True)
    raw = _with_names(raw.option("recursiveFileLookup", True).option("pathGlobFilter", glob).csv(path))
    ts = times.parsed(F.col("HEADER_TIME_STAMP"))
    number = lambda c: F.expr(f"nullif(try_cast({c} as double), double('NaN'))")
    out = raw.withColumn("_ts", ts).select("file", "pid", "sid", "date", "hour", times.to_ms("_ts").alias("t_ms"), *(number(c).alias(c.lower()) for c in "XYZ"))
    return out.na.drop("any", subset=["t_ms", "x", "y", "z"])


def read_annotations(spark: SparkSession, path: str, glob: str = "*.annotation.csv") -> DataFrame:
    """file, pid, annotator, date, hour, start_ms, stop_ms, label_name."""
    raw = spark.read.schema(ANNOTATION).option("header", True).option("comment", "#").option("recursiveFileLookup", True).option("pathGlobFilter", glob).csv(path)
    raw = _with_names(raw).withColumn("_a", times.parsed(F.col("START_TIME"))).withColumn("_z", times.parsed(F.col("STOP_TIME")))
    return raw.select("file", "pid", F.col("sid").alias("annotator"), "date", "hour", times.to_ms("_a").alias("start_ms"), times.to_ms("_z").alias("stop_ms"), F.col("LABEL_NAME").alias("label_name"))


def read_files(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """path, length, content of every file, as text."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return raw.select("path", "length", F.decode("content", "UTF-8").alias("content"))


def locations(files: DataFrame, location_pattern: str, participant_pattern: str) -> DataFrame:
    """pid, sid, location from raw files: patterns on path and name, the serial number from the second line."""
    second = F.element_at(F.split("content", "\n"), 2)
    return files.select(
        F.regexp_extract("path", participant_pattern, 1).alias("pid"),
        F.regexp_extract(second, "Serial Number: ([A-Z0-9]+)", 1).alias("sid"),
        F.regexp_extract(paths.base_name(F.col("path")), location_pattern, 1).alias("location"),
    )


def write_hourly(rows: DataFrame, path: str, digits: int = 9, form: str = "parquet") -> None:
    """One folder for each participant, date and hour; numbers are rounded here only."""
    doubles = [f.name for f in rows.schema.fields if f.dataType.simpleString() == "double"]
    rows.withColumns({c: F.round(c, digits) for c in doubles}).write.mode("overwrite").partitionBy("pid", "date", "hour").format(form).option("header", True).save(path)


def _stored(root: str, name: str, data: bytes) -> None:
    """A file under ``root``, whole or not at all, so that a task that is run again leaves the same. root: a path or an address."""
    system, base = pa.fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (pa.fs.LocalFileSystem(), root)
    path = f"{base}/{name}"
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, path)


def write_files(rows: DataFrame, root: str, path: str = "path", order: str = "HEADER_TIME_STAMP", digits: int = 9) -> int:
    """A CSV file for each value of ``path`` (relative to ``root``), in the given order, doubles with ``digits`` places; the number of files.

    A file is the data set's unit, an hour of a sensor, and is written by one task.
    """
    columns = [c for c in rows.columns if c != path]

    def run(p: pd.DataFrame) -> pd.DataFrame:
        text = p.sort_values(order, kind="stable")[columns].to_csv(index=False, float_format=f"%.{digits}f")
        _stored(root, p[path].iloc[0], text.encode())
        return pd.DataFrame({"n": [len(p)]})

    return rows.groupBy(path).applyInPandas(run, "n long").count()


def sensor_path(pid: str = "pid", sid: str = "sid", time: str = "t_ms", kind: str = "sensor", folder: str = "MasterSynced") -> Column:
    """Where the data set keeps an hour of a sensor."""
    hour = times.from_ms(f"{time} - {time} % {times.HOUR_MS}")
    name = F.concat(F.lit("Sensor-AccelerationCalibrated-NA."), F.col(sid), F.lit("-AccelerationCalibrated."), F.date_format(hour, "yyyy-MM-dd-HH-'00-00-000-P0000.'"), F.lit(f"{kind}.csv"))
    return F.concat_ws("/", F.col(pid), F.lit(folder), F.date_format(hour, "yyyy/MM/dd/HH"), name)


def write_sensor(rows: DataFrame, root: str, folder: str = "MasterSynced", digits: int = 9) -> int:
    """pid, sid, t_ms and value columns as the data set's hourly CSV files; the number of files. Derived sets: folder ``Derived/name``."""
    values = [F.col(c).alias(c.upper()) for c in rows.columns if c not in ("pid", "sid", "t_ms", "date", "hour", "file")]
    return write_files(rows.select(sensor_path(folder=folder).alias("path"), times.written(times.from_ms("t_ms")).alias("HEADER_TIME_STAMP"), *values), root, digits=digits)


def write_csv(rows: DataFrame, path: str, digits: int | None = 9) -> None:
    """One CSV file in order of its first column, doubles with so many places (None: as they are); for results that a person reads."""
    doubles = [f.name for f in rows.schema.fields if f.dataType.simpleString() == "double"]
    rows = rows if digits is None else rows.withColumns({c: F.format_string(f"%.{digits}f", c) for c in doubles})
    rows.orderBy(rows.columns[0]).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def copy_files(spark: SparkSession, source: str, target: str, glob: str = "*.csv") -> int:
    """The files' bytes in the same folders under another one; the number of files."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(source)
    root = source.rstrip("/").split("://")[-1].removeprefix("file:")

    def run(frames):
        for b in frames:
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                _stored(target, path.split(root, 1)[-1].lstrip("/"), data)
            yield pa.RecordBatch.from_arrays([b.column("path")], names=["path"])

    return raw.select("path", "content").mapInArrow(run, "path string").count()
