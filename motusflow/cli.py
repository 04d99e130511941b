"""Command line: python -m motusflow.cli COMMAND ROOT [--out FOLDER] ...

summary, participants: what a data set holds. describe: mean norm or rate of bins, or seconds a label. sampling-rate. locations:
sensors and their places from raw files. Single steps on sensor files: clip, sync, offset, resample, filter, orient, calibrate, vm;
preprocess is calibrate (with --calibrate), sync and clip. features, classes: derived sets. train, search, cv, test: classifiers. copy:
the files themselves. With --set NAME a step's rows become hourly CSV files below OUT/<participant>/Derived/NAME, else Parquet.
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import labels
from .functions.vectors import magnitude
from .operators import calibration, features, lookups, models, signal, summaries, windows
from .plans import features as plans
from .session import importable, local_session
from .sources import mhealth

log = logging.getLogger("motusflow")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="motusflow", description=__doc__)
    out.add_argument("command", choices=sorted(COMMANDS))
    out.add_argument("root")
    out.add_argument("--out")
    out.add_argument("--pid", help="one participant only")
    out.add_argument("--method", default="enmo", choices=("enmo", "sr", "annotation"))
    out.add_argument("--window", type=int, default=5, help="seconds of a bin")
    out.add_argument("--ws", type=int, default=windows.SIZE_MS, help="milliseconds of a window")
    out.add_argument("--ss", type=int, help="milliseconds between windows")
    out.add_argument("--threshold", type=float, default=features.THRESHOLD)
    out.add_argument("--high-cutoff", type=float, default=20.0)
    out.add_argument("--low-cutoff", type=float)
    out.add_argument("--btype", default="lowpass", choices=("lowpass", "highpass", "bandpass"))
    out.add_argument("--order", type=int, default=4)
    out.add_argument("--in-time", action="store_true", help="filter along time, not across axes")
    out.add_argument("--rate", type=float, help="samples a second; without it resample leaves rows as they are")
    out.add_argument("--seconds", type=float, default=0.0, help="offset")
    out.add_argument("--calibrate", action="store_true")
    out.add_argument("--balanced", action="store_true")
    out.add_argument("--set", help="name of a derived set")
    out.add_argument("--digits", type=int, default=9)
    out.add_argument("--csv", action="store_true", help="one CSV file")
    out.add_argument("--sessions")
    out.add_argument("--offsets")
    out.add_argument("--locations")
    out.add_argument("--fixes")
    out.add_argument("--class-set")
    out.add_argument("--model")
    out.add_argument("--name", default="MDCAS", choices=sorted(models.CATALOGUE))
    out.add_argument("--location-pattern", default=r"_([a-z]+)")
    out.add_argument("--pid-pattern", default=r"([A-Za-z]+_[0-9]+)")
    return out


def _table(spark: SparkSession, path: str | None) -> DataFrame | None:
    return None if path is None else spark.read.option("header", True).option("inferSchema", False).csv(path)


def _sensor(spark, a) -> DataFrame:
    rows = mhealth.read_sensor(spark, a.root)
    return rows.filter(F.col("pid") == a.pid) if a.pid else rows


def _sessions(spark, a) -> DataFrame | None:
    rows = _table(spark, a.sessions)
    return None if rows is None else rows.select("pid", F.col("start_ms").cast("long").alias("start_ms"), F.col("stop_ms").cast("long").alias("stop_ms"))


def summary(spark, a) -> DataFrame:
    return summaries.file_summary(mhealth.read_files(spark, a.root))


def participants(spark, a) -> DataFrame:
    return summaries.listed(mhealth.read_files(spark, a.root))


def describe(spark, a) -> DataFrame:
    if a.method == "annotation":
        return summaries.annotation_duration(mhealth.read_annotations(spark, a.root))
    return summaries.binned(_sensor(spark, a), a.window, ["pid", "sid"], a.method)


def sampling_rate(spark, a) -> DataFrame:
    return features.sampling_rate(_sensor(spark, a), ["pid", "sid"])


def locations(spark, a) -> DataFrame:
    return mhealth.locations(mhealth.read_files(spark, a.root, "*RAW.csv"), a.location_pattern, a.pid_pattern)


def _offsets(spark, a) -> DataFrame | None:
    rows = _table(spark, a.offsets)
    return None if rows is None else rows.select("pid", F.col("offset_s").cast("double").alias("offset_s"))


def _usual_rate(rows: DataFrame) -> float:
    """The most frequent rate of the sensors."""
    rate = features.sampling_rate(rows, ["pid", "sid"])
    return float(rate.groupBy("rate").count().orderBy(F.desc("count"), "rate").first()["rate"])


def clip(spark, a) -> DataFrame:
    sessions = _sessions(spark, a)
    rows = _sensor(spark, a)
    return lookups.clipped(rows) if sessions is None else lookups.clipped_to_sessions(rows, sessions)


def sync(spark, a) -> DataFrame:
    rows, offsets = _sensor(spark, a), _offsets(spark, a)
    return rows if offsets is None else lookups.synced(rows, offsets)


def offset(spark, a) -> DataFrame:
    return _sensor(spark, a).withColumn("t_ms", F.col("t_ms") + round(a.seconds * 1000))


def resample(spark, a) -> DataFrame:
    return signal.resampled_by_hour(_sensor(spark, a), a.rate)


def filter_(spark, a) -> DataFrame:
    rows = _sensor(spark, a)
    cutoffs = {"lowpass": [a.high_cutoff], "highpass": [a.low_cutoff], "bandpass": [a.low_cutoff, a.high_cutoff]}[a.btype]
    if None in cutoffs:
        return rows
    step = signal.filtered_in_time if a.in_time else signal.filtered
    return step(rows, a.rate or _usual_rate(rows), cutoffs, a.order, a.btype)


def orient(spark, a) -> DataFrame:
    rows, fixes = _sensor(spark, a), _table(spark, a.fixes)
    return rows if fixes is None else lookups.orientation_fixed(rows, fixes)


def _calibration(rows: DataFrame) -> DataFrame:
    return calibration.calibration(calibration.still_chunks(rows))


def calibrate(spark, a) -> DataFrame:
    rows = _sensor(spark, a)
    return calibration.calibrated(rows, _calibration(rows))


def vm(spark, a) -> DataFrame:
    return _sensor(spark, a).select("pid", "sid", "t_ms", magnitude().alias("vm"))


def preprocess(spark, a) -> DataFrame:
    rows = _sensor(spark, a)
    return plans.preprocessed(rows, _calibration(rows) if a.calibrate else None, _offsets(spark, a), _sessions(spark, a))


def copy(spark, a) -> None:
    log.info("%d files", mhealth.copy_files(spark, a.root, a.out))


def feature_set(spark, a) -> DataFrame:
    rows = _sensor(spark, a)
    return plans.feature_set(rows, features.sampling_rate(rows, ["pid", "sid"]), _usual_rate(rows), _table(spark, a.fixes), _table(spark, a.locations), a.high_cutoff, size=a.ws, step=a.ss)


def classes(spark, a) -> DataFrame:
    marks = mhealth.read_annotations(spark, a.root)
    own = marks.groupBy("pid").agg(F.min("start_ms").alias("session_start"), F.max("stop_ms").alias("session_stop"))
    given = _sessions(spark, a)
    session = own if given is None else given.groupBy("pid").agg(F.min("start_ms").alias("session_start"), F.max("stop_ms").alias("session_stop"))
    held = windows.overlapping(marks, session, ["pid"], a.ws, a.ss)
    return labels.assigned_classes(labels.window_labels(windows.spine(session, ["pid"], a.ws, a.ss), held, ["pid", "window"], a.ws)).drop("_names")


def _set(spark, path: str) -> DataFrame:
    """A feature or class set: Parquet, or CSV files by their names."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)


def _training(spark, a) -> tuple[DataFrame, list[str], str]:
    rows, marks = _set(spark, a.root), _set(spark, a.class_set)
    label = models.CATALOGUE[a.name][0]
    columns = [f.name for f in rows.schema.fields if f.dataType.simpleString() == "double"]
    return models.aligned(rows, marks.select("pid", "start_ms", "stop_ms", label)), columns, label


def train(spark, a) -> None:
    rows, columns, label = _training(spark, a)
    models.train(models.shuffled(rows), columns, a.name, label, balanced=a.balanced).save(spark, a.model)


def search(spark, a) -> None:
    rows, columns, label = _training(spark, a)
    cost, gamma, balanced = models.searched(models.train_rows(rows, label), columns, label, ["pid", "start_ms"])
    models.train(rows, columns, a.name, label, cost, gamma, balanced=balanced).save(spark, a.model)


def cv(spark, a) -> DataFrame:
    rows, columns, label = _training(spark, a)
    return models.cross_validated(models.train_rows(rows, label), columns, label, ["pid", "start_ms"])


def test(spark, a) -> DataFrame:
    return models.Bundle.load(spark, a.model).predict(_set(spark, a.root))


STEPS = {"clip": clip, "sync": sync, "offset": offset, "resample": resample, "filter": filter_, "orient": orient, "calibrate": calibrate, "vm": vm, "preprocess": preprocess}
COMMANDS = STEPS | {
    "summary": summary,
    "participants": participants,
    "describe": describe,
    "sampling-rate": sampling_rate,
    "locations": locations,
    "features": feature_set,
    "classes": classes,
    "train": train,
    "search": search,
    "cv": cv,
    "test": test,
    "copy": copy,
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame | None:
    a = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(levelname)s,%(asctime)s,%(message)s")
    spark = importable(spark or local_session())
    got = COMMANDS[a.command](spark, a)
    log.info("%s of %s", a.command, a.root)
    if got is not None:
        if a.out and a.set and a.command in STEPS:
            mhealth.write_sensor(got.drop("k"), a.out, f"Derived/{a.set}", a.digits)
        elif a.out and a.csv:
            mhealth.write_csv(got, a.out, None)
        elif a.out:
            got.write.mode("overwrite").parquet(a.out)
        else:
            got.show(50, truncate=False)
    return got


if __name__ == "__main__":
    main()
