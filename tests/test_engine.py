"""Operators on small tables: hand-made values, borders, missing values, and the SQL twins on the smallest test tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from motusflow.functions import labels, paths, times, vectors
from motusflow.operators import calibration, features, lookups, models, signal, summaries, windows
from motusflow.plans import registry

SF = os.environ.get("MOTUSFLOW_TEST_SF", "/root/testdata/sf0.001")
POINTS = "pid string, sid string, t_ms long, x double, y double, z double"


def points(spark, times_, values=None):
    values = values or [(0.0, 0.0, 1.0)] * len(times_)
    return spark.createDataFrame([("P", "S", t, *map(float, v)) for t, v in zip(times_, values)], POINTS)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("end, step, starts", [(30000, 12800, [0, 12800]), (30000, 6400, [0, 6400, 12800]), (12799, 12800, []), (12800, 12800, [0])])
def test_spine(spark, end, step, starts):
    got = windows.spine(windows.bounds(points(spark, [0, end])), step=step)
    assert [r[0] for r in rows(got, "start_ms")] == starts


def test_empty_windows_stay_and_borders_are_half_open(spark):
    df = windows.windowed(points(spark, [0, 999, 1000, 3500]), [F.count("*").alias("n")], size=1000)
    assert rows(df.na.fill(0, ["n"]), "window", "n") == [(0, 2), (1, 1), (2, 0)]


def test_sliding_windows_hold_each_point_as_often_as_they_overlap(spark):
    p = points(spark, list(range(0, 5001, 250)))
    got = windows.assigned(p, windows.bounds(p), size=1000, step=500)
    want = sum(1 for t in range(0, 5001, 250) for i in range(9) if i * 500 <= t < i * 500 + 1000)
    assert got.count() == want


def test_activation_golden(spark):
    x = [0, 0.3, 0.4, 0, 0.5, 0, 0.3, 0.3, 0.3, 0, 0.9, 0.9]
    p = points(spark, list(range(12)), [(v, 0, 0) for v in x])
    r = features.activation(p, ["pid"], "x").first()
    assert (round(r[1], 6), round(r[2], 6), round(r[3], 7)) == (0.666667, 0.5, 0.0392837)
    r = features.activation(points(spark, [0, 1]), ["pid"], "x").first()
    assert tuple(r)[1:] == (0.0, None, 0.0)


def test_orientation_needs_a_sample_in_every_part(spark):
    four = features.orientation(points(spark, [0, 1, 2, 3]), ["pid"])
    assert all(r["median_x_angle"] is None for r in four.collect())
    eight = features.orientation(points(spark, range(8)), ["pid"]).first()
    assert round(eight["median_x_angle"], 6) == 1.570796 and eight["range_z_angle"] == 0


def test_enmo_golden_and_empty_bins(spark):
    p = points(spark, [1000, 2000, 17000], [(1.2, 0, 0), (0, 0.5, 0), (1, 1, 1)])
    assert round(p.agg(F.avg(vectors.enmo())).first()[0], 7) == 0.3106836
    assert [r["enmo"] is None for r in summaries.binned(p, 5, []).orderBy("bin_ms").collect()] == [False, True, True, False]
    assert [r["sr"] for r in summaries.binned(p, 5, [], "sr").orderBy("bin_ms").collect()] == [2, 0, 0, 1]
    assert summaries.binned(p, 5, ["pid"]).count() == 2


def test_sampling_rate_drops_ends_and_takes_the_smaller(spark):
    t = [s * 1000 + k for s, n in enumerate([7, 20, 20, 19, 0, 19, 5]) for k in range(n)]
    assert features.sampling_rate(points(spark, t), ["pid"]).first()["rate"] == 19


def test_gap_of_exactly_the_threshold_does_not_split(spark):
    got = signal.gap_segments(points(spark, [0, 1000, 2001]))
    assert rows(got, "t_ms", "segment") == [(0, 0), (1000, 0), (2001, 1)]


def test_linear_resampling(spark):
    p = points(spark, [0, 100, 100, 200, 5000, 5100], [(0, 0, 0), (1, 0, 0), (9, 0, 0), (2, 0, 0), (5, 0, 0), (6, 0, 0)])
    got = {r["t_ms"]: r["x"] for r in signal.resampled(p, 20.0).collect()}
    assert got[0] == 0 and all(v is None for t, v in got.items() if 200 < t < 5000) and 5100 not in got
    assert abs(got[50] - 0.505) < 0.001  # the second of 102 even points
    assert all(r["x"] is not None for r in signal.resampled(p, 20.0, fill=False).collect())


def test_time_filter_and_spline_leave_constants_alone(spark):
    p = points(spark, list(range(0, 2000, 50)), [(1, 2, 3)] * 40)
    for got in (signal.filtered_in_time(p, 20.0, [5.0]), signal.resampled_spline(p, 25.0)):
        assert all(abs(r["x"] - 1) < 1e-9 and abs(r["z"] - 3) < 1e-9 for r in got.collect())


def test_lookups(spark):
    mapping = spark.createDataFrame([("P", "S", "wrist", 2), ("P", "S", "ankle", 1)], "pid string, sid string, location string, order int")
    data = spark.createDataFrame([("P", "S"), ("P", "T")], "pid string, sid string")
    assert rows(lookups.location_of(data, mapping), "sid", "location") == [("S", "ankle"), ("T", "unknown")]
    p = points(spark, [0, 10, 20])
    given = spark.createDataFrame([("Q", 0, 5)], "pid string, start_ms long, stop_ms long")
    assert lookups.session_bounds(p, given).first()["session_start"] is None
    assert lookups.session_bounds(p, given, compat=False).first()["session_stop"] == 20
    assert lookups.clipped(p).count() == 2 and lookups.clipped(p, 5, 25).count() == 2
    moved = lookups.synced(p, spark.createDataFrame([("P", 1.5)], "pid string, offset_s double"))
    assert rows(moved, "t_ms") == [(1500,), (1510,), (1520,)]
    with pytest.raises(Exception, match="no offset"):
        lookups.synced(p, spark.createDataFrame([("Q", 1.5)], "pid string, offset_s double"), compat=True).collect()


def test_orientation_fix_needs_exactly_one_row(spark):
    p = points(spark, [0], [(1, 2, 3)])
    one = [("P", "S", "-Y", "X", "?")]
    schema = "pid string, sid string, x_code string, y_code string, z_code string"
    assert rows(lookups.orientation_fixed(p, spark.createDataFrame(one, schema)), "x", "y", "z") == [(-2.0, 1.0, 3.0)]
    assert rows(lookups.orientation_fixed(p, spark.createDataFrame(one * 2, schema)), "x", "y", "z") == [(1.0, 2.0, 3.0)]


def test_paths(spark):
    name = "STUDY_33/MasterSynced/2016/02/29/23/ActigraphGT9X-AccelerationCalibrated-NA.tas1E-AccelerationCalibrated.2016-02-29-23-00-00-000-M0500.sensor.csv"
    df = spark.createDataFrame([(name,)], "p string")
    p = F.col("p")
    got = df.select(paths.file_type(p), paths.file_date(p), paths.file_hour(p), paths.file_id(p), paths.sensor_type(p), paths.data_type(p), paths.participant(p), paths.valid_name(p), paths.valid_folder(p)).first()
    assert tuple(got) == ("sensor", "2016-02-29", "23", "TAS1E", "ActigraphGT9X", "AccelerationCalibrated", "STUDY_33", "True", "True")
    later = df.select(paths.adjacent(p, 1)).first()[0]
    assert "/2016/03/01/00/" in later and ".2016-03-01-00-00-00-000-" in later
    assert df.select(paths.output_path(p, "Feature", new_type="feature")).first()[0].startswith("STUDY_33/Derived/Feature/2016")


def test_times(spark):
    df = spark.createDataFrame([("2016-03-02 10:00:00.1234"[:23],), ("2016-03-02 10:00:00",), ("2016/03/02 10:00:00.500",), ("x",), (None,)], "s string")
    got = [r[0] for r in df.select(times.written(times.parsed(F.col("s")))).collect()]
    assert got == ["2016-03-02 10:00:00.123", "2016-03-02 10:00:00.000", "2016-03-02 10:00:00.500", None, None]


@pytest.mark.parametrize(
    "label, want",
    [
        ("sitting and writing", ("sitting", "sedentary", "sedentary", "indoor", "sitting and writing", "sedentary", "writing (dom)")),
        ("jumping jacks", ("upright", "others", "others", "indoor", "jumping jacks", "vigorous", "jumping jacks")),
        ("lying on the back", ("lying", "sedentary", "sleep", "indoor", "lying on the back", "sedentary", "still")),
        ("treadmill 3.5 mph", ("unknown", "ambulation", "ambulation", "indoor", "treadmill walking at 3-3.5 mph", "light", "free")),
        ("nothing", ("unknown",) * 7),
    ],
)
def test_label_rules(spark, label, want):
    df = spark.createDataFrame([(label,)], "label string")
    assert tuple(df.select(*labels.classes(F.col("label")).values()).first()) == want


def test_class_map_must_be_unique(spark):
    held = spark.createDataFrame([("a", "k"), ("a", "l")], "key string, kind string")
    df = spark.createDataFrame([(["a"],)], "_names array<string>")
    with pytest.raises(Exception, match="twice"):
        labels.mapped_classes(df, held, "key", ["kind"]).collect()


def test_still_chunks_differ(spark):
    values = [(0, 0, 1)] * 20 + [(0, 0.05, 1)] * 20 + [(1, 0, 0)] * 21
    p = points(spark, [i * 50 for i in range(61)], values)
    assert rows(calibration.still_chunks(p), "window", "count") == [(0, 0), (2, 1)]
    assert calibration.still_vectors(p).count() == 3


def test_models(spark):
    df = spark.createDataFrame([(float(i), 5.0, "a" if i < 10 else "b") for i in range(20)] + [(30.0, 5.0, "unknown")], "f double, c double, kind string")
    limits = models.ranges(df, ["f", "c"])
    got = models.scaled(df, limits)
    assert got.agg(F.min("f"), F.max("f"), F.max("c")).first()[0:3] == (-1.0, 1.0, -1.0)
    bundle = models.train(df, ["f", "c"], "TEST", "kind", cost=10.0, gamma=1.0, width=32, iterations=20)
    hit = bundle.predict(df.filter("kind <> 'unknown'"))
    assert hit.filter("kind = TEST_PREDICTION").count() >= 18
    assert models.metrics(hit, "kind", "TEST_PREDICTION").first()["accuracy"] >= 0.9
    with pytest.raises(Exception, match="differ"):
        a = spark.createDataFrame([("P", 0, 1)], "pid string, start_ms long, stop_ms long")
        models.aligned(a, a.limit(0)).collect()


def test_union_takes_the_widest(spark):
    a, z = spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2, 3)], "b int, a int")
    assert summaries.united(a, z).columns == ["b", "a"] and summaries.united(a, z).count() == 2


def test_replayed_stream_equals_batch(spark, tmp_path):
    from motusflow.streaming import summaries as streams

    p = points(spark, [0, 1000, 7000, 40000, 130000], [(2, 0, 0)] * 5)
    p.write.parquet(str(tmp_path / "in"))
    got = streams.binned(spark.readStream.schema(p.schema).parquet(str(tmp_path / "in")), 5, "10 seconds")
    q = got.writeStream.format("memory").queryName("bins").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = {(r["bin_ms"], r["sr"]) for r in summaries.binned(p, 5, ["pid", "sid"], "sr").collect()}
    stream = {(r["bin_ms"], r["sr"]) for r in spark.table("bins").collect()}
    assert stream <= batch and len(stream) >= 2


def test_csv_files(spark, tmp_path):
    from motusflow.sources import mhealth

    folder = tmp_path / "P1" / "MasterSynced" / "2016" / "03" / "02" / "10"
    folder.mkdir(parents=True)
    name = "Acti-Acc-NA.TAS1-Acc.2016-03-02-10-00-00-000-M0500.sensor.csv"
    (folder / name).write_text("HEADER_TIME_STAMP,X,Y,Z\n2016-03-02 10:00:00.000,1,2,3\nbad,1,2,3\n2016-03-02 10:00:00.050,x,2,3\n# note\n2016-03-02 10:00:00.100,4,5,6\n")
    got = mhealth.read_sensor(spark, str(tmp_path))
    assert rows(got, "pid", "sid", "hour", "x") == [("P1", "TAS1", "10", 1.0), ("P1", "TAS1", "10", 4.0)]
    mhealth.write_hourly(got.drop("file"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    summary = summaries.file_summary(mhealth.read_files(spark, str(tmp_path / "P1"))).first()
    assert (summary["validate_filename"], summary["validate_folder_structure"], summary["validate_csv_header"], summary["n_lines"]) == ("True", "True", "True", 6)


def _same(a, b, name):
    """Every value alike, doubles as they come, to the six places that the queries give."""
    cols = sorted(a.columns)
    assert cols == sorted(b.columns), name

    def norm(d):
        d = d[cols].astype(object).where(d.notna(), None)
        return sorted(repr([round(float(x), 6) if isinstance(x, float) else x if x is None or isinstance(x, (str, bool)) else str(x) for x in row]) for row in d.values.tolist())

    left, right = norm(a), norm(b)
    assert len(left) == len(right), name
    assert [(x, y) for x, y in zip(left, right, strict=True) if x != y][:3] == [], name


TWINS = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(TWINS):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in ("nation", "customer", "events", "embeddings", "pages"):
        con.sql(f"create view {t} as select * from '{TWINS}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql_twins(spark, duck, name):
    _same(registry.queries()[name](spark, TWINS).toPandas(), duck.sql(registry.oracle_sql()[name]).df(), name)


def test_filter_and_spline_by_hour_equal_those_of_the_whole_stretch(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    t = np.arange(3_600_000 - 100_000, 3_600_000 + 100_000, 50)
    v = rng.normal(size=(len(t), 3))
    p = points(spark, [int(k) for k in t], v.tolist())
    got = sorted(((r["t_ms"], r["x"]) for r in signal.filtered_in_time(p, 20.0, [5.0]).collect()))
    b, a = signal.butterworth(4, [5.0], 20.0)
    assert len(got) == len(t) and np.allclose([x for _, x in got], signal.zero_phase(b, a, v)[:, 0], atol=1e-9)
    got = sorted((r["t_ms"], r["y"]) for r in signal.resampled_spline(p, 33.0).collect())
    n = int(np.ceil((t[-1] - t[0]) / 1000 * 33.0))
    at = np.linspace(t[0], t[-1], n)[:-1]
    assert [k for k, _ in got] == np.floor(at).astype(int).tolist()
    assert np.allclose([y for _, y in got], signal.spline(t.astype(float), v[:, 1], at), atol=1e-6)


def test_segments_and_resampling_over_hours(spark):
    hour = 3_600_000
    t = [hour - 500, hour - 100, hour + 400, hour + 2000, 3 * hour, 3 * hour + 100]
    p = points(spark, t, [(k, 0, 0) for k in range(6)])
    assert rows(signal.gap_segments(p), "t_ms", "segment") == list(zip(t, [0, 0, 0, 1, 2, 2]))
    got = {r["t_ms"]: r["x"] for r in signal.resampled(p, 10.0).collect()}
    whole = [(k, x) for k, x in got.items() if x is not None]
    assert all(hour - 500 <= k < hour + 400 or 3 * hour <= k < 3 * hour + 100 or k == hour + 2000 for k, _ in whole) and len(whole) >= 9
    assert any(hour < k < hour + 400 for k, _ in whole)  # between samples of two hours
    same = signal.resampled_by_hour(p, None)
    assert same.count() == 6
    by_hour = {r["t_ms"] for r in signal.resampled_by_hour(p, 10.0, fill=False).collect()}
    assert min(by_hour) >= hour - 500 and max(by_hour) < 3 * hour + 100 and any(hour <= k < hour + 400 for k in by_hour)
    with pytest.raises(ValueError, match="hour"):
        signal.resampled(p, 10.0, gap_ms=hour)


def test_clashing_names_stay(spark):
    p = points(spark, [0, 100, 5000])
    for c in ("k", "hour", "start", "stop", "far", "before", "low", "high", "_k", "_hour", "session_start", "session_stop", "n", "segment_"):
        p = p.withColumn(c, F.lit(c))
    given = spark.createDataFrame([("P", 0, 200)], "pid string, start_ms long, stop_ms long")
    for got in (lookups.clipped_to_sessions(p, given), lookups.masked(p, given, ["pid"]), lookups.first_of(p, ["pid"], ["t_ms"]), signal.gap_segments(p).drop("segment"), windows.assigned(p, windows.bounds(points(spark, [0, 5000])), size=1000).drop("window")):
        assert got.columns == p.columns and all(r["hour"] == "hour" and r["low"] == "low" and r["k"] == "k" and r["session_start"] == "session_start" for r in got.collect())


def test_files_are_written_read_and_copied(spark, tmp_path):
    from motusflow.sources import mhealth

    hour = 3_600_000
    p = points(spark, [hour - 50, hour, hour + 50], [(1, 2, 3), (0.1234567894, 5, 6), (7, 8, 9)])
    assert mhealth.write_sensor(p, str(tmp_path / "a")) == 2
    names = sorted(str(f.relative_to(tmp_path / "a")) for f in (tmp_path / "a").rglob("*.csv"))
    assert names == [f"P/MasterSynced/1970/01/01/0{h}/Sensor-AccelerationCalibrated-NA.S-AccelerationCalibrated.1970-01-01-0{h}-00-00-000-P0000.sensor.csv" for h in (0, 1)]
    assert (tmp_path / "a" / names[1]).read_text().splitlines() == ["HEADER_TIME_STAMP,X,Y,Z", "1970-01-01 01:00:00.000,0.123456789,5.000000000,6.000000000", "1970-01-01 01:00:00.050,7.000000000,8.000000000,9.000000000"]
    assert rows(mhealth.read_sensor(spark, str(tmp_path / "a")), "pid", "sid", "t_ms", "y") == [("P", "S", hour - 50, 2.0), ("P", "S", hour, 5.0), ("P", "S", hour + 50, 8.0)]
    (tmp_path / "a" / "raw.csv").write_bytes(b"\xff\x00\r\n")
    assert mhealth.copy_files(spark, str(tmp_path / "a"), str(tmp_path / "b")) == 3
    assert (tmp_path / "b" / "raw.csv").read_bytes() == b"\xff\x00\r\n" and (tmp_path / "b" / names[0]).read_bytes() == (tmp_path / "a" / names[0]).read_bytes()
    mhealth.write_sensor(p, str(tmp_path / "c"), "Derived/Resampled", 3)
    assert len(list((tmp_path / "c" / "P" / "Derived" / "Resampled").rglob("*.csv"))) == 2


def test_shuffles_charts_and_the_clock(spark):
    df = spark.range(50)
    a, z = ([r[0] for r in models.shuffled(df, seed).collect()] for seed in (1, 1))
    assert a == z != [r[0] for r in models.shuffled(df, 2).collect()] and sorted(a) == list(range(50))
    p = spark.createDataFrame([("P", "S"), ("P", "T")], "pid string, sid string")
    where = spark.createDataFrame([("P", "S", "wrist")], "pid string, sid string, location string")
    assert rows(summaries.chart_frame(p, where), "sid", "sid_location") == [("S", "S_wrist"), ("T", "T")]
    assert len(spark.range(1).select(times.now_text()).first()[0]) == 14


def test_balanced_classes_and_the_search(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    data = [(k, float(x), "a" if k % 10 else "b") for k, x in enumerate(rng.normal(size=120) + np.where(np.arange(120) % 10, 0, 1.2))]
    df = spark.createDataFrame(data, "k long, f double, kind string").repartition(2)
    found = [models.train(df, ["f"], "T", "kind", cost=1.0, gamma=0.5, width=16, iterations=15, balanced=b).predict(df).filter("T_PREDICTION = 'b'").count() for b in (False, True)]
    assert found[1] > found[0]
    cost, gamma, balanced = models.searched(df, ["f"], "kind", ["k"], tries=2, folds=2, width=8, iterations=3)
    assert cost > 0 and gamma > 0 and balanced in (True, False)


def test_all_spectral_peaks_of_a_window(spark):
    import numpy as np

    n = np.arange(200)
    x = np.sin(2 * np.pi * n * 50 / 1000) + 0.5 * np.sin(2 * np.pi * n * 250 / 1000) + 0.2 * np.sin(2 * np.pi * n * 400 / 1000)
    p = points(spark, [int(t) * 50 for t in n], [(v, 0, 0) for v in x]).withColumn("rate", F.lit(20))
    freq, power = features.spectrum(x, 20.0)
    at = features.detect_peaks(power)
    at = at[np.argsort(-power[at], kind="stable")]
    got = sorted(features.spectral_peaks(p, ["pid", "sid"], "x").collect(), key=lambda r: r["rank"])
    assert len(got) == len(at) > 2 and [r["rank"] for r in got] == list(range(1, len(at) + 1))
    assert np.allclose([r["freq"] for r in got], freq[at]) and np.allclose([r["power"] for r in got], power[at])
    top = features.spectral(p, ["pid", "sid"], "x", top=3).first()
    assert np.allclose([top["dom_freq_x"], top["dom_freq_2_x"], top["dom_freq_3_x"]], freq[at[:3]])
    if os.path.isdir(SF):
        assert registry.queries()["spectral_peaks_all"](spark, SF).filter("rank > 1").count() > 0


def test_calib_fit_of_24_points():
    import numpy as np

    i = np.arange(24)
    a, c = np.sin(i * 1.3), np.cos(i * 0.7) * 1.5
    p = np.stack([np.cos(a) * np.cos(c), np.cos(a) * np.sin(c), np.sin(a)], 1)
    m, b = calibration.fitted(p @ np.array([[1.1, 0.02, 0], [0.02, 0.95, 0], [0, 0, 1.05]]) + [0.05, -0.03, 0.02])
    assert np.allclose(b, [0.05, -0.03, 0.02], atol=1e-6) and np.allclose(m @ [[1.1, 0.02, 0], [0.02, 0.95, 0], [0, 0, 1.05]], np.eye(3), atol=1e-6)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_calib_fit_over_all_sensors(spark):
    from motusflow.sources import views

    sf = "/root/testdata/sf0.01"
    got = registry.queries()["calib_fit"](spark, sf).toPandas()
    assert set(got.pid) == {r[0] for r in views.dense(spark, sf).select("pid").distinct().collect()}
    assert (got[["b0", "b1", "b2"]] - [0.05, -0.03, 0.02]).abs().to_numpy().max() < 1e-4


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_svm_predicts_every_vector(spark):
    from motusflow.sources import views

    got = registry.queries()["svm_predict"](spark, SF).toPandas()
    assert len(got) == views.table(spark, SF, "embeddings").count() and got.MDCAS_PREDICTION.notna().all()


def test_entry_works_without_the_llm_folder(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache", ".hypothesis"))
    code = "import __spark_entry__ as e; n = e.queries(); o = e.oracle_sql(); assert 'tumbling_stats' in n and not any(x.startswith('op') and x[2].isdigit() or x == 'pipeline' for x in n) and set(o) < set(n); import bench, motusflow.cli"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True, text=True, timeout=120, env=os.environ | {"PYTHONPATH": str(tmp_path / "r")})
    assert done.returncode == 0, done.stderr
    # a fault within the subpackage isn't taken for its absence
    (tmp_path / "r" / "motusflow" / "llm").mkdir()
    (tmp_path / "r" / "motusflow" / "llm" / "__init__.py").write_text("")
    (tmp_path / "r" / "motusflow" / "llm" / "queries.py").write_text("import no_such_module")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path / "r", capture_output=True, text=True, timeout=120, env=os.environ | {"PYTHONPATH": str(tmp_path / "r")})
    assert done.returncode and "no_such_module" in done.stderr


def test_single_steps(spark, tmp_path):
    from motusflow import cli
    from motusflow.sources import mhealth

    p = points(spark, list(range(0, 20_000, 50)), [(0.1, 0.2, 1 + k % 7 / 10) for k in range(400)])
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    mhealth.write_sensor(p, root)
    (tmp_path / "sessions.csv").write_text("pid,start_ms,stop_ms\nP,1000,2000\n")
    (tmp_path / "offsets.csv").write_text("pid,offset_s\nP,2.5\n")
    (tmp_path / "fixes.csv").write_text("pid,sid,x_code,y_code,z_code\nP,S,Y,X,-Z\n")
    for argv, n, check in (
        (["clip", "--sessions", str(tmp_path / "sessions.csv")], 20, None),
        (["sync", "--offsets", str(tmp_path / "offsets.csv")], 400, lambda r: r["t_ms"] == 2500),
        (["offset", "--seconds", "-1"], 400, lambda r: r["t_ms"] == -1000),
        (["resample"], 400, None),
        (["resample", "--rate", "10"], 200, None),
        (["filter", "--high-cutoff", "5"], 400, None),
        (["filter", "--btype", "highpass", "--low-cutoff", "2", "--in-time"], 400, None),
        (["filter", "--btype", "highpass"], 400, lambda r: r["x"] == 0.1),
        (["orient", "--fixes", str(tmp_path / "fixes.csv")], 400, lambda r: (r["x"], r["y"], r["z"]) == (0.2, 0.1, -1.0)),
        (["calibrate"], 400, lambda r: r["x"] == 0.1),
        (["vm"], 400, lambda r: abs(r["vm"] - 1.05**0.5) < 1e-9),
        (["preprocess", "--calibrate", "--sessions", str(tmp_path / "sessions.csv")], 20, None),
    ):
        got = cli.main([argv[0], root, *argv[1:], "--out", f"{out}-{argv[0]}", "--set", "Made", "--digits", "3"], spark)
        first = got.orderBy("t_ms").first()
        assert abs(got.count() - n) <= 2 and (check is None or check(first)), argv
        assert list((tmp_path / f"out-{argv[0]}" / "P" / "Derived" / "Made").rglob("*.sensor.csv"))
    cli.main(["copy", root, "--out", out], spark)
    assert len(list((tmp_path / "out").rglob("*.csv"))) == 1


def test_hours_cut_windows(spark):
    from motusflow.plans.features import feature_set

    t = list(range(3_590_000, 3_620_000, 50))
    p = points(spark, t, [(1, 0, i % 7 / 10) for i in range(len(t))])
    rate = features.sampling_rate(p, ["pid", "sid"])
    whole = {r["window"]: r["mean_vm"] for r in feature_set(p, rate, 80.0).collect()}
    cut = {r["window"]: r["mean_vm"] for r in feature_set(p, rate, 80.0, hour_truncation=True).collect()}
    assert len(whole) == len(cut) == 2 and whole[0] != cut[0] and whole[1] == cut[1]
    anew = feature_set(p, rate, 80.0, anchor="hour")
    assert [(r["hour_ms"], r["start_ms"]) for r in anew.collect()] == [(3_600_000, 3_600_000)]


def test_command_line(spark, tmp_path):
    from motusflow import cli

    folder = tmp_path / "P1" / "MasterSynced" / "2016" / "03" / "02" / "10"
    folder.mkdir(parents=True)
    lines = "".join(f"2016-03-02 10:00:{s:02d}.{ms:03d},0.1,0.2,{1 + ms / 1000}\n" for s in range(30) for ms in range(0, 1000, 50))
    (folder / "Acti-Acc-NA.TAS1-Acc.2016-03-02-10-00-00-000-M0500.sensor.csv").write_text("HEADER_TIME_STAMP,X,Y,Z\n" + lines)
    (folder / "Acti-Act-NA.ANN1-Act.2016-03-02-10-00-00-000-M0500.annotation.csv").write_text("HEADER_TIME_STAMP,START_TIME,STOP_TIME,LABEL_NAME\n2016-03-02 10:00:00.000,2016-03-02 10:00:00.000,2016-03-02 10:00:30.000,Walking\n")
    root = str(tmp_path / "P1")
    assert cli.main(["sampling-rate", root, "--out", str(tmp_path / "r")], spark).first()["rate"] == 20
    assert cli.main(["features", root, "--high-cutoff", "5", "--out", str(tmp_path / "f")], spark).count() == 2
    assert {r["activity"] for r in cli.main(["classes", root, "--out", str(tmp_path / "c")], spark).collect()} == {"self-paced walking"}
    assert cli.main(["summary", root, "--out", str(tmp_path / "s")], spark).count() == 2
    assert cli.main(["describe", root, "--method", "annotation", "--out", str(tmp_path / "d")], spark).first()["duration_in_seconds"] == 30
