"""Every registered query of the engine, by name, with its SQL twin (DuckDB) where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels, paths, times, vectors
from ..operators import calibration, features, lookups, models, signal, summaries, windows
from ..session import importable, scratch
from ..sources import mhealth, views
from ..sources.views import ANNOTATIONS_SQL, DENSE_SQL, SENSOR_SQL
from . import features as plans

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
KEYS = ["pid", "sid"]
BY = [*KEYS, "window"]
RATE = 80.0


def _query(sql: str | None = None):
    def held(fn: Query) -> Query:
        _QUERIES[fn.__name__] = lambda spark, sf_dir: fn(importable(spark), sf_dir)
        if sql is not None:
            _SQL[fn.__name__] = sql.strip()
        return fn

    return held


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to six places, with no negative zero; NaN as null."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.select(*((F.round(F.nanvl(F.col(c), F.lit(None).cast("double")), digits) + 0.0).alias(c) if k == "double" else F.col(c) for c, k in kinds.items()))


def rounded_alike(df: DataFrame) -> DataFrame:
    """Doubles to six places by arithmetic on the double alone, which every engine does alike."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.select(*((F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c) if k == "double" else F.col(c) for c, k in kinds.items()))


# ---------------------------------------------------------------- the views' dimension tables


def _sessions(spark, sf):
    """Sessions of the dense stream: every participant but each third one."""
    rows = views.dense(spark, sf).groupBy("pid").agg((F.min("t_ms") + 5000).alias("start_ms"), (F.max("t_ms") - 5000).alias("stop_ms"))
    return rows.filter("cast(substring(pid, 2) as long) % 3 <> 2")


SESSIONS_SQL = """ses AS (SELECT pid, min(t_ms) + 5000 AS start_ms, max(t_ms) - 5000 AS stop_ms FROM dense GROUP BY pid HAVING CAST(substr(pid, 2) AS BIGINT) % 3 <> 2)"""


def _locations(spark, sf):
    c = views.table(spark, sf, "customer")
    return c.select(F.concat(F.lit("P"), (F.col("c_custkey") % 7).cast("string")).alias("pid"), F.element_at(F.array(*(F.lit(x) for x in ("click", "error", "purchase", "signup", "view"))), (F.col("c_custkey") % 5 + 1).cast("int")).alias("sid"), F.col("c_mktsegment").alias("location"), F.col("c_custkey").alias("order"))


LOCATIONS_SQL = """loc AS (SELECT 'P' || CAST(c_custkey % 7 AS VARCHAR) AS pid, ['click', 'error', 'purchase', 'signup', 'view'][c_custkey % 5 + 1] AS sid, c_mktsegment AS location, c_custkey AS ord FROM customer)"""


def _offsets(spark, sf):
    n = views.table(spark, sf, "nation")
    return n.select(F.concat(F.lit("P"), F.col("n_nationkey").cast("string")).alias("pid"), (F.col("n_nationkey") * 1.5 - 3).cast("double").alias("offset_s"))


OFFSETS_SQL = """off AS (SELECT 'P' || CAST(n_nationkey AS VARCHAR) AS pid, CAST(n_nationkey * 1.5 - 3 AS DOUBLE) AS offset_s FROM nation)"""


def _fixes(spark, sf):
    """One row for each participant but the fifth, which has two (so none is applied)."""
    n = views.table(spark, sf, "nation")
    code = lambda k: F.element_at(F.array(*(F.lit(c) for c in vectors.CODES)), ((F.col("n_nationkey") + k) % 6 + 1).cast("int"))
    rows = n.select(F.concat(F.lit("P"), (F.when(F.col("n_nationkey") == 5, 4).otherwise(F.col("n_nationkey"))).cast("string")).alias("pid"), F.lit("S1").alias("sid"), code(1).alias("x_code"), code(2).alias("y_code"), code(5).alias("z_code"))
    return rows


FIXES_SQL = """fix AS (SELECT pid, count(*) AS n, any_value(x_code) AS x_code, any_value(y_code) AS y_code, any_value(z_code) AS z_code FROM (
  SELECT 'P' || CAST(CASE WHEN n_nationkey = 5 THEN 4 ELSE n_nationkey END AS VARCHAR) AS pid, ['X', '-X', 'Y', '-Y', 'Z', '-Z'][(n_nationkey + 1) % 6 + 1] AS x_code,
    ['X', '-X', 'Y', '-Y', 'Z', '-Z'][(n_nationkey + 2) % 6 + 1] AS y_code, ['X', '-X', 'Y', '-Y', 'Z', '-Z'][(n_nationkey + 5) % 6 + 1] AS z_code FROM nation) GROUP BY pid HAVING count(*) = 1)"""
_TURN = lambda c, a: f"CASE {c} WHEN 'X' THEN x WHEN '-X' THEN -x WHEN 'Y' THEN y WHEN '-Y' THEN -y WHEN 'Z' THEN z WHEN '-Z' THEN -z ELSE {a} END"

FILE_SQL = """files AS (SELECT page_id, 'STUDY_' || CAST(page_id % 9 AS VARCHAR) || CASE WHEN page_id % 3 = 0 THEN '/Derived/set' || CAST(page_id % 2 AS VARCHAR) ELSE '/MasterSynced' END
  || strftime(TIMESTAMP '2016-03-02 22:00:00' + to_hours(CAST(page_id AS BIGINT)), '/%Y/%m/%d/%H/') || CASE WHEN page_id % 5 = 0 THEN 'Actigraph' ELSE 'ActigraphGT9X-AccelerationCalibrated-NA' END || '.tas' || CAST(page_id % 4 AS VARCHAR) || '-AccelerationCalibrated.'
  || strftime(TIMESTAMP '2016-03-02 22:00:00' + to_hours(CAST(page_id AS BIGINT)), '%Y-%m-%d-%H-00-00-000') || '-M0500.' || CASE page_id % 4 WHEN 0 THEN 'annotation' ELSE 'sensor' END || '.csv' AS file FROM pages)"""


def _files(spark, sf):
    """File paths of the data set's grammar, one for each page."""
    p = views.table(spark, sf, "pages").select("page_id")
    i = F.col("page_id")
    ts = F.lit("2016-03-02 22:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=i.cast("int"))
    kind = F.when(i % 3 == 0, F.concat(F.lit("/Derived/set"), (i % 2).cast("string"))).otherwise("/MasterSynced")
    name = F.when(i % 5 == 0, "Actigraph").otherwise("ActigraphGT9X-AccelerationCalibrated-NA")
    return p.select("page_id", F.concat(F.lit("STUDY_"), (i % 9).cast("string"), kind, F.date_format(ts, "/yyyy/MM/dd/HH/"), name, F.lit(".tas"), (i % 4).cast("string"), F.lit("-AccelerationCalibrated."), F.date_format(ts, "yyyy-MM-dd-HH-'00-00-000'"), F.lit("-M0500."), F.when(i % 4 == 0, "annotation").otherwise("sensor"), F.lit(".csv")).alias("file"))


# ---------------------------------------------------------------- scans, paths, times


@_query(f"""
WITH {SENSOR_SQL} SELECT event_id, pid, sid, t_ms, value AS x, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value * 2 END AS y FROM sensor WHERE event_id % 11 <> 0""")
def scan_sensor_clean(spark, sf):
    """Text is coerced and rows with a missing value go."""
    rows = views.sensor(spark, sf)
    text = F.when(F.col("event_id") % 11 == 0, "n/a").otherwise((F.col("value") * 2).cast("string"))
    rows = rows.select("event_id", "pid", "sid", "t_ms", F.col("value").alias("x"), text.alias("_y"))
    return rows.select("event_id", "pid", "sid", "t_ms", "x", F.expr("try_cast(_y as double)").alias("y")).na.drop("any")


@_query(f"WITH {DENSE_SQL} SELECT pid, sid, strftime(make_timestamp(t_ms * 1000), '%Y-%m-%d') AS date, strftime(make_timestamp(t_ms * 1000), '%H') AS hour, t_ms, round(x, 6) + 0.0e0 AS x, round(y, 6) + 0.0e0 AS y, round(z, 6) + 0.0e0 AS z FROM dense")
def sensor_files(spark, sf):
    """The dense stream written as hourly CSV files under their proper names and read again."""
    root = scratch(spark, "sensor-files")
    mhealth.write_sensor(views.dense(spark, sf).drop("event_id"), root)
    return rounded(mhealth.read_sensor(spark, root).select("pid", "sid", "date", "hour", "t_ms", "x", "y", "z"))


@_query("""SELECT page_id, regexp_extract(url, '://([^/]+)/', 1) AS pid, regexp_extract(html, '<title>([^<]*)</title>', 1) AS serial, regexp_extract(url, '([^/]*)$', 1) AS location FROM pages""")
def regex_location_map(spark, sf):
    p = views.table(spark, sf, "pages")
    return p.select("page_id", F.regexp_extract("url", "://([^/]+)/", 1).alias("pid"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("serial"), F.regexp_extract("url", "([^/]*)$", 1).alias("location"))


@_query(f"""
WITH {FILE_SQL}, b AS (SELECT page_id, file, string_split(file, '/')[-1] AS name FROM files), s AS (SELECT *, string_split(name, '.') AS t FROM b)
SELECT page_id, lower(t[-2]) AS file_type, regexp_extract(t[3], '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AS file_date, regexp_extract(t[3], '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}-([0-9]{{2}})', 1) AS file_hour,
  upper(string_split(t[2], '-')[1]) AS file_id, string_split(t[1], '-')[1] AS sensor_type, coalesce(string_split(t[1], '-')[2], '') AS data_type,
  string_split(file, '/')[1] AS pid, CASE WHEN file LIKE '%Derived/%' THEN regexp_extract(file, 'Derived/([^/]+)', 1) END AS derived_set FROM s""")
def path_parse(spark, sf):
    p = F.col("file")
    return _files(spark, sf).select("page_id", paths.file_type(p).alias("file_type"), paths.file_date(p).alias("file_date"), paths.file_hour(p).alias("file_hour"), paths.file_id(p).alias("file_id"), paths.sensor_type(p).alias("sensor_type"), paths.data_type(p).alias("data_type"), paths.participant(p).alias("pid"), paths.derived_set(p).alias("derived_set"))


@_query(f"""
WITH {FILE_SQL}, n AS (SELECT page_id + 1 AS page_id, file FROM files)
SELECT f.page_id, strftime(TIMESTAMP '2016-03-02 22:00:00' + to_hours(CAST(f.page_id + 1 AS BIGINT)), '%Y/%m/%d/%H') AS next_folder, strftime(TIMESTAMP '2016-03-02 22:00:00' + to_hours(CAST(f.page_id - 1 AS BIGINT)), '%Y-%m-%d-%H-00-00-000') AS prev_stamp FROM files f""")
def adjacent_hour(spark, sf):
    later, earlier = paths.adjacent(F.col("file"), 1), paths.adjacent(F.col("file"), -1)
    return _files(spark, sf).select("page_id", F.regexp_extract(later, "[0-9]{4}/[0-9]{2}/[0-9]{2}/[0-9]{2}", 0).alias("next_folder"), F.regexp_extract(earlier, r"[0-9]{4}(-[0-9]{2}){5}-[0-9]{3}", 0).alias("prev_stamp"))


@_query("""
SELECT event_id, CASE event_id % 3 WHEN 2 THEN -1 WHEN 1 THEN epoch_us(date_trunc('second', ts)) // 1000 ELSE (epoch_us(ts) // 1000) END AS t_ms,
  CASE event_id % 3 WHEN 2 THEN NULL WHEN 1 THEN strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S.%g') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%g') END AS text FROM events""")
def parse_ts(spark, sf):
    e = views.table(spark, sf, "events").select("event_id", "ts")
    given = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("yesterday")
    e = e.select("event_id", times.parsed(given).alias("_ts"))
    return e.select("event_id", F.coalesce(times.to_ms("_ts"), F.lit(-1)).alias("t_ms"), times.written(F.col("_ts")).alias("text"))


@_query("""SELECT event_id, (epoch_us(ts) // 1000) AS t_ms, (epoch_us(ts) // 1000) / 1e3 AS t_s, (epoch_us(ts) // 1000) % 3600000 AS in_hour_ms FROM events""")
def epoch_ms(spark, sf):
    e = views.table(spark, sf, "events").select("event_id", times.to_ms("ts").alias("t_ms"))
    return e.select("event_id", "t_ms", (F.col("t_ms") / 1000.0).alias("t_s"), (F.col("t_ms") - times.floor_to("t_ms", times.HOUR_MS)).alias("in_hour_ms"))


# ---------------------------------------------------------------- projections


@_query(f"WITH {DENSE_SQL} SELECT event_id, round(sqrt(x*x + y*y + z*z), 6) + 0.0e0 AS vm FROM dense")
def vector_magnitude(spark, sf):
    return rounded(views.dense(spark, sf).select("event_id", vectors.magnitude().alias("vm")))


@_query(f"""
WITH {DENSE_SQL}, v AS (SELECT *, nullif(sqrt(x*x + y*y + z*z), 0) AS n FROM dense)
SELECT event_id, {", ".join(f"round({a}/n, 6) + 0.0e0 AS unit_{a}, round(acos(greatest(-1e0, least(1e0, {a}/n))), 6) + 0.0e0 AS angle_{a}" for a in "xyz")} FROM v""")
def orientation_angles(spark, sf):
    cols = [c for a in "xyz" for c in (vectors.unit(a).alias(f"unit_{a}"), vectors.angle(a).alias(f"angle_{a}"))]
    return rounded(views.dense(spark, sf).select("event_id", *cols))


@_query(f"""
WITH {DENSE_SQL}, {FIXES_SQL}
SELECT event_id, round({_TURN('x_code', 'x')}, 6) + 0.0e0 AS x, round({_TURN('y_code', 'y')}, 6) + 0.0e0 AS y, round({_TURN('z_code', 'z')}, 6) + 0.0e0 AS z FROM dense LEFT JOIN fix USING (pid)""")
def orient_fix(spark, sf):
    return rounded(lookups.orientation_fixed(views.dense(spark, sf), _fixes(spark, sf)).select("event_id", "x", "y", "z"))


@_query(f"WITH {SENSOR_SQL} SELECT event_id, t_ms + 2500 AS t_ms FROM sensor")
def ts_offset(spark, sf):
    return views.sensor(spark, sf).select("event_id", (F.col("t_ms") + F.lit(int(2.5 * 1000))).alias("t_ms"))


@_query(f"WITH {DENSE_SQL} SELECT event_id, pid, sid, CASE pid WHEN 'P0' THEN 'wrist' ELSE 'unknown' END AS location, 'dense' AS protocol FROM dense")
def metadata_append(spark, sf):
    rows = views.dense(spark, sf).select("event_id", "pid", "sid")
    where = spark.createDataFrame([("P0", "S1", "wrist")], "pid string, sid string, location string")
    return lookups.location_of(rows, where).select("event_id", "pid", "sid", "location", F.lit("dense").alias("protocol"))


# ---------------------------------------------------------------- filters


@_query(f"WITH {DENSE_SQL} SELECT event_id, t_ms FROM dense WHERE t_ms >= (SELECT min(t_ms) FROM dense) AND t_ms < (SELECT max(t_ms) FROM dense)")
def clip_range(spark, sf):
    return lookups.clipped(views.dense(spark, sf)).select("event_id", "t_ms")


@_query(f"""
WITH {DENSE_SQL}, {SESSIONS_SQL}, h AS (SELECT *, t_ms - t_ms % 3600000 AS hr FROM dense), f AS (SELECT pid, sid, hr, min(t_ms) AS lo, max(t_ms) AS hi FROM h GROUP BY ALL)
SELECT event_id, h.pid, t_ms FROM h JOIN f USING (pid, sid, hr) LEFT JOIN ses ON ses.pid = h.pid WHERE t_ms >= coalesce(ses.start_ms, lo) AND t_ms < coalesce(ses.stop_ms, hi)""")
def clip_sessions(spark, sf):
    return lookups.clipped_to_sessions(views.dense(spark, sf), _sessions(spark, sf)).select("event_id", "pid", "t_ms")


@_query(f"""
WITH {DENSE_SQL}, m AS (SELECT pid, min(t_ms) - min(t_ms) % 60000 + 60000 AS lo, max(t_ms) - max(t_ms) % 60000 AS hi FROM dense GROUP BY pid)
SELECT event_id, t_ms FROM dense JOIN m USING (pid) WHERE t_ms BETWEEN lo AND hi""")
def hour_mask(spark, sf):
    """The whole minutes within each participant's data; closed on both sides, unlike a clip."""
    rows = views.dense(spark, sf)
    ends = rows.groupBy("pid").agg((times.floor_to(F.min("t_ms"), times.MINUTE_MS) + times.MINUTE_MS).alias("start_ms"), times.floor_to(F.max("t_ms"), times.MINUTE_MS).alias("stop_ms"))
    return lookups.masked(rows, ends, ["pid"]).select("event_id", "t_ms")


@_query(f"""
WITH {SENSOR_SQL}, d AS (SELECT *, t_ms - t_ms % 60000 AS t FROM sensor)
SELECT pid, sid, t AS t_ms, event_id, value FROM d QUALIFY row_number() OVER (PARTITION BY pid, sid, t ORDER BY event_id) = 1""")
def dedup_ts(spark, sf):
    rows = views.sensor(spark, sf).withColumn("t_ms", times.floor_to("t_ms", times.MINUTE_MS))
    return lookups.deduplicated(rows, ["event_id"]).select("pid", "sid", "t_ms", "event_id", "value")


# ---------------------------------------------------------------- lookups


@_query(f"""
WITH {SENSOR_SQL}, {LOCATIONS_SQL}, l AS (SELECT * FROM loc QUALIFY row_number() OVER (PARTITION BY pid, sid ORDER BY ord) = 1)
SELECT event_id, s.pid, s.sid, coalesce(location, 'unknown') AS location FROM sensor s LEFT JOIN l ON l.pid = s.pid AND l.sid = s.sid""")
def lookup_location(spark, sf):
    return lookups.location_of(views.sensor(spark, sf), _locations(spark, sf)).select("event_id", "pid", "sid", "location")


@_query(f"""
WITH {LOCATIONS_SQL}, l AS (SELECT pid, location, sid FROM loc QUALIFY row_number() OVER (PARTITION BY pid, location ORDER BY ord) = 1),
a AS (SELECT c_custkey, 'P' || CAST(c_custkey % 9 AS VARCHAR) AS pid, c_mktsegment AS location FROM customer)
SELECT c_custkey, a.pid, a.location, sid FROM a LEFT JOIN l ON l.pid = a.pid AND l.location = a.location""")
def lookup_sid(spark, sf):
    c = views.table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("P"), (F.col("c_custkey") % 9).cast("string")).alias("pid"), F.col("c_mktsegment").alias("location"))
    return lookups.sid_of(c, _locations(spark, sf)).select("c_custkey", "pid", "location", "sid")


@_query(f"""
WITH {DENSE_SQL}, {SESSIONS_SQL}, o AS (SELECT pid, min(t_ms) AS lo, max(t_ms) AS hi FROM dense GROUP BY pid)
SELECT o.pid, coalesce(ses.start_ms, lo) AS session_start, coalesce(ses.stop_ms, hi) AS session_stop, ses.start_ms AS compat_start, ses.stop_ms AS compat_stop FROM o LEFT JOIN ses ON ses.pid = o.pid""")
def session_bounds(spark, sf):
    data, given = views.dense(spark, sf), _sessions(spark, sf)
    compat = lookups.session_bounds(data, given).select("pid", F.col("session_start").alias("compat_start"), F.col("session_stop").alias("compat_stop"))
    return lookups.session_bounds(data, given, compat=False).join(compat, "pid")


@_query(f"""
WITH {SENSOR_SQL}, {OFFSETS_SQL} SELECT event_id, s.pid, t_ms + coalesce(CAST(round(offset_s * 1000) AS BIGINT), 0) AS t_ms FROM sensor s LEFT JOIN off ON off.pid = s.pid""")
def ts_sync(spark, sf):
    return lookups.synced(views.sensor(spark, sf), _offsets(spark, sf)).select("event_id", "pid", "t_ms")


@_query(f"""
WITH {FILE_SQL}, p AS (SELECT page_id, file, string_split(file, '/')[1] AS pid, upper(string_split(string_split(string_split(file, '/')[-1], '.')[2], '-')[1]) AS sid FROM files)
SELECT page_id, lag(file) OVER w AS prev_file, lead(file) OVER w AS next_file FROM p WINDOW w AS (PARTITION BY pid, sid ORDER BY page_id)""")
def prev_next(spark, sf):
    p = F.col("file")
    rows = _files(spark, sf).select("page_id", "file", paths.participant(p).alias("pid"), paths.file_id(p).alias("sid"), paths.file_date(p).alias("date"), paths.file_hour(p).alias("hour"))
    return lookups.neighbours(rows).select("page_id", "prev_file", "next_file")


# ---------------------------------------------------------------- summaries


@_query(f"WITH {ANNOTATIONS_SQL} SELECT pid, annotator, label_name, round(sum((stop_ms - start_ms) / 1e3), 6) AS duration_in_seconds FROM ann GROUP BY ALL")
def annotation_duration(spark, sf):
    return rounded(summaries.annotation_duration(views.annotations(spark, sf)))


@_query(f"WITH {DENSE_SQL} SELECT pid, sid, t_ms - t_ms % 5000 AS bin_ms, round(avg(greatest(sqrt(x*x + y*y + z*z) - 1, 0e0)), 6) + 0.0e0 AS enmo FROM dense GROUP BY ALL")
def enmo_5s(spark, sf):
    return rounded(summaries.binned(views.dense(spark, sf), 5, KEYS))


@_query(f"""
WITH {DENSE_SQL}, b AS (SELECT t_ms - t_ms % 5000 AS bin_ms, count(*) AS sr FROM dense GROUP BY ALL), g AS (SELECT unnest(generate_series(min(bin_ms), max(bin_ms), 5000)) AS bin_ms FROM b)
SELECT bin_ms, coalesce(sr, 0) AS sr FROM g LEFT JOIN b USING (bin_ms)""")
def sr_count(spark, sf):
    """Without keys, so with the empty bins in between."""
    return summaries.binned(views.dense(spark, sf), 5, [], "sr")


RATE_SQL = """sec AS (SELECT pid, sid, t_ms // 1000 AS s, count(*) AS rate FROM dense GROUP BY ALL), inner_ AS (SELECT * FROM sec QUALIFY s > min(s) OVER (PARTITION BY pid, sid) AND s < max(s) OVER (PARTITION BY pid, sid)),
rate AS (SELECT pid, sid, rate FROM (SELECT pid, sid, rate, count(*) AS n FROM inner_ GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY pid, sid ORDER BY n DESC, rate) = 1)"""


@_query(f"WITH {DENSE_SQL}, {RATE_SQL} SELECT pid, sid, rate FROM rate")
def sampling_rate(spark, sf):
    return features.sampling_rate(views.dense(spark, sf), KEYS)


@_query(f"WITH {DENSE_SQL} SELECT pid, sid, arg_min(t_ms, event_id) - arg_min(t_ms, event_id) % 1000 AS start_ms, arg_max(t_ms, event_id) - arg_max(t_ms, event_id) % 1000 + 1000 AS stop_ms FROM dense GROUP BY ALL")
def sessions(spark, sf):
    return summaries.extracted_sessions(views.dense(spark, sf), order=("event_id",))


@_query(f"""
WITH {FILE_SQL} SELECT page_id, 'True' AS valid_folder_or_derived, CASE WHEN regexp_matches(file, '{paths.NAME_FORM}') THEN 'True' ELSE 'False' END AS valid_name,
  CASE WHEN file LIKE '%MasterSynced/%' THEN 'True' ELSE 'False' END AS valid_folder,
  CASE WHEN page_id % 4 = 0 THEN CASE page_id % 3 WHEN 0 THEN 'True' WHEN 1 THEN 'START_TIME|STOP_TIME|LABEL_NAME' ELSE 'Header has less than 2 columns' END
       ELSE CASE page_id % 3 WHEN 2 THEN 'Header has less than 2 columns' ELSE 'True' END END AS header FROM files""")
def validate_names(spark, sf):
    header = F.element_at(F.array(F.lit("HEADER_TIME_STAMP,START_TIME,STOP_TIME,LABEL_NAME"), F.lit("HEADER_TIME_STAMP,X,Y,Z"), F.lit("X")), (F.col("page_id") % 3 + 1).cast("int"))
    p = F.col("file")
    return _files(spark, sf).select("page_id", F.lit("True").alias("valid_folder_or_derived"), paths.valid_name(p).alias("valid_name"), paths.valid_folder(p).alias("valid_folder"), paths.header_report(header, paths.file_type(p)).alias("header"))


@_query(f"""
WITH {FILE_SQL} SELECT page_id, CASE WHEN file LIKE '%MasterSynced%' THEN replace(file, 'MasterSynced', 'Derived/Feature') ELSE replace(file, regexp_extract(file, 'Derived/([^/]+)', 1), 'Feature') END AS out FROM files""")
def output_path(spark, sf):
    return _files(spark, sf).select("page_id", paths.output_path(F.col("file"), "Feature").alias("out"))


@_query(f"WITH {SENSOR_SQL} SELECT pid, sid, count(*) AS n_rows, count(*) FILTER (event_id % 13 = 0) AS na_rows FROM sensor GROUP BY ALL")
def na_rows(spark, sf):
    rows = views.sensor(spark, sf).withColumn("value", F.when(F.col("event_id") % 13 != 0, F.col("value")))
    return summaries.na_rows(rows, KEYS, ["t_ms", "value"])


@_query(f"""
WITH {DENSE_SQL}, v AS (SELECT pid, sid, unnest([x, y, z]) AS v FROM dense), m AS (SELECT pid, sid, max(v) AS hi, min(v) AS lo, count(*) // 3 AS lines FROM v GROUP BY ALL)
SELECT pid, sid, lines, round(hi, 6) AS max_g, round(lo, 6) AS min_g, count(*) FILTER (v = hi) AS max_g_count, count(*) FILTER (v = lo) AS min_g_count FROM v JOIN m USING (pid, sid) GROUP BY ALL""")
def sensor_stat(spark, sf):
    return rounded(summaries.extremes(views.dense(spark, sf)))


@_query(f"""
WITH {DENSE_SQL}, {ANNOTATIONS_SQL}, b AS (SELECT min(t_ms) AS a, max(t_ms) AS z FROM dense UNION ALL SELECT min(start_ms), max(stop_ms) FROM ann)
SELECT 'union' AS rule, min(a) - min(a) % 60000 AS synced_start, max(z) - max(z) % 60000 + 60000 AS synced_stop FROM b
UNION ALL SELECT 'intersection', max(a) - max(a) % 60000, min(z) - min(z) % 60000 + 60000 FROM b""")
def synced_bounds(spark, sf):
    a = views.dense(spark, sf).agg(F.min("t_ms").alias("session_start"), F.max("t_ms").alias("session_stop"))
    z = views.annotations(spark, sf).agg(F.min("start_ms").alias("session_start"), F.max("stop_ms").alias("session_stop"))
    both = a.union(z)
    return windows.synced_bounds(both).select(F.lit("union").alias("rule"), "*").union(windows.synced_bounds(both, "intersection").select(F.lit("intersection").alias("rule"), "*"))


@_query(f"""
WITH {FILE_SQL}, p AS (SELECT string_split(file, '/')[1] AS pid, upper(string_split(string_split(string_split(file, '/')[-1], '.')[2], '-')[1]) AS id, page_id % 4 = 0 AS ann, length(html) AS n FROM files JOIN pages USING (page_id))
SELECT pid, array_to_string(list_sort(list_distinct(list(id) FILTER (NOT ann))), ',') AS sensors, array_to_string(list_sort(list_distinct(coalesce(list(id) FILTER (ann), []))), ',') AS annotators, CAST(sum(n) AS BIGINT) AS bytes FROM p GROUP BY pid""")
def list_ids(spark, sf):
    files = _files(spark, sf).join(views.table(spark, sf, "pages").select("page_id", F.length("html").cast("long").alias("length")), "page_id")
    return summaries.listed(files.withColumnRenamed("file", "path"))


@_query(f"""
WITH {FILE_SQL}, f AS (SELECT file, html, string_split(html, chr(10)) AS ls FROM files JOIN pages USING (page_id)), h AS (SELECT *, string_split(trim(ls[1]), ',') AS k, string_split(string_split(file, '/')[-1], '.') AS t FROM f)
SELECT string_split(file, '/')[1] AS pid, upper(string_split(t[2], '-')[1]) AS id, lower(t[-2]) AS type, regexp_extract(t[3], '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AS date, regexp_extract(t[3], '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}-([0-9]{{2}})', 1) AS hour,
  round(length(html) / 1024e0, 6) + 0.0e0 AS size_kb, CAST(len(ls) - CASE WHEN ls[-1] = '' THEN 1 ELSE 0 END AS BIGINT) AS n_lines, CASE WHEN file LIKE '%MasterSynced/%' THEN 'True' ELSE 'False' END AS validate_folder_structure,
  CASE WHEN string_split(file, '/')[-1] LIKE 'ActigraphGT9X-%' THEN 'True' ELSE 'False' END AS validate_filename,
  CASE WHEN len(k) < 2 THEN 'Header has less than 2 columns' ELSE coalesce(nullif(CASE WHEN k[1] <> 'HEADER_TIME_STAMP' THEN 'HEADER_TIME_STAMP|' ELSE '' END || CASE WHEN lower(t[-2]) = 'annotation' THEN
    CASE WHEN coalesce(k[2], '') <> 'START_TIME' THEN 'START_TIME|' ELSE '' END || CASE WHEN coalesce(k[3], '') <> 'STOP_TIME' THEN 'STOP_TIME|' ELSE '' END || CASE WHEN coalesce(k[4], '') <> 'LABEL_NAME' THEN 'LABEL_NAME' ELSE '' END ELSE '' END, ''), 'True') END AS validate_csv_header FROM h""")
def file_summary(spark, sf):
    """A row a file; text and size are those of the pages."""
    files = _files(spark, sf).join(views.table(spark, sf, "pages").select("page_id", F.col("html").alias("content"), F.length("html").alias("length")), "page_id")
    return rounded(summaries.file_summary(files.withColumnRenamed("file", "path")))


@_query(f"WITH {DENSE_SQL}, {SENSOR_SQL} SELECT event_id, pid, sid, t_ms, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM dense UNION ALL SELECT event_id, pid, sid, t_ms, NULL, NULL, NULL FROM sensor")
def union_widest(spark, sf):
    return rounded(summaries.united(views.sensor(spark, sf).drop("value"), views.dense(spark, sf)))


# ---------------------------------------------------------------- windows and features


def _window_sql(size: int = windows.SIZE_MS, step: int | None = None) -> str:
    step = step or size
    low = f"greatest((t_ms - st - {size}) // {step} + 1, 0)" if step != size else f"(t_ms - st) // {step}"
    return f"""b AS (SELECT pid, sid, min(t_ms) AS st, max(t_ms) AS et FROM dense GROUP BY pid, sid), bn AS (SELECT *, CASE WHEN et - st >= {size} THEN (et - st - {size}) // {step} + 1 ELSE 0 END AS nw FROM b),
spine AS (SELECT pid, sid, w AS "window", st + w * {step} AS start_ms, st + w * {step} + {size} AS stop_ms FROM (SELECT *, unnest(generate_series(0, nw - 1)) AS w FROM bn)),
pts AS (SELECT * EXCLUDE (st, et, nw), sqrt(x*x + y*y + z*z) AS vm FROM (SELECT d.*, st, et, nw, unnest(generate_series(greatest(CAST(ceil((t_ms - st - {size} + 1) / {float(step)}) AS BIGINT), 0), least((t_ms - st) // {step}, nw - 1))) AS "window" FROM dense d JOIN bn USING (pid, sid)))"""


_STATS = ", ".join(f"round({f}, 6) + 0.0e0 AS {n}_vm" for n, f in (("mean", "avg(vm)"), ("std", "stddev_pop(vm)"), ("max", "max(vm)"), ("min", "min(vm)"), ("range", "max(vm) - min(vm)"), ("amplitude", "max(abs(vm))")))
_ON = 'LEFT JOIN g USING (pid, sid, "window")'


def _vm(spark, sf):
    return views.dense(spark, sf).withColumn("vm", vectors.magnitude())


@_query(f"WITH {DENSE_SQL}, {_window_sql()} SELECT * FROM spine")
def window_spine(spark, sf):
    return windows.spine(windows.bounds(views.dense(spark, sf)))


@_query(f'WITH {DENSE_SQL}, {_window_sql()}, g AS (SELECT pid, sid, "window", {_STATS} FROM pts GROUP BY ALL) SELECT * FROM spine {_ON}')
def tumbling_stats(spark, sf):
    return rounded(windows.windowed(_vm(spark, sf), features.amplitude("vm")))


@_query(f'WITH {DENSE_SQL}, {_window_sql(12800, 3200)}, g AS (SELECT pid, sid, "window", {_STATS} FROM pts GROUP BY ALL) SELECT * FROM spine {_ON}')
def sliding_stats(spark, sf):
    return rounded(windows.windowed(_vm(spark, sf), features.amplitude("vm"), step=3200))


@_query(f'WITH {DENSE_SQL}, {_window_sql()}, g AS (SELECT DISTINCT pid, sid, "window" FROM pts) SELECT s.* FROM spine s ANTI JOIN g USING (pid, sid, "window")')
def empty_windows(spark, sf):
    return windows.windowed(_vm(spark, sf), [F.count("*").alias("n")]).filter("n is null").drop("n")


def _held(spark, sf, column="vm"):
    rows = _vm(spark, sf)
    return windows.assigned(rows, windows.bounds(rows))


@_query(f'WITH {DENSE_SQL}, {_window_sql()}, m AS (SELECT *, avg(vm) OVER (PARTITION BY pid, sid, "window") AS mu FROM pts) SELECT pid, sid, "window", round(avg(abs(vm - mu)), 6) + 0.0e0 AS mean_distance_vm FROM m GROUP BY ALL')
def mean_abs_dev(spark, sf):
    return rounded(features.mean_distance(_held(spark, sf), BY, "vm"))


_ACTIVE = """a1 AS (SELECT pid, sid, "window", t_ms, CAST(vm >= 0.2e0 AS INT) AS a FROM pts), a2 AS (SELECT *, CAST(a = 1 AND coalesce(lag(a) OVER w, 0) = 0 AS INT) AS rise FROM a1 WINDOW w AS (PARTITION BY pid, sid, "window" ORDER BY t_ms)),
a3 AS (SELECT *, sum(rise) OVER (PARTITION BY pid, sid, "window" ORDER BY t_ms ROWS UNBOUNDED PRECEDING) AS run FROM a2), a4 AS (SELECT pid, sid, "window", run, sum(a) AS len, count(*) AS n, sum(rise) AS rises FROM a3 GROUP BY ALL),
act AS (SELECT pid, sid, "window", sum(len) AS active, sum(n) AS n, sum(rises) AS rises, stddev_pop(len) FILTER (len > 1) AS spread FROM a4 GROUP BY ALL)"""


@_query(f'WITH {DENSE_SQL}, {_window_sql()}, {_ACTIVE} SELECT pid, sid, "window", round(active / n, 6) AS active_perc_vm, round(rises / nullif(active, 0), 6) AS activations_vm FROM act')
def activation(spark, sf):
    return rounded(features.activation(_held(spark, sf), BY, "vm").drop("activation_std_vm"))


@_query(f'WITH {DENSE_SQL}, {_window_sql()}, {_ACTIVE.replace("vm >= 0.2e0", "x >= 0.2e0").replace("SELECT pid, sid, \"window\", t_ms, CAST", "SELECT pid, sid, \"window\", t_ms, CAST")} SELECT pid, sid, "window", round(CASE WHEN rises <= 2 THEN 0e0 ELSE spread END / n, 6) + 0.0e0 AS activation_std_x FROM act')
def activation_std(spark, sf):
    return rounded(features.activation(_held(spark, sf), BY, "x").select(*BY, "activation_std_x"))


_ORIENT = """o1 AS (SELECT *, row_number() OVER (PARTITION BY pid, sid, "window" ORDER BY t_ms) - 1 AS i, count(*) OVER (PARTITION BY pid, sid, "window") AS n FROM pts), o2 AS (SELECT *, n // 4 AS l FROM o1 WHERE n >= 4),
o3 AS (SELECT pid, sid, "window", i // l AS sub, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM o2 WHERE i < least(l * 4, n - 1) GROUP BY ALL), o4 AS (SELECT *, nullif(sqrt(x*x + y*y + z*z), 0) AS nn FROM o3)"""
_ANGLES = ", ".join(f"acos(greatest(-1e0, least(1e0, {a}/nn))) AS {a}" for a in "xyz")
_ANGLE_FEATURES = ", ".join([*(f"CASE WHEN count(*) = 4 THEN round(median({a}), 6) + 0.0e0 END AS median_{a}_angle" for a in "xyz"), *(f"CASE WHEN count(*) = 4 THEN round(max({a}) - min({a}), 6) + 0.0e0 END AS range_{a}_angle" for a in "xyz")])


@_query(f'WITH {DENSE_SQL}, {_window_sql()}, {_ORIENT}, o5 AS (SELECT pid, sid, "window", {_ANGLES} FROM o4) SELECT pid, sid, "window", {_ANGLE_FEATURES} FROM o5 GROUP BY ALL')
def orientation_features(spark, sf):
    return rounded(features.orientation(_held(spark, sf), BY))


# the transform as a join of every sample with every frequency of its window
_SPECTRUM = f"""{RATE_SQL}, s1 AS (SELECT pid, sid, "window", t_ms, vm, count(*) OVER w AS n, row_number() OVER (PARTITION BY pid, sid, "window" ORDER BY t_ms) - 1 AS i, avg(vm) OVER w AS mu FROM pts WINDOW w AS (PARTITION BY pid, sid, "window")),
s2 AS (SELECT *, 0.54e0 - 0.46e0 * cos(2 * pi() * i / n) AS h FROM s1), s3 AS (SELECT *, unnest(generate_series(0, n // 2)) AS k FROM s2 WHERE n > 1),
s4 AS (SELECT pid, sid, "window", k, max(n) AS n, sum((vm - mu) * h * cos(2 * pi() * ((k * i) % n) / n)) AS re, sum((vm - mu) * h * sin(2 * pi() * ((k * i) % n) / n)) AS im, sum(h * h) AS hh FROM s3 GROUP BY ALL),
s5 AS (SELECT pid, sid, "window", k, k * rate / n AS f, (re * re + im * im) / (rate * hh) * CASE WHEN k = 0 OR 2 * k = n THEN 1 ELSE 2 END AS p FROM s4 JOIN rate USING (pid, sid)),
pk AS (SELECT * FROM (SELECT *, lag(p) OVER w AS a, lead(p) OVER w AS z FROM s5 WINDOW w AS (PARTITION BY pid, sid, "window" ORDER BY k)) WHERE p > a AND p >= z),
spec AS (SELECT pid, sid, "window", coalesce(max(pk.f), 0e0) AS dom_freq, coalesce(max(pk.p), 0e0) AS dom_power, any_value(total) AS total_power, any_value(high) AS high_power FROM
  (SELECT pid, sid, "window", sum(p) AS total, coalesce(sum(p) FILTER (f > 3.5), 0e0) AS high FROM s5 GROUP BY ALL) t LEFT JOIN (SELECT * FROM pk QUALIFY row_number() OVER (PARTITION BY pid, sid, "window" ORDER BY p DESC, k) = 1) pk USING (pid, sid, "window") GROUP BY ALL)"""


@_query(f'WITH {DENSE_SQL}, {_window_sql()}, {_SPECTRUM} SELECT pid, sid, "window", round(dom_freq, 6) AS dom_freq_vm, round(dom_power, 6) AS dom_power_vm, round(total_power, 6) AS total_power_vm, round(high_power, 6) AS high_power_vm FROM spec')
def spectral(spark, sf):
    rate = features.sampling_rate(views.dense(spark, sf), KEYS)
    return rounded(features.spectral(_held(spark, sf).join(rate, KEYS), BY, "vm"))


_EDGE = """w AS (SELECT event_id, pid, x, lag(x) OVER o AS a, lead(x) OVER o AS z FROM dense WINDOW o AS (PARTITION BY pid ORDER BY t_ms))"""


@_query(f"WITH {DENSE_SQL}, {_EDGE} SELECT event_id, round(x, 6) + 0.0e0 AS x FROM w WHERE x > a AND x >= z")
def detect_peaks(spark, sf):
    """Rising edges, the default: window functions suffice."""
    o = W.partitionBy("pid").orderBy("t_ms")
    rows = views.dense(spark, sf).select("event_id", "x", F.lag("x").over(o).alias("a"), F.lead("x").over(o).alias("z"))
    return rounded(rows.filter("x > a and x >= z").select("event_id", "x"))


@_query(f"WITH {DENSE_SQL}, {_EDGE} SELECT event_id, round(x, 6) + 0.0e0 AS x FROM w WHERE (x > a AND x >= z OR x >= a AND x > z) AND x >= 0.25 AND least(x - a, x - z) >= 0.1")
def detect_peaks_both(spark, sf):
    """Either end of a flat top, with a least height and a least drop to both neighbours."""
    return rounded(features.peaks(views.dense(spark, sf).select("event_id", "pid", "t_ms", "x"), ["pid"], "x", edge="both", height=0.25, threshold=0.1).select("event_id", "x"))


@_query(f"WITH {DENSE_SQL}, {_EDGE} SELECT event_id, round(x, 6) + 0.0e0 AS x FROM w WHERE x <= a AND x < z")
def detect_valleys(spark, sf):
    """Falling edges of the series turned over."""
    return rounded(features.peaks(views.dense(spark, sf).select("event_id", "pid", "t_ms", "x"), ["pid"], "x", edge="falling", valley=True).select("event_id", "x"))


@_query()
def detect_peaks_apart(spark, sf):
    """Of peaks within 20 samples of each other the highest."""
    return rounded(features.peaks(views.dense(spark, sf).select("event_id", "pid", "t_ms", "x"), ["pid"], "x", distance=20).select("event_id", "x"))


@_query(f"""
WITH {DENSE_SQL}, {_window_sql()}, {_SPECTRUM} SELECT pid, sid, "window", rank, round(p, 6) AS power, round(f, 6) AS freq FROM (SELECT *, row_number() OVER (PARTITION BY pid, sid, "window" ORDER BY p DESC, k) AS rank FROM pk) WHERE rank <= 1""")
def spectral_peaks(spark, sf):
    rate = features.sampling_rate(views.dense(spark, sf), KEYS)
    got = features.spectral(_held(spark, sf).join(rate, KEYS), BY, "vm").filter("dom_power_vm > 0")
    return rounded(got.select(*BY, F.lit(1).cast("long").alias("rank"), F.col("dom_power_vm").alias("power"), F.col("dom_freq_vm").alias("freq")))


@_query()
def spectral_peaks_all(spark, sf):
    """All ranked peaks of each window; ``spectral_peaks`` keeps the rank filter of its SQL."""
    rate = features.sampling_rate(views.dense(spark, sf), KEYS)
    return rounded(features.spectral_peaks(_held(spark, sf).join(rate, KEYS), BY, "vm"))


_TF = """round(mean_vm, 6) + 0.0e0 AS mean_vm, round(std_vm, 6) + 0.0e0 AS std_vm, round(max_vm, 6) + 0.0e0 AS max_vm, round(dom_power, 6) AS dom_freq_vm, round(dom_power / nullif(total_power, 0), 6) AS dom_freq_power_ratio_vm,
round(high_power / nullif(total_power, 0), 6) AS highend_freq_power_ratio_vm, round(range_vm, 6) + 0.0e0 AS range_vm, round(active / n, 6) AS active_sample_perc_vm, round(rises / nullif(active, 0), 6) AS number_of_activations_vm,
round(CASE WHEN rises <= 2 THEN 0e0 ELSE spread END / n, 6) + 0.0e0 AS activation_interval_var_vm"""
_TF_FROM = 'FROM spine LEFT JOIN (SELECT pid, sid, "window", avg(vm) AS mean_vm, stddev_pop(vm) AS std_vm, max(vm) AS max_vm, max(vm) - min(vm) AS range_vm FROM pts GROUP BY ALL) g USING (pid, sid, "window") LEFT JOIN spec USING (pid, sid, "window") LEFT JOIN act USING (pid, sid, "window")'


@_query(f'WITH {DENSE_SQL}, {_window_sql()}, {_SPECTRUM}, {_ACTIVE} SELECT pid, sid, "window", start_ms, stop_ms, {_TF} {_TF_FROM}')
def timefreq_features(spark, sf):
    rows = _vm(spark, sf)
    return rounded(plans.time_frequency(rows, "vm", features.sampling_rate(rows, KEYS)))


def _matrix_sql(m) -> str:
    return ", ".join(f"{float(r[0])!r}::DOUBLE * x + {float(r[1])!r}::DOUBLE * y + {float(r[2])!r}::DOUBLE * z AS {a}" for r, a in zip(m, "xyz", strict=True))


def _plain_matrix(cutoffs, kind="lowpass") -> np.ndarray:
    """How the zero-phase filter acts on three values, by its difference equation: for the SQL twins."""
    b, a = signal.butterworth(4, cutoffs, RATE, kind)

    def once(x):
        seen, y = [x[0]] * 2000 + list(x), []  # a long constant lead stands for the steady state
        for i, v in enumerate(seen):
            y.append(b[0] * v + sum(b[k] * seen[i - k] for k in range(1, len(b)) if i >= k) - sum(a[k] * y[i - k] for k in range(1, len(a)) if i >= k))
        return y[2000:]

    return np.stack([once(once(e)[::-1])[::-1] for e in np.eye(3)], 1)


_LOWPASS = _plain_matrix([20.0])
_FILTERED = f"fil AS (SELECT * EXCLUDE (x, y, z), {_matrix_sql(_LOWPASS)} FROM pts), turned AS (SELECT fil.* EXCLUDE (x, y, z), {', '.join(_TURN(f'{a}_code', a) + f' AS {a}' for a in 'xyz')} FROM fil LEFT JOIN fix USING (pid))"


@_query(f"""
WITH {DENSE_SQL}, {FIXES_SQL}, {_window_sql()}, {_SPECTRUM}, {_ACTIVE}, {_FILTERED}, {_ORIENT.replace("FROM pts)", "FROM turned)")}, o5 AS (SELECT pid, sid, "window", {_ANGLES} FROM o4), ori AS (SELECT pid, sid, "window", {_ANGLE_FEATURES} FROM o5 GROUP BY ALL)
SELECT pid, sid, "window", start_ms, stop_ms, {_TF}, median_x_angle, median_y_angle, median_z_angle, range_x_angle, range_y_angle, range_z_angle, CASE pid WHEN 'P0' THEN 'wrist' ELSE 'unknown' END AS location {_TF_FROM} LEFT JOIN ori USING (pid, sid, "window")""")
def feature_set(spark, sf):
    where = spark.createDataFrame([("P0", "S1", "wrist")], "pid string, sid string, location string")
    rows = views.dense(spark, sf)
    return rounded(plans.feature_set(rows, features.sampling_rate(rows, KEYS), RATE, _fixes(spark, sf), where))


# ---------------------------------------------------------------- labels


_OVER = f"""{{dense}}, {ANNOTATIONS_SQL}, {{win}}, ov AS (SELECT s.pid, s.sid, s."window", label_name, a.stop_ms - a.start_ms AS len FROM spine s JOIN ann a ON a.pid = s.pid AND a.start_ms < s.stop_ms AND a.stop_ms > s.start_ms),
lab AS (SELECT s.*, g.label, coalesce(g.short, false) AS short, g.names FROM spine s LEFT JOIN (SELECT pid, sid, "window", lower(trim(array_to_string(list_sort(list_distinct(list(label_name))), ','))) AS label, min(len) < 12800 AS short, list_sort(list_distinct(list(lower(trim(label_name))))) AS names FROM ov GROUP BY ALL) g USING (pid, sid, "window"))"""
_LABEL_SQL = _OVER.format(dense=DENSE_SQL, win=_window_sql())


def _labelled(spark, sf):
    session = windows.bounds(views.dense(spark, sf))
    held = windows.overlapping(views.annotations(spark, sf), session.select("pid", "sid", "session_start", "session_stop"), keys=["pid"])
    return labels.window_labels(windows.spine(session), held, BY, windows.SIZE_MS)


@_query(f'WITH {_LABEL_SQL} SELECT pid, sid, "window", label, short FROM lab')
def interval_overlap(spark, sf):
    return _labelled(spark, sf).select(*BY, "label", "short")


def _case(cases, default) -> str:
    def one(part: str) -> str:
        out = []
        for word in part.split("|"):
            out.append(f"label = '{word[1:]}'" if word[0] == "=" else f"NOT contains(label, '{word[1:]}')" if word[0] == "!" else f"contains(label, '{word}')")
        return "(" + " OR ".join(out) + ")"

    return "CASE " + " ".join(f"WHEN {' AND '.join(one(p) for p in rule.split(' & '))} THEN {value}" for rule, value in cases) + f" ELSE {default} END"


def _class_sql(target: str) -> str:
    groups = {"posture": labels.POSTURE, "four_classes": labels.FOUR_CLASSES, "activity_group": labels.ACTIVITY_GROUP, "indoor_outdoor": labels.INDOOR_OUTDOOR}
    if target in groups:
        value = _case([(words, f"'{name}'") for name, words in groups[target].items()], "'unknown'")
    elif target == "activity_intensity":
        met = _case([(p, m) for p, m, _, _ in labels.DETAILS], "NULL")
        value = f"CASE WHEN ({met}) IS NULL THEN 'unknown' WHEN ({met}) <= 1.5 THEN 'sedentary' WHEN ({met}) <= 4.0 THEN 'light' WHEN ({met}) <= 7.0 THEN 'moderate' ELSE 'vigorous' END"
    else:
        k = 2 if target == "activity" else 3
        value = _case([(d[0], f"'{d[k]}'") for d in labels.DETAILS], "'unknown'")
    return f"""WITH {_LABEL_SQL} SELECT pid, sid, "window", CASE WHEN label IS NULL THEN 'unknown' WHEN short THEN 'transition' ELSE {value} END AS {target} FROM lab"""


def _register_classes() -> None:
    short = {"activity_group": "mdcas", "activity_intensity": "intensity", "hand_gesture": "gesture"}
    for target in labels.TARGETS:
        def fn(spark, sf, target=target):
            return labels.assigned_classes(_labelled(spark, sf), [target]).select(*BY, target)

        fn.__name__ = f"labels_{short.get(target, target)}"
        _query(_class_sql(target))(fn)


_register_classes()


@_query("""
SELECT c_custkey, CASE WHEN label = '' THEN NULL ELSE label END AS label FROM (SELECT c_custkey, lower(c_mktsegment) AS label FROM customer)""")
def label_text(spark, sf):
    c = views.table(spark, sf, "customer")
    return c.select("c_custkey", F.nullif(F.lower(F.trim("c_mktsegment")), F.lit("")).alias("label"))


@_query(f"""
WITH {_LABEL_SQL}, m(k, kind) AS (VALUES ('walking', 'move'), ('lying on the back', 'rest'), ('sitting and writing-walking', 'mixed'), ('stairs going up', 'move'))
SELECT pid, sid, "window", coalesce(kind, 'unknown') AS kind FROM lab LEFT JOIN m ON m.k = array_to_string(names, '-')""")
def class_map(spark, sf):
    held = spark.createDataFrame([("walking", "move"), ("lying on the back", "rest"), ("sitting and writing-walking", "mixed"), ("stairs going up", "move")], "label string, kind string")
    return labels.mapped_classes(_labelled(spark, sf), held, "label", ["kind"]).select(*BY, "kind")


# ---------------------------------------------------------------- signal


@_query(f"""
WITH {DENSE_SQL}, f AS (SELECT *, coalesce(CAST(t_ms - lag(t_ms) OVER (PARTITION BY pid, sid ORDER BY t_ms) > 1000 AS INT), 0) AS far FROM dense)
SELECT event_id, CAST(sum(far) OVER (PARTITION BY pid, sid ORDER BY t_ms ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM f""")
def gap_segments(spark, sf):
    return signal.gap_segments(views.dense(spark, sf)).select("event_id", "segment")


_GRID = 25.0


@_query(f"""
WITH {DENSE_SQL}, f AS (SELECT *, coalesce(CAST(t_ms - lag(t_ms) OVER (PARTITION BY pid, sid ORDER BY t_ms) > 1000 AS INT), 0) AS far FROM dense),
s AS (SELECT *, sum(far) OVER (PARTITION BY pid, sid ORDER BY t_ms ROWS UNBOUNDED PRECEDING) AS seg FROM f),
e AS (SELECT pid, sid, min(t_ms) AS a, max(t_ms) AS z, CAST(ceil((max(t_ms) - min(t_ms)) / 1e3 * {_GRID}) AS BIGINT) AS n FROM dense GROUP BY ALL),
g AS (SELECT pid, sid, k, a + k * ((z - a) / (n - 1)::DOUBLE) AS g, z FROM (SELECT *, unnest(generate_series(0, n - 1)) AS k FROM e)),
l AS (SELECT g.pid, g.sid, g.k, g.g, s.t_ms::DOUBLE AS t0, s.seg AS s0, s.x AS x0, s.y AS y0, s.z AS z0 FROM g ASOF JOIN (SELECT *, t_ms::DOUBLE AS t FROM s) s ON s.pid = g.pid AND s.sid = g.sid AND g.g >= s.t WHERE g.g < g.z),
b AS (SELECT l.*, r.t AS t1, r.seg AS s1, r.x AS x1, r.y AS y1, r.z AS z1 FROM l ASOF LEFT JOIN (SELECT *, t_ms::DOUBLE AS t FROM s) r ON r.pid = l.pid AND r.sid = l.sid AND l.g <= r.t)
SELECT pid, sid, k, CAST(floor(g) AS BIGINT) AS t_ms, {", ".join(f"floor((CASE WHEN t0 = g THEN {a}0 WHEN s0 = s1 THEN {a}0 + ({a}1 - {a}0) / (t1 - t0) * (g - t0) END) * 1e6 + 0.5e0) / 1e6 AS {a}" for a in "xyz")} FROM b""")
def resample_linear(spark, sf):
    return rounded_alike(signal.resampled(views.dense(spark, sf), _GRID))


@_query(f"""
WITH {DENSE_SQL}, e AS (SELECT pid, sid, min(t_ms) AS lo, max(t_ms) AS hi FROM dense GROUP BY ALL), h AS (SELECT DISTINCT pid, sid, t_ms - t_ms % 3600000 AS hr FROM dense),
g AS (SELECT pid, sid, k, hr + k * (3600000::DOUBLE / {int(3600 * _GRID) - 1}) AS g FROM (SELECT *, unnest(generate_series(0, {int(3600 * _GRID) - 2})) AS k FROM h)),
w AS (SELECT g.* FROM g JOIN e USING (pid, sid) WHERE g >= lo AND g < hi), s AS (SELECT *, t_ms::DOUBLE AS t FROM dense),
l AS (SELECT w.*, s.t AS t0, s.x AS x0, s.y AS y0, s.z AS z0 FROM w ASOF JOIN s ON s.pid = w.pid AND s.sid = w.sid AND w.g >= s.t),
b AS (SELECT l.*, s.t AS t1, s.x AS x1, s.y AS y1, s.z AS z1 FROM l ASOF LEFT JOIN s ON s.pid = l.pid AND s.sid = l.sid AND l.g <= s.t)
SELECT pid, sid, k, CAST(floor(g) AS BIGINT) AS t_ms, {", ".join(f"floor((CASE WHEN t0 = g THEN {a}0 WHEN t1 - t0 <= 1000 THEN {a}0 + ({a}1 - {a}0) / (t1 - t0) * (g - t0) END) * 1e6 + 0.5e0) / 1e6 AS {a}" for a in "xyz")} FROM b""")
def resample_hourly(spark, sf):
    return rounded_alike(signal.resampled_by_hour(views.dense(spark, sf), _GRID))


@_query()
def resample_spline(spark, sf):
    return rounded(signal.resampled_spline(views.dense(spark, sf), _GRID))


@_query(f"WITH {DENSE_SQL} SELECT event_id, {', '.join(f'round({a}, 6) + 0.0e0 AS {a}' for a in 'xyz')} FROM (SELECT event_id, {_matrix_sql(_LOWPASS)} FROM dense)")
def lowpass_compat(spark, sf):
    return rounded(signal.filtered(views.dense(spark, sf), RATE, [20.0]).select("event_id", "x", "y", "z"))


def _register_filters() -> None:
    for kind, cutoffs in (("highpass", [5.0]), ("bandpass", [2.0, 20.0])):
        def fn(spark, sf, kind=kind, cutoffs=cutoffs):
            return rounded(signal.filtered(views.dense(spark, sf), RATE, cutoffs, kind=kind).select("event_id", "x", "y", "z"))

        fn.__name__ = f"{kind}_compat"
        m = _plain_matrix(cutoffs, kind)
        _query(f"WITH {DENSE_SQL} SELECT event_id, {', '.join(f'round({a}, 6) + 0.0e0 AS {a}' for a in 'xyz')} FROM (SELECT event_id, {_matrix_sql(m)} FROM dense)")(fn)


_register_filters()


@_query()
def lowpass_time(spark, sf):
    return rounded(signal.filtered_in_time(views.dense(spark, sf), 20.0, [5.0]))


# ---------------------------------------------------------------- still stretches and calibration


_STILL = f"""{_window_sql(1000)}, st AS (SELECT pid, sid, "window", count(*) AS n, {", ".join(f"avg({a}) AS {a}, stddev_pop({a}) AS std_{a}" for a in "xyz")} FROM pts GROUP BY ALL HAVING stddev_pop(x) <= 0.01 AND stddev_pop(y) <= 0.01 AND stddev_pop(z) <= 0.01 AND NOT greatest(abs(avg(x)), abs(avg(y)), abs(avg(z))) < 1e-5)"""


@_query(f'WITH {DENSE_SQL}, {_STILL} SELECT pid, sid, "window", n, round(x, 6) + 0.0e0 AS x, round(y, 6) + 0.0e0 AS y, round(z, 6) + 0.0e0 AS z FROM st')
def static_windows(spark, sf):
    return rounded(calibration.still_windows(views.dense(spark, sf)).select(*BY, "n", "x", "y", "z"))


@_query(f"""
WITH {DENSE_SQL}, {_STILL}, u AS (SELECT *, sqrt(x*x + y*y + z*z) AS vm FROM st)
SELECT pid, sid, "window", start_ms, stop_ms, round(x / vm, 6) + 0.0e0 AS unit_x, round(y / vm, 6) + 0.0e0 AS unit_y, round(z / vm, 6) + 0.0e0 AS unit_z, round(acos(least(1e0, (x + y + z) / vm / sqrt(3e0))), 6) + 0.0e0 AS angle
FROM u JOIN spine USING (pid, sid, "window") WHERE abs(vm - 1) < 0.02""")
def static_vectors(spark, sf):
    return rounded(calibration.still_vectors(views.dense(spark, sf)))


@_query()
def static_chunks(spark, sf):
    return rounded(calibration.still_chunks(views.dense(spark, sf)))


@_query(f"""
WITH {DENSE_SQL}, {_STILL}, c AS (SELECT pid, sid, count(*) AS n_points FROM st GROUP BY ALL HAVING count(*) >= 9)
SELECT pid, sid, "window", round(x, 6) + 0.0e0 AS x, round(y, 6) + 0.0e0 AS y, round(z, 6) + 0.0e0 AS z, n_points FROM st JOIN c USING (pid, sid)""")
def calib_points(spark, sf):
    still = calibration.still_windows(views.dense(spark, sf)).select(*BY, "x", "y", "z")
    return rounded(calibration.calibration_points(still).select(*BY, "x", "y", "z", "n_points"))


_M, _B = [[1.02, 0.01, -0.02], [0.01, 0.98, 0.015], [-0.02, 0.015, 1.01]], [0.03, -0.02, 0.01]


def _params(spark):
    return spark.createDataFrame([("P0", "S1", [v for r in _M for v in r], _B)], "pid string, sid string, m array<double>, b array<double>")


_CALIBRATED = ", ".join(
    f"CASE WHEN pid = 'P0' THEN {' + '.join(f'{float(_M[i][j])!r}::DOUBLE * ({a} - {float(_B[j])!r}::DOUBLE)' for j, a in enumerate('xyz'))} ELSE {'xyz'[i]} END AS {'xyz'[i]}" for i in range(3)
)


@_query(f"WITH {DENSE_SQL} SELECT event_id, {', '.join(f'round({a}, 6) + 0.0e0 AS {a}' for a in 'xyz')} FROM (SELECT event_id, {_CALIBRATED} FROM dense)")
def calib_apply(spark, sf):
    return rounded(calibration.calibrated(views.dense(spark, sf), _params(spark)).select("event_id", "x", "y", "z"))


@_query()
def calib_fit(spark, sf):
    """The dense stream, each second turned to an orientation of its own and distorted by a known matrix; still stretches of every sensor are fitted.

    The view's still stretches have three orientations, too few for a fit; hence the turning.
    """
    from ..operators.calibration import calibration as fit

    second = F.floor(F.col("t_ms") / 1000) % 86_400
    a, c = second * 2.399963, second * 0.7548777 * 2 * np.pi
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    turned = views.dense(spark, sf).select("pid", "sid", "t_ms", (x * F.cos(a) - y * F.sin(a)).alias("x"), (x * F.sin(a) + y * F.cos(a)).alias("y"), "z", c.alias("c"))
    turned = turned.select("pid", "sid", "t_ms", "x", (y * F.cos("c") - z * F.sin("c")).alias("y"), (y * F.sin("c") + z * F.cos("c")).alias("z"))
    rows = turned.select("pid", "sid", "t_ms", (x * 1.1 + y * 0.02 + 0.05).alias("x"), (x * 0.02 + y * 0.95 - 0.03).alias("y"), (z * 1.05 + 0.02).alias("z"))
    rows = calibration.still_chunks(rows)
    got = fit(rows)
    return rounded(got.select("pid", "sid", *(F.col("m")[k].alias(f"m{k}") for k in range(9)), *(F.col("b")[k].alias(f"b{k}") for k in range(3))))


@_query(f"""
WITH {DENSE_SQL}, {SESSIONS_SQL}, {OFFSETS_SQL}, c AS (SELECT event_id, pid, sid, t_ms, {_CALIBRATED} FROM dense), s AS (SELECT c.* REPLACE (t_ms + coalesce(CAST(round(offset_s * 1000) AS BIGINT), 0) AS t_ms) FROM c LEFT JOIN off USING (pid)),
h AS (SELECT *, t_ms - t_ms % 3600000 AS hr FROM s), f AS (SELECT pid, sid, hr, min(t_ms) AS lo, max(t_ms) AS hi FROM h GROUP BY ALL)
SELECT event_id, h.pid, t_ms, {', '.join(f'round({a}, 6) + 0.0e0 AS {a}' for a in 'xyz')} FROM h JOIN f USING (pid, sid, hr) LEFT JOIN ses ON ses.pid = h.pid WHERE t_ms >= coalesce(ses.start_ms, lo) AND t_ms < coalesce(ses.stop_ms, hi)""")
def preprocess(spark, sf):
    out = plans.preprocessed(views.dense(spark, sf), _params(spark), _offsets(spark, sf), _sessions(spark, sf))
    return rounded(out.select("event_id", "pid", "t_ms", "x", "y", "z"))


# ---------------------------------------------------------------- models


WIDTH = 64


def _vectors(spark, sf, width: int = WIDTH):
    e = views.table(spark, sf, "embeddings")
    return e.select("vec_id", "label", *(F.col("embedding")[k].cast("double").alias(f"f{k}") for k in range(width)))


_FEATURES = "v AS (SELECT vec_id, label, " + ", ".join(f"embedding[{k + 1}]::DOUBLE AS f{k}" for k in range(WIDTH)) + " FROM embeddings)"
_KIND = "CASE label % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN 'transition' ELSE 'c' || CAST(label AS VARCHAR) END"


def _kind():
    return F.when(F.col("label") % 5 == 0, "unknown").when(F.col("label") % 5 == 1, "transition").otherwise(F.concat(F.lit("c"), F.col("label").cast("string")))


@_query(f"WITH {_FEATURES} SELECT vec_id, {', '.join(f'round((f{k} - min(f{k}) OVER ()) / (max(f{k}) OVER () - min(f{k}) OVER ()) * 2 - 1, 6) + 0.0e0 AS f{k}' for k in range(WIDTH))} FROM v")
def minmax_scale(spark, sf):
    rows, cols = _vectors(spark, sf), [f"f{k}" for k in range(WIDTH)]
    return rounded(models.scaled(rows, models.ranges(rows, cols)).select("vec_id", *cols))


@_query(f"WITH {_FEATURES} SELECT vec_id, {_KIND} AS kind FROM v WHERE label % 5 > 1 AND vec_id % 7 <> 0")
def train_filter(spark, sf):
    rows = _vectors(spark, sf).select("vec_id", F.when(F.col("vec_id") % 7 != 0, F.col("f0")).alias("f0"), _kind().alias("kind"))
    return models.train_rows(rows, "kind").select("vec_id", "kind")


@_query(f"WITH {_FEATURES} SELECT vec_id, label, (row_number() OVER (PARTITION BY label ORDER BY vec_id * 7919 % 10007, vec_id) - 1) % 10 AS fold FROM v")
def stratified_folds(spark, sf):
    rows = models.folded(_vectors(spark, sf), "label", [F.col("vec_id") * 7919 % 10007, "vec_id"])
    return rows.select("vec_id", "label", F.col("fold").cast("long").alias("fold"))


_BEST = "v AS (SELECT *, 'f' || CAST(list_position(l, list_max(l)) - 1 AS VARCHAR) AS best, list_max(l) AS p FROM (SELECT vec_id, label, embedding::DOUBLE[] AS l FROM embeddings))"


@_query(f"WITH {_BEST} SELECT vec_id, best AS label, round(p, 6) + 0.0e0 AS p FROM v")
def argmax_label(spark, sf):
    label, p = models.argmax_label({f"f{k}": f"f{k}" for k in range(WIDTH)})
    return rounded(_vectors(spark, sf).select("vec_id", label.alias("label"), p.alias("p")))


@_query(f"""
WITH {_BEST}, r AS (SELECT 'f' || CAST(label AS VARCHAR) AS truth, best AS pred FROM v), s AS (SELECT truth AS l, CAST(truth = pred AS INT) AS hit FROM r UNION ALL SELECT pred, 0 FROM r)
SELECT (SELECT round(avg(CAST(truth = pred AS INT)), 6) FROM r) AS accuracy, round(avg(f1), 6) AS macro_f1 FROM (SELECT l, 2e0 * sum(hit) / count(*) AS f1 FROM s GROUP BY l)""")
def macro_f1(spark, sf):
    label, _ = models.argmax_label({f"f{k}": f"f{k}" for k in range(WIDTH)})
    rows = _vectors(spark, sf).select(F.concat(F.lit("f"), F.col("label").cast("string")).alias("truth"), label.alias("pred"))
    return rounded(models.metrics(rows, "truth", "pred"))


@_query(f'WITH {_LABEL_SQL}, g AS (SELECT pid, sid, "window", round(avg(vm), 6) + 0.0e0 AS mean_vm FROM pts GROUP BY ALL) SELECT pid, start_ms, stop_ms, mean_vm, label FROM lab LEFT JOIN g USING (pid, sid, "window")')
def align_features(spark, sf):
    measured = windows.windowed(_vm(spark, sf), [F.avg("vm").alias("mean_vm")]).select("pid", "start_ms", "stop_ms", "mean_vm")
    return rounded(models.aligned(measured, _labelled(spark, sf).select("pid", "start_ms", "stop_ms", "label")).select("pid", "start_ms", "stop_ms", "mean_vm", "label"))


@_query()
def svm_predict(spark, sf):
    """A radial-kernel machine by random features over all components, trained on most vectors and applied to all."""
    width = views.table(spark, sf, "embeddings").agg(F.max(F.size("embedding"))).first()[0]
    rows = _vectors(spark, sf, width).withColumn("kind", F.concat(F.lit("c"), (F.col("label") % 3).cast("string")))
    cols = [f"f{k}" for k in range(width)]
    bundle = models.train(rows.filter("vec_id % 5 <> 0"), cols, "MDCAS", "kind", cost=10.0)
    return rounded(bundle.predict(rows).select("vec_id", "kind", "MDCAS_PREDICTION", "MDCAS_PREDICTION_PROB"))
