"""File names and folders as column expressions.

Names follow ``Type-DataType[-Version].ID-DataType.YYYY-MM-DD-HH-mm-ss-SSS-ZONE.filetype.csv`` under
``participant/MasterSynced/YYYY/MM/DD/HH`` or ``participant/Derived/set``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The data set's grammar of names and folders, its columns in their places, and what a header report says.
NAME_FORM = r"([A-Za-z0-9]+-){1,2}[A-Za-z0-9]+\.[A-Za-z0-9]+-[A-Za-z0-9]+\.[0-9]{4}-[0-9]{2}-[0-9]{2}-[0-9]{2}-[0-9]{2}-[0-9]{2}-[0-9]{3}-[MP][0-9]{4}\.[a-z]+\.csv"
FOLDER_FORM = r"MasterSynced/[0-9]{4}/[0-9]{2}/[0-9]{2}/[0-9]{2}"
HEADER = (("HEADER_TIME_STAMP", "|", None), ("START_TIME", "|", ("annotation", "event")), ("STOP_TIME", "|", ("annotation", "event")), ("LABEL_NAME", "", ("annotation",)))
SHORT_HEADER, GOOD = "Header has less than 2 columns", "True"


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _part(path: Column, k: int) -> Column:
    return F.try_element_at(F.split(base_name(path), r"\."), F.lit(k))


def file_type(path: Column) -> Column:
    return F.lower(F.trim(_part(path, -2)))


def file_date(path: Column) -> Column:
    return F.nullif(F.regexp_extract(_part(path, 3), r"[0-9]{4}-[0-9]{2}-[0-9]{2}", 0), F.lit(""))


def file_hour(path: Column) -> Column:
    return F.nullif(F.regexp_extract(_part(path, 3), r"[0-9]{4}-[0-9]{2}-[0-9]{2}-([0-9]{2})", 1), F.lit(""))


def file_id(path: Column) -> Column:
    return F.upper(F.trim(F.element_at(F.split(_part(path, 2), "-"), 1)))


def sensor_type(path: Column) -> Column:
    return F.element_at(F.split(_part(path, 1), "-"), 1)


def data_type(path: Column) -> Column:
    return F.coalesce(F.try_element_at(F.split(_part(path, 1), "-"), F.lit(2)), F.lit(""))


def participant(path: Column) -> Column:
    """The folder above MasterSynced or Derived, else the file's own folder."""
    of = lambda name: F.regexp_extract(path, rf"([^/]+)/{name}", 1)
    return F.when(path.contains("MasterSynced"), of("MasterSynced")).when(path.contains("Derived"), of("Derived")).otherwise(F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit("")))


def derived_set(path: Column) -> Column:
    """The folder right below Derived; null if there is none."""
    return F.nullif(F.regexp_extract(path, "Derived/([^/]+)", 1), F.lit(""))


def adjacent(path: Column, hours: int) -> Column:
    """The path of the file so many hours later: the hour folders and the name's time stamp both move."""
    folder = F.regexp_extract(path, r"[0-9]{4}/[0-9]{2}/[0-9]{2}/[0-9]{2}", 0)
    stamp = F.regexp_extract(_part(path, 3), r"[0-9]{4}(-[0-9]{2}){5}-[0-9]{3}", 0)
    step = F.make_dt_interval(hours=F.lit(hours))
    moved_folder = F.date_format(F.try_to_timestamp(folder, F.lit("yyyy/MM/dd/HH")).cast("timestamp_ntz") + step, "yyyy/MM/dd/HH")
    moved_stamp = F.date_format(F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd-HH-mm-ss-SSS")).cast("timestamp_ntz") + step, "yyyy-MM-dd-HH-mm-ss-SSS")
    return F.replace(F.replace(path, folder, moved_folder), stamp, moved_stamp)


def valid_name(path: Column) -> Column:
    return F.when(path.rlike(NAME_FORM), "True").otherwise("False")


def valid_folder(path: Column) -> Column:
    return F.when(path.rlike(FOLDER_FORM), "True").otherwise("False")


def header_report(header: Column, kind: Column) -> Column:
    """``True``, or the names of missing columns, each closed by a bar (the label column by none)."""
    tokens = F.split(F.trim(header), ",")
    missing = []
    for place, (name, closed, kinds) in enumerate(HEADER, 1):
        wrong = F.coalesce(F.try_element_at(tokens, F.lit(place)), F.lit("")) != name
        missing.append(F.when(wrong if kinds is None else wrong & kind.isin(*kinds), name + closed).otherwise(""))
    text = F.concat(*missing)
    return F.when(F.size(tokens) < 2, SHORT_HEADER).when(text == "", GOOD).otherwise(text)


def output_path(path: Column, set_name: str, new_type: str | None = None, new_data: str | None = None, compat: bool = True) -> Column:
    """Where a derived file goes. compat replaces a type's text wherever it occurs; otherwise only in the file name."""
    folder, name = F.regexp_extract(path, r"^(.*/)?[^/]*$", 1), base_name(path)
    out = F.when(path.contains("MasterSynced"), F.replace(path, F.lit("MasterSynced"), F.lit(f"Derived/{set_name}")))
    out = out.when(path.contains("Derived"), F.replace(path, derived_set(path), F.lit(set_name)))
    out = out.otherwise(F.concat(folder, F.lit(f"Derived/{set_name}/"), name))

    def swapped(whole: Column, old: Column, new: str) -> Column:
        if compat:
            return F.replace(whole, old, F.lit(new))
        head = F.regexp_extract(whole, r"^(.*/)?[^/]*$", 1)
        return F.concat(head, F.replace(base_name(whole), old, F.lit(new)))

    if new_type is not None:
        out = swapped(out, file_type(path), new_type)
    if new_data is not None:
        out = F.when(data_type(path) != "", swapped(out, data_type(path), new_data)).otherwise(out)
    return out
