"""From the labels of a window to classes: rules over the joined, lower-case label, the first match wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN, TRANSITION = "unknown", "transition"

# Fixed values. A word is a substring that must occur, "!word" one that must not, "=text" the whole label, "a|b" either.
POSTURE = {
    "upright": "walk|stand|run|jog|still|jump|laundry|sweep|shelf|frisbee|stair|vending|elevator|escalator",
    "sitting": "sit|reclin|bik|cycl",
    "lying": "lying",
}
FOUR_CLASSES = {
    "others": "=jumping jacks|laundry|sweep|frisbee|shelf|vend",
    "sedentary": "sit|stand|lying|reclin|elevator|escalator",
    "ambulation": "stair|treadmill|walk",
    "cycling": "bik",
}
ACTIVITY_GROUP = {
    "others": "=jumping jacks|laundry|sweep|frisbee|shelf|vend|bik",
    "sedentary": "sit|stand|reclin|elevator|escalator",
    "ambulation": "stair|treadmill|walk|run",
    "sleep": "lying",
}
INDOOR_OUTDOOR = {
    "outdoor": "outdoor|city|light|escalator|mbta|frisbee|stair|vending|elevator|wait",
    "indoor": "treadmill|jog|run|writ|laundry|shelf|web|lying|reclin|jump|desk|mph|kpm|grade|sweep|sit|still|station",
}
# Predicate (all parts must hold), metabolic equivalent, activity, hand gesture.
DETAILS = (
    ("=jumping jacks", 8.0, "jumping jacks", "jumping jacks"),
    ("sitting & writing", 1.3, "sitting and writing", "writing (dom)"),
    ("stand & writ", 1.8, "standing and writing", "writing (dom)"),
    ("sit & story", 1.5, "sitting and talking", "talking"),
    ("reclin & story", 1.3, "reclining and talking", "talking"),
    ("reclin|sit & text", 1.3, "reclining and using phone", "using phone"),
    ("stand & story & !wait", 1.3, "standing naturally", "talking"),
    ("sit & web", 1.3, "sitting and keyboard typing", "keyboard typing"),
    ("stand & web", 1.8, "standing and keyboard typing", "keyboard typing"),
    ("stair & down", 3.5, "walking down stairs", "free"),
    ("stair & up & phone", 5.0, "walking up stairs and phone talking", "phone talking"),
    ("stair & up", 5.0, "walking up stairs", "free"),
    ("mbta & stand", 1.5, "standing on train", "still"),
    ("mbta & sit", 1.3, "sitting on train", "free"),
    ("bik & outdoor", 6.8, "biking outdoor", "biking"),
    ("bik & stationary", 3.5, "stationary biking", "biking"),
    ("treadmill & 1 & arms", 2.0, "treadmill walking at 1 mph with arms on desk", "arms on desk"),
    ("treadmill & 2 & arms", 2.8, "treadmill walking at 2 mph with arms on desk", "arms on desk"),
    ("treadmill & 3.5 & text & !arms", 4.3, "treadmill walking at 3-3.5 mph and using phone", "using phone"),
    ("treadmill & phone & !arms", 4.0, "treadmill walking at 3-3.5 mph and talking with phone", "phone talking"),
    ("treadmill & bag & !arms", 4.5, "treadmill walking at 3-3.5 mph and carrying a bag", "carrying suitcase"),
    ("treadmill & story & !arms", 4.0, "treadmill walking at 3-3.5 mph talking", "talking"),
    ("treadmill & drink & !arms", 4.0, "treadmill walking at 3-3.5 mph and carrying a drink", "carrying a drink"),
    ("treadmill|walk & 3.5|3 & !arms", 4.0, "treadmill walking at 3-3.5 mph", "free"),
    ("treadmill & 5.5", 10.5, "treadmill running at 5.5 mph 5% grade", "free"),
    ("laundry", 2.0, "standing and folding towels", "folding towels"),
    ("sweep", 3.3, "standing and sweeping", "sweeping"),
    ("frisbee", 3.0, "frisbee", "frisbee"),
    ("shelf & load", 3.5, "standing and shelf reloading or unloading", "shelf reloading or unloading"),
    ("lying", 1.3, "lying on the back", "still"),
    ("elevator & up", 1.5, "elevator up", "free"),
    ("elevator & down", 1.5, "elevator down", "free"),
    ("escalator & up", 1.5, "escalator up", "free"),
    ("escalator & down", 1.5, "escalator down", "free"),
    ("walk & bag & story", 3.8, "self-paced walking and talking with bag", "talking"),
    ("walk & bag", 3.8, "self-paced walking with bag", "free"),
    ("walk & story", 3.8, "self-paced walking and talking", "talking"),
    ("walk & text", 3.8, "self-paced walking and texting", "using phone"),
    ("=walking", 3.8, "self-paced walking", "free"),
    ("outdoor & stand", 1.5, "standing naturally", "free"),
    ("vend", 2.5, "using vending machine", "using vending machine"),
    ("light & stand", 1.5, "standing for stop light", "free"),
    ("=standing", 1.5, "standing naturally", "free"),
    ("sit & wait", 1.3, "sitting naturally", "free"),
    ("=sitting", 1.3, "sitting still", "still"),
    ("sit & still", 1.3, "sitting still", "still"),
    ("=still|=standing", 1.5, "standing naturally", "still"),
)
INTENSITY = ((1.5, "sedentary"), (4.0, "light"), (7.0, "moderate"))
TARGETS = ("posture", "four_classes", "activity_group", "indoor_outdoor", "activity", "activity_intensity", "hand_gesture")


def _holds(label: Column, predicate: str) -> Column:
    out = None
    for part in predicate.split(" & "):
        either = None
        for word in part.split("|"):
            if word.startswith("="):
                one = label == word[1:]
            elif word.startswith("!"):
                one = ~label.contains(word[1:])
            else:
                one = label.contains(word)
            either = one if either is None else either | one
        out = either if out is None else out & either
    return out


def _chain(label: Column, cases: Sequence[tuple[str, object]], default: object) -> Column:
    out = F
    for predicate, value in cases:
        out = out.when(_holds(label, predicate), F.lit(value))
    return out.otherwise(F.lit(default))


def _grouped(label: Column, rules: dict[str, str]) -> Column:
    return _chain(label, [(words, name) for name, words in rules.items()], UNKNOWN)


def met(label: Column) -> Column:
    """Metabolic equivalent of a label; null if no rule fits."""
    return _chain(label, [(p, m) for p, m, _, _ in DETAILS], None)


def intensity(label: Column) -> Column:
    value, out = met(label), F
    out = F.when(value.isNull(), UNKNOWN)
    for most, name in INTENSITY:
        out = out.when(value <= most, name)
    return out.otherwise("vigorous")


def classes(label: Column) -> dict[str, Column]:
    """One column for each target from a joined label."""
    return {
        "posture": _grouped(label, POSTURE),
        "four_classes": _grouped(label, FOUR_CLASSES),
        "activity_group": _grouped(label, ACTIVITY_GROUP),
        "indoor_outdoor": _grouped(label, INDOOR_OUTDOOR),
        "activity": _chain(label, [(p, a) for p, _, a, _ in DETAILS], UNKNOWN),
        "activity_intensity": intensity(label),
        "hand_gesture": _chain(label, [(p, g) for p, _, _, g in DETAILS], UNKNOWN),
    }


def window_labels(spine: DataFrame, overlaps: DataFrame, by: Sequence[str], size: int, clip: bool = False) -> DataFrame:
    """For each window the joined label (distinct names, sorted before they are lowered) and whether an interval is too short.

    As shipped, an interval's whole duration is compared with the window; ``clip`` compares its part within the window.
    """
    start, stop = F.col("start_ms"), F.col("stop_ms")
    own = overlaps.withColumnsRenamed({"start_ms": "_from", "stop_ms": "_to"})
    rows = own.join(spine.select(*by, "start_ms", "stop_ms"), list(by))
    length = F.least("_to", stop) - F.greatest("_from", start) if clip else F.col("_to") - F.col("_from")
    got = rows.groupBy(*by).agg(F.sort_array(F.collect_set("label_name")).alias("_names"), F.min(length).alias("_shortest"))
    label = F.lower(F.trim(F.array_join("_names", ",")))
    out = spine.join(got, list(by), "left")
    return out.select(*spine.columns, label.alias("label"), (F.coalesce(F.col("_shortest") < size, F.lit(False))).alias("short"), F.col("_names"))


def assigned_classes(labelled: DataFrame, targets: Sequence[str] = TARGETS) -> DataFrame:
    """Class columns of labelled windows: ``transition`` with a short interval, ``unknown`` without any."""
    of = classes(F.col("label"))
    return labelled.withColumns({t: F.when(F.col("label").isNull(), UNKNOWN).when(F.col("short"), TRANSITION).otherwise(of[t]) for t in targets})


def mapped_classes(labelled: DataFrame, class_map: DataFrame, key: str, targets: Sequence[str]) -> DataFrame:
    """Classes by lookup: names lowered, sorted and joined by dashes find their row of the map; without one, ``unknown``.

    A key that the map holds twice is an error, as silently choosing a row would be.
    """
    names = F.array_sort(F.array_distinct(F.transform("_names", lambda s: F.lower(F.trim(s)))))
    once = class_map.groupBy(key).agg(F.count("*").alias("_n"), *(F.first(t).alias(t) for t in targets))
    twice = F.raise_error(F.concat(F.lit("class map holds a key twice: "), F.col(key))).cast("string")
    once = once.withColumns({t: F.when(F.col("_n") > 1, twice).otherwise(F.col(t).cast("string")) for t in targets})
    rows = labelled.withColumn("_key", F.array_join(names, "-")).join(once.withColumnRenamed(key, "_key"), "_key", "left")
    return rows.withColumns({t: F.coalesce(t, F.lit(UNKNOWN)) for t in targets}).drop("_key", "_n")
