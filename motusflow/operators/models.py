"""Activity classifiers: scaling, folds, a radial-kernel machine by random Fourier features, metrics, a stored bundle.

The shipped models are support vector machines with a radial kernel. Their exact solution is not distributed, so the kernel is
approximated (Rahimi and Recht 2007) and a linear machine is fitted for each class against the rest: results are approximate.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, LinearSVCModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import fresh

DROPPED = ("unknown", "transition")
#: label column, cost and kernel width of each classifier (fixed values).
CATALOGUE = {
    "MDCAS": ("activity_group", 262.488, 0.173997),
    "POSTURE": ("posture", 262.488, 0.173997),
    "DAILY_ACTIVITY": ("activity", 262.488, 0.173997),
    "HAND_GESTURE": ("hand_gesture", 262.488, 0.173997),
    "ACTIVITY_INTENSITY": ("activity_intensity", 133.513, 0.258716),
    "FOUR_CLASSES": ("four_classes", 262.488, 0.173997),
}


def ranges(rows: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Smallest and largest value of each column over all rows."""
    got = rows.agg(*(f(c).alias(f"{n}_{i}") for i, c in enumerate(columns) for f, n in ((F.min, "a"), (F.max, "z")))).first()
    return {c: (got[f"a_{i}"], got[f"z_{i}"]) for i, c in enumerate(columns)}


def scaled_columns(limits: dict[str, tuple[float, float]]) -> list[Column]:
    """Columns to [-1, 1]; a constant column becomes -1, as its lower end does."""
    wide = lambda a, z: a is not None and z > a
    return [((F.col(c) - F.lit(a)) / F.lit(z - a) * 2 - 1 if wide(a, z) else F.when(F.col(c).isNotNull(), F.lit(-1.0))).alias(c) for c, (a, z) in limits.items()]


def scaled(rows: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    return rows.withColumns(dict(zip(limits, scaled_columns(limits), strict=True)))


def shuffled(rows: DataFrame, seed: int = 0) -> DataFrame:
    """The rows in a random order that depends on the seed and their values alone."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *rows.columns), *rows.columns)


def train_rows(rows: DataFrame, label: str) -> DataFrame:
    """Rows without a missing value and with a real class; taken after the scaler has seen all rows."""
    return rows.na.drop("any").filter(~F.col(label).isin(*DROPPED))


def aligned(features: DataFrame, classes: DataFrame, keys: Sequence[str] = ("pid", "start_ms", "stop_ms")) -> DataFrame:
    """Features and classes of the same windows; an error if a window lacks its counterpart."""
    a, z = features.withColumn("_f", F.lit(1)), classes.withColumn("_c", F.lit(1))
    both = a.join(z, list(keys), "full")
    check = F.when(F.col("_f").isNull() | F.col("_c").isNull(), F.raise_error(F.lit("feature set and class set differ")).cast("int")).otherwise(F.lit(1))
    return both.withColumn("_ok", check).filter("_ok = 1").drop("_f", "_c", "_ok")


def folded(rows: DataFrame, label: str, order: Sequence[Column | str], folds: int = 10) -> DataFrame:
    """``fold``: each class is dealt out evenly in the given order."""
    return rows.withColumn("fold", (F.row_number().over(W.partitionBy(label).orderBy(*order)) - 1) % folds)


def argmax_label(scores: dict[str, str | Column]) -> tuple[Column, Column]:
    """Label and value of the highest score; the first by name on a tie."""
    best = F.array_max(F.array(*(F.struct(F.col(c).alias("p") if isinstance(c, str) else c.alias("p"), F.lit(-i).alias("k"), F.lit(n).alias("label")) for i, (n, c) in enumerate(sorted(scores.items())))))
    return best["label"], best["p"]


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def metrics(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """accuracy and macro_f1 (plain mean over the classes that occur in either column)."""
    pairs = confusion(rows, truth, predicted)
    sides = pairs.select(F.col("truth").alias("label"), "n", F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit"))
    sides = sides.union(pairs.select(F.col("predicted").alias("label"), "n", F.lit(0).cast("long")))
    per = sides.groupBy("label").agg((2.0 * F.sum("hit") / F.sum("n")).alias("f1"), F.sum("hit").alias("hit"))
    total = pairs.agg(F.sum("n").alias("total"))
    return per.agg(F.avg("f1").alias("macro_f1"), F.sum("hit").alias("_hit")).crossJoin(total).select((F.col("_hit") / F.col("total")).alias("accuracy"), "macro_f1")


@dataclass
class Bundle:
    """What is needed to predict: limits of the scaler, the random features, one linear machine for each class."""

    name: str
    label: str
    columns: list[str]
    limits: dict[str, list[float]]
    gamma: float
    classes: list[str]
    width: int = 256
    seed: int = 0
    weights: list[list[float]] = field(default_factory=list)
    intercepts: list[float] = field(default_factory=list)

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "bundle string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Bundle:
        return cls(**json.loads(spark.read.text(path, wholetext=True).first()[0]))

    def features(self):
        """Random Fourier features of a matrix of scaled rows, as a function."""
        rng = np.random.default_rng(self.seed)
        w = rng.normal(0, np.sqrt(2 * self.gamma), (self.width, len(self.columns)))
        shift, scale = rng.uniform(0, 2 * np.pi, self.width), float(np.sqrt(2 / self.width))
        return lambda x: np.cos(x @ w.T + shift) * scale

    def mapped(self, rows: DataFrame) -> DataFrame:
        """``_phi``: random Fourier features of the scaled columns, one matrix product an Arrow batch."""
        of = self.features()

        @F.pandas_udf("array<double>")
        def phi(x: pd.Series) -> pd.Series:
            return pd.Series(list(of(np.stack(x.to_list()))) if len(x) else [], dtype=object)

        return rows.withColumn("_phi", phi(F.array(*scaled_columns({c: tuple(v) for c, v in self.limits.items()}))))

    def predict(self, rows: DataFrame) -> DataFrame:
        """<NAME>_PREDICTION and <NAME>_PREDICTION_PROB for rows without a missing feature; the first class by name on a tie.

        All machines are one matrix product an Arrow batch.
        """
        name, place = self.name, fresh(rows, "p")
        phi = self.features()
        weights, intercepts = np.array(self.weights), np.array(self.intercepts)

        @F.pandas_udf("array<double>")
        def shares(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            s = 1 / (1 + np.exp(-(phi(np.stack(x.to_list())) @ weights.T + intercepts)))
            return pd.Series(list(s / s.sum(1, keepdims=True)), dtype=object)

        got = rows.na.drop("any", subset=self.columns).withColumn(place, shares(F.array(*scaled_columns({c: tuple(v) for c, v in self.limits.items()}))))
        label = F.element_at(F.array(*(F.lit(c) for c in self.classes)), F.array_position(place, F.array_max(place)).cast("int"))
        return got.select(*rows.columns, label.alias(f"{name}_PREDICTION"), F.array_max(place).alias(f"{name}_PREDICTION_PROB"))


def train(rows: DataFrame, columns: Sequence[str], name: str = "MDCAS", label: str | None = None, cost: float | None = None, gamma: float | None = None, width: int = 256, seed: int = 0, iterations: int = 100, balanced: bool = False) -> Bundle:
    """Fit a classifier: limits over all rows, then real classes only, then one machine for each class.

    ``balanced`` weighs a row by the inverse of its class's share.
    """
    own = CATALOGUE.get(name, (label, 262.488, 0.173997))
    label, cost, gamma = label or own[0], cost or own[1], gamma or own[2]
    limits = {c: list(v) for c, v in ranges(rows, columns).items()}
    rows = train_rows(rows.select(*columns, label), label)
    sizes = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}  # a row a class
    classes = sorted(sizes)
    share = {c: sum(sizes.values()) / (len(sizes) * k) if balanced else 1.0 for c, k in sizes.items()}
    weight = F.element_at(F.create_map(*(F.lit(x) for c in classes for x in (c, share[c]))), F.col(label)) if classes else F.lit(1.0)
    bundle = Bundle(name, label, list(columns), limits, gamma, classes, width, seed)
    held = bundle.mapped(rows).select(array_to_vector("_phi").alias("features"), label, weight.alias("weight")).persist()
    n = held.count()
    for c in classes:
        side = held.withColumn("label", (F.col(label) == c).cast("double"))
        if len(classes) == 1:
            bundle.weights.append([0.0] * width)
            bundle.intercepts.append(1.0)
            continue
        model: LinearSVCModel = LinearSVC(maxIter=iterations, regParam=1 / (cost * max(n, 1)), tol=1e-5, standardization=False, weightCol="weight").fit(side)
        bundle.weights.append(model.coefficients.toArray().tolist())
        bundle.intercepts.append(float(model.intercept))
    held.unpersist()
    return bundle


def cross_validated(rows: DataFrame, columns: Sequence[str], label: str, order: Sequence[str], folds: int = 10, **kwargs) -> DataFrame:
    """fold, accuracy, macro_f1 of stratified folds; each model is fitted without its fold."""
    dealt = folded(rows, label, order, folds).persist()
    out = None
    for k in range(folds):
        bundle = train(dealt.filter(F.col("fold") != k), columns, name="CV", label=label, **kwargs)
        one = metrics(bundle.predict(dealt.filter(F.col("fold") == k)), label, "CV_PREDICTION").withColumn("fold", F.lit(k))
        out = one if out is None else out.union(one)
    return out


def searched(rows: DataFrame, columns: Sequence[str], label: str, order: Sequence[str], tries: int = 20, folds: int = 5, seed: int = 0, **kwargs) -> tuple[float, float, bool]:
    """Cost, kernel width and whether classes are balanced, with the best mean macro F1 among random ones (exponential, means 100 and 0.1)."""
    rng = np.random.default_rng(seed)
    best = (-1.0, 0.0, 0.0, False)
    for _ in range(tries):
        cost, gamma, balanced = rng.exponential(100) + 1e-3, rng.exponential(0.1) + 1e-4, bool(rng.integers(2))
        f1 = cross_validated(rows, columns, label, order, folds, cost=cost, gamma=gamma, balanced=balanced, **kwargs).agg(F.avg("macro_f1")).first()[0]
        best = max(best, (f1 or 0.0, cost, gamma, balanced))
    return best[1:]


__all__ = ["Bundle", "CATALOGUE", "aligned", "argmax_label", "confusion", "cross_validated", "folded", "metrics", "ranges", "scaled", "scaled_columns", "searched", "shuffled", "train", "train_rows"]
