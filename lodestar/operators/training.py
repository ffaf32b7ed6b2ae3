"""Labels, negatives, folds, the pair classifier, calibration and the cascade."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def label_pairs(cand: DataFrame, truth: DataFrame) -> DataFrame:
    known = truth.select("s1_id", "vendor_id", F.lit(1).alias("y")).distinct()
    return cand.join(known, ["s1_id", "vendor_id"], "left").withColumn("y", F.coalesce("y", F.lit(0)))


def _drawn(seed: int, *keys: str) -> Column:
    """A seeded hexadecimal draw for a row, the same in any engine that has md5."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *keys))


def hard_negatives(labelled: DataFrame, per_positive: int = 10, seed: int = 42) -> DataFrame:
    """All positives and, per entity, ``per_positive`` negatives for each positive (for one, if it has none), by a seeded hash."""
    w = Window.partitionBy("s1_id", "y").orderBy(_drawn(seed, "s1_id", "vendor_id"), "vendor_id")
    wanted = F.greatest(F.lit(1), F.sum("y").over(Window.partitionBy("s1_id"))) * per_positive
    return labelled.withColumns({"_r": F.row_number().over(w), "_n": wanted}).where("y = 1 or _r <= _n").drop("_r", "_n")


def stratified_negatives(labelled: DataFrame, per_positive: int = 10, seed: int = 42, stratum: str = "country") -> DataFrame:
    """All positives, and in each stratum negatives at the rate that gives ``per_positive`` for each of its positives, by a seeded draw of each pair.

    Rates are one row a stratum; pairs are decided where they stand.
    """
    rates = labelled.groupBy(stratum).agg((per_positive * F.sum("y") / F.greatest(F.lit(1), F.count_if(F.col("y") == 0))).alias("_rate"))
    draw = F.conv(F.substring(_drawn(seed, "s1_id", "vendor_id"), 1, 8), 16, 10).cast("long") / F.lit(16.0**8)
    return labelled.join(rates, stratum).where((F.col("y") == 1) | (draw < F.col("_rate"))).drop("_rate")


def fold(key: str = "s1_id", folds: int = 5, seed: int = 42) -> Column:
    """The fold of an entity: all its pairs fall into one."""
    return F.pmod(F.conv(F.substring(_drawn(seed, key), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")


def fit(train: DataFrame, features: list[str], label: str = "y", kind: str = "gbt", seed: int = 42, **options):
    """A function DataFrame -> DataFrame that adds p."""
    data = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep")
    model = (GBTClassifier if kind == "gbt" else LogisticRegression)(featuresCol="_x", labelCol=label, **({"seed": seed} if kind == "gbt" else {}), **options).fit(data.transform(train))
    return lambda df: model.transform(data.transform(df)).withColumn("p", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")


def calibrate(held_out: DataFrame, p: str = "p", label: str = "y") -> Callable[[DataFrame], DataFrame]:
    """An isotonic fit on a held-out fold; the function it returns adds calibrated."""
    data = VectorAssembler(inputCols=[p], outputCol="_p")
    model = IsotonicRegression(featuresCol="_p", labelCol=label, predictionCol="calibrated").fit(data.transform(held_out.withColumn(label, F.col(label).cast("double"))))
    return lambda df: model.transform(data.transform(df)).drop("_p")


def ensemble(*ps: str) -> Column:
    return sum((F.col(p) for p in ps), F.lit(0.0)) / len(ps)


def ablation(score: Callable[[list[str]], float], families: dict[str, list[str]]) -> list[dict]:
    """The score with all feature families, and without each. score: fits and scores on the named features; the loop is over configured families, not rows."""
    full = score([f for fs in families.values() for f in fs])
    rows = [{"left_out": None, "score": full, "delta": 0.0}]
    for name in families:
        s = score([f for other, fs in families.items() if other != name for f in fs])
        rows.append({"left_out": name, "score": s, "delta": s - full})
    return rows


def cascade(cand: DataFrame, cheap: Column, keep: int = 30) -> DataFrame:
    """The ``keep`` best candidates of each entity by the cheap score, which costly features are then made for."""
    w = Window.partitionBy("s1_id").orderBy(F.col("cheap").desc(), "vendor_id")
    return cand.withColumn("cheap", cheap).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)
