"""Validation, moments and standardisation of clouds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import TINY, dot, minus, plus_scaled


def width(points: DataFrame) -> int:
    """The number of features, from one row."""
    row = points.select(F.size("x").alias("n")).first()
    if row is None or row["n"] < 1:
        raise ValueError("a cloud has a row and a feature at least")
    return row["n"]


def validation(points: DataFrame) -> DataFrame:
    """One row: n, features (least and most), bad: rows with a null, NaN or infinite coordinate."""
    wrong = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return points.agg(
        F.count("*").alias("n"), F.min(F.size("x")).alias("least_features"), F.max(F.size("x")).alias("most_features"),
        F.count_if(F.coalesce(wrong, F.lit(True))).alias("bad"),
    )


def check(points: DataFrame) -> None:
    r = validation(points).first()
    if r["n"] == 0 or r["least_features"] != r["most_features"] or r["least_features"] < 1 or r["bad"]:
        raise ValueError(f"not a cloud of finite rows of one width: {r.asDict()}")


#: Features up to which each has aggregates of its own; wider rows are unrolled instead.
SIDE_BY_SIDE = 16


def moments(points: DataFrame, features: int | None = None) -> DataFrame:
    """One row with mean and scale (population deviation, 1 where it is next to 0), from one pass with map-side sums."""
    d = features or width(points)
    safe = lambda s: F.when(s < TINY, F.lit(1.0)).otherwise(s)
    if d <= SIDE_BY_SIDE:
        at = [F.get("x", F.lit(j)) for j in range(d)]
        one = points.agg(F.array(*map(F.avg, at)).alias("mean"), F.array(*map(F.stddev_pop, at)).alias("deviation"))
        return one.select("mean", F.transform("deviation", safe).alias("scale"))
    each = points.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    row = each.agg(F.array_sort(F.collect_list(F.struct("j", "m", "s"))).alias("all"))  # a struct for each feature
    return row.select(F.transform("all", lambda f: f["m"]).alias("mean"), F.transform("all", lambda f: safe(f["s"])).alias("scale"))


def standardized(points: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """The cloud with x in standard units; of: the moments to use, one row."""
    m = F.broadcast(moments(points) if of is None else of)
    return points.join(m).withColumn("x", F.zip_with(minus(F.col("x"), F.col("mean")), "scale", lambda v, s: v / s)).drop("mean", "scale")


def destandardized(points: DataFrame, of: DataFrame) -> DataFrame:
    return points.join(F.broadcast(of)).withColumn("x", F.zip_with(F.zip_with("x", "scale", lambda v, s: v * s), "mean", lambda v, m: v + m)).drop("mean", "scale")


def covariance(points: DataFrame, features: int | None = None) -> DataFrame:
    """i, j, value: the population covariance, for i <= j, from one pass of sums that are combined on the map side.

    Wide rows are summed as matrices about the mean, a batch at a time, and a task gives one term for each pair.
    """
    d = features or width(points)
    if d > SIDE_BY_SIDE:
        mean = points.sparkSession.sparkContext.broadcast(np.array(moments(points, d).first()["mean"], float))

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            whole, n = np.zeros((d, d)), 0
            for frame in batches:
                for at in range(0, len(frame), 4096):
                    x = np.array(frame["x"].iloc[at : at + 4096].tolist(), float) - mean.value
                    whole, n = whole + x.T @ x, n + len(x)
            i, j = np.triu_indices(d)
            yield pd.DataFrame({"i": i, "j": j, "s": whole[i, j], "n": n}).astype({"n": "int64"})

        every = points.select("x").mapInPandas(sums, "i int, j int, s double, n long")
        return every.groupBy("i", "j").agg((F.sum("s") / F.sum("n")).alias("value"))
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    one = points.agg(*(F.covar_pop(F.get("x", F.lit(i)), F.get("x", F.lit(j))).alias(f"c{i}_{j}") for i, j in pairs))
    return one.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c{i}_{j}").alias("value")) for i, j in pairs))).alias("c")).select("c.*")


def principal_axes(points: DataFrame, k: int = 2) -> tuple[list[float], list[list[float]], list[float]]:
    """Mean, the first k principal directions and their deviations. The covariance, features squared, is all that is collected.

    A direction's largest coordinate is positive, so signs don't hang on the solver.
    """
    d = width(points)
    matrix = np.zeros((d, d))
    for r in covariance(points, d).collect():
        matrix[r["i"], r["j"]] = matrix[r["j"], r["i"]] = r["value"]
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(-values, kind="stable")[:k]
    axes = vectors[:, order].T
    axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    mean = list(moments(points, d).first()["mean"])
    return mean, axes.tolist(), np.sqrt(np.maximum(values[order], 0)).tolist()


#: The second principal deviation over the first up to which a cloud counts as a line.
LINEAR = 0.12


def nearly_linear(points: DataFrame, tolerance: float = LINEAR) -> bool:
    """Whether the second principal deviation is at most the tolerance times the first."""
    _, axes, deviations = principal_axes(points, 2)
    return len(axes) < 2 or deviations[0] <= TINY or deviations[1] / deviations[0] <= tolerance


def line_through(points: DataFrame, tolerance: float = LINEAR) -> tuple[list[float], list[float]] | None:
    """The ends of the principal line's part that the rows stand by, if the cloud is nearly a line of some length."""
    mean, axes, deviations = principal_axes(points, 2)
    if deviations[0] <= TINY or (len(axes) > 1 and deviations[1] / deviations[0] > tolerance):
        return None
    along = dot(minus(F.col("x"), _literal(mean)), _literal(axes[0]))
    low, high = points.agg(F.min(along), F.max(along)).first()
    return tuple([m + t * a for m, a in zip(mean, axes[0])] for t in (low, high))


def _literal(values: list[float]) -> Column:
    return F.array(*map(F.lit, values))


def projected_to_axes(points: DataFrame, k: int = 2) -> DataFrame:
    """The cloud with x as its coordinates on the first k principal axes."""
    mean, axes, _ = principal_axes(points, k)
    centred = minus(F.col("x"), _literal(mean))
    return points.withColumn("x", F.array(*(dot(centred, _literal(a)) for a in axes)))


def projected_to_line(points: DataFrame) -> DataFrame:
    """The cloud with x moved to the nearest place of the first principal line."""
    mean, axes, _ = principal_axes(points, 1)
    center, axis = _literal(mean), _literal(axes[0])
    return points.withColumn("x", plus_scaled(center, dot(minus(F.col("x"), center), axis), axis))
