"""Ordered operators: numbering without one task, lookups along routes, seeds with spacing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import distance, plus_scaled, sqdist
from ..sources.tables import save
from .groups import as_row


def numbered(rows: DataFrame, *by: str) -> DataFrame:
    """Rows with number (from 0) in the order of columns, and whole: how many there are.

    Rows are dealt by ranges of the columns and numbered within each, and the ranges' sizes, a row
    for each, are added up; so no task sorts all rows.
    """
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__part", F.spark_partition_id())
    dealt = save(dealt.withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("__before"), F.sum("n").over(Window.partitionBy()).alias("whole"))
    return dealt.join(F.broadcast(offsets), "__part").withColumn("number", F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")


def tile(number: Column, whole: Column, tiles: int) -> Column:
    """The tile of a number, from 1: tiles of even size, the first ones larger by one where they don't divide the whole."""
    size, larger = F.floor(whole / tiles), whole % tiles
    edge = larger * (size + 1)
    return F.when(number < edge, F.floor(number / (size + 1))).otherwise(larger + F.floor((number - edge) / F.greatest(size, F.lit(1)))).cast("int") + 1


def snapped(centers: DataFrame, points: DataFrame) -> DataFrame:
    """center, row_id, d2: the row nearest to each center (center, c), ties to the least id; the centers must be few."""
    away = F.transform("all", lambda s: F.struct(s["center"].alias("center"), F.round(sqdist(F.col("x"), s["c"]), 9).alias("d2")))
    every = points.join(as_row(centers, "center", "c")).select("row_id", F.explode(away).alias("s"))
    best = every.groupBy(F.col("s.center").alias("center")).agg(F.min(F.struct(F.col("s.d2").alias("d2"), "row_id")).alias("b"))  # combined on the map side
    return best.select("center", "b.row_id", "b.d2")


def interpolated(segs: DataFrame, places: list[float]) -> DataFrame:
    """route_id, place, x, tangent: where a route is at each place (0 to 1) of its length; the first segment that reaches it."""
    asked = F.explode(F.array(*(F.lit(float(p)) for p in places)))
    held = segs.select("*", asked.alias("place")).where((F.col("place") >= F.col("t0")) & (F.col("place") <= F.col("t1")))
    first = held.groupBy("route_id", "place").agg(F.min(F.struct("seg", "s", "v", "t0", "t1")).alias("g"))
    span = F.col("g.t1") - F.col("g.t0")
    alpha = F.when(span > 0, (F.col("place") - F.col("g.t0")) / span).otherwise(0.0)
    size = F.sqrt(F.aggregate("g.v", F.lit(0.0), lambda t, v: t + v * v))
    return first.select("route_id", "place", plus_scaled(F.col("g.s"), alpha, F.col("g.v")).alias("x"), F.transform("g.v", lambda v: F.when(size <= 1e-12, F.lit(0.0)).otherwise(v / size)).alias("tangent"))


def on_grid(position: Column, grid: int) -> tuple[Column, Column]:
    """The last of so many even places from 0 to 1 that isn't beyond a position (the last but one at most), and the share of the way to the next."""
    at = F.least(F.floor(position * (grid - 1)), F.lit(grid - 2))
    return at.cast("int"), position * (grid - 1) - at


def nearest_knot(position: Column, knots: int) -> Column:
    """The nearest of so many even places from 0 to 1; of two the lesser."""
    return F.ceil(position * (knots - 1) - 0.5).cast("int")


def sliding_windows(rows: DataFrame, size: int, step: int, *by: str) -> DataFrame:
    """Rows with window: each window of so many consecutive rows, begun at every step-th row, that is whole."""
    order = numbered(rows, *by)
    first = F.greatest(F.lit(0), F.ceil((F.col("number") - size + 1) / step))
    last = F.least(F.floor(F.col("number") / step), F.floor((F.col("whole") - size) / step))
    return order.where(first <= last).withColumn("window", F.explode(F.sequence(first, last)))


def spaced_seeds(rows: DataFrame, score: str, k: int, spacing: float) -> DataFrame:
    """seed (from 0), row_id, score: k rows at most of largest score, each at least so far from all before it; ties to the least id.

    A round for each seed takes the best of the rows that are left, an aggregation on the map side.
    """
    left, found = rows.select("row_id", "x", F.col(score).alias("score")), []
    for i in range(k):
        best = left.agg(F.max(F.struct("score", (-F.col("row_id")).alias("back"), "x")).alias("b")).first()["b"]
        if best is None:
            break
        found.append((i, -best["back"], best["score"]))
        center = F.array(*map(F.lit, best["x"]))
        left = left.where(distance(F.col("x"), center) >= spacing)
    return rows.sparkSession.createDataFrame(found, "seed int, row_id long, score double")


def farthest_points(points: DataFrame, k: int) -> DataFrame:
    """seed (from 0), row_id, away: the row of least id, then in each round the row farthest from all before it, ties to the least id."""
    found, centers, left = [], [], points.select("row_id", "x")
    for i in range(k):
        if centers:
            away = F.least(*(distance(F.col("x"), F.array(*map(F.lit, c))) for c in centers)) if len(centers) > 1 else distance(F.col("x"), F.array(*map(F.lit, centers[0])))
        else:
            away = F.lit(0.0)
        best = left.agg(F.max(F.struct(F.round(away, 9).alias("away"), (-F.col("row_id")).alias("back"), "x")).alias("b")).first()["b"]
        if best is None or (centers and best["away"] == 0):
            break
        found.append((i, -best["back"], best["away"]))
        centers.append(list(best["x"]))
    return points.sparkSession.createDataFrame(found, "seed int, row_id long, away double")
