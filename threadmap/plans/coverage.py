"""Ribs: further routes where the routes so far leave rows far off, added in rounds until they describe the cloud.

A round takes a few rows of large residual, far from one another, as seeds. All seeds are one job: the
rows about each of them give sums of outer products of residuals, from which a direction across the route
follows, and a polyline through the means of the rows in steps along it; its gain is an aggregation
of how much nearer the rows about the seed get. Ribs that gain enough become routes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, minus, norm, plus_scaled, sqdist
from ..operators.groups import as_row
from ..operators.lookups import spaced_seeds
from ..operators.routes import decomposed, project, segments
from ..sources.tables import save

#: The neighbourhood of a seed: so many local scales, and the share of all rows, whichever is wider.
NEAR_SCALES, NEAR_SHARE, SEED_SPACING = 6.0, 0.12, 4.0
#: Rows of a neighbourhood at least, and places of a rib.
LEAST_ROWS, PLACES = 5, 8
#: Local scales of error that a cloud may keep where no tolerance is given.
TOLERANCE = 3.0


@dataclass
class Covered:
    """The segments with ribs, of which routes from first_rib on are ribs, the ribs (route_id, seed, gain, support, length), and the rounds."""

    segments: DataFrame
    first_rib: int
    ribs: list[dict] = field(default_factory=list)
    history: list[dict] = field(default_factory=list)


def neighbourhoods(rows: DataFrame, seeds: DataFrame, radii: DataFrame) -> DataFrame:
    """seed, row_id, x, residual, residual_norm of rows within each seed's radius (seed, radius); seeds (seed, x, tangent) are a few and go to all tasks."""
    few = seeds.join(radii, "seed").select(F.col("seed").alias("center"), F.struct("x", "radius").alias("c"))
    near = F.filter("all", lambda s: sqdist(F.col("x"), s["c"]["x"]) <= s["c"]["radius"] * s["c"]["radius"])
    each = rows.join(as_row(few, "center", "c")).withColumn("s", F.explode(near))
    return each.select(F.col("s.center").alias("seed"), "row_id", "x", "residual", "residual_norm")


def seed_radii(rows: DataFrame, seeds: DataFrame, scale: float) -> DataFrame:
    """seed, radius: so many local scales, or the distance within which a share of all rows lies (to 1 in 10,000 of the ranks)."""
    few = as_row(seeds.select(F.col("seed").alias("center"), F.col("x").alias("c")), "center", "c")
    away = rows.join(few).select(F.explode(F.transform("all", lambda s: F.struct(s["center"].alias("seed"), F.sqrt(sqdist(F.col("x"), s["c"])).alias("d")))).alias("e"))
    share = F.percentile_approx("e.d", NEAR_SHARE, 10_000)
    return away.groupBy(F.col("e.seed").alias("seed")).agg(F.greatest(F.lit(NEAR_SCALES * scale), share).alias("radius"))


def cross_directions(near: DataFrame, seeds: DataFrame) -> DataFrame:
    """seed, direction: across the seed's tangent, where the residuals about it point to most; from sums of outer products by seed."""
    tangents = {r["seed"]: np.array(r["tangent"], float) for r in seeds.select("seed", "tangent").collect()}  # a few
    shared = near.sparkSession.sparkContext.broadcast(tangents)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for frame in batches:
            for seed, part in frame.groupby("seed"):
                t = shared.value[seed]
                r = np.array(part["residual"].tolist(), float)
                r = r - np.outer(r @ t, t)
                total[seed] = total.get(seed, 0) + r.T @ r
        for seed, m in total.items():
            i, j = np.indices(m.shape).reshape(2, -1)
            yield pd.DataFrame({"seed": seed, "i": i, "j": j, "s": m.ravel()}).astype({"seed": "int32", "i": "int32", "j": "int32"})

    summed = near.select("seed", "residual").mapInPandas(sums, "seed int, i int, j int, s double").groupBy("seed", "i", "j").agg(F.sum("s").alias("s"))

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        d, seed = int(frame["i"].max()) + 1, int(frame["seed"].iloc[0])
        m = np.zeros((d, d))
        m[frame["i"], frame["j"]] = frame["s"]
        t = shared.value[seed]
        axis = np.linalg.eigh(m)[1][:, -1]
        axis = axis - (axis @ t) * t
        if np.linalg.norm(axis) < 1e-12 or not m.any():
            axis = np.eye(d)[np.abs(t).argmin()]
            axis = axis - (axis @ t) * t
        axis = axis / max(np.linalg.norm(axis), 1e-12)
        return pd.DataFrame({"seed": [seed], "direction": [axis * (np.sign(axis[np.abs(axis).argmax()]) or 1.0)]}).astype({"seed": "int32"})

    return summed.groupBy("seed").applyInPandas(solve, "seed int, direction array<double>")  # features squared rows for each seed


def cross_ribs(near: DataFrame, directions: DataFrame, kind: str = "transverse") -> DataFrame:
    """seed, at, c: a polyline of each seed through the means of the rows about it, in even steps along the direction.

    A transverse rib goes as far as the rows farthest on one side and on the other. A parallel one stays
    with the better populated side, and its steps follow the neighbourhood's extent along the tangent (``along``).
    """
    placed = near.join(F.broadcast(directions), "seed")
    signed = placed.withColumn("across", dot(F.col("residual"), F.col("direction"))).withColumn("axis", F.col("direction"))
    if kind == "parallel":
        sides = signed.where("across <> 0").groupBy("seed").agg((F.count_if(F.col("across") > 0) >= F.count_if(F.col("across") < 0)).alias("up"))
        signed = signed.join(F.broadcast(sides), "seed").where((F.col("across") > 0) == F.col("up")).withColumn("across", F.col("along")).withColumn("axis", F.col("tangent"))
    ends = signed.groupBy("seed").agg(F.min("across").alias("low"), F.max("across").alias("high"), F.count("*").alias("n")).where((F.col("n") >= LEAST_ROWS) & (F.col("high") > F.col("low")))
    at = F.least(F.floor((F.col("across") - F.col("low")) / (F.col("high") - F.col("low")) * PLACES), F.lit(PLACES - 1)).cast("int")
    binned = signed.join(F.broadcast(ends), "seed").withColumn("at", at)
    means = binned.select("seed", "at", F.posexplode("x").alias("j", "v")).groupBy("seed", "at", "j").agg(F.avg("v").alias("m"))
    inner = means.groupBy("seed", "at").agg(F.array_sort(F.collect_list(F.struct("j", "m"))).alias("ms")).select("seed", "at", F.transform("ms", lambda m: m["m"]).alias("c"))
    # both ends are the outer means, moved along the axis as far as the farthest rows lie
    outer = binned.groupBy("seed", "at").agg(F.avg("across").alias("mean"), F.first("axis").alias("axis"), F.first("low").alias("low"), F.first("high").alias("high")).join(inner, ["seed", "at"])
    w = Window.partitionBy("seed")
    ends = outer.withColumn("least", F.min("at").over(w)).withColumn("most", F.max("at").over(w))
    tip = lambda to: plus_scaled(F.col("c"), F.col(to) - F.col("mean"), F.col("axis")).alias("c")
    first = ends.where("at = least").select("seed", F.lit(-1).alias("at"), tip("low"))
    last = ends.where("at = most").select("seed", F.lit(PLACES).alias("at"), tip("high"))
    return inner.unionByName(first).unionByName(last)


def rib_gains(near: DataFrame, ribs: DataFrame) -> DataFrame:
    """seed, gain, support, length of the segments of ribs (route_id = seed): how much squared error of the rows about a seed its rib takes away, and of which share of them."""
    few = ribs.groupBy(F.col("route_id").alias("seed")).agg(F.collect_list(F.struct("s", "v")).alias("gs"), F.sum("length").alias("length"))

    def squared(g):
        vv = dot(g["v"], g["v"])
        alpha = F.when(vv <= 1e-24, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(minus(F.col("x"), g["s"]), g["v"]) / vv)))
        return sqdist(F.col("x"), plus_scaled(g["s"], alpha, g["v"]))

    less = F.greatest(F.lit(0.0), F.col("residual_norm") * F.col("residual_norm") - F.array_min(F.transform("gs", squared)))
    met = near.join(F.broadcast(few), "seed").withColumn("less", less)
    return met.groupBy("seed").agg(F.sum("less").alias("gain"), F.avg((F.col("less") > 0).cast("double")).alias("support"), F.max("length").alias("length"))


def coverage_ribs(
    points: DataFrame, segs: DataFrame, scale: float, tolerance: float | None = None, quantile: float = 0.95, rounds: int = 4, seeds: int = 4,
    least_gain: float = 0.0, length_penalty: float = 0.0, rib_penalty: float = 0.0, most_ribs: int | None = None, spacing: float | None = None, kind: str = "transverse",
) -> Covered:
    """Adds ribs to the routes (segments) of standardised points (row_id, x) until the quantile of residuals is within the tolerance.

    A rib's use is its gain and the share of rows that gain, less penalties for its length and for being one; those
    of at most least_gain are left out. It ends at the tolerance, after so many rounds, or where a round adds nothing.
    """
    if kind not in ("transverse", "parallel"):
        raise ValueError(f"ribs are transverse or parallel, not {kind!r}")
    held = save(points.select("row_id", "x"), "covered-rows")
    limit = TOLERANCE * max(scale, 1e-12) if tolerance is None else tolerance
    first = segs.agg(F.max("route_id")).first()[0] + 1
    out = Covered(segs, first)
    for turn in range(rounds + 1):
        rows = save(decomposed(project(held, out.segments)).select("row_id", "x", "tangent", "residual", "residual_norm"), "residuals")
        error, worst = rows.agg(F.percentile_approx("residual_norm", quantile, 10_000), F.max("residual_norm")).first()
        out.history.append({"round": turn, "quantile_error": error, "max_error": worst, "tolerance": limit, "ribs": len(out.ribs)})
        left = None if most_ribs is None else most_ribs - len(out.ribs)
        if turn == rounds or error is None or error <= limit or left == 0:
            break
        chosen = spaced_seeds(rows.where(F.col("residual_norm") > limit), "residual_norm", seeds, spacing if spacing is not None else max(SEED_SPACING * scale, 1e-8))
        at = save(F.broadcast(chosen.select("seed", "row_id")).join(rows, "row_id").select("seed", "x", "tangent"), "rib-seeds")
        near = save(neighbourhoods(rows, at, seed_radii(rows, at, scale)), "rib-rows")
        if kind == "parallel":
            along = F.broadcast(at.select("seed", F.col("x").alias("o"), "tangent"))
            near = near.join(along, "seed").withColumn("along", dot(minus(F.col("x"), F.col("o")), F.col("tangent"))).drop("o")
        ribs = save(segments(cross_ribs(near, cross_directions(near, at), kind).select(F.col("seed").alias("route_id"), "at", "c")), "ribs")
        gains = sorted((r.asDict() for r in rib_gains(near, ribs).collect()), key=lambda r: r["seed"])  # a row for each seed
        for r in gains:
            r["utility"] = r["gain"] + r["support"] - length_penalty * r["length"] - rib_penalty
        good = sorted((r for r in gains if r["gain"] > 0 and r["utility"] > least_gain), key=lambda r: (-r["utility"], r["seed"]))[:left]
        if not good:
            break
        names = {r["seed"]: first + len(out.ribs) + i for i, r in enumerate(good)}
        out.ribs += [{"route_id": names[r["seed"]], "round": turn, **{k: r[k] for k in ("gain", "support", "length", "utility")}} for r in good]
        table = F.broadcast(points.sparkSession.createDataFrame(list(names.items()), "route_id int, name int"))
        new = ribs.join(table, "route_id").withColumn("route_id", F.col("name")).drop("name")
        out.segments = save(out.segments.unionByName(new), "covered-segments")
    return out


def crossings(segs: DataFrame, first_rib: int, reach: float) -> DataFrame:
    """rib, route_id, gap, angle: the routes that come within a reach of the middles of a rib's segments, how near, and the cosine between both there.

    Routes go to all tasks as one row, after a check of their number.
    """
    ribs = segs.where(F.col("route_id") >= first_rib).select(F.col("route_id").alias("rib"), F.col("v").alias("w"), plus_scaled(F.col("s"), F.lit(0.5), F.col("v")).alias("m"))
    few = segs.where(F.col("route_id") < first_rib).select(F.col("route_id").alias("center"), F.struct("s", "v").alias("c"))

    def met(g):
        vv = dot(g["c"]["v"], g["c"]["v"])
        alpha = F.when(vv <= 1e-24, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(minus(F.col("m"), g["c"]["s"]), g["c"]["v"]) / vv)))
        cosine = F.abs(dot(F.col("w"), g["c"]["v"])) / F.greatest(norm(F.col("w")) * F.sqrt(vv), F.lit(1e-12))
        return F.struct(g["center"].alias("route_id"), F.sqrt(sqdist(F.col("m"), plus_scaled(g["c"]["s"], alpha, g["c"]["v"]))).alias("gap"), cosine.alias("angle"))

    each = ribs.join(as_row(few, "center", "c")).select("rib", F.explode(F.filter(F.transform("all", met), lambda s: s["gap"] <= reach)).alias("s"))
    best = each.groupBy("rib", "s.route_id").agg(F.min(F.struct("s.gap", "s.angle")).alias("b"))
    return best.select("rib", "route_id", "b.gap", "b.angle")
