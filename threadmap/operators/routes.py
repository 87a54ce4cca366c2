"""Routes: polylines as segment tables, projection of rows onto them, and what is measured along them.

segments: route_id, seg, s and v (start and direction, array<double>), t0, t1 (place on the route
at both ends, 0 to 1), closed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.vectors import distance, dot, minus, norm, plus_scaled, sqdist
from .neighbors import DUPLICATE

#: Decimals of squared distances that are compared, so ties at shared vertices go to the first route and segment.
TIE_DIGITS = 9
#: For each feature and unit of squared length, how far rounding alone may part squared distances. Such ones tie even if they round to apart decimals.
TIE_SLACK = float(np.finfo(float).eps)
MOST_SEGMENTS = 50_000
#: Vertices of a route that are compared with another route at a time, about.
VERTICES_AT_ONCE = 256


def segments(vertices: DataFrame, closed: bool = False) -> DataFrame:
    """The segments of polylines (route_id, at, c): consecutive vertices, and last to first where closed.

    Places are arc lengths over the route's length where open and even steps where closed.
    """
    w = Window.partitionBy("route_id").orderBy("at")
    after = F.lead("c").over(w)
    if closed:
        after = F.coalesce(after, F.first("c").over(w))
    steps = vertices.select("route_id", (F.row_number().over(w) - 1).alias("seg"), F.col("c").alias("s"), after.alias("e")).where("e IS NOT NULL")
    steps = steps.select("route_id", "seg", "s", minus(F.col("e"), F.col("s")).alias("v")).withColumn("length", norm(F.col("v")))
    so_far, whole = Window.partitionBy("route_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("route_id")
    if closed:
        n = F.count("*").over(whole)
        t0, t1 = F.col("seg") / n, (F.col("seg") + 1) / n
    else:
        size = F.sum("length").over(whole)
        t1 = F.when(size > 0, F.sum("length").over(so_far) / size).otherwise(0.0)
        t0 = F.when(size > 0, (F.sum("length").over(so_far) - F.col("length")) / size).otherwise(0.0)
    return steps.select("route_id", "seg", "s", "v", t0.alias("t0"), t1.alias("t1"), F.lit(closed).alias("closed"), "length")


def arc_lengths(vertices: DataFrame) -> DataFrame:
    """route_id, at, arc: the length of the polyline up to each vertex."""
    w = Window.partitionBy("route_id").orderBy("at")
    step = F.coalesce(distance(F.col("c"), F.lag("c").over(w)), F.lit(0.0))
    stepped = vertices.select("route_id", "at", step.alias("step"))
    return stepped.select("route_id", "at", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("arc"))


def _few(segs: DataFrame) -> None:
    if segs.limit(MOST_SEGMENTS + 1).count() > MOST_SEGMENTS:
        raise ValueError(f"more than {MOST_SEGMENTS} segments")


def project(points: DataFrame, segs: DataFrame) -> DataFrame:
    """points with route_id, seg, alpha, position, d2, projected and tangent of the nearest place on the routes.

    The segments, checked to be few, are one broadcast row; a row's distances are an array in the
    JVM, so rows are neither multiplied nor shuffled. Of segments whose distances differ by rounding alone the first one is taken.
    """
    _few(segs)
    table = F.broadcast(segs.agg(F.array_sort(F.collect_list(F.struct("route_id", "seg", "s", "v", "t0", "t1"))).alias("all")))
    of = {f.name: f.dataType.simpleString() for f in table.schema["all"].dataType.elementType}
    best_of = f"struct<key:double,route_id:{of['route_id']},seg:{of['seg']},alpha:double,d2:double,g:struct<{','.join(f'{n}:{kind}' for n, kind in of.items())}>>"

    def place(g):
        vv = dot(g["v"], g["v"])
        along = dot(minus(F.col("x"), g["s"]), g["v"])
        alpha = F.when(vv <= DUPLICATE, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), along / vv)))
        return F.struct(g.alias("g"), alpha.alias("alpha"))

    def measured(p):
        d2 = sqdist(F.col("x"), plus_scaled(p["g"]["s"], p["alpha"], p["g"]["v"]))
        return F.struct(F.round(d2, TIE_DIGITS).alias("key"), p["g"]["route_id"].alias("route_id"), p["g"]["seg"].alias("seg"), p["alpha"].alias("alpha"), d2.alias("d2"), p["g"].alias("g"))

    def nearer(b, m):
        apart = TIE_SLACK * (F.size("x") + 4) * (dot(F.col("x"), F.col("x")) + b["d2"])
        return F.when(b.isNull() | ((m["key"] < b["key"]) & (m["d2"] < b["d2"] - apart)), m).otherwise(b)

    best = F.aggregate(F.transform(F.transform("all", place), measured), F.lit(None).cast(best_of), nearer)
    found = points.join(table).withColumn("b", best)
    position = F.col("b.g.t0") + F.col("b.alpha") * (F.col("b.g.t1") - F.col("b.g.t0"))
    length = norm(F.col("b.g.v"))
    tangent = F.transform("b.g.v", lambda u: F.when(length <= 1e-12, F.lit(0.0)).otherwise(u / length))
    return found.select(
        *points.columns, "b.route_id", "b.seg", "b.alpha", position.alias("position"), "b.d2",
        plus_scaled(F.col("b.g.s"), F.col("b.alpha"), F.col("b.g.v")).alias("projected"), tangent.alias("tangent"),
    )


def project_batches(points: DataFrame, segs: DataFrame) -> DataFrame:
    """row_id, route_id, seg, alpha, position, d2: as ``project``, a batch at a time in numpy, for wide clouds and streams."""
    _few(segs)
    listed = sorted(segs.collect(), key=lambda r: (r["route_id"], r["seg"]))
    arrays = [np.array([r[c] for r in listed], float) for c in ("s", "v", "t0", "t1")]
    names = np.array([(r["route_id"], r["seg"]) for r in listed])
    shared = points.sparkSession.sparkContext.broadcast((*arrays, names))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, v, t0, t1, names = shared.value
        vv = (v * v).sum(1)
        for frame in batches:
            for at in range(0, len(frame), 1024):
                part = frame.iloc[at : at + 1024]
                x = np.array(part["x"].tolist(), float)
                alpha = np.clip((x @ v.T - (s * v).sum(1)) / np.where(vv <= DUPLICATE, 1, vv), 0, 1) * (vv > DUPLICATE)
                d2 = np.zeros_like(alpha)
                for j in range(x.shape[1]):
                    d2 += (x[:, j][:, None] - s[:, j] - alpha * v[:, j]) ** 2
                least = d2.min(1)
                apart = TIE_SLACK * (x.shape[1] + 4) * ((x * x).sum(1) + least)
                best = ((np.round(d2, TIE_DIGITS) <= np.round(least, TIE_DIGITS)[:, None]) | (d2 <= (least + apart)[:, None])).argmax(1)
                rows = np.arange(len(x))
                a = alpha[rows, best]
                yield pd.DataFrame({
                    "row_id": part["row_id"], "route_id": names[best, 0], "seg": names[best, 1], "alpha": a,
                    "position": t0[best] + a * (t1 - t0)[best], "d2": d2[rows, best],
                })

    return points.select("row_id", "x").mapInPandas(run, "row_id long, route_id int, seg int, alpha double, position double, d2 double")


def decomposed(projections: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """projections with residual and residual_norm; of: moments, one row, to go back to original units first."""
    if of is not None:
        back = lambda c: F.zip_with(F.zip_with(c, "scale", lambda v, s: v * s), "mean", lambda v, m: v + m)
        projections = projections.join(F.broadcast(of)).withColumn("x", back("x")).withColumn("projected", back("projected")).drop("mean", "scale")
    residual = minus(F.col("x"), F.col("projected"))
    return projections.withColumn("residual", residual).withColumn("residual_norm", norm(F.col("residual")))


def kernel_covariance(rows: DataFrame, grid: list[float], bandwidth: float, dimensions: int, closed: bool = False) -> DataFrame:
    """route_id, g, i, j, value: at each place of the grid the covariance of residuals, weighed by a Gaussian of the place.

    Weights are taken relative to the nearest row's, and sums are combined on the map side, a row of
    the cloud giving each grid place of its route one term.
    """
    places = F.array(*(F.struct(F.lit(i).alias("g"), F.lit(float(t)).alias("t")) for i, t in enumerate(grid)))
    away = F.abs(F.col("position") - F.col("p.t"))
    away = F.least(away, 1 - away) if closed else away
    spread = rows.select("route_id", "position", "residual", F.explode(places).alias("p")).select("route_id", F.col("p.g").alias("g"), away.alias("away"), "residual")
    nearest = spread.groupBy("route_id", "g").agg(F.min("away").alias("nearest"))
    weighed = spread.join(F.broadcast(nearest), ["route_id", "g"]).withColumn("w", F.exp(-0.5 * F.pow((F.col("away") - F.col("nearest")) / bandwidth, 2)))
    pairs = [(i, j) for i in range(dimensions) for j in range(i, dimensions)]
    r = lambda i: F.get("residual", F.lit(i))
    sums = weighed.groupBy("route_id", "g").agg(*((F.sum(F.col("w") * r(i) * r(j)) / F.sum("w")).alias(f"c{i}_{j}") for i, j in pairs))
    listed = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c{i}_{j}").alias("value")) for i, j in pairs))
    return sums.select("route_id", "g", F.explode(listed).alias("c")).select("route_id", "g", "c.*")


def residual_axes(covariances: DataFrame, r: int) -> DataFrame:
    """route_id, g, axes, values: the first r eigenvectors of each grid place, largest coordinate positive."""
    schema = "route_id int, g int, axes array<array<double>>, values array<double>"

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        n = int(frame["j"].max()) + 1
        m = np.zeros((n, n))
        m[frame["i"], frame["j"]] = m[frame["j"], frame["i"]] = frame["value"]
        values, vectors = np.linalg.eigh(m)
        order = np.argsort(-values, kind="stable")[:r]
        axes = vectors[:, order].T
        axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
        return pd.DataFrame({"route_id": [frame["route_id"].iloc[0]], "g": [frame["g"].iloc[0]], "axes": [axes.tolist()], "values": [values[order].tolist()]})

    return covariances.groupBy("route_id", "g").applyInPandas(solve, schema)


def coverage(rows: DataFrame, q: float = 0.95) -> DataFrame:
    """One row: the quantile, the median and the mean square of residual norms."""
    return rows.agg(
        F.percentile("residual_norm", q).alias("quantile"), F.percentile("residual_norm", 0.5).alias("median"), F.avg(F.pow("residual_norm", F.lit(2))).alias("mean_square")
    )


def worst_rows(rows: DataFrame, n: int) -> DataFrame:
    """The n rows that the routes describe worst, ties to the least id: a report of the first n."""
    return rows.orderBy(F.desc(F.round("residual_norm", TIE_DIGITS)), "row_id").limit(n)


def directed_distances(a: DataFrame, b: DataFrame) -> DataFrame:
    """a_route, b_route, d: for each vertex of routes a its distance to routes b (both route_id, at, c); b must be few."""
    _few(b)

    @pandas_udf("array<double>")
    def nearest(xs: pd.Series, cs: pd.Series) -> pd.Series:
        out = []
        for x, c in zip(xs, cs):
            x, c = (np.array([np.asarray(r, float) for r in m]) for m in (x, c))
            d2 = np.zeros((len(x), len(c)))
            for j in range(x.shape[1]):
                d2 += (x[:, j, None] - c[None, :, j]) ** 2
            out.append(np.sqrt(d2.min(1)))
        return pd.Series(out)

    table = F.broadcast(b.groupBy(F.col("route_id").alias("b_route")).agg(F.collect_list("c").alias("cs")))
    some = a.groupBy(F.col("route_id").alias("a_route"), F.floor(F.col("at") / VERTICES_AT_ONCE).alias("part")).agg(F.collect_list("c").alias("xs"))
    spread = some.repartition(a.sparkSession.sparkContext.defaultParallelism, "a_route", "part")  # few rows, of much work each
    return spread.join(table).select("a_route", "b_route", F.explode(nearest("xs", "cs")).alias("d"))


def route_distance(a: DataFrame, b: DataFrame, q: float = 0.9) -> DataFrame:
    """a_route, b_route, distance: the larger of the two directed distances' quantiles."""
    there = directed_distances(a, b).groupBy("a_route", "b_route").agg(F.percentile("d", q).alias("p"))
    back = directed_distances(b, a).groupBy(F.col("b_route").alias("a_route"), F.col("a_route").alias("b_route")).agg(F.percentile("d", q).alias("o"))
    return there.join(back, ["a_route", "b_route"]).select("a_route", "b_route", F.greatest("p", "o").alias("distance"))


def support(hits: DataFrame, key: str, hit: str, least: int = 2) -> DataFrame:
    """key, support: the mean of hits, null where fewer than that were tried."""
    return hits.groupBy(key).agg(F.when(F.count(hit) >= least, F.avg(F.col(hit).cast("double"))).alias("support"), F.count(hit).alias("tries"))
