"""Directions about rows and routes: local tangents, normal frames, residual coordinates.

A row's residual is described in the plane that is normal to its route: the frame of a tangent
is fixed by the tangent alone, so a row's coordinates don't hang on the batch that it is in.
Axes of the residuals are fitted for each place of a grid along a route, and looked up there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.vectors import tangent_inconsistency
from .cloud import SIDE_BY_SIDE
from .routes import kernel_covariance, residual_axes

#: Lengths below these count as zero.
NO_TANGENT, NO_DIRECTION = 1e-12, 1e-10
#: Numbers of a model of residual axes that are sent to all tasks, at most.
MOST_NUMBERS = 20_000_000


def normal_frame(tangent: np.ndarray) -> np.ndarray:
    """An orthonormal basis (features, features - 1) of what is normal to the tangent: the axes in order, made orthogonal.

    A vector's largest coordinate is positive. A tangent of no length counts as the first axis.
    """
    d = len(tangent)
    size = np.linalg.norm(tangent)
    basis = [tangent / size if size >= NO_TANGENT else np.eye(d)[0]]
    for axis in np.eye(d):
        if len(basis) == d:
            break
        left = axis - np.array(basis).T @ (np.array(basis) @ axis)
        size = np.linalg.norm(left)
        if size >= NO_DIRECTION:
            left /= size
            basis.append(left * np.sign(left[np.abs(left).argmax()]))
    return np.array(basis[1:]).T.reshape(d, -1)


def _with(rows: DataFrame, *names: str) -> StructType:
    return StructType([*rows.schema.fields, *(StructField(n, ArrayType(DoubleType())) for n in names)])


def _rows(column) -> np.ndarray:
    return np.array(column.tolist(), float)


def _frames(frame: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each distinct tangent of a batch the places of its rows, and its frame."""
    distinct, which = np.unique(_rows(frame["tangent"]), axis=0, return_inverse=True)
    for i, tangent in enumerate(distinct):
        yield np.flatnonzero(which.ravel() == i), normal_frame(tangent)


def normal_coordinates(rows: DataFrame) -> DataFrame:
    """Rows (residual, tangent, ...) with normal: the residual's coordinates in the frame of the tangent."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if len(frame):
                residual = _rows(frame["residual"])
                out = np.zeros((len(frame), residual.shape[1] - 1))
                for at, basis in _frames(frame):
                    out[at] = residual[at] @ basis
                yield frame.assign(normal=list(out))

    return rows.mapInPandas(run, _with(rows, "normal"))


def fitted_axes(rows: DataFrame, grid: list[float], bandwidth: float, r: int, dimensions: int, closed: bool = False) -> DataFrame:
    """route_id, g, axes, values: at each place of the grid the first r axes of normal coordinates, of which there are so many."""
    own = rows.select("route_id", "position", F.col("normal").alias("residual"))
    covariances = kernel_covariance(own, grid, bandwidth, dimensions, closed) if dimensions <= SIDE_BY_SIDE else wide_kernel_covariance(own, grid, bandwidth, closed)
    return residual_axes(covariances, min(r, dimensions))


def wide_kernel_covariance(rows: DataFrame, grid: list[float], bandwidth: float, closed: bool = False) -> DataFrame:
    """As ``kernel_covariance``, for residuals of many coordinates: each task sums matrices by route and place of the grid.

    A task holds a matrix for each of them; the nearest row's distance to each place is found first.
    """
    places = np.array(grid, float)
    gap = lambda p: np.minimum(p, 1 - p) if closed else p

    def least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for route, part in frame.groupby("route_id"):
                yield pd.DataFrame({"route_id": np.full(len(places), route, np.int32), "g": np.arange(len(places), dtype=np.int32), "away": gap(np.abs(part["position"].to_numpy()[:, None] - places)).min(0)})

    nearest = rows.select("route_id", "position").mapInPandas(least, "route_id int, g int, away double").groupBy("route_id", "g").agg(F.min("away").alias("away"))
    offsets: dict[int, np.ndarray] = {}
    for r in nearest.toLocalIterator():  # a row for each route and place
        offsets.setdefault(r["route_id"], np.zeros(len(places)))[r["g"]] = r["away"]
    shared = rows.sparkSession.sparkContext.broadcast(offsets)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, int], tuple[np.ndarray, float]] = {}
        for frame in batches:
            for route, part in frame.groupby("route_id"):
                x = _rows(part["residual"])
                w = np.exp(-0.5 * ((gap(np.abs(part["position"].to_numpy()[:, None] - places)) - shared.value[route]) / bandwidth) ** 2)
                for g in range(len(places)):
                    m, s = total.get((route, g), (0.0, 0.0))
                    total[route, g] = m + (x * w[:, g, None]).T @ x, s + float(w[:, g].sum())
        for (route, g), (m, s) in total.items():
            i, j = np.triu_indices(len(m))
            yield pd.DataFrame({"route_id": route, "g": g, "i": i, "j": j, "s": m[i, j], "w": s}).astype({c: "int32" for c in ("route_id", "g", "i", "j")})

    summed = rows.select("route_id", "position", "residual").mapInPandas(sums, "route_id int, g int, i int, j int, s double, w double")
    return summed.groupBy("route_id", "g", "i", "j").agg((F.sum("s") / F.sum("w")).alias("value"))


def residual_coordinates(rows: DataFrame, axes: DataFrame, grid: list[float]) -> DataFrame:
    """Rows (route_id, position, projected, residual, tangent, normal) with residual_coordinates, reconstructed and unexplained_residual.

    The axes, checked to be few, go to all tasks. A row takes those of the last place of the grid
    that isn't beyond its position. A route without axes has no coordinates there.
    """
    listed = axes.select("route_id", "g", "axes").limit(100_001).collect()
    if len(listed) > 100_000 or sum(len(r["axes"]) * len(r["axes"][0]) for r in listed) > MOST_NUMBERS:
        raise ValueError("too many residual axes")
    table = {(r["route_id"], r["g"]): np.array(r["axes"], float) for r in listed}
    shared = rows.sparkSession.sparkContext.broadcast((table, np.array(grid, float)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, grid = shared.value
        for frame in batches:
            if not len(frame):
                continue
            normal, residual, projected = (_rows(frame[c]) for c in ("normal", "residual", "projected"))
            place = np.clip(np.searchsorted(grid, frame["position"].to_numpy(), "right") - 1, 0, len(grid) - 1)
            coordinates: list = [np.zeros(0)] * len(frame)
            told = np.zeros_like(normal)
            keys = pd.Series(list(zip(frame["route_id"], place.tolist())))
            for key, at in keys.groupby(keys).indices.items():
                if key in table:
                    c = normal[at] @ table[key].T
                    told[at] = c @ table[key]
                    for i, v in zip(at.tolist(), c):
                        coordinates[i] = v
            back = np.zeros_like(residual)
            for at, basis in _frames(frame):
                back[at] = told[at] @ basis.T
            yield frame.assign(residual_coordinates=coordinates, reconstructed=list(projected + back), unexplained_residual=list(residual - back))

    names = ("residual_coordinates", "reconstructed", "unexplained_residual")
    return rows.mapInPandas(run, _with(rows, *names)).withColumn(
        "unexplained_residual_norm", F.sqrt(F.aggregate("unexplained_residual", F.lit(0.0), lambda t, v: t + v * v))
    )


def local_tangents(points: DataFrame, neighbors: DataFrame) -> DataFrame:
    """row_id, tangent: the principal direction of each row's neighbours (i, j, ...) about the row, largest coordinate positive.

    A row gathers its neighbours alone, whose number is that of the knn join.
    """
    near = neighbors.select("i", "j").join(points.select(F.col("row_id").alias("j"), F.col("x").alias("y")), "j")
    centred = near.join(points.select(F.col("row_id").alias("i"), "x"), "i").select("i", F.zip_with("y", "x", lambda p, q: p - q).alias("v"))
    grouped = centred.groupBy(F.col("i").alias("row_id")).agg(F.collect_list("v").alias("vs"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for vs in frame["vs"]:
                m = np.array([np.asarray(v, float) for v in vs])
                values, vectors = np.linalg.eigh(m.T @ m)
                axis = vectors[:, -1] if len(m) > 1 and values[-1] > NO_TANGENT**2 else np.zeros(m.shape[1])
                out.append(axis * (np.sign(axis[np.abs(axis).argmax()]) or 1.0))
            yield pd.DataFrame({"row_id": frame["row_id"], "tangent": out})

    return grouped.mapInPandas(solve, "row_id long, tangent array<double>")


def edge_costs(edges: DataFrame, tangents: DataFrame, length_weight: float = 1.0, tangent_weight: float = 0.5, density_weight: float = 0.25) -> DataFrame:
    """Edges (src, dst, length, density) with cost: the weighed sum of length over the median, bend, and sparseness."""
    a = tangents.select(F.col("row_id").alias("src"), F.col("tangent").alias("ta"))
    b = tangents.select(F.col("row_id").alias("dst"), F.col("tangent").alias("tb"))
    usual = F.broadcast(edges.agg(F.greatest(F.percentile("length", 0.5), F.lit(NO_TANGENT)).alias("usual")))
    cost = length_weight * F.col("length") / F.col("usual") + tangent_weight * tangent_inconsistency(F.col("ta"), F.col("tb")) + density_weight / F.greatest(F.col("density"), F.lit(1e-6))
    return edges.join(a, "src").join(b, "dst").join(usual).withColumn("cost", F.greatest(cost, F.lit(1e-8))).drop("ta", "tb", "usual")


def location_dispersion(locations: DataFrame, key: str) -> DataFrame:
    """key, dispersion: the root mean square distance of a key's locations (x) to their mean; NaN for a single one."""
    each = locations.select(key, F.posexplode("x").alias("j", "v")).groupBy(key, "j").agg(F.var_pop("v").alias("s"), F.count("*").alias("n"))
    whole = each.groupBy(key).agg(F.sqrt(F.sum("s")).alias("d"), F.max("n").alias("n"))
    return whole.select(key, F.when(F.col("n") > 1, F.col("d")).otherwise(F.lit(float("nan"))).alias("dispersion"))


def cross_sections(rows: DataFrame, places: int) -> DataFrame:
    """route_id, place, n, major, minor, angle: the ellipse of two normal coordinates in each of so many stretches of a route."""
    a, b = F.get("normal", F.lit(0)), F.get("normal", F.lit(1))
    at = F.least((F.col("position") * places).cast("int"), F.lit(places - 1))
    sums = rows.groupBy("route_id", at.alias("place")).agg(F.count("*").alias("n"), F.var_pop(a).alias("aa"), F.covar_pop(a, b).alias("ab"), F.var_pop(b).alias("bb"))
    middle, spread = (F.col("aa") + F.col("bb")) / 2, F.sqrt(F.pow((F.col("aa") - F.col("bb")) / 2, F.lit(2)) + F.col("ab") * F.col("ab"))
    return sums.select(
        "route_id", "place", "n", F.sqrt(middle + spread).alias("major"), F.sqrt(F.greatest(middle - spread, F.lit(0.0))).alias("minor"),
        (0.5 * F.atan2(2 * F.col("ab"), F.col("aa") - F.col("bb"))).alias("angle"),
    )

