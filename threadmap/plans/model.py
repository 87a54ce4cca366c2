"""Fitting routes to a cloud, from rows to a table of segments, and applying them.

The cloud is compressed to landmarks by k-means. Every row joins its two nearest landmarks; the
pairs that enough rows join are the network, and its chains between landmarks of degree other
than two, and its loops, are the routes. All that touches rows is Spark jobs; the network, which
the number of landmarks bounds, is made in one task.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import norm
from ..operators.cloud import check, line_through, moments, standardized, width
from ..operators.frames import fitted_axes, normal_coordinates, residual_coordinates
from ..operators.groups import kmeans
from ..operators.routes import decomposed, project, project_batches, segments
from ..sources.tables import save
from .network import joined, routes_of


#: Places along a route at which axes of residuals are fitted.
GRID = 32


@dataclass
class RouteModel:
    """Moments (one row), segments and the network's edges (src, dst, length) and nodes (node, c); where residuals are
    described, their axes (route_id, g, axes) at the places of a grid and how many there are."""

    moments: DataFrame
    segments: DataFrame
    nodes: DataFrame
    edges: DataFrame
    axes: DataFrame | None = None
    residual_dim: int = 0

    def transform(self, points: DataFrame) -> DataFrame:
        """Each row's route, position, projection, residual and tangent, residual coordinates and what they and the route together leave unexplained.

        Projections, residuals and reconstructions are in the cloud's own units, tangents and residual coordinates in standard
        ones. A row's result hangs on the row and the model alone.
        """
        placed = project(standardized(points, self.moments), self.segments)
        if self.axes is None:
            empty = F.array().cast("array<double>")
            out = decomposed(placed, self.moments).withColumn("residual_coordinates", empty).withColumn("reconstructed", F.col("projected"))
        else:
            told = residual_coordinates(normal_coordinates(decomposed(placed)), self.axes, grid())
            own = told.drop("residual", "residual_norm", "normal", "unexplained_residual", "unexplained_residual_norm")
            back = F.zip_with(F.zip_with("reconstructed", "scale", lambda v, s: v * s), "mean", lambda v, m: v + m)
            moved = own.join(F.broadcast(self.moments)).withColumn("reconstructed", back).drop("mean", "scale")
            out = decomposed(moved, self.moments)
        left = F.zip_with("x", "reconstructed", lambda a, b: a - b)
        return out.withColumn("unexplained_residual", left).withColumn("unexplained_residual_norm", norm(F.col("unexplained_residual")))

    def place(self, points: DataFrame) -> DataFrame:
        """row_id, route_id, seg, alpha, position and d2 in standard units; works on streams too."""
        return project_batches(standardized(points, self.moments), self.segments)

    def save(self, path: str) -> None:
        for name in ("moments", "segments", "nodes", "edges", *(["axes"] if self.axes is not None else [])):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        spark = self.segments.sparkSession
        spark.createDataFrame([(self.residual_dim, self.axes is not None)], "residual_dim int, axes boolean").write.mode("overwrite").parquet(f"{path}/parameters")

    @staticmethod
    def load(spark: SparkSession, path: str) -> RouteModel:
        told = spark.read.parquet(f"{path}/parameters").first()
        axes = spark.read.parquet(f"{path}/axes") if told["axes"] else None
        return RouteModel(*(spark.read.parquet(f"{path}/{name}") for name in ("moments", "segments", "nodes", "edges")), axes, told["residual_dim"])


def grid() -> list[float]:
    return [i / (GRID - 1) for i in range(GRID)]


def with_residual_axes(model: RouteModel, points: DataFrame, residual_dim: int, bandwidth: float = 0.1) -> RouteModel:
    """The model with axes of residuals: at each place of the grid the first so many directions across the route, fewer than the features."""
    if residual_dim < 0 or not 0 < bandwidth < float("inf"):
        raise ValueError("residual_dim is 0 or more, and the bandwidth is over 0 and finite")
    features = width(points)
    r = min(residual_dim, features - 1)
    if not r:
        return replace(model, axes=None, residual_dim=0)
    rows = save(normal_coordinates(decomposed(project(standardized(points, model.moments), model.segments))).join(F.broadcast(model.segments.select("route_id", "closed").distinct()), "route_id").select("route_id", "position", "normal", "closed"), "normal-rows")
    parts = [fitted_axes(rows.where(F.col("closed") == closed), grid(), bandwidth, r, features - 1, closed) for closed in (False, True)]
    return replace(model, axes=save(parts[0].unionByName(parts[1]).select("route_id", "g", "axes"), "residual-axes"), residual_dim=r)


def fit(points: DataFrame, landmarks: int = 16, seed: int = 0, validate: bool = True, residual_dim: int = 0, bandwidth: float = 0.1) -> RouteModel:
    """Routes through the network of k-means landmarks of the standardised cloud; loops are closed routes.

    A cloud that is nearly a line is one straight route. With residual_dim what lies across the routes is described by so many coordinates.
    """
    if validate:
        check(points)
    model = _routes(points, landmarks, seed)
    return with_residual_axes(model, points, residual_dim, bandwidth) if residual_dim else model


def _routes(points: DataFrame, landmarks: int, seed: int) -> RouteModel:
    units = save(moments(points), "moments")
    scaled = save(standardized(points, units).select("row_id", "x"), "standardized")
    ends = line_through(points)
    if ends:
        listed = points.sparkSession.createDataFrame([(i, c) for i, c in enumerate(ends)], "node long, x array<double>")
        nodes = save(standardized(listed, units).select("node", F.col("x").alias("c")), "landmarks")
        straight = segments(nodes.select(F.lit(0).alias("route_id"), F.col("node").cast("int").alias("at"), "c"))
        edges = straight.select(F.lit(0).cast("long").alias("src"), F.lit(1).cast("long").alias("dst"), "length")
        return RouteModel(units, save(straight, "segments"), nodes, save(edges, "network"))
    nodes = save(kmeans(scaled, landmarks, seed=seed).select(F.col("center").cast("long").alias("node"), "c"), "landmarks")
    edges, vertices = routes_of(save(joined(scaled, nodes), "joined"))
    placed = save(vertices.join(F.broadcast(nodes), "node"), "vertices")
    open_, closed = placed.where("NOT closed").select("route_id", "at", "c"), placed.where("closed").select("route_id", "at", "c")
    return RouteModel(units, save(segments(open_).unionByName(segments(closed, closed=True)), "segments"), nodes, save(edges, "network"))
