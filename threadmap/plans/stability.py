"""Which routes come back when the cloud is resampled: supports over replicates that are fitted as one job.

Each replicate gets landmarks, links and routes of its own. A route of the whole cloud is supported by a replicate
where a route of its lies along it, one to one, or where its corridor is connected in the replicate's network.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import distance, minus, norm, plus_scaled
from ..operators.graph import roots
from ..operators.groups import as_row
from ..operators.ranges import greedy_matching
from ..operators.replicates import grouped_kmeans, grouped_links, replicates
from ..operators.routes import route_distance
from ..sources.tables import save
from .network import chains, kept_edges

#: Places of a route that are compared, and those that a corridor has to connect.
SAMPLES, ANCHORS = 64, 9
#: Distances that count as near, in local scales: of routes, and of a corridor.
NEAR_ROUTE, NEAR_CORRIDOR = 8.0, 3.0
LEAST_SUPPORT = 0.5
#: Landmarks of the network that corridors are looked for in, as a multiple of those of routes.
FINER = 4


@dataclass
class Replicated:
    """The networks of the replicates: nodes (replicate, node, c) and vertices (replicate, route_id, at, node, closed) of routes,
    and all links between more landmarks, which corridors are looked for in: fine_nodes (replicate, node, c), fine_edges (replicate, src, dst, n, length)."""

    runs: int
    nodes: DataFrame
    vertices: DataFrame
    fine_nodes: DataFrame
    fine_edges: DataFrame


def fitted_replicates(points: DataFrame, runs: int = 8, landmarks: int = 16, fraction: float = 0.8, seed: int = 0, jitter: float = 0.0) -> Replicated:
    """The network of each of so many resampled clouds of standardised points (row_id, x)."""
    rows = save(replicates(points.select("row_id", "x"), runs, fraction, seed, jitter), "replicates")
    nodes = save(grouped_kmeans(rows, landmarks, seed=seed), "replicate-landmarks")
    counts = save(grouped_links(rows, nodes), "replicate-links")

    def listed(frame: pd.DataFrame) -> list[tuple[int, int, float]]:
        return kept_edges(list(frame[["src", "dst", "n", "length"]].itertuples(index=False, name=None)))

    def vertices(frame: pd.DataFrame) -> pd.DataFrame:
        rows = [(r, at, node, closed) for r, (path, closed) in enumerate(chains(listed(frame))) for at, node in enumerate(path)]
        out = pd.DataFrame(rows, columns=["route_id", "at", "node", "closed"]).astype({"route_id": "int32", "at": "int32", "node": "int64", "closed": bool})
        return out.assign(replicate=int(frame["replicate"].iloc[0]))[["replicate", "route_id", "at", "node", "closed"]]

    each = counts.groupBy("replicate")  # as many rows as pairs of landmarks, at most
    paths = save(each.applyInPandas(vertices, "replicate int, route_id int, at int, node long, closed boolean"), "replicate-routes")
    fine = save(grouped_kmeans(rows, FINER * landmarks, rounds=3, seed=seed + 1), "replicate-fine-landmarks")
    return Replicated(runs, nodes.withColumnRenamed("center", "node"), paths, fine.withColumnRenamed("center", "node"), save(grouped_links(rows, fine), "replicate-fine-links"))


def sampled(segments: DataFrame, samples: int = SAMPLES, keys: tuple[str, ...] = ("route_id",)) -> DataFrame:
    """keys, at, c: so many even places (0 to 1) of each route of segments (keys, s, v, t0, t1); each segment gives those it holds."""
    n = samples - 1
    first = F.when(F.col("t0") <= 0, F.lit(0)).otherwise(F.floor(F.col("t0") * n + 1e-9) + 1)
    held = segments.withColumn("first", first.cast("int")).withColumn("last", F.floor(F.col("t1") * n + 1e-9).cast("int")).where("first <= last")
    span = F.col("t1") - F.col("t0")
    alpha = F.when(span > 0, (F.col("at") / n - F.col("t0")) / span).otherwise(0.0)
    return held.withColumn("at", F.explode(F.sequence("first", "last"))).select(*keys, "at", plus_scaled(F.col("s"), alpha, F.col("v")).alias("c"))


def replicate_segments(fit: Replicated) -> DataFrame:
    """replicate, route_id, s, v, t0, t1 of the replicates' routes, by arc length; closed ones return to their start."""
    w = Window.partitionBy("replicate", "route_id").orderBy("at")
    placed = fit.vertices.join(F.broadcast(fit.nodes), ["replicate", "node"])  # the number of nodes is checked where they are made
    after = F.coalesce(F.lead("c").over(w), F.when(F.col("closed"), F.first("c").over(w)))
    steps = placed.select("replicate", "route_id", "at", F.col("c").alias("s"), after.alias("e")).where("e IS NOT NULL").withColumn("v", minus(F.col("e"), F.col("s"))).withColumn("length", norm(F.col("v")))
    whole, so_far = F.sum("length").over(Window.partitionBy("replicate", "route_id")), F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return steps.withColumn("t1", F.when(whole > 0, so_far / whole).otherwise(0.0)).withColumn("t0", F.when(whole > 0, (so_far - F.col("length")) / whole).otherwise(0.0)).select("replicate", "route_id", "s", "v", "t0", "t1")


def matched_routes(routes: DataFrame, fit: Replicated, tolerance: float) -> DataFrame:
    """replicate, route_id, distance: routes (route_id, at, c: sampled places) with a route of the replicate within the tolerance, the nearest pairs first and one to one."""
    own = save(sampled(replicate_segments(fit), keys=("replicate", "route_id")).select(F.struct("replicate", "route_id").alias("route_id"), "at", "c"), "replicate-samples")
    away = save(route_distance(routes, own).where(F.col("distance") <= tolerance), "route-distances")
    pairs = away.select(F.col("b_route.replicate").alias("replicate"), F.col("a_route").alias("i"), F.col("b_route.route_id").alias("j"), F.col("distance").alias("d"))
    return greedy_matching(pairs, group="replicate").select("replicate", F.col("i").alias("route_id"), F.col("d").alias("distance"))


def recurring_corridors(routes: DataFrame, fit: Replicated, tolerance: float) -> DataFrame:
    """replicate, route_id, recurs: whether a replicate's network has a route's (route_id, at, c) corridor.

    The corridor is the edges between nodes within the tolerance of the route. Nine in ten of the route's places must lie within the
    tolerance of such an edge, and the edges nearest to its anchors, which are a few even places, must be connected by others.
    """
    few = as_row(routes.select(F.col("route_id").alias("center"), F.struct("at", "c").alias("c")), "center", "c")
    off = F.transform("all", lambda s: F.struct(s["center"].alias("route_id"), distance(F.col("c"), s["c"]["c"]).alias("d")))
    close = fit.fine_nodes.join(few).select("replicate", "node", F.explode(F.filter(off, lambda s: s["d"] <= tolerance)).alias("s"))
    inside = save(close.select("replicate", "s.route_id", "node").distinct(), "corridor-nodes")
    at_src = inside.select("replicate", "route_id", F.col("node").alias("src")).join(fit.fine_edges, ["replicate", "src"])
    induced = save(at_src.join(inside.select("replicate", "route_id", F.col("node").alias("dst")), ["replicate", "route_id", "dst"]).select("replicate", "route_id", "src", "dst"), "corridor-edges")
    key = lambda n: F.struct("replicate", "route_id", F.col(n).alias("node"))
    found = roots(induced.select(key("src").alias("a"), key("dst").alias("b"))).select("node.replicate", "node.route_id", F.col("node.node").alias("src"), F.col("root.node").alias("part"))
    named = induced.join(found, ["replicate", "route_id", "src"], "left").withColumn("part", F.coalesce("part", "src"))
    for end in ("src", "dst"):
        named = named.join(fit.fine_nodes.select("replicate", F.col("node").alias(end), F.col("c").alias(f"c_{end}")), ["replicate", end])
    listed = named.groupBy("replicate", "route_id").agg(F.collect_list(F.struct("part", F.col("c_src").alias("s"), minus(F.col("c_dst"), F.col("c_src")).alias("v"))).alias("edges"))  # of a network of landmarks

    def gaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for replicate, route, s, v, part, at, c in frame.itertuples(index=False):
                s, v, c = (np.array([np.asarray(r, float) for r in m]) for m in (s, v, c))
                part, vv = np.asarray(part), (v * v).sum(1)
                nearest = []
                for place in c:
                    off = place - s
                    alpha = np.where(vv <= 1e-24, 0.0, np.clip((off * v).sum(1) / np.maximum(vv, 1e-24), 0.0, 1.0))
                    d = np.sqrt(((off - alpha[:, None] * v) ** 2).sum(1))
                    nearest.append((d.min(), part[d == d.min()].min()))
                yield pd.DataFrame({"replicate": replicate, "route_id": route, "at": np.asarray(at), "d": [n[0] for n in nearest], "part": [n[1] for n in nearest]})

    places = routes.groupBy("route_id").agg(F.collect_list(F.struct("at", "c")).alias("places"))  # so many samples of a route
    columns = listed.join(F.broadcast(places), "route_id").select("replicate", "route_id", F.col("edges.s").alias("s"), F.col("edges.v").alias("v"), F.col("edges.part").alias("part"), F.col("places.at").alias("at"), F.col("places.c").alias("c"))
    spread = columns.repartition(routes.sparkSession.sparkContext.defaultParallelism, "replicate", "route_id")  # few rows, of much work each
    kinds = ", ".join(f"{n} {t.schema[n].dataType.simpleString()}" for n, t in (("replicate", columns), ("route_id", columns), ("at", routes)))
    placed = spread.mapInPandas(gaps, f"{kinds}, d double, part long").select("replicate", "route_id", "at", F.struct("d", "part").alias("b"))
    last = placed.groupBy("replicate", "route_id").agg(F.max("at").alias("last"))
    step = F.greatest(F.lit(1.0), F.col("last") / F.lit(float(ANCHORS - 1)))
    anchor = (F.floor(F.col("at") / step) != F.floor((F.col("at") - 1) / step)) | (F.col("at") == F.col("last"))
    good = placed.join(last, ["replicate", "route_id"]).groupBy("replicate", "route_id").agg(F.percentile("b.d", 0.9).alias("p"), F.count_distinct(F.when(anchor, F.col("b.part"))).alias("parts"))
    asked = routes.select("route_id").distinct().withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(fit.runs - 1))))
    held = good.select("replicate", "route_id", ((F.col("p") <= tolerance) & (F.col("parts") == 1)).alias("recurs"))
    return asked.join(held, ["replicate", "route_id"], "left").select("replicate", "route_id", F.coalesce("recurs", F.lit(False)).alias("recurs"))


def route_supports(segments: DataFrame, fit: Replicated, scale: float, least: float = LEAST_SUPPORT) -> DataFrame:
    """route_id, support (share of replicates with a route along it), corridor_support, stable: for the routes of segments, at a local scale."""
    routes = save(sampled(segments), "route-samples")
    matched = matched_routes(routes, fit, NEAR_ROUTE * scale).groupBy("route_id").agg((F.count("*") / fit.runs).alias("support"))
    recurs = recurring_corridors(routes, fit, NEAR_CORRIDOR * scale).groupBy("route_id").agg((F.count_if("recurs") / fit.runs).alias("corridor_support"))
    out = recurs.join(matched, "route_id", "left").select("route_id", F.coalesce("support", F.lit(0.0)).alias("support"), "corridor_support")
    return out.withColumn("stable", F.col("support") >= least)


def stable_segments(segments: DataFrame, supports: DataFrame) -> DataFrame:
    """The segments of stable routes; all where none is."""
    kept = supports.where("stable").select("route_id")
    return segments if kept.isEmpty() else segments.join(F.broadcast(kept), "route_id", "left_semi")
