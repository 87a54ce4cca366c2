"""Shortest paths over edge tables, many at once, and paths of representatives brought down the levels of a hierarchy."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import save
from .neighbors import knn, union_edges

#: Decimals of lengths that are compared, so ties go to the least row before.
TIE_DIGITS = 9
#: Edges, to and fro, up to which a search is gone through within one task; all other searches take their steps as jobs. And as many
#: searches at most share edges that way, which are copied for each.
LOCAL_EDGES, LOCAL_SEARCHES = 1_000_000, 64


def _searched(frame: pd.DataFrame) -> pd.DataFrame:
    """search, node, length, before of one search, from its edges (src, dst, length) and its sources (src, length -1), by least length first."""
    search, source = frame["search"].iloc[0], frame["length"].to_numpy(float) < 0
    names, at = np.unique(np.r_[frame["src"].to_numpy(np.int64), frame["dst"].to_numpy(np.int64)], return_inverse=True)
    begin = at[: len(frame)][source]
    src, dst, length = at[: len(frame)][~source], at[len(frame) :][~source], frame["length"].to_numpy(float)[~source]
    order = np.argsort(src, kind="stable")
    dst, length = dst[order].tolist(), length[order].tolist()
    first = np.searchsorted(src[order], np.arange(len(names) + 1)).tolist()
    so_far, key, before = {int(n): 0.0 for n in begin}, {int(n): 0.0 for n in begin}, {int(n): None for n in begin}
    heap, done = [(0.0, n) for n in sorted(so_far)], set()
    while heap:
        _, n = heapq.heappop(heap)
        if n in done:
            continue
        done.add(n)
        for e in range(first[n], first[n + 1]):
            m, way = dst[e], so_far[n] + length[e]
            k, had = round(way, TIE_DIGITS), key.get(m)
            if had is None or k < had or (k == had and key[n] < k and before[m] is not None and n < before[m]):
                if m in done and not (had is not None and k == had):
                    continue
                so_far[m], key[m], before[m] = way, k, n
                heapq.heappush(heap, (k, m))
    nodes = list(so_far)
    back = [None if before[n] is None else int(names[before[n]]) for n in nodes]
    return pd.DataFrame({"search": search, "node": names[nodes], "length": [so_far[n] for n in nodes], "before": pd.array(back, "Int64")})


def _walk(frame: pd.DataFrame) -> pd.DataFrame:
    """search, step, node: the way back from one search's targets, out of its nodes; what is before a source is itself."""
    before = dict(zip(frame["node"].tolist(), frame["before"].tolist()))
    rows = []
    for target in frame["node"][frame["asked"]].tolist():
        way = [target]
        while before[way[-1]] != way[-1]:
            way.append(before[way[-1]])
        rows += enumerate(reversed(way))
    return pd.DataFrame({"search": frame["search"].iloc[0], "step": [r[0] for r in rows], "node": [r[1] for r in rows]}).astype({"step": "int32", "node": "int64"})


def _few_each(rows: DataFrame) -> bool:
    """Whether no search has more rows than one task goes through."""
    return (rows.groupBy("search").count().agg(F.max("count")).first()[0] or 0) <= LOCAL_EDGES


def distances(edges: DataFrame, sources: DataFrame, rounds: int | None = None) -> DataFrame:
    """search, node, length, before: from each source (search, node) the shortest way to all nodes that edges (src, dst, length) reach.

    Searches of few edges are gone through in a task each. All others take each step together: a round joins the nodes that got nearer in the last one with their edges, so settled parts
    of the graph aren't read again; ties go to the least node before, out of those that are nearer than the node itself: among nodes
    at no distance from each other the first one found is kept, so ways never go in circles. Edges with a column search belong to that one alone.
    """
    on = ["search"] if "search" in edges.columns else []
    both = edges.select(*on, "src", "dst", "length").union(edges.select(*on, F.col("dst").alias("src"), F.col("src").alias("dst"), "length"))
    both = save(both.where("length >= 0"), "path-edges")
    if rounds is None:
        local = both if on else None
        if not on and both.count() <= LOCAL_EDGES and sources.select("search").distinct().count() <= LOCAL_SEARCHES:
            local = both.crossJoin(F.broadcast(sources.select("search").distinct())).select("search", "src", "dst", "length")
        if local is not None and _few_each(local):
            begin = sources.select("search", F.col("node").cast("long").alias("src"), F.col("node").cast("long").alias("dst"), F.lit(-1.0).alias("length")).distinct()
            kind = sources.schema["search"].dataType.simpleString()
            found = local.join(F.broadcast(sources.select("search").distinct()), "search", "left_semi").select("search", "src", "dst", "length").unionByName(begin)
            return save(found.groupBy("search").applyInPandas(_searched, f"search {kind}, node long, length double, before long"), "nearest")
    best = save(sources.select("search", "node", F.lit(0.0).alias("length"), F.lit(None).cast("long").alias("before")).dropDuplicates(["search", "node"]), "nearest")
    front, turn = best, 0
    while rounds is None or turn < rounds:
        stepped = front.select("search", F.col("node").alias("src"), F.col("length").alias("so_far")).join(both, [*on, "src"])
        key = F.round(F.col("so_far") + F.col("length"), TIE_DIGITS)
        offer = F.struct(key.alias("key"), (F.round("so_far", TIE_DIGITS) >= key).alias("still"), F.col("src").alias("before"), (F.col("so_far") + F.col("length")).alias("length"))
        offered = stepped.groupBy("search", F.col("dst").alias("node")).agg(F.min(offer).alias("b"))
        old = best.select("search", "node", F.round("length", TIE_DIGITS).alias("had"), F.col("before").alias("old"))
        tied = (F.col("b.key") == F.col("had")) & ~F.col("b.still") & (F.col("b.before") < F.col("old"))
        nearer = F.col("had").isNull() | (F.col("b.key") < F.col("had")) | tied
        new = save(offered.join(old, ["search", "node"], "left").where(nearer).select("search", "node", "b.length", "b.before"), "frontier")
        if new.isEmpty():
            return best
        best = save(best.join(new.select("search", "node"), ["search", "node"], "left_anti").unionByName(new), "nearest")
        front, turn = new, turn + 1
    return best


def walked(found: DataFrame, targets: DataFrame) -> DataFrame:
    """search, step (0 at the source), node: the way to each search's target (search, node), found by going back step by step.

    A search whose target isn't reached has no rows.
    """
    if _few_each(found):
        asked = found.join(targets.select("search", "node", F.lit(True).alias("asked")).distinct(), ["search", "node"], "left")
        kind = found.schema["search"].dataType.simpleString()
        return asked.select("search", "node", F.coalesce("before", "node").alias("before"), F.coalesce("asked", F.lit(False)).alias("asked")).groupBy("search").applyInPandas(_walk, f"search {kind}, step int, node long")
    here = save(found.join(targets.select("search", "node"), ["search", "node"]).select("search", "node", "before", F.lit(0).alias("back")), "walk")
    out = here
    while True:
        up = here.where("before IS NOT NULL").select("search", F.col("before").alias("node"), (F.col("back") + 1).alias("back"))
        here = save(up.join(found.select("search", "node", "before"), ["search", "node"]).select("search", "node", "before", "back"), "walk")
        if here.isEmpty():
            break
        out = out.union(here)
    return out.withColumn("step", F.max("back").over(Window.partitionBy("search")) - F.col("back")).select("search", "step", "node")


def legs(paths: DataFrame) -> DataFrame:
    """path, leg, source, target: the consecutive vertices (path, at, node) of each path."""
    w = Window.partitionBy("path").orderBy("at")
    return paths.select("path", (F.row_number().over(w) - 1).alias("leg"), F.col("node").alias("source"), F.lead("node").over(w).alias("target")).where("target IS NOT NULL AND source <> target")


def _ways(steps: DataFrame, corridor: DataFrame, points: DataFrame, k: int, power: float) -> DataFrame:
    """path, leg, step, node: the cheapest way of each leg (path, leg, source, target) over neighbours within its path's corridor (path, row_id)."""
    rows = save(points.join(corridor.select("row_id").distinct(), "row_id", "left_semi"), "corridor-rows")
    near = save(union_edges(knn(rows, max(1, min(k, rows.count() - 1)))).select("src", "dst", F.pow("d2", F.lit(power / 2)).alias("length")), "corridor-edges")
    a, b = (corridor.select("path", F.col("row_id").alias(c)) for c in ("src", "dst"))
    inside = near.join(a, "src").join(b, ["path", "dst"])
    searched = save(steps.withColumn("search", F.monotonically_increasing_id()), "searches")
    found = distances(inside.join(searched.select("path", "search"), "path").select("search", "src", "dst", "length"), searched.select("search", F.col("source").alias("node")))
    ways = walked(found, searched.select("search", F.col("target").alias("node")))
    return save(ways.join(searched.select("search", "path", "leg"), "search").select("path", "leg", "step", "node"), "ways")


def refined(paths: DataFrame, children: DataFrame, points: DataFrame, k: int = 8, power: float = 2.0, widen: bool = True) -> tuple[DataFrame, DataFrame]:
    """Paths (path, at, node) of representatives as paths (path, at, leg, node) of the level below, and the legs that no way was found for.

    children: row_id, rep (its representative, which is a row of the level below itself); points: row_id, x of the level below.
    The rows whose representatives are on a path are its corridor. Every leg between two representatives becomes
    the cheapest way over the nearest neighbours within the corridor, where a step costs its length to a power; over 1
    it follows the rows rather than skipping some. All legs of all paths are one search. Legs that find none are tried again among twice as many
    neighbours, in a corridor with the neighbours of its vertices; if that fails too, or without widen, they keep their two ends.
    """
    steps = save(legs(paths), "legs")
    corridor = save(paths.select("path", F.col("node").alias("rep")).distinct().join(children, "rep").select("path", "row_id").distinct(), "corridor")
    ways = _ways(steps, corridor, points, k, power)
    lost = save(steps.join(ways.select("path", "leg").distinct(), ["path", "leg"], "left_anti"), "lost-legs")
    if widen and not lost.isEmpty():
        again = corridor.join(lost.select("path").distinct(), "path", "left_semi")
        near = knn(points, max(1, min(k, points.count() - 1))).select(F.col("i").alias("node"), F.col("j").alias("row_id"))
        beside = lost.select("path", F.explode(F.array("source", "target")).alias("node")).distinct().join(near, "node").select("path", "row_id")
        more = _ways(lost, save(again.union(beside).distinct(), "wide-corridor"), points, 2 * k, power)
        ways = ways.union(more)
        lost = save(lost.join(more.select("path", "leg").distinct(), ["path", "leg"], "left_anti"), "lost-legs")
    straight = lost.select("path", "leg", F.explode(F.array(F.struct(F.lit(0).alias("step"), F.col("source").alias("node")), F.struct(F.lit(1).alias("step"), F.col("target").alias("node")))).alias("s")).select("path", "leg", "s.step", "s.node")
    first = steps.groupBy("path").agg(F.min("leg").alias("first"))
    every = ways.unionByName(straight).join(first, "path").where("leg = first OR step > 0")
    at = F.row_number().over(Window.partitionBy("path").orderBy("leg", "step")) - 1
    return save(every.select("path", at.alias("at"), "leg", "node"), "refined"), lost.select("path", "leg", "source", "target")


def refined_to_cloud(paths: DataFrame, levels: DataFrame, ancestry: DataFrame, level: int, k: int = 8, power: float = 2.0) -> DataFrame:
    """path, at, node: paths of a level's representatives brought down to the cloud, a level at a time; their ends stay.

    levels (level, rep, x) and ancestry (level, row_id, rep) are a hierarchy's.
    """
    now = paths
    for depth in range(level, 0, -1):
        own = levels.where(F.col("level") == depth - 1).select(F.col("rep").alias("row_id"), "x")
        # a representative of the level below is a row, and what stands for it above is what stands for that row
        children = ancestry.where(F.col("level") == depth).join(own.select("row_id"), "row_id", "left_semi").select("row_id", "rep")
        now, _ = refined(now, children, own, k, power)
    return now


def path_lengths(paths: DataFrame, points: DataFrame) -> DataFrame:
    """path, rows, length of each path's (path, at, node) polyline through points (row_id, x)."""
    from ..functions.vectors import distance

    w = Window.partitionBy("path").orderBy("at")
    placed = paths.join(points.select(F.col("row_id").alias("node"), "x"), "node")
    return placed.withColumn("step", distance(F.col("x"), F.lag("x").over(w))).groupBy("path").agg(F.count("*").alias("rows"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"))
