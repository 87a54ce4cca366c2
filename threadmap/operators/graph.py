"""Graphs as edge tables: components, spanning trees, cycle rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import distance
from ..sources.tables import save


def roots(edges: DataFrame) -> DataFrame:
    """node, root for each node of edges (a, b) that is not its component's least node.

    Stars are contracted: every round joins edges with the least neighbour of a node, which
    is aggregated on the map side, so the neighbours of a node are never gathered, and saves
    the edges that are left. Null ends and loops are left out.
    """
    e = save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    seen = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        e = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        e = save(e.where("a <> b").distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component: the least node that edges (src, dst) reach, for each of nodes (node)."""
    found = roots(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return nodes.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def spanning_forest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """src, dst, length of the minimum spanning forest: in each round every component takes its shortest edge out.

    Ties are broken by src and dst, so rounds never close a cycle.
    """
    chosen, owner = None, save(nodes.select("node", F.col("node").alias("component")), "owner")
    while True:
        a = owner.select(F.col("node").alias("src"), F.col("component").alias("ca"))
        b = owner.select(F.col("node").alias("dst"), F.col("component").alias("cb"))
        out = edges.join(a, "src").join(b, "dst").where("ca <> cb")
        ends = out.select("ca", F.struct("length", "src", "dst").alias("e")).union(out.select("cb", F.struct("length", "src", "dst").alias("e")))
        best = save(ends.groupBy(F.col("ca").alias("c")).agg(F.min("e").alias("e")).select("e.*").distinct().select("src", "dst", "length"), "forest")
        if best.isEmpty():
            return chosen if chosen is not None else best
        chosen = best if chosen is None else save(chosen.union(best).distinct(), "forest")
        owner = save(components(nodes, chosen), "owner")


def cycle_rank(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, components and cycle_rank, which is edges - nodes + components."""
    c = components(nodes, edges).agg(F.count("*").alias("nodes"), F.countDistinct("component").alias("components"))
    return c.join(edges.agg(F.count("*").alias("edges"))).withColumn("cycle_rank", F.col("edges") - F.col("nodes") + F.col("components"))


def mst_augmented(nodes: DataFrame, edges: DataFrame, wider: DataFrame) -> DataFrame:
    """src, dst, length, is_mst: edges, and those of the spanning forest of wider ones (which hold them) that they lack."""
    tree = spanning_forest(nodes, wider).select("src", "dst", "length", F.lit(True).alias("t"))
    own = edges.select("src", "dst", "length", F.lit(False).alias("t"))
    return own.union(tree).groupBy("src", "dst").agg(F.min("length").alias("length"), F.min("t").alias("is_mst"))


def bridges(points: DataFrame, of: DataFrame, centers: int = 2_000) -> DataFrame:
    """src, dst, length: the shortest edges that join the components (row_id, component) of a cloud to one tree.

    In each round every component takes its shortest edge to another one. Of two components the
    smaller one's rows, checked to be few, are compared with all rows; more raise.
    """
    held, chosen = save(points.select("row_id", "x").join(of, "row_id"), "bridged"), None
    while True:
        sizes = held.groupBy("component").agg(F.count("*").alias("n"))
        largest = sizes.orderBy(F.desc("n"), "component").first()
        if largest is None or sizes.count() < 2:
            break
        few = held.where(F.col("component") != largest["component"])
        if few.limit(centers + 1).count() > centers:
            raise ValueError(f"more than {centers} rows outside of the largest component")
        table = F.broadcast(few.agg(F.collect_list(F.struct(F.col("row_id").alias("r"), F.col("component").alias("c"), F.col("x").alias("y"))).alias("all")))
        away = F.transform(F.filter("all", lambda s: s["c"] != F.col("component")), lambda s: F.struct(distance(F.col("x"), s["y"]).alias("length"), F.least("row_id", s["r"]).alias("src"), F.greatest("row_id", s["r"]).alias("dst"), s["c"].alias("c")))
        near = held.join(table).select(F.explode(away).alias("e"))
        best = save(near.groupBy("e.c").agg(F.min(F.struct("e.length", "e.src", "e.dst")).alias("e")).select("e.*").distinct().select("src", "dst", "length"), "bridges")
        chosen = best if chosen is None else save(chosen.union(best).distinct(), "bridges")
        old = held.select("row_id", "component")
        a, b = old.select(F.col("row_id").alias("src"), F.col("component").alias("ca")), old.select(F.col("row_id").alias("dst"), F.col("component").alias("cb"))
        joined = best.join(a, "src").join(b, "dst").select(F.col("ca").alias("src"), F.col("cb").alias("dst"))
        names = components(sizes.select(F.col("component").alias("node")), joined).select(F.col("node").alias("component"), F.col("component").alias("to"))
        held = save(held.join(names, "component").select("row_id", "x", F.col("to").alias("component")), "bridged")
    return chosen if chosen is not None else points.sparkSession.createDataFrame([], "src long, dst long, length double")


def terminal_chains(edges: DataFrame, degrees: DataFrame, longest: float) -> DataFrame:
    """Edges that end in a leaf and are no longer than that: the branches to prune in one round."""
    leaf = degrees.where("degree = 1").select(F.col("row_id").alias("leaf"))
    short = edges.where(F.col("length") <= longest)
    at_src, at_dst = F.col("src") == F.col("leaf"), F.col("dst") == F.col("leaf")
    return short.join(leaf, at_src, "left_semi").unionByName(short.join(leaf, at_src, "left_anti").join(leaf, at_dst, "left_semi"))


def pruned(edges: DataFrame, longest: float) -> DataFrame:
    """The edges left after short terminal branches are taken away, round after round, until none is left."""
    from .neighbors import degrees

    now = save(edges, "pruned")
    while True:
        gone = save(terminal_chains(now, degrees(now), longest), "terminal")
        if gone.isEmpty():
            return now
        now = save(now.join(gone.select("src", "dst"), ["src", "dst"], "left_anti"), "pruned")
