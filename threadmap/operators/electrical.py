"""The graph as a network of resistors: potentials, effective resistances, leverage, currents.

The Laplacian is never formed. Its product with vectors is a join of the edges with the nodes' values and a
sum, and conjugate gradients solve for many right sides at once, each node holding one value of
each; the few numbers that a step needs for each right side are one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import save
from .graph import components

#: Right sides that are solved at once, and the size of what is left over, to that of the right side, at which one counts as solved.
AT_ONCE, TOLERANCE = 64, 1e-10


def _sums(column: Column, k: int) -> Column:
    return F.array(*(F.sum(F.get(column, F.lit(i))) for i in range(k)))


def _each(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def laplacian_times(edges: DataFrame, vectors: DataFrame, column: str, k: int) -> DataFrame:
    """node, y: the Laplacian of edges (src, dst, conductance) times the vectors (node, column: an array of k values)."""
    both = edges.select("src", "dst", "conductance").union(edges.select("dst", "src", "conductance"))
    at = vectors.select(F.col("node").alias("src"), F.col(column).alias("own"))
    over = vectors.select(F.col("node").alias("dst"), F.col(column).alias("other"))
    flows = both.join(at, "src").join(over, "dst").select(F.col("src").alias("node"), F.zip_with("own", "other", lambda a, b: a - b).alias("f"), "conductance")
    return flows.groupBy("node").agg(_sums(F.transform("f", lambda v: v * F.col("conductance")), k).alias("y"))


def potentials(edges: DataFrame, sides: DataFrame, k: int, tolerance: float = TOLERANCE, rounds: int | None = None) -> DataFrame:
    """node, x: potentials with Laplacian times x = b for k right sides (node, b: an array of k values), each of which sums to zero in every component.

    Ends when what is left over is at most the tolerance times the right side for all of them, or after so many rounds (two for each node at most).
    """
    state = save(sides.select("node", F.transform("b", lambda v: v * 0.0).alias("x"), F.col("b").alias("r"), F.col("b").alias("p")), "potentials")
    square = lambda a, b: _sums(F.zip_with(a, b, lambda u, v: u * v), k)
    n, first = state.agg(F.count("*"), square("r", "r")).first()
    if not n:
        return state.select("node", "x")
    left, turn = list(first), 0
    limit = 2 * n if rounds is None else rounds
    while turn < limit and any(v > (tolerance**2) * f for v, f in zip(left, first)):
        moved = state.join(laplacian_times(edges, state, "p", k), "node", "left").withColumn("y", F.coalesce("y", F.transform("p", lambda v: v * 0.0)))
        held = save(moved, "potentials-step")
        along = held.agg(square("p", "y")).first()[0]
        live = [v > (tolerance**2) * f for v, f in zip(left, first)]
        step = [a / b if on and b > 0 else 0.0 for a, b, on in zip(left, along, live)]
        by = lambda c, d, s: F.zip_with(c, F.zip_with(d, s, lambda v, t: v * t), lambda u, w: u + w)
        held = held.select("node", by("x", "p", _each(step)).alias("x"), by("r", "y", _each([-s for s in step])).alias("r"), "p")
        held = save(held, "potentials")
        now = list(held.agg(square("r", "r")).first()[0])
        turned = [a / b if on and b > 0 else 0.0 for a, b, on in zip(now, left, live)]
        state = save(held.select("node", "x", "r", by("r", "p", _each(turned)).alias("p")), "potentials")
        left, turn = now, turn + 1
    return state.select("node", "x")


def effective_resistances(edges: DataFrame, at_once: int = AT_ONCE, tolerance: float = TOLERANCE) -> DataFrame:
    """src, dst, conductance, resistance, leverage (conductance times resistance) of each edge, a number of edges at a time.

    A unit current goes in at one end and out at the other; the resistance is the difference of potentials.
    """
    held = save(edges.select("src", "dst", "conductance").where("conductance > 0"), "resistors")
    nodes = save(held.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "nodes")
    listed = save(held.withColumn("e", F.monotonically_increasing_id()), "numbered-resistors")
    done = None
    while True:
        rest = listed if done is None else listed.join(done.select("e"), "e", "left_anti")
        few = [r["e"] for r in rest.orderBy("e").select("e").limit(at_once).collect()]
        if not few:
            break
        k, place = len(few), F.array_position(F.array(*map(F.lit, few)), F.col("e")) - 1
        own = save(listed.where(F.col("e").isin(few)).withColumn("at", place), "sides")
        ends = own.select(F.col("src").alias("node"), "at", F.lit(1.0).alias("v")).union(own.select(F.col("dst"), "at", F.lit(-1.0)))
        b = ends.groupBy("node").agg(F.array(*(F.coalesce(F.sum(F.when(F.col("at") == i, F.col("v"))), F.lit(0.0)) for i in range(k))).alias("b"))
        sides = nodes.join(b, "node", "left").select("node", F.coalesce("b", F.array(*([F.lit(0.0)] * k))).alias("b"))
        x = save(potentials(held, sides, k, tolerance), "solved")
        a, z = x.select(F.col("node").alias("src"), F.col("x").alias("xa")), x.select(F.col("node").alias("dst"), F.col("x").alias("xz"))
        new = own.join(a, "src").join(z, "dst").select("e", "src", "dst", "conductance", F.greatest(F.lit(0.0), F.get("xa", F.col("at").cast("int")) - F.get("xz", F.col("at").cast("int"))).alias("resistance"))
        done = save(new, "resistances") if done is None else done.union(save(new, "resistances"))
    out = done if done is not None else listed.withColumn("resistance", F.lit(0.0)).select("e", "src", "dst", "conductance", "resistance")
    return out.select("src", "dst", "conductance", "resistance", (F.col("conductance") * F.col("resistance")).alias("leverage"))


def currents(edges: DataFrame, source: int, target: int, tolerance: float = TOLERANCE) -> DataFrame:
    """src, dst, current: what flows from src to dst where one unit goes in at the source and out at the target; nothing where they aren't connected."""
    held = save(edges.select("src", "dst", "conductance"), "resistors")
    nodes = held.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    named = save(components(nodes, held), "components")
    joined = named.where(F.col("node").isin(source, target)).agg(F.count("*") == 2, F.count_distinct("component") == 1).first()
    size = F.lit(1.0 if all(joined) and source != target else 0.0)
    b = F.array(F.when(F.col("node") == source, size).when(F.col("node") == target, -size).otherwise(0.0))
    x = save(potentials(held, nodes.select("node", b.alias("b")), 1, tolerance), "solved")
    a, z = x.select(F.col("node").alias("src"), F.col("x").alias("xa")), x.select(F.col("node").alias("dst"), F.col("x").alias("xz"))
    return held.join(a, "src").join(z, "dst").select("src", "dst", (F.col("conductance") * (F.col("xa")[0] - F.col("xz")[0])).alias("current"))
