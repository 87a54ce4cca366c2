"""The network of landmarks: which are joined by rows between them, and its routes.

Every row joins its two nearest landmarks, so the count of rows that join a pair is one
aggregation over the cloud. What follows works on the counts alone, whose number the
landmarks bound, in one task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import sqdist
from ..operators.groups import as_row

#: Shares of the rows that join the usual edge of the forest: what an edge needs, and what one that closes a loop needs.
LEAST_LINK, LEAST_SHARE = 0.08, 0.15


def joined(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """src < dst, n, length: how many rows have these landmarks (node, c) as their two nearest, and how far apart they are."""
    ordered = F.array_sort(F.transform("all", lambda s: F.struct(sqdist(F.col("x"), s["c"]).alias("d2"), s["node"].alias("node"))))
    two = points.join(as_row(nodes, "node", "c")).select(ordered.alias("o")).where(F.size("o") > 1).select(F.get("o", F.lit(0))["node"].alias("p"), F.get("o", F.lit(1))["node"].alias("q"))
    counts = two.groupBy(F.least("p", "q").alias("src"), F.greatest("p", "q").alias("dst")).agg(F.count("*").alias("n"))
    a, b = nodes.select(F.col("node").alias("src"), F.col("c").alias("ca")), nodes.select(F.col("node").alias("dst"), F.col("c").alias("cb"))
    return counts.join(F.broadcast(a), "src").join(F.broadcast(b), "dst").select("src", "dst", "n", F.sqrt(sqdist(F.col("ca"), F.col("cb"))).alias("length"))


def kept_edges(edges: list[tuple[int, int, int, float]]) -> list[tuple[int, int, float]]:
    """The forest of shortest edges (src, dst, n, length), and others that more rows join, without triangles or edges of next to no rows."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    forest, others = [], []
    for e in sorted(edges, key=lambda e: (e[3], e[0], e[1])):
        a, b = find(e[0]), find(e[1])
        (others if a == b else forest).append(e)
        root[a] = b
    if not forest:
        return []
    usual = sorted(e[2] for e in forest)[len(forest) // 2]
    joins = {(a, b): n for a, b, n, _ in edges}
    length = {(a, b): d for a, b, n, d in [*forest, *(e for e in others if e[2] >= LEAST_SHARE * usual)]}
    beside: dict[int, set[int]] = {}
    length = {e: d for e, d in length.items() if joins[e] >= LEAST_LINK * usual}
    for a, b in length:
        beside.setdefault(a, set()).add(b)
        beside.setdefault(b, set()).add(a)
    for a, b in sorted(length, key=lambda e: (-length[e], e)):  # the longest edge of a triangle goes
        if any(max(length[min(a, c), max(a, c)], length[min(b, c), max(b, c)]) <= length[a, b] for c in beside[a] & beside[b]):
            del length[a, b]
            beside[a].discard(b)
            beside[b].discard(a)
    return [(a, b, d) for (a, b), d in sorted(length.items())]


def chains(edges: list[tuple[int, int, float]]) -> list[tuple[list[int], bool]]:
    """The maximal chains between nodes whose degree isn't two, and what is left: closed chains."""
    beside: dict[int, list[int]] = {}
    for a, b, _ in edges:
        beside.setdefault(a, []).append(b)
        beside.setdefault(b, []).append(a)
    used: set[tuple[int, int]] = set()
    out = []

    def walk(start: int, to: int) -> list[int]:
        path = [start, to]
        used.add((min(start, to), max(start, to)))
        while len(beside[path[-1]]) == 2 and path[-1] != start:
            here, back = path[-1], path[-2]
            after = next(n for n in beside[here] if n != back)
            used.add((min(here, after), max(here, after)))
            path.append(after)
        return path

    for node in sorted(beside, key=lambda n: (len(beside[n]) == 2, n)):
        for to in sorted(beside[node]):
            if (min(node, to), max(node, to)) not in used:
                path = walk(node, to)
                closed = path[-1] == node
                out.append((path[:-1] if closed else path, closed))
    return out


def routes_of(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges (src, dst, length) and vertices (route_id, at, node, closed) of the network of joined landmarks."""

    def edges(frame: pd.DataFrame) -> pd.DataFrame:
        rows = kept_edges(list(frame[["src", "dst", "n", "length"]].itertuples(index=False, name=None)))
        return pd.DataFrame(rows, columns=["src", "dst", "length"]).astype({"src": "int64", "dst": "int64", "length": float})

    def vertices(frame: pd.DataFrame) -> pd.DataFrame:
        rows = kept_edges(list(frame[["src", "dst", "n", "length"]].itertuples(index=False, name=None)))
        listed = [(r, at, node, closed) for r, (path, closed) in enumerate(chains(rows)) for at, node in enumerate(path)]
        return pd.DataFrame(listed, columns=["route_id", "at", "node", "closed"]).astype({"route_id": "int32", "at": "int32", "node": "int64", "closed": bool})

    whole = counts.withColumn("one", F.lit(0)).groupBy("one")  # as many rows as pairs of landmarks, at most
    return whole.applyInPandas(edges, "src long, dst long, length double"), whole.applyInPandas(vertices, "route_id int, at int, node long, closed boolean")
