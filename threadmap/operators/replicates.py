"""Resampled clouds as one table: every step works on all replicates at once, keyed by their number.

A replicate's rows are drawn by a hash of the row and the replicate, so a seed gives the same replicates
however the rows are dealt. k-means over replicates is one job a round, with one set of centers for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions.vectors import sqdist
from ..sources.tables import save
from .cloud import SIDE_BY_SIDE, width
from .groups import MOST_CENTERS

#: Draws of starting centers, and how many rows each takes about, as multiples of the number of centers.
DRAWS, OVERSAMPLING = 4, 2
#: Starts of which the best is taken where candidates are condensed to centers.
RESTARTS = 8
#: Distances that a task holds at a time.
BLOCK = 1 << 20


def share(seed: int, *columns: Column | str) -> Column:
    """A number from 0 to 1 for each row, from the first 32 bits of an MD5 of seed and columns, joined by colons."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def replicates(points: DataFrame, runs: int, fraction: float = 0.8, seed: int = 0, jitter: float = 0.0) -> DataFrame:
    """points with replicate (from 0): each row is drawn into each replicate with a chance, without repeats.

    jitter: the deviation of normal noise that each coordinate gets, drawn anew in each replicate.
    """
    drawn = F.filter(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: share(seed, r, "row_id") < fraction)
    out = points.withColumn("replicate", F.explode(drawn))
    if jitter <= 0:
        return out
    place = lambda i, k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "replicate", "row_id", i), F.lit(1 << 30)) / F.lit(float(1 << 30))
    normal = lambda i: F.sqrt(-2 * F.log(place(i, 0) + 1e-12)) * F.cos(place(i, 1) * 6.283185307179586)
    return out.withColumn("x", F.transform("x", lambda v, i: v + jitter * normal(i)))


def held_by_replicate(centers: DataFrame, key: str = "center", vector: str = "c") -> Broadcast:
    """Each replicate's centers in the order of their numbers, as arrays (numbers, vectors); they go to all tasks after a check of their number."""
    if centers.limit(MOST_CENTERS + 1).count() > MOST_CENTERS:
        raise ValueError(f"more than {MOST_CENTERS} centers of replicates")
    listed = centers.select("replicate", F.col(key).alias("center"), F.col(vector).alias("c")).toPandas().sort_values("center")
    each = {int(r): (part["center"].to_numpy(np.int64), np.array(part["c"].tolist(), float)) for r, part in listed.groupby("replicate")}
    return centers.sparkSession.sparkContext.broadcast(each)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows and centers, added up feature by feature, as functions.vectors does."""
    d2 = np.zeros((len(x), len(c)))
    for j in range(x.shape[1]):
        d2 += (x[:, j, None] - c[None, :, j]) ** 2
    return d2


def _by_replicate(batch: pa.RecordBatch, held: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Places in the batch, their squared distances to their replicate's centers, the centers' numbers, the replicate; BLOCK numbers at a time."""
    if not batch.num_rows:
        return
    replicate = batch.column(batch.schema.get_field_index("replicate")).to_numpy()
    vectors = batch.column(batch.schema.get_field_index("x"))
    x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    for r in np.unique(replicate):
        if int(r) not in held:
            continue
        numbers, c = held[int(r)]
        mine, step = np.flatnonzero(replicate == r), max(1, BLOCK // len(c))
        for at in range(0, len(mine), step):
            part = mine[at : at + step]
            yield part, _squared(x[part], c), numbers, int(r)


def nearest_in_replicate(rows: DataFrame, centers: DataFrame) -> DataFrame:
    """rows (replicate, x, ...) with center and d2 of the nearest of the replicate's centers (replicate, center, c), ties to the least."""
    shared = held_by_replicate(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            center, d2 = np.full(batch.num_rows, -1, np.int64), np.zeros(batch.num_rows)
            met = np.zeros(batch.num_rows, bool)
            for part, away, numbers, _ in _by_replicate(batch, shared.value):
                best = away.argmin(1)
                center[part], d2[part], met[part] = numbers[best], away[np.arange(len(part)), best], True
            whole = pa.RecordBatch.from_arrays([*batch.columns, pa.array(center), pa.array(d2)], names=[*batch.schema.names, "center", "d2"])
            yield whole.filter(pa.array(met))

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("center", LongType()), StructField("d2", DoubleType())]))


def _means(rows: DataFrame, d: int) -> DataFrame:
    by = ["replicate", "center"]
    if d <= SIDE_BY_SIDE:
        return rows.groupBy(*by).agg(F.array(*(F.avg(F.get("x", F.lit(j))) for j in range(d))).alias("c"))
    each = rows.select(*by, F.posexplode("x").alias("j", "v")).groupBy(*by, "j").agg(F.avg("v").alias("m"))
    listed = each.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("j", "m"))).alias("ms"))  # a struct for each feature
    return listed.select(*by, F.transform("ms", lambda m: m["m"]).alias("c"))


def _condensed(k: int, seed: int):
    """Of a replicate's weighed candidates, whose number the draws bound, k centers: spread starts and weighed means."""

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("center")
        x, w = np.array(frame["c"].tolist(), float), frame["n"].to_numpy(float)
        replicate = int(frame["replicate"].iloc[0])
        rng = np.random.default_rng((seed, replicate))
        best, c = np.inf, x[:1]
        for _ in range(RESTARTS):
            tried = [int(rng.choice(len(x), p=w / w.sum()))]
            away = ((x - x[tried[0]]) ** 2).sum(1)
            while len(tried) < min(k, len(x)) and (away * w).sum() > 0:
                tried.append(int(rng.choice(len(x), p=away * w / (away * w).sum())))
                away = np.minimum(away, ((x - x[tried[-1]]) ** 2).sum(1))
            m = x[tried]
            for _ in range(10):
                d2 = ((x[:, None] - m[None]) ** 2).sum(2)
                own = d2.argmin(1)
                m = np.array([np.average(x[own == i], axis=0, weights=w[own == i]) if (own == i).any() else m[i] for i in range(len(m))])
            cost = float((_squared(x, m).min(1) * w).sum())
            if cost < best:
                best, c = cost, m
        return pd.DataFrame({"replicate": replicate, "center": np.arange(len(c)), "c": list(c)}).astype({"replicate": "int32", "center": "int64"})

    return solve


def grouped_kmeans(rows: DataFrame, k: int, rounds: int = 8, seed: int = 0) -> DataFrame:
    """replicate, center (from 0), c: k-means of each replicate's rows (replicate, row_id, x); all replicates take part in each job.

    Starts: in a few draws every row becomes a candidate with a chance by its squared distance to the
    candidates so far; these are weighed by the rows next to them and condensed to k.
    """
    d = width(rows)
    first = rows.groupBy("replicate").agg(F.min(F.struct(F.xxhash64(F.lit(seed), "replicate", "row_id").alias("h"), F.col("row_id").alias("center"), F.col("x").alias("c"))).alias("b"))
    found = save(first.select("replicate", "b.center", "b.c"), "candidates")
    for draw in range(DRAWS):
        placed = nearest_in_replicate(rows, found)
        whole = F.broadcast(placed.groupBy("replicate").agg(F.sum("d2").alias("whole")))
        chance = OVERSAMPLING * k * F.col("d2") / F.col("whole")
        u = F.pmod(F.xxhash64(F.lit(seed), F.lit(draw), "replicate", "row_id"), F.lit(1 << 30)) / float(1 << 30)
        new = placed.join(whole, "replicate").where((F.col("whole") > 0) & (u < chance)).select("replicate", F.col("row_id").alias("center"), F.col("x").alias("c"))
        found = save(found.union(new).dropDuplicates(["replicate", "center"]), "candidates")
    weights = nearest_in_replicate(rows, found).groupBy("replicate", "center").agg(F.count("*").alias("n"))
    kinds = "replicate int, center long, c array<double>"
    weighed = found.join(weights, ["replicate", "center"]).repartition(rows.sparkSession.sparkContext.defaultParallelism, "replicate")  # few rows, of much work each
    centers = save(weighed.groupBy("replicate").applyInPandas(_condensed(k, seed), kinds), "centers")
    for _ in range(rounds):
        moved = _means(nearest_in_replicate(rows, centers), d).withColumnRenamed("c", "m")
        centers = save(centers.join(moved, ["replicate", "center"], "left").select("replicate", "center", F.coalesce("m", "c").alias("c")), "centers")
    return centers


def grouped_links(rows: DataFrame, centers: DataFrame) -> DataFrame:
    """replicate, src < dst, n, length: how many of a replicate's rows have these of its centers as their two nearest, and how far apart they are."""
    shared = held_by_replicate(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, away, numbers, r in _by_replicate(batch, shared.value):
                if len(numbers) < 2:
                    continue
                p = away.argmin(1)
                away[np.arange(len(part)), p] = np.inf
                ends = np.sort(np.stack([numbers[p], numbers[away.argmin(1)]], 1), 1)
                links, n = np.unique(ends, axis=0, return_counts=True)
                columns = [pa.array(np.full(len(n), r, np.int32)), pa.array(links[:, 0]), pa.array(links[:, 1]), pa.array(n.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["replicate", "src", "dst", "n"])

    counts = rows.select("replicate", "x").mapInArrow(run, "replicate int, src long, dst long, n long").groupBy("replicate", "src", "dst").agg(F.sum("n").alias("n"))
    a, b = (F.broadcast(centers.select("replicate", F.col("center").alias(s), F.col("c").alias(f"c_{s}"))) for s in ("src", "dst"))
    return counts.join(a, ["replicate", "src"]).join(b, ["replicate", "dst"]).select("replicate", "src", "dst", "n", F.sqrt(sqdist(F.col("c_src"), F.col("c_dst"))).alias("length"))


def link_supports(links: DataFrame, runs: int, least: float = 0.0) -> DataFrame:
    """src, dst, support, mean_share, dispersion: over replicates of one set of centers, in which share of them a link holds at least that share of the rows,
    and how its share of them varies (0 where it is missing)."""
    whole = links.groupBy("replicate").agg(F.sum("n").alias("whole"))
    shared = links.join(F.broadcast(whole), "replicate").withColumn("share", F.col("n") / F.col("whole"))
    s, ss = F.sum("share") / runs, F.sum(F.col("share") * F.col("share")) / runs
    return shared.groupBy("src", "dst").agg((F.count_if(F.col("share") >= least) / runs).alias("support"), s.alias("mean_share"), F.sqrt(F.greatest(ss - s * s, F.lit(0.0))).alias("dispersion"))
