"""Assignment to centers, k-means, medoids, duplicates, and the hierarchy of representatives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import distance, sqdist
from ..sources.tables import save
from .cloud import SIDE_BY_SIDE, width
from .neighbors import density_threshold, knn, kth_scale

#: Centers that may be sent to all tasks as one row.
MOST_CENTERS = 20_000
#: Rows of a block when members of a group are compared.
BLOCK_ROWS = 256


def as_row(centers: DataFrame, key: str, vector: str) -> DataFrame:
    """All centers as one broadcast row, after a check of their number."""
    n = centers.limit(MOST_CENTERS + 1).count()
    if n > MOST_CENTERS:
        raise ValueError(f"more than {MOST_CENTERS} centers; assign through knn instead")
    return F.broadcast(centers.agg(F.array_sort(F.collect_list(F.struct(key, vector))).alias("all")))


def nearest_center(points: DataFrame, centers: DataFrame) -> DataFrame:
    """points with center and d2 of the nearest of centers (center, c), ties to the least."""
    best = F.array_min(F.transform("all", lambda s: F.struct(sqdist(F.col("x"), s["c"]).alias("d2"), s["center"].alias("center"))))
    return points.join(as_row(centers, "center", "c")).withColumn("best", best).select(*points.columns, "best.center", "best.d2")


def group_means(points: DataFrame, key: str, features: int | None = None) -> DataFrame:
    """key, c, n: the mean of each group, from one pass with map-side sums."""
    d = features or width(points)
    if d <= SIDE_BY_SIDE:
        return points.groupBy(key).agg(F.array(*(F.avg(F.get("x", F.lit(j))) for j in range(d))).alias("c"), F.count("*").alias("n"))
    each = points.select(key, F.posexplode("x").alias("j", "v")).groupBy(key, "j").agg(F.avg("v").alias("m"), F.count("*").alias("n"))
    row = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("j", "m"))).alias("all"), F.max("n").alias("n"))  # a struct for each feature
    return row.select(key, F.transform("all", lambda f: f["m"]).alias("c"), "n")


def kmeans_step(points: DataFrame, centers: DataFrame) -> DataFrame:
    """center, c, n: the means of the rows that are nearest to each center."""
    return group_means(nearest_center(points, centers), "center")


def kmeans(points: DataFrame, k: int, rounds: int = 80, seed: int = 0) -> DataFrame:
    """center, c: k-means with parallel k-means++ seeds."""
    if k < 2:
        return group_means(points.withColumn("center", F.lit(0)), "center").select("center", "c")
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=k, maxIter=rounds, seed=seed, featuresCol="v").fit(points.select(array_to_vector("x").alias("v")))
    rows = [(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())]
    return points.sparkSession.createDataFrame(rows, "center int, c array<double>")


def medoids(points: DataFrame, key: str, candidates: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """key, row_id, cost, n: the member of each group of least summed distance to all members, ties to the least id.

    Equal rows of a group are weighed as one, by their number. Distinct rows are cut into blocks of a
    bounded number, and blocks of one group are compared with each other a pair of blocks at a time, so
    no task holds a group. With candidates only so many members, those of least hash, are weighed
    against all members, which bounds the work of a group by its size.
    """
    distinct = points.groupBy(key, "x").agg(F.min("row_id").alias("row_id"), F.count("*").alias("times"))
    if candidates is None:
        held = save(distinct, "medoid-rows")
        parts = held.groupBy(key).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts"))
        cut = held.join(parts, key).withColumn("part", F.pmod(F.xxhash64("row_id"), F.col("parts")))
        packed = cut.groupBy(key, "part").agg(F.max("parts").alias("parts"), F.collect_list("row_id").alias("ids"), F.collect_list("x").alias("xs"), F.collect_list("times").alias("ts"))
        packed = save(packed.withColumn("block", F.monotonically_increasing_id()), "medoid-blocks")
        # a group of one block meets itself; pairs of all others are a Cartesian product of the saved files, so no block is shuffled for each that it meets
        alone = packed.where("parts = 1").select(key, F.col("block").alias("q"), F.col("ids").alias("q_ids"), F.col("xs").alias("q_xs"), "xs", "ts")
        cut_up = packed.where("parts > 1")
        left = cut_up.select(F.col(key).alias("of"), F.col("block").alias("q"), F.col("ids").alias("q_ids"), F.col("xs").alias("q_xs"))
        met = left.join(cut_up.select(key, "xs", "ts").hint("shuffle_replicate_nl"), F.col("of") == F.col(key)).select(*alone.columns)
        kind = points.schema[key].dataType.simpleString()

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now, own = None, None
            for frame in batches:
                for k, q, ids, a, b, times in zip(frame[key], frame["q"], frame["q_ids"], frame["q_xs"], frame["xs"], frame["ts"]):
                    if q != now:
                        if own is not None:
                            yield own
                        now, own = q, pd.DataFrame({key: [k] * len(ids), "row_id": np.asarray(ids), "cost": 0.0, "n": 0})
                    a, b, times = (np.array([np.asarray(v, float) for v in x]) for x in (a, b, times))
                    d2 = np.zeros((len(a), len(b)))
                    for j in range(a.shape[1]):
                        d2 += (a[:, j][:, None] - b[:, j][None]) ** 2
                    own["cost"] += np.sqrt(d2) @ times
                    own["n"] += int(times.sum())
            if own is not None:
                yield own

        costs = alone.unionByName(met).mapInPandas(sums, f"{key} {kind}, row_id long, cost double, n long").groupBy(key, "row_id").agg(F.sum("cost").alias("cost"), F.sum("n").alias("n"))
    else:
        order = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64("row_id"), "row_id"))
        few = distinct.withColumn("o", order).where(F.col("o") <= candidates).groupBy(key).agg(F.collect_list(F.struct("row_id", F.col("x").alias("y"))).alias("few"))
        costs = points.join(few, key).select(key, F.explode(F.transform("few", lambda s: F.struct(s["row_id"].alias("row_id"), distance(F.col("x"), s["y"]).alias("d")))).alias("s"))
        costs = costs.groupBy(key, F.col("s.row_id").alias("row_id")).agg(F.sum("s.d").alias("cost"), F.count("*").alias("n"))
    best = costs.groupBy(key).agg(F.min(F.struct(F.round("cost", 9).alias("cost"), "row_id")).alias("b"), F.max("n").alias("n"))
    return best.select(key, "b.row_id", "b.cost", "n")


def duplicate_groups(points: DataFrame) -> DataFrame:
    """first, n: the least id and the number of rows of each set of equal rows."""
    return points.groupBy("x").agg(F.min("row_id").alias("first"), F.count("*").alias("n")).select("first", "n")


def greedy_cover(rows: DataFrame, links: DataFrame) -> DataFrame:
    """row_id, seed: rows become seeds in the order of their ids unless an earlier seed has claimed them.

    A row belongs to the first seed that is linked (i, j) to it. In each round the open rows
    that have no open row of lesser id beside them become seeds, and rows beside them close, which is
    what going through them in order gives.
    """
    both = save(links.select("i", "j").union(links.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct(), "links")
    open_, seeds = save(rows.select("row_id"), "open"), None
    while not open_.isEmpty():
        live = both.join(open_.select(F.col("row_id").alias("i")), "i").join(open_.select(F.col("row_id").alias("j")), "j")
        least = live.groupBy(F.col("i").alias("row_id")).agg(F.min("j").alias("m"))
        new = save(open_.join(least, "row_id", "left").where(F.col("m").isNull() | (F.col("m") > F.col("row_id"))).select("row_id"), "seeds")
        seeds = new if seeds is None else seeds.union(new)
        gone = new.union(live.join(new.select(F.col("row_id").alias("j")), "j").select("i"))
        open_ = save(open_.join(gone, "row_id", "left_anti"), "open")
    if seeds is None:
        return rows.select("row_id", F.col("row_id").alias("seed"))
    # a seed of a later round may stand before one of an earlier round, so rows are claimed when all seeds are known
    held = save(seeds, "seeds")
    claims = both.join(held.select(F.col("row_id").alias("j")), "j").groupBy(F.col("i").alias("row_id")).agg(F.min("j").alias("seed"))
    return held.select("row_id", F.col("row_id").alias("seed")).union(claims.join(held, "row_id", "left_anti"))


def hierarchy(points: DataFrame, target: int = 1000, k: int = 8, quantile: float = 0.5, least_reduction: float = 0.05, candidates: int | None = None) -> tuple[DataFrame, DataFrame]:
    """levels (level, rep, x) and ancestry (level, row_id, rep): ever fewer representatives, each a row of the cloud.

    A level's rows that are near each other at their local scale are grouped, and a group's medoid
    stands for it on the next level; with candidates it is weighed among so many members only. It ends at the target, or where a level shrinks too little.
    """
    now = save(points.select("row_id", "x"), "level")
    n, level = now.count(), 0
    levels = now.select(F.lit(0).alias("level"), F.col("row_id").alias("rep"), "x")
    parents = save(now.select(F.col("row_id"), F.col("row_id").alias("rep")), "parents")
    ancestry = parents.select(F.lit(0).alias("level"), "row_id", "rep")
    while n > target:
        near = save(knn(now, min(k, n - 1)), "neighbors")
        scales = kth_scale(near)
        a, b = (scales.select(F.col("row_id").alias(c), F.col("scale").alias(f"s{c}")) for c in ("i", "j"))
        limit = F.broadcast(density_threshold(near, quantile))
        links = near.join(a, "i").join(b, "j").join(limit).where(F.sqrt("d2") / F.sqrt(F.col("si") * F.col("sj")) <= F.col("threshold"))
        grouped = save(now.join(greedy_cover(now, links), "row_id"), "grouped")
        chosen = medoids(grouped, "seed", candidates).select("seed", F.col("row_id").alias("medoid"))
        step = save(grouped.join(chosen, "seed").select(F.col("row_id").alias("rep"), "medoid"), "step")
        fewer = step.select(F.col("medoid").alias("row_id")).distinct().join(now, "row_id")
        fewer = save(fewer, "level")
        m = fewer.count()
        if m > n * (1 - least_reduction):
            break
        level, n, now = level + 1, m, fewer
        parents = save(parents.join(step, "rep").select("row_id", F.col("medoid").alias("rep")), "parents")
        levels = levels.union(now.select(F.lit(level), "row_id", "x"))
        ancestry = ancestry.union(parents.select(F.lit(level), "row_id", "rep"))
    return levels, ancestry


def composed(lower: DataFrame, upper: DataFrame) -> DataFrame:
    """row_id, rep: the representatives (row_id, rep) of representatives. Each of lower has one in upper, where it is a row."""
    return lower.select("row_id", F.col("rep").alias("via")).join(upper.select(F.col("row_id").alias("via"), "rep"), "via").select("row_id", "rep")


def shared_descendants(a: DataFrame, b: DataFrame) -> DataFrame:
    """a_rep, b_rep, shared: how many rows of the cloud both representatives stand for, where any."""
    own = a.select("row_id", F.col("rep").alias("a_rep")).join(b.select("row_id", F.col("rep").alias("b_rep")), "row_id")
    return own.groupBy("a_rep", "b_rep").agg(F.count_distinct("row_id").alias("shared"))


def corridor(ancestry: DataFrame, kept: DataFrame) -> DataFrame:
    """row_id: rows of the cloud whose representative is one of kept (rep)."""
    return ancestry.join(kept.select("rep").distinct(), "rep", "left_semi").select("row_id")


def descendant_support(ancestry: DataFrame) -> DataFrame:
    """level, rep, descendants, share: how many rows of the cloud, and which share, a representative stands for."""
    counted = ancestry.groupBy("level", "rep").agg(F.count_distinct("row_id").alias("descendants"))
    return counted.withColumn("share", F.col("descendants") / F.sum("descendants").over(Window.partitionBy("level")))
