"""Nearest-neighbour joins and the edges that come of them.

``knn`` is exact and never forms all pairs of rows. Rows go to the cell of their nearest
pivot, cells are cut into packs of a bounded number of rows, and a pack meets another one
only where the triangle inequality leaves room for a neighbour that is near enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import distance
from ..sources.tables import save

#: Rows of a pack, about, and pivots, at most: these are sent to all tasks.
PACK_ROWS, MOST_PIVOTS = 1024, 4096
#: Tasks for each core that go through pairs of packs, at least, where there are as many pairs of parts of the files.
TASKS_PER_CORE = 4
#: Groups of equal rows that hold over one in so many rows are joined by broadcast.
HOT_KEYS = 1000
#: Squared distances up to which rows count as duplicates; least scale.
DUPLICATE, LEAST_SCALE = 1e-24, 1e-8


def _matrix(column) -> np.ndarray:
    return np.array(column.tolist() if hasattr(column, "tolist") else list(column), float)


def _gram(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T


def _bounds(a: np.ndarray, a_ids: np.ndarray, b: np.ndarray, b_ids: np.ndarray, k: int) -> np.ndarray:
    """For each row of a a squared distance within which k other rows of b lie; infinite where there are fewer."""
    if len(b) < k:
        return np.full(len(a), np.inf)
    d2 = _gram(a, b)
    d2[a_ids[:, None] == b_ids[None, :]] = np.inf
    return np.maximum(np.partition(d2, k - 1, axis=1)[:, k - 1], 0) + 2 * _slack(a.shape[1], (a * a).sum(1) + (b * b).sum(1).max())


def _slack(width: int, norms: np.ndarray, kind: type = float) -> np.ndarray:
    """By how much either form of a squared distance may be off in that precision, where norms are those of both rows."""
    return 4 * (width + 4) * np.finfo(kind).eps * norms


class _Best:
    """The k nearest rows of each row of a pack, out of the packs that were added.

    The expanded form, in single precision where that is near enough, only rules out rows that its rounding can't bring among
    the nearest; the distances of all others, of which ties make any number, are summed directly. Of ties the least ids are kept.
    """

    def __init__(self, x: np.ndarray, ids: np.ndarray, k: int, bound: np.ndarray):
        self.ids, self.k, self.bound = ids, k, bound
        self.rows, self.j, self.d2 = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.hold(x)

    def hold(self, x: np.ndarray) -> None:
        """Takes the pack's rows, which ``rest`` let go."""
        self.x, self.norms = x, (x * x).sum(1)
        with np.errstate(over="ignore"):
            self.single = x.astype(np.float32)

    def rest(self) -> None:
        """Keeps the neighbours so far and lets the rows go."""
        self.x = self.norms = self.single = None

    def add(self, b: np.ndarray, b_ids: np.ndarray) -> None:
        norms = (b * b).sum(1)
        far = self.norms + norms.max()
        single = 2 * _slack(b.shape[1], far, np.float32)
        rough = far.max() < 1e30 and bool((single <= 0.1 * self.bound).all())
        if rough:
            d2, room = self.single @ b.astype(np.float32).T, self.bound * (1 + 1e-6) + single
        else:
            d2, room = self.x @ b.T, self.bound + 2 * _slack(b.shape[1], far)
        d2 *= -2
        d2 += norms.astype(d2.dtype)[None, :]
        # the row's own norm is taken to the other side
        rows, at = np.divmod(np.flatnonzero(d2 <= (room - self.norms).astype(d2.dtype)[:, None]), len(b))
        other = self.ids[rows] != b_ids[at]
        rows, at = rows[other], at[other]
        if not len(rows):
            return
        exact = np.zeros(len(rows))
        for j in range(b.shape[1]):
            exact += (self.x[rows, j] - b[at, j]) ** 2
        rows, ids, exact = np.r_[self.rows, rows], np.r_[self.j, b_ids[at]], np.r_[self.d2, exact]
        order = np.lexsort((ids, exact, rows))
        rows, ids, exact = rows[order], ids[order], exact[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        last = place == self.k - 1
        self.bound[rows[last]] = np.minimum(self.bound[rows[last]], exact[last])
        some = place < self.k
        self.rows, self.j, self.d2 = rows[some], ids[some], exact[some]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (self.ids[self.rows], self.j, self.d2)], names=["i", "j", "d2"])


def _nearest(a: np.ndarray, a_ids: np.ndarray, b: np.ndarray, b_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of a the k nearest rows of b other than themselves: places in a, ids in b, squared distances."""
    best = _Best(a, a_ids, k, _bounds(a, a_ids, b, b_ids, k))
    best.add(b, b_ids)
    return best.rows, best.j, best.d2


def _as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs with ids and xs as the bytes of their numbers, one pack at a time: tasks read them in place, however often packs meet."""
    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            ids, xs = one.column("ids").flatten().to_numpy(), one.column("xs").flatten().flatten().to_numpy(zero_copy_only=False)
            bytes_ = [pa.array([v.tobytes()], pa.binary()) for v in (ids.astype("<i8"), xs.astype("<f8"))]
            yield pa.RecordBatch.from_arrays([one.column("cell"), *bytes_, one.column("radius")], names=["cell", "ids", "xs", "radius"])


def _pack(ids: pa.Scalar, xs: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """The ids and rows of a pack from their bytes, without a copy."""
    own = np.frombuffer(ids.as_buffer(), "<i8")
    return own, np.frombuffer(xs.as_buffer(), "<f8").reshape(len(own), -1)


def packs(points: DataFrame, pack_rows: int = PACK_ROWS) -> DataFrame:
    """The saved packs: pack, ids, xs (bytes), and the center and radius of a ball that holds them."""
    n = points.count()
    pivots = _matrix([r["x"] for r in points.orderBy(F.xxhash64("row_id"), "row_id").limit(min(MOST_PIVOTS, -(-n // pack_rows) or 1)).select("x").collect()])
    shared = points.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if len(frame):
                x = _matrix(frame["x"])
                cell = _gram(x, shared.value).argmin(1)
                yield frame.assign(cell=cell, away=np.sqrt(((x - shared.value[cell]) ** 2).sum(1)))

    held = save(points.select("row_id", "x").mapInPandas(assign, "row_id long, x array<double>, cell int, away double"), "cells")
    sizes = held.groupBy("cell").agg(F.ceil(F.count("*") / pack_rows).cast("int").alias("parts"))
    cut = held.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("row_id"), F.col("parts")))
    packed = cut.groupBy("cell", "part").agg(F.collect_list("row_id").alias("ids"), F.collect_list("x").alias("xs"), F.max("away").alias("radius"))
    packed = packed.select("cell", "ids", "xs", "radius").mapInArrow(_as_bytes, "cell int, ids binary, xs binary, radius double")

    def centered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield pd.DataFrame({"cell": frame["id"], "center": list(shared.value[frame["id"]])})

    centers = points.sparkSession.range(len(pivots)).mapInPandas(centered, "cell int, center array<double>")
    return save(packed.join(F.broadcast(centers), "cell").select(F.monotonically_increasing_id().alias("pack"), "ids", "xs", "center", "radius"), "packs")


def knn(points: DataFrame, k: int, pack_rows: int = PACK_ROWS, distinct: bool = False) -> DataFrame:
    """i, j, d2, rank: the k nearest other rows of each row, ties to the least id.

    Equal rows are one while packs meet, so copies cost no more than the rows that they are written to; distinct says that there are none.
    """
    rows = points.select("row_id", "x")
    if distinct:
        return _knn(rows, k, pack_rows)
    groups = save(rows.groupBy("x").agg(F.min("row_id").alias("rep"), F.count("*").alias("times")), "distinct-rows")
    near = _knn(groups.select(F.col("rep").alias("row_id"), "x"), k, pack_rows)
    copies = groups.where("times > 1")
    if copies.isEmpty():
        return near
    return _of_copies(save(rows, "rows"), groups, save(near, "distinct-neighbors"), k)


def _joined_by(rows: DataFrame, keyed: DataFrame, key: str, total: int) -> DataFrame:
    """rows with what keyed (key once, times: how many rows have it) has; keys of over a thousandth of all rows, of which there are a thousand at most, are broadcast."""
    hot = F.col("times") * HOT_KEYS > total
    many = keyed.where(hot)
    apart = rows.join(F.broadcast(many.select(key)), key, "left_anti").join(keyed.where(~hot), key)
    return rows.join(F.broadcast(many), key).unionByName(apart)


def _of_copies(rows: DataFrame, groups: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """The neighbours of all rows from those of distinct ones: the nearest of the k + 1 least ids of a row's own group and of its neighbours' groups."""
    total = groups.agg(F.sum("times")).first()[0]
    member = save(_joined_by(rows, groups, "x", total).select("row_id", "rep", "times"), "members")

    def least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield frame.sort_values("row_id").groupby("rep").head(k + 1)

    # each batch gives k + 1 ids of a group at most
    few = member.where("times > 1").select("rep", "row_id").mapInPandas(least, "rep long, row_id long")
    listed = save(few.groupBy("rep").agg(F.slice(F.array_sort(F.collect_list("row_id")), 1, k + 1).alias("ids")), "least-ids")
    others = near.select("i", F.col("j").alias("rep"), "d2").join(listed, "rep", "left").select("i", "d2", F.explode(F.coalesce("ids", F.array("rep"))).alias("id"))
    own = listed.select(F.col("rep").alias("i"), F.lit(0.0).alias("d2"), F.explode("ids").alias("id"))
    order = F.row_number().over(Window.partitionBy("i").orderBy("d2", "id"))
    best = others.unionByName(own).withColumn("o", order).where(F.col("o") <= k + 1)
    lists = best.groupBy(F.col("i").alias("rep")).agg(F.array_sort(F.collect_list(F.struct("d2", "id"))).alias("best")).join(groups.select("rep", "times"), "rep")
    met = _joined_by(member.select("row_id", "rep"), save(lists, "neighbor-lists"), "rep", total)
    kept = met.select(F.col("row_id").alias("i"), F.posexplode(F.slice(F.filter("best", lambda s: s["id"] != F.col("row_id")), 1, k)).alias("at", "s"))
    return kept.select("i", F.col("s.id").alias("j"), F.col("s.d2").alias("d2"), (F.col("at") + 1).alias("rank"))


def _knn(points: DataFrame, k: int, pack_rows: int) -> DataFrame:
    """The neighbours of rows, of which few are equal."""
    ranked = _candidates(points, k, pack_rows).withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("d2", "j")))
    return ranked.where(F.col("rank") <= k)


def _candidates(points: DataFrame, k: int, pack_rows: int) -> DataFrame:
    """i, j, d2: among them the k nearest other rows of each row.

    Pairs of packs are a Cartesian product of the saved files, which tasks read by themselves, so packs aren't shuffled however
    many others they meet. The product's partitions are coalesced: a task takes one part of the files through all parts, one after
    the other, and keeps k neighbours of each of its rows, so what is shuffled after it grows with rows alone. Where there are fewer
    parts than cores, a part is taken through by more than one task.
    """
    packed = packs(points, pack_rows)
    parts = packed.rdd.getNumPartitions()
    tasks = parts * min(parts, -(-TASKS_PER_CORE * points.sparkSession.sparkContext.defaultParallelism // max(1, parts)))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds = []
            for ids, xs in zip(batch.column("ids"), batch.column("xs")):
                ids, x = _pack(ids, xs)
                bounds.append(float(np.sqrt(_bounds(x, ids, x, ids, k).max())))
            yield pa.RecordBatch.from_arrays([batch.column("pack"), pa.array(bounds, pa.float64())], names=["pack", "bound"])

    bounds = save(packed.select("pack", "ids", "xs").mapInArrow(own, "pack long, bound double"), "bounds")  # a row for each pack
    left = packed.join(F.broadcast(bounds), "pack").select(F.col("pack").alias("q"), F.col("ids").alias("q_ids"), F.col("xs").alias("q_xs"), F.col("center").alias("q_center"), F.col("radius").alias("q_radius"), "bound")
    right = packed.select("ids", "xs", "center", "radius").hint("shuffle_replicate_nl")
    apart = distance(F.col("q_center"), F.col("center")) - F.col("q_radius") - F.col("radius")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a pack comes again for each part of the files; only its neighbours so far are held in between
        now, best, met = None, None, {}
        for batch in batches:
            for q, q_ids, q_xs, ids, xs in zip(*batch.columns):
                if q.as_py() != now:
                    if best is not None:
                        best.rest()
                    own_ids, x = _pack(q_ids, q_xs)
                    # a copy, so no batch is held
                    now, x = q.as_py(), x.copy()
                    best = met.get(now)
                    if best is None:
                        own_ids = own_ids.copy()
                        best = met[now] = _Best(x, own_ids, k, _bounds(x, own_ids, x, own_ids, k))
                    else:
                        best.hold(x)
                ids, x = _pack(ids, xs)
                best.add(x, ids)
        for best in met.values():
            yield best.batch()

    near = left.join(right, apart <= F.col("bound") * (1 + 1e-9) + 1e-9)
    return near.select("q", "q_ids", "q_xs", "ids", "xs").coalesce(max(1, tasks)).mapInArrow(compare, "i long, j long, d2 double")


def union_edges(neighbors: DataFrame) -> DataFrame:
    """src < dst, d2: an edge where either row is among the other's neighbours."""
    return neighbors.groupBy(F.least("i", "j").alias("src"), F.greatest("i", "j").alias("dst")).agg(F.min("d2").alias("d2"))


def mutual_edges(neighbors: DataFrame) -> DataFrame:
    """src < dst, d2: an edge where each row is among the other's neighbours."""
    both = neighbors.groupBy(F.least("i", "j").alias("src"), F.greatest("i", "j").alias("dst")).agg(F.min("d2").alias("d2"), F.count("*").alias("n"))
    return both.where(F.col("n") == 2).drop("n")


def kth_scale(neighbors: DataFrame) -> DataFrame:
    """row_id, scale: the distance of the last neighbour, with a floor."""
    return neighbors.groupBy(F.col("i").alias("row_id")).agg(F.greatest(F.sqrt(F.max("d2")), F.lit(LEAST_SCALE)).alias("scale"))


def conductances(edges: DataFrame, scales: DataFrame) -> DataFrame:
    """src, dst, length, conductance, density. conductance is exp(-d2 / (s_src s_dst)).

    density is the conductance over the median scale, clipped to [0, 1].
    """
    a = scales.select(F.col("row_id").alias("src"), F.col("scale").alias("sa"))
    b = scales.select(F.col("row_id").alias("dst"), F.col("scale").alias("sb"))
    middle = F.broadcast(scales.agg(F.percentile("scale", 0.5).alias("middle")))
    c = F.exp(-F.col("d2") / (F.col("sa") * F.col("sb")))
    joined = edges.join(a, "src").join(b, "dst").join(middle)
    return joined.select("src", "dst", F.sqrt("d2").alias("length"), c.alias("conductance"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c / F.col("middle"))).alias("density"))


def local_scale(points: DataFrame) -> DataFrame:
    """One row, scale: the median over rows of the distance to the nearest row that is no duplicate, with a floor.

    Equal rows are joined to one of them first, and weigh by their number.
    """
    groups = save(points.groupBy("x").agg(F.min("row_id").alias("row_id"), F.count("*").alias("times")), "distinct-rows")
    n, k = groups.count(), 2
    while True:
        # where the k nearest rows of some are all duplicates within the tolerance, more are looked at
        near = save(knn(groups, min(k, max(1, n - 1)), distinct=True).where(F.col("d2") > DUPLICATE).groupBy(F.col("i").alias("row_id")).agg(F.sqrt(F.min("d2")).alias("d")), "scales")
        if k >= n - 1 or groups.join(near, "row_id", "left_anti").isEmpty():
            break
        k *= 8
    middle = near.join(groups.select("row_id", "times"), "row_id").agg(F.percentile("d", 0.5, F.col("times")).alias("scale"))
    return middle.select(F.greatest(F.coalesce("scale", F.lit(LEAST_SCALE)), F.lit(LEAST_SCALE)).alias("scale"))


def density_threshold(neighbors: DataFrame, q: float) -> DataFrame:
    """One row, threshold: the quantile of neighbour distances over the root of both scales' product."""
    s = kth_scale(neighbors)
    a, b = (s.select(F.col("row_id").alias(n), F.col("scale").alias(f"s{n}")) for n in ("i", "j"))
    scaled = neighbors.join(a, "i").join(b, "j").select((F.sqrt("d2") / F.sqrt(F.col("si") * F.col("sj"))).alias("r"))
    return scaled.agg(F.percentile("r", q).alias("threshold"))


def degrees(edges: DataFrame) -> DataFrame:
    """row_id, degree."""
    return edges.select(F.explode(F.array("src", "dst")).alias("row_id")).groupBy("row_id").agg(F.count("*").alias("degree"))


def annulus_counts(points: DataFrame, centers: DataFrame, inner: float, outer: float) -> DataFrame:
    """center, n: the rows between the radii about each center (center, c); the centers, checked to be few, go to all tasks."""
    from .groups import as_row

    bands = as_row(centers, "center", "c")
    away = F.transform("all", lambda s: F.struct(s["center"].alias("center"), F.sqrt(F.aggregate(F.zip_with("x", s["c"], lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda t, v: t + v)).alias("d")))
    inside = points.join(bands).select(F.explode(F.filter(away, lambda s: (s["d"] >= inner) & (s["d"] <= outer))).alias("s"))
    return inside.groupBy(F.col("s.center").alias("center")).agg(F.count("*").alias("n"))


def label_agreement(neighbors: DataFrame, labels: DataFrame, rank: int = 1) -> DataFrame:
    """One row, accuracy: how often the neighbour of that rank has the row's own label."""
    a = labels.select(F.col("row_id").alias("i"), F.col("label").alias("own"))
    b = labels.select(F.col("row_id").alias("j"), F.col("label").alias("other"))
    near = neighbors.where(F.col("rank") == rank).join(a, "i").join(b, "j")
    return near.agg(F.avg((F.col("own") == F.col("other")).cast("double")).alias("accuracy"), F.count("*").alias("n"))
