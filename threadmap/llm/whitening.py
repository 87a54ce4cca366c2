"""Whitening of embeddings by a tiled covariance.

Components become whole numbers, whose sums by dimension are exact. Each batch of rows is a row block
and is cut into column blocks of centred values. Blocks of the same rows meet by shuffle, a
pair of column blocks is a tile of dimension pairs, and every task adds up its products
by tile, so what is summed is as many small matrices as there are tiles. No task holds more than
two column blocks, and the driver gets the covariance alone, whose size the dimensions bound.

The covariance is assembled there and decomposed; a last pass projects the rows, and
the covariance of what it wrote is compared with the identity.

Defined cases: rows whose vector is null, empty or holds a null or a component that isn't finite are
dropped; repeated rows count each; a null id is returned as null. Components with next to no
variance (below LEAST_SHARE of the largest eigenvalue) are null in ``whitened`` and
are left out of ``identity_error``. With fewer dimensions than components asked for there are as many
as dimensions. An empty table gives no rows. Vectors of different widths and whole numbers of
LARGEST or more raise an error. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import finite_vectors, matrix, save

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
#: Dimensions of a column block.
TILE = 32
#: Whole numbers below this are exact as doubles after centring.
LARGEST = 1 << 40
LEAST_SHARE = 1e-12
_LOW = 26


def whole_numbers(rows: DataFrame, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """vec_id, x: floor(SCALE * component) + OFFSET for finite vectors."""
    x = F.transform(F.col(vector), lambda v: F.floor(SCALE * v.cast("double")).cast("long") + OFFSET)
    return finite_vectors(rows, vector).select(F.col(vec_id).alias("vec_id"), x.alias("x"))


@dataclass
class Sums:
    """How many rows there are, and the exact sum of each dimension."""

    n: int
    s: list[int]

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean as a whole part and what is left of it, so that centring loses no digits."""
        whole = [v // self.n for v in self.s]
        return np.array(whole, np.int64), np.array([(v - w * self.n) / self.n for v, w in zip(self.s, whole)])

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole, rest = self.centre()
        return (x - whole).astype(float) - rest

    def deviations(self, x: np.ndarray) -> list[int]:
        """The exact sum over dimensions of (n x - S)**2 for each row."""
        whole, _ = self.centre()
        y = self.n * (x - whole) - np.array([v - w * self.n for v, w in zip(self.s, whole.tolist())], np.int64)
        high, low = y >> _LOW, y & ((1 << _LOW) - 1)
        parts = ((high * high).sum(1), (high * low).sum(1), (low * low).sum(1))
        return [(a << 2 * _LOW) + (b << _LOW + 1) + c for a, b, c in zip(*(p.tolist() for p in parts))]


def sums(own: DataFrame) -> Sums | None:
    """The sums of rows (vec_id, x); None where there is no row."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, least, most = 0, None, 0, 0
        for batch in batches:
            if len(batch):
                sizes = np.diff(batch.column(0).offsets.to_numpy())
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False)
                if sizes.min() != sizes.max() or (total is not None and len(total) != sizes[0]):
                    raise ValueError("vectors of different widths")
                if np.abs(x).max() >= LARGEST:
                    raise ValueError(f"whole numbers of {LARGEST} or more")
                s = x.reshape(len(batch), -1).sum(0)
                total, n = (s if total is None else total + s), n + len(batch)
        if n:
            yield pa.record_batch([pa.array(np.arange(-1, len(total)), pa.int32()), pa.array([n, *total.tolist()])], ["j", "s"])

    found = own.select("x").mapInArrow(add, "j int, s long").groupBy("j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.count("*").alias("tasks"))
    listed = sorted(found.collect(), key=lambda r: r["j"])  # a row for each dimension
    if not listed:
        return None
    if len({r["tasks"] for r in listed}) > 1:
        raise ValueError("vectors of different widths")
    return Sums(int(listed[0]["s"]), [int(r["s"]) for r in listed[1:]])


def column_blocks(own: DataFrame, of: Sums, tile: int = TILE) -> DataFrame:
    """rows, block, data: each batch of centred rows cut into column blocks of doubles, rows being the batch's number."""
    shared = own.sparkSession.sparkContext.broadcast(of)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            if len(batch):
                y = shared.value.centred(matrix(batch.column(0)))
                blocks = [y[:, i : i + tile].tobytes() for i in range(0, y.shape[1], tile)]
                yield pa.record_batch([pa.array([at] * len(blocks)), pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary())], ["rows", "block", "data"])
                at += 1

    return own.select("x").mapInArrow(cut, "rows long, block int, data binary")


def tiled_covariance(own: DataFrame, of: Sums, tile: int = TILE) -> np.ndarray:
    """The covariance of all dimensions: pairs of column blocks of the same rows multiplied, and summed by tile."""
    blocks = save(column_blocks(own, of, tile), "column-blocks")
    right = blocks.select("rows", F.col("block").alias("other"), F.col("data").alias("beside"))
    # tiles of one block with itself need no other one
    pairs = blocks.join(right, "rows").where("block <= other").select("block", "other", "data", "beside")
    width = len(of.s)
    wide = lambda i: min(tile, width - i * tile)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i, j, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                product = np.frombuffer(a).reshape(-1, wide(i)).T @ np.frombuffer(b).reshape(-1, wide(j))
                total[i, j] = total[i, j] + product if (i, j) in total else product
        for (i, j), m in total.items():
            n = m.size
            yield pa.record_batch([pa.array([i] * n, pa.int32()), pa.array([j] * n, pa.int32()), pa.array(np.arange(n, dtype=np.int32)), pa.array(m.ravel())], ["i", "j", "at", "s"])

    tiles = pairs.mapInArrow(multiply, "i int, j int, at int, s double").groupBy("i", "j", "at").agg(F.sum("s").alias("s"))
    covariance = np.zeros((width, width))
    for r in tiles.toLocalIterator():  # a row for each pair of dimensions
        a, b = divmod(r["at"], wide(r["j"]))
        covariance[r["i"] * tile + a, r["j"] * tile + b] = covariance[r["j"] * tile + b, r["i"] * tile + a] = r["s"]
    return covariance / of.n


@dataclass
class Whitening:
    """The sums, and the eigenvalues (falling) and eigenvectors (columns) of the covariance."""

    of: Sums
    values: np.ndarray
    vectors: np.ndarray

    def explained(self) -> np.ndarray:
        whole = self.values.sum()
        return self.values / whole if whole > 0 else np.full(len(self.values), np.nan)

    def usable(self, components: int) -> np.ndarray:
        return self.values[:components] > max(self.values[0], 0) * LEAST_SHARE


def fitted(own: DataFrame, tile: int = TILE) -> Whitening | None:
    """The whitening of rows (vec_id, x); None where there is no row."""
    of = sums(own)
    if of is None:
        return None
    values, vectors = np.linalg.eigh(tiled_covariance(own, of, tile))
    return Whitening(of, values[::-1].copy(), vectors[:, ::-1].copy())


def projected(own: DataFrame, fit: Whitening, components: int = COMPONENTS) -> DataFrame:
    """vec_id, deviation (exact), w: the whitened coordinates of each row, null along components without variance."""
    components = min(components, len(fit.values))
    shared = own.sparkSession.sparkContext.broadcast(fit)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = shared.value
        some = fit.usable(components)
        scale = np.sqrt(np.where(some, fit.values[:components], 1))
        for batch in batches:
            if len(batch):
                x = matrix(batch.column(1))
                w = (fit.of.centred(x) @ fit.vectors[:, :components]) / scale
                flat = pa.array(w.ravel(), mask=np.tile(~some, len(w)))
                listed = pa.ListArray.from_arrays(np.arange(0, w.size + 1, components, dtype=np.int32), flat)
                exact = pa.array([Decimal(v) for v in fit.of.deviations(x)], pa.decimal128(38, 0))
                yield pa.record_batch([batch.column(0), exact, listed], ["vec_id", "deviation", "w"])

    kind = own.schema["vec_id"].dataType.simpleString()
    return own.select("vec_id", "x").mapInArrow(project, f"vec_id {kind}, deviation decimal(38,0), w array<double>")


def identity_error(rows: DataFrame, components: int) -> float | None:
    """The largest absolute entry of the covariance of w minus the identity, over components with variance; None without any."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, s, n = np.zeros((components, components)), np.zeros(components), 0
        for batch in batches:
            if len(batch):
                w = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, components)
                m, s, n = m + w.T @ w, s + w.sum(0), n + len(w)
        yield pa.record_batch([pa.array(np.arange(m.size + components + 1)), pa.array(np.r_[m.ravel(), s, n])], ["at", "s"])

    found = dict(rows.select("w").mapInArrow(add, "at long, s double").groupBy("at").agg(F.sum("s")).collect())  # a row for each pair of components
    flat = np.array([found[i] for i in range(len(found))])
    n, mean = flat[-1], flat[components**2 : -1] / flat[-1]
    away = flat[: components**2].reshape(components, components) / n - np.outer(mean, mean) - np.eye(components)
    some = ~np.isnan(np.diag(away))
    return float(np.abs(away[some][:, some]).max()) if some.any() else None


def whitened(rows: DataFrame, components: int = COMPONENTS, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """vec_id, component (from 1), n, deviation (null where no long holds it), whitened, explained, identity_error for each finite row and component."""
    own = whole_numbers(rows, vector, vec_id)
    fit = fitted(own)
    if fit is None:
        return own.select("vec_id", *(F.lit(0).cast(k).alias(c) for c, k in (("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))))
    out = save(projected(own, fit, components), "whitened")
    components = min(components, len(fit.values))
    error = identity_error(out, components)
    share = F.array(*(F.lit(None if np.isnan(v) else float(v)).cast("double") for v in fit.explained()[:components]))
    each = out.select("vec_id", F.expr("try_cast(deviation AS long)").alias("deviation"), F.posexplode("w").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(fit.of.n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
