"""Synthetic clouds: noisy samples of known shapes, drawn row by row in the JVM.

Every draw is a hash of seed, row and place, so a cloud is the same however it is
partitioned, and a generator of any size needs no shuffle and no driver memory.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TAU = 2 * math.pi


def uniform(seed: int, k: int, row: str = "row_id") -> Column:
    """In [0, 1), by seed, draw number and row."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(k), row), F.lit(1 << 40)) / F.lit(float(1 << 40))


def normal(seed: int, k: int) -> Column:
    return F.sqrt(-2 * F.log(uniform(seed, 2 * k + 1000) + 1e-15)) * F.cos(uniform(seed, 2 * k + 1001) * TAU)


def _noisy(rows: DataFrame, coordinates: list[Column], noise: float, seed: int, carry: tuple[str, ...] = ()) -> DataFrame:
    return rows.select("row_id", F.array(*(c + noise * normal(seed, i) for i, c in enumerate(coordinates))).alias("x"), *carry)


def _rows(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "row_id")


def line(spark: SparkSession, n: int, noise: float = 0.045, seed: int = 0) -> DataFrame:
    return _noisy(_rows(spark, n), [uniform(seed, 0) * 2.4 - 1.2, F.lit(0.0)], noise, seed)


def circle(spark: SparkSession, n: int, noise: float = 0.045, seed: int = 0) -> DataFrame:
    angle, radius = uniform(seed, 0) * TAU, 1 + 0.45 * noise * normal(seed, 50)
    return _noisy(_rows(spark, n), [radius * F.cos(angle), radius * F.sin(angle)], noise, seed)


def figure_eight(spark: SparkSession, n: int, noise: float = 0.045, seed: int = 0) -> DataFrame:
    angle = uniform(seed, 0) * TAU
    return _noisy(_rows(spark, n), [F.sin(angle), F.sin(angle) * F.cos(angle)], noise, seed)


def torus(spark: SparkSession, n: int, noise: float = 0.045, seed: int = 0, major: float = 1.0, minor: float = 0.35) -> DataFrame:
    if not major > minor > 0:
        raise ValueError("major > minor > 0 is needed")
    a, b = uniform(seed, 0) * TAU, uniform(seed, 1) * TAU
    ring = major + minor * F.cos(b)
    return _noisy(_rows(spark, n), [ring * F.cos(a), ring * F.sin(a), minor * F.sin(b)], noise, seed)


def spiral(spark: SparkSession, n: int, noise: float = 0.045, seed: int = 0, turns: float = 1.15) -> DataFrame:
    t = uniform(seed, 0)
    radius, angle = 0.1 + 0.9 * t, t * turns * TAU
    return _noisy(_rows(spark, n), [radius * F.cos(angle), radius * F.sin(angle)], noise, seed)


def segments(spark: SparkSession, n: int, ends: list[tuple[list[float], list[float]]], noise: float = 0.045, seed: int = 0) -> DataFrame:
    """Points on segments, each chosen in proportion to its length. The segments are a small literal table."""
    sizes = [math.dist(a, b) for a, b in ends]
    whole, at, places = sum(sizes), 0.0, []
    for (a, b), size in zip(ends, sizes):
        places.append((at / whole, (at + size) / whole, a, b))
        at += size
    listed = spark.createDataFrame(places, "lo double, hi double, a array<double>, b array<double>")
    drawn = _rows(spark, n).withColumn("u", uniform(seed, 0)).join(F.broadcast(listed), (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    t = (F.col("u") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    return _noisy(drawn, [F.get("a", F.lit(i)) * (1 - t) + F.get("b", F.lit(i)) * t for i in range(len(ends[0][0]))], noise, seed)


def star(spark: SparkSession, n: int, noise: float = 0.045, seed: int = 0, branches: int = 4) -> DataFrame:
    if branches < 2:
        raise ValueError("a star has two branches at least")
    ends = [([0.0, 0.0], [1.25 * math.cos(TAU * i / branches), 1.25 * math.sin(TAU * i / branches)]) for i in range(branches)]
    return segments(spark, n, ends, noise, seed)


def binary_tree(spark: SparkSession, n: int, noise: float = 0.045, seed: int = 0, depth: int = 3) -> DataFrame:
    """A complete binary tree: levels from 1.2 down to -1.2, the nodes of each spread evenly from -1.25 to 1.25."""
    if depth < 1:
        raise ValueError("a tree has a depth of one at least")

    def place(level: int, k: int) -> list[float]:
        return [2.5 * k / (2**level - 1) - 1.25 if level else 0.0, 1.2 - 2.4 * level / depth]

    return segments(spark, n, [(place(d, k // 2), place(d + 1, k)) for d in range(depth) for k in range(2 ** (d + 1))], noise, seed)


def hypercube(spark: SparkSession, n: int, noise: float = 0.045, seed: int = 0, dimensions: int = 3) -> DataFrame:
    if dimensions < 1:
        raise ValueError("a cube has one dimension at least")
    corner = lambda k: [1.0 if k >> i & 1 else -1.0 for i in range(dimensions)]
    ends = [(corner(k), corner(k | 1 << i)) for k in range(2**dimensions) for i in range(dimensions) if not k >> i & 1]
    return segments(spark, n, ends, noise, seed)


def loop_with_branch(spark: SparkSession, n: int, noise: float = 0.045, seed: int = 0) -> DataFrame:
    """The first 78 rows in a hundred on the unit circle, the others on a stem that leaves it."""
    on_loop, t = F.col("row_id") < round(0.78 * n), uniform(seed, 0)
    x = F.when(on_loop, F.cos(t * TAU)).otherwise(1 + 0.95 * t)
    y = F.when(on_loop, F.sin(t * TAU)).otherwise(0.75 * t)
    return _noisy(_rows(spark, n), [x, y], noise, seed)


def polygon_with_rays(spark: SparkSession, n: int, noise: float = 0.045, seed: int = 0, sides: int = 5, radius: float = 1.0, circle_radius: float = 0.22) -> DataFrame:
    """A polygon, a ray from its center to each corner, and a circle outside that touches each corner; drawn by length."""
    if sides < 3 or radius <= 0 or circle_radius <= 0:
        raise ValueError("three sides and positive radii are needed")
    corner = lambda i, r: (r * math.cos(math.pi / 2 + TAU * i / sides), r * math.sin(math.pi / 2 + TAU * i / sides))
    straight = [(corner(i, radius), corner(i + 1, radius)) for i in range(sides)] + [((0.0, 0.0), corner(i, radius)) for i in range(sides)]
    parts = [(math.dist(a, b), *a, b[0] - a[0], b[1] - a[1], 0.0) for a, b in straight]
    parts += [(TAU * circle_radius, *corner(i, radius + circle_radius), 0.0, 0.0, circle_radius) for i in range(sides)]
    whole, at, places = sum(p[0] for p in parts), 0.0, []
    for size, *shape in parts:
        places.append((at / whole, (at + size) / whole, *shape))
        at += size
    listed = spark.createDataFrame(places, "lo double, hi double, px double, py double, vx double, vy double, r double")
    drawn = _rows(spark, n).withColumn("u", uniform(seed, 0)).join(F.broadcast(listed), (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    t = (F.col("u") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    x = F.col("px") + t * F.col("vx") + F.col("r") * F.cos(t * TAU)
    y = F.col("py") + t * F.col("vy") + F.col("r") * F.sin(t * TAU)
    return _noisy(drawn, [x, y], noise, seed)


def lifted(points: DataFrame, noise: float, seed: int = 9) -> DataFrame:
    """The cloud with one more coordinate of noise."""
    return points.withColumn("x", F.concat("x", F.array(noise * normal(seed, 7))))


GENERATORS = {
    "line": line, "star": star, "circle": circle, "figure_eight": figure_eight, "torus": torus, "binary_tree": binary_tree,
    "loop_with_branch": loop_with_branch, "polygon_with_rays": polygon_with_rays, "hypercube": hypercube, "spiral": spiral,
}
