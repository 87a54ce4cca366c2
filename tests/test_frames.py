"""Frames, lookups, augmented graphs, generators: small cases with known results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadmap.operators import frames, graph, groups, lookups, routes
from threadmap.operators import neighbors as nb
from threadmap.sources import generators


def cloud(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "row_id long, x array<double>")


@pytest.mark.parametrize("d", [2, 3, 7])
def test_normal_frames_are_orthonormal_and_fixed_by_the_tangent(d):
    rng = np.random.default_rng(d)
    for tangent in [rng.standard_normal(d), np.eye(d)[0], np.eye(d)[-1], np.zeros(d)]:
        basis = frames.normal_frame(tangent)
        assert basis.shape == (d, d - 1) and np.allclose(basis.T @ basis, np.eye(d - 1)) and np.allclose(tangent @ basis, 0) == (tangent.any() or d > 0)
        assert (basis[np.abs(basis).argmax(0), np.arange(d - 1)] > 0).all()


def line_rows(spark, n=200, seed=10):
    """Rows about the first axis whose residuals lie mostly along the second."""
    rng = np.random.default_rng(seed)
    points = cloud(spark, np.c_[np.linspace(-1, 1, n), 0.2 * rng.standard_normal(n), 0.03 * rng.standard_normal(n)])
    segs = spark.createDataFrame([(0, 0, [-1.0, 0.0, 0.0], [2.0, 0.0, 0.0], 0.0, 1.0)], "route_id int, seg int, s array<double>, v array<double>, t0 double, t1 double")
    return frames.normal_coordinates(routes.decomposed(routes.project(points, segs)))


def test_residual_coordinates_follow_the_main_axis_in_any_batch(spark):
    rows = line_rows(spark)
    grid = [0.0, 0.5, 1.0]
    axes = frames.fitted_axes(rows, grid, 0.3, 1, 2)
    assert all(abs(r["axes"][0][0]) > 0.98 for r in axes.collect())
    every = {r["row_id"]: r for r in frames.residual_coordinates(rows, axes, grid).collect()}
    few = {r["row_id"]: r for r in frames.residual_coordinates(rows.where("row_id % 7 = 3").repartition(3), axes, grid).collect()}
    assert all(np.allclose(few[i]["residual_coordinates"], every[i]["residual_coordinates"]) and few[i]["unexplained_residual_norm"] == pytest.approx(every[i]["unexplained_residual_norm"]) for i in few)
    for r in every.values():
        assert np.allclose(np.array(r["reconstructed"]) + r["unexplained_residual"], r["x"])
        assert r["unexplained_residual_norm"] <= r["residual_norm"] + 1e-12
    whole = frames.residual_coordinates(rows, frames.fitted_axes(rows, grid, 0.3, 2, 2), grid)
    assert whole.agg(F.max("unexplained_residual_norm")).first()[0] < 1e-9


def test_chain_of_four_needs_the_spanning_tree(spark):
    points = cloud(spark, [[0], [1], [3], [10]])
    near = nb.knn(points, 1)
    nodes = points.select(F.col("row_id").alias("node"))
    mutual = nb.mutual_edges(near).select("src", "dst", F.sqrt("d2").alias("length"))
    assert sorted(r["n"] for r in graph.components(nodes, mutual).groupBy("component").agg(F.count("*").alias("n")).collect()) == [1, 1, 2]
    whole = graph.mst_augmented(nodes, mutual, nb.union_edges(near).select("src", "dst", F.sqrt("d2").alias("length")))
    assert sorted((r["src"], r["dst"], r["length"], r["is_mst"]) for r in whole.collect()) == [(0, 1, 1.0, False), (1, 2, 2.0, True), (2, 3, 7.0, True)]
    joined = graph.bridges(points, graph.components(nodes, mutual).select(F.col("node").alias("row_id"), "component"))
    assert sorted((r["src"], r["dst"], r["length"]) for r in joined.collect()) == [(1, 2, 2.0), (2, 3, 7.0)]


def test_short_branches_are_pruned_round_after_round(spark):
    edges = spark.createDataFrame([(0, 1, 5.0), (1, 2, 5.0), (1, 3, 0.5), (3, 4, 0.5)], "src long, dst long, length double")
    assert sorted((r["src"], r["dst"]) for r in graph.pruned(edges, 1.0).collect()) == [(0, 1), (1, 2)]


def test_local_scale_passes_by_rows_that_are_all_but_equal(spark):
    assert nb.local_scale(cloud(spark, [[0], [1e-13], [2e-13], [1], [5]])).first()["scale"] == pytest.approx(1.0)
    assert nb.local_scale(cloud(spark, [[0], [0]])).first()["scale"] == pytest.approx(1e-8)


def test_numbers_seeds_and_farthest_points(spark):
    points = cloud(spark, [[(i * 37) % 101, 0] for i in range(101)])
    got = lookups.numbered(points.withColumn("v", F.col("x")[0]), "v").orderBy("v").collect()
    assert [r["number"] for r in got] == list(range(101)) and {r["whole"] for r in got} == {101}
    tiles = [r["t"] for r in spark.range(17).select(lookups.tile(F.col("id"), F.lit(17), 5).alias("t")).collect()]
    assert tiles == [r["t"] for r in spark.sql("SELECT ntile(5) OVER (ORDER BY id) AS t FROM range(17)").collect()]
    seeds = lookups.spaced_seeds(points.withColumn("s", F.col("x")[0]), "s", 4, 30.0)
    assert [r["score"] for r in seeds.collect()] == [100.0, 70.0, 40.0, 10.0]
    assert [r["away"] for r in lookups.farthest_points(points, 3).collect()] == [0.0, 100.0, 50.0]
    assert lookups.farthest_points(points.limit(0), 3).count() == 0


def test_medoids_weigh_all_members(spark):
    rng = np.random.default_rng(8)
    x = np.r_[rng.standard_normal((300, 4)), np.repeat([[3.0, 0, 0, 0]], 40, 0)]
    points = cloud(spark, x).withColumn("g", (F.col("row_id") % 2).cast("int"))
    apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for r in groups.medoids(points, "g", block_rows=32).collect():
        own = np.arange(len(x))[np.arange(len(x)) % 2 == r["g"]]
        costs = apart[np.ix_(own, own)].sum(1)
        assert r["row_id"] == own[np.round(costs, 9).argmin()] and r["cost"] == pytest.approx(costs.min()) and r["n"] == len(own)
    two = spark.createDataFrame([(8, [0.0], 1), (3, [1.0], 1)], "row_id long, x array<double>, g int")
    assert groups.medoids(two, "g").first()["row_id"] == 3


def test_shapes_of_generators(spark):
    tree = np.array([r["x"] for r in generators.binary_tree(spark, 3000, noise=0.0, depth=2).collect()])
    assert tree[:, 1].max() == pytest.approx(1.2, abs=0.01) and tree[:, 1].min() == pytest.approx(-1.2, abs=0.01) and abs(tree[:, 0]).max() == pytest.approx(1.25, abs=0.01)
    loop = np.array([r["x"] for r in generators.loop_with_branch(spark, 1000, noise=0.0).orderBy("row_id").collect()])
    assert np.allclose((loop[:780] ** 2).sum(1), 1) and np.allclose((loop[780:, 0] - 1) / 0.95, loop[780:, 1] / 0.75)
    rays = np.array([r["x"] for r in generators.polygon_with_rays(spark, 4000, noise=0.0).collect()])
    away = np.sqrt((rays**2).sum(1))
    assert away.min() < 0.05 and away.max() == pytest.approx(1.44, abs=0.01)
    corners = np.array([[math.cos(math.pi / 2 + math.tau * i / 5), math.sin(math.pi / 2 + math.tau * i / 5)] for i in range(5)])
    outside = rays[away > 1.0001]
    assert np.allclose(np.abs(np.sqrt(((outside[:, None] - 1.22 * corners) ** 2).sum(-1)) - 0.22).min(1), 0, atol=1e-9)
    for wrong in (lambda: generators.binary_tree(spark, 5, depth=0), lambda: generators.polygon_with_rays(spark, 5, sides=2), lambda: generators.polygon_with_rays(spark, 5, radius=0), lambda: generators.hypercube(spark, 5, dimensions=0)):
        with pytest.raises(ValueError):
            wrong()


def test_loops_are_closed_routes_and_components_stay_apart(spark):
    from threadmap.plans import model
    from threadmap.plans.network import chains, kept_edges

    def fitted(points, landmarks):
        m = model.fit(points, landmarks=landmarks)
        segs = m.segments.groupBy("route_id").agg(F.max("closed").alias("closed")).collect()
        degrees = sorted(r["degree"] for r in nb.degrees(m.edges).collect())
        return sorted(r["closed"] for r in segs), degrees, m

    ring, degrees, m = fitted(generators.circle(spark, 800), 14)
    assert ring == [True] and set(degrees) == {2}
    assert routes.coverage(m.transform(generators.circle(spark, 800))).first()["median"] < 0.1
    inner = generators.circle(spark, 500, seed=4).select((F.col("row_id") + 10_000).alias("row_id"), F.transform("x", lambda v: 0.42 * v).alias("x"))
    assert fitted(generators.circle(spark, 800).union(inner), 22)[0] == [True, True]
    star, degrees, _ = fitted(generators.star(spark, 1200), 12)
    assert star == [False] * 4 and degrees.count(4) == 1 and degrees.count(1) == 4
    assert fitted(generators.line(spark, 500), 8)[0] == [False]
    assert chains([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (2, 3, 1.0)]) == [([2, 0, 1], True), ([2, 3], False)]
    assert kept_edges([(0, 1, 50, 1.0), (1, 2, 50, 1.0), (0, 2, 40, 1.5), (2, 3, 5, 1.0), (3, 4, 50, 1.0), (4, 5, 1, 0.1)]) == [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0)]
