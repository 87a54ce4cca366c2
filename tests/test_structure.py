"""Resampling, ribs, ways, rings, regions and matches, held against plain single-process forms."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadmap.operators import groups, junctions, paths, ranges, replicates
from threadmap.operators.cloud import standardized
from threadmap.operators.neighbors import knn, local_scale, union_edges
from threadmap.operators.routes import segments
from threadmap.plans import coverage, model, stability
from threadmap.sources.tables import save


def cloud_of(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "row_id long, x array<double>")


def edges_of(points, k):
    return save(union_edges(knn(points, k)).select("src", "dst", F.sqrt("d2").alias("length")), "edges")


def plane(seed=0, n=160):
    rng = np.random.default_rng(seed)
    return np.column_stack((rng.uniform(-1.0, 1.0, size=(n, 2)), np.zeros(n)))


def circle(n, noise=0.0, seed=0):
    t, rng = np.linspace(0, 2 * np.pi, n, endpoint=False), np.random.default_rng(seed)
    return np.column_stack([np.cos(t), np.sin(t)]) + rng.normal(0, noise, (n, 2)) if noise else np.column_stack([np.cos(t), np.sin(t)])


def star(arms, n=60, noise=0.0, seed=0):
    rng = np.random.default_rng(seed)
    t = np.linspace(0, 1, n)[1:]
    x = np.vstack([[[0.0, 0.0]], *(np.outer(t, [math.cos(a), math.sin(a)]) for a in 2 * np.pi * np.arange(arms) / arms)])
    return x + rng.normal(0, noise, x.shape) if noise else x


# rows within a radius


@pytest.mark.parametrize("d", [1, 2, 3, 5])
def test_range_join_equals_all_pairs(spark, d):
    rng = np.random.default_rng(d)
    x, c, r = rng.normal(size=(200, d)), rng.normal(size=(20, d)), rng.uniform(0.1, 1.2, 20)
    centers = spark.createDataFrame([(i, v.tolist(), float(q)) for i, (v, q) in enumerate(zip(c, r))], "center long, c array<double>, radius double")
    got = {(g["center"], g["row_id"]) for g in ranges.range_join(cloud_of(spark, x), centers).collect()}
    far = np.sqrt(((c[:, None] - x[None]) ** 2).sum(2))
    assert got == {(i, j) for i, j in zip(*np.nonzero(far <= r[:, None]))}


@pytest.mark.parametrize("d,radius", [(1, 0.05), (2, 0.2), (4, 0.9)])
def test_single_linkage_equals_a_plain_one(spark, monkeypatch, d, radius):
    monkeypatch.setattr(ranges, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(150, d)), np.repeat(rng.normal(size=(1, d)), 60, axis=0)])
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= radius
    root = np.arange(len(x))
    while True:
        new = np.where(near, root[None], len(x)).min(1)
        if (new == root).all():
            break
        root = new
    got = {r["row_id"]: r["component"] for r in ranges.near_components(cloud_of(spark, x), radius).collect()}
    assert got == dict(enumerate(root.tolist())) and 1 < len(set(root)) < len(x)


def test_regions_weigh_places_and_take_medians(spark):
    rows = [(0, [0.0, 0.0], 3, 1.0), (1, [1.0, 0.0], 4, 3.0), (2, [9.0, 0.0], 5, 0.0), (3, [9.0, 0.5], 3, 0.0), (4, [9.0, 1.0], 3, 0.0)]
    got = {r["region"]: r for r in ranges.merged_regions(spark.createDataFrame(rows, "row_id long, x array<double>, branches long, confidence double"), 1.0).collect()}
    assert got[0]["x"] == pytest.approx([0.75, 0.0]) and got[0]["branches"] == 4 and got[0]["confidence"] == pytest.approx(2.5) and got[0]["members"] == 2
    assert got[2]["x"] == pytest.approx([9.0, 0.5]) and got[2]["branches"] == 3 and got[2]["members"] == 3


@pytest.mark.parametrize("order", [("d", "i", "j"), ("i", "d", "j")])
def test_matching_equals_going_through_the_pairs(spark, order):
    rng = random.Random(5)
    pairs = [(g, i, j, rng.randrange(4) / 2) for g in range(3) for i in range(12) for j in range(10) if rng.random() < 0.5]  # many ties
    at = {"i": 1, "j": 2, "d": 3}
    want, used = set(), set()
    for p in sorted(pairs, key=lambda p: [p[at[c]] for c in order]):
        if (p[0], "i", p[1]) not in used and (p[0], "j", p[2]) not in used:
            used |= {(p[0], "i", p[1]), (p[0], "j", p[2])}
            want.add(p[:3])
    got = ranges.greedy_matching(spark.createDataFrame(pairs, "g int, i int, j int, d double"), order, "g")
    assert {(r["g"], r["i"], r["j"]) for r in got.collect()} == want


def test_references_take_their_nearest_in_turn(spark):
    a, b = cloud_of(spark, [[0.0], [0.1], [5.0]]), cloud_of(spark, [[0.05], [0.3], [9.0]])
    assert {(r["i"], r["j"]) for r in ranges.matched_within(a, b, 0.5).collect()} == {(0, 0), (1, 1)}


# rings


def arms_at(spark, x, at, base, k=6):
    points = cloud_of(spark, x)
    centers = spark.createDataFrame([(0, [float(v) for v in at], base)], "center long, c array<double>, base double")
    return junctions.local_topology(points, edges_of(points, k), centers).first()


@pytest.mark.parametrize("arms", [3, 4, 5])
def test_a_star_has_its_arms_about_the_middle(spark, arms):
    got = arms_at(spark, star(arms), [0.0, 0.0], 0.3)
    assert got["branches"] == arms and got["confidence"] == 1.0


def test_two_arms_on_a_circle_and_one_at_an_end(spark):
    assert arms_at(spark, circle(120), [1.0, 0.0], 0.3)["branches"] == 2
    assert arms_at(spark, star(3), [1.0, 0.0], 0.2)["branches"] == 1
    assert arms_at(spark, star(3), [7.0, 7.0], 0.2)["branches"] == 1  # no rows in any ring


def test_ties_of_scales_go_to_fewer_arms(spark):
    counts = spark.createDataFrame([(0, 0, 4), (0, 1, 3), (0, 2, 4), (0, 3, 3)], "center long, scale int, arms long")
    assert tuple(junctions.branch_modes(counts).first()) == (0, 3, 0.5)


def test_regions_of_a_star_are_one_junction_and_its_ends(spark):
    points = cloud_of(spark, star(4, noise=0.004))
    centers = points.select(F.col("row_id").alias("center"), F.col("x").alias("c"), F.lit(0.12).alias("base"))
    topology = save(junctions.local_topology(points, edges_of(points, 6), centers), "topology")
    found = junctions.regions(points, topology, 0.1).collect()
    middle = [r for r in found if r["kind"] == "junction"]
    assert len(middle) == 1 and np.linalg.norm(middle[0]["x"]) < 0.1 and middle[0]["branches"] == 4
    ends = [r for r in found if r["kind"] == "end"]
    assert len(ends) == 4 and all(np.linalg.norm(r["x"]) > 0.85 for r in ends)


# ways


def test_ways_equal_a_plain_search(spark):
    rng = random.Random(2)
    n = 40
    edges = {(i, j): rng.randrange(1, 9) / 4 for i in range(n) for j in range(i + 1, n) if rng.random() < 0.08}
    table = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src long, dst long, length double")
    sources = spark.createDataFrame([(100 + s, s) for s in (0, 7, 21)], "search long, node long")
    got = {(r["search"], r["node"]): r["length"] for r in paths.distances(table, sources).collect()}
    for s in (0, 7, 21):
        best = {s: 0.0}
        for _ in range(n):
            for (a, b), w in edges.items():
                for p, q in ((a, b), (b, a)):
                    if p in best and best[p] + w < best.get(q, math.inf):
                        best[q] = best[p] + w
        assert {k[1]: v for k, v in got.items() if k[0] == 100 + s} == pytest.approx(best)
    found = save(paths.distances(table, sources), "found")
    targets = save(found.groupBy("search").agg(F.max_by("node", "length").alias("node")), "targets")
    ways = {}
    for r in paths.walked(found, targets).orderBy("search", "step").collect():
        ways.setdefault(r["search"], []).append(r["node"])
    for search, nodes in ways.items():
        assert nodes[0] == search - 100
        assert sum(edges[min(a, b), max(a, b)] for a, b in zip(nodes, nodes[1:])) == pytest.approx(got[search, nodes[-1]])


def test_searches_with_edges_of_their_own(spark):
    table = spark.createDataFrame([(0, 1, 2, 1.0), (1, 1, 2, 5.0), (1, 2, 3, 1.0)], "search long, src long, dst long, length double")
    got = {(r["search"], r["node"]): r["length"] for r in paths.distances(table, spark.createDataFrame([(0, 1), (1, 1)], "search long, node long")).collect()}
    assert got == {(0, 1): 0.0, (0, 2): 1.0, (1, 1): 0.0, (1, 2): 5.0, (1, 3): 6.0}


def test_paths_reach_the_cloud_with_their_ends(spark):
    """Rows of a half circle, every fourth of which stands for four rows on the first level, and every twelfth for twelve on the second."""
    n = 120
    t = np.linspace(0, np.pi, n)
    points = cloud_of(spark, np.column_stack([np.cos(t), np.sin(t)]))
    levels = points.select(F.lit(0).alias("level"), F.col("row_id").alias("rep"), "x")
    ancestry = points.select(F.lit(0).alias("level"), "row_id", F.col("row_id").alias("rep"))
    for level, step in ((1, 4), (2, 12)):
        levels = levels.union(points.where(F.col("row_id") % step == 0).select(F.lit(level), "row_id", "x"))
        ancestry = ancestry.union(points.select(F.lit(level), "row_id", F.col("row_id") - F.col("row_id") % step))
    coarse = spark.createDataFrame([(p, i, r) for p, reps in ((0, range(0, 96, 12)), (1, range(24, 60, 12))) for i, r in enumerate(reps)], "path int, at int, node long")
    rows = paths.refined_to_cloud(coarse, levels, ancestry, 2, k=4).orderBy("path", "at").collect()
    assert [r["node"] for r in rows if r["path"] == 0] == list(range(85)) and [r["node"] for r in rows if r["path"] == 1] == list(range(24, 49))
    lengths = paths.path_lengths(coarse, points).collect()
    assert {r["path"]: r["rows"] for r in lengths} == {0: 8, 1: 3} and all(r["length"] < np.pi for r in lengths)


def test_legs_without_a_way_keep_their_ends(spark):
    points = cloud_of(spark, [[0.0, 0.0], [0.1, 0.0], [0.2, 0.0], [9.0, 0.0], [9.1, 0.0], [9.2, 0.0]])
    coarse = spark.createDataFrame([(0, 0, 0), (0, 1, 2), (0, 2, 5)], "path int, at int, node long")
    children = spark.createDataFrame([(0, 0), (1, 0), (2, 2), (3, 5), (4, 5), (5, 5)], "row_id long, rep long")
    fine, lost = paths.refined(coarse, children, points, k=1)
    assert [r["node"] for r in fine.orderBy("at").collect()] == [0, 1, 2, 5]
    assert [(r["source"], r["target"]) for r in lost.collect()] == [(2, 5)]


# replicates


def test_replicates_hang_on_the_seed_alone(spark):
    points = cloud_of(spark, circle(500))
    draw = lambda p, seed: {(r["replicate"], r["row_id"]) for r in replicates.replicates(p, 4, 0.7, seed).select("replicate", "row_id").collect()}
    one = draw(points, 1)
    assert one == draw(points.repartition(7), 1) != draw(points, 2)
    assert all(300 < sum(r == k for r, _ in one) < 400 for k in range(4))
    moved = replicates.replicates(points, 2, 0.9, 1, jitter=0.1).join(points.withColumnRenamed("x", "y"), "row_id").select(F.zip_with("x", "y", lambda a, b: a - b).alias("e"))
    off = np.array([r["e"] for r in moved.collect()])
    assert abs(off.mean()) < 0.02 and off.std() == pytest.approx(0.1, rel=0.15)


def test_grouped_kmeans_finds_each_replicates_clusters(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([c + rng.normal(0, 0.05, (60, 2)) for c in ([0, 0], [4, 0], [0, 4], [4, 4])])
    rows = save(replicates.replicates(cloud_of(spark, x), 3, 0.8, 0), "rows")
    found = replicates.grouped_kmeans(rows, 4).collect()
    for k in range(3):
        c = np.array(sorted((r["c"] for r in found if r["replicate"] == k), key=lambda v: [round(x) for x in v]))
        assert c == pytest.approx(np.array([[0, 0], [0, 4], [4, 0], [4, 4]]), abs=0.1)


def test_routes_of_a_circle_and_of_a_star_come_back(spark):
    for x, routes in ((circle(400, 0.02), 1), (star(3, 120, 0.01), 3)):
        points = cloud_of(spark, x)
        fit = model.fit(points, landmarks=12)
        scaled = save(standardized(points, fit.moments), "scaled")
        scale = local_scale(scaled).first()["scale"]
        own = stability.fitted_replicates(scaled, 8, 12)
        got = {r["route_id"]: r for r in stability.route_supports(fit.segments, own, 2 * scale).collect()}
        assert len(got) == routes and all(r["support"] >= 0.75 and r["stable"] for r in got.values())
        # a route that cuts the corner at a junction needn't have a corridor there
        assert sum(r["corridor_support"] >= 0.5 for r in got.values()) >= min(routes, 2)
        # a route that isn't in the cloud isn't supported
        stray = segments(spark.createDataFrame([(9, 0, [9.0, 9.0]), (9, 1, [9.0, 12.0])], "route_id int, at int, c array<double>"))
        both = save(fit.segments.unionByName(stray), "segments")
        supports = save(stability.route_supports(both, own, 2 * scale), "supports")
        assert [tuple(r)[1:] for r in supports.where("route_id = 9").collect()] == [(0.0, 0.0, False)]
        assert stability.stable_segments(both, supports).where("route_id = 9").isEmpty()


# ribs


def middle_route(spark, x):
    return segments(spark.createDataFrame([(0, 0, [float(x[:, 0].min()), 0.0, 0.0]), (0, 1, [float(x[:, 0].max()), 0.0, 0.0])], "route_id int, at int, c array<double>"))


def test_ribs_halve_the_error_of_a_plane(spark):
    x = plane(4)
    covered = coverage.coverage_ribs(cloud_of(spark, x), save(middle_route(spark, x), "route"), 0.05, tolerance=0.05)
    errors = [h["quantile_error"] for h in covered.history]
    assert len(covered.ribs) > 0 and errors[-1] <= errors[0] / 2
    assert covered.segments.where(F.col("route_id") >= covered.first_rib).select("route_id").distinct().count() == len(covered.ribs)
    assert all(r["gain"] > 0 and 0 < r["support"] <= 1 and r["length"] > 0 for r in covered.ribs)
    first = {r["route_id"] for r in covered.ribs if r["round"] == 0}
    met = [r for r in coverage.crossings(covered.segments, covered.first_rib, 0.6).collect() if r["rib"] in first]
    assert len(met) == len(first) and all(r["route_id"] == 0 and r["angle"] < 0.6 for r in met)  # the first ribs run across the route


def test_a_ribbon_gets_no_rib_and_limits_hold(spark):
    rng = np.random.default_rng(1)
    x = np.column_stack((np.linspace(-1, 1, 160), rng.normal(0, 0.01, 160), np.zeros(160)))
    route = save(middle_route(spark, x), "route")
    assert coverage.coverage_ribs(cloud_of(spark, x), route, 0.02).ribs == []
    wide = save(cloud_of(spark, plane(4)), "wide")
    assert len(coverage.coverage_ribs(wide, route, 0.05, tolerance=0.05, most_ribs=2, rounds=1).ribs) == 2
    assert coverage.coverage_ribs(wide, route, 0.05, tolerance=0.05, rib_penalty=1e9).ribs == []
    with pytest.raises(ValueError, match="diagonal"):
        coverage.coverage_ribs(wide, route, 0.05, kind="diagonal")


def test_parallel_ribs_run_along_the_route(spark):
    x = plane(6)
    covered = coverage.coverage_ribs(cloud_of(spark, x), save(middle_route(spark, x), "route"), 0.1, tolerance=0.05, rounds=1, seeds=2, kind="parallel")
    assert covered.ribs and covered.history[-1]["quantile_error"] <= covered.history[0]["quantile_error"]


# cover


@pytest.mark.parametrize("seed", range(3))
def test_cover_equals_going_through_the_rows(spark, seed):
    rng = random.Random(seed)
    n = 60
    links = {(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.06}
    beside = {i: {j for p in links for j in p if i in p and j != i} for i in range(n)}
    want = {}
    for i in range(n):
        if i not in want:
            want[i] = i
            want |= {j: i for j in beside[i] if j not in want}
    got = groups.greedy_cover(spark.range(n).withColumnRenamed("id", "row_id"), spark.createDataFrame(sorted(links), "i long, j long"))
    assert {r["row_id"]: r["seed"] for r in got.collect()} == want


# copies


@pytest.mark.parametrize("k,share", [(3, 0.34), (6, 0.9)])
def test_neighbours_of_copies_go_by_least_ids(spark, k, share):
    rng = np.random.default_rng(k)
    x = rng.integers(-3, 4, (160, 2)).astype(float)
    x[rng.random(160) < share] = [1.0, 1.0]
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    want = {(i, r + 1): j for i in range(160) for r, j in enumerate([j for j in sorted(range(160), key=lambda j: (d2[i, j], j)) if j != i][:k])}
    got = knn(cloud_of(spark, x).repartition(5), k, pack_rows=20).collect()
    assert {(r["i"], r["rank"]): r["j"] for r in got} == want and all(r["d2"] == d2[r["i"], r["j"]] for r in got)


def jobs_of(spark, work):
    name = f"counted-{id(work)}"
    spark.sparkContext.setJobGroup(name, "counted")
    try:
        out = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_long_ways_are_few_jobs_and_the_same_as_in_rounds(spark):
    far = 2**60
    rng = np.random.default_rng(3)
    chain = [(far + i, far + i + 1, 1.0) for i in range(40)]
    some = [(int(a), int(b), float(w)) for a, b, w in zip(*rng.integers(0, 30, (2, 90)), rng.integers(0, 3, 90))]
    table = save(spark.createDataFrame(chain + some, "src long, dst long, length double"), "some-edges")
    sources = spark.createDataFrame([(0, far), (1, 3)], "search int, node long")
    got, jobs = jobs_of(spark, lambda: sorted((r["search"], r["node"], r["length"]) for r in paths.distances(table, sources).collect()))
    want = sorted((r["search"], r["node"], r["length"]) for r in paths.distances(table, sources, rounds=45).collect()) if jobs < 30 else None
    assert jobs < 30 and got == want
    way = [r["node"] for r in paths.walked(paths.distances(table, sources), spark.createDataFrame([(0, far + 40)], "search int, node long")).orderBy("step").collect()]
    assert way == [far + i for i in range(41)]


def test_ways_over_equal_rows_dont_go_in_circles(spark):
    table = spark.createDataFrame([(5, 9, 1.0), (3, 9, 0.0), (3, 4, 0.0), (4, 9, 0.0), (4, 7, 1.0)], "src long, dst long, length double")
    sources, targets = (spark.createDataFrame([(0, n)], "search int, node long") for n in (5, 7))
    for rounds in (None, 20):
        found = save(paths.distances(table, sources, rounds), "found")
        assert {r["node"]: r["length"] for r in found.collect()} == {5: 0.0, 9: 1.0, 3: 1.0, 4: 1.0, 7: 2.0}
        assert {r["node"]: r["before"] for r in found.collect()}[9] == 5


def test_matches_in_turn_dont_wait_for_each_other(spark):
    references = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(25)] + [(99, [3.0, 0.0])], "row_id long, x array<double>")
    candidates = spark.createDataFrame([(100 + i, [i + 0.01, 0.0]) for i in range(25)], "row_id long, x array<double>")
    got, jobs = jobs_of(spark, lambda: sorted((r["i"], r["j"]) for r in ranges.matched_within(references, candidates, 1.2).collect()))
    assert got == [(i, 100 + i) for i in range(25)] and jobs < 40


@pytest.mark.parametrize("width", [1, 3])
def test_matches_in_turn_of_copies_take_few_rounds(spark, width):
    """Copies of references ask for copies of candidates, some of which lie where blocks meet, and of which there are too few."""
    rng = np.random.default_rng(width)
    x, y = rng.integers(-8, 16, (12, width)) * 0.6, rng.integers(-16, 32, (9 * width, width)) * 0.3
    x, y = np.repeat(x, 20, 0)[rng.permutation(240)], np.repeat(y, 20, 0)
    left, want = np.ones(len(y), bool), []
    for i, at in enumerate(x):
        d = np.where(left, np.sqrt(((y - at) ** 2).sum(1)), np.inf)
        if d.min() <= 1.2:
            left[d.argmin()] = False
            want.append((i, int(d.argmin())))
    got, jobs = jobs_of(spark, lambda: sorted((r["i"], r["j"]) for r in ranges.matched_within(cloud_of(spark, x), cloud_of(spark, y), 1.2).collect()))
    assert got == want and 0 < len(want) < len(x) and jobs < 150  # a job for each copy and more before


def test_rings_of_many_centers_are_few_jobs_and_the_same_as_over_keys(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(50, 2))
    points = save(cloud_of(spark, x), "cloud")
    edges = save(edges_of(points, 4), "edges")
    centers = save(points.select(F.col("row_id").alias("center"), F.col("x").alias("c"), (0.3 + F.col("row_id") / 60).alias("base")), "centers")
    count = lambda: sorted(tuple(r) for r in junctions.ring_arms(points, edges, centers, junctions.scales()).collect())
    got, jobs = jobs_of(spark, count)
    monkeypatch.setattr(junctions, "MOST_EDGES", 1)
    want, _ = jobs_of(spark, count)
    assert got == want and len(got) == 300 and jobs < 15


def test_rings_of_copies_are_counted_once(spark, monkeypatch):
    """Four copies of each row: some joined by edges, some not, and copies of centers."""
    x = np.repeat(np.random.default_rng(4).normal(size=(40, 2)), 4, 0)
    points = save(cloud_of(spark, x), "cloud")
    apart = [(i, i + 1, 0.0) for i in range(0, 160, 4)] + [(i + 1, i + 2, 0.0) for i in range(0, 80, 4)]
    edges = save(edges_of(points, 5).where("length > 0").union(spark.createDataFrame(apart, "src long, dst long, length double")), "edges")
    centers = save(points.select(F.col("row_id").alias("center"), F.col("x").alias("c"), F.lit(0.6).alias("base")), "centers")
    seen, own = [], junctions._ring_arms

    def counted(points, edges, centers, *rest):
        seen.append((points.count(), centers.count()))
        return own(points, edges, centers, *rest)

    want = sorted(tuple(r) for r in own(points, edges, centers, junctions.scales(), junctions.INNER, junctions.LONGEST).collect())
    monkeypatch.setattr(junctions, "_ring_arms", counted)
    got = sorted(tuple(r) for r in junctions.ring_arms(points, edges, centers, junctions.scales()).collect())
    assert got == want and len(got) == 960 and len({r[2] for r in got}) > 3
    assert seen == [(20 * 2 + 20 * 3, 40)]  # all 160 and 160 before


def test_distances_of_long_routes_are_those_of_all_pairs(spark):
    from threadmap.operators.routes import directed_distances

    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(600, 24)), rng.normal(size=(300, 24))
    routes = [spark.createDataFrame([(r % 2, r // 2, [float(v) for v in x]) for r, x in enumerate(m)], "route_id int, at int, c array<double>") for m in (a, b)]
    got = {}
    for r in directed_distances(*routes).collect():
        got.setdefault((r["a_route"], r["b_route"]), []).append(r["d"])
    for i in range(2):
        for j in range(2):
            want = np.sqrt(((a[i::2, None] - b[None, j::2]) ** 2).sum(2).min(1))
            assert np.allclose(sorted(got[i, j]), sorted(want))


def test_candidates_of_neighbours_grow_with_rows_and_not_with_files(spark, monkeypatch):
    from threadmap.operators import neighbors as nb

    confs = {"spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.openCostInBytes": str(1 << 27)}
    before = {c: spark.conf.get(c) for c in confs}
    monkeypatch.setattr(nb, "TASKS_PER_CORE", 1)
    try:
        for c, v in confs.items():
            spark.conf.set(c, v)
        x = np.random.default_rng(5).normal(0, 1, (300, 8))
        found = save(nb._candidates(cloud_of(spark, x), 5, 10), "candidates")
        assert found.count() == 300 * 5  # a file each for all 12 partitions gave each row 5 of every one
        d2 = ((x[:, None] - x[None]) ** 2).sum(2)
        np.fill_diagonal(d2, np.inf)
        got = {i: set() for i in range(300)}
        for r in found.collect():
            got[r["i"]].add(r["j"])
        assert all(got[i] == set(np.argsort(d2[i])[:5].tolist()) for i in range(300))
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
