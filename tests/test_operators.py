import numpy as np
import pytest
from pyspark.sql import functions as F

from threadmap.operators import features as ft
from threadmap.operators import graph, groups, routes
from threadmap.operators import neighbors as nb
from threadmap.plans import model
from threadmap.sources import generators


def points(spark, rows, labels=None):
    data = [(i, [float(v) for v in r], int(labels[i]) if labels is not None else 0) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "row_id long, x array<double>, label int")


def brute_knn(x, k):
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d2, np.inf)
    return [sorted((d2[i, j], j) for j in range(len(x)) if j != i)[:k] for i in range(len(x))]


@pytest.mark.parametrize("pack_rows", [7, 1000])
def test_knn_is_exact(spark, pack_rows):
    x = np.random.default_rng(0).normal(size=(60, 3))
    x[10:14] = x[9]
    got = {(r["i"], r["rank"]): (r["d2"], r["j"]) for r in nb.knn(points(spark, x), 4, pack_rows).collect()}
    for i, want in enumerate(brute_knn(x, 4)):
        for rank, (d2, j) in enumerate(want, 1):
            assert got[i, rank] == (pytest.approx(d2, abs=1e-12), j)


def test_packs_that_meet_are_not_shuffled(spark):
    x = np.random.default_rng(1).normal(size=(60, 3))
    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near = nb.knn(points(spark, x), 4, 5)
        plan = near._jdf.queryExecution().executedPlan().toString()
        got = sorted((r["i"], r["rank"], r["j"]) for r in near.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)
    assert "SortMergeJoin" not in plan and "CartesianProduct" in plan
    assert got == [(i, rank, j) for i, want in enumerate(brute_knn(x, 4)) for rank, (_, j) in enumerate(want, 1)]


def test_chain_components_and_tree(spark):
    p = points(spark, [[0], [1], [3], [10]])
    mutual = nb.mutual_edges(nb.knn(p, 1))
    sizes = graph.components(p.select(F.col("row_id").alias("node")), mutual).groupBy("component").count()
    assert sorted(r["count"] for r in sizes.collect()) == [1, 1, 2]
    every = spark.createDataFrame([(a, b, float(abs(u - v))) for a, u in enumerate([0, 1, 3, 10]) for b, v in enumerate([0, 1, 3, 10]) if a < b], "src long, dst long, length double")
    tree = graph.spanning_forest(p.select(F.col("row_id").alias("node")), every).collect()
    assert sorted((r["src"], r["dst"]) for r in tree) == [(0, 1), (1, 2), (2, 3)]
    assert graph.cycle_rank(p.select(F.col("row_id").alias("node")), every).first()["cycle_rank"] == 3


def test_all_equal_rows(spark):
    p = points(spark, [[1.0, 1.0]] * 5)
    assert nb.local_scale(p).first()["scale"] == nb.LEAST_SCALE
    assert groups.duplicate_groups(p).collect() == [(0, 5)]
    assert model.fit(p, landmarks=1).edges.count() == 0


def test_medoids_and_ties(spark):
    p = points(spark, [[0.0], [1.0], [5.0], [6.0], [7.0]], [0, 0, 1, 1, 1])
    assert {r["label"]: r["row_id"] for r in groups.medoids(p, "label").collect()} == {0: 0, 1: 3}
    assert {r["label"]: r["row_id"] for r in groups.medoids(p, "label", 10).collect()} == {0: 0, 1: 3}


def test_greedy_cover_is_in_order_of_ids(spark):
    rows = spark.range(6).withColumnRenamed("id", "row_id")
    links = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)], "i long, j long")
    assert {r["row_id"]: r["seed"] for r in groups.greedy_cover(rows, links).collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4}


def test_hierarchy_partitions_rows(spark):
    levels, ancestry = groups.hierarchy(generators.circle(spark, 200), target=60)
    assert levels.agg(F.max("level")).first()[0] >= 1
    per_level = ancestry.groupBy("level").agg(F.count("*").alias("n"), F.count_distinct("row_id").alias("d")).collect()
    assert all(r["n"] == r["d"] == 200 for r in per_level)


def test_projection_agrees_with_batches_and_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 2))
    corners = [[-1.0, 0.0], [0.0, 0.0], [0.0, 1.0], [0.0, 1.0]]
    v = spark.createDataFrame([(0, i, c) for i, c in enumerate(corners)], "route_id int, at int, c array<double>")
    segs = routes.segments(v)
    a = {r["row_id"]: r for r in routes.project(points(spark, x), segs).collect()}
    b = {r["row_id"]: r for r in routes.project_batches(points(spark, x).repartition(5), segs).collect()}
    for i, p in enumerate(x):
        best = min((round(float(((p - (np.array(s) + t * (np.array(e) - np.array(s)))) ** 2).sum()), 9), k)
                   for k, (s, e) in enumerate(zip(corners, corners[1:]))
                   for t in [np.clip(np.dot(p - np.array(s), np.array(e) - np.array(s)) / max(1e-30, float(((np.array(e) - np.array(s)) ** 2).sum())), 0, 1)])
        assert (a[i]["seg"], b[i]["seg"]) == (best[1], best[1])
        assert a[i]["d2"] == pytest.approx(best[0], abs=1e-8) and b[i]["position"] == pytest.approx(a[i]["position"])


@pytest.mark.parametrize("place", [routes.project, routes.project_batches])
def test_ties_at_a_shared_vertex_that_round_apart_go_to_the_first_segment(spark, place):
    rng = np.random.default_rng(5)
    corners = rng.normal(size=(3, 64))
    first, second = corners[1] - corners[0], corners[2] - corners[1]
    off = rng.normal(size=(20_000, 64))
    off = off[(off @ first > 1) & (off @ second < -1)][:3000]
    off *= np.sqrt((64 + 0.5e-9) / (off * off).sum(1))[:, None]  # squared lengths lie where the ninth decimal rounds up or down
    v = spark.createDataFrame([(0, i, [float(c) for c in corner]) for i, corner in enumerate(corners)], "route_id int, at int, c array<double>")
    got = place(points(spark, corners[1] + off), routes.segments(v)).select("seg", "alpha").collect()
    assert len(got) == 3000 and {tuple(r) for r in got} == {(0, 1.0)}


def test_closed_routes(spark):
    v = spark.createDataFrame([(0, i, c) for i, c in enumerate([[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]])], "route_id int, at int, c array<double>")
    segs = routes.segments(v, closed=True).orderBy("seg").collect()
    assert len(segs) == 3 and segs[2]["v"] == [-1.0, -1.0] and segs[2]["t1"] == 1.0


def test_kernel_covariance(spark):
    rng = np.random.default_rng(0)
    t, r = rng.random(100), rng.normal(size=(100, 3))
    rows = spark.createDataFrame([(0, float(p), [float(v) for v in q]) for p, q in zip(t, r)], "route_id int, position double, residual array<double>")
    for closed in (False, True):
        got = {(x["g"], x["i"], x["j"]): x["value"] for x in routes.kernel_covariance(rows, [0.0, 0.5], 0.1, 3, closed).collect()}
        for g, place in enumerate([0.0, 0.5]):
            away = np.abs(t - place)
            away = np.minimum(away, 1 - away) if closed else away
            w = np.exp(-0.5 * ((away - away.min()) / 0.1) ** 2)
            c = (r * w[:, None]).T @ r / w.sum()
            assert all(got[g, i, j] == pytest.approx(c[i, j]) for i in range(3) for j in range(i, 3))


def test_star_has_a_route_for_each_arm_and_round_trips(spark, tmp_path):
    cloud = generators.star(spark, 1200)
    fitted = model.fit(cloud, landmarks=12)
    assert fitted.segments.select("route_id").distinct().count() == 4
    out = fitted.transform(cloud)
    assert out.count() == 1200 and routes.coverage(out).first()["median"] < 0.1
    gap = out.select(F.max(F.aggregate(F.zip_with(F.zip_with("projected", "residual", lambda a, b: a + b), "x", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, v: s + v))).first()[0]
    assert gap < 1e-9
    fitted.save(str(tmp_path / "m"))
    again = model.RouteModel.load(spark, str(tmp_path / "m")).place(cloud).agg(F.sum("d2")).first()[0]
    assert again == pytest.approx(fitted.place(cloud).agg(F.sum("d2")).first()[0])


def test_supports_and_labels(spark):
    hits = spark.createDataFrame([("a", True), ("a", False), ("b", True)], "k string, hit boolean")
    assert {r["k"]: r["support"] for r in routes.support(hits, "k", "hit").collect()} == {"a": 0.5, "b": None}
    rows = spark.createDataFrame([(0, 1), (0, 2), (1, 5)], "route_id int, label int")
    assert {r["route_id"]: (r["label"], r["purity"]) for r in ft.purity(rows).collect()} == {0: (1, 0.5), 1: (5, 1.0)}


def test_out_of_fold_accuracy(spark):
    from pyspark.ml.classification import DecisionTreeClassifier

    rows = spark.createDataFrame([(i, [float(i % 2), float(i)], i % 2) for i in range(60)], "row_id long, features array<double>, label int")
    assert ft.out_of_fold_accuracy(rows, DecisionTreeClassifier(), 3) == 1.0


def test_nearest_takes_the_least_ids_of_ties_and_holds_far_from_the_origin():
    from threadmap.operators.neighbors import _nearest

    rng = np.random.default_rng(5)
    tied = np.repeat(rng.normal(size=(3, 4)), 100, axis=0)
    far = 1e8 + rng.integers(0, 9, (300, 4)) / 4
    for x in (tied, far):
        ids = rng.permutation(len(x))
        rows, j, d2 = _nearest(x, ids, x, ids, 6)
        want = [(i, n, d) for i in range(len(x)) for d, n in sorted((float(((x[i] - x[m]) ** 2).sum()), int(ids[m])) for m in range(len(x)) if m != i)[:6]]
        assert list(zip(rows.tolist(), j.tolist())) == [w[:2] for w in want]
        assert np.allclose(d2, [w[2] for w in want])


def test_packs_are_bytes_that_tasks_read_in_place(spark):
    x = np.random.default_rng(4).normal(size=(60, 3))
    held = nb.packs(points(spark, x), 10)
    assert dict(held.dtypes)["ids"] == dict(held.dtypes)["xs"] == "binary"
    got = {}
    for r in held.collect():
        ids = np.frombuffer(r["ids"], "<i8")
        got.update(zip(ids.tolist(), np.frombuffer(r["xs"], "<f8").reshape(len(ids), -1).tolist()))
    assert got == dict(enumerate(x.tolist()))


@pytest.mark.parametrize("shift", [0.0, 30.0, 1e6])
def test_single_precision_rules_no_neighbour_out(shift):
    x = np.round(np.random.default_rng(5).normal(size=(400, 5)), 1) + shift
    ids = np.arange(400)[::-1].copy()
    best = nb._Best(x[:200], ids[:200], 5, nb._bounds(x[:200], ids[:200], x[:200], ids[:200], 5))
    for at in range(0, 400, 100):
        best.add(x[at : at + 100], ids[at : at + 100])
    got = {}
    for r, j in zip(best.rows.tolist(), best.j.tolist()):
        got.setdefault(r, []).append(j)
    for i in range(200):
        d2 = np.zeros(400)
        for f in range(5):
            d2 += (x[i, f] - x[:, f]) ** 2
        assert got[i] == [j for _, j in sorted(zip(d2.tolist(), ids.tolist())) if j != ids[i]][:5]


def test_medoid_blocks_meet_without_a_shuffle(spark):
    x = np.random.default_rng(6).normal(size=(90, 2))
    p = points(spark, x).withColumn("g", F.when(F.col("row_id") < 80, 0).otherwise(F.col("row_id")))
    found = groups.medoids(p, "g", block_rows=16)
    assert "CartesianProduct" in found._jdf.queryExecution().toString()
    got = {r["g"]: (r["row_id"], r["n"]) for r in found.collect()}
    cost = np.sqrt(((x[:80, None] - x[None, :80]) ** 2).sum(2)).sum(1)
    assert got == {0: (int(cost.argmin()), 80), **{i: (i, 1) for i in range(80, 90)}}
