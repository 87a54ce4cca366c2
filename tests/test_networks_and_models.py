"""Resistances, cubes, scaling, and the fields of transformed rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadmap.operators import electrical, junctions, scaling
from threadmap.operators.cloud import standardized
from threadmap.operators.frames import wide_kernel_covariance
from threadmap.operators.routes import kernel_covariance
from threadmap.plans import model


def cloud_of(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "row_id long, x array<double>")


def resistors(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, conductance double")


def test_resistances_in_series_and_parallel(spark):
    # a bridge of one resistor, two in parallel by way of node 3, and a component of its own
    rows = [(0, 1, 2.0), (1, 2, 1.0), (1, 3, 0.5), (3, 2, 0.25), (10, 11, 4.0)]
    got = {(r["src"], r["dst"]): (r["resistance"], r["leverage"]) for r in electrical.effective_resistances(resistors(spark, rows), at_once=3).collect()}
    assert got[0, 1] == pytest.approx((0.5, 1.0)) and got[10, 11] == pytest.approx((0.25, 1.0))
    assert got[1, 2] == pytest.approx((1 / (1 + 1 / 6), 6 / 7))
    assert sum(v for _, v in got.values()) == pytest.approx(6 - 2)  # nodes less components
    flow = {(r["src"], r["dst"]): r["current"] for r in electrical.currents(resistors(spark, rows), 0, 2).collect()}
    assert flow == pytest.approx({(0, 1): 1.0, (1, 2): 6 / 7, (1, 3): 1 / 7, (3, 2): 1 / 7, (10, 11): 0.0}, abs=1e-9)
    assert electrical.currents(resistors(spark, rows), 0, 11).agg(F.sum(F.abs("current"))).first()[0] == 0.0


def frame_of_a_cube(n, d, noise, seed=7):
    rng = np.random.default_rng(seed)
    x = rng.choice([-1.0, 1.0], (n, d))
    x[np.arange(n), rng.integers(0, d, n)] = rng.uniform(-1, 1, n)
    return x + rng.normal(0, noise, x.shape)


def test_a_cube_has_eight_corners_and_six_faces(spark):
    got = junctions.hypercube(standardized(cloud_of(spark, frame_of_a_cube(1000, 3, 0.05))), 0.05)
    assert got["dimension"] == 3 and got["faces"] == 6 and len(got["corners"]) == 8 and all(c["branches"] == 3 for c in got["corners"])
    assert len({tuple(np.sign(c["x"])) for c in got["corners"]}) == 8
    rng = np.random.default_rng(0)
    assert junctions.hypercube(standardized(cloud_of(spark, rng.normal(size=(600, 3)))), 0.05) is None
    assert junctions.hypercube(cloud_of(spark, rng.normal(size=(600, 2))), 0.05) is None
    assert junctions.hypercube(cloud_of(spark, rng.normal(size=(20, 3))), 0.05) is None


def test_scaling_keeps_the_distances_of_a_planar_cloud(spark):
    rng = np.random.default_rng(3)
    flat = rng.normal(size=(120, 2))
    turn = np.linalg.qr(rng.normal(size=(5, 5)))[0][:2]
    points = cloud_of(spark, flat @ turn + 2.0)
    fit = scaling.fitted_scaling(points, 3, 40)
    rows = scaling.scaled_rows(points.repartition(5), fit).orderBy("row_id").collect()
    y = np.array([r["x"] for r in rows])
    far = lambda m: np.sqrt(((m[:, None] - m[None]) ** 2).sum(2))
    assert np.abs(far(y) - far(flat)).max() < 1e-6 and np.abs(y[:, 2]).max() == 0.0  # a third direction has no extent
    one = scaling.scaled_rows(points.where("row_id = 77"), fit).first()["x"]
    assert one == pytest.approx(y[77].tolist(), abs=1e-12)
    for wrong in (lambda: scaling.fitted_scaling(points, 0), lambda: scaling.fitted_scaling(points, 2, 1), lambda: scaling.fitted_scaling(points.where("row_id = 0"), 2)):
        with pytest.raises(ValueError):
            wrong()


@pytest.mark.parametrize("closed", [False, True])
def test_wide_and_narrow_covariances_agree(spark, closed):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(int(i % 2), float(p), [float(v) for v in rng.normal(size=3)]) for i, p in enumerate(rng.uniform(size=60))], "route_id int, position double, residual array<double>").repartition(3)
    grid = [0.0, 0.3, 0.97]
    key = lambda f: {(r["route_id"], r["g"], r["i"], r["j"]): r["value"] for r in f.collect()}
    assert key(wide_kernel_covariance(rows, grid, 0.05, closed)) == pytest.approx(key(kernel_covariance(rows, grid, 0.05, 3, closed)))


def noisy_line(n=140, seed=2):
    rng = np.random.default_rng(seed)
    return np.column_stack([np.linspace(-2, 2, n), rng.normal(0, 0.12, n), rng.normal(0, 0.03, n)])


FIELDS = ["route_id", "position", "projected", "residual", "residual_norm", "tangent", "residual_coordinates", "reconstructed", "unexplained_residual", "unexplained_residual_norm"]


def test_transformed_rows_have_all_fields_and_add_up(spark, tmp_path):
    points = cloud_of(spark, noisy_line())
    base = model.fit(points)
    left = {}
    for r in (0, 1, 2, 5):
        m = model.with_residual_axes(base, points, r)
        assert m.residual_dim == min(r, 2)
        rows = m.transform(points).orderBy("row_id").collect()
        assert all(f in rows[0].asDict() for f in FIELDS) and len(rows) == 140
        x, told, rest = (np.array([r[c] for r in rows]) for c in ("x", "reconstructed", "unexplained_residual"))
        assert all(len(r["residual_coordinates"]) == m.residual_dim for r in rows) and told + rest == pytest.approx(x)
        assert x == pytest.approx(noisy_line())  # in own units
        assert np.array([r["unexplained_residual_norm"] for r in rows]) == pytest.approx(np.linalg.norm(rest, axis=1))
        left[r] = float((rest**2).sum())
        if r == 0:
            assert rest == pytest.approx(np.array([row["residual"] for row in rows]))
    # rows beyond a route's ends lie off along it too, which no direction across tells
    assert left[0] > left[1] > left[2] == pytest.approx(left[5]) and left[2] < 0.2 * left[0]
    m = model.with_residual_axes(base, points, 1)
    whole = {r["row_id"]: r for r in m.transform(points).collect()}
    m.save(str(tmp_path / "m"))
    again = model.RouteModel.load(spark, str(tmp_path / "m"))
    for r in again.transform(points.where("row_id % 3 = 0")).collect():
        assert all(r[f] == pytest.approx(whole[r["row_id"]][f]) for f in FIELDS)
    for wrong in ({"residual_dim": -1}, {"residual_dim": 1, "bandwidth": 0.0}, {"residual_dim": 1, "bandwidth": float("inf")}):
        with pytest.raises(ValueError):
            model.with_residual_axes(base, points, **wrong)


def test_routes_are_a_stage_of_a_pipeline(spark, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import LogisticRegression

    from threadmap.plans.estimators import RouteEmbedder

    x = noisy_line()
    rows = spark.createDataFrame([(i, [float(v) for v in r], float(r[0] > 0), "c") for i, r in enumerate(x)], "key long, cloud array<double>, label double, position string")
    stage = RouteEmbedder(inputCol="cloud", outputCol="along", idCol="key", residualDim=1, resultCol="result")
    assert stage.copy({stage.landmarks: 9}).getOrDefault("landmarks") == 9 and stage.getOrDefault("landmarks") == 16
    assert stage.setParams(bandwidth=0.2) is stage and stage.getOrDefault("bandwidth") == 0.2
    fitted = Pipeline(stages=[stage, LogisticRegression(featuresCol="along", labelCol="label", maxIter=20)]).fit(rows)
    out = fitted.transform(rows)
    assert out.columns[:4] == rows.columns  # a column of the rows may have the name of a field
    assert out.where("prediction = label").count() > 115
    named = [a["name"] for a in out.schema["along"].metadata["ml_attr"]["attrs"]["numeric"]]
    assert named == ["route_0", "position", "residual_norm", "residual_0"] == fitted.stages[0].names()
    fitted.write().overwrite().save(str(tmp_path / "p"))
    again = PipelineModel.load(str(tmp_path / "p"))
    key = lambda f: {r["key"]: (list(r["along"]), r["result"]["unexplained_residual_norm"]) for r in f.collect()}
    was, now = key(out), key(again.transform(rows.where("key % 7 = 0")))
    assert len(now) == 20 and all(now[k][0] == pytest.approx(was[k][0]) and now[k][1] == pytest.approx(was[k][1]) for k in now)
    stage.write().overwrite().save(str(tmp_path / "s"))
    assert RouteEmbedder.load(str(tmp_path / "s")).getOrDefault("residualDim") == 1
    for wrong in ({"landmarks": 1}, {"residualDim": -1}, {"bandwidth": 0.0}):
        with pytest.raises(ValueError):
            RouteEmbedder(**wrong)


# scores within routes


def scored_rows(spark, n=240):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, 3))
    route = np.where(np.arange(n) < 4, 3, np.where(np.arange(n) < 30, 2, np.arange(n) % 2))  # 3 is small, 2 of one class
    label = np.where(route == 2, 1, (x[:, 0] + 0.3 * rng.normal(size=n) > 0).astype(int) + (x[:, 1] > 1))
    value = np.where(route == 2, 5.0, 2 * x[:, 0] - x[:, 2] + 0.2 * rng.normal(size=n))
    frame = spark.createDataFrame([(i, int(r), [float(v) for v in f], int(c), float(y)) for i, (r, f, c, y) in enumerate(zip(route, x, label, value))], "row_id long, route_id int, features array<double>, label int, value double")
    return x, route, label, value, frame.repartition(3)


def plain_predictions(x, y, fold):
    out = np.zeros((len(x), y.shape[1]))
    z = np.c_[np.ones(len(x)), x]
    for f in set(fold):
        out[fold == f] = z[fold == f] @ np.linalg.lstsq(z[fold != f], y[fold != f], rcond=None)[0]
    return out


def test_scores_equal_separate_fits(spark):
    from threadmap.operators import scores

    x, route, label, value, frame = scored_rows(spark)
    fold = np.array([r["fold"] for r in scores.dealt(frame, 5).orderBy("row_id").collect()])
    got = {r["route_id"]: r for r in scores.route_classification(frame.withColumnRenamed("label", "target"), 5, 5).collect()}
    for r in (0, 1):
        own = route == r
        told = plain_predictions(x[own], np.eye(3)[label[own]], fold[own]).argmax(1)
        accuracy = (told == label[own]).mean()
        assert got[r]["status"] == "ok" and got[r]["accuracy"] == pytest.approx(accuracy) and got[r]["normalized_accuracy"] == pytest.approx(max(0, (accuracy - 1 / 3) / (2 / 3)))
        assert got[r]["route_purity"] == pytest.approx(np.bincount(label[own]).max() / own.sum()) and accuracy > 0.6
    assert (got[2]["status"], got[2]["accuracy"], got[2]["valid"]) == ("pure route", 1.0, True)
    assert got[3]["status"].startswith("insufficient") and got[3]["accuracy"] is None and not got[3]["valid"]
    assert (got[4]["status"], got[4]["n_samples"], got[4]["route_purity"]) == ("empty route", 0, None)
    told = {r["route_id"]: r for r in scores.route_regression(frame.withColumnRenamed("value", "target"), 5, 5).collect()}
    for r in (0, 1):
        own = route == r
        y = value[own]
        p = plain_predictions(x[own], y[:, None], fold[own])[:, 0]
        rank = lambda v: np.argsort(np.argsort(v))
        assert told[r]["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-6)
        assert told[r]["rank_correlation"] == pytest.approx(np.corrcoef(rank(y), rank(p))[0, 1], abs=1e-9) and told[r]["r2"] > 0.9
    assert [told[r]["status"] for r in (2, 3, 4)] == ["constant target", "insufficient samples for 5-fold regression", "empty route"]
    with pytest.raises(ValueError):
        scores.route_regression(frame.withColumnRenamed("value", "target"), 5, 1)
