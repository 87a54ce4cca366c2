import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadmap.functions import vectors as vec
from threadmap.operators import cloud as cl
from threadmap.sources import generators, tables


def points(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "row_id long, x array<double>")


def one(spark, expression):
    return spark.range(1).select(expression.alias("v")).first()["v"]


def lit(*values):
    return F.array(*(F.lit(float(v)) for v in values))


def test_vector_functions(spark):
    assert one(spark, vec.dot(lit(1, 2), lit(3, 4))) == 11
    assert one(spark, vec.sqdist(lit(0, 0), lit(3, 4))) == 25
    assert one(spark, vec.unit(lit(0, 0))) == [0, 0]
    assert one(spark, vec.tangent_inconsistency(lit(1, 0), lit(-2, 0))) == 0
    assert one(spark, vec.tangent_inconsistency(lit(0, 0), lit(-2, 0))) == 0
    assert one(spark, vec.departure_angle(lit(1, 0), lit(-2, 0))) == 2
    assert one(spark, vec.departure_angle(lit(0, 0), lit(1, 0))) == math.inf
    assert one(spark, vec.one_hot(F.lit(1), F.lit(3))) == [0, 1, 0]
    assert [one(spark, vec.octilinear_bin(F.lit(math.cos(a)), F.lit(math.sin(a)))) for a in (0, 0.7, 1.6, 3.1, -0.7)] == [0, 1, 2, 4, 7]


def test_standardise_and_back(spark):
    rng = np.random.default_rng(0)
    x = np.c_[rng.normal(3, 2, (40, 2)), np.full(40, 7.0)]
    p = points(spark, x)
    units = cl.moments(p)
    z = np.array([r["x"] for r in cl.standardized(p, units).orderBy("row_id").collect()])
    scale = np.where(x.std(0) < 1e-12, 1, x.std(0))
    assert np.allclose(z, (x - x.mean(0)) / scale)
    back = np.array([r["x"] for r in cl.destandardized(cl.standardized(p, units), units).orderBy("row_id").collect()])
    assert np.allclose(back, x)


def test_wide_and_narrow_moments_agree(spark, monkeypatch):
    p = points(spark, np.random.default_rng(1).normal(size=(30, 5)))
    a = cl.moments(p).first()
    monkeypatch.setattr(cl, "SIDE_BY_SIDE", 2)
    b = cl.moments(p).first()
    assert np.allclose(a["mean"], b["mean"]) and np.allclose(a["scale"], b["scale"])


@pytest.mark.parametrize("rows", [[[1.0, math.nan]], [[1.0], [1.0, 2.0]], [[math.inf, 0.0]], []])
def test_bad_clouds_raise(spark, rows):
    with pytest.raises(ValueError):
        cl.check(points(spark, rows))


def test_linear_clouds(spark):
    assert cl.nearly_linear(generators.line(spark, 300))
    assert not cl.nearly_linear(generators.circle(spark, 300))
    flat = cl.projected_to_line(generators.line(spark, 100))
    assert cl.principal_axes(flat, 2)[2][1] < 1e-6


@pytest.mark.parametrize("name", sorted(generators.GENERATORS))
def test_generators_are_the_same_however_partitioned(spark, name):
    make = generators.GENERATORS[name]
    a = make(spark, 50).orderBy("row_id").collect()
    b = make(spark, 50).repartition(7).orderBy("row_id").collect()
    assert a == b and len(a) == 50
    cl.check(make(spark, 50))


def test_bad_generator_parameters(spark):
    with pytest.raises(ValueError):
        generators.torus(spark, 5, major=0.1)
    with pytest.raises(ValueError):
        generators.star(spark, 5, branches=1)


def test_subsample_and_jitter(spark):
    p = generators.circle(spark, 100)
    assert tables.subsample(p, 10, 3).count() == 10
    assert tables.subsample(p, 10, 3).collect() == tables.subsample(p.repartition(5), 10, 3).collect()
    moved = tables.jittered(p, 0.1).join(p.withColumnRenamed("x", "y"), "row_id").agg(F.avg(vec.sqdist(F.col("x"), F.col("y")))).first()[0]
    assert 0.01 < moved < 0.04
