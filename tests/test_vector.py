import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from relinfer.functions import vector as V
from tests import reference as R


def value(spark, column, **inputs):
    df = spark.createDataFrame([tuple(inputs.values())], list(inputs)) if inputs else spark.range(1)
    return df.select(column.alias("r")).first().r


def test_dot_and_sum_sq(spark):
    assert value(spark, V.dot("a", "b"), a=[1.0, 2.0], b=[3.0, 4.0]) == 11.0
    assert value(spark, V.sum_sq("a"), a=[3.0, 4.0]) == 25.0


def test_clamped_exp_limits_and_null(spark):
    assert value(spark, V.clamped_exp("v"), v=1000.0) == pytest.approx(math.exp(50), rel=1e-12)
    assert value(spark, V.clamped_exp("v"), v=-1000.0) == pytest.approx(math.exp(-50), rel=1e-12)
    assert value(spark, V.clamped_exp(F.lit(None).cast("double"))) is None


def test_softmax_keeps_far_values_positive(spark):
    p = value(spark, V.softmax_vec("x"), x=[0.0, -500.0, 1.0])
    assert sum(p) == pytest.approx(1.0)
    assert p == pytest.approx(list(R.softmax(np.array([0.0, -500.0, 1.0]))), rel=1e-12)
    assert p[1] > 0


def test_rms_norm(spark):
    x, g = [1.0, -2.0, 3.0], [0.5, 1.0, 2.0]
    got = value(spark, V.rms_norm_vec("x", "g"), x=x, g=g)
    assert got == pytest.approx(list(R.rms(np.array(x), np.array(g))))


def test_add_treats_missing_as_zero(spark):
    df = spark.createDataFrame([([1.0, 2.0], [None, 5.0]), ([1.0, 2.0], None)], "x array<double>, d array<double>")
    assert [r.r for r in df.select(V.add_vec("x", "d").alias("r")).collect()] == [[1.0, 7.0], [1.0, 2.0]]


@pytest.mark.parametrize("pos", [0, 1, 17])
def test_rope(spark, pos):
    x = [float(i * i % 7) - 3 for i in range(24)]
    got = value(spark, V.rope_vec("x", "p", 8), x=x, p=pos)
    assert got == pytest.approx(list(R.rotate(np.array(x), pos, 8)))
    assert np.linalg.norm(got) == pytest.approx(np.linalg.norm(x))
    if pos == 0:
        assert got == x


def test_uniform_stays_inside(spark):
    df = spark.range(5000).select(V.uniform(1, "id").alias("u"), V.uniform(2, "id").alias("w"))
    low, high, mean, same = df.agg(
        F.min("u"), F.max("u"), F.avg("u"), F.sum((F.col("u") == F.col("w")).cast("int"))
    ).first()
    assert 0 < low and high < 1 and 0.48 < mean < 0.52 and same < 5


def test_let_evaluates_once(spark):
    """A computed vector inside a lambda is bound, not copied into it."""
    x = F.transform("x", lambda v: v * 2)
    df = spark.createDataFrame([([1.0] * 32,)], ["x"]).withColumn("y", x)
    once = df.select(V.rms_norm_vec("y", V.vec_lit(np.ones(32))).alias("z"))
    text = once._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("* 2.0") == 1
