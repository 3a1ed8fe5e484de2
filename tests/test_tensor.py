import numpy as np
import pytest
from pyspark.sql import functions as F

from relinfer.operators import tensor as X
from relinfer.operators.tensor import Matrix
from tests.conftest import plan

RNG = np.random.default_rng(3)
W = RNG.normal(size=(7, 5))
ROWS = RNG.normal(size=(40, 5))


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(ROWS)], "seq_id bigint, x array<double>")


def matrix_of(df, vec):
    return np.array([r[0] for r in df.orderBy("seq_id").select(vec).collect()])


def test_all_forms_of_linear_agree(spark, df):
    expected = ROWS @ W.T
    for engine in ("inline", "arrow"):
        assert np.allclose(matrix_of(X.linear(df, W, "x", engine=engine), "y"), expected)
    assert np.allclose(matrix_of(X.linear_t(df, np.ascontiguousarray(W.T), "x"), "y"), expected)
    long = X.to_rows(X.linear_rows(df, W, "x"), "seq_id", "token")
    assert np.allclose(matrix_of(long, "vec"), expected)
    table = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(W.T)], "in_idx int, w array<double>")
    joined = X.to_rows(X.linear_join(df, table, "seq_id", "x"), "seq_id", "out_dim")
    assert np.allclose(matrix_of(joined, "vec"), expected)


@pytest.mark.parametrize("engine", ["inline", "arrow"])
def test_linear_is_narrow_and_keeps_nulls(spark, df, engine):
    with_null = df.unionByName(spark.createDataFrame([(99, None)], df.schema))
    out = X.linear(with_null, W, "x", engine=engine)
    assert "Exchange" not in plan(out) and "BatchEvalPython" not in plan(out)
    assert out.where("seq_id = 99").first().y is None
    assert out.where("y is null").count() == 1


def test_linear_after_computed_vector(spark, df):
    """A nested lambda in front of the kernel is not moved into its arguments."""
    from relinfer.functions import vector as V
    normed = df.withColumn("n", V.rms_norm_vec("x", V.vec_lit(np.ones(5))))
    out = X.linear(normed, W, "n", engine="arrow").drop("n").select("seq_id", F.posexplode("y"))
    assert out.count() == 40 * 7


def test_wrong_width_is_an_error(df):
    with pytest.raises(Exception, match="vectors of length 4"):
        X.linear(df, W[:, :4], "x", engine="arrow").collect()


def test_matrix_over_the_bound(df, monkeypatch):
    monkeypatch.setattr(X, "MAX_BROADCAST_BYTES", 10)
    with pytest.raises(ValueError, match="linear_join"):
        X.linear(df, Matrix(W), "x", engine="arrow")


def test_transpose_twice_is_identity(df):
    heads = df.select(F.lit(1).alias("m"), F.col("seq_id").cast("int").alias("row"), F.col("x").alias("w"))
    twice = X.transpose_matrix(X.transpose_matrix(heads, "m", "row", "w"), "m", "in_idx", "w", "row")
    got = np.array([r.w for r in twice.orderBy("row").collect()])
    assert np.array_equal(got, ROWS)


def test_heads_and_long_round_trip(spark, df):
    wide = spark.createDataFrame([(1, [float(i) for i in range(12)])], "seq_id int, x array<double>")
    heads = X.split_heads(wide, "x", 4).orderBy("head").collect()
    assert [(r.head, r.w) for r in heads] == [(h, [4.0 * h + d for d in range(4)]) for h in range(3)]
    indexed = X.head_index(X.to_long(wide, "x", "o"), "o", 4).orderBy("o").collect()
    assert [(r.head, r.h_dim) for r in indexed] == [(o // 4, o % 4) for o in range(12)]
    assert np.allclose(matrix_of(X.to_rows(X.to_long(df, "x"), "seq_id"), "vec"), ROWS)


def test_weighted_sum_combines_before_the_shuffle(spark, df):
    keyed = df.withColumns({"g": F.col("seq_id") % 3, "p": F.col("seq_id") / 10})
    out = X.vec_weighted_sum(keyed, "g", "x", "p", 5)
    assert "partial_sum" in plan(out)
    ids = np.arange(40)
    for r in out.collect():
        own = ids % 3 == r.g
        assert np.allclose(r.vec, (ids[own, None] / 10 * ROWS[own]).sum(axis=0))
