"""Matrix and vector operators on DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relinfer.config import MAX_BROADCAST_BYTES
from relinfer.functions import vector as V
from relinfer.functions.kernels import matmul_kernel, shard_kernel
from relinfer.operators.skew import as_list

JOIN_SALTS = 16


def split_heads(df: DataFrame, vec: str, head_dim: int, out: str = "w") -> DataFrame:
    """One row (head, slice of the vector) per head."""
    rest = [c for c in df.columns if c != vec]
    return df.select(*rest, F.posexplode(V.head_slices(vec, head_dim)).alias("head", out))


def head_index(df: DataFrame, row: str, head_dim: int) -> DataFrame:
    """Head and place within the head of projection rows numbered by `row`."""
    return df.withColumns(
        {
            "head": F.floor(F.col(row) / head_dim).cast("int"),
            "h_dim": (F.col(row) % head_dim).cast("int"),
        }
    )


def to_long(df: DataFrame, vec: str, index: str = "h_dim", value: str = "val") -> DataFrame:
    """Vector rows to one row per component."""
    rest = [c for c in df.columns if c != vec]
    return df.select(*rest, F.posexplode(vec).alias(index, value))


def to_rows(
    df: DataFrame, keys: str | Sequence[str], index: str = "h_dim", value: str = "val",
    out: str = "vec",
) -> DataFrame:
    """Components back to vectors; a vector is as long as the model is wide."""
    ordered = F.array_sort(F.collect_list(F.struct(index, value)))
    return df.groupBy(*as_list(keys)).agg(
        F.transform(ordered, lambda e: e.getField(value)).alias(out)
    )


def transpose_matrix(
    df: DataFrame, keys: str | Sequence[str], row: str, vec: str, out_row: str = "in_idx"
) -> DataFrame:
    """Transpose matrices stored as numbered row vectors, one matrix per key."""
    keys = as_list(keys)
    long = df.select(*keys, row, F.posexplode(vec).alias(out_row, "_val"))
    return to_rows(long, [*keys, out_row], row, "_val", vec)


def vec_weighted_sum(
    df: DataFrame, keys: str | Sequence[str], vec: str, weight: str, dim: int, out: str = "vec"
) -> DataFrame:
    """Sum of weight * vector per key.

    Every component is an ordinary sum, so groups of any size are combined
    before the shuffle and a task never holds a group. A missing value adds 0.
    """
    sums = [
        F.coalesce(F.sum(F.col(weight) * F.get(vec, F.lit(i))), F.lit(0.0)) for i in range(dim)
    ]
    return df.groupBy(*as_list(keys)).agg(F.array(*sums).alias(out))


class Matrix:
    """A local matrix (out, in) that is sent to the executors once, however often used."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self._transposed = None
        self._kernel = None
        self._columns = {}

    @property
    def T(self) -> "Matrix":
        if self._transposed is None:
            self._transposed = Matrix(np.ascontiguousarray(self.values.T))
        return self._transposed

    def column(self, x: str, build) -> Column:
        """The product with column `x` in array functions, built once."""
        if x not in self._columns:
            literal = F.array(*[V.vec_lit(row) for row in self.values])
            self._columns[x] = build(literal)
        return self._columns[x]

    def kernel(self, df: DataFrame):
        if self._kernel is None:
            if self.values.nbytes > MAX_BROADCAST_BYTES:
                raise ValueError("matrix exceeds the broadcast bound; use linear_join")
            self._kernel = matmul_kernel(df.sparkSession.sparkContext.broadcast(self.values))
        return self._kernel


def as_matrix(matrix: Matrix | np.ndarray) -> Matrix:
    return matrix if isinstance(matrix, Matrix) else Matrix(matrix)


def linear(
    df: DataFrame, matrix: Matrix | np.ndarray, x: str, out: str = "y", engine: str = "arrow"
) -> DataFrame:
    """y_o = sum_i W[o,i] x_i for a matrix of shape (out, in); a narrow operation.

    engine 'arrow' multiplies batches in the kernel with a broadcast matrix;
    'inline' uses array functions and a literal matrix and needs no Python
    worker, but is several times slower already at 12 x 48.
    """
    return linears(df, {out: matrix}, x, engine)


def linears(
    df: DataFrame, matrices: dict[str, Matrix | np.ndarray], x: str, engine: str = "arrow"
) -> DataFrame:
    """Several linear maps of the same vector in one pass."""
    return df.withColumns(
        {out: linear_column(df, m, x, engine) for out, m in matrices.items()}
    )


def linear_column(
    df: DataFrame, matrix: Matrix | np.ndarray, x: str, engine: str = "arrow"
) -> Column:
    matrix = as_matrix(matrix)
    if engine == "inline":
        return matrix.column(
            x,
            lambda literal: F.when(
                F.col(x).isNotNull(),
                V.let(x, lambda xv: F.transform(literal, lambda r: V.dot(r, xv))),
            ),
        )
    if engine != "arrow":
        raise ValueError("engine must be 'arrow' or 'inline'")
    return apply_kernel(matrix.kernel(df), x)


def apply_kernel(kernel, x: str) -> Column:
    # Naming x twice also keeps the optimizer from moving the expression behind
    # x into the UDF call, where Spark cannot plan nested lambdas.
    return kernel(F.col(x), F.size(F.col(x)))


def linear_t(
    df: DataFrame, matrix_t: Matrix | np.ndarray, x: str, out: str = "y", engine: str = "arrow"
) -> DataFrame:
    """y = sum_i x_i W_t[i,:] for an input-major matrix of shape (in, out)."""
    return linear(df, as_matrix(matrix_t).T, x, out, engine)


def linear_rows(
    df: DataFrame, matrix: Matrix | np.ndarray, x: str, index: str = "token", value: str = "val",
    engine: str = "arrow",
) -> DataFrame:
    """Linear map with one output row per output unit (language-model head)."""
    rest = [c for c in df.columns if c != x]
    mapped = linear(df, matrix, x, "_y", engine)
    return mapped.select(*rest, F.posexplode("_y").alias(index, value))


def linear_sharded(
    df: DataFrame, weights: DataFrame, keys: str | Sequence[str], x: str, shape: tuple[int, int], out: str = "y",
    input_major: bool = False, shard_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """df with y = W x for a matrix table (row, w) of any size and `shape` (rows, width); rows have unique `keys`.

    The matrix is cut into shards of outputs below `shard_bytes`, which go from the table to the tasks: nothing of it
    passes the driver or is broadcast. Every vector visits every shard, and its results are put one after the
    other. Where there are fewer shards than partitions, a shard goes to several tasks, each with its share of the vectors.
    Null vectors give null.
    """
    keys = as_list(keys)
    n_out, n_in = shape[::-1] if input_major else shape
    step = max(1, shard_bytes // (8 * n_in))
    shards = -(-n_out // step)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = max(1, parts // shards)
    numbers, copies = F.sequence(F.lit(0), F.lit(shards - 1)), F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    if input_major:
        sliced = weights.select("row", "w", F.explode(numbers).alias("_shard"))
        cut = sliced.select("row", F.slice("w", F.col("_shard") * step + 1, F.lit(step)).alias("w"), "_shard")
    else:
        cut = weights.select("row", "w", F.floor(F.col("row") / step).cast("int").alias("_shard"))
    rest = [c for c in df.columns if c not in keys]
    # The other columns travel with the first shard only.
    visits = df.select(
        *keys, F.col(x).alias("_x"), F.struct(*rest).alias("_rest"), F.explode(numbers).alias("_shard"),
        F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int").alias("_salt"),
    ).withColumn("_rest", F.when(F.col("_shard") == 0, F.col("_rest"))).withColumn("_kind", F.lit(1))
    held = cut.withColumn("_salt", copies).withColumn("_kind", F.lit(0))
    units, kept = ["_shard", "_salt"], [*keys, "_shard", "_rest"]
    pairs = held.unionByName(visits, allowMissingColumns=True).repartition(parts, *units).sortWithinPartitions(*units, "_kind")
    schema = T.StructType([*(visits.schema[c] for c in kept), T.StructField("_y", T.ArrayType(T.DoubleType()))])
    products = pairs.mapInArrow(shard_kernel(units, kept, "_y", input_major), schema)
    ordered = F.array_sort(F.collect_list(F.struct("_shard", "_y")))
    joined = products.groupBy(*keys).agg(
        F.first("_rest", ignorenulls=True).alias("_rest"), F.flatten(F.transform(ordered, lambda p: p["_y"])).alias("_y")
    )
    return joined.select(*keys, *[F.col(f"_rest.{c}").alias(c) for c in rest if c != out], F.col("_y").alias(out))


def linear_join(
    df: DataFrame,
    weights: DataFrame,
    keys: str | Sequence[str],
    x: str,
    in_idx: str = "in_idx",
    index: str = "out_dim",
    value: str = "val",
) -> DataFrame:
    """Linear map against an input-major matrix table (in_idx, w) of any size.

    The way beyond the broadcast bound: components are joined to matrix rows on
    the input index and summed per output. All input indexes are equally
    frequent; the matrix is repeated over a salt so that more tasks than input
    indexes can share the work.
    """
    keys = as_list(keys)
    salt = F.pmod(F.xxhash64(*keys), F.lit(JOIN_SALTS))
    long = df.select(*keys, salt.alias("_salt"), F.posexplode(x).alias(in_idx, "_x"))
    salts = F.sequence(F.lit(0).cast("bigint"), F.lit(JOIN_SALTS - 1).cast("bigint"))
    copies = weights.select(in_idx, "w", F.explode(salts).alias("_salt"))
    products = long.join(copies, [in_idx, "_salt"]).select(
        *keys, "_x", F.posexplode("w").alias(index, "_w")
    )
    return products.groupBy(*keys, index).agg(F.sum(F.col("_x") * F.col("_w")).alias(value))
