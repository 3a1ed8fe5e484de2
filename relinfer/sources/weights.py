"""Model weights as tables of row vectors."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relinfer.config import MAX_BROADCAST_BYTES, ModelConfig
from relinfer.functions.kernels import gather_kernel, matmul_kernel
from relinfer.operators.tensor import Matrix, apply_kernel, linear_sharded

LAYER_TENSORS = ("norm", "q", "k", "v", "o", "ffn_norm", "gate", "up", "down")
GLOBAL_TENSORS = ("emb", "out", "out_norm")
INPUT_MAJOR = ("o", "down")
CONFIG_FOLDER = "_config"


@dataclass
class Model:
    """A model: its dimensions and one table (tensor, layer, row, w).

    `emb`, `out` and `out_norm` have layer 0. `o` and `down` are stored
    input-major, the other matrices output-major.
    """

    config: ModelConfig
    weights: DataFrame
    # What is fetched and broadcast at once.
    max_bytes: int = MAX_BROADCAST_BYTES
    _cache: dict = field(default_factory=dict, repr=False)
    _kernels: dict = field(default_factory=dict, repr=False)
    _columns: dict = field(default_factory=dict, repr=False)
    _sent: dict = field(default_factory=dict, repr=False)

    def rows(self, tensor: str, layer: int = 0) -> DataFrame:
        """The row vectors (row, w) of one tensor."""
        return self.weights.where((F.col("tensor") == tensor) & (F.col("layer") == layer)).select(
            "row", "w"
        )

    def fits(self, tensor: str) -> bool:
        """Whether the tensor is below the broadcast bound, by its configured shape."""
        return self.config.matrix_bytes(tensor) <= self.max_bytes

    def matrix(self, tensor: str, layer: int = 0) -> Matrix | np.ndarray:
        """One tensor as a local matrix, to be broadcast; only below the bound.

        Gains, which are single rows, come as plain vectors.
        """
        key = (tensor, layer)
        if key not in self._cache:
            if not self.fits(tensor):
                raise ValueError(f"{tensor} exceeds the broadcast bound; use rows()")
            group = [tensor]
            if tensor in LAYER_TENSORS and self._layer_bytes() <= self.max_bytes:
                group = list(LAYER_TENSORS)
            self._fetch(group, layer)
        return self._cache[key]

    def multiply(self, df: DataFrame, tensors: dict[str, str], x: str, layer: int = 0) -> DataFrame:
        """df with the linear maps {column: tensor} of column x, for tensors of any size.

        Tensors below the bound are broadcast, and the map is narrow. Others are read by the tasks, shard by
        shard; rows must have unique (seq_id, pos) then.
        """
        small = {out: t for out, t in tensors.items() if self.fits(t)}
        df = df.withColumns({out: self.product(t, x, layer) for out, t in small.items()}) if small else df
        for out, tensor in tensors.items():
            if out not in small:
                df = linear_sharded(
                    df, self.rows(tensor, layer), ("seq_id", "pos"), x, self.config.matrix_shapes()[tensor], out,
                    tensor in INPUT_MAJOR, self.max_bytes,
                )
        return df

    def product(self, tensor: str, x: str, layer: int = 0) -> Column:
        """The linear map of a tensor below the bound on column x; narrow.

        The driver keeps no values of a tensor that is broadcast.
        """
        key = (tensor, layer)
        if key not in self._kernels:
            self._kernels[key] = matmul_kernel(self.broadcast(tensor, layer))
        return apply_kernel(self._kernels[key], x)

    def broadcast(self, tensor: str, layer: int = 0):
        """The values of a tensor below the bound, as (out, in), sent once."""
        key = (tensor, layer, "values")
        if key not in self._kernels:
            values = self.matrix(tensor, layer).values
            del self._cache[tensor, layer]
            values = np.ascontiguousarray(values.T) if tensor in INPUT_MAJOR else values
            self._kernels[key] = self.weights.sparkSession.sparkContext.broadcast(values)
            self._sent.setdefault(layer, []).append(self._kernels[key])
        return self._kernels[key]

    def release(self, layers: Iterable[int]) -> None:
        """Free the executors of the layers' matrices, if the model as a whole exceeds the bound.

        They are sent again when they are used again.
        """
        if self.config.n_layers * self._layer_bytes() > self.max_bytes:
            for layer in layers:
                for sent in self._sent.get(layer, []):
                    sent.unpersist()

    def lookup(self, tensor: str, row: Column) -> Column:
        """The row of a tensor below the bound, which is broadcast once; null if there is none."""
        key = (tensor, "rows")
        if key not in self._kernels:
            self._kernels[key] = gather_kernel(self.table(tensor))
        return self._kernels[key](row)

    def table(self, tensor: str):
        """The rows of a tensor below the bound, sent once."""
        key = (tensor, "table")
        if key not in self._kernels:
            self._kernels[key] = self.weights.sparkSession.sparkContext.broadcast(self.matrix(tensor).values)
            del self._cache[tensor, 0]
        return self._kernels[key]

    def column(self, key: tuple, build) -> Column:
        """A column expression that layers and steps share, built once.

        Describing an expression costs the driver more than planning it, and a
        decode loop repeats the same ones for every step.
        """
        if key not in self._columns:
            self._columns[key] = build()
        return self._columns[key]

    def _layer_bytes(self) -> int:
        return sum(self.config.matrix_bytes(t) for t in LAYER_TENSORS)

    def _fetch(self, tensors: list[str], layer: int) -> None:
        table = (
            self.weights.where(F.col("tensor").isin(tensors) & (F.col("layer") == layer))
            .select("tensor", "row", "w").toArrow()
        )
        names = np.asarray(table.column("tensor").to_pylist())
        order, flat = _row_values(table)
        shapes = self.config.matrix_shapes()
        for tensor in tensors:
            own = np.flatnonzero(names == tensor)
            if (len(own), flat.shape[1]) != shapes[tensor]:
                raise ValueError(f"{tensor}, layer {layer}: expected shape {shapes[tensor]}")
            matrix = np.ascontiguousarray(flat[own[np.argsort(order[own])]])
            single = shapes[tensor][0] == 1
            self._cache[tensor, layer] = matrix[0] if single else Matrix(matrix)


def _row_values(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and vectors of a fetched table."""
    flat = table.column("w").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return table.column("row").to_numpy(), flat.reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 0))


def save_weights(weights: DataFrame, path: str, config: ModelConfig | None = None) -> None:
    """Write a weight table, partitioned so that a scan reads one tensor of one layer.

    The configuration goes next to it, into a folder that table scans pass over.
    """
    weights.repartition("tensor", "layer").write.partitionBy("tensor", "layer").parquet(path)
    if config:
        row = [(json.dumps(vars(config)),)]
        weights.sparkSession.createDataFrame(row, "value string").coalesce(1).write.text(f"{path}/{CONFIG_FOLDER}")


def load_config(spark: SparkSession, path: str) -> ModelConfig | None:
    """The configuration stored with a weight table; None if there is none."""
    try:
        text = spark.read.text(f"{path}/{CONFIG_FOLDER}").first().value
    except AnalysisException:
        return None
    values = json.loads(text)
    return ModelConfig(**values | {"stop_tokens": tuple(values["stop_tokens"])})


def infer_config(weights: DataFrame, head_dim: int = 64, **constants) -> ModelConfig:
    """Model dimensions read off the shapes of a weight table."""
    shapes = {
        r.tensor: r for r in weights.groupBy("tensor").agg(
            (F.max("row") + 1).alias("rows"), F.max(F.size("w")).alias("width"),
            (F.max("layer") + 1).alias("layers"),
        ).collect()
    }
    return ModelConfig(
        hidden=shapes["emb"].width, n_layers=shapes["q"].layers, head_dim=head_dim,
        n_heads=shapes["q"].rows // head_dim, n_kv_heads=shapes["k"].rows // head_dim,
        ffn_dim=shapes["gate"].rows, vocab_size=shapes["emb"].rows, **constants,
    )


def load_weights(spark: SparkSession, path: str, config: ModelConfig | None = None) -> Model:
    """Read a weight table, widen it to double and check it.

    Without a configuration, the one stored with the weights is taken; if there is none,
    the dimensions are read off the shapes and the constants are the defaults.
    """
    weights = spark.read.parquet(path).select(
        F.col("tensor").cast("string").alias("tensor"), F.col("layer").cast("int").alias("layer"),
        F.col("row").cast("int").alias("row"), F.col("w").cast("array<double>").alias("w"),
    )
    config = config or load_config(spark, path) or infer_config(weights)
    check_weights(weights, config)
    return Model(config, weights)


def check_weights(weights: DataFrame, config: ModelConfig) -> None:
    """Every tensor of every layer is there once, with the configured shape."""
    found = {
        (r.tensor, r.layer): (r.rows, r.low, r.high, r.ids)
        for r in weights.groupBy("tensor", "layer").agg(
            F.count(F.lit(1)).alias("rows"), F.min(F.size("w")).alias("low"),
            F.max(F.size("w")).alias("high"), F.count_distinct("row").alias("ids"),
        ).collect()
    }
    shapes = config.matrix_shapes()
    expected = {(t, layer) for t in LAYER_TENSORS for layer in range(config.n_layers)}
    expected |= {(t, 0) for t in GLOBAL_TENSORS}
    for tensor, layer in sorted(expected):
        rows, width = shapes[tensor]
        if found.get((tensor, layer)) != (rows, width, width, rows):
            raise ValueError(f"{tensor}, layer {layer}: expected shape {(rows, width)}")


# Index of each tensor in the closed form.
KINDS = {
    "emb": 0, "q": 1, "k": 2, "v": 3, "o": 4, "gate": 5, "up": 6, "down": 7, "out": 8,
}
GAIN_KINDS = {"norm": 0, "ffn_norm": 1, "out_norm": 2}


def formula_element(kind: Column, layer: Column, o: Column, i: Column) -> Column:
    """Element [o, i] of a closed-form matrix, output index first."""
    return F.lit(0.25) * F.sin(
        F.lit(1.0) + kind * 0.7 + layer * 1.3 + o * 0.31 + i * 0.17 + o * i * 0.013
    )


def formula_gain(kind: Column, layer: Column, i: Column) -> Column:
    return F.lit(1.0) + F.lit(0.1) * F.cos(kind * 0.5 + layer + i * 0.3)


def formula_model(spark: SparkSession, config: ModelConfig) -> Model:
    """A model whose weights follow a formula, computed on the executors."""
    tensors = [
        (tensor, layer, rows, width, {**KINDS, **GAIN_KINDS}[tensor])
        for tensor, (rows, width) in config.matrix_shapes().items()
        for layer in range(config.n_layers if tensor in LAYER_TENSORS else 1)
    ]
    grid = spark.createDataFrame(
        tensors, "tensor string, layer int, n_rows int, width int, kind int"
    ).withColumn("row", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)))
    kind, layer, row = F.col("kind"), F.col("layer"), F.col("row")

    def element(i):
        gain = F.col("tensor").isin(*GAIN_KINDS)
        input_major = F.col("tensor").isin(*INPUT_MAJOR)
        return (
            F.when(gain, formula_gain(kind, layer, i))
            .when(input_major, formula_element(kind, layer, i, row))
            .otherwise(formula_element(kind, layer, row, i))
        )

    vector = F.transform(F.sequence(F.lit(0), F.col("width") - 1), element)
    return Model(config, grid.select("tensor", "layer", "row", vector.alias("w")))


def rope_table(spark: SparkSession, n_pos: int, head_dim: int, theta: float = 100000.0) -> DataFrame:
    """Rotary table (pos, h_dim, cos_val, sin_val); pairs of h_dim share a frequency."""
    pair = F.floor(F.col("h_dim") / 2) * 2
    angle = F.col("pos") * (F.lit(1.0) / F.pow(F.lit(theta), pair / float(head_dim)))
    return (
        spark.range(n_pos * head_dim)
        .select(
            F.floor(F.col("id") / head_dim).cast("int").alias("pos"),
            (F.col("id") % head_dim).cast("int").alias("h_dim"),
        )
        .withColumns({"cos_val": F.cos(angle), "sin_val": F.sin(angle)})
    )
