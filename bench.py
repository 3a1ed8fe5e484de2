"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line. Each query is written to the no-op sink, so that all of
its rows and columns are computed and none are brought to the driver. With BENCH_DEEP set come, after the
queries, prompts and decode steps of a model of the published depth and width, for one sequence and for 200.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from relinfer.config import ModelConfig, SamplingParams  # noqa: E402
from relinfer.plans import catalog  # noqa: E402
from relinfer.plans.model import decode_step, init_state, prefill  # noqa: E402
from relinfer.session import drop_table, local_session, new_table_path  # noqa: E402
from relinfer.sources.weights import LAYER_TENSORS, load_weights  # noqa: E402

HEADLINE = (
    "score_and_sample", "dot_scores", "linear_packed", "linear_joined", "rms_norm", "swiglu",
    "vec_weighted_sum", "rope_apply", "gqa_attention", "softmax_grouped", "softmax_hot", "top_k",
    "top_p_hot", "nucleus_lines", "gumbel_sample", "filter_logits", "repetition_penalty", "next_token",
    "vocab_build", "encode", "decode_text", "text_round_trip", "chat_render", "chat_tokens", "model_logits",
    "sampled_generate",
)


# Depth, width, heads and vocabulary of the smaller published model; its other sizes are not published.
DEEP = ModelConfig(
    hidden=60, n_layers=30, head_dim=64, n_heads=3, n_kv_heads=1, ffn_dim=576, vocab_size=49152
)
PROMPT, STEPS = 30, 2


def write_weights(spark, path: str) -> None:
    """Weights of DEEP, drawn where they are written, a task for each tensor of a layer."""
    tensors = [
        (tensor, layer, rows, width) for tensor, (rows, width) in DEEP.matrix_shapes().items()
        for layer in range(DEEP.n_layers if tensor in LAYER_TENSORS else 1)
    ]

    def drawn(batches):
        for batch in batches:
            for tensor, layer, rows, width in zip(*(c.to_pylist() for c in batch.columns)):
                rng = np.random.default_rng([layer, rows, width, sum(map(ord, tensor))])
                w = rng.normal(1.0 if rows == 1 else 0.0, width**-0.5, rows * width)
                yield pa.RecordBatch.from_arrays([
                    pa.array([tensor] * rows), pa.array(np.full(rows, layer, np.int32)), pa.array(np.arange(rows, dtype=np.int32)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, rows * width + 1, width, dtype=np.int32)), pa.array(w.astype(np.float32))),
                ], ["tensor", "layer", "row", "w"])

    grid = spark.createDataFrame(tensors, "tensor string, layer int, n int, width int").repartition(16)
    rows = grid.mapInArrow(drawn, "tensor string, layer int, row int, w array<float>")
    rows.write.partitionBy("tensor", "layer").parquet(path)


def deep(spark, folder: str, sizes: tuple[int, ...] = (1, 200)) -> dict[str, float]:
    """Seconds of a prompt of 30 tokens and of a decode step (the mean of those after the first)."""
    path = new_table_path(spark, "bench-weights")
    write_weights(spark, path)
    model, out = load_weights(spark, path, DEEP), {}
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    for n in sizes:
        # Not more tasks than sequences.
        spark.conf.set("spark.sql.shuffle.partitions", min(n, int(parts)))
        items = spark.read.parquet(f"{folder}/benchmark.parquet").orderBy("item_id").limit(n)
        tokens = items.select(
            F.col("item_id").alias("seq_id"), F.explode(F.sequence(F.lit(0), F.lit(PROMPT - 1))).alias("pos"), "text"
        ).select("seq_id", "pos", F.pmod(F.xxhash64("text", "pos"), F.lit(40000)).cast("int").alias("token"))
        tokens = tokens.withColumn("token", F.col("token") + 17)
        state = init_state(spark, model)
        start = time.perf_counter()
        frontier = prefill(tokens, model, state)
        frontier.write.format("noop").mode("overwrite").save()
        out[f"deep_prefill_{n}"] = round(time.perf_counter() - start, 3)
        took = []
        for _ in range(STEPS):
            start = time.perf_counter()
            frontier = decode_step(frontier, model, SamplingParams(), state, 1)
            took.append(time.perf_counter() - start)
        out[f"deep_step_{n}"] = round(sum(took[1:]) / len(took[1:]), 3)
        state.drop()
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    drop_table(spark, path)
    return out


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=8 if cpus == "*" else int(cpus))
    # Start the JVM's and Python's workers before the clock runs.
    catalog.linear_packed(spark, folder).write.format("noop").mode("overwrite").save()
    timings = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {timings[name]} s", file=sys.stderr)
    depth = deep(spark, folder) if os.environ.get("BENCH_DEEP") else {}
    for name, seconds in depth.items():
        print(f"{name}: {seconds} s", file=sys.stderr)
    prompts = spark.read.parquet(f"{folder}/benchmark.parquet").count()
    extra = {
        "generated_tokens_per_sec": round(prompts * 3 / timings["sampled_generate"], 2),
        "logit_rows_per_sec": round(
            catalog.vectors(spark, folder).count() * catalog.WIDE.vocab_size / timings["dot_scores"]
        ),
    }
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings | depth, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), **extra,
    }))


if __name__ == "__main__":
    main()
