"""Building blocks of a transformer layer on rows (seq_id, pos, vector)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relinfer.config import ModelConfig
from relinfer.functions import vector as V
from relinfer.functions.kernels import (
    attention_kernel, merge_kernel, merge_step, mix_kernel, mix_step, mix_tiles_kernel, partial_rows, partials_step, score_rows,
    scores_step, softmax_kernel, softmax_step, summary_step,
)
from relinfer.operators.skew import lookup_join
from relinfer.operators.steps import chain_of, follow

# Positions whose queries meet a batch of keys at once in attention.
ATTENTION_BLOCK = 512
# Bytes of the queries that a task holds at a time.
TILE_BYTES = 32 * 1024 * 1024


def embed(tokens: DataFrame, w_emb: DataFrame, table_bytes: int | None = None, out: str = "x") -> DataFrame:
    """Look up the embedding row (row, w) of every token; an id without one is an error."""
    table = w_emb.select(F.col("row").alias("token"), F.col("w").alias(out))
    return known(lookup_join(tokens, table, "token", "left", table_bytes), out)


def known(df: DataFrame, out: str = "x") -> DataFrame:
    """df, whose tokens all have to have a vector."""
    message = F.concat(F.lit("no embedding for token "), F.coalesce(F.col("token").cast("string"), F.lit("null")))
    return df.withColumn(out, F.coalesce(out, F.raise_error(message).cast("array<double>")))


def scale_by(df: DataFrame, x: str, s: str, gain: Sequence[float] | str, out: str = "y") -> DataFrame:
    """x_i * s * gain_i; the gain is a constant vector or a column."""
    return df.withColumn(out, V.scale_vec(x, s, _gain(gain)))


def residual_add(df: DataFrame, x: str, delta: str, out: str = "x") -> DataFrame:
    """x_i + delta_i, a missing delta counting as zero."""
    return df.withColumn(out, V.add_vec(x, delta))


def rms_norm(
    df: DataFrame, gain: Sequence[float] | str, eps: float = 1e-5, x: str = "x", out: str = "x_norm"
) -> DataFrame:
    """Root-mean-square normalisation with a gain vector."""
    return df.withColumn(out, V.rms_norm_vec(x, _gain(gain), eps))


def _gain(gain):
    return F.col(gain) if isinstance(gain, str) else V.vec_lit(gain)


def rope(
    df: DataFrame, vec: str, head_dim: int, theta: float = 100000.0, pos: str = "pos",
    out: str | None = None,
) -> DataFrame:
    """Rotary encoding of one head or of concatenated heads."""
    return df.withColumn(out or vec, V.rope_vec(vec, pos, head_dim, theta))


def rope_join(
    df: DataFrame, table: DataFrame, head_dim: int, n_pos: int, vec: str = "vec", out: str = "vec"
) -> DataFrame:
    """Rotary encoding through a rotary table; positions outside the table give null.

    The table has n_pos * head_dim rows of 24 bytes, and half of them are used.
    """
    half = head_dim // 2
    used = table.where(F.col("h_dim") % 2 == 0)
    packed = used.groupBy("pos").agg(
        F.array_sort(F.collect_list(F.struct("h_dim", "cos_val", "sin_val"))).alias("_r")
    ).withColumn("pos", F.col("pos").cast("bigint"))
    rows = lookup_join(
        df.withColumn("pos", F.col("pos").cast("bigint")), packed, "pos", "left",
        n_pos * head_dim * 24,
    )

    def rotate(v, r):
        def component(value, i):
            turn = F.get(r, i % half)
            c, s = turn.getField("cos_val"), turn.getField("sin_val")
            return F.when(i % head_dim < half, value * c - F.get(v, i + half) * s).otherwise(
                F.get(v, i - half) * s + value * c
            )

        return F.transform(v, component)

    turned = F.when(F.col("_r").isNotNull(), V.lets([vec, "_r"], rotate))
    return rows.withColumn(out, turned).drop("_r")


def swiglu(df: DataFrame, gate: str, up: str, out: str = "h", clamp: float = 50.0) -> DataFrame:
    """silu(gate) * up."""
    return df.withColumn(out, V.swiglu_vec(gate, up, clamp))


def by_sequence(df: DataFrame, key: str = "seq_id") -> DataFrame:
    """Partition rows by sequence.

    The number of partitions is the session's and not left to the optimizer,
    since the work per row is far larger than its bytes suggest.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _block(pos: str) -> Column:
    return F.floor(F.col(pos) / ATTENTION_BLOCK).cast("int")


UNITS = ("_qb", "_kb")


def _block_pairs(keys: DataFrame, asking: DataFrame, key: str, units: list[str]) -> DataFrame:
    """Rows of both sides in the pairs of blocks of a sequence in which they meet, partitioned by pair.

    `keys` (key, pos, ..) are repeated for their own and each later block in which the sequence has queries, and come
    first in a pair; `asking` has _qb and _kb already. A pair holds a block of keys at a time, whatever
    the sequence's length, and its queries pass by.
    """
    last = asking.groupBy(key).agg(F.max("_qb").alias("_last"))
    own = _block("pos")
    held = keys.join(last, key).where(own <= F.col("_last")).select(
        *keys.columns, F.explode(F.sequence(own, F.col("_last"))).alias("_qb"), own.alias("_kb"), F.lit(0).alias("_kind")
    )
    both = held.unionByName(asking.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(parts, *units).sortWithinPartitions(*units, "_kind", "pos")


def attn_scores(df: DataFrame, config: ModelConfig, key: str = "seq_id") -> DataFrame:
    """Scaled causal scores: (key, pos, head, kblock, kpos[], val[], ..).

    `df` has (key, pos, q, k) with concatenated heads; positions start at 0 and occur once. A row has the scores of a
    query over those keys of one block that it sees, in order; no row per pair is made. Rows lie `in_tiles` (with
    `again`), or are sent there: once, and keys twice to each later tile. The scores, which are by far
    more than the rows, are made where the rows are, in batches, and cross no shuffle.

    More columns serve `attn_softmax` and, if `df` has v, `attn_mix`: the greatest score and the sum of exponents of
    each query, and the values of a block beside the first of the queries that meet it.
    """
    values = "v" in df.columns
    placed = {"_tile", "_kind"} <= set(df.columns)
    rows = df if placed else in_tiles(df.select(key, "pos", "q", "k", *(["v"] if values else [])), config, key, again=True)
    place = df.schema["pos"].dataType
    schema = T.StructType([
        df.schema[key], df.schema["pos"], T.StructField("head", T.IntegerType()), T.StructField("kblock", T.IntegerType()),
        T.StructField("kpos", T.ArrayType(place)), T.StructField("val", T.ArrayType(T.DoubleType())), T.StructField("_tile", T.IntegerType()),
        T.StructField("_top", T.DoubleType()), T.StructField("_total", T.DoubleType()),
    ])
    if values:
        schema = schema.add("_places", T.ArrayType(T.LongType())).add("_values", T.ArrayType(T.DoubleType()))
    step, shown = scores_step(config, key, [key, "_tile"]), score_rows(key, ATTENTION_BLOCK, values)
    return follow(rows, step, schema, gives="scores with values" if values else "scores", rows=shown)


def attn_softmax(scores: DataFrame, clamp: float = 50.0, key: str = "seq_id", out: str = "prob") -> DataFrame:
    """Softmax of each query's scores over all its blocks, as a column beside them.

    Scores of `attn_scores` bring the greatest one and the sum of exponents of their query, so that nothing is
    sent, and follow them in one process if they come from there. Of others, the blocks of a query meet in a window: as many
    rows as the sequence has blocks.
    """
    chain = chain_of(scores, "scores") or chain_of(scores, "scores with values")
    if chain is not None and out not in scores.columns:
        schema = T.StructType([*scores.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])
        return follow(scores, softmax_step(clamp, out), schema, chain.gives, chain.gives, chain.rows)
    if {"_top", "_total"} <= set(scores.columns):
        return scores.withColumn(out, softmax_kernel(clamp)("val", "_top", "_total"))
    each = Window.partitionBy(key, "pos", "head")
    topped = scores.withColumn("_top", F.max(F.array_max("val")).over(each))
    e = F.transform("val", lambda x: V.clamped_exp(x - F.col("_top"), clamp))
    summed = topped.withColumn("_e", e).withColumn("_total", F.sum(F.aggregate("_e", F.lit(0.0), lambda a, x: a + x)).over(each))
    return summed.withColumn(out, F.transform("_e", lambda x: x / F.col("_total"))).drop("_top", "_e", "_total")


def attn_mix(
    weights: DataFrame, kv: DataFrame | None, config: ModelConfig, weight: str = "prob", key: str = "seq_id", out: str = "o",
) -> DataFrame:
    """Mix values by attention weights: (key, pos, head, o).

    `weights` is (key, pos, head, kblock, kpos[], weight[]) as of `attn_softmax`; `kv` has (key, pos, v) with
    concatenated heads. Each block of values meets the weights for it, and the sums of a query's
    blocks are added, combined before the shuffle.

    Without `kv` the values are those that `attn_scores` left beside its rows. Then nothing is sent; the rows have to be
    all of them, as they lie.
    """
    fields = [weights.schema[key], weights.schema["pos"], T.StructField("head", T.IntegerType()), T.StructField(out, T.ArrayType(T.DoubleType()))]
    if kv is None and chain_of(weights, "scores with values") is not None and weight in weights.columns:
        return follow(weights, mix_step(key, weight, out), T.StructType(fields), "scores with values")
    if kv is None:
        rows = weights.select(key, "pos", "head", "kblock", weight, "_tile", "_places", "_values")
        return rows.mapInArrow(mix_tiles_kernel(config, key, [key, "_tile"], weight, out, ATTENTION_BLOCK), T.StructType(fields))
    units = [key, *UNITS]
    asking = weights.select(key, "pos", "head", "kpos", weight, _block("pos").alias("_qb"), F.col("kblock").alias("_kb"))
    pairs = _block_pairs(kv.select(key, "pos", "v"), asking, key, units)
    parts = pairs.mapInArrow(mix_kernel(config, key, units, weight, out), T.StructType(fields))
    sums = [F.sum(F.get(out, F.lit(i))) for i in range(config.head_dim)]
    return parts.groupBy(key, "pos", "head").agg(F.array(*sums).alias(out))


def attn_summary(weights: DataFrame, weight: str = "prob", key: str = "seq_id") -> DataFrame:
    """How many scores each row of `attn_softmax` has, the greatest, and the greatest weight: (key, pos, head, n, top, weight).

    A query and head have several rows, as they have of scores: at most one for each block of keys. Weights of `attn_scores` and
    `attn_softmax` are summed up in the process that makes them.
    """
    chain = chain_of(weights, "scores") or chain_of(weights, "scores with values")
    if chain is None:
        tops = [F.array_max("val").alias("top"), F.array_max(weight).alias(weight)]
        return weights.select(key, "pos", "head", F.size("kpos").cast("bigint").alias("n"), *tops)
    kinds = {"n": T.LongType(), "top": T.DoubleType(), weight: T.DoubleType()}
    schema = T.StructType([*(weights.schema[c] for c in (key, "pos", "head")), *(T.StructField(c, t) for c, t in kinds.items())])
    return follow(weights, summary_step(key, weight), schema, chain.gives)


def attn_partials(df: DataFrame, config: ModelConfig, key: str = "seq_id", kept: Sequence[str] = ()) -> DataFrame:
    """What the softmax over each block of keys comes to: (key, pos, head, top, total, mixed[], ..).

    `df` has (key, pos, q, k, v). `total` and `mixed` are the sums of the exponents, and of the values times
    them, relative to the greatest score `top` of the block; partial results of any blocks can be merged. Rows lie
    `in_tiles`, or are sent there. One partial result of a query brings its `kept` columns for `attn_merge`.
    """
    placed = {"_tile", "_kind"} <= set(df.columns)
    more = [c for c in kept if c not in (key, "pos", "q", "k", "v")]
    rows = df if placed else in_tiles(df.select(key, "pos", "q", "k", "v", *more), config, key)
    schema = T.StructType([
        df.schema[key], df.schema["pos"], T.StructField("head", T.IntegerType()), T.StructField("top", T.DoubleType()),
        T.StructField("total", T.DoubleType()), T.StructField("mixed", T.ArrayType(T.DoubleType())), T.StructField("_tile", T.IntegerType()),
        T.StructField("_own", T.BooleanType()), *(T.StructField(f"_kept_{c}", df.schema[c].dataType) for c in kept),
    ])
    step, shown = partials_step(config, key, [key, "_tile"], ATTENTION_BLOCK), partial_rows(key, ATTENTION_BLOCK, list(kept))
    return follow(rows, step, schema, gives=f"partial results with {list(kept)}", rows=shown)


def attn_merge(partials: DataFrame, config: ModelConfig, key: str = "seq_id", out: str = "o", kept: Sequence[str] = ()) -> DataFrame:
    """Partial results of a query's blocks to its mix of all values: (key, pos, head, o).

    With the `kept` columns that `attn_partials` was given: a row (kept columns, o) for each query, with concatenated heads. The
    partial results have to be all of them then, as they lie, and nothing is sent.
    """
    if kept:
        names = {f.name: f for f in partials.schema.fields}
        schema = T.StructType([*(T.StructField(c, names[f"_kept_{c}"].dataType) for c in kept), T.StructField(out, T.ArrayType(T.DoubleType()))])
        made = f"partial results with {list(kept)}"
        if chain_of(partials, made) is not None:
            return follow(partials, merge_step(list(kept), out), schema, made)
        return partials.mapInArrow(merge_kernel(config, key, [key, "_tile"], list(kept), out), schema)
    keys = [key, "pos", "head"]
    scaled = partials.withColumn("_f", F.exp(F.col("top") - F.max("top").over(Window.partitionBy(*keys))))
    sums = [F.sum(F.get("mixed", F.lit(i)) * F.col("_f")) for i in range(config.head_dim)]
    merged = scaled.groupBy(*keys).agg(F.array(*sums).alias("_o"), F.sum(F.col("total") * F.col("_f")).alias("_t"))
    return merged.select(*keys, F.transform("_o", lambda x: x / F.col("_t")).alias(out))


def attend_blocked(df: DataFrame, config: ModelConfig, key: str = "seq_id", out: str = "o") -> DataFrame:
    """`attend` as two steps: partial softmax of pairs of blocks, and their merge, with the other columns beside them."""
    kept = [c for c in df.columns if c not in ("q", "_tile", "_kind")]
    return attn_merge(attn_partials(df, config, key, kept), config, key, out, kept)


def tile_rows(config: ModelConfig) -> int:
    """Positions of an attention tile: as many blocks as TILE_BYTES of queries hold."""
    return ATTENTION_BLOCK * max(1, TILE_BYTES // (8 * config.q_dim * ATTENTION_BLOCK))


def tile_of(pos: str | Column, config: ModelConfig) -> Column:
    """The attention tile of a position."""
    return F.floor((F.col(pos) if isinstance(pos, str) else pos) / tile_rows(config)).cast("int")


def with_asked(df: DataFrame, config: ModelConfig, key: str = "seq_id") -> DataFrame:
    """df with `_ask`, the tiles in which its sequence has rows.

    Only sequences of more than a tile are counted and broadcast: at most a tile for each `tile_rows` rows.
    """
    long_ = df.where(F.col("pos") >= tile_rows(config)).groupBy(key).agg(F.collect_set(tile_of("pos", config)).alias("_later"))
    first = F.array(F.lit(0))
    joined = df.join(F.broadcast(long_.withColumnRenamed(key, "_key")), F.col(key).eqNullSafe(F.col("_key")), "left")
    return joined.withColumn("_ask", F.coalesce(F.concat(first, "_later"), first)).drop("_key", "_later")


def in_tiles(df: DataFrame, config: ModelConfig, key: str = "seq_id", again: bool = False) -> DataFrame:
    """Rows (key, pos, ..) in the tiles that need them: with `_tile` and `_kind`, partitioned by tile and in order.

    A row is of kind 0 in its own tile, and of kind 1 in each later one of its sequence; `again` has it there as kind 2
    too, after those. Attention takes rows with these columns as they lie, so that the narrow steps in between
    (embedding, norm, projections) are done again in a later tile, instead of their vectors being sent.
    """
    rows = df if "_ask" in df.columns else with_asked(df, config, key)
    spread = _spread(rows, config)
    if again:
        spread = spread.withColumn("_kind", F.explode(F.when(F.col("_kind") == 0, F.array(F.lit(0))).otherwise(F.array(F.lit(1), F.lit(2)))))
    if "_ask" not in df.columns:
        spread = spread.drop("_ask")
    return by_tile(spread, "_tile", key).sortWithinPartitions(key, "_tile", "_kind", "pos")


def by_tile(df: DataFrame, tile: str | Column, key: str = "seq_id", parts: int | None = None) -> DataFrame:
    """Partition rows by tile, into the session's number of partitions or `parts`; those of first tiles lie as by_sequence puts their sequence.

    So a long sequence is spread, and a table bucketed by sequence takes the rows of short
    ones as they lie.
    """
    tile = F.col(tile) if isinstance(tile, str) else tile
    home = F.when(tile == 0, F.col(key)).otherwise(F.xxhash64(key, tile).cast(df.schema[key].dataType))
    return df.repartition(parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), home)


def attend(
    df: DataFrame, config: ModelConfig, cache: DataFrame | None = None, key: str = "seq_id", out: str = "o",
) -> DataFrame:
    """Scores, softmax and value mix in one pass; adds the concatenated heads `o`.

    `df` has (key, pos, q, k, v) and any other columns, which are kept except q; a
    position occurs once. `cache` holds (key, pos, k, v) of earlier positions. There is no
    limit on positions.

    Positions are cut into tiles, and tiles into blocks of ATTENTION_BLOCK. The queries of a
    tile of a sequence are a unit of work, held by a task in blocks. Their own keys are theirs already; a key
    is sent once to each later tile that asks, and meets all blocks of it. So a sequence of one tile
    crosses the shuffle once, and one of n tiles sends a key to less than n of them.

    A column `_ask`, the tiles of the row's sequence in which `df` has rows, saves finding them. Rows that lie `in_tiles`
    already are taken as they lie.
    """
    units = [key, "_tile"]
    if cache is None and {"_tile", "_kind"} <= set(df.columns):
        kept = [c for c in df.columns if c not in ("q", "_tile", "_kind")]
        return _attended(df, df, config, units, kept, out)
    kept = [c for c in df.columns if c != "q"]
    rows = df if "_ask" in kept else with_asked(df, config, key)
    spread = _spread(rows, config)
    own = [F.when(F.col("_kind") == 0, F.col(c)).alias(c) for c in rows.columns if c not in (key, "pos", "k", "v")]
    both = spread.select(key, "pos", "k", "v", *own, "_tile", "_kind")
    if cache is not None:
        asked = rows.select(key, "_ask").dropDuplicates([key])
        old = _spread(cache.select(key, "pos", "k", "v").join(asked, key), config).drop("_ask").withColumn("_kind", F.lit(1))
        both = both.unionByName(old, allowMissingColumns=True)
    return _attended(by_tile(both, "_tile", key).sortWithinPartitions(*units, "_kind", "pos"), df, config, units, kept, out)


def _spread(rows: DataFrame, config: ModelConfig) -> DataFrame:
    """A row for its own and each later tile that asks, in which it is of kind 1."""
    own = tile_of("pos", config)
    later = F.filter("_ask", lambda t: t >= own)
    return rows.withColumn("_tile", F.explode(later)).withColumn("_kind", (F.col("_tile") != own).cast("int"))


def _attended(ready: DataFrame, df: DataFrame, config: ModelConfig, units: list[str], kept: list[str], out: str) -> DataFrame:
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(out, T.ArrayType(T.DoubleType()))])
    return follow(ready, attention_kernel(config, units, kept, out, ATTENTION_BLOCK), schema)


def attend_step(
    df: DataFrame, config: ModelConfig, cache: DataFrame, live: DataFrame, parts: int, key: str = "seq_id", out: str = "o",
) -> DataFrame:
    """`attend` of the few new positions of a decode step over a stored cache.

    The cache lies in `parts` buckets by key: its rows are filtered to the `live` keys, sorted and read where they
    are, and only the new rows are sent to them. (Were it to lie otherwise, the window would have it
    shuffled.) The new rows of a sequence are held together.
    """
    # Strings: a decode loop describes this for every layer of every step.
    fields = df.schema.fields
    kept = [f.name for f in fields if f.name != "q"]
    read = {key, "pos", "k", "v"}
    new = df.selectExpr(*(f"`{f.name}`" for f in fields), "0 AS _kind").repartition(parts, key)
    asked = live.select(key).repartition(parts, key).hint("shuffle_hash")
    old = cache.join(asked, key, "left_semi").selectExpr(*(
        f"`{f.name}`" if f.name in read else f"CAST(NULL AS {f.dataType.simpleString()}) AS `{f.name}`" for f in fields
    ), "1 AS _kind")
    ordered = new.union(old).selectExpr("*", f"row_number() OVER (PARTITION BY `{key}` ORDER BY _kind, pos) AS _at")
    return _attended(ordered, df, config, [key], kept, out)
