"""The layer stack, prefill and the decode loop."""

from __future__ import annotations

import hashlib
import os
import re
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relinfer.config import SamplingParams
from relinfer.functions import vector as V
from relinfer.functions.kernels import gather_step, projection_step, residual_step
from relinfer.operators.layers import attend, attend_step, by_tile, embed, known, tile_of, with_asked
from relinfer.operators.sampling import gumbel_vec, penalise_vec, settings_of, survivors_vec, with_params
from relinfer.operators.skew import with_group_value
from relinfer.operators.steps import chain_of, follow
from relinfer.session import cut, drop_table, has_table, new_table_path
from relinfer.sources.weights import Model

# Layers in one query plan; after that many the activations are written out.
LAYERS_PER_JOB = 4


def _normed(df: DataFrame, model: Model, tensor: str, layer: int = 0) -> DataFrame:
    def build():
        return V.rms_norm_vec("x", V.vec_lit(model.matrix(tensor, layer)), model.config.rms_eps)

    return df.withColumn("x_norm", model.column((tensor, layer), build))


def projected(df: DataFrame, model: Model, layer: int) -> DataFrame:
    """Norm and projections: df with q, k and v, the first two turned by their position; of rows `in_tiles`, in one step."""
    cfg = model.config
    if {"_tile", "_kind"} <= set(df.columns) and all(map(model.fits, ("norm", "q", "k", "v"))):
        sent = {t: model.broadcast(t, layer) for t in ("q", "k", "v")}
        step = projection_step(cfg, model.matrix("norm", layer), sent, V.rope_frequencies(cfg.head_dim, cfg.rope_theta))
        return follow(df, step, _with_vectors(df, *sent))
    df = _normed(df, model, "norm", layer)
    df = model.multiply(df, {t: t for t in ("q", "k", "v")}, "x_norm", layer).drop("x_norm")
    turned = {
        c: model.column(("rope", c), lambda: V.rope_vec(c, "pos", cfg.head_dim, cfg.rope_theta))
        for c in ("q", "k")
    }
    return df.withColumns(turned)


def attention(df: DataFrame, model: Model, layer: int, attending=attend) -> DataFrame:
    """Attention sub-layer: norm, projections, rotary encoding, attention, residual.

    Rows (seq_id, pos, x, ...) get the new x and the keys and values k and v. `attending` adds `o` to rows with
    q, k and v.
    """
    df = attending(projected(df, model, layer), model.config)
    if chain_of(df) is not None and "_ask" not in df.columns and model.fits("o"):
        schema = T.StructType([f for f in df.schema.fields if f.name != "o"])
        return follow(df, residual_step(model.broadcast("o", layer)), schema)
    return _residual(model.multiply(df, {"_d": "o"}, "o", layer), model, "o")


def ffn(df: DataFrame, model: Model, layer: int) -> DataFrame:
    """Feed-forward sub-layer: norm, gate and up, gated activation, down, residual."""
    cfg = model.config
    df = _normed(df, model, "ffn_norm", layer)
    df = model.multiply(df, {"_g": "gate", "_u": "up"}, "x_norm", layer)
    gated = model.column(("swiglu",), lambda: V.swiglu_vec("_g", "_u", cfg.exp_clamp))
    df = df.withColumn("_h", gated).drop("x_norm", "_g", "_u")
    return _residual(model.multiply(df, {"_d": "down"}, "_h", layer), model, "_h")


def _residual(df: DataFrame, model: Model, used: str) -> DataFrame:
    added = model.column(("residual",), lambda: V.add_vec("x", "_d"))
    return df.withColumn("x", added).drop("_d", used)


def _layer(df: DataFrame, model: Model, layer: int, attending=attend) -> DataFrame:
    return ffn(attention(df, model, layer, attending), model, layer)


def _groups(model: Model, layers_per_job: int) -> list[range]:
    n = model.config.n_layers
    return [range(i, min(i + layers_per_job, n)) for i in range(0, n, layers_per_job)]


def layers(df: DataFrame, model: Model, layers_per_job: int = LAYERS_PER_JOB) -> DataFrame:
    """All layers, without keeping keys and values."""
    groups = _groups(model, layers_per_job)
    for group in groups:
        for layer in group:
            df = _layer(df, model, layer).drop("k", "v")
        if group is not groups[-1]:
            df = cut(df)
            model.release(group)
    return df.drop("_ask")


def embedded(tokens: DataFrame, model: Model, parts: int | None = None) -> DataFrame:
    """Token rows with their embedding x, partitioned while they are still small; rows `in_tiles` stay where they lie.

    An id outside the vocabulary keeps its row and place: it is embedded as the
    configured `unk_token`, or, without one, is an error.
    """
    rows = tokens if "_tile" in tokens.columns else by_tile(tokens, tile_of("pos", model.config), parts=parts)
    unk = model.config.unk_token
    if unk is None:
        return _looked_up(rows, model)
    inside = F.coalesce(F.col("token").between(0, model.config.vocab_size - 1), F.lit(False))
    mapped = rows.withColumn("_id", F.col("token")).withColumn("token", F.when(inside, F.col("token")).otherwise(unk))
    return _looked_up(mapped, model).withColumn("token", F.col("_id")).drop("_id")


def _with_vectors(df: DataFrame, *names: str) -> T.StructType:
    return T.StructType([*(f for f in df.schema.fields if f.name not in names), *(T.StructField(n, VECTOR) for n in names)])


def _looked_up(df: DataFrame, model: Model) -> DataFrame:
    if model.fits("emb") and {"_tile", "_kind"} <= set(df.columns):
        return follow(df, gather_step(model.table("emb"), "token", "x"), _with_vectors(df, "x"))
    if model.fits("emb"):
        return known(df.withColumn("x", model.lookup("emb", F.col("token"))))
    return embed(df, model.rows("emb"))


def logits_vec(df: DataFrame, model: Model, out: str = "logits") -> DataFrame:
    """Final norm and language-model head; x becomes a vector of logits."""
    normed = _normed(df, model, "out_norm").drop("x")
    return model.multiply(normed, {out: "out"}, "x_norm").drop("x_norm")


def forward(tokens: DataFrame, model: Model, layers_per_job: int = LAYERS_PER_JOB) -> DataFrame:
    """Logit vector of every position: (seq_id, pos, token, logits)."""
    return logits_vec(layers(embedded(with_asked(tokens, model.config), model), model, layers_per_job), model)


# ------------------------------------------------------------------ state


VECTOR = T.ArrayType(T.DoubleType())
ROW = (
    T.StructField("seq_id", T.LongType()), T.StructField("pos", T.LongType()),
    T.StructField("token", T.IntegerType()), T.StructField("last", T.BooleanType()),
    T.StructField("recent", T.ArrayType(T.IntegerType())), T.StructField("x", VECTOR),
    T.StructField("_ask", T.ArrayType(T.IntegerType())),
)


@dataclass
class State:
    """Append-only state of a run: tokens, activations, keys and values.

    Layers are run in groups, and each group has a table in the shared folder, bucketed by
    sequence and partitioned by segment: the rows that leave the group in a step, with the keys and
    values of its layers. A bucket of all segments is read where the new rows of its
    sequences are, so that stored keys never cross a shuffle, and a layer reads only its columns.

    A step writes its segment of every group and then commits it. What isn't committed
    is never read, and a step that is repeated overwrites its segment; so no row is doubled. A lost executor costs
    nothing that was finished.
    """

    spark: SparkSession
    groups: list[range]
    root: str
    buckets: int
    segments: list[int] = field(default_factory=list)
    segment: int = 0
    merged: int = 0

    def _schema(self, group: int) -> T.StructType:
        kv = [T.StructField(f"{c}{n}", VECTOR) for n in self.groups[group] for c in "kv"]
        return T.StructType([*ROW, *kv])

    def _names(self, group: int) -> list[str]:
        return [f.name for f in self._schema(group).fields]

    def table(self, group: int) -> str:
        """Name of a group's table in the session's catalog."""
        name = re.sub(r"\W", "_", os.path.basename(self.root))
        return f"{name}_{hashlib.sha256(self.root.encode()).hexdigest()[:16]}_{group:03d}"

    def create(self) -> None:
        """Register the tables; those of a state that is resumed by another session bring their segments."""
        for group in range(len(self.groups)):
            if self.spark.catalog.tableExists(self.table(group)):
                continue
            path = f"{self.root}/group-{group:03d}"
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self._schema(group))
            self.spark.sql(
                f"CREATE TABLE {self.table(group)} ({columns}, segment INT) USING parquet "
                f"OPTIONS (partitionOverwriteMode 'dynamic') PARTITIONED BY (segment) CLUSTERED BY (seq_id) INTO {self.buckets} BUCKETS LOCATION '{path}'"
            )
            if has_table(self.spark, path):
                self.spark.catalog.recoverPartitions(self.table(group))

    def read(self, group: int, segments: list[int] | None = None) -> DataFrame:
        """Rows of the committed or the given segments."""
        wanted = self.segments if segments is None else segments
        listed = ", ".join(map(str, wanted)) or "NULL"
        return self.spark.table(self.table(group)).where(f"segment IN ({listed})").select(self._names(group))

    def append(self, group: int, rows: DataFrame) -> DataFrame:
        """Write the rows of the step's segment and return them as stored, without keys and values."""
        self._write(group, rows)
        return self.read(group, [self.segment]).select(*[f.name for f in ROW])

    def _write(self, group: int, rows: DataFrame) -> None:
        columns = [f"CAST(`{f.name}` AS {f.dataType.simpleString()}) AS `{f.name}`" for f in self._schema(group).fields]
        rows.selectExpr(*columns, f"{self.segment} AS segment").write.insertInto(self.table(group), overwrite=True)

    def commit(self) -> None:
        """The segment of all groups becomes part of the state; the next step gets a new one."""
        self.segments.append(self.segment)
        self.segment += 1

    def _compact(self) -> None:
        """Merge the small segments of the steps since the last merge, but the newest."""
        first = 1 + self.merged
        old = self.segments[first:-1]
        if len(old) > 1:
            for group in range(len(self.groups)):
                self._write(group, self.read(group, old))
            self.segments[first:-1] = [self.segment]
            self.segment += 1
        self.merged += 1

    def retain(self, live: DataFrame) -> None:
        """Merge all segments but the newest, keeping the sequences that are `live` only."""
        old = self.segments[:-1]
        if old:
            for group in range(len(self.groups)):
                self._write(group, self.read(group, old).join(live.select("seq_id"), "seq_id", "left_semi"))
            self.segments[:-1] = [self.segment]
            self.segment += 1
        self.merged = 0

    def forget(self, segments: list[int]) -> None:
        """Delete segments that nothing reads any more."""
        for group in range(len(self.groups)):
            for number in segments:
                self.spark.sql(f"ALTER TABLE {self.table(group)} DROP IF EXISTS PARTITION (segment = {number})")
                drop_table(self.spark, f"{self.root}/group-{group:03d}/segment={number}")

    def cache(self, layer: int) -> DataFrame | None:
        """Keys and values (seq_id, pos, k, v) of one layer; none before the first step."""
        if not self.segments:
            return None
        group = next(g for g, members in enumerate(self.groups) if layer in members)
        return self.read(group).selectExpr("seq_id", "pos", f"k{layer} AS k", f"v{layer} AS v")

    def tokens(self) -> DataFrame:
        return self.read(len(self.groups) - 1).select("seq_id", "pos", "token")

    def drop(self) -> None:
        """Delete all tables of the run; what was read from them can't be computed any more."""
        for group in range(len(self.groups)):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table(group)}")
        drop_table(self.spark, self.root)


def init_state(
    spark: SparkSession, model: Model, layers_per_job: int = LAYERS_PER_JOB, path: str | None = None,
    buckets: int | None = None,
) -> State:
    """An empty state of its own for each run; nothing is deleted or reused.

    With the `path` (in a folder that all executors share) of a state that is there, that one's tables.
    """
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    state = State(spark, _groups(model, layers_per_job), path or new_table_path(spark, "state"), buckets)
    state.create()
    return state


def _stored_layers(df: DataFrame, model: Model, state: State, live: DataFrame | None = None) -> DataFrame:
    """All layers over new rows (seq_id, pos, token, last, recent, x, _ask), into the state.

    With `live` sequences the rows are a step that looks back on the state, else they are prompts.
    """
    for number, group in enumerate(state.groups):
        for layer in group:
            attending = attend
            if live is not None:
                attending = partial(attend_step, cache=state.cache(layer), live=live, parts=state.buckets)
            df = _layer(df, model, layer, attending).withColumnsRenamed({"k": f"k{layer}", "v": f"v{layer}"})
        if number == len(state.groups) - 1:
            # Only the last position of a sequence is ever scored.
            df = df.withColumn("x", F.when(F.col("last"), F.col("x")))
        df = state.append(number, df)
        model.release(group)
    state.commit()
    return df


def kv_append(cache: DataFrame, k: DataFrame, v: DataFrame) -> DataFrame:
    """Append the keys and values of new positions, given as (key columns, k) and (.., v)."""
    keys = [c for c in cache.columns if c not in ("k", "v")]
    return cache.unionByName(k.join(v, keys).select(*cache.columns))


def prefill(tokens: DataFrame, model: Model, state: State) -> DataFrame:
    """Forward pass over all prompt positions at once; fills the state.

    Returns the frontier (seq_id, pos, token, recent, x), the last position of
    every sequence with the tokens its penalty looks back on.
    """
    near = F.col("pos") >= F.col("_end") - model.config.rep_window
    placed = with_group_value(
        tokens.select("seq_id", F.col("pos").cast("bigint").alias("pos"), "token"), "seq_id",
        _end=F.max("pos"), _ask=F.collect_set(tile_of("pos", model.config)),
    )
    marked = placed.select(
        "seq_id", "pos", "token", (F.col("pos") == F.col("_end")).alias("last"),
        F.when(near, F.array(F.col("token").cast("int"))).alias("recent"), "_ask",
    )
    stored = _stored_layers(embedded(marked, model), model, state)
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.col("recent")[0].alias("token"))))
    recent = stored.where(F.col("recent").isNotNull()).groupBy("seq_id").agg(
        F.transform(ordered, lambda r: r.getField("token")).alias("recent")
    )
    return stored.where("last").select("seq_id", "pos", "token", "x").join(recent, "seq_id")


def sample_next(
    frontier: DataFrame, model: Model, params: SamplingParams | None, seed: int
) -> DataFrame:
    """The next token of every frontier row; narrow. Without `params` rows bring their settings."""
    cfg = model.config

    def build():
        pen = settings_of(params)["rep_pen"]
        penalised = penalise_vec("logits", "recent", pen, cfg.protected_tokens)
        return survivors_vec(penalised, params, cfg.exp_clamp)

    survivors = model.column(("survivors", params), build)
    chosen = model.column(("choice", seed), lambda: gumbel_vec("_survivors", seed, "seq_id", "pos"))
    following = logits_vec(frontier, model).withColumns(
        {"pos": F.col("pos") + 1, "_survivors": survivors}
    )
    return following.withColumn("token", chosen).drop("logits", "_survivors", *vars(SamplingParams()))


def _slide(recent: Column, token: Column, size: int) -> Column:
    longer = F.concat(recent, F.array(token))
    return F.when(F.size(longer) > size, F.slice(longer, F.size(longer) - (size - 1), size)).otherwise(longer)


def decode_step(
    frontier: DataFrame, model: Model, params: SamplingParams | DataFrame, state: State, seed: int,
    max_pos: DataFrame | None = None, forced: DataFrame | None = None,
) -> DataFrame:
    """One token for every live sequence: sample, embed, all layers, append to the state.

    Returns the new frontier, which has no row for a finished sequence.
    """
    cfg = model.config
    live = frontier.where(~F.col("token").isin(*cfg.stop_tokens))
    if isinstance(params, DataFrame):
        live, params = with_params(live, params, each_once=True), None
    limit = settings_of(params)["max_pos"]
    if max_pos is None:
        live = live.where(F.col("pos") < limit)
    else:
        limits = max_pos.select("seq_id", F.col("max_pos").alias("_limit"))
        live = live.join(limits, "seq_id", "left").where(F.col("pos") < F.coalesce("_limit", limit)).drop("_limit")
    new = sample_next(live, model, params, seed)
    if forced is not None:
        given = forced.select("seq_id", "pos", F.col("token").cast("int").alias("_forced"))
        new = new.join(given, ["seq_id", "pos"], "left").withColumn(
            "token", F.coalesce("_forced", "token")
        ).drop("_forced")
    new = new.withColumns(
        {
            "recent": _slide(F.col("recent"), F.col("token"), cfg.rep_window + 1),
            "last": F.lit(True),
            "_ask": F.array().cast("array<int>"),
        }
    )
    # Known before anything is sampled: of the cache, only live sequences are read.
    stored = _stored_layers(embedded(new, model, state.buckets), model, state, live.select("seq_id"))
    return stored.select("seq_id", "pos", "token", "recent", "x")


def generate(
    tokens: DataFrame, model: Model, params: SamplingParams | DataFrame, max_new: int, seed: int = 0,
    max_pos: DataFrame | None = None, forced: DataFrame | None = None,
    layers_per_job: int = LAYERS_PER_JOB, compact_every: int = 16, state: State | None = None,
) -> DataFrame:
    """Continue every prompt (seq_id, pos, token) by up to `max_new` tokens.

    Returns all tokens (seq_id, pos, token), the prompt's included. A sequence
    ends after a stop token, which is kept, or at its `max_pos`, for which `params`
    has the default. `params` may be a table with a row (seq_id, temp, top_p, ...) for
    each sequence; what it lacks has the default. `forced` gives
    tokens (seq_id, pos, token) that replace the sampled ones. The driver only
    starts the steps; it stops when no sequence is live. The result is read from the
    state; a caller that gives its own (of `init_state`) can drop it after use.
    """
    if state is None:
        # Not more buckets than sequences: a bucket is a task of every layer.
        parts = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        sequences = tokens.select("seq_id").distinct().limit(parts).count()
        state = init_state(tokens.sparkSession, model, layers_per_job, buckets=max(1, sequences))
    frontier = prefill(tokens, model, state)
    for step in range(max_new):
        frontier = decode_step(frontier, model, params, state, seed, max_pos, forced)
        if frontier.isEmpty():
            break
        if (step + 1) % compact_every == 0:
            state._compact()
    return state.tokens()
