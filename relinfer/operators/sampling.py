"""Logit processing and random choice.

Two forms of each step: on long rows (keys, token, val), one row per
candidate; and on a logit vector per row, which needs no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relinfer.config import SamplingParams
from relinfer.functions import vector as V
from relinfer.operators.skew import as_list, lookup_join, running_sum, with_group_value

# The longest rank limit that Spark applies in front of a shuffle.
RANKED = 1000

Setting = float | int | str | Column


def setting(value: Setting) -> Column:
    """A sampling setting: a constant, or the name of a per-row column."""
    return F.col(value) if isinstance(value, str) else F.lit(value) if not isinstance(value, Column) else value


def settings_of(params: SamplingParams | None) -> dict[str, Column]:
    """Every setting as a column: a constant, or, without `params`, what the rows bring by its name."""
    if params:
        return {k: F.lit(v) for k, v in vars(params).items()}
    own = {k: F.col(k) for k in vars(SamplingParams())}
    return own | {k: _positive(own[k], k) for k in ("temp", "top_k", "rep_pen")}


def _positive(value: Column, name: str) -> Column:
    message = F.raise_error(F.lit(f"{name} must be positive"))
    return F.when(value > 0, value).otherwise(message.cast("int" if name == "top_k" else "double"))


def with_params(
    df: DataFrame, params: SamplingParams | DataFrame, keys: Sequence[str] = ("seq_id",), each_once: bool = False
) -> DataFrame:
    """Attach sampling settings: the same for all rows, or a table of them per key.

    A key without a row in the table gets the defaults, and so does a setting that is null or
    for which the table has no column. `each_once` says that a key has one row in df.
    """
    if isinstance(params, DataFrame):
        given = params.select(*keys, *[c for c in vars(SamplingParams()) if c in params.columns])
        joined = df.join(given, list(keys), "left") if each_once else lookup_join(df, given, list(keys), "left")
        return joined.withColumns({
            k: F.coalesce(F.col(k), F.lit(v)) if k in given.columns else F.lit(v)
            for k, v in vars(SamplingParams()).items()
        })
    return df.withColumns({k: F.lit(v) for k, v in vars(params).items()})


# ---------------------------------------------------------------- long form


def temperature(df: DataFrame, temp: Setting, val: str = "val", out: str = "t_val") -> DataFrame:
    """val / temp; a temperature that is not positive is an error."""
    if isinstance(temp, (int, float)) and temp <= 0:
        raise ValueError("temp must be positive")
    checked = setting(temp)
    if not isinstance(temp, (int, float)):
        checked = _positive(checked, "temp")
    return df.withColumn(out, F.col(val) / checked)


def softmax(
    df: DataFrame, keys: str | Sequence[str], val: str = "val", out: str = "prob",
    clamp: float = 50.0, keep_total: bool = False,
) -> DataFrame:
    """Softmax per group: exponents relative to the group maximum, limited to +-clamp.

    With `keep_total` the sum of a group's exponentials stays as `_total`; the greatest
    probability of the group is 1 / _total.
    """
    keys = as_list(keys)
    shifted = with_group_value(df, keys, _max=F.max(val))
    exps = shifted.withColumn("_e", V.clamped_exp(F.col(val) - F.col("_max"), clamp)).drop("_max")
    total = with_group_value(exps, keys, _total=F.sum("_e"))
    probs = total.withColumn(out, F.col("_e") / F.col("_total")).drop("_e")
    return probs if keep_total else probs.drop("_total")


def min_p_filter(
    df: DataFrame, keys: str | Sequence[str], min_p: Setting, prob: str = "prob"
) -> DataFrame:
    """Keep rows with prob >= group maximum * min_p."""
    best = with_group_value(df, keys, _best=F.max(prob))
    return best.where(F.col(prob) >= F.col("_best") * setting(min_p)).drop("_best")


def top_k_filter(
    df: DataFrame, keys: str | Sequence[str], k: Setting, prob: str = "prob", token: str = "token"
) -> DataFrame:
    """Keep the k most probable rows of each group, ties by token.

    A constant limit up to RANKED is pushed below the shuffle, so at most k rows per group
    leave each task. Beyond it, or with a limit per row, ranks are counted over range
    partitions, so that a group of any size is split.
    """
    if not isinstance(k, int) or k > RANKED:
        order = [(F.col(prob), True), (F.col(token), False)]
        counted = running_sum(df.withColumn("_one", F.lit(1)), keys, order, "_one", "_rn")
        return counted.where(F.col("_rn") <= setting(k)).drop("_one", "_rn")
    ranked = Window.partitionBy(*as_list(keys)).orderBy(F.desc(prob), F.asc(token))
    return df.withColumn("_rn", F.row_number().over(ranked)).where(F.col("_rn") <= k).drop("_rn")


def top_p_filter(
    df: DataFrame, keys: str | Sequence[str], top_p: Setting, prob: str = "prob",
    token: str = "token", bounded: bool = False,
) -> DataFrame:
    """Keep rows whose cumulative mass before them is at most top_p; never none.

    `bounded` says that groups are small already (after a top-k filter), so an
    ordinary window may hold one.
    """
    keys = as_list(keys)
    if bounded:
        order = (
            Window.partitionBy(*keys).orderBy(F.desc(prob), F.asc(token))
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        summed = df.withColumn("_cdf", F.sum(prob).over(order))
    else:
        summed = running_sum(
            df, keys, [(F.col(prob), True), (F.col(token), False)], prob, "_cdf"
        )
    return summed.where(F.col("_cdf") - F.col(prob) <= setting(top_p)).drop("_cdf")


def filter_logits(
    df: DataFrame, params: SamplingParams | DataFrame, keys: str | Sequence[str] = "seq_id",
    val: str = "val", token: str = "token",
) -> DataFrame:
    """Temperature, softmax, min-p, top-k, top-p; probabilities are not re-normalised.

    `params` may be a table with a row of settings for each group.
    """
    by_row = isinstance(params, DataFrame)
    if by_row:
        df = with_params(df, params, as_list(keys))
    temp, min_p, top_k, top_p = (k if by_row else getattr(params, k) for k in ("temp", "min_p", "top_k", "top_p"))
    probs = softmax(temperature(df, temp, val), keys, "t_val", keep_total=True)
    best = F.lit(1.0) / F.col("_total")
    likely = probs.where(F.col("prob") >= best * setting(min_p)).drop("_total")
    top = top_k_filter(likely, keys, top_k, token=token)
    bounded = not by_row and top_k <= RANKED
    kept = top_p_filter(top, keys, top_p, token=token, bounded=bounded)
    return kept.drop(*vars(SamplingParams())) if by_row else kept


def gumbel_sample(
    df: DataFrame, keys: str | Sequence[str], seed: int, val: str = "t_val", token: str = "token"
) -> DataFrame:
    """Draw one row per group, with probability proportional to exp(val)."""
    keys = as_list(keys)
    noisy = F.col(val) + V.gumbel(V.uniform(seed, *keys, token))
    return df.groupBy(*keys).agg(
        F.max_by(F.col(token), F.struct(noisy.alias("g"), (-F.col(token)).alias("t"))).alias(token)
    )


def repetition_penalty(
    logits: DataFrame, tokens: DataFrame, window: int = 64, pen: Setting = 1.2,
    protected: int = 16, val: str = "val", at: str | None = None,
) -> DataFrame:
    """Penalise candidates seen at the last `window` + 1 positions of their sequence.

    A non-positive logit is multiplied by `pen`, a positive one divided by it,
    once per candidate however often it was seen; ids up to `protected` are
    left alone. With `at`, the position column of `logits`, each position looks
    back from itself; without it, every sequence looks back from its end.
    """
    value = F.col(val)
    penalised = F.when(value <= 0, value * setting(pen)).otherwise(value / setting(pen))
    if at is None:
        placed = with_group_value(tokens, "seq_id", _end=F.max("pos"))
        recent = placed.where(
            (F.col("pos") >= F.col("_end") - window) & (F.col("token") > protected)
        ).select("seq_id", "token")
        # At most window + 1 ids per sequence: an array, so that logits are joined by sequence.
        seen = recent.groupBy("seq_id").agg(F.collect_set("token").alias("_seen"))
        marked = logits.join(seen, "seq_id", "left")
        hit = F.coalesce(F.array_contains("_seen", F.col("token")), F.lit(False))
        return marked.withColumn(val, F.when(hit, penalised).otherwise(value)).select(*logits.columns)
    else:
        reach = F.sequence(F.col("pos"), F.col("pos") + window)
        recent = tokens.where(F.col("token") > protected).select(
            "seq_id", F.explode(reach).alias(at), "token"
        )
        keys = ["seq_id", at, "token"]
    seen = recent.distinct().withColumn("_seen", F.lit(True))
    marked = logits.join(seen, keys, "left")
    return marked.withColumn(val, F.when(F.col("_seen"), penalised).otherwise(value)).drop("_seen").select(
        *logits.columns
    )


# ------------------------------------------------------------- token log


def next_pos(tokens: DataFrame) -> DataFrame:
    """Position after the last one, per sequence."""
    return tokens.groupBy("seq_id").agg((F.max("pos") + 1).alias("pos"))


def last_token(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("seq_id").agg(F.max_by("token", "pos").alias("token"))


def is_stopped(tokens: DataFrame, stop: Sequence[int] = (0, 2)) -> DataFrame:
    """Whether the last token of each sequence ends it."""
    return tokens.groupBy("seq_id").agg(
        F.max_by("token", "pos").isin(*[int(s) for s in stop]).alias("stopped")
    )


def is_exhausted(tokens: DataFrame, max_pos: DataFrame | int) -> DataFrame:
    """Whether each sequence has reached its `max_pos` (not max(pos) < max_pos)."""
    last = tokens.groupBy("seq_id").agg(F.max("pos").alias("_last"))
    if isinstance(max_pos, DataFrame):
        last = last.join(max_pos.select("seq_id", "max_pos"), "seq_id")
    else:
        last = last.withColumn("max_pos", F.lit(max_pos))
    return last.select("seq_id", (F.col("_last") >= F.col("max_pos")).alias("exhausted"))


def choose_token(forced: DataFrame, sampled: DataFrame) -> DataFrame:
    """The forced token of (seq_id, pos) if there is one, else the sampled token."""
    given = forced.select("seq_id", "pos", F.col("token").alias("_forced"))
    chosen = sampled.join(given, ["seq_id", "pos"], "left")
    return chosen.withColumn("token", F.coalesce("_forced", "token")).drop("_forced")


def next_token(
    tokens: DataFrame,
    logits: DataFrame,
    params: SamplingParams,
    seed: int,
    stop: Sequence[int] = (0, 2),
    window: int = 64,
    protected: int = 16,
    max_pos: DataFrame | int | None = None,
    forced: DataFrame | None = None,
) -> DataFrame:
    """The next (seq_id, pos, token) of every sequence that is not finished.

    `tokens` is the log so far and `logits` the (seq_id, token, val) rows of
    the last position.
    """
    log = tokens.groupBy("seq_id").agg(
        F.max("pos").alias("_last"), F.max_by("token", "pos").alias("_token")
    )
    live = log.where(~F.col("_token").isin(*[int(s) for s in stop]))
    limit = params.max_pos if max_pos is None else max_pos
    if isinstance(limit, DataFrame):
        live = live.join(limit.select("seq_id", "max_pos"), "seq_id").where("_last < max_pos")
    else:
        live = live.where(F.col("_last") < limit)
    live = live.select("seq_id", (F.col("_last") + 1).alias("pos"))

    if forced is not None:
        # A forced token needs no logits.
        given = live.join(forced.select("seq_id", "pos", "token"), ["seq_id", "pos"])
        live = live.join(given, ["seq_id", "pos"], "left_anti")
    asked = logits.join(live, "seq_id")
    penalised = repetition_penalty(asked, tokens, window, params.rep_pen, protected)
    sampled = gumbel_sample(filter_logits(penalised, params), ["seq_id", "pos"], seed)
    if forced is None:
        return sampled
    missing = live.join(sampled, ["seq_id", "pos"], "left")
    return given.select("seq_id", "pos", "token").unionByName(missing.select("seq_id", "pos", "token"))


# ------------------------------------------------------------ vector form


def penalise_vec(logits: Column | str, recent: Column | str, pen: float | Column, protected: int) -> Column:
    """Repetition penalty on a logit vector, given the recent token ids."""
    return V.let(
        recent,
        lambda seen: F.transform(
            V.col(logits),
            lambda v, i: F.when(
                (i > protected) & F.array_contains(seen, i),
                F.when(v <= 0, v * pen).otherwise(v / pen),
            ).otherwise(v),
        ),
    )


def survivors_vec(logits: Column | str, params: SamplingParams | None, clamp: float = 50.0) -> Column:
    """Candidates left by temperature, softmax, min-p, top-k and top-p.

    Returns an array of (token, t_val, prob) by falling probability, ties by token.
    Without `params` the settings are columns of their names.
    """
    own = settings_of(params)
    scaled = F.transform(V.col(logits), lambda v: v / own["temp"])

    def candidates(t, p):
        rows = F.zip_with(t, p, lambda tv, pv: F.struct((-pv).alias("np"), tv.alias("t_val")))
        indexed = F.transform(
            rows,
            lambda r, i: F.struct(
                r.getField("np").alias("np"), i.alias("token"), r.getField("t_val").alias("t_val")
            ),
        )
        best = F.array_max(p) * own["min_p"]
        likely = V.let(best, lambda b: F.filter(indexed, lambda r: -r.getField("np") >= b))
        top = F.slice(F.array_sort(likely), F.lit(1), own["top_k"].cast("int"))
        return nucleus(top)

    def nucleus(top):
        empty = F.array().cast("array<struct<token:int,t_val:double,prob:double>>")
        start = F.struct(F.lit(0.0).alias("cdf"), empty.alias("kept"))

        def step(acc, r):
            prob = -r.getField("np")
            row = F.struct(
                r.getField("token").alias("token"), r.getField("t_val").alias("t_val"),
                prob.alias("prob"),
            )
            cdf = acc.getField("cdf") + prob
            kept = acc.getField("kept")
            return F.struct(
                cdf.alias("cdf"),
                F.when(cdf - prob <= own["top_p"], F.concat(kept, F.array(row)))
                .otherwise(kept).alias("kept"),
            )

        return F.aggregate(top, start, step, lambda acc: acc.getField("kept"))

    return V.let(scaled, lambda t: V.let(V.softmax_vec(t, clamp), lambda p: candidates(t, p)))


def gumbel_vec(survivors: Column | str, seed: int, *keys: Column | str) -> Column:
    """Draw one of the surviving candidates; the token id."""
    scored = F.transform(
        V.col(survivors),
        lambda r: F.struct(
            (r.getField("t_val") + V.gumbel(V.uniform(seed, *keys, r.getField("token")))).alias("g"),
            (-r.getField("token")).alias("t"),
        ),
    )
    return (-F.array_max(scored).getField("t")).cast("int")
