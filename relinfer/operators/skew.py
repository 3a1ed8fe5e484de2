"""Joins and running sums that stay balanced when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relinfer.config import MAX_BROADCAST_BYTES

# A key outside the HOT_KEYS most frequent ones holds less than 1/HOT_KEYS of
# the rows; the hot ones form a table of at most HOT_KEYS rows.
HOT_KEYS = 10_000
SALTS = 1024
# So many consecutive rows, as a power of two, have the same salt: rows that resemble each other are written together.
SALT_RUN = 12
# Of so many rows one bounds the pieces of a running sum, and pieces of a group at most.
SAMPLED_ROWS = 4096
PIECES = 256


def as_list(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join in which null keys match, as they do in a grouping."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def lookup_join(
    big: DataFrame,
    table: DataFrame,
    keys: str | Sequence[str],
    how: str = "inner",
    bounded_bytes: int | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Join `big` to a table that has at most one row per key.

    `bounded_bytes` is an upper bound of the table's size that the caller can
    prove (a model dimension, a limit): a small enough table is broadcast.
    Otherwise the table's rows for the most frequent keys of `big` (at most
    HOT_KEYS rows) are broadcast, and only the other rows of `big` are matched
    through a shuffle; rows that are served already are spread by a salt, in runs and without their key.
    `counts` may give the number of rows of each key in a column `_n`.
    """
    keys = as_list(keys)
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    if bounded_bytes is not None and bounded_bytes <= MAX_BROADCAST_BYTES:
        return _join(big, F.broadcast(table), keys, how)

    if counts is None:
        counts = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.orderBy(F.desc("_n"), *keys).limit(HOT_KEYS).select(*keys)
    values = [c for c in table.columns if c not in keys]
    packed = table.select(*keys, F.struct(*values).alias("_value"))
    hot_values = _join(packed, F.broadcast(hot), keys, "inner").withColumnRenamed("_value", "_hot")

    # A row that is served already takes a salt > 0 and finds no partner; a shuffle takes its key along only for a caller who reads it.
    run_hash = F.xxhash64(F.shiftright(F.monotonically_increasing_id(), SALT_RUN))
    salted = _join(big, F.broadcast(hot_values), keys, "left").withColumn(
        "_salt", F.when(F.col("_hot").isNull(), 0).otherwise(1 + F.pmod(run_hash, F.lit(SALTS)))
    ).withColumns({f"_k_{k}": F.when(F.col("_hot").isNull(), F.col(k)) for k in keys})
    unsalted = packed.withColumn("_salt", F.lit(0).cast("bigint")).withColumnsRenamed({k: f"_k_{k}" for k in keys})
    joined = _join(salted, unsalted, [*(f"_k_{k}" for k in keys), "_salt"], "left")
    found = F.coalesce("_hot", "_value")
    result = joined.where(found.isNotNull()) if how == "inner" else joined
    extra = [c for c in big.columns if c not in keys]
    result = result.select(*keys, *extra, found.alias("_found"))
    return result.select(
        *keys, *extra, *[F.col("_found").getField(c).alias(c) for c in values]
    )


def with_group_value(
    df: DataFrame, keys: str | Sequence[str], **aggregates: Column
) -> DataFrame:
    """Attach aggregates of its group to every row.

    Unlike a window over the keys this never brings a group together: the
    aggregates are pre-combined before the shuffle and joined back. Nothing runs while the
    plan is described; adaptive execution broadcasts the aggregates if their real size
    allows, and else splits the partitions of hot keys in the join.
    """
    keys = as_list(keys)
    grouped = df.groupBy(*keys).agg(*[a.alias(name) for name, a in aggregates.items()])
    return _join(df, grouped, keys, "inner")


def _not_after(bound: Column, row: list[Column], descending: list[bool]) -> Column:
    """Whether a bound stands in front of a row or at its place; nulls are first when ascending, else last."""
    result = F.lit(True)
    for i in reversed(range(len(row))):
        b, r = bound[f"_o{i}"], row[i]
        less = (b > r) if descending[i] else (b < r)
        null_first = (b.isNotNull() & r.isNull()) if descending[i] else (b.isNull() & r.isNotNull())
        result = F.coalesce(less, F.lit(False)) | null_first | (b.eqNullSafe(r) & result)
    return result


def _count_before(bounds: Column, row: list[Column], descending: list[bool]) -> Column:
    """How many of the sorted bounds stand in front of a row or at its place, by bisection."""

    def step(n: Column, size: Column) -> Column:
        reached = n + size
        fits = (reached <= F.size(bounds)) & _not_after(F.get(bounds, reached - 1), row, descending)
        return F.when(fits, reached).otherwise(n)

    sizes = [F.lit(1 << i) for i in reversed(range(PIECES.bit_length()))]
    return F.aggregate(F.array(*sizes), F.lit(0), step)


def running_sum(
    df: DataFrame,
    keys: str | Sequence[str],
    order: Sequence[tuple[Column, bool]],
    value: str,
    out: str,
) -> DataFrame:
    """Running sum (ROWS UNBOUNDED PRECEDING) of `value` per key, at any group size.

    `order` lists (expression, descending) pairs; ties are ordered by a hash of the whole row. Nothing runs while
    the plan is described.

    A row in SAMPLED_ROWS, by that hash, is a bound of pieces (at most PIECES of a group), so that only groups of
    more rows than that are cut, and pieces depend on what the rows hold alone, not on where they lie. The rows
    are partitioned by group and piece; each piece sums on its own, and the sums of the pieces before it are
    added. Rows that are equal in all columns stay in one piece.
    """
    keys = as_list(keys)
    columns = df.columns
    descending = [d for _, d in order] + [False]
    last = len(order)
    tie = F.xxhash64(*(F.col(f"`{c}`") for c in columns))
    tied = df.withColumns({f"_o{i}": o for i, (o, _) in enumerate(order)} | {f"_o{last}": tie})
    names = [f"_o{i}" for i in range(last + 1)]

    mixed = F.xxhash64(F.lit(SAMPLED_ROWS), f"_o{last}")
    slots = tied.where(F.pmod(mixed, F.lit(SAMPLED_ROWS)) == 0).withColumn(
        "_slot", F.pmod(F.shiftright(mixed, 20), F.lit(PIECES))
    )
    chosen = slots.groupBy(*keys, "_slot").agg(F.min(F.struct(f"_o{last}", *names[:-1])).alias("_bound"))
    in_order = lambda a, b: F.when(
        _not_after(a, [b[n] for n in names], descending), F.when(_not_after(b, [a[n] for n in names], descending), 0).otherwise(-1)
    ).otherwise(1)
    bounds = chosen.groupBy(*keys).agg(F.array_sort(F.collect_list("_bound"), in_order).alias("_bounds"))
    row = [F.col(n) for n in names]
    placed = _join(tied, bounds, keys, "left").withColumn(
        "_piece", F.when(F.col("_bounds").isNull(), 0).otherwise(_count_before(F.col("_bounds"), row, descending))
    ).drop("_bounds")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = placed.repartition(parts, *keys, "_piece")

    totals = pieces.groupBy(*keys, "_piece").agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_piece", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset")
    )
    sort = [F.col(n).desc() if d else F.col(n).asc() for n, d in zip(names, descending)]
    within = (
        Window.partitionBy(*keys, "_piece").orderBy(*sort)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = pieces.withColumn("_sum", F.sum(value).over(within))
    joined = _join(summed, offsets, [*keys, "_piece"], "inner")
    return joined.select(*columns, (F.col("_offset") + F.col("_sum")).alias(out))
