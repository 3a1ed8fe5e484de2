"""Tables with unique keys: checks and writes that never replace a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relinfer.operators.skew import as_list, with_group_value


def duplicate_keys(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """(keys, n): the keys that occur more than once, nulls being equal; counted before the shuffle."""
    return df.groupBy(*as_list(keys)).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unique(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """df, whose keys must be unique; a key that occurs twice is an error when df is read."""
    counted = with_group_value(df, keys, _n=F.count(F.lit(1)))
    message = F.concat_ws(" ", F.lit("a key occurs more than once:"), *as_list(keys))
    once = F.when(F.col("_n") > 1, F.raise_error(message).cast("boolean")).otherwise(True)
    return counted.where(once).select(df.columns)


def insert_missing(stored: DataFrame, new: DataFrame, keys: str | Sequence[str], order: str | None = None) -> DataFrame:
    """`stored` and those rows of `new` whose key it lacks; a row that is there is never replaced.

    Of several new rows of a key the first by `order` is taken (by all columns if there is none), so that the same
    rows given twice, or a write that is repeated, change nothing. Null keys are equal.
    """
    keys = as_list(keys)
    rest = [c for c in stored.columns if c not in keys]
    first = F.struct(*([order] if order else []), *rest)
    candidates = new.select(*stored.columns).groupBy(*keys).agg(F.min(first).alias("_row"))
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    missing = candidates.alias("n").join(stored.select(*keys).alias("s"), same, "left_anti")
    return stored.unionByName(missing.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]))
