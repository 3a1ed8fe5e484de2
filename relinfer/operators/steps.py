"""Python steps in a row, which run in one process."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from relinfer.functions.kernels import chained


@dataclass(frozen=True)
class Chain:
    """What a frame is made by: steps over a frame, what the last one gives, and what makes record batches of that."""

    source: DataFrame
    steps: tuple[Callable, ...]
    gives: str = "batches"
    rows: Callable | None = None


def chain_of(df: DataFrame, gives: str | None = None) -> Chain | None:
    """The steps that `df` itself is the result of (of `gives`, if named); none behind any other operator."""
    chain = None if df.is_cached else vars(df).get("_chain")
    return chain if chain is None or gives in (None, chain.gives) else None


def follow(
    df: DataFrame, step: Callable, schema: T.StructType, takes: str = "batches", gives: str = "batches", rows: Callable | None = None,
) -> DataFrame:
    """`df.mapInArrow(step, schema)`; where df is the result of such steps, in the process that runs them.

    So rows that one step hands to the next don't pass the JVM. A step that gives something else than record batches
    has `rows`, which makes them of it; a step that `takes` it has it as it is.
    """
    chain = chain_of(df)
    if chain is None:
        source, before = df, ()
    else:
        source, before = chain.source, chain.steps
        if chain.gives != takes:
            before = (*before, chain.rows)
    steps = (*before, step)
    out = source.mapInArrow(chained([*steps, *([rows] if rows else [])]), schema)
    out._chain = Chain(source, steps, gives, rows)
    return out
