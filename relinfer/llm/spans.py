"""Places of regular expressions in a text, with built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from relinfer.functions.vector import let

SPAN = "struct<kind:int, start:bigint, end:bigint, value:string>"


# A fold that collects as it goes copies what it has for each element, so it never collects more than this.
CHUNK = 256


def scan(
    values: Column, begin: Column, advance: Callable[[Column, Column], Column],
    emit: Callable[[Column, Column], Column], element: str,
) -> Column:
    """emit(state, x) of every x of an array, where advance(state, x) is the state of the next one.

    Long arrays are cut into chunks: one fold carries the state from chunk to chunk, and each chunk is then
    collected on its own, so that the work grows with the array and not with its square.
    """
    empty = F.array().cast(f"array<{element}>")

    def collected(part: Column, state: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            out = F.array_append(acc["out"], emit(acc["state"], x))
            return F.struct(advance(acc["state"], x).alias("state"), out.alias("out"))

        return F.aggregate(part, F.struct(state.alias("state"), empty.alias("out")), step, lambda acc: acc["out"])

    def in_chunks(xs: Column) -> Column:
        last = F.floor((F.size(xs) - 1) / CHUNK).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(xs, c * CHUNK + 1, F.lit(CHUNK)))

        def carry(acc: Column, part: Column) -> Column:
            state = F.aggregate(part, acc["state"], advance)
            return F.struct(state.alias("state"), F.array_append(acc["starts"], acc["state"]).alias("starts"))

        def whole(parts: Column) -> Column:
            none = F.slice(F.array(begin), 1, 0)
            starts = F.aggregate(parts, F.struct(begin.alias("state"), none.alias("starts")), carry, lambda acc: acc["starts"])
            return F.flatten(F.zip_with(parts, starts, collected))

        return let(chunks, whole)

    return let(values, lambda xs: F.when(F.size(xs) <= CHUNK, collected(xs, begin)).otherwise(in_chunks(xs)))


def _ended(at: Column, x: Column) -> Column:
    return at + F.length(x["part"]) + F.length(x["whole"])


def find_spans(text: Column, pattern: Column, kind: Column, group: int = 0) -> Column:
    """array<struct<kind, start, end, value>>: leftmost non-overlapping matches in order.

    Offsets count code points from 0, end exclusive; value is the text of a group. The
    parts between the matches give their places: one scan adds the lengths up. Null text: null.
    """
    parts = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    value = whole if group == 0 else F.regexp_extract_all(text, pattern, F.lit(group))
    steps = F.arrays_zip(F.slice(parts, F.lit(1), F.size(whole)).alias("part"), whole.alias("whole"), value.alias("value"))

    def span(at: Column, x: Column) -> Column:
        start = at + F.length(x["part"])
        return F.struct(
            kind.cast("int").alias("kind"), start.alias("start"), _ended(at, x).alias("end"), x["value"].alias("value")
        )

    return scan(steps, F.lit(0).cast("bigint"), _ended, span, SPAN)


def by_place(spans: Column) -> Column:
    """Spans by start, then kind, then end."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
    return F.transform(
        F.array_sort(keyed),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")),
    )


def spell(spans: Column, names: list[str]) -> Column:
    """kind:start:end of each span, comma-joined; kinds are numbers into names."""
    listed = F.array(*map(F.lit, names))
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.element_at(listed, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")),
        ), ",",
    )


def of_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
