"""Column functions on vectors (`array<double>`); all of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column | str, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and hand it to `body` as a bound variable.

    Without the binding the optimizer copies a computed value into the lambda
    that uses it and evaluates it again for every element.
    """
    return F.transform(F.array(col(value)), body)[0]


def lets(values: Sequence[Column | str], body: Callable[..., Column], *bound: Column) -> Column:
    """`let` for several values."""
    if not values:
        return body(*bound)
    return let(values[0], lambda v: lets(values[1:], body, *bound, v))


def vec_lit(values: Sequence[float]) -> Column:
    """A constant vector."""
    return F.lit(np.asarray(values, dtype=np.float64))


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product, summed in index order."""
    return F.aggregate(
        F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v
    )


def sum_sq(a: Column | str) -> Column:
    """Sum of squares."""
    return F.aggregate(col(a), F.lit(0.0), lambda acc, v: acc + v * v)


def _limited_exp(v: Column, clamp: float) -> Column:
    return F.exp(F.greatest(F.least(v, F.lit(float(clamp))), F.lit(-float(clamp))))


def clamped_exp(v: Column | str, clamp: float = 50.0) -> Column:
    """exp of the value limited to [-clamp, clamp]; null stays null."""
    return F.when(col(v).isNotNull(), _limited_exp(col(v), clamp))


def uniform(seed: int, *keys: Column | str) -> Column:
    """Uniform draw from {1e-6, ..., 0.999999}, a pure function of seed and keys."""
    text = F.concat_ws("|", F.lit(int(seed)), *[col(k).cast("string") for k in keys])
    number = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint")
    return (number % 999999 + 1) / F.lit(1000000.0)


def gumbel(u: Column) -> Column:
    return -F.ln(-F.ln(u))


def scale_vec(x: Column | str, s: Column | str, gain: Column | str) -> Column:
    """x_i * s * gain_i."""
    return lets([x, s, gain], lambda xv, sv, gv: F.zip_with(xv, gv, lambda a, g: a * sv * g))


def rms_norm_vec(x: Column | str, gain: Column | str, eps: float = 1e-5) -> Column:
    """x_i * gain_i / sqrt(mean(x^2) + eps)."""
    return let(
        x,
        lambda xv: lets(
            [F.lit(1.0) / F.sqrt(sum_sq(xv) / F.size(xv) + F.lit(eps)), gain],
            lambda s, gv: F.zip_with(xv, gv, lambda a, g: a * s * g),
        ),
    )


def add_vec(x: Column | str, delta: Column | str) -> Column:
    """x_i + delta_i, where a missing delta (element or vector) counts as zero."""
    x, delta = col(x), col(delta)
    summed = F.zip_with(x, delta, lambda a, d: a + F.coalesce(d, F.lit(0.0)))
    return F.coalesce(summed, x)


def swiglu_vec(gate: Column | str, up: Column | str, clamp: float = 50.0) -> Column:
    """silu(gate_i) * up_i with silu(g) = g / (1 + exp(-g))."""
    return F.zip_with(
        col(gate), col(up), lambda g, u: g / (F.lit(1.0) + _limited_exp(-g, clamp)) * u
    )


def softmax_vec(x: Column | str, clamp: float = 50.0) -> Column:
    """Softmax of a vector: exponents relative to the maximum, limited to +-clamp."""
    return let(
        x,
        lambda xv: let(
            let(F.array_max(xv), lambda m: F.transform(xv, lambda v: clamped_exp(v - m, clamp))),
            lambda ev: let(
                F.aggregate(ev, F.lit(0.0), lambda acc, e: acc + F.coalesce(e, F.lit(0.0))),
                lambda total: F.transform(ev, lambda e: e / total),
            ),
        ),
    )


def rope_frequencies(head_dim: int, theta: float) -> list[float]:
    half = head_dim // 2
    return [theta ** (-(d / half)) for d in range(half)]


def _tiled(head: Column, heads: Column) -> Column:
    """The same vector for every head."""
    return F.flatten(F.array_repeat(head, heads))


def rope_vec(
    vec: Column | str, pos: Column | str, head_dim: int, theta: float = 100000.0
) -> Column:
    """Rotary encoding, half-split form, of one head or of concatenated heads.

    Component d < head_dim/2 pairs with d + head_dim/2; both turn by the angle
    pos * theta^(-(d mod half)/half).
    """
    half = head_dim // 2
    freq = vec_lit(rope_frequencies(head_dim, theta))

    def rotate(v, c, s):
        heads = (F.size(v) / head_dim).cast("int")

        def swapped(h):
            first = F.slice(v, h * head_dim + 1, F.lit(half))
            return F.concat(F.slice(v, h * head_dim + half + 1, F.lit(half)), first)

        partner = F.flatten(F.transform(F.sequence(F.lit(0), heads - 1), swapped))
        signed = F.concat(F.transform(s, lambda t: -t), s)
        straight = F.zip_with(v, _tiled(F.concat(c, c), heads), lambda a, b: a * b)
        crossed = F.zip_with(partner, _tiled(signed, heads), lambda a, b: a * b)
        return F.zip_with(straight, crossed, lambda a, b: a + b)

    return let(
        col(pos).cast("double"),
        lambda p: lets(
            [
                vec,
                F.transform(freq, lambda f: F.cos(p * f)),
                F.transform(freq, lambda f: F.sin(p * f)),
            ],
            rotate,
        ),
    )


def head_slices(vec: Column | str, head_dim: int) -> Column:
    """Cut a vector of concatenated heads into one vector per head."""
    vec = col(vec)
    heads = (F.size(vec) / head_dim).cast("int")
    return F.transform(
        F.sequence(F.lit(0), heads - 1), lambda h: F.slice(vec, h * head_dim + 1, F.lit(head_dim))
    )
