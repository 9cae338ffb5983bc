"""Numeric semantics that every operator shares, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def finite(x) -> Column:
    """Neither null, NaN nor infinite."""
    x = c(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def round_half_up(x) -> Column:
    """Nearest integer, halves towards plus infinity."""
    return F.floor(c(x) + 0.5)


def clamp(x, low=0.0, high=1.0) -> Column:
    return F.least(F.greatest(c(x), F.lit(low)), F.lit(high))


def cell(x, size: float) -> Column:
    """Grid cell of a coordinate; floor, so that negative coordinates keep their own cells."""
    return F.floor(c(x) / size)


def cells(size: float, columns=("x", "y", "z"), names=("cx", "cy", "cz")) -> list[Column]:
    return [cell(a, size).alias(n) for a, n in zip(columns, names, strict=True)]


# Four definitions of a quantile; none is interchangeable with another.


def quantile_nearest(x, f: float) -> Column:
    """A: nearest rank, sorted[ceil(n*f) - 1]."""
    return F.expr(f"percentile_disc({f}) WITHIN GROUP (ORDER BY {x})")


def quantile_floor(x, f: float) -> Column:
    """B: sorted[floor((n-1)*f)]; values of a group are bounded (a frame, a neighbourhood, a history)."""
    values = F.sort_array(F.collect_list(c(x)))
    return F.get(values, F.floor((F.size(values) - 1) * F.lit(f)).cast("int"))


def quantile_linear(x, f: float) -> Column:
    """C: linear interpolation between ranks."""
    return F.expr(f"percentile({x}, {f})")


def quantile_index(x, f: float) -> Column:
    """D: sorted[floor(n*f)]; as B, for bounded groups."""
    values = F.sort_array(F.collect_list(c(x)))
    return F.get(values, F.floor(F.size(values) * F.lit(f)).cast("int"))
