"""Sets of small ordinals (frames, viewpoints of a scan) as 64-bit words: name0, name1, ..., as many as the largest ordinal
needs, so that no ordinal is dropped."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from gridwise.functions.numeric import c

WORD = 64


def words(most: int | None) -> int:
    """Words for ordinals from 0 to most (null: none yet)."""
    return (most or 0) // WORD + 1


def names(name: str, n: int) -> list[str]:
    return [f"{name}{i}" for i in range(n)]


def columns(name: str, n: int, of: str = "") -> list[Column]:
    return [F.col(of + x) for x in names(name, n)]


def bit(ordinal, n: int) -> list[Column]:
    """The words of the set of one ordinal; none is set where it is null."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(c(ordinal), F.lit(WORD)).cast("int"))
    return [F.when(F.floor(c(ordinal) / WORD) == i, one).otherwise(F.lit(0).cast("long")) for i in range(n)]


def united(sets: Sequence[Column]) -> list[Column]:
    """Aggregates: the union over rows."""
    return [F.coalesce(F.bit_or(x), F.lit(0).cast("long")) for x in sets]


def both(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [x.bitwiseAND(y) for x, y in zip(a, b, strict=True)]


def less(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    """What a has and b has not."""
    return [x.bitwiseAND(F.bitwise_not(y)) for x, y in zip(a, b, strict=True)]


def size(a: Sequence[Column]) -> Column:
    return reduce(lambda x, y: x + y, (F.bit_count(x) for x in a))
