"""Column expressions of index arithmetic; all of them stay inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def modes(n: int) -> list[str]:
    return [f"i{m}" for m in range(n)]


def block_modes(n: int) -> list[str]:
    return [f"b{m}" for m in range(n)]


def div(a: Column, b: int) -> Column:
    """Integer division of non-negative whole numbers."""
    return F.call_function("div", a.cast("long"), F.lit(b)) if b != 1 else a.cast("long")


def linear(columns: Sequence[str | Column], extents: Sequence[int]) -> Column:
    """Sum of index times stride, the first column fastest."""
    terms, stride = [], 1
    for c, e in zip(columns, extents, strict=True):
        terms.append((F.col(c) if isinstance(c, str) else c).cast("long") * F.lit(stride))
        stride *= e
    return reduce(lambda a, b: a + b, terms, F.lit(0).cast("long"))


def sub_indices(number: Column, extents: Sequence[int]) -> list[Column]:
    """The indices of which linear() is the number."""
    out, stride = [], 1
    for e in extents:
        out.append(F.pmod(div(number, stride), F.lit(e)).cast("long"))
        stride *= e
    return out


def squared_distance(a: Column, b: Column) -> Column:
    """Sum of squared differences of two arrays of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    """Aggregate: root of the sum of squares."""
    return F.sqrt(F.sum(v * v))
