"""Arithmetic on array columns and literal vectors, all in the JVM."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(vector: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; the shorter array counts as padded with nulls, so the result is then null."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, query: Sequence[float]) -> Column:
    """Cosine of an array column and a vector; 0 where either has no length."""
    length = math.sqrt(sum(float(x) * float(x) for x in query))
    if not length:
        return F.when(a.isNotNull(), F.lit(0.0))
    own = norm(a)
    return F.when(own == 0, F.lit(0.0)).otherwise(dot(a, literal(query)) / (own * F.lit(length)))


def normalised(a: Column) -> Column:
    """The vector at length 1; one without length stays."""
    return _once(a, lambda v: _once(norm(v), lambda own: F.when(own == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / own)))).cast("array<float>")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once a row, however often and in whatever lambda it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
