"""Vectors held as arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column, floor: float = 1e-8) -> Column:
    return F.greatest(F.sqrt(dot(a, a)), F.lit(floor))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def argmax(values: Column) -> Column:
    """0-based place of the first largest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once however often f uses it: lambdas have no common subexpressions."""
    return F.element_at(F.transform(F.array(value), f), 1)


def softmax(scores: Column) -> Column:
    ended = lambda s, top: F.struct(s.alias("s"), top.alias("top"))
    raised = let(let(scores, lambda s: ended(s, F.array_max(s))), lambda t: F.transform(t["s"], lambda x: F.exp(x - t["top"])))
    total = lambda r: F.aggregate(r, F.lit(0.0), lambda s, x: s + x)
    return let(let(raised, lambda r: ended(r, total(r))), lambda t: F.transform(t["s"], lambda x: x / t["top"]))
