"""Numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int = 6) -> Column:
    """F.round(x, digits) of a double, bit for bit. That one goes by decimal text, which takes longer than what is rounded; here only
    values so near to a half, or so large, that a product could be off, and what is no number, go that way. x stands in it as few times as
    can be: Java leaves methods of more than 8,000 bytes uncompiled, and Spark makes one of all that a task does to a row."""
    scaled = x * float(10**digits)
    whole = F.floor(scaled + 0.5)
    plain = (F.abs(scaled) < 1e9) & (F.abs(F.abs(scaled - whole) - 0.5) > 1e-4)
    return F.when(plain, whole / float(10**digits)).otherwise(F.round(x, digits))  # of a whole number: no -0.0
