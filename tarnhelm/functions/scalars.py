"""Scalar helpers whose semantics deserve a name; everything else is ``pyspark.sql.functions``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def if_else(cond: Column, yes: Column, no: Column) -> Column:
    """A NULL condition takes the ELSE branch, as in SQL."""
    return F.when(cond, yes).otherwise(no)


def divide(a: Column, b: Column) -> Column:
    """NULL on division by zero (plain ``/`` raises under ANSI)."""
    return F.try_divide(a, b)


def substring(s: Column, pos: int, length: int) -> Column:
    """By characters, 1-based; position 0 means 1; negative counts from the end."""
    return F.substring(s, pos or 1, length)


def contains(s: Column, part: str) -> Column:
    return s.contains(part)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
