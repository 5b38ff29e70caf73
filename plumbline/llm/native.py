"""Column helpers for operators that stay on DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.values import let

__all__ = ["BROADCAST_ROWS", "let", "longs", "small_side"]

#: Rows of a few numbers or short strings that are broadcast at most, counted first; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def longs(values: list[int]) -> Column:
    """An array<bigint> literal; the number of values must be bounded by the caller."""
    return F.from_json(F.lit("[" + ",".join(map(str, values)) + "]"), "array<bigint>")


def small_side(df: DataFrame, most: int | None = None) -> DataFrame:
    """df with a broadcast hint if a count proves it small, else as it is. df should be cut(), as it is computed twice."""
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if most is None else most) else df
