"""Colour expressions on integer channel columns from 0 to 255."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHANNELS = ("r", "g", "b", "a")


def normalized(c: str) -> Column:
    """A channel with the colour of transparent pixels gone."""
    return F.when(F.col("a") == 0, 0).otherwise(F.col(c)).cast("int").alias(c)


def rounded(x: Column) -> Column:
    """To the nearest integer, halves to even, within a byte."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.rint(x))).cast("int")


def distance(one: dict[str, Column], other: dict[str, Column]) -> Column:
    """Squared distance, alpha three times."""
    d = {c: one[c] - other[c] for c in CHANNELS}
    return d["r"] * d["r"] + d["g"] * d["g"] + d["b"] * d["b"] + 3 * d["a"] * d["a"]


def nibble(depth: int) -> Column:
    """The four channels' bits at a depth from 0 (highest) as one number; 0 for transparent colours."""
    bit = [F.shiftright(F.col(c), 7 - depth).bitwiseAND(1) for c in CHANNELS]
    packed = bit[0] + bit[1] * 2 + bit[2] * 4 + bit[3] * 8
    return F.when(F.col("a") == 0, 0).otherwise(packed).cast("int")
