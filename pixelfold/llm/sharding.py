"""Rendezvous hashing of record keys over weighted shards, in DataFrame functions only.

Every shard draws a number for every key from an MD5 digest; a key goes to the shard with the
largest ``weight / -ln(u)``. A new shard draws its own numbers and leaves those of the others as
they are, so that it takes rows only into itself, and takes its share by weight.

Defined results: a null key is a key of its own (equal for all null keys); a null text has size 8
and checksum 0; a text of any length counts whole; repeated rows get a slot each; an empty table gives no
rows; other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sub-buckets of a shard. Slots are counted in (shard, bucket) first, so no task holds a shard.
BUCKETS = 1024
#: Copies of a row that are numbered at a time.
COPIES = 10_000
#: Hexadecimal digits of a draw: 52 bits, exact in a double.
DIGITS = 13


def digest(key: Column, part: int | str) -> Column:
    return F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{part}")).cast("binary"))


def number(hexadecimal: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(hexadecimal, start, digits), 16, 10).cast("long")


def scores(key: Column, weights: Sequence[float]) -> list[Column]:
    """Score of each shard; one digest serves two shards."""
    out = []
    for s, weight in enumerate(weights):
        if weight <= 0:
            raise ValueError("weights are positive")
        drawn = number(digest(key, s // 2), 1 + DIGITS * (s % 2), DIGITS)
        out.append(F.lit(float(weight)) / -F.ln((drawn + 0.5) / float(16**DIGITS)))
    return out


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """Struct (score, shard) of the winner; the smaller shard wins a tie."""
    best = F.array_max(F.array(*[F.struct(x.alias("score"), F.lit(-s).alias("minus")) for s, x in enumerate(scores(key, weights))]))
    return F.struct(best["score"].alias("score"), (-best["minus"]).alias("shard"))


def shard(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text", added_weight: float | None = None) -> DataFrame:
    """Puts each row into a shard and numbers the rows of a shard from 0 without gaps.

    Columns: the key, size, text_crc32, shard, grown_shard (the shard once a further one of
    ``added_weight`` is there, by default of the mean weight) and slot.
    """
    weights = list(weights)
    more = sum(weights) / len(weights) if added_weight is None else added_weight
    body = F.col(text).cast("binary")
    sized = docs.select(
        F.col(key).alias("_key"),
        (F.coalesce(F.octet_length(body), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(body), F.lit(0)).cast("long").alias("text_crc32"),
    )
    # Draws come before any shuffle, where rows are spread as they are read.
    placed = (
        sized.withColumn("_best", shard_of(F.col("_key"), weights))
        .withColumn("_new", scores(F.col("_key"), [*weights, more])[-1])
        .select(
            "_key", "size", "text_crc32",
            F.col("_best.shard").cast("int").alias("shard"),
            F.when(F.col("_new") > F.col("_best.score"), len(weights)).otherwise(F.col("_best.shard")).cast("int").alias("grown_shard"),
            F.pmod(number(digest(F.col("_key"), "slot"), 1, 7) + F.col("text_crc32"), F.lit(BUCKETS)).alias("_bucket"),
        )
    )
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    # At most len(weights) * BUCKETS rows, whatever the input.
    starts = (
        placed.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
        .select("shard", "_bucket", F.coalesce(F.sum("_rows").over(before.partitionBy("shard").orderBy("_bucket")), F.lit(0)).alias("_start"))
    )
    # Equal rows are counted before a shuffle needs them together.
    placed = placed.groupBy(*placed.columns).agg(F.count(F.lit(1)).alias("_n"))
    within = before.partitionBy("shard", "_bucket").orderBy("_key", "size", "text_crc32")
    return (
        placed.withColumn("_within", F.coalesce(F.sum("_n").over(within), F.lit(0)))
        .join(F.broadcast(starts), ["shard", "_bucket"])
        .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(COPIES).cast("long"))).alias("_first"))
        .select("*", F.explode(F.sequence(F.col("_first"), F.least(F.col("_first") + (COPIES - 1), F.col("_n") - 1))).alias("_copy"))
        .select(F.col("_key").alias(key), "size", "text_crc32", "shard", "grown_shard", (F.col("_start") + F.col("_within") + F.col("_copy")).alias("slot"))
    )
