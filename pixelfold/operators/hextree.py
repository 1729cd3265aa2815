"""Palette quantization by folding a tree of bit planes.

A colour's upper d + 1 bits a channel are its node at depth d. Nodes fold into their parents, deepest
and rarest first, until at most K leaves are left. Folding whole depths leaves as many leaves as the
depth has nodes, so only one depth, the deepest with at most K nodes, is folded in part; within it a
node folds while the children still unfolded exceed K. That is a window, not a walk. Ties go by prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import CHANNELS, normalized, rounded

PREFIX = [f"p{c}" for c in CHANNELS]
DEPTHS = 8


def check_colours(colours: int) -> None:
    if not 16 <= colours <= 256:
        raise ValueError("16 to 256 colours")


def histogram(pixels: DataFrame) -> DataFrame:
    """(image_id, r, g, b, a, n): the distinct colours, transparent ones as one."""
    return pixels.select("image_id", *[normalized(c) for c in CHANNELS]).groupBy("image_id", *CHANNELS).agg(F.count(F.lit(1)).alias("n"))


def _shifted(c: str) -> Column:
    return F.expr(f"shiftright({c}, 7 - level)").alias(f"p{c}")


def levels(hist: DataFrame) -> DataFrame:
    """(image_id, level, prefix, n, nchild, weighted channel sums) of every node."""
    spread = hist.select("*", F.explode(F.sequence(F.lit(0), F.lit(DEPTHS - 1))).alias("level"))
    low = F.concat(*[F.expr(f"shiftright({c}, greatest(6 - level, 0)) & 1").cast("string") for c in CHANNELS])
    nodes = spread.select("image_id", "level", *[_shifted(c) for c in CHANNELS], "n", *[(F.col(c) * F.col("n")).alias(f"s{c}") for c in CHANNELS], low.alias("child"))
    return nodes.groupBy("image_id", "level", *PREFIX).agg(F.sum("n").alias("n"), F.size(F.collect_set("child")).alias("nchild"), *[F.sum(f"s{c}").alias(f"s{c}") for c in CHANNELS])


def level_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("image_id", "level").agg(F.count(F.lit(1)).alias("n_nodes"))


def fold(nodes: DataFrame, colours: int) -> DataFrame:
    """The nodes of the split depth with what is left before each, and whether it folds.

    Only images with more than ``colours`` colours have one. At most ``colours`` rows an image.
    """
    check_colours(colours)
    counts = level_counts(nodes)
    split = counts.groupBy("image_id").agg(
        F.max(F.when(F.col("n_nodes") <= colours, F.col("level"))).alias("level"), F.max_by("n_nodes", "level").alias("n_colours"),
        F.map_from_entries(F.collect_list(F.struct("level", "n_nodes"))).alias("sizes"),
    ).filter(F.col("n_colours") > colours).select("image_id", "level", F.col("sizes")[F.col("level") + 1].alias("below"))
    order = Window.partitionBy("image_id").orderBy("n", *PREFIX)
    gone = F.coalesce(F.sum(F.col("nchild") - 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return nodes.join(split, ["image_id", "level"]).withColumn("left", F.col("below") - gone).withColumn("folds", F.col("left") > colours)


def palette(nodes: DataFrame, colours: int) -> DataFrame:
    """(image_id, pid, level, prefix, r, g, b, a, n): the leaves in the order of their ids."""
    folded = fold(nodes, colours)
    parts = folded.select("image_id", F.col("level").alias("split"), *[F.col(p).alias(f"_{p}") for p in PREFIX], "folds")
    depth = parts.select("image_id", "split").distinct()
    placed = nodes.join(depth, "image_id", "left")
    flat = placed.filter(F.col("split").isNull() & (F.col("level") == DEPTHS - 1)).drop("split")
    lower = placed.filter(F.col("level") == F.col("split") + 1)
    own = [F.shiftright(p, 1) == F.col(f"_{p}") for p in PREFIX]
    lower = lower.join(parts.filter(~F.col("folds")).drop("split").withColumnRenamed("image_id", "_image"), (F.col("image_id") == F.col("_image")) & own[0] & own[1] & own[2] & own[3], "left_semi").drop("split")
    upper = folded.filter("folds").select(*flat.columns)
    leaves = flat.unionByName(lower).unionByName(upper)
    mean = {c: rounded(F.col(f"s{c}") / F.col("n")) for c in CHANNELS}
    leaves = leaves.withColumns({c: mean[c] for c in CHANNELS})
    leaves = leaves.withColumns({c: F.when(F.col("a") == 0, 0).otherwise(F.col(c)) for c in "rgb"})
    pid = F.row_number().over(Window.partitionBy("image_id").orderBy(F.col("level").desc(), "n", *PREFIX)) - 1
    return leaves.select("image_id", pid.alias("pid"), "level", *PREFIX, *CHANNELS, "n")


def colour_index(hist: DataFrame, leaves: DataFrame) -> DataFrame:
    """(image_id, r, g, b, a, pid): the leaf above each colour, by equal prefixes at its depth."""
    depths = leaves.select("image_id", "level").distinct()
    spread = hist.join(depths, "image_id").select("image_id", *CHANNELS, "level", *[_shifted(c) for c in CHANNELS])
    return spread.join(leaves.select("image_id", "level", *PREFIX, "pid"), ["image_id", "level", *PREFIX]).select("image_id", *CHANNELS, "pid")


def index_by(pixels: DataFrame, pids: DataFrame) -> DataFrame:
    """(image_id, y, x, pid) without dithering, from the entry of each colour."""
    plain = pixels.select("image_id", "y", "x", *[normalized(c) for c in CHANNELS])
    return plain.join(pids.select("image_id", *CHANNELS, "pid"), ["image_id", *CHANNELS]).select("image_id", "y", "x", "pid")


def nearest(colours: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds the pid of the nearest palette entry of the image, the lowest of equally near ones.

    A palette has at most 256 entries an image.
    """
    from ..functions.color import distance

    other = entries.select("image_id", "pid", *[F.col(c).alias(f"_{c}") for c in CHANNELS])
    far = distance({c: F.col(c) for c in CHANNELS}, {c: F.col(f"_{c}") for c in CHANNELS})
    pairs = colours.select("image_id", *CHANNELS).join(other, "image_id").withColumn("distance", far)
    return pairs.groupBy("image_id", *CHANNELS).agg(F.min(F.struct("distance", "pid")).alias("m")).select("image_id", *CHANNELS, "m.pid", "m.distance")
