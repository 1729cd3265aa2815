"""Whole images to palettes: dense RGBA images in, bitmaps of palette entries and the palettes out.

Images are (image_id, width, height, data) with four bytes a pixel. The result is two tables:
(image_id, width, height, data, error), a byte a pixel, and (image_id, pid, r, g, b, a), the palette. An
image whose sides are not allowed or do not fit its data has neither, but an error. With ``kernel`` errors
are diffused (an image a task), without it each colour gets its own entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.color import CHANNELS
from ..sources.rasters import pixels_to_bitmap, rgba_pixels
from . import clusters, dither, hextree

#: The widest image of the tree and the pixels that an image of the clusters stays below;
#: the largest error of a channel that is diffused.
WIDEST, PIXELS = 8192, 4096 * 4096
LIMITS = {"hextree": 16.0, "utc": 14.0}


def problem(method: str) -> Column:
    """What keeps an image from being quantized; null if nothing does."""
    w, h, size = F.col("width"), F.col("height").cast("long"), F.octet_length("data")
    sides = F.coalesce((w >= 1) & (h >= 1), F.lit(False))
    allowed = (w <= WIDEST) if method == "hextree" else (w * h < PIXELS)
    fits = F.coalesce(size == 4 * w * h, F.lit(False))
    return F.when(~sides | ~F.coalesce(allowed, F.lit(False)), "sides not allowed").when(~fits, "width times height is not its size")


def quantize(images: DataFrame, method: str = "hextree", colours: int = 255, kernel: str | None = "atkinson") -> tuple[DataFrame, DataFrame]:
    """The bitmaps and the palettes."""
    if method not in LIMITS:
        raise ValueError(f"methods are {', '.join(LIMITS)}")
    (hextree if method == "hextree" else clusters).check_colours(colours)
    found = images.select(F.col("image_id").cast("long").alias("image_id"), "width", "height", "data", problem(method).alias("error"))
    pixels = rgba_pixels(found.filter("error IS NULL"))
    hist = hextree.histogram(pixels)
    if method == "hextree":
        entries = hextree.palette(hextree.levels(hist), colours)
        pids = hextree.colour_index(hist, entries)
    else:
        pids = clusters.colour_index(hist, colours)
        entries = clusters.palette(pids)
    placed = dither.dither(pixels, pids, entries, LIMITS[method], kernel) if kernel else hextree.index_by(pixels, pids)
    made = pixels_to_bitmap(placed.withColumnRenamed("pid", "v")).select(F.col("image_id").alias("_id"), F.col("data").alias("_data"))
    bitmaps = found.join(made, F.col("image_id") == F.col("_id"), "left").select("image_id", "width", "height", F.col("_data").alias("data"), "error")
    return bitmaps, entries.select("image_id", "pid", *CHANNELS)
