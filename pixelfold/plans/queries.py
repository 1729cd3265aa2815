"""The library's queries over the driver's tables."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..functions import color
from ..operators import clusters, dither, hextree, layout, quantize, rle
from ..sources import rasters
from ..sources.shipping import ship
from .columns import pairs

#: Colours of the tree's palette in the queries, and epochs of the container's history.
TREE, EPOCH = 64, 1000


def capabilities(spark: SparkSession) -> DataFrame:
    """The implementations of each operator, whether what they need is there, and the library's version."""

    def installed(*names: str) -> bool:
        return all(importlib.util.find_spec(n) is not None for n in names)

    functions = {r[0] for r in spark.sql("SHOW FUNCTIONS").collect()}
    native, arrow = {"listagg", "regexp_extract_all", "transform"} <= functions, installed("pyarrow", "numpy")
    pandas = arrow and installed("pandas")
    rows = [
        ("rle", "native", native), ("rle", "arrow", arrow), ("layout", "native", native), ("layout", "keyed state", pandas), ("hextree", "native", native),
        ("utc", "pandas", pandas), ("kmeans", "pandas", pandas), ("dither", "pandas", pandas),
    ]
    return spark.createDataFrame([(*r, __version__) for r in rows], "operator string, implementation string, available boolean, version string")


def _hex(df: DataFrame) -> DataFrame:
    return df.withColumn("data_hex", F.hex("data"))


def _shown(df: DataFrame) -> DataFrame:
    """As :func:`_hex`, with empty strings and 0 for what an image with an error lacks."""
    return _hex(df).fillna("", ["data_hex", "error"]).fillna(0, ["width", "height"])


def _dense(s: SparkSession, d: str) -> DataFrame:
    return rasters.pixels_to_bitmap(rasters.embedding_bitmap(s, d))


def _streams(s: SparkSession, d: str) -> DataFrame:
    return rle.encode(rasters.event_grid(s, d)).unionByName(rle.encode(rasters.embedding_bitmap(s, d)).withColumn("image_id", F.col("image_id") + 1_000_000))


def _mixed(s: SparkSession, d: str) -> DataFrame:
    """Dense images of which some break a rule: every fifth one lacks its last byte, every seventh is
    said to be four rows high."""
    lacks = F.expr("CASE WHEN image_id % 5 = 0 THEN substring(data, 1, octet_length(data) - 1) ELSE data END")
    return _dense(s, d).withColumn("data", lacks).withColumn("height", F.when(F.col("image_id") % 7 == 0, 4).otherwise(F.col("height")))


def _broken(s: SparkSession, d: str) -> DataFrame:
    """Streams of which some are broken: every fifth one has a ninth row of one pixel, every seventh a run
    that is cut off behind its rows, every eleventh only a row's end."""
    one = F.expr("CASE WHEN image_id % 11 = 0 THEN X'0000' WHEN image_id % 5 = 0 THEN concat(data, X'010000') WHEN image_id % 7 = 0 THEN concat(data, X'0083') ELSE data END")
    return _streams(s, d).withColumn("data", one)


def _whole(s: SparkSession, d: str, method: str, colours: int) -> tuple[DataFrame, DataFrame]:
    return quantize.quantize(rasters.rgba_dense(rasters.embedding_rgba(s, d)), method, colours, None)


def _layouts(s: SparkSession, d: str) -> DataFrame:
    """Layouts that have masks, if a user of that number has, and as many that have none."""
    ids = rasters.table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("layout_id"))
    return ids.union(ids.select(F.col("layout_id") - 1000))


def _screen(s: SparkSession, d: str) -> DataFrame:
    return layout.screen(rasters.event_masks(s, d).filter(layout.fits(*rasters.SCREEN)))


def _cuts(s: SparkSession, d: str) -> DataFrame:
    pixels = _screen(s, d)
    return layout.candidates(pixels, layout.extended(layout.containers(pixels), *rasters.SCREEN))


def _tree(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    hist = hextree.histogram(rasters.embedding_rgba(s, d))
    nodes = hextree.levels(hist)
    return hist, nodes, hextree.palette(nodes, TREE)


def _one_cluster(s: SparkSession, d: str) -> DataFrame:
    return rasters.lineitem_histogram(s, d).withColumn("cid", F.lit(0))


def _distance(s: SparkSession, d: str) -> DataFrame:
    """Of each pixel to the left neighbour, 0 at the edge."""
    from pyspark.sql import Window

    line = Window.partitionBy("image_id", "y").orderBy("x")
    p = rasters.embedding_rgba(s, d)
    left = {c: F.coalesce(F.lag(c).over(line), F.col(c)) for c in color.CHANNELS}
    return p.withColumn("distance", color.distance({c: F.col(c) for c in color.CHANNELS}, left))


def _quantized(s: SparkSession, d: str, kind: str, kernel: str | None) -> DataFrame:
    pixels = rasters.embedding_rgba(s, d)
    if kind == "hextree":
        hist, _, entries = _tree(s, d)
        pids = hextree.colour_index(hist, entries)
    else:
        pids = clusters.colour_index(hextree.histogram(pixels), 16)
        entries = clusters.palette(pids)
    if kernel:
        return dither.dither(pixels, pids, entries, quantize.LIMITS[kind], kernel)
    plain = pixels.select("image_id", "y", "x", *[color.normalized(c) for c in color.CHANNELS])
    return plain.join(pids, ["image_id", *color.CHANNELS])


PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "bitmap_to_pixels": lambda s, d: rasters.bitmap_to_pixels(_dense(s, d)),
    "pixels_to_bitmap": lambda s, d: _hex(_dense(s, d)),
    "rgba_pixels": lambda s, d: rasters.rgba_pixels(rasters.rgba_dense(rasters.embedding_rgba(s, d))),
    "rgba_normalize": lambda s, d: rasters.embedding_rgba(s, d).select("image_id", "y", "x", *[color.normalized(c) for c in color.CHANNELS]),
    "rle_validate_dims": lambda s, d: rasters.whole_text_dims(s, d).withColumn("valid", rle.valid_dims(F.col("width"), F.col("height"))),
    "rle_runs": lambda s, d: rle.runs(rasters.embedding_bitmap(s, d)),
    "rle_run_codes": lambda s, d: rle.run_codes(rle.runs(rasters.embedding_bitmap(s, d))),
    "rle_encode": lambda s, d: _hex(rle.encode(rasters.embedding_bitmap(s, d))),
    "rle_encode_events": lambda s, d: _hex(rle.encode(rasters.event_grid(s, d))),
    "rle_encode_text": lambda s, d: rle.encode_dense(rasters.text_bitmap(s, d), strict=False).withColumn("data_md5", F.md5(F.hex("data").cast("binary"))),
    "rle_encode_dense": lambda s, d: _shown(rle.encode_dense(_mixed(s, d))),
    "rle_encode_dense_arrow": lambda s, d: _shown(rle.encode_dense(_mixed(s, d), impl="arrow")),
    "rle_decode_dense": lambda s, d: _shown(rle.decode_dense(_broken(s, d))),
    "rle_decode_dense_arrow": lambda s, d: _shown(rle.decode_dense(_broken(s, d), impl="arrow")),
    "rle_size_ratio": lambda s, d: rle.size_ratio(rasters.embedding_bitmap(s, d)),
    "rle_row_budget": lambda s, d: rle.row_budget(rasters.embedding_bitmap(s, d)),
    "rle_tokenize": lambda s, d: rle.tokenize(_streams(s, d)),
    "rle_decode": lambda s, d: rle.decode(_streams(s, d)),
    "rle_row_widths": lambda s, d: rle.row_widths(_broken(s, d)),
    "rgba_histogram": lambda s, d: hextree.histogram(rasters.embedding_rgba(s, d)),
    "color_nibbles": lambda s, d: rasters.lineitem_histogram(s, d).select("image_id", *color.CHANNELS, *[color.nibble(i).alias(f"d{i}") for i in range(8)]),
    "color_distance": _distance,
    "palette_nearest": lambda s, d: hextree.nearest(rasters.lineitem_histogram(s, d), hextree.palette(hextree.levels(rasters.lineitem_histogram(s, d)), 16)),
    "layout_validate_masks": lambda s, d: layout.validate(rasters.event_masks(s, d), 48, 80),
    "layout_screen": _screen,
    "layout_changed": lambda s, d: layout.changed(rasters.event_masks(s, d)),
    "layout_container": lambda s, d: layout.containers(_screen(s, d)),
    "layout_raw_container": lambda s, d: layout.raw_containers(_layouts(s, d), _screen(s, d)).fillna(-1),
    "layout_container_history": lambda s, d: layout.container_history(rasters.event_masks(s, d), F.floor(F.col("seq") / EPOCH)),
    "layout_extended": lambda s, d: layout.extended(layout.containers(_screen(s, d)), *rasters.SCREEN),
    "layout_candidates": _cuts,
    "layout_best_split": lambda s, d: layout.best_split(_cuts(s, d)),
    "layout_find": lambda s, d: layout.find(_screen(s, d), *rasters.SCREEN),
    "hextree_levels": lambda s, d: _tree(s, d)[1],
    "hextree_level_counts": lambda s, d: hextree.level_counts(_tree(s, d)[1]),
    "hextree_fold": lambda s, d: hextree.fold(_tree(s, d)[1], TREE),
    "hextree_palette": lambda s, d: _tree(s, d)[2],
    "hextree_index": lambda s, d: hextree.colour_index(_tree(s, d)[0], _tree(s, d)[2]),
    "hextree_quantize": lambda s, d: _quantized(s, d, "hextree", None),
    "hextree_dither": lambda s, d: _quantized(s, d, "hextree", "atkinson"),
    "hextree_dither_jjn": lambda s, d: _quantized(s, d, "hextree", "jjn"),
    "hextree_dither_sierra": lambda s, d: _quantized(s, d, "hextree", "sierra"),
    "utc_cluster_stats": lambda s, d: clusters.cluster_stats(_one_cluster(s, d)),
    "utc_split_choice": lambda s, d: clusters.split_choice(clusters.cluster_stats(clusters.split_once(_one_cluster(s, d), 8)), 8),
    "utc_first_split": lambda s, d: clusters.split_once(_one_cluster(s, d), 8),
    "utc_palette_k8": lambda s, d: clusters.palette(clusters.colour_index(rasters.lineitem_histogram(s, d), 8)),
    "utc_index_k8": lambda s, d: clusters.colour_index(rasters.lineitem_histogram(s, d), 8),
    "utc_quantize": lambda s, d: _quantized(s, d, "utc", None),
    "utc_dither": lambda s, d: _quantized(s, d, "utc", "atkinson"),
    "hextree_quantize_bitmap": lambda s, d: _shown(_whole(s, d, "hextree", TREE)[0]),
    "hextree_quantize_palette": lambda s, d: _whole(s, d, "hextree", TREE)[1],
    "utc_quantize_bitmap": lambda s, d: _shown(_whole(s, d, "utc", 16)[0]),
    "utc_quantize_palette": lambda s, d: _whole(s, d, "utc", 16)[1],
    "kmeans_palette": lambda s, d: clusters.kmeans_palette(rasters.lineitem_histogram(s, d), 8),
    "capabilities": lambda s, d: capabilities(s),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def typed(name: str, plan: Callable) -> Callable:
        def query(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return plan(spark, folder).select(*[F.col(c).cast(t).alias(c) for c, t in pairs(name)])

        return query

    return {name: typed(name, plan) for name, plan in PLANS.items()}
