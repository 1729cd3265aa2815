"""Rasters as tables: converters between dense and long form, and rasters made from other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def byte_at(data, i):
    """The unsigned byte of a binary column at a place from 0."""
    return F.conv(F.hex(F.substring(data, i + 1, F.lit(1))), 16, 10).cast("int")


def bitmap_to_pixels(bitmaps: DataFrame) -> DataFrame:
    """Dense (image_id, width, height, data) to a row (image_id, y, x, v) for each pixel."""
    cells = bitmaps.select("image_id", "width", "data", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("i"))
    return cells.select("image_id", F.expr("i div width").cast("int").alias("y"), (F.col("i") % F.col("width")).alias("x"), byte_at(F.col("data"), F.col("i")).alias("v"))


def pixels_to_bitmap(pixels: DataFrame) -> DataFrame:
    """Long form to dense: each row's bytes are put together first, then the rows."""
    code = F.expr("unhex(lpad(hex(v), 2, '0'))")
    rows = pixels.withColumn("code", code).groupBy("image_id", "y").agg(F.expr("listagg(code) WITHIN GROUP (ORDER BY x)").alias("line"), (F.max("x") + 1).alias("width"))
    return rows.groupBy("image_id").agg(F.max("width").alias("width"), (F.max("y") + 1).alias("height"), F.expr("listagg(line) WITHIN GROUP (ORDER BY y)").alias("data"))


def rgba_pixels(images: DataFrame) -> DataFrame:
    """Dense RGBA (image_id, width, height, data of four bytes a pixel) to (image_id, y, x, r, g, b, a)."""
    cells = images.select("image_id", "width", "data", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("i"))
    channel = [byte_at(F.col("data"), F.col("i") * 4 + k).alias(c) for k, c in enumerate("rgba")]
    return cells.select("image_id", F.expr("i div width").cast("int").alias("y"), (F.col("i") % F.col("width")).alias("x"), *channel)


def rgba_dense(pixels: DataFrame) -> DataFrame:
    """RGBA pixels to dense images."""
    code = F.expr("unhex(concat(lpad(hex(r), 2, '0'), lpad(hex(g), 2, '0'), lpad(hex(b), 2, '0'), lpad(hex(a), 2, '0')))")
    rows = pixels.withColumn("code", code).groupBy("image_id", "y").agg(F.expr("listagg(code) WITHIN GROUP (ORDER BY x)").alias("line"), (F.max("x") + 1).alias("width"))
    return rows.groupBy("image_id").agg(F.max("width").alias("width"), (F.max("y") + 1).alias("height"), F.expr("listagg(line) WITHIN GROUP (ORDER BY y)").alias("data"))


def event_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Images of 24 x 16 pixels, one a day of the year: hours across, users down, colours by event."""
    e = table(spark, folder, "events")
    colour = (F.ascii(F.col("event_type")) % 4 + 1).cast("int")
    seen = e.groupBy((F.dayofyear("ts") - 1).cast("long").alias("image_id"), (F.col("user_id") % 16).cast("int").alias("y"), F.hour("ts").alias("x")).agg(F.max(colour).alias("v"))
    # At most 366 images; each row is spread over its 24 pixels without a join.
    rows = seen.groupBy("image_id", "y").agg(F.map_from_entries(F.collect_list(F.struct("x", "v"))).alias("at"))
    lines = rows.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("y", "at"))).alias("lines"))
    cells = lines.select("image_id", "lines", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("y"))
    cells = cells.select("image_id", "y", F.try_element_at("lines", F.col("y")).alias("at"), F.explode(F.sequence(F.lit(0), F.lit(23))).alias("x"))
    return cells.select("image_id", "y", "x", F.coalesce(F.try_element_at("at", F.col("x")), F.lit(0)).alias("v"))


def embedding_bitmap(spark: SparkSession, folder: str) -> DataFrame:
    """An 8 x 8 image of each vector of 64 numbers."""
    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "e"))
    value = F.least(F.greatest(F.floor((F.col("e").cast("double") + 0.25) * 8), F.lit(0)), F.lit(15)).cast("int")
    return e.select("image_id", F.expr("i div 8").cast("int").alias("y"), (F.col("i") % 8).alias("x"), value.alias("v"))


def embedding_rgba(spark: SparkSession, folder: str) -> DataFrame:
    """An RGBA image for each label, 16 pixels wide, with a row for each vector by its id."""
    from pyspark.sql import Window

    e = table(spark, folder, "embeddings")
    rows = e.select(F.col("label").cast("long").alias("image_id"), "vec_id", "embedding", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("y"))
    cells = rows.select("image_id", "vec_id", "y", "embedding", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("x"))

    def level(k):
        return F.floor((F.get("embedding", F.col("x") * 4 + k).cast("double") + 1) * 127.5).cast("int")

    alpha = F.when((F.col("vec_id") + F.col("x")) % 11 == 0, 0).otherwise(level(3))
    return cells.select("image_id", "y", "x", level(0).alias("r"), level(1).alias("g"), level(2).alias("b"), alpha.cast("int").alias("a"))


def whole_texts(spark: SparkSession, folder: str, width: int = 64) -> DataFrame:
    """(image_id, text, n, rows) of every document; a null text is an empty one, a part of a row counts."""
    d = table(spark, folder, "documents").select(F.col("doc_id").alias("image_id"), F.coalesce("text", F.lit("")).alias("text"))
    return d.withColumn("n", F.char_length("text")).withColumn("rows", F.expr(f"(n + {width - 1}) div {width}").cast("int"))


def text_bitmap(spark: SparkSession, folder: str, width: int = 64, least: int = 8) -> DataFrame:
    """Dense images of every document to its last character, ``width`` code points modulo 256 a row: the
    last row, and texts under ``least`` rows, are filled up with 0.

    Texts within Latin-1 are their bytes there; of others every fourth byte of UTF-32 is taken. What is done
    with a character costs far more than moving it, so a table of few splits is dealt out."""
    d = whole_texts(spark, folder, width)
    tasks = spark.sparkContext.defaultParallelism
    d = d.repartition(tasks) if d.rdd.getNumPartitions() < tasks else d
    rows = F.greatest(F.col("rows"), F.lit(least))
    low = F.unhex(F.regexp_replace(F.hex(F.encode("text", "UTF-32")), "......(..)", "$1"))
    codes = F.when(F.col("text").rlike(r"[^\x00-\xFF]"), low).otherwise(F.encode("text", "ISO-8859-1"))
    return d.select("image_id", F.lit(width).alias("width"), rows.alias("height"), F.rpad(codes, rows * width, F.lit(b"\0")).alias("data"))


def whole_text_dims(spark: SparkSession, folder: str, width: int = 64) -> DataFrame:
    """(image_id, width, height) of every document's text, with no rows added to short ones."""
    return whole_texts(spark, folder, width).select("image_id", F.lit(width).alias("width"), F.col("rows").alias("height"))


def lineitem_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """A colour histogram for each return flag."""
    x = table(spark, folder, "lineitem")
    image = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).cast("long")
    colours = x.select(
        image.alias("image_id"), (F.col("l_quantity") * 5).cast("int").alias("r"), F.rint(F.col("l_discount") * 2500).cast("int").alias("g"),
        F.rint(F.col("l_tax") * 3000).cast("int").alias("b"), F.when(F.col("l_linestatus") == "F", 255).otherwise(128).alias("a"),
    )
    return colours.groupBy("image_id", "r", "g", "b", "a").agg(F.count(F.lit(1)).alias("n"))


SCREEN = (128, 96)


def event_masks(spark: SparkSession, folder: str) -> DataFrame:
    """Full masks on a screen of 128 x 96, one an event, a layout for each user."""
    e = table(spark, folder, "events")
    i = F.col("event_id")
    masks = e.select(
        F.col("user_id").alias("layout_id"), i.alias("seq"), (8 + (i * 7) % 40).cast("int").alias("xp"),
        (F.when(F.col("event_type").isin("click", "view"), 4).otherwise(70) + i % 8).cast("int").alias("yp"),
        (4 + i % 5).cast("int").alias("w"), (2 + i % 3).cast("int").alias("h"),
    )
    return masks.withColumn("data", F.unhex(F.repeat(F.lit("01"), F.col("w") * F.col("h"))))
