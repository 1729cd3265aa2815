"""Run-length codec for indexed bitmaps.

Runs stay within a row. A run of L pixels of colour c is written, with hexadecimal digits, as::

    c = 0, L < 64    00 L              c > 0, L < 3     c, or c c
    c = 0, L >= 64   00 4h ll          c > 0, L < 64    00 (80 + L) c
    end of row       00 00             c > 0, L >= 64   00 Ch ll c

where h ll is L in 14 bits; a longer run is written as several. Colours outside 0 to 255 are an error.

Two implementations give the same bytes: ``native``, of DataFrame functions, a row an image and without
a shuffle, and ``arrow``, a scan in Python over Arrow batches. Long form (a row a pixel) goes through
windows. With ``strict`` an image whose sides the format forbids has no data but an
error; without it every width and height of one pixel or more is coded.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sides that the strict format allows, and the longest run that 14 bits say.
STRICT, WIDEST = (8, 4096), 16383
IMPLEMENTATIONS = ("native", "arrow")


def hex_byte(x: Column) -> Column:
    return F.lpad(F.hex(x), 2, "0")


def valid_dims(width: Column, height: Column, strict: bool = True) -> Column:
    if strict:
        return width.between(*STRICT) & height.between(*STRICT)
    return (width >= 1) & (height >= 1)


def runs(pixels: DataFrame) -> DataFrame:
    """(image_id, y, run_idx, x_start, len, v) for each longest run of equal pixels.

    One exchange, by image: the row windows here and the image's assembly later can share it.
    """
    line = Window.partitionBy("image_id", "y").orderBy("x")
    new = F.when(F.lag("v").over(line) == F.col("v"), 0).otherwise(1)
    marked = pixels.repartition("image_id").withColumn("new", new)
    marked = marked.withColumn("run_idx", (F.sum("new").over(line) - 1).cast("int"))
    return marked.groupBy("image_id", "y", "run_idx").agg(F.min("x").alias("x_start"), F.count(F.lit(1)).cast("int").alias("len"), F.min("v").alias("v"))


def _code(length: Column, v: Column) -> Column:
    long = F.concat(hex_byte(F.shiftright(length, 8).bitwiseOR(F.when(v == 0, 0x40).otherwise(0xC0))), hex_byte(length.bitwiseAND(255)))
    zero = F.when(length < 64, F.concat(F.lit("00"), hex_byte(length))).otherwise(F.concat(F.lit("00"), long))
    some = (
        F.when(length <= 2, F.repeat(hex_byte(v), length))
        .when(length < 64, F.concat(F.lit("00"), hex_byte(length + 0x80), hex_byte(v)))
        .otherwise(F.concat(F.lit("00"), long, hex_byte(v)))
    )
    return F.when(v == 0, zero).otherwise(some)


def code(length: Column, v: Column) -> Column:
    """A run's bytes in hexadecimal."""
    full, rest = (length / WIDEST).cast("int"), (length % WIDEST).cast("int")
    many = F.concat(F.repeat(_code(F.lit(WIDEST), v), full), F.when(rest > 0, _code(rest, v)).otherwise(""))
    checked = F.when(length <= WIDEST, _code(length, v)).otherwise(many)
    return F.when(v.between(0, 255), checked).otherwise(F.raise_error(F.concat(F.lit("colours are from 0 to 255, not "), v.cast("string"))).cast("string"))


def run_codes(found: DataFrame) -> DataFrame:
    return found.withColumn("code", code(F.col("len"), F.col("v")))


def encode(pixels: DataFrame) -> DataFrame:
    """(image_id, width, height, data BINARY): rows are put together first, then images of rows."""
    coded = run_codes(runs(pixels))
    rows = coded.groupBy("image_id", "y").agg(F.expr("listagg(code, '') WITHIN GROUP (ORDER BY run_idx)").alias("line"), F.sum("len").cast("int").alias("width"))
    whole = F.expr("listagg(concat(line, '0000'), '') WITHIN GROUP (ORDER BY y)")
    return rows.groupBy("image_id").agg(F.max("width").alias("width"), F.count(F.lit(1)).cast("int").alias("height"), F.unhex(whole).alias("data"))


def row_budget(pixels: DataFrame) -> DataFrame:
    """(image_id, y, n_bytes, width, fits): whether a row's code is no longer than the row."""
    coded = run_codes(runs(pixels))
    rows = coded.groupBy("image_id", "y").agg((F.sum(F.length("code")) / 2).cast("long").alias("n_bytes"), F.sum("len").alias("width"))
    return rows.withColumn("fits", F.col("n_bytes") <= F.col("width"))


def size_ratio(pixels: DataFrame) -> DataFrame:
    """(image_id, n_pixels, n_bytes) without putting any bytes together."""
    rows = row_budget(pixels)
    return rows.groupBy("image_id").agg(F.sum("width").alias("n_pixels"), (F.sum("n_bytes") + 2 * F.count(F.lit(1))).alias("n_bytes"))


def scan(data: bytes) -> tuple[list[tuple[int, int, int, int, int]], str | None, int]:
    """Runs (y, run_idx, x_start, len, v) of a stream, what is wrong with it, and trailing bytes.

    What stands behind the last row's end is no row. Variable-length codes hold any byte, so the
    stream is read from its start.
    """
    out, row = [], []
    at, y, x, width, kept = 0, 0, 0, 0, 0
    n = len(data)
    if n < 2:
        return [], "too short", n
    while at < n:
        first = data[at]
        at += 1
        if first:
            length, v = 1, first
        else:
            if at >= n:
                return out, "truncated", n - kept
            op = data[at]
            at += 1
            if op == 0:
                if width and x != width:
                    return out, "rows differ in width", n - kept
                # Rows without a pixel before the first that has one are no rows.
                width = x
                out += row
                y += bool(x)
                row, x, kept = [], 0, at
                continue
            length = op & 0x3F
            if op & 0x40:
                if at >= n:
                    return out, "truncated", n - kept
                length = length << 8 | data[at]
                at += 1
            v = 0
            if op & 0x80:
                if at >= n:
                    return out, "truncated", n - kept
                v = data[at]
                at += 1
        if not length:
            continue
        if row and row[-1][4] == v:
            y0, k, start, before, _ = row[-1]
            row[-1] = (y0, k, start, before + length, v)
        else:
            row.append((y, len(row), x, length, v))
        x += length
    if not width:
        return out, "no rows", n - kept
    return out, None, n - kept


def widths(data: bytes) -> list[int]:
    """Pixels of each finished row of a stream, sound or not."""
    out, at, x, n = [], 0, 0, len(data)
    while at < n:
        if data[at]:
            x, at = x + 1, at + 1
            continue
        op = data[at + 1] if at + 1 < n else 0x40  # a lone last byte is no row's end
        if op == 0:
            out.append(x)
            x, at = 0, at + 2
            continue
        more = 2 + bool(op & 0x40) + bool(op & 0x80)
        if at + more > n:
            break
        x += (op & 0x3F) << 8 | data[at + 2] if op & 0x40 else op & 0x3F
        at += more
    return out


def tokenize(streams: DataFrame) -> DataFrame:
    """Runs of each stream (image_id, data); one row with ``error`` and no run for a broken stream."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["image_id", "y", "run_idx", "x_start", "len", "v", "error", "trailing_bytes"]
        for batch in batches:
            rows = []
            for image, data in zip(batch["image_id"], batch["data"], strict=True):
                found, error, rest = scan(data or b"")
                rows += [(image, None, None, None, None, None, error, rest)] if error else [(image, *r, None, rest) for r in found]
            made = pd.DataFrame(rows, columns=names)
            yield made.astype(dict.fromkeys(names[1:6], "Int32"))

    return streams.select("image_id", "data").mapInPandas(run, "image_id long, y int, run_idx int, x_start int, len int, v int, error string, trailing_bytes int")


def decode(streams: DataFrame) -> DataFrame:
    """(image_id, y, x, v) of the sound streams."""
    found = tokenize(streams).filter(F.col("error").isNull())
    return found.select("image_id", "y", F.explode(F.sequence("x_start", F.col("x_start") + F.col("len") - 1)).alias("x"), "v")


def row_widths(streams: DataFrame) -> DataFrame:
    """(image_id, height, narrowest, widest, consistent) from the finished rows of all streams."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [widths(d or b"") for d in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["image_id", "w"])

    rows = streams.select("image_id", "data").mapInArrow(run, f"image_id {streams.schema['image_id'].dataType.simpleString()}, w array<int>").filter(F.size("w") > 0)
    rows = rows.select("image_id", F.size("w").cast("long").alias("height"), F.array_min("w").alias("narrowest"), F.array_max("w").alias("widest"))
    return rows.withColumn("consistent", F.col("narrowest") == F.col("widest"))


def check_implementation(impl: str) -> None:
    if impl not in IMPLEMENTATIONS:
        raise ValueError(f"implementations are {', '.join(IMPLEMENTATIONS)}")


def problem(width: Column, height: Column, size: Column, strict: bool) -> Column:
    """What keeps an image of so many bytes from being coded; null if nothing does."""
    forbidden = ~F.coalesce(valid_dims(width, height, strict), F.lit(False))
    wrong = ~F.coalesce(size == width.cast("long") * height, F.lit(False))
    return F.when(forbidden, F.lit("sides not allowed")).when(wrong, F.lit("width times height is not its size"))


def encode_row(line: Column) -> Column:
    """The code, with its end and in hexadecimal, of a row as a string of Latin-1, a character a pixel.

    Colours in runs under 3 are their own code, so only rows with 0 or a longer run are taken apart.
    """
    digits = F.hex(F.encode(line, "ISO-8859-1"))

    def coded(r: Column) -> Column:
        itself = (F.length(r) <= 4) & ~r.startswith("00")
        return F.when(itself, r).otherwise(code((F.length(r) / 2).cast("int"), F.conv(F.substring(r, 1, 2), 16, 10).cast("int")))

    apart = F.array_join(F.transform(F.regexp_extract_all(digits, F.lit("(..)\\1*"), F.lit(0)), coded), "")
    return F.concat(F.when(line.rlike(r"(?s)\x00|(.)\1\1"), apart).otherwise(digits), F.lit("0000"))


def encode_bytes(data: bytes, width: int) -> bytes:
    """The stream of an image, in plain Python."""
    out = bytearray()
    for start in range(0, len(data), width):
        for v, same in groupby(data[start : start + width]):
            length = sum(1 for _ in same)
            while length:
                n = min(length, WIDEST)
                length -= n
                if v and n < 3:
                    out += bytes([v] * n)
                    continue
                kind = 0x80 if v else 0
                out += bytes([0, kind | n]) if n < 64 else bytes([0, kind | 0x40 | n >> 8, n & 255])
                out += bytes([v]) if v else b""
        out += b"\0\0"
    return bytes(out)


def encode_dense(bitmaps: DataFrame, strict: bool = True, impl: str = "native") -> DataFrame:
    """(image_id, width, height, data, error) from dense (image_id, width, height, data), a byte a pixel."""
    check_implementation(impl)
    why = problem(F.col("width"), F.col("height"), F.octet_length("data"), strict)
    found = bitmaps.select("image_id", "width", "height", "data", why.alias("error"))
    if impl == "native":
        # All rows are cut in one pass, as each look at a binary column copies it and a place in a string is found from its start.
        rows = F.regexp_extract_all(F.decode("data", "ISO-8859-1"), F.concat(F.lit("(?s).{1,"), F.col("width"), F.lit("}")), F.lit(0))
        return found.select("image_id", "width", "height", F.when(F.col("error").isNull(), F.unhex(F.array_join(F.transform(rows, encode_row), ""))).alias("data"), "error")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            made = [None if e else encode_bytes(d, w) for w, d, e in zip(*[batch.column(c).to_pylist() for c in ("width", "data", "error")], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.binary()), batch.column(4)], names=batch.schema.names)

    return found.mapInArrow(run, found.schema)


#: The codes of a stream in hexadecimal digits: a row's end, runs of 0 and of colours, one pixel, and
#: last a digit that none of them takes, as where a code is cut off.
CODES = "0000|00[1-3].|000[1-9A-F]|00[4-7]...|00[89AB]...|00[C-F].....|0[1-9A-F]|[1-9A-F].|."


def decode_dense(streams: DataFrame, impl: str = "native") -> DataFrame:
    """(image_id, width, height, data, error): the pixels of streams (image_id, data) as dense images.

    A broken stream, or one without a pixel, has no data but an error.
    """
    check_implementation(impl)
    kind = streams.schema["image_id"].dataType.simpleString()
    if impl == "arrow":

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                rows = []
                for data in batch.column(1).to_pylist():
                    found, error, _ = scan(data or b"")
                    if error:
                        rows.append((None, None, None, error))
                        continue
                    height = found[-1][0] + 1
                    pixels = b"".join(bytes([v]) * n for *_, n, v in found)
                    rows.append((len(pixels) // height, height, pixels, None))
                columns = zip(*rows, strict=True) if rows else [[]] * 4
                types = (pa.int32(), pa.int32(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]], names=["image_id", "width", "height", "data", "error"])

        return streams.select("image_id", "data").mapInArrow(run, f"image_id {kind}, width int, height int, data binary, error string")

    def number(digits: Column) -> Column:
        return F.conv(digits, 16, 10).cast("int")

    def pixels(c: Column) -> Column:
        op = number(F.substring(c, 3, 2))
        long = op.bitwiseAND(0x40) > 0
        length = F.when(long, op.bitwiseAND(0x3F) * 256 + number(F.substring(c, 5, 2))).otherwise(op.bitwiseAND(0x3F))
        colour = F.when(op < 0x80, F.lit("00")).otherwise(F.substring(c, -2, 2))
        return F.when(c == "0000", F.lit("|")).when(F.length(c) == 2, c).otherwise(F.repeat(colour, length))

    codes = F.regexp_extract_all(F.hex(F.coalesce("data", F.lit(b""))), F.lit(CODES), F.lit(0))
    split = streams.select("image_id", F.coalesce(F.octet_length("data"), F.lit(0)).alias("size"), codes.alias("codes"))
    # What is behind the last row's end is no row. A code that is cut off is left as single digits or "00".
    cut = F.exists("codes", lambda c: (F.length(c) == 1) | (c == "00"))
    rows = F.split(F.array_join(F.transform("codes", pixels), ""), "\\|")
    split = split.select("image_id", "size", cut.alias("cut"), rows.alias("rows"))
    split = split.withColumn("rows", F.slice("rows", F.lit(1), F.size("rows") - 1))
    first = F.array_position(F.transform("rows", lambda r: F.length(r) > 0), F.lit(True))
    split = split.withColumn("rows", F.when(first > 0, F.slice("rows", first.cast("int"), F.size("rows"))).otherwise(F.slice("rows", 1, 0)))
    wide = F.length(F.get("rows", F.lit(0)))
    apart = F.exists("rows", lambda r: F.length(r) != wide)
    error = F.when(F.col("size") < 2, "too short").when(apart, "rows differ in width").when(F.col("cut"), "truncated").when(F.size("rows") == 0, "no rows")
    made = split.select("image_id", error.alias("error"), (wide / 2).cast("int").alias("width"), F.size("rows").alias("height"), F.unhex(F.array_join("rows", "")).alias("data"))
    sound = F.col("error").isNull()
    return made.select("image_id", *[F.when(sound, F.col(c)).alias(c) for c in ("width", "height", "data")], "error")
