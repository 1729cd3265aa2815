"""Two-rectangle layout search: masks gather on a screen, and at most two boxes of least area hold them.

A container is the box around all set pixels, at least ``LEAST`` on a side. It is widened by up to
seven pixels on every side and cut in two at every line that leaves eight pixels on both sides; each
half shrinks to what it holds. The halves with the least area together win if that is less than the
container's area: the first cut across rows, then the first across columns.

How a half shrinks has a closed form in its box [X1, X2) x [Y1, Y2) and its contents' box
[l, r) x [t, b), which the windows over lines give for all cuts at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST = 8
BOX = ("x1", "y1", "x2", "y2")


#: Widest and highest screen.
LARGEST = (1928, 1088)


def check_screen(screen_w: int, screen_h: int) -> None:
    if not (LEAST <= screen_w <= LARGEST[0] and LEAST <= screen_h <= LARGEST[1]):
        raise ValueError(f"screens are from {LEAST} x {LEAST} to {LARGEST[0]} x {LARGEST[1]}")


def fits(screen_w: int, screen_h: int) -> Column:
    """Whether a mask lies on the screen."""
    return (F.col("xp") >= 0) & (F.col("yp") >= 0) & (F.col("w") > 0) & (F.col("h") > 0) & (F.col("xp") + F.col("w") <= screen_w) & (F.col("yp") + F.col("h") <= screen_h)


def validate(masks: DataFrame, screen_w: int, screen_h: int) -> DataFrame:
    return masks.withColumn("valid", fits(screen_w, screen_h))


def mask_pixels(masks: DataFrame) -> DataFrame:
    """(layout_id, seq, y, x) of the set pixels, in the screen's coordinates."""
    cells = masks.select("*", F.explode(F.sequence(F.lit(0), F.col("w") * F.col("h") - 1)).alias("i"))
    on = F.hex(F.substring("data", F.col("i") + 1, F.lit(1))) != "00"
    return cells.filter(on).select("layout_id", "seq", (F.col("yp") + F.expr("i div w")).cast("int").alias("y"), (F.col("xp") + F.col("i") % F.col("w")).alias("x"))


#: Pixels of a row that one word of ``mask_words`` holds, the first in its highest bit.
WORD = 32


def mask_words(masks: DataFrame) -> DataFrame:
    """(layout_id, seq, y, word, bits): the set pixels as bits, a row for each line of a mask and each WORD
    columns that it meets. Brought together by layout before anything is kept by pixel or word, so that
    what a task holds does not grow with the masks that it reads."""
    m = masks.select("layout_id", "seq", "xp", "yp", "w", "data", F.explode(F.when((F.col("w") > 0) & (F.col("h") > 0), F.sequence(F.lit(0), F.col("h") - 1))).alias("j"))
    line = F.decode(F.substring("data", F.col("j") * F.col("w") + 1, F.col("w")), "ISO-8859-1")
    # As in mask_pixels, cells that the data lacks are set.
    line = F.rpad(F.regexp_replace(F.regexp_replace(line, r"[^\x00]", "1"), r"\x00", "0"), F.col("w"), F.lit("1"))
    line = F.concat(F.repeat(F.lit("0"), F.pmod("xp", F.lit(WORD))), line)
    m = m.select("layout_id", "seq", (F.col("yp") + F.col("j")).cast("int").alias("y"), F.floor(F.col("xp") / WORD).cast("int").alias("first"), line.alias("line"))
    parts = F.regexp_extract_all("line", F.lit(f".{{1,{WORD}}}"), F.lit(0))
    m = m.select("layout_id", "seq", "y", "first", F.posexplode(parts).alias("k", "part"))
    bits = F.conv(F.rpad("part", F.lit(WORD), F.lit("0")), 2, 10).cast("long")
    m = m.select("layout_id", "seq", "y", (F.col("first") + F.col("k")).alias("word"), bits.alias("bits"))
    return m.filter(F.col("bits") != 0).repartition("layout_id")


def screen(masks: DataFrame) -> DataFrame:
    """(layout_id, y, x) of all pixels set by any mask."""
    words = mask_words(masks).groupBy("layout_id", "y", "word").agg(F.bit_or("bits").alias("bits"))
    cells = words.select("layout_id", "y", "word", "bits", F.explode(F.sequence(F.lit(0), F.lit(WORD - 1))).alias("i"))
    return cells.filter(F.expr(f"getbit(bits, {WORD - 1} - i) = 1")).select("layout_id", "y", (F.col("word") * WORD + F.col("i")).alias("x"))


def changed(masks: DataFrame) -> DataFrame:
    """(layout_id, seq, changed): whether a mask set a pixel that no earlier one had."""
    before = Window.partitionBy("layout_id", "y", "word").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.bit_or("bits").over(before), F.lit(0))
    new = mask_words(masks).select("layout_id", "seq", F.col("bits").bitwiseAND(F.bitwise_not(seen)).alias("new")).filter(F.col("new") != 0)
    first = new.select("layout_id", "seq").distinct().withColumn("new", F.lit(True))
    return masks.select("layout_id", "seq").join(first, ["layout_id", "seq"], "left").select("layout_id", "seq", F.coalesce("new", F.lit(False)).alias("changed"))


def padded(df: DataFrame) -> DataFrame:
    """Widens x1 ... y2 to LEAST a side: on the low side as far as there is room, else on the other."""
    for low, high in (("x1", "x2"), ("y1", "y2")):
        need = F.greatest(F.lit(0), LEAST - (F.col(high) - F.col(low)))
        take = F.least(need, F.col(low))
        df = df.withColumn("_need", need).withColumn("_take", take)
        df = df.withColumn(low, F.col(low) - F.col("_take")).withColumn(high, F.col(high) + F.col("_need") - F.col("_take"))
    return df.drop("_need", "_take")


def containers(pixels: DataFrame) -> DataFrame:
    """(layout_id, x1, y1, x2, y2): the padded box around each layout's pixels."""
    tight = pixels.groupBy("layout_id").agg(F.min("x").alias("x1"), F.min("y").alias("y1"), (F.max("x") + 1).alias("x2"), (F.max("y") + 1).alias("y2"))
    return padded(tight)


def raw_containers(layouts: DataFrame, pixels: DataFrame) -> DataFrame:
    """(layout_id, x1, y1, x2, y2) of every layout, null before it has a pixel."""
    return layouts.select("layout_id").join(containers(pixels), "layout_id", "left")


def container_history(masks: DataFrame, epoch: Column) -> DataFrame:
    """(layout_id, epoch, box): the container at each look, which keeps what earlier looks had."""
    boxes = mask_pixels(masks.withColumn("seq", epoch)).groupBy("layout_id", F.col("seq").alias("epoch")).agg(F.min("x").alias("x1"), F.min("y").alias("y1"), (F.max("x") + 1).alias("x2"), (F.max("y") + 1).alias("y2"))
    so_far = Window.partitionBy("layout_id").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)

    def grown(df: DataFrame) -> DataFrame:
        return df.select("layout_id", "epoch", *[(F.min if c[1] == "1" else F.max)(c).over(so_far).alias(c) for c in BOX])

    return grown(padded(grown(boxes)))


def extended(boxes: DataFrame, screen_w: int, screen_h: int) -> DataFrame:
    """Adds ex1, ey1, ex2, ey2: the container with a margin of up to seven pixels."""
    check_screen(screen_w, screen_h)
    m = LEAST - 1
    return boxes.select(
        "*", F.greatest(F.lit(0), F.col("x1") - m).alias("ex1"), F.greatest(F.lit(0), F.col("y1") - m).alias("ey1"),
        F.least(F.lit(screen_w), F.col("x2") + m).alias("ex2"), F.least(F.lit(screen_h), F.col("y2") + m).alias("ey2"),
    )


#: What an empty half's contents count as.
FAR = 1_000_000


def _halves(lines: DataFrame, across: str, along: str) -> DataFrame:
    """For each cut ``pos`` of the dense lines: the contents' boxes before it and from it on.

    lines: layout_id, box, line, and lo, hi (past the end) of the line's pixels, null if it is empty.
    """
    part = Window.partitionBy("layout_id").orderBy("line")
    before, after = part.rowsBetween(Window.unboundedPreceding, -1), part.rowsBetween(0, Window.unboundedFollowing)
    here, past = F.when(F.col("lo").isNotNull(), F.col("line")), F.when(F.col("lo").isNotNull(), F.col("line") + 1)
    out = [F.lit(across).alias("axis"), F.col("line").alias("pos")]
    for k, frame in ((0, before), (1, after)):
        out += [
            F.coalesce(F.min("lo").over(frame), F.lit(FAR)).alias(f"{along}lo{k}"), F.coalesce(F.max("hi").over(frame), F.lit(-FAR)).alias(f"{along}hi{k}"),
            F.coalesce(F.min(here).over(frame), F.lit(FAR)).alias(f"{across}lo{k}"), F.coalesce(F.max(past).over(frame), F.lit(-FAR)).alias(f"{across}hi{k}"),
        ]
    return lines.select("layout_id", *BOX, "ex1", "ey1", "ex2", "ey2", *out)


def _shrunk(k: int, axis: str) -> list[Column]:
    """The k-th half's window. The side that is trimmed first wins where the contents are small."""
    low = {"x": F.col("ex1"), "y": F.col("ey1")}
    high = {"x": F.col("ex2"), "y": F.col("ey2")}
    (high if k == 0 else low)[axis] = F.col("pos")
    along = "x" if axis == "y" else "y"
    a1 = F.least(F.col(f"{along}lo{k}"), high[along] - LEAST)
    a2 = F.greatest(F.col(f"{along}hi{k}"), a1 + LEAST)
    b2 = F.greatest(F.col(f"{axis}hi{k}"), low[axis] + LEAST)
    b1 = F.least(F.col(f"{axis}lo{k}"), b2 - LEAST)
    one = {f"{along}1": a1, f"{along}2": a2, f"{axis}1": b1, f"{axis}2": b2}
    return [one[c].alias(f"w{k}_{c}") for c in BOX]


def candidates(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """(layout_id, box, axis_rank, pos, both windows, area) for every cut of the extended containers."""
    out = None
    for rank, (axis, other) in enumerate((("y", "x"), ("x", "y"))):
        stats = pixels.groupBy("layout_id", F.col(axis).alias("line")).agg(F.min(other).alias("lo"), (F.max(other) + 1).alias("hi"))
        dense = boxes.select("*", F.explode(F.sequence(F.col(f"e{axis}1"), F.col(f"e{axis}2") - 1)).alias("line"))
        cuts = _halves(dense.join(stats, ["layout_id", "line"], "left"), axis, other)
        cuts = cuts.filter((F.col("pos") >= F.col(f"e{axis}1") + LEAST) & (F.col("pos") <= F.col(f"e{axis}2") - LEAST))
        made = cuts.select("layout_id", *BOX, "ex1", "ey1", "ex2", "ey2", F.lit(rank).alias("axis_rank"), "pos", *_shrunk(0, axis), *_shrunk(1, axis))
        out = made if out is None else out.unionByName(made)

    def area(k: int) -> Column:
        return (F.col(f"w{k}_x2") - F.col(f"w{k}_x1")) * (F.col(f"w{k}_y2") - F.col(f"w{k}_y1"))

    return out.withColumn("area", (area(0) + area(1)).cast("long"))


WINDOWS = [f"w{k}_{c}" for k in (0, 1) for c in BOX]


def best_split(cuts: DataFrame) -> DataFrame:
    """The winning cut of each layout that has one better than its container."""
    whole = ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).cast("long")
    best = cuts.filter(F.col("area") < whole).groupBy("layout_id").agg(F.min(F.struct("area", "axis_rank", "pos", *WINDOWS)).alias("b"))
    return best.select("layout_id", "b.*")


def find(pixels: DataFrame, screen_w: int, screen_h: int) -> DataFrame:
    """(layout_id, container, windows relative to it, flag): flag 1 for rows cut, 0 for columns, -1."""
    boxes = extended(containers(pixels), screen_w, screen_h)
    best = best_split(candidates(pixels, boxes))
    all_of = boxes.join(best, "layout_id", "left")
    cut = F.col("axis_rank").isNotNull()
    flag = F.when(~cut, -1).otherwise(1 - F.col("axis_rank"))
    outer = {c: F.when(cut, F.col(f"e{c}")).otherwise(F.col(c)) for c in BOX}
    window = [(F.coalesce(F.col(f"w{k}_{c}"), F.col(c)) - outer[f"{c[0]}1"]).alias(f"w{k}_{c}") for k in (0, 1) for c in BOX]
    return all_of.select("layout_id", *[outer[c].alias(c) for c in BOX], *window, flag.alias("flag"))
