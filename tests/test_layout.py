"""Golden layouts, and the stream against the batch."""

import re

import numpy as np
import pytest

from pixelfold.operators import layout
from pixelfold.streaming import layouts

#: masks (xp, yp, w, h) on a screen of 64 x 64 -> container, windows, flag
GOLDEN = {
    "two boxes": ([(8, 8, 8, 8), (8, 48, 8, 8)], (1, 1, 23, 63), (7, 7, 15, 15), (7, 47, 15, 55), 1),
    "one box": ([(8, 8, 8, 8)], (8, 8, 16, 16), (0, 0, 8, 8), (0, 0, 8, 8), -1),
    "one pixel": ([(20, 20, 1, 1)], (13, 13, 21, 21), (0, 0, 8, 8), (0, 0, 8, 8), -1),
    "a pixel near the corner": ([(7, 7, 1, 1)], (0, 0, 8, 8), (0, 0, 8, 8), (0, 0, 8, 8), -1),
    "small boxes": ([(20, 8, 2, 2), (20, 48, 2, 2)], (7, 1, 29, 57), (13, 1, 21, 9), (13, 41, 21, 49), 1),
    "side by side": ([(8, 8, 8, 8), (48, 8, 8, 8)], (1, 1, 63, 23), (7, 7, 15, 15), (47, 7, 55, 15), 0),
}
SCHEMA = "layout_id long, seq long, xp int, yp int, w int, h int, data binary"


def masks(spark, placed):
    rows = [(i, k, *m, bytearray([1] * (m[2] * m[3]))) for i, one in enumerate(placed) for k, m in enumerate(one)]
    return spark.createDataFrame(rows, SCHEMA)


def flat(r):
    return tuple(tuple(r[f"{p}{c}"] for c in layout.BOX) for p in ("", "w0_", "w1_")) + (r["flag"],)


def test_golden(spark):
    pixels = layout.screen(masks(spark, [g[0] for g in GOLDEN.values()]))
    got = {r["layout_id"]: flat(r) for r in layout.find(pixels, 64, 64).collect()}
    assert got == {i: g[1:] for i, g in enumerate(GOLDEN.values())}


@pytest.mark.parametrize("name", GOLDEN)
def test_golden_in_the_stream_kernel(name):
    placed, *want = GOLDEN[name]
    screen = np.zeros((64, 64), bool)
    for x, y, w, h in placed:
        screen[y : y + h, x : x + w] = True
    outer, pair, flag = layouts.windows(screen, layouts.container(screen))
    assert [tuple(outer), *map(tuple, pair), flag] == want


def test_random_masks_stream_kernel_equals_batch(spark):
    rng = np.random.default_rng(3)
    placed = [[(int(rng.integers(0, 50)), int(rng.integers(0, 50)), int(rng.integers(1, 12)), int(rng.integers(1, 12))) for _ in range(int(rng.integers(1, 5)))] for _ in range(40)]
    got = {r["layout_id"]: flat(r) for r in layout.find(layout.screen(masks(spark, placed)), 64, 64).collect()}
    for i, one in enumerate(placed):
        screen = np.zeros((64, 64), bool)
        for x, y, w, h in one:
            screen[y : y + h, x : x + w] = True
        outer, pair, flag = layouts.windows(screen, layouts.container(screen))
        assert got[i] == (tuple(outer), tuple(pair[0]), tuple(pair[1]), flag)


def test_changed_and_validity(spark):
    m = masks(spark, [[(8, 8, 4, 4), (9, 9, 2, 2), (10, 10, 4, 4), (62, 0, 4, 4)]])
    assert [r["changed"] for r in layout.changed(m).orderBy("seq").collect()] == [True, False, True, True]
    assert [r["valid"] for r in layout.validate(m, 64, 64).orderBy("seq").collect()] == [True, True, True, False]


def test_stream(spark, tmp_path):
    placed = GOLDEN["two boxes"][0]
    schema = "layout_id long, xp int, yp int, w int, h int, data binary, reset boolean"

    def put(rows, name):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def row(m):
        return (5, *m, bytearray([1] * (m[2] * m[3])), False)

    def look():
        q = (
            layouts.stream(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")), 64, 64)
            .writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
            .foreachBatch(lambda df, _: seen.extend(df.collect())).start()
        )
        q.awaitTermination(120)

    seen = []
    put([row(placed[0])], "a")
    look()
    put([row(placed[1])], "b")
    look()
    put([row(placed[1])], "c")
    look()
    assert [flat(r) for r in seen] == [GOLDEN["one box"][1:], GOLDEN["two boxes"][1:], GOLDEN["two boxes"][1:]]
    assert [r["changed"] for r in seen] == [True, True, False]
    put([(5, 9, 9, 4, 4, None, False), (5, 9, 9, 4, 4, bytearray(b"x"), False), (5, None, 9, 1, 1, bytearray(b"x"), False)], "bad")
    look()
    assert flat(seen[-1]) == GOLDEN["two boxes"][1:] and not seen[-1]["changed"]
    put([(5, 0, 0, 0, 0, bytearray(), True)], "d")
    look()
    put([row((20, 20, 1, 1))], "e")
    look()
    assert flat(seen[-1]) == GOLDEN["one pixel"][1:]


def test_screens_and_layouts_without_masks(spark):
    for w, h in ((7, 8), (8, 7), (1929, 8), (8, 1089)):
        with pytest.raises(ValueError, match="screens"):
            layout.check_screen(w, h)
    layout.check_screen(1928, 1088)
    m = masks(spark, [[(8, 8, 8, 8)]])
    got = {r["layout_id"]: r["x1"] for r in layout.raw_containers(spark.createDataFrame([(0,), (1,)], "layout_id long"), layout.screen(m)).collect()}
    assert got == {0: 8, 1: None}


def test_cells_of_a_mask_that_are_zero_set_nothing(spark):
    holes = bytearray([0, 1, 0, 0, 0, 2, 0, 0, 0])
    m = spark.createDataFrame([(0, 0, 10, 20, 3, 3, holes)], SCHEMA)
    assert sorted((r["y"], r["x"]) for r in layout.screen(m).collect()) == [(20, 11), (21, 12)]


def test_pixels_are_kept_as_words_behind_the_exchange_by_layout(spark):
    """Else a task that reads many masks holds a row for each pixel that they set."""
    rng = np.random.default_rng(7)
    rows = [(i % 3, k, int(rng.integers(-40, 60)), int(rng.integers(0, 50)), int(rng.integers(1, 75)), int(rng.integers(1, 6))) for i in range(3) for k in range(40)]
    rows = [(*r, None if r[1] == 5 else bytearray((rng.random(r[4] * r[5] - (r[1] == 6)) < 0.2).astype(np.uint8) * int(rng.integers(1, 256)))) for r in rows]
    m = spark.createDataFrame([*rows, (0, 99, 3, 3, 0, 2, bytearray()), (3, 0, 2, 2, 2, 2, bytearray(4))], SCHEMA)
    pixels = layout.mask_pixels(m.filter("w > 0")).collect()
    seen, new = set(), set()
    for r in sorted(pixels, key=lambda r: r["seq"]):
        if (at := (r["layout_id"], r["y"], r["x"])) not in seen:
            new.add((r["layout_id"], r["seq"]))
        seen.add(at)
    got = layout.changed(m).collect()
    assert len(got) == m.count() and {(r["layout_id"], r["seq"]) for r in got if r["changed"]} == new
    cells = [tuple(r) for r in layout.screen(m).select("layout_id", "y", "x").collect()]
    assert len(cells) == len(seen) and set(cells) == seen
    assert layout.mask_words(m).count() * 4 < sum(r[4] * r[5] for r in rows)
    for df in (layout.changed(m), layout.screen(m)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        leaf = re.split(r"Exchange hashpartitioning\(layout_id", plan)[-1]
        assert "Aggregate" not in leaf and "getbit" not in leaf
