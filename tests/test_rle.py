"""Golden codes, round trips and broken streams."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pixelfold.operators import rle
from pixelfold.plans import queries
from pixelfold.sources import rasters

ROWS = {
    "0008": [0] * 8, "008801": [1] * 8, "003F": [0] * 63, "00BF05": [5] * 63, "004040": [0] * 64, "00C04005": [5] * 64,
    "010102" + "0003" + "0303": [1, 1, 2, 0, 0, 0, 3, 3], "004100": [0] * 256, "00C12C05": [5] * 300, "00C78001": [1] * 1920,
}


def pixels(spark, images):
    rows = [(i, y, x, v) for i, image in images.items() for y, line in enumerate(image) for x, v in enumerate(line)]
    return spark.createDataFrame(rows, "image_id long, y int, x int, v int")


def test_golden_rows(spark):
    images = {i: [line] * 8 for i, line in enumerate(ROWS.values())}
    got = {r["image_id"]: r["data"].hex().upper() for r in rle.encode(pixels(spark, images)).collect()}
    assert got == {i: (code + "0000") * 8 for i, code in enumerate(ROWS)}


def test_golden_rows_come_back(spark):
    images = {i: [line] * 8 for i, line in enumerate(ROWS.values())}
    source = pixels(spark, images)
    again = rle.decode(rle.encode(source))
    assert source.exceptAll(again).isEmpty() and again.exceptAll(source).isEmpty()


@pytest.mark.parametrize(
    ("stream", "error"),
    [("00880100000089010000", "rows differ in width"), ("0008000000", "truncated"), ("0000", "no rows"), ("00", "too short"), ("", "too short"), ("0041", "truncated"), ("0083", "truncated")],
)
def test_broken_streams(stream, error):
    assert rle.scan(bytes.fromhex(stream))[1] == error


def test_unterminated_tail_is_no_row():
    runs, error, rest = rle.scan(bytes.fromhex("000800000102"))
    assert error is None and rest == 2 and runs == [(0, 0, 0, 8, 0)]


def test_broken_stream_gives_an_error_row(spark):
    made = rle.tokenize(spark.createDataFrame([(1, bytearray(b"\0"))], "image_id long, data binary")).collect()
    assert [(r["image_id"], r["error"], r["y"]) for r in made] == [(1, "too short", None)]


def plain_encode(image):
    out = b""
    for line in image:
        x = 0
        while x < len(line):
            n = 1
            while x + n < len(line) and line[x + n] == line[x]:
                n += 1
            v = line[x]
            if v and n < 3:
                out += bytes([v]) * n
            elif n < 64:
                out += bytes([0, n | (0x80 if v else 0)]) + (bytes([v]) if v else b"")
            else:
                out += bytes([0, (0xC0 if v else 0x40) | n >> 8, n & 255]) + (bytes([v]) if v else b"")
            x += n
        out += b"\0\0"
    return out


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 90).flatmap(lambda w: st.lists(st.lists(st.sampled_from([0, 0, 0, 1, 255]), min_size=w, max_size=w), min_size=1, max_size=5)))
def test_scan_inverts_encoding(image):
    runs, error, rest = rle.scan(plain_encode(image))
    assert error is None and rest == 0
    back = [[] for _ in image]
    for y, _, start, n, v in runs:
        assert start == len(back[y])
        back[y] += [v] * n
    assert back == image


def test_size_and_budget(spark):
    p = pixels(spark, {0: [[0] * 8] * 8, 1: [[1, 0] * 4] * 8})
    assert {r["image_id"]: (r["n_pixels"], r["n_bytes"]) for r in rle.size_ratio(p).collect()} == {0: (64, 32), 1: (64, 8 * (4 + 8 + 2))}
    assert {(r["image_id"], r["fits"]) for r in rle.row_budget(p).collect()} == {(0, True), (1, False)}


def test_dims(spark):
    df = spark.createDataFrame([(7, 8), (8, 8), (4096, 4096), (4097, 8), (16383, 1)], "w int, h int")
    made = df.select(rle.valid_dims(F.col("w"), F.col("h")).alias("s"), rle.valid_dims(F.col("w"), F.col("h"), strict=False).alias("l")).collect()
    assert [(r["s"], r["l"]) for r in made] == [(False, True), (True, True), (True, True), (False, True), (False, True)]


def test_whole_texts_lose_nothing(spark, tmp_path):
    made = {0: "", 1: "ab", 2: "x" * 511, 3: "y" * 512, 4: "é日" * 300 + "end", 5: None}
    spark.createDataFrame(list(made.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    dims = {r["image_id"]: (r["width"], r["height"], r["valid"]) for r in queries.queries()["rle_validate_dims"](spark, str(tmp_path)).collect()}
    assert dims == {0: (64, 0, False), 1: (64, 1, False), 2: (64, 8, True), 3: (64, 8, True), 4: (64, 10, True), 5: (64, 0, False)}
    source = rasters.text_bitmap(spark, str(tmp_path))
    seen = {}
    for r in rle.decode(rle.encode(rasters.bitmap_to_pixels(source))).collect():
        seen.setdefault(r["image_id"], {})[r["y"] * 64 + r["x"]] = r["v"]
    want = {i: [ord(c) & 255 for c in t or ""] for i, t in made.items()}
    assert {i: [v for _, v in sorted(cells.items())] for i, cells in seen.items()} == {i: v + [0] * (max(512, -(-len(v) // 64) * 64) - len(v)) for i, v in want.items()}
    assert source.exceptAll(rle.decode_dense(rle.encode_dense(source, strict=False)).select(*source.columns)).isEmpty()
    assert queries.queries()["rle_encode_text"](spark, str(tmp_path)).count() == len(made)


def test_a_long_text_costs_no_more_a_character_than_short_ones(spark, tmp_path):
    """Its rows were found by a walk from its start: minutes for this one."""
    rng = __import__("random").Random(5)
    made = ["".join(rng.choices("ab c\0\xff\u0100\u65e5\U0001f600", [9, 9, 9, 3, 1, 1, 1, 1, 1], k=k)) for k in (2_000_000, 777, 64)]
    made += ["".join(rng.choices("abc\xe9   ", k=1000)), "a\n\n\nb", "\r\r\u2028\u2028\u2028\x85\x85\x85"]
    spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    began = time.monotonic()
    got = {r["image_id"]: bytes(r["data"]) for r in rle.encode_dense(rasters.text_bitmap(spark, str(tmp_path)), strict=False).collect()}
    assert time.monotonic() - began < 40
    pixels_of = [bytes(ord(c) & 255 for c in t) for t in made]
    assert got == {i: rle.encode_bytes(p.ljust(max(512, -(-len(p) // 64) * 64), b"\0"), 64) for i, p in enumerate(pixels_of)}


STREAMS = "image_id long, data binary"


def both(spark, streams):
    df = spark.createDataFrame([(i, None if x is None else bytearray(x)) for i, x in enumerate(streams)], STREAMS)
    made = [{r["image_id"]: (r["width"], r["height"], r["data"] and bytes(r["data"]), r["error"]) for r in rle.decode_dense(df, impl).collect()} for impl in rle.IMPLEMENTATIONS]
    assert made[0] == made[1]
    return list(made[0][i] for i in range(len(streams)))


def test_runs_without_pixels_and_rows_before_the_first(spark):
    nothing = bytes.fromhex("0101010080050202020000")
    empty_first = bytes.fromhex("00000000" + "0008" + "0000")
    assert both(spark, [nothing, empty_first, empty_first + bytes.fromhex("0000")]) == [(6, 1, bytes([1, 1, 1, 2, 2, 2]), None), (8, 1, bytes(8), None), (None, None, None, "rows differ in width")]
    assert rle.scan(nothing)[0] == [(0, 0, 0, 3, 1), (0, 1, 3, 3, 2)] and rle.widths(empty_first) == [0, 0, 8]


def test_broken_streams_in_both_ways(spark):
    streams = {"00880100000089010000": "rows differ in width", "0008000000": "truncated", "0000": "no rows", "00": "too short", "": "too short", "0041": "truncated", "0083": "truncated", "00080000C1": None, "000800000041": "truncated"}
    assert [e for *_, e in both(spark, [bytes.fromhex(x) for x in streams])] == list(streams.values())
    assert both(spark, [None])[0][3] == "too short"


@settings(max_examples=20, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=14).map(lambda b: b.replace(b"\x07", b"\0\0")), min_size=1, max_size=20))
def test_any_bytes_in_both_ways(spark, streams):
    both(spark, streams)


def test_both_ways_encode_alike(spark):
    rng = __import__("random").Random(3)
    images = [(8, 8, bytes(rng.choice([0, 0, 0, 7, 200]) for _ in range(64))), (40000, 1, bytes(40000)), (16384, 2, bytes([9]) * 32768), (300, 9, bytes([5]) * 2700), (8, 9, bytes(71)), (0, 8, b""), (8, 8, None), (None, 8, bytes(8))]
    df = spark.createDataFrame([(i, w, h, None if d is None else bytearray(d)) for i, (w, h, d) in enumerate(images)], "image_id long, width int, height int, data binary")
    for strict in (True, False):
        made = [{r["image_id"]: (r["data"] and bytes(r["data"]), r["error"]) for r in rle.encode_dense(df, strict, impl).collect()} for impl in rle.IMPLEMENTATIONS]
        assert made[0] == made[1]
    assert [made[0][i][1] for i in range(8)] == [None, None, None, None, "width times height is not its size", "sides not allowed", "width times height is not its size", "sides not allowed"]
    back = {r["image_id"]: (r["width"], r["height"], bytes(r["data"])) for r in rle.decode_dense(rle.encode_dense(df, False).filter("error IS NULL")).collect()}
    assert back == {i: images[i] for i in range(4)}
    long = pixels(spark, {0: [[3] * 20000]})
    assert rle.decode(rle.encode(long)).count() == 20000
    with pytest.raises(ValueError, match="implementations"):
        rle.encode_dense(df, impl="c")


def test_colours_beyond_a_byte_are_an_error(spark):
    with pytest.raises(Exception, match="colours are from 0 to 255"):
        rle.encode(pixels(spark, {0: [[300] * 8] * 8})).collect()
