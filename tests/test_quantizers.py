"""Golden palettes and properties of the quantizers."""

import numpy as np
import pytest

from pixelfold.operators import clusters, dither, hextree, quantize

HIST = "image_id long, r int, g int, b int, a int, n long"
TWO = [(0, 10, 20, 30, 255, 3), (0, 200, 100, 50, 255, 1)]


def test_two_colours_by_clusters(spark):
    hist = spark.createDataFrame(TWO, HIST)
    one = clusters.cluster_stats(hist.selectExpr("*", "0 AS cid")).collect()[0]
    assert [one[f"m{c}"] for c in "rgba"] == [58, 40, 35, 255] and one["chn"] == 0 and one["max_err"] == 72
    made = clusters.palette(clusters.colour_index(hist, 8)).orderBy("pid").collect()
    assert [tuple(r[c] for c in "rgba") for r in made] == [(10, 20, 30, 255), (200, 100, 50, 255)]


def test_two_colours_by_tree(spark):
    made = hextree.palette(hextree.levels(spark.createDataFrame(TWO, HIST)), 16).orderBy("pid").collect()
    assert [tuple(r[c] for c in "rgba") for r in made] == [(200, 100, 50, 255), (10, 20, 30, 255)]


def test_seventeen_colours_fold_to_sixteen(spark):
    hist = spark.createDataFrame([(0, i, 0, 0, 255, 1) for i in range(17)], HIST)
    made = hextree.palette(hextree.levels(hist), 16).orderBy("pid").collect()
    assert [r["r"] for r in made] == [*range(2, 16), 16, 0]


def test_every_colour_has_one_leaf(spark):
    rng = np.random.default_rng(0)
    rows = {tuple(int(v) for v in rng.integers(0, 256, 4)) for _ in range(600)}
    hist = spark.createDataFrame([(0, *c, 1 + sum(c) % 7) for c in rows if c[3]], HIST)
    leaves = hextree.palette(hextree.levels(hist), 32)
    index = hextree.colour_index(hist, leaves)
    assert index.count() == hist.count() and 0 < leaves.count() <= 32
    assert leaves.selectExpr("sum(n)").head()[0] == hist.selectExpr("sum(n)").head()[0]


def test_kernel_and_steps_split_alike(spark):
    rng = np.random.default_rng(1)
    rows = {tuple(int(v) for v in rng.integers(0, 40, 4)) for _ in range(80)}
    hist = spark.createDataFrame([(0, *c, 1 + sum(c) % 5) for c in sorted(rows) if c[3]], HIST)
    once = clusters.split_once(hist.selectExpr("*", "0 AS cid"), 8)
    twice = {tuple(r[c] for c in "rgba"): r["cid"] for r in clusters.split_once(once, 8).collect()}
    x = np.array([[*c] for c in sorted(rows) if c[3]])
    n = np.array([1 + int(c.sum()) % 5 for c in x])
    # With three clusters the kernel has made the same two cuts; costs depend on the number aimed at.
    three = clusters.clusterize(x, n, 3)
    assert set(twice.values()) == {0, 1, 2} == set(three.tolist())
    again = clusters.split_once(clusters.split_once(hist.selectExpr("*", "0 AS cid"), 3), 3)
    assert {tuple(r[c] for c in "rgba"): r["cid"] for r in again.collect()} == dict(zip(map(tuple, x.tolist()), three.tolist(), strict=True))


def test_kmeans_keeps_the_best_of_three_starts(spark):
    levels = [0, 1, 2, 60, 61, 62, 63, 120, 121, 200, 202, 250]
    rows = [(0, a, b, 0, 255, 1 + (a * b) % 3) for a in levels for b in levels[::3]]
    got = [tuple(r[c] for c in "rgba") for r in clusters.kmeans_palette(spark.createDataFrame(rows, HIST), 4).collect()]
    x, n = np.array([r[1:5] for r in sorted(rows)], float), np.array([r[5] for r in sorted(rows)], float)

    def cost(centres):
        return (((x[:, None] - np.array(centres)) ** 2).sum(2).min(1) * n).sum()

    rng = np.random.default_rng(0)
    first, *others = [clusters.kmeans(x, n, 4, 11, 1e-3, rng)[2] for _ in range(3)]
    assert min(others) < 0.97 * first and cost(got) == pytest.approx(min(others), rel=0.01)


@pytest.mark.parametrize("kernel", dither.KERNELS)
def test_exact_palette_needs_no_dithering(kernel):
    image = np.array([[[0, 0, 0, 255], [255, 255, 255, 255]] * 4] * 6)
    own = np.array([[0, 1] * 4] * 6)
    assert (dither.diffuse(image, own, np.array([[0, 0, 0, 255], [255, 255, 255, 255]]), lambda c: None, 16, kernel) == own).all()


@pytest.mark.parametrize("kernel", dither.KERNELS)
def test_grey_becomes_a_mixture(kernel):
    image = np.full((24, 24, 4), (100, 100, 100, 255))
    out = dither.diffuse(image, np.zeros((24, 24), int), np.array([[90, 90, 90, 255], [110, 110, 110, 255]]), lambda c: None, 16, kernel)
    assert 0.3 < out.mean() < 0.7


def test_arguments():
    for call in (lambda: hextree.check_colours(15), lambda: clusters.check_colours(7), lambda: clusters.check_colours(257), lambda: dither.dither(None, None, None, 1, "x")):
        with pytest.raises(ValueError, match="colours|kernel"):
            call()
    clusters.check_colours(4, strict=False)


def slow_diffusion(image, own, palette, lookup, limit, kernel):
    """The rules written out pixel by pixel: what is spread, and how near an edge."""
    h, w = own.shape
    f = np.float32
    waiting = {}
    out = np.zeros((h, w), int)

    def give(y, x, rest, weight):
        waiting[y, x] = waiting.get((y, x), np.zeros(4, f)) + rest * f(weight)

    for y in range(h):
        way = 1 if y % 2 == 0 else -1
        for x in sorted(range(w), reverse=way < 0):
            e = np.clip(waiting.get((y, x), np.zeros(4, f)), -limit, limit)
            colour = image[y, x].astype(f)
            if (e * e).sum() > 2:
                colour = colour + e
                c = np.clip(np.rint(colour), 0, 255).astype(int)
                c = c * (c[3] > 0)
                pid = lookup(tuple(c.tolist()))
                if pid is None:
                    pid = min(range(len(palette)), key=lambda k: (sum(int(d) * d * m for d, m in zip(palette[k] - c, (1, 1, 1, 3), strict=True)), k))
            else:
                pid = own[y, x]
            out[y, x] = pid
            rest = (colour - palette[pid].astype(f)) / f({"atkinson": 8, "jjn": 48, "sierra": 32}[kernel])
            below, below2 = y + 1 < h, y + 2 < h
            if kernel == "atkinson":
                if (way > 0 and x < w - 2) or (way < 0 and x > 1):
                    give(y, x + way, rest, 1), give(y, x + 2 * way, rest, 1)
                if below and 0 < x < w - 1:
                    for d in (-1, 0, 1):
                        give(y + 1, x + d, rest, 1)
                if below2:
                    give(y + 2, x, rest, 1)
                continue
            far = 1 < x < w - 2
            if far:
                give(y, x + way, rest, 7 if kernel == "jjn" else 5), give(y, x + 2 * way, rest, 5 if kernel == "jjn" else 3)
            if far and below:
                for d, k in zip((-2, -1, 0, 1, 2), (3, 5, 7, 5, 3) if kernel == "jjn" else (2, 4, 5, 4, 2), strict=True):
                    give(y + 1, x + d, rest, k)
            if below2 and (far if kernel == "jjn" else 0 < x < w - 1):
                for d, k in zip((-2, -1, 0, 1, 2), (1, 3, 5, 3, 1) if kernel == "jjn" else (0, 2, 3, 2, 0), strict=True):
                    if k:
                        give(y + 2, x + d, rest, k)
    return out


@pytest.mark.parametrize("kernel", dither.KERNELS)
@pytest.mark.parametrize(("h", "w"), [(16, 40), (9, 3), (5, 1), (1, 8)])
def test_dithering_equals_its_slow_twin(kernel, h, w):
    rng = np.random.default_rng(h * w)
    image = rng.integers(0, 256, (h, w, 4))
    image[..., 3] = rng.choice([0, 128, 255], (h, w))
    image[image[..., 3] == 0] = 0
    palette = rng.integers(0, 256, (12, 4))
    own = ((image[:, :, None] - palette) ** 2 * (1, 1, 1, 3)).sum(3).argmin(2)
    known = {tuple(c): int(p) for c, p in zip(image.reshape(-1, 4).tolist(), own.ravel(), strict=True)}
    got = dither.diffuse(image, own, palette, known.get, 16.0, kernel)
    assert (got == slow_diffusion(image, own, palette, known.get, np.float32(16), kernel)).all()


@pytest.mark.parametrize("method", quantize.LIMITS)
@pytest.mark.parametrize("kernel", [None, "atkinson"])
def test_quantize(spark, method, kernel):
    rng = np.random.default_rng(2)
    flat = rng.choice(8, 30 * 10)
    colours = np.array([[0, 0, 0, 0], [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255], [9, 9, 9, 255], [90, 90, 9, 128], [200, 9, 200, 255], [255, 255, 255, 255]], np.uint8)
    data = bytearray(colours[flat].tobytes())
    images = [(1, 30, 10, data), (2, 30, 9, data), (3, 0, 1, bytearray()), (4, 9000, 1, bytearray(36000))]
    bitmaps, palettes = quantize.quantize(spark.createDataFrame(images, "image_id long, width int, height int, data binary"), method, 16, kernel)
    got = {r["image_id"]: r for r in bitmaps.collect()}
    pal = {(r["image_id"], r["pid"]): tuple(r[c] for c in "rgba") for r in palettes.collect()}
    assert [pal[1, p] for p in got[1]["data"]] == [tuple(c) for c in colours[flat].tolist()]
    assert [got[i]["error"] for i in (1, 2, 3)] == [None, "width times height is not its size", "sides not allowed"]
    assert (got[4]["error"] == "sides not allowed") == (method == "hextree") and got[2]["data"] is None
    with pytest.raises(ValueError, match="colours"):
        quantize.quantize(bitmaps, method, 7)
