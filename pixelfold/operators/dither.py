"""Error diffusion: a serpentine scan, one image at a time, many images side by side.

Each pixel depends on all before it, so this is a grouped kernel in single precision. A pixel gets its
error, clamped, if that is large enough to matter, then an entry: by lookup, else the nearest. What
the entry lacks is spread ahead; pixels near an edge spread less.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.color import CHANNELS, normalized

#: Fixed values: (row, step ahead, weight) and divisor of the known kernels.
KERNELS = {
    "atkinson": ([(0, 1, 1), (0, 2, 1), (1, -1, 1), (1, 0, 1), (1, 1, 1), (2, 0, 1)], 8),
    "jjn": ([(0, 1, 7), (0, 2, 5), (1, -2, 3), (1, -1, 5), (1, 0, 7), (1, 1, 5), (1, 2, 3), (2, -2, 1), (2, -1, 3), (2, 0, 5), (2, 1, 3), (2, 2, 1)], 48),
    "sierra": ([(0, 1, 5), (0, 2, 3), (1, -2, 2), (1, -1, 4), (1, 0, 5), (1, 1, 4), (1, 2, 2), (2, -1, 2), (2, 0, 3), (2, 1, 2)], 32),
}
#: For each of a kernel's rows how far from both edges a pixel must be to spread there; None:
#: only the way ahead must be free.
EDGES = {"atkinson": (None, 1, 0), "jjn": (2, 2, 2), "sierra": (2, 2, 1)}
#: Squared error from which it is added to the pixel.
THRESHOLD = 2.0


def diffuse(image: np.ndarray, own: np.ndarray, palette: np.ndarray, lookup: Callable[[tuple], int | None], limit: float, kernel: str) -> np.ndarray:
    """Entries of an image (height, width, 4). own: entries of the pixels as they are; lookup: the
    entry of a changed colour, if it has one; limit: largest error of a channel."""
    spread, divisor = KERNELS[kernel]
    h, w = own.shape
    ahead_free = max(abs(s) for r, s, _ in spread if r == 0)
    edges = EDGES[kernel]
    errors = np.zeros((h + 2, w, 4), np.float32)
    out = np.empty((h, w), np.int32)
    colours = palette.astype(np.float32)
    whole = palette.astype(np.int64)
    for y in range(h):
        ahead = 1 if y % 2 == 0 else -1
        for x in range(w) if ahead > 0 else range(w - 1, -1, -1):
            e = np.clip(errors[y, x], -limit, limit)
            pixel = image[y, x].astype(np.float32)
            if float((e * e).sum()) > THRESHOLD:
                pixel = pixel + e
                c = np.clip(np.rint(pixel), 0, 255).astype(np.int64)
                if c[3] == 0:
                    c[:] = 0
                entry = lookup(tuple(c.tolist()))
                if entry is None:
                    d = whole - c
                    entry = int(((d * d) * (1, 1, 1, 3)).sum(1).argmin())
            else:
                entry = int(own[y, x])
            out[y, x] = entry
            rest = (pixel - colours[entry]) / np.float32(divisor)
            room = [y + r < h and (0 <= x + ahead_free * ahead < w if far is None else far <= x < w - far) for r, far in enumerate(edges)]
            for r, s, weight in spread:
                if room[r]:
                    errors[y + r, x + s * ahead] += rest * np.float32(weight)
    return out


def dither(pixels: DataFrame, colour_pids: DataFrame, entries: DataFrame, limit: float, kernel: str = "atkinson") -> DataFrame:
    """(image_id, y, x, pid). colour_pids: the entry of each colour. entries: pid and colour, and for a
    tree the level and prefix of its leaf; without those, only colours of the image are looked up."""
    if kernel not in KERNELS:
        raise ValueError(f"kernel is one of {', '.join(KERNELS)}")
    plain = pixels.select("image_id", "y", "x", *[normalized(c) for c in CHANNELS])
    known = plain.join(colour_pids.select("image_id", *CHANNELS, "pid"), ["image_id", *CHANNELS])
    tree = "level" in entries.columns
    entries = entries.select(*[F.col(c).alias(c) for c in entries.columns])  # its own columns, where both come of one plan

    def run(key: tuple, cells: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values(["y", "x"])
        h, w = int(cells["y"].max()) + 1, int(cells["x"].max()) + 1
        image = cells[list(CHANNELS)].to_numpy(np.int64).reshape(h, w, 4)
        own = cells["pid"].to_numpy(np.int64).reshape(h, w)
        table = table.sort_values("pid")
        if tree:
            leaves = {(t.level, t.pr, t.pg, t.pb, t.pa): t.pid for t in table.itertuples()}
            depths = sorted(set(table["level"]), reverse=True)

            def lookup(c: tuple) -> int | None:
                return next((leaves[k] for d in depths if (k := (d, *[v >> (7 - d) for v in c])) in leaves), None)
        else:
            lookup = dict(zip(map(tuple, cells[list(CHANNELS)].to_numpy().tolist()), cells["pid"], strict=True)).get
        out = diffuse(image, own, table[list(CHANNELS)].to_numpy(np.int64), lookup, limit, kernel)
        return cells[["image_id", "y", "x"]].assign(pid=out.ravel())

    return known.groupBy("image_id").cogroup(entries.groupBy("image_id")).applyInPandas(run, "image_id long, y int, x int, pid int")
