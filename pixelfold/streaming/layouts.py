"""Layouts as a stream: masks arrive, a keyed state keeps screen and container, each batch is a look.

Adding masks is idempotent and in any order, so late or repeated masks do no harm; the container keeps
what earlier looks had, so it depends on when looks happen. A look that found nothing new repeats the last
result, which the state keeps. A mask that is not on the screen, or whose data is null or of another
length than its sides say, is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..operators.layout import LEAST, check_screen

RESULT = "layout_id long, x1 int, y1 int, x2 int, y2 int, " + ", ".join(f"w{k}_{c} int" for k in (0, 1) for c in ("x1", "y1", "x2", "y2")) + ", flag int, changed boolean"


def container(screen: np.ndarray) -> list[int] | None:
    ys, xs = np.flatnonzero(screen.any(1)), np.flatnonzero(screen.any(0))
    if not len(ys):
        return None
    box = [int(xs[0]), int(ys[0]), int(xs[-1]) + 1, int(ys[-1]) + 1]
    for k in (0, 1):
        need = max(0, LEAST - (box[k + 2] - box[k]))
        take = min(need, box[k])
        box[k] -= take
        box[k + 2] += need - take
    return box


def windows(screen: np.ndarray, box: list[int]) -> tuple[list[int], list[list[int]], int]:
    """The outer box, both windows relative to it, and the flag."""
    h, w = screen.shape
    m = LEAST - 1
    outer = [max(0, box[0] - m), max(0, box[1] - m), min(w, box[2] + m), min(h, box[3] + m)]
    best, found = (box[2] - box[0]) * (box[3] - box[1]), None
    for axis in (1, 0):
        for pos in range(outer[axis] + LEAST, outer[axis + 2] - LEAST + 1):
            pair = []
            for k in (0, 1):
                half = list(outer)
                half[axis + 2 if k == 0 else axis] = pos
                part = screen[half[1] : half[3], half[0] : half[2]]
                lines = [np.flatnonzero(part.any(0)) + half[0], np.flatnonzero(part.any(1)) + half[1]]
                other = 1 - axis
                lo, hi = (int(lines[other][0]), int(lines[other][-1]) + 1) if len(lines[other]) else (1 << 20, -(1 << 20))
                a1 = min(lo, half[other + 2] - LEAST)
                a2 = max(hi, a1 + LEAST)
                lo, hi = (int(lines[axis][0]), int(lines[axis][-1]) + 1) if len(lines[axis]) else (1 << 20, -(1 << 20))
                b2 = max(hi, half[axis] + LEAST)
                b1 = min(lo, b2 - LEAST)
                made = [0] * 4
                made[other], made[other + 2], made[axis], made[axis + 2] = a1, a2, b1, b2
                pair.append(made)
            area = sum((p[2] - p[0]) * (p[3] - p[1]) for p in pair)
            if area < best:
                best, found = area, (pair, axis)
    if found is None:
        pair, flag, outer = [box, box], -1, box
    else:
        pair, flag = found[0], found[1]
    return outer, [[p[i] - outer[i % 2] for i in range(4)] for p in pair], flag


def stream(masks: DataFrame, width: int, height: int) -> DataFrame:
    """Looks of a stream of masks (layout_id, xp, yp, w, h, data, reset BOOLEAN): one row for each
    layout and batch. A row with ``reset`` clears the layout before what follows it in the batch."""
    check_screen(width, height)

    def sound(m) -> bool:
        if any(v is None or v != v for v in (m.xp, m.yp, m.w, m.h)) or m.data is None or isinstance(m.data, float):
            return False
        return 0 <= m.xp <= m.xp + m.w <= width and 0 <= m.yp <= m.yp + m.h <= height and len(m.data) == m.w * m.h

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        screen, box, last = np.zeros((height, width), bool), None, None
        if state.exists:
            bits, last, *old = state.get
            screen = np.unpackbits(np.frombuffer(bits, np.uint8), count=width * height).astype(bool).reshape(height, width)
            box = list(old) if old[2] else None
        before = screen.copy()
        for batch in batches:
            for m in batch.itertuples():
                if m.reset:
                    screen[:], box, last = False, None, None
                elif sound(m):
                    x, y, w, h = (int(v) for v in (m.xp, m.yp, m.w, m.h))
                    screen[y : y + h, x : x + w] |= np.frombuffer(m.data, np.uint8).reshape(h, w) > 0
        now = container(screen)
        if now is None:
            state.remove()
            return
        if box:
            now = [min(a, b) if i < 2 else max(a, b) for i, (a, b) in enumerate(zip(now, box, strict=True))]
        changed = bool((screen != before).any())
        if changed or not last:
            outer, pair, flag = windows(screen, now)
            last = np.array([*outer, *pair[0], *pair[1], flag], np.int32).tobytes()
        state.update((np.packbits(screen).tobytes(), last, *now))
        yield pd.DataFrame([(key[0], *np.frombuffer(last, np.int32).tolist(), changed)], columns=[c.split()[0] for c in RESULT.split(", ")])

    return masks.groupBy("layout_id").applyInPandasWithState(update, RESULT, "screen binary, last binary, x1 int, y1 int, x2 int, y2 int", "update", "NoTimeout")
