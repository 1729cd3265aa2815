"""Pattern packing of documents into sequences by non-negative least squares.

The lengths' histogram, at most ``limit`` rows, is all that the driver sees. Lengths fall into
classes; patterns are the few-document multisets of classes that fill a sequence well; repeat
counts are fitted to the histogram by non-negative least squares and rounded down; the lengths that
remain go, largest first, into the tightest room. The plan says for runs of equal lengths which
sequences they go to, so its size follows the number of distinct lengths, not the documents.

Defined results: a null or empty text is a document of its end id alone; only a document longer than
``limit`` is cut, whatever its length; repeated rows are documents of their own; null keys and keys of any
kind stay what they are; an empty table gives no rows; other columns play no part, whatever their names.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import over_texts, ship_file, shipped_file, stored
from .tokens import encoder

LIMIT = 4096
#: Length classes, and documents of a pattern at most.
CLASSES = 64
DEEPEST = 4


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that minimises |a x - b|: an active-set search after Lawson and Hanson."""
    ata, atb = a.T @ a, a.T @ b
    x, on = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        w = np.where(on, -np.inf, atb - ata @ x)
        k = int(w.argmax())
        if w[k] <= 1e-9 * max(1.0, float(np.abs(atb).max())):
            break
        on[k] = True
        while True:
            at = np.flatnonzero(on)
            z = np.linalg.lstsq(ata[np.ix_(at, at)], atb[at], rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            low = z <= 0
            step = (x[at][low] / np.maximum(x[at][low] - z[low], 1e-300)).min()
            x[at] += step * (z - x[at])
            on &= x > 1e-12
            x[~on] = 0
            if not on.any():
                break
    return x


def patterns(middles: list[float], limit: int, step: int) -> list[tuple[int, ...]]:
    """Non-increasing class tuples of at most DEEPEST documents whose middle lengths fill a sequence
    but for less than a class."""
    found: list[tuple[int, ...]] = []

    def grow(chosen: tuple[int, ...], room: float, last: int) -> None:
        if chosen and room < step:
            found.append(chosen)
        if len(chosen) < DEEPEST:
            for k in range(last, -1, -1):
                if middles[k] <= room:
                    grow((*chosen, k), room - middles[k], k)

    grow((), limit, len(middles) - 1)
    return found


def plan(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, count, first sequence, offset): the documents of that length with
    ranks from the first on go to sequences from the first on, one each, at the offset."""
    left = {n: c for n, c in histogram.items() if c > 0}
    if any(not 0 < n <= limit for n in left):
        raise ValueError("lengths are from 1 to the limit")
    taken: dict[int, int] = defaultdict(int)
    rows: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # open capacity -> runs (first sequence, count)

    def put(length: int, count: int, sequence: int, offset: int) -> None:
        rows.append((length, taken[length], count, sequence, offset))
        taken[length] += count
        left[length] -= count

    def keep(capacity: int, sequence: int, count: int) -> None:
        if capacity > 0 and count > 0:
            if capacity not in room:
                bisect.insort(open_sizes, capacity)
            room[capacity].append((sequence, count))

    open_sizes: list[int] = []
    if limit in left:
        count = left[limit]
        put(limit, count, sequences, 0)
        sequences += count
    step = max(1, limit // CLASSES)
    classes: dict[int, list[int]] = defaultdict(list)
    for n in sorted(n for n, c in left.items() if c):
        classes[(n - 1) // step].append(n)
    names = sorted(classes)
    if names:
        middles = [k * step + (step + 1) / 2 for k in names]
        shapes = patterns(middles, limit, step)
        if shapes:
            a = np.zeros((len(names), len(shapes)))
            for j, shape in enumerate(shapes):
                for k in shape:
                    a[k, j] += 1
            b = np.array([float(sum(left[n] for n in classes[k])) for k in names])
            scale = 1 / np.sqrt(np.maximum(b, 1))  # so that rare classes are fitted as well
            repeats = np.floor(nnls(a * scale[:, None], b * scale) + 1e-9).astype(int)
            alive = sorted(n for n, c in left.items() if c)
            for shape, times in sorted(zip(shapes, repeats.tolist(), strict=True), key=lambda x: [-k for k in x[0]]):
                while times > 0:
                    lengths, need, free = [], defaultdict(int), limit
                    for k in shape[:-1]:  # the longest of the class, and last the longest that fits
                        n = next((n for n in reversed(classes[names[k]]) if n <= free and left[n] > need.get(n, 0)), 0)
                        if not n:
                            break
                        need[n] += 1
                        free -= n
                        lengths.append(n)
                    i = bisect.bisect_right(alive, free) - 1
                    while i >= 0 and left[alive[i]] <= need.get(alive[i], 0):
                        i -= 1
                    if len(lengths) < len(shape) - 1 or i < 0 or alive[i] < middles[shape[-1]] - 2 * step:
                        break
                    need[alive[i]] += 1
                    lengths.append(alive[i])
                    count = min(times, *(left[n] // m for n, m in need.items()))
                    at = 0
                    for n in lengths:
                        put(n, count, sequences, at)
                        at += n
                    keep(limit - at, sequences, count)
                    sequences += count
                    times -= count
                    for n in need:
                        if not left[n]:
                            alive.remove(n)
    for n in sorted((n for n, c in left.items() if c), reverse=True):
        while left[n]:
            i = bisect.bisect_left(open_sizes, n)
            if i == len(open_sizes):
                each = limit // n
                count = max(1, left[n] // each)
                if left[n] < each:
                    each = left[n]
                for j in range(each):
                    put(n, count, sequences, j * n)
                keep(limit - each * n, sequences, count)
                sequences += count
                continue
            size = open_sizes[i]
            first, count = room[size].pop()
            if not room[size]:
                del room[size]
                open_sizes.pop(i)
            used = min(count, left[n])
            put(n, used, first, limit - size)
            keep(size - n, first, used)
            keep(size, first + used, count - used)
    return rows


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, piece, start, length, ids_crc32, salt): documents as ids with their end id, cut at
    the limit; salt spreads rows evenly, whatever the keys and lengths."""
    name = ship_file(docs.sparkSession, tokenizer)

    def start():
        words, end, row = encoder(shipped_file(name)), end_id.to_bytes(4, "little"), 0

        def cut(texts: list[str | None]) -> tuple:
            nonlocal row
            out = []
            for i, body in enumerate(texts):
                ids = words.encode(body) + end
                for piece, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at : at + 4 * limit]
                    row += 1
                    out.append((i, piece, at // 4, len(part) // 4, zlib.crc32(part), row))
            return tuple(map(list, zip(*out, strict=True))) if out else ([],) * 6

        return cut

    return over_texts(docs, key, text, "piece int, start long, length long, ids_crc32 long, salt long", start).withColumnRenamed(key, "k")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece: key, piece, start, length, ids_crc32, sequence_id and offset."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer, end_id, limit, key, text), "pieces")
    counted = cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most `limit` rows
    rows = plan({r["length"]: r["n"] for r in counted}, limit)
    placed = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    sent = spark.sparkContext.broadcast(placed)
    # Ranks within a length: first within a bucket of rows, so that a common length is no single task.
    total = sum(r["n"] for r in counted)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 100_000 + 1)
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("salt", "k", "piece"), F.lit(buckets)))
    counts = cut.groupBy("bucket", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("bucket", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("bucket", "length").orderBy("k", "piece", "ids_crc32", "start")
    ranked = cut.withColumn("rank", F.row_number().over(within) - 1).join(starts, ["bucket", "length"]).withColumn("rank", F.col("rank") + F.col("first"))

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = sent.value
        # One number for (length, first rank): ranks are below 2**48, lengths below 2**15.
        keys = (table[:, 0] << 48) + table[:, 1]
        for batch in batches:
            rank, length = (batch.column(c).to_numpy().astype(np.int64) for c in ("rank", "length"))
            at = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            made = [pa.array(table[at, 3] + rank - table[at, 1]), pa.array(table[at, 4])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *made], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    kind = docs.schema[key].dataType.simpleString()
    return ranked.select("k", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, f"k {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("k", key)
