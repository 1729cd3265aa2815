"""Quality classifier: ridge regression on random Fourier features of document statistics.

The statistics of every text are a narrow table. Random Fourier features approximate a Gaussian
kernel over them; each partition of labelled rows adds up its part of the normal equations, those
parts are summed in levels, each of the square root of the parts before, and one small system is solved. Isotonic regression over a histogram
of the training scores turns scores into probabilities. All labelled rows take part; what reaches the
driver depends on the number of features and bins alone.

Defined results: a null or empty text has statistics of zero; a text of any length is measured whole, in
one task; null keys and keys of any kind stay what they are; labels other than 0 and 1 and null
keys are not learnt from; without labels of both classes every score is the share of label 1 (0 if
there are none); repeated rows are scored alike; an empty table gives no rows; other columns play no
part, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_texts, stored

FEATURES = 256
#: Width of the kernel in standard deviations of the statistics, and the ridge per labelled row.
SIGMA = 3.0
RIDGE = 1e-3
BINS = 2000
LOW, HIGH = -0.5, 1.5
STATISTICS = 12
#: Parts of the normal equations that the driver adds up at most.
FEW = 16


def statistics(text: str | None) -> list[float]:
    """What a text looks like, each number of moderate size."""
    if not text:
        return [0.0] * STATISTICS
    words = text.split()
    n, chars = max(1, len(words)), sum(map(len, words)) or 1
    lines = [x for x in text.split("\n") if x.strip()]
    triples = len(words) - 2
    signs = sum(map(text.count, "#*$%&|<>"))
    stops = sum(map(text.count, ".,;:"))
    loud = sum(map(text.count, "!?"))
    return [
        math.log1p(len(words)),
        chars / n,
        min(1.0, signs / chars),
        min(1.0, stops / n),
        min(1.0, loud / n),
        sum(map(str.isupper, words)) / n,
        sum(map(str.isdigit, words)) / n,
        len(set(words)) / n,
        1 - len(set(zip(words, words[1:], words[2:], strict=False))) / triples if triples > 0 else 0.0,
        1 - len(set(lines)) / max(1, len(lines)),
        math.log1p(n / max(1, len(lines))),
        sum(map(str.istitle, words)) / n,
    ]


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, x): the statistics of every whole text."""
    def start():
        return lambda texts: (None, [statistics(t) for t in texts])

    return over_texts(docs, key, text, "x array<double>", start)


class Model:
    """Statistics -> score from 0 to 1."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.turns = rng.normal(0, 1 / SIGMA, (STATISTICS, FEATURES))
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.knots = (np.array([LOW, HIGH]), np.array([0.0, 1.0]))

    def features(self, x: np.ndarray) -> np.ndarray:
        # Far out there is nothing to learn from; the nearest known statistics speak for those.
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(z @ self.turns + self.phase) * np.sqrt(2 / FEATURES), np.ones((len(z), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.knots), 0, 1)


def isotonic(value: np.ndarray, count: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of a rising function through the bins' shares of ones."""
    pools: list[list[float]] = []  # ones, count, sum of count * value
    for v, c, o in zip(value, count, ones, strict=True):
        pools.append([o, c, c * v])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([s / c for _, c, s in pools]), np.array([o / c for o, c, _ in pools])


def fit(rows: DataFrame) -> Model:
    """Learns from rows (x, y)."""
    head = rows.select(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones"), *[f(F.col("x")[i]).alias(f"{name}{i}") for i in range(STATISTICS) for name, f in (("m", F.avg), ("s", F.stddev_pop))]).head()
    known = head["n"] and 0 < head["ones"] < head["n"]
    part = [np.array([head[f"{name}{i}"] or 0.0 for i in range(STATISTICS)]) for name in "ms"]
    model = Model(part[0], np.maximum(part[1], 1e-3))
    if not known:
        share = head["ones"] / head["n"] if head["n"] else 0.0
        model.knots = (np.array([LOW, HIGH]), np.array([share, share]))
        return model
    size = FEATURES + 1
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def equations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            if len(batch):
                z = sent.value.features(np.stack(batch["x"].to_numpy()))
                total[:, :-1] += z.T @ z
                total[:, -1] += z.T @ batch["y"].to_numpy(np.float64)
        if total.any():
            yield pd.DataFrame({"g": [int(total.view(np.int64).sum() % 2**31)], "m": [total.tobytes()]})

    def added(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": group["g"].iloc[:1], "m": [sum(np.frombuffer(m) for m in group["m"]).tobytes()]})

    # A task adds up a square root of the parts at most, and the driver gets as few.
    parts = stored(rows.select("x", "y").mapInPandas(equations, "g long, m binary"), "equations")
    groups = max(1, math.isqrt(parts.count()))
    sums = parts.withColumn("g", F.pmod(F.xxhash64("g"), F.lit(groups))).groupBy("g").applyInPandas(added, "g long, m binary")
    while groups > FEW:
        groups = math.isqrt(groups)
        sums = sums.withColumn("g", F.pmod(F.xxhash64("g"), F.lit(groups))).groupBy("g").applyInPandas(added, "g long, m binary")
    total = sum(np.frombuffer(r["m"]) for r in sums.collect()).reshape(size, size + 1)  # FEW rows at most
    ridge = RIDGE * head["n"] * np.eye(size) / FEATURES
    ridge[-1, -1] = 0
    model.weights = np.linalg.solve(total[:, :-1] + ridge + 1e-9 * np.eye(size), total[:, -1])
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, ones = np.zeros(BINS), np.zeros(BINS)
        for batch in batches:
            if len(batch):
                raw = sent.value.raw(np.stack(batch["x"].to_numpy()))
                at = np.clip(((raw - LOW) / (HIGH - LOW) * BINS).astype(int), 0, BINS - 1)
                count += np.bincount(at, minlength=BINS)
                ones += np.bincount(at, batch["y"].to_numpy(np.float64), BINS)
        at = np.flatnonzero(count)
        yield pd.DataFrame({"b": at, "c": count[at], "o": ones[at]})

    bins = rows.select("x", "y").mapInPandas(binned, "b int, c double, o double").groupBy("b").agg(F.sum("c").alias("c"), F.sum("o").alias("o")).orderBy("b").toPandas()
    model.knots = isotonic(LOW + (bins["b"].to_numpy() + 0.5) * (HIGH - LOW) / BINS, bins["c"].to_numpy(), bins["o"].to_numpy())
    return model


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, score) for every document, learnt from the labels given."""
    table = stored(measured(docs.select(F.col(key).alias("k_"), F.col(text).alias("t_")), "k_", "t_"), "statistics")
    known = labels.select(F.col(key).alias("k_"), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1))
    model = fit(stored(table.join(known, "k_").select("x", "y"), "labelled"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy().reshape(-1, STATISTICS)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.score(x))], names=["k_", "score"])

    return table.select("k_", "x").mapInArrow(run, f"k_ {kind}, score double").withColumnRenamed("k_", key)
