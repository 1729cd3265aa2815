"""Palette quantization by threshold clustering, and by k-means.

Clusters of a histogram are split one after another: the cluster with the largest cost is cut at its
mean along the channel with the largest mean deviation. A palette depends on the histogram alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.color import CHANNELS, rounded


def check_colours(colours: int, strict: bool = True) -> None:
    if not (8 if strict else 4) <= colours <= 256:
        raise ValueError("8 to 256 colours, from 4 without strict")


def cluster_stats(members: DataFrame) -> DataFrame:
    """(image_id, cid, weight, pop, mean r, g, b, a, chn, max_err) of clustered histogram rows."""
    key = ["image_id", "cid"]
    mean = members.groupBy(*key).agg(F.sum("n").alias("weight"), F.count(F.lit(1)).alias("pop"), *[F.sum(F.col(c) * F.col("n")).alias(f"s{c}") for c in CHANNELS])
    mean = mean.select(*key, "weight", "pop", *[rounded(F.col(f"s{c}") / F.col("weight")).alias(f"m{c}") for c in CHANNELS])
    mean = mean.withColumns({f"m{c}": F.when(F.col("ma") == 0, 0).otherwise(F.col(f"m{c}")) for c in "rgb"})
    off = members.join(mean, key).groupBy(*key).agg(*[F.sum(F.abs(F.col(c) - F.col(f"m{c}")) * F.col("n")).alias(f"e{c}") for c in CHANNELS])
    most = F.greatest(*[F.col(f"e{c}") for c in CHANNELS])
    chn = F.when(F.col("er") == most, 0).when(F.col("eg") == most, 1).when(F.col("eb") == most, 2).otherwise(3)
    return mean.join(off, key).select(*key, "weight", "pop", *[f"m{c}" for c in CHANNELS], chn.alias("chn"), rounded(most / F.col("weight")).alias("max_err"))


def split_choice(stats: DataFrame, colours: int) -> DataFrame:
    """(image_id, cid): the cluster to split next; the lowest id of equal costs."""
    n = stats.groupBy("image_id").agg(F.count(F.lit(1)).alias("clusters"))
    cost = F.col("max_err") * F.pow(F.col("weight").cast("double"), F.lit(0.75) - (F.col("clusters") + 0.5) / (2 * colours))
    ranked = stats.filter("pop > 1").join(n, "image_id").withColumn("cost", cost)
    return ranked.groupBy("image_id").agg(F.max(F.struct("cost", (-F.col("cid")).alias("m"))).alias("b")).select("image_id", (-F.col("b.m")).alias("cid"))


def split_once(members: DataFrame, colours: int) -> DataFrame:
    """Relabels the rows of the chosen cluster of each image: those above its mean go to a new one.

    Rows at the mean stay if those above weigh more than those below. A cut that leaves nothing in the
    old cluster is none.
    """
    stats = cluster_stats(members)
    chosen = stats.join(split_choice(stats, colours), ["image_id", "cid"]).select("image_id", "cid", "chn", *[f"m{c}" for c in CHANNELS])
    count = stats.groupBy("image_id").agg(F.count(F.lit(1)).cast("int").alias("new"))
    value = F.element_at(F.array(*CHANNELS), F.col("chn") + 1)
    mean = F.element_at(F.array(*[f"m{c}" for c in CHANNELS]), F.col("chn") + 1)
    marked = members.join(chosen, ["image_id", "cid"], "left").join(count, "image_id").withColumn("side", F.sign(value - mean))
    weights = marked.filter("side IS NOT NULL").groupBy("image_id").agg(
        F.sum(F.when(F.col("side") > 0, F.col("n")).otherwise(0)).alias("above"), F.sum(F.when(F.col("side") < 0, F.col("n")).otherwise(0)).alias("below")
    )
    marked = marked.join(weights, "image_id", "left")
    leaves = (F.col("side") > 0) | ((F.col("side") == 0) & (F.col("above") <= F.col("below")))
    empty = (F.col("below") == 0) & (F.col("above") <= F.col("below"))
    return marked.select("image_id", *CHANNELS, "n", F.when(leaves & ~empty, F.col("new")).otherwise(F.col("cid")).alias("cid"))


def _stats(rgba: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, int, int, int]:
    weight = int(n.sum())
    mean = np.clip(np.rint((rgba * n[:, None]).sum(0) / weight), 0, 255).astype(np.int64)
    if mean[3] == 0:
        mean[:] = 0
    off = (np.abs(rgba - mean) * n[:, None]).sum(0)
    worst = int(off.argmax())
    return mean, weight, worst, int(np.clip(np.rint(off[worst] / weight), 0, 255))


def clusterize(rgba: np.ndarray, n: np.ndarray, colours: int) -> np.ndarray:
    """Cluster of each histogram row."""
    cid = np.zeros(len(n), np.int64)
    stats, stuck = [_stats(rgba, n)], [False]
    while len(stats) < colours:
        power = 0.75 - (len(stats) + 0.5) / (2 * colours)
        best, cost = -1, -1.0
        for k, (_, weight, _, err) in enumerate(stats):
            if not stuck[k] and (here := err * float(weight) ** power) > cost and (cid == k).sum() > 1:
                best, cost = k, here
        if best < 0:
            break
        own = np.flatnonzero(cid == best)
        side = np.sign(rgba[own, stats[best][2]] - stats[best][0][stats[best][2]])
        above, below = n[own[side > 0]].sum(), n[own[side < 0]].sum()
        moved = own[side > 0] if above > below else own[side >= 0]
        if len(moved) == len(own) or not len(moved):
            stuck[best] = True
            continue
        cid[moved] = len(stats)
        stats.append(_stats(rgba[moved], n[moved]))
        left = own[~np.isin(own, moved)]
        stats[best], stuck[best] = _stats(rgba[left], n[left]), False
        stuck.append(False)
    return cid


def colour_index(hist: DataFrame, colours: int, strict: bool = True) -> DataFrame:
    """(image_id, r, g, b, a, n, pid): each colour's cluster. A task holds one image's histogram."""
    check_colours(colours, strict)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(list(CHANNELS))
        pid = clusterize(group[list(CHANNELS)].to_numpy(np.int64), group["n"].to_numpy(np.int64), colours)
        return group.assign(pid=pid.astype(np.int32))

    return hist.groupBy("image_id").applyInPandas(run, "image_id long, r int, g int, b int, a int, n long, pid int")


def palette(indexed: DataFrame) -> DataFrame:
    """(image_id, pid, r, g, b, a, n) from the colours' clusters."""
    stats = cluster_stats(indexed.withColumnRenamed("pid", "cid"))
    return stats.select("image_id", F.col("cid").alias("pid"), *[F.col(f"m{c}").alias(c) for c in CHANNELS], F.col("weight").alias("n"))


def kmeans(x: np.ndarray, w: np.ndarray, colours: int, rounds: int, tol: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, float]:
    """Centres, each row's nearest and the weighted squared distance, from one k-means++ start."""
    centres = x[[rng.choice(len(x), p=w / w.sum())]]
    while len(centres) < min(colours, len(x)):
        d = ((x[:, None] - centres) ** 2).sum(2).min(1) * w
        if d.sum() == 0:
            break
        centres = np.vstack([centres, x[rng.choice(len(x), p=d / d.sum())]])
    for _ in range(rounds):
        near = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        moved = np.array([np.average(x[near == k], axis=0, weights=w[near == k]) if (near == k).any() else c for k, c in enumerate(centres)])
        done = np.abs(moved - centres).max() <= tol
        centres = moved
        if done:
            break
    far = ((x[:, None] - centres) ** 2).sum(2)
    return centres, far.argmin(1), float((far.min(1) * w).sum())


def kmeans_palette(hist: DataFrame, colours: int, rounds: int = 11, tol: float = 1e-3, seed: int = 0, attempts: int = 3) -> DataFrame:
    """(image_id, pid, r, g, b, a, n) by weighted k-means: the best of seeded k-means++ starts."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(list(CHANNELS))
        x, w = group[list(CHANNELS)].to_numpy(np.float64), group["n"].to_numpy(np.float64)
        rng = np.random.default_rng(seed)
        centres, near, _ = min((kmeans(x, w, colours, rounds, tol, rng) for _ in range(attempts)), key=lambda made: made[2])
        out = pd.DataFrame(np.clip(np.rint(centres), 0, 255).astype(np.int32), columns=list(CHANNELS))
        return out.assign(image_id=group["image_id"].iloc[0], pid=np.arange(len(out), dtype=np.int32), n=[int(w[near == k].sum()) for k in range(len(out))])

    return hist.groupBy("image_id").applyInPandas(run, "image_id long, pid int, r int, g int, b int, a int, n long")
