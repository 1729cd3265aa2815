"""Connected components of links kept in tables: forests of partitions, and alternating stars.

Each partition replaces its links by a forest that connects the same nodes, without a shuffle. While
there are more of those links than one partition may hold, a round of large and small stars brings
nodes nearer to their smallest ones; once they fit, one task's forest is the result. Nothing is
gathered by node but minima, no link goes to the driver, and every half round is in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Links that a task turns into a forest at a time.
LINKS = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that is not the smallest of its component, and that smallest node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        # A root takes the smallest root that a link of its tree leads to.
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def forests(links: DataFrame, roots: bool = False) -> DataFrame:
    """Links (a, b), b the smaller, that connect what each partition's links connect; with ``roots``
    also a row of each smallest node with itself."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        a, b = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            a, b = (np.concatenate([x, batch.column(i).to_numpy()]) for i, x in ((0, a), (1, b)))
            if len(a) > 2 * LINKS:
                a, b = forest(a, b)
                if len(a) > LINKS:  # a forest by itself; the next rounds join what it shares with others
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                    a, b = a[:0], b[:0]
        a, b = forest(a, b)
        if roots:
            top = np.unique(b)
            a, b = np.concatenate([a, top]), np.concatenate([b, top])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return links.mapInArrow(run, "a long, b long")


def stars(edges: DataFrame) -> DataFrame:
    """A large and a small star round of links (a, b), b the smaller."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    large = stored(large, "large-stars")
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    return large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).head())


def components(links: DataFrame, most: int = LINKS) -> DataFrame:
    """Rows (node, root) for every node of links (a, b), 64-bit numbers: the smallest node that it
    reaches. Nodes that are linked with themselves alone have no row."""
    edges = stored(forests(links.filter("a <> b").select("a", "b")), "forests")
    before = _state(edges)
    while before[0] > most:
        edges = stored(forests(stored(stars(edges), "stars")), "forests")
        after = _state(edges)
        if after == before:  # every node is linked with its smallest one
            return edges.union(edges.select("b", "b").distinct()).toDF("node", "root")
        before = after
    return forests(edges.coalesce(1), roots=True).toDF("node", "root")
