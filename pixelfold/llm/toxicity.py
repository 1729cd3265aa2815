"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of itself and its character n-grams between ``<`` and ``>``, each hashed to a row of
an embedding table, so misspellings that were never seen share most vectors with what was. A document
is the average of the vectors of all its words' bags, a word said k times weighing 1 + ln k, so that
junk which says a few words over and over is not judged by those alone; a softmax over it gives its
class. Embeddings, softmax and bias learn together, by the gradient of the class-balanced
log loss over whole documents.

After training the table times the softmax is one number a row, which is all that scoring needs.

Defined results: a null or empty text, or one without letters, has the score of the bias; a text of any
length is scored whole, in one pass; ties and repeated rows are scored alike; null keys and keys of any
kind stay what they are; an empty table gives no rows; without labels of both classes nothing is learnt
and every score is 0; other columns play no part, whatever their names.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_texts

#: Labelled rows that training sees at most, half of each class: the first by a hash of the id among
#: those whose text has at most so many characters, which bounds what the driver holds.
SAMPLE, LONGEST = 4000, 40_000
BUCKETS = 1 << 17
WIDTH = 4
GRAMS = (3, 4, 5)
EPOCHS = 80
#: Steps of the table, the softmax and the bias.
RATES = (30.0, 0.3, 0.3)
#: Words whose sums a worker keeps; emptied when full.
CACHE = 400_000
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def grams(word: str) -> list[int]:
    """Table rows of a word: its own and those of its n-grams."""
    marked = f"<{word}>"
    parts = {marked} | {marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)}
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for p in sorted(parts)]


def weight_of(times: int) -> float:
    """What a word weighs in a text that says it so often."""
    return 1 + math.log(times)


class Bags:
    """Texts as counted words, and distinct words as rows of the table."""

    def __init__(self, texts: list[str | None]):
        ids: dict[str, int] = {}
        flat, count, doc = [], [], []
        for d, text in enumerate(texts):
            for w, k in Counter(words(text)).items():
                flat.append(ids.setdefault(w, len(ids)))
                count.append(weight_of(k))
                doc.append(d)
        lists = [grams(w) for w in ids]
        self.n = np.fromiter(map(len, lists), np.int64, len(lists))
        self.rows = np.fromiter((g for x in lists for g in x), np.int32, int(self.n.sum()))
        self.word_of = np.repeat(np.arange(len(lists), dtype=np.int32), self.n)
        self.flat, self.count, self.doc = np.array(flat, np.int32), np.array(count, np.float64), np.array(doc, np.int32)
        self.docs = len(texts)
        self.size = np.maximum(np.bincount(self.doc, self.count * self.n[self.flat], self.docs), 1)

    def means(self, table: np.ndarray) -> np.ndarray:
        """Vectors of documents."""
        out = np.empty((self.docs, table.shape[1]))
        for k in range(table.shape[1]):
            each = np.bincount(self.word_of, table[self.rows, k], len(self.n))
            out[:, k] = np.bincount(self.doc, self.count * each[self.flat], self.docs) / self.size
        return out

    def back(self, g: np.ndarray) -> np.ndarray:
        """Gradient of the table from that of the documents' vectors."""
        out = np.empty((BUCKETS, g.shape[1]))
        for k in range(g.shape[1]):
            each = np.bincount(self.flat, self.count * (g[:, k] / self.size)[self.doc], len(self.n))
            out[:, k] = np.bincount(self.rows, each[self.word_of], BUCKETS)
        return out


def train(texts: list[str | None], toxic: list[int], seed: int = 7) -> tuple[np.ndarray, float]:
    """One weight a table row, and the bias: class 1 against class 0."""
    y = np.array(toxic)
    if len(set(toxic)) < 2:
        return np.zeros(BUCKETS), -np.inf
    bags = Bags(texts)
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (BUCKETS, WIDTH))
    soft = rng.normal(0, 0.5, (WIDTH, 2))
    bias = np.zeros(2)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    speed, steepest = [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]
    for epoch in range(EPOCHS):
        h = bags.means(table)
        z = h @ soft + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = (p - np.eye(2)[y]) * weight[:, None]
        grads = [bags.back(d @ soft.T), h.T @ d, d.sum(0)]
        for i, (value, rate) in enumerate(zip((table, soft, bias), RATES, strict=True)):
            # Steps shrink with the gradient, so mislabelled rows do not drive them at the end.
            steepest[i] = max(steepest[i], float(np.sqrt((grads[i] ** 2).sum())), 1e-12)
            speed[i] = 0.8 * speed[i] + grads[i] / steepest[i]
            value -= rate * (1 - epoch / EPOCHS) * speed[i]
    return table @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0])


class Scorer(dict):
    """Maps a word to the sum of its rows' weights and their number, as one complex number: both add up
    over a text at once."""

    def __init__(self, weights: np.ndarray, bias: float):
        super().__init__()
        self.weights, self.bias = weights.tolist(), bias

    def __missing__(self, word: str) -> complex:
        if len(self) >= CACHE:
            self.clear()
        rows = grams(word)
        out = self[word] = complex(sum(map(self.weights.__getitem__, rows)), len(rows))
        return out

    def score(self, text: str | None) -> float:
        total = 0j
        for word, k in Counter(words(text)).items():
            total += self[word] if k == 1 else self[word] * weight_of(k)
        z = total.real / max(total.imag, 1.0) + self.bias
        return 1 / (1 + math.exp(-min(max(z, -700.0), 700.0)))


def sample(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str, rows: int = SAMPLE) -> tuple[list, list]:
    """Texts and labels of at most ``rows`` labelled rows, half of each class; of rows with equal keys
    the first text counts."""
    known = labels.select(F.col(key).alias("k_"), F.col(label).cast("int").alias("y_")).filter(F.col("y_").isin(0, 1) & F.col("k_").isNotNull())
    short = docs.select(F.col(key).alias("k_"), F.col(text).alias("t_")).filter(F.coalesce(F.char_length("t_"), F.lit(0)) <= LONGEST)
    order = [F.xxhash64("k_"), "k_"]
    picked = [known.filter(F.col("y_") == y).dropDuplicates(["k_"]).orderBy(*order).limit(rows // 2) for y in (1, 0)]
    got = short.join(F.broadcast(picked[0].union(picked[1])), "k_").groupBy("k_", "y_").agg(F.min("t_").alias("t_")).orderBy("k_", "y_").select("t_", "y_").toPandas()
    return got["t_"].tolist(), got["y_"].tolist()


_scorers: dict[str, Scorer] = {}


def score(docs: DataFrame, weights: np.ndarray, bias: float, key: str = "doc_id", text: str = "text", keep: bool = False, threshold: float = 0.5) -> DataFrame:
    """Rows (key, score); with ``keep`` the documents themselves whose score is below the threshold."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((weights.astype(np.float64), bias))
    name = uuid.uuid4().hex

    def scorer() -> Scorer:
        if name not in _scorers:
            _scorers.clear()
            _scorers[name] = Scorer(*sent.value)
        return _scorers[name]

    def scores():
        one = scorer()
        return lambda texts: (None, [one.score(t) for t in texts])

    def clean(batches: Iterator) -> Iterator:
        import pyarrow as pa

        one = scorer()
        for batch in batches:
            low = [one.score(t) < threshold for t in batch.column(text).to_pylist()]
            yield batch.filter(pa.array(low, pa.bool_()))

    if keep:
        return docs.mapInArrow(clean, docs.schema)
    return over_texts(docs, key, text, "score double", scores)
