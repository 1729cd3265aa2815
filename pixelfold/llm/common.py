"""Helpers shared by the operators: tables cut from their lineage, and hashing expressions."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shipping import ship

__all__ = ["chunks", "discard", "held_out", "new_path", "over_texts", "read", "release", "shared_dir", "ship", "ship_file", "shipped_file", "stored", "unused"]

#: Characters of text that a worker handles at a time.
CHUNK = 1_000_000
#: While a table is written: bytes of rows that go to a Python worker at a time, whatever their number,
#: and shuffle files go when it is done, as the table alone is read from then on.
WRITING = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the setting is absent and Spark runs in one process is a temporary folder made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="pixelfold-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


@contextmanager
def _set(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Writes the rows as Parquet to the shared folder and reads them back.

    The result depends on those files alone, so a lost executor costs no recomputation.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    with _set(spark, WRITING):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(table: DataFrame) -> None:
    """Deletes a stored table that nothing reads any more."""
    made = _made.get(table.sparkSession.sparkContext.applicationId, [])
    for file in table.inputFiles()[:1]:
        path = file.rpartition("/")[0]
        name = path.rpartition("/")[2]
        for p in [p for p in made if p.rpartition("/")[2] == name]:
            made.remove(p)
            _delete(table.sparkSession, p)


def release(spark: SparkSession) -> None:
    """Deletes the tables that :func:`stored` wrote in this application."""
    for path in _made.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether crc32 of the id's text is divisible by 5; false for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until the table has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK characters together."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def arrow_type(name: str):
    import pyarrow as pa

    if name.startswith("array<"):
        return pa.list_(arrow_type(name[6:-1]))
    return {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}[name]


def over_texts(docs: DataFrame, key: str, text: str, columns: str, start: Callable[[], Callable]) -> DataFrame:
    """Rows (key, columns) by a function of lists of whole texts.

    ``start`` makes a task's function. It returns the columns, each a list, and before them None for a
    row a text, or the place of each row's text. Keys of any kind, nulls among them, pass as Arrow
    arrays and stay what they are.
    """
    parts = [c.strip().split(" ") for c in columns.split(",")]
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        one = start()
        kinds = [arrow_type(t) for _, t in parts]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in chunks(texts):
                places, *made = one(texts[lo:hi])
                keys = batch.column(0).slice(lo, hi - lo)
                if places is not None:
                    keys = keys.take(pa.array(places, pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, *[pa.array(c, t) for c, t in zip(made, kinds, strict=True)]], names=["k_", *[c for c, _ in parts]])

    return docs.select(F.col(key).alias("k_"), F.col(text).alias("t_")).mapInArrow(run, f"k_ {kind}, {columns}").withColumnRenamed("k_", key)


def ship_file(spark: SparkSession, path: str) -> str:
    """Sends a file of the driver to the executors; returns the name by which they find it."""
    if "://" in path or os.path.exists(path):
        spark.sparkContext.addFile(path)
    return os.path.basename(path)


def shipped_file(name: str) -> str:
    """Where a file that was sent lies on this machine."""
    from pyspark import SparkFiles

    return SparkFiles.get(name)
