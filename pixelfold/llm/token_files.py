"""Token ids in seekable zstandard files: independent frames, a key index and a trailing seek table.

A file holds documents in ascending key order::

    frame ...            one or more zstandard frames per document, ids as little-endian uint32
    skippable 0x184D2A50 index: document count, then per document its key, validity and frame count
    skippable 0x184D2A5E seek table: per frame compressed size, plain size and checksum, then a footer

The seek table is that of the published seekable format: the checksum is the low half of XXH64 over
the plain bytes, the footer has the frame count, a descriptor (bit 7: checksums) and 0x8F92EAB1. So
any zstandard reader can unpack the ids, and :class:`TokenFile` reads only the frames of one document.

Defined results: a null or empty text is its end id alone; a text of any length is as many frames as it
needs; a null key comes first, and other keys, whole numbers of up to 64 bits, stay what they are beside
it (keys of another kind are refused); rows with equal keys follow one another; an empty table makes no
file; other columns play no part, whatever their names.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, ship_file, shipped_file, stored
from .tokens import encoder

INDEX, SEEK, FOOTER = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
#: Plain bytes of a frame at most, and bytes of text for a file.
FRAME = 1 << 20
FILE = 256 << 20


def filesystem(path: str):
    """A file system for a path or URI, and the path in it."""
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


class TokenFile:
    """Reads documents of one file by their place or key."""

    def __init__(self, path: str):
        import zstandard

        system, inner = filesystem(path)
        self._in = system.open_input_file(inner)
        self._unpack = zstandard.ZstdDecompressor().decompress
        size = self._in.size()
        frames, flags, magic = struct.unpack("<IBI", self._in.read_at(9, size - 9))
        if magic != FOOTER or not flags & 0x80:
            raise ValueError(f"{path}: no seek table with checksums")
        table = size - 9 - 12 * frames
        entries = np.frombuffer(self._in.read_at(12 * frames, table), "<u4").reshape(-1, 3)
        self._packed, self._plain, self._check = entries.T
        self._at = np.concatenate([[0], np.cumsum(self._packed, dtype=np.int64)])
        start = int(self._at[-1])
        magic, length = struct.unpack("<II", self._in.read_at(8, start))
        if magic != INDEX or struct.unpack("<I", self._in.read_at(4, table - 8))[0] != SEEK:
            raise ValueError(f"{path}: no index")
        body = self._in.read_at(length, start + 8)
        (n,) = struct.unpack_from("<Q", body)
        self.keys = np.frombuffer(body, "<i8", n, 8)
        self.valid = np.frombuffer(body, "u1", n, 8 + 8 * n).astype(bool)
        self._first = np.concatenate([[0], np.cumsum(np.frombuffer(body, "<u4", n, 8 + 9 * n), dtype=np.int64)])
        self.tokens = np.add.reduceat(self._plain.astype(np.int64), self._first[:-1]) // 4 if n else np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.keys)

    def raw(self, i: int) -> bytes:
        """The ids of the i-th document as bytes; its frames alone are read and verified."""
        import xxhash

        out = []
        for f in range(self._first[i], self._first[i + 1]):
            plain = self._unpack(self._in.read_at(int(self._packed[f]), int(self._at[f])), max_output_size=int(self._plain[f]))
            if len(plain) != self._plain[f] or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self._check[f]:
                raise ValueError(f"frame {f} is damaged")
            out.append(plain)
        return b"".join(out)

    def find(self, key: int) -> list[np.ndarray]:
        """The ids of each document with the key."""
        nulls = int((~self.valid).sum())  # they come first
        lo, hi = (nulls + int(np.searchsorted(self.keys[nulls:], key, side=s)) for s in ("left", "right"))
        return [np.frombuffer(self.raw(i), "<u4") for i in range(lo, hi)]


class Writer:
    """Writes one file; it takes its name when complete, so that a lost task leaves none."""

    def __init__(self, folder: str, name: str):
        self.system, inner = filesystem(folder)
        self.system.create_dir(inner, recursive=True)
        self.final, self.now = f"{inner}/{name}", f"{inner}/.{name}.{uuid.uuid4().hex}"
        self.out = self.system.open_output_stream(self.now)
        self.entries: list[tuple[int, int, int]] = []
        self.keys: list[int | None] = []
        self.frames: list[int] = []

    def add(self, key: int | None, part: int, packed: bytes, plain: int, check: int) -> None:
        self.out.write(packed)
        self.entries.append((len(packed), plain, check))
        if part == 0:
            self.keys.append(key)
            self.frames.append(0)
        self.frames[-1] += 1

    def close(self) -> tuple[int, int]:
        """Documents and ids written."""
        n = len(self.keys)
        keys = np.array([k or 0 for k in self.keys], "<i8").tobytes() + bytes(k is not None for k in self.keys)
        body = struct.pack("<Q", n) + keys + np.array(self.frames, "<u4").tobytes()
        table = np.array(self.entries, "<u4").reshape(-1, 3).tobytes() + struct.pack("<IBI", len(self.entries), 0x80, FOOTER)
        for magic, content in ((INDEX, body), (SEEK, table)):
            self.out.write(struct.pack("<II", magic, len(content)) + content)
        self.out.close()
        self.system.move(self.now, self.final)
        return n, sum(plain for _, plain, _ in self.entries) // 4


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the files; returns their list: file, name, documents, tokens and start (ids before)."""
    spark = docs.sparkSession
    if docs.schema[key].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError("keys of token files are whole numbers")
    name = ship_file(spark, tokenizer)
    docs = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    # As many files as the bytes of text ask for, the shuffle's partitions at least.
    sized = docs.select("k", F.coalesce(F.octet_length("t"), F.lit(0)).alias("b"))
    files = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(sized.agg(F.sum("b")).head()[0] or 0) // FILE))
    cuts = sized.agg(F.percentile_approx("k", [i / files for i in range(1, files)] or [0.5], F.lit(20 * files))).head()[0]
    bounds = spark.sparkContext.broadcast(np.array(sorted(set(cuts or []))[: files - 1], np.int64))

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash
        import zstandard

        words, end, row = encoder(shipped_file(name)), end_id.to_bytes(4, "little"), 0
        shrink = zstandard.ZstdCompressor(level=1).compress
        names = ["file", "k", "row", "part", "packed", "plain", "check"]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
        for batch in batches:
            out, held = [], 0
            keys = batch.column(0)
            null = keys.is_null().to_numpy(zero_copy_only=False)
            file = np.where(null, 0, np.searchsorted(bounds.value, keys.fill_null(0).to_numpy(), side="left"))
            for one, at, body in zip(keys.to_pylist(), file.tolist(), batch.column(1).to_pylist(), strict=True):
                ids = words.encode(body) + end
                row += 1
                for part, i in enumerate(range(0, len(ids), FRAME)):
                    plain = ids[i : i + FRAME]
                    out.append((at, one, row, part, shrink(plain), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
                    held += len(out[-1][4])
                if held > 8 * FRAME:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def save(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, at, done = None, -1, []
        for batch in batches:
            for file, one, part, packed, plain, check in zip(*[batch.column(c).to_pylist() for c in ("file", "k", "part", "packed", "plain", "check")], strict=True):
                if file != at:
                    if now:
                        done.append((at, f"{at:06d}.ids.zst", *now.close()))
                    now, at = Writer(folder, f"{file:06d}.ids.zst"), file
                now.add(one, part, packed, plain, check)
        if now:
            done.append((at, f"{at:06d}.ids.zst", *now.close()))
        kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(kinds)], names=["file", "name", "documents", "tokens"])

    frames = docs.mapInArrow(encode, "file int, k long, row long, part int, packed binary, plain long, check long")
    dealt = frames.repartition(files, "file").sortWithinPartitions("file", F.col("k").asc_nulls_first(), "row", "part")
    listed = stored(dealt.mapInArrow(save, "file int, name string, documents long, tokens long"), "token-list")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return listed.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_back(spark: SparkSession, listed: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """A row for each document of the files: key, start, n_tokens and the ids' crc32."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, start in zip(batch["name"], batch["start"], strict=True):
                file = TokenFile(f"{folder}/{name}")
                starts = start + np.cumsum(file.tokens) - file.tokens
                for lo in range(0, len(file), 4096):
                    at = range(lo, min(len(file), lo + 4096))
                    yield pd.DataFrame({
                        "k": pd.array([int(file.keys[i]) if file.valid[i] else None for i in at], dtype="Int64"),
                        "start": starts[at.start : at.stop], "n_tokens": file.tokens[at.start : at.stop], "ids_crc32": [zlib.crc32(file.raw(i)) for i in at],
                    })

    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return listed.select("file", "name", "start").repartition(tasks, "file").mapInPandas(scan, "k long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("k", key)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Writes the documents' ids to files and returns what the files hold."""
    folder = folder or new_path(docs.sparkSession, "token-files")
    return read_back(docs.sparkSession, write(docs, folder, tokenizer, end_id, key, text), folder, key)
