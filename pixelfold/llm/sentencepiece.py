"""SentencePiece encoding and decoding by suffix-array matching.

A batch's distinct chunks (a run of spaces with what follows it) are written one after another and
indexed by a suffix array as deep as the longest piece. Each piece's occurrences are one range of the
array, found by binary search on all pieces at once. Every occurrence is an edge between two places
of its chunk; edges are sorted by where they end and relaxed in that order.

The models at hand are byte-pair models, whose result is no shortest path. So relaxing keeps, for
each end, the edge that the merges would leave last: the one whose piece, behind the piece that ends
where it starts, is left alone by the merges. (In a byte-pair encoding every beginning of the pieces
encodes its own text, and pieces are an encoding when every two neighbours are.) Which neighbours
hold is found by merging the two, once for each pair. Characters without a piece become bytes.

Defined results: a null or empty text has no ids; ids that spell broken UTF-8 decode to U+FFFD; a text of
any length is encoded whole, a run without spaces as one chunk; repeated rows are encoded each; null keys
and keys of any kind stay what they are; an empty table gives no rows; other columns play no part, whatever
their names. A model of another kind, or one that changes texts first, is refused.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_texts, ship_file, shipped_file

#: The sign for a space in pieces, and a code point that no text has.
BLANK, END = "▁", 0x110000
#: Characters of text that are handled at a time, and chunks that a worker remembers.
STEP = 2_000_000
CACHE = 800_000
_RUNS = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer's fields; a message or text as bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = message[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(message):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, message[at : at + size]
        at += size


#: Fixed values of the model format: the fields of the trainer and of the normalizer, of the model's
#: kind and byte-pair among them, of the normalizer's rules, and of a first and of surplus spaces.
TRAINER, NORMALIZER, KIND, BYTE_PAIR, RULES, FIRST, SURPLUS = 2, 3, 3, 2, 2, 3, 4
_checked: set[str] = set()


def check(path: str) -> None:
    """ValueError unless the model is byte-pair with texts taken as they are, a space put before them."""
    if path in _checked:
        return
    with open(path, "rb") as f:
        parts = [(n, dict(fields(m))) for n, m in fields(f.read()) if n in (TRAINER, NORMALIZER)]
    found = dict(parts)
    rules = found.get(NORMALIZER, {})
    if found.get(TRAINER, {}).get(KIND, 1) != BYTE_PAIR:
        raise ValueError(f"{path} is no byte-pair model")
    if rules.get(RULES) or not rules.get(FIRST, 1) or rules.get(SURPLUS, 1):
        raise ValueError(f"{path} changes texts before it splits them")
    _checked.add(path)


class Model:
    """Pieces of a model, and the chunks encoded so far."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.vocab_size()
        names = [sp.id_to_piece(i) for i in range(size)]
        normal = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {names[i]: i for i in normal}
        self.score = {i: sp.get_score(i) for i in normal}
        self.names, self.size = names, size
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = sp.unk_id()
        self.spelled = [n.encode() for n in names]
        for i in range(size):
            if sp.is_control(i):
                self.spelled[i] = b""
        for b, i in enumerate(self.bytes):
            if sp.is_byte(i):
                self.spelled[i] = bytes([b])
        self.fallback = sp.is_byte(self.bytes[0])
        self.cuts_lines = "\n" not in self.ids
        order = sorted(normal, key=lambda i: len(names[i]))
        self.order = np.array(order)
        self.length = np.array([len(names[i]) for i in order])
        self.deepest = int(self.length.max())
        self.letters = np.zeros((len(order), self.deepest), np.int32)
        for row, i in enumerate(order):
            self.letters[row, : len(names[i])] = [ord(c) for c in names[i]]
        self.known_keys, self.known = np.empty(0, np.int64), np.empty(0, bool)
        self.chunks: dict[str, bytes] = {}

    def merge(self, text: str) -> list[int]:
        """Byte-pair merges one after another: highest score first, then leftmost. -1: no piece."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                one = self.ids.get(parts[i] + parts[i + 1])
                if one is not None and (best is None or self.score[one] > best):
                    best, at = self.score[one], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids.get(p, -1) for p in parts]

    def neighbours(self, keys: np.ndarray) -> np.ndarray:
        """For (left + 2) * (size + 2) + right: whether merges leave the two as they are. left is -2
        at a chunk's start; size stands for a character without a piece."""
        if len(self.known_keys):
            at = np.minimum(np.searchsorted(self.known_keys, keys), len(self.known_keys) - 1)
            fresh = np.unique(keys[self.known_keys[at] != keys])
        else:
            fresh = np.unique(keys)
        if len(fresh):
            right, left = fresh % (self.size + 2), fresh // (self.size + 2) - 2
            holds = [self._holds(a, b) for a, b in zip(left.tolist(), right.tolist(), strict=True)]
            place = np.searchsorted(self.known_keys, fresh)
            self.known_keys, self.known = np.insert(self.known_keys, place, fresh), np.insert(self.known, place, holds)
        return self.known[np.searchsorted(self.known_keys, keys)]

    def _holds(self, left: int, right: int) -> bool:
        if right == self.size or left == self.size:
            return right == self.size or self.merge(self.names[right]) == [right]
        if left < 0:
            return self.merge(self.names[right]) == [right]
        return self.merge(self.names[left] + self.names[right]) == [left, right]

    def ranges(self, text: np.ndarray, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and one past the last suffix that begins with each piece."""
        lo, hi = np.zeros(len(self.order), np.int64), np.full(len(self.order), len(suffixes), np.int64)
        for j in range(self.deepest):
            on = np.flatnonzero((self.length > j) & (lo < hi))
            want = self.letters[on, j]
            ends = []
            for past in (False, True):
                a, b = lo[on].copy(), hi[on].copy()
                while (more := a < b).any():
                    mid = (a + b) // 2
                    seen = text[suffixes[np.minimum(mid, len(suffixes) - 1)] + j]
                    low = (seen <= want) if past else (seen < want)
                    a = np.where(more & low, mid + 1, a)
                    b = np.where(more & ~low, mid, b)
                ends.append(a)
            lo[on], hi[on] = ends
        return lo, hi

    def learn(self, fresh: list[str]) -> None:
        """Encodes chunks that are not known yet."""
        size = np.fromiter(map(len, fresh), np.int64, len(fresh))
        start = np.cumsum(size + 1) - size - 1
        n = int((size + 1).sum())
        text = np.full(n + self.deepest + 1, END, np.int32)  # past the end: so that j more can be read
        flat = np.frombuffer("".join(fresh).encode("utf-32-le", "surrogatepass"), np.int32)
        within = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        text[np.repeat(start, size) + within] = flat
        suffixes = suffix_array(text[:n], self.deepest)
        lo, hi = self.ranges(text, suffixes)
        count = np.maximum(hi - lo, 0)
        begin = suffixes[np.repeat(lo, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)]
        piece, length = np.repeat(self.order, count), np.repeat(self.length, count)
        place = np.repeat(start, size) + within
        lone = np.ones(n, bool)
        lone[begin[length == 1]] = False
        lone = place[lone[place]]
        begin = np.concatenate([begin, lone])
        piece = np.concatenate([piece, np.full(len(lone), self.size)])
        length = np.concatenate([length, np.ones(len(lone), np.int64)])
        first = np.zeros(n + 1, np.int64)  # the start of the chunk that a place is in
        first[np.repeat(start, size + 1) + np.arange(n) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)] = np.repeat(start, size + 1)
        stop = begin + length
        # Edges by where they end in their chunk: all chunks are relaxed side by side.
        offset = stop - first[begin]
        order = np.argsort(offset.astype(np.uint16) if size.max(initial=0) < 1 << 16 else offset, kind="stable")
        begin, piece, stop, offset = begin[order], piece[order], stop[order], offset[order]
        last, back = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
        last[start] = -2
        cut = np.searchsorted(offset, np.arange(1, int(size.max(initial=0)) + 2))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            s, t, e = begin[a:b], piece[a:b], stop[a:b]
            ready = last[s] != -1
            s, t, e = s[ready], t[ready], e[ready]
            good = self.neighbours((last[s] + 2) * (self.size + 2) + t)
            last[e[good]], back[e[good]] = t[good], s[good]
        last, back = last.tolist(), back.tolist()
        for chunk, a, m in zip(fresh, start.tolist(), size.tolist(), strict=True):
            ids, at = [], a + m
            while at > a and back[at] >= 0:
                ids.append(last[at] if last[at] < self.size else -1 - (back[at] - a))
                at = back[at]
            if at != a:
                raise ValueError(f"no pieces for {chunk!r}")
            out: list[int] = []
            for i in reversed(ids):
                out += [i] if i >= 0 else self._spell(chunk[-1 - i])
            self.chunks[chunk] = np.array(out, "<u4").tobytes()

    def _spell(self, letter: str) -> list[int]:
        return [self.bytes[b] for b in letter.encode("utf-8", "replace")] if self.fallback else [self.unknown]

    def split(self, text: str | None) -> list[str]:
        """Chunks that no piece crosses, and empty strings."""
        if not text:
            return []
        text = BLANK + text.replace(" ", BLANK)
        if BLANK * 2 in text or "\0" in text:
            return _RUNS.findall(text)
        text = text.replace(BLANK, "\0" + BLANK)
        return (text.replace("\n", "\0\n\0") if self.cuts_lines else text).split("\0")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        held, size = [], 0
        for i, text in enumerate(texts):
            held.append(self.split(text))
            size += len(text or "")
            if size >= STEP or i == len(texts) - 1:
                if len(self.chunks) > CACHE:
                    self.chunks.clear()
                self.chunks[""] = b""
                if fresh := list(set().union(*held) - self.chunks.keys()):
                    self.learn(fresh)
                out += [b"".join(map(self.chunks.__getitem__, x)) for x in held]
                held, size = [], 0
        return out

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.spelled.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace").replace(BLANK, " ")
        return text.removeprefix(" ")


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of what stands there, by the first ``depth`` characters: prefix doubling from
    as many characters as fit into a number. Equal ones stand in any order."""
    letters, code = np.unique(text, return_inverse=True)
    bits = max(1, int(len(letters)).bit_length())
    k = max(1, min(62 // bits, depth))
    rank = np.zeros(len(text), np.int64)
    code = np.concatenate([code + 1, np.zeros(k, np.int64)])
    for j in range(k):
        rank = rank << bits | code[j : j + len(text)]
    while True:
        order = np.argsort(rank)
        step = np.empty(len(text), np.int64)
        step[order] = np.cumsum(np.concatenate([[0], rank[order][1:] != rank[order][:-1]])) if len(text) else 0
        rank = step + 1
        if k >= depth or (len(order) and rank[order[-1]] == len(order)):
            return order
        later = np.zeros(len(text), np.int64)
        later[:-k] = rank[k:]
        rank = rank * (len(text) + 2) + later
        k *= 2


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    """The worker's model of a file."""
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, ids): ids as an array of int."""
    check(path)
    name = ship_file(docs.sparkSession, path)

    def start():
        one = model(shipped_file(name))
        return lambda texts: (None, [np.frombuffer(x, "<u4").astype(np.int32) for x in one.encode(texts)])

    return over_texts(docs, key, text, "ids array<int>", start)


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Rows (key, text) from arrays of ids; an empty text for a null."""
    check(path)
    name = ship_file(encoded.sparkSession, path)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        one = model(shipped_file(name))
        for batch in batches:
            raw = (b"" if x is None else np.asarray(x).astype("<u4").tobytes() for x in batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([one.decode(x) for x in raw], pa.string())], names=["k_", "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(F.col(key).alias("k_"), F.col(ids).alias("i_")).mapInArrow(run, f"k_ {kind}, text string").withColumnRenamed("k_", key)


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_ids, ids_crc32, decoded_crc32, same): encoded, decoded again and compared."""
    check(path)
    name = ship_file(docs.sparkSession, path)

    def start():
        one = model(shipped_file(name))

        def run(texts: list[str | None]) -> tuple:
            rows = []
            for body, ids in zip(texts, one.encode(texts), strict=True):
                again = one.decode(ids)
                rows.append((len(ids) // 4, zlib.crc32(ids), zlib.crc32(again.encode("utf-8", "replace")), again == (body or "").replace(BLANK, " ")))
            return None, *map(list, zip(*rows, strict=True))

        return run

    return over_texts(docs, key, text, "n_ids long, ids_crc32 long, decoded_crc32 long, same boolean", start)
