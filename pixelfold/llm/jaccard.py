"""N-gram Jaccard join by a token-group matrix: which texts are linked, and their components.

A document's set holds the 64-bit hashes of its distinct word shingles. Equal sets are one set from
then on. The rest is exact:

1. *Signatures.* From ``PARTS`` per cent on: two linked sets of sizes within a class differ in at most D
   tokens, so of D + 1 parts of the token universe one is the same in both. Each set says, by one hash a
   part, what it holds there; some parts more make up for those that are empty. Below, parts would hold
   a token or two, so a set's signatures are its rarest tokens, as many as two linked sets cannot both
   miss; how rare a token is comes from counts over all documents, in a table of fixed size, which only
   settles the order. Either way linked sets share a signature.
2. *Groups.* A set goes to the group of its signature with most company, so similar sets meet there;
   groups are cut by size and into chunks of bounded tokens. A group's column of the matrix holds its
   sets, the union of their tokens and the components that its own links make: common tokens of all its
   pairs at once are a product of two 0/1 matrices. Where one signature's sets fill several groups,
   the groups' largest components are first held against a few centres, so that a large class of
   copies is one component before its groups would be compared pairwise.
3. *Matrix.* Where a signature joins sets of several components still, its groups query one another, a
   group's sets at a time. Bits of each set, a hundredth of its tokens, first tell which groups can have
   a link at all, and only those meet; then a set queries a group only if the group's union holds enough
   of its tokens for a link with a set of the group's smallest size, and a group that no set queries is
   not opened. Only sets that pass from both sides are compared.

Links between sets of one component are not looked for again: they change no component.

Defined results: a null text, or one without words, has an empty set, no links and its own id as
component; fewer words than a shingle are one shingle; null keys stay rows, and a component's id is
its smallest non-null key; repeated rows are copies of one another; an empty table gives no rows;
other columns play no part, whatever their names. A text of any length is one set; a very long one is a
group of its own. What a task holds is bounded by one text or one group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, discard, over_texts, stored, unused
from .graphs import components

#: From this threshold on signatures are of parts. Sizes of a class grow by this factor.
PARTS = 85
CLASS = 1.5
#: Counters of the table of token counts, in slices that are added up apart.
COUNTERS, SLICES = 1 << 23, 32
#: Sets and tokens of a group at most, on average; a group's sizes differ by this factor at most.
GROUP, TOKENS = 512, 250_000
ALIKE = 1.25
#: Centres of a signature that its groups' largest components are held against.
CENTRES = 32
#: Candidate sets up to this many are broadcast by id if ids are numbers, others joined by a shuffle.
BROADCAST = 500_000
#: Cells of a 0/1 matrix, and bytes of a batch of columns.
CELLS, BATCH = 2_000_000, 4_000_000
#: Sets that a task has met, whose signatures it does not say again; forgotten when so many.
MET = 1_000_000
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def token_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    import xxhash

    lists = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    ends = np.cumsum(n)
    h = np.fromiter((xxhash.xxh64_intdigest(w) for x in lists for w in x), np.uint64, int(ends[-1]) if len(ends) else 0)
    chained = mix(h + _A)
    for k in range(1, size):
        chained = mix(chained[:-1] * _B + h[k:] + mix(np.array([k], np.uint64))) if len(chained) > 1 else chained[:0]
    out = []
    for end, m in zip(ends.tolist(), n.tolist(), strict=True):
        if m >= size:
            out.append(np.unique(chained[end - m : end - size + 1]))
        elif m:
            one = np.array([m], np.uint64)
            for i in range(end - m, end):
                one = mix(one * _B + h[i : i + 1])
            out.append(one)
        else:
            out.append(np.empty(0, np.uint64))
    return out


class Levels:
    """Size classes and how many parts the sets of each are cut into."""

    def __init__(self, percent: int):
        self.t = percent / 100
        self.low = [1]
        while self.low[-1] < 1 << 40:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * max(CLASS, 1 / self.t))))

    def of(self, n: int) -> list[int]:
        """Levels of a set: its class, and the next one if a partner can lie there."""
        k = int(np.searchsorted(self.low, n, side="right")) - 1
        # floor(n / t) is the largest partner
        return [k, k + 1] if math.floor(n / self.t + 1e-9) >= self.low[k + 1] else [k]

    def parts(self, k: int) -> tuple[int, int]:
        """Parts at a level, and how many empty ones they allow for."""
        largest = self.low[k + 1] - 1
        differ = math.floor(2 * largest * (1 - self.t) / (1 + self.t) + 1e-9)
        if differ == 0:
            return 1, 0
        smallest = max(1, math.ceil(self.low[k] * self.t))
        spare = 0
        while True:
            m = differ + 1 + spare
            expected = m * math.exp(-smallest / m)
            need = math.ceil(expected + 4 * math.sqrt(expected) + 1)
            if need <= spare or spare >= differ:
                return m, spare
            spare = need if need > spare else spare + 1


_levels: dict[int, Levels] = {}


def signatures(tokens: np.ndarray, levels: Levels) -> np.ndarray:
    out = []
    for k in levels.of(len(tokens)):
        m, spare = levels.parts(k)
        if m == 1:
            sums, full = np.array([tokens.sum(dtype=np.uint64)]), np.ones(1, bool)
        else:
            part = (mix(tokens + _C) % np.uint64(m)).astype(np.int64)
            sums = np.zeros(m, np.uint64)
            np.add.at(sums, part, mix(tokens * _A + _B))
            full = np.bincount(part, minlength=m) > 0
        label = mix(np.arange(m, dtype=np.uint64) + np.uint64((k + 1) << 32))
        made = mix(sums ^ label)
        # With few empty parts, a full one is the same in both sets; else empty ones count too.
        out.append(made[full] if (~full).sum() <= spare else made)
    return np.concatenate(out).view(np.int64)


def rarest(tokens: np.ndarray, percent: int, counted: np.ndarray) -> np.ndarray:
    """The prefix of a set in the order of its tokens' counts: linked sets' prefixes meet."""
    keep = len(tokens) - -(-percent * len(tokens) // 100) + 1
    order = np.lexsort((tokens, counted[tokens & np.uint64(COUNTERS - 1)]))
    return tokens[order[:keep]].view(np.int64)


def token_counts(docs: DataFrame, size: int, key: str, text: str) -> np.ndarray:
    """How many documents hold a token, over all documents; tokens share counters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        total, first = np.zeros(COUNTERS, np.uint32), 0
        for batch in batches:
            texts = batch["t"].tolist()
            for lo, hi in chunks(texts):
                for tokens in token_sets(texts[lo:hi], size):
                    if len(tokens) and not first:
                        first = 1 + int(tokens[0] >> np.uint64(8)) % 64  # spreads the sums over some tasks
                    np.add.at(total, (tokens & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
        if first:
            pack = zstandard.ZstdCompressor(level=1).compress
            yield pd.DataFrame({"j": range(SLICES), "m": first, "c": [pack(x.tobytes()) for x in np.split(total, SLICES)]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        total = np.zeros(COUNTERS // SLICES, np.uint64)
        for c in group["c"]:
            total += np.frombuffer(zstandard.ZstdDecompressor().decompress(c), np.uint32)
        packed = zstandard.ZstdCompressor(level=1).compress(np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes())
        return pd.DataFrame({"j": group["j"].iloc[:1], "m": [0], "c": [packed]})

    shape = "j int, m int, c binary"
    parts = docs.select(F.col(text).alias("t")).mapInPandas(run, shape).groupBy("j", "m").applyInPandas(add, shape).groupBy("j").applyInPandas(add, shape).collect()
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    out = np.zeros(COUNTERS, np.uint16)
    wide = COUNTERS // SLICES
    for r in parts:  # logarithms keep the order of what two bytes can tell apart
        out[r["j"] * wide : (r["j"] + 1) * wide] = np.round(2048 * np.log2(1.0 + np.frombuffer(unpack(r["c"]), np.uint32)))
    return out


def name_of(tokens: np.ndarray) -> int | None:
    """A set's 64-bit name."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(tokens.tobytes())).view(np.int64)) if len(tokens) else None


def tokenized(docs: DataFrame, percent: int, size: int, key: str, text: str) -> DataFrame:
    """Rows (k, n, h, sigs): key, set size, the set's name and its signatures, which a task says only
    once for equal sets."""
    sent = None if percent >= PARTS else docs.sparkSession.sparkContext.broadcast(token_counts(docs, size, key, text))

    def signed(tokens: np.ndarray) -> np.ndarray:
        if sent is not None:
            return rarest(tokens, percent, sent.value)
        return signatures(tokens, _levels.setdefault(percent, Levels(percent)))

    def start():
        met: set[int] = set()

        def run(texts: list[str | None]) -> tuple:
            sets = token_sets(texts, size)
            names, sigs = [name_of(s) for s in sets], []
            for h, s in zip(names, sets, strict=True):
                sigs.append(signed(s) if h is not None and h not in met else [])
                if len(met) >= MET:
                    met.clear()
                met.add(h)
            return None, [len(s) for s in sets], names, sigs

        return run

    return over_texts(docs, key, text, "n long, h long, sigs array<bigint>", start).withColumnRenamed(key, "k")


def candidate_texts(docs: DataFrame, wanted: DataFrame, size: int, key: str, text: str, few: bool) -> DataFrame:
    """Rows (h, gid, home, split, t) for the wanted (k, h, gid, home, split): texts of those keys, of which
    a key can have several, so that the set's name still has to be compared."""
    group = ("h", "gid", "home", "split")

    def named(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo, hi in chunks(texts):
                names = [name_of(s) for s in token_sets(texts[lo:hi], size)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), batch.column(0).slice(lo, hi - lo)], names=["h", "t"])

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few else df

    body = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    out = body.join(side(wanted), "k").select(*group, "t")
    bare = wanted.filter("k IS NULL")
    if bare.isEmpty():
        return out
    # Rows without a key are found by their sets' names, not paired with one another.
    unkeyed = body.filter("k IS NULL").select("t").mapInArrow(named, "h long, t string").dropDuplicates(["h"])
    return out.union(unkeyed.join(side(bare.select(*group)), "h").select(*group, "t"))


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many tokens each set on the left shares with each on the right: 0/1 matrices over the
    tokens that both sides hold, multiplied a slice of tokens at a time."""
    sides = [np.concatenate(s) for s in (left, right)]
    rows = [np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (left, right)]
    if left is right:
        tokens, count = np.unique(sides[0], return_counts=True)
        tokens = tokens[count > 1]
    else:
        tokens = np.intersect1d(*sides)
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(tokens):
        return out.astype(np.int64)
    placed = []
    for flat, row in zip(sides, rows, strict=True):
        at = np.minimum(np.searchsorted(tokens, flat), len(tokens) - 1)
        held = tokens[at] == flat
        order = np.argsort(at[held], kind="stable")
        placed.append((at[held][order], row[held][order]))
    wide = max(64, CELLS // (len(left) + len(right)))
    for lo in range(0, len(tokens), wide):
        cells = []
        for (at, row), n in zip(placed, out.shape, strict=True):
            first, last = np.searchsorted(at, (lo, lo + wide))
            one = np.zeros((n, min(wide, len(tokens) - lo)), np.float32)
            one[row[first:last], at[first:last] - lo] = 1
            cells.append(one)
        out += cells[0] @ cells[1].T
    return out.astype(np.int64)


def linked(same: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sets are linked, from their common tokens and their sizes."""
    return 100 * same >= percent * (n[:, None] + m[None, :] - same)


def smallest_reached(link: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links the smallest row that it reaches."""
    at = np.arange(len(link))
    while True:
        new = np.minimum(np.where(link, at[None, :], len(at)).min(1), at)
        new = new[new]
        if (new == at).all():
            return at
        at = new


def parity(tokens: np.ndarray) -> bytes:
    """A set's bits, about as many as it has tokens: of how many tokens each place has, whether odd.

    Two sets differ in as many tokens at least as their bits differ."""
    wide = max(64, 1 << (len(tokens) - 1).bit_length())
    return np.packbits(np.bincount((mix(tokens) & np.uint64(wide - 1)).astype(np.int64), minlength=wide) & 1 == 1).tobytes()


def folded(bits: bytes, wide: int) -> np.ndarray:
    """The bits as they would be with no more than so many places."""
    out = np.unpackbits(np.frombuffer(bits, np.uint8))
    while len(out) > wide:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def can_link(one: tuple, other: tuple, percent: int) -> bool:
    """Whether the bits of two groups (labels, sizes, bits) allow a link between components."""
    sides = [(np.array(label), np.array(n, np.int64), np.array([len(b) * 8 for b in bits]), bits) for label, n, bits in (one, other)]
    for x in np.unique(sides[0][2]):
        for y in np.unique(sides[1][2]):
            at = [np.flatnonzero(side[2] == z) for side, z in zip(sides, (x, y), strict=True)]
            flat = [np.stack([folded(side[3][i], min(x, y)) for i in rows]).astype(np.float32) for side, rows in zip(sides, at, strict=True)]
            differ = flat[0].sum(1)[:, None] + flat[1].sum(1)[None, :] - 2 * (flat[0] @ flat[1].T)
            n = sides[0][1][at[0]][:, None] + sides[1][1][at[1]][None, :]
            apart = sides[0][0][at[0]][:, None] != sides[1][0][at[1]][None, :]
            if (apart & (differ.astype(np.int64) * (100 + percent) <= n * (100 - percent))).any():
                return True
    return False


def made_columns(dealt: DataFrame, percent: int, size: int) -> DataFrame:
    """The matrix's columns from texts sorted by group: the group, its sets' names, components, sizes and
    bits, their tokens, and the tokens' union (null where one set is all)."""
    shape = "gid long, home long, split boolean, h array<bigint>, label array<bigint>, n array<bigint>, bits array<binary>, tokens binary, held binary"

    def column(gid: int, home: int, split: bool, rows: dict[int, bytes]) -> tuple:
        h = np.array(sorted(rows), np.int64)
        sets = [np.frombuffer(rows[x], np.uint64) for x in h.tolist()]
        n = np.array([len(s) for s in sets], np.int64)
        label, held = h, None
        if len(sets) > 1:
            label = h[smallest_reached(linked(common(sets, sets), n, n, percent) | np.eye(len(h), dtype=bool))]
            held = np.unique(np.concatenate(sets)).tobytes()
        return gid, home, split, h, label, n, [parity(x) for x in sets], b"".join(rows[x] for x in h.tolist()), held

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = [pa.int64(), pa.int64(), pa.bool_(), *[pa.list_(pa.int64())] * 3, pa.list_(pa.binary()), pa.binary(), pa.binary()]
        names = [c.strip().split(" ")[0] for c in shape.split(",")]
        out: list[tuple] = []
        size_now, now, rows = 0, None, {}

        def ready() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        def sets_of(batch) -> Iterator[tuple]:
            texts = batch.column("t").to_pylist()
            groups = [batch.column(c).to_pylist() for c in ("gid", "home", "split", "h")]
            for lo, hi in chunks(texts):
                sets = token_sets(texts[lo:hi], size)
                yield from ((gid, home, split, h, s.tobytes()) for gid, home, split, h, s in zip(*[g[lo:hi] for g in groups], sets, strict=True) if name_of(s) == h)

        for batch in batches:
            for gid, home, split, h, tokens in sets_of(batch):
                if now is None or gid != now[0]:
                    if now is not None:
                        out.append(column(*now, rows))
                        size_now += 3 * len(out[-1][7])
                        if size_now > BATCH:
                            yield ready()
                            out, size_now = [], 0
                    now, rows = (gid, home, split), {}
                rows[h] = tokens
        if now is not None:
            out.append(column(*now, rows))
            yield ready()

    return dealt.mapInArrow(run, shape)


def centred(columns: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of components by their labels: of each cut-up signature's groups the largest
    component's first set against the first of those sets that are like none before."""

    def largest(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for home, label, n, tokens in zip(*[batch.column(c).to_pylist() for c in ("home", "label", "n", "tokens")], strict=True):
                names, count = np.unique(label, return_counts=True)
                one = names[count.argmax()]
                at = label.index(one)
                start = 8 * sum(n[:at])
                rows.append((home, int(one), tokens[start : start + 8 * n[at]]))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 3, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["home", "label", "tokens"])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, centres = None, []
        for batch in batches:
            found = []
            for home, label, tokens in zip(*[batch.column(c).to_pylist() for c in ("home", "label", "tokens")], strict=True):
                if home != now:
                    now, centres = home, []
                one = np.frombuffer(tokens, np.uint64)
                for name, other in centres:
                    if 100 * min(len(one), len(other)) >= percent * max(len(one), len(other)):
                        same = len(np.intersect1d(one, other, assume_unique=True))
                        if 100 * same >= percent * (len(one) + len(other) - same):
                            found.append((label, name))
                            break
                else:
                    if len(centres) < CENTRES:
                        centres.append((label, one))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    reps = columns.filter("split").select("home", "label", "n", "tokens").mapInArrow(largest, "home long, label long, tokens binary")
    return reps.repartition("home").sortWithinPartitions("home", "label").mapInArrow(run, "a long, b long")


class Column:
    """A group as read back."""

    def __init__(self, h: list[int], label: list[int], n: list[int], tokens: bytes, held: bytes | None):
        self.label, self.n = np.array(label, np.int64), np.array(n, np.int64)
        self.flat = np.frombuffer(tokens, np.uint64)
        self.sets = np.split(self.flat, np.cumsum(self.n)[:-1])
        self.held = self.flat if held is None else np.frombuffer(held, np.uint64)

    def overlap(self, other: "Column") -> np.ndarray:
        """How many tokens of each of its sets the other group holds."""
        at = np.minimum(np.searchsorted(other.held, self.flat), len(other.held) - 1)
        return np.add.reduceat(other.held[at] == self.flat, np.cumsum(self.n) - self.n, dtype=np.int64)


def found_between(one: Column, other: Column, percent: int) -> set[tuple[int, int]]:
    """Components (by label) of two groups that a link joins: each set queries the other group, and the
    sets of both sides whose bounds allow a link are compared."""
    asking = []
    for q, c in ((one, other), (other, one)):
        most, least = q.overlap(c), np.maximum(c.n.min(), -(-percent * q.n // 100))
        asking.append(np.flatnonzero(100 * most >= percent * (q.n + least - most)))
        if not len(asking[-1]):
            return set()
    left, right = ([c.sets[i] for i in at] for c, at in zip((one, other), asking, strict=True))
    hit = linked(common(left, right), one.n[asking[0]], other.n[asking[1]], percent)
    i, j = np.nonzero(hit & (one.label[asking[0]][:, None] != other.label[asking[1]][None, :]))
    return set(zip(one.label[asking[0]][i].tolist(), other.label[asking[1]][j].tolist(), strict=True))


def asked_of(columns: DataFrame, pairs: DataFrame) -> DataFrame:
    """The columns of groups that the pairs name."""
    asked = stored(pairs.select("g").union(pairs.select("other")).distinct().withColumnRenamed("g", "gid"), "asked")
    return columns.join(F.broadcast(asked) if asked.count() <= BROADCAST else asked, "gid", "left_semi")


def possible(pairs: DataFrame, columns: DataFrame, percent: int) -> DataFrame:
    """Those pairs of groups (g, other) whose bits allow a link, before any tokens are moved."""
    parts = ("label", "n", "bits")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sides = [list(zip(*[batch.column(f"{c}{x}").to_pylist() for c in parts], strict=True)) for x in ("", "2")]
            keep = [can_link(a, b, percent) for a, b in zip(*sides, strict=True)]
            yield batch.select(["g", "other"]).filter(pa.array(keep, pa.bool_()))

    columns = asked_of(columns, pairs)
    first = columns.select(F.col("gid").alias("g"), *parts)
    second = columns.select(F.col("gid").alias("other"), *[F.col(c).alias(f"{c}2") for c in parts])
    return pairs.join(first, "g").join(second, "other").select("g", "other", *parts, *[f"{c}2" for c in parts]).mapInArrow(run, "g long, other long")


def opened(pairs: DataFrame, columns: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the components of pairs of groups (g, other)."""
    parts = ("h", "label", "n", "tokens", "held")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found: set[tuple[int, int]] = set()
            for i in range(batch.num_rows):
                one, other = (Column(*[batch.column(f"{c}{x}")[i].as_py() for c in parts]) for x in ("", "2"))
                found |= found_between(one, other, percent)
            listed = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in listed], pa.int64()) for i in (0, 1)], names=["a", "b"])

    columns = asked_of(columns, pairs)
    first = columns.select(F.col("gid").alias("g"), *parts)
    second = columns.select(F.col("gid").alias("other"), *[F.col(c).alias(f"{c}2") for c in parts])
    both = pairs.join(first, "g").join(second, "other")
    return both.select(*parts, *[f"{c}2" for c in parts]).mapInArrow(run, "a long, b long")


def queries(hits: DataFrame, columns: DataFrame, leaders: DataFrame | None, percent: int) -> DataFrame:
    """Pairs of groups (g, other) that share a signature whose sets are of several components."""
    sets = columns.select("gid", F.array_min("n").alias("least"), F.array_max("n").alias("most"), F.explode(F.arrays_zip("h", "label")).alias("s"))
    sets = sets.select("gid", "least", "most", F.col("s.h").alias("h"), F.col("s.label").alias("label"))
    if leaders is not None:
        sets = sets.join(leaders.withColumnRenamed("a", "label"), "label", "left").withColumn("label", F.coalesce("b", "label")).drop("b")
    listed = hits.select("h", "sig").join(sets, "h").groupBy("sig", "gid", "least", "most").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    listed = stored(listed, "listed")
    mixed = listed.groupBy("sig").agg(F.min("lo").alias("_lo"), F.max("hi").alias("_hi"), F.min("gid").alias("_a"), F.max("gid").alias("_b"))
    mixed = mixed.filter("_lo <> _hi AND _a <> _b").select("sig")
    asking = stored(listed.join(mixed, "sig"), "mixed")
    other = asking.select("sig", *[F.col(c).alias(f"{c}2") for c in ("gid", "least", "most", "lo", "hi")])
    apart = "NOT (lo = hi AND lo2 = hi2 AND lo = lo2)"
    near = (F.col("most") * 100 >= percent * F.col("least2")) & (F.col("most2") * 100 >= percent * F.col("least"))
    pairs = asking.join(other, "sig").filter("gid < gid2").filter(apart).filter(near)
    return stored(pairs.select(F.col("gid").alias("g"), F.col("gid2").alias("other")).distinct(), "queries")


def links(docs: DataFrame, sets: DataFrame, percent: int, size: int, key: str, text: str) -> tuple[DataFrame, DataFrame | None] | None:
    """From the stored sets, which go once they have been asked for company: the sets with company and the label of their group's component (h, label), and the labels that are
    not the smallest of theirs (node, root); None if no two sets can be linked."""
    spread = sets.filter("n > 0").select("h", "n", "k", F.explode("sigs").alias("sig"))
    # A count alone, as it is one of every signature: copies that several tasks met count as company.
    shared = spread.groupBy("sig").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    hits = stored(spread.join(shared, "sig"), "hits")
    discard(sets)
    kind = F.floor(F.log("n") / math.log(ALIKE))
    best = hits.groupBy("h").agg(F.max(F.struct("c", "sig")).alias("m"), F.min("k").alias("k"), F.max("n").alias("n"))
    homes = stored(best.select("h", "k", "n", F.col("m.sig").alias("home"), kind.alias("kind")), "homes")
    count = homes.count()
    if not count:
        return None
    crowd = homes.groupBy(F.col("home").alias("_home"), F.col("kind").alias("_kind")).agg(F.greatest(F.ceil(F.count(F.lit(1)) / GROUP), F.ceil(F.sum("n") / TOKENS)).alias("parts")).filter("parts > 1")
    cut = homes.join(crowd, (F.col("home") == F.col("_home")) & (F.col("kind") == F.col("_kind")), "left")
    gid = F.xxhash64("home", "kind", F.coalesce(F.pmod(F.xxhash64("h"), F.col("parts")), F.lit(0)))
    groups = stored(cut.select("h", "k", "home", F.col("parts").isNotNull().alias("split"), gid.alias("gid")), "groups")
    few = count <= BROADCAST and docs.schema[key].dataType.typeName() in ("byte", "short", "integer", "long")
    texts = candidate_texts(docs, groups, size, key, text, few)
    columns = stored(made_columns(texts.repartition("gid").sortWithinPartitions("gid"), percent, size), "columns")
    leaders = None if groups.filter("split").isEmpty() else stored(centred(columns, percent), "leaders")
    asked = queries(hits, columns, leaders, percent)
    between = leaders
    if not asked.isEmpty():
        asked = stored(possible(asked, columns, percent), "possible")
    if not asked.isEmpty():
        later = stored(opened(asked, columns, percent), "later-links")
        between = later if between is None else between.union(later)
    sets = columns.select(F.explode(F.arrays_zip("h", "label")).alias("s")).select("s.h", "s.label")
    return sets, between


def classes(docs: DataFrame, percent: int, size: int, key: str, text: str) -> DataFrame:
    """A row (k, n, h, c) for each document: key, set size, the set's name and its component."""
    signed = stored(tokenized(docs, percent, size, key, text), "sets")
    rows = stored(signed.select("k", "n", "h"), "names")
    found = links(docs, signed, percent, size, key, text)
    if found is None:
        return rows.select("k", "n", "h", F.col("h").alias("c"))
    sets, between = found
    if between is not None:
        sets = sets.join(components(between).withColumnRenamed("node", "label"), "label", "left").select("h", F.coalesce("root", "label").alias("c"))
    else:
        sets = sets.select("h", F.col("label").alias("c"))
    moved = sets.filter("h <> c").withColumnRenamed("h", "_h")
    return stored(rows.join(moved, F.col("h") == F.col("_h"), "left").select("k", "n", "h", F.coalesce("c", "h").alias("c")), "classes")


def join(docs: DataFrame, percent: int = 80, size: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: the key, n_shingles and component_id."""
    rows = classes(docs, percent, size, key, text)
    least = rows.filter("c IS NOT NULL").groupBy("c").agg(F.min("k").alias("first"))
    return rows.join(least, "c", "left").select(F.col("k").alias(key), F.col("n").alias("n_shingles"), F.coalesce("first", "k").alias("component_id"))


def set_names(size: int):
    """A text column's set names, as a function of columns."""

    def run(texts: pd.Series) -> pd.Series:
        listed = texts.tolist()
        return pd.Series([name_of(s) for lo, hi in chunks(listed) for s in token_sets(listed[lo:hi], size)], dtype="Int64")

    return F.pandas_udf(run, "long")


def deduplicate(docs: DataFrame, percent: int = 80, size: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with all their columns, one of each component: the first by key, then by its set's name.

    Of rows with equal keys and equal sets one stays; rows with equal keys whose sets are not linked
    stay each for its own component; rows with a null key stay.
    """
    rows = classes(docs, percent, size, key, text).filter("k IS NOT NULL")
    first = rows.filter("c IS NOT NULL").groupBy("c").agg(F.min(F.struct("k", "h")).alias("first"))
    others = rows.join(first, "c").filter((F.col("k") != F.col("first.k")) | (F.col("h") != F.col("first.h")))
    copy, name, again, own = (unused(docs, c) for c in ("dropped_", "name_", "again_", "set_"))
    dropped = stored(others.select(F.col("k").alias(copy), F.col("h").alias(name)).distinct(), "dropped")
    repeated = stored(rows.groupBy(F.col("k").alias(again)).count().filter("count > 1").select(again), "repeated-keys")
    numbers = docs.schema[key].dataType.typeName() in ("byte", "short", "integer", "long")

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if numbers and df.count() <= BROADCAST else df

    gone = side(dropped)
    if repeated.isEmpty():
        return docs.join(gone, F.col(key) == F.col(copy), "left_anti")
    twice = side(repeated)
    once = docs.join(twice, F.col(key) == F.col(again), "left_anti").join(gone, F.col(key) == F.col(copy), "left_anti")
    # Only rows with repeated keys are told apart by their sets.
    several = docs.join(twice, F.col(key) == F.col(again), "left_semi").withColumn(own, set_names(size)(F.col(text)))
    several = several.join(gone, (F.col(key) == F.col(copy)) & (F.col(own) == F.col(name)), "left_anti")
    return once.union(several.dropDuplicates([key, own]).drop(own))
