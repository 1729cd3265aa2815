"""Quality rules: counts with fixed limits, then robust multivariate outliers, in DataFrame functions.

Base counts of a text and two limits give ``base_failed``. For the others, four shares of the words count:
short ones, ones with a mark that is no letter, ones with a capital, and ones equal to the word before. Each share
is turned by the arc sine of its root, which makes the spread by chance depend on the number of words alone; its
distance to the median of its group of language and source is then multiplied by the root of that number, which
levels off at ``STYLE`` words, where how authors differ outweighs chance. These are whole numbers, so their sums are
exact and the same in any order. Within each group a minimum-covariance-determinant estimate is found from several
starts: the medians with the median deviations, all rows, and two halves that the statistics' sums deal out. From
each, concentration steps follow: rows fall into distance bins, the bins that make up the nearest three quarters give
the next mean and covariance. Of the starts' last estimates the one with the smallest determinant counts. Texts that
agree in all shares, words and characters, as copies do, count once. A variance below ``LEAST`` squared is raised to
it. A row further than the chi-square cutoff by Mahalanobis distance is rejected. Groups below ``SMALL`` rows are
estimated together; nothing is rejected where even those are fewer than ``FEW``.

Defined results: a null or empty text has no words and fails; a text of any length is counted whole, in one
row; null language and source are values of
their own; repeated rows and ties are judged alike, each by itself; an empty table gives no rows;
other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: White space between words; a regular expression and the same as characters.
SPACE = "[ \\t-\\r]+"
MIN_WORDS, REPEAT_PERCENT = 10, 20
#: Rows of a group at least for estimates of its own, and of the pooled rest for any.
SMALL, FEW = 30, 8
NEAREST = 0.75
STEPS = 3
#: Starts: 0 the medians, 1 all rows, 2 and 3 the rows whose statistics' sum is even and odd.
HALF = "abs(z1 + z2 + z3 + z4) % 2"
#: Of equal determinants the first start's counts.
DETERMINANT = "(l00 * l11 * l22 * l33)"
#: Distances are binned by this width up to the last bin.
BIN, LAST_BIN = 0.25, 4000
#: Words from which on a longer text's shares are no more certain to be near its group's.
STYLE = 400
#: Least standard deviation: half of what chance alone gives the shares of a short text.
LEAST = 250.0
#: Chi-square with four degrees of freedom: beyond the first lies one in 10^9, so that the sound texts of
#: a large corpus stay; the second makes the covariance of the nearest three quarters one of all:
#: 0.75 / P(chi-square with six degrees <= 5.385).
CUTOFF, CONSISTENT = 47.87, 1.4866
#: Makes a median deviation a standard deviation.
SPREAD = 1.4826
T = ("t1", "t2", "t3", "t4")
Z = ("z1", "z2", "z3", "z4")
#: Words of at most so many characters are short; marks and capitals as regular expressions of both engines.
SHORT = 3
MARK, CAPITAL = "[!-@\\[-`{-~]", "\\p{Lu}"
SHARES = ("n_short", "n_marked", "n_capital", "n_again")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", *SHARES, "n_repeat_words")


def at(array: Column, i: Column) -> Column:
    return F.get(array, i)


def repeated_words(windows: Column, size: int = 5) -> Column:
    """Words covered by windows that occur twice or more; ``windows`` are hashes in text order."""
    order = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(
        F.size(windows) == F.size(F.array_distinct(windows)), F.lit(0).cast("long")
    ).otherwise(_covered(order, size))


def _covered(order: Column, size: int) -> Column:
    def of(pairs: Column) -> Column:
        marked = F.transform(pairs, lambda p, k: F.when((at(pairs, k - 1)["h"] == p["h"]) | (at(pairs, k + 1)["h"] == p["h"]), p["i"]))
        return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))

    def total(places: Column) -> Column:
        gaps = F.transform(places, lambda p, k: F.least(F.lit(size), F.coalesce(at(places, k + 1) - p, F.lit(size))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    # A one-element transform names an intermediate array, which is then made once.
    return F.transform(F.transform(F.array(order), of), total)[0]


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents' columns in a struct ``_row`` with the base counts beside it."""
    body = F.coalesce(F.col(f"_row.`{text}`"), F.lit(""))
    rows = docs.select(F.struct("*").alias("_row"))
    split = rows.select("_row", F.array_remove(F.split(body, SPACE), "").alias("_words"), F.filter(F.split(body, "\n"), lambda x: x.rlike("[^ \\t-\\r]")).alias("_lines"), body.alias("_text"))
    of_words = (
        lambda w: F.char_length(w) <= SHORT, lambda w: w.rlike(MARK), lambda w: w.rlike(CAPITAL),
        lambda w, i: w == at(F.col("_words"), i - 1),
    )
    wide = split.select(
        "_row",
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        *[F.size(F.filter("_words", having)).cast("long").alias(name) for name, having in zip(SHARES, of_words, strict=True)],
        F.when(F.size("_words") < 5, F.array().cast("array<bigint>"))
        .otherwise(F.transform(F.slice("_words", F.lit(1), F.size("_words") - 4), lambda w, i: F.xxhash64(w, *[at(F.col("_words"), i + k) for k in range(1, 5)])))
        .alias("_windows"),
    )
    made = F.struct(*COUNTS[:-1], repeated_words(F.col("_windows")).alias(COUNTS[-1]))
    # Through a generator no filter on the counts is pushed down, where it would split every text again
    # for each of its words.
    return wide.select("_row", F.inline(F.array(made)))


#: The statistics and the base rule in terms of the counts, for Spark and other SQL engines alike.
STATISTICS = {
    "base_failed": f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words",
} | {
    t: f"CAST(round(1000 * asin(sqrt(({x} + 0.375e0) / (n_words + 0.75e0)))) AS BIGINT)" for t, x in zip(T, SHARES, strict=True)
}
#: The statistics that are estimated, in terms of the number of words and the group's medians.
CENTRED = {z: f"CAST(round(sqrt(n_words * {STYLE}e0 / (n_words + {STYLE})) * ({t} - med_{t})) AS BIGINT)" for z, t in zip(Z, T, strict=True)}


def moment_sums(n: str = "1") -> dict[str, str]:
    """Exact sums of the statistics and of their products."""
    out = {f"s{i}": f"sum({a})" for i, a in enumerate(Z)}
    return out | {f"p{i}{j}": f"sum({a} * {b})" for i, a in enumerate(Z) for j, b in enumerate(Z) if j <= i}


def covariance() -> dict[str, str]:
    """Mean and covariance, no variance below the least, of the nearest rows, in terms of the sums and their number n."""
    out = {f"m{i}": f"(s{i} * 1e0 / n)" for i in range(4)}
    for i in range(4):
        for j in range(i + 1):
            one = f"{CONSISTENT} * (p{i}{j} * 1e0 / n - (s{i} * 1e0 / n) * (s{j} * 1e0 / n))"
            out[f"c{i}{j}"] = f"greatest({one}, {LEAST**2})" if i == j else f"({one})"
    return out


def cholesky() -> list[tuple[str, str]]:
    """Assignments in order that give the lower factor from c00 ... c33."""
    out = []
    for j in range(4):
        taken = "".join(f" - l{j}{k} * l{j}{k}" for k in range(j))
        out.append((f"l{j}{j}", f"sqrt(greatest(c{j}{j}{taken}, 1e-6))"))
        for i in range(j + 1, 4):
            taken = "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            out.append((f"l{i}{j}", f"((c{i}{j}{taken}) / l{j}{j})"))
    return out


def distance() -> list[tuple[str, str]]:
    """Assignments in order that end with the squared Mahalanobis distance d2."""
    out = []
    for i, z in enumerate(Z):
        taken = "".join(f" - l{i}{k} * y{k}" for k in range(i))
        out.append((f"y{i}", f"(({z} - m{i}{taken}) / l{i}{i})"))
    return [*out, ("d2", "(y0 * y0 + y1 * y1 + y2 * y2 + y3 * y3)")]


FACTOR = [f"l{i}{j}" for j in range(4) for i in range(j, 4)]
MEAN = [f"m{i}" for i in range(4)]


def assigned(df: DataFrame, steps: list[tuple[str, str]]) -> DataFrame:
    for name, expression in steps:
        df = df.withColumn(name, F.expr(expression))
    return df


GROUP = ["g_lang", "g_source"]


def medians(stats: DataFrame, of: dict[str, str]) -> DataFrame:
    """Per group and expression the smallest whole number that half of the rows do not exceed, and the rows."""
    pairs = F.array(*[F.struct(F.lit(name).alias("i"), F.expr(x).alias("v")) for name, x in of.items()])
    long = stats.select(*GROUP, F.inline(pairs)).groupBy(*GROUP, "i", "v").agg(F.count(F.lit(1)).alias("k"))
    part = Window.partitionBy(*GROUP, "i")
    half = long.withColumn("below", F.sum("k").over(part.orderBy("v"))).withColumn("n", F.sum("k").over(part)).filter(F.col("below") * 2 >= F.col("n"))
    return half.groupBy(*GROUP).agg(*[F.min(F.when(F.col("i") == name, F.col("v"))).alias(name) for name in of], F.max("n").alias("rows"))


def estimates(shares: DataFrame, small_side) -> DataFrame:
    """Per group (g_lang, g_source): medians of t1 ... t4, mean and factor of the covariance of z1 ... z4,
    and rows, from STEPS steps.

    shares: rows with the group, n_words and t1 ... t4. small_side(df) may mark a table of groups for broadcast.
    """
    group = GROUP
    centres = stored(medians(shares, {f"med_{t}": t for t in T}).drop("rows"), "medians")
    stats = joined(shares, small_side(centres), group).select(*group, *[F.expr(x).alias(z) for z, x in CENTRED.items()])
    now = medians(stats, {f"mad_{z}": f"abs({z})" for z in Z}).select(
        *group, "rows", *[F.lit(0.0).alias(m) for m in MEAN],
        *[(F.greatest(F.lit(LEAST), F.lit(SPREAD) * F.col(f"mad_{Z[i]}")) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for j in range(4) for i in range(j, 4)],
    )
    kept = [*group, "start", *MEAN, *FACTOR, "rows"]

    def shaped(sums: DataFrame) -> DataFrame:
        made = sums.select(*group, "start", "rows", *[F.expr(x).alias(name) for name, x in covariance().items()])
        return assigned(made, cholesky()).select(*kept)

    sums = {name: F.expr(x).alias(name) for name, x in moment_sums().items()}
    halves = stats.groupBy(*group, F.expr(HALF).alias("half")).agg(F.count(F.lit(1)).alias("n"), *sums.values())
    whole = halves.groupBy(*group).agg(F.lit(1).alias("start"), F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in sums])
    parts = halves.select(*group, (F.col("half") + 2).cast("int").alias("start"), "n", *sums).unionByName(whole)
    now = now.withColumn("start", F.lit(0)).select(*kept).unionByName(shaped(parts.withColumn("rows", F.lit(0).cast("long"))))
    for _ in range(STEPS):
        seen = assigned(joined(stats, small_side(now), group), distance())
        seen = seen.withColumn("bin", F.least(F.floor(F.col("d2") / BIN), F.lit(LAST_BIN)))
        binned = seen.groupBy(*group, "start", "bin").agg(F.count(F.lit(1)).alias("k"), *sums.values())
        all_bins = Window.partitionBy(*group, "start")
        near = binned.withColumn("before", F.sum("k").over(all_bins.orderBy("bin")) - F.col("k")).withColumn("rows", F.sum("k").over(all_bins)).filter(F.col("before") < NEAREST * F.col("rows"))
        now = shaped(near.groupBy(*group, "start").agg(F.sum("k").alias("n"), F.first("rows").alias("rows"), *[F.sum(x).alias(x) for x in sums]))
        now = stored(now, "starts")
    best = now.groupBy(*group).agg(F.min(F.struct(F.expr(DETERMINANT).alias("det"), "start", *MEAN, *FACTOR, "rows")).alias("b"))
    return joined(best.select(*group, *[F.col(f"b.{c}").alias(c) for c in (*MEAN, *FACTOR, "rows")]), small_side(centres), group)


def joined(left: DataFrame, right: DataFrame, group: list[str]) -> DataFrame:
    right = right.withColumnsRenamed({g: f"_{g}" for g in group})
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group]
    return left.join(right, same[0] & same[1], "left").drop(*[f"_{g}" for g in group])


def counted(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents in ``_row``, their group as lang and source, counts, statistics and base_failed."""
    grouped = counts(docs, text).select("_row", F.col(f"_row.`{lang}`").cast("string").alias("lang"), F.col(f"_row.`{source}`").cast("string").alias("source"), *COUNTS)
    return grouped.select("*", *[F.expr(x).alias(name) for name, x in STATISTICS.items()])


class Fit:
    """Estimates from rows as :func:`counted` makes them (narrow ones, and stored: they are read
    once per step). Tables of more than ``broadcast_groups`` groups are joined by a shuffle."""

    def __init__(self, made: DataFrame, broadcast_groups: int = 20_000):
        shapes = ("lang", "source", "n_words", "word_chars", *T)
        passed = stored(made.filter(~F.col("base_failed")).select(*shapes).distinct(), "shapes")
        self.sizes = stored(passed.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("_n")), "group-sizes")
        self.small_side = F.broadcast if self.sizes.count() <= broadcast_groups else lambda df: df
        self.estimates = stored(estimates(self.grouped(passed), self.small_side), "group-estimates")

    def grouped(self, made: DataFrame) -> DataFrame:
        """Adds g_lang and g_source: null together for rows whose group is small."""
        sizes = self.sizes.withColumnsRenamed({"lang": "_lang", "source": "_source"})
        out = made.join(self.small_side(sizes), F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
        own = [F.when(F.col("_n") >= SMALL, F.concat(F.lit("="), F.coalesce(g, F.lit("\0")))).alias(f"g_{g}") for g in ("lang", "source")]
        return out.select(*made.columns, *own)

    def judge(self, made: DataFrame) -> DataFrame:
        """Adds distance2 and kept."""
        out = assigned(joined(self.grouped(made), self.small_side(self.estimates), GROUP), [*CENTRED.items(), *distance()])
        far = F.coalesce((F.col("rows") >= FEW) & (F.col("d2") > CUTOFF), F.lit(False))
        return out.select(*made.columns, F.col("d2").alias("distance2"), (~F.col("base_failed") & ~far).alias("kept"))


def verdicts(docs: DataFrame, key: str = "doc_id", **columns: str) -> DataFrame:
    """A row for each document: the key, counts, statistics, distance2 and kept."""
    made = stored(counted(docs, **columns).withColumn("_row", F.col(f"_row.`{key}`")).withColumnRenamed("_row", key), "counts")
    return Fit(made).judge(made)


def keep(docs: DataFrame, **columns: str) -> DataFrame:
    """The documents that pass, with all their columns. Texts are counted twice, never stored."""
    fit = Fit(stored(counted(docs, **columns).drop("_row"), "counts"))
    return fit.judge(counted(docs, **columns)).filter("kept").select("_row.*")
