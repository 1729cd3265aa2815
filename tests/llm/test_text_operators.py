import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelfold.llm import jaccard, licenses, quality_classifier, quality_rules, topk, toxicity
from pixelfold.llm.graphs import components


def folded(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(map(t.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(docs, rows):
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality_rules.verdicts(docs).collect())
    assert got == Counter((r[0], *counts(r[1])) for r in rows)


def test_quality_verdicts(docs, rows, none):
    got = quality_rules.verdicts(docs).collect()
    for r in got:
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and (not failed or not r["kept"])
    symbols = next(r[0] for r in rows if r[1] and r[1].startswith("##"))
    assert not any(r["kept"] for r in got if r["doc_id"] == symbols)
    assert sum(r["kept"] for r in got) > 35
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in got if r["kept"])
    assert quality_rules.verdicts(none).count() == 0 and quality_rules.keep(none).count() == 0


def test_outliers_by_group(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join("w" * int(rng.integers(3, 8)) + str(int(rng.integers(10**6))) for _ in range(60)) + ("" if i % 20 else " %$#" * 1 + "%%%% $$$$ " * 9 + "&"), "en", f"s{i % 2}") for i in range(400)]
    got = quality_rules.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    odd = {r["doc_id"] for r in got if not r["kept"] and not r["base_failed"]}
    assert odd == {i for i in range(400) if i % 20 == 0} - {r["doc_id"] for r in got if r["base_failed"]}


def styled(rng, n, marked, twice=False):
    """Invented words of which a share ends in a mark; each of them twice in a row if wanted."""
    words = ["".join(rng.choice(list("abcdefghij"), int(rng.integers(1, 9)))) + ("," if rng.random() < marked else "") for _ in range(n)]
    return " ".join(f"{w} {w}" if twice else w for w in words)


def test_shares_of_words(spark):
    import unicodedata

    rng = np.random.default_rng(4)
    texts = [styled(rng, 50, 0.2, True), "Élan ÉLAN élan 日本語 Ünder_score a-b [x] ^ ` {y} ~ @ 9 aaa aaaa aaaa\naaaa", "x" * 50_000, "", None]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: tuple(r[c] for c in quality_rules.SHARES) for r in quality_rules.verdicts(df).collect()}
    for i, t in enumerate(texts):
        w = (t or "").split()
        assert got[i] == (
            sum(len(x) <= 3 for x in w), sum(any("!" <= c <= "~" and not c.isalpha() for c in x) for x in w),
            sum(any(unicodedata.category(c) == "Lu" for c in x) for x in w), sum(x == y for x, y in zip(w, w[1:])),
        )


def test_own_estimate_of_each_group_decides(spark):
    """What is common in one source is odd in another; a source of copies rejects no other sound text."""
    rng = np.random.default_rng(3)
    rows = [(i, styled(rng, int(rng.integers(20, 400)), 0.1 if i % 2 else 0.7), "en", "prose" if i % 2 else "code") for i in range(300)]
    rows += [(1000, styled(rng, 200, 0.7), "en", "prose"), (1001, styled(rng, 200, 0.1), "en", "code"), (1002, styled(rng, 100, 0.1, True), "en", "prose")]
    copy = styled(rng, 150, 0.1)
    rows += [(2000 + i, copy if i < 160 else styled(rng, 150, 0.1), "en", "copies") for i in range(200)]
    got = quality_rules.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert not any(r["base_failed"] for r in got) and {r["doc_id"] for r in got if not r["kept"]} == {1000, 1001, 1002}


def brute_phrases(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded(t))
    found = [(i, label) for phrase, label in licenses.BASE.items() for n in [phrase.split()] for i in range(len(w) - len(n) + 1) if w[i : i + len(n)] == n]
    at = [i for i, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_licenses(docs, rows, none):
    got = licenses.digest(licenses.scan(docs)).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == Counter((r[0], *brute_phrases(r[1])) for r in rows)
    tagged = next(r[0] for r in rows if r[1] and r[1].startswith("SPDX"))
    assert [(r["labels"], r["score"]) for r in got if r["doc_id"] == tagged] == [("apache,gpl,mit", 0.75)]
    assert licenses.scan(none).count() == 0


@pytest.mark.parametrize(
    ("expression", "labels", "level"),
    [("MIT", {"mit"}, 1), ("MIT OR GPL-3.0-only", {"mit", "gpl"}, 1), ("MIT AND GPL-3.0-only", {"mit", "gpl"}, 3), ("GPL-2.0+ WITH x", {"gpl"}, 2), ("MIT OR BSD-2-Clause AND GPL-3.0", {"mit", "bsd", "gpl"}, 1), ("(MIT OR BSD-2-Clause) AND GPL-3.0", {"mit", "bsd", "gpl"}, 3), ("MIT OR", {"unparsed"}, 3), ("", {"unparsed"}, 3), (") MIT (", {"unparsed"}, 3), ("LicenseRef-x", {"licenseref-x"}, 3)],
)
def test_expressions(expression, labels, level):
    assert licenses.evaluate(expression) == (frozenset(labels), level)


@pytest.mark.parametrize(
    ("text", "labels", "levels"),
    [
        ("<!-- SPDX-License-Identifier: MIT -->", [{"mit"}], [1]),
        ("/* SPDX-License-Identifier: (MIT OR GPL-2.0+) */", [{"mit", "gpl"}], [1]),
        ("SPDX-License-Identifier: MIT (see LICENSE)", [{"mit"}], [1]),
        ("it has the tag SPDX-License-Identifier: GPL-2.0-only WITH x, which says much. More", [{"gpl"}], [2]),
        ("the tag SPDX-License-Identifier: MIT. And more", [{"mit"}], [1]),
        ("SPDX-License-Identifier: MIT SPDX-License-Identifier:Apache-2.0 # both", [{"mit"}, {"apache"}], [1, 1]),
        ("SPDX-License-Identifier: MIT OR\nSPDX-License-Identifier: ) MIT\nSPDX-License-Identifier: (MIT SPDX-License-Identifier: ISC", [{"unparsed"}, {"unparsed"}, {"unparsed"}, {"isc"}], [3, 3, 3, 1]),
        ('SPDX-License-Identifier: "MIT" OR "ISC"', [{"mit", "isc"}], [1]),
        ("SPDX-License-Identifier:\r\nMIT", [{"unparsed"}], [3]),
    ],
)
def test_expressions_end_where_nothing_continues_them(text, labels, levels):
    assert [licenses.evaluate(x) for x in licenses.scan_text(text)[2]] == [(frozenset(a), b) for a, b in zip(labels, levels, strict=True)]


def shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", folded(t))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def brute_components(rows, percent, k):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[top(i)] = min(least.get(top(i), key), key)
    return Counter((key, len(sets[i]), least.get(top(i), key)) for i, (key, _) in enumerate(rows))


@pytest.mark.parametrize(("percent", "k"), [(90, 3), (80, 5)])
def test_jaccard(docs, rows, none, percent, k):
    got = jaccard.join(docs, percent, k).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components([(r[0], r[1]) for r in rows], percent, k)
    assert jaccard.join(none, percent, k).count() == 0


def test_jaccard_at_the_border(spark):
    rng = np.random.default_rng(4)
    made = []
    for b in range(12):
        base = [f"w{int(x)}" for x in rng.integers(0, 5000, int(rng.integers(8, 160)))]
        for _ in range(14):
            one = list(base)
            for _ in range(int(rng.integers(0, 5))):
                one[int(rng.integers(len(one)))] = f"e{int(rng.integers(10**6))}"
            made.append((len(made), " ".join(one)))
    df = spark.createDataFrame(made, "doc_id long, text string")
    for percent, k in ((90, 3), (80, 5)):
        got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(df, percent, k).collect())
        assert got == brute_components(made, percent, k)
    kept = {r["doc_id"] for r in jaccard.deduplicate(df).collect()}
    assert kept == {c for _, _, c in brute_components(made, 80, 5)}


@pytest.mark.parametrize("broadcast", [0, 500_000])
def test_jaccard_links_through_null_keys(spark, monkeypatch, broadcast):
    monkeypatch.setattr(jaccard, "BROADCAST", broadcast)
    words = [f"w{i}" for i in range(300)]
    # Ends of the chain differ in too much to be linked but through the text whose only rows have no key.
    for percent, k, n in ((90, 3, 10), (80, 5, 20)):
        chain = [" ".join(w) for w in ([f"x{i}" for i in range(n)] + words[n:], words, words[:-n] + [f"y{i}" for i in range(n)])]
        made = [(7, chain[0]), (None, chain[1]), (None, chain[1]), (3, chain[2]), (None, "no link to others"), (9, "of its own")]
        want = brute_components(made, percent, k)
        assert want[(7, 301 - k, 3)] == 1 and brute_components([made[0], made[3]], percent, k)[(7, 301 - k, 7)] == 1
        got = jaccard.join(spark.createDataFrame(made, "doc_id long, text string"), percent, k).collect()
        assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want


def test_deduplicate_tells_texts_of_one_key_apart(spark):
    words = [f"w{i}" for i in range(100)]
    base, near, far = " ".join(words), " ".join([*words[:-1], "changed"]), " ".join(f"v{i}" for i in range(50))
    other = far.replace("v", "u")
    made = [(3, base), (5, far), (5, near), (6, other), (6, base + " more"), (6, other), (7, far), (8, ""), (8, None), (8, other + " more"), (9, None), (None, base)]
    df = spark.createDataFrame(made, "doc_id long, text string")
    got = Counter((r["doc_id"], r["text"] or "") for r in jaccard.deduplicate(df).collect())
    assert got == Counter([(3, base), (5, far), (6, other), (8, ""), (9, ""), (None, base)])


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60) if i % 10 != 9] + [(100, 5), (3, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: i // 10 * 10 for i in range(61) if i != 60} | {100: 0}


def test_top_k(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 0.3, (700, 16)).round(1)
    x[::7] = x[0]
    made = [(i * 3 - 500, v.tolist()) for i, v in enumerate(x)]
    odd = [(10**9, None), (10**9 + 1, [None] * 16), (10**9 + 2, [float("nan")] * 16), (10**9 + 3, [float("inf")] * 16), (10**9 + 4, [1.0, 2.0]), made[5]]
    table = spark.createDataFrame([(a, b, "x") for a, b in made + odd], "vec_id long, embedding array<float>, id string")
    size, topk.SHARD = topk.SHARD, 200
    try:
        got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.search(table, F.col("id") % 50 == 0).collect()}
    finally:
        topk.SHARD = size
    ids, z = np.array([a for a, _ in made]), np.floor(1024 * np.array([np.array(b, np.float32) for _, b in made]).astype(float)).astype(int)
    want = {}
    for i in np.flatnonzero(ids % 50 == 0):
        s = z @ z[i]
        for k, j in enumerate([j for j in np.lexsort((ids, -s)) if j != i][:10]):
            want[int(ids[i]), k + 1] = (int(ids[j]), int(s[j]))
    assert got == want
    assert topk.search(table.limit(0), F.col("id") % 50 == 0).count() == 0


def labelled(n):
    rng = np.random.default_rng(6)
    words = [f"{a}{b}" for a in ("lo", "ra", "mi", "tu", "se", "po") for b in ("ban", "den", "gor", "lit", "mas")]
    out = []
    for i in range(n):
        w = [words[int(j)] for j in rng.integers(0, len(words), int(rng.integers(15, 200)))]
        if i % 4 == 0:
            for _ in range(2):
                w[int(rng.integers(len(w)))] = str(rng.choice(["vileness", "vilenesses", "vylenes"]))
        out.append((i, " ".join(w), int(i % 4 == 0)))
    return out


def test_toxicity(spark, docs, none):
    made = labelled(400)
    weights, bias = toxicity.train([t for _, t, _ in made[:300]], [y for *_, y in made[:300]])
    df = spark.createDataFrame([(i, t) for i, t, _ in made[300:]], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, weights, bias).collect()}
    assert np.mean([(got[i] >= 0.5) == y for i, _, y in made[300:]]) > 0.95
    assert toxicity.Scorer(weights, bias).score("loban vilenesss ragor") > toxicity.Scorer(weights, bias).score("loban tumas ragor")
    scores = toxicity.score(docs, weights, bias).collect()
    assert len(scores) == docs.count() and all(0 <= r["score"] <= 1 for r in scores)
    clean = toxicity.score(docs, weights, bias, keep=True)
    assert clean.columns == docs.columns and clean.count() == sum(r["score"] < 0.5 for r in scores)
    assert toxicity.score(none, weights, bias).count() == 0
    untaught = toxicity.train(["a"], [1])
    assert {r["score"] for r in toxicity.score(docs, *untaught).collect()} == {0.0} or max(r["score"] for r in toxicity.score(docs, *untaught).collect()) < 1e-9


def test_quality_classifier(spark, docs, none):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.integers(0, 9999, 80)) + (" $$$ ###" * 20 if i % 3 == 0 else ""), int(i % 3 != 0)) for i in range(300)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 5], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality_classifier.classify(df, labels).collect()}
    assert np.mean([(got[i] >= 0.3) == y for i, _, y in rows if i % 5 == 0]) > 0.95
    assert all(0 <= s <= 1 for s in got.values())
    assert quality_classifier.classify(docs, labels.limit(0)).count() == docs.count()
    assert quality_classifier.classify(none, labels).count() == 0


def test_isotonic():
    x, y = quality_classifier.isotonic(np.array([0.0, 1, 2, 3]), np.array([1.0, 1, 1, 1]), np.array([0.0, 1, 0, 1]))
    assert x.tolist() == [0, 1.5, 3] and y.tolist() == [0, 0.5, 1]
