"""The queries over the smallest tables, the pipeline's stages, and odd keys, names and texts."""

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pixelfold.llm import entries, graphs, jaccard, licenses, packing, quality_classifier, quality_rules, sentencepiece, sharding, token_files, toxicity

from .test_text_operators import brute_components

FOLDER = "/root/testdata/sf0.001"
WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
BIG = 2**60 + 1


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for name in ("documents", "embeddings", "labels"):
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_queries_equal_their_sql(spark, tables, name):
    ours, theirs = entries.queries()[name](spark, FOLDER).toPandas(), tables.sql(entries.oracle_sql()[name]).df()
    columns = sorted(theirs.columns)
    assert sorted(ours.columns) == columns
    assert Counter(map(str, ours[columns].itertuples(index=False, name=None))) == Counter(map(str, theirs[columns].itertuples(index=False, name=None)))


CONTRACTS = {
    "op2_toxicity": "doc_id held_out score predicted",
    "op4_quality_classifier": "doc_id held_out score predicted",
    "op6_token_files": "doc_id start n_tokens ids_crc32",
    "op7_license_scans": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op8_sentencepiece": "doc_id n_ids ids_crc32 decoded_crc32 same",
    "op10_packing": "doc_id piece start length ids_crc32 sequence_id offset",
}


@pytest.mark.parametrize("name", CONTRACTS)
def test_queries_have_their_columns_and_every_document(spark, tables, name):
    got = entries.queries()[name](spark, FOLDER)
    assert got.columns == CONTRACTS[name].split()
    assert {r[0] for r in got.select("doc_id").collect()} == {r[0] for r in tables.sql("SELECT doc_id FROM documents").fetchall()}


def test_toxicity_scores_by_hand(spark, tables):
    weights, bias = entries.toxicity_model(spark, FOLDER)
    learnt = dict(tables.sql("SELECT doc_id, toxic FROM labels WHERE toxic IN (0, 1)").fetchall())
    texts, marks = toxicity.sample(entries.read(spark, FOLDER, "documents"), entries.learnt_from(spark, FOLDER), "toxic", "doc_id", "text")
    known = dict(tables.sql("SELECT doc_id, text FROM documents").fetchall())
    taught = Counter((known[i], y) for i, y in learnt.items() if zlib.crc32(str(i).encode()) % 5)
    assert Counter(zip(texts, marks, strict=True)) == taught
    for r in entries.op2_toxicity(spark, FOLDER).collect():
        total = size = 0.0
        for word, times in Counter(toxicity.words(known[r["doc_id"]])).items():
            marked = f"<{word}>"
            parts = {marked} | {marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)}
            weigh = 1 + np.log(times)
            total += weigh * sum(weights[zlib.crc32(p.encode()) % 2**17] for p in parts)
            size += weigh * len(parts)
        score = 1 / (1 + np.exp(-np.clip(total / max(size, 1) + bias, -700, 700)))
        assert r["score"] == pytest.approx(score, abs=1e-9) and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_toxicity_gradients():
    bags = toxicity.Bags(["ab ab cd", "cd ef gh", "", "xy"])
    rng = np.random.default_rng(1)
    table, way = rng.normal(size=(toxicity.BUCKETS, 2)), rng.normal(size=(4, 2))
    moved = rng.normal(size=table.shape) * 1e-4
    change = ((bags.means(table + moved) - bags.means(table)) * way).sum()
    assert (bags.back(way) * moved).sum() == pytest.approx(change, rel=1e-6)


def test_quality_scores_by_hand(spark, tables):
    rows = dict(tables.sql("SELECT doc_id, text FROM documents").fetchall())
    learnt = {i: y for i, y in tables.sql("SELECT doc_id, quality FROM labels WHERE quality IN (0, 1)").fetchall() if zlib.crc32(str(i).encode()) % 5}
    x, y = np.array([quality_classifier.statistics(rows[i]) for i in learnt]), np.array(list(learnt.values()), float)
    model = quality_classifier.Model(x.mean(0), np.maximum(x.std(0), 1e-3))
    z = model.features(x)
    ridge = quality_classifier.RIDGE * len(y) / quality_classifier.FEATURES * np.eye(z.shape[1])
    ridge[-1, -1] = 0
    model.weights = np.linalg.solve(z.T @ z + ridge + 1e-9 * np.eye(len(ridge)), z.T @ y)
    wide = (quality_classifier.HIGH - quality_classifier.LOW) / quality_classifier.BINS
    bins = defaultdict(list)
    for at, one in zip(np.clip(((model.raw(x) - quality_classifier.LOW) / wide).astype(int), 0, quality_classifier.BINS - 1).tolist(), y, strict=True):
        bins[at].append(one)
    names = sorted(bins)
    # A rising fit by its min-max formula, and one knot for each level.
    fit = [max(min(np.mean([v for k in names[i : j + 1] for v in bins[k]]) for j in range(at, len(names))) for i in range(at + 1)) for at in range(len(names))]
    levels = defaultdict(list)
    for k, level in zip(names, fit, strict=True):
        levels[round(level, 9)] += [quality_classifier.LOW + (k + 0.5) * wide] * len(bins[k])
    model.knots = (np.array([np.mean(v) for v in levels.values()]), np.array(list(levels)))
    got = {r["doc_id"]: r["score"] for r in entries.op4_quality_classifier(spark, FOLDER).collect()}
    want = {i: float(model.score(np.array([quality_classifier.statistics(t)]))[0]) for i, t in rows.items()}
    assert max(abs(got[i] - want[i]) for i in want) < 1e-6


def test_license_labels_by_hand(spark):
    rng = random.Random(5)
    named = {"MIT": "mit", "GPL-2.0-only": "gpl", "Apache-2.0": "apache", "EPL-2.0": "epl", "LicenseRef-own": "licenseref-own", "BSD-3-Clause": "bsd"}
    phrases = licenses.BASE | licenses.NOTICES
    rows, want = [], {}
    for i in range(150):
        words, labels = [f"w{rng.randrange(99)}" for _ in range(30)], set()
        for _ in range(rng.randrange(3)):
            words.insert(rng.randrange(len(words)), f"w0 {rng.choice(list(phrases)).title()} w1")
        text = " ".join(words)
        if rng.random() < 0.5:
            one, other = rng.sample(list(named), 2)
            text += f"\n# SPDX-License-Identifier: ({one} {rng.choice(['AND', 'or'])} {other}) stands here"
            labels |= {named[one], named[other]}
        plain = f" {text.lower().replace('-', ' ')} "
        labels |= {label for phrase, label in phrases.items() if f" {phrase} " in plain}
        rows.append((i, text))
        want[i] = ",".join(sorted(labels))
    got = licenses.digest(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert {r["doc_id"]: r["labels"] for r in got} == want
    assert all((r["score"] == 0) == (not r["labels"]) for r in got)
    assert set(phrases.values()) | set(licenses.IDENTIFIERS.values()) <= set(licenses.LEVELS)


TEXT = "one two three four five six seven eight nine ten eleven"


def test_large_keys_stay_what_they_are_beside_a_null(spark, tmp_path):
    rows = [(BIG, TEXT, 1), (None, TEXT + " twelve", 0), (BIG + 1, "other words here", 1), (-BIG, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y int").coalesce(1)
    keys = Counter(r[0] for r in rows)
    labels = spark.createDataFrame([(BIG, 1), (BIG + 1, 0)], "doc_id long, quality int")
    made = {
        "op1": sharding.shard(df, [1.0] * 3), "op2": toxicity.score(df, np.zeros(toxicity.BUCKETS), 0.0), "op4": quality_classifier.classify(df, labels),
        "op5": quality_rules.verdicts(df.withColumns({"lang": F.lit("en"), "source": F.lit("s")})), "op6": token_files.round_trip(df, WORDS, 2, folder=str(tmp_path)), "op7": licenses.scan(df),
        "op8": sentencepiece.round_trip(df, PIECES), "op9": jaccard.join(df, 90, 3), "op10": packing.pack(df, WORDS),
    }
    for name, got in made.items():
        assert Counter(r["doc_id"] for r in got.select("doc_id").collect()) == keys, name


def test_keys_of_other_kinds(spark, tmp_path):
    df = spark.createDataFrame([("a", TEXT), ("b", TEXT), (None, TEXT)], "y string, text string")
    labels = spark.createDataFrame([("a", 1), ("b", 0)], "y string, quality int")
    for got in (toxicity.score(df, np.zeros(toxicity.BUCKETS), 0.0, key="y"), quality_classifier.classify(df, labels, key="y"), licenses.scan(df, key="y"), sentencepiece.encode(df, PIECES, key="y"), jaccard.join(df, 90, 3, key="y"), packing.pack(df, WORDS, key="y")):
        assert sorted(r["y"] or "" for r in got.collect()) == ["", "a", "b"]
    assert {r["component_id"] for r in jaccard.join(df, 90, 3, key="y").collect()} == {"a"}
    with pytest.raises(ValueError, match="whole numbers"):
        token_files.write(df, str(tmp_path), WORDS, 2, key="y")


@pytest.mark.parametrize("most", [0, jaccard.BROADCAST])
def test_links_through_a_null_key_at_every_size(spark, monkeypatch, most):
    monkeypatch.setattr(jaccard, "BROADCAST", most)
    words = [f"w{i}" for i in range(200)]

    def changed(n):
        return " ".join(["x"] * n + words[n:])

    rows = [(1, changed(0)), (None, changed(3)), (2, changed(6)), (3, "else"), (None, "else"), (None, changed(3))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(df, 96, 3).collect())
    assert got == brute_components(rows, 96, 3) and {c for k, _, c in got if k in (1, 2)} == {1}


def test_deduplicate_goes_by_row(spark):
    a, b = TEXT, "quite another text of more than five words"
    rows = [(1, a, 7, 8), (5, a, 7, 8), (5, b, 7, 8), (6, b, 7, 8), (None, a, 7, 8), (9, None, 7, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, dropped_ int, _dropped int")
    got = jaccard.deduplicate(df)
    assert got.columns == df.columns
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter([(1, a), (5, b), (None, a), (9, None)])


def test_large_groups_and_many_components(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP", 6)
    monkeypatch.setattr(jaccard, "TOKENS", 2000)
    monkeypatch.setattr(jaccard, "CENTRES", 2)
    monkeypatch.setattr(graphs, "LINKS", 3)
    rng = np.random.default_rng(9)
    rows = []
    for c in range(3):
        base = [f"c{c}w{i}" for i in range(120)]
        for _ in range(40):
            one = list(base)
            for at in rng.integers(0, 120, int(rng.integers(0, 9))):
                one[int(at)] = f"e{int(rng.integers(10**6))}"
            rows.append((len(rows), " ".join(one)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for percent, size in ((90, 3), (80, 5)):
        got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(df, percent, size).collect())
        assert got == brute_components(rows, percent, size)


def test_components_in_rounds(spark, monkeypatch):
    rng = random.Random(2)
    edges = [(a, rng.randrange(max(0, a - 9), a + 1)) for a in range(1, 400) if a % 50]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    one = {(r["node"], r["root"]) for r in graphs.components(df).collect()}
    assert one == {(r["node"], r["root"]) for r in graphs.components(df, most=0).collect()}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b), near[b].add(a)
    for node, root in one:
        seen, todo = {node}, [node]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x), todo.append(x)
        assert root == min(seen)


def test_bits_never_rule_out_a_link():
    rng = np.random.default_rng(4)
    for _ in range(300):
        x = rng.integers(0, 2**63, int(rng.integers(1, 300)), dtype=np.uint64)
        y = np.unique(np.concatenate([x[: int(rng.integers(0, len(x) + 1))], rng.integers(0, 2**63, int(rng.integers(1, 300)), dtype=np.uint64)]))
        x = np.unique(x)
        same = len(np.intersect1d(x, y))
        for percent in (60, 80, 90):
            if 100 * same >= percent * (len(x) + len(y) - same):
                assert jaccard.can_link(([1], [len(x)], [jaccard.parity(x)]), ([2], [len(y)], [jaccard.parity(y)]), percent)
        assert jaccard.common([x], [y])[0, 0] == same


def test_very_long_texts(spark, tmp_path):
    rng = random.Random(1)
    rows = [(1, " ".join(f"w{rng.randrange(5000)}" for _ in range(150_000))), (2, "x" * 3000 + "é" * 3000), (3, " ".join(f"v{i}" for i in range(30_000))), (4, " ".join(f"v{i}" for i in range(10, 30_010)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard.join(df, 90, 3).collect()} == {1: 1, 2: 2, 3: 3, 4: 3}
    assert {r["n_words"] for r in quality_rules.verdicts(df.withColumns({"lang": F.lit("en"), "source": F.lit("s")})).collect()} == {150_000, 1, 30_000}
    packed = packing.pack(df, WORDS).collect()
    written = {r["doc_id"]: r for r in token_files.round_trip(df, WORDS, 1, folder=str(tmp_path)).collect()}
    assert {i: sum(r["length"] for r in packed if r["doc_id"] == i) for i in written} == {i: r["n_tokens"] for i, r in written.items()}
    import sentencepiece as library

    sp = library.SentencePieceProcessor(model_file=PIECES)
    for r in sentencepiece.encode(df, PIECES).collect():
        assert r["ids"] == sp.encode(dict(rows)[r["doc_id"]])
    assert toxicity.score(df, np.zeros(toxicity.BUCKETS), 0.0).count() == licenses.scan(df).count() == sharding.shard(df, [1.0]).count() == 4


def test_other_models_are_refused(tmp_path):
    def field(n, body):
        return bytes([n << 3 | 2, len(body)]) + body

    for name, trainer, normalizer in (("unigram", b"\x18\x01", b"\x20\x00"), ("rules", b"\x18\x02", b"\x20\x00" + field(2, b"x")), ("spaces", b"\x18\x02", b"")):
        (tmp_path / name).write_bytes(field(2, trainer) + field(3, normalizer))
        with pytest.raises(ValueError, match="byte-pair|changes texts"):
            sentencepiece.check(str(tmp_path / name))
    sentencepiece.check(PIECES)


def test_pipeline_by_hand(spark, tables):
    docs = entries.read(spark, FOLDER, "documents")
    rows = {r["doc_id"]: r for r in docs.collect()}
    weights, bias = entries.toxicity_model(spark, FOLDER)
    scorer = toxicity.Scorer(weights, bias)
    want = {i for i, r in rows.items() if scorer.score(r["text"]) < 0.5}
    now = docs
    for (name, stage), expected in zip(corpus_pipeline.STAGES[:3], ("toxic", "poor", "copies"), strict=True):
        if expected == "poor":
            want = {r["doc_id"] for r in quality_rules.verdicts(now).collect() if r["kept"]}
        if expected == "copies":
            kept = sorted(want)
            want = {c for _, _, c in brute_components([(i, rows[i]["text"]) for i in kept], 80, 5)}
        now = corpus_pipeline.common.stored(stage(spark, now, FOLDER), "test")
        assert now.columns == docs.columns and {r["doc_id"]: r for r in now.collect()} == {i: rows[i] for i in want}, name
    packed = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r["doc_id"] for r in packed} == want
    room = defaultdict(list)
    for r in packed:
        room[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in room.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.LIMIT


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, y_ int, k_ int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.sample(none, labels, "toxic", "doc_id", "text") == ([], [])
    for got in (quality_classifier.classify(none, labels), token_files.round_trip(none, WORDS, 2, folder=str(tmp_path)), sentencepiece.round_trip(none, PIECES), packing.pack(none, WORDS), jaccard.deduplicate(none), sharding.shard(none, [1.0])):
        assert got.count() == 0
