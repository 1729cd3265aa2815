import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pixelfold.llm import packing, sentencepiece, sharding, token_files, tokens
from pixelfold.llm.entries import tokenizer_path

BPE, PIECES = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def expected(rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    return [(r[0], library.encode(r[1] or "", add_special_tokens=False).ids) for r in rows]


def raw(ids):
    return np.array(ids, "<u4").tobytes()


def test_shards(docs, rows):
    got = sharding.shard(docs, [1.0] * 6).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 6)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert {r["doc_id"]: r["grown_shard"] for r in got} == {r["doc_id"]: r["shard"] for r in sharding.shard(docs, [1.0] * 7).collect()}


def test_shards_follow_weights(spark):
    got = Counter(r["shard"] for r in sharding.shard(spark.range(8000).selectExpr("id AS doc_id", "'x' AS text"), [1.0, 3.0]).collect())
    assert abs(got[1] / 8000 - 0.75) < 0.03


def test_empty_tables(spark, none):
    assert sharding.shard(none, [1.0] * 3).count() == 0
    assert packing.pack(none, BPE).count() == 0
    assert token_files.round_trip(none, BPE, 2).count() == 0
    assert sentencepiece.round_trip(none, PIECES).count() == 0


def test_word_encoder_is_the_library(rows, expected):
    words = tokens.WordEncoder(BPE)
    assert [words.encode(r[1]) for r in rows] == [raw(ids) for _, ids in expected]
    odd = ["<|endoftext|> x<|startoftext|>y", "don't we'll I'M 's", "a b c\x1cd", "ÀÉÎ ΑΣ İ", "x,y.z  ,", "≮ ≠"]
    assert [words.encode(t) for t in odd] == [raw(words.whole.encode(t, add_special_tokens=False).ids) for t in odd]


def test_token_files(docs, expected, tmp_path):
    listed = token_files.write(docs, str(tmp_path / "f"), BPE, 2)
    got = token_files.read_back(docs.sparkSession, listed, str(tmp_path / "f")).collect()
    want = Counter((k, len(ids) + 1, zlib.crc32(raw([*ids, 2]))) for k, ids in expected)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    keys = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    # any zstandard reader sees the ids alone, one document's frames are read alone, damage is noticed
    name = next(r["name"] for r in listed.collect())
    file = token_files.TokenFile(str(tmp_path / "f" / name))
    whole = (tmp_path / "f" / name).read_bytes()
    import zstandard

    assert zstandard.ZstdDecompressor().stream_reader(whole, read_across_frames=True).read() == b"".join(file.raw(i) for i in range(len(file)))
    key = int(file.keys[-1])
    assert [raw(x) for x in file.find(key)] == [raw([*ids, 2]) for k, ids in expected if k == key]
    (tmp_path / "bad").write_bytes(whole[:9] + bytes([whole[9] ^ 255]) + whole[10:])
    with pytest.raises(Exception, match=r"damaged|ompress|orrupt"):
        token_files.TokenFile(str(tmp_path / "bad")).raw(0)


def test_packing(docs, expected):
    got = packing.pack(docs, BPE, limit=256).collect()
    parts = defaultdict(list)
    for r in got:
        parts[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in parts.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 256
    want = Counter()
    for k, ids in expected:
        ids = [*ids, 1]
        want.update((k, i, 256 * i, len(p), zlib.crc32(raw(p))) for i in range(-(-len(ids) // 256)) for p in [ids[256 * i : 256 * i + 256]])
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    assert len(parts) <= sum(r["length"] for r in got) / 256 * 1.1 + 1


@pytest.mark.parametrize("seed", range(4))
def test_plans_place_every_document_once(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(4096, rng.lognormal(6, 1, 5000).astype(int) + 1)
    u, c = np.unique(lengths, return_counts=True)
    plan = packing.plan(dict(zip(u.tolist(), c.tolist(), strict=True)))
    fill = np.zeros(max(s + n for _, _, n, s, _ in plan), int)
    for length, _, n, s, offset in sorted(plan, key=lambda x: x[4]):
        assert (fill[s : s + n] == offset).all()
        fill[s : s + n] += length
    assert fill.max() <= 4096 and fill.sum() == lengths.sum() and len(fill) <= -(-lengths.sum() // 4096) * 1.02 + 2
    ranks = defaultdict(int)
    for length, first, n, _, _ in plan:
        assert first == ranks[length]
        ranks[length] += n


def test_sentencepiece(spark, docs, rows):
    import sentencepiece as library

    sp = library.SentencePieceProcessor(model_file=PIECES)
    got = sentencepiece.encode(docs, PIECES)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got.collect()) == Counter((r[0], tuple(sp.encode(r[1] or ""))) for r in rows)
    back = Counter((r["doc_id"], r["text"]) for r in sentencepiece.decode(got, PIECES).collect())
    assert back == Counter((r[0], r[1] or "") for r in rows)
    assert all(r["same"] for r in sentencepiece.round_trip(docs, PIECES).collect())
