"""Operator 12 against the library's ids and plain lists."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from tessera.llm import wavelet_shards as V

ODD = [None, "", " \n ", "a", "a", "Ab ab AB " * 400, "é ü ñ \U0001f600 日本 ▁x", "x" * 3000, "the quick  fox\n" * 9, "\t\x0b\x0c", "a\0 b", "x <|endoftext|> y", "x  <|endoftext|>", " a   b \n c\n\n d \n", "a\x1c b \x1c\n  c  d  "]


def ids_of(texts):
    library = Tokenizer.from_file(V.TOKENIZER)
    return [library.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def odd_texts(seed, n=300):
    r = random.Random(seed)
    parts = ["a", "It's", "été,", " straße.", " Öl…", "naïve'", "x_y", "$$$", " ¿qué?", "ÿ×÷ɏ", "ª", "we'll", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "12", "3.5", "é", "日本", "!?", "\x1c", " ", " ", "\x85", "\0", "'s", "…", "ﬁ", "<|endoftext|>"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("few", [1, 1 << 17])
def test_units_give_the_ids_of_whole_texts(monkeypatch, few):
    monkeypatch.setattr(V, "UNITS", few)
    own = V.Encoder(V.TOKENIZER)
    for seed in range(4):
        texts = odd_texts(seed) + [t or "" for t in ODD]
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == ids_of(texts)


def test_only_units_that_are_not_kept_are_looked_up(monkeypatch):
    """Kept units stay Arrow columns; the most recently used ones stay when there are too many, long ones never."""
    monkeypatch.setattr(V, "UNITS", 400)
    own, asked, lookup = V.Encoder(V.TOKENIZER), [], V.Encoder.lookup
    monkeypatch.setattr(V.Encoder, "lookup", lambda self, units: asked.append(units) or lookup(self, units))
    common, long = " ".join(f"common{i}," for i in range(100)), "x" * (V.UNIT + 1)
    for i in range(20):
        texts = [common, " ".join(f"own{i}x{j}" for j in range(90)), long]
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == ids_of(texts)
        assert len(own.units) <= 400 and own.sizes.sum() == len(own.body) and len(own.sizes) == len(own.used) == len(own.units)
    assert all(len(units) == 91 and not any("common" in u for u in units) for units in asked[1:])


def test_other_tokenizers_encode_whole_texts(tmp_path):
    library = Tokenizer.from_file(V.TOKENIZER)
    library.pre_tokenizer = ByteLevel(add_prefix_space=True)
    library.save(str(tmp_path / "t.json"))
    texts = odd_texts(7, 50)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist()[:-1] for x in V.Encoder(str(tmp_path / "t.json")).encode(texts)] == want


@pytest.mark.parametrize(("top", "n", "block"), [(1, 0, 8), (1, 5, 8), (2, 300, 64), (50257, 2000, 512), (7, 4096, 512), (1 << 31, 100, 64)])
def test_shard_equals_a_list(top, n, block):
    r = random.Random(n)
    ids = np.array([r.randrange(top) if r.random() < 0.5 else r.randrange(min(top, 4)) for _ in range(n)], np.uint32)
    shard = V.Shard(V.build([None, -5, 9], [1, n - 1, 0] if n else [0, 0, 0], ids, block))
    assert shard.about()[0] == [None, -5, 9] and shard.about()[1].tolist() == ([1, n - 1, 0] if n else [0, 0, 0])
    assert shard.ids().tolist() == ids.tolist()
    assert shard.access(np.arange(n)).tolist() == ids.tolist()
    for token in {*ids[:20].tolist(), 0, 3, top + 5}:
        places = np.flatnonzero(ids == token)
        assert shard.locate(token).tolist() == places.tolist()
        assert shard.select(token, np.arange(len(places))[::-1]).tolist() == places[::-1].tolist()
        for _ in range(5):
            a, b = r.randint(0, n), r.randint(0, n)
            want = [int(p) for p in places if a <= p < b]
            assert shard.count(token, a, b) == len(want) and shard.locate(token, a, b).tolist() == want
    with pytest.raises(IndexError):
        shard.access(np.array([n]))
    with pytest.raises(IndexError):
        shard.select(0, np.array([n]))


def test_one_lookup_opens_one_block_a_plane():
    ids = np.arange(1 << 14, dtype=np.uint32) % 50000
    shard = V.Shard(V.build([1], [len(ids)], ids, 256))
    shard.access(np.array([777]))
    assert len(shard._open) == shard.planes


def test_query(spark, folder):
    texts = ODD + odd_texts(9, 80)
    rows = sorted(V.op12_wavelet_shards(spark, folder(texts)).collect(), key=lambda r: r["doc_id"])
    at = 0
    for i, ids in enumerate(ids_of(texts)):
        assert tuple(rows[i]) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(rows) == len(texts)


def test_files_answer_questions(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"red green {'blue ' * (i % 4)}end", i) for i in range(50)] + [(None, None, 0), (None, None, 0), (7, "red", 1)], "doc_id int, text string, shard int")
    path = str(tmp_path / "shards")
    V.write_shards(docs, path, V.TOKENIZER, most=40)
    shards = spark.read.parquet(path)
    held = {r["shard"]: V.Shard(bytes(r["data"])) for r in shards.collect()}
    assert len(held) > 5 and shards.count() == len([*(tmp_path / "shards").glob("part-*.parquet")])
    assert all(s.size <= 40 for s in held.values())
    read = V.read_documents(spark, path).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in read) == [(False, 0)] * 2 + sorted((True, i) for i in [*range(50), 7])
    red = ids_of([" red"])[0][0]
    asked = [(s, t, a, b) for s in held for t, a, b in ((2, None, None), (red, 3, 30), (None, 0, 5), (60000, 0, None))]
    got = {(r["shard"], r["token"]): (r["n"], r["places"]) for r in V.look_up(shards, spark.createDataFrame(asked * 2, "shard long, token int, start int, stop long")).collect()}
    assert len(got) == 4 * len(held)
    for (s, t), (n, places) in got.items():
        ids = held[s].ids().tolist()
        want = [i for i, x in enumerate(ids) if x == t and (t != red or 3 <= i < 30)]
        assert (n, places) == (len(want), want)


def test_empty_table(spark, folder):
    assert V.op12_wavelet_shards(spark, folder([])).count() == 0
