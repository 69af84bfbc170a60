"""Operator 11 against all lags of all words, and on odd texts."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import periodic_runs as P

ODD = [None, "", " \n ", "a", "a", "Ab ab AB " * 4000, "é ü ñ \U0001f600 日本 ▁x", "x " * 3000, "the quick fox\n" * 9, "\t\x0b\x0c", "a b " * 30, "a\x1cb c " * 24]


def brute_runs(words):
    """Every maximal stretch with period q, for all q; of equal stretches the smallest q."""
    best, n = {}, len(words)
    for q in range(1, n // 3 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            e = i
            while e + 1 < n and words[e + 1] == words[e + 1 - q]:
                e += 1
            start, length = i - q, e - i + 1 + q
            if length >= max(24, 3 * q):
                best.setdefault((start, length), q)
            i = e + 2
    return sorted(((s, m, q) for (s, m), q in best.items()), key=lambda r: (r[0], r[2]))


def periodic_texts(seed, n=60):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        words = [r.choice("abcdefg") for _ in range(r.randint(0, 30))]
        for _ in range(r.randint(1, 4)):
            block = [r.choice("ab" if r.random() < 0.5 else "abcdefghij") for _ in range(r.choice([1, 2, 3, 5, 8, 9, 16, 17, 20, 33, 50]))]
            if r.random() < 0.4:
                block = block * 3 + [r.choice("abc")]
            words += (block * 9)[: r.randint(len(block), 6 * len(block) + 30)]
            words += [r.choice("abcdefg") for _ in range(r.randint(0, 6))]
        out.append(words)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_all_lags(seed):
    texts = periodic_texts(seed)
    ids = np.array([ord(w) for ws in texts for w in ws], np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(ws) for ws in texts])])
    want = [brute_runs(ws) for ws in texts]
    assert P.runs(ids, bounds) == want
    assert sum(map(len, want)) > 40


def test_nested_runs_and_thresholds():
    r = lambda s: P.runs(np.array(list(map(ord, s)), np.int64), np.array([0, len(s)]))[0]
    assert r("a" * 23) == [] and r("a" * 24) == [(0, 24, 1)]
    assert r("abcdefgh" * 3) == [(0, 24, 8)] and r("abcdefgh" * 2 + "abcdefg") == []
    assert r(("a" * 24 + "b") * 3) == [(0, 24, 1), (0, 75, 25), (25, 24, 1), (50, 24, 1)]


def test_one_word_throughout_is_no_square():
    n = 1 << 17
    assert P.runs(np.zeros(n, np.int64), np.array([0, n])) == [[(0, n, 1)]]


def test_query(spark, folder):
    texts = [" ".join(ws) for ws in periodic_texts(9)] + ODD
    rows = sorted(P.op11_periodic_runs(spark, folder(texts)).collect(), key=lambda r: r["doc_id"])
    assert len(rows) == len(texts)
    edited = 0
    for x, t in zip(rows, texts):
        words = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode())
        h, n = zlib.crc32(str(x["doc_id"]).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            edited += 1
        found = brute_runs(words) if n < 5000 else P.runs(np.array([hash(w) for w in words], np.int64), np.array([0, n]))[0]
        gone = {i for s, m, q in found for i in range(s + q, s + m)}
        top = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        assert x["n_runs"] == len(found)
        assert (x["start"], x["length"], x["period"], x["exponent_milli"]) == ((*top, 1000 * top[1] // top[2]) if top else (None,) * 4)
        assert x["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest()
        assert x["collapsed_sha256"] == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()
    assert edited > 3


def test_clashing_columns_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a " * 30, 1, "x"), (3, None, 2, "y"), (3, None, 2, "y")], "doc_id long, text string, runs int, best string")
    out = P.with_runs(df)
    assert out.columns == ["doc_id", "text", "best", "runs", "collapsed"]
    rows = out.select("doc_id", P.repeated_tail(F.col("doc_id"), F.col("text")).alias("t"), "runs", "collapsed").collect()
    assert [tuple(map(tuple, r["runs"])) for r in rows] == [((0, 30, 1),), (), ()] and rows[0]["t"] == "a " * 30
    assert [r["collapsed"] for r in rows] == ["a", "", ""]


def test_empty_table(spark, folder):
    assert P.op11_periodic_runs(spark, folder([])).count() == 0
