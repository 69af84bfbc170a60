"""Cached results: hits, misses, expired and cleared keys; embeddings are computed once."""

import datetime
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources import cache as C

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("cache_key", "provider", "series_id")] + [T.StructField("value", T.DoubleType())])


def at(minute):
    return F.lit(datetime.datetime(2024, 1, 1, 10, minute)).cast("timestamp")


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / uuid.uuid4().hex)


@pytest.fixture
def requests(spark):
    def make(*pairs):
        df = spark.createDataFrame([(p, s, "2024-01-01") for p, s in pairs], "provider string, series_id string, start string")
        return C.with_key(df, "provider", "series_id", "start")

    return make


class Source:
    """Two rows a request; counts what it was asked for."""

    def __init__(self, spark):
        self.calls = []

    def __call__(self, missing):
        self.calls.append(sorted(r["series_id"] for r in missing.collect()))
        return missing.select("cache_key", "provider", "series_id", F.explode(F.array(F.lit(1.0), F.lit(len(self.calls) + 1.0))).alias("value"))


def values(df):
    return sorted((r["provider"], r["series_id"], r["value"]) for r in df.collect())


def test_only_misses_are_computed(spark, path, requests):
    source = Source(spark)
    first = C.through(path, requests(("a", "x"), ("a", "y")), source, SCHEMA, "30 minutes", at(0))
    assert values(first) == [("a", "x", 1.0), ("a", "x", 2.0), ("a", "y", 1.0), ("a", "y", 2.0)]
    second = C.through(path, requests(("a", "x"), ("b", "x"), ("a", "y")), source, SCHEMA, "30 minutes", at(10))
    assert source.calls == [["x", "y"], ["x"]]
    assert values(second) == [("a", "x", 1.0), ("a", "x", 2.0), ("a", "y", 1.0), ("a", "y", 2.0), ("b", "x", 1.0), ("b", "x", 3.0)]


def test_expiry(spark, path, requests):
    source, ask = Source(spark), requests(("a", "x"))
    C.through(path, ask, source, SCHEMA, "30 minutes", at(0))
    assert values(C.get(path, ask, SCHEMA, at(30))) == [("a", "x", 1.0), ("a", "x", 2.0)]
    assert values(C.get(path, ask, SCHEMA, at(31))) == []
    assert values(C.through(path, ask, source, SCHEMA, "30 minutes", at(31))) == [("a", "x", 1.0), ("a", "x", 3.0)]
    assert spark.read.parquet(path).count() == 2  # the expired rows went
    C.put(path, ask.select("cache_key", "provider", "series_id", F.lit(9.0).alias("value")), "-1 seconds", at(32))
    assert values(C.get(path, ask, SCHEMA, at(32))) == []


def test_clearing_one_provider(spark, path, requests):
    source, ask = Source(spark), requests(("a", "x"), ("ab", "x"), ("b", "^z"))
    C.through(path, ask, source, SCHEMA, "1 hour", at(0))
    assert C.clear(spark, path, "a") and not C.clear(spark, path, "a")
    assert {r["provider"] for r in C.get(path, ask, SCHEMA, at(1)).collect()} == {"ab", "b"}
    assert requests(("b", "^z")).first()["cache_key"] != requests(("b", "z")).first()["cache_key"]
    assert C.clear(spark, path) and C.get(path, ask, SCHEMA, at(1)).count() == 0


def test_embeddings_once(spark, path):
    texts = spark.createDataFrame([(1, "red"), (2, "green"), (3, "red"), (4, None)], "id int, text string")
    asked = []

    def embed(missing):
        asked.append(sorted(r["text"] for r in missing.collect()))
        return missing.select("cache_key", F.array(F.length("text").cast("double"), F.lit(0.5)).alias("embedding"))

    want = [(1, [3.0, 0.5]), (2, [5.0, 0.5]), (3, [3.0, 0.5]), (4, None)]
    rows = lambda df: sorted((r["id"], r["embedding"]) for r in df.collect())
    assert rows(C.embedded(path, texts, "m", embed)) == want
    assert rows(C.embedded(path, texts, "m", embed)) == want and asked == [["green", "red"]]
    C.embedded(path, texts.where("id = 1"), "other", embed).count()
    assert asked[1:] == [["red"]]
    # a run beside this one has written the same key too
    spark.read.parquet(path).write.mode("append").parquet(f"{path}-b")
    spark.read.parquet(f"{path}-b").write.mode("append").parquet(path)
    assert rows(C.embedded(path, texts, "m", embed)) == want and len(asked) == 2
