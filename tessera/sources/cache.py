"""Cached results as a table: one folder a provider, rows with the key of their request and when they expire.

A write replaces the rows of its keys by overwriting the providers it touches and no other; expired rows go then too.
Embeddings don't expire: their table is only appended to, and readers take one row of each key, so that two runs may
write the same key at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import cache_key
from tessera.staging import materialise


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _delete(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def with_key(requests: DataFrame, *columns: str) -> DataFrame:
    """requests with cache_key, the digest of their columns in order."""
    return requests.withColumn("cache_key", cache_key(*[F.col(c).cast("string") for c in columns]))


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    fields = [f for f in schema.fields if f.name not in ("cache_key", "provider", "expires_at")]
    full = T.StructType([T.StructField("cache_key", T.StringType()), *fields, T.StructField("expires_at", T.TimestampType()), T.StructField("provider", T.StringType())])
    return spark.read.schema(full).parquet(path) if exists(spark, path) else spark.createDataFrame([], full)


def put(path: str, rows: DataFrame, ttl: str, now: Column) -> None:
    """Store rows (cache_key, provider, ...), which expire `ttl` (an interval, such as '1 hour') after now."""
    spark = rows.sparkSession
    old = _stored(spark, path, rows.schema).where(F.col("expires_at") >= now)
    new = materialise(rows.withColumn("expires_at", (now + F.expr(f"INTERVAL {ttl}")).cast("timestamp")), "cache-rows")
    kept = old.join(new.select("provider").distinct(), "provider", "left_semi").join(new.select("cache_key").distinct(), "cache_key", "left_anti")
    merged = materialise(kept.select(*old.columns).unionByName(new.select(*old.columns)), "cache-merged")  # what is read isn't overwritten meanwhile
    merged.repartition("provider", F.pmod(F.xxhash64("cache_key"), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("provider").parquet(path)


def get(path: str, requests: DataFrame, schema: T.StructType, now: Column) -> DataFrame:
    """The stored rows of requests (cache_key, provider) that have not expired; schema: of the rows that put() got."""
    spark = requests.sparkSession
    held = _stored(spark, path, schema).where(F.col("expires_at") >= now).drop("expires_at")
    return held.join(requests.select("provider", "cache_key").distinct(), ["provider", "cache_key"], "left_semi").select(*schema.names)


def through(path: str, requests: DataFrame, compute: Callable[[DataFrame], DataFrame], schema: T.StructType, ttl: str, now: Column) -> DataFrame:
    """The rows of all requests: stored ones, and those that compute(missing requests) gives, which are stored."""
    hits = materialise(get(path, requests, schema, now), "cache-hits")
    missing = requests.join(hits.select("provider", "cache_key").distinct(), ["provider", "cache_key"], "left_anti")
    new = materialise(compute(missing.select(*requests.columns)).select(*schema.names), "cache-computed")
    if not new.isEmpty():
        put(path, new, ttl, now)
    return hits.unionByName(new)


def clear(spark: SparkSession, path: str, provider: str | None = None) -> bool:
    """Remove a provider's folder, or the whole table; whether there was one."""
    return _delete(spark, path if provider is None else f"{path}/provider={provider}")


def embedded(path: str, texts: DataFrame, model: str, compute: Callable[[DataFrame], DataFrame], text: str = "text") -> DataFrame:
    """texts with embedding: read from the table at `path` by the digest of model and text, or made by compute (cache_key, text -> cache_key, embedding) and appended.

    Equal texts are computed once, null texts not at all (their embedding is null).
    """
    spark = texts.sparkSession
    keyed = texts.withColumn("cache_key", cache_key(F.lit(model), F.col(text)))
    keyed = keyed.withColumn("cache_key", F.when(F.col(text).isNotNull(), F.col("cache_key")))
    wanted = keyed.where(F.col(text).isNotNull()).groupBy("cache_key").agg(F.min(text).alias(text))
    schema = "cache_key string, embedding array<float>"
    known = lambda: spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
    missing = materialise(wanted.join(known(), "cache_key", "left_anti"), "cache-missing")
    if not missing.isEmpty():
        compute(missing).select("cache_key", F.col("embedding").cast("array<float>").alias("embedding")).write.mode("append").parquet(path)
    once = known().groupBy("cache_key").agg(F.first("embedding").alias("embedding"))
    return keyed.join(once, "cache_key", "left").drop("cache_key")
