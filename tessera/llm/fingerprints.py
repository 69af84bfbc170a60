"""Operator 1: document fingerprints by SimHash.

Terms are the words of the text with A-Z lower-cased. A term that occurs tf times weighs 1 + ln(tf) (in steps of
1/64, so sums are exact) and votes with that weight for or against each of 128 bits, by the bits of its hash. A bit is
1 where the votes for it exceed those against it. Empty and null texts have no terms and get the zero fingerprint;
equal texts get equal fingerprints.

near_fingerprints() finds all fingerprints within a Hamming radius r of queries. The 128 bits are cut into r + 1
blocks; two fingerprints that differ in at most r bits agree on a whole block, so r + 1 tables, each keyed by the
block that its permutation puts first, hold every pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.staging import materialise, tables
from tessera.llm.textbytes import LOWER, mix, slices, span_hashes, utf8, words

BITS = 128
RADIUS = 3


def simhash(hashes: np.ndarray) -> bytes:
    """The fingerprint of one text from the hashes of its words, repeats included."""
    if not len(hashes):
        return bytes(BITS // 8)
    terms, times = np.unique(hashes, return_counts=True)
    weights = np.rint(64 * (1 + np.log(times)))
    votes = np.zeros(BITS)
    for at in range(0, len(terms), 1 << 14):
        part = terms[at : at + (1 << 14)]
        lanes = np.stack([mix(part, 0x5851F42D4C957F2D), mix(part, 0x14057B7EF767814F)], axis=1)
        votes += weights[at : at + (1 << 14)] @ np.unpackbits(lanes.view(np.uint8).reshape(len(part), -1), axis=1).astype(np.float64)
    return np.packbits(2 * votes > weights.sum()).tobytes()


def fingerprints_of(texts: pa.Array) -> list[bytes]:
    data, offsets = utf8(texts)
    data = LOWER[data]
    starts, ends, bounds = words(data, offsets)
    hashes = span_hashes(data, starts, ends)
    return [simhash(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]


def with_fingerprint(df: DataFrame, text: str = "text", name: str = "fingerprint", keep_text: bool = True) -> DataFrame:
    """Add the fingerprint of a text column as 32 hex digits."""
    fields = [f for f in df.schema.fields if keep_text or f.name != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{name}` string"
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                marks = [x.hex() for x in fingerprints_of(part.column(text))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(marks, pa.string())], [*names, name])

    return df.mapInArrow(run, schema)


def likeness(a, b):
    """1 less the share of bits that differ, of two columns of 32 hex digits."""
    half = lambda c, at: F.conv(F.substring(c, at, 16), 16, -10).cast("long")
    differ = sum(F.bit_count(half(a, at).bitwiseXOR(half(b, at))) for at in (1, 17))
    return 1.0 - differ / F.lit(float(BITS))


def near_fingerprints(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Every pair (query, fingerprint) of distinct fingerprints within `radius` bits, by radius + 1 block tables.

    Both inputs need a column fingerprint; they are made distinct first, so copies cost nothing. Keys hold
    BITS / (radius + 1) bits, 32 with the default: as many as 2 ** 32 values, hence short buckets at any size.
    """
    blocks, digits = radius + 1, BITS // 4
    cuts = [round(i * digits / blocks) for i in range(blocks + 1)]
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("tab"), F.substring("fingerprint", a + 1, b - a).alias("block")) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))])).alias("key")
    q = queries.select("fingerprint").distinct().select(F.col("fingerprint").alias("query"), keys).select("query", "key.*")
    p = prints.select("fingerprint").distinct().select("fingerprint", keys).select("fingerprint", "key.*")
    differ = F.round((1.0 - likeness(F.col("query"), F.col("fingerprint"))) * BITS).cast("int")
    return q.join(p, ["tab", "block"]).where((F.col("query") != F.col("fingerprint")) & (differ <= radius)).select("query", "fingerprint", differ.alias("distance")).distinct()


def beside_next(docs: DataFrame, columns: list[str], order: str = "doc_id", buckets: int | None = None, keys: DataFrame | None = None) -> DataFrame:
    """Each row with next_<column> of the row that follows by `order` (nulls first, ties by text; after the last the first).

    Rows go to ranges of `order` by approximate quantiles, at four ranges a shuffle partition, and the first row of
    each range is also sent to the range before it, so that no window spans the table. keys: the column `order` of
    docs from a cheaper source, if docs is costly.
    """
    spark = docs.sparkSession
    n = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = docs.select(order) if keys is None else keys
    quantiles = keys.agg(F.percentile_approx(F.col(order).cast("double"), [i / n for i in range(1, n)], 10 * n)).first()[0] or []
    splits = [-math.inf, *(sorted(set(quantiles)) or [0.0]), math.inf]
    ranged = Bucketizer(splits=splits, inputCol="_at", outputCol="_range", handleInvalid="keep")
    placed = ranged.transform(docs.withColumn("_at", F.col(order).cast("double"))).drop("_at")
    placed = placed.withColumn("_range", F.when(F.col(order).isNull(), -1).otherwise(F.col("_range").cast("int")))
    # one row a range: as many as there are ranges, whatever the size of the table
    firsts = sorted(ranged.transform(keys.select(F.col(order), F.col(order).cast("double").alias("_at"))).select(F.when(F.col(order).isNull(), -1).otherwise(F.col("_range").cast("int")).alias("r"), order).groupBy("r").agg(F.min(order)).collect())
    before = [(head, firsts[i - 1][0]) for i, (_, head) in enumerate(firsts)] or [(None, 0)]
    heads = spark.createDataFrame(before, f"_head {docs.schema[order].dataType.simpleString()}, _before int")
    target = lambda r, copy: F.struct(r.alias("r"), F.lit(copy).alias("copy"))
    spread = placed.join(F.broadcast(heads), F.col(order).eqNullSafe(F.col("_head")), "left").withColumn("_to", F.explode(F.when(F.col("_before").isNotNull(), F.array(target(F.col("_range"), False), target(F.col("_before"), True))).otherwise(F.array(target(F.col("_range"), False)))))
    window = Window.partitionBy("_to.r").orderBy("_to.copy", F.col(order).asc_nulls_first(), "text")
    out = spread.select("*", *[F.lead(c).over(window).alias(f"next_{c}") for c in columns])
    return out.where(~F.col("_to.copy")).drop("_head", "_before", "_to", "_range")


def op1_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts.

    n_near: for documents whose id is divisible by 100, how many other distinct fingerprints lie within RADIUS bits
    (by the block tables); null for the others.
    """
    docs = tables(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    marked = beside_next(with_fingerprint(docs), ["text", "fingerprint"], keys=docs.select("doc_id"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    both = marked.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", edited.alias("edited"))
    both = both.select("*", F.sha2("edited", 256).alias("edited_sha256"))
    done = materialise(with_fingerprint(both, "edited", "edited_fingerprint", keep_text=False), "fingerprints")
    near = near_fingerprints(done.where(F.col("doc_id") % 100 == 0), done).groupBy("query").count()
    return done.join(near, (F.col("query") == F.col("fingerprint")) & (F.col("doc_id") % 100 == 0), "left").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        F.when(F.col("doc_id") % 100 == 0, F.coalesce("count", F.lit(0))).alias("n_near"),
    )


QUERIES = {"op1_simhash_fingerprints": op1_simhash_fingerprints}
ORACLE_SQL: dict[str, str] = {}
