"""A chunk table kept by a stream: batches replace chunks, and a batch that comes again changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tessera.operators.corpus import first_of, replace_sources, upsert
from tessera.sources.cache import exists
from tessera.staging import materialise


def chunk_table(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table at `path`, or an empty one with the columns of `like`."""
    return spark.read.schema(like.schema).parquet(f"{path}/chunks").select(*like.columns) if exists(spark, f"{path}/chunks") else like.where(F.lit(False))


def apply_batch(batch: DataFrame, batch_id: int, path: str, order: str = "seq", replace: bool = False) -> None:
    """Put a batch (chunk_id, source, `order`, ..) into the table at `path`; of rows with one id the first by `order` counts.

    Only the folders of the batch's sources are written anew. Done batches are noted; a batch that was stopped half-way
    is done again in full, which gives the same table. replace: other chunks of the batch's sources go. A chunk's source
    must not change, as its id is made from it.
    """
    spark = batch.sparkSession
    done = f"{path}/batches/{batch_id}"
    if exists(spark, f"{done}/_SUCCESS"):
        return
    new = materialise(first_of(batch, "chunk_id", order), "batch")
    if not new.isEmpty():
        table = chunk_table(spark, path, batch)
        own = table.join(new.select("source").distinct(), "source", "left_semi").select(*batch.columns)
        merged = materialise((replace_sources if replace else upsert)(own, new), "merged")
        merged.repartition("source", F.pmod(F.xxhash64("chunk_id"), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(f"{path}/chunks")
    spark.range(1).write.mode("overwrite").parquet(done)


def keep_chunks(stream: DataFrame, path: str, checkpoint: str, order: str = "seq", replace: bool = False) -> DataStreamWriter:
    """A writer that applies the batches of a stream of chunks to the table at `path`."""
    return stream.writeStream.foreachBatch(lambda batch, batch_id: apply_batch(batch, batch_id, path, order, replace)).option("checkpointLocation", checkpoint)


def chunks_once(stream: DataFrame, time: str = "ts", lateness: str = "1 hour", key: str = "chunk_id") -> DataFrame:
    """The first row of each key; later ones are dropped as long as they come within `lateness` of it. State older than that goes."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])
