"""Streams equal their batch counterparts: upserts with a replayed batch, ids once, drawdowns of late rows."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import corpus as C
from tessera.operators import series as S
from tessera.streaming import drawdown as D
from tessera.streaming import upserts as U

SCHEMA = "seq long, chunk_id string, source string, content string"
BATCHES = [
    [(0, "a1", "a", "one"), (1, "a2", "a", "two"), (2, "b1", "b", "three"), (3, "a1", "a", "later copy")],
    [(4, "a2", "a", "two, new"), (5, "c1", "c", "four"), (6, "null", None, "five")],
    [(7, "b1", "b", "three, new"), (8, "b2", "b", "six")],
]


def table(spark, path):
    return sorted((r["chunk_id"], r["source"] or "", r["content"]) for r in spark.read.parquet(f"{path}/chunks").collect())


def in_memory(spark, replace=False):
    held = spark.createDataFrame([], SCHEMA)
    for rows in BATCHES:
        new = C.first_of(spark.createDataFrame(rows, SCHEMA), "chunk_id", "seq")
        held = (C.replace_sources if replace else C.upsert)(held, new)
    return sorted((r["chunk_id"], r["source"] or "", r["content"]) for r in held.collect())


def run(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None


@pytest.mark.parametrize("replace", [False, True])
def test_stream_of_upserts_equals_batches(spark, tmp_path, replace):
    for i, rows in enumerate(BATCHES):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        run(U.keep_chunks(stream, f"{tmp_path}/t", f"{tmp_path}/cp", replace=replace))
    if not replace:
        assert table(spark, f"{tmp_path}/t") == in_memory(spark)
        assert len(table(spark, f"{tmp_path}/t")) == 6
    else:
        assert {x[0] for x in table(spark, f"{tmp_path}/t")} == {"a2", "b1", "b2", "c1", "null"}


def test_replayed_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    frames = [spark.createDataFrame(rows, SCHEMA) for rows in BATCHES]
    for i, f in enumerate(frames):
        U.apply_batch(f, i, path)
    before = table(spark, path)
    U.apply_batch(frames[0], 0, path)  # an old batch comes again after newer ones
    assert table(spark, path) == before == in_memory(spark)
    U.apply_batch(frames[2].limit(0), 3, path)
    assert table(spark, path) == before


def test_chunk_ids_once(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    r = random.Random(4)
    files = []
    for i in range(4):
        files.append([(f"c{r.randrange(40)}", t0 + datetime.timedelta(minutes=10 * i + r.randrange(30)), i) for _ in range(50)])
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, "chunk_id string, ts timestamp, part int").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("chunk_id string, ts timestamp, part int").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run(U.chunks_once(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp"))
    got = sorted(x[0] for x in spark.read.parquet(f"{tmp_path}/out").select("chunk_id").collect())
    assert got == sorted({row[0] for rows in files for row in rows})


def test_running_drawdowns_with_late_rows(spark, tmp_path):
    r = random.Random(6)
    start = datetime.datetime(2024, 1, 1)
    rows = [(t, start + datetime.timedelta(days=i), r.choice([None, -0.5]) if r.random() < 0.1 else r.gauss(0, 0.05)) for t in "ab" for i in range(30)]
    late = rows[:]
    late.sort(key=lambda x: (x[1] + datetime.timedelta(days=r.choice([0, 0, 1, 2])), x[0]))  # up to two days late
    for i in range(0, 60, 15):
        spark.createDataFrame(late[i : i + 15], "ticker string, ts timestamp, ret double").coalesce(1).write.parquet(f"{tmp_path}/in/{i:02}")
    end = start + datetime.timedelta(days=400)
    spark.createDataFrame([("z", end, 0.0)], "ticker string, ts timestamp, ret double").coalesce(1).write.parquet(f"{tmp_path}/in/99")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", D.ROCKSDB)
    try:
        stream = spark.readStream.schema("ticker string, ts timestamp, ret double").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        run(D.running_drawdowns(stream, "7 days").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp"))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    value = lambda x: None if x is None else round(x, 9)
    got = sorted((x["ticker"], x["ts"], value(x["cum"]), value(x["drawdown"])) for x in spark.read.parquet(f"{tmp_path}/out").where("ticker <> 'z'").collect())
    batch = spark.createDataFrame(rows, "ticker string, date timestamp, ret double")
    want = sorted((x["ticker"], x["date"], value(x["cum"]), value(x["drawdown"])) for x in S.drawdowns(batch, ["ticker"]).withColumn("date", F.col("date").cast("timestamp")).collect())
    assert got == want
