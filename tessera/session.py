"""Sessions for local runs; on a cluster the session is given."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(name: str = "tessera", cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "6g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tessera-"))  # driver and executors are one process here
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
