"""Tables of a folder, and bounds for what is gathered from them."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.textbytes import forget
from tessera.staging import materialise, shared_dir

__all__ = ["bounded_memory", "count_floor", "give_back", "lent", "materialise", "shared_dir", "shielded", "stable", "tables", "tidy"]


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder, in a session of bounded_memory()."""
    bounded_memory(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def lent(shared: Broadcast) -> Iterator[Any]:
    """The value of a broadcast variable in a task. A Python worker that waits for its next task then holds no copy of it."""
    try:
        yield shared.value
    finally:
        vars(shared).pop("_value", None)  # would be read again from the worker's file
        give_back()


def give_back() -> None:
    """Return what a Python worker has freed to the system: it may wait long for its next task. Only the GNU C library has a call for that."""
    forget()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function of batches, which gives its memory back when a task ends."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


#: The bytes of an Arrow batch where rows carry whole documents through several Python stages of a task.
BATCH_BYTES = 4 << 20
#: Settings of the C allocator of Python workers, which wait for their next tasks with what they don't give back.
WORKER_MEMORY = {"MALLOC_MMAP_THRESHOLD_": "16777216", "MALLOC_TRIM_THRESHOLD_": "16777216"}


def bounded_memory(spark: SparkSession) -> None:
    """Lower the session's bound of the bytes of an Arrow batch to BATCH_BYTES, and let its Python workers give back what they freed; no result depends on it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    for variable, value in WORKER_MEMORY.items():
        spark.sparkContext.environment.setdefault(variable, value)


def shielded(docs: DataFrame, kept: tuple[str, ...] = ("doc_id", "text"), made: tuple[str, ...] = ()) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """docs with every column but `kept` under a name that no operator uses, and a function that gives the names back (and adds columns).

    Columns of docs called like one of `made`, which the operator adds, are left out.
    """
    names = [c for c in docs.columns if c.lower() not in {m.lower() for m in made}]
    own = {c: c if c in kept else f"own{i}_" for i, c in enumerate(names)}
    safe = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in own.items()])
    return safe, lambda out, *more: out.select(*[F.col(o).alias(c) for c, o in own.items()], *more)


def stable(docs: DataFrame) -> DataFrame:
    """docs, such that rows can be numbered by the plan: as it is if it only reads files, selects and filters; else written first."""
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    kinds = {line.lstrip(" :+-").split("(")[0].split(" ")[0] for line in plan.splitlines() if line.strip()}
    return docs if kinds <= {"Project", "Filter", "Relation"} and docs.inputFiles() else materialise(docs, "rows")


def count_floor(counts: DataFrame, column: str, most: int, weight: Column | None = None, most_weight: int = 0) -> int:
    """A count that at most `most` rows reach, of at most `most_weight` in sum: a power of two or one half more, from one aggregate."""
    step = F.floor(F.log2(F.col(column).cast("double")) * 2).cast("int")
    heavy = F.lit(0) if weight is None else weight.cast("long")
    rows = counts.where(F.col(column) >= 1).groupBy(step.alias("step")).agg(F.count("*"), F.sum(heavy), F.min(column)).collect()  # at most 126 rows
    floor, n, total = 1 << 62, 0, 0
    for _, here, own, least in sorted(rows, reverse=True):
        n, total = n + here, total + own
        if n > most or total > most_weight:
            break
        floor = least
    return floor
