"""Connected components by repeated contraction in joins and grouped minima; the last edges, a bounded number, are united in one task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.staging import materialise

#: Edges that one task unites. A round of joins on fewer costs the driver a dozen plans, broadcasts and their threads, and saves no work.
FEW = 10_000


def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) -> (x, parent) of every node, parent the smallest node of its component."""
    parent: dict = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    kind = pa.int64()
    for batch in batches:
        kind = batch.schema.field("a").type
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    yield pa.RecordBatch.from_arrays([pa.array(list(parent), kind), pa.array([root(x) for x in list(parent)], kind)], ["x", "parent"])


def contract(edges: DataFrame, few: int = FEW) -> list[DataFrame]:
    """Tables (x, parent) that, applied one after the other, take every node of edges (a, b) to its component's root.

    Each round lets every node hook to its smallest neighbour if that is smaller, follows the pointers three times,
    and keeps the edges between different parents: the nodes left fall by a constant factor a round, whatever the
    graph's diameter, and neither a node's neighbours nor a component ever meets in one place, until `few` edges are
    left at most: these are united in one task.
    """
    rounds: list[DataFrame] = []
    live = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while (n := live.count()) > few:
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), F.least("a", "m").alias("parent"))
        hook = materialise(hook, "hook")
        for _ in range(2):
            up = hook.select(F.col("x").alias("parent"), F.col("parent").alias("above"))
            hook = hook.join(up, "parent").select("x", F.col("above").alias("parent"))
        hook = materialise(hook, "parents")
        rounds.append(hook)
        a, b = (hook.select(F.col("x").alias(c), F.col("parent").alias(f"p{c}")) for c in "ab")
        live = materialise(live.join(a, "a").join(b, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    if n:
        kind = live.schema["a"].dataType.simpleString()
        rounds.append(materialise(live.coalesce(1).mapInArrow(united, f"x {kind}, parent {kind}"), "parents"))
    return rounds


def rooted(nodes: DataFrame, rounds: list[DataFrame], column: str, name: str = "root") -> DataFrame:
    """nodes with `name`, the root of the component of `column`; a node without edges is its own root."""
    out = nodes.withColumn(name, F.col(column))
    for r in rounds:
        out = out.join(r.withColumnRenamed("x", name), name, "left").withColumn(name, F.coalesce("parent", name)).drop("parent")
    return out
