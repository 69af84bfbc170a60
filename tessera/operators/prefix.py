"""Running values and numbers of an ordered table without one window over all of it.

A table is cut into ranges of its order. Each range has its own running values; its totals, of which there are as many
as ranges, are folded into what stands before it, and both are put together row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.staging import materialise


def before(totals: DataFrame, keys: Sequence[str], span: str, start: Column, fold: Callable[[Column, Column], Column], name: str = "before") -> DataFrame:
    """(keys, span, name): for every row of totals (keys, span, ..) the fold of the rows of smaller spans of its keys.

    The totals of one key meet in one row, so their number must be that of its ranges.
    """
    own = [c for c in totals.columns if c not in keys]
    rows = totals.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(span, *[c for c in own if c != span]))).alias("_all"))
    each = rows.select(*keys, "_all", F.posexplode("_all").alias("_i", "_x"))
    return each.select(*keys, F.col("_x")[span].alias(span), F.aggregate(F.slice("_all", 1, F.col("_i")), start, fold).alias(name))


def joined(df: DataFrame, found: DataFrame, keys: Sequence[str], span: str) -> DataFrame:
    """df with the columns that found has for its keys and span; null keys meet."""
    same = F.lit(True)
    for c in (*keys, span):
        same = same & df[c].eqNullSafe(found[f"_of_{c}"])
    return df.join(found, same).drop(*[f"_of_{c}" for c in (*keys, span)])


def with_before(df: DataFrame, totals: DataFrame, keys: Sequence[str], span: str, start: Column, fold: Callable[[Column, Column], Column], name: str = "before") -> DataFrame:
    found = before(totals, keys, span, start, fold, name)
    return joined(df, found.select(*[F.col(c).alias(f"_of_{c}") for c in (*keys, span)], name), keys, span)


def with_position(df: DataFrame, order: Sequence[Column | str], keys: Sequence[str], span: str, name: str = "position") -> DataFrame:
    """df with each row's number from 0 in its keys. span: a column that never falls in this order."""
    within = F.row_number().over(Window.partitionBy(*keys, span).orderBy(*order))
    placed = with_before(df.withColumn("_n", within), df.groupBy(*keys, span).agg(F.count("*").alias("_c")), keys, span, F.lit(0).cast("long"), lambda a, x: a + x["_c"], "_before")
    return placed.withColumn(name, F.col("_before") + F.col("_n") - 1).drop("_n", "_before")


def numbered(df: DataFrame, *order: Column | str, name: str = "number", first: int = 1) -> DataFrame:
    """df with gapless numbers by `order`, which must tell all rows apart: rows go to ranges of it, which are counted and numbered by themselves."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialise(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    return with_position(placed, order, (), "_part", name).withColumn(name, F.col(name) + first).drop("_part")


def over_blocks(df: DataFrame, position: str, keys: Sequence[str], reach: int, size: int, columns: Callable[[Window], dict[str, Column]]) -> DataFrame:
    """df with columns over frames that reach `reach` rows back: blocks of `size` positions, each with the last rows of the one before."""
    assert 0 <= reach <= size, "a block must be as long as its frame reaches back"
    block = F.floor(F.col(position) / size)
    last = F.col(position) % size >= size - reach
    spread = df.withColumn("_own", block).withColumn("_block", F.explode(F.when(last, F.array(block, block + 1)).otherwise(F.array(block))))
    frame = Window.partitionBy(*keys, "_block").orderBy(position).rowsBetween(-reach, 0)
    return spread.withColumns(columns(frame)).where("_own = _block").drop("_own", "_block")
