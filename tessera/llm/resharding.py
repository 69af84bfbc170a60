"""Operator 2: resharding by minimum-cost flow.

Old shards hold blocks of rows; new shards have capacities. A flow network (old shard -> new shard, cost 0 to stay and
1 a byte to move, or a given cost matrix) is solved for the bytes that each pair exchanges, by successive shortest
paths with potentials; whole blocks then realise those transfers, largest first. The network has shards x shards
edges and the block table a bounded number of rows, so both fit the driver at any size of the data; the rows
themselves never leave Spark.
"""

from __future__ import annotations

import heapq
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.staging import tables

NEW_SHARDS = 24
OLD_SHARDS = 16
#: Blocks of all old shards together; the only table collected to the driver has one row a block.
BLOCKS = 4096
#: A block above SPLIT_SHARE of a new shard's capacity is split between groups, and inside a group only if the group
#: itself exceeds GROUP_SHARE, so a huge group of equal texts can't unbalance the shards.
SPLIT_SHARE = 1 / 64
GROUP_SHARE = 1 / 4


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """flow[i][j] that ships all supply within the capacities at the least total cost.

    sum(capacity) must be at least sum(supply). Successive shortest paths: Dijkstra on reduced costs from all sources
    with supply left, then push the bottleneck of the shortest path to a shard with room.
    """
    n, m = len(supply), len(capacity)
    assert sum(capacity) >= sum(supply), "the new shards can't hold the data"
    left, room = list(supply), list(capacity)
    flow = [[0] * m for _ in range(n)]
    up, vp = [0] * n, [min((cost[i][j] for i in range(n)), default=0) for j in range(m)]
    while any(left):
        best, via, done = [0 if left[i] else None for i in range(n)] + [None] * m, [-1] * (n + m), [False] * (n + m)
        heap = [(0, i) for i in range(n) if left[i]]
        while heap:
            d, x = heapq.heappop(heap)
            if done[x]:
                continue
            done[x] = True
            if x < n:
                steps = ((n + j, cost[x][j] + up[x] - vp[j]) for j in range(m))
            else:
                steps = ((i, -(cost[i][x - n] + up[i] - vp[x - n])) for i in range(n) if flow[i][x - n])
            for y, c in steps:
                if not done[y] and (best[y] is None or d + c < best[y]):
                    best[y], via[y] = d + c, x
                    heapq.heappush(heap, (d + c, y))
        # potentials make the steps of shortest paths cost nothing; every new shard is reached, since all pairs are edges
        far = max(d for d in best if d is not None)
        for i in range(n):
            up[i] += best[i] if best[i] is not None else far
        for j in range(m):
            vp[j] += best[n + j]
        end = n + min((j for j in range(m) if room[j]), key=lambda j: vp[j])
        path, x = [], end
        while via[x] >= 0:
            path.append((via[x], x))
            x = via[x]
        push = min([left[x], room[end - n], *(flow[b][a - n] for a, b in path if a >= n)])
        for a, b in path:
            if a < n:
                flow[a][b - n] += push
            else:
                flow[b][a - n] -= push
        left[x] -= push
        room[end - n] -= push
    return flow


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def plan_blocks(blocks: list[tuple[int, int, int, int]], new_shards: int, stay: dict[int, int] | None = None) -> dict[tuple[int, int, int], int]:
    """The new shard of each block (old shard, block, part, bytes): transfers by flow, realised block by block.

    Old shard i continues as new shard stay[i] (by default i, if there is one). Blocks go largest first to the
    new shard with the most of the flow from their old shard still open; what the sizes of blocks don't allow is
    made good by the small blocks at the end.
    """
    olds = sorted({b[0] for b in blocks})
    stay = stay if stay is not None else {o: o for o in olds if o < new_shards}
    supply = [sum(b[3] for b in blocks if b[0] == o) for o in olds]
    capacity = even_capacities(sum(supply), new_shards)
    flow = min_cost_flow(supply, capacity, [[0 if stay.get(o) == j else 1 for j in range(new_shards)] for o in olds])
    open_to = {o: flow[i] for i, o in enumerate(olds)}
    room = list(capacity)
    chosen: dict[tuple[int, int, int], int] = {}
    for old, block, part, size in sorted(blocks, key=lambda b: (-b[3], b[:3])):
        own = open_to[old]
        j = max(range(new_shards), key=lambda j: (own[j] >= size and room[j] >= size, min(own[j], room[j]) if own[j] >= size and room[j] >= size else room[j], stay.get(old) == j, -j))
        own[j] -= size
        room[j] -= size
        chosen[old, block, part] = j
    return chosen


def resharded(docs: DataFrame, old_shard: Column, size: Column, group: Column, row: Column, new_shards: int = NEW_SHARDS, blocks: int = BLOCKS) -> DataFrame:
    """docs with old_shard, shard and slot (gapless from 0 in each shard, by block, part of a block and `row`).

    Rows of one group share a shard, unless the group exceeds GROUP_SHARE of a shard. The old shard and the size must
    not be null; group and row may, and rows may repeat. Columns of docs called old_shard, shard or slot are replaced.
    """
    spark = docs.sparkSession
    per_shard = max(1, blocks // max(1, OLD_SHARDS))
    made = ("old_shard", "shard", "slot")
    own = [c for c in docs.columns if c.lower() not in made]
    doc = F.struct(*[F.col(f"`{c}`") for c in own], F.lit(0).alias("_")).alias("_doc")
    keyed = docs.select(doc, old_shard.cast("int").alias("_old"), size.cast("long").alias("_size"), F.coalesce(F.xxhash64(group), F.lit(0)).alias("_group"), F.xxhash64(row).alias("_row"), row.alias("_order"))
    keyed = keyed.withColumn("_block", F.pmod(F.xxhash64("_group"), F.lit(per_shard)).cast("int"))
    whole = keyed.groupBy("_old", "_block").agg(F.sum("_size").alias("bytes"), F.count("*").alias("rows"))
    sizes = whole.collect()  # at most `blocks` rows
    most = max(1.0, sum(r["bytes"] for r in sizes) / new_shards * SPLIT_SHARE)
    most_rows = max(1.0, sum(r["rows"] for r in sizes) / new_shards * SPLIT_SHARE)
    parts = [(r["_old"], r["_block"], min(r["rows"], max(int(r["bytes"] / most) if r["bytes"] > most else 0, int(r["rows"] / most_rows)) + 1), int(r["rows"] / most_rows) + 1) for r in sizes if r["rows"] > 1 and (r["bytes"] > most or r["rows"] > most_rows)]
    split = spark.createDataFrame(parts, "_old int, _block int, _parts int, _runs int")
    # fewer than new_shards / GROUP_SHARE groups can each exceed the share
    heavy = keyed.join(F.broadcast(split), ["_old", "_block"], "left_semi").groupBy("_group").agg(F.sum("_size").alias("b")).where(F.col("b") > most / SPLIT_SHARE * GROUP_SHARE).select(F.col("_group").alias("_heavy"))
    keyed = keyed.join(F.broadcast(split), ["_old", "_block"], "left").join(F.broadcast(heavy), F.col("_group") == F.col("_heavy"), "left")
    salt = F.when(F.col("_heavy").isNotNull(), F.col("_row")).otherwise(F.xxhash64("_group", F.lit("part")))
    keyed = keyed.withColumn("_part", F.pmod(salt, F.coalesce("_parts", F.lit(1)).cast("long")).cast("int"))
    # a group of very many rows is numbered in several runs, though it stays in one shard
    keyed = keyed.withColumn("_run", F.pmod(F.xxhash64("_row"), F.coalesce("_runs", F.lit(1)).cast("long")).cast("int"))
    # at most `blocks` rows, and 1 / SPLIT_SHARE more by bytes and by rows for each new shard
    table = [tuple(r) for r in keyed.groupBy("_old", "_block", "_part", "_run").agg(F.sum("_size"), F.count("*")).collect()]
    bytes_of: Counter[tuple[int, int, int]] = Counter()
    for o, b, p, _, size_, _ in table:
        bytes_of[o, b, p] += size_
    shard_of = plan_blocks([(*k, n) for k, n in bytes_of.items()], new_shards)
    base, plan = [0] * new_shards, []
    for o, b, p, run, _, rows in sorted(table, key=lambda t: t[:4]):
        j = shard_of[o, b, p]
        plan.append((o, b, p, run, j, base[j]))
        base[j] += rows
    plan_df = spark.createDataFrame(plan, "_old int, _block int, _part int, _run int, shard int, _base long")
    within = Window.partitionBy("_old", "_block", "_part", "_run").orderBy("_order", "_row")
    out = keyed.join(F.broadcast(plan_df), ["_old", "_block", "_part", "_run"]).withColumn("slot", F.col("_base") + F.row_number().over(within) - 1)
    return out.select(*[F.col("_doc")[c].alias(c) for c in own], F.col("_old").alias("old_shard"), "shard", "slot")


def rewrite_affected(placed: DataFrame, path: str) -> DataFrame:
    """Write only the new shards that gain or lose rows, as shard=<n> folders; return (shard, rewritten).

    placed: the output of resharded(). A shard whose rows all come from the old shard of its number, and from
    which none leaves, keeps its files.
    """
    moves = placed.select("old_shard", "shard").distinct().where("old_shard <> shard")
    touched = moves.select(F.explode(F.array("old_shard", "shard")).alias("shard")).distinct()
    affected = placed.join(F.broadcast(touched), "shard", "left_semi")  # one row a shard
    affected.repartition("shard", F.pmod("slot", F.lit(8))).write.partitionBy("shard").parquet(path)
    return placed.select("shard").distinct().join(touched.withColumn("rewritten", F.lit(True)), "shard", "left").fillna(False)


def op2_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents from 16 old shards (by the text's checksum) into 24 of near equal bytes, moving the fewest.

    A null text counts as empty. Null and repeated ids are placed like any other row; equal texts share a shard unless
    they exceed GROUP_SHARE of one.
    """
    text = F.coalesce("text", F.lit(""))
    docs = tables(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_hash"))
    placed = resharded(docs, F.pmod("text_crc32", F.lit(OLD_SHARDS)), F.col("size"), F.col("text_hash"), F.col("doc_id"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "old_shard")


QUERIES = {"op2_flow_resharding": op2_flow_resharding}
ORACLE_SQL: dict[str, str] = {}
