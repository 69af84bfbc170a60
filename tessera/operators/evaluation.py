"""Retrieval evaluation: hits (query_id, source, page, rank) against gold (query_id, source, page)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F


def per_question(hits: DataFrame, gold: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Precision, recall and hit at each k, and the reciprocal rank; a question without results has zeros."""
    right = gold.select("query_id", "source", "page").distinct()
    size = right.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    flagged = hits.select("query_id", "source", "page", "rank").join(right.withColumn("hit", F.lit(1)), ["query_id", "source", "page"], "left").fillna(0, ["hit"])
    columns = [F.coalesce(1 / F.min(F.when(F.col("hit") == 1, F.col("rank"))), F.lit(0.0)).alias("rr")]
    for k in ks:
        top = F.col("rank") <= k
        columns += [
            F.coalesce(F.try_divide(F.sum(F.when(top, F.col("hit"))), F.count(F.when(top, 1))), F.lit(0.0)).alias(f"precision_{k}"),
            F.countDistinct(F.when(top & (F.col("hit") == 1), F.struct("source", "page"))).alias(f"found_{k}"),
            F.coalesce(F.max(F.when(top, F.col("hit"))), F.lit(0)).cast("double").alias(f"hit_{k}"),
        ]
    scores = size.join(flagged.groupBy("query_id").agg(*columns), "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return scores.select("query_id", *[x for k in ks for x in (zero(f"precision_{k}"), F.coalesce(F.col(f"found_{k}") / F.col("n_gold"), F.lit(0.0)).alias(f"recall_{k}"), zero(f"hit_{k}"))], zero("rr"))


def aggregate(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count("*").alias("n_questions"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in scores.columns if c != "query_id"])


def worst(scores: DataFrame, k: int, n: int = 5) -> DataFrame:
    return scores.orderBy(f"recall_{k}", "rr", "query_id").limit(n).select("query_id", f"recall_{k}", "rr")


def index_gaps(exact: DataFrame, index: DataFrame, floor: float = 0.35) -> DataFrame:
    """Per question the neighbours above the floor that the index missed, and whether its list is the exact one."""
    true = exact.where(F.col("similarity") >= floor).select("query_id", "chunk_id")
    missed = true.join(index.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").groupBy("query_id").agg(F.count("*").alias("missed"))
    return exact.select("query_id").distinct().join(missed, "query_id", "left").select("query_id", F.coalesce("missed", F.lit(0)).alias("missed"))


def unknown_refs(gold: DataFrame, chunks: DataFrame) -> DataFrame:
    """Gold pages that the corpus doesn't have."""
    return gold.select("query_id", "source", "page").join(chunks.select("source", "page").distinct(), ["source", "page"], "left_anti").select("query_id", "source", "page")


def pool_recall(lists: DataFrame, gold: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """(method, n, found): questions with a gold page among the first n of each method's list."""
    hit = lists.join(gold.select("query_id", "source", "page").distinct(), ["query_id", "source", "page"], "left_semi")
    best = hit.groupBy("method", "query_id").agg(F.min("rank").alias("best"))
    each = best.select("method", "best", F.explode(F.array(*map(F.lit, sizes))).alias("n"))
    return each.groupBy("method", "n").agg(F.count(F.when(F.col("best") <= F.col("n"), 1)).alias("found"))


def spreads(scores: DataFrame, keys: Sequence[str], value: str = "score") -> DataFrame:
    """Per key the spread of repeated scores."""
    return scores.groupBy(*keys).agg((F.max(value) - F.min(value)).alias("spread"), F.count("*").alias("passes"))


def latencies(df: DataFrame, key: str, value: str) -> DataFrame:
    """p50 (interpolated) and p95 (the value at index floor(0.95 n) of the sorted list).

    Approximate percentiles first bound each wanted place from both sides; then only the distinct values between the
    bounds are put in order, so no key's rows meet in one task.
    """
    at = df.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).cast("double").alias("v"))
    edges = F.percentile_approx("v", F.array(*map(F.lit, (0.498, 0.502, 0.948, 0.952))), 10000)
    facts = at.groupBy("k").agg(F.count("*").alias("n"), edges.alias("e"))
    both = at.join(facts.withColumnRenamed("k", "own"), F.col("k").eqNullSafe(F.col("own"))).select("k", "v", "n", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.col("e")[i].alias("low"), F.col("e")[i + 1].alias("high")) for i, p in ((0, 50), (2, 95))])).alias("x"))
    inside = F.when(F.col("v") >= F.col("x.low"), F.col("v"))
    counts = both.where(F.col("v") <= F.col("x.high")).groupBy("k", "n", F.col("x.p").alias("p"), inside.alias("v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("k", "p").orderBy(F.col("v").asc_nulls_first()))
    placed = counts.withColumns({"to": upto, "from": upto - F.col("c")})
    middle = (F.col("n") - 1) * 0.5
    holds = lambda i: (F.col("from") <= i) & (i < F.col("to"))
    pick = lambda p, i: F.max(F.when((F.col("p") == p) & holds(i), F.col("v")))
    low, high = pick(50, F.floor(middle)), pick(50, F.ceil(middle))
    p95 = pick(95, F.least(F.floor(F.col("n") * 0.95), F.col("n") - 1))
    return placed.groupBy("k", "n").agg((low + (high - low) * (middle - F.floor(middle))).alias("p50"), p95.alias("p95")).select(F.col("k").alias(key), "p50", "p95")


def repeat_summary(spread: DataFrame, passes: int) -> DataFrame:
    """One row over spreads() of the keys that every pass scored: how many, how many without spread, its maximum and mean, and how many above 0.05 and 0.2."""
    full = spread.where(F.col("passes") == passes)
    over = lambda x: F.count_if(F.col("spread") > x)
    return full.agg(F.count("*").alias("pairs"), F.count_if(F.col("spread") == 0).alias("identical"), F.max("spread").alias("max_spread"), F.avg("spread").alias("mean_spread"), over(0.05).alias("over_005"), over(0.2).alias("over_02"))


def top1_changes(lists: DataFrame) -> DataFrame:
    """query_id of the questions whose first (source, page) isn't the same in every pass; lists (pass, query_id, source, page, rank). A pass without a list counts as another answer."""
    first = lists.where("rank = 1").select("pass", "query_id", F.struct("source", "page").alias("top"))
    passes = lists.agg(F.count_distinct("pass").alias("passes"))
    seen = first.groupBy("query_id").agg(F.count_distinct("top").alias("tops"), F.count_distinct("pass").alias("n"))
    return seen.join(F.broadcast(passes)).where((F.col("tops") > 1) | (F.col("n") < F.col("passes"))).select("query_id")


def gained_lost(lists: DataFrame, gold: DataFrame, base: str, sizes: Sequence[int]) -> DataFrame:
    """(method, n, query_id, change): questions with a gold page among a method's first n that the base method hasn't (gained), and the other way round (lost)."""
    hit = lists.join(gold.select("query_id", "source", "page").distinct(), ["query_id", "source", "page"], "left_semi")
    best = hit.groupBy("method", "query_id").agg(F.min("rank").alias("best"))
    found = best.select("method", "query_id", "best", F.explode(F.array(*map(F.lit, sizes))).alias("n")).where("best <= n").select("method", "n", "query_id")
    methods = lists.select("method").distinct().where(F.col("method") != base)
    own = found.where(F.col("method") == base).select("n", "query_id").join(methods).withColumn("in_base", F.lit(1))
    other = found.where(F.col("method") != base).withColumn("in_method", F.lit(1))
    both = own.join(other, ["method", "n", "query_id"], "full_outer").where(F.col("in_base").isNull() | F.col("in_method").isNull())
    return both.select("method", "n", "query_id", F.when(F.col("in_base").isNull(), "gained").otherwise("lost").alias("change"))


def index_totals(exact: DataFrame, index: DataFrame, exact_pages: DataFrame, index_pages: DataFrame, floor: float = 0.35) -> DataFrame:
    """One row: questions, those with a gap, missed chunks, and questions whose page lists (in order) are the same."""
    gaps = index_gaps(exact, index, floor)
    pages = lambda df, c: df.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "source", "page"))), lambda x: F.struct(x["source"], x["page"])).alias(c))
    both = gaps.join(pages(exact_pages, "a"), "query_id", "left").join(pages(index_pages, "b"), "query_id", "left")
    return both.agg(F.count("*").alias("questions"), F.count_if(F.col("missed") > 0).alias("with_gap"), F.coalesce(F.sum("missed"), F.lit(0)).alias("missed_chunks"), F.count_if(F.col("a").eqNullSafe(F.col("b"))).alias("equal_pages"))


def provenance_counts(gold: DataFrame) -> DataFrame:
    return gold.groupBy("provenance").agg(F.count("*").alias("n")).orderBy("provenance")


#: Unknown gold pages that an error names.
SHOWN = 5


def evaluate(hits: DataFrame, gold: DataFrame, corpus: DataFrame, path: str, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """Write the scores of every question to path/scores and return the run's one row of means, read from path/totals.

    Gold pages that the corpus (source, page) lacks stop the run before anything is written. The means are observed in
    the pass that writes the scores, so these are computed once; a path that is there isn't overwritten.
    """
    spark = hits.sparkSession
    unknown = unknown_refs(gold, corpus).orderBy("query_id", "source", "page")
    if first := unknown.limit(SHOWN).collect():
        more = unknown.count() - len(first)
        named = "; ".join(f"{r['query_id']}: {r['source']} p{r['page']}" for r in first)
        raise ValueError(f"the corpus lacks gold pages: {named}" + (f"; and {more} more" if more else ""))
    scores, seen = per_question(hits, gold, ks), Observation("scores")
    names = [c for c in scores.columns if c != "query_id"]
    watched = scores.observe(seen, F.count("*").alias("n_questions"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in names])
    watched.write.mode("errorifexists").parquet(f"{path}/scores")
    totals = seen.get
    row = [(totals["n_questions"], *[totals[c] for c in names])]
    spark.createDataFrame(row, "n_questions long, " + ", ".join(f"{c} double" for c in names)).coalesce(1).write.mode("errorifexists").parquet(f"{path}/totals")
    return spark.read.parquet(f"{path}/totals")
