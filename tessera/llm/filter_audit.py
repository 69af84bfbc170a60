"""Operator 13: audit of how filters interact, by relations of failing ids.

Each filter has one stored table of the rows that fail it. What filter f removes after the filters of a prefix S is
its failing rows less those of S: a left-anti join on the id. What it fails that is already gone is the left-semi join
of the same two. Survivors, removals and redundancies of every order depend on its prefixes only as sets, so all of
them, for k filters, come from k * 2 ** (k - 1) pairs (f, S): a failing row is repeated for the prefixes without its
own filter, after it has been placed by its id, and one join of each kind answers them all. Losses of labels are the
same joins over the failing rows whose documents a left-semi join with the labelled ids keeps. Orders are then folded
from these counts, which have some rows for each part, whatever the size of the data.

All joins are on ids, of which each row has its own; the copies of a text meet in the duplicate filter alone, where
texts with very many copies go by a broadcast table of at most HOT rows. Null texts are empty. Repeated rows count
each; a row with a null doc_id is no smaller than others and has no labels. A part without failing rows has zeros.
"""

from __future__ import annotations

import math
import uuid
from itertools import combinations, permutations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import let
from tessera.llm.staging import materialise, shared_dir, tables

LETTERS = "ABCDE"
#: A text is hot if more than 1 / HOT of all rows have it, so that there are less than HOT.
HOT = 1000
_WORDS = r"[^\x20\x09-\x0D]+"


def with_row_filters(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a flag, whether the text fails, for each filter that looks at one row: A to D."""
    counts = let(F.regexp_extract_all(text, F.lit(_WORDS), F.lit(0)), lambda w: F.struct(F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("distinct")))
    return docs.withColumn("_counts", counts).withColumns({
        "A": F.col("_counts.words") < 200,
        "B": 100 * F.col("_counts.distinct") < 50 * F.col("_counts.words"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
        "D": F.col(text).rlike(r"[#$%&*|]"),
    }).drop("_counts")


def with_later_copies(rows: DataFrame, digest: str = "digest", order: str = "doc_id") -> DataFrame:
    """The rows whose digest a row of a smaller `order` has."""
    groups = rows.groupBy(digest).agg(F.min(order).alias("_first"), F.max(order).alias("_last"), F.count("*").alias("_n"))
    groups = materialise(groups.where("_first < _last"), "copies")
    least = rows.agg(F.count("*")).first()[0] / HOT
    out = None
    for hot in (True, False):  # fewer than HOT groups have more than 1 / HOT of the rows
        own = groups.where(F.col("_n") > least if hot else F.col("_n") <= least).select(F.col(digest).alias("_digest"), "_first")
        found = rows.join(F.broadcast(own) if hot else own, (F.col(digest) == F.col("_digest")) & (F.col(order) > F.col("_first")), "left_semi")
        out = found if out is None else out.unionByName(found)
    return out


def failing_ids(rows: DataFrame, flags: str, duplicates: str, labels: DataFrame) -> DataFrame:
    """(filter, kind, id, part, doc_id): the failing rows of each filter, stored in a folder a filter; kinds are all, good and toxic.

    rows: id, part, doc_id, a flag for each filter of `flags`, and digest for the filter `duplicates`. labels: doc_id, quality, toxic.
    """
    spark = rows.sparkSession
    own = F.array_compact(F.array(*[F.when(F.col(name), name) for name in flags]))
    failing = rows.select("id", "part", "doc_id", F.explode(own).alias("filter"))
    failing = failing.unionByName(with_later_copies(rows).select("id", "part", "doc_id", F.lit(duplicates).alias("filter")))
    path = f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}/failing-{uuid.uuid4().hex}"
    failing.withColumn("kind", F.lit("all")).write.partitionBy("filter", "kind").parquet(path)
    table = spark.read.schema("id long, part string, doc_id long, filter string, kind string")
    held = table.parquet(path)
    for kind, column in (("good", "quality"), ("toxic", "toxic")):
        labelled = labels.where(F.col(column) == 1).select("doc_id")
        lost = held.where("kind = 'all'").join(labelled, "doc_id", "left_semi").withColumn("kind", F.lit(kind))
        lost.select("id", "part", "doc_id", "filter", "kind").write.mode("append").partitionBy("filter", "kind").parquet(path)
    return table.parquet(path)


def prefix_counts(failing: DataFrame, letters: str = LETTERS) -> DataFrame:
    """(part, filter, prefix, kind, removed, redundant) for every filter and every set of the others that goes before it."""
    others = {f: [x for x in letters if x != f] for f in letters}
    sets = F.create_map(*[x for f in letters for x in (F.lit(f), F.array(*[F.lit("".join(s)) for k in range(len(letters)) for s in combinations(others[f], k)]))])
    placed = failing.repartition("id")
    asked = placed.select("id", "part", "filter", "kind", F.explode(sets[F.col("filter")]).alias("prefix"))
    gone = failing.where("kind = 'all'").repartition("id").select(F.col("id").alias("_id"), F.col("filter").alias("_filter")).hint("shuffle_hash")
    earlier = (F.col("id") == F.col("_id")) & F.contains("prefix", "_filter")
    key = ["part", "filter", "prefix", "kind"]
    removed = asked.join(gone, earlier, "left_anti").groupBy(*key).agg(F.count("*").alias("removed"), F.lit(0).cast("long").alias("redundant"))
    redundant = asked.join(gone, earlier, "left_semi").groupBy(*key).agg(F.lit(0).cast("long").alias("removed"), F.count("*").alias("redundant"))
    return removed.unionByName(redundant).groupBy(*key).agg(F.sum("removed").alias("removed"), F.sum("redundant").alias("redundant"))


def audit(rows: DataFrame, failing: DataFrame, letters: str = LETTERS) -> DataFrame:
    """For each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    k = len(letters)
    counts = materialise(prefix_counts(failing, letters), "prefix-counts")
    of = lambda kind, column="removed": F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(column))), F.lit(0))
    each = counts.groupBy("part", "filter", "prefix").agg(of("all").alias("removed"), of("all", "redundant").alias("redundant"), of("good").alias("good_lost"), of("toxic").alias("toxic_lost"))
    share = F.element_at(F.array(*[F.lit(math.factorial(n) * math.factorial(k - 1 - n)) for n in range(k)]), F.length("prefix") + 1)
    whole = each.groupBy("part", "filter").agg(F.sum(F.when(F.length("prefix") == k - 1, F.col("removed"))).alias("unique_fails"), F.sum(F.col("removed") * share).alias("shapley"))
    steps = [(order, i + 1, order[i], "".join(sorted(order[:i]))) for order in map("".join, permutations(letters)) for i in range(k)]
    plan = F.broadcast(rows.sparkSession.createDataFrame(steps, "filter_order string, step int, filter string, prefix string"))
    parts = rows.groupBy("part").agg(F.count("*").alias("n")).withColumn("filter", F.explode(F.array(*map(F.lit, letters)))).join(plan, "filter")
    joined = parts.join(each, ["part", "filter", "prefix"], "left").join(whole, ["part", "filter"], "left").fillna(0)
    so_far = Window.partitionBy("part", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return joined.select("part", "filter_order", "step", (F.col("n") - F.sum("removed").over(so_far)).alias("kept"), "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of five filters over all documents by source."""
    docs = tables(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    facts = with_row_filters(docs.withColumns({"id": F.monotonically_increasing_id(), "digest": F.sha2("text", 256)}))
    rows = materialise(facts.drop("text"), "facts")  # ids are given once, here
    labels = tables(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic")
    return audit(rows, failing_ids(rows, "ABCD", "E", labels))


QUERIES = {"op13_filter_audit": op13_filter_audit}
_ORDERS = ", ".join(f"('{''.join(o)}')" for o in permutations(LETTERS))
_BIT = {c: 1 << i for i, c in enumerate(LETTERS)}
ORACLE_SQL = {
    "op13_filter_audit": f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
    m AS (SELECT part, (len(w) < 200)::INT * {_BIT["A"]} + (100 * len(list_distinct(w)) < 50 * len(w))::INT * {_BIT["B"]} + (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT * {_BIT["C"]}
        + regexp_matches(t, '[#$%&*|]')::INT * {_BIT["D"]} + coalesce(doc_id > first, false)::INT * {_BIT["E"]} AS mask,
        (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL))::INT AS good, (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL))::INT AS toxic FROM w),
    c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m GROUP BY ALL),
    o AS (SELECT * FROM (VALUES {_ORDERS}) t(filter_order)),
    s AS (SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS bit, list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
    x AS (SELECT part, filter_order, step, bit, coalesce(before, 0)::INT AS before FROM s, (SELECT DISTINCT part FROM c)),
    r AS (SELECT x.part, filter_order, step, bit, sum(n) FILTER (mask & (bit | before) = 0) AS kept, sum(n) FILTER (mask & bit > 0 AND mask & before = 0) AS removed, sum(n) FILTER (mask & bit > 0 AND mask & before > 0) AS redundant,
        sum(n) FILTER (mask = bit) AS unique_fails, sum(c.good) FILTER (mask & bit > 0 AND mask & before = 0) AS good_lost, sum(c.toxic) FILTER (mask & bit > 0 AND mask & before = 0) AS toxic_lost FROM x JOIN c ON c.part = x.part GROUP BY ALL),
    h AS (SELECT part, bit, sum(coalesce(removed, 0)) AS shapley FROM r GROUP BY ALL)
    SELECT r.part, filter_order, step::INT AS step, {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))} FROM r JOIN h ON h.part = r.part AND h.bit = r.bit"""
}
