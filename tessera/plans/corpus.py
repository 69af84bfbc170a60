"""Corpus and text queries over documents, conversations, pages and orders, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import corpus as C
from tessera.operators import evaluation as E
from tessera.sources import cache as CA
from tessera.sources import specs as SP
from tessera.staging import scratch
from tessera.streaming import upserts as U


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages; every third character count stands for the number of images."""
    return _read(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("page"), "text", "lang", (F.col("n_chars") % 3).alias("n_images"))


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of one page a language, so that copies meet; one id in three is the canonical one."""
    d = _read(spark, sf_dir, "documents").select(F.col("lang").alias("source"), F.lit(0).alias("page"), F.col("text").alias("content"), "doc_id")
    return d.withColumn("chunk_id", F.when(F.col("doc_id") % 3 == 0, C.chunk_id(F.col("source"), F.col("page"), F.col("content"))).otherwise(F.col("doc_id").cast("string")))


def with_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of documents, and for each document of over 40 words a chunk of its last 40."""
    p = pages(spark, sf_dir)
    words = F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")
    tails = p.select("source", "page", words.alias("w")).where(F.size("w") > 40).select("source", "page", F.array_join(F.slice("w", -40, 40), " ").alias("content"), F.concat(F.lit("tail"), F.col("page").cast("string")).alias("chunk_id"))
    return C.chunk_windows(p).select("source", "page", "content", "chunk_id").unionByName(tails)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as chunks: a conversation is a source of one page."""
    t = _read(spark, sf_dir, "conversations")
    return t.select(F.col("conv_id").alias("source"), F.lit(0).alias("page"), F.col("text").alias("content"), F.concat_ws(":", "conv_id", "turn").alias("chunk_id"))


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "source", F.col("lang").alias("doc_type"))


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents, anew with their label as type."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source")
    rows = _read(spark, sf_dir, "labels").join(docs, "doc_id").select(F.col("doc_id").alias("chunk_id"), "source", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("doc_type"))
    return C.first_of(rows, "chunk_id", "doc_type")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as a manifest: source src<key>, type by nation."""
    s = _read(spark, sf_dir, "supplier").join(F.broadcast(_read(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(F.concat(F.lit("src"), F.col("s_suppkey").cast("string")).alias("source"), F.col("n_name").alias("doc_type"), F.round("s_acctbal", 2).alias("note"))


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates rendered into sentences."""
    day = F.to_date("o_orderdate")
    text = F.concat(F.lit("Placed on "), F.date_format(day, "MMMM d, yyyy"), F.lit(", confirmed "), F.date_format(F.date_add(day, 1), "d MMMM yyyy"), F.lit(" and due "), F.date_format(F.date_add(day, 30), "yyyy-MM-dd"), F.lit(", not 2023-02-31."))
    return _read(spark, sf_dir, "orders").select("o_orderkey", day.alias("day"), text.alias("text"))


def amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as answers and sources: the first figure is supported, the second is not."""
    price = F.round("l_extendedprice", 2)
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("It cost "), F.format_number(price, 2), F.lit(" EUR, or "), F.format_number(price + 10000, 2), F.lit(" with interest of 5 % in 3 parts [1].")).alias("answer"), F.concat(F.lit("Montant : "), F.translate(F.format_number(price, 2), ",.", " ,"), F.when(F.col("l_linenumber") % 2 == 0, "; 5,0 %").otherwise("")).alias("sources"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as manifest entries, some of which break a rule."""
    k = F.col("s_suppkey")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n).cast("string")
    kind = F.when(k % 5 == 0, "novel").when(k % 5 == 1, "macro")
    return _read(spark, sf_dir, "supplier").select(F.concat(F.lit("src"), F.floor(k / F.when(k % 7 == 0, 2).otherwise(1)).cast("string")).alias("source"), day((k % 11).cast("int")).alias("period_start"), F.when(k % 13 == 0, "soon").otherwise(day(F.lit(8))).alias("period_end"), F.lit(None).cast("string").alias("published"), kind.alias("doc_type"), F.lit("").alias("note"), F.when(k % 17 == 0, "colour").alias("unknown"))


def sleeves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as sleeves, nations as tickers; every nation weighs a fifth of its region, and one region is too heavy."""
    n = _read(spark, sf_dir, "nation").join(F.broadcast(_read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.col("r_name").alias("sleeve"), F.lit(0.2).alias("sleeve_weight"), F.col("n_name").alias("ticker"), F.when(F.col("n_regionkey") == 2, 0.25).otherwise(0.2).alias("holding_weight"))


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as gold rows (line, row), some of which break a rule."""
    t = _read(spark, sf_dir, "conversations")
    line = F.col("conv_id") * 1000 + F.col("turn")
    page = F.struct(F.col("role").alias("source"), F.col("turn").cast("int").alias("page"))
    kind = F.when(F.col("turn") % 3 == 0, "hand-written").when(F.col("turn") % 3 == 1, "synthetic-draft+human-accept").otherwise("synthetic-draft")
    row = F.struct(F.concat(F.lit("q"), (F.col("conv_id") - F.when(F.col("turn") == 4, 1).otherwise(0)).cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"), F.when(F.length("text") % 10 > 0, F.col("text")).alias("question"), F.when(F.col("turn") % 4 == 3, F.array().cast("array<struct<source:string,page:int>>")).otherwise(F.array(page)).alias("gold"), kind.alias("provenance"))
    return t.select(line.alias("line"), row.alias("row"))


RULES = [("/en/", "english"), ("/fr/", "french"), ("blog.", "blog"), ("m.", "mobile")]
SCORES = {"1-URGENT": "A", "2-HIGH": "B", "3-MEDIUM": "B-", "4-NOT SPECIFIED": "2.25", "5-LOW": "x"}


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    grade = F.try_element_at(F.create_map(*[F.lit(x) for kv in SCORES.items() for x in kv]), F.col("o_orderpriority"))
    return _read(spark, sf_dir, "orders").select("o_orderkey", X.grade_score(grade).alias("score"))


def upsert_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index kept by a stream of three files: all documents, their labelled ones anew, and these once more."""
    place = scratch(spark, "upsert-stream")
    first = index(spark, sf_dir).withColumn("seq", F.col("chunk_id"))
    again = batch(spark, sf_dir).withColumn("seq", F.col("chunk_id"))
    columns = ["chunk_id", "source", "doc_type", "seq"]
    for i, rows in enumerate((first, again, again)):
        rows.select(*columns).write.parquet(f"{place}/in/{i}")
        stream = spark.readStream.schema(first.select(*columns).schema).option("recursiveFileLookup", "true").parquet(f"{place}/in")
        U.keep_chunks(stream, f"{place}/table", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    return U.chunk_table(spark, f"{place}/table", first.select(*columns)).drop("seq")


def ids_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of events and users as ids of a stream, each once."""
    place = scratch(spark, "id-stream")
    rows = _read(spark, sf_dir, "events").select(F.concat_ws(":", "event_type", "user_id").alias("chunk_id"), F.col("ts").cast("timestamp").alias("ts"))
    rows.write.parquet(f"{place}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(f"{place}/in")
    writer = U.chunks_once(stream, lateness="10000 days").writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{place}/out").select("chunk_id")


def cached_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean prices of the order priorities through the result cache: half of the requests first, then all."""
    o = _read(spark, sf_dir, "orders")
    asked = CA.with_key(o.select("o_orderpriority").distinct().select(F.lit("orders").alias("provider"), F.col("o_orderpriority").alias("series_id")), "provider", "series_id")
    rows = lambda missing: o.join(missing, F.col("o_orderpriority") == F.col("series_id")).groupBy("cache_key", "provider", "series_id", F.to_date("o_orderdate").alias("date")).agg(F.avg("o_totalprice").alias("value"))
    schema = rows(asked).schema
    place, now = scratch(spark, "cache"), F.lit("2024-01-01 00:00:00").cast("timestamp")
    for some in (asked.where("series_id < '3'"), asked):
        out = CA.through(place, some, rows, schema, "1 hour", now)
    return out.select("series_id", "date", F.round("value", 6).alias("value"))


def cached_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in for a model (length and words of a text) through the embedding cache, twice."""
    items = _read(spark, sf_dir, "benchmark").select("item_id", "text")
    embed = lambda missing: missing.select("cache_key", F.array(F.length("text").cast("float"), F.size(F.split("text", " ")).cast("float")).alias("embedding"))
    place = scratch(spark, "embedding-cache")
    CA.embedded(place, items.where("item_id % 2 = 0"), "stand-in", embed)
    out = CA.embedded(place, items, "stand-in", embed)
    return out.select("item_id", F.col("embedding")[0].cast("double").alias("n_chars"), F.col("embedding")[1].cast("double").alias("n_words"))


def draft_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as answers of a model: those that end with a question mark are drafts, numbered in order."""
    t = turns(spark, sf_dir).join(_read(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("chunk_id"), "conv_id", "turn"), "chunk_id")
    raw = F.concat(F.lit("Q: "), F.regexp_replace("content", "\n", " "), F.when(F.col("turn") % 2 == 0, "?").otherwise("."))
    return C.drafts(t, raw, "conv_id", "turn").select("id", F.col("source").alias("conv_id"), "note")


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of the first three turns of every conversation; others are left out before turns meet."""
    first = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    t = _read(spark, sf_dir, "conversations").withColumn("n", first).where("n <= 3")
    hits = F.sort_array(F.collect_list(F.struct("turn", F.col("conv_id").alias("source"), F.col("turn").alias("page"), F.col("text").alias("content"))))
    return t.groupBy("conv_id").agg(hits.alias("hits")).select("conv_id", F.sha2(X.prompt(F.lit("What was said?"), F.col("hits")), 256).alias("prompt_sha256"))


QUERIES = {
    "upsert_stream": upsert_stream,
    "ids_once": ids_once,
    "cached_rates": cached_rates,
    "cached_embeddings": cached_embeddings,
    "draft_ids": draft_ids,
    "coverage_report": lambda s, d: C.coverage_report(pages(s, d)),
    "chunk_ids": lambda s, d: pages(s, d).select("page", C.chunk_id(F.col("source"), F.col("page"), F.col("text")).alias("chunk_id")),
    "chunk_windows": lambda s, d: C.chunk_windows(pages(s, d)).select("page", "chunk_no", "chunk_id", F.length("content").alias("n_chars")),
    "exact_duplicates": lambda s, d: C.exact_duplicates(copies(s, d), F.col("doc_id").cast("string")).select("doc_id"),
    "contained_tails": lambda s, d: C.contained_tails(with_tails(s, d)).select("page", "chunk_id"),
    "upsert_chunks": lambda s, d: C.upsert(index(s, d), batch(s, d)),
    "replace_sources": lambda s, d: C.replace_sources(index(s, d), batch(s, d).where("chunk_id % 2 = 0").withColumn("source", F.concat("source", F.lit("b")))),
    "replacement_counts": lambda s, d: C.replacement_counts(index(s, d), batch(s, d)),
    "remove_chunks": lambda s, d: C.remove(index(s, d), batch(s, d)),
    "manifest_apply": lambda s, d: C.update_metadata(index(s, d), manifest(s, d), ["doc_type", "note"]),
    "manifest_diff": lambda s, d: C.manifest_difference(manifest(s, d), index(s, d)),
    "manifest_report": lambda s, d: C.manifest_report(manifest(s, d), index(s, d)),
    "manifest_rules": lambda s, d: SP.manifest_problems(entries(s, d)),
    "portfolio_weights": lambda s, d: SP.portfolio_weights(sleeves(s, d)).withColumn("weight", F.round("weight", 9)),
    "portfolio_rules": lambda s, d: SP.portfolio_problems(sleeves(s, d)).withColumn("total", F.round("total", 9)),
    "gold_rules": lambda s, d: SP.gold_problems(drafts(s, d)),
    "provenance_counts": lambda s, d: E.provenance_counts(drafts(s, d).select("row.provenance").where(SP.accepted(F.col("provenance")))),
    "migrate_chunks": lambda s, d: C.migrated(index(s, d).where("chunk_id % 2 = 0"), index(s, d).where("chunk_id % 3 = 0")),
    "coverage_totals": lambda s, d: C.coverage_totals(C.text_coverage(pages(s, d))),
    "page_lists": lambda s, d: _read(s, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("role").alias("source"), F.col("turn").alias("page")))).alias("p")).select("conv_id", X.page_list(F.col("p")).alias("refs")),
    "markdown_cells": lambda s, d: _read(s, d, "conversations").select("conv_id", "turn", X.markdown_cell(F.concat("text", F.lit("|"), "role")).alias("cell")),
    "text_coverage": lambda s, d: C.text_coverage(pages(s, d)),
    "corpus_status": lambda s, d: C.corpus_status(index(s, d)),
    "stratified_sample": lambda s, d: C.stratified(pages(s, d).select("lang", F.col("page").alias("chunk_id"), F.col("text").alias("content")), "lang", 5).select("lang", "chunk_id"),
    "doc_type_rules": lambda s, d: _read(s, d, "pages").select("page_id", X.first_rule(F.col("url"), RULES, "macro").alias("doc_type")),
    "pdf_date": lambda s, d: _read(s, d, "orders").select("o_orderkey", X.document_date(F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "'D:'yyyyMMdd'000000Z'")), F.lit(None).cast("string"), F.concat(F.lit("report_20"), F.lpad((F.col("o_custkey") % 100).cast("string"), 2, "0"), F.lit(".pdf"))).alias("date")),
    "clean_question": lambda s, d: _read(s, d, "conversations").select("conv_id", "turn", X.clean_question(F.concat(F.lit("<think>why?</think>\n\nQuestion: \""), F.col("text"), F.when(F.col("role") == "user", "?\"").otherwise("\""))).alias("question")),
    "grade_scores": graded,
    "exact_dates": lambda s, d: dated(s, d).select("o_orderkey", F.array_join(F.transform(X.exact_dates(F.col("text")), lambda x: x.cast("string")), ",").alias("dates")),
    "date_cover": lambda s, d: dated(s, d).select("o_orderkey", X.covers(X.exact_dates(F.col("text")), F.lit("1995-01-01").cast("date"), F.lit("1995-12-31").cast("date")).alias("covered")),
    "figure_grounding": lambda s, d: amounts(s, d).select("l_orderkey", "l_linenumber", X.grounding(F.col("answer"), F.col("sources")).alias("g")).select("l_orderkey", "l_linenumber", "g.checked", F.array_join("g.unsupported", " ").alias("unsupported")),
    "answer_prompts": prompts,
    "cache_keys": lambda s, d: _read(s, d, "orders").select("o_orderkey", X.cache_key(F.lit("orders"), F.col("o_orderpriority"), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("key")),
}

_INDEX = "idx AS (SELECT doc_id AS chunk_id, source, lang AS doc_type FROM documents)"
_BATCH = "bat AS (SELECT doc_id AS chunk_id, any_value(source) AS source, min('q' || quality) AS doc_type FROM labels JOIN documents USING (doc_id) GROUP BY 1)"
_MANIFEST = "man AS (SELECT 'src' || s_suppkey AS source, n_name AS doc_type, round(s_acctbal, 2) AS note FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
_KIND = "CASE WHEN length(trim(text)) = 0 AND n_chars % 3 > 0 THEN 'image_only' WHEN length(trim(text)) = 0 THEN 'blank' WHEN length(trim(text)) < 200 AND n_chars % 3 > 0 THEN 'thin' ELSE 'text' END"

ORACLE = {
    "upsert_stream": f"WITH {_INDEX}, {_BATCH} SELECT * FROM idx WHERE chunk_id NOT IN (SELECT chunk_id FROM bat) UNION ALL SELECT chunk_id, source, doc_type FROM bat",
    "ids_once": "SELECT DISTINCT event_type || ':' || user_id AS chunk_id FROM events",
    "cached_rates": "SELECT o_orderpriority AS series_id, o_orderdate::DATE AS date, round(avg(o_totalprice), 6) AS value FROM orders GROUP BY ALL",
    "cached_embeddings": "SELECT item_id, length(text)::DOUBLE AS n_chars, len(string_split(text, ' '))::DOUBLE AS n_words FROM benchmark",
    "draft_ids": "SELECT 'draft' || CASE WHEN n < 100 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END AS id, conv_id, 'drafted from chunk ' || left(conv_id || ':' || turn, 12) AS note FROM (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS n FROM conversations WHERE turn % 2 = 0)",
    "coverage_report": f"SELECT source, count(*) AS pages, count(*) FILTER (k = 'blank') AS blank, count(*) FILTER (k = 'image_only') AS image_only, count(*) FILTER (k = 'thin') AS thin, count(*) FILTER (k = 'text') AS text FROM (SELECT source, {_KIND} AS k FROM documents) GROUP BY ROLLUP (source)",
    "chunk_ids": "SELECT doc_id AS page, sha256(source || ':' || doc_id || ':' || text) AS chunk_id FROM documents",
    "chunk_windows": """WITH w AS (SELECT source, doc_id AS page, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS words FROM documents), f AS (SELECT *, CASE WHEN len(words) < 512 THEN 0 ELSE (len(words) - 512) // 448 + 1 END AS n FROM w),
        c AS (SELECT source, page, words, unnest(range(n + (len(words) - n * 448 > CASE WHEN n > 0 THEN 64 ELSE 0 END)::INT)) AS chunk_no FROM f), t AS (SELECT source, page, chunk_no, array_to_string(list_slice(words, chunk_no * 448 + 1, chunk_no * 448 + 512), ' ') AS content FROM c)
        SELECT page, chunk_no, sha256(source || ':' || page || ':' || content) AS chunk_id, length(content) AS n_chars FROM t""",
    "exact_duplicates": """SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang, text ORDER BY doc_id % 3 = 0 DESC, doc_id::VARCHAR) AS n FROM documents) WHERE n > 1""",
    "contained_tails": r"""WITH w AS (SELECT doc_id, source, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS words FROM documents), f AS (SELECT *, CASE WHEN len(words) < 512 THEN 0 ELSE (len(words) - 512) // 448 + 1 END AS n FROM w),
        k AS (SELECT doc_id, source, words, unnest(range(n + (len(words) - n * 448 > CASE WHEN n > 0 THEN 64 ELSE 0 END)::INT)) AS i FROM f), c AS (SELECT doc_id, array_to_string(list_slice(words, i * 448 + 1, i * 448 + 512), ' ') AS t, source FROM k),
        a AS (SELECT doc_id, t, sha256(source || ':' || doc_id || ':' || t) AS chunk_id FROM c UNION ALL SELECT doc_id, array_to_string(list_slice(words, -40, -1), ' '), 'tail' || doc_id FROM w WHERE len(words) > 40)
        SELECT doc_id AS page, chunk_id FROM a WHERE EXISTS (SELECT 1 FROM a b WHERE a.doc_id = b.doc_id AND length(b.t) > length(a.t) AND contains(b.t, a.t))""",
    "upsert_chunks": f"WITH {_INDEX}, {_BATCH} SELECT * FROM idx WHERE chunk_id NOT IN (SELECT chunk_id FROM bat) UNION ALL SELECT chunk_id, source, doc_type FROM bat",
    "replace_sources": f"WITH {_INDEX}, {_BATCH}, h AS (SELECT chunk_id, source || 'b' AS source, doc_type FROM bat WHERE chunk_id % 2 = 0) SELECT * FROM idx WHERE source NOT IN (SELECT source FROM h) AND chunk_id NOT IN (SELECT chunk_id FROM h) UNION ALL SELECT * FROM h",
    "manifest_report": f"WITH {_INDEX}, {_MANIFEST}, t AS (SELECT source, count(*) AS n FROM idx GROUP BY 1) SELECT coalesce(man.source, t.source) AS source, CASE WHEN t.source IS NULL THEN 'not_indexed' WHEN man.source IS NULL THEN 'unlisted' ELSE 'applied' END AS state, CASE WHEN man.source IS NOT NULL THEN coalesce(n, 0) ELSE 0 END AS updated FROM man FULL JOIN t ON man.source = t.source",
    "manifest_rules": """WITH e AS (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM (SELECT s_suppkey AS k, 'src' || (CASE WHEN s_suppkey % 7 = 0 THEN s_suppkey // 2 ELSE s_suppkey END) AS source FROM supplier))
        SELECT DISTINCT source, unnest(list_filter([CASE WHEN k % 5 = 0 THEN 'unknown doc_type' END, CASE WHEN k % 13 = 0 THEN 'invalid date' END, CASE WHEN k % 13 <> 0 AND k % 11 > 8 THEN 'period_start is after period_end' END, CASE WHEN k % 17 = 0 THEN 'unknown key' END, CASE WHEN n > 1 THEN 'duplicate source' END], lambda x: x IS NOT NULL)) AS reason FROM e""",
    "portfolio_weights": "SELECT n_name AS ticker, r_name AS sleeve, round(0.2 * CASE WHEN n_regionkey = 2 THEN 0.25 ELSE 0.2 END, 9)::DOUBLE AS weight FROM nation JOIN region ON n_regionkey = r_regionkey",
    "portfolio_rules": "SELECT 'Sleeve ' || chr(39) || r_name || chr(39) || ' holding weights' AS label, round(count(*) * 0.25, 9)::DOUBLE AS total FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey = 2 GROUP BY r_name",
    "gold_rules": """WITH g AS (SELECT conv_id * 1000 + turn AS line, 'q' || (conv_id - (turn = 4)::INT) || '-' || turn AS id, length(text) % 10 > 0 AS asks, turn FROM conversations), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line) AS n FROM g)
        SELECT line, id, unnest(list_filter([CASE WHEN NOT asks THEN 'no question' END, CASE WHEN turn % 4 = 3 THEN 'no gold page' END, CASE WHEN n > 1 THEN 'duplicate id' END, CASE WHEN turn % 3 = 2 THEN 'not human-accepted' END], lambda x: x IS NOT NULL)) AS reason FROM n""",
    "provenance_counts": "SELECT CASE turn % 3 WHEN 0 THEN 'hand-written' ELSE 'synthetic-draft+human-accept' END AS provenance, count(*) AS n FROM conversations WHERE turn % 3 < 2 GROUP BY 1",
    "migrate_chunks": f"WITH {_INDEX} SELECT * FROM idx WHERE chunk_id % 2 = 0 OR chunk_id % 3 = 0",
    "coverage_totals": f"SELECT count(*) AS sources, sum(p)::BIGINT AS pages, sum(b)::BIGINT AS blank, sum(i)::BIGINT AS image_only, sum(h)::BIGINT AS thin, sum(t)::BIGINT AS text, count(*) FILTER (i / p >= 0.5) AS scanned FROM (SELECT source, count(*) AS p, count(*) FILTER (k = 'blank') AS b, count(*) FILTER (k = 'image_only') AS i, count(*) FILTER (k = 'thin') AS h, count(*) FILTER (k = 'text') AS t FROM (SELECT source, {_KIND} AS k FROM documents) GROUP BY source)",
    "page_lists": "SELECT conv_id, string_agg(role || ' p' || turn, ', ' ORDER BY role, turn) AS refs FROM conversations GROUP BY 1",
    "markdown_cells": "SELECT conv_id, turn, replace(replace(text, '|', '\\|'), chr(10), ' ') || '\\|' || role AS cell FROM conversations",
    "replacement_counts": f"WITH {_INDEX}, {_BATCH}, o AS (SELECT * FROM idx WHERE source IN (SELECT source FROM bat)) SELECT coalesce(o.source, b.source) AS source, count(b.chunk_id) AS added, count(*) FILTER (b.chunk_id IS NULL) AS removed FROM o FULL JOIN bat b ON o.chunk_id = b.chunk_id GROUP BY 1",
    "remove_chunks": f"WITH {_INDEX}, {_BATCH} SELECT * FROM idx WHERE chunk_id NOT IN (SELECT chunk_id FROM bat)",
    "manifest_apply": f"WITH {_INDEX}, {_MANIFEST} SELECT chunk_id, source, coalesce(man.doc_type, idx.doc_type) AS doc_type, note FROM idx LEFT JOIN man USING (source)",
    "manifest_diff": f"WITH {_INDEX}, {_MANIFEST}, t AS (SELECT DISTINCT source FROM idx) SELECT coalesce(man.source, t.source) AS source, CASE WHEN t.source IS NULL THEN 'not_indexed' WHEN man.source IS NULL THEN 'unlisted' ELSE 'applied' END AS state FROM man FULL JOIN t ON man.source = t.source",
    "text_coverage": f"SELECT source, count(*) AS pages, count(*) FILTER (k = 'blank') AS blank, count(*) FILTER (k = 'image_only') AS image_only, count(*) FILTER (k = 'thin') AS thin, count(*) FILTER (k = 'text') AS text, count(*) FILTER (k = 'image_only') / count(*) >= 0.5 AS likely_scanned FROM (SELECT source, {_KIND} AS k FROM documents) GROUP BY source",
    "corpus_status": "SELECT count(*) AS chunks, count(DISTINCT source) AS sources FROM documents",
    "stratified_sample": "SELECT lang, chunk_id FROM (SELECT lang, doc_id AS chunk_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('0:' || doc_id)) AS n FROM documents WHERE length(trim(text)) >= 200) WHERE n <= 5",
    "doc_type_rules": f"SELECT page_id, CASE {' '.join(f"WHEN contains(lower(url), '{a}') THEN '{b}'" for a, b in RULES)} ELSE 'macro' END AS doc_type FROM pages",
    "pdf_date": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '20' || lpad((o_custkey % 100)::VARCHAR, 2, '0') END AS date FROM orders",
    "clean_question": "SELECT conv_id, turn, CASE WHEN role = 'user' AND NOT contains(text, chr(10)) THEN trim(text) || '?' WHEN contains(text, chr(10)) AND ends_with(split_part(text, chr(10), 1), '?') THEN split_part(text, chr(10), 1) END AS question FROM conversations",
    "grade_scores": "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 4.0 WHEN '2-HIGH' THEN 3.0 WHEN '3-MEDIUM' THEN 2.7 WHEN '4-NOT SPECIFIED' THEN 2.25 END::DOUBLE AS score FROM orders",
    "exact_dates": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || ',' || strftime(o_orderdate::DATE + 1, '%Y-%m-%d') || ',' || strftime(o_orderdate::DATE + 30, '%Y-%m-%d') AS dates FROM orders",
    "date_cover": "SELECT o_orderkey, year(o_orderdate) = 1995 OR year(o_orderdate::DATE + 1) = 1995 OR year(o_orderdate::DATE + 30) = 1995 AS covered FROM orders",
    "figure_grounding": """SELECT l_orderkey, l_linenumber, 3 AS checked, trim(format('{:,.2f}', round(l_extendedprice, 2) + 10000) || CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE ' 5 %' END) AS unsupported FROM lineitem""",
    "answer_prompts": """SELECT conv_id, sha256(string_agg('[' || n || '] ' || conv_id || ' p.' || turn || chr(10) || substr(text, 1, 500), chr(10) || chr(10) ORDER BY n) || chr(10) || chr(10) || 'Question: What was said?') AS prompt_sha256
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n <= 3 GROUP BY conv_id""",
    "cache_keys": "SELECT o_orderkey, sha256('orders:' || o_orderpriority || ':' || strftime(o_orderdate, '%Y-%m-%d')) AS key FROM orders",
}
