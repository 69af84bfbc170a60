"""Retrieval and evaluation queries over embeddings and documents, with their SQL.

A chunk is a vector: source and doc_type are its label, four vectors make a page. Queries are the vectors whose id is
divisible by 100, searched against all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import evaluation as E
from tessera.operators import retrieval as R
from tessera.operators import text_index as I
from tessera.operators import vector_index as V
from tessera.staging import materialise, scratch

K, POOL = 5, 20


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("chunk_id"), "embedding", F.col("label").alias("source"), F.expr("vec_id div 4").alias("page"))


def queries_of(c: DataFrame) -> DataFrame:
    return c.where(F.col("chunk_id") % 100 == 0).select(F.col("chunk_id").alias("query_id"), "embedding", "source")


def pool(spark: SparkSession, sf_dir: str, k: int = POOL) -> DataFrame:
    c = chunks(spark, sf_dir)
    hits = R.vector_topk(queries_of(c), c, k)
    q = queries_of(c).select("query_id", F.col("source").alias("query_source"))
    return hits.join(c.select("chunk_id", "source", "page"), "chunk_id").join(q, "query_id")


def fake_score() -> Column:
    """A deterministic stand-in for a model's score."""
    return (F.col("chunk_id") * 7919 % 1000) / 1000.0


def covers() -> Column:
    return F.col("source") == F.col("query_source")


def full(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    return R.retrieve(pool(spark, sf_dir), k, 0.2, fake_score(), covers())


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of the three nearest vectors of the query's own label."""
    c = chunks(spark, sf_dir)
    near = R.vector_topk(queries_of(c), c, 3, same="source").select("query_id", "chunk_id")
    return near.join(c.select("chunk_id", "source", "page"), "chunk_id").select("query_id", "source", "page").distinct()


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.per_question(R.distinct_pages(pool(spark, sf_dir), 10), gold(spark, sf_dir), (1, 3, 5))


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c, t in df.dtypes if t == "double"})


def bm25_hits(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    q = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text")
    return R.bm25(q, d, k)


def bm25_from_index(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    """The same rows from a persisted index of the documents."""
    q = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text")
    return I.search_text(q, I.build_text_index(d, scratch(spark, "text-index")), k)


def second_list(hits: DataFrame) -> DataFrame:
    return R.rerank_head(hits, fake_score(), POOL)


def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = pool(spark, sf_dir)
    b = second_list(a)
    page = ("source", "page")
    out = None
    for name, x in [("embedding", a), ("rescored", b), ("rrf", R.rrf(a, b, carry=page)), ("union", R.interleaved(a, b, carry=page))]:
        part = x.select("query_id", "chunk_id", *page, "rank", F.lit(name).alias("method"))
        out = part if out is None else out.unionByName(part)
    return out


#: Queries that calibrate an index, and the share of their exact hits that must lie in the probed cells.
CALIBRATION, TARGET = 64, 0.95


def index_of(spark: SparkSession, sf_dir: str, k: int = POOL) -> DataFrame:
    """The pool of a persisted inverted-file index, with as many probes as its calibration asks for."""
    c = chunks(spark, sf_dir)
    index = V.build_index(c, scratch(spark, "vector-index"), attributes=("source",))
    some = queries_of(c).orderBy(F.sha2(F.col("query_id").cast("string"), 256)).limit(CALIBRATION)
    probes = V.calibrated(some, R.vector_topk(some, c, k), index, TARGET)
    hits = materialise(V.search(queries_of(c), index, k, probes), "index-hits")
    q = queries_of(c).select("query_id", F.col("source").alias("query_source"))
    return hits.join(c.select("chunk_id", "source", "page"), "chunk_id").join(q, "query_id")


def index_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact, found = pool(spark, sf_dir), index_of(spark, sf_dir)
    return E.index_totals(exact, found, R.distinct_pages(exact, K), R.distinct_pages(found, K), 0.2)


def evaluation_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.evaluate(R.distinct_pages(pool(spark, sf_dir), 10), gold(spark, sf_dir), chunks(spark, sf_dir), scratch(spark, "evaluation"))


WHERE = {"half": 0, "source": 3}


def halves(c: DataFrame) -> DataFrame:
    return c.withColumn("half", (F.col("chunk_id") % 2).cast("int"))


def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top k among chunks with two metadata values."""
    c = halves(chunks(spark, sf_dir))
    return R.vector_topk(queries_of(c), R.having(c, WHERE), K)


def filtered_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the index, with all cells probed."""
    c = halves(chunks(spark, sf_dir))
    index = V.build_index(c, scratch(spark, "vector-index"), attributes=tuple(WHERE))
    return V.search(queries_of(c), index, K, index.cells, where=WHERE)


WORDS = 8


def both_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have a vector, found by it and by words: a query is a document's vector and its first words, and never finds itself."""
    c = chunks(spark, sf_dir)
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text").join(c.select("chunk_id"), "chunk_id", "left_semi")
    q = d.where(F.col("chunk_id") % 100 == 0).select(F.col("chunk_id").alias("query_id"), F.array_join(F.slice(F.split("text", " "), 1, WORDS), " ").alias("text"))
    index = I.build_text_index(d, scratch(spark, "text-index"))
    words = I.search_text(q, index, POOL + 1).where("query_id <> chunk_id").withColumnRenamed("rank", "_r")
    about = c.select("chunk_id", "source", "page")
    words = R.ranked(words, "_r").where(F.col("rank") <= POOL).select("query_id", "chunk_id", "rank").join(about, "chunk_id")
    vectors = R.vector_topk(queries_of(c), c, POOL).select("query_id", "chunk_id", "rank").join(about, "chunk_id")
    # a vector without a document has no words to be found by
    return R.hybrid(vectors, words, fake_score(), K).select("query_id", "chunk_id", "source", "page", "rank")


def passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool ranked twice: as it is, and re-ranked at the head."""
    page = ["query_id", "source", "page", "rank"]
    return pool(spark, sf_dir).select(F.lit(1).alias("pass"), *page).unionByName(R.rerank_head(pool(spark, sf_dir), fake_score(), 3).select(F.lit(2).alias("pass"), *page))


def event_spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.spreads(spark.read.parquet(f"{sf_dir}/events.parquet"), ["user_id", "event_type"], "value")


QUERIES = {
    "exact_topk": lambda s, d: rounded(pool(s, d, K).select("query_id", "chunk_id", "similarity", "rank")),
    "exact_topk_where": lambda s, d: rounded(filtered(s, d)),
    "ann_topk_where": lambda s, d: rounded(filtered_index(s, d)),
    "hybrid_pools": both_pools,
    "evaluation_run": lambda s, d: rounded(evaluation_run(s, d)),
    "exact_topk_filtered": lambda s, d: rounded(R.vector_topk(queries_of(chunks(s, d)), chunks(s, d), K, same="source")),
    "retrieve_floor": lambda s, d: rounded(R.above_floor(pool(s, d), 0.2).select("query_id", "chunk_id", "similarity", "rank")),
    "retrieve_distinct_pages": lambda s, d: R.distinct_pages(pool(s, d), K).select("query_id", "chunk_id", "source", "page", "rank"),
    "rerank_head": lambda s, d: R.rerank_head(pool(s, d), fake_score()).select("query_id", "chunk_id", "rerank_score", "rank"),
    "date_aware_order": lambda s, d: R.covering_first(pool(s, d), covers()).select("query_id", "chunk_id", "rank"),
    "retrieve_full": lambda s, d: full(s, d).select("query_id", "chunk_id", "source", "page", "rank"),
    "eval_per_question": lambda s, d: rounded(scores(s, d)),
    "eval_aggregate": lambda s, d: rounded(E.aggregate(scores(s, d))),
    "worst_questions": lambda s, d: rounded(E.worst(scores(s, d), 5)),
    "index_check": lambda s, d: E.index_gaps(pool(s, d), index_of(s, d), 0.2),
    "index_check_totals": index_totals,
    "ann_topk": lambda s, d: rounded(index_of(s, d).select("query_id", "chunk_id", "similarity", "rank")),
    "ann_recall": lambda s, d: rounded(V.recall(pool(s, d), index_of(s, d))),
    "unknown_gold_refs": lambda s, d: E.unknown_refs(gold(s, d), index_of(s, d)),
    "gold_ranks": lambda s, d: R.gold_rank(pool(s, d), gold(s, d)),
    "hybrid_retrieve": lambda s, d: R.hybrid(pool(s, d), second_list(pool(s, d)), fake_score(), K, covers=(F.col("source") == F.col("query_source")), carry=("source", "page", "query_source")).select("query_id", "chunk_id", "source", "page", "rank"),
    "gained_lost": lambda s, d: E.gained_lost(methods(s, d), gold(s, d), "embedding", (1, 5)),
    "repeat_summary": lambda s, d: rounded(E.repeat_summary(event_spreads(s, d), 2)),
    "top1_changes": lambda s, d: E.top1_changes(passes(s, d)),
    "bm25_topk": lambda s, d: rounded(bm25_hits(s, d)),
    "bm25_index_topk": lambda s, d: rounded(bm25_from_index(s, d)),
    "rrf_fuse": lambda s, d: rounded(R.rrf(pool(s, d), second_list(pool(s, d)))),
    "union_interleave": lambda s, d: R.interleaved(pool(s, d), second_list(pool(s, d))),
    "pool_recall": lambda s, d: E.pool_recall(methods(s, d), gold(s, d), (5, 10)),
    "score_spread": lambda s, d: rounded(event_spreads(s, d)),
    "latency_percentiles": lambda s, d: rounded(E.latencies(s.read.parquet(f"{d}/events.parquet"), "event_type", "value")),
}

_C = "c AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS e, label AS source, vec_id // 4 AS page FROM embeddings)"
_POOL = f"""{_C}, sims AS (SELECT q.chunk_id AS query_id, q.source AS query_source, c.chunk_id, c.source, c.page, list_cosine_similarity(q.e, c.e) AS similarity FROM c q, c WHERE q.chunk_id % 100 = 0 AND q.chunk_id <> c.chunk_id),
    pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM sims) WHERE rank <= {POOL})"""
_SCORE = "(chunk_id * 7919 % 1000) / 1000.0::DOUBLE"


def _head(src: str, head: int) -> str:
    return f"(SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY rank <= {head} DESC, CASE WHEN rank <= {head} THEN {_SCORE} END DESC NULLS LAST, rank) AS rank, CASE WHEN rank <= {head} THEN {_SCORE} END AS rerank_score FROM {src})"


def _pages(src: str, k: int) -> str:
    return f"(SELECT * FROM (SELECT * EXCLUDE (rank, n), row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source, page ORDER BY rank) AS n FROM {src}) WHERE n = 1) WHERE rank <= {k})"


_GOLD = "gold AS (SELECT DISTINCT query_id, source, page FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS n FROM sims WHERE source = query_source) WHERE n <= 3)"
_AT = "".join(f", coalesce(sum(hit) FILTER (rank <= {k}) / nullif(count(rank) FILTER (rank <= {k}), 0), 0)::DOUBLE AS precision_{k}, (count(DISTINCT (source, page)) FILTER (rank <= {k} AND hit = 1) / any_value(n_gold))::DOUBLE AS recall_{k}, coalesce(max(hit) FILTER (rank <= {k}), 0)::DOUBLE AS hit_{k}" for k in (1, 3, 5))
_EVAL = f"""{_POOL}, {_GOLD}, hits AS {_pages("pool", 10)}, size AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY 1),
    flagged AS (SELECT s.query_id, s.n_gold, h.source, h.page, h.rank, (g.query_id IS NOT NULL)::INT AS hit FROM size s LEFT JOIN hits h USING (query_id) LEFT JOIN gold g ON g.query_id = h.query_id AND g.source = h.source AND g.page = h.page),
    scores AS (SELECT query_id{_AT}, coalesce(1 / min(rank) FILTER (hit = 1), 0)::DOUBLE AS rr FROM flagged GROUP BY query_id)"""
_COLS = [f"{m}_{k}" for k in (1, 3, 5) for m in ("precision", "recall", "hit")] + ["rr"]
_LISTS = f"{_POOL}, b AS {_head('pool', POOL)}, lists AS (SELECT query_id, chunk_id, rank, 0 AS list_no FROM pool UNION ALL SELECT query_id, chunk_id, rank, 1 FROM b)"
_RRF = "(SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first) AS rank FROM (SELECT query_id, chunk_id, sum(1 / (60 + rank)) AS score, min((list_no, rank)) AS first FROM lists GROUP BY ALL))"
_UNION = "(SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY first) AS rank FROM (SELECT query_id, chunk_id, min((rank, list_no)) AS first FROM lists GROUP BY ALL))"

_UNIT = "list_transform({0}, lambda x: x / sqrt(list_inner_product({0}, {0})))"


def _lloyd(i: int) -> str:
    """The centroids after round i: unit sums of the vectors nearest to each centroid before it."""
    return f"""a{i} AS (SELECT cell, v FROM (SELECT o.cell, u.v, row_number() OVER (PARTITION BY u.chunk_id ORDER BY list_inner_product(u.v, o.v) DESC, o.cell) AS n FROM u, c{i - 1} o) WHERE n = 1),
    s{i} AS (SELECT cell, list(x ORDER BY i) AS v FROM (SELECT cell, i, sum(x) AS x FROM (SELECT cell, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{i}) GROUP BY ALL) GROUP BY cell),
    c{i} AS (SELECT o.cell, CASE WHEN s.v IS NULL THEN o.v ELSE {_UNIT.format("s.v")} END AS v FROM c{i - 1} o LEFT JOIN s{i} s USING (cell))"""


_INDEX = f"""u AS (SELECT chunk_id, {_UNIT.format("e")} AS v FROM c),
    c0 AS (SELECT cell, v FROM (SELECT row_number() OVER (ORDER BY sha256(chunk_id::VARCHAR)) - 1 AS cell, v FROM u) WHERE cell < (SELECT greatest(1, round(sqrt(count(*)))) FROM c)), {_lloyd(1)}, {_lloyd(2)},
    near AS (SELECT u.chunk_id, o.cell, row_number() OVER (PARTITION BY u.chunk_id ORDER BY list_inner_product(u.v, o.v) DESC, o.cell) AS probe FROM u, c2 o),
    far AS (SELECT s.*, q.probe FROM sims s JOIN near h ON h.chunk_id = s.chunk_id AND h.probe = 1 JOIN near q ON q.chunk_id = s.query_id AND q.cell = h.cell),
    few AS (SELECT chunk_id FROM c WHERE chunk_id % 100 = 0 ORDER BY sha256(chunk_id::VARCHAR) LIMIT {CALIBRATION}),
    got AS (SELECT probe, sum(count(*)) OVER (ORDER BY probe) AS upto, sum(count(*)) OVER () AS total FROM far JOIN pool USING (query_id, chunk_id) WHERE query_id IN (SELECT chunk_id FROM few) GROUP BY probe),
    idx AS (SELECT * EXCLUDE (probe) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM far WHERE probe <= (SELECT min(probe) FROM got WHERE upto >= {TARGET} * total)) WHERE rank <= {POOL}),
    hit AS (SELECT p.*, i.chunk_id IS NULL AS off FROM pool p LEFT JOIN idx i ON i.query_id = p.query_id AND i.chunk_id = p.chunk_id)"""
_FUSED = f"(SELECT f.query_id, f.chunk_id, p.source, p.page, p.query_source, f.rank FROM {_RRF} f JOIN pool p ON p.query_id = f.query_id AND p.chunk_id = f.chunk_id)"
_METHODS = f"""m AS (SELECT 'embedding' AS method, query_id, chunk_id, rank FROM pool UNION ALL SELECT 'rescored', query_id, chunk_id, rank FROM b UNION ALL SELECT 'rrf', query_id, chunk_id, rank FROM {_RRF} UNION ALL SELECT 'union', query_id, chunk_id, rank FROM {_UNION}),
    best AS (SELECT method, m.query_id, min(m.rank) AS low FROM m JOIN pool p ON p.query_id = m.query_id AND p.chunk_id = m.chunk_id JOIN gold g ON g.query_id = p.query_id AND g.source = p.source AND g.page = p.page GROUP BY ALL)"""

ORACLE = {
    "exact_topk": f"WITH {_POOL} SELECT query_id, chunk_id, round(similarity, 6) AS similarity, rank FROM pool WHERE rank <= {K}",
    "exact_topk_filtered": f"WITH {_POOL} SELECT query_id, chunk_id, round(similarity, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM sims WHERE source = query_source) WHERE rank <= {K}",
    "retrieve_floor": f"WITH {_POOL} SELECT query_id, chunk_id, round(similarity, 6) AS similarity, rank FROM pool WHERE similarity >= 0.2",
    "retrieve_distinct_pages": f"WITH {_POOL} SELECT query_id, chunk_id, source, page, rank FROM {_pages('pool', K)}",
    "rerank_head": f"WITH {_POOL} SELECT query_id, chunk_id, rerank_score, rank FROM {_head('pool', 10)}",
    "date_aware_order": f"WITH {_POOL} SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY source = query_source DESC, rank) AS rank FROM pool",
    "retrieve_full": f"""WITH {_POOL}, f AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM pool WHERE similarity >= 0.2), h AS {_head("f", 10)},
        o AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY source = query_source DESC, rank) AS rank FROM h) SELECT query_id, chunk_id, source, page, rank FROM {_pages("o", K)}""",
    "eval_per_question": f"WITH {_EVAL} SELECT query_id, {', '.join(f'round({c}, 6) AS {c}' for c in _COLS)} FROM scores",
    "eval_aggregate": f"WITH {_EVAL} SELECT count(*) AS n_questions, {', '.join(f'round(avg({c}), 6) AS {c}' for c in _COLS)} FROM scores",
    "worst_questions": f"WITH {_EVAL} SELECT query_id, round(recall_5, 6) AS recall_5, round(rr, 6) AS rr FROM scores ORDER BY scores.recall_5, scores.rr, query_id LIMIT 5",
    "index_check": f"WITH {_POOL}, {_INDEX} SELECT query_id, count(*) FILTER (similarity >= 0.2 AND off) AS missed FROM hit GROUP BY query_id",
    "index_check_totals": f"""WITH {_POOL}, {_INDEX}, g AS (SELECT query_id, count(*) FILTER (similarity >= 0.2 AND off) AS missed FROM hit GROUP BY query_id),
        a AS (SELECT query_id, list((source, page) ORDER BY rank) AS l FROM {_pages("pool", K)} GROUP BY 1), i AS (SELECT query_id, list((source, page) ORDER BY rank) AS l FROM {_pages("idx", K)} GROUP BY 1)
        SELECT count(*) AS questions, count(*) FILTER (missed > 0) AS with_gap, sum(missed)::BIGINT AS missed_chunks, count(*) FILTER (a.l IS NOT DISTINCT FROM i.l) AS equal_pages FROM g LEFT JOIN a USING (query_id) LEFT JOIN i USING (query_id)""",
    "ann_topk": f"WITH {_POOL}, {_INDEX} SELECT query_id, chunk_id, round(similarity, 6) AS similarity, rank FROM idx",
    "ann_recall": f"WITH {_POOL}, {_INDEX} SELECT query_id, count(*) AS n, count(*) FILTER (NOT off) AS found, round(count(*) FILTER (NOT off) / count(*), 6) AS recall FROM hit GROUP BY 1",
    "unknown_gold_refs": f"WITH {_POOL}, {_GOLD}, {_INDEX} SELECT query_id, source, page FROM gold WHERE (source, page) NOT IN (SELECT (source, page) FROM idx)",
    "gold_ranks": f"WITH {_POOL}, {_GOLD} SELECT h.query_id, min(h.rank) FILTER (g.query_id IS NOT NULL) AS gold_rank FROM {_pages('pool', 1000)} h LEFT JOIN gold g ON g.query_id = h.query_id AND g.source = h.source AND g.page = h.page GROUP BY 1",
    "hybrid_retrieve": f"""WITH {_LISTS}, f AS {_FUSED}, h AS {_head("f", 10)}, o AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY source = query_source DESC, rank) AS rank FROM h) SELECT query_id, chunk_id, source, page, rank FROM {_pages("o", K)}""",
    "gained_lost": f"""WITH {_LISTS}, {_GOLD}, {_METHODS}, f AS (SELECT method, n, query_id FROM best, (VALUES (1), (5)) t(n) WHERE low <= n), o AS (SELECT x.method, f.n, f.query_id FROM f, (SELECT DISTINCT method FROM m WHERE method <> 'embedding') x WHERE f.method = 'embedding'), g AS (SELECT * FROM f WHERE method <> 'embedding')
        SELECT *, 'gained' AS change FROM (SELECT * FROM g EXCEPT SELECT * FROM o) UNION ALL SELECT *, 'lost' FROM (SELECT * FROM o EXCEPT SELECT * FROM g)""",
    "repeat_summary": "SELECT count(*) AS pairs, count(*) FILTER (s = 0) AS identical, round(max(s), 6) AS max_spread, round(avg(s), 6) AS mean_spread, count(*) FILTER (s > 0.05) AS over_005, count(*) FILTER (s > 0.2) AS over_02 FROM (SELECT max(value) - min(value) AS s FROM events GROUP BY user_id, event_type HAVING count(*) = 2)",
    "top1_changes": f"WITH {_POOL}, b AS {_head('pool', 3)} SELECT x.query_id FROM pool x JOIN b USING (query_id) WHERE x.rank = 1 AND b.rank = 1 AND (x.source, x.page) <> (b.source, b.page)",
    "bm25_topk": f"""WITH q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}_]+'))) AS term FROM benchmark), d AS (SELECT doc_id AS chunk_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}_]+') AS words FROM documents),
        facts AS (SELECT count(*) AS n, avg(len(words)) AS a FROM d), p AS (SELECT chunk_id, len, term, count(*) AS f FROM (SELECT chunk_id, len(words) AS len, unnest(words) AS term FROM d) GROUP BY ALL),
        idf AS (SELECT term, ln(1 + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf, a FROM p, facts GROUP BY term, n, a),
        s AS (SELECT query_id, chunk_id, round(sum(idf * f * 2.5::DOUBLE / (f + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / a))), 9) AS score FROM q JOIN idf USING (term) JOIN p USING (term) GROUP BY ALL)
        SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= {K}""",
    "rrf_fuse": f"WITH {_LISTS} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM {_RRF}",
    "union_interleave": f"WITH {_LISTS} SELECT query_id, chunk_id, rank FROM {_UNION}",
    "pool_recall": f"WITH {_LISTS}, {_GOLD}, {_METHODS} SELECT method, n, count(*) FILTER (low <= n) AS found FROM best, (VALUES (5), (10)) t(n) GROUP BY ALL",
    "score_spread": "SELECT user_id, event_type, round(max(value) - min(value), 6) AS spread, count(*) AS passes FROM events GROUP BY ALL",
    "latency_percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(list_sort(list(value))[least(floor(count(*) * 0.95::DOUBLE)::BIGINT, count(*) - 1) + 1], 6) AS p95 FROM events WHERE value IS NOT NULL GROUP BY ALL",
}
ORACLE["bm25_index_topk"] = ORACLE["bm25_topk"]
ORACLE["evaluation_run"] = ORACLE["eval_aggregate"]
ORACLE["exact_topk_where"] = ORACLE["ann_topk_where"] = f"WITH {_POOL} SELECT query_id, chunk_id, round(similarity, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM sims WHERE chunk_id % 2 = {WHERE['half']} AND source = {WHERE['source']}) WHERE rank <= {K}"
_TOKENS = "regexp_extract_all(strip_accents(lower({0})), '[\\p{{L}}\\p{{N}}_]+')"
ORACLE["hybrid_pools"] = f"""WITH {_POOL}, t AS (SELECT doc_id AS chunk_id, text FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)),
    w AS (SELECT chunk_id AS query_id, unnest(list_distinct({_TOKENS.format(f"array_to_string(string_split(text, ' ')[1:{WORDS}], ' ')")})) AS term FROM t WHERE chunk_id % 100 = 0), d AS (SELECT chunk_id, {_TOKENS.format("text")} AS words FROM t),
    facts AS (SELECT count(*) AS n, avg(len(words)) AS a FROM d), p AS (SELECT chunk_id, len, term, count(*) AS f FROM (SELECT chunk_id, len(words) AS len, unnest(words) AS term FROM d) GROUP BY ALL),
    idf AS (SELECT term, ln(1 + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf, a FROM p, facts GROUP BY term, n, a),
    s AS (SELECT query_id, chunk_id, round(sum(idf * f * 2.5::DOUBLE / (f + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / a))), 9) AS score FROM w JOIN idf USING (term) JOIN p USING (term) GROUP BY ALL),
    top AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s),
    b AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM top WHERE rank <= {POOL + 1} AND query_id <> chunk_id),
    lists AS (SELECT query_id, chunk_id, rank, 0 AS list_no FROM pool UNION ALL SELECT query_id, chunk_id, rank, 1 FROM b WHERE rank <= {POOL}),
    f AS (SELECT x.query_id, x.chunk_id, c.source, c.page, x.rank FROM {_RRF} x JOIN c ON c.chunk_id = x.chunk_id), h AS {_head("f", 10)} SELECT query_id, chunk_id, source, page, rank FROM {_pages("h", K)}"""
