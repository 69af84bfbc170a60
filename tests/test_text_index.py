"""The inverted index gives the rows of the exact BM25 and leaves out blocks that can't matter."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import tokens_of
from tessera.operators import retrieval as R
from tessera.operators import text_index as I


def corpus(n, seed=5):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(f"d{i}", " ".join(r.choices(words, weights, k=r.randint(1, 60)))) for i in range(n)]
    for i in range(0, n, 97):  # some documents are about one word
        docs[i] = (docs[i][0], f"rare{i} " * 6 + "w0 w1")
    return [*docs, ("null", None), ("empty", ""), ("accents", "Été À w0"), ("copy1", "w5 w6 w7"), ("copy2", "w5 w6 w7")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(1500), "chunk_id string, text string").cache()


@pytest.fixture(scope="module")
def index(docs, tmp_path_factory):
    return I.build_text_index(docs, str(tmp_path_factory.mktemp("text") / "i"), block_docs=16)


@pytest.fixture(scope="module")
def queries(spark):
    rows = [(1, "w0 w1 w2"), (2, "rare97 w0"), (3, "rare194"), (4, "nothing here"), (5, None), (6, "W5 w6 w7 w5"), (7, "ete a"), (8, " ".join(f"w{i}" for i in range(40)))]
    return spark.createDataFrame(rows, "query_id int, text string")


def of(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 8)) for r in df.collect())


@pytest.mark.parametrize("k", [1, 5, 40])
def test_equals_the_exact_ranking(docs, index, queries, k):
    assert of(I.search_text(queries, index, k)) == of(R.bm25(queries, docs, k))


@pytest.mark.parametrize("few", [0, 500])
def test_terms_pushed_or_joined(docs, index, queries, monkeypatch, few):
    monkeypatch.setattr(I, "PUSHED_TERMS", few)
    found = I.search_text(queries, index, 5)
    assert of(found) == of(R.bm25(queries, docs, 5))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ("PushedFilters: [In(term" in plan) == bool(few)
    assert "text:string" not in plan  # no scan of texts


def test_blocks_below_the_kth_score_are_skipped(spark, index, queries):
    weighted = I.weights(queries.where("query_id = 2"), index)
    first, rest = I.chosen_blocks(weighted, index, 5)
    n = I.bounds(weighted, index).count()
    assert first.count() >= 5 and rest.count() < n / 2
    best = first.orderBy(F.desc("score")).first()
    assert best["chunk_id"] == "d97"


def test_bounds_hold(docs, index, queries):
    weighted = I.weights(queries, index)
    all_ = I.bounds(weighted, index)
    blocks = index.read(docs.sparkSession, "facts").first()["blocks"]
    scores = R.bm25(queries, docs, 10**6).withColumn("block", F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)).cast("int"))
    assert scores.join(all_, ["query_id", "block"], "left").where("bound IS NULL OR score > bound + 1e-8").count() == 0


def test_empty_corpus(docs, queries, tmp_path):
    index = I.build_text_index(docs.limit(0), str(tmp_path / "none"))
    assert I.search_text(queries, index, 3).count() == 0
    index = I.build_text_index(docs.limit(3), str(tmp_path / "few"))
    assert I.search_text(queries.limit(0), index, 3).count() == 0


def test_a_term_has_one_row_a_span(spark, index, docs):
    """Rows and what leaves a span grow with spans, not with blocks and documents."""
    rows = index.read(spark, "postings").where("term IS NOT NULL")
    spans = -(-index.facts(spark)[2] // I.SPAN_BLOCKS)
    assert rows.groupBy("term", "span").count().where("count > 1").count() == 0
    assert rows.count() <= spans * rows.select("term").distinct().count()
    terms = docs.select(F.explode(F.array_distinct(R.tokens(F.col("text")))).alias("term"))
    assert rows.agg(F.sum("n"), F.sum(F.size("heads") + F.size("docs"))).first()[:] == (terms.count(),) * 2


def test_only_the_best_of_a_span_leave_it(spark, index, docs, queries):
    weighted = I.weights(queries, index)
    found = I.scored(I.bounds(weighted, index), weighted, index, 3)
    exact = R.bm25(queries, docs, 10**6)
    blocks = index.facts(spark)[2]
    ranks = exact.withColumn("span", F.expr(f"pmod(xxhash64(chunk_id), {blocks}) div {I.SPAN_BLOCKS}")).selectExpr("query_id", "chunk_id", "score", "rank() OVER (PARTITION BY query_id, span ORDER BY score DESC) AS r")
    want = sorted((r["query_id"], r["chunk_id"], round(r["score"], 7)) for r in ranks.where("r <= 3").collect())
    assert sorted((r["query_id"], r["chunk_id"], round(r["score"], 7)) for r in found.collect()) == want


def test_words_of_other_scripts():
    plain = lambda text: re.findall(r"\w+", "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c)))
    r = random.Random(8)
    letters = "aZ_9 .éÉçßİﬁ½²…Ａ̧́ͅ한글漢字かがｶﾞ゙ไทยัक़़أٔ𝒳‍ ẛ̣"
    for n in range(3000):
        text = "".join(r.choices(letters, k=r.randint(0, 30)))
        assert tokens_of(text) == plain(text), text


def test_many_queries_of_common_words(spark, index, docs):
    """As in hybrid_pools: queries are documents, and their number grows with the corpus; no row for every posting and query is made."""
    q = docs.where("chunk_id LIKE 'd%'").selectExpr("chunk_id AS query_id", "text").orderBy("query_id").limit(I.QUERIES_AT_ONCE + 50).cache()
    found = I.search_text(q, index, 21)
    assert of(found) == of(R.bm25(q, docs, 21))
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
