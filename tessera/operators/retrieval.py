"""Vector search, BM25, fusion, re-ranking and the order of retrieved chunks. Every list order is an explicit rank."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import tokens_of
from tessera.staging import materialise

#: Query vectors that are sent to all tasks at a time.
QUERY_BLOCK = 4096
K1, B = 1.5, 0.75


def unit_rows(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def best_pairs(q: np.ndarray, x: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of q, row of x and similarity of at least the k most similar x of each q, ties included, where `off` is false.

    A product of matrices finds them; the similarities are then computed pair by pair, so that equal vectors tie.
    """
    sims = q @ x.T
    sims[off] = -np.inf
    floor = -np.partition(-sims, k - 1, axis=1)[:, k - 1 : k] - 1e-9 if k < x.shape[0] else -np.inf
    at, to = np.nonzero((sims >= floor) & (sims > -np.inf))
    return at, to, np.concatenate([np.einsum("ij,ij->i", q[at[i : i + 65536]], x[to[i : i + 65536]]) for i in range(0, len(at), 65536)] or [np.zeros(0)])


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int, same: str | None = None) -> DataFrame:
    """(query_id, chunk_id, similarity, rank): exact cosine top k, ties by chunk_id, a chunk never matches itself.

    queries (query_id, embedding), corpus (chunk_id, embedding). With `same`, a column of both, only equal values
    match. Queries go to the tasks in blocks of QUERY_BLOCK; each task keeps its k best, which are ranked together.
    """
    spark = queries.sparkSession
    columns = ["query_id", "embedding", *([same] if same else [])]
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {corpus.schema['chunk_id'].dataType.simpleString()}, similarity double"
    parts: list[DataFrame] = []

    def search(block: list) -> DataFrame:
        ids = np.array([r[0] for r in block])
        matrix = unit_rows(pd.Series([r[1] for r in block]))
        kind = np.array([r[2] for r in block]) if same else None
        shared = spark.sparkContext.broadcast((ids, matrix, kind))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, matrix, kind = shared.value
            best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # query number, chunk, similarity

            def pruned() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                q, chunk, sims = (np.concatenate(x) for x in zip(*best))
                order = np.lexsort((chunk, -sims, q))
                q = q[order]
                order = order[np.arange(len(q)) - np.searchsorted(q, q) < k]
                return np.concatenate([b[0] for b in best])[order], chunk[order], sims[order]

            for x in frames:
                for at in range(0, len(x), 2048):
                    f = x.iloc[at : at + 2048]
                    chunk = f["chunk_id"].to_numpy()
                    off = ids[:, None] == chunk[None, :]
                    if kind is not None:
                        off |= kind[:, None] != f[same].to_numpy()[None, :]
                    q, c, sims = best_pairs(matrix, unit_rows(f["embedding"]), off, k)
                    best.append((q, chunk[c], sims))
                    best = [pruned()]
            if best:
                q, chunk, sims = best[0]
                yield pd.DataFrame({"query_id": ids[q], "chunk_id": chunk, "similarity": sims})

        return corpus.select("chunk_id", "embedding", *([same] if same else [])).mapInPandas(run, schema)

    block: list = []
    for row in queries.select(*columns).toLocalIterator():
        block.append(row)
        if len(block) == QUERY_BLOCK:
            parts.append(search(block))
            block = []
    if block or not parts:
        parts.append(search(block) if block else queries.sparkSession.createDataFrame([], schema))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return ranked(found, F.desc("similarity"), "chunk_id").where(F.col("rank") <= k)


def having(corpus: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """The chunks that have all of the metadata values; to be taken before similarities. Null equals nothing; an unknown key is an error."""
    if unknown := [c for c in values if c not in corpus.columns]:
        raise ValueError(f"chunks have no {', '.join(unknown)}")
    for c, v in values.items():
        corpus = corpus.where(F.lit(False) if v is None else F.col(c) == F.lit(v))
    return corpus


def ranked(df: DataFrame, *order: Column | str, key: str = "query_id", name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def above_floor(hits: DataFrame, floor: float = 0.35) -> DataFrame:
    return hits.where(F.col("similarity") >= floor)


def rerank_head(hits: DataFrame, score: Column, head: int = 10) -> DataFrame:
    """The first `head` of each list by score (nulls last, ties in the old order); the rest as they were."""
    in_head = F.col("rank") <= head
    scored = hits.withColumn("rerank_score", F.when(in_head, score))
    return ranked(scored.withColumnRenamed("rank", "_r"), (F.col("_r") <= head).desc(), F.col("rerank_score").desc_nulls_last(), "_r").drop("_r")


def covering_first(hits: DataFrame, covers: Column) -> DataFrame:
    """Chunks for which `covers` holds first, otherwise in the old order."""
    return ranked(hits.withColumnRenamed("rank", "_r"), F.coalesce(covers, F.lit(False)).desc(), "_r").drop("_r")


def distinct_pages(hits: DataFrame, k: int | None = None) -> DataFrame:
    """The first chunk of each (source, page), ranked anew."""
    first = Window.partitionBy("query_id", "source", "page").orderBy("rank")
    out = hits.withColumn("_n", F.row_number().over(first)).where("_n = 1").withColumnRenamed("rank", "_r")
    out = ranked(out, "_r").drop("_n", "_r")
    return out.where(F.col("rank") <= k) if k else out


def retrieve(hits: DataFrame, k: int = 5, floor: float = 0.35, score: Column | None = None, covers: Column | None = None, head: int = 10) -> DataFrame:
    """Over-fetched hits (query_id, chunk_id, source, page, similarity, rank) to at most k pages a query."""
    out = ranked(above_floor(hits, floor).withColumnRenamed("rank", "_r"), "_r").drop("_r") if floor is not None else hits
    if score is not None:
        out = rerank_head(out, score, head)
    if covers is not None:
        out = covering_first(out, covers)
    return distinct_pages(out, k)


#: Query terms above this aren't sent to the tasks; all postings are then counted and joined.
TERMS = 1 << 20


@F.pandas_udf(T.ArrayType(T.StringType()))
def tokens(text: pd.Series) -> pd.Series:
    """Lower-case words without accents."""
    return text.map(tokens_of)


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(chunk_id, len, term, f): a document's number of words and how often it has each query term; one row with a null term for every document."""
    known = [r[0] for r in terms.select("term").distinct().limit(TERMS + 1).toLocalIterator()]
    shared = docs.sparkSession.sparkContext.broadcast(set(known) if len(known) <= TERMS else None)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = shared.value
        for x in frames:
            out = []
            for key, text in zip(x["chunk_id"], x["text"]):
                words = tokens_of(text)
                out.append((key, len(words), None, 0))
                counts = Counter(w for w in words if w in wanted) if wanted is not None else Counter(words)
                out += [(key, len(words), w, f) for w, f in counts.items()]
            yield pd.DataFrame(out, columns=["chunk_id", "len", "term", "f"])

    found = docs.select("chunk_id", "text").mapInPandas(run, f"chunk_id {docs.schema['chunk_id'].dataType.simpleString()}, len long, term string, f long")
    return found if len(known) <= TERMS else found.where(F.col("term").isNull()).unionByName(found.join(terms.select("term").distinct(), "term", "left_semi").select("chunk_id", "len", "term", "f"))


def bm25(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score, rank) of queries (query_id, text) over docs (chunk_id, text; a null text is empty).

    Documents are read once; their words are counted where they are, and only counts of query terms leave the task.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    counted = materialise(postings(docs, terms), "postings")
    facts = counted.where(F.col("term").isNull()).agg(F.count("*").alias("n"), F.avg("len").alias("avg"))
    hits = counted.where(F.col("term").isNotNull())
    idf = hits.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(facts)).select("term", "avg", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    part = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    scores = terms.join(idf, "term").join(hits, "term").groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), 9).alias("score"))
    return ranked(scores, F.desc("score"), "chunk_id").where(F.col("rank") <= k)


def union_lists(*lists: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Ranked lists (query_id, chunk_id, rank and carried columns of the chunk) as one, with list_no."""
    out = None
    for i, x in enumerate(lists):
        part = x.select("query_id", "chunk_id", *carry, "rank", F.lit(i).alias("list_no"))
        out = part if out is None else out.unionByName(part)
    return out


def rrf(*lists: DataFrame, constant: int = 60, carry: tuple[str, ...] = ()) -> DataFrame:
    """Reciprocal-rank fusion: sum of 1 / (constant + rank); ties by the first list, then its rank."""
    fused = union_lists(*lists, carry=carry).groupBy("query_id", "chunk_id", *carry).agg(F.sum(1 / (constant + F.col("rank"))).alias("score"), F.min(F.struct("list_no", "rank")).alias("_first"))
    return ranked(fused, F.desc(F.round("score", 12)), "_first").drop("_first")


def interleaved(*lists: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Round-robin union: by rank, then list; repeats dropped."""
    first = union_lists(*lists, carry=carry).groupBy("query_id", "chunk_id", *carry).agg(F.min(F.struct("rank", "list_no")).alias("_first"))
    return ranked(first, "_first").drop("_first")


def hybrid(first: DataFrame, second: DataFrame, score: Column, k: int, head: int = 10, covers: Column | None = None, merge: str = "hybrid", carry: tuple[str, ...] = ("source", "page")) -> DataFrame:
    """Two ranked pools (query_id, chunk_id, rank and carried columns) to at most k pages a query.

    The pools are fused ("hybrid": reciprocal ranks, "union": round robin), the head is re-ranked by `score`, chunks
    that `covers` go first, and each page stays once. There's neither a floor nor a filter.
    """
    pool = rrf(first, second, carry=carry) if merge == "hybrid" else interleaved(first, second, carry=carry)
    out = rerank_head(pool, score, head)
    if covers is not None:
        out = covering_first(out, covers)
    return distinct_pages(out, k)


def gold_rank(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, gold_rank): the rank of the first gold page among the distinct pages of each list; null if none is there."""
    pages = distinct_pages(hits).join(gold.select("query_id", "source", "page").distinct().withColumn("_gold", F.lit(1)), ["query_id", "source", "page"], "left")
    return pages.groupBy("query_id").agg(F.min(F.when(F.col("_gold") == 1, F.col("rank"))).alias("gold_rank"))
