"""BM25 over a persisted inverted index, with blocks that can't reach a query's k-th score left out.

Documents lie in blocks of about BLOCK_DOCS by a hash of their id, and SPAN_BLOCKS blocks make a span. A row of the
postings holds a term's postings in one span: numbers of documents there and how often they have the term. Heads are
those of a block that no other posting of it outdoes by more uses in a document that isn't longer; one of them has the
greatest impact of the block, whatever the average length, so the sum over a query's terms bounds the score of every
document of a block from the heads alone. The row of a span without a term lists its documents. A search scores each
query's most promising blocks, takes the k-th score found, and then only those other blocks whose bound reaches it.

Texts are exchanged once, by span; a task makes the rows of one span at a time and writes them in order of the terms, so
that the statistics of a file's pages tell which terms they have. Scores of a span are sums in arrays, and only the k
best of a query leave it.

Results are those of retrieval.bm25: null texts are empty, ties go by chunk_id, ids must not be null.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.functions.text import tokens_of
from tessera.operators.retrieval import B, K1, ranked, tokens
from tessera.staging import materialise

BLOCK_DOCS = 128
SPAN_BLOCKS = 16
#: Blocks of each query that are scored first.
FIRST_BLOCKS = 4
#: Query terms that are pushed to the scan as values; more are only joined.
PUSHED_TERMS = 500
#: Queries whose scores of a span are held at a time.
QUERIES_AT_ONCE = 256


@dataclass(frozen=True)
class TextIndex:
    """Where an index lies: path/postings (span, term, n, heads, heads_f, docs, f; without a term chunk_ids, lens, blocks) and path/facts (n, avg, blocks)."""

    path: str

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{name}")

    def facts(self, spark: SparkSession) -> tuple[int, float, int]:
        """The number of documents, their average number of words (0 if there are none) and the number of blocks: one row."""
        row = self.read(spark, "facts").first()
        return row["n"], row["avg"] or 0.0, row["blocks"]


def impact(f: np.ndarray, lens: np.ndarray, avg: float) -> np.ndarray:
    """What a posting adds to a score, but for its term's idf."""
    return f * (K1 + 1) / (f + K1 * (1 - B + B * lens / avg))


def lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


class Numbers(dict):
    """Numbers of words, in the order in which they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def span_rows(span: int, blocks: np.ndarray, ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
    """The rows of one span, whose documents come in order of their blocks."""
    known, terms, uses, lens, distinct = Numbers(), [], [], [], []
    for text in texts:
        words = tokens_of(text)
        counts = Counter(words)
        terms.extend([known[w] for w in counts])
        uses.extend(counts.values())
        lens.append(len(words))
        distinct.append(len(counts))
    words = sorted(known)
    place = np.empty(len(words), np.int64)
    place[[known[w] for w in words]] = np.arange(len(words))
    term, f, length = place[np.array(terms, np.int64)], np.array(uses, np.int32), np.array(lens, np.int32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), distinct)
    # within a term and block by length, then by uses from the most: a head has more uses than all before it
    order = np.lexsort((-f, length[doc], blocks[doc], term))
    term, doc, f = term[order], doc[order], f[order]
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (blocks[doc[1:]] != blocks[doc[:-1]])
    grown = np.maximum.accumulate((np.cumsum(new) << 32) + f)
    head = new.copy()
    head[1:] |= grown[1:] > grown[:-1]
    of = lambda which, x: lists(x[which], np.bincount(term[which], minlength=len(words)))
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    columns = {"heads": of(head, doc), "heads_f": of(head, f), "docs": of(~head, doc), "f": of(~head, f)}
    about = {"chunk_ids": one(ids), "lens": one(pa.array(length)), "blocks": one(pa.array(blocks))}
    n = len(words)
    arrays = {"span": pa.array(np.full(n + 1, span, np.int32)), "term": pa.array([None, *words], pa.string()), "n": pa.array(np.concatenate([[0], np.bincount(term, minlength=n)]).astype(np.int32))}
    arrays |= {c: pa.concat_arrays([pa.nulls(1, x.type), x]) for c, x in columns.items()} | {c: pa.concat_arrays([x, pa.nulls(n, x.type)]) for c, x in about.items()}
    return pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))


def build_text_index(docs: DataFrame, path: str, block_docs: int = BLOCK_DOCS) -> TextIndex:
    """Write the index of docs (chunk_id, text)."""
    index, spark = TextIndex(path), docs.sparkSession
    blocks = max(1, -(-docs.count() // block_docs))
    block = F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)).cast("int")
    placed = docs.select(block.alias("block"), "chunk_id", "text").withColumn("span", F.expr(f"block div {SPAN_BLOCKS}").cast("int"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema["chunk_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def rows() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            ids = whole.column("chunk_id").combine_chunks()
            return span_rows(whole.column("span")[0].as_py(), whole.column("block").to_numpy(), ids, whole.column("text").to_pylist())

        for b in batches:
            spans = b.column("span").to_numpy()
            cuts = [0, *(np.flatnonzero(spans[1:] != spans[:-1]) + 1).tolist(), len(spans)]
            for at, to in zip(cuts[:-1], cuts[1:]):
                if held and to > at and held[0].column("span")[0].as_py() != spans[at]:
                    yield rows()
                    held = []
                if to > at:
                    held.append(b.slice(at, to - at))
        if held:
            yield rows()

    schema = f"span int, term string, n int, heads array<int>, heads_f array<int>, docs array<int>, f array<int>, chunk_ids array<{kind}>, lens array<int>, blocks array<int>"
    whole = placed.repartition(parts, "span").sortWithinPartitions("span", "block").mapInArrow(run, schema)
    whole.write.parquet(f"{path}/postings")
    each = index.read(spark, "postings").where(F.col("term").isNull()).select(F.explode("lens").alias("len"))
    each.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), F.lit(blocks).alias("blocks")).coalesce(1).write.parquet(f"{path}/facts")
    return index


def weights(queries: DataFrame, index: TextIndex) -> DataFrame:
    """(query_id, term, idf) for the terms of queries (query_id, text) that documents have."""
    spark = queries.sparkSession
    own = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    own = materialise(own, "query-terms")
    df = pushed(index.read(spark, "postings"), own).select("term", "n").groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.log(1 + (index.facts(spark)[0] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return own.join(df, "term").select("query_id", "term", idf.alias("idf"))


def pushed(table: DataFrame, own: DataFrame) -> DataFrame:
    """The rows of table with terms of own, which are a filter of its scan if they are few."""
    few = [r[0] for r in own.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
    return table.where(F.col("term").isin(few)) if len(few) <= PUSHED_TERMS else table.join(own.select("term").distinct(), "term", "left_semi")


def spans_of(wanted: DataFrame, weighted: DataFrame) -> DataFrame:
    """(span, query_id, wanted, weights): the wanted blocks (query_id, block) of a query in each span, with the query's terms."""
    terms = weighted.groupBy("query_id").agg(F.collect_list(F.struct("term", "idf")).alias("weights"))  # the words of one query
    blocks = wanted.groupBy(F.expr(f"block div {SPAN_BLOCKS}").cast("int").alias("span"), "query_id").agg(F.collect_list("block").alias("wanted"))  # SPAN_BLOCKS at most
    return blocks.join(terms, "query_id").select("span", "query_id", "wanted", "weights")


def by_span(asked: DataFrame, weighted: DataFrame, index: TextIndex, columns: list[str], schema: str, run: Callable[..., pa.Table]) -> DataFrame:
    """run(ids, lens, blocks, postings, some, terms) of every span that is asked for, for QUERIES_AT_ONCE rows of `asked` at a time.

    ids, lens and blocks are those of the span's documents; postings(i) gives the numbers of documents and the uses of
    the term in the i-th row; some: the rows of `asked`; terms: (i, numbers of rows of some, idf) of each term they have.
    """
    table = index.read(asked.sparkSession, "postings")
    hits = pushed(table, weighted).select("span", "term", *columns)
    about = table.where(F.col("term").isNull()).select("span", "chunk_ids", "lens", "blocks")
    left = hits.unionByName(about, allowMissingColumns=True)

    def each(rows: pa.Table, wants: pa.Table) -> pa.Table:
        rows, wants = rows.combine_chunks(), wants.combine_chunks()
        at = np.flatnonzero(rows.column("chunk_ids").is_valid().to_numpy()) if wants.num_rows else []
        if not len(at):
            return empty
        one = lambda c: rows.column(c)[int(at[0])].values
        ids, lens, blocks = one("chunk_ids"), one("lens").to_numpy(), one("blocks").to_numpy()
        flat = {c: rows.column(c).combine_chunks() for c in columns}
        values, starts = {c: x.values.to_numpy() for c, x in flat.items()}, {c: x.offsets.to_numpy() for c, x in flat.items()}
        postings = lambda i: tuple(np.concatenate([values[c][starts[c][i] : starts[c][i + 1]] for c in columns[k::2]]) for k in (0, 1))
        row_of = {t: i for i, t in enumerate(rows.column("term").to_pylist()) if t is not None}
        out = []
        for a in range(0, wants.num_rows, QUERIES_AT_ONCE):
            some = wants.slice(a, QUERIES_AT_ONCE)
            terms: dict[int, tuple[list[int], list[float]]] = {}
            for n, own in enumerate(some.column("weights").to_pylist()):
                for w in own:
                    if (i := row_of.get(w["term"])) is not None:
                        numbers, idfs = terms.setdefault(i, ([], []))
                        numbers.append(n)
                        idfs.append(w["idf"])
            out.append(run(ids, lens, blocks, postings, some, [(i, np.array(n), np.array(idf)) for i, (n, idf) in terms.items()]))
        return pa.concat_tables(out)

    empty = to_arrow_schema(T.StructType.fromDDL(schema)).empty_table()
    return left.groupBy("span").cogroup(asked.groupBy("span")).applyInArrow(each, schema)


def bounds(weighted: DataFrame, index: TextIndex) -> DataFrame:
    """(query_id, block, bound): what no document of the block scores above. Reads no postings but heads."""
    spark = weighted.sparkSession
    _, avg, n = index.facts(spark)
    every = spark.range(-(-n // SPAN_BLOCKS)).select(F.col("id").cast("int").alias("span"))
    asked = every.crossJoin(weighted.groupBy("query_id").agg(F.collect_list(F.struct("term", "idf")).alias("weights")))
    kind = weighted.schema["query_id"].dataType.simpleString()

    def run(ids, lens, blocks, postings, some, terms) -> pa.Table:
        own, local = np.unique(blocks, return_inverse=True)
        total = np.zeros((some.num_rows, len(own)))
        for i, queries, idf in terms:
            docs, f = postings(i)
            top = np.zeros(len(own))
            np.maximum.at(top, local[docs], impact(f, lens[docs], avg))
            total[queries] += idf[:, None] * top
        q, b = np.nonzero(total)
        return pa.table({"query_id": some.column("query_id").combine_chunks().take(pa.array(q)), "block": pa.array(own[b], pa.int32()), "bound": pa.array(total[q, b])})

    return by_span(asked, weighted, index, ["heads", "heads_f"], f"query_id {kind}, block int, bound double", run)


def scored(wanted: DataFrame, weighted: DataFrame, index: TextIndex, k: int) -> DataFrame:
    """(query_id, chunk_id, score) of the documents in wanted blocks (query_id, block): of each span those among a query's k best there, ties included."""
    spark = wanted.sparkSession
    avg = index.facts(spark)[1]
    kinds = weighted.schema["query_id"].dataType.simpleString(), index.read(spark, "postings").schema["chunk_ids"].dataType.elementType.simpleString()

    def run(ids, lens, blocks, postings, some, terms) -> pa.Table:
        own, local = np.unique(blocks, return_inverse=True)
        total = np.zeros((some.num_rows, len(lens)))
        for i, queries, idf in terms:
            docs, f = postings(i)
            total[np.ix_(queries, docs)] += idf[:, None] * impact(f, lens[docs], avg)
        lists_ = some.column("wanted").combine_chunks()
        ok = np.zeros((some.num_rows, len(own)), bool)
        number, block = np.repeat(np.arange(some.num_rows), pc.list_value_length(lists_).to_numpy()), lists_.flatten().to_numpy()
        at = np.searchsorted(own, block).clip(max=len(own) - 1)
        ok[number, at] = own[at] == block
        total[~ok[:, local]] = 0
        # scores are rounded to nine digits afterwards, which may make ties
        least = np.partition(total, -k, axis=1)[:, -k, None] - 2e-9 if k < total.shape[1] else 0
        q, d = np.nonzero((total > 0) & (total >= least))
        return pa.table({"query_id": some.column("query_id").combine_chunks().take(pa.array(q)), "chunk_id": ids.take(pa.array(d)), "score": pa.array(total[q, d])})

    found = by_span(spans_of(wanted, weighted), weighted, index, ["heads", "heads_f", "docs", "f"], f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double", run)
    return found.withColumn("score", F.round("score", 9))


def chosen_blocks(weighted: DataFrame, index: TextIndex, k: int) -> tuple[DataFrame, DataFrame]:
    """The scores of each query's first blocks, and the other blocks (query_id, block) that may hold one of its k best."""
    best = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    all_ = materialise(bounds(weighted, index).withColumn("_n", F.row_number().over(best)), "bounds")
    first = materialise(scored(all_.where(F.col("_n") <= FIRST_BLOCKS), weighted, index, k), "first-scores")
    least = ranked(first, F.desc("score")).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    # scores are rounded to nine digits; a bound that equals the k-th score may hide a tie
    rest = all_.where(F.col("_n") > FIRST_BLOCKS).join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 1e-8))
    return first, rest.select("query_id", "block")


def search_text(queries: DataFrame, index: TextIndex, k: int) -> DataFrame:
    """(query_id, chunk_id, score, rank) of the k best documents of each query (query_id, text)."""
    weighted = materialise(weights(queries, index), "weights")
    first, rest = chosen_blocks(weighted, index, k)
    return ranked(first.unionByName(scored(rest, weighted, index, k)), F.desc("score"), "chunk_id").where(F.col("rank") <= k)
