"""Operator 10: language-model scores by subword lattice likelihood.

The vocabulary and its scores are those of an existing piece model. A word is a lattice of pieces, of which each path
is a segmentation; the log-space forward recursion sums the weights of all paths. Between two characters that stand
side by side in no piece every path has a cut, so a word's marginal is the product of its units' (Pieces.units).

Weights: vocabulary_logp() maps the vocabulary's scores to log-probabilities (scores of a unigram model are such,
those of a merge model are ranks and follow Zipf's law). A pass over the training words takes the expected uses of
every piece under these weights, and the weights become (PRIOR * p + uses) / (PRIOR + all uses); passes are repeated,
over the distinct units of the words with their counts, until the score settles: the model learns from the training
texts, and the vocabulary's scores stay its prior. A stop event ends every word, so the marginal L(word)
is a distribution over words. A text is a chain of tokens, of which ends / N are ends:

    log10 P(text) = log10(ends / N) + sum over its words of log10((1 - ends / N) * L(word))

Words and their counts live in Spark tables; only piece probabilities (one row a piece) and the most frequent words
(CACHE_WORDS and CACHE_BYTES at most) reach the driver.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.pieces import MARK, MODEL, Pieces, load_pieces
from tessera.llm.staging import count_floor, lent, materialise, tables
from tessera.llm.textbytes import LOWER, mix, slices

#: The weight of the vocabulary's scores, in uses.
PRIOR = 1e4
#: Passes at most, and the gain a word (ln) below which they end.
ROUNDS, SETTLED = 8, 0.01
CACHE_WORDS, CACHE_BYTES = 1 << 18, 16 << 20
#: Cells (words x characters) of the lattices that are in memory at a time.
CELLS = 1 << 17
#: Likelihoods below are summed as logarithms; what is lost of larger ones is less than a part in 10 ** 50.
LEAST = 1e-250
_LOWER = LOWER.tobytes()


def tokens(text: str | None) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ of a text with A-Z lower-cased."""
    return (text or "").encode().translate(_LOWER).split()


class PieceLattice:
    """Lattices of many words at once: words of one length stand in one array."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.size = len(pieces.names)
        by_length: dict[int, list[str]] = defaultdict(list)
        for name in pieces.ids:
            by_length[len(name)].append(name)
        self.keys = {}
        for n, names in by_length.items():
            codes = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(names), n)
            own = self.hashes(codes)[-1][:, 0]
            order = np.argsort(own)
            self.keys[n] = own[order], np.array([pieces.ids[x] for x in names])[order]
        self.logp, self.p = None, np.zeros(0)

    def hashes(self, codes: np.ndarray, most: int | None = None) -> list[np.ndarray]:
        """For l = 1, 2, ..: the hashes of all substrings of l characters."""
        one = mix(codes.astype(np.uint64) + np.uint64(1))
        out = [one]
        for n in range(2, min(codes.shape[1], most or codes.shape[1]) + 1):
            out.append(mix(out[-1][:, : codes.shape[1] - n + 1] * np.uint64(0x9E3779B97F4A7C15) + one[:, n - 1 :]))
        return out

    def edges(self, codes: np.ndarray) -> list[np.ndarray]:
        """For l = 1, 2, ..: the id of the piece at every start, or -1."""
        out = []
        for n, h in enumerate(self.hashes(codes, self.pieces.longest), 1):
            if n not in self.keys:
                out.append(np.full(h.shape, -1))
                continue
            keys, ids = self.keys[n]
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            out.append(np.where(keys[at] == h, ids[at], -1))
        return out

    def run(self, words: list[str], logp: np.ndarray, weights: np.ndarray | None = None, uses: np.ndarray | None = None) -> np.ndarray:
        """ln L of each word; with weights (of the words), the expected uses of each piece are added to uses."""
        units, bounds = self.pieces.units(pa.array([MARK + w for w in words], pa.string()))
        units = units.dictionary_encode()
        at = units.indices.to_numpy()
        times = None
        if uses is not None:
            times = np.bincount(at, np.repeat(weights, np.diff(bounds)), len(units.dictionary))
            uses[-1] += weights.sum()
        found = self.chains(units.dictionary.to_pylist(), logp, times, uses)
        return np.add.reduceat(found[at], bounds[:-1]) + logp[-1] if words else np.zeros(0)

    def chains(self, units: list[str], logp: np.ndarray, times: np.ndarray | None, uses: np.ndarray | None) -> np.ndarray:
        out = np.zeros(len(units))
        by_length: dict[int, list[int]] = defaultdict(list)
        for i, u in enumerate(units):
            by_length[len(u)].append(i)
        for n, rows in by_length.items():
            step = max(1, CELLS // n)
            for at in range(0, len(rows), step):
                own = rows[at : at + step]
                codes = np.frombuffer("".join(units[i] for i in own).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(own), n)
                out[own] = self.one_length(codes, logp, None if times is None else times[own], uses)
        return out

    def one_length(self, codes: np.ndarray, logp: np.ndarray, times: np.ndarray | None, uses: np.ndarray | None) -> np.ndarray:
        """ln of the summed weights of all segmentations of units of one length."""
        if self.logp is not logp:
            self.logp, self.p = logp, np.append(np.exp(logp), 0.0)  # the last stands for no piece
        n = codes.shape[1]
        ids = [np.ascontiguousarray(x.T) for x in self.edges(codes)]
        weights = [self.p[x] for x in ids]
        unknown = np.argwhere(ids[0] < 0)
        for s, i in unknown:  # characters without a piece are spelt in byte pieces
            weights[0][s, i] = math.exp(logp[self.pieces.fallback(chr(codes[i, s]))].sum())
        ahead = np.zeros((n + 1, len(codes)))
        ahead[0] = 1
        for j in range(1, n + 1):
            for k in range(1, min(j, len(ids)) + 1):
                ahead[j] += ahead[j - k] * weights[k - 1][j - k]
        small = ahead[n] < LEAST
        if small.any():
            out = np.zeros(len(codes))
            for rows, f in (small, self.in_logs), (~small, self.one_length):
                out[rows] = f(codes[rows], logp, None if times is None else times[rows], uses) if rows.any() else 0
            return out
        if uses is not None:
            behind = np.zeros((n + 1, len(codes)))
            behind[n] = 1
            for s in range(n - 1, -1, -1):
                for k in range(1, min(n - s, len(ids)) + 1):
                    behind[s] += behind[s + k] * weights[k - 1][s]
            for k, x in enumerate(ids, 1):
                share = ahead[: n - k + 1] * weights[k - 1] * behind[k:] * (times / ahead[n])
                uses += np.bincount(x.ravel() + 1, share.ravel(), len(uses) + 1)[1:]
                if k == 1:
                    for s, i in unknown:
                        np.add.at(uses, self.pieces.fallback(chr(codes[i, s])), share[s, i])
        return np.log(ahead[n])

    def in_logs(self, codes: np.ndarray, logp: np.ndarray, times: np.ndarray | None, uses: np.ndarray | None) -> np.ndarray:
        """one_length() of units whose likelihood is too small for a number."""
        m, n = codes.shape
        ids = self.edges(codes)
        weights = [np.where(x >= 0, logp[x], -np.inf) for x in ids]
        unknown = np.argwhere(ids[0] < 0)
        for i, s in unknown:  # characters without a piece are spelt in byte pieces
            weights[0][i, s] = logp[self.pieces.fallback(chr(codes[i, s]))].sum()
        ahead = np.full((n + 1, m), -np.inf)
        ahead[0] = 0
        for j in range(1, n + 1):
            ahead[j] = np.logaddexp.reduce([ahead[j - k] + weights[k - 1][:, j - k] for k in range(1, min(j, len(ids)) + 1)], axis=0)
        if uses is not None:
            behind = np.full((n + 1, m), -np.inf)
            behind[n] = 0
            for s in range(n - 1, -1, -1):
                behind[s] = np.logaddexp.reduce([behind[s + k] + weights[k - 1][:, s] for k in range(1, min(n - s, len(ids)) + 1)], axis=0)
            for k, x in enumerate(ids, 1):
                share = np.exp(ahead[: n - k + 1].T + weights[k - 1] + behind[k:].T - ahead[n][:, None]) * times[:, None]
                uses += np.bincount(x[x >= 0], share[x >= 0], minlength=len(uses))[: len(uses)]
                if k == 1:
                    for i, s in unknown:
                        np.add.at(uses, self.pieces.fallback(chr(codes[i, s])), share[i, s])
        return ahead[n]


def vocabulary_logp(pieces: Pieces) -> np.ndarray:
    """ln of the probability of each id by the vocabulary's scores alone, and of the stop event (one sixth) at the end.

    A unigram model's scores are log-probabilities. A merge model's are ranks: 1 / (rank + 2), ranks in order of ids.
    Ids that aren't pieces (bytes, controls) have the least weight of a piece.
    """
    if pieces.merges:
        weight = 1 / np.arange(2, len(pieces.names) + 2, dtype=float)
    else:
        score = np.array(pieces.scores)
        normal = np.array(pieces.kinds) == 1
        weight = np.exp(np.where(normal, score, score[normal].min()) - score[normal].max())
    return np.log(np.append(weight, 0.2 * weight.sum()) / (1.2 * weight.sum()))


def word_counts(docs: DataFrame, trains: Column) -> DataFrame:
    """word (UTF-8 bytes), c (occurrences in training texts) of every distinct word of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[Counter[bytes]] = [Counter(), Counter()]

        def rows() -> pa.RecordBatch:
            words = list(seen[1] | seen[0])
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([seen[1][w] for w in words], pa.int64())], ["word", "c"])
            seen[0].clear()
            seen[1].clear()
            return out

        for batch in batches:
            for part in slices(batch, "text"):
                for text, train in zip(part.column("text").to_pylist(), part.column("trains").to_pylist()):
                    seen[train].update(tokens(text))
                if len(seen[0]) + len(seen[1]) > 1 << 19:  # bounds the task's memory; Spark adds the parts up
                    yield rows()
        yield rows()

    return docs.select("text", trains.alias("trains")).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def texts_of(batch: pa.RecordBatch) -> list[str]:
    return batch.column("word").cast(pa.string()).to_pylist()


def unit_counts(counts: DataFrame, pieces: Pieces) -> DataFrame:
    """unit, times: how often each unit stands in the training texts, over all words with c > 0."""
    shared = counts.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lent(shared) as own:
            for batch in batches:
                units, bounds = own.units(pa.array([MARK + w for w in texts_of(batch)], pa.string()))
                known = units.dictionary_encode()
                times = np.bincount(known.indices.to_numpy(), np.repeat(batch.column("c").to_numpy(), np.diff(bounds)), len(known.dictionary))
                yield pa.RecordBatch.from_arrays([known.dictionary.cast(pa.string()), pa.array(times.astype(np.int64))], ["unit", "times"])

    return counts.where("c > 0").select("word", "c").mapInArrow(run, "unit string, times long").groupBy("unit").agg(F.sum("times").alias("times"))


def learned_pieces(counts: DataFrame, pieces: Pieces, prior: float = PRIOR, rounds: int = ROUNDS, settled: float = SETTLED) -> np.ndarray:
    """ln of the piece probabilities by expectation maximisation: the vocabulary's, as `prior` uses, and the expected uses in all occurrences of all words with c > 0.

    Rounds go over the table of distinct units, written once, until a round gains less than `settled` (ln) a word, or
    `rounds` are done.
    """
    first = now = vocabulary_logp(pieces)
    spark = counts.sparkSession
    words = counts.where("c > 0").agg(F.sum("c")).first()[0] or 0
    if not words:
        return now
    units = materialise(unit_counts(counts, pieces), "units")
    before = -math.inf
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((pieces, now))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with lent(shared) as (own, logp):  # noqa: B023
                lattice, uses, total = PieceLattice(own), np.zeros(len(logp)), 0.0
                for batch in batches:
                    times = batch.column("times").to_numpy().astype(float)
                    total += float(times @ lattice.chains(batch.column("unit").to_pylist(), logp, times, uses))
                used = np.flatnonzero(uses)
                yield pa.RecordBatch.from_arrays([pa.array([-1, *used.tolist()]), pa.array([total, *uses[used].tolist()])], ["id", "uses"])

        uses = np.zeros(len(now))
        rows = dict(tuple(r) for r in units.mapInArrow(run, "id long, uses double").groupBy("id").agg(F.sum("uses")).collect())  # one row a piece
        score = rows.pop(-1, 0.0) / words + now[-1]
        for i, x in rows.items():
            uses[i] = x
        uses[-1] += words
        now = np.log((prior * np.exp(first) + uses) / (prior + uses.sum()))
        if score - before < settled:
            break
        before = score
    return now


def scored(docs: DataFrame, held_out: Column, path: str = MODEL, order: str = "doc_id") -> DataFrame:
    """Per row: order, held_out, n_tokens, n_known, train_tokens, base_score and score, learnt from the rows not held out.

    A null text is empty: its one token is the end. Rows may repeat, ids may be null. Without training rows N and V are
    0, the pieces' weights are the vocabulary's, and half of the tokens count as ends. Columns other than order and text
    aren't looked at.
    """
    spark = docs.sparkSession
    pieces = load_pieces(path)
    key = docs.schema[order].dataType.simpleString()
    rows = docs.select(F.col(order).alias("doc_id"), "text", held_out.alias("held_out"))
    counts = materialise(word_counts(rows, ~F.col("held_out")), "counts")
    ends = rows.where(~F.col("held_out")).count()
    facts = counts.where("c > 0").agg(F.sum("c"), F.count("*")).first()
    n, v = (facts[0] or 0) + ends, facts[1] + (ends > 0)
    share = ends / n if n > ends else 0.5
    shared = spark.sparkContext.broadcast((pieces, learned_pieces(counts, pieces)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lent(shared) as (own, logp):
            lattice = PieceLattice(own)
            for batch in batches:
                base = np.log10((batch.column("c").to_numpy() + 1) / (n + v + 1))
                score = (lattice.run(texts_of(batch), logp) + math.log1p(-share)) / math.log(10)
                yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(base), pa.array(score)], ["word", "c", "base", "score"])

    words = materialise(counts.mapInArrow(weigh, "word binary, c long, base double, score double"), "words")
    top = words.where(F.col("c") >= count_floor(words, "c", CACHE_WORDS, F.octet_length("word"), CACHE_BYTES)).toLocalIterator()
    end_base, end_score = math.log10((ends + 1) / (n + v + 1)), math.log10(share)
    frequent = spark.sparkContext.broadcast({bytes(r["word"]): (int(r["c"] > 0), r["base"], r["score"]) for r in top})

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of documents, summed over frequent words, and (word not null) rows of their other words."""
        with lent(frequent) as known:
            for batch in (part for whole in batches for part in slices(whole, "text")):
                out: list[tuple] = []
                for uid, doc, held, text in zip(*(batch.column(x).to_pylist() for x in ("uid", "doc_id", "held_out", "text"))):
                    own = Counter(tokens(text))
                    total, seen, base, score = 1, int(ends > 0), [end_base], [end_score]
                    for w, times in own.items():
                        total += times
                        if (x := known.get(w)) is not None:
                            seen += times * x[0]
                            base.append(times * x[1])
                            score.append(times * x[2])
                        else:
                            out.append((uid, None, None, w, times, None, None, None))
                    out.append((uid, doc, held, None, total, seen, math.fsum(base), math.fsum(score)))
                kinds = (pa.int64(), batch.schema.field("doc_id").type, pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
                for at in range(0, len(out), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out[at : at + (1 << 16)]), kinds)], ["uid", "doc_id", "held_out", "word", "times", "known", "base", "score"])

    numbered = rows.withColumn("uid", F.monotonically_increasing_id())  # evaluated once, for parts
    parts = materialise(numbered.mapInArrow(split, f"uid long, doc_id {key}, held_out boolean, word binary, times long, known long, base double, score double"), "parts")
    rest = parts.where(F.col("word").isNotNull()).select("uid", "word", "times").join(words, "word").groupBy("uid")
    rest = rest.agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("k"), F.sum(F.col("times") * F.col("base")).alias("b"), F.sum(F.col("times") * F.col("score")).alias("s"))
    add = lambda a, b, zero: (F.col(a) + F.coalesce(b, F.lit(zero))).alias(a)
    return parts.where(F.col("word").isNull()).join(rest, "uid", "left").select(
        "doc_id", "held_out", F.col("times").alias("n_tokens"), add("known", "k", 0).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        add("base", "b", 0.0).alias("base_score"), add("score", "s", 0.0),
    )


def op10_subword_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those whose crc32(doc_id) mod 7 is not 2."""
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    return scored(tables(spark, sf_dir, "documents"), held_out)


QUERIES = {"op10_subword_lattice_lm": op10_subword_lattice_lm}
ORACLE_SQL: dict[str, str] = {}
