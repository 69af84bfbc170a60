"""Operator 11: periodic runs of words by an online DP over sparse diagonals.

A run is a stretch of consecutive words with smallest period q and at least max(LEAST, EXPONENT * q) words that no
neighbouring word extends keeping that period. Words are read from left to right. An earlier occurrence of the word,
q words back, adds 1 to the match length of the active diagonal of lag q; a diagonal that the word doesn't extend ends
there, and its run is emitted at once if it is long enough.

Which earlier occurrences are visited is what keeps the DP sparse. A run has at least 16 matches on its diagonal, so an
occurrence only counts if the 15 words before both agree too; a diagonal enters with the length of that context. A lag
of at most 16 words is met as the nearest occurrence of the 16-word context: a nearer one, d words back, would give
the stretch the period gcd(d, q), hence a smaller one. For lags in (g / 2, g], g = 32, 64, .., the same holds for
contexts of g words, and a run of three periods has them. So a word visits one occurrence for each doubling of the
lag, its nearest, instead of all, and n words cost n log n comparisons even where one word is repeated throughout.
Contexts are compared by 64-bit hashes, and the words of every run once more by themselves.

Null and empty texts, and texts of white space, have no words and no runs. Rows are handled one by one: ties, repeated
rows and null or repeated ids change nothing. A very long text is one task's work, in memory of some 200 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import let
from tessera.llm.staging import tables
from tessera.llm.textbytes import PRIME, mix, slices

LEAST, EXPONENT = 24, 3
#: The words of the shortest context; a run of LEAST words or more with three periods has as many matches.
CONTEXT = 16
_WORDS = r"[^\x20\x09-\x0D]+"


def occurrences(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The occurrences that the DP visits: for words, ascending, the lag of the earlier one and the length of the context.

    ids: a number for each distinct word, of several documents one after the other; bounds: where these start and end.
    """
    n, most = len(ids), int(np.diff(bounds).max(initial=0))
    empty = np.zeros(0, np.int64)
    if most < LEAST:
        return empty, empty, empty
    document = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    depth = np.arange(1, n + 1) - bounds[document]
    keys, g = mix(ids.astype(np.uint64) + (document.astype(np.uint64) << np.uint64(32)), 0x5851F42D4C957F2D), 1
    while g < CONTEXT:  # keys of contexts that end at each word
        keys[g:] = mix(keys[:-g] * PRIME + keys[g:])
        g *= 2
    at = np.flatnonzero(depth >= g)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(at):
        own = keys[at]
        order = np.argsort(own, kind="stable")
        same = own[order[1:]] == own[order[:-1]]
        lag = np.zeros(len(at), np.int64)
        lag[order[1:]] = np.where(same, at[order[1:]] - at[order[:-1]], 0)
        near = (lag > (g // 2 if g > CONTEXT else 0)) & (lag <= g)
        found.append((at[near], lag[near], np.full(int(near.sum()), g)))
        if EXPONENT * (g + 1) > most:
            break
        again = np.zeros(n, bool)  # only contexts that occur again have longer ones that do
        again[at[order[1:]][same]] = again[at[order[:-1]][same]] = True
        at = np.flatnonzero(again & (depth >= 2 * g))
        at = at[again[at - g]]
        longer = mix(keys[at - g] * PRIME + keys[at])
        keys[at] = longer
        g *= 2
    word, lag, context = (np.concatenate(x) for x in zip(*found)) if found else (empty, empty, empty)
    order = np.argsort(word, kind="stable")
    return word[order], lag[order], context[order]


def online(visits: Iterable[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """(first word, length, period) of each run of the visited occurrences (word, lag, context), as soon as its diagonal ends."""
    active: dict[int, tuple[int, int]] = {}  # lag: the last word and the match length

    def ended(lag: int) -> Iterator[tuple[int, int, int]]:
        last, matched = active.pop(lag)
        length = matched + lag
        if length >= max(LEAST, EXPONENT * lag):
            yield last - length + 1, length, lag

    word = -1
    for i, lag, context in visits:
        if i != word:
            for q in [q for q, (last, _) in active.items() if last < i - 1]:
                yield from ended(q)
            word = i
        active[lag] = (i, active[lag][1] + 1 if lag in active else context)
    for q in [*active]:
        yield from ended(q)


def runs(ids: np.ndarray, bounds: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """For each document its runs (start, length, period) by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in bounds[1:]]
    for start, length, period in online(zip(*(x.tolist() for x in occurrences(ids, bounds)))):
        if np.array_equal(ids[start : start + length - period], ids[start + period : start + length]):
            i = int(np.searchsorted(bounds, start, "right")) - 1
            out[i].append((start - int(bounds[i]), length, period))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces, without those that a run has after its first period."""
    if not found:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in found:
        keep[start + period : start + length] = False
    return b" ".join(w for w, k in zip(words, keep.tolist()) if k)


def with_runs(df: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Add runs, an array of structs (start, length, period) by start and period, and collapsed, the text less the repeats of its runs.

    Columns called runs or collapsed are replaced, others stay; without keep_text the text goes.
    """
    made = ("runs", "collapsed")
    fields = [f for f in df.schema.fields if f.name.lower() not in made and (keep_text or f.name != text)]
    df = df.select(*[f"`{f.name}`" for f in fields], *([] if keep_text else [f"`{text}`"]))
    names = [f.name for f in fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    schema = schema.removeprefix(", ")

    def of(part: pa.RecordBatch) -> pa.RecordBatch:
        each = [(t or "").encode().split() for t in part.column(text).to_pylist()]  # splits at [\x20\x09-\x0D]
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for ws in each for w in ws), np.int64)
        bounds = np.concatenate([[0], np.cumsum([len(ws) for ws in each])]).astype(np.int64)
        found = runs(ids, bounds)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
        flat = np.array([r for x in found for r in x], np.int64).reshape(-1, 3)
        items = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
        kept = pa.array([collapsed(ws, x).decode() for ws, x in zip(each, found)], pa.string())
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.ListArray.from_arrays(pa.array(offsets), items), kept], [*names, *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield of(part)

    return df.mapInArrow(run, schema)


def strongest(found: Column) -> Column:
    """The run of the greatest length / period, compared exactly; ties by start, then period. Null without runs."""
    def order(a: Column, b: Column) -> Column:
        left, right = a["length"].cast("decimal(19,0)") * b["period"], b["length"].cast("decimal(19,0)") * a["period"]
        by = F.when(left > right, -1).when(left < right, 1)
        for name in ("start", "period"):
            by = by.when(a[name] < b[name], -1).when(a[name] > b[name], 1)
        return by.otherwise(0)

    return F.get(F.array_sort(found, order), F.lit(0))


def repeated_tail(doc_id: Column, text: Column) -> Column:
    """The text, or for one id in ten (crc32 of the decimal id divisible by 10) its words with a tail made periodic.

    With g = crc32 // 10 and n words, each word i from a = g % n on is word a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8).
    A null id leaves the text as it is.
    """
    h = F.crc32(doc_id.cast("string"))
    parts = F.struct(F.regexp_extract_all(text, F.lit(_WORDS), F.lit(0)).alias("w"), F.floor(h / 10).alias("g"))

    def tail(x: Column) -> Column:
        n = F.size(x["w"]).cast("long")
        spans = F.struct(x["w"].alias("w"), (x["g"] % n).alias("a"), (1 + F.floor((n - x["g"] % n) / (3 + x["g"] % 8))).alias("p"))
        source = lambda y, i: F.when(i < y["a"], i).otherwise(y["a"] + (i - y["a"]) % y["p"])
        return let(spans, lambda y: F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(y["w"], source(y, i).cast("int"))), " "))

    return F.when((h % 10 == 0) & text.rlike(_WORDS), let(parts, tail)).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document, one in ten with a tail made periodic; digests of all runs and of the text without the repeats."""
    docs = tables(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = with_runs(docs.select("doc_id", repeated_tail(F.col("doc_id"), F.col("text")).alias("text")), keep_text=False)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = found.withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
ORACLE_SQL: dict[str, str] = {}
