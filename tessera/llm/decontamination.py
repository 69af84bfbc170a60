"""Operator 4: benchmark decontamination by greedy string tiling.

Texts are lower-cased; tokens are runs of characters other than white space and punctuation, compared by 64-bit
hashes; in scripts without spaces every character is a token. SEED consecutive tokens that a document shares with a test item make them a pair (an equi-join of hashed
seeds). In each pair the longest common runs of tokens that overlap no tile yet are marked, again and again, down to
MIN_MATCH tokens (running Karp-Rabin). A document is contaminated by an item if its tiles cover COVERAGE of the
item's tokens, in whatever order they stand.

A bitmap of fixed size of the items' seeds lets documents without any be passed over where they are; the join itself
is exact. An item of fewer than SEED tokens is one seed of its own length, which a document has whole or not at all; so
an item of one common word contaminates every text with it.
Null and empty texts have no tokens and match nothing. Every row of the benchmark is an item of its own, whatever its id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.staging import materialise, shielded, stable, tables, tidy
from tessera.llm.textbytes import SPACE, mix, powers, slices, span_hashes, utf8

SEED, MIN_MATCH, COVERAGE = 5, 5, 0.6
BITMAP_BITS = 22
GAP = SPACE.copy()
GAP[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
# Code points (first, last) of white space and punctuation beyond ASCII, and of scripts without spaces.
GAPS = [(0x80, 0xA9), (0xAB, 0xB1), (0xB4, 0xB4), (0xB6, 0xB8), (0xBB, 0xBB), (0xBF, 0xBF), (0xD7, 0xD7), (0xF7, 0xF7), (0x1680, 0x1680), (0x2000, 0x200B), (0x200E, 0x206F), (0x3000, 0x3004), (0x3008, 0x3020), (0x3030, 0x3030), (0x303D, 0x303F), (0x30FB, 0x30FB), (0xFE10, 0xFE1F), (0xFE30, 0xFE6F), (0xFEFF, 0xFEFF), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65)]
UNSPACED = [(0x0E01, 0x0EFF), (0x0F40, 0x0FBC), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x302F), (0x3031, 0x303C), (0x3041, 0x30FA), (0x30FC, 0x30FF), (0x3105, 0x312F), (0x31A0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF)]


def between(points: np.ndarray, ranges: list[tuple[int, int]]) -> np.ndarray:
    """Which code points lie in any of the ascending ranges."""
    first, last = np.array(ranges).T
    at = np.searchsorted(first, points, "right") - 1
    return (at >= 0) & (points <= last[at])


def kinds_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of UTF-8 whether it lies in a gap, and whether it begins a character that is a token by itself."""
    gap, alone = GAP[data], np.zeros(len(data), bool)
    at = np.flatnonzero(data >= 0xC0)
    lead = data[at].astype(np.int64)
    width = 2 + (lead >= 0xE0) + (lead >= 0xF0)
    points = lead & (0x7F >> width)
    for k in (1, 2, 3):
        more = width > k
        points[more] = points[more] << 6 | data[at[more] + k] & 0x3F
    apart = between(points, GAPS)
    for k in range(4):
        gap[at[apart & (width > k)] + k] = True
    alone[at[between(points, UNSPACED)]] = True
    return gap, alone


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The token hashes of all texts and the bounds between texts."""
    data, offsets = utf8(pc.utf8_lower(pc.fill_null(texts, "")))
    n = len(data)
    gaps, alone = kinds_of(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    edge[:n] |= alone
    after = np.flatnonzero(alone)  # a token ends behind such a character
    edge[after + np.where(data[after] >= 0xF0, 4, np.where(data[after] >= 0xE0, 3, 2))] = True
    gap = np.ones(n + 2, bool)
    gap[1 : n + 1] = gaps
    starts = np.flatnonzero(~gap[1 : n + 1] & (gap[:n] | edge[:n]))
    ends = np.flatnonzero(~gap[1 : n + 1] & (gap[2 : n + 2] | edge[1 : n + 1])) + 1
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def run_hashes(tokens: np.ndarray, n: int) -> np.ndarray:
    """The hash of every run of n tokens, each from its neighbour's in constant time."""
    m = len(tokens)
    if m < n:
        return np.zeros(0, np.uint64)
    up, down = powers(m + 1)
    total = np.zeros(m + 1, np.uint64)
    np.cumsum(tokens * up[:m], out=total[1:])
    return mix((total[n:] - total[:-n]) * down[: m - n + 1])


def greedy_tiles(item: np.ndarray, text: np.ndarray, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in text, tokens): longest first, then by their places, none overlapping another in either."""
    free_item, free_text = np.ones(len(item), bool), np.ones(len(text), bool)
    tiles: list[tuple[int, int, int]] = []
    size = longest_match(item, text, free_item, free_text, least, len(item))
    while size >= least:
        starts, places = matches(item, text, free_item, free_text, size)
        n = len(tiles)
        for i, hash_ in starts:
            if not free_item[i : i + size].all():
                continue
            later = places[hash_]  # ascending from the end; a place that isn't free any more is never tried again
            skipped = []
            while later:
                j = later.pop()
                if not free_text[j : j + size].all():
                    continue
                if (item[i : i + size] != text[j : j + size]).any():  # equal hashes of unlike runs
                    skipped.append(j)
                    continue
                free_item[i : i + size] = False
                free_text[j : j + size] = False
                tiles.append((i, j, size))
                break
            later.extend(reversed(skipped))
        size = longest_match(item, text, free_item, free_text, least, size if len(tiles) > n else size - 1)
    return tiles


def open_runs(tokens: np.ndarray, free: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the runs of n tokens without a marked one."""
    marked = np.append(0, np.cumsum(~free))
    at = np.flatnonzero(marked[n:] == marked[: len(tokens) - n + 1]) if len(tokens) >= n else np.zeros(0, np.int64)
    return at, run_hashes(tokens, n)[at]


def matches(item: np.ndarray, text: np.ndarray, free_item: np.ndarray, free_text: np.ndarray, n: int) -> tuple[list[tuple[int, int]], dict[int, list[int]]]:
    """(start, hash) of the unmarked runs of n tokens of item that text has unmarked, and the places of each hash in text, last first."""
    (i, a), (j, b) = open_runs(item, free_item, n), open_runs(text, free_text, n)
    keep = np.isin(b, a)
    places: dict[int, list[int]] = {}
    for at, hash_ in zip(j[keep][::-1].tolist(), b[keep][::-1].tolist()):
        places.setdefault(hash_, []).append(at)
    return [(at, hash_) for at, hash_ in zip(i.tolist(), a.tolist()) if hash_ in places], places


def longest_match(item: np.ndarray, text: np.ndarray, free_item: np.ndarray, free_text: np.ndarray, least: int, most: int) -> int:
    """The length of the longest unmarked common run, by bisection; less than `least` if there is none."""
    low, high = least - 1, most
    while low < high:
        mid = (low + high + 1) // 2
        if np.isin(open_runs(item, free_item, mid)[1], open_runs(text, free_text, mid)[1]).any():
            low = mid
        else:
            high = mid - 1
    return low


def seeded(df: DataFrame, key: str, bitmap: np.ndarray | None = None, lengths: list[int] | None = None) -> DataFrame:
    """key, tokens, distinct seeds and how often each stands in the text; with a bitmap only texts, and seeds, that it has.

    lengths: the tokens of a seed, one or several; None: SEED or, in a shorter text, all of its tokens.
    """
    shared = df.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, bounds = token_hashes(part.column("text"))
                rows, tokens, seeds, times = [], [], [], []
                for r, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                    sizes = lengths or ([min(SEED, b - a)] if b > a else [])
                    own = np.concatenate([run_hashes(hashes[a:b], n) for n in sizes]) if sizes else np.zeros(0, np.uint64)
                    if bits is not None:
                        own = own[bits[own >> np.uint64(64 - BITMAP_BITS)]]
                        if not len(own):
                            continue
                    rows.append(r)
                    tokens.append(hashes[a:b].view(np.int64))
                    distinct, n = np.unique(own, return_counts=True)
                    seeds.append(distinct.view(np.int64))
                    times.append(n.astype(np.int64))
                if rows:
                    lists = lambda x: pa.ListArray.from_arrays(np.append(0, np.cumsum([len(y) for y in x])).astype(np.int32), np.concatenate(x))
                    yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(rows)), lists(tokens), lists(seeds), lists(times)], [key, "tokens", "seeds", "times"])

    return df.select(key, "text").mapInArrow(tidy(run), f"`{key}` {df.schema[key].dataType.simpleString()}, tokens array<long>, seeds array<long>, times array<long>")


def seed_bitmap(items: DataFrame) -> np.ndarray:
    """Which of 2 ** BITMAP_BITS hash prefixes the items' seeds have; of fixed size whatever the items."""
    prefix = F.shiftrightunsigned("seed", 64 - BITMAP_BITS)
    bitmap = np.zeros(1 << BITMAP_BITS, bool)
    for r in items.select(F.explode("seeds").alias("seed")).select(prefix.alias("p")).distinct().toLocalIterator():
        bitmap[r["p"]] = True
    return bitmap


def rarer_seeds(items: DataFrame, spread: DataFrame, coverage: float) -> DataFrame:
    """(_item, seed): each item's seeds less the most frequent of the documents', as far as they can be spared.

    Tiles of SEED tokens or more that cover `coverage` of an item's n tokens hold a fifth of those or more as starts
    of seeds. A document that shares so many starts (`need`) still shares one if all seeds of the need - 1 starts that
    are most frequent are left out. So a phrase that very many documents and items have brings no pairs by itself.
    """
    need = F.ceil(F.size("tokens") * F.lit(coverage) / SEED - 1e-9)
    starts = items.select("_item", need.alias("need"), F.explode(F.arrays_zip("seeds", "times")).alias("x")).select("_item", "need", F.col("x.seeds").alias("seed"), F.col("x.times").alias("times"))
    often = spread.join(starts.select("seed").distinct(), "seed").groupBy("seed").agg(F.count("*").alias("docs"))
    order = Window.partitionBy("_item").orderBy(F.desc("docs"), "seed").rowsBetween(Window.unboundedPreceding, 0)
    ranked = starts.join(often, "seed").withColumn("sofar", F.sum("times").over(order))
    return ranked.where(F.col("sofar") >= F.col("need")).select("_item", "seed")


def contaminations(docs: DataFrame, items: DataFrame, key: str = "uid", item_key: str = "item_id", coverage: float = COVERAGE) -> DataFrame:
    """key, item_key, item_tokens, matched_tokens, n_tiles and coverage of each contaminated pair.

    docs: (key, text) with distinct keys; items: (item_key, text), whose keys may be null or repeated: every distinct
    row is an item, and gives a row of its own.
    """
    named = materialise(items.select(item_key, "text").distinct().withColumn("_item", F.monotonically_increasing_id()), "named")
    items = materialise(seeded(named, "_item"), "items")
    short = [r[0] for r in items.select(F.size("tokens")).where((F.size("tokens") > 0) & (F.size("tokens") < SEED)).distinct().collect()]  # under SEED rows
    found = materialise(seeded(docs, key, seed_bitmap(items), [*short, SEED]).drop("times"), "candidates")
    spread = found.select(key, F.explode("seeds").alias("seed"))
    pairs = spread.join(rarer_seeds(items, spread, coverage), "seed").select(key, "_item").distinct()
    both = pairs.join(items.select("_item", F.col("tokens").alias("item")), "_item").join(found.select(key, "tokens"), key).join(named.select("_item", item_key), "_item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            items, texts = batch.column("item"), batch.column("tokens")
            for r in range(batch.num_rows):
                item, text = (x[r].values.to_numpy(zero_copy_only=False).view(np.uint64) for x in (items, texts))
                tiles = greedy_tiles(item, text, min(MIN_MATCH, len(item)))
                rows.append((len(item), sum(t[2] for t in tiles), len(tiles)))
            if rows:
                n, matched, tiles = (np.array(x, np.int64) for x in zip(*rows))
                yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(item_key), *map(pa.array, (n, matched, tiles, matched / n))], [key, item_key, "item_tokens", "matched_tokens", "n_tiles", "coverage"])

    kinds = ", ".join(f"`{c}` {both.schema[c].dataType.simpleString()}" for c in (key, item_key))
    return both.select(key, item_key, "item", "tokens").mapInArrow(tidy(run), f"{kinds}, item_tokens long, matched_tokens long, n_tiles long, coverage double").where(F.col("coverage") >= coverage)


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs less the rows that any item contaminates. Columns may have any names; rows that repeat stay or go together."""
    docs, named = shielded(stable(docs))
    keyed = docs.withColumn("uid", F.monotonically_increasing_id())
    bad = materialise(contaminations(keyed.select("uid", "text"), items).select("uid").distinct(), "contaminated")
    return named(keyed.join(bad, "uid", "left_anti"))


def op4_tiling_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it contains; a document that repeats gives its rows as often."""
    docs = tables(spark, sf_dir, "documents").select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
    pairs = contaminations(docs.select(F.struct("uid", "doc_id").alias("uid"), "text"), tables(spark, sf_dir, "benchmark"))
    return pairs.select("uid.doc_id", "item_id", "item_tokens", "matched_tokens", "n_tiles", "coverage")


QUERIES = {"op4_tiling_decontamination": op4_tiling_decontamination}
ORACLE_SQL: dict[str, str] = {}
