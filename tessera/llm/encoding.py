"""Operator 7: SentencePiece encoding and decoding as a relational lattice.

Texts are cut into words (a run of marks, i.e. spaces, and what follows; line feeds stand alone), and words into units
between characters that stand side by side in no piece: no edge of the lattice spans such a cut, so the ids of a text
are those of its units in a row. The substrings of a unit up to the longest piece are exploded and equi-joined to the
piece table; the edges that match are grouped by unit and folded with aggregate():

* unigram model: Viterbi, the best score to every position by the edges that end there, earliest start on ties;
* merge (BPE) model: its scores rank merges and are no log-probabilities, so the path of best total score is not the
  model's segmentation. The fold then merges, over the same edges, the adjacent pair of best rank (leftmost on ties)
  until no pair is an edge. Its state is one number: bit i is set where a symbol starts.

Characters without a piece become byte pieces (or the unknown piece). Both folds give the library's ids.

The units most frequent in the corpus (CACHE_UNITS and CACHE_BYTES at most, so their ids are broadcast) are folded
once. Texts are encoded with them where they are read, some SLICE bytes at a time; the units of a slice that aren't
among them are folded in the stream of its partition and put in their places, so texts are never exchanged. Units longer than LONG characters, the bits of
a state, are segmented by the same rules in plain loops whose time is near linear in their length.

A null or empty text has no ids. decode() restores the text exactly, except that a literal mark U+2581 reads as a
space. Rows may repeat and keep their ids. Columns of the input with the name of an output column are replaced.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from contextlib import nullcontext

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.pieces import MARK, MODEL, Pieces, load_pieces
from tessera.llm.staging import bounded_memory, count_floor, lent, materialise, tables, tidy
from tessera.llm.textbytes import slices, span_hashes, strings, utf8

CACHE_UNITS, CACHE_BYTES = 1 << 20, 32 << 20
#: A unit seen less often isn't worth a place among them.
SEEN = 3
SLICE, COUNT_SLICE = 1 << 20, 4 << 20
#: Edges that are gathered at a time.
GATHERED = 1 << 16
LONG = 62
UNIT = "unit"
def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, in order and with a space before each text, and the bounds of each text's words.

    A word is a run of spaces and what follows; line feeds stand alone. A literal mark is a space.
    """
    texts = pc.replace_substring(pc.fill_null(texts, ""), MARK, " ")
    data, offsets = utf8(pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, "")))
    space, feed = data == 0x20, data == 0x0A
    start = feed.copy()
    start[1:] |= (space[1:] & ~space[:-1]) | feed[:-1]
    at = np.union1d(np.flatnonzero(start), offsets)
    return strings(at, data), np.searchsorted(at, offsets)


def distinct(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct values, and for each value the place of its like."""
    found = values.dictionary_encode()
    return found.dictionary, found.indices.to_numpy().astype(np.int64)


def lattice(units: DataFrame, pieces: Pieces) -> DataFrame:
    """units (uid, pos, unit and any others, a (uid, pos) once) with the edges of each unit by start and length.

    Edges are parallel arrays: their ids (-1: a character without a piece), and

    * for Viterbi their starts (from 1), sizes and scores;
    * for merges, as bits, the positions that they span and those at their two ends; and pairs, what edges of two
      characters or more span inside, by falling score and rising start; regular, whether all edges are regular pieces;
      whole, whether all have a piece.

    The empty unit has no edges. The exploded substrings of a unit follow one another, and a hash join keeps the order
    of its streamed side; runs of one (uid, pos) are then gathered as they stream by, without an exchange or a sort. A
    unit whose positions don't come in order is an error.
    """
    names = units.columns
    n = F.length("unit")
    spans = units.withColumn("s", F.explode(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array(F.lit(1)))))
    spans = spans.withColumn("l", F.explode(F.when(n > 0, F.sequence(F.lit(1), F.least(F.lit(pieces.longest), n - F.col("s") + 1))).otherwise(F.array(F.lit(0)))))
    spans = spans.withColumn("piece", F.expr("substring(unit, s, l)"))
    edges = spans.join(F.broadcast(pieces.table(units.sparkSession)), "piece", "left").where(F.col("id").isNotNull() | (F.col("l") <= 1))
    score = [] if pieces.merges else [F.coalesce("score", F.lit(pieces.unknown_score)).alias("score")]
    edges = edges.select(*names, (F.col("s") * 64 + F.col("l")).alias("place"), F.coalesce("id", F.lit(-1)).alias("id"), *score)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in units.schema.fields]
    columns = ["ids array<int>", *(("spans array<long>", "ends array<long>", "pairs array<long>", "regular boolean", "whole boolean") if pieces.merges else ("starts array<int>", "sizes array<int>", "scores array<double>"))]
    one, merges = np.int64(1), pieces.merges
    odd, ranks = (np.array(sorted(pieces.irregular), np.int32), np.unique(-np.array(pieces.scores), return_inverse=True)[1]) if merges else (None, None)

    def gathered(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        uid, pos, place, ids = (rows.column(c).to_numpy() for c in ("uid", "pos", "place", "id"))
        head = np.flatnonzero(np.append(True, (np.diff(uid) != 0) | (np.diff(pos) != 0)))
        first = rows.select(names).take(pa.array(head))
        group = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(uid))))
        start, size = place >> 6, (place & 63).astype(np.int64)
        if (np.diff(group * 4096 + place) <= 0).any() or not np.array_equal(np.add.reduceat(size == 1, head, dtype=np.int64), pc.utf8_length(first.column("unit")).to_numpy()):
            raise RuntimeError("the edges of a unit didn't arrive together and in order")
        real = size > 0
        group, start, size, ids = (x[real] for x in (group, start, size, ids))
        if merges:
            low, high = one << (start - 1), one << (start - 1 + size)
            longer = np.flatnonzero(size > 1)
            longer = longer[np.argsort(group[longer] * len(ranks) + ranks[ids[longer]], kind="stable")]
            arrays = [(ids, group), (2 * high - low, group), (low | high, group), ((high - 2 * low)[longer], group[longer])]
        else:
            arrays = [(x, group) for x in (ids, start, size.astype(np.int32), rows.column("score").to_numpy()[real])]
        for column, (values, own) in zip(columns, arrays):
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(len(head) + 1)).astype(np.int32)), pa.array(values))
            first = first.append_column(column.split()[0], lists)
        if merges:
            for column, own in ("regular", group[np.isin(ids, odd)]), ("whole", group[ids < 0]):
                flags = np.ones(len(head), bool)
                flags[own] = False
                first = first.append_column(column, pa.array(flags))
        yield from first.to_batches(max_chunksize=2048)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def ended(last: bool) -> Iterator[pa.RecordBatch]:
            """The units of held that can't go on in the next batch."""
            rows = pa.concat_tables(held)
            uid, pos = (rows.column(c).to_numpy() for c in ("uid", "pos"))
            on = len(uid) if last else int(np.flatnonzero(np.append(True, (np.diff(uid) != 0) | (np.diff(pos) != 0)))[-1])
            held[:] = [rows.slice(on)] if on < len(uid) else []
            if on:
                yield from gathered(rows.slice(0, on))

        for batch in batches:
            if batch.num_rows:
                held.append(pa.Table.from_batches([batch]))
                if sum(x.num_rows for x in held) >= GATHERED or sum(x.nbytes for x in held) >= SLICE:
                    yield from ended(False)
        if held:
            yield from ended(True)

    return edges.mapInArrow(tidy(run), ", ".join([*kinds, *columns]))


def fallback_ids(char: Column, pieces: Pieces) -> Column:
    if pieces.byte_base < 0:
        return F.array(F.lit(pieces.unknown))
    digits = F.hex(F.encode(char, "UTF-8"))
    return F.transform(F.sequence(F.lit(1), F.length(digits), F.lit(2)), lambda k: F.conv(F.substring(digits, k, F.lit(2)), 16, 10).cast("int") + F.lit(pieces.byte_base))


def spelt(unit: Column, ids: Column, starts: Column, pieces: Pieces) -> Column:
    """ids with those of its character in the place of each -1."""
    own = F.transform(ids, lambda i, k: F.when(i >= 0, F.array(i)).otherwise(fallback_ids(F.substring(unit, F.get(starts, k), F.lit(1)), pieces)))
    return F.when(F.exists(ids, lambda i: i < 0), F.flatten(own)).otherwise(ids)


def merge_fold(unit: Column, pieces: Pieces) -> Column:
    """The ids of unit by merges. State: the bits of the positions where symbols start, and of the end."""
    edge_ids, spans, ends, pairs = (F.col(c) for c in ("ids", "spans", "ends", "pairs"))

    def step(state: Column, _: Column) -> Column:
        def merges(inner: Column) -> Column:
            both = F.shiftleft(inner, 1).bitwiseOR(F.shiftright(inner, 1)).bitwiseAND(F.bitwise_not(inner))
            return (F.bit_count(state.bitwiseAND(inner)) == 1) & (state.bitwiseAND(both) == both)

        return F.coalesce(state.bitwiseAND(F.bitwise_not(F.get(F.filter(pairs, merges), 0))), state)

    def pair(state: Column, inner: Column) -> Column:
        span = F.shiftleft(inner, 1).bitwiseOR(F.shiftright(inner, 1))
        rest = state.bitwiseAND(F.bitwise_not(inner))
        return F.when((F.bit_count(state.bitwiseAND(inner)) == 1) & (rest.bitwiseAND(span.bitwiseOR(inner)) == span.bitwiseAND(F.bitwise_not(inner))), rest).otherwise(state)

    def ids(state: Column) -> Column:
        symbol = lambda k: state.bitwiseAND(F.get(spans, k)) == F.get(ends, k)
        starts = lambda: F.transform(F.filter(ends, lambda e, k: symbol(k)), lambda e: F.bit_count(e.bitwiseAND(F.negate(e)) - 1).cast("int") + 1)
        found = F.filter(edge_ids, lambda i, k: symbol(k))
        return F.when(F.col("whole"), found).otherwise(spelt(unit, found, starts(), pieces))

    steps = F.least(F.length(unit) - 1, F.size(pairs))
    start = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), F.lit(63) - F.length(unit))
    none = F.array().cast("array<int>")
    general = F.aggregate(F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(none), start, step, ids)
    return F.when(F.length(unit) == 0, none).when(F.col("regular"), F.aggregate(pairs, start, pair, ids)).otherwise(general)


def viterbi_fold(unit: Column, pieces: Pieces) -> Column:
    """The ids of unit by the best total score. State: for each position the best score, and the edge that leads to it."""
    edges = F.arrays_zip("starts", "sizes", "ids", "scores")

    def step(state: Column, j: Column) -> Column:
        score = lambda e: F.element_at(state["best"], e["starts"]) + e["scores"]
        ahead = F.transform(F.filter(edges, lambda e: e["starts"] + e["sizes"] - 1 == j), lambda e: F.struct(score(e).alias("score"), (-e["starts"]).alias("order"), e.alias("edge")))
        grown = F.transform(F.array(F.array_max(ahead)), lambda b: F.struct(F.concat(state["best"], F.array(b["score"])).alias("best"), F.concat(state["edge"], F.array(b["edge"])).alias("edge")))
        return F.get(grown, 0)

    def path(state: Column) -> Column:
        def back(done: Column, j: Column) -> Column:
            here = F.size(state["edge"]) - j + 1
            last = F.element_at(state["edge"], here)
            return F.when(done["at"] == here, F.struct((here - last["sizes"]).alias("at"), F.concat(F.array(last), done["edges"]).alias("edges"))).otherwise(done)

        first = F.struct(F.size(state["edge"]).alias("at"), F.filter(edges, lambda e: F.lit(False)).alias("edges"))
        return F.aggregate(F.sequence(F.lit(1), F.size(state["edge"])), first, back, lambda d: spelt(unit, F.transform(d["edges"], lambda e: e["ids"]), F.transform(d["edges"], lambda e: e["starts"]), pieces))

    n = F.length(unit)
    start = F.struct(F.array(F.lit(0.0)).alias("best"), F.filter(edges, lambda e: F.lit(False)).alias("edge"))
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), start, step, path)).otherwise(F.array().cast("array<int>"))


def folded(units: DataFrame, pieces: Pieces) -> DataFrame:
    """units (uid, pos, unit of at most LONG characters, and any others) with the ids of each unit, in the same order."""
    fold = merge_fold if pieces.merges else viterbi_fold
    return lattice(units, pieces).select(*units.columns, fold(F.col(UNIT), pieces).alias("ids"))


def long_unit(word: str, pieces: Pieces) -> list[int]:
    """The ids of one very long unit."""
    ids = pieces.ids
    n = len(word)
    if pieces.merges:
        after, before, end = list(range(1, n + 1)), list(range(-1, n)), list(range(1, n + 1))
        gone = [False] * n
        heap: list[tuple[float, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) < n and (k := ids.get(word[i : end[j]])) is not None:
                heapq.heappush(heap, (-pieces.scores[k], i, j, end[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, j, e = heapq.heappop(heap)
            if gone[i] or gone[j] or after[i] != j or end[j] != e:
                continue
            gone[j], end[i], after[i] = True, e, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        out = [(i, end[i]) for i in range(n) if not gone[i]]
    else:
        best, back = [0.0] + [float("-inf")] * n, [0] * (n + 1)
        for i in range(n):
            for j in range(i + 1, min(n, i + pieces.longest) + 1):
                k = ids.get(word[i:j])
                score = pieces.scores[k] if k is not None else pieces.unknown_score if j == i + 1 else None
                if score is not None and best[i] + score > best[j]:
                    best[j], back[j] = best[i] + score, i
        out, j = [], n
        while j:
            out.append((back[j], j))
            j = back[j]
        out.reverse()
    return [x for a, b in out for x in ([ids[word[a:b]]] if word[a:b] in ids else [y for c in word[a:b] for y in pieces.fallback(c)])]


def unit_counts(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """unit, n of every distinct unit of at most LONG characters."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lent(shared) as own:
            for batch in batches:
                for part in slices(batch, "text", COUNT_SLICE):
                    words, at = distinct(words_of(part.column(0))[0])
                    units, bounds = own.units(marked(words))
                    units, place = distinct(units)
                    n = np.bincount(place, np.repeat(np.bincount(at, minlength=len(words)), np.diff(bounds)), len(units)).astype(np.int64)
                    rows = pa.RecordBatch.from_arrays([units, pa.array(n)], [UNIT, "n"])
                    yield rows.filter(pc.less_equal(pc.utf8_length(units), LONG))
                    pa.default_memory_pool().release_unused()

    return docs.select("text").mapInArrow(run, f"{UNIT} string, n long").groupBy(UNIT).agg(F.sum("n").alias("n"))


def marked(words: pa.Array) -> pa.Array:
    return pc.replace_substring(words, " ", MARK)


def keys_of(units: pa.Array) -> np.ndarray:
    data, offsets = utf8(units)
    return span_hashes(data, offsets[:-1], offsets[1:])


def cached_units(docs: DataFrame, pieces: Pieces, most: int, most_bytes: int) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Hash (ascending), unit and ids of the units of the highest counts; the choice has no bearing on results."""
    counts = materialise(unit_counts(docs, pieces), "units")
    top = counts.where(F.col("n") >= max(SEEN, count_floor(counts, "n", most, F.octet_length(UNIT), most_bytes)))
    dealt = top.select(UNIT).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = folded(dealt.select(F.monotonically_increasing_id().alias("uid"), F.lit(0).alias("pos"), UNIT), pieces).select(UNIT, "ids")
    found = materialise(rows, "unit-ids").toArrow()  # at most `most` rows
    units, ids = (pa.concat_arrays([pa.array([], k), *(x.cast(k) for x in found.column(c).chunks)]) for c, k in ((UNIT, pa.string()), ("ids", pa.list_(pa.int32()))))
    keys = keys_of(units)
    order = np.argsort(keys)
    return keys[order], units.take(pa.array(order)), ids.take(pa.array(order))


def found_in(cache: tuple[np.ndarray, pa.Array, pa.Array], units: pa.Array) -> np.ndarray:
    """The place of each unit in the cache, or -1; places come from hashes, the strings decide."""
    keys, known, _ = cache
    if not len(keys) or not len(units):
        return np.full(len(units), -1)
    at = np.minimum(np.searchsorted(keys, keys_of(units)), len(keys) - 1)
    return np.where(pc.equal(known.take(pa.array(at)), units).to_numpy(zero_copy_only=False), at, -1)


def picked(lists: pa.Array, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the lists at `at` in a row, and the n + 1 offsets between them."""
    found = lists.take(pa.array(at))
    return found.flatten().to_numpy(), np.append(0, np.cumsum(pc.list_value_length(found).to_numpy(zero_copy_only=False))).astype(np.int64)


def list_array(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, pa.int32()))


def filled(values: np.ndarray, offsets: np.ndarray, rare: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """values with the list number k of rare in the place of -1 - k, and the offsets moved with them."""
    holes = np.flatnonzero(values < 0)
    if not len(holes):
        return values, offsets
    found, bounds = picked(rare, -1 - values[holes].astype(np.int64))
    sizes = np.ones(len(values), np.int64)
    sizes[holes] = np.diff(bounds)
    out = np.repeat(values, sizes)
    ends = np.append(0, np.cumsum(sizes))
    out[np.repeat(ends[holes] - bounds[:-1], np.diff(bounds)) + np.arange(len(found))] = found
    return out, ends[offsets]


def encoded(docs: DataFrame, path: str = MODEL, cache_units: int = CACHE_UNITS, keep: list[str] | None = None, digest: bool = False) -> DataFrame:
    """docs' columns (or those in keep) with n_tokens and ids, and with digest decoded_sha256, that of the decoded ids."""
    spark = docs.sparkSession
    bounded_memory(spark)
    pieces = load_pieces(path)
    made = ["n_tokens", "ids", *(["decoded_sha256"] if digest else [])]
    kept = [f for f in docs.schema.fields if (keep is None or f.name in keep) and f.name.lower() not in made]
    shared, common = spark.sparkContext.broadcast(cached_units(docs, pieces, cache_units, CACHE_BYTES)), spark.sparkContext.broadcast(pieces)
    stored = ["uid", "pos", UNIT, "doc", "own"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each slice a row for every rare unit, then one for every document with its ids, -1 - k in the place of rare unit k."""
        with lent(shared) as cache, lent(common) as own:
            uid = 0
            for batch in batches:
                for part in slices(batch, "text", SLICE):
                    words, text_bounds = words_of(part.column("text"))
                    words, word_at = distinct(words)
                    units, bounds = own.units(marked(words))
                    units, unit_at = distinct(units)
                    where = found_in(cache, units)
                    lost = np.flatnonzero(where < 0)
                    long = [i for i in lost.tolist() if len(units[i].as_py()) > LONG]
                    rare = np.setdiff1d(lost, long)
                    # ids of cached units, then of long ones, then the places of rare ones
                    more = [*(long_unit(units[i].as_py(), own) for i in long), *([-1 - k] for k in range(len(rare)))]
                    hits = np.flatnonzero(where >= 0)
                    lists = pa.concat_arrays([cache[2].take(pa.array(where[hits])), pa.array(more, pa.list_(pa.int32()))])
                    where[np.concatenate([hits, np.array(long, np.int64), rare])] = np.arange(len(units))
                    ids, ends = picked(lists, where[unit_at])
                    ids, ends = picked(list_array(ids, ends[bounds]), word_at)
                    ends = ends[text_bounds]
                    kind = np.dtype("<i2" if len(own.names) + len(rare) < 1 << 15 else "<i4")
                    blank = pa.nulls(len(rare), pa.struct([(f"_{i}", part.column(f.name).type) for i, f in enumerate(kept)] + [("_", pa.bool_())]))
                    doc = pa.StructArray.from_arrays([*(part.column(f.name) for f in kept), pa.array(np.full(part.num_rows, kind.itemsize > 2))], [f.name for f in blank.type])
                    raw = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(ends * kind.itemsize), pa.py_buffer(ids.astype(kind))])
                    columns = [
                        pa.array(np.full(len(rare) + part.num_rows, uid)),
                        pa.array(np.arange(len(rare) + part.num_rows, dtype=np.int32)),
                        pa.concat_arrays([units.take(pa.array(rare)), pa.array([""] * part.num_rows, pa.string())]),
                        pa.concat_arrays([blank, doc]),
                        pa.concat_arrays([pa.nulls(len(rare), pa.binary()), raw.cast(pa.binary())]),
                    ]
                    uid += 1
                    for x in slices(pa.RecordBatch.from_arrays(columns, stored), "own", SLICE):
                        for at in range(0, x.num_rows, 8192):
                            yield x.slice(at, 8192)
                    pa.default_memory_pool().release_unused()

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a slice follow one another, its rare units first."""
        with lent(common) if digest else nullcontext() as own:
            raw = pa.array(own.raw, pa.binary()) if digest else None
            uid, rare = -1, []
            for batch in batches:
                pa.default_memory_pool().release_unused()
                for at, end in runs(batch.column("uid").to_numpy()):
                    part = batch.slice(at, end - at)
                    if (now := part.column("uid")[0].as_py()) != uid:
                        uid, rare = now, []
                    is_doc = part.column("doc").is_valid()
                    if (units := part.column("ids").filter(pc.invert(is_doc))) and len(units):
                        rare.append(units.cast(pa.list_(pa.int32())))
                    rows = part.filter(is_doc)
                    if not rows.num_rows:
                        continue
                    data, offsets = utf8(rows.column("own"))
                    kind = np.dtype("<i4" if rows.column("doc").field(len(kept))[0].as_py() else "<i2")
                    values, ends = filled(np.frombuffer(data.tobytes(), kind), offsets // kind.itemsize, pa.concat_arrays(rare) if rare else pa.array([], pa.list_(pa.int32())))
                    columns = [*(rows.column("doc").field(i) for i in range(len(kept))), pa.array(np.diff(ends)), list_array(values, ends)]
                    if digest:
                        body, at_byte = utf8(raw.take(pa.array(values)))
                        body, at_byte = body.tobytes(), at_byte[ends].tolist()
                        columns.append(pa.array([hashlib.sha256(plain(body[a:b]).encode()).hexdigest() for a, b in zip(at_byte, at_byte[1:])], pa.string()))
                    yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in kept), *made])

    kinds = ", ".join([*(f"_{i}: {f.dataType.simpleString()}" for i, f in enumerate(kept)), "_: boolean"])
    rows = docs.select("text", *[F.col(f"`{f.name}`") for f in kept if f.name != "text"]).mapInArrow(spread, f"uid long, pos int, {UNIT} string, doc struct<{kinds}>, own binary")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
    return folded(rows, pieces).mapInArrow(assemble, ", ".join([*fields, "n_tokens long", "ids array<int>", *(["decoded_sha256 string"] if digest else [])]))


def runs(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and end of each run of equal values."""
    cut = np.flatnonzero(np.diff(x)) + 1
    return zip([0, *cut.tolist()], [*cut.tolist(), len(x)]) if len(x) else iter(())


def plain(raw: bytes) -> str:
    return raw.decode(errors="replace").replace(MARK, " ")[1:]


def decode_ids(ids: list[int], pieces: Pieces) -> str:
    raw = pieces.raw
    return plain(b"".join([raw[i] for i in ids]))


def decoded(df: DataFrame, path: str = MODEL, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """df with the text of its ids; a column called `name` is replaced."""
    pieces = load_pieces(path)
    fields = [f for f in df.schema.fields if f.name.lower() != name.lower()]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{name}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [decode_ids(x.values.to_pylist(), pieces) if x.is_valid else None for x in part.column(ids)]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in fields), pa.array(texts, pa.string())], [*(f.name for f in fields), name])

    return df.mapInArrow(run, schema)


def op7_sentencepiece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document, and the digest of the text that they decode to."""
    return encoded(tables(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"], digest=True)


QUERIES = {"op7_sentencepiece_lattice": op7_sentencepiece_lattice}
ORACLE_SQL: dict[str, str] = {}
