"""Operator 9: near-duplicate groups of 64-bit SimHash fingerprints, by the generalised pigeonhole principle.

The 64 bits are dealt into m parts so that correlated bits share a part, and part i gets a threshold T_i >= -1 with
sum(T_i) = radius - m + 1. Two fingerprints within the radius then differ in at most T_i bits of some part i (T_i = -1:
the part needn't be probed). A dynamic programme picks the thresholds, and m, that cost least by the expected numbers
of probe rows and candidates. Every fingerprint is stored once a part under its exact bits and probes each part under
all values within T_i bits; candidates that meet are verified on all 64 bits.

Copies are made one node first. Before probing, neighbours in the sorted order of each part's buckets are linked and
contracted, so that in a cloud of near copies the probes only return pairs that still lie in different components.
(The join of a bucket still meets all pairs of a cloud of k in it before it drops those of one component.)

The pipeline's near duplicates are pairs of an exact Jaccard similarity, checked in the groups of this linking, since
fingerprint bits can't decide near the threshold. Pairs of 0.8 that lie further apart than the radius (within 17 of 64
bits, which 99 % of them need, probing is near all pairs) are candidates by a band of minimum hashes of their shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.components import contract, rooted
from tessera.llm.staging import materialise, shielded, stable, tables, tidy
from tessera.llm.textbytes import LOWER, PRIME, SPACE, mix, slices, span_hashes, utf8, words

BITS, SHINGLE, RADIUS, SEED = 64, 4, 4, 42
#: Cost of a probe row (written, shuffled, sorted) in units of a candidate's verification.
ROW_COST = 40.0
#: The pipeline's near duplicates: least Jaccard similarity; minima in a band key, and band keys of a text.
SIMILAR, BAND, BANDS = 0.8, 5, 20
#: Nodes, one of its buckets' firsts in each of so many orders, that every node is compared with; places that a node's pairs are dealt to.
STARS, SALTS = 4, 64
#: Nodes outside a bucket's largest component that are paired with all of it; about how many nodes of a wider bucket say what is usual there.
WIDE, USUAL = 16, 64
_FACTORS = mix(np.arange(1, BAND * BANDS + 1, dtype=np.uint64), SEED) | np.uint64(1)
_OFFSETS = mix(np.arange(1, BAND * BANDS + 1, dtype=np.uint64), SEED + 1)


def shingle_spans(column: pa.Array, n: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All texts lower-cased (A-Z) with their words space-joined; start and end of each n-word shingle; bounds by text."""
    data, offsets = utf8(column)
    data = LOWER[data]
    starts, ends, bounds = words(data, offsets)
    lengths = ends - starts
    body = data[~SPACE[data]]
    joined = np.full(len(body) + len(starts), 0x20, np.uint8)
    joined[np.arange(len(body)) + np.repeat(np.arange(len(starts)), lengths)] = body
    to = np.cumsum(lengths + 1) - 1
    at = to - lengths
    last = np.repeat(bounds[1:], np.diff(bounds)) - 1
    index = np.arange(len(starts))
    first = np.repeat(bounds[:-1], np.diff(bounds))
    keep = (index + n - 1 <= last) | ((index == first) & (last - first + 1 < n))
    index = index[keep]
    return joined.tobytes(), at[index], to[np.minimum(index + n - 1, last[index])], np.searchsorted(index, bounds)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of a text's shingle hashes: bit 1 if set in over half of them; none: 0."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[at : at + (1 << 15)].byteswap().view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big") if len(hashes) else 0


def with_simhash(df: DataFrame, n: int = SHINGLE, text: str = "text", keep_text: bool = False, lanes: int = 1) -> DataFrame:
    """Add fp, the fingerprint as a signed long, and with more lanes fp1 .. from remixed hashes; the text is dropped unless keep_text."""
    fields = [f for f in df.schema.fields if keep_text or f.name != text]
    names = [f.name for f in fields]
    prints = lane_names(lanes)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"{x} long" for x in prints)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            for part in slices(batch, text):
                raw, starts, ends, bounds = shingle_spans(part.column(text), n)
                hashes = np.fromiter((digest(raw[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))
                found = []
                for lane in range(lanes):
                    if lane:
                        hashes = mix(hashes, 0x2545F4914F6CDD1D)
                    found.append(pa.array(np.array([majority(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:])], np.uint64).view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *found], [*names, *prints])

    return df.mapInArrow(run, schema)


def lane_names(lanes: int) -> list[str]:
    return ["fp", *(f"fp{i}" for i in range(1, lanes))]


def bit_moments(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and, for each pair of bits, in how many both are 1, over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(x), 1 << 14):
                bits = np.unpackbits(x[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += bits.T @ bits
                n += len(bits)
        cells = np.append(total.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], ["cell", "n"])

    cells = nodes.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 64 * 64 + 1 rows
    flat = np.zeros(BITS * BITS + 1)
    for cell, n in cells:
        flat[cell] = n
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def correlated_parts(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m parts of near equal size; each grows by the free bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    free, parts = set(range(BITS)), []
    for i in range(m):
        size = BITS // m + (i < BITS % m)
        part = [max(free, key=lambda b: (corr[b, sorted(free)].sum(), -b))]
        free.discard(part[0])
        while len(part) < size:
            part.append(max(free, key=lambda b: (corr[b, part].sum(), -b)))
            free.discard(part[-1])
        parts.append(sorted(part))
    return parts


def within(part: list[int], p: np.ndarray, radius: int) -> list[float]:
    """Estimated chance that two fingerprints differ in at most t bits of the part, for t = 0 .. radius."""
    chance = np.zeros(len(part) + 1)
    chance[0] = 1
    for b in part:
        q = 2 * p[b] * (1 - p[b])
        chance[1:] = chance[1:] * (1 - q) + chance[:-1] * q
        chance[0] *= 1 - q
    total = np.cumsum(chance)
    return [float(total[min(t, len(part))]) for t in range(radius + 1)]


def allocate(n: int, parts: list[list[int]], p: np.ndarray, radius: int) -> tuple[float, list[int]]:
    """The thresholds of least estimated cost that sum to radius - len(parts) + 1, by dynamic programming."""
    need = radius - len(parts) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in parts:
        chance = within(part, p, radius)
        rows = np.cumsum([math.comb(len(part), t) for t in range(radius + 1)])
        cost = {-1: 0.0} | {t: n * (ROW_COST * (rows[t] + 1) + n * chance[t] / 2) for t in range(radius + 1)}
        after: dict[int, tuple[float, list[int]]] = {}
        for total, (sofar, chosen) in best.items():
            for t, c in cost.items():
                if (k := total + t) not in after or sofar + c < after[k][0]:
                    after[k] = (sofar + c, [*chosen, t])
        best = after
    return best[need]


def plan_parts(nodes: DataFrame, radius: int) -> list[tuple[list[int], int]]:
    """The parts to be probed with their thresholds."""
    n, both = bit_moments(nodes.select("fp"))
    p = np.diag(both) / max(n, 1)
    options = []
    for m in range(1, min(radius + 1, 16) + 1):
        parts = correlated_parts(n, both, m)
        options.append((*allocate(max(n, 1), parts, p, radius), parts))
    _, thresholds, parts = min(options, key=lambda o: o[0])
    return [(part, t) for part, t in zip(parts, thresholds) if t >= 0]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def linked(nodes: DataFrame, radius: int = RADIUS, lanes: int = 1, lane_radius: int | None = None) -> DataFrame:
    """nodes (id, fp, more lanes; ids distinct) with root, the same for all that are reachable by links.

    A link: at most `radius` bits differ in fp and, with more lanes, at most `lane_radius` bits in all lanes together.
    """
    prints = lane_names(lanes)
    plan = plan_parts(nodes, radius)
    masks = [signed(sum(1 << b for b in part)) for part, _ in plan]
    bits = lambda c: F.bit_count(F.col(c).bitwiseXOR(F.col(f"o_{c}")))
    close = bits("fp") <= radius
    if lanes > 1:
        close = close & (sum(bits(c) for c in prints) <= lane_radius)
    other = lambda df: df.withColumnsRenamed({c: f"o_{c}" for c in df.columns if c not in ("part", "sig")})
    stored = F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(mask)).alias("sig")) for i, mask in enumerate(masks)])).alias("key")

    before = Window.partitionBy("part", "sig").orderBy(*prints, "id")
    beside = nodes.select("id", *prints, stored).select("id", *prints, "key.*")
    beside = beside.select("id", *prints, *[F.lag(c).over(before).alias(f"o_{c}") for c in ("id", *prints)])
    chain = contract(beside.where(close).select(F.col("id").alias("a"), F.col("o_id").alias("b")))
    labelled = materialise(rooted(nodes.select("id", *prints), chain, "id"), "labelled")

    near = [[signed(sum(1 << b for b in c)) for t in range(T + 1) for c in combinations(part, t)] for part, T in plan]
    flips = F.array(*[F.struct(F.lit(i).alias("part"), F.lit(mask).alias("mask"), F.array(*map(F.lit, d)).alias("flips")) for i, (mask, d) in enumerate(zip(masks, near))])
    index = labelled.select("root", *prints, stored).select("root", *prints, "key.*")
    probe = labelled.select("root", *prints, F.explode(flips).alias("p")).select("root", *prints, "p.part", "p.mask", F.explode("p.flips").alias("flip"))
    probe = probe.select("root", *prints, "part", F.col("fp").bitwiseAND(F.col("mask")).bitwiseXOR(F.col("flip")).alias("sig"))
    found = index.join(other(probe), ["part", "sig"]).where((F.col("root") < F.col("o_root")) & close)
    rest = contract(found.select(F.col("root").alias("a"), F.col("o_root").alias("b")).distinct())
    return rooted(labelled.withColumnRenamed("root", "start"), rest, "start").select("id", "root")


def near_duplicate_groups(docs: DataFrame, n: int = SHINGLE, radius: int = RADIUS, lanes: int = 1, lane_radius: int | None = None) -> DataFrame:
    """docs' columns but text, with fp (and more lanes), root (a key of the group) and component_id, its smallest doc_id.

    A null text counts as empty and gets the zero fingerprint, linked like any other. Rows with a null doc_id take
    part; a group of only such rows has a null component_id.
    """
    prints = lane_names(lanes)
    marked = materialise(with_simhash(docs, n, lanes=lanes), "simhash")
    nodes = materialise(marked.groupBy(*prints).agg(F.min("doc_id").alias("first")).withColumn("id", F.monotonically_increasing_id()), "nodes")
    groups = materialise(linked(nodes.drop("first"), radius, lanes, lane_radius), "groups")
    smallest = nodes.select("id", "first").join(groups, "id").groupBy("root").agg(F.min("first").alias("component_id"))
    named = nodes.select("id", *prints).join(groups, "id").join(smallest, "root").select(*prints, "root", "component_id")
    return marked.join(named, prints)


def band_keys(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BANDS keys of a set of hashes, and 16 bits of each of its minimum hashes; two sets of Jaccard similarity s share a key with chance 1 - (1 - s ** BAND) ** BANDS."""
    least = np.full(BAND * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 1 << 10):
        np.minimum(least, (own[at : at + (1 << 10), None] * _FACTORS + _OFFSETS).min(axis=0), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND).T:
        keys = mix(keys * PRIME ^ column)
    return keys, mix(least).astype(np.uint16)


def with_shingles(df: DataFrame, n: int, sets: bool) -> DataFrame:
    """df's columns but text, with id (a hash of the text's set of n-word shingles), size (of the set), band keys, marks (bits of the minimum hashes) and fp (the set's fingerprint), or with sets the set itself."""
    names = [c for c in df.columns if c != "text"]
    last = "shingles" if sets else "keys"
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names), "id long, size long", f"{last} array<long>", *([] if sets else ["marks array<smallint>, fp long"])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 18):
                raw, starts, ends, bounds = shingle_spans(part.column("text"), n)
                hashes = span_hashes(np.frombuffer(raw, np.uint8), starts, ends)
                own = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
                ids = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in own], np.uint64).view(np.int64)
                held = [own] if sets else list(zip(*map(band_keys, own)))
                lists = [pa.ListArray.from_arrays(np.append(0, np.cumsum([len(y) for y in x])).astype(np.int32), np.concatenate(x).view(kind)) for x, kind in zip(held, (np.int64, np.int16))]
                prints = [] if sets else [pa.array(np.array([majority(x) for x in own], np.uint64).view(np.int64))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(ids), pa.array([len(x) for x in own], pa.int64()), *lists, *prints], [*names, "id", "size", last, *([] if sets else ["marks", "fp"])])

    return df.mapInArrow(tidy(run), schema)


def verified(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of `similar` or more.

    A set goes to as many of SALTS places as its pairs need, so a node with very many pairs isn't one task's work.
    """
    for x, y in ("ab", "ba"):
        pairs = pairs.withColumn("salt", F.pmod(F.xxhash64(y), F.lit(SALTS)))
        own = pairs.select(x, "salt").distinct().join(sets.select(F.col("id").alias(x), F.col("shingles").alias(f"set_{x}")), x)
        pairs = pairs.join(own, [x, "salt"])
    both = F.size(F.array_intersect("set_a", "set_b"))
    return pairs.where(both >= similar * (F.size("set_a") + F.size("set_b") - both) - 1e-9).select("a", "b")


def likely(pairs: DataFrame, marks: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) that may be similar; sets are exchanged only for these.

    They have in common the minimum hashes that sets of the least similarity are expected to, less five standard deviations.
    """
    n = BAND * BANDS
    common = n * similar - 5 * (n * similar * (1 - similar)) ** 0.5
    for x in "ab":
        pairs = pairs.join(marks.select(F.col("id").alias(x), F.col("marks").alias(f"marks_{x}")), x)
    same = F.size(F.filter(F.zip_with("marks_a", "marks_b", lambda m, n: m == n), lambda equal: equal))
    return pairs.where(same >= common).select("a", "b")


def candidate_index(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(id, size, key) of the nodes (id, size, fp, keys) that share a key with others: the group that links of at most `radius` bits connect, and the band keys."""
    groups = materialise(linked(nodes.select("id", "fp"), radius), "groups")
    held = groups.join(groups.groupBy("root").count().where("count > 1"), "root", "left_semi").select("id", F.xxhash64("root", F.lit(SEED)).alias("key"))
    bands = nodes.select("id", "size", F.explode("keys").alias("key"))
    bands = bands.join(bands.groupBy("key").count().where("count > 1"), "key", "left_semi").select("id", "size", "key")
    return bands.unionByName(nodes.select("id", "size").join(held, "id"))


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (id, root) with the components that links (a, b) of their ids connect made one."""
    ends = links.join(roots.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a").join(roots.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b")
    steps = contract(ends.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    if not steps:
        return roots
    return materialise(rooted(roots.withColumnRenamed("root", "start"), steps, "start").select("id", "root"), "roots")


def mixed_buckets(index: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of index in buckets of several components, with root, most (the root of the bucket's largest component), nodes (of the bucket) and outside (those not in the largest)."""
    live = index.join(roots, "id")
    most = live.groupBy("key", "root").count().groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("most"), F.sum("count").alias("nodes"), (F.sum("count") - F.max("count")).alias("outside"))
    return materialise(live.join(most.where("outside > 0"), "key"), "mixed")


def regrouped(mixed: DataFrame) -> DataFrame:
    """The index (id, size, key, wide) of the buckets in mixed; those with more than WIDE nodes outside are wide, and of these, such as overlap are one.

    A large group fills up to BANDS + 1 buckets a node; its nodes are so compared once and not in each. A bucket joins
    the one that is the widest of most of its nodes, and goes with that where it joins another. Buckets move whole, so
    no pair is lost.
    """
    wide = mixed.where(F.col("outside") > WIDE)
    widest = F.max(F.struct("nodes", "key")).over(Window.partitionBy("id"))["key"]
    homes = wide.select("key", widest.alias("home")).groupBy("key", "home").count().groupBy("key").agg(F.max_by("home", F.struct("count", "home")).alias("home"))
    homes = homes.join(homes.select(F.col("key").alias("home"), F.col("home").alias("group")), "home").select("key", "group")
    return mixed.join(homes, "key", "left").select("id", "size", F.coalesce("group", "key").alias("key"), F.col("group").isNotNull().alias("wide")).distinct()


def profiles(rows: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The rows (key, id) with delta, the symmetric difference of the node's set A and a set C of its bucket, and excess, |delta| - d |A| with d = (1 - similar) / (1 + similar).

    A and B are similar if their symmetric difference has at most d (|A| + |B|) elements; it has |delta A| + |delta B|
    less twice those that both deltas hold. So they need (excess A + excess B) / 2 common elements of their deltas,
    and none if that isn't above 0. This holds for any C; here it is what over half of some USUAL nodes have.
    """
    rows = rows.select("key", "id")
    held = rows.join(rows.groupBy("key").agg(F.count("*").alias("nodes")), "key").join(sets, "id")
    some = held.where(F.pmod(F.xxhash64("id", "key"), F.ceil(F.col("nodes") / USUAL)) == 0)
    enough = some.groupBy("key").count()
    usual = some.select("key", F.explode("shingles").alias("x")).groupBy("key", "x").agg(F.count("*").alias("n")).join(enough, "key").where("2 * n > count")
    usual = usual.groupBy("key").agg(F.collect_list("x").alias("usual"))
    both = held.join(usual, "key", "left").withColumn("usual", F.coalesce("usual", F.array().cast("array<long>")))
    delta = F.concat(F.array_except("shingles", "usual"), F.array_except("usual", "shingles"))
    excess = F.size("delta") - F.lit((1 - similar) / (1 + similar)) * F.size("shingles")
    return both.withColumn("delta", delta).select("key", "id", "delta", excess.alias("excess"))


def sure_links(wide: DataFrame) -> DataFrame:
    """The pairs (a, b) of each bucket's node of least excess and those that are similar to it whatever their deltas have in common.

    Two nodes that are similar in this way are both in pairs with the node of least excess.
    """
    least = wide.groupBy("key").agg(F.min_by(F.struct("id", "excess"), F.struct("excess", "id")).alias("o"))
    return wide.join(least, "key").where((F.col("excess") + F.col("o.excess") <= 1e-9) & (F.col("id") != F.col("o.id"))).select(F.col("id").alias("a"), F.col("o.id").alias("b")).distinct()


def sharing(wide: DataFrame, alike: Column) -> DataFrame:
    """(id, o_id) of all pairs in a bucket that may be similar and of which one isn't in its largest component; wide: profiles with size, root and most.

    As sure links are in the components, similar nodes of different ones have at least the elements of their deltas in
    common that their excesses ask for. With the rarest elements first, they then share one among the first of each:
    as many as it has that the others hold, less the least number asked for, and one.
    """
    rows = wide.withColumn("out", F.col("root") != F.col("most"))
    least = rows.groupBy("key").agg(F.min(F.when(F.col("out"), F.col("excess"))).alias("least_out"), F.min(F.when(~F.col("out"), F.col("excess"))).alias("least_in"))
    rows = rows.join(least, "key").select("key", "id", "root", "size", "excess", "out", "least_out", "least_in", F.explode("delta").alias("x"))
    element = Window.partitionBy("key", "x")
    held = rows.withColumn("outs", F.sum(F.col("out").cast("int")).over(element)).withColumn("ins", F.sum((~F.col("out")).cast("int")).over(element))
    rows = materialise(held.where("outs > 0 and ins + outs > 1"), "elements")

    def first(out: bool, other: bool) -> DataFrame:
        """The first elements of the nodes in or outside the largest components that nodes on the other side hold."""
        both = F.col("outs" if other else "ins") > (1 if out and other else 0)
        own = rows.where(F.col("out") == out).where(both).withColumn("least", F.col("least_out" if other else "least_in"))
        node = Window.partitionBy("key", "id")
        own = own.withColumn("n", F.count("*").over(node)).withColumn("place", F.row_number().over(node.orderBy(F.col("ins") + F.col("outs"), "x")))
        need = F.greatest(F.lit(1), F.ceil((F.col("excess") + F.col("least")) / 2 - 1e-6))
        return own.where(F.col("place") <= F.col("n") - need + 1).select("key", "x", "id", "root", "size", "excess", "n")

    outer = first(True, True)
    met = [(first(False, True), first(True, False)), (outer, outer)]
    close = (F.col("root") != F.col("o_root")) & alike & ((F.col("excess") + F.col("o_excess")) / 2 <= F.least("n", "o_n") + 1e-6)
    found = [a.join(b.withColumnsRenamed({c: f"o_{c}" for c in b.columns if c not in ("key", "x")}), ["key", "x"]).where(close).select("id", "o_id") for a, b in met]
    return found[0].unionByName(found[1])


def similar_roots(index: DataFrame, sets: DataFrame, marks: DataFrame, similar: float) -> DataFrame:
    """id and root of each node of index (id, size, key), the same for all that are reachable by pairs of `similar` or more that share a key.

    At first every node is compared with one node in each of STARS orders, the first in it of one of its buckets, which
    makes one component of most large groups. All orders are taken in one query, as a plan an order fills the driver.
    Then all pairs of different components are compared: only nodes outside a bucket's largest component are paired with
    the rest of it, and where these are more than WIDE, only with those that they may be similar to by the differences
    of their sets from what is usual in the bucket. So a large group, with many nodes near the threshold too, costs its
    own size and not the square, and not that times the buckets that it fills, as these are made one.
    """
    alike = F.least("size", "o_size") >= similar * F.greatest("size", "o_size") - 1e-9

    def links(met: DataFrame) -> DataFrame:
        pairs = materialise(met.select(F.least("id", "o_id").alias("a"), F.greatest("id", "o_id").alias("b")).distinct(), "pairs")
        return materialise(verified(materialise(likely(pairs, marks, similar), "likely"), sets, similar), "links")

    first = [F.min_by(F.struct("id", "size"), F.xxhash64("id", F.lit(turn))).alias(f"o{turn}") for turn in range(STARS)]
    beside = index.withColumnRenamed("size", "own").join(index.groupBy("key").agg(*first), "key")
    fit = lambda o: (F.col("id") != F.col(f"{o}.id")) & (F.least("own", f"{o}.size") >= similar * F.greatest("own", f"{o}.size") - 1e-9)
    chosen = [F.min_by(f"{o}.id", F.when(fit(o), F.xxhash64(f"{o}.id", F.lit(turn)))).alias(o) for turn, o in enumerate(f"o{t}" for t in range(STARS))]
    met = beside.groupBy("id").agg(*chosen).select("id", F.explode(F.array_compact(F.array(*[f"o{turn}" for turn in range(STARS)]))).alias("o_id"))
    roots = materialise(rooted(index.select("id").distinct(), contract(links(met)), "id"), "roots")

    mixed = mixed_buckets(index, roots)
    narrow, deltas = mixed, not mixed.where(F.col("outside") > WIDE).isEmpty()
    if deltas:
        index = materialise(regrouped(mixed), "regrouped")
        wide = materialise(profiles(index.where("wide"), sets, similar), "wide")
        roots = merged(roots, sure_links(wide))
        mixed = mixed_buckets(index, roots)
        narrow = mixed.where(~F.col("wide"))
    others = narrow.where("root <> most").select("key", F.col("id").alias("o_id"), F.col("root").alias("o_root"), F.col("size").alias("o_size"))
    met = narrow.join(others, "key").where((F.col("root") != F.col("o_root")) & alike).select("id", "o_id")
    if deltas:
        met = met.unionByName(sharing(wide.join(mixed.where("wide").select("key", "id", "size", "root", "most"), ["key", "id"]), alike))
    return merged(roots, links(met))


def without_near_duplicates(docs: DataFrame, n: int = 5, similar: float = SIMILAR) -> DataFrame:
    """docs with one row of each near-duplicate group, the one of the smallest doc_id (null last; repeated ids: one row).

    A link is a Jaccard similarity of `similar` or more of the sets of n-word shingles, computed exactly for every pair
    of one group of fingerprints (linked(), within RADIUS bits) and, for pairs further apart, for every pair that shares
    one of BANDS band keys (a pair of 0.8: 99.96 %). Groups are what links connect. Texts without words are one group.
    """
    docs, named = shielded(stable(docs))
    keyed = docs.withColumn("uid", F.monotonically_increasing_id())
    marked = materialise(with_shingles(keyed.select("uid", "doc_id", "text"), n, sets=False), "bands")
    nodes = materialise(marked.groupBy("id").agg(F.min("uid").alias("uid"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.first("marks").alias("marks"), F.first("fp").alias("fp")), "nodes")
    index = materialise(candidate_index(nodes), "index")
    shared = materialise(nodes.select("id", "uid").join(index.select("id").distinct(), "id").select("uid"), "shared")
    sets = materialise(with_shingles(keyed.select("uid", "text").join(shared, "uid", "left_semi"), n, sets=True).select("id", "shingles"), "sets")
    groups = similar_roots(index, sets, nodes.select("id", "marks"), similar)
    rooted_rows = marked.select("uid", "doc_id", "id").join(groups, "id", "left").withColumn("root", F.coalesce("root", "id"))
    first = rooted_rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("first")).select("first.uid")
    return named(keyed.join(materialise(first, "kept"), "uid", "left_semi"))


def op9_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint and the near-duplicate group of every document."""
    groups = near_duplicate_groups(tables(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op9_simhash_components": op9_simhash_components}
ORACLE_SQL: dict[str, str] = {}
