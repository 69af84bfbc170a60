"""Operator 6: removal of byte strings repeated across documents, by blockwise suffix sorting with a cover sample.

A byte goes if a 50-byte string that covers it also starts in a document with a smaller doc_id. Only the suffixes
that can matter are sorted, one bucket of suffixes at a time:

1. Cover sample. In every 50-byte window the 26-byte gram of least hash (leftmost on ties) is a cover position. Equal
   windows have it at equal offsets, which is what a difference cover grants to pairs of suffixes; taking it from the
   content leaves 2 / 26 of the positions, and lets the grams that occur in one document only be dropped at once.
2. Bucket. Occurrences of one gram, with the bytes of all windows that have it as their cover position, make a
   bucket. Occurrences with equal bytes in one slice of the input are first reduced to the smallest document.
3. Ranks. The cover suffixes of a bucket are sorted (50 bytes at most) and so are the reversed bytes before them. A
   window is then ordered by at most 24 leading bytes and the rank of its cover suffix: windows with equal bytes are
   those with one class of left ranks and one of right ranks, cut where neighbours share too few bytes.
   A block of whole buckets of about BLOCK_ROWS occurrences is in memory at a time.
4. Of equal windows, those outside the smallest document are marked.

Exact copies of a text are settled first by their digests and skip these steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.staging import materialise, shielded, stable, tables, tidy
from tessera.llm.textbytes import mix, powers, slices, utf8

LENGTH, GRAM = 50, 26
REACH = LENGTH - GRAM + 1
#: Bytes of text for which arrays are built at a time; longer texts are cut, with LENGTH - 1 bytes of overlap.
PIECE = 1 << 20
#: Occurrences that are sorted together.
BLOCK_ROWS = 1 << 16
#: Bytes of text for each bucket of grams in the first exchange.
BUCKET_TEXT = 16 << 20


def pieces(batch: pa.RecordBatch, text: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of about PIECE, bounds of the texts in them, their rows in the batch, and where in its text each begins."""
    data, at = utf8(batch.column(text))
    row, n = 0, batch.num_rows
    while row < n:
        if at[row + 1] - at[row] > PIECE:
            for base in range(0, int(at[row + 1] - at[row]) - LENGTH + 1, PIECE):
                part = data[at[row] + base : min(at[row + 1], at[row] + base + PIECE + LENGTH - 1)]
                yield part, np.array([0, len(part)]), np.array([row]), np.array([base])
            row += 1
            continue
        to = max(row + 1, int(np.searchsorted(at, at[row] + PIECE, "right")) - 1)
        yield data[at[row] : at[to]], at[row : to + 1] - at[row], np.arange(row, to), np.zeros(to - row, np.int64)
        row = to


def covers(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each cover position: its gram's hash, itself, and the first and last window that have it; and its text."""
    n = len(data)
    if n < LENGTH:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4)))
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    grams = mix((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1]) >> np.uint64(16)
    least, where = grams, np.arange(len(grams))
    for step in (1, 2, 4, 8, REACH - 16):  # windows of 2, 4, 8, 16 and REACH grams
        left = least[:-step] <= least[step:]
        least, where = np.where(left, least[:-step], least[step:]), np.where(left, where[:-step], where[step:])
    sizes = np.diff(bounds)
    texts = np.repeat(np.arange(len(sizes)), np.maximum(sizes - LENGTH + 1, 0))
    starts = np.arange(len(texts)) - np.repeat(np.cumsum(np.maximum(sizes - LENGTH + 1, 0)) - np.maximum(sizes - LENGTH + 1, 0), np.maximum(sizes - LENGTH + 1, 0)) + bounds[:-1][texts]
    spots = where[starts]
    if not len(spots):
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4)))
    new = np.flatnonzero(np.append(True, (np.diff(spots) != 0) | (np.diff(texts) != 0)))
    last = np.append(new[1:], len(spots)) - 1
    return grams[spots[new]], spots[new], starts[new], starts[last], texts[new]


def packed(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def packed48(x: np.ndarray) -> bytes:
    """Hashes of 48 bits in 6 bytes each. Grams of one hash meet, but only equal bytes are ever marked."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked48(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(x, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def runs(x: np.ndarray) -> tuple[bytes, bytes]:
    """Values and lengths of the runs of x."""
    head = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    return packed(x[head]), packed(np.diff(np.append(head, len(x))).astype(np.int32))


def send_grams(buckets: int, text: str = "text"):
    """Documents -> rows of grams by bucket. One row: the grams of a piece in a bucket, once a document.

    A gram in several documents of the piece is known to be repeated: its documents get it at once (bucket -1 - x, to
    pass through the exchange evenly), and the bucket gets it once, with the number of documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids = batch.column("uid").to_numpy()
            for data, bounds, rows, _ in pieces(batch, text):
                grams, *_, texts = covers(data, bounds)
                if not len(grams):
                    continue
                order = np.lexsort((texts, grams))
                grams, texts = grams[order], texts[order]
                keep = np.append(True, (np.diff(grams) != 0) | (np.diff(texts) != 0))
                grams, texts = grams[keep], texts[keep]
                head = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
                times = np.diff(np.append(head, len(grams)))
                known = np.repeat(times > 1, times)
                out: list[tuple] = []
                if known.any():
                    out.append((-1 - int(grams[0] % np.uint64(buckets)), packed48(grams[known]), *runs(uids[rows[texts[known]]]), packed(np.repeat(times, times)[known].astype(np.int32))))
                g, t, c = grams[head], texts[head], times
                bucket = (g % np.uint64(buckets)).astype(np.int64)
                by = np.lexsort((t, bucket))
                g, t, c, bucket = g[by], t[by], c[by], bucket[by]
                cut = np.flatnonzero(np.append(True, np.diff(bucket) != 0))
                for a, b in zip(cut, np.append(cut[1:], len(g))):
                    out.append((int(bucket[a]), packed48(g[a:b]), *runs(uids[rows[t[a:b]]]), packed(c[a:b].astype(np.int32))))
                for at in range(0, len(out), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out[at : at + 4096]), (pa.int32(), *4 * [pa.binary()]))], ["bucket", "grams", "uids", "runs", "times"])

    return run


def by_uid(uids: np.ndarray, grams: np.ndarray) -> pa.RecordBatch:
    """One row a document with its grams."""
    order = np.argsort(uids, kind="stable")
    uids, grams = uids[order], grams[order]
    cut = np.flatnonzero(np.append(True, np.diff(uids) != 0))
    return pa.RecordBatch.from_arrays([pa.array(uids[cut]), pa.array([packed48(grams[a:b]) for a, b in zip(cut, np.append(cut[1:], len(uids)))], pa.binary())], ["uid", "grams"])


def repeated_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket -> (uid, its grams that other documents have)."""
    held: list[tuple] = []
    bucket = None

    def owners(row: tuple) -> np.ndarray:
        return np.repeat(np.frombuffer(row[1], np.int64), np.frombuffer(row[2], np.int32))

    def settle() -> Iterator[pa.RecordBatch]:
        grams, uids = np.concatenate([unpacked48(h[0]) for h in held]), np.concatenate([owners(h) for h in held])
        times = np.concatenate([np.frombuffer(h[3], np.int32) for h in held])
        order = np.argsort(grams, kind="stable")
        grams, uids, times = grams[order], uids[order], times[order]
        head = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
        total = np.add.reduceat(times.astype(np.int64), head)
        many = np.repeat(total, np.diff(np.append(head, len(grams))))
        keep = many > 1
        if keep.any():
            yield by_uid(uids[keep], grams[keep])

    for batch in batches:
        for b, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "grams", "uids", "runs", "times"))):
            if b < 0:
                yield by_uid(owners(row), unpacked48(row[0]))
                continue
            if b != bucket and held:
                yield from settle()
                held.clear()
            bucket = b
            held.append(row)
    if held:
        yield from settle()


def send_occurrences(text: str = "text"):
    """Documents with grams -> occurrences: the bytes of all windows of a repeated cover position.

    kind 0: to be sorted with its bucket. kind 1: settled here, since an equal occurrence of a smaller document is in
    the same piece: all its windows are marked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "gram", "doc", "uid", "spot", "before", "mask", "body"]
        for batch in batches:
            uids, docs = batch.column("uid").to_numpy(), batch.column("doc").to_numpy()
            lists = batch.column("grams").to_pylist()
            for data, bounds, rows, bases in pieces(batch, text):
                grams, spots, first, last, texts = covers(data, bounds)
                if not len(grams):
                    continue
                keep = np.zeros(len(grams), bool)
                at = np.searchsorted(texts, np.arange(len(rows) + 1))
                for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
                    if a < b and lists[rows[i]]:
                        known = np.unique(np.concatenate([unpacked48(g) for g in lists[rows[i]]]))
                        k = np.minimum(np.searchsorted(known, grams[a:b]), len(known) - 1)
                        keep[a:b] = known[k] == grams[a:b]
                if not keep.any():
                    continue
                grams, spots, first, last, texts = (x[keep] for x in (grams, spots, first, last, texts))
                doc, uid, base = docs[rows[texts]], uids[rows[texts]], (bases - bounds[:-1])[texts]
                raw = data.tobytes()
                bodies = [raw[a : b + LENGTH] for a, b in zip(first.tolist(), last.tolist())]
                lowest: dict[tuple[int, int, bytes], int] = {}
                for g, d, body, p in zip(grams.tolist(), doc.tolist(), bodies, (spots - first).tolist()):
                    key = (g, p, body)
                    if (x := lowest.get(key)) is None or d < x:
                        lowest[key] = d
                out: list[tuple] = []
                for g, d, u, s, f, e, body in zip(grams.tolist(), doc.tolist(), uid.tolist(), (spots + base).tolist(), (spots - first).tolist(), (spots - last).tolist(), bodies):
                    mask = (2 << f) - (1 << e)
                    if lowest[g, f, body] < d:
                        out.append((1, 0, d, u, s, f, mask, b""))
                    else:
                        out.append((0, g, d, u, s, f, mask, body))
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)

    return run


def classes(texts: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of the rows of bytes (by group first), and how many bytes each shares with the one before (-1: other group)."""
    width = texts.shape[1]
    words = texts.view(">u8").astype(np.uint64)
    order = np.lexsort((*(words[:, i] for i in range(words.shape[1] - 1, -1, -1)), group))
    same = texts[order[1:]] == texts[order[:-1]]
    shared = np.where(same.all(axis=1), width, same.argmin(axis=1))
    shared[group[order[1:]] != group[order[:-1]]] = -1
    return order, np.append(-1, shared)


def marked_windows(group: np.ndarray, doc: np.ndarray, before: np.ndarray, mask: np.ndarray, bodies: list[bytes]) -> np.ndarray:
    """For each occurrence the mask of its windows (by offset of the cover position) that a smaller document has."""
    n = len(group)
    sizes = np.fromiter(map(len, bodies), np.int64, n)
    at = np.cumsum(sizes) - sizes
    flat = np.frombuffer(b"".join(bodies), np.uint8)
    spot = at + before
    step = np.arange(56)
    right = np.where(step < (at + sizes - spot)[:, None], flat[np.minimum(spot[:, None] + step, len(flat) - 1)], 0).astype(np.uint8)
    right[:, LENGTH:] = 0
    step = np.arange(32)
    left = np.where(step < before[:, None], flat[np.maximum(spot[:, None] - 1 - step, 0)], 0).astype(np.uint8)
    r_order, r_shared = classes(right, group)
    l_order, l_shared = classes(left, group)
    found = np.zeros(n, np.int64)
    r_class, l_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for k in range(REACH):
        own = np.flatnonzero(mask >> k & 1)
        if len(own) < 2:
            continue
        r_class[r_order] = np.cumsum(r_shared < LENGTH - k)
        l_class[l_order] = np.cumsum(l_shared < k)
        key = l_class[own] * (n + 1) + r_class[own]
        order = np.argsort(key, kind="stable")
        head = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
        least = np.repeat(np.minimum.reduceat(doc[own][order], head), np.diff(np.append(head, len(own))))
        found[own[order][doc[own][order] > least]] |= 1 << k
    return found


def mark_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences sorted by (gram, doc) -> (uid, spot, mask of marked windows), a block of whole buckets at a time.

    A bucket larger than a block is read in parts. What goes on from part to part are the occurrences with a window
    that no smaller document has; later documents can't change their marks.
    """
    names = ["gram", "doc", "uid", "spot", "before", "mask"]
    held: list[pa.Table] = []

    def settle(block: pa.Table) -> tuple[pa.RecordBatch, np.ndarray]:
        gram, doc, uid, spot, before, mask = (block.column(c).to_numpy() for c in names)
        group = np.cumsum(np.append(0, np.diff(gram) != 0))
        found = marked_windows(group, doc, before.astype(np.int64), mask.astype(np.int64), block.column("body").to_pylist())
        tell = (found > 0) & (block.column("kind").to_numpy() == 0)
        return pa.RecordBatch.from_arrays([pa.array(uid[tell]), pa.array(spot[tell]), pa.array(found[tell].astype(np.int32))], ["uid", "spot", "mask"]), found != mask

    most = BLOCK_ROWS
    for batch in batches:
        done = pc.equal(batch.column("kind"), 1)
        if batch.num_rows and pc.any(done).as_py():
            sure = batch.filter(done)
            yield pa.RecordBatch.from_arrays([sure.column(c) for c in ("uid", "spot", "mask")], ["uid", "spot", "mask"])
            batch = batch.filter(pc.invert(done))
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        if sum(b.num_rows for b in held) < most:
            continue
        block = pa.concat_tables(held).combine_chunks()
        gram = block.column("gram").to_numpy()
        edge = np.flatnonzero(gram != gram[-1])
        cut = int(edge[-1]) + 1 if len(edge) else 0
        if cut:
            yield settle(block.slice(0, cut))[0]
            most = BLOCK_ROWS
        rest = block.slice(cut).combine_chunks()
        if rest.num_rows >= most // 2:
            told, new = settle(rest)
            yield told
            rest = rest.filter(pa.array(new))
            rest = rest.set_column(rest.schema.get_field_index("kind"), "kind", pa.array(np.full(rest.num_rows, 2, np.int32)))  # told already
            most = max(BLOCK_ROWS, 2 * rest.num_rows)
        held = [rest]
    if held:
        block = pa.concat_tables(held).combine_chunks()
        if block.num_rows:
            yield settle(block)[0]


def runs_of(gone: np.ndarray) -> int:
    return int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())


def with_removals(docs: DataFrame, order: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with copy (a smaller document has the whole text) and marks (spot, mask): the marked windows.

    docs must give its rows in the same order whenever it is read, as tables do (see stable()).

    Null texts are empty. Rows of equal doc_id don't remove from one another; a null doc_id counts as the smallest.
    """
    spark = docs.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(4 * width, total // BUCKET_TEXT + 1)
    keyed = docs.withColumn("uid", F.monotonically_increasing_id())
    doc = F.coalesce(F.col(order), F.lit(-(2**63))).cast("long")
    digest = keyed.select("uid", doc.alias("doc"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("digest"))
    firsts = digest.groupBy("digest").agg(F.min("doc").alias("first"))
    copies = materialise(digest.join(firsts, "digest").where("doc > first").select("uid", F.lit(True).alias("copy")), "copies")

    # The texts are exchanged once: all three uses below need all columns of at_home, so that Spark reads one exchange thrice.
    at_home = keyed.repartition(width, "uid")
    settled = at_home.join(copies.hint("merge"), "uid", "left")
    fresh = settled.where(F.col("copy").isNull()).select(*keyed.columns, doc.alias("doc"))
    grams = fresh.mapInArrow(tidy(send_grams(buckets, text)), "bucket int, grams binary, uids binary, runs binary, times binary")
    flags = grams.repartition(max(width, total // BUCKET_TEXT + 1), "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(repeated_grams), "uid long, grams binary")
    listed = flags.groupBy("uid").agg(F.collect_list("grams").alias("grams"))
    kinds = "kind int, gram long, doc long, uid long, spot long, before int, mask int, body binary"
    found = fresh.join(listed.hint("merge"), "uid").mapInArrow(tidy(send_occurrences(text)), kinds)
    key = F.when(F.col("kind") == 1, F.xxhash64("uid")).otherwise(F.xxhash64("gram"))
    marks = found.repartition(width, key).sortWithinPartitions("gram", "doc").mapInArrow(tidy(mark_occurrences), "uid long, spot long, mask int")
    gathered = marks.groupBy("uid").agg(F.collect_list(F.struct("spot", "mask")).alias("marks"))
    return settled.join(gathered.hint("merge"), "uid", "left")


def span_report(removals: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            rows = []
            for doc, text, copy, marks in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "copy", "marks"))):
                body = np.frombuffer((text or "").encode(), np.uint8)
                gone = removed_bytes(len(body), marks, bool(copy))
                rows.append((doc, len(body), int(gone.sum()), runs_of(gone), hashlib.sha256(body[~gone].tobytes()).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return removals.select("doc_id", "text", "copy", "marks").mapInArrow(tidy(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def removed_bytes(n: int, marks: list[dict] | None, copy: bool) -> np.ndarray:
    if copy:
        return np.full(n, n >= LENGTH)
    gone = np.zeros(n + 1, np.int64)
    if marks:
        at = np.array([m["spot"] for m in marks])
        mask = np.array([m["mask"] for m in marks])
        for k in range(REACH):
            first = at[(mask >> k & 1) == 1] - k
            np.add.at(gone, first, 1)
            np.add.at(gone, first + LENGTH, -1)
    return np.cumsum(gone)[:n] > 0


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the removed bytes cut from text. A character goes only if all of its bytes are removed.

    Columns may have any names. Rows may repeat: those of equal doc_id don't remove from one another. A null or empty
    text stays as it is.
    """
    docs, named = shielded(stable(docs))
    fields = docs.schema.fields
    names = [f.name for f in fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            texts = []
            for text, copy, marks in zip(*(batch.column(c).to_pylist() for c in ("text", "copy", "marks"))):
                if text and (copy or marks):
                    body = np.frombuffer(text.encode(), np.uint8)
                    gone = removed_bytes(len(body), marks, bool(copy))
                    char = np.cumsum((body & 0xC0) != 0x80) - 1
                    kept = np.zeros(char[-1] + 1, bool)
                    kept[char[~gone]] = True
                    text = body[kept[char]].tobytes().decode()
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names], names)

    return named(with_removals(docs).select(*names, "copy", "marks").mapInArrow(tidy(run), schema))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to documents with smaller ids."""
    return span_report(with_removals(tables(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {"op6_suffix_dedup": op6_suffix_dedup}
ORACLE_SQL: dict[str, str] = {}
