"""Chunking, ids, duplicates and maintenance of a chunk table (source, page, content, chunk_id, ...)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import clean_question, let
from tessera.operators.prefix import numbered
from tessera.staging import materialise

CHUNK_SIZE, CHUNK_OVERLAP = 512, 64
WINDOW = 16
#: Chunks and characters of a page whose contents are compared with each other as they stand.
PAGE_CHUNKS, PAGE_CHARS = 64, 1 << 20


def chunk_id(source: Column, page: Column, text: Column) -> Column:
    return F.sha2(F.concat(source.cast("string"), F.lit(":"), page.cast("string"), F.lit(":"), text), 256)


def chunk_windows(pages: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """pages (source, page, text) as chunks of `size` words that share `overlap`; a tail only if it has words of its own."""
    assert 0 <= overlap < size, "the overlap must be smaller than the chunk"
    step = size - overlap
    words = F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")
    n = F.size("words")
    full = F.when(n < size, 0).otherwise(F.floor((n - size) / step) + 1).cast("int")
    rest = n - F.col("full") * step
    tail = (rest > F.when(F.col("full") > 0, overlap).otherwise(0)).cast("int")
    some = pages.where(F.col("text").rlike(r"(?U)\S"))  # n > 0 says the same, but would split each text several times more
    counted = some.withColumn("words", words).withColumn("full", full).withColumn("n", F.col("full") + tail)
    spread = counted.select("source", "page", "words", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("chunk_no"))
    text = F.array_join(F.slice("words", F.col("chunk_no") * step + 1, F.lit(size)), " ")
    out = spread.select("source", "page", "chunk_no", text.alias("content"))
    return out.withColumn("chunk_id", chunk_id(F.col("source"), F.col("page"), F.col("content")))


def exact_duplicates(chunks: DataFrame, *ties: Column | str) -> DataFrame:
    """The chunks of each (source, page, content) but one: the one with the canonical id, else the smallest id.

    Copies of one canonical id are told apart by `ties` alone. The canonical id of a null content is null.
    """
    canonical = F.col("chunk_id").eqNullSafe(chunk_id(F.col("source"), F.col("page"), F.col("content")))
    order = Window.partitionBy("source", "page", F.sha2("content", 256)).orderBy(canonical.desc(), F.col("chunk_id").asc_nulls_last(), *ties)
    return chunks.withColumn("_n", F.row_number().over(order)).where("_n > 1").drop("_n")


def contained_tails(chunks: DataFrame, most_words: int | None = None) -> DataFrame:
    """Chunks whose content a longer chunk of the same (source, page) contains. With most_words only contents of so many words.

    Pages of up to PAGE_CHUNKS chunks and PAGE_CHARS characters meet in one row, so their contents are exchanged once;
    the chunks of larger pages are found by their rarest grams.
    """
    same = ["source", "page"]
    whole = chunks.where("source IS NOT NULL AND page IS NOT NULL")  # null pages have no tails
    sizes = whole.groupBy(*same).agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))
    large = materialise(sizes.where((F.col("n") > PAGE_CHUNKS) | (F.col("chars") > PAGE_CHARS)).select(*same), "large-pages")
    if large.isEmpty():
        return contained_by_page(whole, most_words)
    found = contained_by_page(whole.join(large, same, "left_anti"), most_words).unionByName(contained_by_grams(whole.join(large, same, "left_semi"), most_words))
    return found.select(*chunks.columns)


def contained_by_page(chunks: DataFrame, most_words: int | None = None) -> DataFrame:
    """contained_tails() where all chunks of a page meet in one row."""
    few = lambda c: F.size(F.split(c, r"(?U)\s+")) <= most_words if most_words else F.lit(True)
    inside = lambda c: lambda o: (F.length(o["content"]) > F.length(c)) & o["content"].contains(c)
    met = chunks.groupBy("source", "page").agg(F.collect_list(F.struct(*chunks.columns)).alias("_all")).where(F.size("_all") > 1)  # PAGE_CHUNKS at most
    found = F.filter("_all", lambda r: (F.length(r["content"]) > 0) & few(r["content"]) & F.exists("_all", inside(r["content"])))
    return met.select(F.explode_outer(found).alias("_r")).where("_r IS NOT NULL").select("_r.*")  # explode() alone would have Spark filter by the size of `found` first, and find twice


def contained_by_grams(chunks: DataFrame, most_words: int | None = None) -> DataFrame:
    """contained_tails() for pages of any size.

    The inner words of a content (all but the first and the last) stand whole in whatever contains it, so a longer chunk
    must have any three of them in a row, one where there are fewer, and of contents without inner words any four
    characters. Of WINDOW threes one after the other only the one of the least hash counts, which is the same in both
    contents; all threes and words are looked at on pages that have shorter contents alone. Each content asks for the
    rarest of its grams; (id, gram) hashes alone are exchanged for that, and contents only for the pairs that share one.
    """
    same = ["source", "page"]
    hashes = F.transform(F.split("content", r"(?U)\s+"), lambda w: F.xxhash64(w))
    own = chunks.where("content IS NOT NULL").select(*same, "content", F.xxhash64(*same, "content").alias("id"), F.xxhash64(*same).alias("place"), hashes.alias("w"))
    held = materialise(own, "contents")
    groups = held.select(*same, "id").distinct().groupBy(*same).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")  # null pages have no tails
    held = held.join(groups, same, "left_semi")
    size, length = F.size("w"), F.length("content")
    steps = lambda n: F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    of = lambda kind, n, *parts: F.transform(steps(n), lambda i: F.xxhash64("place", F.lit(kind), *[x(i) for x in parts]))
    word = lambda at: lambda i: F.get("w", i + at)
    letters = lambda width: lambda i: F.substring("content", i, F.lit(width))
    threes = lambda first, n: of(3, n, *[word(first + k) for k in range(3)])
    short = held.where(size <= most_words) if most_words else held
    inner = size - 2
    least = lambda grams: let(grams, lambda g: F.array_distinct(F.transform(steps(F.size(g) - WINDOW + 1), lambda i: F.xxhash64(F.array_min(F.slice(g, i, WINDOW))))))
    asked = F.when(inner - 2 >= WINDOW, least(threes(0, inner - 2))).when(inner >= 3, threes(0, inner - 2)).when(inner >= 1, of(1, inner, word(0)))
    for width in (4, 3, 2, 1):
        asked = asked.when(length >= width, of(-width, length - width + 1, letters(width)))
    asks = short.select("id", F.explode(F.array_distinct(asked)).alias("gram")).distinct()
    bare = short.where(inner < 1).select(*same).distinct()  # pages where characters are asked for
    few = short.where((inner >= 1) & (inner - 2 < WINDOW)).select(*same).distinct()  # pages where all threes and words are
    by_windows = held.select("id", F.explode(least(threes(-1, size - 2))).alias("gram"))
    by_words = held.join(few, same, "left_semi").select("id", F.explode(F.array_distinct(F.concat(threes(-1, size - 2), of(1, size, word(-1))))).alias("gram"))
    each = F.array_distinct(F.concat(*[of(-x, length - x + 1, letters(x)) for x in (1, 2, 3, 4)]))
    by_letters = held.join(bare, same, "left_semi").select("id", F.explode(each).alias("gram"))
    offers = by_windows.unionByName(by_words).unionByName(by_letters)
    counts = offers.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = asks.join(counts, "gram").groupBy("id").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    pairs = rarest.join(offers.withColumnRenamed("id", "other"), "gram").where("id <> other").select("id", "other").distinct()
    texts_of = lambda i, c: held.groupBy(F.col("id").alias(i)).agg(F.first("content").alias(c))
    found = pairs.join(texts_of("id", "_c"), "id").join(texts_of("other", "_o"), "other").where((F.length("_o") > F.length("_c")) & F.col("_o").contains(F.col("_c")))
    inside = found.select("id").distinct()
    return chunks.withColumn("_id", F.xxhash64(*same, "content")).join(inside.withColumnRenamed("id", "_id"), "_id", "left_semi").drop("_id")


def first_of(batch: DataFrame, key: str, *order: Column | str) -> DataFrame:
    return batch.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(target: DataFrame, batch: DataFrame, key: str = "chunk_id") -> DataFrame:
    """target with the batch's rows in place of its own of the same key. The batch's keys must be distinct (first_of)."""
    return target.join(batch.select(key), key, "left_anti").select(*target.columns).unionByName(batch.select(*target.columns))


def replace_sources(target: DataFrame, batch: DataFrame, key: str = "chunk_id") -> DataFrame:
    """target with the batch's rows in place of its own of the same key, and without other chunks of the batch's sources."""
    old = target.join(batch.select("source").distinct(), "source", "left_anti").join(batch.select(key), key, "left_anti")
    return old.select(*target.columns).unionByName(batch.select(*target.columns))


def replacement_counts(target: DataFrame, batch: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Per source of the batch: chunks added, and removed because the batch lacks them."""
    old = target.join(batch.select("source").distinct(), "source", "left_semi").select("source", F.col(key).alias("k"), F.lit(1).alias("old"))
    new = batch.select("source", F.col(key).alias("k"), F.lit(1).alias("new"))
    both = old.join(new, ["source", "k"], "full_outer")
    return both.groupBy("source").agg(F.count("new").alias("added"), F.count(F.when(F.col("new").isNull(), 1)).alias("removed"))


def remove(target: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    return target.join(ids.select(key), key, "left_anti")


def update_metadata(target: DataFrame, fields: DataFrame, columns: Sequence[str], key: str = "source") -> DataFrame:
    """target with the non-null columns of fields (one row a key) over its own."""
    new = fields.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = target.join(new, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"_new_{c}", c) if c in target.columns else F.col(f"_new_{c}"))
    return out.drop(*[f"_new_{c}" for c in columns])


def manifest_difference(manifest: DataFrame, target: DataFrame) -> DataFrame:
    """(source, state): applied, missing from the index, or not in the manifest."""
    m, t = manifest.select("source").distinct().withColumn("m", F.lit(1)), target.select("source").distinct().withColumn("t", F.lit(1))
    state = F.when(F.col("t").isNull(), "not_indexed").when(F.col("m").isNull(), "unlisted").otherwise("applied")
    return m.join(t, "source", "full_outer").select("source", state.alias("state"))


def manifest_report(manifest: DataFrame, target: DataFrame) -> DataFrame:
    """(source, state, updated) by lower-case name: the difference, and how many chunks of each applied source the manifest changes."""
    chunks = target.groupBy("source").agg(F.count("*").alias("n"))
    rows = manifest_difference(manifest, target).join(chunks, "source", "left")
    return rows.select("source", "state", F.when(F.col("state") == "applied", F.col("n")).otherwise(0).alias("updated")).orderBy(F.lower("source"), "source")


def migrated(target: DataFrame, legacy: DataFrame, key: str = "chunk_id") -> DataFrame:
    """target with all of legacy's chunks; doing it again changes nothing, and legacy stays."""
    return upsert(target, legacy, key)


def emptied(target: DataFrame) -> DataFrame:
    """The schema of target without rows."""
    return target.where(F.lit(False))


def page_kind(text: Column, n_images: Column, thin: int = 200) -> Column:
    size = F.length(F.trim(F.coalesce(text, F.lit(""))))
    return F.when((size == 0) & (n_images > 0), "image_only").when(size == 0, "blank").when((size < thin) & (n_images > 0), "thin").otherwise("text")


def text_coverage(pages: DataFrame, share: float = 0.5) -> DataFrame:
    """Per source the pages of each kind, and whether it looks scanned."""
    kind = page_kind(F.col("text"), F.col("n_images"))
    count = lambda k: F.count(F.when(F.col("kind") == k, 1)).alias(k)
    per = pages.withColumn("kind", kind).groupBy("source").agg(F.count("*").alias("pages"), *map(count, ("blank", "image_only", "thin", "text")))
    return per.withColumn("likely_scanned", F.col("image_only") / F.col("pages") >= share)


def coverage_totals(per_source: DataFrame) -> DataFrame:
    """One row over text_coverage(): sources, pages of each kind, and sources that look scanned."""
    return per_source.agg(F.count("*").alias("sources"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pages", "blank", "image_only", "thin", "text")], F.count_if("likely_scanned").alias("scanned"))


def coverage_report(pages: DataFrame) -> DataFrame:
    """text_coverage() of every source and, in the row without a source, of all: one pass by rollup. Sources with most image-only pages first, then by name, the totals last.

    Pages without a source count under the empty name.
    """
    kinds = ("blank", "image_only", "thin", "text")
    named = pages.select(F.coalesce("source", F.lit("")).alias("source"), page_kind(F.col("text"), F.col("n_images")).alias("kind"))
    per = named.rollup("source").agg(F.count("*").alias("pages"), *[F.count_if(F.col("kind") == k).alias(k) for k in kinds], F.grouping("source").alias("_all"))
    return per.where((F.col("_all") == 0) | (F.col("pages") > 0)).orderBy("_all", F.desc("image_only"), "source").drop("_all")


def drafts(chunks: DataFrame, raw: Column, *order: Column | str) -> DataFrame:
    """Gold drafts (id, question, source, page, note, provenance) of the chunks whose raw answer is a question, numbered draft001, .. in order.

    order must tell all chunks apart. Numbers are given range by range, so there is no window over all drafts.
    """
    asked = chunks.withColumn("question", clean_question(raw)).where(F.col("question").isNotNull())
    n = F.col("number").cast("string")
    note = F.concat(F.lit("drafted from chunk "), F.substring(F.col("chunk_id").cast("string"), 1, 12))
    out = numbered(asked, *order)
    return out.select(F.concat(F.lit("draft"), F.when(F.length(n) < 3, F.lpad(n, 3, "0")).otherwise(n)).alias("id"), "question", "source", "page", note.alias("note"), F.lit("synthetic-draft").alias("provenance"))


def reset(path: str, like: DataFrame) -> None:
    """Empty the table at `path`: an overwrite with no rows of the columns of `like`."""
    emptied(like).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def stratified(chunks: DataFrame, stratum: str, n: int, seed: str = "0", key: str = "chunk_id", least: int = 200) -> DataFrame:
    """At most n chunks of a stratum, of at least `least` characters, by the order of a keyed digest."""
    order = Window.partitionBy(stratum).orderBy(F.sha2(F.concat(F.lit(seed + ":"), F.col(key).cast("string")), 256))
    return chunks.where(F.length(F.trim("content")) >= least).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def corpus_status(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("chunks"), F.countDistinct("source").alias("sources"))
