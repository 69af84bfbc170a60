"""Operator 12: token ids in wavelet matrices, one compressed file a shard.

A shard holds the ids of consecutive documents. Its wavelet matrix has a bit plane for each bit of an id, the highest
first; each plane is in the order that the planes above sorted the ids into, zeros before ones. A plane is cut into
blocks of BLOCK bits, each compressed by itself, beside a directory of their places and of the ones before them. So
the id at a place, the number of an id's occurrences before a place (rank) and the place of its k-th occurrence
(select) read one block of each plane, whatever the size of the shard.

A file is a Parquet file of one row: the shard's number, the ids before it in its partition, how many documents and
ids it has, and its bytes. Spark's committer thus writes it on any store that Spark knows, once even if a task runs
twice, and readers skip the bytes where only the numbers are asked for. Layout of the bytes, little-endian:

    magic, planes and bits of a block, documents, ids, length of the compressed documents
    for each plane: its zeros, then for each block the end of its bytes, then for each block the ones before it
    the documents (ids as differences, counts), compressed; the blocks, plane by plane

Texts are range-partitioned by doc_id; each task encodes its texts in order and cuts them into shards of at most
SHARD_IDS ids (a longer document is a shard of its own). Memory is that of a shard, some 40 bytes an id.

doc_id must be an integer; null ids come first. Documents with one id are ordered by a hash of their texts, so repeated
rows are all kept, and many rows of one id (or null) may go to several tasks. A null text is empty and has the end id
alone. Columns but doc_id and text aren't read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.staging import shared_dir, tables
from tessera.llm.textbytes import slices

#: The public tokenizer of the tokenizer folder; every function takes another path.
TOKENIZER = os.path.join(os.environ.get("TESSERA_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.json")
END = 2
SHARD_IDS = 1 << 22
BLOCK = 1 << 15
MAGIC = b"WVM1"
_HEAD = struct.Struct("<4sIQQQ")


# --- encoding -------------------------------------------------------------------------------------------------------

#: A worker keeps the ids of so many units as Arrow columns and, by name, of half as many tokens, and of as many that it used before those; none is longer than UNIT characters.
UNITS, UNIT = 1 << 19, 48
_CUT, _BETWEEN, _LINES = re.compile(r"(?= \S)"), re.compile(r"\s (?=\s|\Z)"), re.compile(r"\n(?:(?=\s)|(?<=\s\n))")
#: A word of Latin letters with ASCII punctuation after it, two tokens of the pre-tokenizer. Apostrophes may begin a suffix.
_WORD = re.compile(r"( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!\"#$%&()*+,\-./:;<=>?@\[\\\]^`{|}~]*)")
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: The character that stands for each byte in a byte-level vocabulary: itself if it is printable, else the next from U+0100 on.
_LETTERS = dict(zip([*_PLAIN, *(b for b in range(256) if b not in set(_PLAIN))], map(chr, [*_PLAIN, *range(0x100, 0x200)])))


class Encoder:
    """Ids of whole texts by the tokenizers library, each distinct unit of a text encoded once.

    The pre-tokenizer (byte level) starts a token at every space that other characters than white space surround, and
    at every space before such a character: no token of it reaches over those places. A line break between other
    characters is a token. Texts cut there have units of one
    word, mostly, whose ids one after the other are those of the text. White space as Python knows it includes the
    library's, so that doubtful places aren't cut. Plain words go to the library's model without its pre-tokenizer, as
    they are tokens already. Texts with a special token, and all texts if the tokenizer isn't of this kind, are encoded
    whole.
    """

    def __init__(self, path: str, end: int = END) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks run beside each other
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        about = json.loads(self.library.to_str())
        pre = about["pre_tokenizer"] or {}
        self.cuts = about["normalizer"] is None and (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex", True)) == ("ByteLevel", False, True)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.tokenize = self.library.model.tokenize
        self.end = np.array([end], "<u4").tobytes()
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        #: Units with the numbers of their ids, when they were used last, and their ids one after the other.
        self.units, self.sizes, self.used, self.body, self.turn = pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4"), 0

    def cut(self, text: str) -> str:
        """The text with a NUL between its units; one that has a NUL itself isn't cut."""
        if not self.cuts or "\0" in text or any(s in text for s in self.special):
            return text
        if _BETWEEN.search(text):
            return _CUT.sub("\0", text)
        if not _LINES.search(text):
            text = text.replace("\n", "\0\n\0")
        return text.replace(" ", "\0 ")

    def token(self, text: str) -> bytes:
        """The ids of a text that is one token of the pre-tokenizer."""
        found = self.known.get(text) or self.before.get(text)
        if found is None:
            found = self.model(text.encode().decode("latin-1").translate(_LETTERS))
            if len(text) <= UNIT:
                self.known[text] = found
        return found

    def model(self, letters: str) -> bytes:
        """The ids of one token of the pre-tokenizer, given in the letters of the vocabulary."""
        return array("I", [t.id for t in self.tokenize(letters)]).tobytes()

    def lookup(self, units: list[str]) -> list[bytes]:
        """The ids of distinct units."""
        known, out, others = self.known, [], []
        for i, u in enumerate(units):
            found = known.get(u)
            if found is None:
                found = self.before.get(u)
                if found is None:
                    word = _WORD.fullmatch(u) if self.cuts else None
                    if word is None:
                        others.append(i)
                        found = b""
                    elif end := word[2]:
                        found = self.token(word[1]) + self.token(end)
                    else:
                        found = self.model(_LETTERS[32] + u[1:] if u.isascii() and u[0] == " " else u.encode().decode("latin-1").translate(_LETTERS))
                    if len(u) <= UNIT and not (word and word[2]):
                        known[u] = found
                else:
                    known[u] = found
            out.append(found)
        for i, e in zip(others, self.library.encode_batch_fast([units[i] for i in others], add_special_tokens=False)):
            out[i] = array("I", e.ids).tobytes()
            if units[i] in known:
                known[units[i]] = out[i]
        if 2 * len(known) > UNITS:
            self.known, self.before = {}, known
        return out

    def places(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct units, where their ids begin and how many they have in an array of ids; only units that aren't kept become Python's strings."""
        held = pc.index_in(units, value_set=self.units)
        new = held.is_null()
        fresh = units.filter(new)
        found = self.lookup(fresh.to_pylist())
        at = held.fill_null(0).to_numpy().astype(np.int64)
        at[new.to_numpy(zero_copy_only=False)] = len(self.units) + np.arange(len(fresh))
        sizes = np.concatenate([self.sizes, np.fromiter(map(len, found), np.int64, len(found)) // 4])
        starts, body = np.cumsum(sizes) - sizes, np.concatenate([self.body, np.frombuffer(b"".join(found), "<u4")])
        self.turn += 1
        used = np.concatenate([self.used, np.zeros(len(fresh), np.int64)])
        used[at] = self.turn
        keep = np.concatenate([np.ones(len(self.units), bool), pc.less_equal(pc.utf8_length(fresh), UNIT).to_numpy(zero_copy_only=False)])
        if keep.sum() > UNITS:
            keep &= used > np.sort(used[keep])[-(UNITS // 2) - 1]
        self.units, self.sizes, self.used = pa.concat_arrays([self.units, fresh]).filter(pa.array(keep)), sizes[keep], used[keep]
        self.body = body if keep.all() else body[np.repeat(keep, sizes)]
        return starts[at], sizes[at], body

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text with the end id, as little-endian 32-bit numbers."""
        whole = [i for i, t in enumerate(texts) if "\0" in t]
        cut = pc.split_pattern(pa.array(["" if "\0" in t else self.cut(t) for t in texts], pa.large_string()), "\0")
        units = cut.flatten().dictionary_encode()
        starts, sizes, body = self.places(units.dictionary)
        at = units.indices.to_numpy()
        n = sizes[at]
        ends = np.cumsum(n)
        ids = body[np.repeat(starts[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[cut.offsets.to_numpy()].tolist()
        out = [ids[a:b].tobytes() + self.end for a, b in zip(bounds[:-1], bounds[1:])]
        for i in whole:
            out[i] = array("I", self.library.encode(texts[i], add_special_tokens=False).ids).tobytes() + self.end
        return out


@cache
def encoder(path: str, end: int = END) -> Encoder:
    return Encoder(path, end)


# --- the wavelet matrix ---------------------------------------------------------------------------------------------


def build(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, block: int = BLOCK) -> bytes:
    """The bytes of a shard: documents with their ids and numbers of token ids, and the token ids of all."""
    pack = zstandard.ZstdCompressor(level=1).compress
    planes = max(1, int(ids.max(initial=0)).bit_length())
    nulls = sum(d is None for d in doc_ids)
    own = np.array([0 if d is None else d for d in doc_ids], "<i8")
    documents = pack(struct.pack("<Q", nulls) + np.diff(own, prepend=np.int64(0)).astype("<i8").tobytes() + np.array(counts, "<i8").tobytes())
    kind = np.uint16 if planes <= 16 else np.uint32
    directory, body, now = [], [], ids.astype(kind)
    for level in range(planes):
        bits = (now & kind(1 << (planes - 1 - level))) != 0
        ends, ones, parts = [], [], []
        for at in range(0, len(bits), block):
            own_bits = bits[at : at + block]
            parts.append(pack(np.packbits(own_bits, bitorder="little").tobytes()))
            ends.append(len(parts[-1]))
            ones.append(int(own_bits.sum()))
        directory.append(np.array([len(bits) - sum(ones)], "<u8").tobytes() + np.cumsum(ends, dtype=np.int64).astype("<u8").tobytes() + (np.cumsum(ones, dtype=np.int64) - ones).astype("<u8").tobytes())
        body += parts
        now = np.concatenate([now.take(np.flatnonzero(~bits)), now.take(np.flatnonzero(bits))])  # places are faster than masks here
    return _HEAD.pack(MAGIC, planes | block << 8, len(doc_ids), len(ids), len(documents)) + b"".join([*directory, documents, *body])


class Shard:
    """A shard's file, opened: blocks are read when they are asked for. Places and results of questions are arrays."""

    OPEN = 256  # blocks that stay open

    def __init__(self, data: bytes) -> None:
        magic, kind, self.documents, self.size, length = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        self.planes, self.block = kind & 255, kind >> 8
        self.blocks = -(-self.size // self.block)
        table = np.frombuffer(data, "<u8", self.planes * (1 + 2 * self.blocks), _HEAD.size).astype(np.int64).reshape(self.planes, -1)
        at = _HEAD.size + 8 * table.size
        self.zeros, self.ends, self.ones = table[:, 0], table[:, 1 : 1 + self.blocks], table[:, 1 + self.blocks :]
        self._about, at = data[at : at + length], at + length
        lengths = self.ends[:, -1] if self.blocks else np.zeros(self.planes, np.int64)
        self.starts = at + np.cumsum(lengths) - lengths
        self.data = memoryview(data)
        self._open: dict[tuple[int, int], np.ndarray] = {}
        self._unpack = zstandard.ZstdDecompressor().decompress

    def about(self) -> tuple[list[int | None], np.ndarray]:
        """The documents' ids and numbers of token ids."""
        raw = self._unpack(self._about)
        nulls, n = struct.unpack_from("<Q", raw)[0], self.documents
        own = np.cumsum(np.frombuffer(raw, "<i8", n, 8)).tolist()
        return [None] * nulls + own[nulls:], np.frombuffer(raw, "<i8", n, 8 + 8 * n)

    def raw_bits(self, level: int, block: int) -> np.ndarray:
        """The bytes of a block of a plane."""
        start = self.starts[level] + (self.ends[level, block - 1] if block else 0)
        return np.frombuffer(self._unpack(self.data[start : self.starts[level] + self.ends[level, block]]), np.uint8)

    def bits(self, level: int, block: int) -> np.ndarray:
        """The bits of a block, 0 or 1."""
        if (level, block) not in self._open:
            if len(self._open) >= self.OPEN:
                self._open.clear()
            self._open[level, block] = np.unpackbits(self.raw_bits(level, block), bitorder="little")[: min(self.block, self.size - block * self.block)]
        return self._open[level, block]

    def ranks(self, level: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place (0 to size) the ones of a plane before it, and its bit (0 at the end)."""
        before, bit = np.full(len(places), self.size - self.zeros[level]), np.zeros(len(places), np.int64)
        blocks = places // self.block
        for b in np.unique(blocks[places < self.size]).tolist():
            own, here = self.bits(level, b), np.flatnonzero((blocks == b) & (places < self.size))
            ones, inside = np.concatenate([[0], np.cumsum(own, dtype=np.int64)]), places[here] - b * self.block
            before[here], bit[here] = self.ones[level, b] + ones[inside], own[inside]
        return before, bit

    def access(self, places: np.ndarray) -> np.ndarray:
        """The ids at places."""
        places = np.asarray(places, np.int64)
        if len(places) and not (0 <= places.min() and places.max() < self.size):
            raise IndexError("no such place")
        out = np.zeros(len(places), np.int64)
        for level in range(self.planes):
            before, bit = self.ranks(level, places)
            places = np.where(bit == 1, self.zeros[level] + before, places - before)
            out = out << 1 | bit
        return out

    def span(self, token: int, start: int, stop: int) -> tuple[int, int]:
        """Where, in the order below the last plane, the occurrences of an id among places [start, stop) stand."""
        if token < 0 or token >> self.planes:
            return 0, 0
        edges = np.clip(np.array([start, max(start, stop)], np.int64), 0, self.size)
        for level in range(self.planes):
            before, _ = self.ranks(level, edges)
            edges = self.zeros[level] + before if token >> (self.planes - 1 - level) & 1 else edges - before
        return int(edges[0]), int(edges[1])

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """The occurrences of an id among places [start, stop); from 0 on it is the id's rank."""
        a, b = self.span(token, start, self.size if stop is None else stop)
        return b - a

    def select_bits(self, level: int, one: bool, ks: np.ndarray) -> np.ndarray:
        """The places of the k-th (from 0) ones or zeros of a plane; the directory gives their blocks."""
        before = self.ones[level] if one else np.arange(self.blocks, dtype=np.int64) * self.block - self.ones[level]
        blocks, out = np.searchsorted(before, ks, "right") - 1, np.empty(len(ks), np.int64)
        for b in np.unique(blocks).tolist():
            here = blocks == b
            out[here] = b * self.block + np.flatnonzero(self.bits(level, b) == one)[ks[here] - before[b]]
        return out

    def select(self, token: int, ks: np.ndarray) -> np.ndarray:
        """The places of the k-th occurrences (from 0) of an id."""
        start, stop = self.span(token, 0, self.size)
        ks = np.asarray(ks, np.int64)
        if len(ks) and not (0 <= ks.min() and ks.max() < stop - start):
            raise IndexError("no such occurrence")
        places = start + ks
        for level in reversed(range(self.planes)):
            one = bool(token >> (self.planes - 1 - level) & 1)
            places = self.select_bits(level, one, places - self.zeros[level] if one else places)
        return places

    def locate(self, token: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """All places of an id in [start, stop), in order."""
        first = self.count(token, 0, start)
        return self.select(token, np.arange(first, first + self.count(token, start, stop)))

    def ids(self) -> np.ndarray:
        """All ids in their order: from the last plane up, each undoes its sorting."""
        kind = np.uint16 if self.planes <= 16 else np.uint32
        now = np.zeros(self.size, kind)
        for level in reversed(range(self.planes)):
            raw = [self.raw_bits(level, b) for b in range(self.blocks)]
            bits = np.unpackbits(np.concatenate(raw) if raw else np.zeros(0, np.uint8), bitorder="little")[: self.size] == 1
            z, out = int(self.zeros[level]), np.empty(self.size, kind)
            out[np.flatnonzero(~bits)] = now[:z]
            out[np.flatnonzero(bits)] = now[z:] | kind(1 << (self.planes - 1 - level))
            now = out
        return now.astype(np.uint32)


# --- tables of shards -----------------------------------------------------------------------------------------------

SHARDS = T.StructType([T.StructField(c, T.LongType()) for c in ("shard", "before", "n_documents", "n_ids")] + [T.StructField("data", T.BinaryType())])
#: The questions to a shard that one row of a join carries.
QUESTIONS = 4096


def shards_of(rows: Iterable[tuple[int | None, bytes]], most: int = SHARD_IDS) -> Iterator[tuple[int, int, bytes]]:
    """(documents, ids, bytes) of the shards of ordered documents with their ids."""
    doc_ids: list[int | None] = []
    held: list[bytes] = []
    n = 0

    def done() -> tuple[int, int, bytes]:
        return len(doc_ids), n, build(doc_ids, [len(x) // 4 for x in held], np.frombuffer(b"".join(held), "<u4"))

    for doc_id, ids in rows:
        if held and n + len(ids) // 4 > most:
            yield done()
            doc_ids, held, n = [], [], 0
        doc_ids.append(doc_id)
        held.append(ids)
        n += len(ids) // 4
    if held:
        yield done()


def write_shards(docs: DataFrame, path: str, tokenizer: str, end: int = END, most: int = SHARD_IDS) -> None:
    """Write the ids of docs (doc_id, text) as shards in `path`, a file each. Their numbers ascend with doc_id and leave gaps: partition << 32 | place in it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes]]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 22):
                yield from zip(part.column("doc_id").to_pylist(), encoder(tokenizer, end).encode([t or "" for t in part.column("text").to_pylist()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, before = TaskContext.get().partitionId() << 32, 0
        for i, (documents, n, data) in enumerate(shards_of(rows(batches), most)):
            yield pa.RecordBatch.from_pylist([dict(zip(SHARDS.names, (first | i, before, documents, n, data)))], schema=pa.schema([(c, pa.int64()) for c in SHARDS.names[:-1]] + [("data", pa.binary())]))
            before += n

    key = [F.col("doc_id").asc_nulls_first(), F.col("_tie")]
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = own.withColumn("_tie", F.xxhash64("text")).repartitionByRange(parts, *key).sortWithinPartitions(*key)
    placed.select("doc_id", "text").mapInArrow(run, SHARDS).write.option("maxRecordsPerFile", 1).option("compression", "none").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files of shards."""
    shards = spark.read.schema(SHARDS).parquet(path).withColumn("part", F.shiftright("shard", 32))
    # one row for each partition of the writing job
    sizes = sorted(tuple(r) for r in shards.groupBy("part").agg(F.sum("n_ids")).collect())
    bases = [(part, end - n) for (part, n), end in zip(sizes, accumulate(n for _, n in sizes))]
    based = shards.join(F.broadcast(spark.createDataFrame(bases, "part long, base long")), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard = Shard(data.as_py())
                doc_ids, counts = shard.about()
                body, ends = shard.ids().astype("<u4").tobytes(), np.cumsum(counts)
                crc = [zlib.crc32(body[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(first + ends - counts), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return based.select((F.col("base") + F.col("before")).alias("first"), "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def look_up(shards: DataFrame, asked: DataFrame) -> DataFrame:
    """Answers to the distinct questions asked (shard, token, start, stop): n, how often the token stands among the shard's places [start, stop), and places, where.

    A null start is 0, a null stop the shard's end; a null token, or one that no id can be, stands nowhere. A shard's
    questions meet its file some QUESTIONS at a time.
    """
    own = asked.select("shard", F.struct(F.coalesce("token", F.lit(-1)).cast("long").alias("token"), F.coalesce("start", F.lit(0)).cast("long").alias("start"), F.col("stop").cast("long").alias("stop")).alias("q")).distinct()
    groups = own.groupBy("shard").agg(F.ceil(F.count("*") / QUESTIONS).alias("_groups"))
    grouped = own.join(groups, "shard").groupBy("shard", F.pmod(F.xxhash64("q"), F.col("_groups")).alias("_group")).agg(F.collect_list("q").alias("qs"))
    schema = "shard long, token long, start long, stop long, n long, places array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data, qs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                shard = Shard(data.as_py())
                for q in qs:
                    places = shard.locate(q["token"], q["start"], q["stop"])
                    one = lambda x, kind=pa.int64(): pa.array([x], kind)
                    yield pa.RecordBatch.from_arrays([one(name), one(q["token"]), one(q["start"]), one(q["stop"]), one(len(places)), one(places, pa.list_(pa.int64()))], ["shard", "token", "start", "stop", "n", "places"])

    return shards.select("shard", "data").join(grouped, "shard").select("shard", "data", "qs").mapInArrow(run, schema)


def op12_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as wavelet shards in ascending doc_id order and read back."""
    path = f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}/wavelet-{uuid.uuid4().hex}"
    write_shards(tables(spark, sf_dir, "documents"), path, TOKENIZER)
    return read_documents(spark, path)


QUERIES = {"op12_wavelet_shards": op12_wavelet_shards}
ORACLE_SQL: dict[str, str] = {}
