"""Operator 3: quality classifier with supervised subword embeddings.

Features are the words and word pairs of a text and the character n-grams (3 to 5) that lie in one word or touch its
edges, hashed to 2 ** 18 learned vectors. A document is the average of its vectors; a softmax layer on it gives the classes. Vectors
and layer are trained by stochastic gradient descent in numpy.

Training takes the labelled rows of a bounded sample (TRAIN_ROWS, by a hash of the id), turned into feature counts
where the documents are and fitted in one task; that bound, and one of all their features (TRAIN_FEATURES), keep the
task the same at any size of the corpus and whatever the lengths of its texts. With two
classes the trained model is one number a feature, which every task gets; whole texts are scored where they are.

A null or empty text has no features and gets the bias's score. Rows that repeat or have a null id are scored like any
other; a label without a document, or one that is neither 0 nor 1 (null included), is left out. Without labels every
score is one half.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.staging import tables, tidy
from tessera.llm.textbytes import PRIME, mix, powers, slices

BUCKETS, DIM, GRAMS = 1 << 18, 16, (3, 4, 5)
#: The training task takes at most so many rows, and of these in the order of their keys what fits into so many distinct features in sum.
TRAIN_ROWS, TRAIN_FEATURES = 6000, 1 << 26
EPOCHS, RATE = 6, 0.5
#: Texts are hashed in parts of about so many characters, cut at white space; the features are those of the whole text.
CHUNK = 1 << 18


def spaces_of(chars: np.ndarray) -> np.ndarray:
    return (chars == 0x20) | ((chars >= 9) & (chars <= 13)) | (chars == 0xA0)


def features(chars: np.ndarray, size: int | None = None, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The feature ids, repeats included, of the first `size` code points (all) of a text, and the hash of their last word.

    What follows those only completes n-grams. before: the hash of the word that stands before.
    """
    size = len(chars) if size is None else size
    before = np.zeros(0, np.uint64) if before is None else before
    n = len(chars)
    if not n:
        return np.zeros(0, np.int64), before
    space = spaces_of(chars)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    edge = np.concatenate([[True], space[:size], [True]])
    starts = np.flatnonzero(~edge[1:-1] & edge[:-2])
    ends = np.flatnonzero(~edge[1:-1] & edge[2:]) + 1
    own = mix((total[ends] - total[starts]) * down[starts], 1)
    word = np.concatenate([before, own])
    pair = np.where(word[1:] == word[:-1], np.uint64(0), mix(word[:-1] * PRIME + word[1:], 2))  # a word twice is one feature, whatever the word
    out = [own, pair]
    spaces = np.concatenate([[0], np.cumsum(space)])
    for k in GRAMS:
        if n < k:
            break
        inside = spaces[k - 1 : n] - spaces[1 : n - k + 2]  # white space between the first and the last character
        at = np.flatnonzero(inside[:size] == 0)
        out.append(mix((total[at + k] - total[at]) * down[at], k))
    return (np.concatenate(out) % np.uint64(BUCKETS)).astype(np.int64), word[-1:]


def chunks(text: str | None) -> Iterator[np.ndarray]:
    """The feature ids of a text, part by part; a word longer than CHUNK stays whole."""
    chars = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    at, before = 0, None
    while at < len(chars):
        to = min(at + CHUNK, len(chars))
        if to < len(chars):
            near = np.flatnonzero(spaces_of(chars[at:to]))
            while not len(near) and to < len(chars):
                near = np.flatnonzero(spaces_of(chars[to : to + CHUNK])) + (to - at)
                to = min(to + CHUNK, len(chars)) if not len(near) else to
            to = at + int(near[-1 if near[-1] < CHUNK else 0]) + 1 if len(near) else len(chars)
        ids, before = features(chars[at : to + GRAMS[-1] - 1], to - at, before)
        yield ids
        at = to


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, label, text) -> the text's feature ids and their shares."""
    for batch in batches:
        for key, label, text in zip(*(batch.column(c).to_pylist() for c in ("key", "label", "text"))):
            ids, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for x in chunks(text):
                ids, where = np.unique(np.concatenate([ids, x]), return_inverse=True)
                counts = np.bincount(where, np.concatenate([counts, np.ones(len(x), np.int64)]), len(ids))
            share = (counts / max(counts.sum(), 1)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([label], pa.int32()), pa.array([ids.astype(np.int32).tobytes()], pa.binary()), pa.array([share.tobytes()], pa.binary())], ["key", "label", "ids", "shares"])


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int = 2, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, weights and biases after SGD over rows of (label, ids, shares)."""
    rng = np.random.default_rng(seed)
    vectors = (rng.random((BUCKETS, DIM), np.float32) - 0.5) / DIM
    weights, bias = np.zeros((DIM, classes), np.float32), np.zeros(classes, np.float32)
    steps = max(1, epochs * len(rows))
    for step in range(epochs):
        for k, i in enumerate(rng.permutation(len(rows))):
            label, ids, shares = rows[i]
            lr = rate * (1 - (step * len(rows) + k) / steps)
            mean = shares @ vectors[ids]
            z = mean @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            pull = weights @ p
            weights -= lr * np.outer(mean, p)
            bias -= np.float32(lr * 0.1) * p
            # shares are small: a step of the size of one feature's, as if each were seen alone
            vectors[ids] -= lr * np.sqrt(len(ids), dtype=np.float32) * shares[:, None] * pull
    return vectors, weights, bias


def trainer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key -> the model. A row that doesn't fit into what is left of TRAIN_FEATURES is passed over."""
    data, room = [], TRAIN_FEATURES
    for batch in batches:
        for label, ids, shares in zip(*(batch.column(c) for c in ("label", "ids", "shares"))):
            own = np.frombuffer(ids.as_py(), np.int32)
            if len(own) <= room:
                data.append((label.as_py(), own, np.frombuffer(shares.as_py(), np.float32)))
                room -= len(own)
    if not data:
        return
    vectors, weights, bias = fit(data)
    turn = weights[:, 1] - weights[:, 0]
    yield pa.RecordBatch.from_arrays([pa.array([(vectors @ turn).astype(np.float32).tobytes()]), pa.array([float(bias[1] - bias[0])])], ["weights", "bias"])


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """One weight a feature and a bias. docs (doc_id, text); labels (doc_id, label 0 or 1), of which `most` are taken."""
    taken = labels.where(F.col("label").isin(0, 1)).select("doc_id", "label", F.xxhash64("doc_id").alias("key")).orderBy("key", "doc_id", "label").limit(most)
    rows = docs.join(F.broadcast(taken), "doc_id").select("key", F.col("label").cast("int").alias("label"), "text")
    model = rows.mapInArrow(counted, "key long, label int, ids binary, shares binary").repartition(1).sortWithinPartitions("key", "label", "ids").mapInArrow(trainer, "weights binary, bias double").first()
    if model is None:  # no labelled rows
        return np.zeros(BUCKETS, np.float32), 0.0
    return np.frombuffer(model["weights"], np.float32), model["bias"]


def with_score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", name: str = "score", keep_text: bool = True) -> DataFrame:
    """docs with the probability of class 1 of each whole text; null and empty texts get the bias's."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in docs.schema.fields if keep_text or f.name != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{name}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            for part in slices(batch, text):
                out = []
                for t in part.column(text).to_pylist():
                    total = n = 0
                    for ids in chunks(t):
                        total += weights[ids].sum(dtype=np.float64)
                        n += len(ids)
                    out.append(1 / (1 + np.exp(-np.clip(total / max(n, 1) + bias, -700, 700))))
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in fields), pa.array(out, pa.float64())], [*(f.name for f in fields), name])

    return docs.mapInArrow(tidy(run), schema)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def quality_model(spark: SparkSession, sf_dir: str) -> tuple[np.ndarray, float]:
    """Trained on the labelled documents that aren't held out."""
    labels = tables(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label"))
    return train(tables(spark, sf_dir, "documents").select("doc_id", "text"), labels)


def op3_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs = tables(spark, sf_dir, "documents").select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    scored = with_score(docs, quality_model(spark, sf_dir), keep_text=False)
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


QUERIES = {"op3_subword_quality": op3_subword_quality}
ORACLE_SQL: dict[str, str] = {}
