"""The piece table of a SentencePiece model file."""

from __future__ import annotations

import os
from collections import Counter
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.textbytes import strings, utf8

#: The public model of the tokenizer folder; every operator takes another path.
MODEL = os.path.join(os.environ.get("TESSERA_TOKENIZERS", "/opt/tokenizers"), "piece_bpe_32k.model")
#: The piece table is broadcast; a larger one is refused.
BROADCAST_PIECES = 2_000_000
MARK = "▁"


@dataclass(frozen=True)
class Pieces:
    """Pieces in order of their ids; merges: the model was made by merging pairs (BPE), else it is a unigram model."""

    names: list[str]
    scores: list[float]
    kinds: list[int]  # 1 normal, 2 unknown, 3 control, 6 byte
    merges: bool
    unknown: int = field(default=0)

    @cached_property
    def ids(self) -> dict[str, int]:
        return {x: i for i, (x, k) in enumerate(zip(self.names, self.kinds)) if k == 1}

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.ids), default=1)

    @cached_property
    def byte_base(self) -> int:
        """The id of byte 0, or -1 for a model without byte pieces."""
        return self.kinds.index(6) if 6 in self.kinds else -1

    @cached_property
    def unknown_score(self) -> float:
        return min((s for s, k in zip(self.scores, self.kinds) if k == 1), default=0.0) - 10.0

    def fallback(self, char: str) -> list[int]:
        return [self.byte_base + b for b in char.encode()] if self.byte_base >= 0 else [self.unknown]

    @cached_property
    def raw(self) -> list[bytes]:
        """What each id decodes to, before marks become spaces."""
        return [bytes([i - self.byte_base]) if k == 6 else x.encode() for i, (x, k) in enumerate(zip(self.names, self.kinds))]

    @cached_property
    def irregular(self) -> set[int]:
        """The pieces of a merge model that share their score with another, or that one pass over their pairs by rank doesn't make of their characters.

        In a text whose edges are all regular one pass makes all merges: a pair X that only a later merge made possible
        would have been merged at its own turn, since until then nothing reached over its ends, and X by itself is made
        at its turn.
        """
        times = Counter(self.scores[i] for x, i in self.ids.items() if len(x) > 1)
        return {i for x, i in self.ids.items() if len(x) > 1 and (times[self.scores[i]] > 1 or not self.made_at_once(x))}

    def made_at_once(self, piece: str) -> bool:
        n, ids = len(piece), self.ids
        pairs = sorted((-self.scores[k], i, j) for i in range(n) for j in range(i + 2, n + 1) if (k := ids.get(piece[i:j])) is not None)
        state = (2 << n) - 1
        for _, i, j in pairs:
            inner = (1 << j) - (2 << i)
            if state >> i & 1 and state >> j & 1 and (state & inner).bit_count() == 1:
                state &= ~inner
        return state == 1 | 1 << n

    @cached_property
    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """A class for every code point (0: in no piece of two characters or more), and which class may follow which inside a piece."""
        longer = [x for x in self.ids if len(x) > 1]
        chars = sorted({c for x in longer for c in x})
        kinds = np.zeros(0x110000, np.int16 if len(chars) < 1 << 15 else np.int32)
        kinds[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        pairs = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for x in longer:
            codes = kinds[[ord(c) for c in x]]
            pairs[codes[:-1], codes[1:]] = True
        return kinds, pairs

    def units(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words cut between any two characters that stand side by side in no piece, and the bounds of each word's units.

        No edge of a word's lattice spans such a cut, so the lattice of a word is the chain of its units' lattices.
        """
        data, offsets = utf8(words)
        kinds, pairs = self.neighbours
        codes = kinds[np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)]
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        cuts = starts[1:][~pairs[codes[:-1], codes[1:]]] if len(starts) else starts
        at = np.union1d(cuts, offsets)
        return strings(at, data), np.searchsorted(at, offsets)

    def table(self, spark: SparkSession) -> DataFrame:
        """(piece, id, score) of the normal pieces."""
        if len(self.ids) > BROADCAST_PIECES:
            raise ValueError(f"{len(self.ids)} pieces are more than the {BROADCAST_PIECES} that are broadcast")
        return spark.createDataFrame([(x, i, float(self.scores[i])) for x, i in self.ids.items()], "piece string, id int, score double")


def load_pieces(path: str = MODEL) -> Pieces:
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    found = Pieces([p.piece for p in model.pieces], [p.score for p in model.pieces], [p.type for p in model.pieces], model.trainer_spec.model_type == 2)
    # words are cut before a run of marks and around line feeds, which no piece may span
    assert not any(MARK in x.lstrip(MARK) or "\n" in x for x in found.ids), "pieces of this model span words"
    return found
