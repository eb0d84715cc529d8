"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a one-pass Viterbi search.

The automaton reports at each position all pieces that end there, along its output links; each of
them relaxes the best score of that position. The model's scores are used as they are, so the
result is the segmentation with the largest sum of scores, whatever the model was trained as.
Pieces hold a space mark at their start only, so no piece crosses from one spaced unit into the
next: units are searched one by one and remembered.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm.common import table

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: An unknown character costs this much more than the worst piece.
UNKNOWN_PENALTY = 10.0
#: Units remembered by a worker before it forgets them; speed only.
REMEMBERED = 400_000
#: Rows whose ids a worker holds at a time.
SLICE_ROWS = 256

_UNREACHED = float("-inf")
_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces in the order of their ids; ``kinds`` has n (normal), b (byte), c (control), u (unknown)."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: str


def load_vocabulary(path: str = MODEL_PATH) -> Vocabulary:
    """Read a model file on the driver. A piece with a space mark after another character is refused."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    kind = lambda i: "b" if model.is_byte(i) else "c" if model.is_control(i) else "u" if model.is_unknown(i) else "n"
    found = Vocabulary(
        tuple(map(model.id_to_piece, ids)), tuple(map(model.get_score, ids)), "".join(map(kind, ids))
    )
    crossing = [p for p, k in zip(found.pieces, found.kinds, strict=True) if k == "n" and not re.fullmatch(f"{SPACE}*[^{SPACE}]*", p)]
    if crossing:
        raise ValueError(f"pieces cross from one unit into the next: {crossing[:3]}")
    return found


class _Memory(dict):
    """Units and their ids; a unit that is not there is searched."""

    def __init__(self, search: Callable[[str], tuple[int, ...]]):
        super().__init__()
        self.search = search

    def __missing__(self, unit: str) -> tuple[int, ...]:
        ids = self.search(unit)
        if len(self) >= REMEMBERED:
            self.clear()
        # A very long unit is not worth its room.
        if len(unit) <= 64:
            self[unit] = ids
        return ids


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.automaton = ahocorasick.Automaton()
        self.singles = set()
        self.bytes_of = []
        self.lengths = [len(p) for p in vocabulary.pieces]
        byte_ids = {}
        self.unknown = vocabulary.kinds.index("u")
        worst = 0.0
        for i, (piece, score, kind) in enumerate(zip(vocabulary.pieces, vocabulary.scores, vocabulary.kinds, strict=True)):
            if kind == "b":
                byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
                continue
            self.bytes_of.append({"n": piece, "c": "", "u": " ⁇ "}[kind].encode())
            if kind == "n":
                worst = min(worst, score)
                self.automaton.add_word(piece, (len(piece), i, score))
                if len(piece) == 1:
                    self.singles.add(piece)
        self.automaton.make_automaton()
        self.unknown_score = worst - UNKNOWN_PENALTY
        self.byte_ids = byte_ids if len(byte_ids) == 256 else None
        self.memory = _Memory(self.search)

    def search(self, unit: str) -> tuple[int, ...]:
        """Ids of the best segmentation; of equal scores the one whose later pieces are longer."""
        size = len(unit)
        best = [0.0] + [_UNREACHED] * size
        step = [self.unknown] * (size + 1)
        done = 0 if not self.singles.issuperset(unit) else size
        for last, (length, piece, score) in self.automaton.iter(unit):
            end = last + 1
            if done < end:
                done = self._over_unknown(unit, best, done, end)
            reached = best[end - length] + score
            if reached > best[end]:
                best[end] = reached
                step[end] = piece
        self._over_unknown(unit, best, done, size)
        found: list[int] = []
        while size:
            piece = step[size]
            if piece == self.unknown:
                size -= 1
                if self.byte_ids is None:
                    found.append(piece)
                else:
                    found += [self.byte_ids[b] for b in reversed(unit[size].encode("utf-8", "replace"))]
            else:
                found.append(piece)
                size -= self.lengths[piece]
        found.reverse()
        return tuple(found)

    def _over_unknown(self, unit: str, best: list[float], done: int, end: int) -> int:
        """Positions behind characters that are no piece are reached at the unknown score."""
        for at in range(done, end):
            if unit[at] not in self.singles:
                best[at + 1] = best[at] + self.unknown_score
        return max(done, end)

    def encode(self, text: str) -> np.ndarray:
        """A space is put before the text, and spaces become marks; an empty text has no pieces."""
        if not text:
            return np.zeros(0, np.int32)
        units = _UNIT.findall(SPACE + text.replace(" ", SPACE))
        return np.fromiter(chain.from_iterable(map(self.memory.__getitem__, units)), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text; bytes that are not UTF-8 become U+FFFD, and ids outside the vocabulary fail."""
        if len(ids) and not 0 <= int(np.min(ids)) <= int(np.max(ids)) < len(self.bytes_of):
            raise ValueError("an id is outside the vocabulary")
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def _codec(vocabulary: Vocabulary) -> Codec:
    return Codec(vocabulary)


def decoded(ids: Column, spark: SparkSession, vocabulary: Vocabulary) -> Column:
    """Text of an array of ids; null counts as empty."""
    shared = spark.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(shared.value)
        for arrays in batches:
            yield pd.Series([codec.decode(a) if a is not None else "" for a in arrays], dtype=object)

    return decode.asNondeterministic()(ids)


def encode_documents(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", verify: bool = False) -> DataFrame:
    """``docs`` with piece_ids and n_pieces; all rows and other columns stay as they are.

    Null text counts as empty. With ``verify`` also round_trip: whether decoding gives the text
    back, space marks of its own read as spaces. Columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    added = [T.StructField("piece_ids", T.ArrayType(T.IntegerType(), False)), T.StructField("n_pieces", T.LongType())]
    added += [T.StructField("round_trip", T.BooleanType())] if verify else []
    docs = docs.drop(*(f.name for f in added))
    at = docs.columns.index(text)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            # Few rows at a time: ids take more room than their texts.
            for first in range(0, batch.num_rows, SLICE_ROWS):
                rows = batch.slice(first, SLICE_ROWS)
                texts = [t or "" for t in rows.column(at).to_pylist()]
                ids = [codec.encode(t) for t in texts]
                sizes = np.array([len(i) for i in ids], np.int64)
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                columns = [*rows.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))), pa.array(sizes)]
                if verify:
                    columns.append(pa.array([codec.decode(i) == t.replace(SPACE, " ") for i, t in zip(ids, texts, strict=True)]))
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *(f.name for f in added)])

    return docs.mapInArrow(encode, T.StructType([*docs.schema.fields, *added]))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of the ids, and whether decoding gives the text back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = encode_documents(docs, load_vocabulary(), verify=True)
    digest = F.sha2(F.array_join(F.col("piece_ids").cast("array<string>"), ","), 256)
    return found.select("doc_id", "n_pieces", digest.alias("ids_sha256"), "round_trip")
