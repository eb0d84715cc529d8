"""Quality classifier by compression: one zstandard dictionary per label, calibrated difference.

A text is cut into short pieces, each piece is compressed once with the dictionary built from good
text and once with the one built from bad text, and the difference of the two sizes over the bytes
of the whole text says which of them it resembles. A logistic curve fitted on other labelled rows
turns that number into the probability of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.common import table, whole_text

FOLDS = 5
THRESHOLD = 0.3
#: Bytes compressed at a time: short, so that the dictionary and not the text itself decides.
PIECE_BYTES = 512
DICTIONARY_BYTES = 112_640
LEVEL = 3
#: Bounds of the sample that is fitted on: labelled rows per label for a dictionary, pieces of
#: their texts per label, and labelled rows for the calibration.
DICTIONARY_ROWS = 4_000
DICTIONARY_PIECES = 10_000
CALIBRATION_ROWS = 12_000


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    intercept: float


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def pieces(text: str, size: int = PIECE_BYTES) -> list[bytes]:
    body = text.encode("utf-8", "replace")
    return [body[i : i + size] for i in range(0, len(body), size)]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False
    )


def difference(text: str, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> float:
    """Compressed size as bad text less the size as good text, per byte; 0 for an empty text."""
    total = gap = 0
    for piece in pieces(text):
        total += len(piece)
        gap += len(bad.compress(piece)) - len(good.compress(piece))
    return gap / total if total else 0.0


def resemblance(text: Column, good: bytes, bad: bytes) -> Column:
    """Normalised compressed-size difference of whole texts."""

    @F.pandas_udf("double")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        as_good, as_bad = _compressor(good), _compressor(bad)
        for texts in batches:
            yield pd.Series([difference(t, as_good, as_bad) for t in texts], dtype="float64")

    # Not to be computed again in a filter on its result.
    return measure.asNondeterministic()(text)


def _drawn(labels: DataFrame, rows: int, salt: int) -> DataFrame:
    """At most ``rows`` labelled rows, in the order of a hash of their key."""
    return labels.orderBy(F.xxhash64("doc_id", F.lit(salt)), "doc_id").limit(rows)


def _dictionary(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: int) -> bytes:
    chosen = _drawn(labels.filter(F.col("quality") == label), DICTIONARY_ROWS, 1)
    # The sample is bounded by DICTIONARY_ROWS rows of one number.
    texts = docs.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi").select("doc_id", whole_text().alias("text"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, text in zip(batch["doc_id"], batch["text"], strict=True):
                found = pieces(text)
                yield pd.DataFrame({"doc_id": key, "at": range(len(found)), "piece": found})

    cuts = texts.mapInPandas(cut, "doc_id long, at long, piece binary")
    sample = cuts.orderBy(F.xxhash64("doc_id", "at"), "doc_id", "at", "piece").limit(DICTIONARY_PIECES).toPandas()
    found = [bytes(p) for p in sample["piece"] if len(p) >= 8]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, found).as_bytes()
    except (zstandard.ZstdError, ValueError):
        # Too little text to choose from: all of it is the dictionary.
        return b"".join(found)[-DICTIONARY_BYTES:] or b"\n" * 8


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a lightly regularised logistic curve (Newton steps); flat without rows."""
    if not len(x):
        return 0.0, 0.0
    scale = float(np.std(x)) or 1.0
    design = np.column_stack([x / scale, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2), design.T @ (y - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-10:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Dictionaries from one half of the labelled rows outside the held-out fold, the curve from
    the other half; both samples are bounded by the parameters above. A key with several labels
    counts with the largest; rows without key or label are not used."""
    spark = docs.sparkSession
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    half = F.pmod(F.xxhash64("doc_id", F.lit(0)), F.lit(2)) == 0
    good, bad = (_dictionary(spark, docs, known.filter(half), label) for label in (1, 0))
    chosen = F.broadcast(_drawn(known.filter(~half), CALIBRATION_ROWS, 2))
    rows = docs.join(chosen, "doc_id").select("quality", resemblance(whole_text(), good, bad).alias("x")).toPandas()
    slope, intercept = _logistic(rows["x"].to_numpy(float), rows["quality"].to_numpy(float))
    return Model(good, bad, slope, intercept)


def probability(text: Column, model: Model) -> Column:
    x = resemblance(text, model.good, model.bad)
    return 1 / (1 + F.exp(-(x * model.slope + model.intercept)))


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from THRESHOLD on); every row and column stays.

    Only the text counts. Null counts as empty, and an empty text gets the score of a difference
    of zero. Equal texts get equal scores. Columns named score or predicted are replaced.
    """
    marked = docs.withColumn("score", probability(whole_text(text), model))
    return marked.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def accepted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of ``docs`` that are not rejected, by a model fitted on ``docs`` and the labels."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    return docs.withColumn("__score", probability(whole_text(), model)).filter(F.col("__score") >= THRESHOLD).drop("__score")
