"""Token counts of the documents in flat token files that have no index.

A file is nothing but token ids, each document closed by an end-of-document id. Files are cut into
blocks of fixed size, each block is searched for that id with one vectorised comparison, and what a
document has on both sides of a block border is put together by a prefix scan over one small row
per block. No block needs another one, so a single huge file spreads over all tasks.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import shared_path, spread, staged, table, whole_text
from gaugeworks.llm.files import made_folder, opened, whole_file

RANKS_PATH = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The split pattern that belongs to these ranks, and the id left free for the end of a document.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_OF_DOCUMENT = 50_256
TOKEN_TYPE = "<u2"
BLOCK_BYTES = 4 << 20


@lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=known, special_tokens={})


def write_token_files(docs: DataFrame, folder: str, ranks_path: str = RANKS_PATH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write one flat file per partition to a shared folder; returns (path, ordinal, key).

    A file appears under its name only when it is whole, and a repeated task writes the same one.
    Null text counts as empty: a document without tokens is its end mark alone.
    """
    spark = docs.sparkSession
    with open(ranks_path, "rb") as file:
        ranks = spark.sparkContext.broadcast(file.read())

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(ranks.value, SPLIT_PATTERN)
        name = f"part-{TaskContext.get().partitionId():06d}.bin"
        at = 0
        with whole_file(folder, name) as out:
            for batch in batches:
                for body in batch["text"]:
                    ids = encoding.encode_ordinary(body)
                    ids.append(END_OF_DOCUMENT)
                    out.write(np.array(ids, TOKEN_TYPE).tobytes())
                yield pd.DataFrame({"path": name, "ordinal": range(at, at + len(batch)), "key": batch["key"]})
                at += len(batch)

    made_folder(folder)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), whole_text(text).alias("text"))
    return staged(rows.mapInPandas(write, f"path string, ordinal long, key {kind}"), "token-rows")


def count_tokens(
    spark: SparkSession, folder: str, end: int = END_OF_DOCUMENT, token_type: str = TOKEN_TYPE, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Rows (path, ordinal, n_tokens): the documents of all ``*.bin`` files in ``folder``, in order.

    The end mark does not count. Tokens after the last mark are a document of their own; a file
    without bytes has none. A file whose size is no multiple of the token size fails.
    """
    width = np.dtype(token_type).itemsize
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", "length")
    blocks = files.filter("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0), (F.col("length") - 1), F.lit(block_bytes))).alias("at"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, length, at in batch.itertuples(index=False):
                if length % width:
                    raise ValueError(f"{path}: {length} bytes are no whole number of tokens")
                source, name = opened(path)
                with source.open_input_file(name) as file:
                    ids = np.frombuffer(file.read_at(min(block_bytes, length - at), at), token_type)
                marks = np.flatnonzero(ids == end)
                gaps = np.diff(marks, prepend=-1) - 1
                tail = len(ids) - (marks[-1] + 1 if len(marks) else 0)
                yield pd.DataFrame({"path": [path], "at": [at], "marks": [len(marks)], "gaps": [gaps], "tail": [tail]})

    cut = staged(
        spread(blocks, "path", "at").mapInPandas(search, "path string, at long, marks long, gaps array<long>, tail long"),
        "token-blocks",
    )
    before = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    summary = cut.select("path", "at", "marks", "tail").withColumn("first", F.coalesce(F.sum("marks").over(before), F.lit(0)))
    # Since the last block with a mark: its tail, and whole blocks without one.
    stretch = Window.partitionBy("path", "first").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    since = F.when(F.col("marks") == 0, F.col("tail")).otherwise(0)
    summary = summary.withColumn("carried", F.coalesce(F.sum(since).over(stretch), F.lit(0)))
    ends = summary.filter("marks > 0").groupBy("path", (F.col("first") + F.col("marks")).alias("first")).agg(F.max("tail").alias("opening"))
    summary = summary.join(ends, ["path", "first"], "left").withColumn("carried", F.col("carried") + F.coalesce("opening", F.lit(0)))
    closed = cut.select("path", "at", "gaps").join(summary.select("path", "at", "first", "carried"), ["path", "at"])
    closed = closed.select("path", "first", "carried", F.posexplode("gaps").alias("i", "gap"))
    closed = closed.select(
        "path", (F.col("first") + F.col("i")).alias("ordinal"),
        (F.col("gap") + F.when(F.col("i") == 0, F.col("carried")).otherwise(0)).alias("n_tokens"),
    )
    whole = summary.groupBy("path").agg(F.sum("marks").alias("ordinal"), F.max_by(F.struct("marks", "tail", "carried"), "at").alias("last"))
    left = F.col("last.tail") + F.when(F.col("last.marks") == 0, F.col("last.carried")).otherwise(0)
    return closed.unionByName(whole.select("path", "ordinal", left.alias("n_tokens")).filter("n_tokens > 0"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat files that are first written from the texts."""
    folder = shared_path(spark, "tokens")
    rows = write_token_files(table(spark, sf_dir, "documents"), folder)
    counted = count_tokens(spark, folder).withColumn("path", F.substring_index("path", "/", -1))
    return rows.join(counted, ["path", "ordinal"], "left").select(F.col("key").alias("doc_id"), "n_tokens")
