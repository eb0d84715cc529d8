"""Repeated passages, byte by byte: shard Burrows-Wheeler transforms merged by interleave refinement.

Question: which bytes lie in a string of 400 bytes that starts anywhere else, too?

1. Every start of a 400-byte window belongs to the run of starts around it whose windows have the
   same smallest 32-byte hash. Equal windows have equal smallest hashes, so they can only meet under
   one key. A run is sent as a digest of all its bytes: a repeated digest settles its whole run, and
   a run that is alone under its key has no repeat. Texts of the others, cut to their runs, go on.
2. These pieces are dealt into bins by key. A bin is read in shards, and each shard becomes a
   Burrows-Wheeler transform over symbols of 100 bytes, taken at every byte offset. Two transforms
   are merged without sorting their suffixes again: a bit per suffix tells its shard, and each round
   deals the bits by preceding symbol, which refines the interleave by one symbol. After four rounds
   suffixes with a common prefix of 400 bytes are neighbours; an interval of two or more is a repeat.
3. A key with more text than a task should hold is not put in a bin: its windows are counted by
   digest instead, one row each, with map-side combine.

Symbols are 32-bit hashes; four of them, 128 bits, stand for a window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.common import staged, table

WINDOW_BYTES = 400
GRAM_BYTES = 32
SYMBOL_BYTES = 100
#: Starts looked at together in a long text.
STRETCH_BYTES = 1 << 20
#: Piece text of a shard and of a bin; a key with more than HOT_BYTES is counted window by window.
SHARD_BYTES = 1 << 20
BIN_BYTES = 2 << 20
HOT_BYTES = 4 << 20

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    with np.errstate(over="ignore"):
        return tuple(
            np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64))])
            for b in (_BASE, pow(_BASE, -1, 1 << 64))
        )


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each ``width`` bytes, the same wherever they stand."""
    size = 1 << max(16, (len(data) + 1).bit_length())
    up, down = _powers(size)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        found = (sums[width:] - sums[:-width]) * down[: len(data) - width + 1]
        found ^= found >> np.uint64(31)
        found *= np.uint64(0xBF58476D1CE4E5B9)
        found ^= found >> np.uint64(29)
    return found


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours, from running minima of fixed blocks."""
    blocks = np.concatenate([values, np.full(-len(values) % width, _MASK, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: len(values) - width + 1], ahead[width - 1 : len(values)])


def runs_of(data: bytes) -> Iterator[tuple[int, int, int, int, int, bool]]:
    """(first start, number of starts, key, two digest halves, whether it may repeat within itself)."""
    width = WINDOW_BYTES - GRAM_BYTES + 1
    for at in range(0, len(data) - WINDOW_BYTES + 1, STRETCH_BYTES):
        part = data[at : at + STRETCH_BYTES + WINDOW_BYTES - 1]
        grams = gram_hashes(np.frombuffer(part, np.uint8), GRAM_BYTES)
        least = sliding_least(grams, width)
        cuts = np.flatnonzero(least[1:] != least[:-1]) + 1
        first = np.concatenate([[0], cuts])
        last = np.concatenate([cuts, [len(least)]])
        for a, b, key in zip(first.tolist(), last.tolist(), least[first], strict=True):
            digest = xxhash.xxh3_128_digest(part[a : b - 1 + WINDOW_BYTES])
            high, low = np.frombuffer(digest, "<i8").tolist()
            twice = bool(np.count_nonzero(grams[a : b - 1 + width] == key) > 1)
            yield at + a, b - a, int(key.view(np.int64)), high, low, twice


class Transform:
    """Burrows-Wheeler transform of a set of texts over symbols of SYMBOL_BYTES bytes.

    Text offsets up to the length are its suffixes; those without a whole symbol left are ends, all
    different, and come first. ``symbols`` holds the symbol before each suffix in sorted order (0:
    none) and ``places`` the number of the suffix; suffixes are sorted by their first ``depth``
    symbols.
    """

    def __init__(self, symbols: np.ndarray, places: np.ndarray, ends: int):
        self.symbols, self.places, self.ends = symbols, places, ends


def dealt(symbols: np.ndarray) -> np.ndarray:
    """Where the suffixes with a preceding symbol stand, stably sorted by it."""
    live = np.flatnonzero(symbols).astype(np.uint64)
    keys = (symbols[live].astype(np.uint64) << np.uint64(32)) | live
    keys.sort()
    return (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)


def transform(texts: list[bytes], first_place: int, depth: int) -> Transform:
    """Sort the suffixes of one shard, symbol by symbol."""
    sizes = np.array([len(t) for t in texts], np.int64)
    # One spare byte after each text: its last suffix is the empty one.
    joined = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8)
    offset = np.arange(len(joined)) - np.repeat(np.cumsum(sizes + 1) - sizes - 1, sizes + 1)
    size = np.repeat(sizes, sizes + 1)
    names = np.maximum(gram_hashes(joined, SYMBOL_BYTES) >> np.uint64(32), np.uint64(1)).astype(np.uint32)
    before = np.zeros(len(joined), np.uint32)
    later = np.flatnonzero(offset >= SYMBOL_BYTES)
    before[later] = names[later - SYMBOL_BYTES]
    ends = np.flatnonzero(offset > size - SYMBOL_BYTES)
    order = np.concatenate([ends, np.flatnonzero(offset <= size - SYMBOL_BYTES)])
    for _ in range(depth):
        order = np.concatenate([ends, order[dealt(before[order])] - SYMBOL_BYTES])
    return Transform(before[order], order + first_place, len(ends))


def merged(left: Transform, right: Transform, depth: int) -> tuple[Transform, np.ndarray]:
    """Interleave two transforms; also the intervals of suffixes with ``depth`` common symbols."""
    total = len(left.symbols) + len(right.symbols)
    ends = left.ends + right.ends
    start = np.concatenate([np.zeros(left.ends, bool), np.ones(right.ends, bool)])
    side = np.concatenate([np.zeros(len(left.symbols), bool), np.ones(len(right.symbols), bool)])
    interval = np.zeros(total, np.int32)
    symbols = np.empty(total, np.uint32)
    for _ in range(depth):
        symbols[~side], symbols[side] = left.symbols, right.symbols
        source = dealt(symbols)
        own, group = symbols[source], interval[source]
        new = np.ones(total, bool)
        new[ends + 1 :] = (own[1:] != own[:-1]) | (group[1:] != group[:-1])
        interval = np.cumsum(new, dtype=np.int32)
        side = np.concatenate([start, side[source]])
    symbols[~side], symbols[side] = left.symbols, right.symbols
    places = np.empty(total, np.int64)
    places[~side], places[side] = left.places, right.places
    return Transform(symbols, places, ends), interval


def repeated_starts(shards: Iterator[list[bytes]]) -> np.ndarray:
    """For all texts of a bin one after the other, each with one place more than it has bytes:
    whether the window that starts there starts anywhere else in the bin."""
    depth = WINDOW_BYTES // SYMBOL_BYTES
    waiting: list[Transform] = []
    total = 0
    interval = None
    for texts in shards:
        new = transform(texts, total, depth)
        total += len(new.places)
        waiting.append(new)
        # Equal sizes are merged first, so a suffix takes part in few merges.
        while len(waiting) > 1 and len(waiting[-2].places) <= 2 * len(waiting[-1].places):
            right, left = waiting.pop(), waiting.pop()
            both, interval = merged(left, right, depth)
            waiting.append(both)
    while len(waiting) != 1 or interval is None:
        right = waiting.pop() if len(waiting) > 1 else Transform(np.zeros(0, np.uint32), np.zeros(0, np.int64), 0)
        both, interval = merged(waiting.pop(), right, depth)
        waiting.append(both)
    twice = np.bincount(interval)[interval] > 1
    found = np.zeros(total, bool)
    found[waiting[0].places[twice]] = True
    return found


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each stretch of true values."""
    edges = np.diff(flags.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1


_RUN = "key long, id long, hash long, first long, starts long, high long, low long, twice boolean"


def _runs(docs: DataFrame) -> DataFrame:
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["key", "id", "hash", "first", "starts", "high", "low", "twice"]
        for batch in batches:
            rows = []
            for doc, text_hash, data in batch.itertuples(index=False):
                for first, starts, key, high, low, twice in runs_of(data):
                    rows.append((key, doc, text_hash, first, starts, high, low, twice))
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    return docs.select("id", "hash", "body").mapInPandas(cut, _RUN)


def _binned(pieces: DataFrame) -> DataFrame:
    """Repeated starts of pieces (bin, key, id, hash, first, piece), as stretches of starts."""

    def search(own: pd.DataFrame) -> pd.DataFrame:
        texts = own["piece"].tolist()
        sizes = np.array([len(t) for t in texts], np.int64)
        shard = np.cumsum(sizes) // SHARD_BYTES
        edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(texts)]
        found = repeated_starts(texts[a:b] for a, b in zip(edges, edges[1:], strict=False))
        first, last = _stretches(found)
        base = np.cumsum(sizes + 1) - sizes - 1
        # The spare place after a text is never a start, so no stretch goes over a border.
        owner = np.searchsorted(base, first, side="right") - 1
        shift = own["first"].to_numpy()[owner] - base[owner]
        return pd.DataFrame(
            {"id": own["id"].to_numpy()[owner], "hash": own["hash"].to_numpy()[owner], "a": first + shift, "b": last + shift}
        )

    return pieces.groupBy("bin").applyInPandas(search, "id long, hash long, a long, b long")


def _counted(pieces: DataFrame) -> DataFrame:
    """The same for pieces of keys with too much text for a task: windows grouped by digest."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, text_hash, first, piece in batch.itertuples(index=False):
                digests = [xxhash.xxh3_128_digest(piece[i : i + WINDOW_BYTES]) for i in range(len(piece) - WINDOW_BYTES + 1)]
                halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                yield pd.DataFrame({"id": doc, "hash": text_hash, "a": first + np.arange(len(digests)), "high": halves[:, 0], "low": halves[:, 1]})

    windows = pieces.select("id", "hash", "first", "piece").mapInPandas(explode, "id long, hash long, a long, high long, low long")
    windows = staged(windows, "windows")
    twice = staged(windows.groupBy("high", "low").count().filter("count > 1").drop("count"), "repeated-windows")
    return windows.join(twice, ["high", "low"], "left_semi").select("id", "hash", "a", F.col("a").alias("b"))


_RESULT = "struct<n_removed:long,n_spans:long,kept_sha256:string,spans:array<struct<start:long,end:long>>>"


def removed(data: bytes, starts: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal removed stretches (end exclusive) for stretches of repeated starts, and what is kept."""
    spans: list[list[int]] = []
    for a, b in sorted(starts):
        end = b + WINDOW_BYTES
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([a, end])
    kept, at = [], 0
    for a, end in spans:
        kept.append(data[at:a])
        at = end
    kept.append(data[at:])
    return [(a, end) for a, end in spans], b"".join(kept)


def _finished(body: Column, starts: Column) -> Column:
    """What is left of a text; null for a null text."""

    @F.pandas_udf(_RESULT)
    def finish(bodies: pd.Series, found: pd.Series) -> pd.DataFrame:
        rows = []
        for data, own in zip(bodies, found, strict=True):
            if data is None:
                rows.append((None, None, None, None))
                continue
            spans, kept = removed(data, [(s["a"], s["b"]) for s in own] if own is not None else [])
            size = sum(end - a for a, end in spans)
            rows.append((size, len(spans), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": e} for a, e in spans]))
        frame = pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept_sha256", "spans"])
        return frame.astype({"n_removed": "Int64", "n_spans": "Int64"})

    return finish(body, starts)


def repeated_passages(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (key, n_bytes, n_removed, n_spans, kept_sha256, spans) for every row of ``docs``.

    spans are the maximal removed byte ranges, end exclusive. Null text counts as empty; a text
    under 400 bytes loses nothing; repeated rows repeat each other and lose all that is in a whole
    window. The key is a whole number or null. Other columns are not read. No rows: no rows.
    """
    spark = docs.sparkSession
    string = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keyed = docs.select(F.col(key).cast("long").alias("doc"), string.cast("binary").alias("body"), F.xxhash64(string).alias("hash"))
    # A null key is a document like any other; its text hash tells it from other ones.
    keyed = keyed.select("doc", F.coalesce("doc", F.lit(-(1 << 63))).alias("id"), "hash", "body")
    runs = staged(_runs(keyed.filter(F.length("body") >= WINDOW_BYTES)), "runs")

    place = F.min(F.struct("id", "hash", "first", "starts")).alias("at")
    digests = runs.groupBy("high", "low").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key"), F.max("twice").alias("twice"), place)
    digests = staged(digests, "run-digests")
    keys = digests.groupBy("key").agg(
        F.count(F.lit(1)).alias("pieces"), F.sum(F.col("at.starts") + WINDOW_BYTES).alias("bytes"),
        F.max("twice").alias("any_twice"), F.max((F.col("n") == 1)).alias("open"),
    )
    # A key needs its texts if a run that is alone could share a part with another one or itself.
    keys = staged(keys.filter("open AND (pieces > 1 OR any_twice)").select("key", "bytes"), "open-keys")
    cool = keys.filter(F.col("bytes") <= HOT_BYTES).agg(F.sum("bytes")).first()[0] or 0
    bins = max(1, -(-int(cool) // BIN_BYTES))

    wanted = digests.join(keys, "key").select(
        "key", "at.*", F.when(F.col("bytes") > HOT_BYTES, -1).otherwise(F.pmod(F.xxhash64("key"), F.lit(bins))).alias("bin")
    )
    wanted = wanted.groupBy("id", "hash").agg(F.collect_list(F.struct("bin", "first", "starts")).alias("wanted"))
    whole = digests.filter("n > 1").select("high", "low")
    settled = runs.join(whole, ["high", "low"], "left_semi")
    settled = settled.select("id", "hash", F.struct(F.col("first").alias("a"), (F.col("first") + F.col("starts") - 1).alias("b")).alias("s"))
    settled = settled.groupBy("id", "hash").agg(F.collect_list("s").alias("settled"))
    about = staged(settled.join(wanted, ["id", "hash"], "full"), "passages")
    first = keyed.join(about, ["id", "hash"], "left")
    needed = F.size(F.coalesce("wanted", F.array().cast("array<struct<bin:int,first:long,starts:long>>"))) > 0
    first = first.select(
        "doc", "id", "hash", F.length("body").cast("long").alias("n_bytes"), "settled", "wanted",
        F.when(needed, F.col("body")).alias("body"), _finished(F.when(~needed, F.col("body")), F.col("settled")).alias("result"),
    )
    first = staged(first, "first-answers")

    open_ = first.filter("body IS NOT NULL")
    pieces = open_.dropDuplicates(["id", "hash"]).select("id", "hash", "body", F.explode("wanted").alias("w"))
    pieces = pieces.select("id", "hash", "body", "w.*")
    piece = F.substring("body", F.col("first").cast("int") + 1, F.col("starts").cast("int") + WINDOW_BYTES - 1)
    pieces = pieces.select("bin", "id", "hash", "first", piece.alias("piece"))
    found = _binned(pieces.filter("bin >= 0")).unionByName(_counted(pieces.filter("bin < 0")))
    found = found.groupBy("id", "hash").agg(F.collect_list(F.struct("a", "b")).alias("found"))
    later = open_.join(staged(found, "found"), ["id", "hash"], "left")
    none = F.array().cast("array<struct<a:long,b:long>>")
    later = later.withColumn("result", _finished(F.col("body"), F.concat(F.coalesce("settled", none), F.coalesce("found", none))))
    columns = [F.col("doc").alias(key), "n_bytes", "result.*"]
    return first.filter("body IS NULL").select(*columns).unionByName(later.select(*columns))


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
