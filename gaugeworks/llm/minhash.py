"""Near copies by MinHash bands, odd sketches and a check of whole shingle sets.

Each set of three-word shingles gives 200 minima. Five at a time they name 40 buckets, and two sets of
similarity 0.85 miss each other in all 40 once in 10 ** 10 pairs; there is no other way to lose a
link. The minima are also folded into an odd sketch, 512 parity bits: where two sets differ in m
minima, the bits of their exclusive or that are set come from 2 m tosses, so their number tells high
similarities sharply. Pairs of a bucket are let through up to the number of bits that a pair at the
threshold passes again once in 10 ** 10 times, and what is let through is checked on the words.

Equal sets are one node from the start. A large group of near copies is not expanded into pairs:
first every node is compared with one node of each of its buckets, the one that meets most others;
only nodes that are then still in different groups of a bucket are compared, where they share one of
the rarest shingles that two sets of the similarity cannot avoid to share (a prefix filter, which
loses nothing).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from fractions import Fraction
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm.common import staged, table, whole_text
from gaugeworks.llm.components import components
from gaugeworks.llm.similar import possible, postings

WORDS = 3
SIMILARITY = Fraction(17, 20)
BANDS, BAND_ROWS = 40, 5
SAMPLES = BANDS * BAND_ROWS
SKETCH_BITS, SKETCH_LONGS = 512, 8
#: Part of the pairs at the threshold that the sketch may turn away.
LOSS = 1e-10
#: Words whose texts are worked on together; a longer text is a batch of its own.
BATCH_WORDS = 400_000
#: Rows that go to a Python worker at once.
BATCH_TEXTS, BATCH_PAIRS = 1000, 250
#: So many different words make three-word codes that fit 63 bits.
CODED_WORDS = 2_000_000
#: Values of one block of minima, to stay in a core's cache.
BLOCK = 1 << 17

_U = np.uint64
_FACTORS = np.random.default_rng(12).integers(0, 1 << 32, (2, SAMPLES), dtype=np.uint64).astype(np.uint32)
_FACTORS[0] |= 1
_PARITY = [f"s{i}" for i in range(SKETCH_LONGS)]
_SCHEMA = "key string, h1 long, h2 long, n long, d1 long, d2 long, bands array<long>, " + ", ".join(f"{s} long" for s in _PARITY)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str) -> set[tuple[bytes, ...]]:
    """Three-word shingles; the whole sequence of fewer words; nothing without words."""
    words = words_of(text)
    if len(words) < WORDS:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(WORDS)), strict=False))


def shingle_hashes(texts: list[list[bytes]]) -> list[np.ndarray]:
    """Hashes of the distinct shingles of each text. Which are distinct is told by the words."""
    sizes = [len(t) for t in texts]
    words = np.empty(sum(sizes), object)
    words[:] = [w for t in texts for w in t]
    ids, names = pd.factorize(words)
    hashes = _mix(np.fromiter((xxhash.xxh64_intdigest(w) for w in names), np.uint64, len(names)))[ids]
    ids = ids.astype(np.int64)
    pairs, many = ids[:-1] * len(names) + ids[1:], len(names)
    if many > CODED_WORDS:
        pairs, _ = pd.factorize(pairs)
    codes = pairs[:-1] * many + ids[2:] if len(ids) > 2 else pairs[:0]
    mixed = _mix(_mix(_mix(hashes[:-2]) + hashes[1:-1]) + hashes[2:]) if len(ids) > 2 else hashes[:0]
    found, at = [], 0
    for size in sizes:
        if size >= WORDS:
            _, first = np.unique(codes[at : at + size - 2], return_index=True)
            found.append(mixed[at + first])
        elif size:
            found.append(_mix(hashes[at : at + size].cumsum()[-1:] * _U(3) + hashes[at : at + 1] + _U(size)))
        else:
            found.append(hashes[:0])
        at += size
    return found


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of each sampling function over a set, which must not be empty."""
    low = (hashes >> _U(32)).astype(np.uint32)
    found = np.full(SAMPLES, np.iinfo(np.uint32).max, np.uint32)
    step = BLOCK // SAMPLES
    for i in range(0, len(low), step):
        values = _FACTORS[0][:, None] * low[i : i + step]
        values += _FACTORS[1][:, None]
        np.minimum(found, values.min(axis=1), out=found)
    return found


def band_keys(least: np.ndarray) -> np.ndarray:
    """Bucket names of each row of minima."""
    rows = least.reshape(len(least), BANDS, BAND_ROWS).astype(np.uint64)
    keys = np.broadcast_to(_mix(np.arange(1, BANDS + 1, dtype=np.uint64)), rows.shape[:2])
    for k in range(BAND_ROWS):
        keys = _mix(keys + rows[:, :, k] * _U(0x9E3779B97F4A7C15))
    return keys.view(np.int64)


def odd_sketches(least: np.ndarray) -> np.ndarray:
    """Parity bits of each row of minima, as whole numbers of 64 bits."""
    number = np.arange(1, SAMPLES + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)
    bit = (_mix(least.astype(np.uint64) + number) % _U(SKETCH_BITS)).astype(np.int64)
    bit += np.arange(len(least))[:, None] * SKETCH_BITS
    parity = np.bincount(bit.ravel(), minlength=len(least) * SKETCH_BITS).astype(np.uint8) & 1
    return np.packbits(parity.reshape(len(least), SKETCH_BITS), axis=1).view(np.int64)


@cache
def bits_allowed(least: Fraction = SIMILARITY, loss: float = LOSS) -> int:
    """The number of odd bits that a pair of this similarity exceeds with no more than this chance."""
    odd = np.zeros(SKETCH_BITS + 1)
    odd[0] = 1.0
    states = np.arange(SKETCH_BITS + 1) / SKETCH_BITS
    total = np.zeros(SKETCH_BITS + 1)
    chance = float(least) ** SAMPLES
    for differing in range(SAMPLES + 1):
        total += chance * odd
        chance *= (SAMPLES - differing) / (differing + 1) * float(1 - least) / float(least)
        for _ in range(2):
            up, down = odd * (1 - states), odd * states
            odd = np.concatenate([[0.0], up[:-1]]) + np.concatenate([down[1:], [0.0]])
    beyond = total[::-1].cumsum()[::-1]
    return int(np.flatnonzero(beyond > loss)[-1])


def differing_bits(a: str, b: str) -> Column:
    """How many bits of two sketches differ."""
    return sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in _PARITY[1:]), F.bit_count(F.col(f"{a}.s0").bitwiseXOR(F.col(f"{b}.s0"))))


def estimated(bits: Column) -> Column:
    """Similarity that so many differing bits stand for; null beyond what a sketch can tell."""
    left = 1 - 2 * bits / F.lit(SKETCH_BITS)
    return F.when(left > 0, F.greatest(F.lit(0.0), 1 + SKETCH_BITS / (4 * SAMPLES) * F.log(left)))


@contextmanager
def batches_of(frame: DataFrame, rows: int) -> Iterator[None]:
    """What is written inside goes to Python in batches of so many rows: texts may be long."""
    conf, name = frame.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, str(rows))
    try:
        yield
    finally:
        conf.set(name, before)


def _word_batches(bodies: pd.Series) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Where each batch of texts begins, and their words."""
    begin, held, size = 0, [], 0
    for at, text in enumerate(bodies):
        words = words_of(text)
        if held and size + len(words) > BATCH_WORDS:
            yield begin, held
            begin, held, size = at, [], 0
        held.append(words)
        size += len(words)
    if held:
        yield begin, held


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for begin, words in _word_batches(batch["body"]):
            hashes = shingle_hashes(words)
            least = np.stack([minima(h) if len(h) else np.zeros(SAMPLES, np.uint32) for h in hashes])
            digest = np.array([np.frombuffer(xxhash.xxh3_128_digest(np.sort(h).tobytes()), np.int64) for h in hashes])
            found = batch[["key", "h1", "h2"]].iloc[begin : begin + len(words)].assign(n=[len(h) for h in hashes], d1=digest[:, 0], d2=digest[:, 1])
            found["bands"] = list(band_keys(least))
            found[_PARITY] = odd_sketches(least)
            yield found


def bodies_of(wanted: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (node, body) of the wanted nodes."""
    ends = wanted.join(nodes.select("node", "rep"), "node")
    ends = ends.select("node", F.col("rep.key").alias("k"), F.col("rep.h1").alias("e1"), F.col("rep.h2").alias("e2"))
    # By key as well: the copies of one text lie in many partitions, and one of them is taken.
    same = F.col("key").eqNullSafe(F.col("k")) & (F.col("h1") == F.col("e1")) & (F.col("h2") == F.col("e2"))
    return staged(texts.join(ends, same).select("node", "body").dropDuplicates(["node"]), "bodies")


def confirmed(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, least: Fraction) -> DataFrame:
    """Rows (a, b, common, both) of the pairs (a, b) that have the similarity, counted on their words."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def counted(one: pd.Series, two: pd.Series) -> pd.Series:
        found, last, known = [], None, set()
        for a, b in zip(one, two, strict=True):
            if a != last:
                last, known = a, shingle_set(a)
            other = shingle_set(b)
            common = len(known & other)
            found.append([common, len(known) + len(other) - common])
        return pd.Series(found)

    pairs = staged(pairs, "pairs")
    bodies = bodies_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, texts)
    found = pairs.join(bodies.select(F.col("node").alias("a"), F.col("body").alias("one")), "a")
    found = found.join(bodies.select(F.col("node").alias("b"), F.col("body").alias("two")), "b")
    found = found.select("a", "b", counted("one", "two").alias("c")).select("a", "b", F.col("c")[0].alias("common"), F.col("c")[1].alias("both"))
    with batches_of(found, BATCH_PAIRS):
        return staged(found.filter(F.col("common") * least.denominator >= F.col("both") * least.numerator), "links")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def signed_sets(docs: DataFrame, text: str, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts (key, h1, h2, body), rows (key, n, d1, d2), and nodes: the distinct sets that are not
    empty, with their sketches and bands and the text that stands for them."""
    body = whole_text(text)
    texts = docs.select(F.col(key).cast("string").alias("key"), F.xxhash64(F.lit(0), body).alias("h1"), F.xxhash64(F.lit(1), body).alias("h2"), body.alias("body"))
    with batches_of(texts, BATCH_TEXTS):
        signed = staged(texts.mapInPandas(_signed, _SCHEMA), "signed")
    first = F.min(F.struct(F.col("key").isNull().alias("unnamed"), F.col("key").cast("decimal(20,0)").alias("number"), "key", "h1", "h2")).alias("rep")
    carried = [F.any_value(c).alias(c) for c in ("n", "bands", *_PARITY)]
    nodes = signed.filter("n > 0").groupBy("d1", "d2").agg(first, F.count(F.lit(1)).alias("rows"), *carried)
    nodes = staged(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    return texts, signed.select("key", "n", "d1", "d2"), nodes


def similar_links(texts: DataFrame, nodes: DataFrame, least: Fraction = SIMILARITY) -> DataFrame:
    """Links (a, b, common, both) that hold the groups together: every two nodes of the similarity are
    linked, or in one group by others."""
    posts = nodes.select("node", F.explode("bands").alias("bucket"))
    sizes = posts.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    met = staged(posts.join(sizes, "bucket"), "met")
    weight = met.groupBy("node").agg(F.sum(F.col("m") - 1).alias("weight"))
    centre = met.join(weight, "node").groupBy("bucket").agg(F.max(F.struct("weight", "node")).alias("c"))
    star = met.join(centre.select("bucket", F.col("c.node").alias("y")), "bucket").filter("node <> y")
    star = _ordered(star.select(F.col("node").alias("x"), "y"))

    signs = nodes.select("node", "n", *_PARITY)
    one, two = signs.alias("u"), signs.alias("v")
    allowed = bits_allowed(least)
    near = (differing_bits("u", "v") <= allowed) & _sizes_allow("u", "v", least)
    star = star.join(one, F.col("a") == F.col("u.node")).join(two, F.col("b") == F.col("v.node")).filter(near).select("a", "b")
    links = confirmed(star, nodes, texts, least)
    groups = staged(components(links.select("a", "b")), "groups")

    # What is apart and shares a bucket meets by the rarest shingles of which a similar pair shares one.
    placed = met.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("bucket")
    open_ = staged(placed.join(apart, "bucket").select("node", "root").distinct(), "apart")
    bodies = bodies_of(open_.select("node"), nodes, texts)
    with batches_of(bodies, BATCH_TEXTS):
        rare = postings(bodies, WORDS, least).drop("prefix").join(open_, "node")
    mixed = rare.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("shingle")
    rest = staged(rare.join(mixed, "shingle").join(signs.drop("n"), "node"), "rest")
    meets = (F.col("u.shingle") == F.col("v.shingle")) & (F.col("u.node") < F.col("v.node")) & (F.col("u.root") != F.col("v.root"))
    apart_pairs = rest.alias("u").join(rest.alias("v"), meets & possible("u", "v", least) & near)
    pairs = _ordered(apart_pairs.select(F.col("u.node").alias("x"), F.col("v.node").alias("y"))).join(star, ["a", "b"], "left_anti")
    return links.unionByName(confirmed(pairs, nodes, texts, least))


def _sizes_allow(a: str, b: str, least: Fraction) -> Column:
    low, high = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return low * least.denominator >= high * least.numerator


def near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", least: Fraction = SIMILARITY) -> DataFrame:
    """Rows (key, n_shingles, component_id, kept) for every row of ``docs``.

    Rows whose three-word shingle sets have the Jaccard similarity are linked; component_id is the
    smallest key that a row reaches over links, its own included, and a row is kept if that is its own.
    A text of fewer words is one shingle. Null text counts as empty; a text without words has no
    shingle and is linked with nothing. A null key is greater than any other: a component of such
    rows alone has a null id and all of them are kept. Rows that share a key and a group are judged
    alike. Other columns are not read. An empty table gives an empty table.
    """
    texts, rows, nodes = signed_sets(docs, text, key)
    links = similar_links(texts, nodes, least)
    groups = staged(components(links.select("a", "b")), "groups")
    own = nodes.select("node", "d1", "d2", "rows", F.col("rep.number").alias("least"))
    linked = own.join(groups, "node")
    lowest = linked.groupBy("root").agg(F.min("least").alias("component"))
    marked = linked.join(lowest, "root").select("d1", "d2", "component")
    copies = own.join(groups, "node", "left_anti").filter("rows > 1").select("d1", "d2", F.col("least").alias("component"))
    marked = staged(marked.unionByName(copies).withColumn("marked", F.lit(True)), "marked")
    kind = docs.schema[key].dataType
    found = rows.join(marked, ["d1", "d2"], "left")
    component = F.when(F.col("marked"), F.col("component").cast(kind)).otherwise(F.col("key").cast(kind))
    found = found.select(F.col("key").cast(kind).alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return found.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))
