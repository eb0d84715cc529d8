"""Near copies by SimHash: fingerprints near each other, an exact check by Jaccard similarity of word
shingles, components.

Near copies have fingerprints of few differing bits, at 0.8 similarity about 20 of 128. No tree or
table finds all pairs within that distance without comparing most of them, so fingerprints are
compared where texts meet at a rare shingle, and only of texts that can have a near copy:

1. A text with a similar one shares at least a part t of its shingles with it. A sample of each set,
   drawn by hash, tells which texts cannot (:func:`candidates`); of the others all shingles are
   counted, and those with less than that part in other texts go (:func:`prefix_rows`).
2. Two texts whose shingle sets of n and m have similarity t or more share at least t / (1 + t) (n + m)
   shingles. In one order of all shingles, rarest first, the first n - ceil(t n) + 1 of one set and
   those of the other then have a member in common, so only texts that share such a shingle are
   compared and no pair is lost.
3. Of the pairs that meet, those whose fingerprints are near go on, and where a group is not joined by
   one text also those with enough common marks, short hashes of up to MARKS shingles. Each one that
   is left is checked on all its shingles.

A bit of two sets of the least similarity differs with probability 0.162 at most from 8 shingles on
and 0.188 below (exact sums over all sizes up to 150, falling to 0.152), so a radius loses one such
pair in 10^10; so do the marks, and the sample less than that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import keep_rows, staged, whole_text
from gaugeworks.llm.components import components
from gaugeworks.llm.simhash import set_fingerprint

SHINGLE_WORDS = 5
SIMILARITY = Fraction(4, 5)
HASH_SEED = 42
#: Texts whose shingles are counted for the order, the counters they share, and the tasks that count.
SAMPLE_TEXTS = 10_000
COUNTERS = 1 << 19
COUNT_TASKS = 8

#: Bits of 128 in which similar sets differ at most, by the size of the smaller set. For similarities
#: of 0.8 and more; a smaller one has no radius.
SMALL_SET = 8
RADIUS, SMALL_RADIUS = 50, 56
RADIUS_SIMILARITY = Fraction(4, 5)

#: A similar pair has so many sampled shingles in common on average; with MET of them a text goes on. A
#: sum of Poisson terms: fewer than MET of 38 is one pair in 4 * 10^10.
SAMPLED, MET = 38, 6
#: Words of 64 bits in the table that tells which texts go on.
FILTER_WORDS = 1 << 20
#: Texts whose sets are held together.
TEXTS_AT_ONCE = 500
#: Marks of a set on average, the set itself if it is no larger; chance to lose a similar pair by them.
MARKS = 256
MARK_LOSS = 1e-10

_POSTING = "shingle long, node long, n int, at int"
_PRINT = ("f0", "f1")


def shingles_of(text: str, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Distinct shingle hashes of a text, sorted; a text of fewer words is one shingle."""
    parts = text.encode("utf-8", "replace").lower().split()
    if len(parts) < words:
        grams: Iterator[bytes] = iter([b" ".join(parts)])
    else:
        grams = map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, HASH_SEED) for g in grams), dtype=np.uint64))


def prefix_length(n: int, least: Fraction) -> int:
    return n - -(-n * least.numerator // least.denominator) + 1


def shingle_counts(texts: DataFrame, words: int) -> np.ndarray:
    """In how many texts of a sample the shingles of each counter occur; each task sends one row of counters."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for text in batch["body"]:
                total += np.bincount((shingles_of(text, words) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        yield pd.DataFrame({"counts": [total.astype(np.int32).tobytes()]})

    share = min(1.0, SAMPLE_TEXTS / max(1, texts.count()))
    sample = texts.filter(F.pmod(F.xxhash64("node"), F.lit(2**31)) < int(share * 2**31))
    found = sample.select("body").repartition(COUNT_TASKS).mapInPandas(counted, "counts binary")
    counts = np.zeros(COUNTERS, np.int32)
    for row in found.toLocalIterator():
        counts += np.frombuffer(row["counts"], np.int32)
    return counts


def prefixes(texts: DataFrame, words: int, least: Fraction, prints: bool = False) -> DataFrame:
    """Rows (shingle, node, n, at): the shingles of each prefix and their places, with the set size; with
    ``prints`` also f0 and f1, the fingerprint of the set."""
    shared = texts.sparkSession.sparkContext.broadcast(shingle_counts(texts, words))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = shared.value
        for batch in batches:
            parts, marks = [], []
            for node, text in zip(batch["node"], batch["body"], strict=True):
                own = shingles_of(text, words)
                if prints:
                    marks.append(set_fingerprint(own))
                own = own[np.argsort(counts[(own % np.uint64(COUNTERS)).astype(np.int64)], kind="stable")]
                parts.append((own[: prefix_length(len(own), least)].view(np.int64), node, len(own)))
            sizes = [len(p[0]) for p in parts]
            columns = {
                "shingle": np.concatenate([p[0] for p in parts]),
                "node": np.repeat([p[1] for p in parts], sizes),
                "n": np.repeat([p[2] for p in parts], sizes).astype(np.int32),
                "at": np.concatenate([np.arange(s, dtype=np.int32) for s in sizes]),
            }
            if prints:
                columns |= {f: np.repeat([m[i] for m in marks], sizes) for i, f in enumerate(_PRINT)}
            yield pd.DataFrame(columns)

    return texts.mapInPandas(cut, ", ".join([_POSTING, *(f"{f} long" for f in _PRINT if prints)]))


def prefix_of(n: Column, least: Fraction) -> Column:
    """:func:`prefix_length` of a column."""
    n = n.cast("long")
    return n - F.call_function("div", n * least.numerator + (least.denominator - 1), F.lit(least.denominator)) + 1


def postings(texts: DataFrame, words: int, least: Fraction) -> DataFrame:
    """The prefixes, written, each row with the length of its prefix."""
    return staged(prefixes(texts, words, least).withColumn("prefix", prefix_of(F.col("n"), least).cast("int")), "postings")


def possible(a: str, b: str, least: Fraction) -> Column:
    """Whether sets can reach the similarity if this is their first common shingle: by what is left of
    both after it, which also bounds the sizes."""
    up, down = least.numerator, least.denominator
    left = F.least(F.col(f"{a}.n") - F.col(f"{a}.at"), F.col(f"{b}.n") - F.col(f"{b}.at")).cast("long")
    return left * (up + down) >= (F.col(f"{a}.n") + F.col(f"{b}.n")).cast("long") * up


def enough(a: Column, b: Column, common: Column, least: Fraction) -> Column:
    """Whether sets of a and b shingles whose prefixes have ``common`` shingles in common can reach the
    similarity: no more than what lies behind one of the prefixes can be added."""
    up, down = least.numerator, least.denominator
    behind = F.greatest(a - prefix_of(a, least), b - prefix_of(b, least))
    return (common + behind) * (up + down) >= (a + b).cast("long") * up


def near(a: str, b: str) -> Column:
    """Whether two fingerprints are within the radius."""
    bits = [F.bit_count(F.col(f"{a}.{f}").bitwiseXOR(F.col(f"{b}.{f}"))) for f in _PRINT]
    small = F.least(F.col(f"{a}.n"), F.col(f"{b}.n")) < SMALL_SET
    return bits[0] + bits[1] <= F.when(small, SMALL_RADIUS).otherwise(RADIUS)


def below(own: np.ndarray, top: int, bottom: int) -> np.ndarray:
    """The sorted hashes under the bound that so large a part (top / bottom) of all hashes is under."""
    bound = min((top << 64) // bottom, (1 << 64) - 1)
    return own[: np.searchsorted(own, np.uint64(bound), "right")]


def marks_of(own: np.ndarray) -> tuple[int, np.ndarray]:
    """How many shingles of a set are drawn by their hashes, and 16 bits of each, without repeats."""
    drawn = below(own, MARKS, len(own))
    return len(drawn), np.unique(drawn.astype(np.uint16)).view(np.int16)


def sampled(texts: DataFrame, words: int, least: Fraction) -> DataFrame:
    """Rows (shingle, node, need): of each text the shingles whose hash is below a bound, which falls with
    the size of the set, and how many of them a similar text must have too."""
    up, down = least.numerator, least.denominator

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts, needs = [], []
            for text in batch["body"]:
                own = shingles_of(text, words)
                parts.append(below(own, SAMPLED * down, up * len(own)).view(np.int64))
                needs.append(min(MET, -(-len(own) * up // down)))
            sizes = [len(p) for p in parts]
            columns = {"shingle": np.concatenate(parts), "node": np.repeat(batch["node"].to_numpy(), sizes), "need": np.repeat(needs, sizes).astype(np.int32)}
            yield pd.DataFrame(columns)

    return texts.mapInPandas(cut, "shingle long, node long, need int")


def candidates(texts: DataFrame, words: int, least: Fraction) -> DataFrame:
    """Rows (node, n, f0, f1, drawn, marks, shingles) of every text that can have a similar one, by its sampled shingles,
    and of a few others: which texts go on is told by a table of bits, one bit for what hashes to it."""
    rows = met_rows(sampled(texts, words, least))
    going = rows.groupBy("node").agg(F.count(F.lit(1)).alias("met"), F.first("need").alias("need")).filter("met >= need")

    def place(frame: DataFrame) -> DataFrame:
        at = F.pmod("node", F.lit(64 * FILTER_WORDS))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))
        return frame.withColumns({"word": F.shiftright(at, 6), "bit": bit})

    table = staged(place(going).groupBy("word").agg(F.bit_or("bit").alias("bits")), "text-filter")
    passed = place(texts).join(F.broadcast(table), "word").filter(F.col("bits").bitwiseAND(F.col("bit")) != 0)

    def taken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), TEXTS_AT_ONCE):
                part = batch.iloc[at : at + TEXTS_AT_ONCE]
                sets = [shingles_of(text, words) for text in part["body"]]
                prints = np.array([set_fingerprint(own) for own in sets]).reshape(-1, len(_PRINT))
                columns = {"node": part["node"].to_numpy(), "n": [len(own) for own in sets]}
                columns |= {f: prints[:, i] for i, f in enumerate(_PRINT)}
                drawn = [marks_of(own) for own in sets]
                columns |= {"drawn": [d[0] for d in drawn], "marks": [d[1] for d in drawn]}
                yield pd.DataFrame(columns | {"shingles": [own.view(np.int64) for own in sets]})

    fields = ", ".join(["node long, n int", *(f"{f} long" for f in _PRINT), "drawn int, marks array<smallint>, shingles array<long>"])
    return staged(passed.select("node", "body").mapInPandas(taken, fields), "candidates")


def prefix_rows(found: DataFrame, least: Fraction) -> DataFrame:
    """Rows (shingle, node, n, shared, at, f0, f1): the prefixes of the candidates that share as many
    shingles with others as a similar text takes; shared counts these. Order: rarest first, exactly."""
    every = found.select(F.explode("shingles").alias("shingle"), "node")
    every = every.withColumn("texts", F.count(F.lit(1)).over(Window.partitionBy("shingle"))).filter("texts > 1")
    every = staged(every, "shared-shingles")
    shared = every.groupBy("node").agg(F.count(F.lit(1)).alias("shared"))
    nodes = found.select("node", "n", *_PRINT).join(shared, "node")
    nodes = staged(nodes.filter(F.col("shared") * least.denominator >= F.col("n") * least.numerator), "nodes")
    # Shingles of this text alone come first in the order.
    rank = F.row_number().over(Window.partitionBy("node").orderBy("texts", "shingle"))
    rows = every.join(nodes.select("node", "n", "shared"), "node")
    rows = rows.select("shingle", "node", (F.col("n") - F.col("shared") + rank - 1).cast("int").alias("at"), prefix_of(F.col("n"), least).alias("prefix"))
    rows = rows.filter("at < prefix").drop("prefix").join(nodes, "node")
    return rows.select("shingle", "node", "n", F.col("shared").cast("int").alias("shared"), "at", *_PRINT)


def checked(pairs: DataFrame, found: DataFrame, least: Fraction) -> DataFrame:
    """The distinct pairs (a, b) whose texts are similar enough, by all their shingles."""
    up, down = least.numerator, least.denominator
    wanted = staged(pairs, "pairs")
    nodes = wanted.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = staged(found.select("node", "shingles").join(nodes, "node", "left_semi"), "sets")
    both = wanted.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("one")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("two")), "b")
    common = F.size(F.array_intersect("one", "two"))
    return staged(both.filter(common * (up + down) >= (F.size("one") + F.size("two")) * up).select("a", "b"), "links")


def apart(rows: DataFrame, links: DataFrame | None) -> DataFrame:
    """The rows with the root of their node, of shingles whose nodes have different roots."""
    if links is None:
        rows = rows.withColumn("root", F.col("node"))
    else:
        groups = staged(components(links), "groups")
        rows = rows.drop("root").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    own = Window.partitionBy("shingle")
    rows = rows.withColumns({"lo": F.min("root").over(own), "hi": F.max("root").over(own)})
    return staged(rows.filter("lo <> hi").drop("lo", "hi"), "apart")


def star_pairs(rows: DataFrame, least: Fraction, prints: bool) -> DataFrame:
    """Distinct pairs (a, b), at most one for each node: with the hub it meets most often. The hub of a
    shingle is the text that shares most of its own set."""
    share = (F.col("shared") / F.col("n")).alias("share")
    star = rows.withColumn("own", F.struct(share, "node", "n", "at", *_PRINT))
    star = star.withColumn("hub", F.max("own").over(Window.partitionBy("shingle")))
    star = star.filter((F.col("node") != F.col("hub.node")) & possible("own", "hub", least))
    if prints:
        star = star.filter(near("own", "hub"))
    star = star.groupBy("node", F.col("hub.node").alias("mate")).agg(F.count(F.lit(1)).alias("common"))
    star = star.groupBy("node").agg(F.max(F.struct("common", "mate")).alias("best"))
    return star.select(F.least("node", "best.mate").alias("a"), F.greatest("node", "best.mate").alias("b")).distinct()


def linked_texts(texts: DataFrame, words: int = SHINGLE_WORDS, least: Fraction = SIMILARITY) -> DataFrame:
    """Rows (node, root) for every node of ``texts(node, body)`` that has a similar one: its component.

    First each text is compared with one text, which joins most of a large group. Then all texts of a
    shingle that are in different components so far are compared, which leaves out no pair that could
    join two: first which of them have a near fingerprint beside them, then these by their marks.
    """
    prints = least >= RADIUS_SIMILARITY
    found = candidates(texts, words, least)
    rows = apart(prefix_rows(found, least), None)
    links = checked(star_pairs(rows, least, prints), found, least)
    rows = apart(rows, links)
    rows = staged(with_mate(rows, least, prints), "with-mate")
    rows = rows.withColumn("before", F.lag("shingle").over(Window.partitionBy("node").orderBy("at")))
    rows = staged(rows.join(found.select("node", "drawn", "marks"), "node"), "marked")
    return components(links.unionByName(checked(apart_pairs(rows, least, prints, marks=True), found, least)))


def gathered(rows: DataFrame) -> DataFrame:
    """The rows whose shingle has two nodes, with the row of its smallest node as ``centre``, its
    largest as ``last`` and its number of ``nodes``. The rows are shuffled once; a long group is
    buffered on disk."""
    own = Window.partitionBy("shingle")
    row = F.struct("node", *[c for c in rows.columns if c not in ("shingle", "node")])
    found = {"centre": F.min(row).over(own), "last": F.max(row).over(own), "nodes": F.count(F.lit(1)).over(own)}
    return rows.withColumns(found).filter(F.col("centre.node") != F.col("last.node"))


def met_rows(rows: DataFrame) -> DataFrame:
    """The rows whose shingle has two nodes."""
    return gathered(rows).select(rows.columns)


def banded(rows: DataFrame, least: Fraction) -> DataFrame:
    """The rows with the band of their size: a set meets only sets of its own band and of the next one. A
    band is somewhat wider than the ratio of sizes that similar sets can have."""
    return rows.withColumn("band", F.floor(F.log("n") / math.log(1.04 * least.denominator / least.numerator)))


def may_join(a: str, b: str, least: Fraction, prints: bool) -> Column:
    """Whether a pair of rows, the smaller set first, has different roots and can be similar by its sizes
    and with ``prints`` by its fingerprints."""
    small, large = F.col(f"{a}.n"), F.col(f"{b}.n")
    sizes = large.cast("long") * least.numerator <= small.cast("long") * least.denominator
    smaller = F.struct(small, f"{a}.node") < F.struct(large, f"{b}.node")
    met = smaller & sizes & (F.col(f"{a}.root") != F.col(f"{b}.root"))
    return met & near(a, b) if prints else met


def with_mate(rows: DataFrame, least: Fraction, prints: bool) -> DataFrame:
    """The rows that :func:`apart_pairs` could join with another one; as many rows at most as are given."""
    rows = banded(rows, least)
    down = rows.withColumn("band", F.explode(F.array("band", F.col("band") + 1)))
    up = rows.withColumn("band", F.explode(F.array("band", F.col("band") - 1)))
    same = (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.band") == F.col("b.band"))
    first = down.alias("a").join(rows.alias("b"), same & may_join("a", "b", least, prints), "left_semi")
    same = (F.col("b.shingle") == F.col("a.shingle")) & (F.col("b.band") == F.col("a.band"))
    second = up.alias("b").join(rows.alias("a"), same & may_join("a", "b", least, prints), "left_semi")
    return first.unionByName(second).drop("band").dropDuplicates(["shingle", "node"])


def marked(a: str, b: str, least: Fraction) -> Column:
    """Whether two sets, the smaller one first, can be similar by their marks.

    What is drawn of the larger set is in the smaller one by as large a part as its shingles are, by
    chance. A part that is smaller with less than the chance MARK_LOSS is too small (Bernstein's
    bound); if the set is drawn whole, any smaller one. Shingles that share their 16 bits with another
    of their set are counted as common.
    """
    lost = F.least(F.col(f"{a}.drawn") - F.size(f"{a}.marks"), F.col(f"{b}.drawn") - F.size(f"{b}.marks"))
    drawn, n = F.col(f"{b}.drawn"), F.col(f"{b}.n")
    wanted = F.least(F.lit(1.0), F.lit(float(least / (1 + least))) * (F.col(f"{a}.n") + n) / n)
    step = F.lit(-math.log(MARK_LOSS)) / drawn
    below = F.when(drawn < n, step / 3 + F.sqrt(step * step / 9 + 2 * step * (1 - wanted))).otherwise(0.0)
    # The marks are compared once for a pair.
    return F.size(F.array_intersect(f"{a}.marks", f"{b}.marks")) >= drawn * (wanted - below) - lost - 1e-6


def apart_pairs(rows: DataFrame, least: Fraction, prints: bool = False, marks: bool = False) -> DataFrame:
    """Distinct pairs (a, b) of nodes with different roots that can reach the similarity, and with
    ``prints`` have near fingerprints, with ``marks`` enough common marks, from
    ``rows(shingle, node, n, at, root)``, which hold every prefix shingle that two such nodes share.
    With ``marks`` a row has also ``before``, the shingle of the row before it in its node: where two
    nodes have the same one, they have met there already.
    """
    rows = banded(rows, least)
    small = rows.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1))).alias("a")
    pairs = small.join(rows.alias("b"), ["shingle", "band"])
    met = may_join("a", "b", least, prints)
    if marks:
        met &= F.coalesce(F.col("a.before") != F.col("b.before"), F.lit(True)) & marked("a", "b", least)
    pairs = pairs.filter(met)
    pairs = pairs.groupBy(F.col("a.node").alias("x"), F.col("a.n").alias("nx"), F.col("b.node").alias("y"), F.col("b.n").alias("ny"))
    pairs = pairs.agg(F.count(F.lit(1)).alias("common"), F.min("a.at").alias("ax"), F.min("b.at").alias("ay"))
    if not marks:
        pairs = pairs.filter(enough(F.col("nx"), F.col("ny"), F.col("common"), least))
    first = pairs.select("*", F.struct(F.col("nx").alias("n"), F.col("ax").alias("at")).alias("u"), F.struct(F.col("ny").alias("n"), F.col("ay").alias("at")).alias("v"))
    first = first.filter(possible("u", "v", least))
    return first.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def numbered_texts(docs: DataFrame) -> tuple[DataFrame, Column]:
    """Distinct texts (node, body) and the column that gives the node of a row of ``docs``.

    A node is a 64-bit hash of the text. Grouped by it, a second hash shows that no two texts share
    one (two texts with both hashes equal aside, one pair in 10^38); else it is drawn anew.
    """
    body = whole_text()
    draw = 0
    while True:
        node = F.xxhash64(body) if not draw else F.xxhash64(F.lit(draw), body)
        seen = docs.select(node.alias("node"), F.xxhash64(F.lit(-1 - draw), body).alias("other")).groupBy("node")
        seen = seen.agg(F.min("other").alias("lo"), F.max("other").alias("hi"), F.count(F.lit(1)).alias("rows"))
        shared, most = seen.agg(F.count_if(F.col("lo") != F.col("hi")), F.max("rows")).first()
        if not shared:
            texts = docs.select(node.alias("node"), body.alias("body"))
            return (texts.dropDuplicates(["node"]) if (most or 0) > 1 else texts), node
        draw += 1


def keep_one_similar(docs: DataFrame, words: int = SHINGLE_WORDS, least: Fraction = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` with one row for each group of near copies: the one of the smallest
    doc_id, then the smallest text hash; of repeated rows one stays. Near copies are texts whose
    shingles reach the similarity, and what hangs together by them. Null text counts as empty, and
    texts without words are copies of each other. A row without a doc_id is dropped where a row with
    one is in its group. All columns are returned as they are."""
    texts, node = numbered_texts(docs)
    groups = staged(linked_texts(texts, words, least), "groups")
    marked = docs.select("doc_id", node.alias("node"), F.xxhash64(whole_text()).alias("text_hash")).join(groups, "node", "left")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("first")
    stay = marked.groupBy(F.coalesce("root", "node").alias("group")).agg(first)
    return keep_rows(docs, stay.select("first.doc_id", "first.text_hash"))
