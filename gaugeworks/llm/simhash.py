"""Near copies by SimHash: vantage-point shards of fingerprints, exact pairs inside each shard.

A fingerprint goes down a tree of vantage points. At a node with vantage point v and radius m it
belongs to the inner side if its distance to v is under m, and to the outer side if the distance
is at least m - r, where r is the link radius. By the triangle inequality two fingerprints within
r of each other always share a side, so every linked pair meets in some leaf: the boundary shell
of width r is the only part held twice, and no pair is looked for anywhere else.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.common import keep_rows, staged, table, whole_text
from gaugeworks.llm.components import components

SHINGLE_WORDS = 3
HASH_SEED = 42
LINK_BITS = 3
#: Fingerprints a shard should hold, and how many the driver sees at a time to place vantage points.
#: Larger shards mean more comparisons in a task, smaller ones more boundary copies to shuffle: both
#: grow with the root of the number of shards. Comparing a fingerprint with a shard of this size
#: takes well under a millisecond, less than the hashing of its text.
SHARD_ROWS = 40_000
SAMPLE_ROWS = 60_000
#: Fingerprints compared with all others of a shard at a time.
BLOCK_ROWS = 128
#: A shard is split only if both sides together need less than this share of its comparisons.
WORTHWHILE = 0.92

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint_of(text: str, words: int = SHINGLE_WORDS, seed: int = HASH_SEED) -> int:
    """SimHash of one whole text as an unsigned integer; 0 without any word."""
    parts = text.encode("utf-8", "replace").lower().split()
    if not parts:
        return 0
    if len(parts) < words:
        shingles: Iterator[bytes] = iter([b" ".join(parts)])
    else:
        shingles = map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False))
    hashes = map(xxhash.xxh64_intdigest, shingles, iter(lambda: seed, None))
    counts = np.zeros(64, dtype=np.int64)
    total = 0
    while True:
        block = np.fromiter(islice(hashes, 65536), dtype=np.uint64)
        if not len(block):
            break
        total += len(block)
        octets = block.view(np.uint8).reshape(-1, 8)
        for i in range(8):
            counts[8 * i : 8 * i + 8] += np.bincount(octets[:, i], minlength=256) @ _BITS
    ones = counts * 2 > total
    return int((ones.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def set_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """SimHash of 128 bits, as two signed longs, of a set of 64-bit hashes: their own bits, and those
    of a second hash mixed from each."""
    second = (hashes ^ (hashes >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    second = (second ^ (second >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    lanes = np.stack([hashes, second ^ (second >> np.uint64(33))], axis=1)
    counts = np.zeros(128, dtype=np.int64)
    for at in range(0, len(lanes), 65536):
        octets = lanes[at : at + 65536].view(np.uint8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)


def fingerprint(text: Column) -> Column:
    """SimHash as a signed long, computed batch by batch."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        values = np.fromiter((fingerprint_of(t) for t in texts), dtype=np.uint64, count=len(texts))
        return pd.Series(values.view(np.int64))

    return simhash(text)


def _distance(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage)


def plant(points: np.ndarray, target: int, radius: int) -> list[tuple]:
    """Tree over a sample as rows (vantage, m, inner, outer); a negative child -k is leaf k-1.

    Among eight vantage points and all radii the cheapest split is taken, counted in pairs to
    compare on both sides. Where none is worthwhile the node stays a leaf.
    """
    nodes: list[tuple] = []
    leaves = 0

    def grow(own: np.ndarray) -> int:
        nonlocal leaves
        best = None
        if len(own) > target:
            for v in own[:: max(1, len(own) // 8)][:8]:
                reach = np.cumsum(np.bincount(_distance(own, v), minlength=65))
                for m in range(1, 65):
                    inner, outer = int(reach[m - 1]), len(own) - int(reach[m - radius - 1] if m > radius else 0)
                    cost = inner**2 + outer**2
                    if inner and outer < len(own) and (best is None or cost < best[0]):
                        best = (cost, v, m)
        if best is None or best[0] > WORTHWHILE * len(own) ** 2:
            leaves += 1
            return -leaves
        at = len(nodes)
        nodes.append(())
        d = _distance(own, best[1])
        nodes[at] = (best[1], best[2], grow(own[d < best[2]]), grow(own[d >= best[2] - radius]))
        return at

    grow(points)
    return nodes


def descend(nodes: list[tuple], points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaf numbers and positions of all the leaves each point belongs to."""
    if not nodes:
        return np.zeros(len(points), dtype=np.int64), np.arange(len(points))
    found: list[tuple[int, np.ndarray]] = []
    todo = [(0, np.arange(len(points)))]
    while todo:
        at, own = todo.pop()
        if not len(own):
            continue
        if at < 0:
            found.append((-at - 1, own))
            continue
        vantage, m, inner, outer = nodes[at]
        d = _distance(points[own], vantage)
        todo += [(inner, own[d < m]), (outer, own[d >= m - radius])]
    leaf = np.concatenate([np.full(len(own), k, dtype=np.int64) for k, own in found] or [np.zeros(0, np.int64)])
    return leaf, np.concatenate([own for _, own in found] or [np.zeros(0, np.int64)])


def shard(prints: DataFrame, radius: int = LINK_BITS, target: int = SHARD_ROWS) -> DataFrame:
    """Rows (shard, fp): every pair of fingerprints within ``radius`` shares a shard.

    ``prints`` holds distinct fingerprints. The driver only ever sees ``SAMPLE_ROWS`` of them to
    place vantage points; shards that stay too large get trees of their own in a further round.
    """
    spark = prints.sparkSession
    done = None
    open_ = prints.select(F.lit("").alias("shard"), "fp")
    rows = open_.count()
    sizes = {"": rows} if rows else {}
    while sizes:
        share = min(1.0, SAMPLE_ROWS / sum(sizes.values()))
        bound = int(share * 2**31)
        sample = open_.filter(F.pmod(F.xxhash64("fp", F.lit(len(sizes))), F.lit(2**31)) < bound).toPandas()
        trees = {}
        for name, own in sample.groupby("shard"):
            points = np.sort(own["fp"].to_numpy(np.int64)).view(np.uint64)
            trees[name] = plant(points, max(2, int(target * len(points) / sizes[name])), radius)
        trees = {name: nodes for name, nodes in trees.items() if nodes}
        if not trees:
            break
        shared = spark.sparkContext.broadcast(trees)

        def route(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for name, own in batch.groupby("shard"):
                    points = own["fp"].to_numpy(np.int64)
                    leaf, at = descend(shared.value.get(name, []), points.view(np.uint64), radius)
                    names = name + "." + pd.Series(leaf).astype(str) if name in shared.value else name
                    yield pd.DataFrame({"shard": names, "fp": points[at]})

        routed = staged(open_.mapInPandas(route, "shard string, fp long"), "shards")
        rows = routed.groupBy("shard").count().filter(F.col("count") > 4 * target).collect()
        grown = {r["shard"]: r["count"] for r in rows}
        # A shard that was not split this time cannot be split by another sample either.
        sizes = {name: n for name, n in grown.items() if name not in sizes}
        large = F.col("shard").isin(list(sizes)) if sizes else F.lit(False)
        closed = routed.filter(~large)
        done = closed if done is None else done.unionByName(closed)
        open_ = routed.filter(large)
    return open_ if done is None else done.unionByName(open_)


def _links(own: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Each point that links to another one, with a point of its connected group."""
    linked = np.zeros(len(own), dtype=bool)
    for at in range(0, len(own), BLOCK_ROWS):
        block = own[at : at + BLOCK_ROWS]
        hits = np.bitwise_count(block[:, None] ^ own[None, at:]) <= radius
        hits[np.arange(len(block)), np.arange(len(block))] = False
        linked[at:] |= hits.any(axis=0)
        linked[at : at + BLOCK_ROWS] |= hits.any(axis=1)
    left = own[linked]
    nodes, roots = [], []
    while len(left):
        root, frontier = left[0], [left[0]]
        left = left[1:]
        while frontier:
            point = frontier.pop()
            near = np.bitwise_count(left ^ point) <= radius
            if near.any():
                joined = left[near]
                nodes.append(joined)
                roots.append(np.full(len(joined), root))
                frontier.extend(joined)
                left = left[~near]
    empty = np.zeros(0, np.uint64)
    return np.concatenate(nodes or [empty]), np.concatenate(roots or [empty])


def linked_groups(prints: DataFrame, radius: int = LINK_BITS) -> DataFrame:
    """Rows (node, root): connected groups of distinct fingerprints that have any link.

    A shard returns at most one edge per fingerprint, whatever number of pairs it holds.
    """

    def within(own: pd.DataFrame) -> pd.DataFrame:
        points = np.sort(own["fp"].to_numpy(np.int64)).view(np.uint64)
        node, root = _links(points, radius)
        return pd.DataFrame({"a": node.view(np.int64), "b": root.view(np.int64)})

    edges = shard(prints, radius).groupBy("shard").applyInPandas(within, "a long, b long")
    return components(staged(edges, "links"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (key, text_hash, fp, group, component_id) for every row of ``docs``.

    component_id is the smallest key among all rows reachable over links of at most three
    differing bits, group the smallest fingerprint of that component. Null text counts as empty;
    texts without words have fingerprint 0 and link like any other; rows whose key is null stay,
    and a component without any key has no component_id. Repeated rows stay repeated; other
    columns are not read. An empty table gives an empty table.
    """
    body = whole_text(text)
    prints = staged(docs.select(F.col(key).alias("key"), F.xxhash64(body).alias("text_hash"), fingerprint(body).alias("fp")), "prints")
    least = staged(prints.groupBy("fp").agg(F.min("key").alias("least")), "distinct")
    groups = staged(linked_groups(least.select("fp")).withColumnRenamed("node", "fp"), "groups")
    every = least.join(groups, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("group"))
    top = staged(every.groupBy("group").agg(F.min("least").alias("component_id")), "components")
    label = staged(every.join(top, "group").select("fp", "group", "component_id"), "labels")
    return prints.join(label, "fp").select(F.col("key").alias(key), "text_hash", "fp", "group", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one row for each near-duplicate group: the one of the smallest
    doc_id, then the smallest text hash; of repeated rows one stays. A row without a doc_id is
    dropped where a row with one is in its group. All columns are returned as they are."""
    marked = near_duplicates(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("first")
    stay = marked.groupBy("group").agg(first).select("first.doc_id", "first.text_hash")
    return keep_rows(docs, stay)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
