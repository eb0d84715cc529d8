"""Merkle manifest of a table: leaf coordinates from bitmap ranks, levels from keyed slot arrays.

Every row is a leaf. Leaves are grouped, and ascend by their key in a group. No row is sorted to
find its place: the keys of a group form a bitmap, of which only the 64-bit words with a bit set are
rows. Words merge by OR with map-side combine. A directory of population counts, 512 children to a
node, is summed upwards until each group has one node, and its offsets go down again; a row's place
is the offset of its word and the bits below its own. Keys that several rows share, which a bitmap
cannot tell apart, add their surplus to their word; their rows are numbered apart.

A place cuts into chunks of 1,024 slots. Each chunk is an array by slot, folded ten binary levels at
a time, so that a tree of any size takes one shuffle for every ten levels, and no task ever holds
more than a chunk. Groups are the leaves of a last tree, folded alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.functions.segments import row_numbers
from gaugeworks.llm.common import staged, table

CHUNK_BITS = 10
FAN_BITS = 9
MANIFEST = ["key", "position", "n_leaves", "leaf", "claimed", "path", "subroot", "root", "folded_root"]
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def depth_of(size: int) -> int:
    """Binary levels over so many nodes."""
    return max(size - 1, 0).bit_length()


def levels_of(nodes: Sequence[str], depth: int) -> list[list[str]]:
    """The nodes and the next ``depth`` levels above; the last run of a level may hold one node."""
    found = [list(nodes)]
    for _ in range(depth):
        below = found[-1]
        found.append([digest("".join(below[i : i + 2])) for i in range(0, len(below), 2)])
    return found


def siblings(levels: list[list[str]], slot: int) -> str:
    """Digests beside the way up from a slot, without the topmost level."""
    beside = ((level, (slot >> up) ^ 1) for up, level in enumerate(levels[:-1]))
    return "".join(level[at] for level, at in beside if at < len(level))


def folded(node: str, at: int, size: int, path: str, start: int = 0) -> tuple[str, int]:
    """What a node at a place of a level becomes at the top, and how much of the path it took."""
    while size > 1:
        if at ^ 1 < size:
            other = path[start : start + 64]
            start += 64
            node = digest(other + node if at & 1 else node + other)
        else:
            node = digest(node)
        at, size = at >> 1, (size + 1) >> 1
    return node, start


def leaf_of(values: Sequence[Column]) -> Column:
    """Digest of the values: each as its length in UTF-8 bytes, a colon and itself, or ``-`` if null."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _below(bit: Column) -> Column:
    return F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), bit))


def _word(key: Column) -> Column:
    """The key without its lowest six bits; the sign bit is turned, so that words ascend from zero."""
    return F.shiftrightunsigned(key.bitwiseXOR(F.lit(-(1 << 63))), 6)


def word_offsets(words: DataFrame) -> DataFrame:
    """Number of rows before each word(tree, word, n) of its tree, by the directory of counts."""
    levels = [words.select("tree", F.col("word").alias("id"), "n")]
    while not levels[-1].groupBy("tree").count().filter("count > 1").isEmpty():
        above = levels[-1].groupBy("tree", F.shiftright("id", FAN_BITS).alias("id")).agg(F.sum("n").alias("n"))
        levels.append(staged(above, "directory"))
    offsets = levels[-1].select("tree", "id", F.lit(0).cast("long").alias("offset"))
    for level in reversed(levels[:-1]):
        inside = Window.partitionBy("tree", "up").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
        before = level.withColumn("up", F.shiftright("id", FAN_BITS)).withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        above = offsets.select("tree", F.col("id").alias("up"), F.col("offset").alias("base"))
        offsets = before.join(above, ["tree", "up"]).select("tree", "id", (F.col("base") + F.col("before")).alias("offset"))
    return offsets.withColumnRenamed("id", "word")


def numbered_repeats(leaves: DataFrame, shared: DataFrame) -> DataFrame:
    """Rows (row, ordinal, null key or not) of the leaves whose (tree, key) several rows have, in the
    order of their digests; equal digests stand for equal rows."""
    same = leaves["tree"].eqNullSafe(shared["tree"]) & leaves["key"].eqNullSafe(shared["key"])
    many = leaves.join(shared, same, "left_semi").select("row", "tree", "key", "leaf")
    numbered = row_numbers(many, ["tree", F.col("key").asc_nulls_first(), "leaf", "row"], "number")
    first = numbered.groupBy("tree", "key").agg(F.min("number").alias("least")).withColumnRenamed("tree", "t").withColumnRenamed("key", "k")
    return numbered.join(first, numbered["tree"].eqNullSafe(F.col("t")) & numbered["key"].eqNullSafe(F.col("k"))).select(
        "row", (F.col("number") - F.col("least")).alias("ordinal")
    )


def placed(leaves: DataFrame) -> DataFrame:
    """``leaves(row, tree, key, leaf, claimed)`` with the place of each row in its tree."""
    word, bit = _word(F.col("key")), F.col("key").bitwiseAND(F.lit(63)).cast("int")
    named = leaves.filter("key is not null")
    set_bit = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    words = named.groupBy("tree", word.alias("word")).agg(F.bit_or(set_bit).alias("bits"), F.count(F.lit(1)).alias("n"))
    words = staged(words, "words")
    index = words.join(word_offsets(words), ["tree", "word"]).select("tree", "word", "bits", "offset")
    rank = F.col("offset") + F.bit_count(F.col("bits").bitwiseAND(_below(bit)))

    crowded = words.filter(F.col("n") > F.bit_count("bits")).select("tree", "word")
    unnamed = leaves.filter("key is null")
    if crowded.isEmpty() and unnamed.isEmpty():
        found = named.withColumn("word", word).join(index, ["tree", "word"])
        return found.select("row", "tree", "key", "leaf", "claimed", rank.alias("pos"))

    counts = named.withColumn("word", word).join(crowded, ["tree", "word"], "left_semi").groupBy("tree", "word", "key").count()
    counts = staged(counts.filter("count > 1"), "repeats")
    surplus = counts.groupBy("tree", "word").agg(F.collect_list(F.struct("key", (F.col("count") - 1).alias("more"))).alias("surplus"))
    nulls = unnamed.groupBy("tree").agg(F.count(F.lit(1)).alias("nulls"))
    shared = counts.select("tree", "key").unionByName(nulls.select("tree", F.lit(None).cast("long").alias("key")))
    ordinals = numbered_repeats(leaves, shared)
    index = index.join(surplus, ["tree", "word"], "left").join(nulls, "tree", "left").withColumn("nulls", F.coalesce("nulls", F.lit(0)))
    lower = F.filter("surplus", lambda x: x["key"] < F.col("key"))
    more = F.aggregate(F.coalesce(lower, F.array().cast("array<struct<key:bigint,more:bigint>>")), F.lit(0).cast("long"), lambda a, x: a + x["more"])
    found = leaves.withColumn("word", word).join(index, ["tree", "word"], "left").join(ordinals, "row", "left")
    place = F.coalesce(rank + F.col("nulls") + more, F.lit(0)) + F.coalesce("ordinal", F.lit(0))
    return found.select("row", "tree", "key", "leaf", "claimed", place.alias("pos"))


def chunked(nodes: DataFrame, sizes: DataFrame, bits: int, *carried: str) -> DataFrame:
    """Arrays of up to 2 ** ``bits`` slots of ``nodes(tree, pos, node)``, with the size of their tree's level."""
    slot = F.col("pos").bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    slots = F.array_sort(F.collect_list(F.struct(slot.alias("slot"), "node", *carried))).alias("slots")
    found = nodes.groupBy("tree", F.shiftright("pos", bits).alias("chunk")).agg(slots)
    return staged(found.join(sizes, "tree"), "chunks")


def _tops(bits: int) -> Callable[..., Column]:
    @F.pandas_udf(T.StringType())
    def top(nodes: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([levels_of(n, min(bits, depth_of(s)))[-1][0] for n, s in zip(nodes, sizes, strict=True)])

    return top


def _paths(bits: int) -> Callable[..., Column]:
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def paths(nodes: pd.Series, sizes: pd.Series) -> pd.Series:
        found = []
        for n, s in zip(nodes, sizes, strict=True):
            levels = levels_of(n, min(bits, depth_of(s)))
            found.append([siblings(levels, i) for i in range(len(n))])
        return pd.Series(found)

    return paths


def folded_trees(chunks: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """Of chunked leaves: rows (tree, chunk, above), the siblings above each chunk's own levels, and
    (tree, size, subroot)."""
    sizes = chunks.select("tree", "size").distinct()
    rounds = [chunks]
    while True:
        last = rounds[-1]
        tops = last.select("tree", F.col("chunk").alias("pos"), _tops(bits)(F.col("slots.node"), "size").alias("node"))
        left = last.select("tree", F.call_function("div", F.col("size") - 1, F.lit(1 << bits)).alias("size")).distinct()
        if left.filter("size > 0").isEmpty():
            break
        rounds.append(chunked(tops, left.withColumn("size", F.col("size") + 1), bits))
    roots = staged(tops.select("tree", F.col("node").alias("subroot")).join(sizes, "tree"), "subroots")
    above = None
    for level in reversed(rounds[1:]):
        own = level.select("tree", "chunk", F.explode(F.arrays_zip(F.col("slots.slot").alias("slot"), _paths(bits)(F.col("slots.node"), "size").alias("path"))).alias("x"))
        own = own.select("tree", "chunk", (F.shiftleft("chunk", bits) + F.col("x.slot")).alias("pos"), F.col("x.path").alias("path"))
        if above is not None:
            own = own.join(above, ["tree", "chunk"]).withColumn("path", F.concat("path", "above"))
        above = staged(own.select("tree", F.col("pos").alias("chunk"), F.col("path").alias("above")), "paths")
    if above is None:
        above = chunks.select("tree", "chunk", F.lit("").alias("above"))
    return above, roots


def _proved(bits: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    names = ["chunk", "slots", "size", "above", "subroot", "top_pos", "top_size", "top_path", "root"]

    def proved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk, slots, size, above, subroot, top_pos, top_size, top_path, root in batch[names].itertuples(index=False):
                levels = levels_of([s["node"] for s in slots], min(bits, depth_of(size)))
                out = []
                for i, slot in enumerate(slots):
                    pos = (chunk << bits) + i
                    path = siblings(levels, i) + above + top_path
                    reached, used = folded(slot["claimed"], pos, size, path)
                    reached, _ = folded(reached, top_pos, top_size, path, used)
                    out.append((slot["key"], pos, size, slot["node"], slot["claimed"], path, subroot, root, reached))
                yield pd.DataFrame(out, columns=MANIFEST)

    return proved


def manifest(
    docs: DataFrame,
    key: str = "doc_id",
    group: str = "lang",
    fields: Sequence[str] = FIELDS,
    claimed: dict[str, Column] | None = None,
    chunk_bits: int = CHUNK_BITS,
) -> DataFrame:
    """The manifest of ``docs``, one row each: key, position, n_leaves (of its group), leaf, claimed,
    path, subroot, root, folded_root.

    A leaf is the digest of ``fields``. ``claimed`` names columns that someone claims to hold other
    values; folded_root is what the claimed leaf gives with the path of the true one, and equals root
    if nothing differs. ``path`` holds the digests beside the way to the root, from the leaf up.

    Null values are told from empty ones; a null group is the first of all, null keys come first in
    their group. Rows of one key are in the order of their leaves; equal rows take adjacent places.
    Other columns are not read. An empty table gives an empty manifest.
    """
    values = {f: F.col(f) for f in fields}
    leaf = leaf_of(list(values.values()))
    changed = leaf_of([*(values | (claimed or {})).values()]) if claimed else F.lit(None).cast("string")
    leaves = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("tree"),
        F.col(key).cast("long").alias("key"),
        leaf.alias("leaf"),
        changed.alias("claimed"),
    )
    leaves = staged(leaves.withColumn("claimed", F.coalesce("claimed", "leaf")), "leaves")
    sizes = leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("size"))
    # Keys go through Python as text: whole numbers next to nulls would become floats there.
    nodes = placed(leaves).withColumnRenamed("leaf", "node").withColumn("key", F.col("key").cast("string"))
    chunks = chunked(nodes, sizes, chunk_bits, "key", "claimed")
    above, roots = folded_trees(chunks, chunk_bits)

    ranked = row_numbers(roots, ["tree"], "number").select("tree", "subroot", F.col("number").alias("pos"))
    ranked = staged(ranked, "groups")
    one = ranked.select(F.lit("").alias("tree"), "pos", F.col("subroot").alias("node"), F.col("tree").alias("own"))
    top = chunked(one, one.groupBy("tree").agg(F.count(F.lit(1)).alias("size")), chunk_bits, "own")
    top_above, top_root = folded_trees(top, chunk_bits)
    own = top.join(top_above, ["tree", "chunk"]).select(
        "chunk", "size", "above", F.explode(F.arrays_zip(F.col("slots.slot").alias("slot"), F.col("slots.own").alias("own"), F.col("slots.node").alias("node"), _paths(chunk_bits)(F.col("slots.node"), "size").alias("path"))).alias("x")
    )
    crown = own.crossJoin(F.broadcast(top_root.select(F.col("subroot").alias("root")))).select(  # one row
        F.col("x.own").alias("tree"),
        F.col("x.node").alias("subroot"),
        (F.shiftleft("chunk", chunk_bits) + F.col("x.slot")).alias("top_pos"),
        F.col("size").alias("top_size"),
        F.concat("x.path", "above").alias("top_path"),
        "root",
    )
    found = chunks.join(above, ["tree", "chunk"]).join(staged(crown, "crown"), "tree")
    schema = ", ".join(f"{c} {'long' if c in ('position', 'n_leaves') else 'string'}" for c in MANIFEST)
    found = found.mapInPandas(_proved(chunk_bits), schema)
    return found.select(F.col("key").cast("long").alias(key), *MANIFEST[1:])


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of a manifest: the path as a digest, and whether the claimed leaf gives the root."""
    proof, verified = F.sha2("path", 256).alias("proof_sha256"), (F.col("folded_root") == F.col("root")).alias("verified")
    return found.select(key, "leaf", "subroot", "root", proof, "folded_root", verified)


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = F.when(tampered, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars").cast("decimal(20,0)"))
    return digests(manifest(table(spark, sf_dir, "documents"), claimed={"n_chars": more}))


#: 3988292384 is the reversed polynomial of CRC-32; -1 stands for a step by one bit.
OP11_SQL = """
WITH RECURSIVE parts AS (
  SELECT doc_id, lang, n_chars,
    list_reduce(
      list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
        lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda crc, b: CASE WHEN b >= 0 THEN xor(crc, b)
                          WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END
    ) AS crc,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS front,
    coalesce(strlen(text) || ':' || text, '-') AS back
  FROM documents
), leaves AS (
  SELECT doc_id, lang, sha256(front || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || back) AS leaf,
    sha256(front || coalesce(strlen(claim::VARCHAR) || ':' || claim, '-') || back) AS claimed
  FROM (SELECT *, n_chars + CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN 1 ELSE 0 END AS claim FROM parts)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves
), levels AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM placed GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], '')))
  FROM levels WHERE len(nodes) > 1
), subroots AS (
  SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS top_pos FROM levels WHERE len(nodes) = 1
), crown AS (
  SELECT 0 AS level, list(subroot ORDER BY top_pos) AS nodes FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], '')))
  FROM crown WHERE len(nodes) > 1
), steps AS (
  SELECT p.lang, p.pos, level AS step, nodes[xor(p.pos >> level, 1) + 1] AS sibling, (p.pos >> level) & 1 AS odd
  FROM placed p JOIN levels l ON p.lang IS NOT DISTINCT FROM l.lang WHERE len(nodes) > 1
  UNION ALL
  SELECT p.lang, p.pos, 1000 + level, nodes[xor(s.top_pos >> level, 1) + 1], (s.top_pos >> level) & 1
  FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang CROSS JOIN crown WHERE len(nodes) > 1
), ways AS (
  SELECT lang, pos, coalesce(string_agg(sibling, '' ORDER BY step), '') AS path,
    list({'sibling': coalesce(sibling, ''), 'odd': odd} ORDER BY step) AS way
  FROM steps GROUP BY lang, pos
), climb AS (
  SELECT p.lang, p.pos, coalesce(way, []) AS way, claimed AS node, 1 AS num
  FROM placed p LEFT JOIN ways w ON p.lang IS NOT DISTINCT FROM w.lang AND p.pos = w.pos
  UNION ALL
  SELECT lang, pos, way, CASE WHEN way[num].odd = 1 THEN sha256(way[num].sibling || node) ELSE sha256(node || way[num].sibling) END, num + 1
  FROM climb WHERE num <= len(way)
)
SELECT p.doc_id, p.leaf, s.subroot, c.nodes[1] AS root, sha256(coalesce(w.path, '')) AS proof_sha256,
  k.node AS folded_root, k.node = c.nodes[1] AS verified
FROM placed p
JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang
JOIN climb k ON p.lang IS NOT DISTINCT FROM k.lang AND p.pos = k.pos AND k.num = len(k.way) + 1
CROSS JOIN (SELECT nodes FROM crown WHERE len(nodes) = 1) c
LEFT JOIN ways w ON p.lang IS NOT DISTINCT FROM w.lang AND p.pos = w.pos
"""
