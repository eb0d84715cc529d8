"""Exact duplicates by deterministic block naming, in DataFrame functions only.

Every text is cut into blocks of a fixed number of characters. Distinct blocks that occur more
than once are sorted by their tickets (below) and get whole numbers as names; then adjacent names of a document are paired,
the distinct pairs sorted and named again, until each document has one name. Equal names of
documents with equally many blocks mean equal texts, without any collision. A document with a
block, or a pair, that no other place has is alone and leaves at once.

Block texts travel once, to be told apart and counted. Places refer to them by a ticket, a pair of
64-bit hashes, and the distinct blocks themselves show that no two of them share one; otherwise the
tickets are drawn anew. So tickets are as good as texts, and sorting them samples no texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.common import keep_rows, staged, table, whole_text

BLOCK_CHARS = 2048


def _blocks(body: Column, chars: int) -> Column:
    cut = F.regexp_extract_all(body, F.lit(f"(?s).{{1,{chars}}}"), F.lit(0))
    return F.when(body == "", F.array(F.lit(""))).otherwise(cut)


def _ticket(block: Column, draw: int) -> Column:
    return F.struct(
        F.xxhash64(F.lit(2 * draw), block).alias("h1"), F.xxhash64(F.lit(2 * draw + 1), block).alias("h2")
    )


def _named(frame: DataFrame, order: list[str], keep: list[str]) -> DataFrame:
    """Whole numbers in sorted order for distinct rows, fixed by writing them."""
    ranked = frame.repartitionByRange(*order).sortWithinPartitions(*order)
    return staged(ranked.select(*keep, F.monotonically_increasing_id().alias("name")), "names")


def _gathered(places: DataFrame) -> DataFrame:
    """Names of each row in order; rows with a place that got no name are alone and fall out."""
    lists = places.groupBy("row", "n_blocks", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("list"))
    whole = lists.filter(F.size("list") == F.col("n"))
    return staged(whole.select("row", "n_blocks", F.col("list.name").alias("names")), "named")


def named_documents(docs: DataFrame, text: str, key: str, chars: int) -> tuple[DataFrame, DataFrame]:
    """All rows (row, key, text_hash, sha), and (row, n_blocks, name) of those that are not alone."""
    body = whole_text(text)
    draw = 0
    while True:
        ticket = lambda block: _ticket(block, draw)  # noqa: B023, E731
        counted = docs.select(F.explode(_blocks(body, chars)).alias("block")).groupBy("block").count()
        counted = staged(counted.select(ticket(F.col("block")).alias("t"), "count").select("t.*", "count"), "blocks")
        if counted.groupBy("h1", "h2").count().filter("count > 1").isEmpty():
            break
        draw += 1
    rows = staged(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(key).alias("key"),
            F.xxhash64(body).alias("text_hash"),
            F.sha2(body, 256).alias("sha"),
            F.transform(_blocks(body, chars), ticket).alias("tickets"),
        ),
        "rows",
    )
    names = _named(counted.filter("count > 1"), ["h1", "h2"], ["h1", "h2"])
    places = rows.select("row", F.size("tickets").alias("n_blocks"), F.posexplode("tickets").alias("pos", "t"))
    places = places.select("row", "n_blocks", F.col("n_blocks").alias("n"), "pos", "t.*")
    state = _gathered(places.join(names, ["h1", "h2"]))
    finished = state.filter(F.size("names") == 1)
    while not (open_ := state.filter(F.size("names") > 1)).isEmpty():
        left, right = F.col("names")[2 * F.col("pos")], F.get("names", 2 * F.col("pos") + 1)
        places = open_.select("row", "n_blocks", "names", F.ceil(F.size("names") / 2).cast("int").alias("n"))
        places = places.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"))
        places = places.select("row", "n_blocks", "n", "pos", left.alias("l"), F.coalesce(right, F.lit(-1)).alias("r"))
        pairs = places.groupBy("l", "r").count().filter("count > 1")
        state = _gathered(places.join(_named(pairs, ["l", "r"], ["l", "r"]), ["l", "r"]))
        finished = finished.unionByName(state.filter(F.size("names") == 1))
    return rows.drop("tickets"), finished.select("row", "n_blocks", F.col("names")[0].alias("name"))


def exact_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows (key, keep_id, group_size, kept, text_sha256, text_hash) for every row of ``docs``.

    Of equal texts the row with the largest key stays; a null key is the smallest, and of rows
    with the same key and text exactly one stays. Null text counts as empty, and all empty texts
    are equal. Other columns are not read. An empty table gives an empty table.
    """
    rows, named = named_documents(docs, text, key, block_chars)
    members = named.join(rows.select("row", "key"), "row")
    group = members.groupBy("n_blocks", "name").agg(
        F.count(F.lit(1)).alias("group_size"), F.max(F.struct("key", "row")).alias("stays")
    )
    group = staged(group.filter("group_size > 1"), "groups")
    marked = staged(named.join(group, ["n_blocks", "name"]).select("row", "group_size", "stays"), "marked")
    found = rows.join(marked, "row", "left")
    alone = F.col("group_size").isNull()
    return found.select(
        F.col("key").alias(key),
        F.when(alone, F.col("key")).otherwise(F.col("stays.key")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("stays.row") == F.col("row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "text_hash",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those whose text stays in another row."""
    return keep_rows(docs, exact_duplicates(docs).filter("kept").select("doc_id", "text_hash"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


OP1_SQL = """
SELECT doc_id, keep_id, group_size, kept, sha256(body) AS text_sha256
FROM (
  SELECT doc_id, body, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
         row_number() OVER (PARTITION BY body ORDER BY doc_id DESC NULLS LAST) = 1 AS kept
  FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents)
  WINDOW same AS (PARTITION BY body)
)
"""
