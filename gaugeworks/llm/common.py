"""Written tables in the shared folder, and the null and row rules all operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.session import ensure_checkpoint_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(frame: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them back: cuts the lineage, survives lost
    executors, and fixes values that a recomputation could change."""
    path = shared_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def spread(frame: DataFrame, *keys: str) -> DataFrame:
    """Deal small rows that stand for much work over as many tasks as a shuffle has; a number that
    is given is not coalesced by the size of the rows."""
    return frame.repartition(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def whole_text(text: str = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_rows(docs: DataFrame, stay: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, text hash) is in ``stay``, one of each; all columns stay.

    Which keys go, and which are held by several rows, is found on rows of two numbers; whole rows
    are only compared with the keys that go. Of repeated rows alone one is picked among whole rows.
    """
    hashed = docs.withColumn("__hash", F.xxhash64(whole_text()))
    keys = hashed.groupBy(F.col("doc_id").alias("__id"), F.col("__hash").alias("__key")).agg(F.count(F.lit(1)).alias("copies"))
    wanted = stay.select(F.col("doc_id").alias("stay_id"), F.col("text_hash").alias("stay_hash"), F.lit(True).alias("kept")).distinct()
    judged = keys.join(wanted, F.col("__id").eqNullSafe(F.col("stay_id")) & (F.col("__key") == F.col("stay_hash")), "left")
    apart = staged(judged.filter("kept IS NULL OR copies > 1").select("__id", "__key", "kept"), "apart-keys")
    repeated = staged(apart.filter("kept"), "repeated-keys")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__key"))
    single = hashed.join(apart, same, "left_anti")
    again = hashed.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "__hash"])
    return single.unionByName(again).drop("__hash")
