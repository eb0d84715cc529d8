"""File sources and sinks for evidence: JSON lines, CSV, Parquet, checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.schemas import SCHEMA_BY_KIND

CORRUPT = "_corrupt_record"


def parse_lines(lines: DataFrame, column: str, schema: str | T.StructType) -> DataFrame:
    """Adds ``record`` and ``state`` (ok, blank or corrupt) to text lines."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    typed = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    record = F.from_json(
        F.col(column), typed, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    )
    blank = F.length(F.trim(F.col(column))) == 0
    return lines.withColumn("record", record).withColumn(
        "state",
        F.when(blank, "blank").when(F.col(f"record.{CORRUPT}").isNotNull(), "corrupt").otherwise("ok"),
    )


def read_evidence(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """Typed records of JSON lines under ``path`` (globs allowed), and the lines that do not parse.

    Both carry ``source_file``. The schema is fixed per kind, nothing is inferred.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source_file"))
    parsed = parse_lines(lines, "value", SCHEMA_BY_KIND[kind]).where("state <> 'blank'")
    good = parsed.where("state = 'ok'").select("record.*", "source_file").drop(CORRUPT)
    bad = parsed.where("state = 'corrupt'").select("source_file", F.col("value").alias("text"))
    return good, bad


def write_json_once(frame: DataFrame, path: str) -> None:
    """JSON lines; an existing target is an error, evidence is never overwritten."""
    frame.write.mode("errorifexists").json(path)


def csv_ready(frame: DataFrame) -> DataFrame:
    """Columns in name order, nested values as JSON text."""
    nested = {
        f.name
        for f in frame.schema.fields
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))
    }

    def cell(name: str) -> Column:
        quoted = F.col(f"`{name}`")
        return (F.to_json(quoted) if name in nested else quoted).alias(name)

    return frame.select(*[cell(name) for name in sorted(frame.columns)])


def write_csv_once(frame: DataFrame, path: str) -> None:
    csv_ready(frame).write.mode("errorifexists").option("header", True).csv(path)


def write_extraction(features: DataFrame, coverage: DataFrame, summary: DataFrame, root: str, extraction_id: str) -> None:
    """Features, coverage and summary under one extraction id, each row carrying it.

    The summary is written last: a reader that finds it finds the other two complete.
    """
    mark = F.lit(extraction_id).alias("extraction_id")
    features.select("*", mark).write.mode("errorifexists").parquet(f"{root}/features/{extraction_id}")
    coverage.select("*", mark).write.mode("errorifexists").parquet(f"{root}/coverage/{extraction_id}")
    summary.select("*", mark).write.mode("errorifexists").parquet(f"{root}/summary/{extraction_id}")


def check_extraction_id(extraction_id: str) -> str:
    if not extraction_id or extraction_id in (".", "..") or "/" in extraction_id:
        raise ValueError("an extraction id is a plain name inside the evidence root")
    return extraction_id


def load_extraction(
    spark: SparkSession, root: str, extraction_id: str | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Linked features, coverage and summary; the newest by name when no id is given."""
    if extraction_id is None:
        summaries = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/summary")
        extraction_id = summaries.agg(F.max("extraction_id")).first()[0]
        if extraction_id is None:
            raise FileNotFoundError(f"{root} has no extraction summary")
    name = check_extraction_id(extraction_id)
    return tuple(spark.read.parquet(f"{root}/{part}/{name}") for part in ("features", "coverage", "summary"))


def write_splits(assigned: DataFrame, strategy: str, path: str) -> None:
    assigned.select("run_id", "split", F.lit(strategy).alias("actual_strategy")).write.mode(
        "errorifexists"
    ).partitionBy("split").parquet(path)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 and size of every file below ``path``."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", F.sha2("content", 256).alias("sha256"), "length")
    )


def verify_checksums(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Files that are missing, extra or changed, by a full outer join on the path."""
    joined = actual.select("path", F.col("sha256").alias("found")).join(
        expected.select("path", F.col("sha256").alias("wanted")), "path", "full_outer"
    )
    problem = (
        F.when(F.col("found").isNull(), "missing")
        .when(F.col("wanted").isNull(), "unlisted")
        .when(F.col("found") != F.col("wanted"), "changed")
    )
    return joined.select("path", problem.alias("problem")).where("problem IS NOT NULL")
