"""Evidence of windows for batches outside the planned ones."""

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gaugeworks.operators import ingest as I


def test_batches_outside_the_plan_have_a_window(spark):
    plan = I.WindowPlan("2024-01-01T00:00:00Z", 86_400, 30)
    day = plan.size_us
    offsets = {"first": 0, "last": 30 * day - 1, "later": 30 * day, "much-later": 45 * day + 5, "just-before": -2, "days-before": -2 * day - 2}
    rows = spark.createDataFrame([(b, plan.start_us + us) for b, us in offsets.items()], "batch_id string, us bigint")
    found = I.evidence(rows.select("batch_id", F.timestamp_micros("us").alias("observed_at")), plan)
    got = {r["batch_id"]: (r["window_start_us"] - plan.start_us) // day for r in found.collect()}
    assert got == {"first": 0, "last": 29, "later": 30, "much-later": 45, "just-before": 0, "days-before": -2}


def test_events_after_the_plan_match_the_sql(spark, sf_dir, tmp_path):
    moved = f"SELECT * REPLACE (ts + INTERVAL 20 DAY AS ts) FROM read_parquet('{sf_dir}/events.parquet')"
    duckdb.sql(f"COPY ({moved}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    found = entry.queries()["window_evidence"](spark, str(tmp_path))
    with duckdb.connect() as connection:
        connection.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
        result = connection.execute(entry.oracle_sql()["window_evidence"])
        at = [[d[0] for d in result.description].index(c) for c in ("window_start_us", "batch_id")]
        wanted = sorted(tuple(r[i] for i in at) for r in result.fetchall())
    assert wanted and sorted((r["window_start_us"], r["batch_id"]) for r in found.collect()) == wanted
