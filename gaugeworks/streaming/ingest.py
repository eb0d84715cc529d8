"""Message ingest as a Structured Streaming job.

Rules without state are the same expressions as in the batch job. The ordered step keeps
per-agent state: last sequence, last batch id, and the digest of every accepted id as a
map state entry, so one id is looked up without loading an agent's history.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gaugeworks.operators.ingest import (
    MAXIMUM_PAYLOAD_BYTES,
    MAXIMUM_SKEW_SECONDS,
    STEP_COLUMNS,
    AgentState,
    accepted_samples,
    parse,
    skew_flags,
    stateless_reasons,
)
from gaugeworks.schemas import TELEMETRY_FIELDS

REQUEST_SCHEMA = "arrival bigint, received_at timestamp, raw string, signature string"
OUTCOME_SCHEMA = "agent_id string, arrival bigint, message_id string, outcome string"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OrderedIngest(StatefulProcessor):
    """Steps the messages of one agent in arrival order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.position = handle.getValueState("position", "last_sequence bigint, last_batch string")
        self.accepted = handle.getMapState("accepted", "message_id string", "digest string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = AgentState()
        if self.position.exists():
            state.last_sequence, state.last_batch = self.position.get()
        # Spark gives no row order inside a micro-batch; the batch bounds what is sorted here.
        batch = pd.concat(list(rows)).sort_values("arrival")
        outcomes = []
        for row in batch.itertuples(index=False):
            wrapped = (row.message_id,)
            if row.message_id not in state.accepted and self.accepted.containsKey(wrapped):
                state.accepted[row.message_id] = self.accepted.getValue(wrapped)[0]
            outcome = state.step(row)
            if outcome == "accepted":
                self.accepted.updateValue(wrapped, (row.digest,))
            outcomes.append(outcome)
        if state.last_sequence is not None:
            self.position.update((state.last_sequence, state.last_batch))
        yield pd.DataFrame(
            {
                "agent_id": key[0],
                "arrival": batch["arrival"].to_numpy(),
                "message_id": batch["message_id"].to_numpy(),
                "outcome": outcomes,
            }
        )

    def close(self) -> None:
        pass


def request_stream(spark: SparkSession, path: str) -> DataFrame:
    """Requests that producers drop as JSON lines into a folder."""
    return spark.readStream.schema(REQUEST_SCHEMA).json(path)


def checked_stream(
    requests: DataFrame,
    registry: DataFrame,
    session: str,
    maximum_bytes: int = MAXIMUM_PAYLOAD_BYTES,
    skew_seconds: float = MAXIMUM_SKEW_SECONDS,
) -> DataFrame:
    """Requests with reason, digest and skew flags; works on streams and tables alike."""
    checked = stateless_reasons(parse(requests), registry, session, maximum_bytes)
    return skew_flags(checked, skew_seconds).withColumn(
        "is_batch", F.col("message_type") == "telemetry_batch"
    )


def outcome_stream(checked: DataFrame) -> DataFrame:
    """Acknowledgements: rejected by rule at once, the rest by per-agent state."""
    rejected = checked.where("reason IS NOT NULL").select(
        "agent_id", "arrival", "message_id", F.col("reason").alias("outcome")
    )
    pending = checked.where("reason IS NULL").select(*STEP_COLUMNS)
    stepped = pending.groupBy("agent_id").transformWithStateInPandas(
        statefulProcessor=OrderedIngest(),
        outputStructType=OUTCOME_SCHEMA,
        outputMode="append",
        timeMode="none",
    )
    return stepped.unionByName(rejected)


def write_acknowledgements(path: str):
    """A foreachBatch writer: each micro-batch owns one folder, so a replay replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def first_acknowledgements(acknowledgements: DataFrame) -> DataFrame:
    """The acknowledgement a client sees for an id: the first one given wins."""
    return acknowledgements.groupBy("message_id").agg(F.min_by("outcome", "arrival").alias("outcome"))


def window_means_stream(
    accepted: DataFrame, size: str, slide: str | None = None, skew_seconds: float = MAXIMUM_SKEW_SECONDS
) -> DataFrame:
    """Per-node window means of a stream of accepted messages.

    The watermark equals the skew limit: a row later than that was rejected on ingest.
    """
    samples = accepted_samples(accepted).withWatermark("observed_at", f"{int(skew_seconds)} seconds")
    window = F.window("observed_at", size, slide) if slide else F.window("observed_at", size)
    return samples.groupBy(window.alias("w"), "node_id").agg(
        F.count(F.lit(1)).alias("sample_count"), *[F.avg(f).alias(f) for f in TELEMETRY_FIELDS]
    ).select(
        F.unix_micros("w.start").alias("window_start_us"), "node_id", "sample_count", *TELEMETRY_FIELDS
    )
