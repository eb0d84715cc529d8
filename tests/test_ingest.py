"""Signing, rules, ordered state, and the streaming job against the batch job."""

import hashlib
import hmac
import json
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import ingest as I
from gaugeworks.operators import signing
from gaugeworks.operators.signing import hmac_sha256, padded_keys, signing_keys
from gaugeworks.schemas import FIELD_UNITS, TELEMETRY_FIELDS
from gaugeworks.streaming import ingest as ST

SECRET = "top"


def sample(**changes):
    body = {
        "sample_id": "s",
        "observed_at_utc": "2024-01-01T00:00:00Z",
        "monotonic_ns": 1,
        "gpu_index": 0,
        "gpu_uuid": "GPU-0",
        "sequence_number": 0,
        "rank": 0,
        "process_id": 1,
        "configuration_hash": "c",
        "validity_flags": {},
        "telemetry_support_flags": {},
        "fields": {n: {"value": 1.0, "unit": u, "supported": True, "error": None} for n, u in FIELD_UNITS.items()},
    }
    body.update(changes)
    return body


def batch(n, sequence=None, previous=None, agent="a", **changes):
    body = {
        "batch_id": f"b{n}",
        "agent_id": agent,
        "node_id": "n",
        "experiment_session_id": "s",
        "sequence": n if sequence is None else sequence,
        "created_at_utc": "2024-01-01T00:00:00Z",
        "monotonic_start_ns": 0,
        "monotonic_end_ns": 1,
        "samples": [sample()],
        "previous_batch_id": previous,
        "protocol_version": "1.0",
        "message_type": "telemetry_batch",
    }
    body.update(changes)
    return body


def requests(spark, bodies, secret=SECRET):
    rows = []
    for arrival, body in enumerate(bodies):
        raw = json.dumps(body, sort_keys=True, separators=(",", ":"))
        rows.append((arrival, "2024-01-01T00:00:01Z", raw, hmac.new(secret.encode(), raw.encode(), hashlib.sha256).hexdigest()))
    frame = spark.createDataFrame(rows, "arrival bigint, received_at string, raw string, signature string")
    return frame.withColumn("received_at", F.try_to_timestamp("received_at"))


@pytest.fixture(scope="module")
def registry(spark):
    return spark.createDataFrame([("a", "n", SECRET), ("b", "n", SECRET)], "agent_id string, node_id string, secret string")


def outcomes(spark, registry, bodies, **kwargs):
    checked = I.stateless_reasons(I.parse(requests(spark, bodies, **kwargs)), registry, "s")
    return [r["outcome"] for r in I.ordered_outcomes(checked).orderBy("arrival").collect()]


def test_hmac_equals_the_standard_library(spark):
    secrets = ["k", "x" * 64, "long" * 40]
    frame = spark.createDataFrame([(str(i), "n", s) for i, s in enumerate(secrets)], "agent_id string, node_id string, secret string")
    found = signing_keys(frame).select(
        "agent_id", hmac_sha256(F.col("inner_pad"), F.col("outer_pad"), F.lit("héllo")).alias("h")
    )
    for row in found.collect():
        key = secrets[int(row["agent_id"])].encode()
        assert row["h"] == hmac.new(key, "héllo".encode(), hashlib.sha256).hexdigest()
    with pytest.raises(ValueError):
        padded_keys(b"")


def test_rules_in_order(spark, registry):
    reading = {n: {"value": 1.0, "unit": u, "supported": True, "error": None} for n, u in FIELD_UNITS.items()}
    broken = {**reading, "power_draw_w": {"value": None, "unit": "watts", "supported": True, "error": None}}
    bodies = [
        batch(0, protocol_version="2.0"),
        batch(0, agent="z"),
        batch(0, node_id="other"),
        batch(0, experiment_session_id="t"),
        batch(0, message_type="noise"),
        batch(0, created_at_utc="2024-01-01T00:00:00"),
        batch(0, sequence=-1),
        batch(0, samples=[]),
        batch(0, samples=[sample(prompt_text="x")]),
        batch(0, samples=[sample(surprise=1)]),
        batch(0, samples=[{k: v for k, v in sample().items() if k != "rank"}]),
        batch(0, samples=[sample(process_id=0)]),
        batch(0, samples=[sample(fields=broken)]),
        batch(0),
    ]
    assert outcomes(spark, registry, bodies) == [
        "unsupported_protocol_version",
        "unknown_agent",
        "node_identity_mismatch",
        "session_mismatch",
        "unknown_message_type",
        "invalid_message",
        "invalid_message",
        "invalid_message",
        "privacy_violation",
        "privacy_violation",
        "invalid_sample",
        "invalid_sample",
        "invalid_sample",
        "accepted",
    ]


def test_wrong_secret_is_rejected(spark, registry):
    assert outcomes(spark, registry, [batch(0)], secret="other") == ["invalid_signature"]


STORY = [
    (batch(0), "accepted"),
    (batch(0), "already_accepted"),
    (batch(0, samples=[sample(rank=1)]), "message_id_conflict"),
    (batch(2, previous="b0"), "sequence_gap"),
    (batch(1, previous="bx"), "batch_chain_mismatch"),
    (batch(1, previous="b0"), "accepted"),
    (batch(9, sequence=1, previous="b1"), "stale_sequence"),
    (batch(2, previous="b1", created_at_utc="2024-01-01T00:01:00Z"), "clock_skew"),
    (batch(2, previous="b1", samples=[sample(observed_at_utc="2023-12-31T23:59:00Z")]), "sample_clock_skew"),
    (
        {
            **{k: v for k, v in batch(2).items() if k not in ("batch_id", "samples", "previous_batch_id")},
            "heartbeat_id": "h2",
            "message_type": "heartbeat",
        },
        "accepted",
    ),
    (batch(3, previous="b1"), "accepted"),
    # An id of its own: ids belong to all agents (see the tests of shared ids below).
    (batch(5, sequence=0, agent="b"), "accepted"),
]


def test_ordered_state(spark, registry):
    assert outcomes(spark, registry, [b for b, _ in STORY]) == [o for _, o in STORY]


def test_stream_equals_batch(spark, registry):
    """The same story in three files, one per micro-batch, with state carried between them."""
    folder, state = tempfile.mkdtemp(prefix="spark-", dir="/tmp"), tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = requests(spark, [b for b, _ in STORY])
    for part in range(3):
        piece = rows.where(F.col("arrival").between(part * 4, part * 4 + 3)).coalesce(1)
        piece.withColumn("received_at", F.lit("2024-01-01T00:00:01Z")).write.mode("append").json(f"{folder}/in")
    stream = spark.readStream.schema(ST.REQUEST_SCHEMA).option("maxFilesPerTrigger", 1).json(f"{folder}/in")
    checked = ST.checked_stream(stream, registry, "s")
    query = (
        ST.outcome_stream(checked)
        .writeStream.option("checkpointLocation", state)
        .foreachBatch(ST.write_acknowledgements(f"{folder}/acks"))
        .trigger(availableNow=True)
        .start()
    )
    try:
        assert query.awaitTermination(300)
    finally:
        query.stop()
    acks = spark.read.parquet(f"{folder}/acks")
    found = {r["arrival"]: r["outcome"] for r in acks.collect()}
    # Files are read in time order; each holds whole arrivals, so the order is the story's.
    assert [found[i] for i in range(len(STORY))] == [o for _, o in STORY]
    first = {r["message_id"]: r["outcome"] for r in ST.first_acknowledgements(acks).collect()}
    assert first["b2"] == "sequence_gap" and first["b0"] == "accepted"


def test_window_means_stream(spark, registry):
    folder, state = tempfile.mkdtemp(prefix="spark-", dir="/tmp"), tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    stamps = ["2024-01-01T00:00:00Z", "2024-01-01T00:00:04Z", "2024-01-01T00:00:11Z", "2024-01-01T00:05:00Z"]
    bodies = [batch(i, samples=[sample(observed_at_utc=s)]) for i, s in enumerate(stamps)]
    requests(spark, bodies).withColumn("received_at", F.lit("2024-01-01T00:00:01Z")).coalesce(1).write.json(f"{folder}/in")
    parsed = I.parse(ST.request_stream(spark, f"{folder}/in"))
    query = (
        ST.window_means_stream(parsed, "10 seconds")
        .writeStream.format("memory")
        .queryName("window_means")
        .option("checkpointLocation", state)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    try:
        assert query.awaitTermination(300)
    finally:
        query.stop()
    counts = sorted(r["sample_count"] for r in spark.sql("SELECT * FROM window_means").collect())
    assert counts == [1, 2]


def test_decisions(spark):
    rows = [(1, True, 0, 0, 0.9), (2, True, 0, 0, 0.55), (3, False, 1, 2, 0.9), (4, True, 0, 0, 1.5)]
    frame = spark.createDataFrame(rows, "window_start_us bigint, complete boolean, missing_nodes int, missing_agents int, score double")
    found = {r["window_start_us"]: (r["score"], r["abstained"], r["reason"]) for r in I.decide(frame, lambda w: w["score"], 0.5, 0.1).collect()}
    assert found[1] == (0.9, False, "score_outside_margin")
    assert found[2] == (0.55, True, "score_within_abstention_margin")
    assert found[3] == (None, True, "missing_nodes=1 missing_agents=2")
    assert found[4] == (None, True, "score_out_of_range")


def test_key_order_and_spacing_do_not_matter(spark, registry):
    body = batch(0)
    raw = json.dumps(dict(reversed(body.items())), indent=2)
    signature = hmac.new(SECRET.encode(), json.dumps(body, sort_keys=True, separators=(",", ":")).encode(), hashlib.sha256).hexdigest()
    assert signing.canonical_json(raw) == signing.canonical_json(json.dumps(body))
    frame = spark.createDataFrame([(raw, signature)], "raw string, signature string")
    row = frame.select(signing.canonical(F.col("raw")).alias("text"), "signature").first()
    assert hmac.new(SECRET.encode(), row["text"].encode(), hashlib.sha256).hexdigest() == signature
    assert [signing.canonical_json(x) for x in (None, "", "[1]", "{", '{"a":NaN}')] == [None] * 5


def test_windows_name_silent_and_stale_members(spark):
    registry = spark.createDataFrame([("a", "n1"), ("b", "n1"), ("c", "n2"), ("d", "n3")], "agent_id string, node_id string")
    plan = I.WindowPlan("2024-01-01T00:00:00Z", 60, 3)
    rows = [("a", "n1", 5), ("a", "n1", 65), ("b", "n1", 6), ("c", "n2", 7), ("c", "n2", 179), ("a", "n1", 180), ("x", "n9", 8)]
    columns = ", ".join(f"{f} double" for f in TELEMETRY_FIELDS)
    samples = spark.createDataFrame(
        [(f"m{i}", a, n, 1704067200 + at, 0, "GPU", *([float(at)] * len(TELEMETRY_FIELDS))) for i, (a, n, at) in enumerate(rows)],
        f"batch_id string, agent_id string, node_id string, at long, rank int, gpu_uuid string, {columns}",
    ).withColumn("observed_at", F.timestamp_seconds("at"))
    states = {"a": "healthy", "b": "healthy", "c": "stale", "d": "missing"}
    agents = spark.createDataFrame(list(states.items()), "agent_id string, status string")
    nodes = spark.createDataFrame([("n1", "healthy"), ("n2", "stale"), ("n3", "missing")], "node_id string, status string")
    by_node = I.node_windows(samples, nodes, plan)
    by_agent = I.agent_windows(samples, registry, agents, plan)
    first, size = plan.start_us, plan.size_us
    counts = {(r["window_start_us"], r["node_id"]): r["sample_count"] for r in by_node.collect()}
    assert len(counts) == 9
    assert counts[(first, "n1")] == 2 and counts[(first + 2 * size, "n1")] == 0 and counts[(first + 2 * size, "n2")] == 1
    assert {r["sample_count"] for r in by_agent.where("agent_id = 'd'").collect()} == {0}
    names = {tuple(r) for r in I.missing_members(by_node, by_agent).collect()}
    assert {n for n in names if n[0] == first} == {(first, "node", "n2"), (first, "node", "n3"), (first, "agent", "c"), (first, "agent", "d")}
    whole = {r["window_start_us"]: (r["missing_nodes"], r["missing_agents"], r["complete"]) for r in I.window_completeness(by_node, by_agent).collect()}
    assert whole[first] == (2, 2, False) and whole[first + size] == (2, 3, False)
    healthy = I.node_windows(samples, nodes.where("node_id = 'n1'"), plan)
    only_a = I.agent_windows(samples, registry, agents.where("agent_id = 'a'"), plan)
    assert {r["window_start_us"]: r["complete"] for r in I.window_completeness(healthy, only_a).collect()}[first + size]
    with pytest.raises(ValueError):
        I.WindowPlan("2024-01-01T00:00:00Z", 0, 1)


def globally(bodies):
    """One message after the other: ids belong to all agents, sequence and chain to one."""
    ids, last, chain, found = {}, {}, {}, []
    for body in bodies:
        agent, key = body["agent_id"], body["batch_id"]
        digest = json.dumps(body, sort_keys=True)
        if key in ids:
            found.append("already_accepted" if ids[key] == digest else "message_id_conflict")
        elif agent in last and body["sequence"] <= last[agent]:
            found.append("stale_sequence")
        elif agent in last and body["sequence"] != last[agent] + 1:
            found.append("sequence_gap")
        elif agent in chain and body["previous_batch_id"] != chain[agent]:
            found.append("batch_chain_mismatch")
        else:
            ids[key], last[agent], chain[agent] = digest, body["sequence"], key
            found.append("accepted")
    return found


def test_an_id_belongs_to_one_agent(spark, registry):
    bodies = [batch(1), batch(1, agent="b"), batch(2, previous="b1"), batch(3, 1, agent="b"), batch(1), batch(3, 3, previous="b2")]
    found = outcomes(spark, registry, bodies)
    assert found == ["accepted", "message_id_conflict", "accepted", "accepted", "already_accepted", "message_id_conflict"]
    assert found == globally(bodies)


@pytest.mark.parametrize("seed", range(3))
def test_shared_ids_against_one_global_order(spark, seed):
    rng = random.Random(seed)
    agents = "abcde"
    registry = spark.createDataFrame([(a, "n", SECRET) for a in agents], "agent_id string, node_id string, secret string")
    after, bodies = dict.fromkeys(agents, (0, None)), []
    for _ in range(70):
        agent = rng.choice(agents)
        number, last = after[agent]
        key = rng.randrange(40)
        bodies.append(batch(key, number + rng.choice((0, 1, 1, 1, 2)), previous=last, agent=agent))
        if globally(bodies)[-1] == "accepted":
            after[agent] = (bodies[-1]["sequence"], bodies[-1]["batch_id"])
        if rng.random() < 0.2:
            bodies.append(rng.choice(bodies))
    wanted = globally(bodies)
    assert {"accepted", "message_id_conflict", "already_accepted"} <= set(wanted)
    assert outcomes(spark, registry, bodies) == wanted


def test_a_silent_window_is_decided(spark):
    silent = spark.createDataFrame([(0, False, 2, 3, None), (1, True, 0, 0, 0.9)], "window_start_us bigint, complete boolean, missing_nodes int, missing_agents int, mean double")
    rows = {r.window_start_us: r for r in I.decide(silent, lambda _: F.col("mean"), 0.5, 0.1).collect()}
    assert rows[0].abstained and rows[0].score is None and rows[0].reason == "missing_nodes=2 missing_agents=3"
    assert not rows[1].abstained and rows[1].score == 0.9
