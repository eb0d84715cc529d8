"""Event-time windows per run, and the statistics of one window.

Plan shape: telemetry is joined to one row of bounds per run, cut into long time
blocks, shuffled once on (run, block), and only then expanded to the overlapping
windows. A block holds several of the longest windows, so each sample crosses the
network about once instead of once per window, and a run that holds a large share
of all rows still spreads over as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions import arrays as A
from gaugeworks.functions.arrays import div, once
from gaugeworks.schemas import TELEMETRY_FIELDS

NS = 1_000_000_000
WINDOW_KEYS = ("run_id", "window_seconds", "window_index")
BLOCK_WINDOWS = 8
TX, RX = "pcie_tx_bytes_per_s", "pcie_rx_bytes_per_s"


def reading(name: str):
    return lambda sample: sample[name]


def supported(name: str):
    return lambda sample: sample[name].isNotNull()


def on_device(gpu: int):
    return lambda sample: sample["gpu_index"] == gpu


def check_window_arguments(lengths: Sequence[float], stride_fraction: float, tolerance: float) -> None:
    if not lengths or any(float(w) <= 0 for w in lengths):
        raise ValueError(f"every window needs a length above zero, got {sorted(lengths)}")
    if len(set(lengths)) != len(lengths):
        raise ValueError(f"each window length once, got {sorted(lengths)}")
    if not 0 < stride_fraction <= 1:
        raise ValueError(f"a stride is a part of the window, above 0 and up to 1, got {stride_fraction}")
    if tolerance < 0:
        raise ValueError(f"samples pair within zero seconds or more, got {tolerance}")


def run_bounds(telemetry: DataFrame, runs: DataFrame | None, exclude_startup: bool = True) -> DataFrame:
    """Usable interval per run: the common interval of both devices after warm-up.

    ``end_ns`` is exclusive (last common sample + 1 ns). Only runs with both devices
    remain. One map-side-combined aggregate over two columns.
    """
    ns, gpu = F.col("mono_ns"), F.col("gpu_index")
    common = (
        telemetry.groupBy("run_id")
        .agg(
            *[F.min(F.when(gpu == g, ns)).alias(f"first_{g}") for g in (0, 1)],
            *[F.max(F.when(gpu == g, ns)).alias(f"last_{g}") for g in (0, 1)],
        )
        .where("first_0 IS NOT NULL AND first_1 IS NOT NULL")
        .select(
            "run_id",
            F.greatest("first_0", "first_1").alias("common_start_ns"),
            F.least("last_0", "last_1").alias("common_end_ns"),
        )
    )
    if runs is None or not exclude_startup:
        return common.select(
            "run_id", F.col("common_start_ns").alias("start_ns"), (F.col("common_end_ns") + 1).alias("end_ns")
        )
    return common.join(runs, "run_id").select(
        "run_id",
        F.when(
            F.col("measurement_start_ns").isNotNull(),
            F.greatest("common_start_ns", "measurement_start_ns"),
        )
        .otherwise(
            F.col("common_start_ns")
            + (F.coalesce("warmup_seconds", F.lit(0.0)) * NS).cast("long")
        )
        .alias("start_ns"),
        F.least(F.col("common_end_ns") + 1, F.col("measurement_end_ns") + 1).alias("end_ns"),
    )


def window_sizes(lengths: Sequence[float], stride_fraction: float = 0.5) -> tuple[dict[float, int], dict[float, int]]:
    """Size and stride of every length, in nanoseconds."""
    sizes = {w: int(float(w) * NS) for w in lengths}
    return sizes, {w: max(1, int(size * stride_fraction)) for w, size in sizes.items()}


def block_samples(telemetry: DataFrame, bounds: DataFrame, lengths: Sequence[float], stride_fraction: float = 0.5) -> DataFrame:
    """Samples inside their run's bounds with ``start_ns``, ``offset_ns`` and ``span_ns``, hash-partitioned
    on (run_id, block), once for every block that owns a window over them."""
    longest = max(window_sizes(lengths, stride_fraction)[0].values())
    block_ns = longest * BLOCK_WINDOWS
    offset, span = F.col("mono_ns") - F.col("start_ns"), F.col("end_ns") - F.col("start_ns")
    samples = (
        telemetry.join(bounds, "run_id")
        .where((offset >= 0) & (offset < span))
        .withColumn("offset_ns", offset)
        .withColumn("span_ns", span)
        .drop("end_ns")
    )
    first_block = div(F.greatest(F.lit(0), F.col("offset_ns") - longest + 1), block_ns)
    blocks = samples.withColumn(
        "block", F.explode(F.sequence(first_block, div(F.col("offset_ns"), block_ns)))
    )
    # A fixed count: the stage after this shuffle is heavy on CPU, not on bytes, so the
    # byte-based coalescing of AQE would leave cores idle.
    parts = int(telemetry.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(parts, "run_id", "block")


def assign_windows(
    telemetry: DataFrame,
    bounds: DataFrame,
    lengths: Sequence[float],
    stride_fraction: float = 0.5,
) -> DataFrame:
    """Samples expanded to their complete windows, hash-partitioned on (run_id, block).

    The range join sample-in-window is pure arithmetic on the offset from the run's
    own origin, so no pair outside a window is ever produced.
    """
    sizes, strides = window_sizes(lengths, stride_fraction)
    block_ns = max(sizes.values()) * BLOCK_WINDOWS
    blocks = block_samples(telemetry, bounds, lengths, stride_fraction)
    spec = F.array(
        *[
            F.struct(
                F.lit(float(w)).alias("seconds"),
                F.lit(size).cast("long").alias("size"),
                F.lit(strides[w]).cast("long").alias("stride"),
            )
            for w, size in sizes.items()
        ]
    )

    def indices(s: Column) -> Column:
        # A block owns the windows that start inside it.
        own_low = div(F.col("block") * block_ns + s["stride"] - 1, s["stride"])
        own_high = div((F.col("block") + 1) * block_ns + s["stride"] - 1, s["stride"]) - 1
        low = F.when(F.col("offset_ns") < s["size"], F.lit(0).cast("long")).otherwise(
            div(F.col("offset_ns") - s["size"], s["stride"]) + 1
        )
        high = div(F.col("offset_ns"), s["stride"])
        last_complete = div(F.col("span_ns") - s["size"], s["stride"])
        low, high = F.greatest(low, own_low), F.least(high, own_high, last_complete)
        return F.when(
            (F.col("span_ns") >= s["size"]) & (low <= high),
            F.transform(
                F.sequence(low, high),
                lambda k: F.struct(
                    s["seconds"].alias("seconds"),
                    k.alias("index"),
                    (k * s["stride"]).alias("shift"),
                    s["size"].alias("size"),
                ),
            ),
        ).otherwise(F.array().cast("array<struct<seconds:double,index:bigint,shift:bigint,size:bigint>>"))

    return (
        blocks.withColumn("w", F.explode(F.flatten(F.transform(spec, indices))))
        .withColumn("window_seconds", F.col("w.seconds"))
        .withColumn("window_index", F.col("w.index"))
        .withColumn("window_start_ns", F.col("start_ns") + F.col("w.shift"))
        .withColumn("window_end_ns", F.col("start_ns") + F.col("w.shift") + F.col("w.size"))
        .drop("w", "offset_ns", "span_ns", "start_ns")
    )


def window_samples(
    assigned: DataFrame, fields: Iterable[str], tolerance_seconds: float | None = None
) -> DataFrame:
    """One row per (run, window): time-ordered samples per device, and their pairs.

    Grouping keys contain the partitioning keys of :func:`assign_windows`, so no
    further shuffle happens. A group is bounded by window length over sampling
    interval. Windows with fewer than two samples of a device are rejected, and
    with a tolerance also those with fewer than two pairs; indices keep their gaps.
    """
    fields = list(fields)
    sample = F.struct("gpu_index", "mono_ns", "sequence", *fields)
    grouped = assigned.groupBy(
        "run_id", "block", "window_seconds", "window_index", "window_start_ns", "window_end_ns"
    ).agg(F.sort_array(F.collect_list(sample)).alias("samples"))
    sides = once(
        grouped,
        **{f"gpu{g}": F.filter("samples", on_device(g)) for g in (0, 1)},
    ).where("size(gpu0) >= 2 AND size(gpu1) >= 2")
    if tolerance_seconds is not None:
        pairs = pair_by_time(F.col("gpu0"), F.col("gpu1"), tolerance_seconds)
        sides = once(sides, pairs=pairs).where("size(pairs) >= 2")
    return sides.drop("samples", "block")


def pair_by_time(left: Column, right: Column, tolerance_seconds: float) -> Column:
    """Pairs of two time-ordered sample arrays within a tolerance, without reuse.

    Compares the two heads: close enough makes a pair and advances both, otherwise
    the earlier one is dropped. Each step advances a side, so n + m steps suffice.
    """
    tolerance = F.lit(int(tolerance_seconds * 1e9)).cast("long")
    clocks = F.struct(
        F.transform(left, reading("mono_ns")).alias("l"),
        F.transform(right, reading("mono_ns")).alias("r"),
    )

    def scan(clocks: Column) -> Column:
        l_ns, r_ns = clocks["l"], clocks["r"]
        empty = F.array().cast("array<struct<i:int,j:int>>")

        def step(acc: Column, _: Column) -> Column:
            i, j = acc["i"], acc["j"]
            delta = F.get(l_ns, i) - F.get(r_ns, j)
            near = F.abs(delta) <= tolerance
            return F.when(
                (i >= F.size(l_ns)) | (j >= F.size(r_ns)), acc
            ).otherwise(
                F.struct(
                    F.when(near | (delta < 0), i + 1).otherwise(i).alias("i"),
                    F.when(near | (delta > 0), j + 1).otherwise(j).alias("j"),
                    F.when(
                        near,
                        F.array_append(acc["pairs"], F.struct(i.alias("i"), j.alias("j"))),
                    )
                    .otherwise(acc["pairs"])
                    .alias("pairs"),
                )
            )

        return F.aggregate(
            F.sequence(F.lit(1), F.size(l_ns) + F.size(r_ns)),
            F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), empty.alias("pairs")),
            step,
            lambda acc: acc["pairs"],
        )

    return F.transform(
        A.let(clocks, scan),
        lambda p: F.struct(F.get(left, p["i"]).alias("l"), F.get(right, p["j"]).alias("r")),
    )


def series(samples: Column, value) -> Column:
    """array<struct<x, y>> of the supported readings; x is seconds since the first sample."""


    def readings(origin: Column) -> Column:
        return F.transform(
            samples,
            lambda s: F.struct(
                ((s["mono_ns"] - origin) / F.lit(1e9)).alias("x"), value(s).alias("y")
            ),
        )

    return F.filter(
        A.let(F.get(samples, F.lit(0))["mono_ns"], readings), lambda e: e["y"].isNotNull()
    )


def total_traffic(sample: Column) -> Column:
    return sample[TX] + sample[RX]


def value_rows(samples: Column, fields: Sequence[str]) -> Column:
    """array<struct<x: seconds since the first sample, v: array of field values>>."""

    def rows(origin: Column) -> Column:
        return F.transform(
            samples,
            lambda s: F.struct(
                ((s["mono_ns"] - origin) / F.lit(1e9)).alias("x"),
                F.array(*[s[name] for name in fields]).alias("v"),
            ),
        )

    return A.let(F.get(samples, F.lit(0))["mono_ns"], rows)


def series_at(rows: Column, index: Column) -> Column:
    """The series of one field, by its position in ``v``; unsupported readings left out."""
    return F.filter(
        F.transform(rows, lambda s: F.struct(s["x"].alias("x"), F.get(s["v"], index).alias("y"))),
        lambda e: e["y"].isNotNull(),
    )


def field_stats(windows: DataFrame, fields: Sequence[str] = TELEMETRY_FIELDS) -> DataFrame:
    """Long form: one row per (run, window, device, field) with the fifteen statistics."""
    devices = F.array(
        *[
            F.struct(F.lit(g).alias("gpu_index"), value_rows(F.col(f"gpu{g}"), fields).alias("rows"))
            for g in (0, 1)
        ]
    )
    names = F.array(*[F.lit(name) for name in fields])
    rows = windows.select(*WINDOW_KEYS, F.inline(devices)).select(
        *WINDOW_KEYS, "gpu_index", "rows", F.posexplode(names).alias("position", "field")
    )
    staged = once(rows, series=series_at(F.col("rows"), F.col("position")))
    return staged.withColumn("s", A.series_stats(F.col("series"))).select(
        *WINDOW_KEYS,
        "gpu_index",
        "field",
        *[F.col(f"s.{name}").alias(name) for name in A.STAT_NAMES],
        (1 - F.size("series") / F.size("rows")).alias("missing_fraction"),
    )


COMMUNICATION_NAMES = (
    "mean",
    "median",
    "maximum",
    "p90",
    "p95",
    "std",
    "mad",
    "coefficient_of_variation",
    "periodicity_lag1_autocorrelation",
    "sampling_validity_fraction",
    "fraction_above_idle_threshold",
    "communication_duty_cycle",
    "burst_count",
    "average_burst_duration_s",
    "maximum_burst_duration_s",
    "longest_consecutive_burst",
    "near_idle_sample_fraction",
)


def communication(samples: Column, threshold: Column) -> Column:
    """Summary of total (TX + RX) traffic of one device; gate columns null without threshold."""

    def body(traffic: Column) -> Column:
        return A.let(
            F.struct(
                traffic.alias("t"),
                A.series_stats(traffic).alias("s"),
                F.when(F.size(traffic) > 0, A.bursts(traffic, threshold)).alias("b"),
                (
                    F.size(F.filter(traffic, lambda e: e["y"] > threshold))
                    / F.nullif(F.size(traffic), F.lit(0))
                ).alias("active"),
            ),
            finish,
        )

    def finish(r: Column) -> Column:
        s = r["s"]
        known = threshold.isNotNull() & (F.size(r["t"]) > 0)

        def gated(value: Column) -> Column:
            return F.when(known, value)

        b = r["b"]
        return F.struct(
            s["mean"].alias("mean"),
            s["p50"].alias("median"),
            s["max"].alias("maximum"),
            s["p90"].alias("p90"),
            s["p95"].alias("p95"),
            s["std"].alias("std"),
            s["mad"].alias("mad"),
            s["cv"].alias("coefficient_of_variation"),
            s["autocorr_lag1"].alias("periodicity_lag1_autocorrelation"),
            (F.size(r["t"]) / F.nullif(F.size(samples), F.lit(0))).alias("sampling_validity_fraction"),
            gated(r["active"]).alias("fraction_above_idle_threshold"),
            gated(r["active"]).alias("communication_duty_cycle"),
            gated(b["n"]).cast("long").alias("burst_count"),
            gated(F.when(b["n"] > 0, b["total"] / F.nullif(b["n"], F.lit(0))).otherwise(0.0)).alias(
                "average_burst_duration_s"
            ),
            gated(b["peak"]).alias("maximum_burst_duration_s"),
            gated(b["longest"]).cast("long").alias("longest_consecutive_burst"),
            gated(1 - r["active"]).alias("near_idle_sample_fraction"),
        )

    return A.let(series(samples, total_traffic), body)


DEVICE_NAMES = (
    "utilization_idle_fraction",
    "utilization_duty_cycle",
    "pcie_total_mean_bytes_per_s",
    "pcie_tx_rx_ratio",
)


def device_summary(samples: Column) -> dict[str, Column]:
    """Utilization shares (idle at 5 percent or less) and the TX/RX means ratio."""
    util = F.filter(
        F.transform(samples, lambda s: s["gpu_utilization_pct"]), lambda v: v.isNotNull()
    )
    count = F.nullif(F.size(util), F.lit(0))
    both = F.filter(samples, lambda s: total_traffic(s).isNotNull())
    tx, rx = A.mean(F.transform(both, lambda s: s[TX])), A.mean(F.transform(both, lambda s: s[RX]))
    return {
        "utilization_idle_fraction": F.size(F.filter(util, lambda v: v <= 5)) / count,
        "utilization_duty_cycle": F.size(F.filter(util, lambda v: v > 5)) / count,
        "pcie_total_mean_bytes_per_s": A.mean(F.transform(both, total_traffic)),
        "pcie_tx_rx_ratio": tx / F.nullif(rx, F.lit(0.0)),
    }


CROSS_NAMES = ("mean_abs_difference", "normalized_divergence", "correlation", "lag1_correlation")


def cross_stats(pairs: Column) -> Column:
    """Differences and correlations of array<struct<x, y>> of paired readings."""

    def finish(d: Column) -> Column:
        return F.struct(
            d["difference"].alias("mean_abs_difference"),
            (d["difference"] / F.nullif(d["scale"], F.lit(0.0))).alias("normalized_divergence"),
            A.correlation(pairs).alias("correlation"),
            A.lag_correlation(
                F.transform(pairs, lambda p: p["x"]), F.transform(pairs, lambda p: p["y"])
            ).alias("lag1_correlation"),
        )

    return A.let(
        F.struct(
            A.mean(F.transform(pairs, lambda p: F.abs(p["x"] - p["y"]))).alias("difference"),
            (A.mean(F.transform(pairs, lambda p: F.abs(p["x"]) + F.abs(p["y"]))) / 2).alias("scale"),
        ),
        finish,
    )


def paired_readings(pairs: Column, value) -> Column:
    return F.filter(
        F.transform(pairs, lambda p: F.struct(value(p["l"]).alias("x"), value(p["r"]).alias("y"))),
        lambda p: p["x"].isNotNull() & p["y"].isNotNull(),
    )


def positional_traffic_pairs(left: Column, right: Column) -> Column:
    """Total traffic of the two devices paired by position among valid readings."""
    x, y = (
        F.filter(F.transform(side, total_traffic), lambda v: v.isNotNull()) for side in (left, right)
    )
    shared = F.least(F.size(x), F.size(y))
    return F.zip_with(
        F.slice(x, F.lit(1), shared),
        F.slice(y, F.lit(1), shared),
        lambda a, b: F.struct(a.alias("x"), b.alias("y")),
    )


def asymmetry(pairs: Column) -> Column:
    """Mean absolute difference over mean magnitude; zero when the magnitude is zero."""
    difference = A.mean(F.transform(pairs, lambda p: F.abs(p["x"] - p["y"])))
    scale = A.mean(F.transform(pairs, lambda p: F.abs(p["x"]) + F.abs(p["y"]))) / 2
    return F.when(scale == 0, F.lit(0.0)).otherwise(difference / F.nullif(scale, F.lit(0.0)))


def feature_rows(
    windows: DataFrame,
    threshold: float | None,
    fields: Sequence[str] = TELEMETRY_FIELDS,
) -> DataFrame:
    """The wide feature row of every kept window (about 400 numeric columns)."""
    gate = F.lit(threshold).cast("double")
    samples = {g: F.col(f"gpu{g}") for g in (0, 1)}
    positions = F.sequence(F.lit(0), F.lit(len(fields) - 1))
    # Fields are addressed by position, so the plan holds one expression for all of them.
    ready = once(
        windows,
        **{f"rows{g}": value_rows(samples[g], fields) for g in (0, 1)},
        both=F.transform(
            "pairs",
            lambda p: F.struct(
                F.array(*[p["l"][name] for name in fields]).alias("l"),
                F.array(*[p["r"][name] for name in fields]).alias("r"),
            ),
        ),
    )

    def stats(g: int) -> Column:
        return F.transform(
            positions, lambda i: A.let(series_at(F.col(f"rows{g}"), i), A.series_stats)
        )

    def missing(g: int) -> Column:
        rows = F.col(f"rows{g}")
        return F.transform(
            positions,
            lambda i: 1
            - F.size(F.filter(rows, lambda s: F.get(s["v"], i).isNotNull())) / F.size(rows),
        )

    def pairs_at(i: Column) -> Column:
        return F.filter(
            F.transform(
                "both", lambda p: F.struct(F.get(p["l"], i).alias("x"), F.get(p["r"], i).alias("y"))
            ),
            lambda p: p["x"].isNotNull() & p["y"].isNotNull(),
        )

    def traffic(pairs: Column) -> Column:
        return A.let(pairs, lambda p: F.struct(A.correlation(p).alias("c"), asymmetry(p).alias("a")))

    staged = ready.select(
        *WINDOW_KEYS,
        "window_start_ns",
        "window_end_ns",
        F.size("gpu0").cast("long").alias("sample_count_gpu0"),
        F.size("gpu1").cast("long").alias("sample_count_gpu1"),
        F.size("pairs").cast("long").alias("aligned_sample_pairs"),
        (
            F.array_max(
                F.transform("pairs", lambda p: F.abs(p["l"]["mono_ns"] - p["r"]["mono_ns"]))
            )
            / F.lit(1e9)
        ).alias("alignment_max_delta_seconds"),
        *[stats(g).alias(f"stats{g}") for g in (0, 1)],
        *[missing(g).alias(f"missing{g}") for g in (0, 1)],
        *[
            F.struct(*[c.alias(n) for n, c in device_summary(samples[g]).items()]).alias(f"dev{g}")
            for g in (0, 1)
        ],
        *[communication(samples[g], gate).alias(f"comm{g}") for g in (0, 1)],
        F.transform(positions, lambda i: A.let(pairs_at(i), cross_stats)).alias("cross"),
        traffic(positional_traffic_pairs(samples[0], samples[1])).alias("by_position"),
        traffic(paired_readings(F.col("pairs"), total_traffic)).alias("by_time"),
    )
    columns = [
        f"stats{g}[{i}].`{stat}` AS `gpu{g}__{name}__{stat}`"
        for g in (0, 1)
        for i, name in enumerate(fields)
        for stat in A.STAT_NAMES
    ]
    columns += [
        f"missing{g}[{i}] AS `gpu{g}__{name}__missing_fraction`"
        for g in (0, 1)
        for i, name in enumerate(fields)
    ]
    columns += [f"dev{g}.`{name}` AS `gpu{g}__{name}`" for g in (0, 1) for name in DEVICE_NAMES]
    columns += [
        f"comm{g}.`{name}` AS `gpu{g}__pcie_total__{name}`"
        for g in (0, 1)
        for name in COMMUNICATION_NAMES
    ]
    columns += [
        f"cross[{i}].`{stat}` AS `cross_gpu__{name}__{stat}`"
        for i, name in enumerate(fields)
        for stat in CROSS_NAMES
    ]
    return staged.selectExpr(
        *WINDOW_KEYS,
        "window_start_ns",
        "window_end_ns",
        "sample_count_gpu0",
        "sample_count_gpu1",
        "aligned_sample_pairs",
        "alignment_max_delta_seconds",
        *columns,
        "by_position.c AS cross_gpu__pcie_total__correlation",
        "by_position.a AS cross_gpu__pcie_total__asymmetry",
        "by_time.c AS cross_gpu__pcie_total__correlation_aligned",
        "by_time.a AS cross_gpu__pcie_total__asymmetry_aligned",
    )
