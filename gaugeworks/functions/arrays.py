"""Statistics over arrays of readings, as JVM-side higher-order functions.

Every helper works on the samples of one bounded group (a window), so a window
needs one shuffle in total however many statistics are asked of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAT_NAMES = (
    "mean",
    "std",
    "min",
    "max",
    "p25",
    "p50",
    "p75",
    "p90",
    "p95",
    "mad",
    "iqr",
    "range",
    "cv",
    "slope",
    "autocorr_lag1",
)
QUANTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}


def zero() -> Column:
    return F.lit(0.0)


def div(value: Column, by: Column | int) -> Column:
    """Whole-number division without a detour through doubles."""
    return F.call_function("div", value, F.lit(by) if isinstance(by, int) else by)


def once(frame: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a generator, so later filters and lambdas never repeat them."""
    packed = F.array(F.struct(*[value.alias(name) for name, value in columns.items()]))
    return frame.select("*", F.inline(packed))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (lambdas share no subexpressions)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def quantile(ordered: Column, probability: float) -> Column:
    """Linear interpolation at (n - 1) * p over an ascending array; null when empty."""
    position = (F.size(ordered) - 1) * F.lit(float(probability))
    low = F.floor(position).cast("int")
    high = F.ceil(position).cast("int")
    fraction = position - low
    return F.when(
        F.size(ordered) > 0,
        F.get(ordered, low) * (1 - fraction) + F.get(ordered, high) * fraction,
    )


def median(values: Column) -> Column:
    return let(F.sort_array(values), lambda ordered: quantile(ordered, 0.5))


def mean(values: Column) -> Column:
    total = F.aggregate(values, zero(), lambda acc, v: acc + v)
    return F.when(F.size(values) > 0, total / F.nullif(F.size(values), F.lit(0)))


def _sum(pairs: Column, term: Callable[[Column], Column]) -> Column:
    # A scalar fold per sum is far cheaper than one fold that rebuilds a struct per element.
    return F.aggregate(pairs, zero(), lambda acc, p: acc + term(p))


def centred(pairs: Column) -> Column:
    """struct<n, x0, y0, mx, my, xx, yy, xy> of array<struct<x, y>>; null when empty.

    Two passes: means first, then moments of the deviations. Shifting by the first pair
    keeps a constant series at exactly zero.
    """
    names = ("n", "x0", "y0", "mx", "my")

    def means(h: Column) -> Column:
        return F.struct(
            *[h[c].alias(c) for c in ("n", "x0", "y0")],
            (_sum(pairs, lambda p: p["x"] - h["x0"]) / h["n"]).alias("mx"),
            (_sum(pairs, lambda p: p["y"] - h["y0"]) / h["n"]).alias("my"),
        )

    def deviations(h: Column) -> Column:
        return F.transform(
            pairs,
            lambda p: F.struct(
                (p["x"] - h["x0"] - h["mx"]).alias("x"), (p["y"] - h["y0"] - h["my"]).alias("y")
            ),
        )

    def moments(h: Column) -> Column:
        return let(
            deviations(h),
            lambda d: F.struct(
                *[h[c].alias(c) for c in names],
                _sum(d, lambda p: p["x"] * p["x"]).alias("xx"),
                _sum(d, lambda p: p["y"] * p["y"]).alias("yy"),
                _sum(d, lambda p: p["x"] * p["y"]).alias("xy"),
            ),
        )

    first = F.get(pairs, F.lit(0))
    head = F.struct(
        F.size(pairs).cast("double").alias("n"), first["x"].alias("x0"), first["y"].alias("y0")
    )
    return F.when(F.size(pairs) > 0, let(head, lambda h: let(means(h), moments)))


def correlation(pairs: Column) -> Column:
    """Pearson; null for fewer than two pairs or no variance on a side."""
    return let(
        centred(pairs),
        lambda c: F.when(
            (c["n"] >= 2) & (c["xx"] > 0) & (c["yy"] > 0),
            c["xy"] / F.nullif(F.sqrt(c["xx"] * c["yy"]), zero()),
        ),
    )


def lagged(left: Column, right: Column) -> Column:
    """Pairs (left[i], right[i + 1])."""
    steps = F.greatest(F.size(left) - 1, F.lit(0))
    return F.zip_with(
        F.slice(left, F.lit(1), steps),
        F.slice(right, F.lit(2), steps),
        lambda x, y: F.struct(x.alias("x"), y.alias("y")),
    )


def lag_correlation(left: Column, right: Column) -> Column:
    return F.when(F.size(left) > 2, let(lagged(left, right), correlation))


def series_stats(series: Column) -> Column:
    """The fifteen window statistics of array<struct<x: seconds, y: value>> in time order.

    ``sort_array`` compares natively; ``array_sort`` would run a lambda per comparison.
    """

    def finish(s: Column) -> Column:
        c, ordered, values = s["c"], s["ordered"], s["values"]
        average = c["y0"] + c["my"]
        spread = F.sqrt(c["yy"] / c["n"])
        q = s["q"]
        low, high = F.get(ordered, F.lit(0)), F.get(ordered, F.size(ordered) - 1)
        return F.struct(
            average.alias("mean"),
            spread.alias("std"),
            low.alias("min"),
            high.alias("max"),
            *[q[name].alias(name) for name in QUANTILES],
            median(F.transform(ordered, lambda v: F.abs(v - q["p50"]))).alias("mad"),
            (q["p75"] - q["p25"]).alias("iqr"),
            (high - low).alias("range"),
            F.when(average != 0, spread / F.nullif(F.abs(average), zero())).alias("cv"),
            F.when((c["n"] >= 2) & (c["xx"] > 0), c["xy"] / F.nullif(c["xx"], zero())).alias(
                "slope"
            ),
            lag_correlation(values, values).alias("autocorr_lag1"),
        )

    def with_quantiles(s: Column) -> Column:
        return let(
            F.struct(
                *[s[c].alias(c) for c in ("c", "ordered", "values")],
                F.struct(
                    *[quantile(s["ordered"], p).alias(name) for name, p in QUANTILES.items()]
                ).alias("q"),
            ),
            finish,
        )

    values = F.transform(series, lambda e: e["y"])
    return let(
        F.struct(
            centred(series).alias("c"),
            F.sort_array(values).alias("ordered"),
            values.alias("values"),
        ),
        with_quantiles,
    )


def bursts(series: Column, threshold: Column) -> Column:
    """Runs of consecutive readings above ``threshold``: count, durations, longest run.

    A run lasts from its first to its last reading plus the median step.
    """
    steps = F.zip_with(
        F.slice(series, F.lit(1), F.greatest(F.size(series) - 1, F.lit(0))),
        F.slice(series, F.lit(2), F.greatest(F.size(series) - 1, F.lit(0))),
        lambda a, b: b["x"] - a["x"],
    )

    def scan(step: Column) -> Column:
        def close(acc: Column) -> dict[str, Column]:
            open_run = acc["len"] > 0
            duration = F.greatest(zero(), acc["last"] - acc["first"] + step)
            return {
                "n": F.when(open_run, acc["n"] + 1).otherwise(acc["n"]),
                "total": F.when(open_run, acc["total"] + duration).otherwise(acc["total"]),
                "peak": F.when(open_run, F.greatest(acc["peak"], duration)).otherwise(acc["peak"]),
                "longest": F.greatest(acc["longest"], acc["len"]),
            }

        def merge(acc: Column, e: Column) -> Column:
            active = e["y"] > threshold
            closed = close(acc)
            kept = {
                name: F.when(active, acc[name]).otherwise(value) for name, value in closed.items()
            }
            first = F.when(active & (acc["len"] == 0), e["x"]).otherwise(acc["first"])
            return F.struct(
                *[kept[name].alias(name) for name in ("n", "total", "peak", "longest")],
                F.when(active, acc["len"] + 1).otherwise(F.lit(0)).alias("len"),
                first.alias("first"),
                F.when(active, e["x"]).otherwise(acc["last"]).alias("last"),
            )

        start = F.struct(
            F.lit(0).alias("n"),
            zero().alias("total"),
            zero().alias("peak"),
            F.lit(0).alias("longest"),
            F.lit(0).alias("len"),
            zero().alias("first"),
            zero().alias("last"),
        )
        return F.aggregate(
            series,
            start,
            merge,
            lambda acc: F.struct(*[v.alias(k) for k, v in close(acc).items()]),
        )

    return let(F.coalesce(median(steps), zero()), scan)
