"""Windows of whole Arrow batches: the statistics of :mod:`windows` for many windows at a time.

Spark shuffles and sorts the samples by (run, block); a task reads its partition as Arrow batches, never
holding more than a batch and the block it ends in. Overlapping windows are index tables into the
batch, one row a window, so a sample travels once and a statistic is one Numpy call for all windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.functions.arrays import QUANTILES, STAT_NAMES
from gaugeworks.operators import windows as W

#: Samples that are taken together.
BATCH_ROWS = 40_000
EVERY_KEY = ("run_id", "window_seconds", "window_index", "window_start_ns", "window_end_ns")


@dataclass
class Windows:
    """Windows of like size. ``at[g]`` has the rows of device g in time order (-1: none), ``pairs`` the
    positions of paired samples in them; ``values`` and ``known`` have one row per field."""

    keys: dict[str, pa.Array]
    at: list[np.ndarray]
    ns: np.ndarray
    values: np.ndarray
    known: np.ndarray
    names: list[str]
    other: dict[str, pa.Array]
    pairs: list[np.ndarray] | None = None

    def counts(self, g: int) -> np.ndarray:
        return (self.at[g] >= 0).sum(axis=1)

    def seconds(self, g: int) -> np.ndarray:
        return (self.ns[self.at[g]] - self.ns[self.at[g][:, :1]]) / 1e9

    def readings(self, g: int, field: int, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        at = self.at[g] if at is None else at
        return self.values[field][at], self.known[field][at] & (at >= 0)

    def traffic(self, g: int, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        (tx, a), (rx, b) = (self.readings(g, self.names.index(name), at) for name in (W.TX, W.RX))
        return tx + rx, a & b

    def paired(self, g: int) -> np.ndarray:
        """Rows of the paired samples of device g."""
        return np.where(self.pairs[g] >= 0, np.take_along_axis(self.at[g], np.maximum(self.pairs[g], 0), 1), -1)

    def where(self, kept: np.ndarray) -> Windows:
        keys = {name: column.filter(pa.array(kept)) for name, column in self.keys.items()}
        pairs = None if self.pairs is None else [p[kept] for p in self.pairs]
        return Windows(keys, [a[kept] for a in self.at], self.ns, self.values, self.known, self.names, self.other, pairs)


def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about ``BATCH_ROWS`` rows or more that end where a (run, block) ends."""
    held, rows, asked = [], 0, BATCH_ROWS
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < asked:
            continue
        one = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        starts = np.flatnonzero(_changes(one))
        cut = int(starts[-1]) if len(starts) else 0
        if cut:
            yield one.slice(0, cut)
        held = [one.slice(cut)]
        rows = one.num_rows - cut
        asked = max(BATCH_ROWS, 2 * rows)
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _changes(batch: pa.RecordBatch) -> np.ndarray:
    """True where a row begins another (run, block) than the row before it."""
    found = np.zeros(batch.num_rows, bool)
    for name in ("run_id", "block"):
        column = batch.column(name)
        found[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return found


def _ranges(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. up to each count, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def cut_windows(
    batch: pa.RecordBatch, lengths: Sequence[float], stride_fraction: float, fields: Sequence[str]
) -> Iterator[Windows]:
    """Complete windows with two samples of either device, those of like size together."""
    longs = {n: batch.column(n).to_numpy() for n in ("mono_ns", "start_ns", "span_ns", "block")}
    gpu = batch.column("gpu_index").to_numpy()
    group = np.cumsum(_changes(batch))
    values = [pc.fill_null(batch.column(f).cast(pa.float64()), 0.0).to_numpy() for f in fields]
    known = [batch.column(f).is_valid().to_numpy(zero_copy_only=False) for f in fields]
    values = np.array(values).reshape(len(fields), batch.num_rows)
    known = np.array(known, bool).reshape(len(fields), batch.num_rows)
    sizes, stride_of = W.window_sizes(lengths, stride_fraction)
    block_ns = max(sizes.values()) * W.BLOCK_WINDOWS
    offset = longs["mono_ns"] - longs["start_ns"]
    for seconds, size in sizes.items():
        stride = stride_of[seconds]
        low = np.where(offset < size, 0, (offset - size) // stride + 1)
        high = np.minimum(offset // stride, (longs["span_ns"] - size) // stride)
        count = np.where(((gpu == 0) | (gpu == 1)) & (longs["span_ns"] >= size), np.maximum(high - low + 1, 0), 0)
        row = np.repeat(np.arange(len(offset)), count)
        index = low[row] + _ranges(count)
        own = index * stride // block_ns == longs["block"][row]
        row, index = row[own], index[own]
        if not len(row):
            continue
        # Rows come in time order; a stable sort keeps it inside a window and device.
        order = np.lexsort((gpu[row], index, group[row]))
        row, index = row[order], index[order]
        first = np.ones(len(row), bool)
        first[1:] = (index[1:] != index[:-1]) | (group[row][1:] != group[row][:-1])
        window = np.cumsum(first) - 1
        per = np.bincount(window * 2 + gpu[row], minlength=2 * (window[-1] + 1)).reshape(-1, 2)
        rank = _ranges(per.ravel())
        whole = (per >= 2).all(axis=1)
        width = np.ceil(np.log2(per.max(axis=1))).astype(int)
        for bits in np.unique(width[whole]):
            chosen = whole & (width == bits)
            place = np.cumsum(chosen) - 1
            wide = int(per[chosen].max())
            at = [np.full((int(chosen.sum()), wide), -1) for _ in (0, 1)]
            for g in (0, 1):
                mine = chosen[window] & (gpu[row] == g)
                at[g][place[window[mine]], rank[mine]] = row[mine]
            head = row[first][chosen]
            start = longs["start_ns"][head] + index[first][chosen] * stride
            keys = {
                "run_id": batch.column("run_id").take(pa.array(head)),
                "window_seconds": pa.array(np.full(len(head), float(seconds))),
                "window_index": pa.array(index[first][chosen]),
                "window_start_ns": pa.array(start),
                "window_end_ns": pa.array(start + size),
            }
            yield Windows(keys, at, longs["mono_ns"], values, known, list(fields), {"sequence": batch.column("sequence")})


def pair(found: Windows, tolerance_seconds: float) -> Windows:
    """Windows with two pairs or more: the heads of both devices are compared, in all windows at once."""
    tolerance = int(tolerance_seconds * 1e9)
    rows = np.arange(len(found.at[0]))
    n = [found.counts(g) for g in (0, 1)]
    clock = [found.ns[found.at[g]] for g in (0, 1)]
    place = [np.zeros(len(rows), int) for _ in (0, 1)]
    pairs = [np.full((len(rows), min(a.shape[1] for a in found.at)), -1) for _ in (0, 1)]
    count = np.zeros(len(rows), int)
    while len(rows):
        i, j = place[0][rows], place[1][rows]
        delta = clock[0][rows, i] - clock[1][rows, j]
        near = np.abs(delta) <= tolerance
        hit = rows[near]
        pairs[0][hit, count[hit]], pairs[1][hit, count[hit]] = i[near], j[near]
        count[hit] += 1
        place[0][rows] += near | (delta < 0)
        place[1][rows] += near | (delta > 0)
        rows = rows[(place[0][rows] < n[0][rows]) & (place[1][rows] < n[1][rows])]
    found.pairs = pairs
    return found.where(count >= 2)


# --- Statistics: one row a series, ``ok`` marks its values -----------------------------------------
def packed(ok: np.ndarray, *series: np.ndarray) -> tuple[np.ndarray, ...]:
    """Values moved to the front of their rows: how many there are, then the series (zero behind them)."""
    n = ok.sum(axis=1)
    front = np.arange(ok.shape[1]) < n[:, None]
    gaps = np.flatnonzero((ok != front).any(axis=1))
    out = []
    order = np.argsort(~ok[gaps], axis=1, kind="stable") if len(gaps) else None
    for s in series:
        s = s.copy()
        if order is not None:
            s[gaps] = np.take_along_axis(s[gaps], order, 1)
        s[~front] = 0.0
        out.append(s)
    return (n, *out)


def _over(a: np.ndarray, b: np.ndarray, valid: np.ndarray | bool = True) -> np.ndarray:
    """Quotient, masked where the divisor is zero or the row is not valid."""
    valid = valid & (b != 0)
    return np.ma.array(np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=valid), mask=~valid)


def mean_of(n: np.ndarray, s: np.ndarray) -> np.ma.MaskedArray:
    return _over(s.sum(axis=1), n)


def deviations(n: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean, and deviations from it by way of the first value, so a constant series has none."""
    front = np.arange(s.shape[1]) < n[:, None]
    shifted = np.where(front, s - s[:, :1], 0.0)
    middle = shifted.sum(axis=1) / np.maximum(n, 1)
    return s[:, 0] + middle, np.where(front, shifted - middle[:, None], 0.0)


def correlation(n: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ma.MaskedArray:
    if not x.shape[1]:
        return np.ma.masked_all(len(n))
    dx, dy = deviations(n, x)[1], deviations(n, y)[1]
    xx, yy = (dx * dx).sum(axis=1), (dy * dy).sum(axis=1)
    return _over((dx * dy).sum(axis=1), np.sqrt(xx * yy), (n >= 2) & (xx > 0) & (yy > 0))


def lag_correlation(n: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ma.MaskedArray:
    fewer = np.maximum(n - 1, 0)
    front = np.arange(x.shape[1] - 1) < fewer[:, None]
    found = correlation(fewer, np.where(front, x[:, :-1], 0.0), np.where(front, y[:, 1:], 0.0))
    return np.ma.array(found, mask=np.ma.getmaskarray(found) | (n <= 2))


def quantile(n: np.ndarray, ordered: np.ndarray, p: float) -> np.ma.MaskedArray:
    position = np.maximum(n - 1, 0) * p
    low, high = np.floor(position).astype(int), np.ceil(position).astype(int)
    part = position - low
    rows = np.arange(len(n))
    return np.ma.array(ordered[rows, low] * (1 - part) + ordered[rows, high] * part, mask=n == 0)


def ascending(n: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.sort(np.where(np.arange(s.shape[1]) < n[:, None], s, np.nan), axis=1)


def series_stats(n: np.ndarray, x: np.ndarray, y: np.ndarray) -> dict[str, np.ma.MaskedArray]:
    """The fifteen statistics of packed series."""
    none = n == 0
    middle, dy = deviations(n, y)
    dx = deviations(n, x)[1]
    xx = (dx * dx).sum(axis=1)
    average = np.ma.array(middle, mask=none)
    spread = np.ma.array(np.sqrt((dy * dy).sum(axis=1) / np.maximum(n, 1)), mask=none)
    ordered = ascending(n, y)
    q = {name: quantile(n, ordered, p) for name, p in QUANTILES.items()}
    low = np.ma.array(ordered[:, 0], mask=none)
    high = np.ma.array(ordered[np.arange(len(n)), np.maximum(n - 1, 0)], mask=none)
    away = np.sort(np.abs(ordered - q["p50"].data[:, None]), axis=1)
    found = {
        "mean": average,
        "std": spread,
        "min": low,
        "max": high,
        **q,
        "mad": quantile(n, away, 0.5),
        "iqr": q["p75"] - q["p25"],
        "range": high - low,
        "cv": _over(spread.data, np.abs(middle), ~none),
        "slope": _over((dx * dy).sum(axis=1), xx, (n >= 2) & (xx > 0)),
        "autocorr_lag1": lag_correlation(n, y, y),
    }
    return {name: found[name] for name in STAT_NAMES}


def field_stats(found: Windows, g: int, field: int) -> dict[str, np.ma.MaskedArray]:
    y, ok = found.readings(g, field)
    n, x, y = packed(ok, found.seconds(g), y)
    return series_stats(n, x, y) | {"missing_fraction": 1 - n / found.counts(g)}


def device_summary(found: Windows, g: int) -> dict[str, np.ma.MaskedArray]:
    util, ok = found.readings(g, found.names.index("gpu_utilization_pct"))
    n = ok.sum(axis=1)
    total, both = found.traffic(g)
    tx, rx = (
        mean_of(both.sum(axis=1), np.where(both, found.readings(g, found.names.index(name))[0], 0.0)) for name in (W.TX, W.RX)
    )
    return {
        "utilization_idle_fraction": _over((ok & (util <= 5)).sum(axis=1), n),
        "utilization_duty_cycle": _over((ok & ~(util <= 5)).sum(axis=1), n),
        "pcie_total_mean_bytes_per_s": mean_of(both.sum(axis=1), np.where(both, total, 0.0)),
        "pcie_tx_rx_ratio": _over(tx.data, rx.data, ~np.ma.getmaskarray(tx)),
    }


def bursts(n: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    """Runs of readings above the threshold: how many, their whole and greatest duration, the longest run."""
    front = np.arange(x.shape[1]) < n[:, None]
    steps = np.maximum(n - 1, 0)
    step = quantile(steps, ascending(steps, np.diff(x, axis=1)), 0.5).filled(0.0) if x.shape[1] > 1 else np.zeros(len(n))
    active = np.pad(front & (y > threshold), ((0, 0), (1, 1)))
    row, start = np.nonzero(active[:, 1:-1] & ~active[:, :-2])
    end = np.nonzero(active[:, 1:-1] & ~active[:, 2:])[1]
    duration = np.maximum(0.0, x[row, end] - x[row, start] + step[row])
    peak, longest = np.zeros(len(n)), np.zeros(len(n), int)
    np.maximum.at(peak, row, duration)
    np.maximum.at(longest, row, end - start + 1)
    return np.bincount(row, minlength=len(n)), np.bincount(row, duration, len(n)), peak, longest


def communication(found: Windows, g: int, threshold: float | None) -> dict[str, np.ma.MaskedArray]:
    y, ok = found.traffic(g)
    n, x, y = packed(ok, found.seconds(g), y)
    s = series_stats(n, x, y)
    gate = np.inf if threshold is None else threshold
    hidden = (n == 0) | (threshold is None)
    count, total, peak, longest = bursts(n, x, y, gate)
    active = _over(((np.arange(y.shape[1]) < n[:, None]) & (y > gate)).sum(axis=1), n).filled(0.0)
    gated = lambda value: np.ma.array(value, mask=hidden)
    columns = (
        s["mean"], s["p50"], s["max"], s["p90"], s["p95"], s["std"], s["mad"], s["cv"], s["autocorr_lag1"],
        n / found.counts(g), gated(active), gated(active), gated(count), gated(total / np.maximum(count, 1)),
        gated(peak), gated(longest), gated(1 - active),
    )
    return dict(zip(W.COMMUNICATION_NAMES, columns, strict=True))


def cross_stats(ok: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, dict[str, np.ma.MaskedArray]]:
    """Number of pairs, and their differences and correlations."""
    n, x, y = packed(ok, x, y)
    difference, scale = mean_of(n, np.abs(x - y)), mean_of(n, np.abs(x) + np.abs(y)) / 2
    values = (
        difference, _over(difference.data, scale.filled(0.0), n > 0), correlation(n, x, y), lag_correlation(n, x, y)
    )
    return n, dict(zip(W.CROSS_NAMES, values, strict=True))


def field_cross(found: Windows, field: int) -> tuple[np.ndarray, dict[str, np.ma.MaskedArray]]:
    (x, a), (y, b) = (found.readings(g, field, found.paired(g)) for g in (0, 1))
    return cross_stats(a & b, x, y)


def traffic_cross(found: Windows) -> dict[str, np.ma.MaskedArray]:
    """Correlation and asymmetry of the total traffic, paired by position and by time."""

    def both(ok: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ma.MaskedArray, np.ma.MaskedArray]:
        n, s = cross_stats(ok, x, y)
        even = s["normalized_divergence"]
        return s["correlation"], np.ma.array(even.filled(0.0), mask=n == 0)

    sides = []
    for g in (0, 1):
        value, ok = found.traffic(g)
        sides.append(packed(ok, value))
    wide = min(s[1].shape[1] for s in sides)
    shared = np.minimum(sides[0][0], sides[1][0])
    front = np.arange(wide) < shared[:, None]
    position = both(front, sides[0][1][:, :wide], sides[1][1][:, :wide])
    (x, a), (y, b) = (found.traffic(g, found.paired(g)) for g in (0, 1))
    time = both(a & b, x, y)
    return dict(zip(("correlation", "asymmetry", "correlation_aligned", "asymmetry_aligned"), (*position, *time), strict=True))


def alignment(found: Windows) -> dict[str, np.ndarray]:
    left, right = (found.paired(g) for g in (0, 1))
    gap = np.where(left >= 0, np.abs(found.ns[left] - found.ns[right]), 0)
    return {"aligned_sample_pairs": (left >= 0).sum(axis=1), "alignment_max_delta_seconds": gap.max(axis=1) / 1e9}


# --- Spark side ------------------------------------------------------------------------------------
def _column(value, kind: pa.DataType) -> pa.Array:
    if isinstance(value, (pa.Array, pa.ChunkedArray)):
        return value.cast(kind)
    return pa.array(np.ma.getdata(value), mask=np.ma.getmaskarray(value), from_pandas=False).cast(kind)


def map_windows(
    samples: DataFrame,
    lengths: Sequence[float],
    fields: Sequence[str],
    rows: Callable[[Windows], Iterator[dict]],
    columns: dict[str, T.DataType],
    keys: Sequence[str] = W.WINDOW_KEYS,
    tolerance_seconds: float | None = None,
    stride_fraction: float = 0.5,
) -> DataFrame:
    """``rows`` of all windows over the samples of :func:`windows.block_samples`, after their ``keys``."""
    fields = list(fields)
    order = [*("run_id", "block", "mono_ns", "sequence"), *fields]
    kept = [*("run_id", "block", "gpu_index", "mono_ns", "sequence", "start_ns", "span_ns"), *fields]
    ordered = samples.select(*kept).sortWithinPartitions(*order)
    kinds = {"run_id": samples.schema["run_id"].dataType, "window_seconds": T.DoubleType()}
    schema = T.StructType([T.StructField(k, kinds.get(k, T.LongType())) for k in keys])
    for name, kind in columns.items():
        schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in whole_blocks(batches):
            for found in cut_windows(batch, lengths, stride_fraction, fields):
                if tolerance_seconds is not None:
                    found = pair(found, tolerance_seconds)
                if not len(found.at[0]):
                    continue
                for part in rows(found):
                    given = {**found.keys, **part}
                    yield pa.RecordBatch.from_arrays([_column(given[f.name], f.type) for f in target], schema=target)

    return ordered.mapInArrow(run, schema)


DOUBLE, LONG = T.DoubleType(), T.LongType()


def _doubles(names: Sequence[str]) -> dict[str, T.DataType]:
    return dict.fromkeys(names, DOUBLE)


def _by_device(found: Windows, table: Callable[[Windows, int], dict]) -> Iterator[dict]:
    for g in (0, 1):
        yield {"gpu_index": np.full(len(found.at[0]), g)} | table(found, g)


def field_table(samples: DataFrame, lengths: Sequence[float], fields: Sequence[str]) -> DataFrame:
    """Long form: one row per (run, window, device, field) with the fifteen statistics."""

    def rows(found: Windows) -> Iterator[dict]:
        for i, name in enumerate(found.names):
            label = pa.repeat(name, len(found.at[0]))
            yield from _by_device(found, lambda w, g, i=i, label=label: {"field": label} | field_stats(w, g, i))

    columns = {"gpu_index": T.IntegerType(), "field": T.StringType()} | _doubles([*STAT_NAMES, "missing_fraction"])
    return map_windows(samples, lengths, fields, rows, columns)


def device_table(samples: DataFrame, lengths: Sequence[float]) -> DataFrame:
    """One row per (run, window, device) with its utilization shares and traffic means."""
    columns = {"gpu_index": T.IntegerType()} | _doubles(W.DEVICE_NAMES)
    fields = ("gpu_utilization_pct", W.TX, W.RX)
    return map_windows(samples, lengths, fields, lambda found: _by_device(found, device_summary), columns)


def _communication_columns() -> dict[str, T.DataType]:
    return {n: LONG if n in ("burst_count", "longest_consecutive_burst") else DOUBLE for n in W.COMMUNICATION_NAMES}


def communication_table(samples: DataFrame, lengths: Sequence[float], threshold: float | None) -> DataFrame:
    """One row per (run, window, device) with the summary of its total traffic."""
    columns = {"gpu_index": T.IntegerType()} | _communication_columns()

    def rows(found: Windows) -> Iterator[dict]:
        return _by_device(found, lambda w, g: communication(w, g, threshold))

    return map_windows(samples, lengths, (W.TX, W.RX), rows, columns)


def alignment_table(samples: DataFrame, lengths: Sequence[float], tolerance: float) -> DataFrame:
    columns = {"aligned_sample_pairs": LONG, "alignment_max_delta_seconds": DOUBLE}
    return map_windows(samples, lengths, (), lambda found: iter([alignment(found)]), columns, tolerance_seconds=tolerance)


def cross_table(samples: DataFrame, lengths: Sequence[float], fields: Sequence[str], tolerance: float) -> DataFrame:
    """One row per (run, window, field) that has a pair of readings."""

    def rows(found: Windows) -> Iterator[dict]:
        for i, name in enumerate(found.names):
            n, values = field_cross(found, i)
            some = n > 0
            keys = {k: column.filter(pa.array(some)) for k, column in found.keys.items()}
            yield keys | {"field": pa.repeat(name, int(some.sum()))} | {k: v[some] for k, v in values.items()}

    columns = {"field": T.StringType()} | _doubles(W.CROSS_NAMES)
    return map_windows(samples, lengths, fields, rows, columns, tolerance_seconds=tolerance)


def traffic_table(samples: DataFrame, lengths: Sequence[float], tolerance: float) -> DataFrame:
    columns = _doubles(("correlation", "asymmetry", "correlation_aligned", "asymmetry_aligned"))
    return map_windows(
        samples, lengths, (W.TX, W.RX), lambda found: iter([traffic_cross(found)]), columns, tolerance_seconds=tolerance
    )


def feature_table(
    samples: DataFrame, lengths: Sequence[float], fields: Sequence[str], tolerance: float, threshold: float | None
) -> DataFrame:
    """The wide feature row of every kept window (about 400 numeric columns)."""
    fields = list(fields)
    columns = {"sample_count_gpu0": LONG, "sample_count_gpu1": LONG, "aligned_sample_pairs": LONG, "alignment_max_delta_seconds": DOUBLE}
    columns |= _doubles([f"gpu{g}__{f}__{s}" for g in (0, 1) for f in fields for s in STAT_NAMES])
    columns |= _doubles([f"gpu{g}__{f}__missing_fraction" for g in (0, 1) for f in fields])
    columns |= _doubles([f"gpu{g}__{n}" for g in (0, 1) for n in W.DEVICE_NAMES])
    for g in (0, 1):
        columns |= {f"gpu{g}__pcie_total__{n}": kind for n, kind in _communication_columns().items()}
    columns |= _doubles([f"cross_gpu__{f}__{s}" for f in fields for s in W.CROSS_NAMES])
    columns |= _doubles([f"cross_gpu__pcie_total__{s}" for s in ("correlation", "asymmetry", "correlation_aligned", "asymmetry_aligned")])

    def rows(found: Windows) -> Iterator[dict]:
        yield wide_rows(found, threshold)

    return map_windows(samples, lengths, fields, rows, columns, EVERY_KEY, tolerance)


def wide_rows(found: Windows, threshold: float | None) -> dict[str, np.ma.MaskedArray]:
    row = alignment(found)
    for g in (0, 1):
        row[f"sample_count_gpu{g}"] = found.counts(g)
        for i, f in enumerate(found.names):
            row |= {f"gpu{g}__{f}__{s}": v for s, v in field_stats(found, g, i).items()}
        row |= {f"gpu{g}__{n}": v for n, v in device_summary(found, g).items()}
        row |= {f"gpu{g}__pcie_total__{n}": v for n, v in communication(found, g, threshold).items()}
    for i, f in enumerate(found.names):
        row |= {f"cross_gpu__{f}__{s}": v for s, v in field_cross(found, i)[1].items()}
    return row | {f"cross_gpu__pcie_total__{s}": v for s, v in traffic_cross(found).items()}


def feature_means(
    samples: DataFrame,
    lengths: Sequence[float],
    fields: Sequence[str],
    tolerance: float,
    threshold: float | None,
    columns: Sequence[str],
    rounding: Callable[[np.ndarray], np.ndarray] = np.asarray,
) -> DataFrame:
    """Mean of wide columns per (run, window length): one row for each column that has a value.

    A batch adds up its windows of a run, so the wide rows never leave the task. ``rounding`` is
    applied to the fractional columns of a window first.
    """
    names = list(columns)

    def rows(found: Windows) -> Iterator[dict]:
        wide = wide_rows(found, threshold)
        cells = [np.ma.asarray(wide[c]) for c in names]
        values = np.array([rounding(c.filled(0)) if c.dtype.kind == "f" else c.filled(0).astype(float) for c in cells])
        known = np.array([~np.ma.getmaskarray(c) for c in cells])
        run = found.keys["run_id"]
        starts = np.ones(len(run), bool)
        starts[1:] = pc.not_equal(run[1:], run[:-1]).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(starts)
        part = {k: column.take(pa.array(at)) for k, column in found.keys.items()}
        for name, sums in (("filled", np.add.reduceat(known.astype(int), at, axis=1)), ("total", np.add.reduceat(values * known, at, axis=1))):
            part[name] = pa.FixedSizeListArray.from_arrays(pa.array(sums.T.ravel()), len(names))
        yield part

    sums = map_windows(
        samples, lengths, fields, rows, {"filled": T.ArrayType(LONG), "total": T.ArrayType(DOUBLE)},
        ("run_id", "window_seconds"), tolerance,
    )
    keys = ["run_id", "window_seconds", "position"]
    cells = sums.select(*keys[:2], F.posexplode(F.arrays_zip("filled", "total")).alias("position", "cell"))
    added = cells.groupBy(*keys).agg(F.sum("cell.filled").alias("filled"), F.sum("cell.total").alias("total")).where("filled > 0")
    return added.select(
        *keys[:2],
        F.get(F.array(*[F.lit(c) for c in names]), F.col("position")).alias("column_name"),
        F.col("filled").alias("filled_windows"),
        (F.col("total") / F.col("filled")).alias("mean"),
    )


def kept_windows(samples: DataFrame, lengths: Sequence[float], tolerance: float) -> DataFrame:
    """The keys of every window that two samples of either device and two pairs keep."""
    return map_windows(samples, lengths, (), lambda found: iter([{}]), {}, tolerance_seconds=tolerance)


def pair_table(samples: DataFrame, lengths: Sequence[float], tolerance: float) -> DataFrame:
    """One row per pair: clocks and sequence numbers of both samples."""

    def rows(found: Windows) -> Iterator[dict]:
        left, right = (found.paired(g) for g in (0, 1))
        window, at = np.nonzero(left >= 0)
        left, right = left[window, at], right[window, at]
        part = {k: column.take(pa.array(window)) for k, column in found.keys.items()}
        part |= {"left_ns": found.ns[left], "right_ns": found.ns[right]}
        sequence = found.other["sequence"]
        yield part | {f"{side}_sequence": sequence.take(pa.array(at)) for side, at in (("left", left), ("right", right))}

    columns = dict.fromkeys(("left_ns", "right_ns"), LONG) | dict.fromkeys(
        ("left_sequence", "right_sequence"), samples.schema["sequence"].dataType
    )
    return map_windows(samples, lengths, (), rows, columns, tolerance_seconds=tolerance)
