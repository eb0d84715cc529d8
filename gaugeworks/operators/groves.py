"""A forest whose trees grow inside tasks, a few to a task, and score there.

Fully grown trees have about as many nodes as rows, so 300 of them fill a driver; here no tree leaves
its task, and what comes back is one sum per row and task. Training rows travel as one byte per column,
the number of the cut they lie below. Settings are those of Spark's forest: Poisson samples, ``sqrt``
columns drawn per node, weighted Gini gain, leaves of two rows. Leaves are not merged afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.session import cut_lineage

#: Cuts of a column and one more; a byte numbers them.
BINS = 256
#: Ranks that the cuts are exact to.
RANKS = 10_000
#: Tasks that share the trees.
GROVES = 24
LEAF_ROWS = 2
#: Gains below this are what is left by rounding.
LEAST_GAIN = 1e-12

_BLOCK = "train boolean, part int, at int, codes binary, first binary, second binary"


def cuts_of(fitting: DataFrame, columns: int) -> list[np.ndarray]:
    """Up to 255 cuts per column, halfway between quantiles of its values; a few kilobytes a column."""
    values = fitting.select(F.posexplode(vector_to_array("features")).alias("i", "v"))
    shares = [i / BINS for i in range(BINS + 1)]
    rows = values.groupBy("i").agg(F.percentile_approx("v", shares, RANKS).alias("q")).collect()
    quantiles = {r["i"]: r["q"] for r in rows}
    found = [np.unique(np.asarray(quantiles[i], dtype=float))[-BINS:] for i in range(columns)]
    return [q[:-1] / 2 + q[1:] / 2 for q in found]


def blocks(frame: DataFrame, cuts: Sequence[np.ndarray], first: str, second: str, train: bool) -> DataFrame:
    """Rows of ``features`` as blocks of bytes, with two numbers of each row beside them."""

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        for at, batch in enumerate(batches):
            if not len(batch):
                continue
            values = np.stack(batch["v"].to_numpy())
            codes = np.stack([np.searchsorted(c, values[:, i], "left") for i, c in enumerate(cuts)], axis=1).astype(np.uint8)
            numbers = [batch[c].to_numpy().tobytes() for c in ("first", "second")]
            yield pd.DataFrame({"train": [train], "part": part, "at": at, "codes": [codes.tobytes()], "first": numbers[:1], "second": numbers[1:]})

    chosen = frame.select(vector_to_array("features").alias("v"), F.expr(first).alias("first"), F.expr(second).alias("second"))
    return chosen.mapInPandas(packed, _BLOCK)


def best_cuts(
    codes: np.ndarray, rows: np.ndarray, at: np.ndarray, nodes: int, drawn: np.ndarray, n: np.ndarray, w: np.ndarray, wy: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gain, column, cut) for each of ``nodes``: rows with a code up to the cut go left.

    ``at`` is the node of each of ``rows``; n, w and wy are its copies, weight and weight of class 1.
    """
    gain, column, cut = np.full(nodes, LEAST_GAIN), np.full(nodes, -1, np.int32), np.zeros(nodes, np.int32)
    total_n, total_w, total_y = (np.bincount(at, v, nodes) for v in (n, w, wy))

    def purity(part: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Weight times the sum of squared shares."""
        return (y * y + (part - y) * (part - y)) / np.maximum(part, 1e-300)

    whole = purity(total_w, total_y)
    for feature in drawn.T:
        key = at.astype(np.int64) * BINS + codes[rows, feature[at]]
        if nodes * BINS <= 8 * len(rows):
            cells = np.flatnonzero(np.bincount(key, minlength=nodes * BINS))
            sums = [np.bincount(key, v, nodes * BINS)[cells] for v in (n, w, wy)]
        else:
            order = np.argsort(key)
            key = key[order]
            starts = np.flatnonzero(np.diff(key, prepend=-1))
            cells = key[starts]
            sums = [np.add.reduceat(v[order], starts) for v in (n, w, wy)]
        node = cells // BINS
        begin = np.flatnonzero(np.diff(node, prepend=-1))
        # Running sums inside each node; every node has a cell.
        left_n, left_w, left_y = (c - np.repeat((c - s)[begin], np.diff(begin, append=len(cells))) for c, s in ((np.cumsum(s), s) for s in sums))
        right_w, right_y = total_w[node] - left_w, total_y[node] - left_y
        better = (purity(left_w, left_y) + purity(np.maximum(right_w, 0), right_y) - whole[node]) / total_w[node]
        better[(left_n < LEAF_ROWS) | (total_n[node] - left_n < LEAF_ROWS)] = -1
        most = np.maximum.reduceat(better, begin)
        place = np.flatnonzero(better == np.repeat(most, np.diff(begin, append=len(cells))))
        place = place[np.diff(node[place], prepend=-1) > 0]
        wins = most > gain
        gain[wins], column[wins], cut[wins] = most[wins], feature[wins], (cells[place] % BINS)[wins]
    return gain, column, cut


class Tree:
    """Arrays over nodes: the column (-1: leaf), its cut, the left child (the right one follows), the share of class 1."""

    def __init__(self, codes: np.ndarray, y: np.ndarray, w: np.ndarray, seed: Sequence[int], depth: int):
        rng = np.random.default_rng(seed)
        copies = rng.poisson(1.0, len(y))
        rows = np.flatnonzero(copies)
        if not len(rows):
            rows, copies = np.arange(len(y)), np.ones(len(y))
        n = copies[rows].astype(float)
        weight = n * w[rows]
        ones = weight * y[rows]
        at = np.zeros(len(rows), np.int64)
        self.column, self.cut, self.left, self.share = (np.empty(0, t) for t in (np.int32, np.int32, np.int64, float))
        count, columns = 1, codes.shape[1]
        drawn = max(1, int(np.ceil(np.sqrt(columns))))
        for level in range(depth + 1):
            size, total, one = np.bincount(at, n, count), np.bincount(at, weight, count), np.bincount(at, ones, count)
            column, cut = np.full(count, -1, np.int32), np.zeros(count, np.int32)
            mixed = (size >= 2 * LEAF_ROWS) & (np.bincount(at, y[rows], count) > 0) & (np.bincount(at, 1 - y[rows], count) > 0)
            if level == depth:
                mixed[:] = False
            number = np.cumsum(mixed) - 1
            inside = mixed[at]
            rows, at, n, weight, ones = rows[inside], number[at[inside]], n[inside], weight[inside], ones[inside]
            if len(rows):
                picked = np.argpartition(rng.random((int(mixed.sum()), columns)), drawn - 1, axis=1)[:, :drawn]
                _, column[mixed], cut[mixed] = best_cuts(codes, rows, at, len(picked), picked, n, weight, ones)
            split = column >= 0
            left = np.where(split, len(self.column) + count + 2 * (np.cumsum(split) - 1), -1)
            self.share = np.append(self.share, one / total)
            for name, value in (("column", column), ("cut", cut), ("left", left)):
                setattr(self, name, np.append(getattr(self, name), value))
            if not split.any():
                break
            own = np.flatnonzero(mixed)[at]
            going = split[own]
            rows, own, n, weight, ones = rows[going], own[going], n[going], weight[going], ones[going]
            at = 2 * (np.cumsum(split) - 1)[own] + (codes[rows, column[own]] > cut[own])
            count = 2 * int(split.sum())

    def score(self, codes: np.ndarray) -> np.ndarray:
        at, open_rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
        while len(open_rows):
            own = at[open_rows]
            going = self.column[own] >= 0
            open_rows, own = open_rows[going], own[going]
            at[open_rows] = self.left[own] + (codes[open_rows, self.column[own]] > self.cut[own])
        return self.share[at]


def grown_and_scored(fitting: DataFrame, rows: DataFrame, columns: int, trees: int, depth: int, seed: int) -> DataFrame:
    """(_id, p) of ``rows(_id, features)``: mean over all trees, fitted on ``fitting(features, y, w)``, of the share of
    class 1 in the leaf."""
    cuts = cuts_of(fitting, columns)
    groves = min(GROVES, trees)

    def grow(found: pd.DataFrame) -> pd.DataFrame:
        grove = int(found["grove"].iloc[0])
        found = found.sort_values(["train", "part", "at"])
        known, asked = found[found["train"]], found[~found["train"]]
        codes, y, w = (
            np.concatenate([np.frombuffer(b, kind) for b in known[c]]) for c, kind in (("codes", np.uint8), ("first", float), ("second", float))
        )
        codes = codes.reshape(len(y), columns)
        wanted = [np.frombuffer(b, np.uint8).reshape(-1, columns) for b in asked["codes"]]
        total = [np.zeros(len(c)) for c in wanted]
        for number in range(grove, trees, groves):
            tree = Tree(codes, y, w, (seed, number), depth)
            for sums, c in zip(total, wanted, strict=True):
                sums += tree.score(c)
        ids = [np.frombuffer(b, np.int64) for b in asked["first"]]
        empty = not wanted
        return pd.DataFrame(
            {"_id": np.empty(0, np.int64) if empty else np.concatenate(ids), "grove": grove, "total": np.empty(0) if empty else np.concatenate(total)}
        )

    both = cut_lineage(
        blocks(fitting, cuts, "y", "w", True).unionByName(blocks(rows, cuts, "_id", "0", False))
    ).withColumn("grove", F.explode(F.sequence(F.lit(0), F.lit(groves - 1))))
    sums = both.repartitionByRange(groves, "grove").groupBy("grove").applyInPandas(grow, "_id long, grove int, total double")
    # In one order, so that a score at a threshold falls on the same side each time.
    ordered = F.array_sort(F.collect_list(F.struct("grove", "total")))
    mean = F.aggregate(ordered, F.lit(0.0), lambda a, x: a + x["total"]) / trees
    return sums.groupBy("_id").agg(mean.alias("p"))
