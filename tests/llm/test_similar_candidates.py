import random
from fractions import Fraction

import numpy as np
import pytest
from gaugeworks.llm import similar
from gaugeworks.llm.simhash import set_fingerprint
from pyspark.sql import functions as F
from test_similar import planted, plain_groups, plain_sets

LEAST = Fraction(4, 5)


def drawn(rng, n):
    return np.array([rng.getrandbits(64) for _ in range(n)], dtype=np.uint64)


@pytest.fixture
def texts(spark):
    rows = [(i, t) for i, t in enumerate(planted())]
    return rows, spark.createDataFrame(rows, "node long, body string").repartition(3)


def test_candidates_hold_every_linked_text(texts):
    rows, frame = texts
    groups = [g for g in plain_groups([t for _, t in rows]) if len(g) > 1]
    found = {r.node: r for r in similar.candidates(frame, 5, LEAST).collect()}
    assert {i for g in groups for i in g} <= set(found) and len(found) < len(rows) - 10
    for node, row in found.items():
        assert row.n == len(row.shingles) == len(plain_sets(rows[node][1]))


def test_prefixes_in_exact_order(texts):
    rows, frame = texts
    found = similar.candidates(frame, 5, LEAST)
    sets = {r.node: set(r.shingles) for r in found.collect()}
    texts_of = {s: sum(s in own for own in sets.values()) for own in sets.values() for s in own}
    wanted = {}
    for node, own in sets.items():
        order = sorted(own, key=lambda s: (texts_of[s], s))
        if 5 * sum(texts_of[s] > 1 for s in own) >= 4 * len(own):
            wanted |= {(node, s): at for at, s in enumerate(order[: similar.prefix_length(len(own), LEAST)]) if texts_of[s] > 1}
    # Of shingles of one text the order is not told; they come first.
    assert {(r.node, r.shingle): r.at for r in similar.prefix_rows(found, LEAST).collect()} == wanted and wanted


@pytest.mark.parametrize("n", [1, 4, 30, 250, 257, 900, 6000])
def test_marks_lose_no_similar_pair(spark, n):
    rng = random.Random(n)
    rows = []
    for _ in range(25):
        own = np.unique(drawn(rng, n))
        for m in (n, -(-4 * n // 5)):
            common = -(-4 * (n + m) // 9)
            other = np.unique(np.concatenate([own[rng.sample(range(n), common)], drawn(rng, m - common)]))
            (one, two) = sorted((own, other), key=len)
            a, b = similar.marks_of(one), similar.marks_of(two)
            rows.append(((len(one), a[0], a[1].tolist()), (len(two), b[0], b[1].tolist())))
    part = "struct<n:int,drawn:int,marks:array<smallint>>"
    frame = spark.createDataFrame(rows, f"a {part}, b {part}")
    assert frame.filter(similar.marked("a", "b", LEAST)).count() == len(rows)


def test_a_group_of_half_similar_texts_makes_no_pairs(spark):
    """Texts that share 0.7 of their shingles with all others of the group, with fingerprints that are near."""
    rng = random.Random(5)
    base = drawn(rng, 140)
    rows = []
    for node in range(60):
        own = np.sort(np.concatenate([base, drawn(rng, 60)]))
        if node == 41:
            own = np.sort(np.concatenate([first[:190], drawn(rng, 10)]))
        if node == 3:
            first = own
        marks = similar.marks_of(own)
        shingles = base.view(np.int64)[:20].tolist()
        before = [None, *shingles[:-1]]
        rows += [(s, node, 200, at, node, *set_fingerprint(own).tolist(), p, marks[0], marks[1].tolist()) for at, (s, p) in enumerate(zip(shingles, before, strict=True))]
    schema = "shingle long, node long, n int, at int, root long, f0 long, f1 long, before long, drawn int, marks array<smallint>"
    frame = spark.createDataFrame(rows, schema)
    assert similar.apart_pairs(frame, LEAST, True).count() > 1000
    assert [tuple(r) for r in similar.apart_pairs(frame, LEAST, True, marks=True).collect()] == [(3, 41)]


def test_rows_with_a_mate(spark):
    rows = [(1, 10, 50, 0, 10), (1, 11, 55, 0, 11), (1, 12, 90, 0, 12), (2, 10, 50, 1, 10), (2, 13, 50, 0, 10), (3, 14, 64, 0, 14), (3, 15, 80, 0, 15)]
    frame = spark.createDataFrame(rows, "shingle long, node long, n int, at int, root long")
    found = similar.with_mate(frame, LEAST, False).select("shingle", "node").orderBy(F.col("node")).collect()
    assert [tuple(r) for r in found] == [(1, 10), (1, 11), (3, 14), (3, 15)]
