import random
from fractions import Fraction

import numpy as np
from gaugeworks.llm import similar
from gaugeworks.llm.simhash import set_fingerprint


def drawn(rng, n):
    return np.array([rng.getrandbits(64) for _ in range(n)], dtype=np.uint64)


def differing(a, b):
    return int(np.bitwise_count(set_fingerprint(a).view(np.uint64) ^ set_fingerprint(b).view(np.uint64)).sum())


def test_fingerprint_bits():
    own = drawn(random.Random(1), 70_001)
    wanted = [2 * int(((own >> np.uint64(i)) & np.uint64(1)).sum()) > len(own) for i in range(64)]
    found = int(set_fingerprint(own)[0]) % 2**64
    assert [bool(found >> i & 1) for i in range(64)] == wanted


def test_similar_sets_are_within_the_radius():
    rng = random.Random(2)
    for n in (4, 5, 8, 9, 20, 60, 300, 1500):
        far = []
        for _ in range(60):
            own = drawn(rng, n)
            # Sets of n shingles that share as few as a similarity of 0.8 allows, and a set without its last ones.
            common = -(-8 * n // 9)
            assert differing(own, np.concatenate([own[:common], drawn(rng, n - common)])) <= (50 if n >= 8 else 56)
            least = -(-4 * n // 5)
            assert differing(own, own[:least]) <= (50 if least >= 8 else 56)
            far.append(differing(own, drawn(rng, n)) > 50)
        assert n < 20 or sum(far) > 50


def test_strangers_that_share_a_prefix_make_no_pairs(spark):
    rng = random.Random(3)
    marks = [set_fingerprint(drawn(rng, 50)).tolist() for _ in range(120)]
    marks[7] = marks[3]
    rows = [(at, node, 50, at, node, *m) for node, m in enumerate(marks) for at in range(11)]
    frame = spark.createDataFrame(rows, "shingle long, node long, n int, at int, root long, f0 long, f1 long")
    pairs = {tuple(r) for r in similar.apart_pairs(frame, Fraction(4, 5), True).collect()}
    assert (3, 7) in pairs and len(pairs) < 120 * 119 // 2 * 0.03


def test_prefixes_carry_the_fingerprint(spark):
    texts = spark.createDataFrame([(1, "a b c d e f g"), (2, "")], "node long, body string")
    rows = similar.prefixes(texts, 5, Fraction(4, 5), True).collect()
    for node, body in ((1, "a b c d e f g"), (2, "")):
        marks = {(r.f0, r.f1) for r in rows if r.node == node}
        assert marks == {tuple(set_fingerprint(similar.shingles_of(body)).tolist())}
