import random
from collections import Counter, defaultdict

import numpy as np
import xxhash
from gaugeworks.llm import simhash
from gaugeworks.llm.components import components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, bits=3):
    label = list(range(len(prints)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                label[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(prints)):
        groups[find(i)].append(i)
    return list(groups.values())


def test_every_row_against_brute_force(docs, rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    wanted = Counter()
    for group in plain_components(prints):
        keys = [rows[i][0] for i in group if rows[i][0] is not None]
        for i in group:
            wanted[(rows[i][0], prints[i], min(keys, default=None))] += 1
    found = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in found) == wanted


def test_keep_one_of_each_group(docs, rows):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    groups = plain_components([plain_fingerprint(t) for _, t in rows])
    assert kept.count() == len(groups)


def test_no_rows(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0


def test_shards_hold_every_near_pair(spark):
    rng = random.Random(3)
    points = {rng.getrandbits(64) for _ in range(1500)}
    for p in list(points)[:300]:
        near = p
        for bit in rng.sample(range(64), rng.randint(1, 4)):
            near ^= 1 << bit
        points.add(near)
    signed = [int(np.uint64(p).view(np.int64)) for p in points]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    shards = defaultdict(set)
    for r in simhash.shard(frame, target=60).collect():
        shards[r.shard].add(r.fp % 2**64)
    assert len(shards) > 10
    together = {frozenset((a, b)) for own in shards.values() for a in own for b in own if a < b and (a ^ b).bit_count() <= 3}
    ordered = sorted(points)
    assert together == {frozenset((a, b)) for i, a in enumerate(ordered) for b in ordered[:i] if (a ^ b).bit_count() <= 3}


def test_links_of_a_dense_ball():
    base = 0x0123456789ABCDEF
    points = np.array(sorted({base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)}), np.uint64)
    node, root = simhash._links(points, 3)
    assert len(node) == len(points) - 1
    assert len(set(root.tolist())) == 1


def test_components_of_a_path_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (101, 102), (102, 101)]
    found = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 101, 102: 101}
