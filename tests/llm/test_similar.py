import random
from collections import defaultdict
from fractions import Fraction

import corpus_pipeline
import pytest
from gaugeworks.llm import similar
from llm_samples import prose


def plain_sets(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_groups(texts):
    sets = [plain_sets(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if Fraction(common, len(sets[i]) + len(sets[j]) - common) >= Fraction(4, 5):
                label = [label[j] if x == label[i] else x for x in label]
    groups = defaultdict(list)
    for i, x in enumerate(label):
        groups[x].append(i)
    return list(groups.values())


def planted():
    """Originals with copies of a few changed words (similarity about 0.6 to 0.98), chains and noise."""
    rng = random.Random(21)
    found = []
    for length in (40, 90, 180, 400, 700):
        base = prose(rng, length).split()
        found.append(" ".join(base))
        for k in range(8):
            words = list(base)
            for at in rng.sample(range(length), max(1, k * length // 300)):
                words[at] = f"neu{rng.random()}"
            found.append(" ".join(words))
    chain = prose(rng, 200).split()
    for step in range(6):
        found.append(" ".join(chain[step * 15 : step * 15 + 120]))
    found += [prose(rng, rng.randint(1, 80)) for _ in range(30)] + ["", " \n", "x", "two words", "TWO  words"]
    rng.shuffle(found)
    return found


@pytest.mark.parametrize("stage", [similar.keep_one_similar, lambda d: corpus_pipeline.simhash_near_dedup(None, d, "")])
def test_groups_against_brute_force(spark, stage):
    texts = planted()
    groups = plain_groups(texts)
    assert 30 < len(groups) < len(texts) - 15
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    kept = stage(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(g) for g in groups)


def test_odd_rows(docs, rows):
    kept = similar.keep_one_similar(docs).collect()
    assert len(kept) == len(plain_groups([t for _, t in rows]))
    assert all(r.doc_id is not None or r.text == "alone without a key" for r in kept)


def test_no_rows(no_docs):
    assert similar.keep_one_similar(no_docs).count() == 0


def test_rows_that_meet(spark):
    rows = [(1, 10, 5, 0), (1, 11, 6, 1), (2, 10, 5, 1), (3, 12, 9, 0), (3, 12, 9, 1)]
    rows = spark.createDataFrame(rows, "shingle long, node long, n int, at int").repartition(2)
    found = similar.met_rows(rows.mapInPandas(lambda batches: batches, rows.schema))
    assert sorted(tuple(r) for r in found.collect()) == [(1, 10, 5, 0), (1, 11, 6, 1)]


def test_bound_loses_no_pair(spark):
    rng = random.Random(4)
    least = Fraction(4, 5)
    rows, wanted = [], set()
    sets = []
    for node in range(160):
        base = set(rng.sample(range(60), rng.randint(1, 40))) if node % 4 == 0 else set(sets[-1])
        for _ in range(rng.randint(0, 4)):
            base ^= {rng.randrange(60)}
        sets.append(base or {0})
    for node, own in enumerate(sets):
        ordered = sorted(own)[: similar.prefix_length(len(own), least)]
        rows += [(s, node, len(own), at, node) for at, s in enumerate(ordered)]
        for other in range(node):
            common = len(own & sets[other])
            if Fraction(common, len(own) + len(sets[other]) - common) >= least:
                wanted.add((other, node))
    frame = spark.createDataFrame(rows, "shingle long, node long, n int, at int, root long")
    found = [tuple(r) for r in similar.apart_pairs(frame, least).collect()]
    assert len(found) == len(set(found)) and wanted <= set(found) and wanted
    met = {(a, b) for a in range(160) for b in range(a + 1, 160) if sets[a] & sets[b]}
    assert len(found) < len(met)
