import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from gaugeworks.llm import minhash
from gaugeworks.llm.queries import QUERIES
from llm_samples import prose


def plain_set(text):
    words = (text or "").encode().lower().split()
    if len(words) < 3:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)}


def wanted(rows):
    sets = [plain_set(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                label = [label[j] if x == label[i] else x for x in label]
    groups = defaultdict(list)
    for (key, _), x in zip(rows, label):
        groups[x].append(key)
    least = {x: min((k for k in keys if k is not None), default=None) for x, keys in groups.items()}
    return Counter((key, len(s), least[x], key == least[x]) for (key, _), s, x in zip(rows, sets, label))


def planted():
    """Originals with a few words changed, around the threshold; chains; a template with other fillings."""
    rng = random.Random(31)
    found = []
    for length in (20, 60, 150, 400):
        base = prose(rng, length).split()
        found.append(" ".join(base))
        for k in range(14):
            words = list(base)
            for at in rng.sample(range(length), max(1, k * length // 300)):
                words[at] = f"neu{rng.random()}"
            found.append(" ".join(words))
    chain = prose(rng, 220).split()
    for step in range(8):
        found.append(" ".join(chain[step * 9 : step * 9 + 120]))
    frame = prose(rng, 80)
    found += [f"{frame} {prose(rng, 14)} {frame[:200]}" for _ in range(25)]
    found += [prose(rng, rng.randint(1, 60)) for _ in range(20)] + ["two words", "TWO  words", "two Words three"]
    rng.shuffle(found)
    return list(enumerate(found))


def test_components_against_brute_force(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = Counter(tuple(r) for r in minhash.near_copies(docs).collect())
    assert found == wanted(rows)
    assert 20 < sum(not r[3] for r in found) < len(rows) - 20


def test_query_over_odd_rows(spark, docs, rows, tmp_path):
    folder = str(tmp_path / "t")
    docs.write.parquet(f"{folder}/documents.parquet")
    frame = QUERIES["op12_minhash"](spark, folder)
    found = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in frame.collect())
    alone = {r for r in wanted(rows) if r[0] is None and r[2] is None}
    assert found == Counter({(k, n, c, kept or (k, n, c, kept) in alone): m for (k, n, c, kept), m in wanted(rows).items()})


def test_whole_table(spark, sf_dir):
    given = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = Counter(tuple(r) for r in QUERIES["op12_minhash"](spark, sf_dir).collect())
    assert found == wanted(given)


def test_sketch_estimates_and_its_bound(spark):
    rng = np.random.default_rng(1)
    bits = {}
    for similarity in (0.5, 0.7, 0.85, 0.95):
        n, found = 1000, []
        common = round(2 * n * similarity / (1 + similarity))
        for _ in range(60):
            h = rng.integers(0, 1 << 64, 2 * n - common, dtype=np.uint64)
            a, b = minhash.odd_sketches(np.stack([minhash.minima(h[:n]), minhash.minima(h[n - common :])]))
            found.append(sum(int(x).bit_count() for x in (a ^ b).view(np.uint64)))
        bits[similarity] = found
    allowed = minhash.bits_allowed()
    assert max(bits[0.85]) <= allowed < np.mean(bits[0.5])
    frame = spark.createDataFrame([(s, float(np.mean(z))) for s, z in bits.items()], "s double, z double")
    for row in frame.select("s", minhash.estimated(frame.z).alias("e")).collect():
        assert row.e == pytest.approx(row.s, abs=0.03)


def test_many_words_take_another_code(monkeypatch):
    rng = random.Random(2)
    texts = [prose(rng, 50).encode().split() for _ in range(5)]
    plain = [sorted(h.tolist()) for h in minhash.shingle_hashes(texts)]
    monkeypatch.setattr(minhash, "CODED_WORDS", 3)
    assert [sorted(h.tolist()) for h in minhash.shingle_hashes(texts)] == plain
    assert [len(p) for p in plain] == [len(plain_set(b" ".join(t).decode())) for t in texts]


def test_bound_of_the_bands():
    assert float(1 - Fraction(17, 20) ** minhash.BAND_ROWS) ** minhash.BANDS < 1e-10


def test_no_rows(no_docs):
    assert minhash.near_copies(no_docs).count() == 0
