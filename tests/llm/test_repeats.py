import hashlib
import random
import zlib
from collections import Counter

import pytest
from gaugeworks.llm import repeats
from gaugeworks.llm.queries import QUERIES


def plain_runs(words, least=12):
    """Every period over every stretch of equal words that far apart."""
    found = {}
    n = len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i >= q and j + q - i >= least:
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e, q) for (s, e), q in found.items())


def sample_words(rng):
    kind = rng.randrange(6)
    if kind == 0:
        return rng.choices("ab", k=rng.randint(0, 90))
    if kind == 1:
        return rng.choices("abcdefgh", k=rng.randint(0, 60)) * rng.randint(1, 4)
    if kind == 2:
        a, b = ["a"], ["a", "b"]
        for _ in range(rng.randint(3, 7)):
            a, b = b, b + a
        return b
    if kind == 3:
        period = rng.choices("abc", k=rng.randint(1, 9))
        return rng.choices("abc", k=8) + (period * 30)[: rng.randint(8, 70)] + rng.choices("abc", k=8)
    if kind == 4:
        line = rng.choices("abcdefghijklmnop", k=rng.randint(5, 20))
        out = []
        for _ in range(rng.randint(2, 6)):
            out += line + rng.choices("xyz", k=rng.randint(0, 3))
        return out
    return ["a"] * rng.randint(0, 60) + ["b"] * rng.randint(0, 30)


def test_runs_against_brute_force_in_batches():
    rng = random.Random(3)
    texts = [[w.encode() for w in sample_words(rng)] for _ in range(900)]
    for i in range(0, len(texts), 100):
        part = texts[i : i + 100]
        assert repeats.runs_of(part) == [plain_runs(t) for t in part]


def test_pairs_left_occur_once():
    import numpy as np

    rng = random.Random(4)
    words = rng.choices(range(12), k=3000)
    left, ends, rules = repeats.repair(np.array(words), np.zeros(3000, np.int64), np.arange(3000) == 2999)
    assert ends.sum() == 1
    pairs = Counter(zip(left[:-1].tolist(), left[1:].tolist()))
    assert all(n == 1 or a == b for (a, b), n in pairs.items())
    grammar = repeats.Grammar(12, rules, 12)
    assert [w for s in left.tolist() for w in grammar.expanded(s)] == words


def wanted(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    drop = {i for s, e, q in runs for i in range(s + q, e)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
    top = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    best = (None,) * 4 if top is None else (top[0], top[1] - top[0], top[2], 1000 * (top[1] - top[0]) // top[2])
    return (doc_id, len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_against_brute_force(spark, docs, rows, tmp_path):
    folder = str(tmp_path / "t")
    docs.write.parquet(f"{folder}/documents.parquet")
    found = Counter(tuple(r) for r in QUERIES["op13_runs"](spark, folder).collect())
    assert found == Counter(wanted(*r) for r in rows)
    assert any(r[1] for r in found)


def test_whole_table(spark, sf_dir):
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = Counter(tuple(r) for r in QUERIES["op13_runs"](spark, sf_dir).collect())
    assert found == Counter(wanted(*r) for r in given)


@pytest.mark.parametrize("times", [20_000])
def test_one_word_over_and_over_and_a_long_text(times):
    rng = random.Random(9)
    text = [b"x"] * times + [str(rng.random()).encode() for _ in range(times)]
    assert repeats.runs_of([text, []]) == [[(0, times, 1)], []]


def test_no_rows(no_docs):
    assert repeats.repeated_runs(no_docs).count() == 0
