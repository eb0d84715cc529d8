import random

import numpy as np
from gaugeworks.llm import decontaminate as D

from llm_samples import prose


def plain_score(item, words):
    score = [[0] * (len(words) + 1) for _ in range(len(item) + 1)]
    best = 0
    for i, a in enumerate(item, 1):
        for j, b in enumerate(words, 1):
            score[i][j] = max(0, score[i - 1][j - 1] + (1 if a == b else -1), score[i - 1][j] - 1, score[i][j - 1] - 1)
            best = max(best, score[i][j])
    return best


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        words[at : at + 1] = rng.choice([[], ["neu"], [words[at], "plus"]])
    return words


def test_alignment():
    rng = random.Random(1)
    for _ in range(200):
        item = [rng.randrange(4) for _ in range(rng.randint(1, 9))]
        words = [rng.randrange(5) for _ in range(rng.randint(1, 20))]
        score, first, last = D.align(np.array(item), np.array(words))
        assert score == plain_score(item, words)
        assert score == 0 or plain_score(item, words[first : last + 1]) == score


def test_every_pair_against_brute_force(spark):
    rng = random.Random(9)
    items = [(i, prose(rng, n)) for i, n in enumerate((8, 12, 20, 20, 33, 50))] + [(90, "too short"), (91, None), (92, ""), (None, prose(rng, 15))]
    items.append((93, items[3][1]))
    rows = []
    for i in range(70):
        key, text = items[rng.choice([0, 1, 2, 3, 4, 5, 9])]
        passage = edited(rng, text.split(), rng.randint(0, 6))
        rows.append((i, prose(rng, rng.randint(0, 60)) + "\n" + " ".join(passage).title() + ", " + prose(rng, 20)))
    rows += [(200, None), (201, ""), (202, prose(rng, 30)), (203, items[2][1]), (203, items[2][1]), (None, items[4][1])]
    docs = spark.createDataFrame([(k, t, "c") for k, t in rows], "doc_id long, text string, item_id string").repartition(2)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = docs.select("doc_id", "text", D.leaks(docs, benchmark).alias("leaks")).collect()
    assert len(found) == len(rows)
    for row in found:
        words = D.words_of(row.text or "")
        wanted = set()
        for key, text in items:
            own = D.words_of(text or "")
            if len(own) >= D.MIN_ITEM_WORDS and (score := plain_score(own, words)) >= D.SIMILARITY * len(own):
                wanted.add((key, round(score / len(own), 9)))
        assert {(r.item_id, round(r.score, 9)) for r in row.leaks} == wanted
    kept = D.clean_of_benchmark(docs, benchmark)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not r.leaks for r in found)


def test_long_texts_and_rounds(spark, monkeypatch):
    rng = random.Random(3)
    items = [(i, prose(rng, 25)) for i in range(7)]
    rows = [(i, prose(rng, 37 * i) + " " + items[i % 7][1] + " " + prose(rng, 90)) for i in range(14)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(D, "STRETCH_WORDS", 40)
    monkeypatch.setattr(D, "ITEMS_PER_ROUND", 3)
    matchers = [D.Matcher(i, D.rare_seeds(i, D.gram_frequency(docs, i))) for i in D.load_items(benchmark)]
    for key, text in rows:
        assert [leak[:2] for m in matchers for leak in m.leaks(text)] == [(key % 7, 1.0)]


def test_no_rows_and_no_items(no_docs, docs, spark):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert D.clean_of_benchmark(docs, benchmark).count() == docs.count()
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine")], "item_id long, text string")
    assert D.clean_of_benchmark(no_docs, items).count() == 0
