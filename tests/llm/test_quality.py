import random
import zlib

import pytest
from gaugeworks.llm import quality

from llm_samples import EXTRA, SCHEMA, prose


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.7
        text = prose(rng, rng.randint(20, 200))
        rows.append((i, text if good else " ".join(w.upper() + "!!" for w in text.split()), *EXTRA))
        labels.append((i, int(good)))
    rows += [(500, None, *EXTRA), (501, "", *EXTRA), (None, "x", *EXTRA), (3, rows[3][1], *EXTRA)]
    labels += [(None, 1), (7, None), (9, labels[9][1])]
    return spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy_and_rows(corpus):
    docs, labels = corpus
    model = quality.fit(docs, labels)
    found = quality.scored(docs, model).withColumn("held", quality.held_out()).collect()
    assert len(found) == 404
    known = dict(labels.dropna().collect())
    out = [r for r in found if r.held and r.doc_id in known]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held for r in found if r.doc_id is not None)
    assert sum(r.predicted == known[r.doc_id] for r in out) >= 0.95 * len(out)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    empty = {r.score for r in found if not r.text}
    assert len(empty) == 1


def test_accepted_keeps_columns_and_values(spark, corpus, monkeypatch):
    docs, labels = corpus
    monkeypatch.setattr(quality, "table", lambda *_: labels)
    kept = quality.accepted(spark, docs, "")
    assert kept.columns == docs.columns
    assert 200 < kept.count() < 330
    assert {r.score for r in kept.collect()} == {"s"}


def test_labels_of_the_held_out_fold_do_not_matter(corpus):
    docs, labels = corpus
    flipped = labels.withColumn("quality", quality.F.when(quality.held_out(), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    assert quality.fit(docs, labels) == quality.fit(docs, flipped)


def test_few_or_no_rows(spark, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(no_docs, labels)
    assert quality.scored(no_docs, model).count() == 0
    one = no_docs.sparkSession.createDataFrame([(1, "some text", *EXTRA)], no_docs.schema)
    assert quality.scored(one, quality.fit(one, labels)).count() == 1
