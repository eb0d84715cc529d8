"""run() over a planted corpus against a plain program without Spark, and over empty tables."""

import random
from fractions import Fraction

import corpus_pipeline
import pytest
import zstandard
from gaugeworks.llm import quality
from llm_samples import prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, node string"
ITEM_SCHEMA = "item_id long, text string, hash string"


def planted():
    """Good and bad text, exact copies, copies of similarity about 0.6 to 0.97, leaks whole and edited."""
    rng = random.Random(77)
    items = [(i, prose(rng, n)) for i, n in enumerate((12, 20, 30))] + [(9, None), (10, "")]
    texts, quality_of = {}, {}

    def add(text, good=True):
        key = len(texts) * 3 + 1
        texts[key] = text
        quality_of[key] = int(good)

    bases = [prose(rng, n) for n in (60, 90, 140, 220)]
    for base in bases:
        for changes in (0, 0, 1, 2, 4, 8):
            words = base.split()
            for at in rng.sample(range(len(words)), changes):
                words[at] = f"neu{at}"
            add(" ".join(words))
    for _ in range(50):
        add(prose(rng, rng.randint(20, 120)))
    for _ in range(45):
        add(" ".join(w.upper() + "!!" for w in prose(rng, rng.randint(20, 120)).split()), False)
    for _, item in items[:3]:
        for edits in (0, 1, 3, 9):
            words = item.split()
            for at in rng.sample(range(len(words)), edits):
                words[at] = "anders"
            add(prose(rng, 25) + " " + " ".join(words).title() + ". " + prose(rng, 25))
    add(None), add(""), add(" \n"), add("zwei"), add("two words"), add("TWO  words"), add(prose(rng, 6000))
    rows = [(k, t, "en", "s", len(t or ""), "h", "n") for k, t in texts.items()]
    rows += [rows[0], rows[5], (None, prose(rng, 50), None, None, None, None, None), (None, bases[2], None, None, None, None, None)]
    rng.shuffle(rows)
    return rows, quality_of, items


def plain_probability(text, model):
    good, bad = (zstandard.ZstdCompressionDict(d) for d in (model.good, model.bad))
    body = (text or "").encode()
    sizes = [0, 0]
    for at in range(0, len(body), quality.PIECE_BYTES):
        for side, data in enumerate((good, bad)):
            tool = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[side] += len(tool.compress(body[at : at + quality.PIECE_BYTES]))
    x = (sizes[1] - sizes[0]) / len(body) if body else 0.0
    return 1 / (1 + 2.718281828459045 ** -(x * model.slope + model.intercept))


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def leaked(item, text):
    """Smith-Waterman over words by the whole table, row by row."""
    split = "".join(c if c.isalnum() or c == "_" else " " for c in text.lower()).split()
    item = "".join(c if c.isalnum() or c == "_" else " " for c in item.lower()).split()
    row, best = [0] * (len(split) + 1), 0
    for a in item:
        above, row = row, [0]
        for j, b in enumerate(split):
            row.append(max(0, above[j] + (1 if a == b else -1), above[j + 1] - 1, row[j] - 1))
        best = max(best, max(row))
    return bool(item) and best >= 0.8 * len(item)


def plain_run(rows, model, items):
    kept = [r for r in rows if plain_probability(r[1], model) >= quality.THRESHOLD]
    after_quality = len(kept)
    first = lambda r: (r[0] is not None, r[0] or 0)
    by_text = {}
    for r in kept:
        old = by_text.get(r[1] or "")
        by_text[r[1] or ""] = r if old is None or first(r) > first(old) else old
    kept = list(by_text.values())
    after_exact = len(kept)
    sets, group = [shingles(r[1]) for r in kept], list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if Fraction(common, len(sets[i]) + len(sets[j]) - common) >= Fraction(4, 5):
                group = [group[j] if g == group[i] else g for g in group]
    stay = {}
    for r, g in zip(kept, group, strict=True):
        order = (r[0] is None, r[0] or 0)
        if g not in stay or order < stay[g][0]:
            stay[g] = (order, r)
    kept = [r for _, r in stay.values()]
    after_near = len(kept)
    kept = [r for r in kept if not any(leaked(t or "", r[1] or "") for _, t in items)]
    # The corpus is of use only if every stage has something to drop.
    assert len(rows) > after_quality > after_exact > after_near > len(kept) > 40
    return kept


@pytest.fixture()
def written(spark, tmp_path):
    def write(rows, labels, items):
        spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
        spark.createDataFrame(items, ITEM_SCHEMA).write.parquet(f"{tmp_path}/benchmark.parquet")
        return str(tmp_path)

    return write


def test_run_against_a_plain_program(spark, written):
    rows, quality_of, items = planted()
    folder = written(rows, [(k, q, 0) for k, q in quality_of.items()], [(*i, "h") for i in items])
    found = corpus_pipeline.run(spark, folder)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "hash", "node", "piece_ids", "n_pieces", "round_trip"]
    model = quality.fit(*(corpus_pipeline.table(spark, folder, t) for t in ("documents", "labels")))
    got = found.collect()
    wanted = plain_run(rows, model, items)
    assert sorted(map(repr, (tuple(r)[:7] for r in got))) == sorted(map(repr, wanted))
    assert all(r.round_trip and r.n_pieces == len(r.piece_ids) for r in got)


def test_run_over_empty_tables(spark, written):
    assert corpus_pipeline.run(spark, written([], [], [])).isEmpty()
