import random

from gaugeworks.llm import decontaminate as D
from llm_samples import prose


def test_short_items_as_a_whole(spark, monkeypatch):
    rng = random.Random(13)
    items = [(n, f"Zq{n} " + prose(rng, n - 1) if n > 1 else "zq1") for n in range(1, 8)]
    items += [(20, items[4][1].upper()), (21, prose(rng, 25)), (22, ""), (None, items[2][1])]
    rows = [(k, prose(rng, rng.randint(0, 50)) + " " + (t or "") + ", " + prose(rng, 30)) for k, t in items]
    rows += [(50, items[6][1].rsplit(" ", 1)[0] + " neu " + prose(rng, 40)), (51, items[5][1]), (52, None), (53, prose(rng, 60) + " " + rows[3][1] + " " + rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(D, "ITEMS_PER_ROUND", 4)
    for stretch in (200_000, 40):
        monkeypatch.setattr(D, "STRETCH_WORDS", stretch)
        matchers = [D.Matcher(i, D.rare_seeds(i, D.gram_frequency(docs, i))) for i in D.load_items(benchmark)]
        for _, text in rows:
            words = D.words_of(text or "")
            wanted = set()
            for key, item in items:
                own = D.words_of(item)
                places = [at for at in range(len(words)) if own and words[at : at + len(own)] == own]
                if places:
                    wanted.add((key, 1.0, places[0], places[0] + len(own) - 1))
            assert {leak for m in matchers for leak in m.leaks(text or "")} == wanted
    leaking = {r.doc_id for r in docs.collect()} - {r.doc_id for r in D.clean_of_benchmark(docs, benchmark).collect()}
    assert leaking == {1, 2, 3, 4, 5, 6, 7, 20, 21, None, 51, 53}
