"""Rows for the tests: nulls, empty and very long texts, ties, repeats and odd characters."""

import random

SCHEMA = "doc_id long, text string, lang string, key string, row string, hash string, score string, kept string, name string"
EXTRA = ("en", "k", "r", "h", "s", "t", "n")


def prose(rng: random.Random, words: int) -> str:
    return " ".join(rng.choice(VOCABULARY) for _ in range(words))


def _vocabulary() -> list[str]:
    rng = random.Random(5)
    return ["".join(rng.choice("aeioulrstnmdk") for _ in range(rng.randint(2, 9))) for _ in range(900)]


VOCABULARY = _vocabulary()


def texts() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and very long texts, ties, repeated rows, near copies, odd characters."""
    rng = random.Random(11)
    base = [prose(rng, n) for n in (40, 90, 150, 260, 400)]
    long = prose(rng, 9000)
    changed = long.replace(" ", " é", 1).replace("a", "A", 40)
    shared = prose(rng, 70)
    found = [(i, t) for i, t in enumerate(base)]
    found += [(10 + i, base[i % 3]) for i in range(9)]
    found += [(30, long), (31, changed), (32, long), (32, long)]
    found += [(40 + i, prose(rng, 30) + " " + shared + " " + prose(rng, 30)) for i in range(8)]
    found += [(60, None), (61, ""), (62, " \n\t "), (63, "x"), (64, "two words"), (None, base[0]), (None, "alone without a key")]
    found += [(70, "Of " * 500), (71, "\U0001d4b3漢字 Üñ\x01\x02 ▁ tail"), (72, base[4][:-3] + "!!!")]
    found += [(80, "dup row"), (80, "dup row"), (80, "same key, other text")]
    return found
