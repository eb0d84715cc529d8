import hashlib
from collections import Counter, defaultdict

from gaugeworks.llm.exact import drop_copies, exact_duplicates


def wanted(rows):
    groups = defaultdict(list)
    for key, text in rows:
        groups[text or ""].append(key)
    found = Counter()
    for text, keys in groups.items():
        stay = max((k for k in keys if k is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        left = 1
        for key in sorted(keys, key=lambda k: k != stay):
            found[(key, stay, len(keys), bool(left), sha)] += 1
            left = 0
    return found


def test_every_row_against_brute_force(docs, rows):
    for chars in (2048, 7):
        found = exact_duplicates(docs, block_chars=chars)
        assert Counter(tuple(r)[:5] for r in found.collect()) == wanted(rows)


def test_drop_copies_keeps_columns_and_one_row_of_each_text(docs, rows):
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.text or "" for r in kept.collect()) == sorted({t or "" for _, t in rows})


def test_no_rows(no_docs):
    assert exact_duplicates(no_docs).count() == 0
