import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from gaugeworks.llm import passages
from gaugeworks.llm.passages import WINDOW_BYTES, repeated_passages, repeated_starts


def wanted(rows):
    bodies = [(key, (text or "").encode()) for key, text in rows]
    seen = Counter(b[i : i + WINDOW_BYTES] for _, b in bodies for i in range(len(b) - WINDOW_BYTES + 1))
    found = Counter()
    for key, body in bodies:
        gone = np.zeros(len(body), bool)
        for i in range(len(body) - WINDOW_BYTES + 1):
            if seen[body[i : i + WINDOW_BYTES]] > 1:
                gone[i : i + WINDOW_BYTES] = True
        kept = np.frombuffer(body, np.uint8)[~gone].tobytes()
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        found[(key, len(body), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    return found


@pytest.mark.parametrize("hot", [4 << 20, 1200])
def test_every_row_against_brute_force(docs, rows, monkeypatch, hot):
    monkeypatch.setattr(passages, "HOT_BYTES", hot)
    monkeypatch.setattr(passages, "SHARD_BYTES", 5000)
    found = repeated_passages(docs)
    assert Counter(tuple(r)[:5] for r in found.collect()) == wanted(rows)


def test_no_rows(no_docs):
    assert repeated_passages(no_docs).count() == 0


def test_merged_transforms_find_all_repeats():
    rng = random.Random(4)
    blocks = [rng.randbytes(rng.randint(150, 700)) for _ in range(12)]
    texts = [b"".join(rng.choice(blocks) for _ in range(3)) for _ in range(30)] + [b"ab" * 400]
    texts = [t for t in texts if len(t) >= WINDOW_BYTES]
    seen = Counter(t[i : i + WINDOW_BYTES] for t in texts for i in range(len(t) - WINDOW_BYTES + 1))
    plain = [b"" + t[i : i + WINDOW_BYTES] in seen and seen[t[i : i + WINDOW_BYTES]] > 1 for t in texts for i in range(len(t) + 1)]
    for size in (1, 2, 7, 100):
        shards = (texts[i : i + size] for i in range(0, len(texts), size))
        assert repeated_starts(shards).tolist() == plain


def test_long_texts_are_cut_into_stretches_without_loss(monkeypatch):
    rng = random.Random(6)
    data = rng.randbytes(3000)
    whole = sum(r[1] for r in passages.runs_of(data))
    monkeypatch.setattr(passages, "STRETCH_BYTES", 500)
    parts = list(passages.runs_of(data))
    assert whole == sum(r[1] for r in parts) == len(data) - WINDOW_BYTES + 1
    assert [r[0] for r in parts[1:]] == [r[0] + r[1] for r in parts[:-1]]
