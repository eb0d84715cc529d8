import random

import pytest
import sentencepiece
from gaugeworks.llm import pieces
from gaugeworks.llm.pieces import SPACE, Codec, Vocabulary, decoded, encode_documents, load_vocabulary
from pyspark.sql import functions as F

from llm_samples import prose


@pytest.fixture(scope="module")
def vocabulary():
    return load_vocabulary()


def best_score(unit, table, unknown):
    best = [0.0]
    for end in range(1, len(unit) + 1):
        options = [best[start] + table[unit[start:end]] for start in range(end) if unit[start:end] in table]
        if unit[end - 1] not in table:
            options.append(best[end - 1] + unknown)
        best.append(max(options))
    return best[-1]


def test_search_is_the_best_segmentation():
    rng = random.Random(1)
    alphabet = "abc" + SPACE
    table = {c: -rng.uniform(1, 5) for c in alphabet}
    for _ in range(40):
        piece = SPACE * rng.randint(0, 2) + "".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
        table[piece] = -rng.uniform(1, 9)
    names = ["<unk>", *table]
    codec = Codec(Vocabulary(tuple(names), (0.0, *table.values()), "u" + "n" * len(table)))
    for _ in range(300):
        unit = "".join(rng.choice("abcx" + SPACE) for _ in range(rng.randint(1, 14)))
        ids = codec.search(unit)
        score = sum(codec.unknown_score if i == 0 else table[names[i]] for i in ids)
        assert "".join("x" if i == 0 else names[i] for i in ids) == unit
        assert score == pytest.approx(best_score(unit, table, codec.unknown_score))


def test_as_the_library_does_with_the_same_scores(vocabulary):
    from sentencepiece import sentencepiece_model_pb2 as schema

    model = schema.ModelProto()
    with open(pieces.MODEL_PATH, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = schema.TrainerSpec.UNIGRAM
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    codec = Codec(vocabulary)
    rng = random.Random(2)
    for text in [prose(rng, 200) for _ in range(20)] + ["Hello, world! It's 12.5 % of a whole.", "", "a", "Ünïcode – naïve café"]:
        assert codec.encode(text).tolist() == library.encode(text)
    assert codec.decode(library.encode("漢字 𝒳 ok")) == "漢字 𝒳 ok"


def test_round_trip_of_every_row(spark, docs, rows, vocabulary):
    found = encode_documents(docs, vocabulary).withColumn("back", decoded(F.col("piece_ids"), spark, vocabulary))
    assert found.columns == [*docs.columns, "piece_ids", "n_pieces", "back"]
    got = sorted((r.text or "", r.back, r.n_pieces == len(r.piece_ids)) for r in found.collect())
    assert got == sorted(((t or ""), (t or "").replace(SPACE, " "), True) for _, t in rows)


def test_no_rows_and_bad_ids(no_docs, vocabulary):
    assert encode_documents(no_docs, vocabulary).count() == 0
    with pytest.raises(ValueError, match="outside"):
        Codec(vocabulary).decode([1, 10**6])
    assert Codec(vocabulary).decode([]) == ""


def test_memory_is_bounded(vocabulary, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 5)
    codec = Codec(vocabulary)
    text = prose(random.Random(3), 100)
    assert codec.decode(codec.encode(text)) == text
    assert len(codec.memory) <= 5
