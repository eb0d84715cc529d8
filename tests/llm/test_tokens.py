from collections import Counter

import numpy as np
import pytest
from gaugeworks.llm import tokens
from gaugeworks.llm.tokens import END_OF_DOCUMENT, count_tokens, write_token_files


def test_files_of_every_row(spark, docs, rows, tmp_path):
    folder = f"file://{tmp_path}/flat"
    written = write_token_files(docs, folder)
    with open(tokens.RANKS_PATH, "rb") as file:
        encoding = tokens._encoding(file.read(), tokens.SPLIT_PATTERN)
    wanted = Counter((k, len(encoding.encode_ordinary(t or ""))) for k, t in rows)
    for block in (4 << 20, 64, 2):
        counted = count_tokens(spark, folder, block_bytes=block)
        named = {(r.path.rpartition("/")[2], r.ordinal): r.n_tokens for r in counted.collect()}
        assert Counter((r.key, named[(r.path, r.ordinal)]) for r in written.collect()) == wanted
        assert len(named) == len(rows)


def test_borders_and_unclosed_documents(spark, tmp_path):
    rng = np.random.default_rng(0)
    for number in range(4):
        ids = rng.integers(0, 9, 300).astype("<u2")
        ids[rng.random(300) < [0.0, 0.02, 0.3, 1.0][number]] = END_OF_DOCUMENT
        ids.tofile(tmp_path / f"{number}.bin")
    (tmp_path / "empty.bin").write_bytes(b"")
    for block in (2, 20, 64, 600, 5000):
        counted = count_tokens(spark, str(tmp_path), block_bytes=block)
        found = {(r.path.rpartition("/")[2], r.ordinal): r.n_tokens for r in counted.collect()}
        wanted = {}
        for number in range(4):
            ids = np.fromfile(tmp_path / f"{number}.bin", "<u2").tolist()
            sizes = [0]
            for i in ids:
                if i == END_OF_DOCUMENT:
                    sizes.append(0)
                else:
                    sizes[-1] += 1
            sizes = sizes if sizes[-1] else sizes[:-1]
            wanted |= {(f"{number}.bin", k): n for k, n in enumerate(sizes)}
        assert found == wanted


def test_no_rows_and_odd_sizes(spark, no_docs, tmp_path):
    folder = f"file://{tmp_path}/none"
    assert write_token_files(no_docs.coalesce(1), folder).count() == 0
    (tmp_path / "odd.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="no whole number"):
        count_tokens(spark, str(tmp_path)).count()
