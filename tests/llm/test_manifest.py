import hashlib
import zlib
from collections import Counter, defaultdict

from gaugeworks.llm import manifest as M
from gaugeworks.llm.queries import QUERIES
from pyspark.sql import functions as F


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def part(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def root_and_proofs(nodes):
    proofs = [[] for _ in nodes]
    where = list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, at in enumerate(where):
            run = range(at - at % 2, min(at - at % 2 + 2, len(nodes)))
            proofs[leaf].append([(nodes[i] if i != at else None) for i in run])
        nodes = [H(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        where = [at // 2 for at in where]
    return nodes[0], proofs


def climbed(node, proof):
    for run in proof:
        node = H(*[node if x is None else x for x in run])
    return node


def wanted(rows):
    """Rows are (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append((row, H(*map(part, row))))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[g] = root_and_proofs([leaf for _, leaf in groups[g]])
    root, crown = root_and_proofs([trees[g][0] for g in order])
    found = Counter()
    for g, up in zip(order, crown):
        for (row, leaf), proof in zip(groups[g], trees[g][1]):
            doc_id, source, lang, n_chars, text = row
            changed = n_chars is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
            claimed = H(*map(part, (doc_id, source, lang, n_chars + 1, text))) if changed else leaf
            proof = proof + up
            reached = climbed(claimed, proof)
            beside = [x for run in proof for x in run if x is not None]
            found[(doc_id, leaf, trees[g][0], root, H(*beside), reached, reached == root)] += 1
    return found


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, pos long, tree string, slots string, path string, node string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "t", "s", "p", "n") for r in rows], SCHEMA).repartition(3)


def result(spark, rows, tmp_path):
    folder = str(tmp_path / "t")
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    return Counter(tuple(r) for r in QUERIES["op11_manifest"](spark, folder).collect())


def odd_rows(rows):
    langs = ["en", None, "", "fr", "é", "z"]
    found = [(i, ["a", None, ""][k % 3], langs[k % 6], None if k % 5 == 0 else len(t or ""), t) for k, (i, t) in enumerate(rows)]
    found += [(-5, "s", "en", 1, "negative"), (-(2**63), "s", "en", 1, "least"), (2**63 - 1, "s", "en", 2**63 - 1, "greatest")]
    found += [(None, "s", "en", 3, "x"), (None, "s", "en", 3, "x"), (None, None, None, None, None)]
    found += [(77, "s", "fr", 3, f"same id {k % 9}") for k in range(40)]
    return found


def test_odd_rows_against_brute_force(spark, rows, tmp_path):
    given = odd_rows(rows)
    assert result(spark, given, tmp_path) == wanted(given)


def test_many_chunks_and_sparse_ids(spark):
    ids = [*range(100, 180), *(i * 999_983 - 10**9 for i in range(60)), *(2**40 + i * i for i in range(33))]
    given = [(i, "s", "en" if k % 3 else "fr", k, f"text {i}") for k, i in enumerate(ids)]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    claimed = {"n_chars": F.col("n_chars") + tampered.cast("long")}
    found = M.digests(M.manifest(frame(spark, given), claimed=claimed, chunk_bits=2))
    assert Counter(tuple(r) for r in found.collect()) == wanted(given)


def test_one_row_and_no_rows(spark, tmp_path):
    given = [(7, None, None, None, "")]
    assert result(spark, given, tmp_path / "one") == wanted(given)
    assert M.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_changed_row_breaks_its_proof(spark, rows):
    docs = frame(spark, odd_rows(rows))
    found = M.manifest(docs, claimed={"text": F.when(F.col("doc_id") == 3, F.lit("other")).otherwise(F.col("text"))})
    broken = found.filter("folded_root <> root").select("doc_id").collect()
    assert [r.doc_id for r in broken] == [3]
