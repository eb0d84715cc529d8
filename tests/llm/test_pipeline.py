import corpus_pipeline
import duckdb
import pytest
from gaugeworks.llm import queries


def test_stages_in_order_and_columns(spark, sf_dir):
    docs = corpus_pipeline.table(spark, sf_dir, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, sf_dir), "stage")
        after = docs.count()
        assert 0 < after <= before
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
        before = after
    assert docs.columns == [*columns, "piece_ids", "n_pieces", "round_trip"]
    assert docs.filter("NOT round_trip").isEmpty()
    assert docs.select("text").distinct().count() == before
    every = corpus_pipeline.table(spark, sf_dir, "documents").collect()
    assert {tuple(r)[: len(columns)] for r in docs.collect()} <= {tuple(r) for r in every}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, sf_dir, name):
    frame = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    with duckdb.connect() as duck:
        for table in ("documents", "pages"):
            duck.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
        result = duck.execute(queries.ORACLES[name])
        names = [d[0] for d in result.description]
        wanted = sorted(repr([r[names.index(c)] for c in columns]) for r in result.fetchall())
    assert sorted(names) == columns
    assert sorted(repr([r[c] for c in columns]) for r in frame.collect()) == wanted
