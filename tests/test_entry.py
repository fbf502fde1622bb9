import os

import pytest

import __spark_entry__ as entry
from textquarry.plans import registry


def test_registry_without_a_session():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.exists(entry.SMOKE_DIR), reason="needs the driver's tables")
def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "rank", "doc_id", "score"]
    assert entry.entry(spark).count() == 10


@pytest.mark.skipif(not os.path.exists(entry.SMOKE_DIR), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["tokens_per_doc", "corpus_stats", "slugify", "url_parts", "chunk_fold", "rum_weighted_counts", "latest_value", "truncation_delta", "term_ids", "longest_document", "first_documents", "fuzziness_agreement", "planted_bits", "stream_usage"])
def test_sql_twins(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in os.listdir(entry.SMOKE_DIR):
        con.sql(f"create view {t.split('.')[0]} as select * from '{entry.SMOKE_DIR}/{t}'")
    sql = con.sql(registry.ORACLES[name])
    df = registry.QUERIES[name](spark, entry.SMOKE_DIR)
    rows = sorted(str(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
    order = [sql.columns.index(c) for c in sorted(sql.columns)]
    assert sorted(df.columns) == sorted(sql.columns)
    assert rows == sorted(str(tuple(r[k] for k in order)) for r in sql.fetchall())


@pytest.mark.skipif(not os.path.exists(entry.SMOKE_DIR), reason="needs the driver's tables")
def test_every_hundredth_vector_is_a_query(spark):
    ids = [r[0] for r in spark.read.parquet(f"{entry.SMOKE_DIR}/embeddings.parquet").select("vec_id").collect()]
    rows = registry.QUERIES["cosine_scores"](spark, entry.SMOKE_DIR).select("query_id", "vec_id").collect()
    assert len(rows) == len(set(rows)) and {tuple(r) for r in rows} == {(q, i) for q in ids if q % 100 == 0 for i in ids}
    test_sql_twins(spark, "cosine_scores")
