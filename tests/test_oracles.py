"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

from passagebench.plans import catalogue

SF = "/root/testdata/sf0.001"
CHOSEN = ("token_counts", "sentence_spans", "fixed_chunks", "language_detect", "table_runs", "boundary_health", "bm25_topk", "dense_topk_embeddings", "recall_mrr_precision", "validate_duplicates", "draft_idf", "language_audit", "corpus_fingerprint", "structure_sections_pages", "heading_trail", "semantic_breakpoints", "split_across", "dense_topk_hash", "gold_markers", "validate_ambiguous", "bm25_idf")


def shown(rows):
    return sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", CHOSEN)
def test_matches_sql(spark, con, name):
    r = con.execute(catalogue.ORACLE_SQL[name])
    columns = [x[0] for x in r.description]
    df = catalogue.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert shown(df.select(*columns).collect()) == shown(r.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
