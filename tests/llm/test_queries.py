"""The registered queries against DuckDB, brute force or held-out labels, on the smallest tables."""

import math

import duckdb
import pytest

import corpus_pipeline
from passagebench.llm import registry

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "labels", "conversations", "embeddings")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    r = con.execute(registry.ORACLE_SQL[name])
    columns = [x[0] for x in r.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, df.select(*columns).collect())) != [] and sorted(tuple(x) for x in df.select(*columns).collect()) == sorted(r.fetchall())


def test_every_document_once(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op1_document_fingerprints", "op2_substring_dedup", "op3_quality_classifier", "op8_bpe", "op9_toxicity"):
        assert registry.QUERIES[name](spark, SF).select("doc_id").distinct().count() == n, name


def test_quality_keeps_labelled_good(spark):
    rows = registry.QUERIES["op3_quality_classifier"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    good = [r.keep for r in rows if r.quality == 1]
    assert sum(good) / len(good) > 0.95


def test_decoded_is_the_text(spark):
    import hashlib

    docs = {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: r.decoded_sha256 for r in registry.QUERIES["op8_bpe"](spark, SF).collect()} == docs


def test_pipeline_stages(spark, con):
    from .test_edges import brute_similar

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    kept = corpus_pipeline.accepted(spark, docs, SF)
    lines = corpus_pipeline.without_repeated_lines(spark, kept, SF)
    single = corpus_pipeline.one_of_each_group(spark, lines, SF)
    clean = corpus_pipeline.uncontaminated(spark, single, SF)
    assert kept.columns == lines.columns == single.columns == clean.columns == docs.columns
    assert kept.count() == lines.count()
    table = lines.collect()
    _, links = brute_similar([r.text for r in table])
    low = [r.doc_id for r in table]
    changed = True
    while changed:
        changed = False
        for i, own in enumerate(links):
            m = min([low[i], *(low[j] for j in own)])
            changed |= m < low[i]
            low[i] = m
    assert sorted(r.doc_id for r in single.collect()) == sorted(r.doc_id for r, x in zip(table, low) if r.doc_id == x)
    out = corpus_pipeline.run(spark, SF).collect()
    assert len(out) == clean.count() and all(math.isfinite(r.n_tokens) for r in out)
