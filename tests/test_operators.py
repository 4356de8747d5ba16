import pytest
from pyspark.sql import functions as F

from passagebench.functions import plain
from passagebench.operators import chunking, comparison, questions, retrieval, scoring
from passagebench.plans.evaluate import Config, evaluate
from passagebench.sources import documents, reports

OUTLINE = "Preface line.\n# Part A\n## Rules\nText one here.\n| a | b |\n| 1 | 2 |\n\nMore text.\n## Fees\nFees are 5 euros.\n# Part B\nEnd."
PROSE = " ".join(f"Sentence number {i} speaks of topic{i // 7} and thing{i % 11} at length." for i in range(120))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [("outline", OUTLINE), ("prose", PROSE), ("blank", "  \n"), ("none", None), ("cjk", "東京は日本の首都です。大阪は大きい。" * 30)]
    return spark.createDataFrame(rows, "doc_id string, text string").withColumn("elements", chunking.markdown_elements(F.col("text")))


def test_markdown_elements(docs):
    found = {r.doc_id: r.elements for r in docs.collect()}["outline"]
    assert [(e.type, e.level) for e in found] == [("heading", 1), ("heading", 2), ("table", None), ("heading", 2), ("heading", 1)]
    assert all(OUTLINE[e.start : e.end].rstrip("\n").endswith(e.text) for e in found)


@pytest.mark.parametrize(("name", "params"), [("fixed", {"chunk_size": 40, "overlap": 8}), ("recursive", {"chunk_size": 40, "overlap": 8}), ("semantic", {"min_tokens": 30, "max_tokens": 90}), ("semantic_no_floor", {"max_tokens": 90}), ("structure", {"max_tokens": 60}), ("whole_document", {})])
def test_chunks_are_spans(docs, name, params):
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = chunking.chunk(docs, name, **params).collect()
    assert rows and all(texts[r.doc_id][r.start : r.end] == r.text and r.token_count == plain.count_tokens(r.text) for r in rows)
    assert {r.doc_id for r in rows} == {"outline", "prose", "cjk"}
    if name in ("fixed", "recursive"):
        assert max(r.token_count for r in rows) <= 40
        assert sorted(r.chunk_index for r in rows if r.doc_id == "prose") == list(range(sum(r.doc_id == "prose" for r in rows)))


def test_floor_and_ceiling():
    assert chunking.merge_small([(0, 0), (1, 1), (2, 2)], [5, 50, 60], 10) == [(0, 1), (2, 2)]
    assert chunking.merge_small([(0, 0), (1, 1), (2, 2)], [50, 5, 50], 10) == [(0, 1), (2, 2)]
    assert chunking.merge_small([(0, 0), (1, 1)], [1, 1], 10) == [(0, 1)]
    assert chunking.split_large([(0, 3)], [10, 10, 10, 10], lambda a, b: 10 * (b - a + 1), 20) == [(0, 1), (2, 3)]
    assert chunking.break_groups([0.1, 0.9, 0.1], 0.5) == [(0, 1), (2, 3)]


def test_annotate(docs):
    chunks = chunking.annotate(chunking.structure(docs, 60), docs).where("doc_id = 'outline'").orderBy("chunk_index").collect()
    assert any(c.contains_table for c in chunks) and chunks[-1].section_path == ["Part B"]
    assert ["Part A"] in [c.section_path[:1] for c in chunks]


def test_registry(docs):
    class Halves:
        def spans(self, text, elements):
            return [(0, len(text) // 2), (len(text) // 2, len(text))]

    chunking.register_chunker("halves", lambda: Halves(), "two halves")
    try:
        assert "halves" in chunking.strategies() and chunking.chunk(docs, "halves").where("doc_id = 'prose'").count() == 2
        with pytest.raises(ValueError):
            chunking.register_chunker("halves", lambda: Halves())
    finally:
        chunking.unregister_chunker("halves")
    for bad in ("fixed", "whole_document"):
        with pytest.raises(ValueError):
            chunking.register_chunker(bad, lambda: None)
    with pytest.raises(ValueError):
        chunking.chunk(docs, "nope")
    with pytest.raises(ValueError):
        chunking.fixed(docs, 10, 10)


@pytest.fixture(scope="module")
def corpus(spark):
    texts = ["Invoices are paid in thirty days.", "The outage lasted two hours.", "The rate limit is 500 requests.", "The audit is done every year."]
    return spark.createDataFrame([("s", f"d:s:{i}", "d", i, t, len(t.split()), 40 * i, 40 * i + len(t)) for i, t in enumerate(texts)], "strategy string, chunk_id string, doc_id string, chunk_index int, text string, token_count int, start int, end int")


def test_bm25_and_ties(spark, corpus):
    q = spark.createDataFrame([("q1", "outage hours"), ("q2", "zebra"), ("q3", "")], "question_id string, query string")
    got = {}
    for r in retrieval.bm25(corpus, q, 3).orderBy("question_id", "rank").collect():
        got.setdefault(r.question_id, []).append((r.chunk_index, r.score > 0))
    assert got["q1"][0] == (1, True) and got["q2"] == [(0, False), (1, False), (2, False)] == got["q3"]
    assert retrieval.bm25(corpus, q, 10).where("question_id = 'q2'").count() == 4


def test_dense_and_fusion(spark, corpus):
    q = spark.createDataFrame([("q1", "rate limit requests")], "question_id string, query string")
    assert retrieval.dense(corpus, q, 2).where("rank = 1").first().chunk_index == 2
    a = [(f"c{c}", r + 1) for r, c in enumerate([0, 1, 2, 3])]
    b = [(f"c{c}", r + 1) for r, c in enumerate([3, 1, 2, 0])]
    rows = spark.createDataFrame([("s", "q", c, "d", 0, 0.0, r) for c, r in a + b], "strategy string, question_id string, chunk_id string, doc_id string, chunk_index int, score double, rank int")
    assert retrieval.fuse(rows, 4).orderBy("rank").first().chunk_id == "c1"
    assert [r.chunk_id for r in retrieval.fuse(rows, 4).orderBy("rank").collect()] == [r.chunk_id for r in retrieval.fuse(rows.orderBy(F.rand(1)), 4).orderBy("rank").collect()]


def test_scoring(spark, corpus):
    asked = spark.createDataFrame([("q1", "outage hours", ["the OUTAGE  lasted two hours"]), ("q2", "rate", ["limit is 500 requests. The audit"]), ("q3", "zebra", ["nowhere at all to be found"])], "question_id string, query string, gold_snippets array<string>")
    ranked = retrieval.retrieve(corpus, asked, ["bm25"], 4)
    rows = {r.question_id: r for r in scoring.per_question(ranked, corpus, asked, None).collect()}
    assert rows["q1"].gold_found == 1 and rows["q1"].first_hit_rank == 1 and rows["q3"].gold_found == 0 and not rows["q3"].split_across
    cell = scoring.metrics(scoring.per_question(ranked, corpus, asked, None), 4).first()
    assert cell.questions == 3 and abs(cell.recall_at_k - 1 / 3) < 1e-9 and abs(cell.precision_at_k - 1 / 12) < 1e-9
    near = corpus.withColumn("start", F.col("chunk_index") * 30).withColumn("end", F.col("chunk_index") * 30 + 30)
    assert {r.question_id: r.split_across for r in scoring.per_question(ranked, near, asked, None).collect()}["q2"]


def test_balanced_vectors(spark):
    rows = spark.createDataFrame([("a", 0.175, 2107.0), ("b", 0.175, 1378.0), ("c", 0.8, 0.0)], "strategy string, recall_at_k double, retrieved_tokens_at_k double")
    got = {r.strategy: r.balanced_score for r in scoring.balanced(rows).collect()}
    assert round(got["a"], 3) == 0.149 and got["b"] == 0.175 and got["c"] == 0.8


def test_validation(spark, docs):
    asked = [(0, "a", ["Text one here."]), (1, "a", ["Fees are 5 euros."]), (2, "b", []), (3, "c", [" "]), (4, "d", ["Fees are 5 eurus."]), (5, "e", ["utterly unrelated qqq zzz"]), (6, "f", ["End."])]
    q = spark.createDataFrame(asked, "q_ord long, question_id string, gold_snippets array<string>")
    got = [(r.q_ord, r.kind) for r in questions.validate(q, docs.where("text IS NOT NULL")).orderBy("phase", "q_ord").collect()]
    assert got[0] == (0, "duplicate_id") and {(2, "no_gold"), (3, "empty_gold"), (4, "fuzzy_only"), (5, "not_found"), (6, "too_short")} <= set(got)
    fix = questions.validate(q, docs.where("text IS NOT NULL")).where("kind = 'fuzzy_only'").first()
    assert fix.suggestion == "Fees are 5 euros." and fix.location.startswith("outline:")


def test_drafting(spark):
    assert questions.draft_query("Invoices must be paid within 45 days.") == "How long must invoices be paid?"
    assert questions.draft_query("Liability is capped at 30% of fees.") == "What percentage is liability capped at?"
    for s in ("When it rains it is wet for 3 days.", "RFC 3339 is used here.", "**Is it 5 days?**", "Nothing here.", "The value is 7."):
        assert questions.draft_query(s) is None, s
    d = spark.createDataFrame([(i, f"The retention period for class {i} records is limited to {i + 2} days after the final closing of accounts.") for i in range(6)], "doc_id long, text string")
    rows = questions.draft(d, 4).collect()
    assert 1 <= len(rows) <= 4 and len({r.query.lower() for r in rows}) == len(rows) and all(not r.reviewed for r in rows)


def test_check(spark):
    def run(hit):
        return spark.createDataFrame([("s", "bm25", f"q{i:02d}", int(i < hit), 1) for i in range(40)], "strategy string, retriever string, question_id string, gold_found long, gold_total long")

    assert comparison.check(run(30), run(29), "s", "bm25").ok
    assert not comparison.check(run(36), run(12), "s", "bm25").ok
    assert not comparison.check(run(30), run(29), "s", "bm25", max_drop=0.01).ok
    assert comparison.check(run(36), run(12), "s", "bm25", same_questions=False).notes


def test_cache(spark, tmp_path):
    calls = []
    texts = spark.createDataFrame([("a b",), ("c",), ("a b",)], "text string")
    keyed = comparison.cache_keys(texts, "hash")
    path = str(tmp_path / "cache")
    first = comparison.cached_embed(keyed, path, plain.hash_vectors)
    assert first.count() == 2 and not calls
    again = comparison.cache_misses(comparison.cache_keys(texts, "hash"), spark.read.parquet(path))
    assert again.count() == 0 and comparison.cache_misses(comparison.cache_keys(texts, "other"), spark.read.parquet(path)).count() == 2


def test_sources_and_evaluation(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.md").write_bytes(b"\xef\xbb\xbf" + OUTLINE.encode())
    (tmp_path / "d" / "b.txt").write_bytes("Caf\xe9 costs are 7 euros per visit. ".encode("cp1252") * 3)
    got = {r.doc_id: r for r in documents.load_documents(spark, str(tmp_path / "d")).collect()}
    assert got["a"].metadata["encoding"] == "utf-8-bom" and got["b"].metadata["encoding"] == "cp1252" and got["a"].elements and not got["b"].elements
    with pytest.raises(FileNotFoundError):
        documents.load_documents(spark, str(tmp_path / "x"))
    d = documents.load_documents(spark, str(tmp_path / "d"))
    q = documents.questions_from(spark, [{"id": "q1", "query": "fees euros", "gold_snippets": ["Fees are 5 euros."]}, {"id": "q2", "query": "visit", "gold_snippets": ["7 euros per visit"]}])
    report = evaluate(d, q, Config(strategies=[("fixed", {"chunk_size": 20, "overlap": 4}), ("structure", {"max_tokens": 40})], mode="bm25", compare=["hybrid"], resamples=200, fuzzy=None))
    assert len(report["cells"]) == 4 and report["recommendation"] and any("scored questions" in w for w in report["warnings"])
    assert len(report["per_question"]) == 8 and all(q["retrieved"] for q in report["per_question"])
    assert {g["status"] for t in report["tracks"] for g in t["gold"]} <= {"clean", "split"} and report["tracks"]
    assert "retriever" in reports.to_console(report)
    reports.to_json(report, str(tmp_path / "r.json")), reports.to_html(report, str(tmp_path / "r.html"))


def test_conversion(spark):
    paper = '{"paper_id":"1/2","title":"T","abstract":"Abs","full_text":[{"section_name":"S","paragraphs":["A long enough paragraph of text here.","x"]}],"qas":[{"question":"What  now?","answers":[{"answer":{"unanswerable":false,"evidence":["A long enough paragraph of text here.","gone"]}}]},{"question":"No?","answers":[{"answer":{"unanswerable":true,"evidence":[]}}]}]}'
    kind = "paper_id string, title string, abstract string, full_text array<struct<section_name string, paragraphs array<string>>>, qas array<struct<question string, answers array<struct<answer struct<unanswerable boolean, evidence array<string>>>>>>"
    papers = spark.createDataFrame([(paper,)], "j string").select(F.from_json("j", kind).alias("p")).select("p.*")
    d, q, dropped = comparison.convert_papers(papers)
    assert q.first().query == "What now?" and q.count() == 1 and d.first().text.startswith("# T\n\n## Abstract\n\nAbs\n\n## S")
    assert {r.reason: r.n for r in dropped.collect()} == {"no usable evidence": 1, "not verbatim": 1}


def test_stream(spark, tmp_path):
    from passagebench.streaming import chunks

    spark.createDataFrame([(1, PROSE)], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    run = chunks.chunk_stream(chunks.documents_stream(spark, str(tmp_path / "in")), "fixed", chunk_size=40, overlap=8).writeStream.format("memory").queryName("chunked").start()
    run.processAllAvailable(), run.stop()
    assert spark.table("chunked").count() > 5


def test_validate_missing_tells_near_matches(spark, tmp_path):
    """Against all windows by brute force."""
    from passagebench.functions.similarity import ratio
    from passagebench.plans import catalogue

    texts = ["The invoice must be paid within thirty days of receipt by the buyer.", "Quite another text about rivers and stones.", None]
    items = ["the invoice must be paid within thirty days of reciept by a buyer.", "No document holds these words at all.", "Quite another text about rivers", "Quite another tale of livers"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def best(short, long):
        m = len(short)
        return max(ratio(short, long[max(0, e - m) : e]) for e in range(1, len(long) + m) if long[max(0, e - m) : e])

    norms = [t.lower() for t in texts if t]
    want = [(i, "fuzzy_only" if max(best(x.lower(), t) for t in norms) >= 0.9 else "not_found") for i, x in enumerate(items) if not any(x.lower() in t for t in norms)]
    assert ("fuzzy_only" in dict(want).values()) and len(want) == 3
    assert sorted((r.q_ord, r.kind) for r in catalogue.QUERIES["validate_missing"](spark, str(tmp_path)).collect()) == want


def report_of(hits, n=40, digest="x", version="1.0", strategy="s"):
    rows = [{"strategy": strategy, "retriever": "bm25", "question_id": f"q{i:02d}", "gold_found": int(i < hits), "gold_total": 1} for i in range(n)]
    return {"schema_version": version, "summary": {"questions_sha256": digest}, "cells": [{"strategy": strategy, "retriever": "bm25"}], "per_question": rows}


def test_check_of_reports():
    check = comparison.check_reports
    assert check(report_of(30), report_of(29)).ok and check(report_of(30), report_of(30)).interval == (0, 0)
    assert not check(report_of(36), report_of(12)).ok and not check(report_of(30), report_of(29), max_drop=0.01).ok
    other = check(report_of(36), report_of(12, digest="y"))
    assert other.ok and other.notes and not other.comparable
    assert not check(report_of(36), report_of(12, digest="y"), max_drop=0.1).ok
    for bad in (report_of(1, version="2.0"), {"schema_version": "1.0", "cells": []}, report_of(1, strategy="t")):
        with pytest.raises(ValueError):
            check(report_of(1), bad)
    with pytest.raises(ValueError):
        check(report_of(1), report_of(1), strategy="nope")


def test_cache_in_evaluation(spark, tmp_path):
    seen = []

    def embed(texts):
        return plain.hash_vectors(texts)

    path = str(tmp_path / "vectors")
    d = spark.createDataFrame([("a", PROSE)], "doc_id string, text string")
    q = documents.questions_from(spark, [{"id": "q1", "query": "topic3 thing5", "gold_snippets": ["speaks of topic3"]}])
    config = Config(strategies=[("fixed", {"chunk_size": 40, "overlap": 4})], mode="dense", cache=path, resamples=200, fuzzy=None, model="plain")
    first = evaluate(d, q, config, embed=embed)
    n = comparison.cache_stats(spark.read.parquet(path)).first()
    again = evaluate(d, q, config, embed=embed)
    assert n.vectors == n.keys == comparison.cache_stats(spark.read.parquet(path)).first().vectors and not seen
    without = evaluate(d, q, Config(strategies=config.strategies, mode="dense", resamples=200, fuzzy=None), embed=None)
    for r in (again, without):
        assert [c["recall_at_k"] for c in r["cells"]] == [c["recall_at_k"] for c in first["cells"]]
    with pytest.raises(Exception):
        comparison.cached_embed(comparison.cache_keys(d.select("text"), "m"), __file__, embed)  # a file that isn't a cache
    assert comparison.cache_clear(spark, path) and not comparison.cache_clear(spark, path)


def test_config_and_plugins(tmp_path, monkeypatch):
    with pytest.raises(ValueError):
        Config(strategies=[("nope", {})])
    (tmp_path / "c.yaml").write_text("embedding: {model: intfloat/e5-small, cache: /x}\noutput: {json: r.json}\nstrategies: [{name: small, params: {kind: fixed, chunk_size: 9, overlap: 1}}]\n")
    from passagebench.plans.evaluate import load_config

    c = load_config(str(tmp_path / "c.yaml"))
    assert c.prefixes == ("query: ", "passage: ") and c.cache == "/x" and c.json_path == "r.json"

    class Point:
        name = "entry"

        def load(self):
            return lambda: None

    class Broken(Point):
        name = "broken"

        def load(self):
            raise ImportError("no such thing")

    import importlib.metadata

    monkeypatch.setattr(importlib.metadata, "entry_points", lambda group: [Point(), Broken()])
    monkeypatch.setattr(chunking, "_discovered", False)
    try:
        with pytest.warns(RuntimeWarning):
            assert "entry" in chunking.strategies()
        assert "broken" not in chunking.strategies()
    finally:
        chunking.unregister_chunker("entry")


def test_contracts(spark):
    kind = "title string, paragraphs array<struct<context string, qas array<struct<question string, is_impossible boolean, answers array<struct<text string, answer_start int>>>>>>"
    text = "The term of this contract is five years from signing."
    qas = [("What  term?", False, [("of this contract is five years", 9)]), ("Wrong?", False, [("five years from signing now", 3)]), ("None?", True, [])]
    long = "A" * 90
    rows = spark.createDataFrame([(long + "1", [(text, qas), ("more", [])]), (long + "2", [(text, qas)])], kind)
    d, q, dropped = comparison.convert_contracts(rows)
    assert d.select("doc_id").distinct().count() == 2 and q.count() == 2 and q.first().query == "What term?"
    assert {r.reason: r.n for r in dropped.collect()} == {"absent": 2, "offset wrong": 2, "nothing left": 2, "further paragraph": 1}
