"""Faults that reviews found."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from passagebench.functions import plain
from passagebench.functions import text as T
from passagebench.operators import chunking, comparison, questions, retrieval, scoring
from passagebench.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_verbatim_markers(spark):
    docs = spark.createDataFrame([(1, "xx Alpha beta gamma. yy"), (2, "xx alpha  beta gamma. yy")], "doc_id long, text string")
    gold = spark.createDataFrame([(7, 0, "Alpha beta gamma.")], "question_id long, gold_index int, gold string")
    chunks = spark.createDataFrame([("fixed", 1, 0, 23), ("fixed", 2, 0, 24)], "strategy string, doc_id long, start int, end int")
    found = spark.createDataFrame([(7, 0, 1), (7, 0, 2)], "question_id long, gold_index int, doc_id long")
    shown = lambda rows: sorted((r.doc_id, r.start, r.end, r.status) for r in rows.collect())
    assert shown(comparison.gold_markers(docs, gold, chunks, found, verbatim=True)) == [(1, 3, 20, "clean")]
    assert shown(comparison.gold_markers(docs, gold, chunks, found)) == [(1, 3, 20, "clean"), (2, 3, 21, "clean")]


def test_language_at_the_limits_of_the_sql(spark):
    """Shares from 0.04 on, and leads from 0.01 on, name a language."""
    four, lead = "the and of with " + "zzz " * 92, "the and of with if der das und wenn " + "zzz " * 91
    rows = spark.createDataFrame([(0, four), (1, "the and of " + "zzz " * 93), (2, lead)], "i int, t string")
    found = rows.orderBy("i").select(T.detect_language(F.col("t"))).collect()
    assert [r[0] for r in found] == ["en", None, "en"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bm25_shuffles_no_postings(spark):
    plan = plan_of(catalogue.QUERIES["bm25_topk"](spark, SF))
    assert "term" not in plan and "text" not in plan


def test_bm25_in_blocks_against_brute_force(spark, monkeypatch):
    """Two corpora in several batches, blocks of queries, ties, queries without any term and chunks without text."""
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    rng, words = random.Random(5), [f"w{i}" for i in range(30)]
    chunks = [(s, f"{s}{d}:{i}", d, i, None if (d, i) == (3, 1) else " ".join(rng.choice(words[: 3 + d % 9 * 3]) for _ in range(rng.randrange(12)))) for s in "ab" for d in range(40) for i in range(3)]
    asked = [(q, " ".join(rng.choice(words + ["none", "of", "these"]) for _ in range(rng.randrange(5)))) for q in range(40)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        rows = spark.createDataFrame(chunks, "strategy string, chunk_id string, doc_id long, chunk_index int, text string").repartition(3)
        got = {(r.strategy, r.question_id, r.rank): (r.chunk_id, r.score) for r in retrieval.bm25(rows, spark.createDataFrame(asked, "question_id long, query string"), 4).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for s in "ab":
        own = [c for c in chunks if c[0] == s]
        terms = {c[1]: Counter((c[4] or "").split()) for c in own}
        average = sum(t.total() for t in terms.values()) / (len(own) - 1)  # a null text has no length
        df = Counter(w for t in terms.values() for w in t)
        idf = {w: math.log(1 + (len(own) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
        for q, query in asked:
            score = lambda t: round(sum(k * idf[w] * t[w] * 2.5 / (t[w] + 1.5 * (0.25 + 0.75 * t.total() / average)) for w, k in Counter(query.split()).items() if t[w]), 6)  # noqa: E731, B023
            order = sorted(own, key=lambda c: (-score(terms[c[1]]), c[2], c[3]))[:4]  # noqa: B023
            want |= {(s, q, i + 1): (c[1], score(terms[c[1]])) for i, c in enumerate(order)}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-6 for k in want)


def test_scoring_cuts_only_named_documents_again(spark):
    """Chunks may be given as a function, which is asked for the documents that rankings name."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(12)) + ".") for i in range(30)], "doc_id long, text string")
    asked_for = spark.createDataFrame([(1, "w7x3 w7x4", ["w7x3 w7x4"]), (2, "w9x9", ["w9x9 w9x10"])], "question_id long, query string, gold_snippets array<string>")
    cut, asked = lambda d: chunking.fixed(d, 6, 2, "s"), []

    def named(ids):
        asked.extend(r.doc_id for r in ids.collect())
        return cut(docs.join(ids, "doc_id", "left_semi"))

    ranked = retrieval.retrieve(cut(docs), asked_for, ["bm25"], 1)
    one, other = (scoring.per_question(ranked, c, asked_for, None).orderBy("question_id").collect() for c in (named, cut(docs)))
    assert one == other and sorted(asked) == [7, 9] and [r.gold_found for r in one] == [1, 1]


def test_md5_heads():
    words = ["", "a", "ab" * 27, "x" * 55, "x" * 56, "y" * 200, *(f"word{i}" for i in range(9000))]
    got = plain.md5_heads(pa.array(words))
    assert got.tolist() == [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in words]
    assert plain.md5_heads(pa.array(words).slice(3, 2)).tolist() == got.tolist()[3:5]


def test_postings_are_counted_within_chunks(spark):
    rows = spark.createDataFrame([("s", "d1:0", 1, 0, "b a b. C c b"), ("s", "d1:1", 1, 1, ""), ("s", "d2:0", 2, 0, None), ("s", "d3:0", 3, 0, "東京タワー x")], "strategy string, chunk_id string, doc_id long, chunk_index int, text string")
    found = retrieval.postings(rows)
    assert "Exchange" not in plan_of(found.where("length > 0"))
    assert {(r.chunk_id, r.length, r.term, r.tf) for r in found.collect()} == {("d1:0", 6, "a", 1), ("d1:0", 6, "b", 3), ("d1:0", 6, "c", 2), *(("d3:0", 5, t, 1) for t in ("東京", "京タ", "タワ", "ワー", "x"))}


def test_batches_of_texts_are_bounded_in_bytes(spark):
    """Long documents don't come 10,000 at a time."""
    docs = spark.createDataFrame([(i, f"Word {i} of it. " * 40_000) for i in range(60)], "doc_id long, text string").coalesce(1)

    class Counting:
        def spans(self, text, elements):
            return [(0, 4)]

    chunking.register_chunker("counting", Counting, replace=True)
    try:
        assert chunking.chunk(docs, "counting").count() == 60
    finally:
        chunking.unregister_chunker("counting")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    seen = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
    assert len(seen) > 1 and max(seen) < 20 << 20


def test_sentences_and_tokens_by_one_pass():
    """The faster search for sentence ends and the counts of tokens agree with their plain definitions."""
    rng, ends = random.Random(11), re.compile(T.SENTENCE_END)
    bits = ["Dr", "e.g", "etc", "ſt", "a", "b c", " ", "\n", "\n\n", ".", "!", "?", "。", "！", "」", '"', ")", "*", "\t", "x_y", "é", "東", "٣", " Mr. ", "no. "]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(25)))
        cuts = [0, *(m.end() for m in ends.finditer(text) if not plain.TAKEN_BACK.search(text, max(0, m.start() - 40), m.start() + 1)), len(text)]
        parts = [(a + len(text[a:b]) - len(text[a:b].lstrip()), text[a:b].strip()) for a, b in zip(cuts, cuts[1:])]
        assert plain.sentence_spans(text) == [(a, a + len(body)) for a, body in parts if body]
        counts, a = plain.TokenCounts(text), rng.randrange(len(text) + 1)
        b = rng.randrange(a, len(text) + 1)
        assert counts.of(a, b) == plain.count_tokens(text[a:b])
    words = " ".join(f"w{i}" for i in range(200_000)) + ". "
    begun = time.process_time()
    counts = plain.TokenCounts(words)
    assert counts.of(0, len(words)) == 200_000 and time.process_time() - begun < 2


def test_drafts_of_a_long_document(spark):
    """Each sentence is taken from its text once, not by counting characters from the beginning."""
    body = " ".join(f"The retention period for kept record {i} is limited to {i % 90 + 2} days after the closing of it." for i in range(15_000))
    docs = spark.createDataFrame([(1, body), (2, None), (3, ""), (4, "# The limit is 5 days for all of the records here now. Short is 5 days.")], "doc_id long, text string")
    begun = time.perf_counter()
    rows = questions.draft(docs, 5, per_document=2).collect()
    assert [r.tags[0] for r in rows] == ["src:1"] * 2 and time.perf_counter() - begun < 60


def test_scores_are_made_in_short_runs():
    """However many rows and queries meet, few scores are in memory at once."""
    rng = np.random.default_rng(1)
    v, q = rng.normal(size=(5000, 4)), rng.normal(size=(2000, 4))
    runs = list(retrieval._products(v, q))
    assert max(s.size for _, s in runs) <= retrieval.SCORES and sum(len(s) for _, s in runs) == 5000
    assert np.array_equal(np.vstack([s for _, s in runs]), np.round(v @ q.T, retrieval.DIGITS))
    best, scores = retrieval._Best(2, 3, ("id",)), np.array([[1.0, 0, -np.inf], [1, 0, -np.inf], [1, 2, 5]])
    for at in (3, 0):
        best.add(pa.record_batch({"id": pa.array([at, at + 1, at + 2])}), scores)
    assert list(zip(best.held["_query"].to_pylist(), best.held["id"].to_pylist())) == [(0, 0), (0, 1), (1, 2), (1, 5), (2, 2), (2, 5)]
