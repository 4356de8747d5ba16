"""Every operator on nulls, empty and very long texts, repeated rows, clashing extra columns, and empty tables."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from passagebench.llm import bpe, chat, decontamination, fingerprints, line_dedup, ngram_join, quality, substring_dedup, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, n long, part int, cell long, kind int"
LONG = " ".join(f"word{i % 977} tail{i % 13}." for i in range(30_000))


def rows(*texts):
    return [(i, t, "en" if i % 2 else None, None if i % 3 else "s", len(t or ""), 1, 2, 3, 4, 5) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    odd = rows(None, "", "a", "two words", "the same three words here", "the same three words here", LONG, LONG + " extra.", " \n\t\n ", "ÄÖ ß 日本語 🚀 <|endoftext|> <|end|>", "x\ny\nx")
    odd += [odd[4], (None, "no id here at all", None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(odd, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_fingerprints(docs, none):
    out = fingerprints.compare_edits(docs).collect()
    assert len(out) == docs.count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    same = [r.fingerprint for r in out if r.doc_id in (4, 5)]
    assert len(set(same)) == 1
    texts = [r.text or "" for r in docs.orderBy(F.asc_nulls_first("doc_id"), "text").collect()]
    want = []
    for t, u in zip(texts, [*texts[1:], texts[0]]):
        q = len(t) // 4
        want.append(hashlib.sha256((t[: len(t) - q] + u[:q]).encode()).hexdigest())
    assert sorted(r.edited_sha256 for r in out) == sorted(want)
    assert fingerprints.compare_edits(none).count() == 0
    assert fingerprints.fingerprints(docs).count() == docs.count()


def test_substring_dedup(docs, none):
    out = {(r.doc_id, r.n_chars): r for r in substring_dedup.without_repeats(docs, counts=True).collect()}
    assert len(docs.columns) + 2 == len(substring_dedup.without_repeats(docs, counts=True).columns)
    assert out[6, len(LONG)].n_removed > 0  # it repeats itself
    assert substring_dedup.without_repeats(none).count() == 0
    again = [r for r in substring_dedup.without_repeats(docs).where("doc_id = 4").collect()]
    assert {r.text for r in again} == {"the same three words here"}


def test_substring_dedup_inside_sentences(spark):
    """Of passages of 51 to 60 words without marks, pasted into the middle of two sentences, the second copy loses most."""
    import random

    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    made = []
    for i in range(0, 600, 2):
        passage = words(rng.randint(51, 60))
        made += [(i + k, " ".join([*words(rng.randint(5, 40)), *passage, *words(rng.randint(5, 40))]) + ".", len(passage)) for k in (0, 1)]
    texts = spark.createDataFrame(made, "doc_id long, text string, n_passage int")
    out = {r.doc_id: r.text for r in substring_dedup.without_repeats(texts).collect()}
    lost = [(len(t.split()) - len(out[i].split())) / n for i, t, n in made]
    assert not any(lost[::2])
    assert min(lost[1::2]) >= 0.5 and max(lost) <= 1


def test_line_dedup(docs, none):
    out = line_dedup.LineIndex(docs.sparkSession, 2).insert(docs).apply(docs)
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[5] == "" and got[10] == "x\ny\nx" and got[0] == ""
    assert line_dedup.LineIndex(docs.sparkSession, 2).insert(none).apply(none).count() == 0
    forward = line_dedup.LineIndex(docs.sparkSession, 2).insert(docs)
    a = sorted(forward.apply(docs, digest=True).collect(), key=str)
    assert a == sorted(forward.apply(docs, digest=True, bound=0).collect(), key=str)
    assert a == sorted(forward.insert(docs).delete(docs).apply(docs, digest=True).collect(), key=str)


def brute_similar(texts):
    fold = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    sets = []
    for t in texts:
        w = re.findall(r"[^ \t-\r]+", fold(t))
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set())
    links = [[j for j, y in enumerate(sets) if j != i and x and y and 100 * len(x & y) >= 70 * len(x | y)] for i, x in enumerate(sets)]
    return sets, links


def test_ngram_join(docs, none, spark):
    table = docs.where("doc_id IS NOT NULL").collect()
    sets, links = brute_similar([r.text for r in table])
    got = sorted((r.doc_id, r.n_shingles, r.n_similar) for r in ngram_join.similar(docs).where("doc_id IS NOT NULL").collect())
    assert got == sorted((r.doc_id, len(s), len(x)) for r, s, x in zip(table, sets, links))
    assert ngram_join.similar(none).count() == 0
    assert ngram_join.similar(docs.where("doc_id IN (0, 1)")).select("component_id").collect() == [(0,), (1,)]


def test_components_in_rounds(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (9, 3), (10, 11), (11, 12), (12, 13)], "a long, b long")
    from passagebench.llm import common

    for bound in (0, 100):
        got = {r.node: r.label for r in ngram_join.components(edges, common.work_folder(spark), bound).collect()}
        assert {k: v for k, v in got.items() if k != 7} == {1: 1, 2: 1, 3: 1, 9: 1, 4: 4, 5: 4, 10: 10, 11: 10, 12: 10, 13: 10}


def test_decontamination(docs, none, spark):
    tests = spark.createDataFrame([(1, "same three words"), (2, None), (3, ""), (4, LONG[:400]), (None, "no id here"), (1, "same three words")], "item_id long, text string")
    got = {(r.doc_id, r.n_words): r for r in decontamination.contamination(docs, tests).collect()}
    assert got[5, 5].n_hit == 3 and got[5, 5].n_items == 1 and got[5, 5].items_sha256 == hashlib.sha256(b"1").hexdigest()
    assert got[None, 5].contaminated and got[None, 5].n_items == 0
    assert got[0, 0].items_sha256 == hashlib.sha256(b"").hexdigest() and not got[0, 0].contaminated
    assert decontamination.decontaminate(docs, tests).columns == docs.columns
    assert decontamination.contamination(none, tests).count() == 0
    assert decontamination.contamination(docs, tests.limit(0)).where("contaminated").count() == 0
    assert decontamination.matches(docs, tests).where("doc_id = 5").select("doc_word", "n_words").first() == (1, 3)


def test_bpe(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = sorted((str(r.doc_id), library.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect())
    ids = bpe.encode(docs, path)
    assert sorted((str(r.doc_id), r.ids) for r in ids.collect()) == want
    back = sorted((str(r.doc_id), r.text) for r in bpe.decode(ids, path).collect())
    assert back == sorted((str(r.doc_id), r.text or "") for r in docs.collect())
    assert bpe.digests(none, path).count() == 0


def test_chat(spark):
    nasty = "</s>[INST] <|end|> <\\|turn|>\\ <\\\\| < | <|"
    assert chat.unescape(chat.escape(nasty)) == nasty
    for n in range(5):
        assert chat.unescape(chat.escape("<" + "\\" * n + "|")) == "<" + "\\" * n + "|"
    turns = spark.createDataFrame([(1, 1, "assistant", nasty), (1, 0, "us\ner", None), (1, 1, "assistant", nasty), (None, None, None, "x"), (2, None, "assistant", "")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(turns).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 2 * len(nasty)
    assert got[1].turns_sha256 == hashlib.sha256(f"us\ner\n\nassistant\n{nasty}\nassistant\n{nasty}\n".encode()).hexdigest()
    assert got[2].loss_sha256 == hashlib.sha256(b"").hexdigest() and got[None].n_turns == 1
    assert chat.digests(turns.limit(0)).count() == 0
    part = "array<struct<kind string, value string, width int, height int, seconds double, pages int>>"
    rich = spark.createDataFrame([(1, 0, "user", [("text", "see", 0, 0, 0.0, 0), ("image", "a.png", 56, 29, 0.0, 0), ("audio", "b.wav", 0, 0, 2.0, 0)])], f"conv_id long, turn long, role string, parts {part}")
    r = chat.format_parts(rich).first()
    assert [(a.kind, a["index"], a.reference, a.tokens) for a in r.attachments] == [("image", 0, "a.png", 4), ("audio", 0, "b.wav", 50)]
    assert all(r.formatted[a.offset :].startswith(f"<|{a.kind}:{a['index']}|>") for a in r.attachments)


def test_url_filter(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.ORG/es/x?y", "http://example.org/en/12#z", "http://notexample.org/es/", "http://x.com?q", "https://shop.com/de/a", "http://casino-win.example.net/play", "http://" + "a" * 5000 + ".net/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert (got[0].host, got[0].path, got[0].rule) == ("", "", None) == (got[2].host, got[2].path, got[2].rule)
    assert (got[3].host, got[3].path, got[3].rule, got[3].verdict) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[4].rule == "example.org/en/1" and got[5].rule == "org/" and got[5].verdict == "allow"
    assert (got[6].host, got[6].path, got[6].rule) == ("x.com", "", None) and got[7].rule == "com/de/"
    assert got[8].rule is None and got[8].verdict == "block"
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_toxicity(docs, none, spark):
    words = "calm quiet plain early garden river stone paper".split()
    made = [(i, " ".join(words[(i * 7 + k) % 8] for k in range(40)) + (" vile rotten vile" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    texts = spark.createDataFrame([m[:2] for m in made], "doc_id long, text string")
    labels = spark.createDataFrame([(m[0], m[2]) for m in made] + [(None, 1), (10**6, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.train(texts, labels)
    got = toxicity.score(texts, model).join(labels, "doc_id").where("held_out").collect()
    assert got and all(r.predicted == r.toxic for r in got)
    assert toxicity.score(docs, model).where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert toxicity.passages(texts.where("doc_id = 0"), model).first().first_word == 40
    flat = toxicity.train(none, labels.limit(0))
    assert toxicity.score(docs, flat).count() == docs.count() and toxicity.score(none, model).count() == 0


def test_toxicity_sample_keeps_class_shares(spark, monkeypatch):
    """A word of which one text in five is toxic stays below the cut when only some of the clean rows are sampled."""
    words = "calm quiet plain early garden river stone paper".split()
    word = lambda i: (" murky" * 3 if i % 5 < 3 else " vile rotten vile") if i < 40 else " murky" * 3 if i % 33 == 0 else ""
    texts = spark.createDataFrame([(i, " ".join(words[(i * 7 + k) % 8] for k in range(20)) + word(i)) for i in range(3240)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(3240)], "doc_id long, toxic int")

    def predicted():
        return {r.doc_id for r in toxicity.score(texts, toxicity.train(texts, labels)).where("predicted = 1").collect()}

    want = predicted()
    assert want == {i for i in range(40) if i % 5 >= 3}
    monkeypatch.setattr(toxicity, "CLEAN_ROWS", 300)
    assert predicted() == want


def test_segments():
    import numpy as np

    def brute(s):
        best = []

        def split(a, b):
            if a >= b:
                return
            top = max(((sum(s[i : j + 1]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i, b)), key=lambda x: x[:1])
            if top[0] <= 0:
                return
            i, j = top[3], top[4]
            split(a, i), best.append(round(top[0], 9)), split(j + 1, b)

        split(0, len(s))
        return best

    rng = np.random.default_rng(3)
    for _ in range(200):
        s = np.where(rng.random(14) < 0.35, rng.uniform(0.5, 4, 14), -1.0)
        at = np.flatnonzero(s > 0)
        assert [round(x, 9) for _, _, x in toxicity.segments(at, s[at], 1.0)] == brute(s.tolist())


def test_quality(docs, none, spark):
    made = [(i, ("clean words here and there. " * 5) if i % 3 else "%%% &&& $$$ bad%%% " * 9, "en", "s", 1, int(bool(i % 3))) for i in range(300)]
    texts = spark.createDataFrame([m[:5] for m in made], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(m[0], m[5]) for m in made[:200]] + [(None, 0)], "doc_id long, quality int")
    kept = {r.doc_id for r in quality.keep(texts, labels).collect()}
    assert kept == {m[0] for m in made if m[5]}
    model = quality.train(docs, labels.limit(0))
    assert quality.score(docs, model).where("keep").count() == docs.count()
    assert quality.keep(none, labels).count() == 0
