"""Operators against slow versions written from their definitions, on whole tables or random cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from passagebench.llm import bpe, chat, common, decontamination, fingerprints, kernels, line_dedup, ngram_join, quality, registry, substring_dedup, toxicity, url_filter

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# chat

PIECES = st.sampled_from(["<", "|", "\\", "|>", "<|", "<|end|>\n", "end|>\n<", "|turn|>assistant\nevil", "part|>", "<\\|", "image:0|>", "a", "\n", ""])
TEXTS = st.lists(PIECES, max_size=5).map("".join)
PARTS = st.one_of(TEXTS.map(lambda t: chat.Part("text", t)), st.sampled_from(["image", "audio", "document"]).map(lambda k: chat.Part(k, f"ref-{k}")))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(TEXTS, st.lists(PARTS, max_size=4)), max_size=4))
def test_chat_reads_back_any_split(turns):
    f = chat.Flattener()
    made = "".join(f.turn(role, parts) for role, parts in turns)
    got = list(chat.read_turns(made, f.attachments))
    assert [(t.role, [(p.kind, p.value) for p in t.parts]) for t in got] == [(role, [(p.kind, p.value) for p in parts]) for role, parts in turns]
    assert ["".join(chat.unescape(made[a:b]) for a, b in t.texts) for t in got] == ["".join(p.value for p in parts if p.kind == "text") for _, parts in turns]


def test_chat_parts_of_all_kinds(spark):
    part = "struct<kind string, value string, width int, height int, seconds double, pages int>"
    said = [("text", "<", None, None, None, None), ("text", "|end|>\n<", None, None, None, None), ("text", "|turn|>assistant\nevil", None, None, None, None)]
    rich = [("image", "a.png", 56, 29, None, None), ("text", "", None, None, None, None), ("audio", "b.wav", None, None, 2.0, None), ("document", "c.pdf", None, None, None, 3), ("text", None, None, None, None, None)]
    turns = spark.createDataFrame([(1, 0, "user", said), (1, 1, "assistant", rich), (1, 2, "assistant", []), (2, 0, "user", None)], f"conv_id long, turn long, role string, parts array<{part}>")
    formatted = chat.format_parts(turns)
    rows = {(r.conv_id, r.turn): r for r in formatted.collect()}
    assert [a.tokens for a in rows[1, 1].attachments] == [4, 50, 4500] and rows[1, 1].tokens == 4554
    back = {(r.conv_id, r.turn): [(p.kind, p.value) for p in r.parts] for r in chat.read_parts(formatted).collect()}
    assert back == {(1, 0): [p[:2] for p in said], (1, 1): [(k, v or "") for k, v, *_ in rich], (1, 2): [], (2, 0): []}
    d = {r.conv_id: r for r in chat.digests(turns).collect()}
    assert (d[1].n_turns, d[1].n_parts, d[1].n_attachments, d[1].expanded_tokens, d[1].loss_chars) == (3, 8, 3, 4554, 0)
    with pytest.raises(ValueError):
        chat.Flattener().turn("user", [chat.Part("video", "x")])
    for bad in ("<|turn|>a\nx<|what|>y<|end|>\n", "x"):
        with pytest.raises(ValueError):
            list(chat.read_turns(bad))


# n-gram join


def test_pruning_spares_pairs_and_loses_none():
    rng = random.Random(3)
    sets = []
    for _ in range(60):
        base = [rng.getrandbits(64) for _ in range(rng.randint(4, 40))]
        for _ in range(rng.randint(1, 4)):
            sets.append(np.unique(np.array(rng.sample(base, max(1, int(len(base) * rng.uniform(0.6, 1)))) + [rng.getrandbits(64) for _ in range(rng.randint(0, 6))], kernels.U)))
    keys = ngram_join.set_keys(sets)
    levels = np.zeros(ngram_join.LEVELS, np.uint8)
    t, own, place = ngram_join.prefixes(sets, levels, 70)
    n = np.array([len(s) for s in sets], np.uint32)
    found = {}
    for prune in (True, False):
        k, sizes, a, b = ngram_join.candidates(t, np.array(keys)[own], n[own], place.astype(np.uint32), 70, prune)
        by_key = dict(zip(keys, sets))
        pairs = {frozenset((x, y)) for x, y in zip(k[a].tolist(), k[b].tolist())}
        linked = {p for p in pairs if 100 * len(np.intersect1d(*(by_key[x] for x in p))) >= 70 * len(np.union1d(*(by_key[x] for x in p)))}
        found[prune] = len(pairs), linked
    every = {frozenset((x, y)) for i, x in enumerate(keys) for j, y in enumerate(keys) if i < j and x != y and 100 * len(np.intersect1d(sets[i], sets[j])) >= 70 * len(np.union1d(sets[i], sets[j]))}
    assert found[True][0] < found[False][0] and found[True][1] == found[False][1] == every and every
    # the second descent, with bitmaps of whole sets
    order = np.lexsort((np.array(keys), n))
    a, b = np.triu_indices(len(sets), 1)
    keep = ngram_join.prune(a, b, n[order].astype(np.int64), [np.frombuffer(ngram_join.bitmap(sets[i]), kernels.U) for i in order], 70)
    kept = {frozenset((keys[order[i]], keys[order[j]])) for i, j in zip(a[keep], b[keep])}
    assert every <= kept and keep.sum() < len(a) / 2


def test_crowds_of_near_copies_make_no_candidates(spark, monkeypatch):
    rng = random.Random(5)
    texts = []
    for name in "pqr":  # two of them share half of their words
        base = [f"{'p' if name == 'q' and i < 30 else name}{i}" for i in range(60)]
        for _ in range(70):
            new = list(base)
            for i in rng.sample(range(60), rng.choice([0, 1, 1, 2, 3, 5, 8])):
                new[i] = f"x{rng.getrandbits(40)}"
            texts.append(" ".join(new))
    texts += [" ".join(f"y{rng.getrandbits(40)}" for _ in range(30)) for _ in range(20)] + texts[:5] + ["", "p0", None]
    for name, value in (("CROWD", 16), ("BLOCK_SETS", 20), ("PAIRS", 500)):
        monkeypatch.setattr(ngram_join, name, value)
    made = []
    counted = ngram_join._crowd_links
    monkeypatch.setattr(ngram_join, "_crowd_links", lambda *args: made.append(counted(*args)) or made[-1])
    got = {r.doc_id: (r.n_shingles, r.n_similar, r.component_id) for r in ngram_join.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [{tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if (w := (t or "").split()) else set() for t in texts]
    links = [(i, j) for i, s in enumerate(sets) for j, t in enumerate(sets) if i != j and s and 100 * len(s & t) >= 70 * len(s | t)]
    label = ngram_join.spanning(*np.array(links).T, len(sets)).tolist()
    degree = Counter(i for i, _ in links)
    assert got == {i: (len(s), degree[i], label[i]) for i, s in enumerate(sets)}
    assert made and made[0].agg(F.sum("links")).first()[0] > 0.5 * len(links)
    # a tree makes no pair of one crowd, and every one of two
    t, k, n, place = np.full(300, 7, kernels.U), np.arange(300), np.full(300, 50, np.uint32), np.zeros(300, np.uint32)
    for crowd, pairs in ((np.ones(300, np.uint16), 0), (np.repeat([1, 2, 0], [150, 140, 10]).astype(np.uint16), 150 * 140 + 10 * 290 + 45)):
        assert len(ngram_join.candidates(t, k, n, place, 70, crowd=crowd)[2]) == pairs


def test_overlaps():
    rng = np.random.default_rng(2)
    left, right = ([np.unique(rng.zipf(1.3, rng.integers(0, 80)).astype(kernels.U)) for _ in range(n)] for n in (50, 30))
    want = [[len(np.intersect1d(s, t)) for t in right] for s in left]
    assert ngram_join.overlaps(left, right).tolist() == want
    assert ngram_join.overlaps(left, left[:1]).shape == (50, 1)


def test_one_of_each(spark):
    base = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(5, base), (3, base + " more"), (None, base), (3, base), (3, base), (9, "other words stand here"), (9, "other words stand here"), (None, "only null ids"), (None, "only null ids"), (1, None), (1, None), (2, "")]
    out = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = sorted((str(r.doc_id), r.text or "") for r in out)
    assert len([r for r in out if r.text and r.text.startswith("one two")]) == 1 and ("3", "") not in kept
    assert [k for k in kept if not k[1].startswith("one two")] == [("1", ""), ("1", ""), ("2", ""), ("9", "other words stand here"), ("None", "only null ids")]


def test_hubs_in_components(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HUB", 3)
    edges = [(1, i) for i in range(10, 30)] + [(40, i) for i in range(41, 50)] + [(29, 49), (60, 61)]
    got = {r.node: r.label for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long"), common.work_folder(spark), 0).collect()}
    assert got == {**{i: 1 for i in [1, *range(10, 30), *range(40, 50)]}, 60: 60, 61: 60}


# line dedup


def test_lines_beyond_the_bound(spark, documents):
    index = line_dedup.LineIndex(spark, 2).insert(documents)
    want = sorted(map(str, index.apply(documents, digest=True).collect()))
    for bound in (0, 16 * 20, 16 * (index.n_repeated - 1)):  # no, few and nearly all keys on the spot
        assert sorted(map(str, index.apply(documents, digest=True, bound=bound).collect())) == want
    assert sum("n_dropped=0" not in x for x in want) > 5


def test_deletion_is_reversible(spark, documents):
    half, other = documents.where("doc_id % 2 = 0"), documents.where("doc_id % 2 = 1")
    index = line_dedup.LineIndex(spark, 2).insert(half)
    want = sorted(map(str, index.apply(documents, digest=True).collect()))
    index.delete(other)  # never inserted
    index.insert(other)
    assert sorted(map(str, index.apply(documents, digest=True).collect())) == want
    assert index.counts.where("n <= 0").count() == 0


def test_cuckoo_filter():
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    f = line_dedup.CuckooFilter.sized(3000)
    assert f.insert(keys) and f.holds(keys).all()
    f.delete(keys[:1500])
    assert f.holds(keys[1500:]).all() and f.holds(keys[:1500]).mean() < 0.02
    assert line_dedup.CuckooFilter.load(f.table.tobytes()).holds(keys[1500:]).all()
    assert not line_dedup.CuckooFilter.sized(8).insert(keys)


# substring dedup


def brute_removed(texts, least=substring_dedup.LEAST_WORDS):
    """Sentences of each text covered by a run of two or more, of enough words, that isn't the first of its kind."""
    words, bounds = [], []
    for t in texts:
        buf, offsets = kernels.text_bytes(pa.array([t or ""]))
        _, n, _, _ = substring_dedup.sentences(buf, offsets)
        w = re.findall(r"[^ \t-\r]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        ends = np.cumsum(n).tolist()
        words.append([tuple(w[e - k : e]) for e, k in zip(ends, n.tolist())])
    first, gone = {}, [set() for _ in texts]
    for d, s in enumerate(words):
        for i in range(len(s)):
            run = ()
            for j in range(i, len(s)):
                run += (s[j],)
                if len(run) >= 2 and sum(map(len, run)) >= least and first.setdefault(run, (d, i)) != (d, i):
                    gone[d].update(range(i, j + 1))
                if len(run) > 2 * least:
                    break
    return [len(g) for g in gone]


def test_repeated_spans_against_every_run(spark):
    rng = random.Random(8)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) + "." for _ in range(14)]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(80)]
    got = {r.doc_id: r.n_removed for r in substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), counts=True).collect()}
    assert [got[i] for i, _ in rows] == brute_removed([t for _, t in rows]) and sum(got.values()) > 50


def test_repeated_spans_of_documents(spark, documents):
    rows = sorted((r.doc_id, r.text) for r in documents.collect())
    got = {r.doc_id: r.n_removed for r in registry.QUERIES["op2_substring_dedup"](spark, SF).collect()}
    assert [got[i] for i, _ in rows] == brute_removed([t for _, t in rows])


# fingerprints


def slow_chunks(text):
    raw, out, start = text.encode(), {}, 0
    gear = []
    for i in range(len(raw)):
        h = 0
        for k in range(fingerprints.WINDOW):
            if i - k >= 0:
                h = (h + (int(fingerprints.GEAR[raw[i - k]]) << k)) & 0xFFFFFFFF
        gear.append(h)
    while start < len(raw):
        end = min(len(raw), start + fingerprints.MOST)
        for i in range(start + fingerprints.LEAST - 1, end):
            mask = int(fingerprints.STRICT if i + 1 - start < fingerprints.NORMAL else fingerprints.LOOSE)
            if not gear[i] & mask:
                end = i + 1
                break
        out[raw[start:end]] = end - start
        start = end
    return out


def test_fingerprints_of_documents(spark, documents):
    rows = sorted((r.doc_id, r.text or "") for r in documents.collect())
    got = {r.doc_id: r for r in registry.QUERIES["op1_document_fingerprints"](spark, SF).collect()}
    assert len(got) == len(rows)

    def like(a, b):
        total = sum(a.values()) + sum(b.values())
        return 2 * sum(n for c, n in a.items() if c in b) / total if total else 1.0

    for (i, t), (_, u) in list(zip(rows, rows[1:] + rows[:1]))[::9]:
        q = len(t) // 4
        e = t[: len(t) - q] + u[:q]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        if len(t) + len(u) < 8000:
            # within a batch a chunk's first gear hashes see the bytes before the text, which only widens where it may end
            own, edited, following = slow_chunks(t), slow_chunks(e), slow_chunks(u)
            assert abs(r.near_edited - like(own, edited)) < 0.2 and abs(r.near_next - like(own, following)) < 0.2
    same = defaultdict(set)
    for i, t in rows:
        same[t].add(got[i].fingerprint)
    assert all(len(f) == 1 for f in same.values())


def test_containment():
    a, b = fingerprints.chunk_sets([b"x" * 10, b""])
    assert fingerprints.containment(a, a) == 1 and fingerprints.containment(a, b) == 0 and fingerprints.containment(b, b) == 1 and fingerprints.containment(b, a) == 0
    text = " ".join(str(i * 7919 % 10007) for i in range(900)).encode()
    x, y = fingerprints.chunk_sets([text, b"something before it " + text + b" and after"])
    assert fingerprints.containment(x, y) > fingerprints.containment(y, x) > 0.9 and fingerprints.likeness(x, y) > 0.9


def test_fingerprints_of_hot_and_string_ids(spark):
    rows = [(7 if i % 3 else i, f"text number {i} " * 9) for i in range(300)]
    assert fingerprints.compare_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).count() == 300
    named = spark.createDataFrame([(f"d{i:03d}", t) for i, (_, t) in enumerate(rows)] + [(None, "z")], "doc_id string, text string")
    out = {r.doc_id: r for r in fingerprints.compare_edits(named).collect()}
    this, after = rows[4][1], rows[5][1]
    q = len(this) // 4
    assert len(out) == 301 and out["d004"].edited_sha256 == hashlib.sha256((this[: len(this) - q] + after[:q]).encode()).hexdigest()


# quality


def test_quality_on_rows_it_has_not_seen(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    seen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 0
    rows = quality.score(docs, quality.train(docs, labels.where(seen))).join(labels.where(~seen), "doc_id").collect()
    good, bad = ([r.keep for r in rows if r.quality == q] for q in (1, 0))
    assert sum(good) / len(good) > 0.95 and sum(bad) / len(bad) < 0.5


def test_quality_of_few_labels(spark):
    texts = [(i, ("clean words here and there. " * 5) if i % 2 else "%%% &&& $$$ bad%%% " * 9) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    label = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    assert quality.keep(docs, label([(i, 0) for i in range(20)])).count() == 0
    assert quality.keep(docs, label([(i, 1) for i in range(20)])).count() == 60
    assert {r.doc_id % 2 for r in quality.keep(docs, label([(0, 0), (1, 1), (2, 0), (3, 1)])).collect()} == {1}


def test_pseudo_labels_come_from_all_documents():
    counts = np.array([5, 0, 5, 100, 0, 7, 1])
    assert quality._cuts(counts, 6, 5) == (3, 5) and quality._cuts(counts, 0, 0) == (0, 7) and quality._cuts(counts, 30, 30) == (3, 4)


# urls


def test_url_rules_and_plan(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = {r.page_id: r for r in url_filter.op6_url_filter(spark, SF).collect()}
    for p in pages.collect():
        rest = (p.url or "").partition("://")[2]
        host = re.split("[/?#]", rest)[0].lower()
        path = re.split("[?#]", rest[len(host) :])[0]
        fits = [(len(x), x, v) for x, v in url_filter.RULES if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith(x[x.index("/") :])]
        r = rows[p.page_id]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None)
        assert r.verdict == (max(fits)[2] if fits else ("block" if r.score >= 0.5 else "allow"))
    plan = url_filter.op6_url_filter(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_url_model_on_words_it_has_not_seen(spark):
    table, out = url_filter.LABELLED, []
    for k in (0, 1):
        weights, bias = url_filter.fit(spark, [x for i, x in enumerate(table) if i // 2 % 4 != k])
        host, path = url_filter.parts(F.col("url"))
        held = spark.createDataFrame([("http://" + u, y) for i, (u, y) in enumerate(table) if i // 2 % 4 == k], "url string, y int")
        out += held.select("y", (url_filter.score(host, path, weights, bias) >= 0.5).alias("p")).collect()
    hit = sum(r.p and r.y for r in out)
    assert hit / sum(r.p for r in out) > 0.8 and hit / sum(r.y for r in out) > 0.55


# bpe


def test_documents_against_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in registry.QUERIES["op8_bpe"](spark, "/root/testdata/sf0.01").collect()} == want


def test_other_tokenizers_are_refused():
    good = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}, "model": {"type": "BPE"}, "added_tokens": []}
    bpe.supported(good)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": {"type": "Unigram"}}, {"added_tokens": [{"content": "x", "lstrip": True}]}, {"model": {"type": "BPE", "dropout": 0.1}}):
        with pytest.raises(ValueError):
            bpe.supported(good | change)


# toxicity


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = registry.QUERIES["op9_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit / max(1, sum(r.predicted for r in rows)) > 0.7 and hit / sum(r.toxic for r in rows) > 0.6


def test_calibration_of_segments():
    """The chance that a clean text has a segment as good as this falls with the score and grows with the text."""
    m = toxicity.Model(np.zeros(0, kernels.U), np.zeros(0), decay=0.7, scale=0.2)
    for n in (10, 1000):
        for s in (1.0, 4.0, 9.0):
            want = -np.log(1 - np.exp(-m.scale * n * np.exp(-m.decay * s)))
            assert abs(m.log_p(s, n) - want) < 1e-6 * max(1, abs(want))
    assert m.log_p(9, 10) > m.log_p(4, 10) > m.log_p(4, 1000)


# decontamination


def test_longest_matches_and_small_blocks(spark, documents, monkeypatch):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    split = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    items = [split(r.text) for r in benchmark.collect()]
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 100)
    monkeypatch.setattr(decontamination, "SHARD_BYTES", 1 << 16)
    got = {r.doc_id: r for r in decontamination.contamination(documents, benchmark).collect()}
    plain = {r.doc_id: r.n_hit for r in registry.QUERIES["op10_benchmark_decontamination"](spark, SF).collect()}
    assert {i: r.n_hit for i, r in got.items()} == plain and any(plain.values())
    for r in documents.collect():
        w = split(r.text)
        if got[r.doc_id].n_hit or r.doc_id % 10 == 0:
            best = 0
            for item in items:
                n = min(10, len(item))
                at = defaultdict(list)
                for j in range(len(item) - n + 1):
                    at[tuple(item[j : j + n])].append(j)
                for i in range(len(w) - n + 1):
                    for j in at.get(tuple(w[i : i + n]), ()) if n else ():
                        k = n
                        while i + k < len(w) and j + k < len(item) and w[i + k] == item[j + k]:
                            k += 1
                        best = max(best, k)
            assert got[r.doc_id].longest_match == best


# names of columns


INTERNAL = """row_key row_key_of dropped_lines owner line shard lane kind x y a b n key n_sentences n_removed span_doc span_codes span_key part open h doc code codes
label held feature value meta id chosen_id content_score metadata_score score keep tail size to first first_id first_h hot_key cold_key of_key copies stays again gone_id
component_id n_similar cell cells tokens bits place t k many hub m node labelled_id toxic fold held_out predicted items n_words n_hit block item_id ids n_tokens c0 c1 c2 document
""".split()


@pytest.fixture(scope="module")
def clashing(spark):
    texts = [None, "", "one two three four five. six seven eight nine ten. eleven twelve thirteen fourteen.", "one two three four five. six seven eight nine ten. eleven twelve thirteen fourteen.", "A\nB\nA", "words here"]
    rows = spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    return rows.select("*", *[F.lit(f"own {c}").alias(c) for c in INTERNAL])


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES] + ["substring dedup", "substring counts", "fingerprints", "toxicity", "scores", "encode", "lines beyond the bound"])
def test_any_column_names(spark, clashing, name):
    stage = dict(corpus_pipeline.STAGES).get(name)
    labels = spark.createDataFrame([(2, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int").withColumn("label", F.lit("x")).withColumn("id", F.lit("y"))
    if stage:
        out = stage(spark, clashing, SF)
    else:
        out = {
            "substring dedup": lambda: substring_dedup.without_repeats(clashing), "substring counts": lambda: substring_dedup.without_repeats(clashing, counts=True), "fingerprints": lambda: fingerprints.compare_edits(clashing),
            "toxicity": lambda: toxicity.score(clashing, toxicity.train(clashing, labels)), "scores": lambda: quality.score(clashing, quality.train(clashing, labels)), "encode": lambda: ngram_join.similar(clashing),
            "lines beyond the bound": lambda: line_dedup.LineIndex(spark, 2).insert(clashing).apply(clashing, bound=0),
        }[name]()
    rows = out.collect()
    assert len(rows) == (5 if name == "n-gram Jaccard join" else 6)
    if out.columns[: len(clashing.columns)] == clashing.columns:
        at = {c: i for i, c in enumerate(out.columns)}
        assert all(r[at[c]] == f"own {c}" for r in rows for c in INTERNAL)


def test_string_ids(spark):
    rows = spark.createDataFrame([("b", "One two three four five six. Seven eight nine ten eleven twelve."), ("a", "One two three four five six. Seven eight nine ten eleven twelve."), (None, "x")], "doc_id string, text string")
    assert sorted(r.n_removed for r in substring_dedup.without_repeats(rows, counts=True).collect()) == [0, 0, 2]
    assert sorted((r.doc_id or "", r.component_id or "") for r in ngram_join.similar(rows).collect()) == [("", ""), ("a", "a"), ("b", "a")]
    assert ngram_join.one_of_each(rows).count() == 2


def test_work_folder_is_shared(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        common.work_folder(Session())
