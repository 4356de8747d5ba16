import pytest
from pyspark.sql import functions as F

from passagebench.functions import plain, stats
from passagebench.functions import text as T
from passagebench.functions.similarity import best_alignment, lcs, partial_ratio

SAMPLES = [
    "", " \n ", "One. Two! Three?", "See Dr. Smith (e.g. here). Then go.", "Pi is 3.14 today. Yes.", "これは文です。次の文です。最後。", "He said **stop?** Then left.", "First para\n\nSecond para etc\n\nThird.",
    "यह वाक्य है। दूसरा वाक्य।", "彼は「三十日です。」と述べた。", "a.b c.d", "Mixed 日本語 text. Ende!", "No end",
]


def column(spark, texts, c):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", c.alias("x")).collect()
    return [r.x for r in sorted(rows, key=lambda r: r.i)]


def test_sentences_native_equal_plain(spark):
    got = column(spark, SAMPLES, T.sentence_spans(F.col("t")))
    assert [[(s.start, s.end) for s in x] for x in got] == [plain.sentence_spans(t) for t in SAMPLES]


@pytest.mark.parametrize(("text", "n"), [("One. Two! Three?", 3), ("これは文です。次の文です。最後。", 3), ("Pi is 3.14, e.g. here. Yes.", 2), ("彼は「三十日です。」と述べた。次。", 2), ("Ask Dr. Who. Now.", 2)])
def test_sentence_counts(text, n):
    assert len(plain.sentence_spans(text)) == n


def test_tokens_and_terms(spark):
    texts = ["Hello, World 42!", "東京都 と x", "", "ab_c"]
    assert column(spark, texts, T.token_count(F.col("t"))) == [plain.count_tokens(t) for t in texts]
    assert column(spark, texts, T.bm25_terms(F.col("t"))) == [["hello", "world", "42"], ["東京", "京都", "と", "x"], [], ["ab", "c"]]
    assert column(spark, [" A  B\n\tC "], T.normalize(F.col("t"))) == ["a b c"]


def test_scripts_and_languages(spark):
    english = "the cat is in the house and it is not on the table with all of that which was there " * 4
    texts = [english, "Привет мир это большой текст здесь", "short", "die Katze ist nicht auf dem Tisch und der Hund ist bei den Kindern von nebenan " * 5]
    assert column(spark, texts, T.dominant_script(F.col("t"))) == ["latin", "cyrillic", None, "latin"]
    assert column(spark, texts, T.detect_language(F.col("t"))) == ["en", None, None, "de"]
    assert T.model_scope("intfloat/multilingual-e5-small") == "multilingual" and T.model_scope("BAAI/bge-small-en-v1.5") == "english" and T.model_scope("x") == "unknown"
    assert T.prefix_scheme("intfloat/e5-small") == ("query: ", "passage: ") and T.prefix_scheme("BAAI/bge-m3") == ("", "")


def test_similarity():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
        return row[-1]

    for a, b in [("kitten", "sitting"), ("abc", "abc"), ("", "x"), ("aaaa", "aa"), ("banana", "ananas")]:
        assert lcs(a, b) == slow(a, b)
    assert partial_ratio("needle", "hay needle hay") == 1 and best_alignment("needle", "hay needle hay")[1:] == (4, 10)
    assert partial_ratio("the notice period is thirty days", "Clause 4: the notise period is thirty days. End.") > 0.9
    assert partial_ratio("abcd", "wxyz") == 0


def test_statistics():
    low, high = stats.mean_interval([0, 0.5, 1, 1, 0.5, 0, 1, 0.5])
    assert low < 0.5625 < high and stats.mean_interval([]) == (0, 0)
    assert stats.paired_interval([0.5] * 9, [0.5] * 9) == (0, 0)
    assert stats.paired_interval([1.0] * 30, [0.0] * 30)[0] > 0.5
    assert stats.mean_interval([0, 1, 1], seed=3) == stats.mean_interval([0, 1, 1], seed=3)
    with pytest.raises(ValueError):
        stats.paired_interval([1], [1, 2])
    assert stats.questions_to_separate(20, 0, (-1, 1)) is None and stats.questions_to_separate(889, 1.76e-5, (-0.022, 0.023)) is None
    assert 70 < stats.questions_to_separate(70, 0.034, (-0.048, 0.121)) < 100_000


def test_alignment_against_all_windows():
    import random

    from passagebench.functions.similarity import ratio

    rng = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randint(1, n))) for n in (9, 40))
        if len(a) > len(b):
            a, b = b, a
        windows = [(max(0, e - len(a)), min(e, len(b))) for e in range(1, len(b) + len(a))]
        assert abs(partial_ratio(a, b) - max(ratio(a, b[x:y]) for x, y in windows)) < 1e-12


def test_possible_ends_lose_no_window():
    import random

    import numpy as np

    from passagebench.functions.similarity import grams, possible_ends

    rng = random.Random(9)
    told = 0
    for _ in range(400):
        a = "".join(rng.choice("abcde ") for _ in range(rng.randint(3, 30)))
        noisy = "".join(c if rng.random() > 0.1 else rng.choice("xyz") for c in a)
        b = "".join(rng.choice("abcde ") for _ in range(rng.randint(0, 60))) + noisy + "".join(rng.choice("abcde ") for _ in range(rng.randint(0, 60)))
        if len(a) > len(b):
            continue
        for above in (0.6, 0.8, 0.9):
            ends = possible_ends(len(a), np.unique(grams(a)), grams(b), len(b), above)
            told += ends is not None and len(ends) < len(b)
            assert best_alignment(a, b, above, ends) == best_alignment(a, b, above)
    assert told > 100
