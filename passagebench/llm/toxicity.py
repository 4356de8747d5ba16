"""Toxicity by maximum-scoring segments.

Words of toxic and clean labelled texts give log-odds with an informative Dirichlet prior (the words' frequencies in both
together, with PRIOR of the weight of all tokens). Words whose log-odds are significant score them, capped; all others score -DRIFT, so that clean text has a negative
mean. A linear-time scan (Ruzzo and Tompa) finds all maximal scoring segments of a text; only words with a positive score need
visiting, as the gaps between them are known. A word that was never seen significant may score by its first six bytes.

A segment's score S becomes the logarithm of its p-value by the extreme-value law of the best segment of a text of n words,
P = 1 - exp(-K n exp(-lambda S)): lambda solves mean exp(lambda s) = 1 over clean words, K is fitted to clean texts. A text's
evidence is the sum of -log P over its significant segments, and a logistic curve on it makes it the score. For K and the
curve the labelled texts are scored fold by fold with words learned from the other folds.

Labels come only from rows whose crc32(doc_id) mod 4 is not 2, at most TOXIC_ROWS and CLEAN_ROWS of them, chosen by a hash of
doc_id. All labels of each class are counted, and where one is sampled its rows weigh as many as they stand for, in the prior, the
log-odds and the curve: the score is that of the classes' true shares, whatever the size. Text is the only input of a score.

Defined cases: null and empty texts have no evidence and the lowest score; a doc_id labelled more than once is toxic if any of
its labels is; labels without a document and documents without a label are fine; a null doc_id is not held out and has no
label; without both kinds of labels every score is the share of toxic ones; extra columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, kernels as K

TOXIC_ROWS, CLEAN_ROWS = 20_000, 40_000
PRIOR, CAP, DRIFT, SIGNIFICANT, LEAST_TEXTS, FOLDS = 0.1, 6.0, 1.0, 3.0, 3, 5
ALPHA = 0.05
KINDS = ("toxic", "clean", "texts")
PREFIX = 6


def tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words and of their first bytes, and where each row begins."""
    buf, offsets = K.text_bytes(text)
    h, start, end, rows = K.words(buf, offsets, K.NOT_ALNUM)
    # a word's beginning counts only if the word is longer; else it is its own word alone
    p = K.mix(K.span_hashes(buf, start, np.minimum(end, start + PREFIX)) ^ K.U(0x5851F42D4C957F2D)) if len(h) else h
    return h, np.where(end - start > PREFIX, p, K.U(0)), rows


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@common.lean
def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch, fold and feature: tokens and texts, toxic and clean; the feature 0 has all words."""
    for whole in batches:
        for batch in K.pieces(whole, 0):
            h, p, rows = tokens(batch.column(0))
            n = np.diff(rows)
            toxic, fold = (np.array(batch.column(c).to_pylist(), np.int64) for c in (1, 2))
            row = np.tile(np.repeat(np.arange(batch.num_rows), n), 2)
            f = np.concatenate([h, p])
            f, row = f[f != 0], row[f != 0]
            order = np.lexsort((row, fold[row], f))
            f, row = f[order], row[order]
            group = np.concatenate([[True], (f[1:] != f[:-1]) | (fold[row[1:]] != fold[row[:-1]])])[: len(f)]
            own = np.concatenate([[True], group[1:] | (row[1:] != row[:-1])])[: len(f)]
            at = np.flatnonzero(group)
            y = toxic[row]
            sums = [np.add.reduceat(x.astype(np.int64), at) if len(at) else at for x in (y, 1 - y, own & (y == 1))]
            total = [np.bincount(fold, n * x, FOLDS).astype(np.int64) for x in (toxic, 1 - toxic)]
            columns = [np.append(fold[row[at]], np.arange(FOLDS)), np.append(f[at].view(np.int64), [0] * FOLDS), np.append(sums[0], total[0]), np.append(sums[1], total[1]), np.append(sums[2], [0] * FOLDS)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["fold", "f", "toxic", "clean", "texts"])


def segments(at: np.ndarray, score: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score) of a text with these words of positive score; others -drift."""
    found: list[list] = []  # [first, last, sum before, sum at the end]
    total, after = 0.0, 0
    for i, s in zip(at.tolist(), score.tolist()):
        before = total - (i - after) * drift
        total, after = before + s, i + 1
        new = [i, i, before, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new[0], new[2] = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, e - s) for a, b, s, e in found]


@dataclass
class Model:
    features: np.ndarray
    scores: np.ndarray
    decay: float = 1.0
    scale: float = 0.1
    slope: float = 0.0
    bias: float = 0.0

    def word_scores(self, h: np.ndarray, p: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h))
        if len(self.features):
            for f in (p, h):  # a word's own score comes before its beginning's
                at = np.minimum(np.searchsorted(self.features, f), len(self.features) - 1)
                own = self.features[at] == f
                out[own] = self.scores[at[own]]
        return out

    def log_p(self, score: float, n: int) -> float:
        """-log of the chance that a clean text of n words has a segment like this."""
        rate = self.scale * n * np.exp(-self.decay * score)
        return float(-np.log(-np.expm1(-rate))) if rate > 1e-12 else float(-np.log(max(rate, 1e-300)))

    def found(self, text: pa.Array) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
        """Of each text the number of words and the segments."""
        h, p, rows = tokens(text)
        s = self.word_scores(h, p)
        hot = np.flatnonzero(s > 0)
        edges = np.searchsorted(hot, rows).tolist()
        for r, (a, b) in enumerate(zip(edges, edges[1:])):
            yield int(rows[r + 1] - rows[r]), segments(hot[a:b] - rows[r], s[hot[a:b]], DRIFT) if b > a else []

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> float:
        return sum(x for _, _, s in found if (x := self.log_p(s, n)) > -np.log(ALPHA))

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + self.slope * np.log1p(evidence))))


@common.lean
def _best(batches: Iterator[pa.RecordBatch], models: list[Model]) -> Iterator[pa.RecordBatch]:
    """For the scale: label, words and best segment of each text, by the model of the row's fold."""
    for batch, model in _by_fold(batches, models):
        found = [(n, max((s for _, _, s in own), default=0.0)) for n, own in model.found(batch.column(0))]
        yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), pa.array([n for n, _ in found], pa.int64()), pa.array([round(100 * s) for _, s in found], pa.int64())], names=["toxic", "n", "best"])


@common.lean
def _evidences(batches: Iterator[pa.RecordBatch], models: list[Model]) -> Iterator[pa.RecordBatch]:
    """For the curve: label and evidence of each text, by the model of the row's fold."""
    for batch, model in _by_fold(batches, models):
        x = [round(1000 * float(np.log1p(model.evidence(n, own)))) for n, own in model.found(batch.column(0))]
        yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), pa.array(x, pa.int64())], names=["toxic", "x"])


def _by_fold(batches: Iterator[pa.RecordBatch], models: list[Model]) -> Iterator[tuple[pa.RecordBatch, Model]]:
    for batch in batches:
        fold = batch.column(2).to_numpy()
        for k in np.unique(fold).tolist():
            yield batch.filter(pa.array(fold == k)), models[k]


def _weigh(f: np.ndarray, y1: np.ndarray, y0: np.ndarray, texts: np.ndarray, n1: float, n0: float, bias: float, weights: tuple[float, float] = (1.0, 1.0)) -> Model:
    """Scores of the significant features, and lambda. weights: of a toxic and of a clean row."""
    model = Model(np.zeros(0, K.U), np.zeros(0), bias=bias)
    if min(n1, n0) <= 0:
        return model
    rate0, (w1, w0) = y0 / n0, weights
    with np.errstate(divide="ignore"):  # a weight makes a count larger, not surer
        error = np.sqrt(1 / (y1 + PRIOR * (y1 + y0)) + 1 / (y0 + PRIOR * (y1 + y0)))
    y1, y0, n1, n0 = w1 * y1, w0 * y0, w1 * n1, w0 * n0
    prior, both = PRIOR * (y1 + y0), PRIOR * (n1 + n0)
    with np.errstate(divide="ignore", invalid="ignore"):
        odds = np.log((y1 + prior) / (n1 + both - y1 - prior)) - np.log((y0 + prior) / (n0 + both - y0 - prior))
        z = odds / error
    good = (texts >= LEAST_TEXTS) & (z >= SIGNIFICANT) & (odds >= 1.0)
    order = np.argsort(f[good])
    model.features, model.scores = f[good][order], np.minimum(odds[good], CAP)[order]
    rate, low, high = rate0[good][order], 1e-6, 20.0
    for _ in range(100):  # the root of sum rate exp(l s) + (1 - sum rate) exp(-l DRIFT) = 1
        mid = (low + high) / 2
        low, high = (mid, high) if (rate * np.exp(np.minimum(mid * model.scores, 600))).sum() + max(0.0, 1 - rate.sum()) * np.exp(-mid * DRIFT) < 1 else (low, mid)
    model.decay = min(max(low, 0.05), 3.0)
    return model


def _significant(folds: list[int], totals: np.ndarray, weights: tuple[float, float]) -> Column:
    """The same test as a condition on the sums by fold, so that only words that pass it come to the driver."""
    n1, n0 = (float(w * t[folds].sum()) for w, t in zip(weights, totals))
    if min(n1, n0) <= 0:
        return F.lit(False)
    y1, y0, texts = (functools.reduce(lambda a, b: a + b, [F.col(f"{c}{k}") for k in folds]) for c in KINDS)
    error = F.sqrt(1 / (y1 + PRIOR * (y1 + y0)) + 1 / (y0 + PRIOR * (y1 + y0)))
    y1, y0 = y1 * weights[0], y0 * weights[1]
    prior, both = PRIOR * (y1 + y0), PRIOR * (n1 + n0)
    odds = F.log((y1 + prior) / (n1 + both - y1 - prior)) - F.log((y0 + prior) / (n0 + both - y0 - prior))
    # a hair's breadth below the limits: the driver decides
    return F.coalesce((texts >= LEAST_TEXTS) & (odds / error >= SIGNIFICANT - 1e-6) & (odds >= 1 - 1e-6), F.lit(False))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | float = 1.0) -> tuple[float, float]:
    """Slope and bias of weighted rows by Newton's method with a slight ridge; a step that doesn't lower the loss is halved."""
    unit = float(np.std(x)) or 1.0
    w, a = np.zeros(2), np.column_stack([x / unit, np.ones(len(x))])

    def loss(w: np.ndarray) -> float:
        z = a @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5e-2 * w @ w)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2), a.T @ (weight * (y - p)) - 1e-2 * w)
        now = loss(w)
        while loss(w + step) > now and abs(step).max() > 1e-9:
            step /= 2
        w = w + step
        if abs(step).max() < 1e-7:
            break
    return float(w[0] / unit), float(w[1])


def _labels(labels: DataFrame) -> DataFrame:
    """doc_id, label of all rows that may be learned from."""
    return labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("label"))


def class_weights(labels: DataFrame) -> tuple[float, float]:
    """How many labels a sampled toxic and a sampled clean one stand for, scaled so that the sample keeps its size."""
    count = {r.label: r["count"] for r in _labels(labels).groupBy("label").count().collect()}
    all_rows = [count.get(1, 0), count.get(0, 0)]
    sampled = [min(n, most) for n, most in zip(all_rows, (TOXIC_ROWS, CLEAN_ROWS))]
    toxic, clean = (n / k * sum(sampled) / sum(all_rows) if k else 1.0 for n, k in zip(all_rows, sampled))
    return toxic, clean


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic, fold of the training rows."""
    one = _labels(labels)
    order = F.xxhash64(F.col("doc_id"), F.lit("sample"))
    parts = [one.where(F.col("label") == y).orderBy(order, "doc_id").limit(n) for y, n in ((1, TOXIC_ROWS), (0, CLEAN_ROWS))]
    chosen = parts[0].union(parts[1]).select(F.col("doc_id").alias("labelled_id"), "label", F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold"))
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id")).select("text", F.col("label").alias("toxic"), "fold")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    common.prepare(docs.sparkSession)
    folder = common.work_folder(docs.sparkSession)
    weights = class_weights(labels)
    rows = common.stored(labelled(docs, labels), folder, "labelled")
    counts = rows.mapInArrow(_learn, "fold long, f long, toxic long, clean long, texts long").groupBy("f", "fold").agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "texts")])
    counts = common.stored(counts, folder, "counts")
    sums = counts.groupBy("f").agg(*[F.coalesce(F.sum(F.when(F.col("fold") == k, F.col(c))), F.lit(0)).cast("double").alias(f"{c}{k}") for c in KINDS for k in range(FOLDS)])
    total = sums.where("f = 0").first()
    kept = [[j for j in range(FOLDS) if j != k] for k in range(FOLDS)] + [list(range(FOLDS))]
    if total is None:
        found, cube, totals = np.zeros(0, np.int64), np.zeros((3, FOLDS, 0)), np.zeros((2, FOLDS))
    else:
        totals = np.array([[total[f"{c}{k}"] for k in range(FOLDS)] for c in KINDS[:2]])
        good = [_significant(folds, totals, weights) for folds in kept]
        table = sums.where("f <> 0").where(functools.reduce(lambda a, b: a | b, good)).toArrow()  # words significant to a model
        found = table["f"].to_numpy()
        cube = np.array([[table[f"{c}{k}"].to_numpy() for k in range(FOLDS)] for c in KINDS]).reshape(3, FOLDS, len(found))
    share = rows.agg(F.avg("toxic")).first()[0] or 0.0
    share = weights[0] * share / (weights[0] * share + weights[1] * (1 - share))
    bias = float(np.log((share + 1e-6) / (1 - share + 1e-6)))

    def made(folds: list[int]) -> Model:
        y1, y0, texts = cube[:, folds].sum(1)
        return _weigh(found.view(K.U), y1, y0, texts, float(totals[0, folds].sum()), float(totals[1, folds].sum()), bias, weights)

    *models, model = map(made, kept)
    # what comes to the driver are counts by hundredths of a score and thousandths of a logarithm
    seen = rows.select("text", "toxic", "fold").mapInArrow(partial(_best, models=models), "toxic int, n long, best long").where("toxic = 0 AND n > 0").groupBy("best").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).orderBy("best").toArrow()
    best, n, words = (seen[c].to_numpy().astype(float) for c in ("best", "rows", "n"))
    some = best > 0
    if some.any():  # half of the clean texts with a segment have a better one than the median
        middle = best[some][np.searchsorted(np.cumsum(n[some]), n[some].sum() / 2)] / 100
        scale = float(np.clip(n[some].sum() / n.sum() / (words.sum() / n.sum()) / 2 / np.exp(-model.decay * middle), 1e-6, 1.0))
        for m in (*models, model):
            m.scale = scale
    curve = rows.select("text", "toxic", "fold").mapInArrow(partial(_evidences, models=models), "toxic int, x long").groupBy("toxic", "x").agg(F.count("*").alias("n")).orderBy("x", "toxic").toArrow()
    y = curve["toxic"].to_numpy().astype(float)
    if len(set(y)) == 2:
        model.slope, model.bias = _logistic(curve["x"].to_numpy() / 1000, y, curve["n"].to_numpy() * np.where(y > 0, *weights))
    return model


@common.lean
def _score(batches: Iterator[pa.RecordBatch], model: Model, threshold: float) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in K.pieces(whole, 1):
            p = model.probability(np.array([model.evidence(n, found) for n, found in model.found(batch.column(1))], float))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])


@common.lean
def _passages(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(i, a, b - a + 1, s, x) for i, (n, found) in zip(batch.column(0).to_pylist(), model.found(batch.column(1))) for a, b, s in found if (x := model.log_p(s, n)) > -np.log(ALPHA)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((batch.schema.field(0).type, pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=["doc_id", "first_word", "n_words", "score", "evidence"])


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    common.prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string"), held_out(F.col("doc_id")))
    return rows.mapInArrow(partial(_score, model=model, threshold=threshold), f"doc_id {kind}, held_out boolean, score double, predicted int")


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """The significant passages: doc_id, first_word, n_words, score, evidence."""
    common.prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(partial(_passages, model=model), f"doc_id {kind}, first_word long, n_words long, score double, evidence double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
