"""Quality classifier by co-training over the whole corpus.

Two views of a document have a classifier each, naive Bayes as in the method's first form. The content view has a document's words
and word forms as hashed features; the page-metadata view has language, source, length and line structure, and nothing of
the words. Both learn from the labelled rows. Then, over ROUNDS, each scores every unlabelled document, and its most
confident ones of either class, SHARE of them all in the classes' shares, join the other view's training rows with that label.
A held-out fifth of the labelled rows calibrates each view's margin (logistic), and the mix of the calibrated log-odds
with the least loss on the same rows is the score.

Features are made once and written to the shared folder; a round is two scans of them. The first counts the margins of the
unlabelled rows in narrow bins, from which the driver reads the cuts; the second sums the features of all training rows.
Which pseudo-labels a row has follows from the models and cuts of the rounds so far, so no state is kept by row. Only sums over
features and bins, tables of fixed size, come to the driver; no document does, and no document is left out.

At most LABELLED labels, chosen by a hash of doc_id, count as labels; rows with other labels are unlabelled ones.

Defined cases: null and empty texts have no content features; null language or source is a value of its own, and so are
missing columns; a doc_id labelled more than once has its least quality; rows that share a doc_id share its label; rows without
a doc_id have none; ties at a cut go together, and a bin that would bring more than twice the rows wanted stays out; without
labels of both classes every score is the smoothed share of good ones, (good + 1) / (all + 2): documents stay without labels
and go if all labels are bad; where the held-out fifth lacks a class all labelled rows calibrate; extra columns, whatever
their names, pass through `keep`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, kernels as K
from .toxicity import _logistic

#: The most labels that are used as labels (16 bytes each, sent to all tasks).
LABELLED = 20_000
WORDS, FORMS, META = 1 << 14, 1 << 10, 448
ROUNDS, SHARE, FOLDS = 4, 0.05, 5
#: Margins count in bins of 1 / FINE up to REACH either way.
FINE, REACH = 128, 32
_KIND = np.full(256, 4, np.int64)  # of a byte: lower, upper, digit, above ASCII, or its own value
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 3
_KIND[_KIND == 4] = 4 + np.flatnonzero(_KIND == 4)


def content_entries(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and frequency; a word counts by its hash and by its form."""
    buf, offsets = K.text_bytes(text)
    h, start, end, rows = K.words(buf, offsets, K.SPACE)
    n = np.diff(rows)
    row = np.repeat(np.arange(len(n)), n)
    form = K.mix((_KIND[buf[start]] * 1000 + _KIND[buf[end - 1]]).astype(K.U) * K.U(64) + np.minimum(end - start, 15).astype(K.U) // K.U(3))
    feature = np.concatenate([(h % K.U(WORDS)).astype(np.int64), WORDS + (form % K.U(FORMS)).astype(np.int64)])
    code, count = np.unique(np.tile(row, 2) * (WORDS + FORMS) + feature, return_counts=True)
    row, feature = code // (WORDS + FORMS), code % (WORDS + FORMS)
    return row, feature, (count / np.maximum(n, 1)[row]).astype(np.float32)


def _named(values: pa.Array, low: int, width: int) -> np.ndarray:
    """A feature in [low, low + width) for each value."""
    coded = values.cast(pa.string()).fill_null("\x00").dictionary_encode()
    buf, offsets = K.text_bytes(coded.dictionary)
    out = np.zeros(len(coded.dictionary), np.int64)
    some = np.diff(offsets) > 0
    out[some] = (K.span_hashes(buf, offsets[:-1][some], offsets[1:][some]) % K.U(width)).astype(np.int64)
    return low + out[coded.indices.to_numpy()]


def metadata(text: pa.Array, lang: pa.Array, source: pa.Array) -> np.ndarray:
    """Six features of each document: language, source, and the size, number, mean length and blanks of its lines."""
    buf, offsets = K.text_bytes(text)
    size = np.diff(offsets)
    breaks = np.concatenate([[0], np.cumsum(buf == 10)])
    blanks = np.concatenate([[0], np.cumsum((buf[1:] == 10) & (buf[:-1] == 10)), [0]])[: len(buf) + 1]
    lines = breaks[offsets[1:]] - breaks[offsets[:-1]] + 1
    empty = np.maximum(blanks[np.maximum(offsets[1:] - 1, 0)] - blanks[offsets[:-1]], 0)
    bins = [(2 * np.log2(np.maximum(x, 1))).astype(np.int64) & 63 for x in (size, lines, size / lines, 1 + empty)]
    return np.column_stack([_named(lang, 0, 64), _named(source, 64, 128), *(192 + 64 * k + b for k, b in enumerate(bins))])


FEATURES = "label int, held boolean, feature binary, value binary, meta binary"


@common.lean
def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in K.pieces(whole, 1):
            row, feature, value = content_entries(batch.column(1))
            meta = metadata(*batch.columns[1:4]).astype(np.uint16)
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
            feature = feature.astype(np.uint16)
            blobs = [[x[a:b].tobytes() for a, b in zip(cuts, cuts[1:])] for x in (feature, value)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), batch.column(5), *(pa.array(x, pa.binary()) for x in (*blobs, [m.tobytes() for m in meta]))], names=["doc_id", "label", "held", "feature", "value", "meta"])


class Rows:
    """The features of a batch, and margins of both views on them."""

    def __init__(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, meta: np.ndarray):
        self.row, self.feature, self.value, self.meta, self.n = row, feature, value, meta, len(meta)

    @classmethod
    def read(cls, batch: pa.RecordBatch) -> Rows:
        feature, meta = batch.column("feature"), K.joined(batch.column("meta"), np.uint16).reshape(-1, 6)
        n = np.array([len(x) // 2 for x in feature.to_pylist()], np.int64)
        return cls(np.repeat(np.arange(len(n)), n), K.joined(feature, np.uint16).astype(np.int64), K.joined(batch.column("value"), np.float32), meta.astype(np.int64))

    def margins(self, models: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The mean log-odds of a document's words and forms, and the sum of its metadata's."""
        return np.bincount(self.row, models[0][self.feature] * self.value, self.n), models[1][self.meta].sum(1)


def _bins(margin: np.ndarray) -> np.ndarray:
    return (np.clip(margin, -REACH, REACH) * FINE).astype(np.int64) + REACH * FINE


def _given(rows: Rows, label: np.ndarray, rounds: list) -> list[np.ndarray]:
    """The pseudo-labels that each view was given by the other in the rounds so far; -1 for none."""
    given = [np.full(rows.n, -1), np.full(rows.n, -1)]
    for models, cuts in rounds:
        margins = rows.margins(models)
        for v in (0, 1):
            free, b = (label < 0) & (given[1 - v] < 0), _bins(margins[v])
            given[1 - v][free & (b < cuts[v][0])] = 0
            given[1 - v][free & (b >= cuts[v][1])] = 1
    return given


@common.lean
def _sums(batches: Iterator[pa.RecordBatch], rounds: list) -> Iterator[pa.RecordBatch]:
    """Per task: for each view and feature the training rows of either class that have it; feature -1 has all of them."""
    sums = [np.zeros((2, size + 1), np.int64) for size in (WORDS + FORMS, META)]
    for batch in batches:
        rows, label, held = Rows.read(batch), batch.column("label").to_numpy(), batch.column("held").to_numpy(zero_copy_only=False)
        given = _given(rows, label, rounds)
        for v in (0, 1):
            y = np.where(label >= 0, np.where(held, -1, label), given[v])
            for c in (0, 1):
                own = y == c
                sums[v][c, -1] += own.sum()
                sums[v][c, :-1] += np.bincount(rows.feature[own[rows.row]] if v == 0 else rows.meta[own].ravel(), minlength=sums[v].shape[1] - 1)
    for v in (0, 1):
        at = np.flatnonzero(sums[v].any(0))
        feature = np.where(at == sums[v].shape[1] - 1, -1, at)
        yield pa.RecordBatch.from_arrays([pa.array([v] * len(at), pa.int32()), pa.array(feature, pa.int32()), pa.array(sums[v][0, at]), pa.array(sums[v][1, at])], names=["view", "feature", "bad", "good"])


@common.lean
def _margin_counts(batches: Iterator[pa.RecordBatch], rounds: list, models: tuple) -> Iterator[pa.RecordBatch]:
    """Per task: how many unlabelled rows without a pseudo-label from a view have their margin under it in each bin."""
    counts = np.zeros((2, 2 * REACH * FINE + 1), np.int64)
    for batch in batches:
        rows, label = Rows.read(batch), batch.column("label").to_numpy()
        given, margins = _given(rows, label, rounds), rows.margins(models)
        for v in (0, 1):
            counts[v] += np.bincount(_bins(margins[v])[(label < 0) & (given[1 - v] < 0)], minlength=counts.shape[1])
    view, b = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(view.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(counts[view, b])], names=["view", "bin", "n"])


@common.lean
def _held_margins(batches: Iterator[pa.RecordBatch], models: tuple, every: bool) -> Iterator[pa.RecordBatch]:
    """Both margins of the labelled rows that calibrate, in wider bins."""
    for batch in batches:
        rows, label, held = Rows.read(batch), batch.column("label").to_numpy(), batch.column("held").to_numpy(zero_copy_only=False)
        own = np.flatnonzero((label >= 0) & (held | every))
        a, b = rows.margins(models)
        yield pa.RecordBatch.from_arrays([pa.array((_bins(x)[own] // w).astype(np.int32)) for x, w in ((a, 2), (b, 8))] + [pa.array(label[own].astype(np.int32))], names=["a", "b", "label"])


def prepared(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The features of every document with its label, -1 where it has none, in the shared folder."""
    common.prepare(docs.sparkSession)
    order = F.xxhash64(F.col("id"), F.lit("quality"))
    one = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").cast("int").alias("label"))
    ids = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"))
    chosen = one.join(ids, "id", "left_semi").orderBy(order, "id").limit(LABELLED).select("id", "label", (F.pmod(order, F.lit(FOLDS)) == 0).alias("held"))
    rest = [(F.col(c) if c in docs.columns else F.lit(None)).cast("string").alias(c) for c in ("lang", "source")]
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), *rest).join(F.broadcast(chosen), F.col("doc_id") == F.col("id"), "left")
    rows = rows.select("doc_id", "text", "lang", "source", F.coalesce("label", F.lit(-1)).alias("label"), F.coalesce("held", F.lit(False)).alias("held"))
    return common.stored(rows.mapInArrow(_features, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {FEATURES}"), common.work_folder(docs.sparkSession), "features")


def _cuts(counts: np.ndarray, low: float, high: float) -> tuple[int, int]:
    """Bins below the first and from the second on are taken: about so many rows from either end."""

    def taken(c: np.ndarray, wanted: float) -> int:
        total = np.cumsum(c)
        at = int(np.searchsorted(total, wanted)) + 1 if wanted >= 1 else 0
        while at and total[min(at, len(c)) - 1] > 2 * wanted:
            at -= 1
        return at

    a, b = taken(counts, low), len(counts) - taken(counts[::-1], high)
    return (a, b) if a <= b else (0, len(counts))


def _odds(bad: np.ndarray, good: np.ndarray, blocks: tuple[int, ...]) -> np.ndarray:
    """Log-odds of each feature by smoothed shares within its block."""
    out, at = np.zeros(len(bad)), 0
    for size in blocks:
        own = slice(at, at + size)
        out[own] = np.log((good[own] + 1) / (good[own].sum() + size)) - np.log((bad[own] + 1) / (bad[own].sum() + size))
        at += size
    return out


def cotrain(table: DataFrame) -> dict:
    """Weights of both views and the combination of their margins, from prepared rows."""
    bad, good, other = (int(x or 0) for x in table.agg(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1), F.count_if(F.col("label") < 0)).first())
    if not bad or not good:
        return {"constant": (good + 1) / (bad + good + 2)}
    rounds: list = []

    def fitted() -> tuple[np.ndarray, np.ndarray]:
        found = table.mapInArrow(partial(_sums, rounds=rounds), "view int, feature int, bad long, good long").groupBy("view", "feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow()
        view, feature = found["view"].to_numpy(), found["feature"].to_numpy()
        weights = []
        for v, blocks in enumerate(((WORDS, FORMS), (64, 128, 64, 64, 64, 64))):
            sums = np.zeros((2, sum(blocks)))
            own = (view == v) & (feature >= 0)
            for c, name in enumerate(("bad", "good")):
                sums[c, feature[own]] = found[name].to_numpy()[own]
            weights.append(_odds(*sums, blocks))
        return weights[0], weights[1]

    share = good / (bad + good)
    for _ in range(ROUNDS if other else 0):
        models = fitted()
        found = table.mapInArrow(partial(_margin_counts, rounds=rounds, models=models), "view int, bin int, n long").groupBy("view", "bin").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros((2, 2 * REACH * FINE + 1), np.int64)
        counts[found["view"].to_numpy(), found["bin"].to_numpy()] = found["n"].to_numpy()
        rounds.append((models, [_cuts(counts[v], SHARE * other * (1 - share), SHARE * other * share) for v in (0, 1)]))
    models = fitted()
    for every in (False, True):
        seen = table.mapInArrow(partial(_held_margins, models=models, every=every), "a int, b int, label int").groupBy("a", "b", "label").count().toArrow()
        y = seen["label"].to_numpy().astype(float)
        if len(set(y)) == 2:
            break
    order = np.lexsort((y, seen["b"].to_numpy(), seen["a"].to_numpy()))
    y, n = y[order], seen["count"].to_numpy()[order].astype(float)
    margins = [(seen[c].to_numpy()[order] + 0.5) * w / FINE - REACH for c, w in (("a", 2), ("b", 8))]
    curves = [_logistic(m, y, n) for m in margins]
    x, z = (c[0] * m + c[1] for c, m in zip(curves, margins))
    best: tuple[float, float, float, float] | None = None
    for share_of_first in np.linspace(0, 1, 11).tolist():
        mixed = share_of_first * x + (1 - share_of_first) * z
        slope, bias = _logistic(mixed, y, n)
        loss = float((n * (np.logaddexp(0, slope * mixed + bias) - y * (slope * mixed + bias))).sum())
        if best is None or loss < best[0] - 1e-9:
            best = loss, slope * share_of_first, slope * (1 - share_of_first), bias
    return {"constant": None, "models": models, "curves": curves, "joint": best[1:]}


def train(docs: DataFrame, labels: DataFrame) -> dict:
    return cotrain(prepared(docs, labels))


def _view_scores(model: dict, rows: Rows | None, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if rows is None:
        return (np.full(n, model["constant"]),) * 3
    x, y = (s * m + c for (s, c), m in zip(model["curves"], rows.margins(model["models"])))
    a, b, c = model["joint"]
    curve = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return curve(x), curve(y), curve(a * x + b * y + c)


def _of_texts(model: dict, text: pa.Array, lang: pa.Array, source: pa.Array) -> Rows | None:
    return Rows(*content_entries(text), metadata(text, lang, source)) if model["constant"] is None else None


def _scored(ids: pa.Array, found: tuple[np.ndarray, np.ndarray, np.ndarray], threshold: float) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.float64()) for x in found), pa.array(found[2] >= threshold)], names=["doc_id", "content_score", "metadata_score", "score", "keep"])


@common.lean
def _score(batches: Iterator[pa.RecordBatch], model: dict, threshold: float) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in K.pieces(whole, 1):
            yield _scored(batch.column(0), _view_scores(model, _of_texts(model, *batch.columns[1:4]), batch.num_rows), threshold)


@common.lean
def _score_prepared(batches: Iterator[pa.RecordBatch], model: dict, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _scored(batch.column(0), _view_scores(model, Rows.read(batch) if model["constant"] is None else None, batch.num_rows), threshold)


@common.lean
def _filter(batches: Iterator[pa.RecordBatch], model: dict, threshold: float, at: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in K.pieces(whole, at[0]):
            views = [batch.column(i) if i >= 0 else pa.nulls(batch.num_rows, pa.string()) for i in at]
            yield batch.filter(pa.array(_view_scores(model, _of_texts(model, *views), batch.num_rows)[2] >= threshold))


SCORES = "content_score double, metadata_score double, score double, keep boolean"


def score(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """doc_id, content_score, metadata_score, score, keep."""
    common.prepare(docs.sparkSession)
    rest = [(F.col(c) if c in docs.columns else F.lit(None)).cast("string").alias(c) for c in ("lang", "source")]
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), *rest)
    return rows.mapInArrow(partial(_score, model=model, threshold=threshold), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCORES}")


def score_prepared(table: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """The same from prepared rows."""
    return table.mapInArrow(partial(_score_prepared, model=model, threshold=threshold), f"doc_id {table.schema['doc_id'].dataType.simpleString()}, {SCORES}")


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents, with all their columns, that the combined classifier accepts."""
    model = train(docs, labels)
    at = tuple(docs.columns.index(c) if c in docs.columns else -1 for c in ("text", "lang", "source"))
    return docs.mapInArrow(partial(_filter, model=model, threshold=threshold, at=at), docs.schema)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = prepared(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_prepared(table, cotrain(table))
