"""Substring deduplication over sliding sentence spans.

A sentence ends with `.`, `!` or `?` at the end of a word, or with a line. One of over LONG words is divided at its commas,
semicolons and colons, and a part that is still longer after the word of least hash of every WINDOW consecutive ones, so that
a passage repeated inside a long sentence is cut alike in both places, at most WINDOW words apart.

Every run of two or more consecutive sentences with `least_words` words or more is a span. Spans are hashed over their
case-folded words and spans with equal hashes joined over the whole corpus; of each the first by (document, sentence) stays,
and sentences covered by any span that isn't the first are removed. What lies between two sentences goes with the one before.
Only spans that begin or end with a sentence of which no sentence at the other end can be spared are sent: each sentence that
some repeated span covers is covered by one of these too (shorten the span from either end as long as the sentence stays in it).

Spans travel as sorted blobs by hash range, as many ranges as the bytes of the texts make. Within a batch only the first
occurrence of a hash is compared with other batches': the others are known not to be first, and go to a part chosen by their
document, so a span that a third of all documents share is a few rows in its hash range.

Defined cases: null and empty texts have no sentence and stay as they are; rows that share a doc_id count as one document,
in which a span at the same sentence number is one occurrence; a null doc_id counts as the smallest and such documents are
one document; documents are ordered by whole-numbered ids, ids of any other type by their 64-bit hash; extra columns,
whatever their names, pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, kernels as K

LEAST_WORDS, LEAST_SENTENCES = 12, 2
LONG = 20
WINDOW = 8
ENDS = np.isin(np.arange(256), [ord(c) for c in ".!?"])
CLAUSE_ENDS = np.isin(np.arange(256), [ord(c) for c in ",;:"])
NULL_ID = -(2**63)


def least_of_windows(h: np.ndarray, first: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Marks the word of least hash, the last of equals, in every WINDOW words that lie within one part that is long."""
    marks = np.zeros(len(h), bool)
    part = np.cumsum(first)
    i = np.flatnonzero(long[: max(0, len(h) - WINDOW + 1)] & (part[: max(0, len(h) - WINDOW + 1)] == part[WINDOW - 1 :])) if len(h) >= WINDOW else np.zeros(0, np.int64)
    best = i.copy()
    for k in range(1, WINDOW):
        best = np.where(h[i + k] <= h[best], i + k, best)
    marks[best] = True
    return marks


def sentences(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each sentence the hash, number of words and first byte; the n + 1 positions in these where each row begins."""
    h, start, end, rows = K.words(buf, offsets, K.SPACE)
    if not len(h):
        none = np.zeros(0, np.int64)
        return np.zeros(0, K.U), none, none, np.zeros(len(offsets), np.int64)
    breaks = np.concatenate([[0], np.cumsum(buf == 10, dtype=np.int64)])
    first = np.ones(len(h), bool)
    first[1:] = ENDS[buf[end[:-1] - 1]] | (breaks[start[1:]] > breaks[end[:-1]])
    first[rows[:-1][rows[:-1] < len(h)]] = True
    at = np.flatnonzero(first)
    n = np.diff(np.append(at, len(h)))
    for marked in (lambda long: CLAUSE_ENDS[buf[end - 1]], lambda long: least_of_windows(h, first, long)):
        long = np.repeat(n, n) > LONG
        first[1:] |= marked(long)[:-1] & long[1:]
        at = np.flatnonzero(first)
        n = np.diff(np.append(at, len(h)))
    with np.errstate(over="ignore"):
        place = np.arange(len(h)) - np.repeat(at, n)
        sums = np.concatenate([np.zeros(1, K.U), np.cumsum(K.mix(h + place.astype(K.U) * K.U(0xD6E8FEB86659FD93)), dtype=K.U)])
        hashes = K.mix(sums[at + n] - sums[at] + n.astype(K.U))
    return hashes, n, start[at], np.searchsorted(at, rows)


def spans(hashes: np.ndarray, n: np.ndarray, rows: np.ndarray, least_words: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first sentence and number of sentences of every span of which either end's sentence can't be spared."""
    none = np.zeros(0, np.int64)
    if not len(hashes):
        return np.zeros(0, K.U), none, none
    total = np.concatenate([[0], np.cumsum(n)])
    low, high = (np.repeat(rows[x], np.diff(rows)) for x in (slice(0, -1), slice(1, None)))
    i = np.arange(len(hashes))
    # the shortest from each first sentence, and the shortest to each last one
    end = np.maximum(i + LEAST_SENTENCES, np.searchsorted(total, total[i] + least_words))
    begin = np.minimum(i + 1 - LEAST_SENTENCES, np.searchsorted(total, total[i + 1] - least_words, "right") - 1)
    forward, backward = end <= high, begin >= low
    first, last = np.concatenate([i[forward], begin[backward]]), np.concatenate([end[forward], i[backward] + 1])
    if not len(first):
        return np.zeros(0, K.U), none, none
    code = np.unique(first * (len(hashes) + 1) + last)
    first, last = code // (len(hashes) + 1), code % (len(hashes) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, K.U), np.cumsum(hashes * K.powers(K.BASE, len(hashes)), dtype=K.U)])
        h = K.mix((sums[last] - sums[first]) * K.powers(K.INVERSE, len(hashes))[first] + (last - first).astype(K.U))
    return h, first, last - first


def _width(least_words: int) -> int:
    """More than the number of sentences that a sent span can have."""
    return max(least_words, LEAST_SENTENCES) + 1


@common.lean
def _spread(batches: Iterator[pa.RecordBatch], parts: int, least_words: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in K.pieces(whole, 1):
            hashes, n, _, rows = sentences(*K.text_bytes(batch.column(1)))
            h, at, size = spans(hashes, n, rows, least_words)
            row = np.searchsorted(rows, at, "right") - 1
            doc, code = batch.column(0).to_numpy()[row], ((at - rows[row]) * _width(least_words) + size).astype(np.uint32)
            order = np.lexsort((code, doc, h))
            h, doc, code = h[order], doc[order], code[order]
            first = np.ones(len(h), bool)
            first[1:] = h[1:] != h[:-1]
            again = ~first  # the same document and sentence once more, as in a repeated row, is no further occurrence
            again[1:] &= ~((h[1:] == h[:-1]) & (doc[1:] == doc[:-1]) & (code[1:] == code[:-1]))
            part = np.where(first, ((h >> K.U(32)) * K.U(parts) >> K.U(32)).astype(np.int64), (K.mix(doc.view(K.U)) % K.U(parts)).astype(np.int64))
            keep = np.flatnonzero(first | again)
            keep = keep[np.lexsort((first[keep], part[keep]))]
            group = part[keep] * 2 + first[keep]
            cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])) if len(keep) else []
            out = [(int(group[a]), keep[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([g >> 1 for g, _ in out], pa.int32()), pa.array([bool(g & 1) for g, _ in out], pa.bool_())]
                + [pa.array([x[i].tobytes() if x is not h or g & 1 else b"" for g, i in out], pa.binary()) for x in (h, doc, code)],
                names=["part", "open", "h", "doc", "code"],
            )


@common.lean
def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one part, which occurrences aren't the first; by document."""
    table = pa.Table.from_batches(batches, pa.schema([("part", pa.int32()), ("open", pa.bool_()), ("h", pa.binary()), ("doc", pa.binary()), ("code", pa.binary())]))
    open_rows = table["open"].to_numpy()
    free, known = table.filter(pa.array(open_rows)), table.filter(pa.array(~open_rows))
    h, doc, code = K.joined(free["h"], K.U), K.joined(free["doc"], np.int64), K.joined(free["code"], np.uint32)
    order = np.lexsort((code, doc, h))
    h, doc, code = h[order], doc[order], code[order]
    later = np.zeros(len(h), bool)
    later[1:] = (h[1:] == h[:-1]) & ((doc[1:] != doc[:-1]) | (code[1:] != code[:-1]))
    doc, code = np.concatenate([doc[later], K.joined(known["doc"], np.int64)]), np.concatenate([code[later], K.joined(known["code"], np.uint32)])
    order = np.argsort(doc, kind="stable")
    doc, code = doc[order], code[order]
    cuts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]])) if len(doc) else np.zeros(0, np.int64)
    for k in range(0, max(0, len(cuts) - 1), 10_000):
        own = list(zip(cuts[k : k + 10_001][:-1].tolist(), cuts[k : k + 10_001][1:].tolist()))
        yield pa.RecordBatch.from_arrays([pa.array([int(doc[a]) for a, _ in own], pa.int64()), pa.array([code[a:b].tobytes() for a, b in own], pa.binary())], names=["span_doc", "codes"])


@common.lean
def _remove(batches: Iterator[pa.RecordBatch], text_at: int, counts: list[str], width: int) -> Iterator[pa.RecordBatch]:
    """The last column has the blobs of codes."""
    for whole in batches:
        for batch in K.pieces(whole, text_at):
            buf, offsets = K.text_bytes(batch.column(text_at))
            _, _, start, rows = sentences(buf, offsets)
            blobs = batch.column(batch.num_columns - 1).to_pylist()
            raw, texts, removed = buf.tobytes(), [], []
            for i, blob in enumerate(blobs):
                n = int(rows[i + 1] - rows[i])
                gone = np.zeros(n + 1, np.int64)
                for b in blob or ():
                    code = np.frombuffer(b, np.uint32).astype(np.int64)
                    at, size = code // width, code % width
                    own = at + size <= n
                    np.add.at(gone, at[own], 1)
                    np.add.at(gone, (at + size)[own], -1)
                gone = np.cumsum(gone)[:n] > 0
                removed.append(int(gone.sum()))
                lo, hi = int(offsets[i]), int(offsets[i + 1])
                if removed[-1]:
                    edges = np.append(start[rows[i] : rows[i + 1]], hi)
                    own = np.flatnonzero(~gone)
                    texts.append(b"".join([raw[lo : edges[0]], *(raw[edges[j] : edges[j + 1]] for j in own.tolist())]))
                else:
                    texts.append(raw[lo:hi])
            kept = pa.array([t.decode() for t in texts], pa.string())
            columns = [kept if i == text_at else c for i, c in enumerate(batch.columns[:-1])]
            names = batch.schema.names[:-1]
            if counts:
                columns += [pa.array(np.diff(rows), pa.int64()), pa.array(removed, pa.int64())]
                names = [*names, *counts]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def without_repeats(docs: DataFrame, counts: bool = False, least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents without sentences in repeated spans; with counts also n_sentences and n_removed."""
    spark = docs.sparkSession
    common.prepare(spark)
    folder = common.work_folder(spark)
    parts = common.groups(spark, common.text_bytes_of(docs))
    whole = docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long")
    document = F.coalesce(F.col("doc_id").cast("long") if whole else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")), F.lit(NULL_ID))
    found = docs.select(document.alias("document"), F.col("text").cast("string")).mapInArrow(partial(_spread, parts=parts, least_words=least_words), "part int, open boolean, h binary, doc binary, code binary")
    later = found.repartitionById(parts, F.col("part")).mapInArrow(_decide, "span_doc long, codes binary")
    own, codes = common.free(docs.columns, "span_doc"), common.free(docs.columns, "span_codes")
    later = common.stored(later.groupBy(F.col("span_doc").alias(own)).agg(F.collect_list("codes").alias(codes)), folder, "later")
    joined = docs.join(later.hint("merge"), document == F.col(own), "left").select(*[f"`{c}`" for c in docs.columns], codes)
    names = [common.free(docs.columns, c) for c in ("n_sentences", "n_removed")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + (", {} long, {} long".format(*names) if counts else "")
    return joined.mapInArrow(partial(_remove, text_at=docs.columns.index("text"), counts=names if counts else [], width=_width(least_words)), schema)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(common.documents(spark, sf_dir).select("doc_id", "text"), counts=True)
