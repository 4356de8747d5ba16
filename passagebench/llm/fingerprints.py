"""Document fingerprints by content-defined chunking.

A gear hash over the last 16 bytes decides where a chunk may end; as in normalised chunking a stricter mask holds up to the
normal size and a looser one beyond it, so sizes gather round it. Boundaries depend on the text nearby alone, hence an edit
changes the chunks round it and no others. A fingerprint is the sorted set of chunk digests, each with its chunk's length:
40 bits of digest and 8 of length, 12 hex digits. Shared length over own length measures containment; the likeness of two
fingerprints is the harmonic mean of both containments.

All texts of a batch are cut in step: one round finds the next boundary of every text that isn't at its end.

Defined cases: a null text is empty; an empty text has the empty fingerprint, which is like itself (1) and no other (0);
rows with equal doc_ids are ordered by the 64-bit hash of their text; a null doc_id comes first; ids that aren't whole numbers
are ordered as strings; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from . import common, kernels as K

WINDOW, LEAST, NORMAL, MOST = 16, 16, 32, 128
GEAR = np.random.default_rng(7).integers(0, 2**32, 256, dtype=np.uint32)
STRICT, LOOSE = np.uint32(0b111111 << 22), np.uint32(0b1111 << 22)
PIECE = 2 << 20


def gear(buf: np.ndarray) -> np.ndarray:
    """The gear hash of the WINDOW bytes up to each, by doubling."""
    h, k = GEAR[buf], 1
    while k < WINDOW:
        new = h.copy()
        new[k:] += h[:-k] << np.uint32(k)
        h, k = new, 2 * k
    return h


def boundaries(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of every chunk, by row and place."""
    h = gear(buf)
    loose = np.flatnonzero((h & LOOSE) == 0)
    strict = loose[(h[loose] & STRICT) == 0]
    far = np.array([len(buf) + MOST])
    strict, loose = np.append(strict, far), np.append(loose, far)
    rows, pos, end = np.arange(len(offsets) - 1), offsets[:-1], offsets[1:]
    live = pos < end
    rows, pos, end = rows[live], pos[live], end[live]
    found = []
    while len(rows):
        a = strict[np.searchsorted(strict, pos + LEAST - 1)] + 1
        b = loose[np.searchsorted(loose, pos + NORMAL - 1)] + 1
        cut = np.minimum(np.where(a < pos + NORMAL, a, np.minimum(b, pos + MOST)), end)
        found.append((rows, pos, cut))
        live = cut < end
        rows, pos, end = rows[live], cut[live], end[live]
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    rows, start, stop = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(start, kind="stable")
    return rows[order], start[order], stop[order]


def chunk_sets(texts: list[bytes]) -> list[np.ndarray]:
    """For each text its sorted distinct chunks as digest << 8 | length."""
    out: list[np.ndarray] = []
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + len(texts[end]) <= PIECE):
            size += len(texts[end])
            end += 1
        part = texts[begin:end]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in part])]).astype(np.int64)
        buf = np.frombuffer(b"".join(part), np.uint8)
        rows, start, stop = boundaries(buf, offsets) if len(buf) else (offsets[:0],) * 3
        chunks = (K.span_hashes(buf, start, stop, K.BYTE_VALUES) >> K.U(24) << K.U(8)) | (stop - start).astype(K.U)
        edges = np.searchsorted(rows, np.arange(len(part) + 1)).tolist()
        for a, b in zip(edges, edges[1:]):
            s = np.sort(chunks[a:b])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if b - a > 1 else s)
        begin = end
    return out


def fingerprint(chunks: np.ndarray) -> str:
    return chunks.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes().hex()


def parse(text: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(text), np.uint8).reshape(-1, 6)
    return np.pad(raw, ((0, 0), (2, 0))).reshape(-1).view(">u8").astype(K.U)


def shared_length(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    return int((a[K.isin_sorted(a, b)] & K.U(255)).sum()) if len(a) else 0


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The share of a's length whose chunks are in b; of an empty a, 1 if b is empty and else 0."""
    return shared_length(a, b) / int((a & K.U(255)).sum()) if len(a) else float(not len(b))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    total = int((a & K.U(255)).sum()) + int((b & K.U(255)).sum())
    return 2 * shared_length(a, b) / total if total else 1.0


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every text; narrow."""
    common.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = chunk_sets([(t or "").encode() for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(s) for s in sets], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


@common.lean
def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order, tails last: the first tail is what follows the partition's last own row."""
    held: tuple | None = None
    done = False
    for batch in batches:
        if done or not batch.num_rows:
            continue
        ids, texts, tails = (batch.column(i).to_pylist() for i in range(3))
        texts = [t or "" for t in texts]
        if any(tails):
            n = tails.index(True) + 1
            ids, texts, done = ids[:n], texts[:n], True
        own = chunk_sets([t.encode() for t in texts])
        if held:
            ids, texts, own = [held[0], *ids], [held[1], *texts], [held[2], *own]
        edited = []
        for this, following in zip(texts, texts[1:]):
            q = len(this) // 4
            edited.append((this[: len(this) - q] + following[:q]).encode())
        changed = chunk_sets(edited)
        held = ids[-1], texts[-1], own[-1]
        prints = [fingerprint(s) for s in own[:-1]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids[:-1], batch.schema.field(0).type), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
                pa.array(prints, pa.string()), pa.array([fingerprint(s) for s in changed], pa.string()),
                pa.array([likeness(a, b) for a, b in zip(own, changed)], pa.float64()), pa.array([likeness(a, b) for a, b in zip(own, own[1:])], pa.float64()),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )


def _placed(cuts: list[tuple], whole: bool) -> Callable[[Column, Column], Column]:
    """The range of (doc_id, hash) among those that begin at the cuts, which are (doc_id, hash) in order, null ids first."""
    nulls = sum(c[0] is None for c in cuts)
    null_hashes = np.array([h for _, h in cuts[:nulls]], np.int64)
    ids, hashes = np.array([i for i, _ in cuts[nulls:]], np.int64 if whole else object), np.array([h for _, h in cuts[nulls:]], np.int64)

    def place(doc: pd.Series, null: pd.Series, h: pd.Series) -> pd.Series:
        doc, null, h = doc.to_numpy(), null.to_numpy(bool), h.to_numpy(np.int64)
        low, high = np.searchsorted(ids, doc, "left"), np.searchsorted(ids, doc, "right")
        part = nulls + low - 1
        for cut in np.unique(low[(high > low) & ~null]).tolist():  # ids at which ranges begin
            own = (low == cut) & (high > low) & ~null
            to = int(high[own][0])
            part[own] = nulls + cut + np.searchsorted(hashes[cut:to], h[own], "right") - 1
        part[null] = np.searchsorted(null_hashes, h[null], "right") - 1
        return pd.Series(np.maximum(part, 0).astype(np.int32))

    return F.pandas_udf(place, "int")


def _whole(docs: DataFrame) -> bool:
    return docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long")


def with_following(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, tail) in runs of ascending (doc_id, hash of text), one to a partition, each ended by the row that
    follows it.

    The ranges are those that Spark finds for the keys alone; each begins at its first key, and one row with that key is sent to
    the range before too. So texts are shuffled once, a doc_id that many rows share is spread over several ranges, and there
    are as many ranges as the bytes of the texts make.
    """
    spark = docs.sparkSession
    type_ = docs.schema["doc_id"].dataType
    whole = _whole(docs)
    type_ = type_ if whole else StringType()
    texts = docs.select(F.col("doc_id").cast(type_).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    keys = common.stored(texts.select("doc_id", "h", F.octet_length("text").alias("size")), common.work_folder(spark), "keys")
    n = common.groups(spark, keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0], 64 << 20)
    low = F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "h"))
    ranges = keys.select("doc_id", "h").repartitionByRange(n, F.asc_nulls_first("doc_id"), "h").groupBy(F.spark_partition_id().alias("p")).agg(low.alias("low"))
    cuts = [(r["low"]["doc_id"], r["low"]["h"]) for r in ranges.orderBy("low").collect()]  # n rows at most
    if not cuts:
        return texts.select("doc_id", "text", F.lit(False).alias("tail"))
    schema = StructType([StructField("first_id", type_), StructField("first_h", LongType()), StructField("to", IntegerType())])
    firsts = spark.createDataFrame([(i, h, (k - 1) % len(cuts)) for k, (i, h) in enumerate(cuts)], schema)
    tails = texts.join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h"))).groupBy("to").agg(*[F.first(c).alias(c) for c in ("doc_id", "text", "h")])
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(0)) if whole else F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    own = texts.select("doc_id", "text", "h", F.lit(False).alias("tail"), _placed(cuts, whole)(id_, F.col("doc_id").isNull(), F.col("h")).alias("part"))
    rows = own.unionByName(tails.select("doc_id", "text", "h", F.lit(True).alias("tail"), F.col("to").alias("part")))
    return rows.repartitionById(len(cuts), F.col("part")).sortWithinPartitions("tail", F.asc_nulls_first("doc_id"), "h", "text").select("doc_id", "text", "tail")


def compare_edits(docs: DataFrame) -> DataFrame:
    common.prepare(docs.sparkSession, 500)
    kind = docs.schema["doc_id"].dataType.simpleString() if _whole(docs) else "string"
    return with_following(docs).mapInArrow(_edits, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edits(common.documents(spark, sf_dir))
