"""Benchmark decontamination with suffix arrays over the training text.

Arrow batches of documents are gathered into shards of about SHARD_BYTES of text. A shard's suffix array has every word position,
sorted by the words from there on to the depth of the window, at least (ranks of 1, 2, 4, ... words, each from two of the one
before; a suffix ends with its document). Every test suffix (the words from each position of a benchmark item on) is
binary-searched in it to the depth of the window; neighbouring matches on one diagonal join to the longest verbatim matches.
A test suffix with a word that the shard lacks needs no search. The step is narrow: no shuffle, and a lost task is simply run again.

The benchmark is written to the shared folder in blocks of bounded size. A task goes through the blocks once per shard, and
keeps the last few, so neither the benchmark's size nor the corpus's is limited by memory.

Defined cases: null and empty texts have no words and are clean; a null item_id counts as the item named "null" only in
`matches` and is left out of the digest; repeated items count once per item_id; extra columns pass through `decontaminate`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, kernels as K

BLOCK_WORDS, BLOCKS_KEPT = 1 << 18, 8
SHARD_BYTES = 8 << 20


class Tests:
    """One block of the benchmark: its words, and where in them each window begins, how long it is and whose it is."""

    def __init__(self, ids: list[str], texts: pa.Array, window: int):
        self.h, _, _, rows = K.words(*K.text_bytes(texts), K.NOT_ALNUM)
        n = np.diff(rows)
        depth, count = np.minimum(n, window), np.where(n > 0, np.maximum(n - window, 0) + 1, 0)
        self.item = np.repeat(np.arange(len(ids)), count)
        self.at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        self.depth = depth[self.item]
        self.start = rows[self.item] + self.at
        self.ids, self.window = ids, window


@lru_cache(maxsize=BLOCKS_KEPT)
def _load(path: str, block: int, window: int) -> Tests:
    t = pq.read_table(path, filters=[("block", "=", block)], partitioning=None) if "://" not in path or path.startswith("file://") else None
    if t is None:
        from pyarrow import fs

        where, inner = fs.FileSystem.from_uri(path)
        t = pq.read_table(inner, filesystem=where, filters=[("block", "=", block)], partitioning=None)
    return Tests(t["item_id"].to_pylist(), t["text"].combine_chunks() if t.num_rows else pa.array([], pa.string()), window)


class Shard:
    """Words of some documents as ranks, and their suffix array."""

    def __init__(self, texts: pa.Array, window: int):
        h, _, _, self.rows = K.words(*K.text_bytes(texts), K.NOT_ALNUM)
        self.vocabulary, rank, count = np.unique(h, return_inverse=True, return_counts=True)
        self.n, self.window = len(h), window
        self.ends = np.repeat(self.rows[1:], np.diff(self.rows))
        self.rank = np.append(rank + 1, [0] * (window + 1))  # 0: beyond the end
        order = (np.cumsum(count) - count)[rank]  # how many suffixes are less, to the depth so far
        alike, depth = count[rank] > 1, 1
        while depth < window and alike.any():
            own = np.flatnonzero(alike)  # only suffixes that aren't told apart yet are sorted again
            after = np.zeros(len(own), np.int64)
            inside = own + depth < self.ends[own]
            after[inside] = order[own[inside] + depth] + 1
            by = np.argsort(order[own] * (self.n + 1) + after)
            own, after, before = own[by], after[by], order[own[by]]
            old = np.concatenate([[True], before[1:] != before[:-1]])
            new = old | np.concatenate([[True], after[1:] != after[:-1]])
            index = np.arange(len(own))
            place = np.maximum.accumulate(np.where(new, index, 0))
            order[own] = before + place - np.maximum.accumulate(np.where(old, index, 0))
            alike[own] = (np.diff(np.append(np.flatnonzero(new), len(own))) > 1)[np.cumsum(new) - 1]
            depth *= 2
        own = np.flatnonzero(alike)  # alike to the whole depth: in any order
        own = own[np.argsort(order[own])]
        if len(own):
            new = np.concatenate([[True], order[own][1:] != order[own][:-1]])
            order[own] += np.arange(len(own)) - np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))
        self.array = np.empty(self.n, np.int64)
        self.array[order] = np.arange(self.n)

    def bound(self, tests: np.ndarray, depth: np.ndarray, right: bool) -> np.ndarray:
        """For rows of ranks, the first place in the array where a suffix isn't less, or with right is greater, to the depth."""
        lo, hi = np.zeros(len(tests), np.int64), np.full(len(tests), self.n, np.int64)
        columns = np.arange(self.window)
        used = columns < depth[:, None]
        for _ in range(self.n.bit_length() + 1):
            mid = (lo + hi) >> 1
            at = self.array[np.minimum(mid, self.n - 1)]
            place = at[:, None] + columns
            suffix = np.where(place < self.ends[at][:, None], self.rank[place], 0)
            differs = (suffix != tests) & used
            first = differs.argmax(1)
            row = np.arange(len(tests))
            c = np.where(~differs.any(1), 0, np.sign(suffix[row, first] - tests[row, first]))
            up = ((c <= 0) if right else (c < 0)) & (lo < hi)
            down = ~up & (lo < hi)
            lo, hi = np.where(up, mid + 1, lo), np.where(down, mid, hi)
        return lo

    def search(self, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
        """All places (word position in the shard, test suffix) where a test suffix occurs."""
        if not self.n or not len(tests.depth):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, tests.h), len(self.vocabulary) - 1)
        missing = self.vocabulary[at] != tests.h
        lacks = np.concatenate([[0], np.cumsum(missing)])
        live = np.flatnonzero(lacks[tests.start + tests.depth] == lacks[tests.start])
        rank = np.append(at + 1, [0] * self.window)
        found = [(np.zeros(0, np.int64),) * 2]
        for k in range(0, len(live), 1 << 16):
            some = live[k : k + (1 << 16)]
            words = rank[tests.start[some][:, None] + np.arange(self.window)]
            lo, hi = (self.bound(words, tests.depth[some], right) for right in (False, True))
            n = np.maximum(hi - lo, 0)
            found.append((self.array[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)], np.repeat(some, n)))
        a, b = zip(*found)
        return np.concatenate(a), np.concatenate(b)


def _shards(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.column(text_at).nbytes
        if size >= SHARD_BYTES:
            yield joined()
            held, size = [], 0
    if held:
        yield joined()


def _scan(texts: pa.Array, path: str, blocks: int, window: int) -> tuple[Shard, Iterator[tuple[np.ndarray, np.ndarray, Tests]]]:
    shard = Shard(texts, window)
    return shard, ((*shard.search(tests), tests) for tests in (_load(path, b, window) for b in range(blocks)))


def runs(rows: np.ndarray, at: np.ndarray, which: np.ndarray, tests: Tests) -> tuple[np.ndarray, ...]:
    """Neighbouring matches on one diagonal joined: row, item, first word in the shard and in the item, number of words."""
    row = np.searchsorted(rows, at, "right") - 1
    item, pos, depth = tests.item[which], tests.at[which], tests.depth[which]
    order = np.lexsort((at, at - pos, item, row))
    row, item, at, pos, depth = row[order], item[order], at[order], pos[order], depth[order]
    new = np.ones(len(at), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (at[1:] != at[:-1] + 1) | (pos[1:] != pos[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1 if len(first) else first
    return row[first], item[first], at[first], pos[first], at[last] - at[first] + depth[first]


@common.lean
def _summary(batches: Iterator[pa.RecordBatch], path: str, blocks: int, window: int) -> Iterator[pa.RecordBatch]:
    for batch in _shards(batches, 1):
        items = [set() for _ in range(batch.num_rows)]
        shard, found = _scan(batch.column(1), path, blocks, window)
        edge, rows = np.zeros(shard.n + 1, np.int64), shard.rows
        longest = np.zeros(batch.num_rows, np.int64)
        for at, which, tests in found:
            np.add.at(edge, at, 1)
            np.add.at(edge, at + tests.depth[which], -1)
            row, item, _, _, length = runs(rows, at, which, tests)
            np.maximum.at(longest, row, length)
            for r, i in set(zip(row.tolist(), item.tolist())):
                if tests.ids[i] is not None:
                    items[r].add(tests.ids[i])
        covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
        n_hit = covered[rows[1:]] - covered[rows[:-1]]
        names = [",".join(sorted(x)) for x in items]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array(np.diff(rows), pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in names]), pa.array(n_hit > 0), pa.array(longest), pa.array(names),
            ],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "items"],
        )


@common.lean
def _matches(batches: Iterator[pa.RecordBatch], path: str, blocks: int, window: int) -> Iterator[pa.RecordBatch]:
    for batch in _shards(batches, 1):
        shard, found = _scan(batch.column(1), path, blocks, window)
        for at, which, tests in found:
            row, item, first, pos, length = runs(shard.rows, at, which, tests)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row)), pa.array([str(tests.ids[i]) if tests.ids[i] is not None else "null" for i in item], pa.string()),
                    pa.array(first - shard.rows[row], pa.int64()), pa.array(pos, pa.int64()), pa.array(length, pa.int64()),
                ],
                names=["doc_id", "item_id", "doc_word", "item_word", "n_words"],
            )


@common.lean
def _clean(batches: Iterator[pa.RecordBatch], path: str, blocks: int, window: int, text_at: int) -> Iterator[pa.RecordBatch]:
    for batch in _shards(batches, text_at):
        keep = np.ones(batch.num_rows, bool)
        shard, found = _scan(batch.column(text_at), path, blocks, window)
        for at, _, _ in found:
            keep[np.searchsorted(shard.rows, at, "right") - 1] = False
        yield batch.filter(pa.array(keep))


def _store_tests(benchmark: DataFrame) -> tuple[str, int]:
    """Write the items with a block number each; a block has about BLOCK_WORDS words at most, or one item."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    chars = items.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    blocks = max(1, -(-chars // (4 * BLOCK_WORDS))) if chars else 0
    path = f"{common.work_folder(spark)}/tests"
    items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, blocks))).cast("int")).coalesce(max(1, blocks)).write.parquet(path)
    return path, blocks


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match (words), items (comma-joined)."""
    common.prepare(docs.sparkSession)
    path, blocks = _store_tests(benchmark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        partial(_summary, path=path, blocks=blocks, window=window),
        f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, items string",
    )


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The longest verbatim matches with their places: doc_id, item_id, doc_word, item_word, n_words."""
    common.prepare(docs.sparkSession)
    path, blocks = _store_tests(benchmark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        partial(_matches, path=path, blocks=blocks, window=window), f"doc_id {kind}, item_id string, doc_word long, item_word long, n_words long"
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents, with all their columns, in which no window of the benchmark occurs."""
    common.prepare(docs.sparkSession)
    path, blocks = _store_tests(benchmark)
    return docs.mapInArrow(partial(_clean, path=path, blocks=blocks, window=window, text_at=docs.columns.index("text")), docs.schema)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("items")


OP10_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, i AS j, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, lengths WHERE len(w) >= n)
), hits AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id, bw.j FROM dw JOIN bw ON dw.n = bw.n AND dw.gram = bw.gram),
runs AS (SELECT doc_id, max(len) AS longest FROM (SELECT doc_id, count(*) + any_value(n) - 1 AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS run FROM hits) GROUP BY doc_id, item_id, i - j, run) GROUP BY doc_id),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest_match
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN runs USING (doc_id) LEFT JOIN its USING (doc_id)
"""
