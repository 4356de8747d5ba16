"""Reversible line deduplication: exact reference counts of line keys, and sharded cuckoo filters over the repeated ones.

The table of reference counts holds, for each line key (128-bit hash), in how many documents it is. Inserting documents adds
to it and deleting them subtracts, so any batch can be taken back. Keys at or above the threshold are also in cuckoo filters,
one per shard of the key space; keys that cross the threshold are inserted into or deleted from their shard's filter, and a
shard whose filter is full is rebuilt from the exact table. Applying the index to documents probes the filters first: a line
that no filter holds stays without any lookup; the others are looked up in the exact table, so no false positive drops a line.

Per-document distinct keys are counted per batch before the shuffle, so a line in a third of all documents is few rows.
While the exact table of repeated keys is within common.BROADCAST_BYTES, every task reads it and the filters, and nothing is
shuffled. Beyond that, lines travel to their shard: a task reads one shard's filter and exact keys at a time and streams that
shard's lines past them. Keys that more than one in so many of all lines has are kept out of that: there can't be more of
them than the table within the bound holds, so tasks drop them on the spot, and no shard has a hot line.

Defined cases: a null or empty text is one empty line, which is never dropped; a document counts once for a key however often
it has the line; every row is a document, so repeated rows count as often as they occur; deleting rows that weren't inserted
leaves negative counts, which later insertions make good; extra columns, whatever their names, pass through `apply`.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, kernels as K

VALUES = [np.random.default_rng(s).integers(1, 2**64, 256, dtype=K.U) for s in (101, 202)]
for _v in VALUES:
    _v[65:91] = _v[97:123]
SHARD_KEYS = 50_000
#: Lines, by their bytes in the shuffle, that one stream of a shard is meant to have.
LANE_BYTES = 256 << 20


def lines(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every line, and the n + 1 positions in these where each row begins. Every row has a line."""
    breaks = np.flatnonzero(buf == 10)
    # a row's lines begin at its own start and after each of its line breaks
    row_of = np.searchsorted(offsets, breaks, "right") - 1
    start = np.concatenate([offsets[:-1], breaks + 1])
    row = np.concatenate([np.arange(len(offsets) - 1), row_of])
    order = np.lexsort((start, row))
    start, row = start[order], row[order]
    rows = np.searchsorted(row, np.arange(len(offsets)))
    end = np.append(start[1:] - 1, 0)
    end[rows[1:] - 1] = offsets[1:]
    return start, end, rows


def line_keys(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both halves of each line's key, and whether it has any code point."""
    solid = np.append(np.flatnonzero(~K.SPACE[buf]), len(buf))
    s = solid[np.searchsorted(solid, start)]
    some = s < end
    e = np.where(some, solid[np.maximum(np.searchsorted(solid, end) - 1, 0)] + 1, s)
    h = np.zeros((2, len(start)), K.U)
    for i in (0, 1):
        h[i, some] = K.span_hashes(buf, s[some], e[some], VALUES[i])
    return h[0], h[1], some


class CuckooFilter:
    """16-bit marks in buckets of four; a key's second bucket is its first one XOR the hash of its mark."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        return cls(np.zeros((1 << max(1, (int(keys / 3.2)).bit_length()), 4), np.uint16))

    @classmethod
    def load(cls, blob: bytes) -> CuckooFilter:
        return cls(np.frombuffer(blob, np.uint16).reshape(-1, 4).copy())

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m = K.U(len(self.table) - 1)
        mark = (h >> K.U(48)).astype(np.uint16)
        mark[mark == 0] = 1
        one = h & m
        return mark, one.astype(np.int64), (one ^ (K.mix(mark.astype(K.U)) & m)).astype(np.int64)

    def holds(self, h: np.ndarray) -> np.ndarray:
        mark, one, two = self.places(h)
        return ((self.table[one] == mark[:, None]) | (self.table[two] == mark[:, None])).any(1)

    def insert(self, h: np.ndarray) -> bool:
        """False if a key found no place; the filter must then be rebuilt larger."""
        table, m = self.table, len(self.table) - 1
        for mark, one, two in zip(*(x.tolist() for x in self.places(h))):
            at = one
            for turn in range(500):
                for b in (at, two) if not turn else (at,):
                    free = np.flatnonzero(table[b] == 0)
                    if len(free):
                        table[b, free[0]] = mark
                        break
                else:
                    slot = turn & 3
                    mark, table[at, slot] = int(table[at, slot]), mark
                    at ^= int(K.mix(np.array([mark], K.U))[0]) & m
                    continue
                break
            else:
                return False
        return True

    def delete(self, h: np.ndarray) -> None:
        """Only keys that were inserted may be deleted."""
        for mark, one, two in zip(*(x.tolist() for x in self.places(h))):
            for b in (one, two):
                at = np.flatnonzero(self.table[b] == mark)
                if len(at):
                    self.table[b, at[0]] = 0
                    break


@common.lean
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in K.pieces(whole, 0):
            buf, offsets = K.text_bytes(batch.column(0))
            start, end, rows = lines(buf, offsets)
            a, b, some = line_keys(buf, start, end)
            row = np.repeat(np.arange(batch.num_rows), np.diff(rows))
            a, b, row = a[some], b[some], row[some]
            order = np.lexsort((row, b, a))
            a, b, row = a[order], b[order], row[order]
            if not len(a):
                continue
            key = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            own = key | np.concatenate([[True], row[1:] != row[:-1]])
            at = np.flatnonzero(key)
            n = np.add.reduceat(own.astype(np.int64), at)
            yield pa.RecordBatch.from_arrays([pa.array(a[at].view(np.int64)), pa.array(b[at].view(np.int64)), pa.array(n)], names=["a", "b", "n"])


def counts(docs: DataFrame) -> DataFrame:
    """a, b, n: each line key and the number of documents that have it."""
    common.prepare(docs.sparkSession)
    return docs.select(F.col("text").cast("string")).mapInArrow(_count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _keys(table: pa.Table) -> np.ndarray:
    return table["a"].to_numpy().view(K.U)


def _build(key, table: pa.Table) -> pa.Table:
    h, size = _keys(table), table.num_rows
    while True:
        f = CuckooFilter.sized(size)
        if f.insert(h):
            break
        size *= 2
    return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([f.table.tobytes()], pa.binary())], names=["shard", "filter"])


@common.lean
def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys as blobs of one key each, beside their first half, by which they are sharded."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x.tobytes() for x in batch.column(i).to_numpy()], pa.binary()) for i in (0, 1))], names=["a", "x", "y"])


def _revise(key, old: pa.Table, changes: pa.Table) -> pa.Table:
    """A shard's filter after its keys' crossings; null where it is full."""
    shard = key[0].as_py()
    f = CuckooFilter.load(old["filter"][0].as_py()) if old.num_rows else CuckooFilter.sized(changes.num_rows)
    up = changes["up"].to_numpy(zero_copy_only=False) if changes.num_rows else np.zeros(0, bool)
    h = _keys(changes) if changes.num_rows else np.zeros(0, K.U)
    f.delete(h[~up])
    blob = f.table.tobytes() if f.insert(h[up]) else None
    return pa.table([pa.array([shard], pa.int64()), pa.array([blob], pa.binary())], names=["shard", "filter"])


@lru_cache(maxsize=2)
def _load_filters(path: str, shards: int) -> dict[int, CuckooFilter]:
    t = pq.read_table(path, columns=["shard", "filter"], partitioning=None)
    return {s: CuckooFilter.load(f) for s, f in zip(t["shard"].to_pylist(), t["filter"].to_pylist())}


@lru_cache(maxsize=2)
def _load_keys(path: str) -> np.ndarray:
    t = pq.read_table(path, columns=["a", "b"], partitioning=None)
    return np.unique(np.rec.fromarrays([t["a"].to_numpy(), t["b"].to_numpy()]))


def _among(a: np.ndarray, b: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(keys) or not len(a):
        return np.zeros(len(a), bool)
    return np.isin(np.rec.fromarrays([a.view(np.int64), b.view(np.int64)]), keys)


def _suspects(a: np.ndarray, some: np.ndarray, filters: dict[int, CuckooFilter], shards: int) -> np.ndarray:
    """Indices of the lines that a filter holds."""
    at = np.flatnonzero(some)
    shard = (a[at] % K.U(shards)).astype(np.int64)
    keep = np.zeros(len(at), bool)
    for s in np.unique(shard).tolist():
        if s in filters:
            own = np.flatnonzero(shard == s)
            keep[own] = filters[s].holds(a[at[own]])
    return at[keep]


def _rejoined(buf: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray, rows: np.ndarray, gone: np.ndarray) -> list[bytes]:
    raw, out = memoryview(buf.tobytes()), []
    lost = np.add.reduceat(gone.astype(np.int64), rows[:-1]) if len(rows) > 1 else []
    for i, (x, y) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        if lost[i]:
            keep = np.flatnonzero(~gone[rows[i] : rows[i + 1]]) + rows[i]
            out.append(b"\n".join(bytes(raw[s:e]) for s, e in zip(start[keep].tolist(), end[keep].tolist())))
        else:
            out.append(bytes(raw[x:y]))
    return out


def _result(batch: pa.RecordBatch, text_at: int, gone_of, digest: bool) -> pa.RecordBatch:
    buf, offsets = K.text_bytes(batch.column(text_at))
    start, end, rows = lines(buf, offsets)
    gone = gone_of(buf, start, end, rows)
    n = np.diff(rows)
    lost = np.add.reduceat(gone.astype(np.int64), rows[:-1]) if batch.num_rows else n
    texts = _rejoined(buf, offsets, start, end, rows, gone)
    if digest:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])
    kept = pa.array([t.decode() for t in texts], pa.string())
    columns = [kept if i == text_at else c for i, c in enumerate(batch.columns)]
    return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


@common.lean
def _apply_here(batches: Iterator[pa.RecordBatch], filters: str, repeated: str, shards: int, text_at: int, digest: bool) -> Iterator[pa.RecordBatch]:
    table, exact = _load_filters(filters, shards), _load_keys(repeated)

    def gone_of(buf, start, end, rows):
        a, b, some = line_keys(buf, start, end)
        at = _suspects(a, some, table, shards)
        gone = np.zeros(len(start), bool)
        gone[at[_among(a[at], b[at], exact)]] = True
        return gone

    for whole in batches:
        for batch in K.pieces(whole, text_at):
            yield _result(batch, text_at, gone_of, digest)


@common.lean
def _send(batches: Iterator[pa.RecordBatch], heavy: str, shards: int, lanes: int) -> Iterator[pa.RecordBatch]:
    """Rows (key of the row, text) to blobs of lines by shard: halves of the line's key, row key, number of the line."""
    hot = _load_keys(heavy)
    for whole in batches:
        for batch in K.pieces(whole, 1):
            buf, offsets = K.text_bytes(batch.column(1))
            start, end, rows = lines(buf, offsets)
            a, b, some = line_keys(buf, start, end)
            at = np.flatnonzero(some)
            at = at[~_among(a[at], b[at], hot)]
            row = np.searchsorted(rows, at, "right") - 1
            names = np.frombuffer(b"".join(batch.column(0).to_pylist()), "V16")
            shard = (a[at] % K.U(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            at, row, shard = at[order], row[order], shard[order]
            cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(at) else []
            out = list(zip(cuts[:-1], cuts[1:]))
            lane = (int(names[0].tobytes()[0]) if len(names) else 0) % lanes
            blobs = [[x[i:j].tobytes() for i, j in out] for x in (a[at], b[at], names[row], (at - rows[row]).astype(np.uint32))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(shard[i]) for i, _ in out], pa.int64()), pa.array([lane] * len(out), pa.int32()), pa.array([2] * len(out), pa.int32()), *(pa.array(x, pa.binary()) for x in blobs)],
                names=["shard", "lane", "kind", "x", "y", "owner", "line"],
            )


@common.lean
def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by shard: its filter (kind 0), its exact keys (1), then lines (2). Out come the lines to drop."""
    now, table, keys, exact = None, None, [], None
    for batch in batches:
        found: list[tuple[bytes, np.ndarray]] = []
        for shard, kind, x, y, owner, line in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6))):
            if shard != now:
                now, table, keys, exact = shard, None, [], None
            if kind == 0:
                table = CuckooFilter.load(x)
            elif kind == 1:
                keys.append((x, y))
            elif table is not None:
                if exact is None:
                    exact = np.unique(np.rec.fromarrays([np.frombuffer(b"".join(k[i] for k in keys), np.int64) for i in (0, 1)]))
                a, b = np.frombuffer(x, K.U), np.frombuffer(y, K.U)
                at = np.flatnonzero(table.holds(a))
                at = at[_among(a[at], b[at], exact)]
                own, number = np.frombuffer(owner, "V16"), np.frombuffer(line, np.uint32)
                found += [(own[i].tobytes(), int(number[i])) for i in at.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())], names=["owner", "line"])


@common.lean
def _apply_lists(batches: Iterator[pa.RecordBatch], heavy: str, text_at: int, digest: bool) -> Iterator[pa.RecordBatch]:
    """The last column lists the lines to drop, besides those whose keys many lines have."""
    hot = _load_keys(heavy)
    for batch in batches:
        dropped = batch.column(batch.num_columns - 1).to_pylist()

        def gone_of(buf, start, end, rows):
            a, b, some = line_keys(buf, start, end)
            gone = some & _among(a, b, hot)
            for r, drop in enumerate(dropped):
                gone[[rows[r] + x for x in drop or ()]] = True
            return gone

        yield _result(pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]), text_at, gone_of, digest)


class LineIndex:
    """Reference counts and filters of a corpus in the shared folder, by version."""

    def __init__(self, spark: SparkSession, least: int = 10):
        common.prepare(spark)
        self.spark, self.least, self.folder, self.version = spark, least, common.work_folder(spark), 0
        self.shards = 1
        empty = spark.createDataFrame([], "a long, b long, n long")
        self._write(empty, None)

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}-{self.version}"

    def _write(self, table: DataFrame, filters: DataFrame | None) -> None:
        table.write.parquet(self._path("counts"))
        self.counts = self.spark.read.schema("a long, b long, n long").parquet(self._path("counts"))
        self.counts.where(F.col("n") >= self.least).select("a", "b").write.parquet(self._path("repeated"))
        self.repeated = self.spark.read.schema("a long, b long").parquet(self._path("repeated"))
        self.n_repeated = self.repeated.count()
        if filters is None or self.n_repeated > 4 * SHARD_KEYS * self.shards:
            self.shards = max(1, -(-self.n_repeated // SHARD_KEYS))
            filters = self._sharded(self.repeated).groupBy("shard").applyInArrow(common.grouped(_build), "shard long, filter binary")
        filters.write.parquet(self._path("filters"))
        self.filters = self.spark.read.schema("shard long, filter binary").parquet(self._path("filters"))

    def _sharded(self, keys: DataFrame) -> DataFrame:
        # the remainder of the key's first half as an unsigned number
        s = self.shards
        return keys.withColumn("shard", F.pmod(F.pmod("a", F.lit(s)) + F.when(F.col("a") < 0, F.lit(2**64 % s)).otherwise(F.lit(0)), F.lit(s)).cast("long"))

    def _update(self, docs: DataFrame, sign: int) -> None:
        delta = counts(docs).select("a", "b", (F.col("n") * sign).alias("n"))
        if not self.version and sign > 0:
            self.version = 1
            self._write(delta, None)
            return
        old_counts, old_filters = self.counts, self.filters
        change = self._stored_changes(old_counts, delta)
        total = old_counts.select("a", "b", "n").union(delta).groupBy("a", "b").agg(F.sum("n").alias("n")).where("n <> 0")
        crossed = self._sharded(change.select("a", "b", "up"))
        revised = old_filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInArrow(common.cogrouped(_revise), "shard long, filter binary")
        self.version += 1
        revised = common.stored(revised, self.folder, f"revised-{self.version}")
        full = revised.where("filter IS NULL").select("shard")
        keys = self._sharded(total.where(F.col("n") >= self.least).select("a", "b")).join(full, "shard", "left_semi")
        rebuilt = keys.groupBy("shard").applyInArrow(common.grouped(_build), "shard long, filter binary")
        self._write(total, revised.where("filter IS NOT NULL").union(rebuilt))

    def _stored_changes(self, old: DataFrame, delta: DataFrame) -> DataFrame:
        """The keys that cross the threshold."""
        both = delta.withColumnRenamed("n", "d").join(old, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("was"), "d")
        up, was = F.col("was") + F.col("d") >= self.least, F.col("was") >= self.least
        return both.where(up != was).select("a", "b", up.alias("up"))

    def insert(self, docs: DataFrame) -> LineIndex:
        self._update(docs, 1)
        return self

    def delete(self, docs: DataFrame) -> LineIndex:
        self._update(docs, -1)
        return self

    def apply(self, docs: DataFrame, digest: bool = False, bound: int | None = None) -> DataFrame:
        """The documents without their repeated lines, or for digest doc_id, n_lines, n_dropped and kept_sha256.

        bound: bytes of keys that a task may hold.
        """
        bound = common.BROADCAST_BYTES if bound is None else bound
        if digest:
            docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
            schema: object = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_lines long, n_dropped long, kept_sha256 string"
        else:
            schema = docs.schema
        text_at = docs.columns.index("text")
        if 16 * self.n_repeated <= bound:
            return docs.mapInArrow(partial(_apply_here, filters=self._path("filters"), repeated=self._path("repeated"), shards=self.shards, text_at=text_at, digest=digest), schema)
        return self._routed(docs, bound // 16, text_at, digest, schema)

    def _routed(self, docs: DataFrame, most: int, text_at: int, digest: bool, schema: object) -> DataFrame:
        total = self.counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        name = f"heavy-{self.version}-{most}-{uuid.uuid4().hex[:8]}"
        # more than total / most lines each: fewer than `most` keys
        common.stored(self.counts.where((F.col("n") >= self.least) & (F.col("n") * F.lit(most) > F.lit(total))).select("a", "b"), self.folder, name)
        heavy = f"{self.folder}/{name}"
        # 36 bytes a line; each lane of a shard is one stream of lines and has its own copy of filter and keys
        lanes = min(256, max(1, -(-36 * total // (self.shards * LANE_BYTES))))
        columns = "shard long, lane int, kind int, x binary, y binary, owner binary, line binary"
        every = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane")
        none = [F.lit(None).cast("binary").alias(c) for c in ("owner", "line")]
        filters = self.filters.select("shard", every, F.lit(0).alias("kind"), F.col("filter").alias("x"), F.lit(None).cast("binary").alias("y"), *none)
        exact = self._sharded(self.repeated.mapInArrow(_blobs, "a long, x binary, y binary")).select("shard", every, F.lit(1).alias("kind"), "x", "y", *none)
        # rows are known by doc_id and text here; both copies of a repeated row get the same list
        key, drop = common.free(docs.columns, "row_key"), common.free(docs.columns, "dropped_lines")
        keyed = docs.withColumn(key, F.unhex(F.md5(F.concat_ws("\x00", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce(F.col("text").cast("string"), F.lit(""))))))
        sent = keyed.select(F.col(key).alias("owner"), F.col("text").cast("string")).mapInArrow(partial(_send, heavy=heavy, shards=self.shards, lanes=lanes), columns)
        n = max(common.shards(self.spark), min(self.shards * lanes, 100_000))
        streams = filters.union(exact).union(sent).repartition(n, "shard", "lane").sortWithinPartitions("shard", "lane", "kind")
        found = streams.mapInArrow(_probe, "owner binary, line long")
        drops = found.groupBy(F.col("owner").alias(f"{key}_of")).agg(F.collect_set("line").alias(drop))
        joined = keyed.join(drops, F.col(key) == F.col(f"{key}_of"), "left").select(*[f"`{c}`" for c in docs.columns], drop)
        return joined.mapInArrow(partial(_apply_lists, heavy=heavy, text_at=text_at, digest=digest), schema)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return LineIndex(spark, 10).insert(docs).apply(docs, digest=True)


OP4_SQL = """
WITH l AS (
  SELECT doc_id, i, line, translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), r AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(r.k) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE r.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN r ON l.k = r.k GROUP BY doc_id
"""
