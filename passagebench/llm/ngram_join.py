"""Exact Jaccard self-join of word-shingle sets with signature trees.

1. profile   One narrow scan: each document's set size and set key, and how often shingles occur within a task.
2. classes   Documents with equal sets are one class (partial aggregation; a hot group of copies is one row from then on).
3. order     A total order of shingles, from rare to common. How common a shingle is comes from a table of LEVELS bytes, each the
             logarithm of the greatest count of all shingles that share it; ties go by hash. It only makes the join faster.
4. crowds    Near copies of one text, thousands of which all share the same rare shingles, would make all their pairs in every token
             range. A shingle that is among the SKETCH least of CROWD classes names a leader, the class with the most copies; classes
             like a leader are its crowd. Pairs inside a crowd are counted by matrix products over a grid of its sets, and make no
             candidates. Which classes are in a crowd decides how a pair is counted, and not whether it is.
5. postings  One narrow scan: two linked sets share one of the first n - ceil(0.7 n) + 1 shingles in that order. Each class sends
             these with their places, as sorted binary blobs, one per token range; there are as many ranges as the bytes make.
6. trees     A token range's postings form a signature tree, sorted by token and size. Nodes have the OR of their tokens' bits
             (coarser from level to level), a size range, and the most shingles that any of their postings has left from its
             place on. The tree is descended against itself from the root: node pairs whose maximum possible overlap is too small
             for any of their sizes are dropped with all below. The overlap of a pair is counted from the first shingle that
             both share, so it is at most what either has left there. What arrives at the leaves are the candidate pairs.
7. bitmaps   Candidates are spread over a grid of class blocks, sized by the bytes of the bitmaps of whole sets; a second descent
             bounds the overlap of nodes and pairs by these.
8. verify    The sets of the classes that are left are made again from their texts, sent to a grid sized by their bytes and
             intersected exactly.
9. degrees and components  Cells emit link counts per class and a spanning forest, never all pairs of documents.

Token hashes and class names have 64 bits, 48 when two sets are intersected. Bitmaps and bounds only drop pairs that can't be
linked, and no list, candidate set or number of rounds is cut off.

Defined cases: null and empty texts have the empty set, no link, and their own doc_id as component; a text of one or two
words has its whole sequence as the one member; repeated rows are copies of one another and link; null doc_ids are ignored
when the smallest doc_id is taken; extra columns are not read.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, kernels as K

#: A shingle counts as common from so many documents on, counted over tasks in which it occurs at least twice.
FREQUENT, LEVELS = 16, 1 << 20
FLUSH, PAIRS = 400_000, 2_000_000
#: Bytes of sets that a block of the verification's grid holds; a cell has two blocks.
CELL_BYTES = 8 << 20
FANOUT = 8
#: Edges of the link forest that one task may hold (16 bytes each); beyond it components are found by distributed rounds.
FOREST_EDGES = 2_000_000
#: In these rounds, nodes with more edges than this take their least neighbour from a table sent to all tasks; there can be
#: at most 1 / HUB as many of them as edges.
HUB = 1_000_000
#: A shingle that is among the SKETCH least of CROWD classes names a leader. Sets whose SKETCH least meet a leader's, and that are
#: alike to AROUND percent, are in its crowd. Leaders' sets go to all tasks, those of the largest crowds up to so many bytes.
CROWD, SKETCH, AROUND = 128, 8, 40
LEADER_BYTES, MOST_LEADERS = 8 << 20, 60_000
#: Sets on one side of a cell of a crowd's grid.
BLOCK_SETS = 2048


def set_keys(sets: list[np.ndarray]) -> list[int]:
    """Each set's 64-bit name: 24 bits of its least token, so that like sets lie together, and 40 of all its tokens. Empty: 0."""
    n = np.array([len(s) for s in sets], np.int64)
    out = np.zeros(len(sets), K.U)
    some = np.flatnonzero(n)
    if len(some):
        at = (np.cumsum(n) - n)[some]
        with np.errstate(over="ignore"):
            x = K.mix(np.concatenate(sets) ^ K.U(0xA24BAED4963EE407))
            total = np.add.reduceat(x, at) + n[some].astype(K.U)
            name = K.mix(total * K.U(0xD6E8FEB86659FD93) + np.bitwise_xor.reduceat(K.mix(x + K.U(0x9FB21C651E98DF25)), at))
            out[some] = name >> K.U(24) | K.mix(np.minimum.reduceat(x, at)) >> K.U(40) << K.U(40)
    return out.view(np.int64).tolist()


def bitmap_bits(n: int) -> int:
    """A power of two of at least n bits, 64 at least."""
    return max(64, 1 << (n - 1).bit_length()) if n else 64


def bitmap(s: np.ndarray) -> bytes:
    bits = np.zeros(bitmap_bits(len(s)), bool)
    bits[(K.mix(s) & K.U(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _sets(text: pa.Array) -> list[np.ndarray]:
    h, _, _, rows = K.words(*K.text_bytes(text), K.SPACE)
    return K.shingle_sets(h, rows)


@common.lean
def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["kind", "doc_id", "n", "key", "bits", "sketch"]
    tokens, counts, held = np.zeros(0, K.U), np.zeros(0, np.int64), []
    id_type = pa.int64()

    def merge(least: int) -> None:
        nonlocal tokens, counts
        both = np.concatenate([tokens, *(t for t, _ in held)])
        number = np.concatenate([counts, *(c for _, c in held)])
        held.clear()
        tokens, at = np.unique(both, return_inverse=True)
        counts = np.bincount(at, number, len(tokens)).astype(np.int64)
        keep = counts >= least
        tokens, counts = tokens[keep], counts[keep]

    for whole in batches:
        id_type = whole.column(0).type
        for batch in K.pieces(whole, 1):
            sets = _sets(batch.column(1))
            n = pa.array([len(s) for s in sets], pa.int64())
            keys = pa.array(set_keys(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(sets), pa.int32()), batch.column(0), n, keys, pa.array([bitmap(s) for s in sets], pa.binary()), pa.array([s[:SKETCH].tobytes() for s in sets], pa.binary())], names=names)
            if sets:
                t, c = np.unique(np.concatenate(sets), return_counts=True)
                held.append((t, c))
            if sum(len(t) for t, _ in held) > FLUSH * 4:
                merge(1 if len(tokens) < FLUSH * 4 else 2)
    merge(2)
    for k in range(0, len(tokens), 100_000):
        t, c = tokens[k : k + 100_000], counts[k : k + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array([1] * len(t), pa.int32()), pa.nulls(len(t), id_type), pa.array(c), pa.array(t.view(np.int64)), pa.nulls(len(t), pa.binary()), pa.nulls(len(t), pa.binary())], names=names)


def prefixes(sets: list[np.ndarray], levels: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first tokens of each set in the order, by level of commonness and then by hash; the set of each, and its place."""
    n = np.array([len(s) for s in sets], np.int64)
    h = K.mix(np.concatenate([np.zeros(0, K.U), *sets]))
    own = np.repeat(np.arange(len(sets)), n)
    order = np.lexsort((h, levels[(h & K.U(len(levels) - 1)).astype(np.int64)], own))
    place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    keep = place < np.repeat(n + (-percent * n // 100) + 1, n)
    return h[order[keep]], own[keep], place[keep]


class Leaders:
    """The sets that crowds are around, by the upper 48 bits of their tokens; those of the largest crowds first."""

    def __init__(self, blobs: list[bytes]):
        self.sets = [unpacked(x) >> K.U(16) for x in blobs]
        token = np.concatenate([np.zeros(0, K.U), *(s[:SKETCH] for s in self.sets)])
        of = np.repeat(np.arange(len(self.sets)), [min(len(s), SKETCH) for s in self.sets])
        order = np.argsort(token, kind="stable")
        self.token, self.of = token[order], of[order]

    def crowds(self, sets: list[np.ndarray]) -> np.ndarray:
        """For each set the number, from 1 on, of the first leader that it is like; 0 if there is none."""
        out = np.zeros(len(sets), np.uint16)
        if not self.sets or not sets:
            return out
        own = np.repeat(np.arange(len(sets)), [min(len(s), SKETCH) for s in sets])
        least = np.concatenate([s[:SKETCH] for s in sets]) >> K.U(16)
        for i in np.unique(own[K.isin_sorted(least, self.token)]).tolist():
            s = sets[i] >> K.U(16)
            low, high = np.searchsorted(self.token, s[:SKETCH]), np.searchsorted(self.token, s[:SKETCH], "right")
            for k in np.unique(np.concatenate([self.of[a:b] for a, b in zip(low, high)])).tolist():
                small, large = sorted((s, self.sets[k]), key=len)
                if 100 * len(small) >= AROUND * len(large) and np.count_nonzero(K.isin_sorted(small, large)) >= _least(len(small), len(large), AROUND):
                    out[i] = k + 1
                    break
        return out


@common.lean
def _postings(batches: Iterator[pa.RecordBatch], parts: int, levels: bytes, percent: int, leaders: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Tokens (hashes mixed again, as the first of a set are its least; so they are even over all ranges), class keys, sizes,
    places and crowds, by token range."""
    led = Leaders(leaders)
    table = np.frombuffer(levels, np.uint8)
    bounds = (np.arange(parts + 1).astype(object) * 2**64 // parts)[:-1].astype(K.U)
    seen: set[int] = set()
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def blobs() -> pa.RecordBatch:
        t, k, n, place, crowd = (np.concatenate(x) for x in zip(*held))
        o = np.argsort(t)
        t, k, n, place, crowd = t[o], k[o], n[o], place[o], crowd[o]
        edges = np.searchsorted(t, bounds).tolist() + [len(t)]
        rows = [(i, a, b) for i, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
        return pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in rows], pa.int32())] + [pa.array([x[a:b].tobytes() for _, a, b in rows], pa.binary()) for x in (t, k, n, place, crowd)], names=["part", "t", "k", "n", "place", "crowd"])

    for whole in batches:
        for batch in K.pieces(whole, 0):
            sets, fresh, keys = _sets(batch.column(0)), [], []
            for s, key in zip(sets, set_keys(sets)):
                if len(s) and key not in seen:
                    seen.add(key)
                    fresh.append(s), keys.append(key)
            t, own, place = prefixes(fresh, table, percent)
            held.append((K.mix(t), np.array(keys, np.int64)[own], np.array([len(s) for s in fresh], np.uint32)[own], place.astype(np.uint32), led.crowds(fresh)[own]))
            size += len(t)
            if size > FLUSH:
                yield blobs()
                held, size = [], 0
    if size:
        yield blobs()


def _blocks(keys: np.ndarray, blocks: int, splits: dict[int, int]) -> np.ndarray:
    """The block of each class: like sets share one, unless their group is so large that it has several."""
    k = keys.view(K.U)
    near = (k >> K.U(40)).astype(np.int64)
    block = K.mix(near.astype(K.U))
    if splits:
        names = np.array(sorted(splits), np.int64)
        at = np.flatnonzero(K.isin_sorted(near, names))
        with np.errstate(over="ignore"):
            block[at] += K.mix(k[at]) % np.array([splits[x] for x in near[at].tolist()], K.U)
    return (block % K.U(blocks)).astype(np.int64)


PAIR_TYPE = "cell long, k binary, n binary, code binary"


def _pair_rows(a: np.ndarray, b: np.ndarray, keys: np.ndarray, sizes: np.ndarray, blocks: int, splits: dict[int, int]) -> pa.RecordBatch:
    """Pairs of class indices by cell of the grid: the cell's classes, and its distinct pairs as packed differences."""
    block = _blocks(keys, blocks, splits)
    x, y = np.minimum(block[a], block[b]), np.maximum(block[a], block[b])
    cell = (x << 32) | y
    o = np.argsort(cell, kind="stable")
    a, b, cell = a[o], b[o], cell[o]
    cuts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]])) if len(cell) else []
    rows = []
    for x, y in zip(cuts[:-1], cuts[1:]):
        own, index = np.unique(np.concatenate([a[x:y], b[x:y]]), return_inverse=True)
        i, j = index[: y - x], index[y - x :]
        code = np.unique(np.minimum(i, j) * len(own) + np.maximum(i, j))
        rows.append((int(cell[x]), keys[own].tobytes(), sizes[own].astype(np.uint32).tobytes(), zlib.compress(np.diff(code, prepend=0).tobytes(), 1)))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64())] + [pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3)], names=["cell", "k", "n", "code"])


def _unpacked(k: bytes, n: bytes, code: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys and sizes of the classes, and the pairs as indices into them."""
    keys, c = np.frombuffer(k, np.int64), np.cumsum(np.frombuffer(zlib.decompress(code), np.int64))
    return keys, np.frombuffer(n, np.uint32).astype(np.int64), c // max(1, len(keys)), c % max(1, len(keys))


def _least(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The overlap that sets of these sizes need: the least x with 100 x >= percent (a + b - x)."""
    return -(-percent * (a + b) // (100 + percent))


class Tree:
    """A signature tree over postings sorted by token (as a rank), then crowd, then size.

    Nodes of one level span FANOUT**level neighbours. A node's bitmap has a bit per run of 2**shift ranks, modulo 64; the
    runs are about as long as a node, so that nodes of one parent, or of neighbouring ones, that share no token seldom
    share a bit.
    """

    def __init__(self, rank: np.ndarray, size: np.ndarray, left: np.ndarray, crowd: np.ndarray):
        self.rank, self.levels, self.crowds = rank, [], []
        span = 1
        while True:
            at = np.arange(0, len(rank), span)
            per_node = (int(rank[-1]) + 1) * span // len(rank) if len(rank) else 0
            bits = K.U(1) << ((rank >> max(0, per_node.bit_length() - 1)) & 63).astype(K.U)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(size, at), np.maximum.reduceat(size, at), np.maximum.reduceat(left, at)))
            least, most = np.minimum.reduceat(crowd, at), np.maximum.reduceat(crowd, at)
            self.crowds.append(np.where(least == most, least, 0))
            if len(at) <= 1:
                break
            span *= FANOUT

    def fits(self, level: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Which node pairs may have a linked pair below: their maximum possible overlap reaches the least that any needs."""
        bits, low, high, left = self.levels[level]
        most = np.where(bits[a] & bits[b] != 0, np.minimum(np.minimum(left[a], left[b]), np.minimum(high[a], high[b])), 0)
        return most >= np.maximum(_least(low[a], low[b], percent), 1)

    def pairs(self, percent: int, prune: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i < j) of postings with one token that aren't in one crowd, by descent of the tree against itself; without
        prune, of all that share one."""
        top = len(self.levels) - 1
        todo = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while todo:
            level, a, b = todo.pop()
            if len(a) > PAIRS // FANOUT**2 and len(a) > 1:  # a part at a time, depth first, so memory stays within bounds
                half = len(a) // 2
                todo += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
                continue
            one = self.crowds[level]  # the crowd that all below are in
            keep = (one[a] != one[b]) | (one[a] == 0)
            a, b = a[keep], b[keep]
            if prune:
                keep = self.fits(level, a, b, percent)
                a, b = a[keep], b[keep]
            if not level:
                keep = (a < b) & (self.rank[a] == self.rank[b])
                yield a[keep], b[keep]
                continue
            n = len(self.levels[level - 1][0])
            i = (a[:, None] * FANOUT + np.arange(FANOUT))[:, :, None]
            j = (b[:, None] * FANOUT + np.arange(FANOUT))[:, None, :]
            ok = ((i < n) & (j < n) & (i <= j)).ravel()
            i, j = np.broadcast_to(i, (len(a), FANOUT, FANOUT)).ravel()[ok], np.broadcast_to(j, (len(a), FANOUT, FANOUT)).ravel()[ok]
            if len(i):
                todo.append((level - 1, i, j))


def candidates(t: np.ndarray, k: np.ndarray, n: np.ndarray, place: np.ndarray, percent: int, prune: bool = True, crowd: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one token range's postings: class keys and sizes, and the distinct candidate pairs as indices into these."""
    crowd = np.zeros(len(t), np.uint16) if crowd is None else crowd
    order = np.argsort(t, kind="stable")
    same = np.zeros(len(t) + 1, bool)
    same[1:-1] = t[order][1:] == t[order][:-1]
    order = order[same[:-1] | same[1:]]  # a token of one posting has no pair
    order = order[np.lexsort((k[order], n[order], crowd[order], t[order]))]
    t, k, n, place, crowd = t[order], k[order], n[order].astype(np.int64), place[order].astype(np.int64), crowd[order]
    fresh = np.ones(len(t), bool)  # several tasks send the same class
    fresh[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1]) | (n[1:] != n[:-1])
    t, k, n, place, crowd = t[fresh], k[fresh], n[fresh], place[fresh], crowd[fresh]
    keys, some, index = np.unique(k, return_index=True, return_inverse=True)
    found, pending = [np.zeros(0, np.int64)], 0
    if len(t):
        rank = np.cumsum(np.concatenate([[0], t[1:] != t[:-1]]))
        for i, j in Tree(rank, n, n - place, crowd).pairs(percent, prune):
            x, y = index[i].astype(np.int64), index[j].astype(np.int64)
            found.append(np.minimum(x, y) * len(keys) + np.maximum(x, y))
            pending += len(i)
            if pending > 4 * PAIRS:
                found, pending = [np.unique(np.concatenate(found))], 0
    code = np.unique(np.concatenate(found))
    return keys, n[some], code // max(1, len(keys)), code % max(1, len(keys))


@common.lean
def _candidates(batches: Iterator[pa.RecordBatch], blocks: int, splits: dict[int, int], percent: int) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(batches, pa.schema([("part", pa.int32()), *((c, pa.binary()) for c in ("t", "k", "n", "place", "crowd"))]))
    keys, sizes, a, b = candidates(K.joined(table["t"], K.U), K.joined(table["k"], np.int64), K.joined(table["n"], np.uint32), K.joined(table["place"], np.uint32), percent, crowd=K.joined(table["crowd"], np.uint16))
    del table
    for k in range(0, len(a), PAIRS):
        yield _pair_rows(a[k : k + PAIRS], b[k : k + PAIRS], keys, sizes, blocks, splits)


@common.lean
def _needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The classes that are needed in each cell, once per task or flush."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        cell, key = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, np.int64),) * 2
        held.clear()
        o = np.lexsort((key, cell))
        cell, key = cell[o], key[o]
        new = np.ones(len(o), bool)
        new[1:] = (cell[1:] != cell[:-1]) | (key[1:] != key[:-1])
        return pa.RecordBatch.from_arrays([pa.array(cell[new]), pa.array(key[new])], names=["cell", "key"])

    for batch in batches:
        for c, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.append((np.full(len(k) // 8, c, np.int64), np.frombuffer(k, np.int64)))
        if sum(len(x) for x, _ in held) > PAIRS:
            yield flush()
    yield flush()


def _cell_pairs(pairs: pa.Table, classes: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of a cell as indices into its classes, ordered by size and key; the classes' keys, sizes, row numbers."""
    key, row = np.unique(classes["key"].to_numpy(), return_index=True)
    size = classes["n"].to_numpy()[row]
    order = np.lexsort((key, size))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    found = []
    for blobs in zip(*(pairs[c].to_pylist() for c in ("k", "n", "code"))):
        keys, _, a, b = _unpacked(*blobs)
        at = place[np.searchsorted(key, keys)]
        found.append(np.unique(np.minimum(at[a], at[b]) * len(key) + np.maximum(at[a], at[b])))
    code = np.unique(np.concatenate(found))
    return code // len(key), code % len(key), key[order], size[order], row[order]


def _fold(maps: list[np.ndarray], words: int) -> np.ndarray:
    """Bitmaps of any power-of-two width as rows of so many 64-bit words: wide ones are ORed together, narrow ones repeated."""
    out = np.empty((len(maps), words), K.U)
    for i, m in enumerate(maps):
        out[i] = np.bitwise_or.reduce(m.reshape(-1, words), 0) if len(m) >= words else np.tile(m, words // len(m))
    return out


def prune(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, maps: list[np.ndarray], percent: int) -> np.ndarray:
    """Which candidate pairs survive a second descent, with bitmaps of whole sets. Classes are ordered by size.

    A pair of sets shares at most as many tokens as bits are common to both bitmaps, plus the tokens beyond one to a bit in the
    set that has fewer of these; for nodes the bitmaps are ORed and the numbers of such tokens maximised, so the bound holds
    for all below. Nodes of two levels and more are full in these bitmaps, and have size ranges only.
    """
    keep = np.ones(len(a), bool)
    if not len(a):
        return keep
    top = 1
    while FANOUT**top < len(sizes):
        top += 1
    for level in range(top, -1, -1):
        span = FANOUT**level
        node_a, node_b = a[keep] // span, b[keep] // span
        if not len(node_a):
            break
        nodes = -(-len(sizes) // span)
        code, back = np.unique(node_a * nodes + node_b, return_inverse=True)
        na, nb = code // nodes, code % nodes
        low, high = sizes[np.arange(nodes) * span], sizes[np.minimum(np.arange(1, nodes + 1) * span, len(sizes)) - 1]
        fits = (100 * high[na] >= percent * low[nb]) & (100 * high[nb] >= percent * low[na])
        width = np.maximum(np.array([len(m) for m in maps]), 1)
        if level <= 1:  # wider nodes are full: their bitmaps can't prune
            for w in np.unique(width[np.minimum(na * span, len(sizes) - 1)]):
                at = np.flatnonzero(fits & (width[np.minimum(na * span, len(sizes) - 1)] == w))
                for c in range(0, len(at), max(1, (1 << 21) // int(w))):
                    part = at[c : c + max(1, (1 << 21) // int(w))]
                    used = np.unique(np.concatenate([na[part], nb[part]]))
                    bits, spare = [], []
                    for node in used.tolist():
                        own = _fold(maps[node * span : (node + 1) * span], int(w))
                        spare.append(int((sizes[node * span : (node + 1) * span] - np.bitwise_count(own).sum(1)).clip(0).max()))
                        bits.append(np.bitwise_or.reduce(own, 0))
                    bits, spare = np.array(bits), np.array(spare)
                    x, y = np.searchsorted(used, na[part]), np.searchsorted(used, nb[part])
                    overlap = np.bitwise_count(bits[x] & bits[y]).sum(1) + np.minimum(spare[x], spare[y])
                    fits[part] = np.minimum(overlap, np.minimum(high[na[part]], high[nb[part]])) >= _least(low[na[part]], low[nb[part]], percent)
        keep[np.flatnonzero(keep)[~fits[back]]] = False
    return keep


def _trees(key: tuple, pairs: pa.Table, classes: pa.Table, percent: int) -> pa.Table:
    none = pa.table([pa.array([], pa.int64())] + [pa.array([], pa.binary())] * 3, names=["cell", "k", "n", "code"])
    if not pairs.num_rows or not classes.num_rows:
        return none
    a, b, keys, sizes, row = _cell_pairs(pairs, classes)
    keep = prune(a, b, sizes, [np.frombuffer(x, K.U) for x in classes["bits"].take(pa.array(row)).to_pylist()], percent)
    return pa.Table.from_batches([_pair_rows(a[keep], b[keep], keys, sizes, 1, {})]) if keep.any() else none


@common.lean
def _regrid(batches: Iterator[pa.RecordBatch], blocks: int, splits: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """Pairs by the cells of another grid."""
    for batch in batches:
        for blobs in zip(*(x.to_pylist() for x in batch.columns[1:])):
            keys, sizes, a, b = _unpacked(*blobs)
            yield _pair_rows(a, b, keys, sizes, blocks, splits)


def packed(s: np.ndarray) -> bytes:
    """A sorted set by the upper 48 bits of its tokens."""
    return np.ascontiguousarray(s.view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def unpacked(x: bytes) -> np.ndarray:
    return np.pad(np.frombuffer(x, np.uint8).reshape(-1, 6), ((0, 0), (2, 0))).reshape(-1).view(K.U)


@common.lean
def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From text, key, copies and cells: the set of each class for each cell that needs it."""
    for whole in batches:
        for batch in K.pieces(whole, 0, 1 << 20):
            cells, keys, copies, n, blobs = [], [], [], [], []
            sets = _sets(batch.column(0))
            for s, own, key, many, to in zip(sets, set_keys(sets), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if own == key:  # else another text under the same doc_id
                    for c in to:
                        cells.append(c), keys.append(key), copies.append(many), n.append(len(s)), blobs.append(packed(s))
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(keys, pa.int64()), pa.array(copies, pa.int64()), pa.array(n, pa.int64()), pa.array(blobs, pa.binary())], names=["cell", "key", "copies", "n", "tokens"])


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of n nodes reaches along the edges."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (jump := new[new]) is not new and (jump != new).any():
            new = jump
        if (new == label).all():
            break
        label = new
    return label


def _verify(key: tuple, pairs: pa.Table, classes: pa.Table, percent: int) -> pa.Table:
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
    if pairs.num_rows and classes.num_rows:
        a, b, keys, sizes, row = _cell_pairs(pairs, classes)
        copies = classes["copies"].to_numpy()[row]
        sets = [unpacked(x) for x in classes["tokens"].take(pa.array(row)).to_pylist()]
        need, linked = _least(sizes[a], sizes[b], percent), np.zeros(len(a), bool)
        for i, (x, y, least) in enumerate(zip(a.tolist(), b.tolist(), need.tolist())):
            s, t = (sets[x], sets[y]) if len(sets[x]) <= len(sets[y]) else (sets[y], sets[x])
            at = np.searchsorted(t, s)
            linked[i] = np.count_nonzero(t[np.minimum(at, len(t) - 1)] == s) >= least
        a, b = a[linked], b[linked]
        degree = np.bincount(a, copies[b], len(keys)) + np.bincount(b, copies[a], len(keys))
        root = spanning(a, b, len(keys))
        own = np.flatnonzero(degree > 0)
        out = [keys[own], degree[own].astype(np.int64), keys[root[own]]]
    return pa.table([pa.array(x, pa.int64()) for x in out], names=["key", "links", "root"])


@common.lean
def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first half of each class's sketch, a token a row."""
    for batch in batches:
        token = [np.frombuffer(x, np.int64)[: SKETCH // 2] for x in batch.column(0).to_pylist()]
        own = pa.array(np.repeat(np.arange(len(token)), [len(x) for x in token]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *token])), batch.column(1).take(own), batch.column(2).take(own)], names=["token", "key", "copies"])


@common.lean
def _suspects(batches: Iterator[pa.RecordBatch], leaders: list[bytes]) -> Iterator[pa.RecordBatch]:
    """The classes whose sketches meet a leader's, from sketch and other columns."""
    token = Leaders(leaders).token
    for batch in batches:
        met = [bool(K.isin_sorted(np.frombuffer(x, K.U) >> K.U(16), token).any()) for x in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays(batch.columns[1:], names=batch.schema.names[1:]).filter(pa.array(met, pa.bool_()))


@common.lean
def _crowded(batches: Iterator[pa.RecordBatch], leaders: list[bytes]) -> Iterator[pa.RecordBatch]:
    """From text, key and copies: the sets that are in a crowd."""
    led = Leaders(leaders)
    for whole in batches:
        for batch in K.pieces(whole, 0, 1 << 20):
            sets = _sets(batch.column(0))
            crowd = led.crowds(sets)
            same = np.array(set_keys(sets), np.int64) == batch.column(1).to_numpy()  # else another text under the same doc_id
            at = np.flatnonzero((crowd > 0) & same)
            own = [sets[i] for i in at.tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(crowd[at].astype(np.int64)), batch.column(1).take(pa.array(at)), batch.column(2).take(pa.array(at)), pa.array([len(s) for s in own], pa.int64()), pa.array([packed(s) for s in own], pa.binary())],
                names=["crowd", "key", "copies", "n", "tokens"],
            )


@common.lean
def _dealt(batches: Iterator[pa.RecordBatch], blocks: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """The sets of crowds to each cell of the crowd's grid that needs them; a crowd of one has no cell."""
    for batch in batches:
        crowd = batch.column(0).to_numpy()
        n = np.array([blocks.get(c, 0) for c in crowd.tolist()], np.int64)
        block = (K.mix(batch.column(1).to_numpy().view(K.U)) % np.maximum(n, 1).astype(K.U)).astype(np.int64)
        for x in range(int(n.max(initial=0))):
            at = np.flatnonzero(n > x)
            cell = (crowd[at] << 40) | (np.minimum(block[at], x) << 20) | np.maximum(block[at], x)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(block[at])] + [c.take(pa.array(at)) for c in batch.columns[1:]], names=["cell", "block", "key", "copies", "n", "tokens"])


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many tokens each set on the left shares with each on the right.

    Tokens of many sets are columns of a matrix product; the pairs of the others are counted one by one.
    """

    def listed(sets: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        token, row = np.concatenate([np.zeros(0, K.U), *sets]), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(token, kind="stable")
        return row[order], *np.unique(token[order], return_index=True, return_counts=True)

    def ones(row: np.ndarray, at: np.ndarray, many: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, len(at)), np.float32)
        out[row[np.repeat(at - np.cumsum(many) + many, many) + np.arange(many.sum())], np.repeat(np.arange(len(at)), many)] = 1
        return out

    (row_a, a, at_a, many_a), (row_b, b, at_b, many_b) = listed(left), listed(right)
    _, x, y = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    at_a, many_a, at_b, many_b = at_a[x], many_a[x], at_b[y], many_b[y]
    out, pairs = np.zeros((len(left), len(right)), np.float32), many_a * many_b
    wide = 256 * pairs > len(left) * len(right)
    columns = np.flatnonzero(wide)
    for k in range(0, len(columns), 512):
        c = columns[k : k + 512]
        out += ones(row_a, at_a[c], many_a[c], len(left)) @ ones(row_b, at_b[c], many_b[c], len(right)).T
    rest = np.flatnonzero(~wide)
    part = np.cumsum(pairs[rest]) // PAIRS
    for k in np.unique(part):
        c = rest[part == k]
        p = pairs[c]
        within, width = np.arange(p.sum()) - np.repeat(np.cumsum(p) - p, p), np.repeat(many_b[c], p)
        i, j = row_a[np.repeat(at_a[c], p) + within // width], row_b[np.repeat(at_b[c], p) + within % width]
        np.add.at(out.ravel(), i * len(right) + j, np.float32(1))
    return out


def _counted(key: tuple[pa.Scalar, ...], table: pa.Table, percent: int) -> pa.Table:
    """Link counts and a spanning forest of one cell of a crowd's grid."""
    cell = key[0].as_py()
    block, keys, copies = (table[c].to_numpy() for c in ("block", "key", "copies"))
    sets = [unpacked(x) for x in table["tokens"].to_pylist()]
    a, b = (np.flatnonzero(block == (cell >> by & (1 << 20) - 1)) for by in (20, 0))
    n = np.array([len(s) for s in sets], np.int64)
    shared = overlaps([sets[i] for i in a.tolist()], [sets[i] for i in b.tolist()]) if len(a) and len(b) else np.zeros((len(a), len(b)), np.float32)
    linked = shared >= _least(n[a][:, None], n[b][None, :], percent)
    if cell >> 20 & (1 << 20) - 1 == cell & (1 << 20) - 1:
        linked = np.triu(linked, 1)
    i, j = np.nonzero(linked)
    i, j = a[i], b[j]
    degree = np.bincount(i, copies[j], len(keys)) + np.bincount(j, copies[i], len(keys))
    root = spanning(i, j, len(keys))
    own = np.flatnonzero(degree > 0)
    return pa.table([pa.array(x, pa.int64()) for x in (keys[own], degree[own].astype(np.int64), keys[root[own]])], names=["key", "links", "root"])


def _leaders(classes: DataFrame, texts: DataFrame) -> list[bytes]:
    """The packed sets of the leaders, those of the most crowded shingles first."""
    spark = classes.sparkSession
    tokens = classes.select("sketch", "key", "copies").mapInArrow(_sketches, "token long, key long, copies long")
    hot = tokens.groupBy("token").agg(F.count("*").alias("many"), F.max(F.struct("copies", "key")).alias("of")).where(F.col("many") >= CROWD)
    led = hot.groupBy(F.col("of.key").alias("key")).agg(F.max("many").alias("many")).join(classes.select("key", "n"), "key")
    rows = led.orderBy(F.desc("many"), "key").limit(MOST_LEADERS).select("key", "n").toArrow()
    keys = rows["key"].to_numpy()[np.cumsum(rows["n"].to_numpy()) * 6 <= LEADER_BYTES]
    if not len(keys):
        return []
    side = F.broadcast(classes.join(F.broadcast(spark.createDataFrame(pa.table({"key": keys}))), "key").select("first", "key", F.lit(1).cast("long").alias("copies"), F.array(F.lit(0).cast("long")).alias("cells")))
    found = texts.join(side, texts["doc_id"].eqNullSafe(side["first"])).select("text", "key", "copies", "cells").mapInArrow(_members, "cell long, key long, copies long, n long, tokens binary")
    of = {r.key: bytes(r.tokens) for r in found.select("key", "tokens").dropDuplicates(["key"]).collect()}
    return [of[k] for k in keys.tolist() if k in of]


def _crowd_links(classes: DataFrame, texts: DataFrame, leaders: list[bytes], folder: str, percent: int) -> DataFrame:
    """key, links, root of the pairs inside crowds."""
    suspects = common.stored(classes.select("sketch", "first", "key", "copies").mapInArrow(partial(_suspects, leaders=leaders), classes.select("first", "key", "copies").schema), folder, "suspects")
    side = F.broadcast(suspects) if suspects.count() * 64 <= common.BROADCAST_BYTES else suspects
    found = texts.join(side, texts["doc_id"].eqNullSafe(side["first"])).select("text", "key", "copies").mapInArrow(partial(_crowded, leaders=leaders), "crowd long, key long, copies long, n long, tokens binary")
    crowds = common.stored(found.dropDuplicates(["key"]), folder, "crowds")
    sizes = crowds.groupBy("crowd").agg(F.count("*").alias("sets"), F.sum(F.length("tokens")).alias("bytes")).where("sets > 1").collect()
    blocks = {r.crowd: max(-(-r.sets // BLOCK_SETS), -(-r.bytes // CELL_BYTES)) for r in sizes}
    n = max(common.groups(crowds.sparkSession, sum(r.bytes * blocks[r.crowd] for r in sizes)), min(4096, sum(b * (b + 1) // 2 for b in blocks.values() if b > 1)))
    dealt = crowds.mapInArrow(partial(_dealt, blocks=blocks), "cell long, block long, key long, copies long, n long, tokens binary")
    return dealt.repartition(n, "cell").groupBy("cell").applyInArrow(common.grouped(_counted, percent=percent), "key long, links long, root long")


@common.lean
def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(batches, pa.schema([("a", pa.int64()), ("b", pa.int64())]))
    nodes, index = np.unique(np.concatenate([table["a"].to_numpy(), table["b"].to_numpy()]), return_inverse=True)
    label = spanning(index[: table.num_rows], index[table.num_rows :], len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "label"])


def _with_least(edges: DataFrame) -> DataFrame:
    """a, b, m of edges (a, b): m is the least of a and its neighbours. Hubs take it from a table that is sent to all tasks."""
    least = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("k"))
    hubs = least.where(F.col("k") > HUB).select(F.col("a").alias("hub"), F.col("m").alias("hub_m"))
    marked = edges.join(F.broadcast(hubs), F.col("a") == F.col("hub"), "left")
    rest = marked.where("hub IS NULL").select("a", "b").join(least.where(F.col("k") <= HUB).select("a", "m"), "a")
    return marked.where("hub IS NOT NULL").select("a", "b", F.col("hub_m").alias("m")).union(rest.select("a", "b", "m"))


def components(edges: DataFrame, folder: str, bound: int = FOREST_EDGES) -> DataFrame:
    """node, label of every node of the edges (a, b): the smallest node that it reaches.

    Up to `bound` edges one task finds them; beyond, large-star and small-star rounds until nothing changes, each written to
    the shared folder.
    """
    spark = edges.sparkSession
    edges = common.stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), folder, "edges-0")
    if edges.count() <= bound:
        return edges.coalesce(1).mapInArrow(_label, "node long, label long")
    before = None
    for k in itertools.count(1):
        large = _with_least(edges.union(edges.select("b", "a"))).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = common.stored(large, folder, f"large-{k}")
        small = _with_least(large)
        edges = common.stored(small.select("b", "m").union(small.select("a", "m")).toDF("a", "b").where("a <> b").distinct(), folder, f"edges-{k}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select("b", "b").distinct()).groupBy("node").agg(F.min("label").alias("label"))


def _grid(sizes: DataFrame) -> tuple[int, dict[int, int]]:
    """How many blocks hold all classes of (key, size), and into how many the groups of like sets that exceed one are split."""
    near = F.expr("shiftrightunsigned(key, 40)")
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    large = sizes.groupBy(near.alias("near")).agg(F.sum("size").alias("size")).where(F.col("size") > CELL_BYTES).collect() if total > CELL_BYTES else []
    return max(1, -(-total // CELL_BYTES)), {r[0]: -(-r[1] // CELL_BYTES) for r in large}


def _levels(profile: DataFrame) -> bytes:
    """For each of LEVELS buckets of shingles the logarithm of the greatest count in it; 0 where none is common."""
    common_ones = profile.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    of = common_ones.mapInArrow(_buckets, "bucket int, level int").groupBy("bucket").agg(F.max("level").alias("level")).toArrow()
    levels = np.zeros(LEVELS, np.uint8)
    levels[of["bucket"].to_numpy()] = of["level"].to_numpy()
    return levels.tobytes()


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h = K.mix(batch.column(0).to_numpy().view(K.U))
        level = np.log2(batch.column(1).to_numpy().astype(float)) * 4
        yield pa.RecordBatch.from_arrays([pa.array((h & K.U(LEVELS - 1)).astype(np.int32)), pa.array(np.minimum(level, 255).astype(np.int32))], names=["bucket", "level"])


def _by_class(rows: DataFrame, table: DataFrame, how: str = "left") -> DataFrame:
    """Rows joined with a table of one row per class by key. Classes of more than HUB copies, at most 1 / HUB as many as rows,
    are sent to all tasks, so that no task gets all rows of a hot class."""
    small = table.where(F.col("copies") > HUB).drop("copies")
    names = [c for c in small.columns if c != "key"]
    hot = small.select(F.col("key").alias("hot_key"), *[F.col(c).alias(f"hot_{c}") for c in names])
    marked = rows.join(F.broadcast(hot), F.col("key") == F.col("hot_key"), "left")
    cold = F.when(F.col("hot_key").isNull(), F.col("key"))
    joined = marked.withColumn("cold_key", cold).join(table.where(F.col("copies") <= HUB).drop("copies").withColumnRenamed("key", "of_key"), F.col("cold_key") == F.col("of_key"), how)
    return joined.select(*rows.columns, *[F.coalesce(c, f"hot_{c}").alias(c) for c in names])


def classified(docs: DataFrame, percent: int = 70) -> tuple[DataFrame, DataFrame]:
    """doc_id, n, key of each row, and of each class with links or copies: key, copies, n_similar, component_id, first (its
    smallest doc_id) and stays (whether it has its component's smallest doc_id, or of several such the smallest key)."""
    spark = docs.sparkSession
    common.prepare(spark)
    folder = common.work_folder(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    profile = common.stored(texts.mapInArrow(_profile, f"kind int, doc_id {kind}, n long, key long, bits binary, sketch binary"), folder, "profile")
    sets = profile.where("kind = 0").select("doc_id", "n", "key")
    classes = profile.where("kind = 0 AND n > 0").groupBy("key").agg(F.first("n").alias("n"), F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.first("bits").alias("bits"), F.first("sketch").alias("sketch"))
    classes = common.stored(classes, folder, "classes")
    leaders = _leaders(classes, texts)
    # a posting has 26 bytes
    parts = common.groups(spark, classes.agg(F.coalesce(F.sum(26 * (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)), F.lit(0))).first()[0], 12 << 20)
    postings = texts.select("text").mapInArrow(partial(_postings, parts=parts, levels=_levels(profile), percent=percent, leaders=leaders), "part int, t binary, k binary, n binary, place binary, crowd binary")
    blocks, splits = _grid(classes.select("key", F.length("bits").alias("size")))
    found = postings.repartitionById(parts, F.col("part")).mapInArrow(partial(_candidates, blocks=blocks, splits=splits, percent=percent), PAIR_TYPE)
    pairs = common.stored(found, folder, "pairs")

    needs = common.stored(pairs.mapInArrow(_needs, "cell long, key long").distinct().join(classes.select("key", "n", "bits"), "key"), folder, "needs")
    n = common.groups(spark, needs.agg(F.coalesce(F.sum(F.length("bits") + 24), F.lit(0))).first()[0])
    both = pairs.repartition(n, "cell").groupBy("cell").cogroup(needs.repartition(n, "cell").groupBy("cell"))
    pairs = common.stored(both.applyInArrow(common.cogrouped(_trees, percent=percent), PAIR_TYPE), folder, "alive")

    wanted = pairs.mapInArrow(_needs, "cell long, key long").select("key").distinct().join(classes.select("key", "n", "copies", "first"), "key")
    wanted = common.stored(wanted, folder, "wanted")
    blocks, splits = _grid(wanted.select("key", (F.col("n") * 6).alias("size")))
    linked = common.stored(pairs.mapInArrow(partial(_regrid, blocks=blocks, splits=splits), PAIR_TYPE), folder, "linked")
    cells = linked.mapInArrow(_needs, "cell long, key long").groupBy("key").agg(F.collect_set("cell").alias("cells"))
    wanted = common.stored(wanted.join(cells, "key").select("first", "key", "copies", "n", "cells"), folder, "wanted-cells")
    many, places, size = wanted.agg(F.count("*"), F.coalesce(F.sum(F.size("cells")), F.lit(0)), F.coalesce(F.sum(F.size("cells") * F.col("n") * 6), F.lit(0))).first()
    side = wanted.drop("n")
    side = F.broadcast(side) if places * 8 + many * 64 <= common.BROADCAST_BYTES else side
    members = texts.join(side, texts["doc_id"].eqNullSafe(side["first"])).select("text", "key", "copies", "cells").mapInArrow(_members, "cell long, key long, copies long, n long, tokens binary")
    n = common.groups(spark, size)
    both = linked.repartition(n, "cell").groupBy("cell").cogroup(members.repartition(n, "cell").groupBy("cell"))
    links = common.stored(both.applyInArrow(common.cogrouped(_verify, percent=percent), "key long, links long, root long"), folder, "links")
    if leaders:
        links = links.union(common.stored(_crowd_links(classes, texts, leaders, folder, percent), folder, "crowd-links"))

    labels = components(links.select(F.col("key").alias("a"), F.col("root").alias("b")), folder)
    grouped = links.groupBy("key").agg(F.sum("links").alias("links")).join(labels.withColumnRenamed("node", "key"), "key", "left")
    known = classes.select("key", "first", "copies").join(grouped, "key", "left").withColumn("label", F.coalesce("label", "key"))
    least = known.where("links IS NOT NULL").groupBy("label").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "key")).alias("least"))
    known = known.join(least, "label", "left")
    result = known.select(
        "key", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_similar"), F.coalesce("least.first", "first").alias("component_id"), "first", F.coalesce(F.col("least.key") == F.col("key"), F.lit(True)).alias("stays")
    )
    return sets, common.stored(result.where("n_similar > 0"), folder, "result")


def similar(docs: DataFrame, percent: int = 70) -> DataFrame:
    """Per document: doc_id, n_shingles, n_similar, component_id."""
    sets, result = classified(docs, percent)
    return _by_class(sets, result.select("key", "copies", "n_similar", "component_id")).select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("n_similar", F.lit(0).cast("long")).alias("n_similar"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


@common.lean
def _keyed(batches: Iterator[pa.RecordBatch], text_at: int, key: str) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in K.pieces(whole, text_at):
            yield batch.append_column(key, pa.array(set_keys(_sets(batch.column(text_at))), pa.int64()))


def one_of_each(docs: DataFrame, percent: int = 70) -> DataFrame:
    """The documents, with all their columns, without those that are linked, however indirectly, with one that stays.

    Of each component the row with the smallest doc_id stays, nulls last; of rows that share it, the one with the smallest set
    key, and of equal sets one. Texts without words aren't linked and stay.
    """
    common.prepare(docs.sparkSession)
    sets, result = classified(docs, percent)
    twice = sets.where("n > 0").groupBy("key", "doc_id").agg(F.count("*").alias("rows")).where("rows > 1")
    first = result.select("key", "first", "stays", "copies")
    again = twice.join(first.where("stays"), "key").where(F.col("doc_id").eqNullSafe(F.col("first"))).select("key").distinct().withColumn("again", F.lit(True))
    first = common.stored(first.join(again, "key", "left").withColumn("again", F.coalesce("again", F.lit(False))), common.work_folder(docs.sparkSession), "first")
    many, doubled = first.agg(F.count("*"), F.count_if(F.col("again"))).first()
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # no name of a column can clash with these
    rows = docs.toDF(*names.values())
    at, text, kinds = names["doc_id"], names["text"], rows.schema
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds) + ", key long"
    rows = rows.withColumn(text, F.col(text).cast("string")).mapInArrow(partial(_keyed, text_at=docs.columns.index("text"), key="key"), schema)
    found = rows.join(F.broadcast(first.drop("copies")), "key", "left") if many * 64 <= common.BROADCAST_BYTES else _by_class(rows, first)
    kept = found.where(F.col("stays").isNull() | (F.col("stays") & F.col(at).eqNullSafe(F.col("first"))))
    if doubled:
        kept = kept.where(~F.coalesce("again", F.lit(False))).unionByName(kept.where("again").dropDuplicates(["key"]))
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(common.documents(spark, sf_dir))


OP7_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_sides AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
linked AS MATERIALIZED (SELECT a, b FROM both_sides JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 70 * (p.n + q.n - c)),
reach AS (SELECT a, b FROM linked UNION SELECT r.a, l.b FROM reach r JOIN linked l ON r.b = l.a),
k AS (SELECT a, count(*) AS n_similar FROM linked GROUP BY a),
m AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(k.n_similar, 0) AS BIGINT) AS n_similar, least(w.doc_id, coalesce(m.low, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN k ON k.a = w.doc_id LEFT JOIN m ON m.a = w.doc_id
"""
