"""NumPy kernels over the UTF-8 bytes of an Arrow batch: words, their hashes, and what is built on them.

A word's hash is a polynomial over its bytes modulo 2**64 with a random 64-bit value per byte, mixed at the end. Prefix
sums give all words of a block at once; blocks are cut between words, so memory follows the block and not the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.default_rng(20240607)
BYTE_VALUES = _rng.integers(1, 2**64, 256, dtype=U) | U(1)
#: Folding of A-Z is part of the byte values, so no lower-cased copy is made.
FOLDED_VALUES = BYTE_VALUES.copy()
FOLDED_VALUES[65:91] = BYTE_VALUES[97:123]
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
BLOCK = 1 << 20

_c = np.arange(256)
SPACE = (_c == 0x20) | ((_c >= 0x09) & (_c <= 0x0D))
NOT_ALNUM = (_c < 0x80) & ~(((_c >= 0x30) & (_c <= 0x39)) | ((_c >= 0x61) & (_c <= 0x7A)) | ((_c >= 0x41) & (_c <= 0x5A)))

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK + 1)
        with np.errstate(over="ignore"):
            have = np.cumprod(np.concatenate([np.ones(1, U), np.full(size - 1, base, U)]), dtype=U)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, nulls as empty, and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray = FOLDED_VALUES) -> np.ndarray:
    """The hash of each span of bytes; spans are ascending and don't overlap."""
    out, k = np.empty(len(start), U), 0
    with np.errstate(over="ignore"):
        while k < len(start):
            to = max(k + 1, int(np.searchsorted(end, start[k] + BLOCK, "right")))
            lo, hi = int(start[k]), int(end[to - 1])
            sums = np.zeros(hi - lo + 1, U)
            np.cumsum(values[buf[lo:hi]] * powers(BASE, hi - lo), out=sums[1:])
            s, e = start[k:to] - lo, end[k:to] - lo
            out[k:to] = (sums[e] - sums[s]) * powers(INVERSE, hi - lo + 1)[s] + (e - s).astype(U)
            k = to
    return mix(out)


def words(buf: np.ndarray, offsets: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end byte of every word, and the n + 1 positions in these where each row's words begin.

    breaks says for each byte value if it ends a word. Words never span rows.
    """
    inside = ~breaks[buf]
    if not len(inside):
        none = np.zeros(0, np.int64)
        return np.zeros(0, U), none, none, np.zeros(len(offsets), np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(buf))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return span_hashes(buf, start, end), start, end, np.searchsorted(start, offsets)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words from each position on; the last n - 1 positions have none."""
    with np.errstate(over="ignore"):
        out = np.full(max(0, len(h) - n + 1), n, U)
        for k in range(n):
            out = mix(out * U(0xD6E8FEB86659FD93) + h[k : len(h) - n + 1 + k])
    return out


def shingle_sets(h: np.ndarray, rows: np.ndarray, n: int = 3) -> list[np.ndarray]:
    """For each row its sorted distinct n-word shingles; of fewer words, the whole sequence as one; of none, empty."""
    all_n, out = grams(h, n), []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
        if b - a >= n:
            s = np.sort(all_n[a : b - n + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s)
        elif b > a:
            out.append(grams(h[a:b], b - a))
        else:
            out.append(np.zeros(0, U))
    return out


def isin_sorted(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), bool)
    at = np.searchsorted(table, x)
    at[at == len(table)] = 0
    return table[at] == x


def pieces(batch: pa.RecordBatch, at: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about so many bytes of text."""
    _, offsets = text_bytes(batch.column(at))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most, "right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    """The numbers in all blobs of a column, one after the other."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)
