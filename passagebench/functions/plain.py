"""The same text rules on Python strings, for the chunkers whose folds need one document at a time."""

from __future__ import annotations

import hashlib
import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .text import ABBREVIATIONS, CLOSERS, OTHER_ENDS, SPACED_ENDS, WIDE_CLOSERS

HASHED = re.compile("[a-z0-9]+")
WORD = re.compile(r"[^\W_]+")
#: The same as SENTENCE_END, but for beginning with the mark: the search passes over all other characters at once.
ENDS = re.compile(rf"[\n{SPACED_ENDS}{OTHER_ENDS}](?:(?<=\n)\n+|(?<=[{SPACED_ENDS}])[{CLOSERS}]*\s+|(?<=[{OTHER_ENDS}])(?![{WIDE_CLOSERS}])[{CLOSERS}]*\s*)")
TAKEN_BACK = re.compile(rf"(?:^|[\s(])(?:{'|'.join(map(re.escape, ABBREVIATIONS))})[.!?]*\s*\Z", re.IGNORECASE)


def count_tokens(text: str) -> int:
    return sum(1 for _ in WORD.finditer(text))


@lru_cache(maxsize=1)
def _in_words() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


class TokenCounts:
    """count_tokens of any span of a text, from one pass over it."""

    def __init__(self, text: str):
        self.inside = np.append(_in_words()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], False)
        begins = self.inside.copy()
        begins[1:] &= ~self.inside[:-1]
        self.begins, self.sums = begins, np.concatenate([[0], np.cumsum(begins)])

    def of(self, a, b):
        """Of text[a:b], or of several spans: tokens that begin there, and the one that a span begins within."""
        return self.sums[b] - self.sums[a] + (self.inside[a] & ~self.begins[a] & (np.asarray(a) < b))


def sentence_spans(text: str) -> list[tuple[int, int]]:
    cuts = [0]
    for m in ENDS.finditer(text):
        at = m.start() + (text[m.start()] != "\n")
        tail = text[max(0, at - 40) : at + 1]
        if tail.isascii() and not tail.rstrip().rstrip(".!?").lower().endswith(ABBREVIATIONS):  # nearly all are told by this alone
            cuts.append(m.end())
        elif not TAKEN_BACK.search(text, max(0, at - 40), at + 1):
            cuts.append(m.end())
    cuts.append(len(text))
    out = []
    for a, b in zip(cuts, cuts[1:]):
        part = text[a:b]
        if body := part.strip():
            start = a + len(part) - len(part.lstrip())
            out.append((start, start + len(body)))
    return out


#: Of MD5 (RFC 1321): rotations and constants of its 64 steps, and the state that it begins with. The longest message of one block.
_TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_STATE = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
ONE_BLOCK, AT_ONCE = 55, 8192


def md5_heads(words: pa.StringArray) -> np.ndarray:
    """The first four bytes of each word's MD5 as a number. Words of one block are digested together, column by column."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data, sizes = np.frombuffer(words.buffers()[2] or b"", np.uint8), np.diff(offsets).astype(np.int64)
    out = np.zeros(len(words), np.uint32)
    for at in range(0, len(words), AT_ONCE):
        n = np.minimum(sizes[at : at + AT_ONCE], ONE_BLOCK)
        block = np.zeros((len(n), 64), np.uint8)
        row = np.repeat(np.arange(len(n)), n)
        column = np.arange(len(row)) - np.repeat(n.cumsum() - n, n)
        block[row, column] = data[offsets[at : at + len(n)][row] + column]
        block[np.arange(len(n)), n] = 0x80
        block[:, 56:58] = (n * 8).astype("<u2").view(np.uint8).reshape(-1, 2)
        m = np.ascontiguousarray(block.view("<u4").T)
        a, b, c, d = (np.full(len(n), x) for x in _STATE)
        for i in range(64):
            if i < 16:
                f, k = d ^ (b & (c ^ d)), i
            elif i < 32:
                f, k = c ^ (d & (b ^ c)), (5 * i + 1) % 16
            elif i < 48:
                f, k = b ^ c ^ d, (3 * i + 5) % 16
            else:
                f, k = c ^ (b | ~d), 7 * i % 16
            f += a
            f += m[k]
            f += _SINES[i]
            a, d, c, b = d, c, b, b + ((f << np.uint32(_TURNS[i])) | (f >> np.uint32(32 - _TURNS[i])))
        out[at : at + len(n)] = (a + _STATE[0]).byteswap()
    for i in np.flatnonzero(sizes > ONE_BLOCK):
        out[i] = int(hashlib.md5(words[int(i)].as_py().encode()).hexdigest()[:8], 16)
    return out


def hash_vectors(texts: list[str], dims: int = 256) -> np.ndarray:
    """Unit rows of word counts by hash bucket; a text without words is the zero row."""
    text, words = hashed_words(texts)
    unique = words.dictionary_encode()
    bucket = md5_heads(unique.dictionary).astype(np.int64) % dims
    at = text * dims + bucket[unique.indices.to_numpy()]
    out = np.bincount(at, minlength=len(texts) * dims).reshape(len(texts), dims).astype(float)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    out /= np.where(norms > 0, norms, 1)
    return out


#: Bytes of words: 1 where one belongs to [a-z0-9]. Texts are joined by a byte that no text has, as it isn't UTF-8.
_IN_WORD = np.zeros(256, np.int8)
_IN_WORD[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = 1


def hashed_words(texts: list[str]) -> tuple[np.ndarray, pa.StringArray]:
    """All [a-z0-9]+ words of the lower-cased texts, and the number of the text that each is in."""
    whole = np.frombuffer(b"\xff".join(t.lower().encode("utf-8", "surrogatepass") for t in texts) + b"\xff", np.uint8)
    inside = _IN_WORD[whole]
    change = np.diff(inside, prepend=np.int8(0))
    begin, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    text = np.searchsorted(np.flatnonzero(whole == 0xFF), begin)
    offsets = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)
    data = whole[inside.astype(bool)]
    return text, pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(data))


def split_recursively(text: str, size: int, overlap: int, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ", ""), length=count_tokens) -> list[str]:
    """Pieces of at most `size` tokens where the separators allow it, neighbours sharing up to `overlap`.

    The first separator that occurs splits the text, each separator staying with what follows it; pieces that are too long are
    split by the later separators, the others are packed greedily, keeping a tail within the overlap for the next pack.
    """
    sep, later = separators[-1], ()
    for i, candidate in enumerate(separators):
        if candidate == "" or candidate in text:
            sep, later = candidate, separators[i + 1 :]
            break
    if sep:
        found = text.split(sep)
        parts = [p for p in [found[0], *(sep + f for f in found[1:])] if p]
    else:
        parts = list(text)
    out: list[str] = []
    fitting: list[str] = []

    def pack() -> None:
        held: list[str] = []
        sizes: list[int] = []
        for part in fitting:
            n = length(part)
            if held and sum(sizes) + n > size:
                if piece := "".join(held).strip():
                    out.append(piece)
                while held and (sum(sizes) > overlap or (sum(sizes) + n > size and sum(sizes) > 0)):
                    held.pop(0), sizes.pop(0)
            held.append(part), sizes.append(n)
        if piece := "".join(held).strip():
            out.append(piece)
        fitting.clear()

    for part in parts:
        if length(part) < size:
            fitting.append(part)
            continue
        pack()
        if later:
            out.extend(split_recursively(part, size, overlap, later, length))
        elif part.strip():
            out.append(part)
    pack()
    return out


def locate(text: str, pieces: list[str]) -> list[tuple[int, int]]:
    """Spans of the pieces, each sought from just after the last one's start, else from the beginning."""
    spans, at = [], 0
    for p in pieces:
        start = text.find(p, at)
        if start < 0:
            start = text.find(p)
        if start < 0:
            raise ValueError("a piece isn't part of its text")
        spans.append((start, start + len(p)))
        at = start + 1
    return spans
