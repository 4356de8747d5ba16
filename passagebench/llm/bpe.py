"""Byte-level BPE: propose tokens greedily, verify every adjacent pair, merge exactly only where that fails.

A sequence of tokens is the encoding of its bytes if each token is the encoding of its own bytes and no merge crosses any
adjacent pair (merges of a pair are undone from the last on, and at each step the tokens that then touch must have no
earlier merge). Words come from the tokenizer's pattern; texts are first cut at spaces where no word can cross, so equal
pieces of a batch are encoded once, and pieces and words are kept between batches in caches of bounded size.

Defined cases: null and empty texts have no ids; special tokens inside a text get their own ids, as the library does by
default; very long words are merged with a heap in n log n; a tokenizer file of another kind (another pattern, a normaliser,
flags on added tokens) is refused.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, kernels as K

_SPACES = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACES}\p{{L}}\p{{N}}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
WORDS_KEPT, PIECES_KEPT = 200_000, 300_000
SLICE = 2 << 20


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def supported(spec: dict) -> None:
    """Raises unless the tokenizer is of the kind that is encoded here: plain byte-level BPE with the usual pattern."""
    before, model = spec.get("pre_tokenizer") or {}, spec["model"]
    wrong = [f"normalizer {spec['normalizer']}"] if spec.get("normalizer") else []
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        wrong.append(f"pre-tokenizer {before}")
    if model.get("type", "BPE") != "BPE":
        wrong.append(f"model {model['type']}")
    wrong += [f"{k} {model[k]}" for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    wrong += [f"{k} of {t['content']}" for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized") if t.get(k)]
    if wrong:
        raise ValueError("this tokenizer isn't supported: " + ", ".join(wrong))


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        supported(spec)
        model, letters = spec["model"], byte_letters()
        vocab = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.ids = vocab
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for t, i in vocab.items():
            self.bytes[i] = t
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        #: By first three bytes, the lengths of the tokens that begin so, longest first; a single byte is always a token.
        longer: dict[bytes, set[int]] = {}
        for t in vocab:
            if len(t) > 2:
                longer.setdefault(t[:3], set()).add(len(t))
        self.longer = {k: sorted(v, reverse=True) for k, v in longer.items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        self.left, self.right, self.made = np.full(size, -1, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        for r, (a, b) in enumerate(pairs):
            x, y = (vocab[bytes(letters[c] for c in s)] for s in (a, b))
            z = vocab[self.bytes[x] + self.bytes[y]]
            self.rank[x, y] = r
            self.merged.append(z)
            if self.made[z] < 0:
                self.left[z], self.right[z], self.made[z] = x, y, r
        code = np.array([x * size + y for x, y in self.rank], np.int64)
        order = np.argsort(code)
        self.codes, self.code_rank = code[order], np.array(list(self.rank.values()), np.int64)[order]
        self.size = size
        self.sound = np.zeros(size, np.int8)  # 1: its bytes encode to it; -1: they don't; 0: not yet known
        self.known_pairs, self.known_fit = np.zeros(0, np.int64), np.zeros(0, bool)
        self.words: dict[bytes, tuple[int, ...]] = {}
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.arena = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.pattern = regex.compile(PATTERN)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.piece_hash, self.piece_at, self.piece_n, self.pieces = np.zeros(0, K.U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.proposed = self.failed = 0

    def merge(self, word: bytes) -> tuple[int, ...]:
        """The exact encoding of a word: the earliest merge first, leftmost among equals."""
        t = [self.ids[word[i : i + 1]] for i in range(len(word))]
        none = 1 << 30
        if len(t) <= 200:
            get = self.rank.get
            ranks = [get(p, none) for p in zip(t, t[1:])]
            while ranks and (r := min(ranks)) != none:
                i = ranks.index(r)
                t[i : i + 2] = [self.merged[r]]
                del ranks[i]
                if i:
                    ranks[i - 1] = get((t[i - 1], t[i]), none)
                if i < len(ranks):
                    ranks[i] = get((t[i], t[i + 1]), none)
            return tuple(t)
        n = len(t)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, t[i], t[i + 1]) for i in range(n - 1) if (r := self.rank.get((t[i], t[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or t[i] != a or j >= n or t[j] != b:
                continue
            t[i], alive[j], after[i] = self.merged[r], False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (q := self.rank.get((t[i], t[after[i]]))) is not None:
                    heapq.heappush(heap, (q, i, t[i], t[after[i]]))
            if (p := before[i]) >= 0 and (q := self.rank.get((t[p], t[i]))) is not None:
                heapq.heappush(heap, (q, p, t[p], t[i]))
        return tuple(x for x, ok in zip(t, alive) if ok)

    def propose(self, word: bytes) -> list[int]:
        out, i, n, get, longer = [], 0, len(word), self.ids.get, self.longer.get
        while i < n:
            for k in longer(word[i : i + 3], ()):
                if i + k <= n and (t := get(word[i : i + k])) is not None:
                    break
            else:
                k = 2 if i + 1 < n and (t := get(word[i : i + 2])) is not None else 1
                if k == 1:
                    t = get(word[i : i + 1])
            out.append(t)
            i += k
        return out

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of adjacent tokens: no merge crosses from a to b."""
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), 1 << 40, np.int64)
        while len(live):
            code = a * self.size + b
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            crosses = (self.codes[at] == code) & (self.code_rank[at] < limit)
            ok[live[crosses]] = False
            ma, mb = self.made[a], self.made[b]
            # undo the later of the two last merges; on the right side an equal rank comes later too, as merges go left to right
            undo_a = ma > mb
            over = crosses | ((ma < 0) & (mb < 0))
            a, b, limit = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b]), np.where(undo_a, ma, mb + 1)
            live, a, b, limit = live[~over], a[~over], b[~over], limit[~over]
        return ok

    def checked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code, back = np.unique(a.astype(np.int64) * self.size + b, return_inverse=True)
        at = np.searchsorted(self.known_pairs, code)
        known = np.zeros(len(code), bool)
        inside = at < len(self.known_pairs)
        known[inside] = self.known_pairs[at[inside]] == code[inside]
        fit = np.zeros(len(code), bool)
        fit[known] = self.known_fit[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            fit[new] = self.fits(code[new] // self.size, code[new] % self.size)
            if len(self.known_pairs) > 2_000_000:
                self.known_pairs, self.known_fit = self.known_pairs[:0], self.known_fit[:0]
            both = np.concatenate([self.known_pairs, code[new]])
            order = np.argsort(both)
            self.known_pairs, self.known_fit = both[order], np.concatenate([self.known_fit, fit[new]])[order]
        return fit[back]

    def learn(self, words: list[bytes]) -> None:
        """Encode new words: all proposals are verified at once."""
        if not words:
            return
        guesses = [self.propose(w) for w in words]
        n = np.array([len(g) for g in guesses])
        flat = np.fromiter((t for g in guesses for t in g), np.int64, int(n.sum()))
        word = np.repeat(np.arange(len(words)), n)
        for t in np.unique(flat[self.sound[flat] == 0]).tolist():
            self.sound[t] = 1 if self.merge(self.bytes[t]) == (t,) else -1
        bad = np.zeros(len(words), bool)
        bad[word[self.sound[flat] < 0]] = True
        inner = np.flatnonzero(word[1:] == word[:-1])
        bad[word[inner[~self.checked(flat[inner], flat[inner + 1])]]] = True
        self.proposed += len(words)
        self.failed += int(bad.sum())
        for w, g, wrong in zip(words, guesses, bad.tolist()):
            self.words[w] = self.merge(w) if wrong else tuple(g)

    def encode_pieces(self, pieces: list[bytes]) -> list[list[bytes]]:
        if len(self.words) > WORDS_KEPT:
            self.words.clear()
        split = [[w.encode() for w in self.pattern.findall(p.decode())] for p in pieces]
        self.learn(list({w for ws in split for w in ws if w not in self.words}))
        return split

    def plain(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without special tokens, and the n + 1 offsets of each row in them."""
        cuts = piece_starts(buf, offsets)
        start, end = cuts, np.append(cuts[1:], len(buf))
        h, first, back = np.unique(K.span_hashes(buf, start, end, K.BYTE_VALUES), return_index=True, return_inverse=True)
        at = np.searchsorted(self.piece_hash, h)
        known = np.zeros(len(h), bool)
        inside = at < len(self.piece_hash)
        known[inside] = self.piece_hash[at[inside]] == h[inside]
        new = np.flatnonzero(~known)
        if len(new):
            raw = buf.tobytes()
            s, e = start[first[new]].tolist(), end[first[new]].tolist()
            split = self.encode_pieces([raw[a:b] for a, b in zip(s, e)])
            words = self.words
            ids = [[t for w in ws for t in words[w]] for ws in split]
            n = np.array([len(x) for x in ids], np.int64)
            flat = np.fromiter((t for x in ids for t in x), np.uint32, int(n.sum()))
            if len(self.piece_hash) > PIECES_KEPT:  # begin again, with this batch's pieces
                keep = at[known]
                own = self.piece_n[keep]
                index = np.repeat(self.piece_at[keep] - (np.cumsum(own) - own), own) + np.arange(own.sum())
                self.pieces, self.piece_hash, self.piece_n = self.pieces[index], self.piece_hash[keep], own
                self.piece_at = np.cumsum(own) - own
            both = np.concatenate([self.piece_hash, h[new]])
            places = np.concatenate([self.piece_at, len(self.pieces) + np.cumsum(n) - n])
            counts = np.concatenate([self.piece_n, n])
            order = np.argsort(both, kind="stable")
            self.piece_hash, self.piece_at, self.piece_n = both[order], places[order], counts[order]
            self.pieces = np.concatenate([self.pieces, flat])
            at = np.searchsorted(self.piece_hash, h)
        n = self.piece_n[at][back]
        index = np.repeat(self.piece_at[at][back] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        total = np.concatenate([[0], np.cumsum(n)])
        return self.pieces[index], total[np.searchsorted(start, offsets)]

    def forget(self) -> None:
        """Empty the caches; the vocabulary stays."""
        self.words.clear()
        self.piece_hash, self.piece_at, self.piece_n, self.pieces = np.zeros(0, K.U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        parts: list[str] = []
        owner: list[list] = []
        for t in texts:
            t = t or ""
            row: list = []
            if self.cut and (found := list(self.cut.finditer(t))):
                at = 0
                for m in found:
                    row += [len(parts), -1 - self.special[m[0]]]
                    parts.append(t[at : m.start()])
                    at = m.end()
                t = t[at:]
            row.append(len(parts))
            parts.append(t)
            owner.append(row)
        ids = []
        raw = [p.encode() for p in parts]
        begin = 0
        while begin < len(raw):
            end, size = begin, 0
            while end < len(raw) and (end == begin or size + len(raw[end]) <= SLICE):
                size += len(raw[end])
                end += 1
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw[begin:end]])]).astype(np.int64)
            if offsets[-1]:
                flat, rows = self.plain(np.frombuffer(b"".join(raw[begin:end]), np.uint8), offsets)
                ids += [flat[a:b] for a, b in zip(rows[:-1].tolist(), rows[1:].tolist())]
            else:
                ids += [np.zeros(0, np.uint32)] * (end - begin)
            begin = end
        return [ids[r[0]] if len(r) == 1 else np.concatenate([ids[x] if x >= 0 else np.array([-1 - x], np.uint32) for x in r]) for r in owner]

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.lengths[ids]
        return self.arena[np.repeat(self.starts[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes()


def piece_starts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Row starts, and spaces before which no word of the pattern continues.

    Before a space a text may be cut if what precedes isn't white space (a run of it begins here), or if what follows
    isn't (the pattern leaves the run's last space to the next word). Only bytes surely not white space count.
    """
    solid = np.zeros(len(buf) + 1, bool)  # by byte: a whole character other than white space begins here
    solid[:-1] = ((buf > 0x20) & (buf < 0x7F)) | (buf == 0xC3)
    at = np.flatnonzero(buf == 0x20)
    before = np.zeros(len(at), bool)
    one, two = at >= 1, at >= 2
    before[one] = (buf[at[one] - 1] > 0x20) & (buf[at[one] - 1] < 0x7F)
    before[two] |= (buf[at[two] - 2] == 0xC3) & (buf[at[two] - 1] >= 0x80)
    keep = at[before | solid[at + 1]]
    return np.union1d(offsets[:-1][offsets[:-1] < offsets[1:]], keep)


@lru_cache(maxsize=2)
def _load(path: str) -> Bpe:
    return Bpe(path)


@common.lean
def _tokenize(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = _load(path)
    for batch in batches:
        ids = bpe.encode(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string()),
            ],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )
    bpe.forget()


@common.lean
def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = _load(path)
    for batch in batches:
        ids = bpe.encode(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], names=["doc_id", "ids"])
    bpe.forget()


@common.lean
def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = _load(path)
    for batch in batches:
        texts = [bpe.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])


def _kind(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids of every text."""
    common.prepare(docs.sparkSession, 500)
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(partial(_encode, path=path), f"doc_id {_kind(docs)}, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, text from doc_id, ids."""
    common.prepare(tokens.sparkSession, 500)
    return tokens.select("doc_id", "ids").mapInArrow(partial(_decode, path=path), f"doc_id {_kind(tokens)}, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    common.prepare(docs.sparkSession, 500)
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(partial(_tokenize, path=path), f"doc_id {_kind(docs)}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
