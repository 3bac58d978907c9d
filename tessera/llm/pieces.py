"""SentencePiece encoding by batched Viterbi, and decoding.

The words of many texts are encoded together: distinct words of equal length advance
one character at a time as one matrix. Hashes of all substrings that end there probe the
sorted hashes of the pieces of each length, and a vectorised maximum over the candidate
starts stores the back-pointers. Long words, such as texts without spaces, are matched at
all their positions at once instead, and only the maxima are taken one by one. A word is a run of meta spaces and the characters up to
the next; no piece reaches across, so that each word has its own best path.
"""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, small, trim
from .packing import default_tokenizer
from .rewrites import Rewrites

SPACE = "▁"
#: Below the least score: what an unknown character costs (the library's constant).
UNKNOWN_PENALTY = 10.0
#: Distinct words that a worker remembers; then it starts anew.
CACHE = 500_000
#: Longer words are matched at all positions at once.
LONG = 64
_BASE = np.uint64(0x9E3779B97F4A7C15)

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(data: bytes):
    """(number, value) of a protocol buffer message: ints, and bytes for the others."""
    i = 0

    def varint():
        nonlocal i
        x = shift = 0
        while True:
            b = data[i]
            i += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while i < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = varint() if key & 7 == 2 else 8 if key & 7 == 1 else 4
            yield key >> 3, data[i : i + n]
            i += n


class Pieces:
    """A model file's pieces, and the words encoded so far."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        self.text, self.score, self.kind = [], [], []
        self.dummy_prefix, self.squeeze, self.rewrites = True, True, None
        for number, value in fields(raw):
            if number == 1:
                own = dict(fields(value))
                self.text.append(own.get(1, b"").decode())
                self.score.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.kind.append(own.get(3, NORMAL))
            elif number == 3:
                own = dict(fields(value))
                self.dummy_prefix, self.squeeze = bool(own.get(3, 1)), bool(own.get(4, 1))
                if own.get(2):
                    self.rewrites = Rewrites(own[2])
        self.unknown = self.kind.index(UNKNOWN)
        self.bytes = {int(t[1:-1], 16): i for i, t in enumerate(self.text) if self.kind[i] == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        usable = [i for i, k in enumerate(self.kind) if k in (NORMAL, USER)]
        if any(SPACE in self.text[i].lstrip(SPACE) for i in usable):
            raise ValueError("pieces that reach across words are not supported")
        plain = [self.score[i] for i in usable if self.kind[i] == NORMAL]
        self.unknown_score = min(plain) - UNKNOWN_PENALTY
        for i in usable:  # pieces that the user defined have a bonus (the library's rule)
            if self.kind[i] == USER:
                self.score[i] = len(self.text[i]) * max(plain) - 0.1
        silent = (CONTROL, UNUSED)
        #: what each id decodes to
        self.spelled = [b"" if k in silent else bytes([self.byte_of[i]]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else t.replace(SPACE, " ").encode() for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True))]
        self.tables = {}
        for n in sorted({len(self.text[i]) for i in usable}):
            ids = np.array([i for i in usable if len(self.text[i]) == n])
            codes = np.array([[ord(c) for c in self.text[i]] for i in ids], np.uint64)
            h = np.zeros(len(ids), np.uint64)
            for k in range(n):
                h = h * _BASE + codes[:, k] + np.uint64(1)
            h = mix64(h)
            order = np.argsort(h)
            if len(np.unique(h)) < len(h):
                raise ValueError("two pieces share a hash")
            self.tables[n] = (h[order], ids[order], np.array([self.score[i] for i in ids])[order], codes[order])
        self.words: dict[str, bytes] = {}

    def _viterbi(self, words: list[str]) -> list[bytes]:
        """Ids of words of one length, as little-endian 32-bit integers: whole columns advance together."""
        n, m = len(words), len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(n, m).astype(np.uint64)
        prefix = np.zeros((m + 1, n), np.uint64)
        for k in range(m):
            prefix[k + 1] = prefix[k] * _BASE + codes[:, k] + np.uint64(1)
        best = np.full((m + 1, n), -np.inf)
        best[0] = 0
        back, piece = np.zeros((m + 1, n), np.int64), np.zeros((m + 1, n), np.int64)
        for end in range(1, m + 1):
            # longer pieces first: of equal sums the one with the earliest start stays
            for size, (hashes, ids, scores, spelt) in reversed(self.tables.items()):
                if size > end:
                    continue
                start = end - size
                h = mix64(prefix[end] - prefix[start] * np.uint64(pow(int(_BASE), size, 1 << 64)))
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                hit = np.flatnonzero(hashes[at] == h)
                hit = hit[(spelt[at[hit]] == codes[hit, start:end]).all(axis=1)]
                total = best[start, hit] + scores[at[hit]]
                better = total > best[end, hit]
                hit, total = hit[better], total[better]
                best[end, hit], back[end, hit], piece[end, hit] = total, start, ids[at[hit]]
                if size == 1:
                    known = np.zeros(n, bool)
                    known[np.flatnonzero(hashes[at] == h)] = True
            # a character that is no piece of its own may stand as unknown
            if 1 in self.tables:
                lone = np.flatnonzero(~known)
            else:
                lone = np.arange(n)
            total = best[end - 1, lone] + self.unknown_score
            better = total > best[end, lone]
            lone, total = lone[better], total[better]
            best[end, lone], back[end, lone], piece[end, lone] = total, end - 1, self.unknown
        # walk all paths back at once
        at, out = np.full(n, m), []
        while (at > 0).any():
            rows = np.arange(n)
            now = np.where(at > 0, piece[at, rows], -1)
            out.append((now, np.where(at > 0, back[at, rows], 0), at.copy()))
            at = np.where(at > 0, back[at, rows], 0)
        stacked = np.stack([o[0] for o in out[::-1]], axis=1)
        keep = stacked >= 0
        flat, ends = stacked[keep].astype("<u4").tobytes(), (4 * np.cumsum(keep.sum(axis=1))).tolist()
        found = [flat[s:t] for s, t in zip([0, *ends[:-1]], ends, strict=True)]
        lost = np.flatnonzero((stacked == self.unknown).any(axis=1))
        if len(lost):
            starts = np.stack([o[1] for o in out[::-1]], axis=1)
            for r in lost.tolist():
                found[r] = self._spelled_out(words[r], stacked[r][keep[r]], starts[r][keep[r]])
        return found

    def _one(self, word: str) -> bytes:
        """Ids of one long word: every piece is looked up at all positions together, then the best path is taken along the hits."""
        m = len(word)
        codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        known, found = np.zeros(m, bool), []
        for size, (hashes, ids, scores, spelt) in self.tables.items():
            if size > m:
                continue
            h = np.zeros(m - size + 1, np.uint64)
            for k in range(size):
                h = h * _BASE + codes[k : m - size + 1 + k] + np.uint64(1)
            h = mix64(h)
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            start = np.flatnonzero(hashes[at] == h)
            for k in range(size):
                start = start[spelt[at[start], k] == codes[start + k]]
            found.append((start + size, start, scores[at[start]], ids[at[start]]))
            if size == 1:
                known[start] = True
        lone = np.flatnonzero(~known)
        found.append((lone + 1, lone, np.full(len(lone), self.unknown_score), np.full(len(lone), self.unknown)))
        end, start, score, piece = (np.concatenate([f[k] for f in found]) for k in range(4))
        order = np.lexsort((start, end))  # of equal sums the earliest start stays
        edge = np.searchsorted(end[order], np.arange(m + 2)).tolist()
        start, score, piece = start[order].tolist(), score[order].tolist(), piece[order].tolist()
        best, back = [0.0] * (m + 1), [0] * (m + 1)
        for e in range(1, m + 1):
            top, at = -np.inf, -1
            for k in range(edge[e], edge[e + 1]):
                total = best[start[k]] + score[k]
                if total > top:
                    top, at = total, k
            best[e], back[e] = top, at
        path, e = [], m
        while e > 0:
            path.append(back[e])
            e = start[back[e]]
        path.reverse()
        ids = np.array([piece[k] for k in path])
        return self._spelled_out(word, ids, np.array([start[k] for k in path])) if (ids == self.unknown).any() else ids.astype("<u4").tobytes()

    def _spelled_out(self, word: str, ids: np.ndarray, starts: np.ndarray) -> bytes:
        """Unknown characters as their bytes, or a run of them as one unknown where the model has no bytes."""
        lost = ids == self.unknown
        if self.bytes:
            out = []
            for i, s in zip(ids.tolist(), starts.tolist(), strict=True):
                out += [self.bytes[b] for b in word[s].encode("utf-8", "replace")] if i == self.unknown else [i]
            ids = np.array(out)
        else:
            ids = ids[~(lost & np.concatenate([[False], lost[:-1]]))]
        return ids.astype("<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        """Encode the words not yet known, by length; a length's words in parts of bounded size."""
        if len(self.words) > CACHE:
            self.words.clear()
        new: dict[int, list[str]] = {}
        for w in words:
            if w in self.words:
                continue
            if len(w) > LONG:
                self.words[w] = self._one(w)
            else:
                new.setdefault(len(w), []).append(w)
        for m, group in new.items():
            step = max(1, (1 << 18) // m)
            for s in range(0, len(group), step):
                part = group[s : s + step]
                self.words.update(zip(part, self._viterbi(part), strict=True))

    def prepared(self, text: str | None) -> list[str]:
        """A text's words: characters are rewritten as the model's table says, spaces become meta spaces, one is put in front, and each word begins with its run of them."""
        text = text or ""
        if self.rewrites:
            text = self.rewrites(text)
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return []
        text = ((" " if self.dummy_prefix else "") + text).replace(" ", SPACE)
        out, parts = [], text.split(SPACE)
        if parts[0]:
            out.append(parts[0])
        lead = ""
        for p in parts[1:]:
            lead += SPACE
            if p:
                out.append(lead + p)
                lead = ""
        if lead:
            out.append(lead)
        return out

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        lists = [self.prepared(t) for t in texts]
        self.learn({w for ws in lists for w in ws})
        known = self.words.__getitem__
        return [np.frombuffer(b"".join(map(known, ws)), "<u4") for ws in lists]

    def decode(self, ids) -> str:
        """The text of ids: bytes join into characters, one leading space goes, control pieces are silent."""
        text = b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


_LOADED: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """This worker's copy of a model."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) for every row of docs. Null and empty texts have no ids."""

    def run(batches):
        p = pieces(os.fspath(model))
        for b in small(batches, 1024):
            ids = p.encode_all(b.column(1).to_pylist())
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = pa.array(np.concatenate(ids).astype(np.int32) if len(ids) else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["doc_id", "ids"])
        p.words.clear()
        trim()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give null."""

    def run(batches):
        p = pieces(os.fspath(model))
        for b in small(batches, 1024):
            text = [None if x is None else p.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, restored) for every row of docs: the crc32 of the ids as little-endian unsigned 32-bit
    integers, and whether decoding them gives the text back. Null and empty texts have no ids and are restored."""

    def run(batches):
        p = pieces(os.fspath(model))
        for b in small(batches, 1024):
            texts = b.column(1).to_pylist()
            ids = p.encode_all(texts)
            crc, restored = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids], [p.decode(x.tolist()) == (t or "") for x, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(crc, pa.int64()), pa.array(restored, pa.bool_())], names=["doc_id", "n_tokens", "ids_crc32", "restored"])
        p.words.clear()
        trim()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, restored boolean")


def op10_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the crc32 of the ids, and whether they decode to the text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(docs, default_tokenizer("piece_bpe_32k.model"))
