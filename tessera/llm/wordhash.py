"""Vectorised words and rolling hashes over the UTF-8 bytes of many texts at once."""

from __future__ import annotations

import hashlib

import numpy as np

from .common import mix64, trim

_LONG_WORD = 256


class _Powers:
    """base**i and base**-i modulo 2**64, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])
        return self.up[:n], self.down[:n]


def rest() -> None:
    """Forget the powers and give memory back, at the end of a task."""
    for p in (*_BYTES, *_WORDS):
        p.up = p.down = np.ones(1, np.uint64)
    trim()


_BYTES = (_Powers(0x9E3779B97F4A7C15), _Powers(0xC2B2AE3D27D4EB4F))
_WORDS = (_Powers(0xD6E8FEB86659FD93), _Powers(0xA0761D6478BD642F))


class Words:
    """The words of a list of texts, in order: start and end byte in data, and the text each belongs to."""

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join(texts)
        buf = np.frombuffer(self.data, np.uint8)
        text_at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        solid = np.zeros(len(buf) + 2, np.int8)
        np.not_equal((buf == 32) | ((buf >= 9) & (buf <= 13)), True, out=solid[1:-1].view(np.bool_))
        edge = np.diff(solid)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        #: text t has words first[t] to first[t + 1]
        self.first = np.searchsorted(self.start, text_at)
        self.first[-1] = len(self.start)
        self.n = np.diff(self.first)
        self.text = np.repeat(np.arange(len(texts)), self.n)
        self.buf = buf

    def hashes(self, k: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; k chooses one of two independent ones."""
        up, down = _BYTES[k].get(max(1, len(self.buf)))
        total = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * up[: len(self.buf)], out=total[1:])
        size = (self.end - self.start).astype(np.uint64)
        h = (total[self.end] - total[self.start]) * down[self.start]
        h = mix64(h + size * np.uint64(0xFF51AFD7ED558CCD))
        for i in np.flatnonzero(size > _LONG_WORD):  # a polynomial modulo 2**64 is weak on long, self-similar strings
            digest = hashlib.blake2b(self.data[self.start[i] : self.end[i]], digest_size=16).digest()
            h[i] = np.frombuffer(digest, np.uint64)[k]
        return h

    def windows(self, size: int, word_hash: np.ndarray, k: int = 0) -> np.ndarray:
        """A 64-bit hash of words i to i + size - 1 for each i; only those that stay within a text mean anything."""
        n = len(word_hash)
        if n < size:
            return np.zeros(0, np.uint64)
        up, down = _WORDS[k].get(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(word_hash * up, out=total[1:])
        return mix64((total[size:] - total[:-size]) * down[: n - size + 1])

    def within(self, size: int) -> np.ndarray:
        """The starts of windows that stay within a text."""
        if len(self.text) < size:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.text[size - 1 :] == self.text[: len(self.text) - size + 1])


def put_varints(x: np.ndarray) -> bytes:
    """Non-negative integers below 2**35 as LEB128 bytes."""
    x = x.astype(np.uint64)
    size = 1 + sum((x >= np.uint64(1 << s)).astype(np.int64) for s in (7, 14, 21, 28))
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(5):
        has = size > k
        byte = (x[has] >> np.uint64(7 * k)) & np.uint64(127)
        out[at[has] + k] = byte.astype(np.uint8) | ((size[has] > k + 1).astype(np.uint8) << 7)
    return out.tobytes()


def get_varints(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    out = np.zeros(len(first), np.int64)
    for k in range(5):
        at = first + k
        has = at <= last
        out[has] |= (raw[at[has]].astype(np.int64) & 127) << (7 * k)
    return out
