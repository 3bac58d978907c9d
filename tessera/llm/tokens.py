"""Exact token ids of the tokenizers library, with each distinct piece of text encoded once."""

from __future__ import annotations

import json
import os
import re
from operator import attrgetter

import numpy as np

from .common import trim

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Distinct chunks that a worker remembers; then it starts anew.
CACHE = 600_000

#: A plain word as its tokenizers split it in any case: one white space, letters, then signs. Latin-1 letters only, whose class and case no Unicode version disputes; no apostrophe, which may begin a suffix.
_PLAIN = re.compile("([ \\n]?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")
_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: White space to Python, but not to every regular expression library.
_ODD = "\x1c\x1d\x1e\x1f\x85\u180e\u200b\ufeff"
_ODD_ASCII = _ODD[:4]
#: White space before a space: there, a text can't be cut at its single spaces.
_RUN = re.compile(r"\s ")
_ID = attrgetter("id")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes are themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, n = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(n)
            n += 1
    return [letters[b] for b in range(256)]


class Encoder(dict):
    """Chunk -> its ids as little-endian bytes; a missing chunk is encoded when it is asked for.

    Both byte-level and word-end vocabularies split a text at white space before any
    merge, so that a text's ids are those of its chunks in turn: runs of white space
    with the word that follows for the first, words alone for the second. A text with
    unusual white space is encoded whole, and so is every text if the file's
    pre-tokenizer is of neither kind.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        spec = json.loads(self.tokenizer.to_str())
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        size = self.tokenizer.get_vocab_size()
        #: the bytes of each id
        self.one = [i.to_bytes(self.dtype.itemsize, "little") for i in range(size)]
        self.letters = _byte_letters()
        self.signs: dict[str, bytes] = {}
        self.after_space = _AfterSpace(self)
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        steps = [x.get("type") for x in (norm or {}).get("normalizers", [])]
        inner = [x.get("type") for x in pre.get("pretokenizers", [])]
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            self.chunks, self.lower, self.spaced = re.compile(r"\s*\S+|\s+").findall, False, True
        elif steps == ["NFC", "Replace", "Lowercase"] and inner == ["Split", "ByteLevel"]:
            self.chunks, self.lower, self.spaced = str.split, True, False
        else:
            self.chunks = None

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _merged(self, word: str) -> bytes:
        """The ids of one pre-token."""
        letters = word if word.isascii() and word.isalpha() else "".join([self.letters[b] for b in word.encode()])
        return b"".join(map(self.one.__getitem__, map(_ID, self.model.tokenize(letters))))

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isalpha():
            out = self[chunk] = self._merged(chunk.lower() if self.lower else chunk)
            return out
        m = _PLAIN.fullmatch(chunk)
        if not m:
            out = np.array(self._ids(chunk), self.dtype).tobytes()
        elif m[3]:
            out = self[m[1] + m[2]] + self._signs(m[3])
        elif m[1] == "\n":
            out = self._signs("\n") + self[m[2]]
        else:
            out = self._merged(m[2].lower() if self.lower else chunk)
        self[chunk] = out
        return out

    def _signs(self, text: str) -> bytes:
        if text not in self.signs:
            if len(self.signs) > 10_000:
                self.signs.clear()
            self.signs[text] = self._merged(text)
        return self.signs[text]

    def encode(self, text: str | None) -> bytes:
        """The ids of one text, as bytes of self.dtype. Null is empty."""
        if not text:
            return b""
        if self.chunks is None or any(c in text for c in (_ODD_ASCII if text.isascii() else _ODD)):
            return np.array(self._ids(text), self.dtype).tobytes()
        if len(self) > CACHE:
            self.clear()
        if not self.spaced or text[0] == " " or _RUN.search(text):
            return b"".join(map(self.__getitem__, self.chunks(text)))
        if len(self.after_space) > CACHE:
            self.after_space.clear()
        if "\n" in text and " \n" not in text:
            return self._lines(text)
        first, *others = text.split(" ")
        return b"".join([*map(self.__getitem__, self.chunks(first)), *map(self.after_space.__getitem__, others)])

    def _lines(self, text: str) -> bytes:
        """The same for a text whose lines neither begin nor end with a space: a line's first word goes with the line ends before it."""
        out, gap, after = [], "", self.after_space.__getitem__
        for k, line in enumerate(text.split("\n")):
            if k:
                gap += "\n"
            if line:
                first, *others = line.split(" ")
                known = self.get(gap + first)  # what is remembered is one chunk
                if known is None:
                    out += map(self.__getitem__, self.chunks(gap + first))
                else:
                    out.append(known)
                out += map(after, others)
                gap = ""
        if gap:
            out.append(self[gap])
        return b"".join(out)


class _AfterSpace(dict):
    """What follows a single space -> the ids of both. Texts that hold further white space are not remembered."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder, self.tokenize, self.space, self.one = encoder, encoder.model.tokenize, encoder.letters[32], encoder.one.__getitem__

    def __missing__(self, rest: str) -> bytes:
        if rest.isascii():  # the commonest forms, without a search
            if rest.isalpha():
                out = self[rest] = b"".join(map(self.one, map(_ID, self.tokenize(self.space + rest))))
                return out
            if rest[-1:] in (",", ".") and rest[:-1].isalpha():
                out = self[rest] = self[rest[:-1]] + self.encoder._signs(rest[-1])
                return out
        elif rest.isalpha() and _WORD.fullmatch(rest):
            out = self[rest] = self.encoder._merged(" " + rest)
            return out
        elif rest[-1:] in (",", ".") and _WORD.fullmatch(rest, 0, len(rest) - 1):
            out = self[rest] = self[rest[:-1]] + self.encoder._signs(rest[-1])
            return out
        first, *others = self.encoder.chunks(" " + rest)
        if others:
            return self[first[1:]] + b"".join(map(self.encoder.__getitem__, others))
        m = _PLAIN.fullmatch(first)
        if m and m[3]:
            out = self[m[2]] + self.encoder._signs(m[3])
        elif m:
            out = self.encoder._merged(first)
        else:
            out = np.array(self.encoder._ids(first), self.encoder.dtype).tobytes()
        self[rest] = out
        return out


def rest(enc: Encoder) -> None:
    """Give memory back at the end of a task: Spark keeps more idle workers than tasks run at once, and later stages use them too."""
    enc.clear()
    enc.after_space.clear()
    trim()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file; it lives as long as the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
