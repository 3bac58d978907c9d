"""Character rewrites of a SentencePiece model: a table of byte sequences and what stands for them.

The table is a double-array trie of 32-bit units before a block of strings that end in
zeros. At each place the longest sequence that the trie knows is replaced; other
characters stay.
"""

from __future__ import annotations

import re
import struct

import numpy as np


class Rewrites:
    def __init__(self, table: bytes):
        (size,) = struct.unpack_from("<I", table)
        self.units = np.frombuffer(table, "<u4", size // 4, 4).tolist()
        self.strings = table[4 + size :]
        alone = [b for b in range(128) if self._longest(bytes([b]), 0) is None]
        # runs of characters that stay as they are; the last one may combine with what follows
        self.plain = re.compile(b"[" + re.escape(bytes(alone)) + b"]+") if alone and not self._pairs(alone) else None

    def _child(self, node: int, byte: int) -> int | None:
        """The node that a byte leads to from a node's first child."""
        at = node ^ byte
        if at >= len(self.units) or self.units[at] & 0x800000FF != byte:
            return None
        return at

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def _pairs(self, alone: list[int]) -> bool:
        """Whether any two plain characters begin a sequence of the table."""
        for a in alone:
            first = self._child(self._offset(self.units[0]), a)
            if first is None:
                continue
            below = first ^ self._offset(self.units[first])
            if any(self._child(below, b) is not None for b in alone):
                return True
        return False

    def _longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(length, replacement) of the longest known sequence at a place."""
        node, best = self._offset(self.units[0]), None
        for k in range(at, len(data)):
            own = self._child(node, data[k])
            if own is None:
                break
            unit = self.units[own]
            node = own ^ self._offset(unit)
            if unit & 0x100:
                best = (k + 1 - at, self.units[node] & 0x7FFFFFFF)
        if best is None:
            return None
        start = best[1]
        return best[0], self.strings[start : self.strings.index(b"\0", start)]

    def __call__(self, text: str) -> str:
        data, out, i = text.encode("utf-8", "replace"), [], 0
        while i < len(data):
            if self.plain and (m := self.plain.match(data, i)):
                end = m.end() if m.end() == len(data) else m.end() - 1
                if end > i:
                    out.append(data[i:end])
                    i = end
                    continue
            found = self._longest(data, i)
            if found:
                out.append(found[1])
                i += found[0]
            else:
                b = data[i]
                n = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                out.append(data[i : i + n])
                i += n
        return b"".join(out).decode("utf-8", "replace")
