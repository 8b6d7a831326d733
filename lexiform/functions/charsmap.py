"""Precompiled character maps of SentencePiece normalizers: a double-array trie and the texts it points to."""

from __future__ import annotations

import struct

import numpy as np
import regex

_GRAPHEME = regex.compile(r"\X")
#: Graphemes of more bytes are mapped character by character.
LONG = 6


class CharsMap:
    """The blob: the trie's size in bytes (u32), its units (u32), then NUL-ended texts, all little-endian."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0]
        if len(blob) < 4 + size or size % 4:
            raise ValueError("truncated character map")
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.texts = blob[4 + size :]
        self.memo: dict[str, str] = {}

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def find(self, key: bytes) -> str | None:
        """The text of the shortest beginning of ``key`` that the trie knows."""
        at = self._offset(self.units[0])
        for b in key:
            at ^= b
            if not b or at >= len(self.units):
                return None
            unit = self.units[at]
            if unit & 0x800000FF != b:
                return None
            at ^= self._offset(unit)
            if unit >> 8 & 1:
                start = self.units[at] & 0x7FFFFFFF
                return self.texts[start : self.texts.index(b"\0", start)].decode()
        return None

    def _map(self, grapheme: str) -> str:
        key = grapheme.encode()
        whole = self.find(key) if len(key) < LONG else None
        if whole is not None:
            return whole
        return "".join(c if (t := self.find(c.encode())) is None else t for c in grapheme)

    def normalize(self, text: str) -> str:
        out = []
        for g in _GRAPHEME.findall(text):
            t = self.memo.get(g)
            if t is None:
                t = self._map(g)
                if len(self.memo) < 100_000 and len(g) < 16:
                    self.memo[g] = t
            out.append(t)
        return "".join(out)
