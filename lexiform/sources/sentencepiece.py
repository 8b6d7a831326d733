"""Byte-fallback BPE models of ``tokenizer.json``: characters and ``<0xHH>`` bytes under ranked merges."""

from __future__ import annotations

import base64
import hashlib
import json
import re
from dataclasses import dataclass, field

from ..functions.bpe import merge
from ..functions.charsmap import CharsMap
from ..functions.text import MARK
from .artifact import Added, Splitter, template

#: Distinct units whose ids are kept.
MEMO = 200_000
_BYTE = re.compile(r"<0x([0-9A-F]{2})>\Z")


@dataclass
class PieceArtifact:
    """``steps``: normalizers in order, as (kind, arguments). ``prepend``: never, always or first.

    Added tokens are cut out in two passes: those for the raw text, then, in what is left and
    normalized, those marked as normalized. What is cut out isn't normalized again.
    """

    vocab: dict[str, int]
    ranks: dict[tuple[int, int], tuple[int, int]]
    steps: list[tuple] = field(default_factory=list)
    prepend: str = "never"
    ignore_merges: bool = False
    metaspace: bool = False
    added: list[Added] = field(default_factory=list)
    bos: list[int] = field(default_factory=list)
    eos: list[int] = field(default_factory=list)
    sha256: str = ""

    def __post_init__(self):
        self.raw_added = Splitter([a for a in self.added if not a.normalized])
        self.late_added = Splitter([Added(**vars(a) | {"content": self._plain(a.content)}) for a in self.added if a.normalized])
        self.names: dict[int, str] = {i: t for t, i in self.vocab.items()}
        self.byte = {int(m[1], 16): i for t, i in self.vocab.items() if (m := _BYTE.match(t))}
        self.raw = {i: b for b, i in self.byte.items()}
        self.special = {a.id for a in self.added if a.special}
        self.memo: dict[str, tuple[int, ...]] = {}
        plain = {i: t.replace(MARK, " ").encode() for i, t in self.names.items()} | {i: bytes([b]) for i, b in self.raw.items()}
        self.surface = plain | {a.id: a.content.replace(MARK, " ").encode() for a in self.added if a.id not in self.raw}
        # A text can be cut before a mark if no merge joins a mark to what stands before it.
        self.cuts = not any(MARK in t.lstrip(MARK) for t in self.vocab if not _BYTE.match(t))

    def _plain(self, text: str) -> str:
        """The normalizers alone, without the marks of the pre-tokenizer."""
        for kind, *args in self.steps:
            if kind == "map":
                text = args[0].normalize(text)
            elif kind == "replace":
                text = text.replace(*args)
            elif kind == "collapse":
                text = re.sub(" {2,}", args[0], text)
            elif kind == "prepend":
                text = args[0] + text if text else text
            elif kind == "strip":
                text = text.lstrip() if args[0] else text
                text = text.rstrip() if args[1] else text
        return text

    def _marked(self, text: str, first: bool) -> str:
        if not self.metaspace:
            return text
        text = text.replace(" ", MARK)
        wanted = self.prepend == "always" or (self.prepend == "first" and first)
        return MARK + text if wanted and text and not text.startswith(MARK) else text

    def normalize(self, text: str) -> str:
        return self._marked(self._plain(text), True)

    def units(self, text: str) -> list[str]:
        """Parts of a normalized text that can be encoded alone; the whole text where that isn't certain."""
        return re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", text) if self.cuts else [text] if text else []

    def unit(self, unit: str) -> tuple[int, ...]:
        ids = self.memo.get(unit)
        if ids is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            ids = self.memo[unit] = tuple(self._unit(unit))
        return ids

    def _unit(self, unit: str) -> list[int]:
        if self.ignore_merges and unit in self.vocab:
            return [self.vocab[unit]]
        ids: list[int] = []
        for c in unit:
            if c in self.vocab:
                ids.append(self.vocab[c])
            else:  # bytes that the vocabulary lacks are dropped
                ids += [self.byte[b] for b in c.encode() if b in self.byte]
        return merge(ids, self.ranks)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        begun = False
        for part, token in self.raw_added.split(text):
            if token is not None:
                out.append(token)
                begun = True
                continue
            for piece, late in self.late_added.split(self._plain(part)) if part else ():
                if late is not None:
                    out.append(late)
                elif piece:
                    for u in self.units(self._marked(piece, not begun)):
                        out += self.unit(u)
                begun = True
        return out

    def cut(self, text: str) -> int:
        """Normalizers may look over any place, so that a session's text is never cut."""
        return 0

    def told(self, data: bytes) -> str:
        """Text of decoded bytes, without the space that encoding put in front."""
        text = data.decode("utf-8", "replace")
        added = self.prepend != "never" or any(k == "prepend" for k, *_ in self.steps)
        return text[1:] if added and text.startswith(" ") else text

    def decode(self, ids: list[int], skip_special: bool = False) -> str:
        return self.told(b"".join(self.surface[i] for i in ids if not (skip_special and i in self.special)))


def from_json(data: bytes | str) -> PieceArtifact:
    j = json.loads(data)
    model = j["model"]
    if model.get("type", "BPE") != "BPE" or not model.get("byte_fallback"):
        raise ValueError("not a byte-fallback BPE model")
    vocab = model["vocab"]
    ranks: dict[tuple[int, int], tuple[int, int]] = {}
    for rank, m in enumerate(model.get("merges") or []):
        a, b = m.split(" ", 1) if isinstance(m, str) else m
        if a in vocab and b in vocab and a + b in vocab:
            ranks.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
    norm = j.get("normalizer")
    steps = []
    for p in norm.get("normalizers", []) if norm and norm["type"] == "Sequence" else [norm] if norm else []:
        pattern = p.get("pattern", {})
        if p["type"] == "Replace" and "String" in pattern:
            steps.append(("replace", pattern["String"], p["content"]))
        elif p["type"] == "Replace" and pattern.get("Regex") == " {2,}":
            steps.append(("collapse", p["content"]))
        elif p["type"] == "Prepend":
            steps.append(("prepend", p["prepend"]))
        elif p["type"] == "Precompiled" and p.get("precompiled_charsmap"):
            steps.append(("map", CharsMap(base64.b64decode(p["precompiled_charsmap"]))))
        elif p["type"] == "Strip":
            steps.append(("strip", p["strip_left"], p["strip_right"]))
        else:
            raise ValueError(f"unsupported normalizer: {p['type']}")
    pre = j.get("pre_tokenizer")
    if pre and pre["type"] != "Metaspace":
        raise ValueError(f"unsupported pre-tokenizer: {pre['type']}")
    prepend = (pre.get("prepend_scheme") or ("always" if pre.get("add_prefix_space", True) else "never")) if pre else "never"
    added = [Added(**{k: a[k] for k in Added.__dataclass_fields__ if k in a}) for a in j.get("added_tokens") or []]
    bos, eos = template(j.get("post_processor"))
    raw = data.encode() if isinstance(data, str) else data
    return PieceArtifact(vocab, ranks, steps, prepend, bool(model.get("ignore_merges")), bool(pre), added, bos, eos, hashlib.sha256(raw).hexdigest())
