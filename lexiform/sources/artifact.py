"""Tokenizer files as data: vocabulary, merges, added tokens."""

from __future__ import annotations

import base64
import hashlib
import json
import re
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ArtifactHashMismatch, ArtifactNotFound
from ..functions import schemes
from ..functions.bpe import byte_alphabet, merge


@dataclass(frozen=True)
class Added:
    id: int
    content: str
    special: bool = False
    single_word: bool = False
    lstrip: bool = False
    rstrip: bool = False
    normalized: bool = False


class Splitter:
    """Cuts a text at added tokens, leftmost and longest first."""

    def __init__(self, added: list[Added]) -> None:
        self.by_text = {a.content: a for a in added if a.content}
        names = sorted(self.by_text, key=len, reverse=True)
        self.rule = re.compile("|".join(map(re.escape, names))) if names else None

    def _alone(self, text: str, start: int, end: int) -> bool:
        word = lambda c: c.isalnum() or c == "_"
        return not (start and word(text[start - 1])) and not (end < len(text) and word(text[end]))

    def split(self, text: str) -> list[tuple[str, int | None]]:
        """(segment, None) or (literal, id), in order."""
        out, at, place = [], 0, 0
        while self.rule and (m := self.rule.search(text, place)):
            t, (start, end) = self.by_text[m.group()], m.span()
            if t.single_word and not self._alone(text, start, end):
                place = start + 1
                continue
            head = text[at:start]
            out += [(head.rstrip() if t.lstrip else head, None), (m.group(), t.id)]
            at = place = end + (len(text[end:]) - len(text[end:].lstrip()) if t.rstrip else 0)
        return [*out, (text[at:], None)]


@dataclass
class Artifact:
    """A byte-level BPE vocabulary. ``vocab``: id to bytes; ``ranks``: pair of ids to (rank, merged id)."""

    vocab: dict[int, bytes]
    ranks: dict[tuple[int, int], tuple[int, int]]
    scheme: str = "gpt2"
    added: list[Added] = field(default_factory=list)
    nfc: bool = False
    prefix_space: bool = False
    ignore_merges: bool = False
    bos: list[int] = field(default_factory=list)
    eos: list[int] = field(default_factory=list)
    sha256: str = ""

    def __post_init__(self):
        if self.vocab and not 0 <= min(self.vocab) <= max(self.vocab) < 2**31:
            raise ValueError("ids must fit in an integer column")
        first: dict[bytes, int] = {}
        for i in sorted(self.vocab):
            first.setdefault(self.vocab[i], i)
        self.whole = first
        self.held: dict = {}  # what a worker keeps beside it
        self.bytes = [first.get(bytes([b]), -1) for b in range(256)]

    def literals(self) -> list[str]:
        return [a.content for a in self.added]

    def surface(self) -> dict[int, bytes]:
        return self.vocab | {a.id: a.content.encode() for a in self.added}

    def unsafe_ranks(self) -> list[tuple[int, int]]:
        """Merges whose rank is below that of a merge that makes one of their parts."""
        made = {}
        for rank, new in self.ranks.values():
            made[new] = min(rank, made.get(new, rank))
        return [p for p, (rank, _) in self.ranks.items() if any(made.get(x, -1) > rank for x in p)]

    def fingerprint(self) -> str:
        """SHA-256 over all that decides ids, in a fixed order."""
        body = {"vocab": sorted((i, b.hex()) for i, b in self.vocab.items()), "ranks": sorted((*p, *r) for p, r in self.ranks.items()), "scheme": self.scheme, "added": [list(vars(a).values()) for a in self.added], "flags": [self.nfc, self.prefix_space, self.ignore_merges], "template": [self.bos, self.eos]}
        return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    def vocab_frame(self, spark: SparkSession) -> DataFrame:
        special = {a.id for a in self.added if a.special}
        return spark.createDataFrame([(i, bytearray(b), i in special) for i, b in sorted(self.surface().items())], "id int, bytes binary, special boolean")

    def merges_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted((r, a, b, m) for (a, b), (r, m) in self.ranks.items()), "rank int, left int, right int, merged int")


def unsafe_frame(merges: DataFrame) -> DataFrame:
    """Merges (rank, left, right, merged) whose rank is below that of the first merge that makes one of their parts."""
    made = merges.groupBy("merged").agg(F.min("rank").alias("made"))
    part = lambda side: made.select(F.col("merged").alias(side), F.col("made").alias(f"{side}_made"))
    held = merges.join(part("left"), "left", "left").join(part("right"), "right", "left")
    return held.filter((F.col("left_made") > F.col("rank")) | (F.col("right_made") > F.col("rank"))).select("rank", "left", "right", "merged")


def byte_artifact(scheme: str = "gpt2", added: list[Added] | None = None) -> Artifact:
    """One token per byte and no merges: any wrong id shows at once."""
    return Artifact({b: bytes([b]) for b in range(256)}, {}, scheme, added or [])


def _bytes(token: str) -> bytes:
    alphabet = byte_alphabet()
    try:
        return bytes(alphabet[c] for c in token)
    except KeyError:
        raise ValueError(f"token outside the byte alphabet: {token!r}") from None


def from_json(data: bytes | str) -> Artifact:
    """A byte-level BPE ``tokenizer.json``. WordPiece, Unigram and unknown parts are refused by name."""
    raw = data.encode() if isinstance(data, str) else data
    j = json.loads(raw)
    model = j["model"]
    kind = model.get("type") or ("BPE" if "merges" in model else "WordPiece" if isinstance(model.get("vocab"), dict) else "Unigram")
    if kind != "BPE":
        raise ValueError(f"unsupported model type: {kind}")
    if model.get("byte_fallback"):
        raise ValueError("byte-fallback models are not byte-level")
    added = [Added(**{k: a[k] for k in Added.__dataclass_fields__ if k in a}) for a in j.get("added_tokens") or []]
    own = {a.content for a in added}
    names = {t: i for t, i in model["vocab"].items() if t not in own}
    vocab = {i: _bytes(t) for t, i in names.items()}
    ranks: dict[tuple[int, int], tuple[int, int]] = {}
    for rank, m in enumerate(model.get("merges") or []):
        a, b = m.split(" ", 1) if isinstance(m, str) else m
        if a in names and b in names and a + b in names:
            ranks.setdefault((names[a], names[b]), (rank, names[a + b]))
    norm = j.get("normalizer")
    parts = norm.get("normalizers", []) if norm and norm["type"] == "Sequence" else [norm] if norm else []
    if any(p["type"] != "NFC" for p in parts):
        raise ValueError("unsupported normalizer")
    pre = j.get("pre_tokenizer") or {"type": "ByteLevel"}
    steps = pre.get("pretokenizers", []) if pre["type"] == "Sequence" else [pre]
    patterns, prefix, regex_on = [], False, False
    for s in steps:
        if s["type"] == "Split":
            patterns.append(s["pattern"].get("Regex") or re.escape(s["pattern"]["String"]))
        elif s["type"] == "ByteLevel":
            prefix, regex_on = bool(s.get("add_prefix_space")), s.get("use_regex", True)
        else:
            raise ValueError(f"unsupported pre-tokenizer: {s['type']}")
    scheme = schemes.by_patterns(patterns) if patterns else "gpt2"
    bos, eos = template(j.get("post_processor"))
    del regex_on  # a bare byte level means the gpt2 pattern
    return Artifact(vocab, ranks, scheme, added, bool(parts), prefix, bool(model.get("ignore_merges")), bos, eos, hashlib.sha256(raw).hexdigest())


def template(post) -> tuple[list[int], list[int]]:
    for p in (post or {}).get("processors", [post] if post else []):
        if p["type"] == "TemplateProcessing":
            ids, out, at = p["special_tokens"], ([], []), 0
            for item in p["single"]:
                if "Sequence" in item:
                    at = 1
                else:
                    out[at].extend(ids[item["SpecialToken"]["id"]]["ids"])
            return out
    return [], []


def from_ranks(data: bytes, scheme: str, special: dict[str, int] | None = None) -> Artifact:
    """``base64 rank`` lines. Merges are rebuilt: a token's last merge joins the two parts that
    earlier merges leave of it."""
    vocab = {int(r): base64.b64decode(t) for t, r in (line.split() for line in data.splitlines() if line.strip())}
    if sorted(vocab) != list(range(len(vocab))):
        raise ValueError("ranks must be dense")
    single = {b[0]: i for i, b in vocab.items() if len(b) == 1}
    ranks: dict[tuple[int, int], tuple[int, int]] = {}
    for i in range(len(vocab)):
        if len(vocab[i]) > 1:
            parts = merge([single[b] for b in vocab[i]], ranks)
            if len(parts) == 2:
                ranks.setdefault((parts[0], parts[1]), (i, i))
    added = [Added(i, t, special=True) for t, i in (special or {}).items()]
    return Artifact(vocab, ranks, schemes.resolve(scheme), added, sha256=hashlib.sha256(data).hexdigest())


def load(spark: SparkSession, path: str, scheme: str | None = None, sha256: str | None = None) -> Artifact:
    """Reads a local or shared file through Spark and checks its digest before parsing."""
    try:
        body = bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])
    except (AnalysisException, TypeError):
        raise ArtifactNotFound("no such artifact", searched=path) from None
    if sha256 and hashlib.sha256(body).hexdigest() != sha256:
        raise ArtifactHashMismatch("artifact digest mismatch", path=path, expected_sha256=sha256, observed_sha256=hashlib.sha256(body).hexdigest())
    if path.endswith(".tiktoken"):
        return from_ranks(body, scheme or "gpt4")
    if json.loads(body)["model"].get("byte_fallback"):
        from . import sentencepiece

        return sentencepiece.from_json(body)
    return from_json(body)
