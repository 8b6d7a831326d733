"""Fingerprints of what decides ids: canonical JSON and a tagged preimage in which absent and default differ."""

from __future__ import annotations

import hashlib
import json
import struct

# The fields of a semantic fingerprint in the order of their numbers, from 1 on.
FIELDS = ("artifact_sha256", "pipeline_fingerprint", "added_tokens", "oracle_package", "oracle_semantic_id", "add_special_tokens_policy", "normalization_policy", "special_token_extraction_policy", "truncation_policy", "postprocessor_policy", "session_api_version", "store_format_version")
ADDED = ("content", "id", "special", "single_word", "lstrip", "rstrip", "normalized")
SECTIONS = ("decoder", "model", "normalizer", "pre_tokenizer")


def canonical(value) -> str:
    """JSON with keys in UTF-16 order, no spaces and the shortest numbers."""
    if isinstance(value, dict):
        if any(not isinstance(k, str) for k in value):
            raise ValueError("keys must be strings")
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, bool) or value is None or isinstance(value, str):
        if isinstance(value, str):
            value.encode()  # a lone surrogate is no text
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, int):
        if abs(value) > 1 << 53:
            raise ValueError("a number beyond a double's whole range")
        return str(value)
    if isinstance(value, float):
        return _number(value)
    raise ValueError(f"no JSON value: {type(value).__name__}")


def _number(x: float) -> str:
    if x != x or x in (float("inf"), float("-inf")):
        raise ValueError("not a finite number")
    if x == 0:
        return "0"
    sign, x = "-" * (x < 0), abs(x)
    mantissa, _, exponent = repr(x).partition("e")
    whole, _, part = mantissa.partition(".")
    part = "" if part == "0" else part
    digits = (whole + part).lstrip("0")
    point = len(whole) + int(exponent or 0) - (len(whole + part) - len(digits))
    digits = digits.rstrip("0")
    n = len(digits)
    if n <= point <= 21:
        return sign + digits + "0" * (point - n)
    if 0 < point <= 21:
        return f"{sign}{digits[:point]}.{digits[point:]}"
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    e = point - 1
    return f"{sign}{digits[0]}{'.' + digits[1:] if n > 1 else ''}e{'+' if e > 0 else '-'}{abs(e)}"


def _value(v) -> bytes:
    if v is None:
        return b"\0"
    if isinstance(v, bool):
        return b"\1" + bytes([v])
    if isinstance(v, int):
        return b"\1" + struct.pack("<Q", v)
    if isinstance(v, str):
        return b"\1" + v.encode()
    if isinstance(v, bytes):
        return b"\1" + v
    return b"\1" + struct.pack("<I", len(v)) + b"".join(v)


def pipeline(document: dict, tag: bytes = b"lexiform.pipeline.v1\0") -> bytes:
    """Of a ``tokenizer.json`` without its added tokens; a section that is missing counts as null."""
    return hashlib.sha256(tag + canonical({k: document.get(k) for k in SECTIONS}).encode()).digest()


def added(tokens) -> list[bytes]:
    """Each added token's fields, tokens in the order they were declared."""
    return [b"".join(_value(t[k] if isinstance(t, dict) else getattr(t, k)) for k in ADDED) for t in tokens]


def semantic(fields: dict, tag: bytes = b"lexiform.fingerprint.v1\0") -> bytes:
    """Over all fields, each there once; None is told apart from any value."""
    if set(fields) != set(FIELDS):
        raise ValueError("every field is needed, and no other")
    out = bytearray(tag)
    for number, name in enumerate(FIELDS, 1):
        v = _value(fields[name])
        out += struct.pack("<HI", number, len(v)) + v
    return hashlib.sha256(bytes(out)).digest()


def of_file(data: bytes) -> bytes:
    """The semantic fingerprint of a ``tokenizer.json`` under this engine's one policy."""
    document = json.loads(data)
    tokens = [{"special": False, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False} | t for t in document.get("added_tokens") or []]
    policy = dict(zip(FIELDS[3:], ("lexiform", "1", "read_time", "artifact_default", "artifact_default", "none", "read_time", 1, 1), strict=True))
    return semantic({"artifact_sha256": hashlib.sha256(data).digest(), "pipeline_fingerprint": pipeline(document), "added_tokens": added(tokens), **policy})
