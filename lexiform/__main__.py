"""``python -m lexiform``: inspect a vocabulary, verify a file, convert a rank file, say what is installed."""

from __future__ import annotations

import argparse
import hashlib
import importlib.metadata
import json
import sys

from .errors import ArtifactHashMismatch, ArtifactNotFound, LexiformError
from .sources import artifact, convert, sentencepiece


def _read(path: str) -> bytes:
    try:
        with open(path, "rb") as f:
            return f.read()
    except OSError:
        raise ArtifactNotFound("no such file", searched=path) from None


def _parse(path: str, scheme: str):
    data = _read(path)
    if path.endswith(".tiktoken"):
        return artifact.from_ranks(data, scheme)
    return sentencepiece.from_json(data) if json.loads(data)["model"].get("byte_fallback") else artifact.from_json(data)


def inspect(a) -> dict:
    a_ = _parse(a.path, a.scheme)
    out = {"kind": type(a_).__name__, "vocab": len(a_.vocab), "merges": len(a_.ranks), "added": len(a_.added), "sha256": a_.sha256}
    if isinstance(a_, artifact.Artifact):
        out |= {"scheme": a_.scheme, "unsafe_ranks": len(a_.unsafe_ranks()), "fingerprint": a_.fingerprint()}
    return out


def verify(a) -> dict:
    got = hashlib.sha256(_read(a.path)).hexdigest()
    if got != a.sha256:
        raise ArtifactHashMismatch("the file holds other content", path=a.path, expected_sha256=a.sha256, observed_sha256=got)
    return {"path": a.path, "sha256": got, "ok": True}


def to_json(a) -> dict:
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("lexiform convert").getOrCreate()
    body = convert.to_json(convert.rank_frame(spark, _read(a.path)), a.scheme)
    with open(a.out, "w", encoding="utf-8") as f:
        f.write(body)
    return {"out": a.out, "sha256": hashlib.sha256(body.encode()).hexdigest()}


def doctor(a) -> dict:
    def version(name):
        try:
            return importlib.metadata.version(name)
        except importlib.metadata.PackageNotFoundError:
            return None

    return {"python": sys.version.split()[0]} | {n: version(n) for n in ("pyspark", "pyarrow", "pandas", "numpy", "regex")}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lexiform")
    sub = p.add_subparsers(required=True)
    for name, f in (("inspect", inspect), ("verify", verify), ("convert", to_json), ("doctor", doctor)):
        s = sub.add_parser(name)
        s.set_defaults(run=f)
        if f is not doctor:
            s.add_argument("path")
            s.add_argument("--scheme", default="gpt2")
        if f is verify:
            s.add_argument("sha256")
        if f is to_json:
            s.add_argument("out")
    try:
        a = p.parse_args(argv)
    except SystemExit as e:
        return 64 if e.code else 0
    try:
        print(json.dumps(a.run(a)))
        return 0
    except LexiformError as e:
        print(json.dumps(e.report()), file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
