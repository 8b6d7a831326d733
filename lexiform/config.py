"""Settings, read once: an argument goes before the session's, that before a file's, that before the default.

No setting can change ids.
"""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession

from .errors import ConfigInvalid
from .plans.routing import THRESHOLD, Policy

PREFIX = "spark.lexiform."


@dataclass(frozen=True)
class Config:
    policy: Policy = Policy.CERTIFIED
    threshold: int = THRESHOLD
    spread_chars: int = 1 << 16
    batch_bytes: int = 16 << 20
    max_sessions: int = 1024
    diagnostics: bool = False

    def with_(self, **values) -> Config:
        return replace(self, **{k: parse(k, v, "argument") for k, v in values.items()})


def parse(name: str, value, source: str):
    kinds = {f.name: type(f.default) for f in fields(Config)}
    if name not in kinds:
        raise ConfigInvalid("unknown setting", field=name, source=source)
    kind = kinds[name]
    try:
        if kind is Policy:
            return value if isinstance(value, Policy) else Policy("certified" if value == "auto" else value)
        if kind is bool:
            return value if isinstance(value, bool) else {"1": True, "true": True, "yes": True, "on": True, "0": False, "false": False, "no": False, "off": False}[str(value).lower()]
        if isinstance(value, bool) or int(value) <= 0:
            raise ValueError
        return int(value)
    except (KeyError, ValueError, TypeError):
        raise ConfigInvalid("a value that can't be read", field=name, value=value, source=source) from None


def load(spark: SparkSession | None = None, path: str | None = None, **arguments) -> Config:
    found: dict = {}
    if path:
        try:
            with open(path, "rb") as f:
                found |= {k: parse(k, v, path) for k, v in tomllib.load(f).items()}
        except (OSError, tomllib.TOMLDecodeError) as e:
            raise ConfigInvalid("a file that can't be read", source=path, cause=repr(e)) from None
    if spark is not None:
        for f in fields(Config):
            value = spark.conf.get(PREFIX + f.name, None)
            if value is not None:
                found[f.name] = parse(f.name, value, "session")
    return Config(**(found | {k: parse(k, v, "argument") for k, v in arguments.items()}))
