"""Normalizers and predicates on text, as Catalyst expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "▁"


def collapse_spaces(c: Column) -> Column:
    return F.regexp_replace(c, " {2,}", " ")


def strip(c: Column, left: bool = True, right: bool = True) -> Column:
    ends = [r"^\s+"] * left + [r"\s+\z"] * right
    return F.regexp_replace(c, "(?U)" + "|".join(ends), "") if ends else c


def prepend(c: Column, prefix: str) -> Column:
    return F.when(c == "", c).otherwise(F.concat(F.lit(prefix), c))


def metaspace(c: Column, prepend_scheme: str = "always") -> Column:
    """Spaces to marks, with a leading mark unless there is one: never, always or first (the text's first chunk)."""
    if prepend_scheme not in ("never", "always", "first"):
        raise ValueError(prepend_scheme)
    out = F.translate(c, " ", MARK)
    return out if prepend_scheme == "never" else F.when((out == "") | out.startswith(MARK), out).otherwise(F.concat(F.lit(MARK), out))


def add_prefix_space(c: Column) -> Column:
    return F.when((c == "") | c.startswith(" "), c).otherwise(F.concat(F.lit(" "), c))


def may_hold(c: Column, literals: list[str]) -> Column:
    """False proves that no literal occurs; checked before any exact work."""
    if not literals:
        return F.lit(False)
    return c.rlike("|".join(re.escape(x) for x in sorted(literals, key=len, reverse=True)))


def over(c: Column, threshold: int) -> Column:
    """Whether the text has at least so many UTF-8 bytes."""
    return F.octet_length(c) >= threshold


def valid(c: Column) -> Column:
    """Whether bytes are a text; what isn't goes to the reference path."""
    return F.is_valid_utf8(c.cast("string"))
