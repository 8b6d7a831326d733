"""Pre-tokenization schemes as Catalyst expressions."""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published split patterns by which tokenizer files name their schemes.
GPT2 = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
GPT4 = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"
GPT4_POSSESSIVE = r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}++|\p{N}{1,3}+| ?[^\s\p{L}\p{N}]++[\r\n]*+|\s++$|\s*[\r\n]|\s+(?!\S)|\s+"
QWEN2 = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
QWEN35 = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?[\p{L}\p{M}]+|\p{N}| ?[^\s\p{L}\p{M}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
OLMO3 = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
O200K = r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+(?i:'s|'t|'re|'ve|'m|'ll|'d)?|[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*(?i:'s|'t|'re|'ve|'m|'ll|'d)?|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n/]*|\s*[\r\n]+|\s+(?!\S)|\s+"
NEMOTRON = r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+|[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*|\p{N}| ?[^\s\p{L}\p{N}]+[\r\n/]*|\s*[\r\n]+|\s+(?!\S)|\s+"
KIMI = r"[\p{Han}]+|[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}&&[^\p{Han}]]*[\p{Ll}\p{Lm}\p{Lo}\p{M}&&[^\p{Han}]]+(?i:'s|'t|'re|'ve|'m|'ll|'d)?|[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}&&[^\p{Han}]]+[\p{Ll}\p{Lm}\p{Lo}\p{M}&&[^\p{Han}]]*(?i:'s|'t|'re|'ve|'m|'ll|'d)?|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
DEEPSEEK = (
    r"\p{N}{1,3}",
    "[一-龥぀-ゟ゠-ヿ]+",
    "[!\"#$%&'()*+,\\-./:;<=>?@\\[\\\\\\]^_`{|}~][A-Za-z]+|[^\r\n\\p{L}\\p{P}\\p{S}]?[\\p{L}\\p{M}]+| ?[\\p{P}\\p{S}]+[\r\n]*|\\s*[\r\n]+|\\s+(?!\\S)|\\s+",
)

LAGUNA = (r"(?:\r?\n)+(?:(?!\r?\n)[\s\S])*", QWEN2)  # a run of line ends begins a segment; segments are split alone
# Where a run of line ends begins. The JVM's matcher would recurse for each repetition of a group, so it cuts here instead.
_RUN_BEGINS = r"(?<!\n)(?=\r\n)|(?<![\r\n])(?=\n)"

SCHEMES: dict[str, tuple[str, ...]] = {"gpt2": (GPT2,), "gpt4": (GPT4,), "qwen2": (QWEN2,), "qwen35": (QWEN35,), "olmo3": (OLMO3,), "o200k": (O200K,), "nemotron": (NEMOTRON,), "kimi": (KIMI,), "deepseek_v3": DEEPSEEK, "laguna": LAGUNA}
ALIASES = {"r50k": "gpt2", "cl100k": "gpt4", "qwen3": "qwen2", "none": "gpt2"}


def resolve(name: str) -> str:
    name = ALIASES.get(name, name)
    if name not in SCHEMES:
        raise ValueError(f"unknown scheme: {name}")
    return name


def by_patterns(patterns: list[str]) -> str:
    """The scheme that split patterns of a tokenizer file mean; they must match exactly."""
    if list(patterns) == [GPT4_POSSESSIVE]:
        return "gpt4"  # both spellings mean at most three digits a piece
    if list(patterns) == [r"(?:\r?\n)+", QWEN2]:
        return "laguna"
    for name, own in SCHEMES.items():
        if tuple(patterns) == own:
            return name
    raise ValueError("unknown pre-tokenization pattern")


def _jvm(pattern: str) -> str:
    # The JVM's classes are ASCII unless told otherwise, and it names scripts by \p{IsHan}.
    return pattern.replace(r"\p{Han}", r"\p{IsHan}")


def pieces(text: Column, scheme: str) -> Column:
    """array<string> of a text's pieces; joined they are the text. Null stays null."""
    stages = SCHEMES[resolve(scheme)]
    if len(stages) == 1:
        return F.regexp_extract_all(text, F.lit("(?U)" + _jvm(stages[0])), F.lit(0))
    out = F.array(text)
    if stages is LAGUNA:
        out, stages = F.split(text, _RUN_BEGINS), stages[1:]
    out = F.when(text == "", F.array().cast("array<string>")).otherwise(out)
    for p in stages:
        out = F.flatten(F.transform(out, _stage(f"(?Us)(?:{_jvm(p)})|(?:(?!{_jvm(p)}).)+")))
    return out


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def pieces_sql(text: str, scheme: str) -> str:
    """The same as SQL text over the SQL expression ``text``."""
    stages = SCHEMES[resolve(scheme)]
    if len(stages) == 1:
        return f"regexp_extract_all({text}, {quoted('(?U)' + _jvm(stages[0]))}, 0)"
    out = f"array({text})"
    if stages is LAGUNA:
        out, stages = f"split({text}, {quoted(_RUN_BEGINS)})", stages[1:]
    for p in stages:
        out = f"flatten(transform({out}, x -> regexp_extract_all(x, {quoted(f'(?Us)(?:{_jvm(p)})|(?:(?!{_jvm(p)}).)+')}, 0)))"
    return f"CASE WHEN {text} = '' THEN cast(array() AS array<string>) ELSE {out} END"


# Places that no scheme's piece reaches over and none looks past, so that both sides can be split alone: between a letter
# or digit and a space that a letter follows, and between a letter and a mark below or a line end. Letters are those of any
# script. No scheme continues a run of letters over these marks; apostrophes do, and some marks of the kana blocks count as
# letters in one scheme, so they are not among them. NFC doesn't compose there either: no mark combines with what is before it.
STOPS = "\n,.;:!?()[]{}<>=+*/%&|^~@#$\"\\、。，；：！？（）"
_SPACE = r"(?<=[\p{L}\p{N}])(?= \p{L})"


def cuts(stops: str = STOPS, spaces: bool = True) -> str:
    """The pattern of such places before the marks ``stops`` and, if wanted, before spaces; the empty string for none."""
    marks = [rf"(?<=\p{{L}})(?=[{re.escape(stops)}])"] * bool(stops)
    return "|".join([_SPACE] * spaces + marks)


@cache
def _rule(pattern: str):
    import regex

    return regex.compile(pattern)


def free_cuts(tokens) -> str:
    """The pattern of the places that no added token can reach over, strip the space behind, or look past. ``tokens`` have
    content, rstrip and single_word."""

    def free(left: str, c: str) -> bool:
        place = _rule(left + re.escape(c))
        return not any(place.search(t.content) or (t.rstrip and c.isspace() and place.search(t.content[-1:] + c)) or (t.single_word and t.content[:1] == c) for t in tokens)

    return cuts("".join(c for c in STOPS if free(r"\p{L}", c)), free(r"[\p{L}\p{N}]", " "))


def last_cut(text: str, window: int = 512, pattern: str | None = None) -> int:
    """The last place of ``text`` at which it can be cut, 0 where there is none. Looks back by doubling windows."""
    pattern = cuts() if pattern is None else pattern
    if not pattern:
        return 0
    rule = _rule(pattern)
    while True:
        low = max(0, len(text) - window)
        at = 0
        for m in rule.finditer(text, low):
            at = m.start()
        if at or not low:
            return at
        window *= 2


def ranges(text: Column, size: int, pattern: str | None = None) -> Column:
    """array<string> of parts that can be split alone, each of ``size`` characters or somewhat more."""
    pattern = cuts() if pattern is None else pattern
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{size},}}?(?:{pattern}|\z)|.+"), F.lit(0)) if pattern else F.when(text == "", F.array().cast("array<string>")).otherwise(F.array(text))


def _stage(pattern: str):
    """Cuts a piece; what the pattern doesn't match stays whole for the next stage."""
    return lambda x: F.regexp_extract_all(x, F.lit(pattern), F.lit(0))


def split(text: str, scheme: str) -> list[str]:
    """The same for one text in Python."""
    import regex

    out = [text] if text else []
    for p in SCHEMES[resolve(scheme)]:
        rule = regex.compile(f"(?:{p})", regex.V1)
        parts = []
        for x in out:
            at = 0
            for m in rule.finditer(x):
                if m.start() > at:
                    parts.append(x[at : m.start()])
                if m.group():
                    parts.append(m.group())
                at = m.end()
            if at < len(x):
                parts.append(x[at:])
        out = parts
    return out
