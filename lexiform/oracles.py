"""SQL for merge vocabularies: splitting and merging told over again, for comparison with the engine.

The SQL engine's patterns have no look-ahead. ``\\s+(?!\\S)`` leaves the last white space of a run to what follows, so a mark is
put before that place first, and no pattern matches the mark. Merging joins the neighbours whose joined bytes have the
lowest rank in a rank file, one pair after another; it knows nothing of a merge list.
"""

from __future__ import annotations

MARK = ""  # of the private use area; no text holds it
_WHITE = r"\s\x0B\x{85}\p{Z}"
_INLINE = r" \t\x0B\x0C\x{85}\p{Z}"
_SHORT = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)"
_UPPER, _LOWER = r"\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}", r"\p{Ll}\p{Lm}\p{Lo}\p{M}"


def _cased(short: str) -> str:
    head = rf"[^\r\n\p{{L}}\p{{N}}{MARK}]?"
    return rf"{head}[{_UPPER}]*[{_LOWER}]+{short}|{head}[{_UPPER}]+[{_LOWER}]*{short}"


def _modern(words: str, digits: str, other: str = r"\p{L}\p{N}", ends: str = r"[\r\n]*", lines: str = rf"[{_WHITE}]*[\r\n]+") -> str:
    return rf"{words}|{digits}| ?[^{_WHITE}{other}{MARK}]+{ends}|{lines}|[{_WHITE}]+"


_PLAIN = rf"{_SHORT}|[^\r\n\p{{L}}\p{{N}}{MARK}]?\p{{L}}+"
#: Scheme to (where the mark goes, what a piece is). The tables hold no Han, by which one scheme differs from another.
PIECES = {
    "gpt2": (rf"([{_WHITE}]+)([{_WHITE}][^{_WHITE}])", rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}{MARK}]+|[{_WHITE}]+"),
    "gpt4": (None, _modern(_PLAIN, r"\p{N}{1,3}")),
    "qwen2": (None, _modern(_PLAIN, r"\p{N}")),
    "qwen35": (None, _modern(rf"{_SHORT}|[^\r\n\p{{L}}\p{{N}}{MARK}]?[\p{{L}}\p{{M}}]+", r"\p{N}", r"\p{L}\p{M}\p{N}")),
    "olmo3": (None, _modern(_PLAIN, r"\p{N}{1,3}")),
    "o200k": (None, _modern(_cased(f"{_SHORT}?"), r"\p{N}{1,3}", ends=r"[\r\n/]*")),
    "nemotron": (None, _modern(_cased(""), r"\p{N}", ends=r"[\r\n/]*")),
    "kimi": (None, _modern(_cased(f"{_SHORT}?"), r"\p{N}{1,3}")),
    # Digits are cut out first, so that white space before them is at its segment's end and stays whole.
    "deepseek_v3": (
        rf"([{_INLINE}])([{_INLINE}][^{_WHITE}\p{{N}}])",
        rf"\p{{N}}{{1,3}}|[!-/:-@\[-`{{-~][A-Za-z]+|[^\r\n\p{{L}}\p{{P}}\p{{S}}\p{{N}}{MARK}]?[\p{{L}}\p{{M}}]+| ?[\p{{P}}\p{{S}}]+[\r\n]*|[{_WHITE}]*[\r\n]+|[{_WHITE}]+|[^{_WHITE}{MARK}]+",
    ),
    # Line ends begin a segment: nothing before them reaches over them.
    "laguna": (None, _modern(_PLAIN, r"\p{N}", ends="", lines=r"[\r\n]+").replace(rf"|[{_WHITE}]+", rf"|[{_INLINE}]+")),
}


def pieces(scheme: str, text: str = "text") -> str:
    """A list of a text's pieces."""
    mark, piece = PIECES[scheme]
    mark = mark or rf"([{_INLINE}])([{_INLINE}][^{_WHITE}])"
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    return f"regexp_extract_all(regexp_replace({text}, {quoted(mark)}, '\\1{MARK}\\2', 'g'), {quoted(piece)})"


def merged(ranks: str, rows: str, scheme: str = "gpt2", key: str = "doc_id") -> str:
    """CTEs for texts: ``p`` (key, pos, piece) and ``b`` (piece, ids, sizes), the ids and byte lengths of each distinct piece.
    ``rows`` selects (key, text); ``ranks`` is a rank file."""
    return f"""
WITH RECURSIVE v AS (
  SELECT hex(from_base64(token)) AS h, rank FROM read_csv('{ranks}', delim=' ', header=false, quote='', escape='', columns={{'token': 'VARCHAR', 'rank': 'BIGINT'}})
), t AS ({rows}), q AS (
  SELECT {key}, {pieces(scheme)} AS x FROM t
), p AS (
  SELECT {key}, unnest(range(0, len(x))) AS pos, unnest(x) AS piece FROM q
), m AS (
  SELECT piece, list_transform(range(0, strlen(piece)), lambda i: substr(hex(encode(piece)), CAST(2 * i + 1 AS BIGINT), 2)) AS s FROM (SELECT DISTINCT piece FROM p)
  UNION ALL
  SELECT piece, s[1 : k - 1] || [s[k] || s[k + 1]] || s[k + 2 :] FROM (
    SELECT piece, s, arg_min(k, v.rank * 1048576 + k) AS k
    FROM (SELECT piece, s, unnest(range(1, len(s))) AS k FROM m) JOIN v ON v.h = s[k] || s[k + 1] GROUP BY piece, s)
), f AS (
  SELECT piece, arg_min(s, len(s)) AS s FROM m GROUP BY piece
), b AS (
  SELECT piece, list(v.rank ORDER BY k) AS ids, list(length(h) // 2 ORDER BY k) AS sizes
  FROM (SELECT piece, unnest(s) AS h, unnest(range(0, len(s))) AS k FROM f) JOIN v USING (h) GROUP BY piece
)"""
