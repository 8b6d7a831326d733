"""License scans by patience alignment.

A template is aligned with a text by the words that are unique in both: the longest increasing
subsequence of their places anchors the alignment, equal words next to an anchor extend it, and the gaps
between anchors are aligned again in the same way, since words that repeat in the whole text are often
unique in a gap. A gap without such words is aligned by its longest common subsequence. Every window of a text
is looked at, so a notice is found wherever and however often its words stand. Coverage is the aligned part of the
template in the best window.

Only words of some template can ever align, so a text is reduced to those first; places count all words.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Sequence
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .notices import NOTICES, notices
from .tables import batch, bound_batches, text_of

#: Notices that stand in texts, by SPDX identifier. Fixed values; ``notices()`` adds whole license texts, which only the driver reads.
TEMPLATES = {name: text for name, (text, _) in NOTICES.items()}
#: Least part of a template that is aligned. Its deciding words, which tell its name and version, are all aligned besides.
COVERAGE = 0.8
#: A window, and so an alignment, spreads over at most so many times its template's words.
SPREAD = 2.0


def tokens(text: bytes | str) -> list[bytes]:
    """Lower-cased words without punctuation around them; a word of punctuation alone is empty."""
    data = text.encode() if isinstance(text, str) else text
    return [w.strip(b".,;:!?()[]{}<>\"'`*_") for w in data.lower().split()]


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence with increasing second numbers of pairs sorted by the first (patience sorting)."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        back.append(at[k - 1] if k else -1)
        if k == len(tops):
            tops.append(b)
            at.append(i)
        else:
            tops[k], at[k] = b, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def _rows(a: Sequence, b: Sequence) -> list[int]:
    """After each item of ``a``, which places of ``b`` do not add to the longest common subsequence so far, as bits."""
    at: dict = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, out = full, []
    for x in a:
        if m := at.get(x):
            u = v & m
            v = (v + u | v - u) & full
        out.append(v)
    return out


def common(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence."""
    at: dict = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    full = v = (1 << len(b)) - 1
    for x in a:
        if m := at.get(x):
            u = v & m
            v = (v + u | v - u) & full
    return len(b) - v.bit_count()


def _common_pairs(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Places of a longest common subsequence."""
    rows, out, i, j = _rows(a, b), [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if not i or rows[i - 1] >> (j - 1) & 1:
            j -= 1
            out.append((i, j))
    return out[::-1]


def align(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Aligned places of ``a`` and ``b``, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {b[j]: j for j in range(b0, b1) if in_b[b[j]] == 1}
        anchors = _increasing([(i, place[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and a[i] in place])
        if not anchors:
            out += [(a0 + i, b0 + j) for i, j in _common_pairs(a[a0:a1], b[b0:b1])]
            continue
        pa_, pb = a0, b0
        for i, j in [*anchors, (a1, b1)]:
            if i < pa_ or j < pb:
                continue  # reached by extending the anchor before
            lo_i, lo_j = i, j
            while lo_i > pa_ and lo_j > pb and a[lo_i - 1] == b[lo_j - 1] and (i, j) != (a1, b1):
                lo_i, lo_j = lo_i - 1, lo_j - 1
                out.append((lo_i, lo_j))
            todo.append((pa_, lo_i, pb, lo_j))
            if (i, j) == (a1, b1):
                break
            out.append((i, j))
            pa_, pb = i + 1, j + 1
            while pa_ < a1 and pb < b1 and a[pa_] == b[pb]:
                out.append((pa_, pb))
                pa_, pb = pa_ + 1, pb + 1
    return sorted(out)


def _find(words: Sequence, part: Sequence) -> list[int]:
    """Where ``part`` stands in ``words``."""
    return [k for k in range(len(words) - len(part) + 1) if words[k] == part[0] and list(words[k : k + len(part)]) == list(part)]


def _window(words: Sequence, places: list[int], template: Sequence, deciding: Sequence = (), ranks: list[int] | None = None) -> list[tuple[int, int]]:
    """The alignment of the window with the most words in common with the template; the first of equals, [] below COVERAGE.

    Windows span at most SPREAD times the template's words. What a window has in common it has within any larger
    stretch too, so a run of windows is passed over when the stretch of all of them has too little, and halved otherwise.
    deciding: words of the template that a window must hold one behind the other; ranks: places that count words with a letter or digit only.
    """
    n, span, m = len(template), int(SPREAD * len(template)), len(deciding)
    p = _find(template, deciding)[0] if m else 0
    ranks = ranks or places
    marks = [k for k in _find(words, deciding) if ranks[k + m - 1] - ranks[k] == m - 1] if m else []

    def parts(lo: int, hi: int) -> list[tuple[int, int, int, int]]:
        """(words in common, end of the words before, the deciding words, begin of the words behind)."""
        if not m:
            return [(common(words[lo:hi], template), hi, n, n)]
        inside = marks[bisect_left(marks, lo) : bisect_right(marks, hi - m)]
        return [(common(words[lo:k], template[:p]) + m + common(words[k + m : hi], template[p + m :]), k, p, p + m) for k in inside]

    def size(lo: int, hi: int) -> int:
        return max((x[0] for x in parts(lo, hi)), default=0)

    best, found = max(1, ceil(COVERAGE * n - 1e-9)) - 1, None
    todo = [(e, min(e + n, len(words)) - 1) for e in range(0, len(words), n)][::-1] if marks or not m else []
    while todo and best < n:
        first, last = todo.pop()
        lo = bisect_left(places, places[first] - span + 1)
        if last + 1 - lo <= best or (got := size(lo, last + 1)) <= best:
            continue
        if places[last] - places[lo] < span:
            best, found = got, (lo, last + 1)
        else:
            mid = (first + last) // 2
            todo += [(mid + 1, last), (first, mid)]
    if found is None:
        return []
    lo, hi = found
    hi = bisect_left(range(hi), best, lo=lo, key=lambda e: size(lo, e + 1)) + 1
    lo = bisect_left(range(hi), 1 - best, lo=lo, key=lambda s: -size(s, hi)) - 1
    _, k, q, r = max(parts(lo, hi), key=lambda x: x[0])
    out = _most(words, lo, k, template, 0, q)
    if m:
        out += [(k + i, p + i) for i in range(m)] + _most(words, k + m, hi, template, r, n)
    return out


def _most(a: Sequence, a0: int, a1: int, b: Sequence, b0: int, b1: int) -> list[tuple[int, int]]:
    """Patience alignment of two parts, or what they have in common where anchors cross it."""
    pairs = align(a[a0:a1], b[b0:b1])
    if len(pairs) < common(a[a0:a1], b[b0:b1]):
        pairs = _common_pairs(a[a0:a1], b[b0:b1])
    return [(a0 + i, b0 + j) for i, j in pairs]


def scan(text: bytes, templates: dict[str, tuple[list[bytes], list[bytes]]], vocabulary: dict[bytes, bytes | None], known: set[bytes] | None = None) -> list[tuple[str, float, int, int, int]]:
    """(template, coverage, aligned words, first place, place after the last) of all templates that reach COVERAGE.

    templates: words and deciding words. vocabulary: memo from raw lower-cased words to template words, None for others,
    empty for words without a letter or digit. known: all words of templates.
    """
    known = known or {t for ts, _ in templates.values() for t in ts}
    words, places, ranks, rank = [], [], [], 0
    for i, w in enumerate(text.lower().split()):
        if w not in vocabulary:
            if len(vocabulary) > 200_000:
                vocabulary.clear()
            t = tokens(w)[0]
            vocabulary[w] = t if t in known else None if any(map(str.isalnum, w.decode("utf-8", "replace"))) else b""
        t = vocabulary[w]
        if t:
            words.append(t)
            places.append(i)
            ranks.append(rank)
        rank += t != b""
    have, out = set(words), []
    for name, (template, deciding) in templates.items():
        if not have.issuperset(deciding) or len(words) < COVERAGE * len(template):
            continue
        own = set(template)
        if sum(t in have for t in template) < COVERAGE * len(template):
            continue
        at = [k for k, w in enumerate(words) if w in own]
        if pairs := _window([words[k] for k in at], [places[k] for k in at], template, deciding, [ranks[k] for k in at]):
            out.append((name, len(pairs) / len(template), len(pairs), places[at[pairs[0][0]]], places[at[pairs[-1][0]]] + 1))
    return sorted(out, key=lambda x: (-x[2], x[0]))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """One row per input row: id, license, coverage, n_aligned, first_word, end_word, n_found.

    license is the template with the most aligned words (ties: the first by name) of those whose coverage is
    at least COVERAGE, null where there is none; n_found counts them all. Null and empty texts
    have none. Templates of one's own have no deciding words. Whole texts are scanned. Rows are independent, so nothing is shuffled:
    repeated ones have the same result each, a null id stays null, an empty table gives no rows. Ids must be integers; further
    columns are ignored.
    """
    bound_batches(docs.sparkSession)
    chosen = {name: (text, "") for name, text in templates.items()} if templates else notices()
    split = {name: tuple([t for t in tokens(part) if t] for part in parts) for name, parts in sorted(chosen.items())}
    known = {t for words, _ in split.values() for t in words}
    schema = pa.schema([(id_col, pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("n_aligned", pa.int64()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("n_found", pa.int64())])

    def run(batches):
        memo: dict[bytes, bytes | None] = {}
        for b in batches:
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = scan(text, split, memo, known)
                rows.append((i, *(found[0] if found else (None, 0.0, 0, None, None)), len(found)))
            if rows:
                yield batch(schema, [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), text_of(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` long, license string, coverage double, n_aligned long, first_word long, end_word long, n_found long")
