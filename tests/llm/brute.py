"""Plain single-process versions of the operators, for comparison."""

import hashlib
from collections import defaultdict


def shingles(text, size=5):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    if len(w) < size:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def near(rows, size=5, percent=75):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, set()).add(shingles(t, size))
    docs = [(i, s) for i, x in sets.items() for s in x]
    parent = {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for k, (_, s) in enumerate(docs):
        for g in s:
            where[g].append(k)
    for k, (i, s) in enumerate(docs):
        seen = defaultdict(int)
        for g in s:
            for m in where[g]:
                if m < k:
                    seen[m] += 1
        for m, both in seen.items():
            if 100 * both >= percent * (len(s) + len(docs[m][1]) - both):
                a, b = find(i), find(docs[m][0])
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in docs}


def repeats(rows, length=20):
    """Each row is a document; rows that share an id come in the order of their texts' digests, null ids first."""
    first, out = {}, []
    rows = [(i, (t or "").encode()) for i, t in rows]
    docs = sorted(((i is not None, i or 0, hashlib.sha256(t).hexdigest()), i, t.split()) for i, t in rows)
    for r, (_, _, w) in enumerate(docs):
        for s in range(len(w) - length + 1):
            first.setdefault(tuple(w[s : s + length]), (r, s))
    for r, (_, i, w) in enumerate(docs):
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            if first[tuple(w[s : s + length])] < (r, s):
                gone[s : s + length] = [True] * length
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out
