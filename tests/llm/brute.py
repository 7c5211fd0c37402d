"""Plain versions of operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def substring_dedup(rows, window=35):
    """(doc_id, text) to (doc_id, n_words, n_removed, kept_sha256)."""
    docs = [(i, WORDS.findall(t or "")) for i, t in rows]
    seen = Counter(tuple(w[s : s + window]) for _, w in docs for s in range(len(w) - window + 1))
    for i, w in docs:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if seen[tuple(w[s : s + window])] > 1:
                gone[s : s + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        yield i, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def shingles(text, k=5):
    w = WORDS.findall(lower(text))
    return {tuple(w[s : s + k]) for s in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def jaccard_pairs(texts, near=75):
    """Linked pairs of different texts."""
    sets = [(t, shingles(t)) for t in sorted(set(texts))]
    return {(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if x and y and 100 * len(x & y) >= near * len(x | y)}


def jaccard(rows, near=75):
    """(doc_id, text) to (doc_id, n_shingles, component_id)."""
    ids, sets = [i for i, _ in rows], [shingles(t) for _, t in rows]
    root, posts = list(range(len(sets))), defaultdict(list)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        both = Counter(j for x in s for j in posts[x])
        for j, n in both.items():
            if 100 * n >= near * (len(s) + len(sets[j]) - n):
                root[top(i)] = top(j)
        for x in s:
            posts[x].append(i)
    least = {}
    for i, x in enumerate(ids):
        if sets[i] and x is not None:
            least[top(i)] = min(x, least.get(top(i), x))
    return [(x, len(sets[i]), least.get(top(i)) if sets[i] else x) for i, x in enumerate(ids)]
