"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    raw = (text or "").encode()
    if lower:
        raw = bytes(c + 32 if 65 <= c <= 90 else c for c in raw)
    return WORD.findall(raw)


def passages(rows, window):
    """n_words, n_removed, kept_sha256 by identifier."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        w = words(text)
        bad = [False] * len(w)
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                bad[s : s + window] = [True] * window
            seen.add(key)
        kept = b" ".join(x for x, b in zip(w, bad) if not b)
        out[i] = (len(w), sum(bad), hashlib.sha256(kept).hexdigest())
    return out


def components(rows, k, percent):
    """n_shingles and component_id by identifier."""
    sets = {}
    for i, text in rows:
        w = words(text, True)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = {}
    for i in sorted(sets):
        common = Counter()
        for g in sets[i]:
            for j in index.get(g, ()):
                common[j] += 1
            index.setdefault(g, []).append(i)
        for j, n in common.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}
