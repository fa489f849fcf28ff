"""Slow, plain versions of operators for the tests."""

import re
from collections import defaultdict


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def near_groups(rows, like=75):
    """[(doc_id, text)] -> [(doc_id, size, component)], in order; null ids don't name a component."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    seen = defaultdict(list)
    for i, s in enumerate(sets):
        near = defaultdict(int)
        for x in s:
            for j in seen[x]:
                near[j] += 1
            seen[x].append(i)
        for j, both in near.items():
            if 100 * both >= like * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None and (least.get(r) is None or d < least[r]):
            least[r] = d
    return [(d, len(sets[i]), d if not sets[i] else least.get(find(i))) for i, (d, _) in enumerate(rows)]
