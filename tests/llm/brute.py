"""Plain-Python versions of what the operators compute."""

import re
from collections import defaultdict


def words(text):
    return [w.decode("utf-8", "surrogateescape") for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())]


def shingle_set(text, width):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def components(sets, num, den):
    """Least id that each id can reach over pairs with num / den of similarity; sets: id to set."""
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    shared = defaultdict(int)
    for ids in holders.values():
        for a in ids:
            for b in ids:
                if a < b:
                    shared[a, b] += 1
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for (a, b), n in shared.items():
        if n * den >= num * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {i: top(i) for i in sets}
