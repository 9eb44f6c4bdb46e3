"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text, lower=False):
    raw = (text or "").encode()
    return (raw.translate(LOWER) if lower else raw).split()


def sha(data):
    return hashlib.sha256(data).hexdigest()


def substring(docs, width):
    """docs: (id, text) -> {row: (n_words, n_removed, sha)}"""
    first = {}
    for i, t in docs:
        w = words(t)
        for k in range(len(w) - width + 1):
            s = tuple(w[k : k + width])
            first[s] = min(first.get(s, i), i) if i is not None else first.get(s, 1 << 70)
    out = []
    for i, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < (1 << 69 if i is None else i):
                gone[k : k + width] = [True] * width
        out.append((len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def bytes_removed(texts, width):
    count = Counter()
    for t in texts:
        b = (t or "").encode()
        count.update(b[k : k + width] for k in range(len(b) - width + 1))
    out = []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if count[b[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        out.append((len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def shingles(text, n=5):
    w = words(text, lower=True)
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components(docs):
    """{id: (n_shingles, component)} of (id, text), by all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in docs}
    parent, by = {i: i for i in sets}, defaultdict(list)

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, s in sets.items():
        both = Counter()
        for x in s:
            both.update(by[x])
            by[x].append(i)
        for j, n in both.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def contained(docs, items):
    found = {}
    for k, item in items:
        s = {tuple(x.decode().lower() for x in y) for y in shingles(item)}
        for i, t in docs:
            n = len(s & {tuple(x.decode().lower() for x in y) for y in shingles(t)})
            if s and 100 * n >= 75 * len(s):
                found[(i, k)] = (len(s), n)
    return found
