"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def sha(data):
    return hashlib.sha256(data).hexdigest()


def repeated_bytes(rows, size=200):
    """rows: (doc_id, text)."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[p : p + size] for _, t in texts for p in range(len(t) - size + 1))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - size + 1):
            if seen[t[p : p + size]] > 1:
                gone[p : p + size] = b"\1" * size
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(t), sum(gone), runs, sha(bytes(b for b, g in zip(t, gone) if not g))))
    return out


def repeated_sequences(rows, size=20):
    texts = sorted((i, words(t)) for i, t in rows)
    seen, out = set(), []
    for i, w in texts:
        gone = [False] * len(w)
        for p in range(len(w) - size + 1):
            key = tuple(w[p : p + size])
            if key in seen:
                gone[p : p + size] = [True] * size
            seen.add(key)
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode())))
    return out


def shingles(text, size=5):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[p : p + size]) for p in range(max(len(w) - size + 1, 1))} if w else set()


def linked(rows, percent=75):
    sets = [(i, shingles(t)) for i, t in rows]
    holders = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            holders[x].append(k)
    parent = list(range(len(sets)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for k, (_, s) in enumerate(sets):
        shared = Counter(j for x in s for j in holders[x] if j < k)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j][1]) - n):
                a, b = sorted((top(k), top(j)))
                parent[b] = a
    least = {}
    for k, (i, _) in enumerate(sets):
        least[top(k)] = min(i, least.get(top(k), i))
    return [(i, len(s), least[top(k)]) for k, (i, s) in enumerate(sets)]
