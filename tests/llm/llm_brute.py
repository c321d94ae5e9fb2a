"""Brute-force versions that tests share."""

import hashlib
import itertools

import xxhash


def brute_repeats(items, n=20):
    seen, out = set(), {}
    for key, text in items:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - n + 1):
            window = tuple(words[s : s + n])
            if window in seen:
                gone[s : s + n] = [True] * n
            seen.add(window)
        out[key] = (len(words), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(words, gone) if not g)).hexdigest())
    return out


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    votes = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(grams))


def brute_components(ids, fps):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(ids)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            a, b = sorted((find(i), find(j)), key=lambda k: ids[k])
            parent[b] = a
    return [ids[find(i)] for i in range(len(ids))]


def brute_kept(rows):
    """rows: (doc_id, text). The smallest id of each component of texts linked at five-word Jaccard >= 0.8."""
    rows = sorted(rows)
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    by = {}
    for i, s in enumerate(sets):
        for x in s or {()}:
            by.setdefault(x, []).append(i)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in {(a, b) for v in by.values() for a in v for b in v if a < b}:
        both = len(sets[i] & sets[j])
        if sets[i] == sets[j] or both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
            x, y = sorted((find(i), find(j)))
            parent[y] = x
    return {rows[i][0] for i in range(len(rows)) if find(i) == i}
