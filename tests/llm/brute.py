"""Plain versions of the operators, straight from their definitions."""

from __future__ import annotations

import math
import re
from collections import Counter

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, n):
    w = SPACED.findall(lower(text))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(rows, n, percent):
    sets = {i: shingles(t, n) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def links(rows, n, percent):
    """Overlap of every two different ids whose sets link, smaller id first."""
    sets = sorted({(i, frozenset(shingles(t, n))) for i, t in rows}, key=lambda x: x[0])
    out = {}
    for k, (a, x) in enumerate(sets):
        for b, y in sets[k + 1 :]:
            if x & y and 100 * len(x & y) >= percent * len(x | y):
                out[a, b] = len(x & y)
    return out


def removed(rows, width):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - width + 1) if i is not None else ():
            first[b[p : p + width]] = min(first.get(b[p : p + width], i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1) if i is not None else ():
            if first[b[p : p + width]] < i:
                gone[p : p + width] = b"\1" * width
        runs = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out.append((-1 if i is None else i, len(b), runs, bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return sorted(out)


def quality(text):
    text = text or ""
    w = SPACED.findall(text)
    count = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def ratios(text):
    """What quality rules may test, from their definitions."""
    text = text or ""
    n, chars, symbols, dup, repeats = quality(text)
    w, lines = SPACED.findall(text), [x for x in text.split("\n") if SPACED.search(x)]
    count = lambda known: sum(c in known for c in text)
    return {
        "words": n, "word_length": chars / max(1, n), "symbols": symbols / max(1, n), "shouts": count("!") / max(1, n),
        "capitals": count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / max(1, chars), "digits": count("0123456789") / max(1, chars),
        "dup_lines": dup / max(1, len(lines)), "repeats": repeats / max(1, n), "distinct": len(set(w)) / max(1, n),
    }


PHRASES = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}


def licences(text):
    w = ALNUM.findall(lower(text))
    hits = [(i, k) for k, p in PHRASES.items() for i in range(len(w)) if w[i : i + len(p)] == p]
    at = [i for i, _ in hits]
    return len(w), len(at), min(at) if at else None, max(at) if at else None, ",".join(sorted({k for _, k in hits}))


def chain_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b):
            row[j + 1], left = (left + 1 if x == y else max(row[j + 1], row[j])), row[j + 1]
    return row[-1]


def licence_labels(text, known):
    w, labels = ALNUM.findall(lower(text)), set()
    for t in known:
        p = ALNUM.findall(lower(t.text))
        together = any(w[i : i + len(p)] == p for i in range(len(w)))
        if together or (not t.together and chain_length(p, w) >= 0.6 * len(p)):
            labels.add(t.label)
    return ",".join(sorted(labels))


def search(rows, asked, k):
    bags = {i: Counter(ALNUM.findall(lower(t))) for i, t in rows}
    df = Counter(w for c in bags.values() for w in c)
    n, mean = len(bags), sum(sum(c.values()) for c in bags.values()) / max(1, len(bags))
    out = []
    for q in asked:
        found = []
        for d, c in bags.items():
            size, s = sum(c.values()), 0.0
            for w, m in bags[q].items():
                if w in c:
                    s += math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * 8 * m / (7 + m) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size / mean))
            if s > 0:
                found.append((-round(s, 9), d))
        out += [(q, r + 1, d) for r, (_, d) in enumerate(sorted(found)[:k])]
    return sorted(out)
