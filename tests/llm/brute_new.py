"""Plain-Python versions of the whitening, periodic-run and SimHash operators."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from fractions import Fraction

import numpy as np


def whiten(rows, components=32, weights="counts"):
    """rows: (vec_id, vector) -> n, [(vec_id, deviation, whitened)], explained; the vectors in one matrix."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in good]
    fit = x if weights == "counts" else [list(t) for t in sorted(set(map(tuple, x)))]
    n = len(fit)
    s = [sum(c) for c in zip(*fit)]
    mean = [Fraction(t, n) for t in s]
    centred = lambda m: np.array([[float(a - b) for a, b in zip(r, mean)] for r in m])
    y = centred(fit)
    v = y.T @ y / n
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values)[:components]
    order = [k for k in order if values[k] > 1e-12 * values.max()]
    z = centred(x) @ vectors[:, order] / np.sqrt(values[order])
    dev = [sum((n * a - b) ** 2 for a, b in zip(r, s)) for r in x]
    return n, [(i, d, w) for (i, _), d, w in zip(good, dev, z)], values[order] / np.trace(v)


def run_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def runs(words, shortest=6, power=4):
    """(start, length, period) by start, then period: every period over every place."""
    found = {}
    n = len(words)
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            a = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - a >= max(shortest, power * q):
                found.setdefault((a, i + q - a), q)  # periods rise: the first is the smallest
    return sorted(((a, m, q) for (a, m), q in found.items()), key=lambda r: (r[0], r[2]))


def run_row(doc_id, words):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    found = runs(words)
    gone = {i for a, m, q in found for i in range(a + q, a + m)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    best = (None,) * 4 if top is None else (*top, 1000 * top[1] // top[2])
    return (doc_id, len(found), *best, sha("".join(f"{a},{m},{q}\n" for a, m, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def fingerprint(text, n=3):
    from xxhash import xxh64_intdigest

    w = run_words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    h = [xxh64_intdigest(" ".join(w[i:i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash(rows, n=3):
    """rows: (doc_id, text) -> (doc_id, fingerprint, component_id), all pairs of fingerprints compared."""
    fp = [fingerprint(t, n) for _, t in rows]
    nodes = sorted(set(fp))
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(nodes):
        for b in nodes[:k]:
            if (a ^ b).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for (i, _), f in zip(rows, fp):
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return [(i, f"{f:016x}", least.get(find(f))) for (i, _), f in zip(rows, fp)]
