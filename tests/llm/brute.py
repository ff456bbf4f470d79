"""Plain-Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
KINDS = ("email", "ip", "card", "phone")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return WORD.findall(lower(t))


def tokens(rows, tokenizer, end_id):
    """rows: (doc_id, text) in doc_id order -> (doc_id, start, n_tokens, crc)."""
    import numpy as np

    at, out = 0, []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, end_id]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def luhn(d):
    s = 0
    for i, c in enumerate(d[::-1]):
        x = int(c) * (1 + i % 2)
        s += x - 9 if x > 9 else x
    return s % 10 == 0


def base_spans(t):
    t, out = t or "", []
    for k, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if k == 2 and not (12 <= len(d) <= 19 and luhn(d)):
                continue
            if k == 3 and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def span_text(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def top_k(rows, is_query, k):
    """rows: (id, vector or None) -> (query_id, rank, vec_id, score)."""
    good = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    best = defaultdict(dict)
    for q, u in good:
        if is_query(q):
            for i, v in good:
                if i != q and len(u) == len(v):
                    s = sum(a * b for a, b in zip(u, v))
                    best[q][i] = max(s, best[q].get(i, -10**18))
    return [(q, r + 1, i, s) for q, d in best.items() for r, (i, s) in enumerate(sorted(d.items(), key=lambda x: (-x[1], x[0]))[:k])]


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return a == b
    if len(a) > len(b):
        a, b = b, a
    p = 0
    while p < len(a) and a[p] == b[p]:
        p += 1
    return a[p + 1:] == b[p + 1:] if len(a) == len(b) else a[p:] == b[p + 1:]


def within(a, b, edits):
    """Whether a and b are at most ``edits`` edits apart."""
    if abs(len(a) - len(b)) > edits:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] <= edits


def kept_lines(rows, shortest=8, edits=1):
    """rows: (doc_id, text), no equal rows -> {(doc_id, text): kept line numbers}."""
    def key(i, t):
        t = t or ""
        return (i is not None, i or 0, hashlib.md5(f"{'null' if i is None else f'i{i}'}:{hashlib.md5(t.encode()).hexdigest()}".encode()).digest())

    first, out = {}, {}
    order = sorted(set(rows), key=lambda r: key(*r))
    for i, t in order:
        for n, l in enumerate((t or "").split("\n")):
            if l.strip(" ") and l not in first:
                first[l] = (i, t, n)
    lines = list(first)
    gone = set()
    for b in range(len(lines)):
        for a in range(b):
            if min(len(lines[a]), len(lines[b])) >= shortest and (one_edit(lines[a], lines[b]) if edits == 1 else within(lines[a], lines[b], edits)):
                gone.add(lines[b])
    for i, t in order:
        out[i, t] = [n for n, l in enumerate((t or "").split("\n")) if l.strip(" ") and first[l] == (i, t, n) and l not in gone]
    return out


def shingles(t, n=5):
    w = words(t)
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def join(rows, threshold=0.8):
    """rows: (doc_id, text) -> sorted (doc_id, class_id, n_copies, n_links, n_linked_docs)."""
    texts = defaultdict(list)
    for i, t in rows:
        texts[t or ""].append(i)
    names = list(texts)
    sets = [shingles(t) for t in names]
    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    root, links = list(range(len(names))), defaultdict(set)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, s in enumerate(sets):
        for j, both in Counter(j for x in s for j in holders[x] if j < k).items():
            if both >= threshold * (len(s) + len(sets[j]) - both) - 1e-9:
                links[k].add(j)
                links[j].add(k)
                a, b = find(k), find(j)
                root[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for k, t in enumerate(names):
        least[find(k)] += [i for i in texts[t] if i is not None]
    return sorted(((i, min(least[find(k)], default=None), len(texts[t]) - 1, len(links[k]), sum(len(texts[names[j]]) for j in links[k])) for k, t in enumerate(names) for i in texts[t]), key=lambda r: (r[0] is not None, r))


def contamination(docs, items, window=10):
    """-> sorted (doc_id, n_words, n_hit, n_items, sha256, contaminated)."""
    by = defaultdict(set)
    for i, t in items:
        w = words(t)
        k = min(window, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            by[tuple(w[a:a + k])].add("null" if i is None else str(i))
    lengths, out = {len(x) for x in by}, []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for k in lengths:
            for a in range(len(w) - k + 1):
                if tuple(w[a:a + k]) in by:
                    hit |= set(range(a, a + k))
                    found |= by[tuple(w[a:a + k])]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def mix(rows, seed=11, share=1.5, most=2, weights=(5, 2, 1)):
    """rows: (doc_id, source, text) -> (doc_id, size, source_size, target, taken)."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = Counter()
    for _, s, t in rows:
        total[s] += size(t)
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, free, left = {}, set(order), share * sum(total.values())
    while free:
        level = left / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > most * total[s]]
        if not over:
            target |= {s: level * w[s] for s in free}
            break
        for s in over:
            target[s] = float(most * total[s])
            left -= target[s]
            free.discard(s)
    out = []
    for s in order:
        u = int(hashlib.md5((f"{seed}:" + ("null" if s is None else "s" + s)).encode()).hexdigest()[:3], 16) / 4096
        mine = sorted(((size(t), hashlib.md5(("" if i is None else str(i)).encode()).hexdigest(), i is not None, i or 0) for i, x, t in rows if x == s))
        rate = target[s] / total[s] if total[s] else 0
        for r, (z, _, some, i) in enumerate(mine):
            c = math.floor((r + 1) * rate + u) - math.floor(r * rate + u)
            out.append((i if some else None, z, total[s], target[s], c * z))
    return out


def mix_size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
