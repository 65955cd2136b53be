"""Plain Python versions of the operators, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter


def words_of(text, lower=True):
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text) if lower else text)


def shingles(text, size=3):
    w = words_of(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def components(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard(rows, size=3, percent=90):
    sets = [(i, shingles(t, size)) for i, t in rows]
    links = []
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            common = len(a & b)
            if i is not None and j is not None and a and b and 100 * common >= percent * (len(a) + len(b) - common):
                links.append((i, j))
    own = components({i for i, _ in rows if i is not None}, links)
    return sorted(((i, len(s), own.get(i)) for i, s in sets), key=repr)


def repeated_strings(rows, size=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - size + 1 if i is not None else 0):
            w = b[p : p + size]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = set()
        for p in range(len(b) - size + 1 if i is not None else 0):
            if first[b[p : p + size]] < i:
                gone.update(range(p, p + size))
        kept = bytes(c for k, c in enumerate(b) if k not in gone)
        spans = sum(1 for k in gone if k - 1 not in gone)
        out.append((i, len(b), len(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def mixture(rows, weights=(1, 2, 3), most=3):
    """Targets by sharing the excess again and again; rows of (doc_id, source, text)."""
    total = Counter()
    for _, s, t in rows:
        total[s] += len(words_of(t))
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, free, target = sum(total.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if most * total[s] < level * weight[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        for s in full:
            target[s] = float(most * total[s])
            left -= most * total[s]
        free -= full
    return total, target


def text_counts(text):
    text = text or ""
    w = words_of(text, lower=False)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def base_scores(rows):
    tokens = [(i, [*words_of(t), "\0end"]) for i, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    seen = Counter(t for (_, ts), h in zip(tokens, held) if not h for t in ts)
    n, v = sum(seen.values()), len(seen)
    return [
        (i, h, len(ts), sum(seen[t] > 0 for t in ts), n, sum(math.log10((seen[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts))
        for (i, ts), h in zip(tokens, held)
    ]


def near_vectors(rows, threshold=0.9):
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v):
            return None
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v] if n else None

    units = [(i, unit(v)) for i, v in rows]
    links, count = [], Counter()
    for k, (i, a) in enumerate(units):
        for j, b in units[:k]:
            if a and b and len(a) == len(b) and sum(x * y for x, y in zip(a, b)) >= threshold:
                links.append((i, j))
                count[i] += 1
                count[j] += 1
    own = components({i for i, _ in rows}, links)
    return sorted((i, count[i], own[i], own[i] == i) for i, _ in rows)


def _finite(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def line_dedup(rows, min_chars=40, min_docs=5):
    """``doc_id, n_lines, n_dropped, kept`` of every row."""
    def key_of(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\f\r"))

    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key_of(line)) >= min_chars:
                held.setdefault(key_of(line), set()).add(i)
    last = {k: max(ids) for k, ids in held.items() if len(ids) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or last.get(key_of(x), i) <= i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def hard_negatives(rows, positives=5, negatives=10, low=30, high=90, every=100, scale=256):
    """Rows ``vec_id, label, vector``."""
    fit = [(k, i, c, [math.floor(scale * x) for x in v]) for k, (i, c, v) in enumerate(rows) if i is not None and c is not None and _finite(v)]
    out = []
    for k, i, c, q in fit:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j, c == d) for m, j, d, v in fit if m != k and len(v) == len(q))
        for s, p, _ in [x for x in scored if x[2]][:positives]:
            inside = [(-t, j) for t, j, alike in scored if not alike and low * -s <= 100 * -t <= high * -s]
            out += [(i, p, r + 1, j, -s, t) for r, (t, j) in enumerate(inside[:negatives])]
    return sorted(out)


def centroid_clusters(rows, k=8, rounds=10, dim=64, scale=1024, seed=3):
    """Rows ``vec_id, vector``; gives ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if _finite(v) and len(v) == dim]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    centres = [v for _, _, v in sorted((i is None, digest(f"{seed}:{i}"), v) for i, v in kept)[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for n in set(own):
            mine = [v for (_, v), o in zip(kept, own) if o == n]
            centres[n] = [sum(x) // len(mine) for x in zip(*mine)]
    placed = [(i, *nearest(v)) for i, v in kept]
    inertia = Counter()
    for _, d, n in placed:
        inertia[n] += d
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), digest(",".join(map(str, centres[n])))) for i, d, n in placed), key=repr)
