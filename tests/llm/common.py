"""Small tables and brute-force versions for the operators' tests."""

import hashlib
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def reshared(size, share=1.5):
    """Targets by repeated resharing."""
    names = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(size.values())
    while free:
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) >= 2 * size[s]]
        if not over:
            target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            break
        for s in over:
            target[s] = 2 * size[s]
        left -= sum(target[s] for s in over)
        free -= set(over)
    return target


def hits(text, items, window=10):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    hit, found = set(), set()
    for name, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        for k in range(len(w) - min(window, len(w)) + 1 if w else 0):
            p = w[k : k + window]
            for a in range(len(words) - len(p) + 1):
                if words[a : a + len(p)] == p:
                    hit |= set(range(a, a + len(p)))
                    found.add(str(name))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def union_find(n, pairs):
    root = {x: x for x in n}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in n}


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def repeated_lines(rows, min_words=5):
    """({doc_id: lines that go}, links between distinct lines) by the edit distance of all pairs of lines."""
    units = []
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            words = re.findall(r"[^\x20\x09-\x0D]+", lower(line))
            if words:
                units.append((i, k, tuple(words)))
    kinds = sorted({u[2] for u in units})
    links = []
    for a, x in enumerate(kinds):
        for b, y in enumerate(kinds[:a]):
            most = int(0.2 * max(len(x), len(y)) + 1e-9)
            if min(len(x), len(y)) >= min_words and abs(len(x) - len(y)) <= most and distance(x, y) <= most:
                links.append((a, b))
    group = union_find(range(len(kinds)), links)
    number = {w: k for k, w in enumerate(kinds)}
    seen, gone = {}, {}
    for i, k, w in sorted(units):
        if seen.setdefault(group[number[w]], (i, k)) != (i, k):
            gone.setdefault(i, set()).add(k)
    return gone, links
