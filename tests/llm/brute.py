"""Plain Python versions of the operators' results."""

import collections
import hashlib
import re
import zlib

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def decontam(docs, bench, width=10):
    windows = collections.defaultdict(set)
    for i, t in bench:
        w = WORD.findall((t or "").translate(UP))
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[k : k + width])].add(i)
    out = []
    for i, t in docs:
        w, hit, items = WORD.findall((t or "").translate(UP)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    items |= windows[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), tuple(sorted(items))))
    return sorted(out, key=repr)


def shingles(t, size=5, lower=True):
    w = SPACED.findall((t or "").translate(UP) if lower else t or "")
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def jaccard(docs):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            inter = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * inter >= 75 * (len(sets[a]) + len(sets[b]) - inter):
                parent[root(a)] = root(b)
    least = collections.defaultdict(list)
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[root(k)].append(i)
    return sorted(((i, len(sets[k]), i if not sets[k] else min(least[root(k)], default=None)) for k, (i, _) in enumerate(docs)), key=repr)


def repeats(docs, width=400):
    raws = [(t or "").encode() for _, t in docs]
    count = collections.Counter(r[k : k + width] for r in raws for k in range(len(r) - width + 1))
    out = []
    for (i, _), r in zip(docs, raws, strict=True):
        gone = bytearray(len(r))
        for k in range(len(r) - width + 1):
            if count[r[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        runs = sum(1 for k in range(len(r)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(r), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(r, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def targets(docs, weights=(5, 2, 1), cap=3):
    size = collections.Counter()
    for s, t in docs:
        size[s] += len(SPACED.findall(t or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    fixed = {}
    while True:
        free = [s for s in names if s not in fixed]
        share = (sum(size.values()) - sum(fixed.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if share * weight[s] > cap * size[s]]
        if not over:
            return size, {s: fixed.get(s, share * weight[s]) for s in names}
        fixed |= {s: cap * size[s] for s in over}


def planted(docs):
    """The words of each document after a tenth of them, by the crc32 of the id, repeat a stretch."""
    out = []
    for i, t in docs:
        w, h = SPACED.findall(t or ""), zlib.crc32(("" if i is None else str(i)).encode())
        g = h // 10
        if h % 10 == 0 and w:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
        out.append((i, w))
    return out


def periodic(words, least=6, times=4):
    """(start, length, period) of all maximal runs, period by period."""
    n, found, seen = len(words), [], set()
    for q in range(1, n // times + 1):
        k = 0
        while k + q < n:
            if words[k] != words[k + q]:
                k += 1
                continue
            s = k
            while k + q < n and words[k] == words[k + q]:
                k += 1
            length = k + q - s
            # A smaller period of the same stretch has been found before.
            if length >= max(least, times * q) and (s, length) not in seen:
                seen.add((s, length))
                found.append((s, length, q))
    return sorted((s, n, q) for s, n, q in found)


def collapsed(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def spelling(docs):
    counts = collections.Counter()
    for i, t in docs:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = r.translate(UP)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            counts[r if h % 97 else r[: h % len(r)] + r[h % len(r) + 1 :]] += 1
    kept = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) == len(a) + 1 and any(a == b[:k] + b[k + 1 :] for k in range(len(b)))

    beside = {w: [v for v in kept if near(w, v)] for w in kept}
    form = {}
    for w, others in beside.items():
        best = min(others, key=lambda v: (-kept[v], v), default=None)
        form[w] = best if best is not None and kept[best] >= 2 * kept[w] else None
    out = []
    for w in kept:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, kept[w], len(beside[w]), kept[form[w]] if form[w] is not None else None))
    return sorted(out)


def earlier_windows(docs, width=20):
    """(id, words, removed, kept text) with windows that start at a smaller (id, word number) removed; a null id comes first."""
    rows = [(i, SPACED.findall(t or "")) for i, t in docs]
    at = lambda i, k: ((0, 0) if i is None else (1, i), k)
    first = {}
    for i, w in rows:
        for k in range(len(w) - width + 1):
            x = tuple(w[k : k + width])
            first[x] = min(first.get(x, at(i, k)), at(i, k))
    out = []
    for i, w in rows:
        gone = {j for k in range(len(w) - width + 1) if first[tuple(w[k : k + width])] < at(i, k) for j in range(k, k + width)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)
