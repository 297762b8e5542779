"""Plain versions of the operators for small inputs, written without their methods."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def near_components(rows, size, percent):
    """doc_id -> smallest doc_id reachable, for rows (doc_id, text) with distinct ids."""
    sets = {i: shingle_set(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def passages(text, items, window=10):
    """(n_words, hit positions, items) of a text."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    words, hit, found = split(text), set(), set()
    for item, body in items:
        own = split(body)
        size = min(window, len(own))
        for start in range(len(own) - size + 1 if size else 0):
            pattern = own[start : start + size]
            for at in range(len(words) - size + 1):
                if words[at : at + size] == pattern:
                    hit.update(range(at, at + size))
                    found.add(item)
    return len(words), hit, found


def mix_targets(sizes):
    """source -> target, by sharing what is left round by round, in exact fractions."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, out = Fraction(3, 2) * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total >= 2 * sizes[s]}
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = Fraction(2 * sizes[s])
            left -= out[s]
        open_ -= over
    return out


def shard_of(rows, limit):
    """key -> bits, for (key, size) rows with distinct keys."""
    bits = {k: bin(int(hashlib.md5(str(k).encode()).hexdigest()[:15], 16))[2:].zfill(60) for k, _ in rows}

    def split(prefix, inside):
        if sum(n for _, n in inside) <= limit or len(prefix) == 60:
            return {k: prefix for k, _ in inside}
        out = {}
        for bit in "01":
            half = [r for r in inside if bits[r[0]][len(prefix)] == bit]
            out |= split(prefix + bit, half) if half else {}
        return out

    return split("", rows)


def kneser_ney(trusted, order):
    """The probability function of the model, straight from its definition."""
    level = Counter()
    for text in trusted:
        t = " ".join((text or "").replace("\0", " ").split())
        level.update(t[i : i + order] for i in range(len(t) - order + 1))
    counts = {order: level}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discount, contexts = {}, {}
    for k, c in counts.items():
        t = [sum(1 for v in c.values() if v == n) for n in (1, 2, 3, 4)]
        y = t[0] / (t[0] + 2 * t[1]) if t[0] else 0.5
        discount[k] = [
            min(max((n + 1) - (n + 2) * y * t[n + 1] / t[n], 0.1), n + 0.9) if t[n] else (n + 1) / 2 for n in range(3)
        ]
        by = defaultdict(list)
        for g, v in c.items():
            by[g[:-1]].append(v)
        contexts[k] = by
    kinds = len(counts[1])

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / (kinds + 1)
        values, d = contexts[k].get(gram[:-1]), discount[k]
        if not values:
            return p(gram[1:])
        c = counts[k].get(gram, 0)
        own = max(c - d[min(c, 3) - 1], 0) / sum(values) if c else 0.0
        gamma = sum(d[min(v, 3) - 1] for v in values) / sum(values)
        return own + gamma * p(gram[1:])

    return p


def perplexity(p, text, order):
    t = " ".join((text or "").replace("\0", " ").split())
    grams = [t[i : i + order] for i in range(len(t) - order + 1)]
    return math.exp(-sum(math.log(p(g)) for g in grams) / len(grams)) if grams else None


def divergences(rows, most):
    """Sorted (lang, source, part, item, value, rank) for rows (text, lang, source)."""
    docs = [(la or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))) for t, la, s in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [(s, w) for la, s, w in docs if la == lang]
        spread = Counter(t for _, w in own for t in set(w))
        kept = sorted(t for t, n in spread.items() if n >= 3)
        counts = {s: Counter() for s, _ in own}
        for s, w in own:
            counts[s].update(t for t in w if spread[t] >= 3)
        whole = sum(counts.values(), Counter())

        def shares(c):
            return [1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept]

        parts = {s: shares(c) for s, c in counts.items()}
        q_all = shares(whole)
        f = lambda p, q: (p - q) * (p - q) // q
        for s, p in parts.items():
            pairs = [(sum(map(f, p, q)), o) for o, q in parts.items() if o != s]
            terms = [(f(a, b), t) for t, a, b in zip(kept, p, q_all) if counts[s][t] and a > b]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, k) for k, (v, i) in enumerate(ranked, 1) if part == "pair" or k <= most]
    return sorted(out)


def whitened(rows, most):
    """(covariance's eigenvalues, deviations by position, n) of rows of entries, in exact fractions up to the eigenvalues."""
    x = [[math.floor(64 * c) + 1_000_000 for c in row] for row in rows]
    n, size = len(x), len(x[0])
    sums = [sum(col) for col in zip(*x)]
    cov = [[float(sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in x) / Fraction(n) ** 3) for j in range(size)] for i in range(size)]
    return cov, [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x], n
