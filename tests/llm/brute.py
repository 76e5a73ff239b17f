"""Plain statements of what the operators should do, for small tables."""

from __future__ import annotations

import bisect
import collections
import hashlib
import math
import re

import numpy as np

SPACES = "\t\n\x0b\x0c\r "


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def quality(text):
    w, t = words(text), text or ""
    seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = set()
    for i in range(len(w) - 4):
        if seen[tuple(w[i : i + 5])] > 1:
            again |= set(range(i, i + 5))
    lines, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(again)


def line_dedup(docs):
    """docs: (id, text); ids may be None or repeat.  Rows (id, n_lines, n_dropped, text)."""
    holders = collections.defaultdict(set)
    key = lambda line: lower(line.strip(SPACES))
    for d, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        keep = []
        for line in lines:
            own = holders.get(key(line), set())
            top = max((x for x in own if x is not None), default=None)
            if len(own) < 3 or d == top:
                keep.append(line)
        out.append((d, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


def repeats(docs, length=50):
    """docs: (id, text) with distinct ids.  {id: (n_bytes, n_removed, n_spans, sha)}"""
    raw = {d: (t or "").encode() for d, t in docs}
    first = {}
    for d, b in raw.items():
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            first[s] = min(first.get(s, d), d)
    out = {}
    for d, b in raw.items():
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()
    return out


def near(docs, n=5, percent=75):
    """{id: (n_shingles, component)} for distinct ids."""
    sets = {}
    for d, t in docs:
        w = words(lower(t or ""))
        sets[d] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held = collections.defaultdict(list)
    for d, s in sets.items():
        for x in s:
            held[x].append(d)
    shared = collections.Counter()
    for ds in held.values():
        for i, a in enumerate(ds):
            for b in ds[:i]:
                shared[a, b] += 1
    for (a, b), c in shared.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def secrets(text):
    text, found = text or "", []
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found += [(m.start(), 0, "assign", m.end()) for m in re.finditer(assign, text, re.I | re.A) if len(m[2]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(k, s, e) for s, _, k, e in sorted(found)]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def personal(text):
    text, found = text or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    ]
    for kind, pattern, holds in rules:
        found += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if holds(m[0])]
    return found


def targets(sizes, weights=(5, 2, 1), most=3):
    """sizes: {source: size}; sharing by rounds, as the rule is stated."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    open_, out, left = set(names), {}, float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total >= most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
            open_.discard(s)
        left -= sum(out[s] for s in over)
    return out


def runs(words, shortest=6, repeats=4):
    """(start, length, period) of every maximal run, by start, then period: all lags, one by one."""
    names, found = {}, {}
    own = np.array([names.setdefault(w, len(names)) for w in words])
    for q in range(len(words) // repeats, 0, -1):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], own[q:] == own[:-q], [0])).astype(int)))
        for i, j in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if j - i + q >= max(shortest, repeats * q):
                found[i, j - i + q] = q  # smaller periods come later
    return sorted((s, k, q) for (s, k), q in found.items())


def collapsed(words, found):
    gone = {i for s, k, q in found for i in range(s + q, s + k)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def kneser_ney(train, texts):
    """(n_tokens, n_known, base_score, score) of each text under a bigram model of the training texts."""
    cut = lambda t: ["<s>", *words(lower(t or "")), ""]
    pairs = collections.Counter(p for t in train for p in zip(cut(t), cut(t)[1:]))
    count = collections.Counter(w for t in train for w in cut(t)[1:])
    kinds = collections.Counter(w for _, w in pairs)
    after = collections.defaultdict(list)
    for (h, _), c in pairs.items():
        after[h].append(c)

    def discounts(counts):
        n = [sum(c == k for c in counts) for k in range(5)]
        if min(n[1:4]) == 0:
            return [0, 0.5, 1, 1.5]
        y = n[1] / (n[1] + 2 * n[2])
        d = [0, 1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]]
        return d if all(0 <= d[k] <= k for k in (1, 2, 3)) else [0, 0.5, 1, 1.5]

    d, e = discounts(list(pairs.values())), discounts(list(kinds.values()))
    v, n, types = len(count), sum(count.values()), sum(kinds.values())
    left = sum(e[min(k, 3)] for k in kinds.values()) / types / (v + 1)

    def chance(h, w):
        alone = (kinds[w] - e[min(kinds[w], 3)]) / types + left
        if h not in after:
            return alone
        total = sum(after[h])
        return (pairs[h, w] - d[min(pairs[h, w], 3)]) / total + sum(d[min(c, 3)] for c in after[h]) / total * alone

    out = []
    for t in texts:
        own = cut(t)
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own[1:])
        known = sum(count[w] > 0 for w in own[1:])
        out.append((len(own) - 1, known, base, sum(math.log10(chance(h, w)) for h, w in zip(own, own[1:]))))
    return out


def alignment(docs, a_bytes, b_bytes):
    """docs: (ids of A, ids of B).  The rows of the alignment, token by token."""
    links, listed = [], []
    for a, b in docs:
        spans = []
        for ids, names in ((a, a_bytes), (b, b_bytes)):
            at, own = 0, []
            for i in ids.tolist():
                own.append((at, at + len(names[i]), i))
                at += len(names[i])
            spans.append(own)
        owner = [[i for i, (s, e, _) in enumerate(own) for _ in range(s, e)] for own in spans]  # token of each byte
        found = [(int(a[i]), int(b[j])) for i, j in sorted(set(zip(*owner)))]
        links.append(found)
        ends = sorted({e for _, e, _ in spans[0]} & {f for _, f, _ in spans[1]})
        sides = [collections.defaultdict(list), collections.defaultdict(list)]
        for own, side in zip(spans, sides):
            for _, e, i in own:
                side[bisect.bisect_left(ends, e)].append(str(i))
        listed.append([f"{','.join(sides[0][k])}|{','.join(sides[1][k])}" for k in range(len(ends))])
    count = collections.Counter(x for found in links for x in found)
    most = collections.Counter()
    for (_, j), c in count.items():
        most[j] = max(most[j], c)
    out = []
    for (a, b), found, groups in zip(docs, links, listed):
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if len(a) else ""
        best = sum(count[x] == most[x[1]] for x in found)
        out.append((len(a), len(b), len(groups), len(found), best, sum(count[x] for x in found), sha))
    return out
