"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def near_duplicates(rows, n, num, den):
    """{id: (shingles, component)}"""
    sets = {}
    for i, t in rows:
        ws = WORD.findall(lower(t or ""))
        sets[i] = {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)} if len(ws) >= n else ({tuple(ws)} if ws else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    holders, shared = defaultdict(list), Counter()
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    for ids in holders.values():
        ids.sort()
        shared.update((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :])
    for (a, b), c in shared.items():
        if c * den >= num * (len(sets[a]) + len(sets[b]) - c):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def without_repeats(rows, window):
    """Counter of (id, words, removed, kept text)"""
    words = [WORD.findall(t or "") for _, t in rows]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = Counter()
    for (i, _), w in zip(rows, words):
        keep = [True] * len(w)
        for p in range(len(w) - window + 1):
            if count[tuple(w[p : p + window])] > 1:
                keep[p : p + window] = [False] * window
        out[i, len(w), keep.count(False), " ".join(x for x, k in zip(w, keep) if k)] += 1
    return out


def without_similar_lines(rows, num=80, den=100, least=5):
    """{id: text}"""
    lines = []
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            s = frozenset(WORD.findall(lower(line)))
            if len(s) >= least:
                lines.append((i, k, s))
    lines.sort(key=lambda x: x[:2])
    gone = set()
    for j, (i, k, s) in enumerate(lines):
        if any(den * len(s & u) >= num * len(s | u) for _, _, u in lines[:j]):
            gone.add((i, k))
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}
