"""Plain restatements of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

WHITE = b" \t\n\x0b\x0c\r"


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def raw(text: str | None) -> bytes:
    return (text or "").encode()


def substring_dedup(docs: list[tuple[int, str | None]], window: int = 20) -> dict[int, tuple]:
    first: dict[tuple, tuple] = {}
    words = {d: raw(t).split() for d, t in docs}
    for d in sorted(words):
        w = words[d]
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), (d, i))
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] != (d, i):
                gone.update(range(i, i + window))
        out[d] = (len(w), len(gone), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def line_dedup(docs, min_rows: int = 5, min_chars: int = 40) -> dict[int, tuple]:
    holders = defaultdict(set)
    key = lambda line: line.strip(WHITE).lower()
    for d, t in docs:
        for line in raw(t).split(b"\n"):
            if len(key(line).decode()) >= min_chars:
                holders[key(line)].add(d)
    out = {}
    for d, t in docs:
        lines = raw(t).split(b"\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= min_rows and max(holders[key(x)]) != d)]
        out[d] = (len(lines), len(lines) - len(kept), sha(b"\n".join(kept)))
    return out


def shingles(text, size: int = 5) -> set:
    w = raw(text).lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def near_dedup(docs, percent: int = 85) -> dict[int, tuple]:
    sets = {d: shingles(t) for d, t in docs}
    posting = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            posting[x].append(d)
    shared = Counter()
    for p in posting.values():
        for i, a in enumerate(p):
            for b in p[i + 1 :]:
                shared[a, b] += 1
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def base_scores(docs) -> dict[int, tuple]:
    tokens = {d: [*raw(t).lower().split(), None] for d, t in docs}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in tokens}
    c = Counter(x for d, t in tokens.items() if not held[d] for x in t)
    n, v = sum(c.values()), len(c)
    out = {}
    for d, t in tokens.items():
        out[d] = (held[d], len(t), sum(x in c for x in t), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t))
    return out


def plain_words(text) -> list[bytes]:
    return bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in raw(text)).lower().split()


def overlaps(docs, items, span: int = 12, tolerance: int = 2) -> set:
    out = set()
    for d, t in docs:
        w = plain_words(t)
        for k, x in items:
            v = plain_words(x)
            size, least = (span, span - tolerance) if len(v) >= span else (len(v), len(v))
            for i in range(len(w) - size + 1 if size else 0):
                for j in range(len(v) - size + 1):
                    same = sum(a == b for a, b in zip(w[i : i + size], v[j : j + size], strict=True))
                    if same >= least:
                        out.add((d, i, k, j, size, same))
    return out
