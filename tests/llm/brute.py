"""Plain versions of the operators for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

BLANK = b" \t\n\x0b\x0c\r"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def data(text) -> bytes:
    return (text or "").encode()


def fold(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode()) % 5


def lines(docs, least):
    key = lambda line: line.strip(BLANK).lower()  # noqa: E731  bytes.lower() lowers A-Z only
    where = defaultdict(set)
    for i, t in docs:
        for line in data(t).split(b"\n"):
            where[key(line)].add(i)
    gone = {k for k, ids in where.items() if k and len(ids) >= least}
    out = []
    for i, t in docs:
        split = data(t).split(b"\n")
        kept = [x for x in split if key(x) not in gone]
        out.append((i, len(split), len(split) - len(kept), b"\n".join(kept)))
    return out


def exact(docs):
    norm = {n: re.sub(rb"[\x20\x09-\x0D]+", b" ", data(t)) for n, (_, t) in enumerate(docs)}
    groups = defaultdict(list)
    for n, (i, _) in enumerate(docs):
        groups[norm[n]].append(i)
    out = []
    for n, (i, _) in enumerate(docs):
        ids = [x for x in groups[norm[n]] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[norm[n]]), i == keep, sha(norm[n])))
    return out


def shingles(t, size):
    w = data(t).lower().split()
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def near(docs, size=4, percent=80):
    sets = [(i, shingles(t, size)) for i, t in docs]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (a, s) in enumerate(sets):
        for b, u in sets[:n]:
            if s and u and 100 * len(s & u) >= percent * len(s | u):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [(i, len(s), find(i)) for i, s in sets]


def judge(docs, items, size=13):
    windows = defaultdict(set)
    for item, t in items:
        w = WORD.findall(data(t).lower())
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[k : k + size])].add(item)
    sizes = sorted({len(w) for w in windows})
    out = []
    for i, t in docs:
        w = WORD.findall(data(t).lower())
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                got = windows.get(tuple(w[k : k + n]))
                if got:
                    hit.update(range(k, k + n))
                    found |= got
        names = sorted(map(str, found))
        out.append((i, len(w), len(hit), len(names), names, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def repeats(docs, length=400):
    seen = Counter(data(t)[k : k + length] for _, t in docs for k in range(len(data(t)) - length + 1))
    out = []
    for i, t in docs:
        b = data(t)
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out
