"""Plain statements of what the operators compute, for small inputs."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import xxhash


class Groups:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def unite(self, a, b):
        self.up[self.find(a)] = self.find(b)


def simhash(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i: i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def within(marks: list[int], bits: int) -> list[int]:
    """Component name (smallest index) of each mark, linked at that many differing bits or fewer."""
    groups = Groups()
    for i, a in enumerate(marks):
        groups.find(i)
        for j in range(i):
            if (a ^ marks[j]).bit_count() <= bits:
                groups.unite(i, j)
    least = defaultdict(lambda: len(marks))
    for i in range(len(marks)):
        least[groups.find(i)] = min(least[groups.find(i)], i)
    return [least[groups.find(i)] for i in range(len(marks))]


def repeats(texts: list[bytes], span: int = 400) -> list[tuple[int, int, int, str]]:
    seen = Counter(t[i: i + span] for t in texts for i in range(len(t) - span + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - span + 1):
            if seen[t[i: i + span]] > 1:
                gone[i: i + span] = b"\1" * span
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def kept_lines(rows: list[tuple], like: float, width: int, least: int) -> list[str]:
    """Texts of (doc_id, text) rows with unique ids, of alike lines only the first."""
    def cut(line):
        return {line[i: i + width] for i in range(max(1, len(line) - width + 1))}

    places = defaultdict(list)
    for doc_id, text in rows:
        for i, line in enumerate(text.split("\n")):
            if len(line) >= least:
                places[line].append((doc_id, i))
    lines = list(places)
    sets, groups, first = [cut(x) for x in lines], Groups(), {}
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= like * len(a | sets[j]):
                groups.unite(lines[i], lines[j])
    for line in lines:
        root = groups.find(line)
        first[root] = min(first.get(root, min(places[line])), min(places[line]))
    return ["\n".join(x for i, x in enumerate(text.split("\n")) if len(x) < least or first[groups.find(x)] == (doc_id, i))
            for doc_id, text in rows]


def base_scores(texts: dict[int, str], held) -> dict[int, tuple]:
    words = {k: (t or "").encode().lower().split() for k, t in texts.items()}
    counts = Counter(w for k, ws in words.items() if not held(k) for w in [*ws, None])
    n, v = sum(counts.values()), len(counts)
    return {k: (len(ws) + 1, sum(counts[w] > 0 for w in [*ws, None]), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*ws, None]))
            for k, ws in words.items()}


def jaccard(a: str, b: str) -> float:
    a, b = Counter(a.split()), Counter(b.split())
    top = sum((a | b).values())
    return sum((a & b).values()) / top if top else 1.0


def crc(ids) -> int:
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))
