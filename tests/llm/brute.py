"""Plain restatements of what the dealt operators return, on lists of (doc_id, text)."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def crc(n) -> int:
    return zlib.crc32(str(n).encode())


def ids_bytes(ids) -> bytes:
    return b"".join(int(i).to_bytes(4, "little") for i in ids)


def components(docs, size: int, percent: int) -> dict[int, tuple[int, int, bool]]:
    """doc_id: set size, least doc_id reachable, kept."""
    sets = {}
    for i, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    both: Counter = Counter()
    for group in holders.values():
        both.update(itertools.combinations(sorted(group), 2))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), c in both.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def base_quality(text: str | None) -> tuple[int, int, int, int, int, bool]:
    t = text or ""
    w = WORD.findall(t)
    windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
    seen, again = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), again, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def phrases(text: str | None, sought) -> tuple[int, int, int | None, int | None, str]:
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places, labels = [], set()
    for phrase, label in sought:
        p = phrase.split()
        at = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def unigram(docs) -> dict[int, tuple[bool, int, int, int, float]]:
    """doc_id: held_out, n_tokens, n_known, train_tokens, base_score."""
    tokens = {i: [*WORD.findall((t or "").translate(LOWER)), "\n"] for i, t in docs}
    out = {i: crc(i) % 7 == 2 for i in tokens}
    c = Counter(x for i, w in tokens.items() if not out[i] for x in w)
    n, v = sum(c.values()), len(c)
    return {i: (out[i], len(w), sum(c[x] > 0 for x in w), n, math.fsum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for i, w in tokens.items()}


def context_tree(train: list[bytes], texts: list[bytes], depth: int) -> list[float]:
    """log10 probability of each text (with its end) by weighted contexts of up to `depth` bytes, node by node."""
    end = b"\n"
    nodes: dict[tuple, list[int]] = defaultdict(lambda: [0, 0])

    def decisions(text: bytes):
        data = end * depth + text + end
        for k in range(depth, len(data)):
            for j in range(8):
                yield data[k - depth : k][::-1], 1 << j | data[k] >> 8 - j, data[k] >> 7 - j & 1  # nearest byte first

    for t in train:
        for context, seen, bit in decisions(t):
            for d in range(depth + 1):
                nodes[context[:d], seen][bit] += 1
    children = defaultdict(set)
    for context, seen in nodes:
        if context:
            children[context[:-1], seen].add(context)

    def kt(zeros, ones):
        return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(zeros + ones + 1) - math.log(math.pi)

    weighted: dict[tuple, float] = {}
    stay: dict[tuple, float] = {}
    for context, seen in sorted(nodes, key=lambda x: -len(x[0])):
        own = kt(*nodes[context, seen])
        if len(context) == depth:
            weighted[context, seen], stay[context, seen] = own, 1.0
            continue
        longer = sum(weighted[c, seen] for c in children[context, seen])
        top = max(own, longer)
        both = top + math.log(0.5 * math.exp(own - top) + 0.5 * math.exp(longer - top))
        weighted[context, seen], stay[context, seen] = both, 0.5 * math.exp(own - both)

    def probability(context, seen, bit):
        p = None
        for d in range(depth, -1, -1):
            key = (context[:d], seen)
            if key in nodes:
                own = (nodes[key][bit] + 0.5) / (sum(nodes[key]) + 1)
                p = own if p is None else stay[key] * own + (1 - stay[key]) * p
        return 0.5 if p is None else p

    return [math.fsum(math.log10(probability(*d)) for d in decisions(t)) for t in texts]


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def nnpu(rows, labels, steps, min_rows=5, min_purity=0.6):
    """Scores of all rows by the non-negative risk, written as a plain function of the weights; slopes by differences."""
    import re

    def features(text):
        out = set()
        for w in re.findall(r"[a-z0-9]+", text.lower()):
            out |= {w} | {w[:k] + "*" for k in range(4, 9) if len(w) > k}
        return out

    own = {i: features(t) for i, t in rows}
    confirmed = [i for i, _ in rows if labels.get(i) == 1]
    prior = sum(labels.values()) / len(labels)
    strength = {}
    for f in set().union(*own.values()):
        p, u = sum(f in own[i] for i in confirmed), sum(f in x for x in own.values())
        purity = prior * p / len(confirmed) / ((u + 1) / (len(rows) + 1))
        if p >= min_rows and purity >= min_purity:
            strength[f] = p * purity
    names = sorted(strength, key=lambda f: (-strength[f], f))
    x = np.array([[f in own[i] for f in names] for i, _ in rows], dtype=float)
    c = np.array([[f in own[i] for f in names] for i in confirmed], dtype=float)

    def parts(w, b):
        loss = lambda z: np.log1p(np.exp(-z))
        return prior * loss(c @ w + b).mean(), loss(-(x @ w + b)).mean() - prior * loss(-(c @ w + b)).mean()

    theta, m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, steps + 1):
        _, rest = parts(theta[:-1], theta[-1])
        risk = (lambda t: sum(parts(t[:-1], t[-1]))) if rest >= 0 else (lambda t: -parts(t[:-1], t[-1])[1])
        grad = np.array([(risk(theta + 1e-5 * e) - risk(theta - 1e-5 * e)) / 2e-5 for e in np.eye(len(theta))])
        grad[:-1] += 1e-4 * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - 0.1 * (1 - step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return {i: 1 / (1 + np.exp(-(row @ theta[:-1] + theta[-1]))) for (i, _), row in zip(rows, x, strict=True)}
