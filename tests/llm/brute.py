"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = re.compile(r"[\x20\x09-\x0D]")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def exact(rows):
    """{(doc_id, row number): (keep_id, size)} and the digests; rows are (doc_id, text)."""
    groups = defaultdict(list)
    for i, (d, t) in enumerate(rows):
        groups[SPACE.sub("", t or "")].append((-len(t or ""), d is None, d, i))
    out = {}
    for norm, g in groups.items():
        keep = min(g)[2]
        for _, _, d, i in g:
            out[i] = (d, keep, len(g), hashlib.sha256(norm.encode()).hexdigest())
    return out


def fingerprint(text):
    w = [x.translate(LOWER) for x in WORD.findall(text or "")]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(ids, linked):
    """The smallest id that each can reach; ``linked`` is a symmetric boolean matrix with a true diagonal."""
    low = np.array(ids)
    while True:
        now = np.where(linked, low[None, :], np.iinfo(np.int64).max).min(1)
        if (now == low).all():
            return low.tolist()
        low = now


def repeats(rows, length=50):
    """Counter of (doc_id, n_bytes, n_removed, n_spans, kept_sha256), one for each row (doc_id, text); null ids are smaller than all others."""
    place = lambda d: -(2**63) if d is None else d
    first, out = {}, Counter()
    for d, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            first[b[p : p + length]] = min(place(d), first.get(b[p : p + length], place(d)))
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < place(d):
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d, len(b), sum(gone), sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1])), hashlib.sha256(kept).hexdigest()] += 1
    return out


def lines(rows):
    """Counter of (doc_id, n_lines, n_removed, text) by windows of three lines; one for each row."""
    place = lambda r: (r[0] is not None, r[0] or 0, int(hashlib.md5(r[1].encode()).hexdigest()[:8], 16) & 2**30 - 1 if r[1] is not None else 0)
    first, out = {}, Counter()
    for r in sorted(rows, key=place):
        x = r[1].split("\n") if r[1] is not None else []
        for i in range(len(x) - 2):
            first.setdefault(tuple(x[i : i + 3]), (place(r), i))
    for r in rows:
        if r[1] is None:
            out[r[0], 0, 0, None] += 1
            continue
        x = r[1].split("\n")
        gone = {i + k for i in range(len(x) - 2) if (place(r), i) > first[tuple(x[i : i + 3])] for k in range(3)}
        out[r[0], len(x), len(gone), "\n".join(y for i, y in enumerate(x) if i not in gone)] += 1
    return out


def targets(sizes, weights=(5, 2, 1)):
    """{source: target}; sizes by source, None last."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    budget, full = 1.5 * sum(sizes.values()), set()
    while True:
        open_ = [s for s in order if s not in full]
        level = (budget - sum(2 * sizes[s] for s in full)) / sum(w[s] for s in open_) if open_ else 0
        more = {s for s in open_ if level * w[s] > 2 * sizes[s]}
        if not more:
            return {s: 2.0 * sizes[s] if s in full else level * w[s] for s in order}
        full |= more


def cut_edges(shard, text):
    """Pairs of equal texts that lie in two shards; a group's pairs are counted from its members by shard."""
    groups = defaultdict(lambda: defaultdict(int))
    for d, t in text.items():
        groups[t][shard[d]] += 1
    return sum((sum(g.values()) ** 2 - sum(n * n for n in g.values())) // 2 for g in groups.values())


def propagated(text, shards, rounds=20):
    """{id: shard} by plain label propagation under quotas: one document at a time, in order, moves to the shard with most of its
    copies, if there is a document without copies, or one that gains by it, to change places with."""
    ids = sorted(text)
    shard = {d: i % shards for i, d in enumerate(ids)}
    copies = defaultdict(list)
    for d in ids:
        copies[text[d]].append(d)
    for _ in range(rounds):
        moved = 0
        for d in ids:
            near = defaultdict(int)
            for e in copies[text[d]]:
                near[shard[e]] += e != d
            to = max(sorted(near), key=lambda s: near[s], default=shard[d])
            if len(copies[text[d]]) < 2 or to == shard[d] or near[to] <= near[shard[d]]:
                continue
            mine = shard[d]
            loss = {e: sum(shard[x] == to for x in copies[text[e]] if x != e) - sum(shard[x] == mine for x in copies[text[e]] if x != e) for e in ids if shard[e] == to and text[e] != text[d]}
            other = min(loss, key=lambda e: (loss[e], e), default=None)
            if other is not None and loss[other] < near[to] - near[mine]:
                shard[d], shard[other] = to, mine
                moved += 1
        if not moved:
            break
    return shard


RULES = {("com", "/en/"): "block", ("example.com", "/en/7"): "allow", ("net", "/de/"): "allow", ("example.net", "/de/8"): "block", ("org", "/es/"): "block"}


def reputation(rows, bound=0.5, z=1.645):
    """(page_id, host, path, rule, verdict): rules, then beta-binomial shrinkage from all pages down to the host."""
    parts = []
    for page, url in rows:
        head, sep, rest = (url or "").partition("://")
        rest = rest if sep else ""
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = host.translate(LOWER)
        fits = [h + p for h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, key=len, default=None)
        parts.append((page, host, path, rule, next((v for (h, p), v in RULES.items() if h + p == rule), None)))
    suffix, domain = (lambda h: h.split(".")[-1]), (lambda h: ".".join(h.split(".")[-2:]))
    levels = [defaultdict(lambda: [0, 0]) for _ in range(3)]
    for _, host, _, _, said in parts:
        for level, key in zip(levels, (suffix(host), domain(host), host), strict=True):
            level[key][0] += said is not None
            level[key][1] += said == "block"
    n, k = (sum(x[i] for x in levels[0].values()) for i in (0, 1))
    mean = defaultdict(lambda: (k + 1) / (n + 2))
    for level, up in zip(levels, (lambda key: None, suffix, domain), strict=True):
        mu = {key: mean[up(key)] for key in level}
        spread = sum((b - a * mu[key]) ** 2 - a * mu[key] * (1 - mu[key]) for key, (a, b) in level.items() if a)
        scale = sum(a * (a - 1) * mu[key] * (1 - mu[key]) for key, (a, b) in level.items())
        strength = 1 / min(0.5, max(0.001, spread / scale if scale else 0.5)) - 1
        post = {key: (mu[key] * strength + b, (1 - mu[key]) * strength + a - b) for key, (a, b) in level.items()}
        mean = {key: a / (a + b) for key, (a, b) in post.items()}
    bad = {key: a / (a + b) - z * (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5 > bound for key, (a, b) in post.items()}
    return [(page, host, path, rule, said or ("block" if bad[host] else "allow")) for page, host, path, rule, said in parts]
