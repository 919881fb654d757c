"""Embedding near-dedup: a hierarchical navigable small-world graph for each shard of a label, asked by every vector of the label.

Beams are widened until audits against all pairs of a sample of queries lose nothing; cosines are verified; links are united.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, join_back


class Graph:
    """A hierarchical navigable small-world graph over unit vectors; batches are searched side by side."""

    def __init__(self, x: np.ndarray, degree: int = 16, seed: int = 0):
        self.x, n = x, len(x)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(1 - rng.random(n)) / np.log(degree)).astype(int), 8) if n else np.zeros(0, int)
        self.order = np.lexsort((np.arange(n), -level))  # upper layers first, so that a layer is a prefix
        self.x = np.ascontiguousarray(x[self.order])
        self.rough = self.x.astype(np.float32)  # steers the search; what it finds is verified in double precision
        level = level[self.order]
        self.sizes = [int((level >= k).sum()) for k in range(int(level.max(initial=0)) + 1)]
        self.near = [np.full((s, degree * (2 if k == 0 else 1)), -1, np.int32) for k, s in enumerate(self.sizes)]
        self.sim = [np.full(a.shape, -2.0) for a in self.near]
        at = 0
        while at < n:
            hi = min(n, max(at + 16, min(2 * at, at + 1024)))
            self._add(at, hi)
            at = hi

    def _add(self, lo: int, hi: int) -> None:
        ids = np.arange(lo, hi)
        q = self.x[lo:hi]
        entry = np.zeros((hi - lo, 1), np.int32)
        for k in range(len(self.sizes) - 1, -1, -1):
            mine = ids < self.sizes[k]
            width = self.near[k].shape[1]
            if lo:
                found, sims = self._beam(q, entry, k, max(32, width) if mine.any() else 4, min(lo, self.sizes[k]))
                entry = found[:, :4]
            else:
                found, sims = np.full((hi - lo, 1), -1, np.int32), np.full((hi - lo, 1), -2.0)
            if not mine.any():
                continue
            # Members of one batch see each other exactly.
            own = np.arange(int(mine.sum()))
            pair = q[own] @ q[own].T
            pair[own, own] = -2.0
            top = min(len(own), width)
            part = np.argpartition(-pair, top - 1, axis=1)[:, :top]
            cand = np.concatenate([found[own], part + lo], axis=1)
            cs = np.concatenate([sims[own], np.take_along_axis(pair, part, 1)], axis=1)
            cand[cs < -1.5] = -1
            # Half of the places go to the nearest, half are spread over the rest of what was found.
            best = np.argsort(-cs, axis=1, kind="stable")
            near, far = best[:, : width // 2], best[:, width // 2 :]
            far = far[:, np.linspace(0, far.shape[1] - 1, min(width // 4, far.shape[1])).astype(int)] if far.shape[1] else far
            pick = np.concatenate([near, far], axis=1)
            link, ls = np.take_along_axis(cand, pick, 1), np.take_along_axis(cs, pick, 1)
            self.near[k][lo : lo + len(own), : link.shape[1]] = link
            self.sim[k][lo : lo + len(own), : link.shape[1]] = np.where(link >= 0, ls, -2.0)
            self._back(k, ids[: len(own)], link, ls)

    def _back(self, k: int, ids: np.ndarray, link: np.ndarray, sims: np.ndarray) -> None:
        """Links back from the neighbours; a full node keeps half its places for old links."""
        src, dst, s = np.repeat(ids, link.shape[1]), link.ravel(), sims.ravel()
        ok = (dst >= 0) & ~(self.near[k][dst] == src[:, None]).any(1)  # no link twice: a beam would meet its end twice
        src, dst, s = src[ok], dst[ok], s[ok]
        order = np.lexsort((-s, dst))
        src, dst, s = src[order], dst[order], s[order]
        first = np.flatnonzero(np.r_[True, np.diff(dst) != 0])
        rank = np.arange(len(dst)) - np.repeat(first, np.diff(np.r_[first, len(dst)]))
        width = self.near[k].shape[1]
        used = (self.near[k] >= 0).sum(1)
        room = used[dst] + rank < width
        self.near[k][dst[room], used[dst[room]] + rank[room]] = src[room]
        self.sim[k][dst[room], used[dst[room]] + rank[room]] = s[room]
        full = ~room
        for d, c, t in zip(dst[full].tolist(), src[full].tolist(), s[full].tolist(), strict=True):
            half = self.sim[k][d, width // 2 :]
            w = int(half.argmin()) + width // 2
            if t > self.sim[k][d, w] and c not in self.near[k][d]:
                self.near[k][d, w], self.sim[k][d, w] = c, t

    def _beam(self, q: np.ndarray, entry: np.ndarray, k: int, width: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` best that a beam search of layer k meets among its first n nodes, for each row of q."""
        m, q = len(q), q.astype(np.float32)
        rows = np.arange(m)[:, None]
        seen = np.zeros((m, n), bool)
        entry = np.where((entry >= 0) & (entry < n), entry, 0)
        ids = np.full((m, width), -1, np.int32)
        sims = np.full((m, width), -2.0, np.float32)
        done = np.ones((m, width), bool)
        e = min(entry.shape[1], width)
        ids[:, :e] = entry[:, :e]
        sims[:, :e] = np.einsum("mcd,md->mc", self.rough[ids[:, :e]], q)
        for j in range(1, e):  # the same entry twice counts once
            sims[:, j][(ids[:, :j] == ids[:, j : j + 1]).any(1)] = -2.0
        done[:, :e] = sims[:, :e] < -1.5
        ids[sims < -1.5] = -1
        seen[rows, np.where(ids[:, :e] >= 0, ids[:, :e], entry[:, :1])] = True
        live = np.arange(m)
        while len(live):
            s = np.where(done[live], -3.0, sims[live])
            j = s.argmax(1)
            on = s[np.arange(len(live)), j] > -2.0
            live, j = live[on], j[on]
            if not len(live):
                break
            done[live, j] = True
            near = self.near[k][ids[live, j]]
            ok = (near >= 0) & (near < n)
            near = np.where(ok, near, 0)
            ok &= ~seen[live[:, None], near]
            seen[live[:, None], near] |= ok
            got = np.einsum("mcd,md->mc", self.rough[near], q[live])
            got[~ok] = -2.0
            both = np.concatenate([sims[live], got], axis=1)
            top = np.argpartition(-both, width - 1, axis=1)[:, :width] if both.shape[1] > width else np.tile(np.arange(both.shape[1]), (len(live), 1))
            sims[live] = np.take_along_axis(both, top, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(ok, near, -1)], axis=1), top, 1)
            done[live] = np.take_along_axis(np.concatenate([done[live], ~ok], axis=1), top, 1)
        best = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)

    def beam(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query the nodes and cosines that a search down the layers holds at the end, -1 where there is none."""
        n = self.sizes[0]
        entry = np.zeros((len(q), 1), np.int32)
        for k in range(len(self.sizes) - 1, 0, -1):
            entry = self._beam(q, entry, k, 4, self.sizes[k])[0]
        return self._beam(q, entry, 0, min(width, n), n)

    def within(self, q: np.ndarray, least: float, width: int, slack: float) -> list[np.ndarray]:
        """For each query the places of vectors at cosine ``least`` or more: a beam search down the layers,
        then a walk over all that is above ``least - slack``."""
        out: list[np.ndarray] = []
        n = self.sizes[0] if self.sizes else 0
        if not n:
            return [np.zeros(0, int)] * len(q)
        for at in range(0, len(q), 512):
            part = q[at : at + 512]
            ids, sims = self.beam(part, width)
            for i in range(len(part)):
                hit = ids[i][(sims[i] >= least - slack) & (ids[i] >= 0)]
                if not len(hit):
                    out.append(hit)
                    continue
                seen = np.zeros(n, bool)
                seen[ids[i][ids[i] >= 0]] = True
                all_, front = [hit], hit
                while len(front):
                    near = self.near[0][front].ravel()
                    near = np.unique(near[near >= 0])
                    near = near[~seen[near]]
                    seen[near] = True
                    front = near[self.x[near] @ part[i] >= least - slack]
                    all_.append(front)
                hit = np.unique(np.concatenate(all_))
                out.append(self.order[hit[self.x[hit] @ part[i] >= least]])
        return out


class Shard:
    """The vectors of a shard and their graph, with the beam width that the audit asks for.

    Audited queries are compared with all vectors of the shard, all links but those to themselves. They are the first ones of the label,
    from all its shards, as many as AUDIT_LINKS links take, AUDIT_LEAST at least and AUDIT_MOST at most. While more than one in a thousand of the links
    seen is lost, the beam doubles; where it would meet an eighth of the shard, the shard is searched without the graph. Audited queries get what
    the comparison found.
    """

    AUDIT_LINKS, AUDIT_LEAST, AUDIT_MOST = 400, 512, 8192

    def __init__(self, nodes: np.ndarray, sizes: np.ndarray, x: np.ndarray, least: float, width: int = 64, slack: float = 0.02):
        self.nodes, self.size, self.x, self.least, self.width, self.slack = nodes, sizes, x, least, width, slack
        self.graph: Graph | None = Graph(x)
        self.seen = self.links = 0
        self.low = list(range(len(x)))  # which of the shard's vectors are joined by links that were sent

    def root(self, h: int) -> int:
        low = self.low
        while low[h] != h:
            h = low[h] = low[low[h]]
        return h

    def joined(self, hit: np.ndarray) -> list[int]:
        """One of the vectors ``hit``'s joined groups each; from now on they are one, as the query that found them links to each of these."""
        ends = list({self.root(h) for h in hit.tolist()})
        for e in ends:
            self.low[e] = ends[0]
        return ends

    def audit(self, nodes: np.ndarray, q: np.ndarray) -> list[np.ndarray]:
        cos = q @ self.x.T
        cos[nodes[:, None] == self.nodes[None, :]] = -2.0
        truth = cos >= self.least
        self.seen += len(q)
        self.links += int(truth.sum())
        while self.graph is not None:
            found = self.graph.within(q, self.least, self.width, self.slack)
            lost = int(truth.sum()) - sum(int(truth[i, h].sum()) for i, h in enumerate(found))
            if lost * 1000 <= self.links:
                break
            self.width *= 2
            if self.width * 8 >= len(self.x):
                self.graph = None
        return [np.flatnonzero(t) for t in truth]

    def ask(self, nodes: np.ndarray, q: np.ndarray) -> list[np.ndarray]:
        """For each query the places of vectors at ``least`` or more, without itself."""
        out: list[np.ndarray] = []
        while len(out) < len(q) and self.graph is not None and self.seen < self.AUDIT_MOST and (self.seen < self.AUDIT_LEAST or self.links < self.AUDIT_LINKS):
            lo = len(out)
            out += self.audit(nodes[lo : lo + 256], q[lo : lo + 256])
        rest, ids = q[len(out) :], nodes[len(out) :]
        found = self.graph.within(rest, self.least, self.width, self.slack) if self.graph is not None else within(self.x, rest, self.least)
        return out + [h[self.nodes[h] != u] for u, h in zip(ids.tolist(), found, strict=True)]


def within(x: np.ndarray, q: np.ndarray, least: float) -> Iterator[np.ndarray]:
    """For each of ``q`` the places in ``x`` at cosine ``least`` or more; all of unit length, all pairs, by blocks."""
    for at in range(0, len(q), 512):
        part = q[at : at + 512]
        a, b = np.nonzero(part @ x.T >= least)
        yield from np.split(b, np.searchsorted(a, np.arange(1, len(part))))


def shard_search(least: float):
    """mapInArrow over rows (label, dims, shard, role, node, size, v) sorted so that a shard's members (role 0)
    come before its queries (role 1): (u, v, n) with n links of u in this shard and v one of them or u."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, shard = None, [], None

        def ask(nodes: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
            us, vs, ns = [], [], []
            for u, hit in zip(nodes.tolist(), shard.ask(nodes, q), strict=True):
                if len(hit):
                    ends = shard.nodes[shard.joined(hit)]
                    us += [u] * len(ends)
                    vs += ends.tolist()
                    ns += [int(shard.size[hit].sum()), *[0] * (len(ends) - 1)]
            return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64()), pa.array(ns, pa.int64())], ["u", "v", "n"])

        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            starts = np.flatnonzero(np.r_[True, np.any([np.diff(c) != 0 for c in cols[:4]], axis=0)]) if b.num_rows else []
            for lo, hi in zip(starts, [*starts[1:], b.num_rows], strict=False):
                flat = b.column(6).slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(hi - lo, -1)
                x = flat / np.sqrt((flat * flat).sum(1, keepdims=True))
                if (now := tuple(c[lo] for c in cols[:3])) != key:
                    key, members, shard = now, [], None
                if cols[3][lo] == 0:
                    members.append((cols[4][lo:hi], cols[5][lo:hi], x))
                else:
                    shard = shard or Shard(*(np.concatenate(part) for part in zip(*members, strict=True)), least)
                    yield ask(cols[4][lo:hi], x)

    return run


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93, shard_size: int = 4096) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors``.

    Vectors are linked when their labels are equal and not null and their cosine, in double precision, is
    ``least`` or more. Equal vectors of a label form a class, which is searched once and whose copies
    count as links. Each label's classes are dealt by a hash over shards of about ``shard_size`` with a graph each; every
    class asks every shard of its label. Links are verified, so none is wrong; recall is audited in each shard (``Shard``).
    Asking every shard is the square of a label's distinct vectors over the shard size, in searches.

    Null vectors, vectors of norm zero and vectors with null or non-finite parts link with nothing, nor do
    rows with a null label; vectors of different lengths never link. Null ids link like others and are never the smallest; the component of
    null ids alone is null. Rows that repeat an id are vectors
    of their own and share the component. kept is ``vec_id = component_id`` (null ids: false). An empty table gives
    no rows. A label with a third of all rows is spread over its shards, a class with a third of them over tasks.
    """
    v = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[label_col].cast("long").alias("label"), vectors[vector_col].cast("array<double>").alias("v"))
    sound = F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.withColumn("hash", F.when(F.coalesce(sound, F.lit(False)), F.xxhash64("v")))
    # Classes are made in each task before the shuffle. Cut, so that their numbers stay.
    classes = v.filter("hash is not null").groupBy("label", "hash", "v").agg(F.min("vec_id").alias("low"), F.count("*").alias("size"))
    classes = cut(classes.select("*", F.monotonically_increasing_id().alias("node"), F.size("v").alias("dims")))
    counts = classes.groupBy("label", "dims").agg(F.count("*").alias("n"))
    total = classes.agg(F.sum("size")).first()[0] or 0
    dealt = join_back(classes, counts, ["label", "dims"], ["node"], "n", total).withColumn("shards", F.ceil(F.col("n") / shard_size).cast("int"))
    cols = ["label", "dims", "shard", "role", "node", "size", "v"]
    members = dealt.withColumns({"shard": F.pmod(F.xxhash64("hash", F.lit(1)), F.col("shards")).cast("int"), "role": F.lit(0)}).select(cols)
    asks = dealt.withColumns({"shard": F.explode(F.sequence(F.lit(0), F.col("shards") - 1)), "role": F.lit(1)}).select(cols)
    rows = members.union(asks).repartition("label", "dims", "shard").sortWithinPartitions("label", "dims", "shard", "role", "node")
    found = cut(rows.mapInArrow(shard_search(least), "u long, v long, n long"))
    linked = found.groupBy("u").agg(F.sum("n").alias("others"))
    of = components(found.select("u", "v"))
    c = classes.select("label", "hash", "v", "low", "size", "node")
    c = c.join(linked, c["node"] == linked["u"], "left").join(of, c["node"] == of["id"], "left").withColumn("root", F.coalesce("component", "node"))
    c = cut(c.select("label", "hash", "v", "low", "size", "root", (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("n_links")))
    lows = c.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n"))
    c = join_back(c, lows, ["root"], ["label", "hash"], "n", total).select("label", "hash", "v", "size", "n_links", "component_id")
    out = join_back(v.filter("hash is not null"), c, ["label", "hash", "v"], ["vec_id"], "size", total).select("vec_id", "n_links", "component_id")
    out = out.union(v.filter("hash is null").select("vec_id", F.lit(0).cast("long"), F.col("vec_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
