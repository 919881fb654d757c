"""Exact similarity of vectors: every vector against every block of vectors, by matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scale import components, cut


def block_search(least: float):
    """mapInArrow over rows (block, role, node, v) sorted so that a block's members (role 0) come before its queries (role 1): (u, v, n): n other
    vectors of this block at cosine ``least`` or more to u, and edges from u that join all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, nodes, parts, x, low = None, [], [], None, {}

        def root(h: int) -> int:
            while low.get(h, h) != h:
                low[h] = low.get(low[h], low[h])
                h = low[h]
            return h

        for b in batches:
            which, role, node = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            starts = np.flatnonzero(np.r_[True, (np.diff(which) != 0) | (np.diff(role) != 0)]) if b.num_rows else []
            for lo, hi in zip(starts, [*starts[1:], b.num_rows], strict=False):
                v = b.column(3).slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, -1)
                v = v / np.sqrt((v * v).sum(1, keepdims=True))
                if which[lo] != block:
                    block, nodes, parts, x, low = which[lo], [], [], None, {}
                if role[lo] == 0:
                    nodes.append(node[lo:hi])
                    parts.append(v)
                    continue
                if x is None:
                    x, members = np.concatenate(parts), np.concatenate(nodes)
                us, vs, ns = [], [], []
                for at in range(0, hi - lo, 512):
                    own = node[lo + at : min(hi, lo + at + 512)]
                    near = v[at : at + 512] @ x.T >= least
                    near &= own[:, None] != members[None, :]
                    for u, row in zip(own.tolist(), near, strict=True):
                        hit = np.flatnonzero(row)
                        if len(hit):
                            ends = list({root(h) for h in hit.tolist()})
                            for e in ends:
                                low[e] = ends[0]
                            us += [u] * len(ends)
                            vs += members[ends].tolist()
                            ns += [len(hit), *[0] * (len(ends) - 1)]
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64()), pa.array(ns, pa.int64())], ["u", "v", "n"])

    return run


def similar(vectors: DataFrame, id_col: str, vector_col: str, least: float, block: int = 4096) -> DataFrame:
    """(id, n_links, cluster_id) for each row: how many other vectors are at cosine ``least`` or more, and the smallest id that links reach.

    Exact, in double precision. Vectors are dealt over blocks of about ``block``; every vector meets every block, so the work grows
    with the square of the vectors, as a search of all pairs does; no pairs are listed. Null vectors, those of norm zero and those
    with null or non-finite parts link with nothing; all others must be of one length. An empty table gives no rows.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    v = cut(v.withColumns({"ok": F.coalesce(sound, F.lit(False)), "node": F.monotonically_increasing_id()}))
    good = v.filter("ok")
    blocks = max(1, -(-good.count() // block))
    members = good.select(F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("role"), "node", "v")
    asks = good.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("role"), "node", "v")
    rows = members.union(asks).repartition("block").sortWithinPartitions("block", "role", "node")
    found = cut(rows.mapInArrow(block_search(least), "u long, v long, n long"))
    links = found.groupBy("u").agg(F.sum("n").alias("n"))
    of = components(found.select("u", "v"))
    d = v.select("id", "node").join(links, F.col("node") == F.col("u"), "left").join(of.withColumnRenamed("id", "linked"), F.col("node") == F.col("linked"), "left")
    d = cut(d.select("id", F.coalesce("n", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "node").alias("root")))
    return d.join(d.groupBy("root").agg(F.min("id").alias("cluster_id")), "root").select("id", "n_links", "cluster_id")
