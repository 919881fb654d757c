"""SimHash near-dedup with covering locality-sensitive hashing.

Fingerprints come from Arrow batches; candidate pairs from 2^(r+1) - 1 tables of structured bit masks.
Each bit position gets a random vector of r+1 bits; table v keeps the positions whose vector has an odd
product with v. The at most r positions in which two fingerprints differ span no more than r
dimensions, so some v has even products with all of them: the pair agrees on all that table keeps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from .common import components, cut, join_back, small_batches


def fingerprint(text: str | None, words: int = 3, seed: int = 42, chunk: int = 65536) -> int:
    """The 64-bit SimHash of the word shingles of ``text``; bytes.lower() and bytes.split() are ASCII only."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return 0
    whole, n = b" ".join(w), max(1, len(w) - words + 1)
    if len(w) <= words:
        spans = [(0, len(whole))]
    else:
        ends = np.cumsum([len(x) + 1 for x in w]) - 1
        spans = list(zip([0, *(ends[: n - 1] + 1).tolist()], ends[words - 1 :].tolist(), strict=True))
    h, counts, digest = memoryview(whole), np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, n, chunk):
        part = np.array([digest(h[a:b], seed) for a, b in spans[i : i + chunk]], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


@F.arrow_udf(LongType())
def fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array(np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts)).view(np.int64))


def masks(radius: int = 3, bits: int = 64, seed: int = 1) -> list[int]:
    """The covering masks: any two words at distance ``radius`` or less agree under one of them."""
    rng = np.random.default_rng(seed)
    each = rng.integers(1, 2 ** (radius + 1), bits)
    return [sum(1 << i for i, m in enumerate(each.tolist()) if (m & v).bit_count() & 1) for v in range(1, 2 ** (radius + 1))]


def settle(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n can reach over the edges (a, b)."""
    low = np.arange(n)
    while len(a):
        x, y = low[a], low[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(low, up := low[low]):
            low = up
    return low


def linked(x: np.ndarray, radius: int, depth: int = 0, small: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Edges among the distinct fingerprints ``x`` that connect all within ``radius`` and no others.

    A small bucket is compared whole. A larger one goes through covering masks of its own, so that
    buckets shrink by about half of the bits left each time; no pair within the radius is lost.
    """
    if len(x) <= small or depth > 12:
        out = []
        for i in range(0, len(x), small):
            near = np.bitwise_count(x[i : i + small, None] ^ x[None, :]) <= radius
            a, b = np.nonzero(near)
            keep = a + i < b
            out.append((a[keep] + i, b[keep]))
        return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for m in masks(radius, seed=100 + depth):
        key = x & np.uint64(m)
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        for group in np.split(order, cuts):
            if len(group) > 1:
                # A group that did not shrink has no bits to tell its members apart under this mask: go deeper.
                a, b = linked(x[group], radius, depth + 1, small)
                low = settle(len(group), a, b)
                moved = np.flatnonzero(low != np.arange(len(group)))
                found.append((group[moved], group[low[moved]]))
    a, b = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))
    return a, b


def bucket_links(radius: int):
    """mapInArrow over rows (t, key, fp) sorted by t, key: edges that connect each bucket's fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(rows: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)) + 1
            lo, hi = [0, *cuts.tolist()], [*cuts.tolist(), rows.shape[1]]
            us, vs = [], []
            for i, j in zip(lo, hi, strict=True):
                if j - i > 1:
                    x = np.unique(rows[2, i:j].view(np.uint64))
                    a, b = linked(x, radius)
                    low = settle(len(x), a, b)
                    moved = np.flatnonzero(low != np.arange(len(x)))
                    us.append(x[moved].view(np.int64))
                    vs.append(x[low[moved]].view(np.int64))
            u, v = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (us, vs))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        held: list[np.ndarray] = []  # of the last bucket seen, which the next batch may continue
        for b in batches:
            rows = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
            if not rows.shape[1]:
                continue
            ends = np.flatnonzero((rows[0] != rows[0, -1]) | (rows[1] != rows[1, -1]))
            at = int(ends[-1]) + 1 if len(ends) else 0
            if at == 0 and held and (held[-1][:2, -1] == rows[:2, 0]).all():
                held.append(rows)
                continue
            yield edges(np.concatenate([*held, rows[:, :at]], axis=1)) if at or held else edges(rows[:, :0])
            held = [np.ascontiguousarray(rows[:, at:])]
        if held:
            yield edges(np.concatenate(held, axis=1))

    return run


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each row of ``docs``.

    Whole texts count. Texts without words, null among them, have fingerprint zero and link like any
    other. Documents of one fingerprint form a class; classes at ``radius`` or fewer differing bits are
    linked, found through the covering tables and verified; component_id is the smallest doc_id that can
    be reached (null only if all ids there are null). Rows may repeat. Other columns are ignored.
    Hot fingerprints are combined before any shuffle; a bucket holds distinct fingerprints only and is
    searched without listing its pairs.
    """
    return classed(docs, id_col, text_col, radius).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("best.id").alias("component_id"))


def classed(docs: DataFrame, id_col: str, text_col: str, radius: int) -> DataFrame:
    """(doc_id, fp, best) for each row; best is (id, hash) of the row that stays of the component: the smallest doc_id, null last,
    then the smallest hash of the text."""
    small_batches(docs.sparkSession)
    text = docs[text_col].cast("string")
    rows = cut(docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), fingerprints(text).alias("fp")))
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "hash")
    classes = cut(rows.groupBy("fp").agg(F.min(first).alias("best"), F.count("*").alias("n")))
    tables = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m - 2**64 if m >> 63 else m).cast("long")).alias("key")) for t, m in enumerate(masks(radius))))
    dealt = classes.select("fp", F.explode(tables).alias("k")).select("k.t", "k.key", "fp").repartition("t", "key").sortWithinPartitions("t", "key")
    links = dealt.mapInArrow(bucket_links(radius), "u long, v long")
    of = components(links)
    linked_ = classes.join(of, classes["fp"] == of["id"]).select("fp", "best", "n", "component")
    lows = linked_.groupBy("component").agg(F.min("best").alias("low"))
    moved = linked_.join(lows, "component").select("fp", "low")
    total = classes.agg(F.sum("n")).first()[0] or 0
    classes = classes.join(moved, "fp", "left").select("fp", "n", F.coalesce("low", "best").alias("best"))
    return join_back(rows, classes, ["fp"], ["doc_id", "hash"], "n", total).select("doc_id", "fp", "hash", "best")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """One row of ``docs`` of each component, with its own columns: that of the smallest doc_id, null last; of rows of that id in the
    component the one whose text has the smallest hash, once if it is repeated."""
    stay = classed(docs, id_col, text_col, radius).select(F.col("best.id").alias("_i"), F.col("best.hash").alias("_h")).distinct()
    d = docs.select(F.struct("*").alias("_row"), docs[id_col].cast("long").alias("_id"), F.xxhash64(docs[text_col].cast("string")).alias("_hash"))
    d = d.join(stay, d["_id"].eqNullSafe(stay["_i"]) & (d["_hash"] == stay["_h"]), "left_semi")
    turn = F.row_number().over(Window.partitionBy("_id", "_hash").orderBy("_hash"))
    return d.withColumn("_turn", turn).filter("_turn = 1").select("_row.*")
