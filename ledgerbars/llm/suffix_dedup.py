"""Suffix-array dedup: bytes of later documents that repeat a string of an earlier one.

A suffix array holds only what fits a task, so strings that may repeat are brought together by content first, with no loss:

1. Equal texts become one, by digest and whole text; long texts are split into pieces that overlap. Pieces are dealt into units,
   written once as a bucketed table; two passes read it in place before the last one cuts the bytes.
2. In each window (string of ``length`` bytes) the smallest hash of the short strings in it is its anchor; equal windows have equal
   anchors. Units send what anchors they hold (sorted, four bytes each); those in two places come back.
3. Consecutive windows of one such anchor are a context. Contexts go, with their bytes, to their anchor's shard; equal ones are made
   one by comparing their bytes, in each unit and then in all. A shard keeps of them what another context of the anchor may hold
   too, sorts the suffixes of all that is left by induction, and its permuted common prefixes tell for each window the smallest document.
4. Units take the answers for their contexts and cut the bytes; the pieces of a long text are put together again.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_back, release
from .suffix_array import common_prefixes, suffix_array

#: Bytes of the strings whose hashes are anchors, bytes of text a unit aims at, and bytes of a long text's pieces.
GRAM, UNIT_BYTES, PIECE_BYTES = 24, 12_000_000, 4_000_000
#: Bytes of contexts that a shard takes together; an anchor's contexts are never parted.
SHARD_BYTES = 1 << 20
#: Where a null doc_id sorts.
NOWHERE = -(2**63)
MIX1, MIX2, BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0x100000001B3)


def mixed(x: np.ndarray, by: np.uint64) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * by
    return x ^ (x >> np.uint64(29))


def grams(text: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position; positions too near the end have meaningless values."""
    n = len(text)
    power = {k: np.uint64(pow(int(BASE), k, 2**64)) for k in (1, 2, 4, 8)}
    h = {1: text.astype(np.uint64) + np.uint64(1)}
    for k in (1, 2, 4, 8):
        h[2 * k] = h[k] * power[k]
        h[2 * k][: n - k] += h[k][k:]
        if k != 8:
            del h[k]
    out = h[16] * power[8]
    out[: max(0, n - 16)] += h[8][16:]
    return mixed(out, MIX1)


def window_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of x[i : i + width], for each i; shorter at the end."""
    m, k = x.copy(), 1
    while 2 * k <= width:
        m[: len(m) - k] = np.minimum(m[: len(m) - k], m[k:])
        k *= 2
    if k < width:
        rest = width - k
        m[: len(m) - rest] = np.minimum(m[: len(m) - rest], m[rest:].copy())
    return m


def spread(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """True at the places that some [start, end) covers."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:n]) > 0


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class Texts:
    """The pieces of a unit, end to end."""

    def __init__(self, table: pa.Table):
        self.pids, self.keys = (table.column(c).to_numpy() for c in ("pid", "low"))
        data = table.column("bytes").combine_chunks()
        data = data if isinstance(data, pa.Array) else pa.concat_arrays(data.chunks)
        offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1] if len(data) else np.zeros(1, np.int32)
        self.at = (offsets - offsets[0]).astype(np.int64)
        self.sizes = np.diff(self.at)
        self.bytes = np.frombuffer(data.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if self.at[-1] else np.zeros(0, np.uint8)

    def windows(self, length: int) -> np.ndarray:
        """True where a window of a piece starts."""
        some = self.sizes >= length
        return spread(self.at[:-1][some], self.at[1:][some] - length + 1, len(self.bytes))

    def ranges(self, most: int = 1 << 17) -> Iterator[tuple[int, int]]:
        """Ranges of whole pieces of about ``most`` bytes, so that work arrays stay in a core's cache."""
        lo = 0
        for end in self.at[1:].tolist():
            if end - lo >= most:
                yield lo, end
                lo = end
        if lo < len(self.bytes):
            yield lo, len(self.bytes)


def contexts(t: Texts, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(starts, ends, anchors): the runs of window starts that have one anchor."""
    left = t.windows(length)
    for lo, hi in t.ranges():
        ok = left[lo:hi]
        if not ok.any():
            continue
        m = window_min(grams(t.bytes[lo:hi]), length - GRAM + 1)
        new = ok.copy()
        new[1:] &= (m[1:] != m[:-1]) | ~ok[:-1]
        s = np.flatnonzero(new)
        over = np.flatnonzero(ok & ~np.concatenate([ok[1:], [False]])) + 1  # ends of stretches of windows
        e = np.minimum(np.concatenate([s[1:], [len(ok)]]), over[np.searchsorted(over, s, side="right")])
        yield s + lo, e + lo, mixed(m[s], MIX2)


def bucketed(anchor: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    return ((anchor >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24), (anchor & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def wanted(known: pa.Table) -> np.ndarray:
    """The sorted tags that came back: bucket above, four bytes below."""
    tags = [np.frombuffer(x, np.uint32).astype(np.uint64) | np.uint64(b << 32) for b, x in zip(known.column("bucket").to_pylist(), known.column("blob").to_pylist(), strict=True)]
    return np.sort(np.concatenate(tags)) if tags else np.zeros(0, np.uint64)


def among(want: np.ndarray, x: np.ndarray, buckets: int) -> np.ndarray:
    b, r = bucketed(x, buckets)
    tag = (b << np.uint64(32)) | r.astype(np.uint64)
    return want[np.minimum(np.searchsorted(want, tag), len(want) - 1)] == tag if len(want) else np.zeros(len(x), bool)


def match_anchors(key: tuple, rows: pa.Table) -> pa.Table:
    """Of a bucket: for each unit the anchors that are in several places."""
    once, twice = ([np.frombuffer(x, np.uint32) for x in rows.column(c).to_pylist()] for c in ("once", "twice"))
    each, counts = np.unique(np.concatenate([np.unique(np.concatenate(p)) for p in zip(once, twice, strict=True)]), return_counts=True)
    often = np.unique(np.concatenate([each[counts > 1], *twice]))
    mine = [np.concatenate([t, x[np.isin(x, often, assume_unique=True)]]) for x, t in zip(once, twice, strict=True)]
    keep = [i for i, x in enumerate(mine) if len(x)]
    units = rows.column("unit").to_pylist()
    return pa.table([pa.array([units[i] for i in keep], pa.int32()), pa.array([key[0].as_py()] * len(keep), pa.int32()), pa.array([np.sort(mine[i]).tobytes() for i in keep], pa.binary())], ["unit", "bucket", "blob"])


def pack(unit: int, found: np.ndarray, buckets: int) -> pa.Table:
    """Tags by bucket, four bytes each: those that are there once, and those that are there more often."""
    all_, counts = np.unique(found, return_counts=True)
    b, r = bucketed(all_, buckets)
    cuts = np.searchsorted(b, np.arange(buckets + 1, dtype=np.uint64))
    rows = [(i, r[x:y], counts[x:y]) for i, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) if y > x]
    data = [[unit] * len(rows), [i for i, _, _ in rows], [np.sort(x[c == 1]).tobytes() for _, x, c in rows], [np.sort(x[c > 1]).tobytes() for _, x, c in rows]]
    return pa.table([pa.array(x, k) for x, k in zip(data, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["unit", "bucket", "once", "twice"])


def send_anchors(length: int, buckets: int):
    """A unit's anchors by bucket; ``twice``: those it holds in several places."""

    def run(key: tuple, docs: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.uint64), *(anchor for _, _, anchor in contexts(Texts(docs), length))]
        return pack(key[0].as_py(), np.concatenate(found), buckets)

    return run


CONTEXT = "unit int, anchor long, digest long, context binary, low long, n int, places binary"


def send_contexts(length: int, buckets: int):
    """Cogroup of a unit's pieces with its shared anchors: the contexts, equal ones of the unit as one. ``low`` is the smallest document
    of the unit that holds it, ``places`` are (piece's row, first window) as pairs of 32-bit numbers."""

    def run(key: tuple, docs: pa.Table, known: pa.Table) -> pa.Table:
        want = wanted(known) if docs.num_rows else np.zeros(0, np.uint64)
        t, found = Texts(docs), {}
        raw = memoryview(t.bytes)
        for s, e, anchor in contexts(t, length) if len(want) else ():
            hit = among(want, anchor, buckets)
            s, e, anchor = s[hit], e[hit], anchor[hit]
            row = np.searchsorted(t.at, s, side="right") - 1
            for a, x, y, r in zip(anchor.view(np.int64).tolist(), s.tolist(), (e + length - 1).tolist(), row.tolist(), strict=True):
                found.setdefault((a, bytes(raw[x:y])), []).append((r, x))
        flat = np.array([p for places in found.values() for p in places], np.int64).reshape(-1, 2)
        sizes = np.array([len(p) for p in found.values()], np.int64)
        first = np.cumsum(sizes) - sizes
        low = np.minimum.reduceat(t.keys[flat[:, 0]], first) if len(first) else np.zeros(0, np.int64)
        pairs = np.stack([flat[:, 0], flat[:, 1] - t.at[flat[:, 0]]], 1).astype(np.int32).tobytes()
        cuts = (np.concatenate([first, [len(flat)]]) * 8).tolist()
        digests = b"".join(hashlib.blake2b(c, digest_size=8).digest() for _, c in found)
        cols = [
            pa.array(np.full(len(found), key[0].as_py() if found else 0, np.int32)), pa.array([a for a, _ in found], pa.int64()), pa.array(np.frombuffer(digests, np.int64)), pa.array([c for _, c in found], pa.binary()),
            pa.array(low), pa.array(sizes.astype(np.int32)), pa.array([pairs[x:y] for x, y in zip(cuts, cuts[1:], strict=False)], pa.binary()),
        ]
        return pa.table(cols, ["unit", "anchor", "digest", "context", "low", "n", "places"])

    return run


def window_hashes(x: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` bytes from each position, from those of the short strings that cover them."""
    h = grams(x)
    out = h.copy()
    for at in [*range(GRAM, length - GRAM, GRAM), length - GRAM]:
        out *= MIX1
        out[: len(out) - at] ^= h[at:]
    return mixed(out, MIX2)


def repeated(pieces: list[bytes], docs: np.ndarray, length: int) -> list[np.ndarray]:
    """For each of ``pieces`` the offsets of windows that a piece of a smaller document holds too."""
    s, owner, at = [], [], []
    for i, c in enumerate(pieces):
        s += [b + 2 for b in c]
        s.append(1)
        owner.append(np.full(len(c) + 1, i))
        at.append(np.arange(len(c) + 1))
    owner_, at_ = np.concatenate(owner), np.concatenate(at)
    sa = suffix_array(s, 258)
    shared = np.array(common_prefixes(s, sa))
    order = np.array(sa)
    sizes = np.array([len(c) for c in pieces])
    full = at_[order] + length <= sizes[owner_[order]]  # the suffix begins with a window of its piece
    group = np.cumsum(~((shared >= length) & full & np.concatenate([[False], full[:-1]])))
    o, g = order[full], group[full]
    d = docs[owner_[o]]
    low = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(low, g, d)
    o = o[low[g] < d]
    o = o[np.lexsort((at_[o], owner_[o]))]
    cuts = np.searchsorted(owner_[o], np.arange(len(pieces) + 1))
    return [at_[o[x:y]] for x, y in zip(cuts, cuts[1:], strict=False)]


def solve(anchors: np.ndarray, texts: list[bytes], lows: np.ndarray, length: int) -> list[list[int]]:
    """For each context, of whole anchors in order, the ranges of its windows that a smaller document has in another context of its anchor,
    as starts and ends in turn."""
    sizes = np.array([len(c) for c in texts], np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(texts)), sizes)
    ok = spread(at[:-1], at[1:] - length + 1, int(at[-1]))
    place = np.flatnonzero(ok)
    tag = window_hashes(np.frombuffer(b"".join(texts), np.uint8), length)[place] ^ mixed(anchors[owner[place]].view(np.uint64), MIX1)
    order = np.argsort(tag, kind="stable")
    again = tag[order[1:]] == tag[order[:-1]]
    some = np.zeros(len(ok), bool)
    some[place[order[1:][again]]] = some[place[order[:-1][again]]] = True
    some[at[1:-1]] &= ok[at[1:-1]]
    # Pieces: stretches of windows that may be elsewhere too. Equal pieces of an anchor are sorted once, for their smallest document.
    edge = np.concatenate([[True], (owner[1:] != owner[:-1])]) if len(owner) else np.zeros(0, bool)
    begins = np.flatnonzero(some & (edge | ~np.concatenate([[False], some[:-1]])))
    ends = np.flatnonzero(some & (np.concatenate([edge[1:], [True]]) | ~np.concatenate([some[1:], [False]]))) + 1
    raw = b"".join(texts)
    parts = [(int(anchors[owner[x]]), raw[x : y + length - 1], int(owner[x]), int(x - at[owner[x]])) for x, y in zip(begins.tolist(), ends.tolist(), strict=True)]
    low: dict[tuple[int, bytes], int] = {}
    many: dict[int, int] = {}
    for a, piece, i, _ in parts:
        if (a, piece) not in low:
            many[a] = many.get(a, 0) + 1
        low[a, piece] = min(int(lows[i]), low.get((a, piece), int(lows[i])))
    keys = [k for k in low if many[k[0]] > 1]
    hits = dict(zip(keys, repeated([p for _, p in keys], np.array([low[k] for k in keys]), length), strict=True)) if keys else {}
    out: list[list[int]] = [[] for _ in texts]
    for a, piece, i, first in parts:
        if lows[i] > low[a, piece]:
            out[i] += [first, first + len(piece) - length + 1]
        elif len(h := hits.get((a, piece), ())):
            flags = np.zeros(int(h[-1]) + 1, bool)
            flags[h] = True
            for x, y in zip(*(z.tolist() for z in runs(flags)), strict=True):
                out[i] += [first + x, first + y]
    return out


def shard_arrays(length: int):
    """mapInArrow over distinct contexts (anchor, digest, context, low, places, rows) sorted by anchor: the answers for those of which any
    window goes anywhere: (anchor, digest, rows, least document, windows, gone: ranges that go in that document too)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        todo: list[pa.RecordBatch] = []  # whole anchors, then the last one, which the next batch may continue
        held = 0

        def flush(table: pa.Table) -> pa.RecordBatch:
            anchors, digests, lows = (table.column(c).to_numpy() for c in ("anchor", "digest", "low"))
            several = np.zeros(len(anchors), bool)
            same = anchors[1:] == anchors[:-1]
            several[1:] |= same
            several[:-1] |= same
            if (same & (digests[1:] == digests[:-1])).any():
                raise ValueError("two contexts of an anchor have one digest")
            at = np.flatnonzero(several)
            gone: list[list[int]] = [[]] * len(anchors)
            for i, g in zip(at.tolist(), solve(anchors[at], table.column("context").take(pa.array(at)).to_pylist(), lows[at], length) if len(at) else (), strict=True):
                gone[i] = g
            keep = np.flatnonzero((table.column("places").to_numpy() > 1) | np.fromiter(map(bool, gone), bool, len(gone)))
            windows = (pa.compute.binary_length(table.column("context")).to_numpy()[keep] - (length - 1)).astype(np.int32)
            cols = [anchors[keep], digests[keep], table.column("rows").to_numpy()[keep], lows[keep], windows]
            return pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array([gone[i] for i in keep.tolist()], pa.list_(pa.int32()))], ["anchor", "digest", "rows", "least", "windows", "gone"])

        for b in batches:
            if not b.num_rows:
                continue
            todo.append(b)
            held += b.nbytes
            if held < SHARD_BYTES:
                continue
            table = pa.Table.from_batches(todo)
            anchors = table.column("anchor").to_numpy()
            ends = np.flatnonzero(anchors != anchors[-1])
            if len(ends):
                last = int(ends[-1]) + 1
                for lo, hi in parts_of(table, anchors, last):
                    yield flush(table.slice(lo, hi - lo))
                todo = table.slice(last).combine_chunks().to_batches()
                held = sum(x.nbytes for x in todo)
        if todo:
            table = pa.Table.from_batches(todo)
            for lo, hi in parts_of(table, table.column("anchor").to_numpy(), table.num_rows):
                yield flush(table.slice(lo, hi - lo))

    def parts_of(table: pa.Table, anchors: np.ndarray, last: int) -> Iterator[tuple[int, int]]:
        """Ranges of rows before ``last`` of about SHARD_BYTES that end with an anchor."""
        size = np.cumsum(pa.compute.binary_length(table.column("context")).to_numpy()[:last])
        ends = np.flatnonzero(np.diff(anchors[:last], append=anchors[last - 1] - 1 if last else 0) != 0) + 1
        lo = before = 0
        for e in ends.tolist():
            if size[e - 1] - before >= SHARD_BYTES or e == last:
                yield lo, e
                lo, before = e, size[e - 1]

    return run


RESULT = "pid long, digest binary, piece int, pieces int, low long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, opens boolean, closes boolean"


def cut_bytes(length: int):
    """Cogroup of a unit's pieces with the answers for its contexts: what is left of each piece; its bytes only where a text has several."""

    def run(key: tuple, docs: pa.Table, known: pa.Table) -> pa.Table:
        t = Texts(docs)
        gone = np.zeros(len(t.bytes), bool)
        if known.num_rows:
            pairs = np.frombuffer(b"".join(known.column("places").to_pylist()), np.int32).reshape(-1, 2)
            each = np.repeat(np.arange(known.num_rows), known.column("n").to_numpy())
            at, own = t.at[pairs[:, 0]] + pairs[:, 1], t.keys[pairs[:, 0]]
            whole = own > known.column("least").to_numpy()[each]
            starts, ends = [at[whole]], [at[whole] + known.column("windows").to_numpy()[each[whole]]]
            ranges = known.column("gone").combine_chunks()
            ranges = ranges if isinstance(ranges, pa.Array) else pa.concat_arrays(ranges.chunks)
            counts = pa.compute.list_value_length(ranges).to_numpy(zero_copy_only=False) // 2
            flat = pa.compute.list_flatten(ranges).to_numpy(zero_copy_only=False).reshape(-1, 2)
            part = ~whole & (counts[each] > 0)
            times = counts[each[part]]
            first = (np.cumsum(counts) - counts)[each[part]]
            pick = np.repeat(first - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
            starts.append(np.repeat(at[part], times) + flat[pick, 0])
            ends.append(np.repeat(at[part], times) + flat[pick, 1])
            gone = spread(np.concatenate(starts), np.concatenate(ends) + length - 1, len(gone))
        rows = []
        front, size = (docs.column(c).to_pylist() for c in ("front", "own"))
        for i, (a, n_pieces) in enumerate(zip(t.at[:-1].tolist(), docs.column("pieces").to_pylist(), strict=True)):
            lo, hi = a + front[i], a + front[i] + size[i]
            g = gone[lo:hi]
            n = int(g.sum())
            kept = (t.bytes[lo:hi][~g] if n else t.bytes[lo:hi]).tobytes()
            edge = (bool(g[0]), bool(g[-1])) if len(g) else (False, False)
            rows.append((hi - lo, n, len(runs(g)[0]) if n else 0, hashlib.sha256(kept).hexdigest() if n_pieces == 1 else None, kept if n_pieces > 1 else None, *edge))
        names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "opens", "closes"]
        kinds = [pa.int64()] * 3 + [pa.string(), pa.binary(), pa.bool_(), pa.bool_()]
        made = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        own_ = ["pid", "digest", "piece", "pieces", "low"]
        return pa.table([*(docs.column(c) for c in own_), *made], [*own_, *names])

    return run


def put_together(key: tuple, pieces: pa.Table) -> pa.Table:
    """The pieces of one long text as one row; a run that goes on from one piece into the next is one."""
    rows = sorted(pieces.to_pylist(), key=lambda r: r["piece"])
    both = sum(a["closes"] and b["opens"] for a, b in zip(rows, rows[1:], strict=False))
    digest = hashlib.sha256()
    for r in rows:
        digest.update(r["kept"])
    total = {c: [sum(r[c] for r in rows)] for c in ("n_bytes", "n_removed", "n_spans")}
    total["n_spans"][0] -= both
    cols = {"digest": pa.array([rows[0]["digest"]], pa.binary()), "low": pa.array([rows[0]["low"]], pa.int64())}
    return pa.table(cols | {c: pa.array(x, pa.int64()) for c, x in total.items()} | {"kept_sha256": pa.array([digest.hexdigest()])})


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, unit_bytes: int = UNIT_BYTES, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row for each row of ``docs``.

    Texts are UTF-8 bytes; null is empty. A byte goes if a string of ``length`` bytes that covers it also
    starts in a document with a smaller doc_id; overlaps count, and strings are judged on the input.
    Strings repeated within one document alone stay. Texts shorter than ``length`` are kept. A null doc_id is smaller than all others
    (and equal to -2^63). Rows that repeat a doc_id, or have none, are documents of their own that take nothing
    from each other. An empty table gives no rows. Other columns are ignored. A text longer than
    ``piece_bytes`` is split over units with ``length`` - 1 bytes of its neighbours on each side; only its
    kept bytes meet again in one task. Exact, whatever the anchors: equal windows have equal anchors.
    """
    spark = docs.sparkSession
    key = F.coalesce(docs[id_col].cast("long"), F.lit(NOWHERE).cast("long"))
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), key.alias("key"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    name = f"suffix_dedup_{uuid.uuid4().hex}"
    pause = min(1.5, total / 2e8)  # a spent shuffle of a few megabytes may stay for a while
    # One text of each digest, by its whole bytes; each task combines its rows before the only shuffle of texts.
    whole = rows.groupBy("digest", "text").agg(F.min("key").alias("low"), F.count("*").alias("copies"))
    n, reach = F.octet_length("text"), length - 1
    pieces = F.greatest(F.lit(1), F.ceil(n / piece_bytes)).cast("int")
    split = whole.select("digest", "low", "copies", F.col("text").cast("binary").alias("bytes"), n.alias("size"), pieces.alias("pieces"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    lo = F.col("piece").cast("long") * piece_bytes
    front = F.least(lo, F.lit(reach)).cast("int")
    own = F.least(F.lit(piece_bytes), F.col("size") - lo).cast("int")
    part = F.when(F.col("pieces") == 1, F.col("bytes")).otherwise(F.substring("bytes", (lo - front + 1).cast("int"), front + own + reach))
    # Units are parts of the write's tasks, so that a unit's rows are in one file. A task gets an even share of all bytes, or what adaptive
    # execution puts together, which text outgrows about threefold.
    units = max(1, -(-total // unit_bytes))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    merged = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes"))
    parts = min(units, max(-(-units // tasks), -(-3 * merged // unit_bytes)))
    of_ = lambda pid: (F.shiftright(pid, 33) * parts + F.pmod(F.xxhash64(pid), F.lit(parts))).cast("int")
    dealt = split.select("digest", "low", "copies", "pieces", "piece", front.alias("front"), own.alias("own"), part.alias("bytes")).withColumn("pid", F.monotonically_increasing_id())
    dealt = dealt.withColumn("unit", of_(F.col("pid")))
    write = lambda df, table: df.write.option("compression", "zstd").bucketBy(max(1, min(tasks, int(units))), "unit").sortBy("unit").saveAsTable(table)
    try:
        write(dealt, name)
        del dealt, split, whole
        release(spark, pause)
        texts = spark.table(name)
        buckets = max(4, int(units))
        only = texts.select("unit", "pid", "low", "bytes")
        sent = only.groupBy("unit").applyInArrow(send_anchors(length, buckets), "unit int, bucket int, once binary, twice binary")
        shared = cut(sent.groupBy("bucket").applyInArrow(match_anchors, "unit int, bucket int, blob binary"))
        del sent
        release(spark, pause)
        found = only.groupBy("unit").cogroup(shared.groupBy("unit")).applyInArrow(send_contexts(length, buckets), CONTEXT)
        found.write.option("compression", "zstd").saveAsTable(f"{name}_contexts")
        del found, shared
        release(spark, pause)
        found = spark.table(f"{name}_contexts")
        # Equal contexts by their bytes, in one shuffle by anchor: a context that a third of all documents hold is one row a unit already.
        distinct = found.select("anchor", "digest", "context", "low", "n").repartition("anchor").groupBy("anchor", "digest", "context").agg(F.min("low").alias("low"), F.sum("n").alias("places"), F.count("*").alias("rows"))
        answers = distinct.sortWithinPartitions("anchor", "digest").mapInArrow(shard_arrays(length), "anchor long, digest long, rows long, least long, windows int, gone array<int>")
        answers = cut(answers)
        del distinct
        release(spark, pause)
        rows_ = answers.agg(F.sum("rows")).first()[0] or 0
        told = join_back(found.select("unit", "anchor", "digest", "n", "places"), answers, ["anchor", "digest"], ["unit"], "rows", rows_).select("unit", "n", "places", "least", "windows", "gone")
        left = texts.groupBy("unit").cogroup(told.groupBy("unit")).applyInArrow(cut_bytes(length), RESULT)
        left = cut(left)
        cols = ["digest", "low", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        long_ = left.filter("pieces > 1").groupBy("digest").applyInArrow(put_together, "digest binary, low long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
        done = left.filter("pieces = 1").select(cols).union(long_.select(cols))
        sizes = texts.filter("piece = 0").select("digest", "copies")
        done = cut(done.join(sizes, "digest"))
        n_rows = done.agg(F.sum("copies")).first()[0] or 0
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.sql(f"DROP TABLE IF EXISTS {name}_contexts")
    out = join_back(rows.select("doc_id", "key", "digest"), done, ["digest"], ["key"], "copies", n_rows)
    # A text that a smaller document has too is gone as a whole, if it is long enough to hold a window.
    copy = (F.col("key") > F.col("low")) & (F.col("n_bytes") >= length)
    pick = lambda then, name: F.when(copy, then).otherwise(F.col(name)).alias(name)
    return out.select("doc_id", "n_bytes", pick(F.col("n_bytes"), "n_removed"), pick(F.lit(1).cast("long"), "n_spans"), pick(F.lit(hashlib.sha256(b"").hexdigest()), "kept_sha256"))
