"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text is cut into marked words (spaces become U+2581 and stay with the word they precede). The distinct
words of a batch are sorted, which is a depth-first walk of their trie: forward states are kept for the
prefix that a word shares with the one before and computed only for the rest.

For a unigram model the forward state is the best score and its last piece. For a BPE model, whose
"scores" are merge ranks, the state is the last piece of the prefix's encoding: the one vocabulary piece
that ends there and that merging leaves apart from the piece before it. An encoding is what merging gives
exactly if all its neighbours are so, hence the states give the merge result and not the best rank sum.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, quoted, small_batches

MARK = "▁"
#: Words whose ids, and pairs of pieces whose merging, a worker keeps between batches; beyond that it forgets and computes again.
CACHE_WORDS, CACHE_PAIRS = 1 << 19, 1 << 18


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield tag >> 3, data[at : at + n]
            at += n


class Codec:
    """A model's pieces with an encoder and a decoder; pickles to what the executors need."""

    def __init__(self, model: bytes):
        self.name = hashlib.sha256(model).hexdigest()
        self.pieces: list[str] = []
        self.ids: dict[str, int] = {}
        self.scores: list[float] = []
        self.byte_ids: dict[int, int] = {}
        self.unknown, self.bpe, self.prefix = 0, False, True
        for number, value in fields(model):
            if number == 1:
                piece = dict(fields(value))
                text, kind, i = piece[1].decode(), piece.get(3, 1), len(self.pieces)
                self.pieces.append(text)
                self.scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                if kind in (1, 4):
                    self.ids[text] = i
                elif kind == 2:
                    self.unknown = i
                elif kind == 6:
                    self.byte_ids[int(text[3:5], 16)] = i
            elif number == 2:
                self.bpe = dict(fields(value)).get(3, 1) == 2
            elif number == 3:
                rules = dict(fields(value))
                self.prefix = bool(rules.get(3, 1))
                if rules.get(2) or rules.get(4, 1) or not rules.get(5, 1):
                    raise ValueError("models that normalise characters, drop spaces or leave spaces as they are are not supported")
        known = {c for p in self.ids for c in p if c in self.ids}
        if any(MARK in p.lstrip(MARK) for p in self.ids) or any(c not in known for p in self.ids for c in p):
            raise ValueError("pieces that cross words, or hold characters that are no piece, are not supported")
        self.longest: dict[str, int] = {}  # of the pieces that end in these three characters, or are no longer than that
        for p in self.ids:
            self.longest[p[-3:]] = max(self.longest.get(p[-3:], 0), len(p))
        self.segment = re.compile("([^" + "".join(map(re.escape, sorted(known))) + "])")
        self.words = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
        self.apart: dict[int, bool] = {}
        by_byte = {i: bytes([b]) for b, i in self.byte_ids.items()}
        normal = set(self.ids.values())
        self.raw = [by_byte.get(i, p.replace(MARK, " ").encode() if i in normal else b" \xe2\x81\x87 " if i == self.unknown else b"") for i, p in enumerate(self.pieces)]

    def merge(self, text: str) -> list[str]:
        """Plain merging: again and again the leftmost pair of the best piece."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stays(self, before: int, piece: int) -> bool:
        """Whether merging leaves ``piece`` whole and apart from the piece ``before`` it; -1: the word begins."""
        if len(self.apart) >= CACHE_PAIRS:
            self.apart.clear()
        x, y = self.pieces[before] if before >= 0 else "", self.pieces[piece]
        known = self.apart[before << 32 | piece] = self.merge(x + y) == [z for z in (x, y) if z]
        return known

    def walk(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """Ids of each of the sorted distinct ``words``, whose characters are all pieces."""
        get, longest, scores, apart, stays, bpe = self.ids.get, self.longest.get, self.scores, self.apart.get, self.stays, self.bpe
        before, last, start, best = "", [-1], [0], [0.0]  # states at each position of the current path
        for w in words:
            n, m = len(w), min(len(w), len(before))
            k = 0
            while k < m and w[k] == before[k]:
                k += 1
            del last[k + 1 :], start[k + 1 :], best[k + 1 :]
            for i in range(k + 1, n + 1):
                far = (longest(w[i - 3 : i]) if i > 2 else None) or (2 if i > 1 and w[i - 2 : i] in self.ids else 1)
                if bpe:
                    for j in range(i - far if i > far else 0, i):
                        if (p := get(w[j:i])) is not None:
                            if (ok := apart(last[j] << 32 | p)) is None:
                                ok = stays(last[j], p)
                            if ok:
                                break
                    last.append(p)
                    start.append(j)
                else:
                    top = -1e30
                    for j in range(i - far if i > far else 0, i):
                        if (p := get(w[j:i])) is not None and best[j] + scores[p] > top:
                            choice, at, top = p, j, best[j] + scores[p]
                    last.append(choice)
                    start.append(at)
                    best.append(top)
            out, i = [], n
            while i > 0:
                out.append(last[i])
                i = start[i]
            before = w
            yield w, out[::-1]

    def encode_words(self, words: set[str]) -> dict[str, bytes]:
        """Ids, as packed 32-bit numbers, of marked words of any characters."""
        odd = self.segment.search
        mixed = {w: [s for s in self.segment.split(w) if s] for w in words if odd(w)}
        rest = {s for p in mixed.values() for s in p}
        strange = {s for s in rest if odd(s)}
        packed = {w: array("i", ids).tobytes() for w, ids in self.walk(sorted((words - mixed.keys()) | (rest - strange)))}
        for s in strange:
            packed[s] = array("i", [self.byte_ids[b] for b in s.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown]).tobytes()
        packed |= {w: b"".join(map(packed.__getitem__, p)) for w, p in mixed.items()}
        return packed

    def marked(self, text: str | None) -> list[str]:
        return self.words.findall(MARK * self.prefix + text.replace(" ", MARK)) if text else []

    def encode(self, texts: list[str | None], cache: dict[str, bytes] | None = None) -> list[bytes]:
        cache = {} if cache is None else cache
        marked = [self.marked(t) for t in texts]
        distinct = set().union(*marked)
        if new := distinct.difference(cache):
            if len(cache) + len(new) > CACHE_WORDS:
                cache.clear()
                new = distinct
            cache.update(self.encode_words(new))
        return [b"".join(map(cache.__getitem__, m)) for m in marked]

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids.tolist()))
        return raw[1:].decode("utf-8", "replace") if self.prefix and raw[:1] == b" " else raw.decode("utf-8", "replace")


def coder(codec: Codec, batch_chars: int = 1 << 20):
    """The UDF from a text to (ids, n_tokens, decoded). Only texts go to Python, and only results come back."""

    @F.arrow_udf("ids array<int>, n_tokens int, decoded string")
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache, codec.apart = held(f"sentencepiece {codec.name}", lambda: ({}, codec.apart))  # words and pairs met so far
        for whole in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(whole), 0).to_numpy(zero_copy_only=False)
            group = np.cumsum(sizes) // batch_chars
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(whole)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                texts = whole.slice(lo, hi - lo).to_pylist()
                packed = codec.encode(texts, cache)
                ends = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
                flat = np.frombuffer(b"".join(packed), np.int32)
                decoded = pa.array([None if t is None else codec.decode(flat[i:j]) for t, i, j in zip(texts, ends, ends[1:], strict=False)], pa.string())
                yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(np.diff(ends)), decoded], ["ids", "n_tokens", "decoded"])

    return coded


def load(path: str) -> Codec:
    """Read a .model file on the driver; executors get the codec with the task."""
    with open(path, "rb") as f:
        return Codec(f.read())


def encode_decode(docs: DataFrame, codec: Codec, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(kept: a struct of the columns ``keep``, ids, n_tokens, decoded) for each row.

    ``decoded`` comes from the ids alone and equals the text, but that a literal U+2581 comes back as a
    space. Null and empty texts have no ids; a null decodes to null. Characters that are no piece become
    UTF-8 byte pieces. Rows may repeat; columns may have any name; an empty table gives no rows. Very long texts are one word list
    at a time; memory is bounded by the Arrow batch and the two caches.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*map(quoted, keep)).alias("kept"), coder(codec)(quoted(text_col).cast("string")).alias("coded"))
    return rows.select("kept", "coded.ids", "coded.n_tokens", "coded.decoded")
