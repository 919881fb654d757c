"""Language ID by cross-parsing entropy.

One suffix automaton for each language holds a bounded sample of labelled text. A text is cut greedily
into the longest phrases that occur in a language's sample; the language that needs the fewest phrases,
times the logarithm of its sample's length, and with letters that it does not have paid for, wins. Texts are parsed whole: stretches of a long text are parsed
side by side and then joined, so that the count is that of one parse from its beginning.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import held, quoted, small_batches

#: Bounds of the training sample: documents and characters for each language, and languages.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_LANGUAGES = 200, 40_000, 256
#: Columns of the dense table of steps: the most frequent characters and one for unseen ones. Steps by the sample's other
#: characters, of which scripts such as Chinese have thousands, are few a state and are looked up in a sorted list.
ALPHABET = 96
#: Long texts are parsed in stretches of this many characters side by side, before the stretches are joined.
STRETCH = 2048
#: A sample that is shorter than the longest by more than so many halvings counts as if by so many: a few words are no language.
SHORT_BITS = 3.0
#: Places of marks, characters times languages, that are held at once.
MARKS = 1 << 25


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """The transitions of the suffix automaton of ``codes``, by state."""
    nexts, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        cur = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return nexts


def built(samples: dict[str, str]) -> "Model":
    """The model of these samples. Tasks carry the samples, which are small; each worker builds the automata once."""
    name = hashlib.sha256(repr(sorted(samples.items())).encode("utf-8", "surrogatepass")).hexdigest()
    return held(f"language id {name}", lambda: Model(samples))


class Model:
    """The automata in one table of steps: twice the next state, plus one where a phrase begins."""

    def __init__(self, samples: dict[str, str]):
        counts: dict[str, int] = {}
        for text in samples.values():
            for c in text:
                counts[c] = counts.get(c, 0) + 1
        chars = sorted(counts, key=lambda c: (-counts[c], c))
        self.width = wide = min(ALPHABET, len(chars) + 1)
        self.codes = {c: i if i < wide - 1 else i + 1 for i, c in enumerate(chars)}  # wide - 1 is for unseen ones
        self.rare = max(0, len(chars) - (wide - 1))
        self.languages = sorted(samples)
        tables, self.roots, self.logs, base = [], [], [], 0
        keys, values, agains = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], []
        self.lacks = np.zeros((len(self.languages), len(chars) + 1), bool)
        self.lacks[:, [self.codes[c] for c in chars if c.isalpha()]] = True
        for lang in self.languages:
            codes = [self.codes[c] for c in samples[lang]]
            self.lacks[len(self.roots), codes] = False
            nexts = suffix_automaton(codes)
            sizes = np.array([len(row) for row in nexts])
            state = np.repeat(np.arange(len(nexts)), sizes)
            code = np.array([c for row in nexts for c in row], np.int64)
            to = np.array([x for row in nexts for x in row.values()], np.int64)
            t = np.full((len(nexts), wide), -1, np.int32)
            dense = code < wide
            t[state[dense], code[dense]] = to[dense]
            again = np.where(t[0] >= 0, t[0], 0)  # where a phrase can't go on, the next one begins with this character
            step = np.where(t >= 0, 2 * (t + base), 2 * (again + base) + 1)
            step[0] = 2 * (again + base) + 1  # at the root a phrase begins; one of an unseen character ends at once
            tables.append(step.astype(np.int32))
            state, code, to = state[~dense], code[~dense] - wide, to[~dense]
            keys.append((state + base) * self.rare + code)
            values.append((2 * (to + base) + (state == 0)).astype(np.int32))
            again = np.full(self.rare, 2 * base + 1, np.int32)
            again[code[state == 0]] = 2 * (to[state == 0] + base) + 1
            agains.append(again)
            self.roots.append(base)
            self.logs.append(float(np.log2(max(2, len(codes)))))
            base += len(t)
        order = np.argsort(all_ := np.concatenate(keys))
        self.keys, self.values = all_[order], np.concatenate(values)[order]
        self.again = np.stack(agains) if agains else np.zeros((0, 0), np.int32)
        self.step = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        self.points = np.array(sorted(ord(c) for c in chars), np.uint32)
        self.of_points = np.array([self.codes[chr(p)] for p in self.points], np.int32)

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases needed by (text, language), each text parsed greedily from its beginning."""
        return self.parsed(texts)[0]

    def parsed(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """By (text, language): phrases, and letters that the language does not have."""
        sizes = np.array([len(t) for t in texts], np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.minimum(np.searchsorted(self.points, points), max(0, len(self.points) - 1))
        codes = np.where(self.points[at] == points, self.of_points[at], self.width - 1).astype(np.int32)
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        some = max(1, MARKS // max(1, len(codes)))
        for lo in range(0, len(self.languages), some):
            out[:, lo : lo + some] = self._parse(codes, sizes, slice(lo, lo + some))
        return out, self._strange(codes, sizes)

    def _strange(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(text, language): the letters that the language's sample does not hold, but another's does. Each is a phrase, which a
        short sample would otherwise get cheaply; it costs one of the longest sample more. Signs and figures say nothing of a language."""
        out, some = np.zeros((len(sizes), len(self.languages)), np.int64), np.flatnonzero(sizes)
        if len(some):
            begins = (np.cumsum(sizes) - sizes)[some]
            for i in range(len(self.languages)):
                out[some, i] = np.add.reduceat(self.lacks[i][codes], begins, dtype=np.int64)
        return out

    def _went(self, states: np.ndarray, code: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Steps of states of the languages ``rows``; all three of one shape."""
        went = self.step[states.astype(np.int64) * self.width + np.minimum(code, self.width - 1)]
        if self.rare and (code >= self.width).any():
            at = np.nonzero(code >= self.width)
            key = states[at].astype(np.int64) * self.rare + (code[at] - self.width)
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            went[at] = np.where(self.keys[found] == key, self.values[found], self.again[rows[at], code[at] - self.width])
        return went

    def _parse(self, codes: np.ndarray, sizes: np.ndarray, block: slice) -> np.ndarray:
        """(text, language): stretches are parsed as if a phrase began with each; then each one's last phrase goes on into
        what follows until a phrase begins where one begins there too, from where on both parses are the same."""
        roots = np.array(self.roots[block], np.int32)
        lang = np.arange(len(self.languages))[block]
        lanes = -(-sizes // STRETCH)
        owner = np.repeat(np.arange(len(sizes)), lanes)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begins = np.cumsum(sizes) - sizes
        start = begins[owner] + within * STRETCH
        width = np.minimum(STRETCH, sizes[owner] - within * STRETCH)
        out = np.zeros((len(sizes), len(roots)), np.int64)
        if not len(owner):
            return out
        order = np.argsort(-width, kind="stable")
        first, wide = start[order], width[order]
        alive = np.searchsorted(-wide, -np.arange(wide[0]), side="left")  # stretches longer than k
        rare = self.rare and bool((codes >= self.width).any())
        states = np.repeat(roots[:, None], len(owner), 1)
        marks = np.zeros((len(roots), len(codes)), bool)  # where phrases begin
        for k in range(int(wide[0])):
            n = int(alive[k])
            code = codes[first[:n] + k]
            if rare:
                went = self._went(states[:, :n], np.broadcast_to(code, (len(roots), n)), np.broadcast_to(lang[:, None], (len(roots), n)))
            else:
                went = self.step[states[:, :n] * self.width + code]
            marks[:, first[:n] + k] = went & 1
            states[:, :n] = went >> 1
        single = np.flatnonzero(lanes == 1)
        sums = np.add.reduceat(marks, begins[lanes > 0], axis=1, dtype=np.int64) if len(single) else None
        if sums is not None:
            out[np.flatnonzero(lanes > 0)] = sums.T  # right for texts of one stretch
        if len(single) == np.count_nonzero(lanes):
            return out
        # Where each stretch's parse meets one of those after it, and how many phrases it begins before that.
        ends = begins + sizes
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        go = np.flatnonzero(within + 1 < lanes[owner])
        r, j = (x.ravel() for x in np.meshgrid(np.arange(len(roots)), go, indexing="ij"))
        meets, extra = np.zeros((len(roots), len(owner)), np.int64), np.zeros((len(roots), len(owner)), np.int64)
        state, at, end = states[r, back[j]], start[j] + width[j], ends[owner[j]]
        while len(r):
            went = self._went(state, codes[at], lang[r])
            starts = (went & 1).astype(bool)
            met = starts & marks[r, at]
            extra[r, j] += starts & ~met
            at, state = at + ~met, went >> 1
            stop = met | (at >= end)
            meets[r[stop], j[stop]] = at[stop]
            on = ~stop
            r, j, state, at, end = r[on], j[on], state[on], at[on], end[on]
        lead = np.cumsum(lanes) - lanes
        for i in np.flatnonzero(lanes > 1).tolist():
            for row in range(len(roots)):
                total, here = 0, int(begins[i])
                while here < ends[i]:
                    lane = int(lead[i] + (here - begins[i]) // STRETCH)
                    over = int(start[lane] + width[lane])
                    total += int(np.count_nonzero(marks[row, here:over])) + int(extra[row, lane])
                    here = int(meets[row, lane]) if over < ends[i] else over
                out[i, row] = total
        return out

    def predict(self, texts: list[str | None] | pa.Array, budget: int = 1 << 20) -> tuple[list[str], np.ndarray]:
        """Languages and scores; score is how far the best entropy is below the second best, from 0 to 1."""
        langs, scores = ["und"] * len(texts), np.zeros(len(texts))
        at, todo, held = [], [], 0
        for i, t in enumerate(texts):
            t = t.as_py() if isinstance(t, pa.Scalar) else t
            if t is not None and self.languages and any(map(str.isalpha, t)):
                at.append(i)
                todo.append(plain(t))
                held += len(t)
                if held >= budget:
                    self._some(at, todo, langs, scores)
                    at, todo, held = [], [], 0
        if todo:
            self._some(at, todo, langs, scores)
        return langs, scores

    def _some(self, at: list[int], texts: list[str], langs: list[str], scores: np.ndarray) -> None:
        phrases, strange = self.parsed(texts)
        logs = np.maximum(self.logs, max(self.logs) - SHORT_BITS)
        bits = phrases * logs + strange * max(self.logs)
        best = bits.argmin(1)  # ties: the first language by code point
        for j, i in enumerate(at):
            langs[i] = self.languages[best[j]]
        if bits.shape[1] > 1:
            two = np.partition(bits, 1, axis=1)
            scores[at] = np.clip(1 - two[:, 0] / np.maximum(two[:, 1], 1e-9), 0, 1)
        else:
            scores[at] = 1.0


def plain(text: str) -> str:
    """What is parsed: composed and in lower case."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower()


def train(labelled: DataFrame, docs_each: int = SAMPLE_DOCS, chars_each: int = SAMPLE_CHARS) -> dict[str, str]:
    """Sample rows (doc_id, text, lang). At most ``docs_each`` documents, chosen by a hash of their id, and
    ``chars_each`` characters of each language reach the driver; of each document an equal share at most. The first
    SAMPLE_LANGUAGES languages by code point are learned.
    Rows without a language, an id or a letter in the text teach nothing and are not chosen. Without any other, all texts
    are ``und``.
    """
    usable = labelled.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    usable = usable.select(F.col("lang"), F.col("doc_id"), F.xxhash64("text").alias("hash"), F.col("text"))
    known = [r["lang"] for r in usable.select("lang").distinct().orderBy("lang").limit(SAMPLE_LANGUAGES).collect()]
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "hash"))
    keys = usable.filter(F.col("lang").isin(known)).select("lang", "doc_id", "hash").withColumn("r", rank).filter(F.col("r") <= docs_each)
    # docs_each rows for each of SAMPLE_LANGUAGES languages at most: a bounded table. Rows that are repeated come once.
    few = F.broadcast(keys.select("lang", "doc_id", "hash").distinct())
    share = max(400, 4 * chars_each // docs_each)
    rows = usable.join(few, ["lang", "doc_id", "hash"]).groupBy("lang", "doc_id", "hash").agg(F.min(F.substring("text", 1, share)).alias("text")).collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["doc_id"], r["text"])):
        samples.setdefault(r["lang"], []).append(plain(r["text"]))
    return {lang: "\n".join(t[: level(texts, chars_each)] for t in texts)[:chars_each] for lang, texts in samples.items()}


def level(texts: list[str], whole: int) -> int:
    """The share of each text with which all of them together come to ``whole`` characters, or as near as they can."""
    rest, left = whole, len(texts)
    for n in sorted(len(t) + 1 for t in texts):
        if n * left > rest:
            return max(1, rest // left)
        rest, left = rest - n, left - 1
    return whole


def predictor(samples: dict[str, str]):
    """The UDF from a text to (lang_pred, score). Only texts go to Python, and only results come back."""

    @F.arrow_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = built(samples)
        for texts in batches:
            langs, scores = model.predict(texts)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return predicted


def identify(docs: DataFrame, model: dict[str, str], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(kept: a struct of the columns ``keep``, lang_pred, score) for each row, from the whole text alone.

    ``und`` with score 0 for a null text and one without letters. Rows may repeat; ids may be null; columns may have any name; an
    empty table gives no rows. Ties go to the first language by code point. A very long text is parsed whole; its marks take a byte a
    character and language at most. Only texts that repeat one character or phrase throughout may keep a stretch's parse from
    meeting the next, which costs time in proportion to the text but changes nothing.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*map(quoted, keep)).alias("kept"), predictor(model)(quoted(text_col).cast("string")).alias("said"))
    return rows.select("kept", "said.lang_pred", "said.score")


def held_out(docs: DataFrame):
    """True for documents whose crc32 of doc_id as text leaves 2 by 4; null ids are held out of nothing."""
    return F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 4 == 2, F.lit(False))
