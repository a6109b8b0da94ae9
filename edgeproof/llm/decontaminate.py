"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are normalised (lower case, every run of other characters than letters and digits one
space). Benchmark items are cut into overlapping windows, long ones for edited copies and short
ones for parts of items: any short + short_step - 1 = 63 normalised characters of an item hold a whole
short window, which is found with up to 3 edits. A window w of length m that occurs in a
document with at most k edits shares at least m + 1 - q (k + 1) q-grams with it, all within
2k + 1 neighbouring diagonals. So documents' q-grams are looked up in the windows' q-grams, hits
are counted in overlapping bands of diagonals, and bands that meet the bound are verified by a
banded alignment, many bands side by side. A cheap form of the same bound on runs of hits, for short
and for long windows, leaves most text untouched. An item shorter than a gram is held by a text that
is nothing else.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, cut, mix64, scan, slices, text_slices

_BASE = 0x100000001B3
#: What is worked on at once: bytes of text, hits of grams. They bound a task's memory.
SLICE_BYTES, SLICE_HITS = 1_000_000, 500_000


@dataclass(frozen=True)
class Budget:
    """Window length and step in normalised characters, the same of the short windows that find
    parts of items, gram length, edits a character."""

    window: int = 120
    step: int = 60
    short: int = 48
    short_step: int = 16
    q: int = 8
    rate: float = 0.08
    #: Characters of benchmark text a pass over the documents looks for: the bound on what is sent
    #: to every task. A larger benchmark takes more passes.
    block_chars: int = 4_000_000

    def edits(self, m: int) -> int:
        """Edits allowed in m characters: the rate, as far as the lemma still demands a fifth of m."""
        k = int(self.rate * m)
        while k and m + 1 - self.q * (k + 1) < m / 5:
            k -= 1
        return k


_LOWER = np.arange(0x110000, dtype=np.uint32)
_WORDY = np.zeros(0x110000, dtype=bool)


def _tables() -> None:
    if not _WORDY.any():
        for c in range(0x30000):
            if chr(c).isalnum():
                _WORDY[c] = True
                low = chr(c).lower()
                if len(low) == 1:
                    _LOWER[c] = ord(low)


def normalise(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised code points of all texts end to end (a 0 between texts), each one's place in its
    text, and the start of each text."""
    _tables()
    data = "\x00".join(t.replace("\x00", " ") for t in texts) + "\x00"
    codes = np.frombuffer(data.encode("utf-32-le", "surrogatepass"), np.uint32)
    wordy, stop = _WORDY[codes], codes == 0
    gap = ~wordy & ~stop
    keep = wordy | stop
    keep[1:] |= gap[1:] & wordy[:-1]
    kept = np.flatnonzero(keep)
    out = _LOWER[codes[kept]]
    out[gap[kept]] = 32  # a stop is its own lower case, 0
    at = np.flatnonzero(out == 0)
    begun = np.concatenate([[0], at[:-1] + 1])
    kept -= np.repeat(np.concatenate([[0], kept[at[:-1]] + 1]), np.diff(np.append(begun, len(out))))
    return out, kept, begun


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q code points from each place on (0 where a text ends before)."""
    n = len(codes)
    if n < q:
        return np.zeros(n, np.uint64)
    h, have = np.zeros(n, np.uint64), 0
    runs, size = codes.astype(np.uint64), 1
    # Hashes of runs of 1, 2, 4... characters: those that add up to q are put together.
    while True:
        if q & size:
            h = _joined(runs, h, size, have)
            have += size
        if have == q:
            break
        runs, size = _joined(runs, runs, size, size), 2 * size
    h = mix64(h)
    stops = np.flatnonzero(codes == 0)
    h[np.maximum(stops[:, None] - np.arange(q), 0).ravel()] = 0
    h[n - q + 1 :] = 0
    return h


def _joined(left: np.ndarray, right: np.ndarray, size: int, more: int) -> np.ndarray:
    """Hashes of runs of size + more characters from those of their first size and of the more after them."""
    out = left * np.uint64(pow(_BASE, more, 1 << 64))
    out[: len(out) - size] += right[size:]
    return out


def align_all(patterns: np.ndarray, codes: np.ndarray, base: np.ndarray, end: np.ndarray, diagonal: np.ndarray, band: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least edits of each pattern (a row) against any part of codes[base:end] whose path stays within
    the band around its diagonal: edits (over most if there is none), start, end. All pairs go row by
    row over the band together; those that can't stay within most leave."""
    n, m = patterns.shape
    big, offs = np.int32(10**6), np.arange(2 * band + 1, dtype=np.int32)
    edits, first, last = np.full(n, most + 1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    who, shift = np.arange(n), (diagonal - band)[:, None]
    lo, hi = (base - diagonal + band)[:, None], (end - diagonal + band)[:, None]  # of the text, from column 0 of row 0 on
    row = np.where((offs >= lo) & (offs <= hi), 0, big).astype(np.int32)
    start = np.broadcast_to(offs, row.shape)
    for i in range(m):
        at = offs + np.int32(i)
        inside = (at >= lo) & (at < hi)
        same = codes[np.where(inside, at + shift, 0)] == patterns[who, i][:, None]
        diag = np.where(inside, row + ~same, big)
        up = np.append(row[:, 1:] + 1, np.full((len(row), 1), big), axis=1)
        take = diag <= up
        best = np.where(take, diag, up) - offs
        low = np.minimum.accumulate(best, axis=1)
        src = np.maximum.accumulate(np.where(best == low, offs, 0), axis=1)
        start = np.take_along_axis(np.where(take, start, np.append(start[:, 1:], np.zeros((len(row), 1), np.int32), axis=1)), src, 1)
        row = low + offs
        if i % 8 == 7 or i == m - 1:
            ok = row.min(axis=1) <= most
            if not ok.all():
                row, start, who, shift, lo, hi = (x[ok] for x in (row, start, who, shift, lo, hi))
            if not len(who):
                return edits, first, last
    j = row.argmin(axis=1)
    rows = np.arange(len(who))
    edits[who], first[who], last[who] = row[rows, j], start[rows, j] + shift[:, 0], j + shift[:, 0] + m
    return edits, first, last


def align(window: np.ndarray, text: np.ndarray, diagonal: int, band: int, most: int) -> tuple[int, int, int] | None:
    """One window against one text: (edits, start, end), or None if it takes more than most edits."""
    one = lambda x: np.array([x], np.int64)
    k, a, b = (int(x[0]) for x in align_all(window[None, :], text, one(0), one(len(text)), one(diagonal), band, most))
    return (k, a, b) if k <= most else None


class Windows:
    """The windows of a block of items, and an index of their grams."""

    def __init__(self, items: list[tuple[int, str]], budget: Budget):
        self.budget, self.item, self.codes, self.start = budget, [], [], []
        self.tiny: dict[bytes, list] = {}
        for item, text in items:
            codes, _, _ = normalise([text])
            codes = codes[:-1]
            if len(codes) and codes[-1] == 32:
                codes = codes[:-1]
            m = len(codes)
            if m < budget.q:
                if m:
                    self.tiny.setdefault(codes.tobytes(), []).append(item)
                continue
            spans = set()
            for w, step in ((min(m, budget.window), budget.step), (min(m, budget.short), budget.short_step)):
                spans |= {(s, w) for s in (*range(0, m - w + 1, step), m - w)}
            for s, w in sorted(spans):
                self.item.append(item)
                self.start.append(s)
                self.codes.append(codes[s : s + w])
        size = np.array([len(c) for c in self.codes], dtype=np.int64)
        self.edits = np.array([budget.edits(int(m)) for m in size], dtype=np.int64)
        self.bound = size + 1 - budget.q * (self.edits + 1)
        h = [grams(c, budget.q)[: len(c) - budget.q + 1] for c in self.codes]
        flat = np.concatenate(h) if h else np.zeros(0, np.uint64)
        self.window = np.repeat(np.arange(len(h)), [len(x) for x in h])
        self.offset = np.concatenate([np.arange(len(x)) for x in h]) if h else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.window, self.offset = self.window[order], self.offset[order]
        # Each gram once, where its windows begin and how many they are.
        self.gram, self.first, self.times = np.unique(flat[order], return_index=True, return_counts=True)
        self.bits = max(16, min(27, int(math.log2(len(flat) + 1)) + 6))
        self.filter = np.zeros(1 << self.bits, bool)
        self.filter[(flat >> np.uint64(64 - self.bits)).astype(np.int64)] = True
        self.reach = int((size + self.edits).max(initial=1))
        # Short and long windows apart: how far a window's grams lie apart, how many of them there are.
        kinds = [size <= budget.short, size > budget.short]
        self.runs = [(int((size + self.edits)[k].max()), int(self.bound[k].min())) for k in kinds if k.any()]

    def matches(self, codes: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, window, edits, start, end) for each window found in the normalised texts."""
        if not len(self.gram):
            return []
        h = grams(codes, self.budget.q)
        maybe = np.flatnonzero(self.filter[(h >> np.uint64(64 - self.bits)).astype(np.int64)] & (h != 0))
        # A window's grams lie within reach: places with too few possible hits around them go, then
        # once more with what are hits indeed.
        maybe = self._dense(maybe)
        sought = h[maybe]
        at = np.minimum(np.searchsorted(self.gram, sought), len(self.gram) - 1)
        real = self.gram[at] == sought
        maybe, at = maybe[real], at[real]
        stay = self._dense_mask(maybe)
        maybe, at = maybe[stay], at[stay]
        lo, n = self.first[at], self.times[at]
        found: dict = {}
        for a, b in slices(n.tolist(), SLICE_HITS) if n.sum() > SLICE_HITS else [(0, len(n))] * bool(len(n)):
            # What begins in a slice ends within reach of its last place: slices overlap by that much.
            b = int(np.searchsorted(maybe, maybe[b - 1] + self.reach, "right"))
            for t, w, *hit in self._bands(codes, starts, maybe[a:b], lo[a:b], n[a:b]):
                found[t, w] = min(found.get((t, w), hit), hit)
        return [(t, w, *hit) for (t, w), hit in found.items()]

    def _dense(self, places: np.ndarray) -> np.ndarray:
        """Places with as many others within reach as some window demands."""
        return places[self._dense_mask(places)]

    def _dense_mask(self, places: np.ndarray) -> np.ndarray:
        marks = np.zeros(len(places) + 1, np.int64)
        for reach, least in self.runs:
            run = np.searchsorted(places, places + reach) - np.arange(len(places))
            good = np.flatnonzero(run >= least)
            marks += np.bincount(good, minlength=len(marks)) - np.bincount(good + run[good], minlength=len(marks))
        return np.cumsum(marks)[:-1] > 0

    def _bands(self, codes, starts, place, lo, n):
        hit = np.repeat(place, n)
        index = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        win, diag = self.window[index], hit - self.offset[index]
        width = 2 * self.edits[win] + 1  # a path with k edits stays within this many diagonals
        bound = self.bound[win]
        cell, parts = diag // width, []
        key = win * np.int64(1 << 34) + (1 << 20)
        for half in (0, 1):  # overlapping bands, two cells each: every path of so many diagonals lies in one of them
            band = (cell + half) >> 1
            code = key + band
            # A small table of counts, which may only count too much, leaves few hits to sort.
            slot = (code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)
            maybe = np.flatnonzero(np.bincount(slot, minlength=1 << 20)[slot] >= bound)
            order = maybe[np.argsort(code[maybe], kind="stable")]
            _, first, c = np.unique(code[order], return_index=True, return_counts=True)
            ok = c >= bound[order[first]]
            first, mid = order[first[ok]], order[(first + c // 2)[ok]]
            w = win[first]
            # A window, the text, the middle hit's diagonal and the middle of the band.
            parts.append(np.stack([w, np.searchsorted(starts, hit[first], "right") - 1, diag[mid], (2 * band[first] - half + 1) * width[first]], axis=1))
        todo = np.unique(np.concatenate(parts), axis=0)
        size = np.array([len(c) for c in self.codes], dtype=np.int64)[todo[:, 0]]
        got = []
        for m, k in sorted(set(zip(size.tolist(), self.edits[todo[:, 0]].tolist(), strict=True))):
            w, text, exact, middle = todo[(size == m) & (self.edits[todo[:, 0]] == k)].T
            patterns = np.stack([self.codes[x] for x in w.tolist()])
            base, end = starts[text], np.append(starts[1:], len(codes))[text] - 1
            inside = (exact >= base) & (exact + m <= end)
            equal = np.zeros(len(w), bool)
            equal[inside] = (codes[exact[inside, None] + np.arange(m)] == patterns[inside]).all(1)
            got += [(t, x, 0, d, d + m) for t, x, d in zip(text[equal].tolist(), w[equal].tolist(), exact[equal].tolist(), strict=True)]
            rest = np.flatnonzero(~equal)
            for at in range(0, len(rest), 4096):
                r = rest[at : at + 4096]
                edits, a, b = align_all(patterns[r], codes, base[r], end[r], middle[r], 2 * k + 1, k)
                ok = edits <= k
                got += zip(text[r][ok].tolist(), w[r][ok].tolist(), edits[ok].tolist(), a[ok].tolist(), b[ok].tolist(), strict=True)
        out: dict = {}
        for t, w, *hit in got:
            if (t, w) not in out or hit < out[t, w]:
                out[t, w] = hit
        return [(t, w, *x) for (t, w), x in out.items()]

    def leaks(self, texts: list[str]) -> list[tuple[int, object, int, int, int, int]]:
        """(text, item, windows, edits, start, end) for each text and each item that it holds."""
        codes, place, starts = normalise(texts)
        by: dict = {}
        for text, win, edits, s, e in self.matches(codes, starts):
            by.setdefault((text, self.item[win]), []).append((edits, int(place[s]), int(place[max(s, e - 1)]) + 1))
        if self.tiny:
            ends = np.append(starts[1:], len(codes)) - 1
            for text in np.flatnonzero(ends - starts <= self.budget.q + 1).tolist():
                a, b = int(starts[text]), int(ends[text])
                a, b = a + int(b > a and codes[a] == 32), b - int(b > a and codes[b - 1] == 32)
                for item in self.tiny.get(codes[a:b].tobytes(), ()) if b > a else ():
                    by.setdefault((text, item), []).append((0, int(place[a]), int(place[b - 1]) + 1))
        return [(t, item, len(x), min(y[0] for y in x), min(y[1] for y in x), max(y[2] for y in x)) for (t, item), x in sorted(by.items(), key=lambda y: (y[0][0], str(y[0][1])))]


def _blocks(benchmark: DataFrame, budget: Budget):
    """The benchmark's items in blocks of about block_chars, sent to the tasks one at a time: a block
    reaches the driver when it is asked for, and the one before is let go. All texts of an item are in
    one block, so a document and an item meet in one pass. Yields the block and whether it is the only one."""
    spark = benchmark.sparkSession
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / budget.block_chars))
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        sent = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").collect()])  # about block_chars
        yield sent, blocks == 1
        if blocks > 1:
            sent.destroy()


def find_leaks(documents: DataFrame, benchmark: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """One row for each document row and item it holds a window of: doc_id, item_id, n_windows (found),
    edits (the least), start and end (code points of the text, around all that was found).

    Null texts hold nothing, null items and those without a letter or digit are held by none; an item
    shorter than a gram is held by texts that normalise to it; null ids are kept as they are; repeated
    rows give a row each time; texts of one item id are one item; an empty table on either side gives
    no rows. A benchmark larger than block_chars is looked for in blocks, a pass each, whose rows are
    written before the next one is read.
    """
    schema = "doc_id long, item_id long, n_windows int, edits int, start int, end int"
    out = None
    for sent, only in _blocks(benchmark, budget):
        found = scan(documents.select("doc_id", "text"), _finder(sent, budget), schema)
        found = found if only else cut(found, "leaks")
        out = found if out is None else out.unionByName(found)
    return out


def _windows(state: dict, sent, budget: Budget) -> Windows:
    if "w" not in state:
        state["w"] = Windows(sent.value, budget)
    return state["w"]


def _finder(sent, budget: Budget):
    state: dict = {}

    def run(batch):
        w = _windows(state, sent, budget)
        ids = column(batch, "doc_id").to_pylist()
        for a, _, texts in text_slices(column(batch, "text"), SLICE_BYTES):
            rows = [(ids[a + t], *x) for t, *x in w.leaks(texts)]
            if rows:
                yield dict(zip(("doc_id", "item_id", "n_windows", "edits", "start", "end"), zip(*rows, strict=True), strict=True))

    return run


def _cleaner(sent, budget: Budget, at: int):
    state: dict = {}

    def run(batches):
        for batch in batches:
            w = _windows(state, sent, budget)
            for a, b, texts in text_slices(batch.column(at), SLICE_BYTES):
                clean = np.ones(b - a, bool)
                clean[[t for t, *_ in w.leaks(texts)]] = False
                yield batch.slice(a, b - a).filter(pa.array(clean))

    return run


def decontaminate(documents: DataFrame, benchmark: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """The document rows that hold no part of the benchmark, all columns. Each row is judged by its own
    text and nothing is shuffled; with several blocks, what one leaves is written for the next."""
    at = documents.columns.index("text")
    for sent, only in _blocks(benchmark, budget):
        documents = documents.mapInArrow(_cleaner(sent, budget, at), documents.schema)
        documents = documents if only else cut(documents, "decontaminated")
    return documents
