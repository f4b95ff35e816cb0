"""License scan: winnowed fingerprints, an inverted index and banded alignment.

Templates are winnowed (k-grams of words, the least hash of each window of them) with
the longest grams and widest window, up to ``k`` and ``window``, of which every match of
the asked coverage keeps one whatever is edited in it; short templates are indexed word
by word.  All grams of a document are looked up.  Places within the band of a shared
fingerprint are ruled out exactly by counts of equal words, and a banded alignment at
each of the others reports the template words matched in order, their share (coverage)
and the span in the document.

The templates are a fixed parameter of bounded size (``MAX_TEMPLATE_WORDS``).

Defined cases: null or short texts give no rows; repeated rows give repeated
results; of overlapping matches of one licence the one with more words, then the
tighter, is reported, those of different licences all are (a CC BY-NC statement holds
6 of the 7 words of the CC BY-SA one); a null doc_id is kept as null; extra columns are
not read.
"""

from __future__ import annotations

import bisect
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, alnum_words, bounded_batches, mix64, released, utf8
from .license_templates import TEMPLATES

MAX_TEMPLATE_WORDS = 1_000_000


def _grams(w: np.ndarray, k: int) -> np.ndarray:
    h = np.zeros(max(0, len(w) - k + 1), np.uint64)
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + (w[j : len(w) - k + 1 + j] + 1).astype(np.uint64)
    return mix64(h)


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """Places of the rightmost least hash of every window of ``window`` hashes."""
    if len(h) <= window:
        return np.array([len(h) - 1 - int(np.argmin(h[::-1]))]) if len(h) else np.empty(0, np.int64)
    v = np.lib.stride_tricks.sliding_window_view(h, window)
    return np.unique(np.arange(len(v)) + window - 1 - v[:, ::-1].argmin(axis=1))


class Index:
    """Fingerprints of the templates, with the gram length and window of each chosen so that
    every match of ``coverage`` within ``band`` keeps one; ``k`` and ``window`` are the most
    that is tried."""

    def __init__(self, templates, k: int, window: int, band: int = 12, coverage: float = 0.7):
        self.templates = templates
        words = [alnum_words(t.encode()) for _, _, t in templates]
        if sum(map(len, words)) > MAX_TEMPLATE_WORDS:
            raise ValueError("templates exceed MAX_TEMPLATE_WORDS")
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for x in words for w in x}))}
        self.words = [np.array([self.vocabulary[w] for w in x], np.int64) for x in words]
        self.filled = np.array([t for t, w in enumerate(self.words) if len(w)], np.int64)
        self.prints = [_fingerprints(w, k, window, band, needed(len(w), coverage)) for w in self.words]
        bags = [np.unique(self.words[t], return_counts=True) for t in self.filled]
        self.bag_word, self.bag_n = (np.concatenate([x[i] for x in bags] or [np.empty(0, np.int64)]) for i in (0, 1))
        self.bag_start = np.cumsum([0] + [len(x[0]) for x in bags])[:-1]
        self.sizes = np.array([len(self.words[t]) for t in self.filled], np.int64)

    def possible(self, w: np.ndarray, least: float) -> list[int]:
        """Templates of whose words, counted, the text has enough."""
        if not len(self.filled):
            return []
        n = np.bincount(w[w >= 0], minlength=len(self.vocabulary))
        both = np.add.reduceat(np.minimum(n[self.bag_word], self.bag_n), self.bag_start)
        return self.filled[both >= least * self.sizes].tolist()

    def diagonals(self, t: int, w: np.ndarray) -> np.ndarray:
        """Distinct differences of document place and template place of shared fingerprints."""
        k, places, known, first = self.prints[t]
        if len(w) < k:
            return np.empty(0, np.int64)
        h = _grams(w, k)
        at = np.flatnonzero(np.isin(h, known) & np.lib.stride_tricks.sliding_window_view(w >= 0, k).all(axis=1))
        x = np.searchsorted(known, h[at])
        held = np.zeros(len(w) + len(self.words[t]), bool)
        for g in np.unique(x).tolist():
            for q in places[first[g] : first[g + 1]].tolist():
                held[at[x == g] - q + len(self.words[t])] = True
        return np.flatnonzero(held) - len(self.words[t])


def needed(n: int, least: float) -> int:
    """Matched words that a template of ``n`` words takes."""
    return max(1, math.ceil(least * n))


def _fingerprints(w: np.ndarray, k: int, window: int, band: int, need: int):
    """(gram length, template places, sorted hashes, first place of each hash).

    An unmatched word spoils at most k grams and a place of inserted words k - 1; the
    diagonal climbs by at most ``2 * band`` and what unmatched words lower it, so there are
    no more such places.  The longest grams and widest window of which more are picked than
    can be spoilt are taken; single words in windows of one always are enough.
    """
    lost = max(0, len(w) - need)
    for n in range(min(k, len(w)), 0, -1):
        h = _grams(w, n)
        for width in range(window, 0, -1):
            picked = winnow(h, width)
            if len(picked) > n * lost + (n - 1) * (2 * band + lost) or n == width == 1:
                picked = picked[np.argsort(h[picked], kind="stable")]
                known, first = np.unique(h[picked], return_index=True)
                return n, picked, known, np.append(first, len(picked))
    return 1, np.empty(0, np.int64), np.empty(0, np.uint64), np.zeros(1, np.int64)


def align(template: np.ndarray, region: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """(matched, first, last) of the longest common subsequence within ``band`` of the
    diagonal region = template + shift; first and last are places in the region."""
    m, n, width = len(template), len(region), 2 * band + 1
    score = np.zeros((m + 1, width + 1), np.int32)
    offs = np.arange(width)
    hit = np.zeros((m, width), bool)
    for i in range(m):
        j = i + shift - band + offs
        ok = (j >= 0) & (j < n)
        hit[i, ok] = region[j[ok]] == template[i]
        step = np.maximum(score[i, :width] + hit[i], score[i, 1:])
        score[i + 1, :width] = np.maximum.accumulate(step)
    i, b = m, int(score[m, :width].argmax())
    first = last = -1
    while i > 0 and b >= 0 and score[i, b] > 0:
        if b > 0 and score[i, b - 1] == score[i, b]:
            b -= 1
        elif score[i - 1, b + 1] == score[i, b] and b + 1 < width:
            i, b = i - 1, b + 1
        else:
            first = i - 1 + shift - band + b
            last = first if last < 0 else last
            i -= 1
    return int(score[m, :width].max()), first, last


_FOUND = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("template", pa.string()), ("matched_words", pa.int64()), ("template_words", pa.int64()), ("coverage", pa.float64()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("start_byte", pa.int64()), ("end_byte", pa.int64())])
_FOUND_SQL = "doc_id long, license string, template string, matched_words long, template_words long, coverage double, start_word long, end_word long, start_byte long, end_byte long"


def _places(template: np.ndarray, w: np.ndarray, diagonals: np.ndarray, band: int, need: int) -> np.ndarray:
    """Shifts within ``band`` of a shared fingerprint at which enough template words have an
    equal word within the band, as a match must."""
    m, n = len(template), len(w)
    base = m + band  # shifts run from -base to n + band
    near = np.zeros(n + m + 2 * band + 2, np.int32)
    np.add.at(near, diagonals - band + base, 1)
    np.add.at(near, diagonals + band + 1 + base, -1)
    close = np.cumsum(near[:-1]) > 0
    count = np.zeros(len(close), np.int32)
    for x in np.unique(template).tolist():
        at = np.flatnonzero(w == x)
        if not len(at):
            continue
        reach = np.zeros(len(close) + m, np.int32)
        np.add.at(reach, at - band + base, 1)
        np.add.at(reach, at + band + 1 + base, -1)
        reach = np.cumsum(reach) > 0
        for i in np.flatnonzero(template == x).tolist():
            count += reach[i : i + len(close)]
    return np.flatnonzero(close & (count >= need)) - base


def _scores(template: np.ndarray, w: np.ndarray, shifts: np.ndarray, band: int) -> np.ndarray:
    """Matched words of ``align`` at each shift."""
    m, width = len(template), 2 * band + 1
    pad = np.full(len(w) + 2 * (m + 2 * band + 1), -1, np.int64)
    pad[m + 2 * band + 1 : m + 2 * band + 1 + len(w)] = w
    at = shifts[:, None] + np.arange(width) + (m + band + 1)
    score = np.zeros((len(shifts), width + 1), np.int32)
    for i in range(m):
        step = np.maximum(score[:, :width] + (pad[at + i] == template[i]), score[:, 1:])
        score[:, :width] = np.maximum.accumulate(step, axis=1)
    return score[:, :width].max(axis=1)


def _matches(index: Index, w: np.ndarray, t: int, band: int, least: float) -> set[tuple[int, int, int, int]]:
    """(template, matched, first, last) of the alignments of one template at all places."""
    template, out = index.words[t], set()
    need = needed(len(template), least)
    shifts = _places(template, w, index.diagonals(t, w), band, need)
    for i in range(0, len(shifts), 2048):
        part = shifts[i : i + 2048]
        for d in part[_scores(template, w, part, band) >= need].tolist():
            lo, hi = max(0, d - band), min(len(w), d + len(template) + band)
            matched, first, last = align(template, w[lo:hi], d - lo, band)
            out.add((t, matched, lo + first, lo + last))
    return out


def scan_words(index: Index, w: np.ndarray, band: int, least: float) -> list[tuple[int, int, int, int]]:
    """(template, matched, first word, last word) of the reported matches."""
    by_licence: dict[str, list[int]] = {}
    for t in index.possible(w, least):
        by_licence.setdefault(index.templates[t][1], []).append(t)
    kept = []
    for own in by_licence.values():
        parts = [(0, len(w))]
        while parts:
            lo, hi = parts.pop()
            likely = set(index.possible(w[lo:hi], least)).intersection(own)
            found = _apart(x for t in sorted(likely) for x in _matches(index, w[lo:hi], t, band, least))
            kept += [(t, n, lo + a, lo + b) for a, b, t, n in found]
            # an alignment may be drawn to a better match near by: look again between those found
            if found:
                edges = [lo, *(lo + e for a, b, _, _ in found for e in (a, b + 1)), hi]
                parts += [(x, y) for x, y in zip(edges[::2], edges[1::2], strict=True) if x < y]
    return sorted(kept, key=lambda x: (x[2], x[0]))


def _apart(matches) -> list[tuple[int, int, int, int]]:
    """(first, last, template, matched); of overlapping matches the one with more words, then
    the tighter one."""
    kept: list[tuple[int, int, int, int]] = []
    for t, matched, first, last in sorted(matches, key=lambda x: (-x[1], x[3] - x[2], x[2], x[0])):
        i = bisect.bisect(kept, (first, last))
        if (i == 0 or kept[i - 1][1] < first) and (i == len(kept) or last < kept[i][0]):
            kept.insert(i, (first, last, t, matched))
    return kept


def license_scan(df: DataFrame, templates=None, k: int = 4, window: int = 4, band: int = 12, coverage: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per template matched in a document, with coverage and spans (ends exclusive)."""
    spark = df.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(Index(templates or TEMPLATES, k, window, band, coverage))

    @released
    def run(batches):
        index = shared.value
        get = index.vocabulary.get
        for b in batches:
            rows = []
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = alnum_words(raw)
                w = np.fromiter(map(get, words, itertools.repeat(-1)), np.int64, len(words))
                found = scan_words(index, w, band, coverage)
                if not found:
                    continue
                plain = np.frombuffer(raw.translate(ALNUM), np.uint8) != 32
                edge = np.diff(np.concatenate(([0], plain.view(np.int8), [0])))
                begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                for t, matched, first, last in found:
                    name, licence, _ = index.templates[t]
                    n = len(index.words[t])
                    rows.append((doc, licence, name, matched, n, round(matched / n, 6), first, last + 1, int(begins[first]), int(ends[last])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_FOUND)], schema=_FOUND)

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("raw"))
    return docs.mapInArrow(run, _FOUND_SQL)
