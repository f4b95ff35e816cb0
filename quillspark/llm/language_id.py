"""Word-level language identification with a linear-chain conditional random field.

Each word is scored by its character n-grams (those that touch a word edge are its
affixes) and by its entry in a learned lexicon; learned transitions join the words
of a chain, and forward-backward gives every word's distribution over languages.  A
document takes the language of greatest mean marginal.  Chains are runs of ``CHAIN``
words; all words of a text belong to one.

The model is fitted on the driver from at most ``train_docs`` labelled documents,
each giving at most ``train_chains`` chains; chains of several documents are joined
piecewise, so that switches inside a chain are seen in training.

Defined cases: null text or a text without a letter is ``und`` with score 0; with no
labelled rows every text is ``und``; of equal means the first label by name is taken;
rows are kept one to one, repeated ones too; a text of any length is scored whole, a
bounded number of chains at a time; an empty table gives no rows; extra columns are
not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, mix64, released, utf8

CHAIN = 64
BITS = 17
_EDGE_L, _EDGE_R = 2, 3


def words_of(raw: bytes) -> list[str]:
    import regex

    return regex.findall(r"\p{L}+", raw.decode("utf-8", "replace").lower())


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature slots of all words, first slot of each): 1- to 4-grams with the edges."""
    text = "".join(f"\x02{w}\x03" for w in words)
    c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    n = len(c)
    begin = np.flatnonzero(c == _EDGE_L)
    word = np.cumsum(c == _EDGE_L) - 1
    slots, owner = [], []
    h = np.zeros(n, np.uint64)
    for k in range(1, 5):
        h = h[: n - k + 1] * np.uint64(0x100000001B3) + c[k - 1 :] + np.uint64(k)
        inside = word[: n - k + 1] == word[k - 1 :]
        slots.append((mix64(h[inside] + np.uint64(k)) >> np.uint64(64 - BITS)).astype(np.int64))
        owner.append(word[: n - k + 1][inside])
    slots, owner = np.concatenate(slots), np.concatenate(owner)
    o = np.argsort(owner, kind="stable")
    return slots[o], np.searchsorted(owner[o], np.arange(len(begin)))


class Model:
    def __init__(self, labels: list[str], grams: np.ndarray, lexicon: dict[str, int], lex: np.ndarray, trans: np.ndarray, start: np.ndarray):
        self.labels, self.grams, self.lexicon, self.lex, self.trans, self.start = labels, grams, lexicon, lex, trans, start

    def emissions(self, words: list[str]) -> np.ndarray:
        slots, first = ngrams(words)
        e = np.add.reduceat(self.grams[slots], first, axis=0)
        return e + self.lex[[self.lexicon.get(w, 0) for w in words]]


def forward_backward(e: np.ndarray, mask: np.ndarray, trans: np.ndarray, start: np.ndarray):
    """Marginals (chains, steps, labels), expected transitions, log-likelihood constants.

    e: (chains, steps, labels) scores; mask marks real steps, which lead each chain.
    """
    c, t, k = e.shape
    top = e.max(axis=2, keepdims=True)
    x = np.exp(e - top)
    m = np.exp(trans)
    a = np.empty((t, c, k), x.dtype)
    scale = np.ones((t, c), x.dtype)
    a[0] = x[:, 0] * np.exp(start)
    for i in range(t):
        if i:
            a[i] = np.where(mask[:, i, None], (a[i - 1] @ m) * x[:, i], a[i - 1])
        s = a[i].sum(axis=1)
        scale[i] = s
        a[i] /= s[:, None]
    b = np.ones((c, k), x.dtype)
    out = np.empty_like(a)
    pair = np.zeros((k, k))
    for i in range(t - 1, -1, -1):
        p = a[i] * b
        out[i] = p / p.sum(axis=1, keepdims=True)
        if i:
            y = x[:, i] * b
            live = mask[:, i]
            joint = (a[i - 1][live].T @ (y[live] / (p.sum(axis=1) * scale[i])[live, None])) * m
            pair += joint
            b = np.where(live[:, None], y @ m.T, b)
            b /= b.sum(axis=1, keepdims=True)
    log_z = float(np.log(scale).sum() + (top[:, :, 0] * mask).sum())
    return out.transpose(1, 0, 2), pair, log_z


def fit(chains: list[tuple[list[str], list[str]]], rounds: int = 60, rate: float = 0.1, decay: float = 1e-4) -> Model | None:
    """chains: (words, label of each word)."""
    labels = sorted({y for _, ys in chains for y in ys})
    if not labels:
        return None
    number = {y: i for i, y in enumerate(labels)}
    counts = Counter(w for ws, _ in chains for w in ws)
    vocabulary = {w: i for i, w in enumerate(counts)}
    lexicon = {w: i + 1 for i, w in enumerate(w for w, n in counts.items() if n >= 5)}
    k, c = len(labels), len(chains)
    idx = np.zeros((c, CHAIN), np.int64)
    gold = np.zeros((c, CHAIN), np.int64)
    mask = np.zeros((c, CHAIN), bool)
    for i, (ws, ys) in enumerate(chains):
        idx[i, : len(ws)] = [vocabulary[w] for w in ws]
        gold[i, : len(ys)] = [number[y] for y in ys]
        mask[i, : len(ws)] = True
    slots, first = ngrams(list(vocabulary))
    owner = np.repeat(np.arange(len(first)), np.diff(np.concatenate((first, [len(slots)]))))
    lex_of = np.array([lexicon.get(w, 0) for w in vocabulary])
    grams, lex = np.zeros((1 << BITS, k)), np.zeros((len(lexicon) + 1, k))
    trans, start = np.zeros((k, k)), np.zeros(k)
    total = mask.sum()
    real = np.zeros((len(vocabulary), k))
    np.add.at(real, (idx[mask], gold[mask]), 1)
    both = mask[:, 1:]
    real_pair = np.zeros((k, k))
    np.add.at(real_pair, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    params = [grams, lex, trans, start]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for r in range(1, rounds + 1):
        per_word = np.add.reduceat(grams[slots], first, axis=0) + lex[lex_of]
        marg, pair, _ = forward_backward(per_word[idx], mask, trans, start)
        want = np.zeros((len(vocabulary), k))
        flat = idx[mask]
        for j in range(k):
            want[:, j] = np.bincount(flat, weights=marg[mask][:, j], minlength=len(vocabulary))
        g_word = real - want
        g_grams = np.stack([np.bincount(slots, weights=g_word[owner, j], minlength=1 << BITS) for j in range(k)], axis=1)
        g_lex = np.zeros_like(lex)
        np.add.at(g_lex, lex_of, g_word)
        g_lex[0] = 0
        g_start = np.bincount(gold[:, 0], minlength=k) - marg[:, 0].sum(axis=0)
        for p, g, u, v in zip(params, (g_grams, g_lex, real_pair - pair, g_start), m1, m2, strict=True):
            g = g / total - decay * p
            u += 0.1 * (g - u)
            v += 0.01 * (g * g - v)
            p += rate * (u / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return Model(labels, grams.astype(np.float32), lexicon, lex.astype(np.float32), trans.astype(np.float32), start.astype(np.float32))


def _sample_chains(n: int):
    schema = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string()))])

    @released
    def run(batches):
        for b in batches:
            langs, out = [], []
            for lang, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = words_of(raw)
                step = max(CHAIN, len(w) // n)  # chains spread over the whole text
                for i in range(0, len(w), step):
                    langs.append(lang)
                    out.append(w[i : i + CHAIN])
                    if i // step == n - 1:
                        break
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.list_(pa.string()))], schema=schema)

    return run


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = 1500, train_chains: int = 2) -> Model | None:
    """Fit on at most ``train_docs`` rows, the first by a hash of the id."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(utf8(text_col)).alias("h"), utf8(text_col).alias("raw")).where("lang is not null and length(raw) > 0")
    cut = rows.select(F.xxhash64("id", "h").alias("k")).orderBy("k").limit(train_docs).agg(F.max("k")).first()[0]
    if cut is None:
        return None
    # rows that repeat an id and its text count once, so no more than ``train_docs`` are gathered
    once = rows.where(F.xxhash64("id", "h") <= cut).groupBy(F.xxhash64("id", "h")).agg(F.min(F.struct("lang", "raw")).alias("r"))
    sample = once.select("r.lang", "r.raw").mapInArrow(_sample_chains(train_chains), "lang string, words array<string>").collect()
    parts = sorted((r.lang, r.words) for r in sample if r.words)
    rng = np.random.Generator(np.random.PCG64(5))
    order = rng.permutation(len(parts))
    chains = [(parts[i][1], [parts[i][0]] * len(parts[i][1])) for i in order]
    for i, j in zip(order[::3], order[1::3], strict=False):  # code-switched chains
        (a, x), (b, y) = parts[i], parts[j]
        p, q = rng.integers(4, 33, 2)
        ws = (x[:p] + y[:q] + x[p : p + 16])[:CHAIN]
        chains.append((ws, ([a] * len(x[:p]) + [b] * len(y[:q]) + [a] * 16)[: len(ws)]))
    return fit(chains)


class Scorer:
    """Scores of words seen by this task, and chains over them."""

    LIMIT = 300_000

    def __init__(self, model: Model):
        self.model, self.rows = model, {}
        self.table = np.zeros((1 << 12, len(model.labels)), np.float32)

    def _numbers(self, words: list[str]) -> np.ndarray:
        if len(self.rows) > self.LIMIT:
            self.rows.clear()
        miss = [w for w in dict.fromkeys(words) if w not in self.rows]
        if miss:
            at = len(self.rows)
            while at + len(miss) > len(self.table):
                self.table = np.concatenate((self.table, np.zeros_like(self.table)))
            for i in range(0, len(miss), 50_000):
                part = miss[i : i + 50_000]
                self.table[at + i : at + i + len(part)] = self.model.emissions(part)
            self.rows.update(zip(miss, range(at, at + len(miss)), strict=True))
        return np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))

    def marginals(self, words: list[str], sizes: np.ndarray) -> np.ndarray:
        """(words, labels) for texts laid end to end, of the given numbers of words."""
        k = len(self.model.labels)
        if not words:
            return np.empty((0, k), np.float32)
        numbers = self._numbers(words)  # may replace the table
        e = self.table[numbers]
        base = np.repeat(np.cumsum(sizes) - sizes, sizes)
        local = np.arange(len(words)) - base
        per_text = -(-sizes // CHAIN)
        first = np.repeat(np.cumsum(per_text) - per_text, sizes)
        row, col = first + local // CHAIN, local % CHAIN
        out = np.empty((len(words), k), np.float32)
        for lo in range(0, int(row[-1]) + 1, 4096):  # bounded memory for any text
            i = slice(*np.searchsorted(row, (lo, lo + 4096)))
            r, c = row[i] - lo, col[i]
            x = np.zeros((int(r[-1]) + 1, CHAIN, k), np.float32)
            mask = np.zeros(x.shape[:2], bool)
            x[r, c] = e[i]
            mask[r, c] = True
            out[i] = forward_backward(x, mask, self.model.trans, self.model.start)[0][r, c]
        return out


def predict(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, n_switches): n_switches counts neighbouring words whose best labels differ."""
    spark = df.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("n_switches", pa.int64())])

    @released
    def run(batches):
        model = shared.value
        scorer = Scorer(model) if model else None
        for b in batches:
            words, sizes = [], []
            for raw in b.column(1).to_pylist() if model else ():
                w = words_of(raw)
                words += w
                sizes.append(len(w))
            langs, scores, switches = ["und"] * b.num_rows, np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64)
            if words:
                sizes = np.array(sizes)
                p = scorer.marginals(words, sizes)
                some = np.flatnonzero(sizes)
                ends = np.cumsum(sizes)
                begin = (ends - sizes)[some]
                mean = np.add.reduceat(p.astype(np.float64), begin, axis=0) / sizes[some, None]
                best = mean.argmax(axis=1)
                scores[some] = np.clip(mean[np.arange(len(some)), best], 0, 1)
                for i, j in zip(some.tolist(), best.tolist(), strict=True):
                    langs[i] = model.labels[j]
                own = p.argmax(axis=1)
                turn = np.concatenate(([False], own[1:] != own[:-1]))
                turn[begin] = False
                switches[some] = np.add.reduceat(turn.astype(np.int64), begin)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs), pa.array(scores), pa.array(switches)], schema=schema)

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("raw"))
    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double, n_switches long")
