"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item gives windows of ``size`` consecutive words (all its words if it
has fewer).  Exact containment needs every word of a window, so the necessary
prefix of a window, its words ordered by rarity over all documents, is its rarest
word alone.  Documents without any such word are passed over; elsewhere each
occurrence of a rarest word proposes the windows it heads at the one place where
positions agree, bounded by the text's ends, and the words there are compared.

The windows of at most ``block_bytes`` of item text are broadcast at a time; a
larger benchmark is split into blocks and the documents are read once per block.

Defined cases: null or wordless texts have no words and no hits; an item without
id or words proposes nothing; items of one id count once; repeated rows stay.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, alnum_words, bounded_batches, maybe_broadcast, released, utf8

_HIT = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n_words", pa.int64()), ("hits", pa.binary()), ("items", pa.list_(pa.int64()))])
_HIT_SQL = "doc_id long, h long, n_words long, hits binary, items array<long>"


def windows_of(items: list[tuple[int, bytes]], size: int) -> dict[tuple[bytes, ...], list[int]]:
    """Window -> the ids of the items it occurs in."""
    out: dict[tuple[bytes, ...], set[int]] = {}
    for item, raw in items:
        w = alnum_words(raw)
        m = min(size, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            out.setdefault(tuple(w[i : i + m]), set()).add(item)
    return {k: sorted(v) for k, v in out.items()}


def _frequency(shared):
    schema = pa.schema([("w", pa.int64()), ("c", pa.int64())])

    @released
    def run(batches):
        vocabulary = shared.value
        known = set(vocabulary)
        total = np.zeros(len(vocabulary), np.int64)
        for b in batches:
            for raw in b.column(0).to_pylist():
                found = known.intersection(alnum_words(raw))
                if found:
                    total[[vocabulary[w] for w in found]] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], schema=schema)

    return run


def _match(shared):
    @released
    def run(batches):
        vocabulary, heads, ids = shared.value
        rare = {w for w, i in vocabulary.items() if i in heads}
        is_head = np.zeros(len(vocabulary) + 1, bool)
        is_head[list(heads)] = True
        for b in batches:
            counts, hits, found = [], [], []
            for raw in b.column(2).to_pylist():
                words = alnum_words(raw)
                counts.append(len(words))
                if rare.isdisjoint(words):
                    hits.append(b"")
                    found.append([])
                    continue
                w = np.fromiter(map(vocabulary.get, words, itertools.repeat(-1)), np.int64, len(words))
                hit, items = np.zeros(len(w) + 1, np.int64), set()
                at = np.flatnonzero(is_head[w])
                of = w[at]
                for head in np.unique(of).tolist():
                    places = at[of == head]
                    for offset, window, owners in heads[head]:
                        start = places - offset
                        start = start[(start >= 0) & (start + len(window) <= len(w))]
                        for i in range(len(window)):  # words that differ drop a place at once
                            if not len(start):
                                break
                            start = start[w[start + i] == window[i]]
                        if len(start):
                            np.add.at(hit, start, 1)
                            np.add.at(hit, start + len(window), -1)
                            items.update(owners)
                hits.append(np.packbits(np.cumsum(hit[:-1]) > 0).tobytes() if items else b"")
                found.append([ids[i] for i in sorted(items)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64()), pa.array(hits, pa.binary()), pa.array(found, pa.list_(pa.int64()))], schema=_HIT)

    return run


_SUM_SQL = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, items array<long>, text_hash long"


def _summed(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("items", pa.list_(pa.int64())), ("text_hash", pa.int64())])
    for b in batches:
        n_hit, n_items, digest, items = [], [], [], []
        for hits, found in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            mask = np.zeros(max(map(len, hits), default=0), np.uint8)
            for h in hits:
                if h:
                    mask[: len(h)] |= np.frombuffer(h, np.uint8)
            own = sorted({i for x in found for i in x}, key=str)
            n_hit.append(int(np.unpackbits(mask).sum()))
            n_items.append(len(own))
            items.append(own)
            digest.append(hashlib.sha256(",".join(map(str, own)).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digest), pa.array(items, pa.list_(pa.int64())), b.column(4)], schema=schema)


_summary = released(_summed)


def _match_and_sum(shared):
    """``_match`` and ``_summary`` in one worker, for a benchmark of one block."""
    match = _match(shared)

    def each(x):
        return pa.ListArray.from_arrays(pa.array(range(len(x) + 1), pa.int32()), x)

    def run(batches):
        for doc, h, n, hits, found in map(pa.RecordBatch.itercolumns, match(batches)):
            yield from _summed([pa.RecordBatch.from_arrays([doc, n, each(hits), each(found), h], ["doc_id", "n_words", "hits", "found", "h"])])

    return run


def contamination(df: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, text_hash) of every row."""
    spark = df.sparkSession
    bounded_batches(spark)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(utf8(text_col)).alias("h"), utf8(text_col).alias("raw"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), utf8(item_text).alias("raw")).where("item is not null")
    total = items.agg(F.coalesce(F.sum(F.length("raw")), F.lit(0))).first()[0]
    blocks = int(-(-total // block_bytes)) or 1
    parts = []
    for k in range(blocks):
        own = [(r[0], bytes(r[1])) for r in items.where(F.pmod(F.xxhash64("item", "raw"), F.lit(blocks)) == k).collect()]
        found = windows_of(own, size)
        vocabulary = {w: i for i, w in enumerate(sorted({w for x in found for w in x}))}
        shared = spark.sparkContext.broadcast(vocabulary)
        counted = docs.select("raw").mapInArrow(_frequency(shared), "w long, c long").groupBy("w").agg(F.sum("c")).collect()
        often = {r[0]: r[1] for r in counted}
        ids = sorted({i for x in found.values() for i in x})
        number = {i: j for j, i in enumerate(ids)}
        heads: dict[int, list] = {}
        for window, owners in found.items():
            w = np.array([vocabulary[x] for x in window], np.int64)
            offset = min(range(len(w)), key=lambda i: (often.get(int(w[i]), 0), w[i]))
            heads.setdefault(int(w[offset]), []).append((offset, w, [number[i] for i in owners]))
        windows = spark.sparkContext.broadcast((vocabulary, heads, ids))
        parts.append(docs.mapInArrow(_match_and_sum(windows), _SUM_SQL) if blocks == 1 else docs.mapInArrow(_match(windows), _HIT_SQL))
    if blocks == 1:
        out = parts[0]
    else:
        union = parts[0]
        for p in parts[1:]:
            union = union.unionByName(p)
        merged = union.groupBy("doc_id", "h").agg(F.first("n_words").alias("n_words"), F.collect_set("hits").alias("hits"), F.collect_set("items").alias("found"), (F.count("*") / blocks).cast("int").alias("rows"))
        merged = merged.select("doc_id", "n_words", "hits", "found", "h", F.explode(F.sequence(F.lit(1), "rows"))).drop("col")
        out = merged.mapInArrow(_summary, _SUM_SQL)
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), "items", "text_hash")


def drop_contaminated(df: DataFrame, benchmark: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of documents in which no window of an item occurs.  A row is known by two
    64-bit hashes, of its text and of its id with its text."""
    both, own = F.xxhash64(F.col(id_col), utf8(text_col)), F.xxhash64(utf8(text_col))
    dirty = contamination(df.select(both.alias("__q_key"), F.col(text_col)), benchmark, id_col="__q_key", text_col=text_col, **options)
    dirty = scratch.keep(dirty.where("contaminated").select(F.col("doc_id").alias("__q_dirty"), F.col("text_hash").alias("__q_text")).distinct())
    return df.join(maybe_broadcast(dirty, 96), (both == F.col("__q_dirty")) & (own == F.col("__q_text")), "left_anti")
