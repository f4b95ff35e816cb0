"""Suffix-array removal of repeated 100-byte strings (difference-cover sort).

A byte is removed if some ``MATCH``-byte string covering it also starts earlier:
in a document of smaller id, or earlier in the same document.  Strings are judged
on the input and never cross documents.

Plan
1. ``anchors.runs`` cuts each document's windows into runs that own one
   content-defined anchor (about one run in 38 bytes).  Runs equal to one another
   inside an Arrow batch are settled at once (map-side combine); the rest is
   dealt and sorted by (anchor, content, document, position).
2. A stream over that order settles copies: a run whose content occurred earlier
   is repeated from end to end.  The first run of a content is *open* if its
   anchor has other contents, for then single windows may still be equal.
3. The bytes of open runs are dealt by anchor and sorted by the difference-cover
   method (``cover_sort``): sampled triples, names of triples, triples of names,
   then the remaining suffixes by first byte and name of the next sample; equal
   neighbours in that order are compared on exactly ``MATCH`` bytes.  Residues are
   counted from the anchor, so equal strings have equal residues and no comparison
   between residues is needed.  An anchor with more than ``hot`` contents is dealt
   window by window.
4. Repeated windows become byte spans, which are cut from the texts.

Defined cases: null text is empty text; an empty or short text loses nothing; a
row without doc_id takes no part and loses nothing; rows that repeat a doc_id and
its text are one document, lose the same bytes, and are no reason for removal to
each other; different texts of one doc_id are documents of their own, in an order
fixed by their hashes; a very long text is cut into blocks whose windows partition
its own; an empty table gives no rows; extra columns stay as they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors
from .common import Scratch, bounded_batches, released, utf8
from .anchors import MATCH, mix

_RUN = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("doc", pa.int64()), ("at", pa.int64()), ("n", pa.int32()), ("kind", pa.int32())])
_RUN_SQL = "anchor long, content long, doc long, at long, n int, kind int"
_OPEN = pa.schema([("route", pa.int64()), ("doc", pa.int64()), ("at", pa.int64()), ("lead", pa.int32()), ("body", pa.binary())])
_OPEN_SQL = "route long, doc long, at long, lead int, body binary"
_SPAN = pa.schema([("doc", pa.int64()), ("at", pa.int64()), ("n", pa.int32())])
_SPAN_SQL = "doc long, at long, n int"

#: A position carries, above these bits, the number of its text among those of one doc_id.
TEXT_BITS = 40
_PLACE = (1 << TEXT_BITS) - 1

#: kinds of a run: not judged, repeated, first of its content beside other contents
_UNKNOWN, _REPEATED, _OPEN_RUN = 0, 1, 2


def _flush_runs(pieces):
    sizes = np.array([len(x[2]) for x in pieces], np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    first, n, lead, anchor, content = anchors.runs(np.concatenate([x[2] for x in pieces]), ends)
    own = np.searchsorted(ends, first, side="right")
    doc = np.array([x[0] for x in pieces], np.int64)[own]
    at = first - begins[own] + np.array([x[1] for x in pieces], np.int64)[own]
    return anchor.view(np.int64), content.view(np.int64), doc, at, n, lead


@released
def _document_runs(batches):
    for b in batches:
        parts, held, size = [], [], 0
        for d, raw, text in zip(b.column(0).to_numpy(zero_copy_only=False), b.column(1), b.column(2).to_pylist(), strict=True):
            raw = np.frombuffer(raw.as_buffer(), np.uint8)
            for off, n in anchors.blocks(len(raw)):
                held.append((d, off | text << TEXT_BITS, raw[off : off + n]))
                size += n
                if size >= anchors.BLOCK:
                    parts.append(_flush_runs(held))
                    held, size = [], 0
        if held:
            parts.append(_flush_runs(held))
        if not parts:
            continue
        a, c, d, p, n, lead = (np.concatenate(x) for x in zip(*parts, strict=True))
        # map-side combine: later equal runs of this batch are repeated, whatever else exists
        order = np.lexsort((p, d, c))
        cs, ds, ps = c[order], d[order], p[order]
        head = np.maximum.accumulate(np.where(np.concatenate(([True], cs[1:] != cs[:-1])), np.arange(len(cs)), 0))
        gone = order[(ds != ds[head]) | (ps != ps[head])]
        keep = np.ones(len(c), bool)
        keep[gone] = False
        yield _rows(a[keep], c[keep], d[keep], p[keep], n[keep] + (lead[keep] << 7), _UNKNOWN)
        if len(gone):
            o = gone[np.lexsort((p[gone], d[gone]))]
            d, p, n = d[o], p[o], n[o]
            cut = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (p[1:] != p[:-1] + n[:-1]))))
            total = np.add.reduceat(n, cut)
            yield _rows(mix((d[cut] << 20 ^ p[cut]).view(np.uint64)).view(np.int64), np.zeros(len(cut), np.int64), d[cut], p[cut], total, _REPEATED)


def _rows(a, c, d, p, n, kind):
    kind = np.full(len(a), kind, np.int32) if np.isscalar(kind) else kind
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (a, c, d, p, n.astype(np.int32), kind)], schema=_RUN)


@released
def _judge(batches):
    """Runs sorted by (anchor, content, doc, at) -> repeated runs and open runs."""
    held = None  # last content's first run: (anchor, content, doc, at, n), not yet known to be open
    anchor_open = False  # the held run's anchor has had another content before
    for b in batches:
        done = b.column(5).to_numpy() == _REPEATED
        if done.any():
            yield b.filter(pa.array(done))
            b = b.filter(pa.array(~done))
        if not b.num_rows:
            continue
        a, c, d, p = (b.column(i).to_numpy() for i in range(4))
        n = b.column(4).to_numpy()
        if held is not None:
            a, c, d, p = (np.concatenate(([h], x)) for h, x in zip(held[:4], (a, c, d, p), strict=True))
            n = np.concatenate(([held[4]], n)).astype(np.int32)
        m = len(a)
        new_a = np.concatenate(([True], a[1:] != a[:-1]))
        new_c = new_a | np.concatenate(([True], c[1:] != c[:-1]))
        head = np.maximum.accumulate(np.where(new_c, np.arange(m), 0))
        repeated = (d != d[head]) | (p != p[head])
        # open: the first of its content, and the anchor has another content before or after
        before = new_c & ~new_a
        if held is not None and anchor_open:
            before[0] = True
        heads = np.flatnonzero(new_c)
        after = np.zeros(m, bool)
        after[heads[:-1]] = ~new_a[heads[1:]]
        opened = new_c & (before | after)
        last = heads[-1]
        emit_open = opened.copy()
        emit_open[last] = False  # decided with the next batch
        kind = np.where(repeated, _REPEATED, np.where(emit_open, _OPEN_RUN, _UNKNOWN)).astype(np.int32)
        take = kind > 0
        held = (a[last], c[last], d[last], p[last], n[last])  # copied scalars
        anchor_open = bool(before[last])
        if take.any():
            n = np.where(kind == _REPEATED, n & 127, n)
            yield _rows(a[take], c[take], d[take], p[take], n[take], kind[take])
    if held is not None and anchor_open:
        yield pa.RecordBatch.from_arrays([pa.array(np.array([x], t)) for x, t in zip((*held, _OPEN_RUN), (np.int64,) * 4 + (np.int32,) * 2, strict=True)], schema=_RUN)


@released
def _fetch(batches):
    """Texts with the open runs asked of them -> the runs' bytes, dealt by anchor or by window."""
    for b in batches:
        rows = {k: [] for k in _OPEN.names}
        for doc, raw, text, asked in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            for x in asked:
                at, n, lead = x["at"], x["n"] & 127, x["n"] >> 7
                if at >> TEXT_BITS != text:
                    continue
                body = raw[at & _PLACE : (at & _PLACE) + n + MATCH - 1]
                if x["hot"]:
                    p, i = anchors.prefix_sums(np.frombuffer(body, np.uint8)), np.arange(n)
                    routes = anchors.span_hash(p, i, i + MATCH).view(np.int64).tolist()
                    pieces = [(routes[i], i, body[i : i + MATCH]) for i in range(n)]
                else:
                    pieces = [(x["anchor"], 0, body)]
                for route, i, piece in pieces:
                    for k, v in zip(_OPEN.names, (route, doc, at + i, lead - i, piece), strict=True):
                        rows[k].append(v)
        if rows["doc"]:
            yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in _OPEN], schema=_OPEN)


def _rank(keys: np.ndarray) -> np.ndarray:
    """Order-preserving dense names of 64-bit keys."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    out = np.empty(len(keys), np.uint64)
    out[order] = np.cumsum(np.concatenate(([0], s[1:] != s[:-1])), dtype=np.uint64) if len(s) else 0
    return out


def _rank3(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    top = max((int(x.max()) for x in (a, b, c) if len(x)), default=0)
    if top < 1 << 21:
        return _rank(a << np.uint64(42) | b << np.uint64(21) | c)
    return _rank(_rank(a << np.uint64(32) | b) << np.uint64(32) | c)


def cover_sort(bodies: list[bytes], leads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Name every window of the bodies: (row of each window, its name); equal names = equal bytes.

    Windows of different residue (distance to the anchor mod 3) get different names.
    """
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    base = np.concatenate(([0], np.cumsum(sizes)))
    text = np.frombuffer(b"".join(bodies) + b"\0" * 32, np.uint8)
    x = text.astype(np.uint64)
    x = x[:-1] << np.uint64(8) | x[1:]
    x = x[:-2] << np.uint64(16) | x[2:]
    symbol = x[:-4] << np.uint64(32) | x[4:]  # eight bytes from each position
    total = int(base[-1])
    row = np.repeat(np.arange(len(bodies)), sizes)
    local = np.arange(total) - base[row]
    residue = (local - leads[row]) % 3
    wins = sizes[row] - MATCH + 1
    sampled = (residue != 0) & (local < wins + 76)
    # 1. sort sampled triples of eight-byte symbols
    at = np.flatnonzero(sampled)
    eight = np.zeros(total + 32, np.uint64)
    need = np.zeros(total + 32, bool)
    for s in (0, 8, 16):
        need[at + s] = True
    where = np.flatnonzero(need)
    eight[where] = _rank(symbol[np.minimum(where, len(symbol) - 1)])
    name = np.zeros(total + 128, np.uint64)
    name[at] = _rank3(eight[at], eight[at + 8], eight[at + 16])
    # 2. recurse on the names: triples of names cover 72 bytes
    at = np.flatnonzero(sampled & (local < wins + 28))
    name72 = np.zeros(total + 128, np.uint64)
    name72[at] = _rank3(name[at], name[at + 24], name[at + 48])
    # 3. all windows: the samples by their own names, the rest by first byte and next sample
    w = np.flatnonzero(local < wins)
    own = residue[w] != 0
    key = np.empty(len(w), np.uint64)
    s, r = w[own], w[~own]
    key[own] = name72[s] << np.uint64(36) | name72[s + 27] << np.uint64(8) | text[s + 99]
    key[~own] = name72[r + 1] << np.uint64(36) | name72[r + 28] << np.uint64(8) | text[r]
    out = _rank(key) * np.uint64(2) + own
    return w, out


#: Bytes of open runs, whole routes, that are sorted at once; the sort holds several arrays of 8 bytes for each.
FLUSH_BYTES = 1 << 18


@released
def _settle(batches):
    """Open runs sorted by (route, doc, at) -> windows that occurred earlier, as spans."""

    def flush(rows):
        doc, at, lead = (np.array([r[i] for r in rows], np.int64) for i in (0, 1, 2))
        order = np.lexsort((at, doc))
        doc, at, lead = doc[order], at[order], lead[order]
        bodies = [rows[i][3] for i in order]
        sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
        base = np.cumsum(sizes) - sizes
        w, name = cover_sort(bodies, lead)
        # 4. neighbours in the order: all but a name's earliest window are repeated
        o = np.argsort(name, kind="stable")
        first = np.concatenate(([True], name[o][1:] != name[o][:-1]))
        row = np.searchsorted(base, w, side="right") - 1
        d, p = doc[row], at[row] + (w - base[row])
        head = np.maximum.accumulate(np.where(first, np.arange(len(o)), 0))
        later = (d[o] != d[o][head]) | (p[o] != p[o][head])
        hit = np.sort(o[later])
        if len(hit):
            d, p = d[hit], p[hit]
            cut = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1))))
            n = np.diff(np.concatenate((cut, [len(hit)])))
            yield pa.RecordBatch.from_arrays([pa.array(d[cut]), pa.array(p[cut]), pa.array(n.astype(np.int32))], schema=_SPAN)

    rows, size, route = [], 0, None
    for b in batches:
        cols = [b.column(i).to_pylist() for i in range(5)]
        for r, d, p, lead, body in zip(*cols, strict=True):
            if r != route and size > FLUSH_BYTES:
                yield from flush(rows)
                rows, size = [], 0
            route = r
            rows.append((d, p, lead, body))
            size += len(body)
    if rows:
        yield from flush(rows)


_PACKED = pa.schema([("doc", pa.int64()), ("cuts", pa.binary())])


@released
def _pack(batches):
    """Spans of repeated windows per document -> maximal byte spans, as int64 pairs."""
    for b in batches:
        docs, cuts = b.column(0).to_pylist(), []
        spans = b.column(1)
        flat = spans.flatten()
        at, n = flat.field(0).to_numpy(), flat.field(1).to_numpy()
        offs = spans.offsets.to_numpy() - spans.offsets[0].as_py()
        for i in range(len(docs)):
            s = at[offs[i] : offs[i + 1]]
            e = s + n[offs[i] : offs[i + 1]] + MATCH - 1
            o = np.argsort(s, kind="stable")
            s, e = s[o], np.maximum.accumulate(e[o])
            new = np.concatenate(([True], s[1:] > e[:-1]))
            ends = np.concatenate((e[np.flatnonzero(new)[1:] - 1], e[-1:]))
            cuts.append(np.column_stack((s[new], ends)).astype(np.int64).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(cuts, pa.binary())], schema=_PACKED)


def _numbered(df: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    """df with __q_doc, the id, and __q_text, the number of the row's text among those of its id."""
    h = F.xxhash64(utf8(text_col))
    out = df.withColumn("__q_doc", F.col(id_col).cast("long"))
    hashes = out.where("__q_doc is not null").select(F.col("__q_doc").alias("__q_twice"), h.alias("h")).groupBy("__q_twice")
    twice = scratch.keep(hashes.agg(F.sort_array(F.collect_set("h")).alias("__q_hashes")).where("size(__q_hashes) > 1"))
    if twice.isEmpty():
        return out.withColumn("__q_text", F.lit(0).cast("long"))
    number = F.coalesce(F.array_position("__q_hashes", h) - 1, F.lit(0)).cast("long")
    return out.join(twice, F.col("__q_doc") == F.col("__q_twice"), "left").withColumn("__q_text", number).drop("__q_twice", "__q_hashes")


def repeated_spans(numbered: DataFrame, scratch: Scratch, text_col: str = "text", hot: int = 20_000) -> DataFrame:
    """(doc, cuts): for each document that loses bytes, its maximal removed byte spans
    as int64 (start, end) pairs, with the number of its text above ``TEXT_BITS``."""
    bounded_batches(numbered.sparkSession)
    docs = numbered.select(F.col("__q_doc").alias("doc"), utf8(text_col).alias("raw"), F.col("__q_text").alias("text")).where("doc is not null")
    found = scratch.keep(docs.where(F.length("raw") >= MATCH).mapInArrow(_document_runs, _RUN_SQL).transform(_judged))
    asked = found.where(f"kind = {_OPEN_RUN}")
    crowded = asked.groupBy("anchor").count().where(F.col("count") > hot).select("anchor", F.lit(True).alias("hot"))
    asked = asked.join(crowded, "anchor", "left").groupBy("doc").agg(F.collect_list(F.struct("anchor", "at", "n", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("asked"))
    # what is asked grows with the texts: both sides are dealt by document
    opened = docs.join(scratch.keep(asked), "doc").select("doc", "raw", "text", "asked").mapInArrow(_fetch, _OPEN_SQL)
    settled = opened.repartition("route").sortWithinPartitions("route", "doc", "at").mapInArrow(_settle, _SPAN_SQL)
    spans = found.where(f"kind = {_REPEATED}").select("doc", "at", "n").unionByName(settled)
    packed = spans.groupBy("doc").agg(F.collect_list(F.struct("at", "n")).alias("spans")).mapInArrow(_pack, "doc long, cuts binary")
    return scratch.keep(packed)


def _judged(runs: DataFrame) -> DataFrame:
    # runs found repeated inside their batch come ready, under a spread key
    return runs.repartition("anchor").sortWithinPartitions("kind", "anchor", "content", "doc", "at").mapInArrow(_judge, _RUN_SQL)


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def cut(raw: bytes, cuts: bytes | None, text: int = 0) -> tuple[bytes, int, int]:
    """(remaining bytes, removed bytes, spans) of the text of that number."""
    s = np.frombuffer(cuts or b"", np.int64).reshape(-1, 2)
    s = s[s[:, 0] >> TEXT_BITS == text] & _PLACE
    keep, at = [], 0
    for a, b in s.tolist():
        keep.append(raw[at:a])
        at = b
    keep.append(raw[at:])
    return b"".join(keep), int((s[:, 1] - s[:, 0]).sum()), len(s)


@released
def _digest(batches):
    for b in batches:
        out = {k: [] for k in _DIGEST.names}
        for d, raw, text, cuts in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            kept, gone, n = cut(raw, cuts, text)
            for k, v in zip(_DIGEST.names, (d, len(raw), gone, n, hashlib.sha256(kept).hexdigest()), strict=True):
                out[k].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in _DIGEST], schema=_DIGEST)


#: Bytes of cuts that are broadcast; more are dealt by document.
CUT_BYTES = 16 << 20


def _with_cuts(numbered: DataFrame, cuts: DataFrame) -> DataFrame:
    width = cuts.agg(F.coalesce(F.sum(F.length("cuts") + 96), F.lit(0))).first()[0]
    side = cuts.select(F.col("doc").alias("__q_own"), F.col("cuts").alias("__q_cuts"))
    return numbered.join(F.broadcast(side) if width <= CUT_BYTES else side, F.col("__q_doc") == F.col("__q_own"), "left").drop("__q_own")


def removal_digest(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    numbered = _numbered(df.select(F.col(id_col), F.col(text_col)), scratch, id_col, text_col)
    cuts = repeated_spans(numbered, scratch, text_col, **options)
    docs = _with_cuts(numbered, cuts).select("__q_doc", utf8(text_col).alias("raw"), "__q_text", "__q_cuts")
    return docs.mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows with their texts cut; bytes of a character cut in two are dropped with it.
    A null text stays null; all other columns stay."""
    numbered = _numbered(df, scratch, id_col, text_col)
    cuts = repeated_spans(numbered, scratch, text_col, **options)

    @F.pandas_udf("string")
    def shorter(text, spans, number):
        return pd.Series([t if t is None or s is None else cut(t.encode(), s, n)[0].decode("utf-8", "ignore") for t, s, n in zip(text, spans, number, strict=True)], dtype=object)

    short = F.when(F.col("__q_cuts").isNull(), F.col(text_col)).otherwise(shorter(F.col(text_col), F.col("__q_cuts"), F.col("__q_text")))
    return _with_cuts(numbered, cuts).withColumn(text_col, short).select(df.columns)
