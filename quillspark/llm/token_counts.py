"""Token counts by a map-side two-tier lookup.

Tier one is a compact table of the lengths of frequent pre-tokens, broadcast to all
workers; tier two is a cache in each worker, which encodes what misses the first time.
No pre-token is shuffled.  The table comes from a bounded sample of rows: at most
``sample_docs`` texts of at most ``sample_bytes`` bytes, the first by a hash of their
bytes, and holds at most ``table`` pre-tokens.  It only saves work: whatever it holds,
each count is the library's, over the whole text.

Defined cases: null text counts as empty; texts with characters outside the compared
range, and added tokens inside texts, are counted as the library counts them; rows are
kept one to one, so repeats, ties and null ids stay; a text of any length is cut as one;
an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, released, utf8
from .pretokens import Table, distinct_pieces, pieces


def frequent_lengths(df: DataFrame, path: str, text_col: str = "text", sample_docs: int = 1024, sample_bytes: int = 16384, table: int = 32768) -> dict[bytes, int]:
    """Pre-token -> its number of tokens, for the most frequent of the sample."""
    raw = utf8(text_col)
    rows = df.select(raw.alias("raw"), F.xxhash64(raw).alias("h")).where(f"length(raw) between 1 and {sample_bytes}")
    cut = rows.select("h").orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]  # hashes alone go round
    sample = [] if cut is None else rows.where(F.col("h") <= cut).groupBy("h").agg(F.min("raw").alias("raw")).select("raw").collect()
    p, seen = pieces(path), Counter()
    texts = [t for r in sample if (t := p.plain(bytes(r[0]))) is not None]
    if texts:
        found, _ = distinct_pieces(texts, p.clip)
        seen.update(dict(zip(found[0], np.bincount(found[1], minlength=len(found[0])).tolist(), strict=True)))
    top = [x for x, n in seen.most_common(table) if n > 1 and len(x) <= 32]
    return dict(zip(top, p.encoded(top)[1].tolist(), strict=True)) if top else {}


#: This worker's table, by the query it was made for; it outlives the task.
_tables: dict[tuple[str, str], Table] = {}


def worker_table(path: str, key: str = "", shared=None) -> Table:
    if (path, key) not in _tables:
        _tables.clear()
        _tables[path, key] = Table(path, base=shared.value if shared is not None else None)
    return _tables[path, key]


def _count(path: str, shared):
    key = uuid.uuid4().hex
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    @released
    def run(batches):
        table = worker_table(path, key, shared)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(table.counts(b.column(2).to_pylist()), pa.int64())], schema=schema)

    return run


def token_counts(df: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row."""
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(frequent_lengths(df, path, text_col))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(utf8(text_col)).cast("long").alias("n_bytes"), utf8(text_col).alias("raw"))
    return docs.mapInArrow(_count(path, shared), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
