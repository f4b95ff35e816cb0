"""Packing by optimal length buckets.

Sequences (texts, cut every ``max_len`` tokens) are padded to the length of their
bucket.  Dynamic programming over the global histogram of lengths, at most
``max_len`` counts, chooses the ``buckets`` boundaries of least total padding.
Inside a bucket sequences are numbered by a hash of their key, and every
``budget // length`` of them form a batch.

Numbering is done in ``shards`` independent pieces per bucket, whose sizes are added
up first, so that no bucket is gathered in one task; a very long document's pieces
spread like any others.

Defined cases: a text without tokens (null, empty) gives one row with n_tokens 0
and null bucket, batch and slot; equal keys (repeated rows) are numbered one after
another; an empty table gives no rows; a bucket length above the budget makes
batches of one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, released, utf8
from .token_counts import worker_table


def best_boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """Bucket lengths (ascending, last = longest) of least padding for {length: count}."""
    lengths = np.array(sorted(k for k, v in histogram.items() if v > 0), np.int64)
    if not len(lengths):
        return []
    n = np.concatenate(([0], np.cumsum([histogram[int(x)] for x in lengths])))
    s = np.concatenate(([0], np.cumsum([histogram[int(x)] * int(x) for x in lengths])))
    m, far = len(lengths), np.iinfo(np.int64).max // 4
    best = np.full(m + 1, far, np.int64)
    best[0] = 0
    back = []
    for _ in range(min(buckets, m)):
        now, come = np.full(m + 1, far, np.int64), np.zeros(m + 1, np.int64)
        for lo in range(1, m + 1, 256):
            j = np.arange(lo, min(lo + 256, m + 1))
            i = np.arange(j[-1])
            cost = best[None, : j[-1]] + lengths[j - 1][:, None] * (n[j][:, None] - n[i][None, :]) - (s[j][:, None] - s[i][None, :])
            cost[i[None, :] >= j[:, None]] = far
            come[j] = cost.argmin(axis=1)
            now[j] = cost[np.arange(len(j)), come[j]]
        now[0] = 0
        back.append(come)
        best = now
    out, j = [], m
    for come in reversed(back):
        if not j:
            break
        out.append(int(lengths[j - 1]))
        j = int(come[j])
    return out[::-1]


def with_token_counts(df: DataFrame, path: str, id_col: str, text_col: str) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64())])

    @released
    def run(batches):
        table = worker_table(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(table.counts(b.column(1).to_pylist()), pa.int64())], schema=schema)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("raw")).mapInArrow(run, "doc_id long, n long")


def pack(df: DataFrame, path: str, scratch: Scratch, max_len: int = 2048, buckets: int = 16, budget: int = 16384, shards: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per sequence: (doc_id, piece, first_token, n_tokens, bucket_len, batch_id, slot, padding)."""
    spark = df.sparkSession
    bounded_batches(spark)
    counted = scratch.keep(with_token_counts(df, path, id_col, text_col))
    pieces = counted.select("doc_id", "n", F.explode(F.expr(f"sequence(0L, greatest(n - 1, 0L) div {max_len})")).alias("piece"))
    pieces = pieces.select("doc_id", "piece", (F.col("piece") * max_len).alias("first_token"), F.expr(f"least(n - piece * {max_len}, {max_len}L)").alias("n_tokens"))
    histogram = {r[0]: r[1] for r in pieces.where("n_tokens > 0").groupBy("n_tokens").count().collect()}  # at most max_len rows
    bounds = best_boundaries(histogram, buckets)
    bucket = F.lit(None).cast("long")
    for b in reversed(bounds):
        bucket = F.when(F.col("n_tokens") <= b, F.lit(b).cast("long")).otherwise(bucket)
    pieces = pieces.withColumn("bucket_len", F.when(F.col("n_tokens") > 0, bucket))
    pieces = pieces.withColumn("__q_h", F.xxhash64("doc_id", "piece")).withColumn("__q_shard", F.pmod("__q_h", F.lit(shards)).cast("int"))
    # at most buckets * shards rows
    sizes = sorted((r[0], r[1], r[2]) for r in pieces.where("n_tokens > 0").groupBy("bucket_len", "__q_shard").count().collect())
    offsets, at, last = [], 0, None
    for b, s, c in sizes:
        at = 0 if b != last else at
        offsets.append((b, s, at))
        at, last = at + c, b
    # by way of Arrow: rows of Python objects would go through a pool of workers of their own
    kinds = {"bucket_len": pa.int64(), "__q_shard": pa.int32(), "__q_offset": pa.int64()}
    table = spark.createDataFrame(pa.table([pa.array([x[i] for x in offsets], t) for i, t in enumerate(kinds.values())], list(kinds)))
    ranked = pieces.where("n_tokens > 0").selectExpr("*", "row_number() over (partition by bucket_len, __q_shard order by __q_h, doc_id, piece, first_token) - 1 as __q_rank")
    ranked = ranked.join(F.broadcast(table), ["bucket_len", "__q_shard"])
    per_batch = F.greatest(F.lit(1).cast("long"), F.expr(f"{budget} div bucket_len"))
    number = F.col("__q_rank") + F.col("__q_offset")
    # batches of a bucket are numbered from a base of their own
    base, total = F.lit(0).cast("long"), 0
    held = {b: sum(c for x, _, c in sizes if x == b) for b in bounds}
    for b in bounds:
        base = F.when(F.col("bucket_len") == b, F.lit(total).cast("long")).otherwise(base)
        total += -(-held[b] // max(1, budget // b))
    ranked = ranked.select("doc_id", "piece", "first_token", "n_tokens", "bucket_len", (base + F.expr("cast(0 as long)") + F.floor(number / per_batch)).cast("long").alias("batch_id"), F.pmod(number, per_batch).cast("int").alias("slot"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding"))
    empty = pieces.where("n_tokens = 0").selectExpr("doc_id", "piece", "first_token", "n_tokens", "cast(null as long) bucket_len", "cast(null as long) batch_id", "cast(null as int) slot", "cast(null as long) padding")
    return ranked.unionByName(empty)
