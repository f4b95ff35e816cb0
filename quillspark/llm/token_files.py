"""Token ids in binary files: frequency-ranked, byte-aligned variable-length coding.

Format, one row per block of consecutive documents: ``doc_ids`` and ``lens`` (int64
and uint32 little-endian), ``control`` (two bits a value: its bytes less one, four
values a byte) and ``data`` (the values' bytes, little-endian), where a value is the
rank of an id by falling corpus frequency (ties: smaller id first).  The rank table
lies beside the blocks.  Blocks are numbered (part, block) in ascending doc_id order.
They are written through Spark, so any store that Spark writes will do.

Defined cases: null text is empty, and has the end id alone; rows that repeat a
doc_id stand side by side, ordered by their ids; a null doc_id comes first; a text of
any length stands in one block, which grows with it; empty tables give empty files;
extra columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, released, utf8
from .pretokens import Table, pieces

#: bytes of each of the four values that a control byte describes
LENGTHS = np.array([[(c >> (2 * i) & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)


def _control(extra: np.ndarray) -> bytes:
    padded = np.zeros(-(-len(extra) // 4) * 4, np.uint8)
    padded[: len(extra)] = extra
    q = padded.reshape(-1, 4)
    return (q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6).tobytes()


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit values."""
    v = values.astype(np.uint32)
    if not len(v) or v.max() <= 0xFFFF:
        extra, data = v > 0xFF, v.astype("<u2").view(np.uint8)
        keep = np.ones((len(v), 2), bool)
        keep[:, 1] = extra
        return _control(extra), data[keep.ravel()].tobytes()
    extra = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    size = extra.astype(np.int64) + 1
    at = np.cumsum(size) - size
    data = np.empty(int(size.sum()), np.uint8)
    for k in range(4):
        m = extra >= k
        data[at[m] + k] = (v[m] >> np.uint32(8 * k)) & np.uint32(255)
    return _control(extra), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values of (control, data)."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    d = np.frombuffer(data, np.uint8)
    out = d[at].astype(np.uint32)
    for k in range(1, int(size.max()) if n else 1):
        m = np.flatnonzero(size > k)
        if len(m):
            out[m] |= d[at[m] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


#: This worker's table of pre-tokens by tokenizer file; it outlives the task.
_tables: dict[str, Table] = {}


def _kept(path: str) -> Table:
    if path not in _tables:
        _tables.clear()
        _tables[path] = Table(path, keep_ids=True)
    return _tables[path]


def _encode(path: str, end: int):
    """Texts -> their ids in two bytes each (four where the vocabulary is larger); behind the
    task's last row one more without ids, whose ``tally`` counts all ids of the task."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("tally", pa.binary())])

    @released
    def run(batches):
        table, total = _kept(path), np.zeros(1, np.int64)
        kind = _width(table.p.vocabulary, end)
        for b in batches:
            ids, count = table.ids(b.column(1).to_pylist(), end)
            seen = np.bincount(ids, minlength=len(total))
            seen[: len(total)] += total
            total = seen
            ends = np.concatenate(([0], np.cumsum(count) * np.dtype(kind).itemsize)).astype(np.int32)
            held = pa.BinaryArray.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype(kind))])
            yield pa.RecordBatch.from_arrays([b.column(0), held, pa.nulls(len(count), pa.binary())], schema=schema)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], schema=schema)

    return run


def _width(vocabulary: int, end: int) -> str:
    return "<u2" if max(vocabulary, end + 1) <= 1 << 16 else "<u4"


def _tally(batches):
    schema = pa.schema([("id", pa.int64()), ("c", pa.int64())])
    for b in batches:
        for held in b.column(0).to_pylist():
            total = np.frombuffer(held, np.int64)
            ids = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids])], schema=schema)


_BLOCK = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.binary()), ("known", pa.binary()), ("lens", pa.binary()), ("n_ids", pa.int64()), ("control", pa.binary()), ("data", pa.binary())])
_BLOCK_SQL = "part int, block int, doc_ids binary, known binary, lens binary, n_ids long, control binary, data binary"


def _write(ranks, block_ids: int, kind: str):
    @released
    def run(batches):
        rank = np.frombuffer(ranks.value, np.int32)
        part, block = TaskContext.get().partitionId(), 0
        docs, ids, size = [], [], 0

        def flush():
            nonlocal docs, ids, size, block
            control, data = pack(rank[np.concatenate(ids)])
            row = (part, block, np.array([d or 0 for d in docs], "<i8").tobytes(), bytes(d is not None for d in docs), np.array([len(x) for x in ids], "<u4").tobytes(), size, control, data)
            docs, ids, size, block = [], [], 0, block + 1
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _BLOCK, strict=True)], schema=_BLOCK)

        for b in batches:
            for d, kept in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                docs.append(d)
                ids.append(np.frombuffer(kept, kind))
                size += len(ids[-1])
                if size >= block_ids:
                    yield flush()
        if docs:
            yield flush()

    return run


def write_files(df: DataFrame, folder: str, path: str, scratch: Scratch, end: int = 2, id_col: str = "doc_id", text_col: str = "text", block_ids: int = 1 << 18) -> None:
    """Encode every row's text and write ``folder``/blocks and ``folder``/ranks."""
    spark = df.sparkSession
    bounded_batches(spark)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("raw"))
    written = scratch.keep(docs.mapInArrow(_encode(path, end), "doc_id long, ids binary, tally binary"))
    encoded = written.where("ids is not null").select("doc_id", "ids")
    # at most one row per id of the vocabulary reaches the driver
    counts = written.select("tally").where("tally is not null").mapInArrow(_tally, "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "id").collect()
    by_rank = np.array([r[0] for r in counts], np.int64)
    spark.createDataFrame([(by_rank.astype("<u4").tobytes(),)], "ids binary").coalesce(1).write.parquet(f"{folder}/ranks")
    rank = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, np.int32)
    rank[by_rank] = np.arange(len(by_rank))
    shared = spark.sparkContext.broadcast(rank.tobytes())
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), encoded.rdd.getNumPartitions())
    ordered = encoded.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(_write(shared, block_ids, _width(pieces(path).vocabulary, end)), _BLOCK_SQL).write.parquet(f"{folder}/blocks")


_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _blocks(ranks):
    """Rows of blocks with their start -> (doc ids, known, ends, ids) of each."""
    by_rank = np.frombuffer(ranks, "<u4")

    def decode(row):
        lens = np.frombuffer(row["lens"], "<u4").astype(np.int64)
        return np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["known"], np.uint8), lens, by_rank[unpack(row["control"], row["data"], row["n_ids"])]

    return decode


def read_digest(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), read from the files."""
    blocks = spark.read.schema(_BLOCK_SQL).parquet(f"{folder}/blocks")
    ranks = spark.read.schema("ids binary").parquet(f"{folder}/ranks").first()[0]
    # one row per block of a quarter million ids; starts are added up part by part
    parts = {r[0]: r[1] for r in blocks.groupBy("part").agg(F.sum("n_ids")).collect()}
    starts, at = {}, 0
    for p in sorted(parts):
        starts[p], at = at, at + parts[p]
    shared = spark.sparkContext.broadcast((ranks, starts))

    def run(batches):
        ranks, starts = shared.value
        decode = _blocks(ranks)
        for b in batches:
            for row in b.to_pylist():
                docs, known, lens, ids = decode(row)
                ends = np.cumsum(lens)
                begin = starts[row["part"]] + row["before"]
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lens.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64(), mask=known == 0), pa.array(begin + ends - lens), pa.array(lens), pa.array(crc, pa.int64())], schema=_READ)

    sizes = blocks.select("part", "block", "n_ids")
    before = sizes.selectExpr("part", "block", "sum(n_ids) over (partition by part order by block rows between unbounded preceding and current row) - n_ids as before")
    return blocks.join(before, ["part", "block"]).select(*_BLOCK.names, "before").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
