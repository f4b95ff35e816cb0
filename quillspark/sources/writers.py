"""Writers: tables, one file per document, pretty JSON, reports; all through Spark's file systems."""

from __future__ import annotations

import contextlib
import difflib
import os
import uuid

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _write_text(spark: SparkSession, path: str, body: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(body.encode()))
    finally:
        out.close()


def not_yet_written(df: DataFrame, done: DataFrame, key: str = "doc_id", overwrite: bool = False) -> DataFrame:
    """Rows whose key is not in ``done``; all of them with ``overwrite``."""
    return df if overwrite else df.join(done.select(key), key, "left_anti")


def output_path(rel: str = "rel_path", suffix: str = "") -> F.col:
    """rel_path with a suffix before its extension."""
    return F.regexp_replace(rel, r"(?s)^(.*?)(\.[^./]*)?$", f"$1{suffix}$2") if suffix else F.col(rel)


def text_documents(df: DataFrame, folder: str, suffix: str = "") -> None:
    """One text file for each row (rel_path, text) at folder/rel_path.  Rows of one path share its
    file.  On a file system that is mounted (file:) the tasks write the files; elsewhere Spark writes
    them, a partition for each path, and the driver renames each to its path."""
    spark = df.sparkSession
    staged = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/.staged-{uuid.uuid4().hex}")
    fs = staged.getFileSystem(spark._jsc.hadoopConfiguration())
    staged = fs.makeQualified(staged)
    t = df.select(output_path(suffix=suffix).alias("out"), F.col("text").alias("value"))
    if fs.getScheme() == "file":
        fs.mkdirs(staged)
        _write_mounted(t, staged.toUri().getPath())
        fs.delete(staged, True)
    else:
        _write_and_rename(t, fs, staged)


def _write_mounted(t: DataFrame, staged: str) -> None:
    """Files of (out, value) beside the folder ``staged`` of a mounted file system: each is written
    there and then takes its path, so that a task that runs again replaces what it wrote."""
    out = F.coalesce(F.nullif("out", F.lit("")), F.lit("__HIVE_DEFAULT_PARTITION__"))

    def write(batches):
        root, part, current, stream, made = os.path.dirname(staged), f"{staged}/{uuid.uuid4().hex}", None, None, set()

        def close():
            stream.close()
            target = os.path.normpath(f"{root}/{current}")
            parent, name = os.path.split(target)
            if parent not in made:
                os.makedirs(parent, exist_ok=True)
                made.add(parent)
            with contextlib.suppress(FileNotFoundError):
                os.remove(f"{parent}/.{name}.crc")  # the check sum of a file that Hadoop wrote there
            os.replace(part, target)

        n = 0
        for batch in batches:
            for path, body in zip(batch.column(0), batch.column(1), strict=True):
                if (path := path.as_py()) != current:
                    if stream:
                        close()
                    current, stream, n = path, open(part, "wb"), n + 1
                stream.write((body.as_buffer() or b"") if body.is_valid else b"")
                stream.write(b"\n")
        if stream:
            close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    rows = t.select(out.alias("out"), F.col("value").cast("binary").alias("value")).repartition("out").sortWithinPartitions("out")
    rows.mapInArrow(write, "n long").agg(F.sum("n")).collect()


def _write_and_rename(t: DataFrame, fs, root) -> None:
    t.repartition("out").sortWithinPartitions("out").write.partitionBy("out").option("lineSep", "\n").text(root.toString())
    jvm = t.sparkSession._jvm
    plain_name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    for part in fs.listStatus(root):
        name = part.getPath().getName()
        if not name.startswith("out="):
            continue
        target = jvm.org.apache.hadoop.fs.Path(f"{root.getParent()}/{plain_name(name.removeprefix('out='))}")
        fs.mkdirs(target.getParent())
        fs.delete(target, False)
        for f in fs.listStatus(part.getPath()):
            fs.rename(f.getPath(), target)
    fs.delete(root, True)


def jsonl(df: DataFrame, path: str, by: str | None = None) -> None:
    """JSON lines with null fields; a folder for each value of ``by``."""
    w = df.write.mode("overwrite").option("ignoreNullFields", "false")
    (w.partitionBy(by) if by else w).json(path)


#: every value as it is: white space at its ends stays, and a zero byte beside a quote is no escape
_CSV = {"header": True, "quoteAll": True, "escape": '"', "charToEscapeQuoteEscaping": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, **_CSV)


def csv_with_bom(df: DataFrame, path: str) -> None:
    """CSV whose first heading carries a byte order mark, for spreadsheets."""
    first, *rest = df.columns
    df.select(F.col(f"`{first}`").alias("﻿" + first), *(f"`{c}`" for c in rest)).write.mode("overwrite").csv(path, **_CSV | {"quoteAll": False})


def parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def append_vectors(df: DataFrame, path: str) -> None:
    """Appends (vec_id, label, embedding, text); ids already there are left alone."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        df = df.join(spark.read.parquet(path).select("vec_id"), "vec_id", "left_anti")
    df.write.mode("append").parquet(path)


def load_or_compute(spark: SparkSession, path: str, compute) -> DataFrame:
    """The table at ``path``, computed and written there first if there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def pretty_json(df: DataFrame, path: str, limit: int = 100_000) -> None:
    """A report as one indented JSON array; refuses tables above ``limit`` rows."""
    rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false", "pretty": "true"}).alias("j")).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows for one JSON file; write JSON lines")
    _write_text(df.sparkSession, path, "[\n" + ",\n".join(r.j for r in rows) + "\n]\n")


def keyed_json(df: DataFrame, path: str, key: str, limit: int = 100_000) -> None:
    """A report as one JSON object keyed by a column; refuses tables above ``limit`` rows."""
    rest = F.struct(*(f"`{c}`" for c in df.columns if c != key))
    rows = df.select(F.to_json(F.map_from_arrays(F.array(key), F.array(rest)), {"ignoreNullFields": "false"}).alias("j")).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows for one JSON file; write JSON lines")
    _write_text(df.sparkSession, path, "{\n" + ",\n".join(r.j[1:-1] for r in rows) + "\n}\n")


def report(spark: SparkSession, path: str, values: dict, body: str = "") -> None:
    """A text report of name=value lines and a body."""
    _write_text(spark, path, "".join(f"{k}={v:.6f}\n" if isinstance(v, float) else f"{k}={v}\n" for k, v in values.items()) + body)


def html_page(cards: DataFrame, path: str, title: str, order: list[str], limit: int = 100_000) -> None:
    """Cards in order as one page; refuses above ``limit`` cards."""
    from ..operators.render import PAGE

    rows = cards.orderBy(*order).select("card").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} cards for one page")
    _write_text(cards.sparkSession, path, PAGE.format(title=title, body="\n".join(r.card for r in rows)))


@F.pandas_udf(T.StringType())
def unified_diff(before: pd.Series, after: pd.Series) -> pd.Series:
    """What a cleaner would change, as a unified diff."""
    return pd.Series(["\n".join(difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), "before", "after", lineterm="")) for a, b in zip(before, after, strict=True)], index=before.index, dtype=object)


def outcome(df: DataFrame, error: str = "error") -> DataFrame:
    """(total, ok, failed)."""
    return df.agg(F.count("*").alias("total"), F.count_if(F.col(error).isNull()).alias("ok"), F.count_if(F.col(error).isNotNull()).alias("failed"))
