"""Readers with declared schemas; nothing is inferred and everything is read by Spark.

Paths go to Spark's readers, so any store will do; ``_metadata`` gives names and folders.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import calls, fixed, text

RECORD_SCHEMA = "doc_id string, label string, subject string, desc string, basis string, agency string, case_id string, address string, officer string, phone string, fax string, raw_text_len int, built_text string, built_text_masked string"
EXAMPLE_SCHEMA = "label string, text string"
METRIC_SCHEMA = "model string, acc string, time_str string"
SUMMARY_SCHEMA = "doc_id string, class string, urgency struct<is_urgent:boolean,reason:string,due_date:string>, who array<struct<role:string,name:string>>, ids array<string>, policies array<string>, basis array<string>, agency string, case_id string, subject string, summary_text string"
PROFILE_SCHEMA = ", ".join(f"{f} string" for f in fixed.PROFILE_FIELDS)


def _named(df: DataFrame) -> DataFrame:
    path = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "/")
    return df.withColumn("path", path).withColumn("file_name", text.extract("path", "([^/]+)$", 1)).withColumn("doc_id", F.regexp_replace("file_name", r"\.[^.]*$", ""))


def _binary_files(spark: SparkSession, folder: str, pattern: str, recursive: bool = False) -> DataFrame:
    """Whole files.  Spark counts 4 MB for opening each, which makes a task of every few small files;
    here a task takes files of about 16 MB together."""
    r = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    df = (r.option("recursiveFileLookup", "true") if recursive else r).load(folder)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.select("content", "length", "_metadata").coalesce(max(4 * spark.sparkContext.defaultParallelism, size >> 24))


def text_files(spark: SparkSession, folder: str, pattern: str = "*.txt", recursive: bool = False, encodings=tuple(fixed.ENCODINGS), where: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(doc_id, file_name, path, rel_path, label, text, encoding) of whole text files in any listed
    encoding; label is the folder's name.  ``where`` picks files before their texts are decoded."""
    df = _named(_binary_files(spark, folder, pattern, recursive))
    root = "/" + folder.split("://", 1)[-1].strip("/") + "/"
    rel = F.when(F.contains("path", F.lit(root)), F.substring_index("path", root, -1)).otherwise(F.col("file_name"))
    df = where(df.withColumn("rel_path", rel).withColumn("label", text.extract("path", "/([^/]+)/[^/]+$", 1)))
    # kept out of merged projections: a filter on the text would decode it again
    df = df.withColumn("d", text.decoder(encodings).asNondeterministic()("content"))
    return df.select("doc_id", "file_name", "path", "rel_path", "label", F.col("d.text").alias("text"), F.col("d.encoding").alias("encoding"))


def utf8_files(spark: SparkSession, folder: str, pattern: str = "*.txt", recursive: bool = False) -> DataFrame:
    """Whole UTF-8 files; bytes that are none are left out, not replaced."""
    return text_files(spark, folder, pattern, recursive, encodings=())


def class_files(spark: SparkSession, folder: str, classes: list[str] | None = None, name_has: str | None = None) -> DataFrame:
    """Text files one level below ``folder``; the folder's name is the label.  Empty texts are left out."""

    def where(df: DataFrame) -> DataFrame:
        if classes:
            df = df.where(F.col("label").isin(classes))
        return df.where(F.contains("file_name", F.lit(name_has))) if name_has else df

    df = text_files(spark, f"{folder.rstrip('/')}/*", encodings=(), where=where)
    return df.where(text.utrim("text") != "")


def csv(spark: SparkSession, path: str, schema: str, encoding: str = "UTF-8") -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', charToEscapeQuoteEscaping='"', encoding=encoding, enforceSchema=False)


def probe_encoding(spark: SparkSession, path: str, encodings=tuple(fixed.CSV_ENCODINGS)) -> str:
    """The first of the encodings that reads all of a file; the file is read on an executor."""
    got = spark.read.format("binaryFile").load(path).select(text.decoder(encodings)("content").alias("d")).select("d.encoding").distinct().collect()
    names = {r[0] for r in got}
    return next((e for e in reversed(encodings) if e in names), "utf-8")


def csv_any(spark: SparkSession, path: str, schema: str) -> DataFrame:
    name = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "cp950": "x-windows-950"}.get(probe_encoding(spark, path), "UTF-8")
    return csv(spark, path, schema, name)


def jsonl(spark: SparkSession, path: str, schema: str = EXAMPLE_SCHEMA, required: list[str] | None = None) -> DataFrame:
    """Strict JSON lines; only rows with all ``required`` fields (label and text by default)."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    for c in required if required is not None else ["label", "text"]:
        df = df.where(F.col(c).isNotNull())
    return df


def jsonl_tolerant(spark: SparkSession, path, schema: str, stems: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed lines) of one or many JSON-lines files, of the listed file stems only."""
    raw = _named(spark.read.text(path).select("value", "_metadata")).where(F.trim("value") != "")
    if stems:
        raw = raw.where(F.col("doc_id").isin(stems))
    parsed = raw.withColumn("r", F.from_json("value", T.StructType.fromDDL(schema + ", __q_bad string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__q_bad"}))
    bad = F.col("r").isNull() | F.col("r.__q_bad").isNotNull()
    names = T.StructType.fromDDL(schema).names
    return parsed.where(~bad).select(F.col("file_name").alias("source_file"), *(F.col(f"r.{n}") for n in names)), parsed.where(bad).select("file_name", "value")


def json_array(spark: SparkSession, path: str, schema: str = METRIC_SCHEMA) -> DataFrame:
    """Objects of a JSON array, with their place ``pos``; other values are left out."""
    whole = spark.read.text(path, wholetext=True)
    items = whole.select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "item"))
    return items.where(F.ltrim("item").startswith("{")).select("pos", F.from_json("item", schema).alias("r")).select("pos", "r.*")


def keyed_json(spark: SparkSession, path: str, fields: list[str] | None = None) -> DataFrame:
    """(key, fields...) of an object keyed by file name; keys are trimmed."""
    fields = fields or fixed.ANSWER_FIELDS
    t = T.MapType(T.StringType(), T.StructType([T.StructField(f, T.StringType()) for f in fields]))
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", t)).alias("k", "v")).select(text.utrim("k").alias("key"), "v.*")


def prediction_files(spark: SparkSession, path: str, fields: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(heads(file_name, model, time_str), answers(file_name, key, fields...)) of files with a preamble and keyed JSON."""
    fields = fields or fixed.ANSWER_FIELDS
    raw = _named(spark.read.text(path, wholetext=True).select("value", "_metadata"))
    return prediction_heads(raw), prediction_answers(raw, fields)


def prediction_heads(raw: DataFrame) -> DataFrame:
    plain = F.translate(F.replace("value", F.lit("﻿"), F.lit("")), "：　", ": ")
    tail = text.utrim(text.extract(plain, r"(?m)^[ \t]*總執行時間:([^\n]*)", 1))
    m, s = (text.extract(tail, fixed.MIN_SEC_BOTH, i).try_cast("int") for i in (1, 2))
    time = F.when(m.isNotNull(), F.format_string("%d分%02d秒", m, s)).otherwise(F.coalesce(F.nullif(tail, F.lit("")), F.lit("NA")))
    return raw.select("file_name", text.utrim(text.extract(plain, r"(?m)^[ \t]*模型:([^\n]*)", 1)).alias("model"), time.alias("time_str"))


def prediction_answers(raw: DataFrame, fields: list[str]) -> DataFrame:
    t = T.MapType(T.StringType(), T.StructType([T.StructField(f, T.StringType()) for f in fields]))
    body = calls.straight_quotes(F.substring(F.col("value"), F.instr("value", "{"), F.length("value")))
    return raw.where(F.instr("value", "{") > 0).select("file_name", F.explode(F.from_json(body, t)).alias("k", "v")).select("file_name", text.utrim("k").alias("key"), "v.*")


def boxes(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """(keep..., box_no, x1, y1, x2, y2) of nested literals of corners: numbers in order of appearance, four to
    a box, rounded, corners ordered."""
    nums = text.extract_all(F.col(column), r"(-?\d+(?:\.\d+)?)", 1)
    t = df.select("*", F.transform(nums, lambda x: F.bround(x.cast("double")).cast("int")).alias("ns"))
    t = t.select("*", F.explode(F.when(F.size("ns") >= 4, F.sequence(F.lit(0), (F.size("ns") / 4).cast("int") - 1))).alias("box_no"))
    at = lambda i: F.get("ns", F.col("box_no") * 4 + i)
    return t.select(*keep, "box_no", F.least(at(0), at(2)).alias("x1"), F.least(at(1), at(3)).alias("y1"), F.greatest(at(0), at(2)).alias("x2"), F.greatest(at(1), at(3)).alias("y2"))


def images(spark: SparkSession, folder: str, pattern: str = "*.png") -> DataFrame:
    return _named(_binary_files(spark, folder, pattern)).select("doc_id", "path", "length", "content")


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """A summary table by its suffix: .jsonl or .csv."""
    if path.endswith(".jsonl"):
        return spark.read.schema(SUMMARY_SCHEMA).json(path)
    if path.endswith(".csv"):
        return csv(spark, path, "doc_id string, class string, is_urgent boolean, due_date string, agency string, case_id string, ids string, who string, policies string, basis string, subject string, summary_text string")
    raise ValueError(f"neither .jsonl nor .csv: {path}")


def small_text(spark: SparkSession, path: str) -> str | None:
    """A parameter file (rules, thresholds, prompts) as text; None if there is none."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def rules(spark: SparkSession, path: str) -> dict[str, tuple[list[str], float]]:
    """label -> (patterns, delta) of a YAML file; none if the file is missing."""
    import yaml

    return {k: (list(v.get("patterns") or []), float(v.get("delta") or 0)) for k, v in (yaml.safe_load(small_text(spark, path) or "") or {}).items()}


def thresholds(spark: SparkSession, path: str) -> dict[str, dict[str, float]]:
    return json.loads(small_text(spark, path) or "{}")


def report_thresholds(spark: SparkSession, path: str) -> tuple[float, float] | None:
    """(sim, margin) of a text report's thr_sim= and thr_margin=."""
    import re

    body = small_text(spark, path) or ""
    found = [re.search(rf"{n}\s*=\s*([0-9.]+)", body) for n in ("thr_sim", "thr_margin")]
    return (float(found[0][1]), float(found[1][1])) if all(found) else None


def sheet(spark: SparkSession, path: str, columns: tuple[int, int] = (2, 3), names: tuple[str, str] = ("text", "category")) -> DataFrame:
    """Rows of a workbook's first sheet by position, without a heading; needs a workbook reader for pandas."""
    frame = pd.read_excel(path, header=None, usecols=list(columns), dtype=str)
    rows = [(i, *(None if pd.isna(v) else v for v in r)) for i, r in enumerate(frame.itertuples(index=False))]
    return spark.createDataFrame(rows, f"row_no int, {names[0]} string, {names[1]} string").where(" and ".join(f"trim(coalesce({n}, '')) <> ''" for n in names))


def vector_table(spark: SparkSession, path: str) -> DataFrame:
    """(vec_id, label, embedding) of a written index; an error that names the path if there is none."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        parent = p.getParent()
        near = [s.getPath().getName() for s in fs.listStatus(parent)] if parent and fs.exists(parent) else []
        raise ValueError(f"no vector table at {path}; beside it: {', '.join(near) or 'nothing'}")
    return spark.read.parquet(path)


def landing_stream(spark: SparkSession, folder: str, pattern: str = "*.txt", files_per_trigger: int = 10_000) -> DataFrame:
    """A stream of the text files that arrive in a folder."""
    # each batch lists its files again, by a task for each file if it may: a session of its own holds the limit
    spark = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", 4 * spark.sparkContext.defaultParallelism)
    schema = "path string, modificationTime timestamp, length long, content binary"
    r = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger)
    # as in _binary_files: few tasks, not one of every few small files
    t = r.load(folder).coalesce(4 * spark.sparkContext.defaultParallelism).withColumn("d", text.decoder().asNondeterministic()("content"))
    return t.select(text.extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("doc_id"), F.col("d.text").alias("text"), F.col("d.encoding").alias("encoding"), "modificationTime")
