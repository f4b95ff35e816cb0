"""Queries through sources and sinks: rows are written to the shared folder, read back and compared
with the table they came from."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import anonymise, classify, sampling
from ..sources import readers, writers
from ..streaming import landing
from .catalogue import query, table
from .fixtures import TABLES, frame
from .fixtures import sql as values


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that all executors see; a local one only for a local session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/roundtrips/{name}-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def _letters(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files: a folder for each source, one file for each document."""
    t = table(spark, d, "documents").where("text is not null")
    return t.select(F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("rel_path"), "text")


@query("""SELECT doc_id || '.clean' AS doc_id, coalesce(source, 'none') AS label, coalesce(source, 'none') || '/' || doc_id || '.clean.txt' AS rel_path, md5(text || chr(10)) AS text_md5
FROM documents WHERE text IS NOT NULL""")
def files_at_mirrored_paths(spark, d):
    folder = work_folder(spark, "letters")
    writers.text_documents(_letters(spark, d), folder, ".clean")
    return readers.text_files(spark, folder, recursive=True).select("doc_id", "label", "rel_path", F.md5("text").alias("text_md5"))


@query(r"""SELECT coalesce(source, 'none') AS label, count(*) AS n, CAST(sum(strlen(text) + 1) AS BIGINT) AS n_bytes FROM documents
WHERE regexp_matches(text, '[^\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]') GROUP BY 1""")
def class_folders(spark, d):
    folder = work_folder(spark, "classes")
    writers.text_documents(_letters(spark, d), folder)
    t = readers.class_files(spark, folder)
    return t.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).cast("long").alias("n_bytes"))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(strlen(text) + 1 AS BIGINT) AS n_bytes FROM documents WHERE text IS NOT NULL")
def binary_files(spark, d):
    folder = work_folder(spark, "binary")
    writers.text_documents(_letters(spark, d), folder)
    return readers.images(spark, f"{folder}/*", "*.txt").select("doc_id", F.col("length").alias("n_bytes"))


@query("SELECT doc_id, md5(coalesce(text, '')) AS text_md5, coalesce(lang, '') AS lang FROM documents")
def csv_round_trip(spark, d):
    folder = work_folder(spark, "csv")
    writers.csv(table(spark, d, "documents").select("doc_id", "lang", "text"), folder)
    t = readers.csv(spark, folder, "doc_id long, lang string, text string")
    return t.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), F.coalesce("lang", F.lit("")).alias("lang"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def csv_with_bom_round_trip(spark, d):
    folder = work_folder(spark, "bom")
    writers.csv_with_bom(table(spark, d, "nation").select("n_nationkey", "n_name").coalesce(1), folder)
    t = readers.csv_any(spark, folder, "n_nationkey string, n_name string")
    return t.select("n_nationkey", "n_name")


@query("SELECT event_id, event_type, value, coalesce(props, '') AS props FROM events")
def jsonl_round_trip(spark, d):
    folder = work_folder(spark, "jsonl")
    writers.jsonl(table(spark, d, "events").select("event_id", "event_type", "value", "props"), folder)
    t = readers.jsonl(spark, folder, "event_id long, event_type string, value double, props string", required=["event_id"])
    return t.withColumn("props", F.coalesce("props", F.lit("")))


@query("SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY event_type")
def jsonl_folder_per_class(spark, d):
    folder = work_folder(spark, "classes")
    writers.jsonl(table(spark, d, "events").select("event_id", "event_type"), folder, by="event_type")
    return spark.read.schema("event_id long, event_type string").json(folder).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("""SELECT stem, CAST(count(*) FILTER (event_id % 7 <> 0) AS BIGINT) AS n_good, CAST(count(*) FILTER (event_id % 7 = 0) AS BIGINT) AS n_bad
FROM (SELECT event_id, event_type AS stem FROM events) WHERE stem IN ('click', 'purchase') GROUP BY stem""")
def jsonl_with_malformed_lines(spark, d):
    """Every seventh line of a file breaks off; only the files of two stems are read."""
    folder = work_folder(spark, "malformed")
    line = F.concat(F.lit('{"label":"'), F.col("event_type"), F.lit('","text":"'), F.col("event_id").cast("string"), F.when(F.col("event_id") % 7 == 0, "").otherwise('"}'))
    t = table(spark, d, "events").groupBy("event_type").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text"))
    writers.text_documents(t.select(F.concat("event_type", F.lit(".jsonl")).alias("rel_path"), "text"), folder)
    good, bad = readers.jsonl_tolerant(spark, f"{folder}/*.jsonl", readers.EXAMPLE_SCHEMA, ["click", "purchase"])
    n = good.select(F.regexp_replace("source_file", r"\.jsonl$", "").alias("stem"), F.lit(1).alias("g"), F.lit(0).alias("b"))
    n = n.unionByName(bad.select(F.regexp_replace("file_name", r"\.jsonl$", "").alias("stem"), F.lit(0).alias("g"), F.lit(1).alias("b")))
    return n.groupBy("stem").agg(F.sum("g").alias("n_good"), F.sum("b").alias("n_bad"))


@query(f"SELECT pos, model, acc, time_str FROM {values('metrics_a')}")
def json_array_round_trip(spark, d):
    path = work_folder(spark, "metrics") + ".json"
    writers.pretty_json(frame(spark, "metrics_a").orderBy("pos").select("model", "acc", "time_str"), path)
    return readers.json_array(spark, path)


_ANSWERS = TABLES["answers"][0].replace("string", "").replace(",", "").split()


@query(f"SELECT trim(key) AS key, base_date, agency, receipt_no, subject FROM {values('answers')}")
def keyed_json_round_trip(spark, d):
    path = work_folder(spark, "answers") + ".json"
    writers.keyed_json(frame(spark, "answers"), path, "key")
    return readers.keyed_json(spark, path, _ANSWERS[1:])


@query(f"SELECT 'qwen:' || row_number() OVER (ORDER BY key) AS model, '2分05秒' AS time_str, trim(key) AS key, subject FROM {values('answers')}")
def prediction_file_parse(spark, d):
    """Files with a preamble, full-width marks and curly quotes around keyed JSON."""
    folder = work_folder(spark, "predictions")
    rows = sorted(TABLES["answers"][1])
    body = [(f"p{i}.txt", f"模型：qwen:{i}\n總執行時間： 2分5秒\n{{“{r[0]}”: {{“subject”: “{r[4]}”}}}}") for i, r in enumerate(rows, 1)]
    writers.text_documents(spark.createDataFrame(body, "rel_path string, text string"), folder)
    heads, answers = readers.prediction_files(spark, f"{folder}/*.txt", ["subject"])
    return heads.join(answers, "file_name").select("model", "time_str", "key", "subject")


@query("SELECT label, count(*) AS n, round(sum(embedding[1]::DOUBLE), 6) AS first FROM embeddings GROUP BY label")
def vectors_appended_twice(spark, d):
    folder = work_folder(spark, "vectors")
    for _ in range(2):
        writers.append_vectors(table(spark, d, "embeddings"), folder)
    return readers.vector_table(spark, folder).groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum(F.col("embedding")[0].cast("double")), 6).alias("first"))


@query("SELECT p_partkey, p_name FROM part")
def feature_cache(spark, d):
    """The second call reads what the first one wrote."""
    folder = work_folder(spark, "cache")
    writers.load_or_compute(spark, folder, lambda: table(spark, d, "part").select("p_partkey", "p_name"))
    return writers.load_or_compute(spark, folder, lambda: table(spark, d, "part").select("p_partkey", F.lit("").alias("p_name")))


@query("SELECT round(quantile_cont(l_discount, 0.9), 6) AS sim, round(avg(l_tax), 6) AS margin FROM lineitem")
def report_thresholds_round_trip(spark, d):
    path = work_folder(spark, "report") + ".txt"
    found = table(spark, d, "lineitem").agg(F.percentile("l_discount", 0.9).alias("s"), F.avg("l_tax").alias("m")).first()
    writers.report(spark, path, {"thr_sim": float(found.s), "thr_margin": float(found.m)}, "rest\n")
    return spark.createDataFrame([readers.report_thresholds(spark, path)], "sim double, margin double")


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS n_equal FROM embeddings")
def classifier_artifacts(spark, d):
    folder, e = work_folder(spark, "model"), table(spark, d, "embeddings")
    model = classify.LinearClassifier(max_iter=20).fit(e)
    model.save(folder, spark)
    again = classify.LinearClassifier.load(folder, spark).transform(e).select("vec_id", F.col("pred").alias("again"))
    t = model.transform(e).select("vec_id", "pred").join(again, "vec_id")
    return t.agg(F.count("*").alias("n"), F.count_if(F.col("pred") == F.col("again")).alias("n_equal"))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(lower(text || chr(10))) AS text_md5 FROM documents WHERE text IS NOT NULL")
def landing_folder_stream(spark, d):
    folder = work_folder(spark, "landing")
    writers.text_documents(_letters(spark, d), f"{folder}/in")
    landing.start(landing.clean_stream(spark, f"{folder}/in/*", F.lower), f"{folder}/out", f"{folder}/ck").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("doc_id", F.md5("text").alias("text_md5"))


@query("""SELECT lang, count(*) AS n, CAST(least(count(*), CASE lang WHEN 'en' THEN 5 WHEN 'fr' THEN 8 ELSE 3 END) AS BIGINT) AS n_picked FROM documents WHERE lang IS NOT NULL GROUP BY lang""")
def sizes_by_category(spark, d):
    docs = table(spark, d, "documents").where("lang is not null")
    t = sampling.per_category_sample(docs.select("doc_id", "lang"), "lang", "doc_id", sampling.parse_sizes("en=5，fr=8"), n=3)
    return t.groupBy("lang").agg(F.count("*").alias("n"), F.count_if("picked").alias("n_picked"))


@query("SELECT doc_id, md5(replace(replace(text, 'the', 'NAME'), 'and', 'PLACE')) AS text_md5 FROM documents WHERE text IS NOT NULL")
def entity_replacement(spark, d):
    t = table(spark, d, "documents").where("text is not null").select("doc_id", "text", F.struct(F.lit("NAME").alias("name"), F.lit("PLACE").alias("address")).alias("profile"))
    return anonymise.replace_entities(t, lambda body: [("the", "B-PERSON"), ("and", "GPE"), ("of", "DATE")]).select("doc_id", F.md5("text").alias("text_md5"))


@query("SELECT doc_id, md5(translate(text, 'aeé', 'AEÉ')) AS text_md5 FROM documents WHERE text IS NOT NULL")
def script_conversion(spark, d):
    convert = text.converter({"a": "A", "e": "E", "é": "É"})
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(convert(F.col("text"))).alias("text_md5"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, o_orderpriority AS class, o_orderstatus AS agency FROM orders")
def summaries_by_suffix(spark, d):
    folder = work_folder(spark, "summaries") + ".jsonl"
    t = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("doc_id"), F.col("o_orderpriority").alias("class"), F.col("o_orderstatus").alias("agency"))
    writers.jsonl(t, folder)
    return readers.summaries(spark, folder).select("doc_id", "class", "agency")


