"""Files at scale: odd values through CSV, and documents as files without a task or a call for each."""

from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.sources import readers, writers
from quillspark.streaming import landing

ODD = [None, "", " lead", "trail ", "\n", "\n\n x", "a\rb", "a\r\nb", "a\r", "\r\n", "\\", 'a\\"b', '"', '\\"', ",\"\n\"", "\0", 'a\0"b', '"\0"', "﻿x", "#x", "\t", "\x85", "\xa0", "\x1a", "null", "'", 'a\n"b"\n', "doc_id,lang,text"]


def test_csv_keeps_every_value(spark, tmp_path):
    rows = [(i, ODD[i * 7 % len(ODD)], v) for i, v in enumerate(ODD)]
    schema = "doc_id long, lang string, text string"
    writers.csv(spark.createDataFrame(rows, schema).repartition(3), str(tmp_path / "csv"))
    got = readers.csv(spark, str(tmp_path / "csv"), schema).na.fill("").collect()
    assert sorted(map(tuple, got)) == [(i, a or "", b or "") for i, a, b in rows]


def test_documents_are_written_and_read_by_few_tasks(spark, tmp_path, monkeypatch):
    n, folder = 600, str(tmp_path / "t")
    df = spark.range(n).select(F.format_string("c%d/x %%y+%d.txt", F.col("id") % 3, "id").alias("rel_path"), F.concat(F.lit("é\0"), F.col("id").cast("string")).alias("text"))
    # a file that Hadoop wrote has a check sum beside it
    writers.jsonl(df.limit(1), f"{folder}/old")
    (tmp_path / "t" / "c0").mkdir()
    (tmp_path / "t" / "c0" / ".x %y+0.txt.crc").write_bytes(b"crc\0\0\0\x02\0\0\0\0\0")
    client, calls = spark._jvm._gateway_client, []
    send = type(client).send_command
    monkeypatch.setattr(type(client), "send_command", lambda self, *a, **k: calls.append(1) or send(self, *a, **k))
    writers.text_documents(df, folder)
    monkeypatch.undo()
    assert len(calls) < n
    t = readers.text_files(spark, folder, recursive=True)
    assert t.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism < n
    assert {(r.rel_path, r.text) for r in t.collect()} == {(f"c{i % 3}/x %y+{i}.txt", f"é\0{i}\n") for i in range(n)}
    assert [p.name for p in (tmp_path / "t").iterdir() if p.name.startswith(".staged")] == []
    assert readers.images(spark, f"{folder}/c*", "*.txt").count() == n


def test_rows_of_one_path_share_a_file(spark, tmp_path):
    df = spark.createDataFrame([("a.txt", "1"), ("b/c.txt", None), ("a.txt", "1")], "rel_path string, text string")
    for _ in range(2):
        writers.text_documents(df, str(tmp_path / "t"))
    assert (tmp_path / "t" / "a.txt").read_text() == "1\n1\n" and (tmp_path / "t" / "b" / "c.txt").read_text() == "\n"


def test_stream_lists_and_reads_by_few_tasks(spark, tmp_path):
    n, tracker = 300, spark.sparkContext.statusTracker()
    writers.text_documents(spark.range(n).select(F.format_string("%d.txt", "id").alias("rel_path"), F.lit("x").alias("text")), str(tmp_path / "in"))
    q = landing.start(landing.clean_stream(spark, str(tmp_path / "in"), text.trimmed_lines), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    stages = [s for j in tracker.getJobIdsForGroup(str(q.runId)) for s in tracker.getJobInfo(j).stageIds]
    most = max(tracker.getStageInfo(s).numTasks for s in stages if tracker.getStageInfo(s))
    assert most <= 4 * spark.sparkContext.defaultParallelism < n
    assert spark.read.parquet(str(tmp_path / "out")).where("text = 'x'").count() == n
