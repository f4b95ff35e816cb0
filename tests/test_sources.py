"""Round trips of readers and writers through temporary folders."""

import json

from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import classify
from quillspark.sources import models, readers, writers
from quillspark.streaming import landing


def put(folder, name, raw):
    p = folder / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(raw if isinstance(raw, bytes) else raw.encode())


def test_text_files_in_any_encoding(spark, tmp_path):
    put(tmp_path, "甲/a.txt", "主旨：查詢".encode("cp950"))
    put(tmp_path, "甲/b.txt", "﻿說明")
    put(tmp_path, "乙/c.txt", "")
    rows = {r.file_name: r for r in readers.text_files(spark, str(tmp_path), recursive=True).collect()}
    assert (rows["a.txt"].text, rows["a.txt"].encoding, rows["a.txt"].label, rows["a.txt"].rel_path) == ("主旨：查詢", "cp950", "甲", "甲/a.txt")
    assert (rows["b.txt"].text, rows["b.txt"].encoding) == ("說明", "utf-8-sig")
    put(tmp_path, "甲/d.txt", b"ok\xff")
    got = readers.class_files(spark, str(tmp_path), ["甲"], "d").collect()
    assert [(r.text, r.label, r.doc_id) for r in got] == [("ok", "甲", "d")]


def test_json_readers(spark, tmp_path):
    put(tmp_path, "x.jsonl", '{"label":"a","text":"t"}\n\n{"label":"b"}\n')
    assert readers.jsonl(spark, str(tmp_path / "x.jsonl")).count() == 1
    put(tmp_path, "y.jsonl", '{"label":"a","text":"t"}\nbroken {\n')
    good, bad = readers.jsonl_tolerant(spark, str(tmp_path / "*.jsonl"), readers.EXAMPLE_SCHEMA, ["y"])
    assert (good.count(), bad.count()) == (1, 1)
    put(tmp_path, "m.json", json.dumps([{"model": "a:1b", "acc": 0.5, "time_str": "1分2秒"}, 3, {"model": "b"}]))
    assert [(r.pos, r.model, r.acc) for r in readers.json_array(spark, str(tmp_path / "m.json")).orderBy("pos").collect()] == [(0, "a:1b", "0.5"), (2, "b", None)]
    body = {" a.txt ": dict.fromkeys(readers.fixed.ANSWER_FIELDS, "v")}
    put(tmp_path, "k.json", json.dumps(body, ensure_ascii=False))
    assert readers.keyed_json(spark, str(tmp_path / "k.json")).first().key == "a.txt"
    put(tmp_path, "p.txt", "模型：qwen\n總執行時間： 2分5秒\n" + json.dumps(body, ensure_ascii=False).replace('"v"', "“v”"))
    heads, answers = readers.prediction_files(spark, str(tmp_path / "p.txt"))
    assert heads.first()[1:] == ("qwen", "2分05秒") and answers.count() == 1


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", "x,\"1\"\n2", None), ("b", "", 3)], "doc_id string, text string, n int")
    writers.csv(df, str(tmp_path / "csv"))
    assert sorted(readers.csv(spark, str(tmp_path / "csv"), "doc_id string, text string, n int").na.fill("").collect()) == sorted(df.na.fill("").collect())
    writers.csv_with_bom(df, str(tmp_path / "bom"))
    assert next((tmp_path / "bom").glob("*.csv")).read_bytes().startswith(b"\xef\xbb\xbf")
    writers.jsonl(df, str(tmp_path / "j"), by="doc_id")
    assert (tmp_path / "j" / "doc_id=a").is_dir()
    writers.pretty_json(df, str(tmp_path / "p.json"))
    assert [r["doc_id"] for r in json.loads((tmp_path / "p.json").read_text())] == ["a", "b"]
    writers.report(spark, str(tmp_path / "r.txt"), {"thr_sim": 0.35, "thr_margin": 0.08})
    assert readers.report_thresholds(spark, str(tmp_path / "r.txt")) == (0.35, 0.08)
    writers.text_documents(df.select(F.concat("doc_id", F.lit(".txt")).alias("rel_path"), "text"), str(tmp_path / "t"), ".clean")
    assert (tmp_path / "t" / "a.clean.txt").read_text() == "x,\"1\"\n2\n" and (tmp_path / "t" / "b.clean.txt").read_text() == "\n"
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if p.suffix != ".crc") == ["a.clean.txt", "b.clean.txt"]
    v = spark.createDataFrame([(1, "a", [1.0, 0.0])], "vec_id long, label string, embedding array<float>")
    for _ in range(2):
        writers.append_vectors(v, str(tmp_path / "v"))
    assert readers.vector_table(spark, str(tmp_path / "v")).count() == 1
    d = spark.createDataFrame([("a\nb", "a\nc")], "x string, y string").select(writers.unified_diff("x", "y").alias("d")).first().d
    assert "-b" in d and "+c" in d


def test_rules_and_missing_files(spark, tmp_path):
    put(tmp_path, "r.yaml", "甲:\n  patterns: [x, y]\n  delta: 0.5\n")
    assert readers.rules(spark, str(tmp_path / "r.yaml")) == {"甲": (["x", "y"], 0.5)}
    assert readers.rules(spark, str(tmp_path / "none.yaml")) == {} and readers.thresholds(spark, str(tmp_path / "none.json")) == {}


def test_models_as_callables(spark):
    df = spark.createDataFrame([(1, "甲"), (2, "fail")], "id int, text string")

    def client(p):
        if "fail" in p:
            raise RuntimeError("no")
        return '{"narrative": "ok"}'

    out = models.parsed_replies(models.complete(df.withColumn("prompt", models.prompt("system {transcript}", "text")), client)).orderBy("id").collect()
    assert out[0].call.narrative == "ok" and out[0].error is None and "RuntimeError" in out[1].error
    v = df.select(models.embed(models.hashed_embedder(8))("text").alias("v")).first().v
    assert abs(sum(x * x for x in v) - 1) < 1e-5


def test_classifier_round_trip(spark, tmp_path):
    rows = [(i, "ab"[i % 2], [float(i % 2), 1.0 + (i % 5) / 10]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
    m = classify.LinearClassifier(max_iter=20).fit(df)
    assert m.transform(df).where("label = pred").count() >= 58
    m.save(str(tmp_path / "m"), spark)
    assert classify.LinearClassifier.load(str(tmp_path / "m"), spark).transform(df).where("label = pred").count() >= 58


def test_landing_stream(spark, tmp_path):
    put(tmp_path, "in/a.txt", "x\n\n...")
    q = landing.start(landing.clean_stream(spark, str(tmp_path / "in"), text.trimmed_lines), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert [(r.doc_id, r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a", "x")]
