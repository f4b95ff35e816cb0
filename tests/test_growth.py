"""Plans that do a step once and shuffle no texts."""

import re

from conftest import SMALL
from quillspark.functions import text
from quillspark.plans import catalogue


def test_alignment_shuffles_no_texts(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: sum(e.totalShuffleWrite() for e in map(store.executorList(True).apply, range(store.executorList(True).size())))
    before = written()
    catalogue.QUERIES["eval_align_occurrence"](spark, SMALL).collect()
    size = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("sum(octet_length(text)) AS n").first().n
    assert written() - before < size / 4


def test_repeats_are_looked_for_once(spark):
    plan = catalogue.QUERIES["line_adjacent_dedupe"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("受文單位", plan)) == 1


def test_repeats_that_hold_a_keyword_stay(spark):
    df = spark.createDataFrame([("a\na\n\n\n主旨\n主旨\nb\na",), ("",)], "t string").select(text.without_adjacent_repeats("t").alias("t"))
    assert [r.t for r in df.collect()] == ["a\n\n\n主旨\n主旨\nb\na", ""]
