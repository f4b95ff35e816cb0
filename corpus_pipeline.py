"""Corpus pipeline: quality rules, near-dedup, substring dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs.  ``run`` gives each stage a scratch of
its own and drops it when the stage's rows are written.  A stage called by itself drops
what its predecessor over the same sf_dir left, whose rows are written by then.

Defined cases: null, empty and wordless texts fail the quality rules; of repeated rows
one stays; a row without doc_id passes both dedups as it is; an empty table gives no rows; extra columns pass through all stages but the
last, which returns sequences; n_chars, where there is such a column, follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontamination, exact_substrings, minhash_dedup, packing, quality_rules
from quillspark.llm.common import Scratch
from quillspark.llm.queries import tokenizer_path

#: scratches of stages called by themselves, by (sf_dir, place of the stage)
_left: dict[tuple[str, int], Scratch] = {}


def _scratch(spark: SparkSession, sf_dir: str, place: int) -> Scratch:
    if before := _left.pop((sf_dir, place - 1), None):
        before.drop()
    _left[sf_dir, place] = Scratch(spark)
    return _left[sf_dir, place]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Documents that pass their own rules and their host's."""
    return quality_rules.keep_good(docs, scratch or _scratch(spark, sf_dir, 0))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """One document of each group of near-duplicates, the one of least doc_id."""
    return minhash_dedup.keep_one(docs, scratch or _scratch(spark, sf_dir, 1), percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Documents without their repeated 100-byte strings; n_chars follows the text."""
    cut = exact_substrings.remove_repeats(docs, scratch or _scratch(spark, sf_dir, 2))
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.drop_contaminated(docs, benchmark, scratch or _scratch(spark, sf_dir, 3))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Token-budget batches in optimal length buckets."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), scratch or _scratch(spark, sf_dir, 4))


STAGES = [
    ("quality_rules", quality),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", substring_dedup),
    ("benchmark_decontamination", decontaminate),
    ("packing", pack),
]

#: Connected components and packing have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)


def over(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All stages over docs; the last one's input and scratch stay for the result to be read."""
    for _, stage in STAGES[:-1]:
        scratch = Scratch(spark)
        docs = Scratch(spark).keep(stage(spark, docs, sf_dir, scratch))
        scratch.drop()
    return STAGES[-1][1](spark, docs, sf_dir, Scratch(spark))
