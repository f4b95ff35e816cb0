"""Queries of the training-data operators over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontamination, exact_substrings, language_id, license_scan, minhash_dedup, packing, quality_rules, token_counts, token_files
from .common import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = language_id.train(docs.where(~held_out & F.col("lang").isNotNull()))
    out = language_id.predict(docs, model)
    return out.withColumn("held_out", held_out).select("doc_id", "held_out", "lang_pred", "score", "n_switches")


def op3_length_bucket_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), Scratch(spark))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    folder = f"{scratch.root}/files"
    token_files.write_files(_table(spark, sf_dir, "documents"), folder, tokenizer_path("word_bpe_49k.json"), scratch)
    return token_files.read_digest(spark, folder)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(_table(spark, sf_dir, "documents"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_substrings.removal_digest(_table(spark, sf_dir, "documents"), Scratch(spark))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"), Scratch(spark), percent=85)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(_table(spark, sf_dir, "documents"), Scratch(spark))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    examples = Scratch(spark).keep(chat_format.chat_examples(rows.unionByName(more)))
    return chat_format.read_back(examples)


_OPS = (
    op1_token_counts, op2_language_id, op3_length_bucket_packing, op4_token_files, op5_license_scan,
    op6_suffix_array_dedup, op7_benchmark_decontamination, op8_minhash_near_dedup, op9_quality_rules, op10_chat_formatting,
)
QUERIES = {f.__name__: f for f in _OPS}
ORACLES: dict[str, str] = {"op9_quality_rules": quality_rules.ORACLE}
