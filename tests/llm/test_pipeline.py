"""The corpus pipeline against brute-force stages one after another."""

from collections import defaultdict

import brute
import corpus_pipeline
from conftest import SMALL
from quillspark.llm.queries import tokenizer_path


def test_pipeline(spark):
    from tokenizers import Tokenizer

    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    good = brute.quality_verdicts(docs)
    rows = [(d, t) for d, t, _ in docs if good[d][2]]
    near = brute.near_duplicates(rows, 80)
    rows = [(d, t) for d, t in rows if near[d][1] == d]
    cut = brute.repeats(rows)
    rows = [(d, cut[d][3].decode("utf-8", "ignore")) for d, _ in rows]
    dirty = brute.contamination(rows, items)
    count = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")).encode
    want = {d: len(count(t, add_special_tokens=False).ids) for d, t in rows if not dirty[d][1]}
    got = defaultdict(int)
    for r in corpus_pipeline.run(spark, SMALL).collect():
        got[r.doc_id] += r.n_tokens
    assert dict(got) == want and 0 < len(want) < len(docs)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "packing"]


def test_pipeline_on_odd_rows(spark):
    """Nulls, empty texts, repeated rows and ids, clashing columns, no n_chars, no rows."""
    from pyspark.sql import functions as F

    good = " ".join(f"word{i} and thing{i * 7 % 31}" for i in range(40))
    other = " ".join(f"name{i} or place{i * 5 % 29}" for i in range(40))
    rows = [(1, None, None), (2, "", "a"), (3, " \n\t", "a"), (4, good, "a"), (4, good, "a"), (5, good, None), (None, other, "b"), (6, other, "b"), (7, other + " tail", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *(F.lit(f"x_{c}").alias(c) for c in ("raw", "doc", "h1", "host", "n_words", "kept", "cuts")))
    out = corpus_pipeline.over(spark, docs, SMALL).collect()
    assert sorted((r.doc_id or 0, r.first_token) for r in out) == [(0, 0), (4, 0), (6, 0)]
    assert corpus_pipeline.over(spark, docs.limit(0), SMALL).collect() == []
