"""Nulls, empty and very long texts, ties, repeated rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

import brute
from quillspark.llm import chat_format, decontamination, exact_substrings, language_id, license_scan, minhash_dedup, packing, quality_rules, token_counts, token_files
from quillspark.llm.common import Scratch
from quillspark.llm.queries import tokenizer_path

BYTES, WORDS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
PROSE = " ".join(f"word{i} and thing{i * 7 % 31}" for i in range(60))
LONG = " ".join(f"tok{i}" for i in range(120_000))
ROWS = [
    (1, None, "en", None), (2, "", "en", "a"), (3, " \n\t ", None, "a"), (4, PROSE, "en", "a"), (5, PROSE, "fr", "a"), (5, PROSE, "fr", "a"), (None, PROSE, None, "b"), (None, None, None, None),
    (6, LONG, "de", "b"), (7, "ünï 漢字 \U0001f600 </s> <|endoftext|> [INST]", "de", "b"), (8, "Released under the MIT License.", "en", "b"), (9, "x", "es", "b"), (9, "x", "es", "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASH = ("raw", "doc", "n", "h1", "host", "bits", "cuts", "component", "n_words", "kept", "w0", "count")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).select("*", *(F.lit(f"x_{c}").alias(c) for c in CLASH))


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_token_counts(docs, none):
    out = token_counts.token_counts(docs, BYTES).collect()
    assert len(out) == len(ROWS) and all(r.n_tokens == 0 for r in out if r.n_bytes == 0) and max(r.n_tokens for r in out) > 200_000
    assert token_counts.token_counts(none, BYTES).collect() == []


def test_language_id(docs, none):
    model = language_id.train(docs)
    out = language_id.predict(docs, model).collect()
    assert len(out) == len(ROWS) and all((r.lang_pred, r.score) == ("und", 0) for r in out if r.doc_id in (1, 2, 3))
    assert language_id.train(none) is None
    assert language_id.predict(none, model).collect() == []
    many = docs.where("doc_id = 4").withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(200))))
    assert language_id.train(many, train_docs=5).labels == ["en"]
    assert {r.lang_pred for r in language_id.predict(docs, None).collect()} == {"und"}


def test_packing(spark, docs, none):
    out = packing.pack(docs, BYTES, Scratch(spark), max_len=512, budget=1024).collect()
    assert all(r.bucket_len is None and r.batch_id is None for r in out if r.n_tokens == 0) and sum(r.n_tokens == 0 for r in out) == 3
    slots = [(r.batch_id, r.slot) for r in out if r.n_tokens]
    assert len(set(slots)) == len(slots)
    assert packing.pack(none, BYTES, Scratch(spark)).collect() == []
    histogram = {1: 5, 2: 1, 7: 3, 8: 2}
    best = packing.best_boundaries(histogram, 2)
    pad = lambda bs: sum(n * (min(b for b in bs if b >= k) - k) for k, n in histogram.items())
    assert pad(best) == min(pad([a, 8]) for a in (1, 2, 7))


def test_token_files(spark, docs, none):
    for t, n in ((docs, len(ROWS)), (none, 0)):
        s = Scratch(spark)
        token_files.write_files(t, f"{s.root}/files", WORDS, s)
        out = sorted(token_files.read_digest(spark, f"{s.root}/files").collect(), key=lambda r: r.start)
        assert len(out) == n
        assert [r.doc_id for r in out[:2]] == [None, None][:n]
        assert all(a.start + a.n_tokens == b.start for a, b in zip(out, out[1:], strict=False))


def test_license_scan(docs, none):
    out = license_scan.license_scan(docs).collect()
    assert [(r.doc_id, r.license) for r in out] == [(8, "MIT")]
    assert license_scan.license_scan(none).collect() == []


def test_substrings(spark, docs, none):
    out = exact_substrings.remove_repeats(docs, Scratch(spark))
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) == len(ROWS)
    texts = {r.doc_id: r.text for r in got if r.doc_id is not None}
    assert texts[4] == PROSE and texts[5] == "" and texts[1] is None and texts[6] == LONG
    assert [r.text for r in got if r.doc_id is None].count(PROSE) == 1
    assert exact_substrings.remove_repeats(none, Scratch(spark)).collect() == []


def test_texts_of_one_id_are_documents_of_their_own(spark):
    a, b, c = (" ".join(f"{k}{i * 31 % 97}" for i in range(60)) for k in "abc")
    rows = spark.createDataFrame([(1, a), (2, a), (2, c), (3, b + a)], "doc_id long, text string")
    for hot in (0, 20_000):
        left = sorted((r.doc_id, r.text) for r in exact_substrings.remove_repeats(rows, Scratch(spark), hot=hot).collect())
        assert left == sorted([(1, a), (2, ""), (2, c), (3, b)])
        digest = {(r.doc_id, r.n_removed) for r in exact_substrings.removal_digest(rows, Scratch(spark), hot=hot).collect()}
        assert digest == {(1, 0), (2, len(a)), (2, 0), (3, len(a))}


def test_one_failing_document_sinks_no_host_of_its_own(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = spark.createDataFrame([(i, f"{good} {'# ' * 40 if i < 20 else ''}", f"host{i}") for i in range(100)], "doc_id long, text string, source string")
    assert all(r.kept for r in quality_rules.quality_report(rows, Scratch(spark)).collect())


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, PROSE), (2, None), (3, "x"), (None, "word1"), (3, "x")], "item_id long, text string")
    out = {r.doc_id: r for r in decontamination.contamination(docs, items).collect()}
    assert out[4].contaminated and out[9].items == [3] and not out[6].contaminated and out[1].n_words == 0
    left = decontamination.drop_contaminated(docs, items, Scratch(spark))
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {None, 1, 2, 3, 6, 7, 8}
    assert decontamination.contamination(none, items).collect() == []
    assert decontamination.drop_contaminated(docs, items.limit(0), Scratch(spark)).count() == len(ROWS)


def test_near_duplicates(spark, docs, none):
    out = minhash_dedup.near_duplicates(docs, Scratch(spark)).collect()
    assert len(out) == len(ROWS)
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert (by[5].component_id, by[5].kept, by[4].kept) == (4, False, True)
    assert all(by[i].n_shingles == 0 and by[i].component_id == i and by[i].kept for i in (1, 2, 3))
    assert all(r.component_id is None and not r.kept for r in out if r.doc_id is None)
    assert minhash_dedup.near_duplicates(none, Scratch(spark)).collect() == []


def test_quality_rules(spark, docs, none):
    out = quality_rules.keep_good(docs, Scratch(spark))
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} <= {None, 4, 5, 6}
    report = quality_rules.quality_report(docs, Scratch(spark)).collect()
    assert len(report) == len(ROWS) and all(r.base_failed for r in report if r.doc_id in (1, 2, 3, 9))
    assert quality_rules.quality_report(none, Scratch(spark)).collect() == []


def test_chat_format(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "a<|text|>\\[b</s>"), (1, 1, "assistant", "a<|text|>\\[b</s>"), (None, None, None, None), (2, 0, "assistant", ""), (3, 5, "user", LONG)]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit("x"))
    out = {r.conv_id: r for r in chat_format.read_back(chat_format.chat_examples(t)).collect()}
    assert {k: r.n_turns for k, r in out.items()} == {1: 3, None: 1, 2: 1, 3: 1}
    assert out[1].loss_chars == 2 * len("a<|text|>\\[b</s>") and out[3].loss_chars == 0
    assert chat_format.read_back(chat_format.chat_examples(t.limit(0))).collect() == []
    for s in ("<|turn|>", "\\<\\", "[[INST]]", "<\\[\\"):
        assert chat_format.unescape(chat_format.escape(s)) == s and "<|" not in chat_format.escape(s)


def test_brute_force_agrees_on_ties():
    assert brute.near_duplicates([(2, "a b c d e f"), (1, "a b c d e f"), (3, "")], 80) == {1: (2, 1), 2: (2, 1), 3: (0, 3)}
