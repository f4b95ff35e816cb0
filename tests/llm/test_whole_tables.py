"""The queries over the whole small tables against brute-force versions."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest

import brute
from conftest import MIDDLE, SMALL
from quillspark.llm import queries
from quillspark.llm.queries import QUERIES, tokenizer_path


def table(spark, name, *columns, folder=SMALL):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/{name}.parquet").select(*columns).collect()]


def rows(spark, name, folder=SMALL):
    return QUERIES[name](spark, folder).collect()


def test_token_counts(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    texts = dict(table(spark, "documents", "doc_id", "text"))
    out = rows(spark, "op1_token_counts")
    assert len(out) == len(texts)
    for r in out:
        n = len(t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), n, n > 1024)


def test_language_id_on_held_out_documents(spark):
    langs = dict(table(spark, "documents", "doc_id", "lang", folder=MIDDLE))
    out = rows(spark, "op2_language_id", MIDDLE)
    assert len(out) == len(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out and langs[r.doc_id] and r.lang_pred != "und"]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.95 * len(held)


def test_packing(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = {d: len(t.encode(x or "", add_special_tokens=False).ids) for d, x in table(spark, "documents", "doc_id", "text")}
    out = rows(spark, "op3_length_bucket_packing")
    pieces, batches = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id].append((r.first_token, r.n_tokens))
        if r.n_tokens:
            batches[r.batch_id].append(r)
    assert pieces.keys() == want.keys()
    for d, p in pieces.items():
        p.sort()
        assert p[0][0] == 0 and sum(n for _, n in p) == want[d]
        assert all(a + n == b for (a, n), (b, _) in zip(p, p[1:], strict=False))
    partial = defaultdict(int)
    for b in batches.values():
        assert len({r.bucket_len for r in b}) == 1 and sorted(r.slot for r in b) == list(range(len(b)))
        assert len(b) * b[0].bucket_len <= 16384
        partial[b[0].bucket_len] += len(b) < 16384 // b[0].bucket_len
        assert all(r.padding == r.bucket_len - r.n_tokens >= 0 for r in b)
    assert all(v <= 1 for v in partial.values()) and len(partial) <= 16


def test_token_files(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    out = {r.doc_id: r for r in rows(spark, "op4_token_files")}
    start = 0
    for d, text in sorted(table(spark, "documents", "doc_id", "text")):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        assert tuple(out[d]) == (d, start, len(ids), brute.crc(ids))
        start += len(ids)


def test_license_scan_finds_every_verbatim_template(spark):
    from quillspark.llm.license_templates import TEMPLATES

    found = defaultdict(set)
    for r in rows(spark, "op5_license_scan", MIDDLE):
        assert 0.7 <= r.coverage <= 1 and r.start_word < r.end_word and r.matched_words <= r.template_words
        found[r.doc_id].add(r.license)
    some = 0
    for d, text in table(spark, "documents", "doc_id", "text", folder=MIDDLE):
        joined = b" " + b" ".join(brute.alnum_words(text)) + b" "
        for _, licence, template in TEMPLATES:
            if b" " + b" ".join(brute.alnum_words(template)) + b" " in joined:
                some += 1
                assert licence in found[d]
    assert some


def test_suffix_array_dedup(spark):
    want = brute.repeats(table(spark, "documents", "doc_id", "text"))
    out = rows(spark, "op6_suffix_array_dedup")
    assert len(out) == len(want) and sum(r.n_removed > 0 for r in out)
    for r in out:
        n, gone, spans, kept = want[r.doc_id]
        assert tuple(r) == (r.doc_id, n, gone, spans, hashlib.sha256(kept).hexdigest())


def test_decontamination(spark):
    want = brute.contamination(table(spark, "documents", "doc_id", "text", folder=MIDDLE), table(spark, "benchmark", "item_id", "text", folder=MIDDLE))
    out = rows(spark, "op7_benchmark_decontamination", MIDDLE)
    assert len(out) == len(want) and any(r.contaminated for r in out)
    for r in out:
        n, hit, items = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(items), brute.items_digest(items), hit > 0)


@pytest.mark.parametrize("folder", [SMALL, MIDDLE])
def test_near_duplicates(spark, folder):
    want = brute.near_duplicates(table(spark, "documents", "doc_id", "text", folder=folder), 85)
    out = rows(spark, "op8_minhash_near_dedup", folder)
    assert len(out) == len(want)
    for r in out:
        n, c = want[r.doc_id]
        assert tuple(r) == (r.doc_id, n, c, c == r.doc_id)


def test_quality_rules(spark):
    want = brute.quality_verdicts(table(spark, "documents", "doc_id", "text", "source", folder=MIDDLE))
    out = rows(spark, "op9_quality_rules", MIDDLE)
    con = duckdb.connect()
    con.execute(f"create view documents as from '{MIDDLE}/documents.parquet'")
    oracle = {r[0]: r for r in con.execute(f"select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept from ({queries.ORACLES['op9_quality_rules']})").fetchall()}
    assert len(out) == len(want) == len(oracle)
    for r in out:
        (n, chars, symbols, dup, _, rep), failed, kept = want[r.doc_id]
        got = (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept)
        assert got == (r.doc_id, n, chars, symbols, dup, rep, failed, kept) == oracle[r.doc_id]


def test_chat_formatting(spark):
    by = defaultdict(list)
    for c, turn, role, text in table(spark, "conversations", "conv_id", "turn", "role", "text"):
        by[c].append((turn, role or "", text or ""))
    by[-7] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    out = rows(spark, "op10_chat_formatting")
    assert len(out) == len(by)
    for r in out:
        turns = sorted(by[r.conv_id])
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars >= sum(len(t) for *_, t in turns)
