"""Texts cut and merged side by side against the tokenizers library."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillspark.llm import packing, token_counts
from quillspark.llm.common import Scratch
from quillspark.llm.pretokens import Table
from quillspark.llm.queries import tokenizer_path

PATHS = [tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")]
TEXTS = ["", " ", "\n", "  a", "a  b", "a b \n c", "\n\na b\n", "don't I'll we've 12345 x", " 's 't\n'd it''s !'s", "a\xa0b c", "<|endoftext|> a", "ünï 漢字 \U0001f600 </s>", "x" * 500 + " yz", "é" * 70, " a\tb ", "a\x1cb", "A" * 3 + "É"]


@pytest.fixture(scope="module", params=PATHS)
def both(request):
    return Tokenizer.from_file(request.param), Table(request.param, keep_ids=True)


def check(both, texts):
    library, table = both
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    raws = [t.encode() for t in texts]
    assert table.counts(raws).tolist() == list(map(len, want))
    flat, count = table.ids(raws, 2)
    assert count.tolist() == [len(w) + 1 for w in want] and flat.tolist() == [i for w in want for i in (*w, 2)]


def test_listed_texts(both):
    check(both, TEXTS)
    check(both, [])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAbstmrdvel 's\n\t\xa0,.1é9ßñ<|…"), max_size=40), max_size=4))
def test_any_texts(texts):
    for path in PATHS:
        check((LIBRARY[path], TABLE[path]), texts)


LIBRARY = {p: Tokenizer.from_file(p) for p in PATHS}
TABLE = {p: Table(p, keep_ids=True) for p in PATHS}


@pytest.mark.parametrize("path", PATHS)
def test_null_empty_and_blank_texts(spark, path):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, " \n\t "), (None, "a b"), (5, "a b")], "doc_id long, text string")
    n = LIBRARY[path].encode(" \n\t ", add_special_tokens=False).ids
    out = sorted((r.doc_id or 0, r.n_tokens) for r in token_counts.token_counts(rows, path).collect())
    assert out == [(0, 2), (1, 0), (2, 0), (3, len(n)), (5, 2)]
    packed = packing.pack(rows, path, Scratch(spark)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in packed) == out
