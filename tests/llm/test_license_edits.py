"""License scan of edited, repeated and short statements, against alignment at every place."""

import random

import numpy as np
import pytest

from quillspark.llm import license_scan
from quillspark.llm.common import alnum_words
from quillspark.llm.license_templates import TEMPLATES

BAND, LEAST = 12, 0.7


def encoded(index, words):
    return np.array([index.vocabulary.get(w, -1) for w in words], np.int64)


def everywhere(index, w):
    """All matches of the short templates, by an alignment at every shift."""
    for t, template in enumerate(index.words):
        if len(template) > 16:
            continue
        for d in range(-len(template) - BAND, len(w) + BAND):
            lo, hi = max(0, d - BAND), min(len(w), d + len(template) + BAND)
            if lo < hi:
                matched, first, last = license_scan.align(template, w[lo:hi], d - lo, BAND)
                if matched and matched >= LEAST * len(template):
                    yield t, matched, lo + first, lo + last


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        i = rng.randrange(len(words))
        how = rng.randrange(3)
        if how == 0 and len(words) > 1:
            del words[i]
        elif how == 1:
            words.insert(i, rng.choice([b"the", b"zz", b"license", b"4"]))
        else:
            words[i] = rng.choice([b"a", b"zz", b"under"])
    return words


@pytest.mark.parametrize("text, licence", [("Licensed under the CC BY-NC 4.0", "CC-BY-NC-4.0"), ("Licensed under Apache License, Version 2.0", "Apache-2.0"), ("Released under an MIT License", "MIT")])
def test_edited_statement(spark, text, licence):
    out = license_scan.license_scan(spark.createDataFrame([(1, f"Some words. {text}, and more.")], "doc_id long, text string")).collect()
    assert licence in {r.license for r in out if r.coverage >= LEAST}


def test_edited_templates_against_alignment_at_every_place():
    rng = random.Random(5)
    index = license_scan.Index(TEMPLATES, 4, 4)
    some = 0
    for _ in range(12):
        words = []
        for _ in range(3):
            x = alnum_words(rng.choice([t for t in TEMPLATES if len(t[2]) < 100])[2].encode())
            words += edited(rng, x, rng.randrange(5)) + [rng.choice([b"the", b"under", b"license", b"x"]) for _ in range(rng.randrange(20))]
        w = encoded(index, words)
        out = license_scan.scan_words(index, w, BAND, LEAST)
        for t, matched, first, last in everywhere(index, w):
            some += 1
            name = TEMPLATES[t][1]
            assert any(TEMPLATES[u][1] == name and n >= matched and first <= b and a <= last for u, n, a, b in out)
    assert some > 300


def test_long_template_edited_in_every_gram():
    index = license_scan.Index(TEMPLATES, 4, 4)
    t = next(i for i, x in enumerate(TEMPLATES) if x[0] == "isc-text")
    words = [b"zz" if i % 4 == 3 else x for i, x in enumerate(alnum_words(TEMPLATES[t][2].encode()))]
    assert [x[0] for x in license_scan.scan_words(index, encoded(index, words), BAND, LEAST)] == [t]


@pytest.mark.parametrize("texts", [["Licensed under CC BY-NC 4.0."] * 2, ["Released under the MIT License."] * 3, ["Licensed under CC BY-NC 4.0.", "Licensed under the CC NC 4.0.", "Licensed under CC BY-NC 4.0."]])
def test_repeated_statements_each_give_a_span(texts):
    index = license_scan.Index(TEMPLATES, 4, 4)
    licence = "MIT" if "MIT" in texts[0] else "CC-BY-NC-4.0"
    parts = [alnum_words(x.encode()) for x in texts]
    out = license_scan.scan_words(index, encoded(index, sum(parts, [])), BAND, LEAST)
    ends = np.cumsum([len(x) for x in parts]).tolist()
    assert [(a, b + 1) for t, _, a, b in out if TEMPLATES[t][1] == licence] == [(e - len(x), e) for e, x in zip(ends, parts, strict=True)]


def test_callers_templates_shorter_than_a_gram():
    index = license_scan.Index([("a", "A", "Beerware"), ("b", "B", "Zlib license"), ("c", "C", "")], 4, 4)
    scan = lambda text: [(t, a, b) for t, _, a, b in license_scan.scan_words(index, encoded(index, alnum_words(text)), BAND, LEAST)]
    assert scan(b"beerware") == [(0, 0, 0)] and scan(b"This is under the Zlib license") == [(1, 4, 5)] and scan(b"none") == scan(b"") == []
