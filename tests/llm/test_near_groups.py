"""Groups of near copies around one text, most of which only that text links."""

import random

import pytest

import brute
from quillspark.llm import minhash_dedup
from quillspark.llm.common import Scratch


def edits_of_one_text(copies, seed=5):
    """A text of 150 words at id 500, and copies of it with one to three words changed."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(150)]
    rows = [(500, " ".join(words))]
    for d in range(copies):
        edited = list(words)
        for at in rng.sample(range(5, 145), 1 if d % 8 == 0 else 3):
            edited[at] = f"e{d}x{at}"
        rows.append((1000 + d, " ".join(edited)))
    return rows


@pytest.mark.parametrize("copies", [100, 200])
def test_pairs_do_not_grow_with_the_square_of_the_group(spark, monkeypatch, copies):
    made, pairs = [], minhash_dedup.prefix_pairs

    def counted(posted, percent, turn):
        found = pairs(posted, percent, turn)
        made.append(found.distinct().count())
        return found

    monkeypatch.setattr(minhash_dedup, "prefix_pairs", counted)
    rows = edits_of_one_text(copies)
    scratch = Scratch(spark)
    out = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), scratch, percent=80).collect()
    scratch.drop()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute.near_duplicates(rows, 80)
    assert sum(made) <= copies


def test_last_step_alone_finds_every_link(spark):
    """Without rounds all links come from the last step, where components still are single texts."""
    rows = edits_of_one_text(40) + [(3000 + d, t.replace("w", "v")) for d, t in edits_of_one_text(20, seed=6)]
    scratch = Scratch(spark)
    out = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), scratch, percent=80, rounds=0).collect()
    scratch.drop()
    assert {r["doc_id"]: r["component_id"] for r in out} == {d: c for d, (_, c) in brute.near_duplicates(rows, 80).items()}
