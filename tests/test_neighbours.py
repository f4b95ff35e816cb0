import numpy as np
import pytest

from quillspark.operators import neighbours

SCHEMA = "vec_id long, label int, embedding array<double>"


def brute(queries, index, k):
    out = []
    for q, _, v in queries:
        near = [(-float(np.dot(v, w)), n) for n, _, w in index if n != q]
        out += [(q, n, r + 1) for r, (_, n) in enumerate(sorted(near)[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    draw = np.random.default_rng(5)
    rows = [(i, i % 3, [float(x) for x in draw.integers(-3, 4, 4)]) for i in range(150)]
    return rows + [(150 + i, 0, rows[0][2]) for i in range(60)]  # copies: ties beyond k


@pytest.mark.parametrize("pass_bytes", [64 << 20, 320])
def test_one_or_many_passes_give_the_same_neighbours(spark, vectors, monkeypatch, pass_bytes):
    monkeypatch.setattr(neighbours, "_QUERIES", 3)
    monkeypatch.setattr(neighbours, "_ROWS", 7)
    index = spark.createDataFrame(vectors, SCHEMA)
    asked = [r for r in vectors if r[0] % 10 == 0]
    got = neighbours.top_k(spark.createDataFrame(asked, SCHEMA), index, 4, pass_bytes).collect()
    assert sorted((r.q, r.nb, r["rank"]) for r in got) == brute(asked, vectors, 4)


def test_nulls_empty_tables_and_no_numbers(spark):
    index = spark.createDataFrame([(1, None, [1.0, 0.0]), (2, 5, None), (3, 7, [float("nan"), 1.0]), (4, 8, [0.5, 0.0])], SCHEMA)
    asked = spark.createDataFrame([(1, 0, [1.0, 0.0]), (9, 0, None)], SCHEMA)
    assert [(r.q, r.nb, r.label, r.sim) for r in neighbours.top_k(asked, index).collect()] == [(1, 4, 8, 0.5)]
    assert neighbours.top_k(asked.where("false"), index).count() == 0
    assert neighbours.top_k(asked, index.where("false")).count() == 0


def test_vectors_of_different_lengths_are_refused(spark):
    index = spark.createDataFrame([(1, 0, [1.0]), (2, 0, [1.0, 2.0, 3.0])], SCHEMA)
    with pytest.raises(Exception, match="differ in length"):
        neighbours.top_k(index, index).collect()
