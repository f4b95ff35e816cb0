"""Every query with an SQL counterpart gives its rows; the others give rows."""

import datetime
import decimal

import duckdb
import pytest

import __spark_entry__ as entry_module
from conftest import SMALL
from quillspark.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as from '{SMALL}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    r = con.execute(catalogue.ORACLES[name])
    have = [d[0] for d in r.description]
    assert sorted(have) == cols
    want = sorted(repr([plain(x[have.index(c)]) for c in cols]) for x in r.fetchall())
    assert got == want


@pytest.mark.parametrize("name", ["summary_flat", "pii_segment_rewrite", "pii_found_in_transcripts", "call_json_flatten", "body_fallback", "birth_date_formats", "entity_highlight", "threshold_best_and_per_class"])
def test_query_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).count() == 5
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_segment_rewrite_gives_its_texts(spark):
    """All columns are read: a count alone leaves the Python functions out of the plan."""
    got = {r["conv_id"]: (r["text"], r["n_found"]) for r in catalogue.QUERIES["pii_segment_rewrite"](spark, SMALL).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1][1] == 3 and "我的手機是0912000111\nR: \nL: 好的\nR: 信箱是 fake1@gmail.com" in got[1][0]
    assert got[2][1] == 2 and got[2][0].endswith("\nR: 生日民國74年1月2日")
    assert got[3] == ("L: 12\nR: 0912\nR: 345\nL: 好\nR: 1234567", 0)
