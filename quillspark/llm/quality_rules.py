"""Host-level quality rules, in DataFrame functions throughout.

Every document is judged by rules on its own text; rule failures are added up by
host, each host's rate is shrunk towards all hosts' by a beta prior fitted to the
hosts' rates (moments of the beta-binomial), and a host whose shrunk rate of any rule passes
``host_limit`` is rejected with all its documents.  Only ``base_failed`` rejects a
document by itself.

Defined cases: null text has no words and fails the base rule; a null host is no
host and is never rejected; hosts of few documents are shrunk most, and where rates
differ no more than by chance (one host, equal rates, hosts of one document) all are
shrunk to the mean by the strongest prior; ties at the limit are kept; an empty table
gives no rows; rows are kept one to one, repeated ones too; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Scratch

RULES = ("base_failed", "symbol_heavy", "line_repeats", "odd_words")
_SPACE = "[ \\\\t-\\\\r]"

#: Words in windows found twice: windows by hash, those with an equal neighbour in that order
#: by place, each adding the words it covers before the next.  ``transform(array(x), y -> ..)[0]``
#: binds x once, so that the expression stays linear wherever a filter is pushed to.
_WINDOWS = "transform(if(size(w) < 3, cast(array() as array<int>), sequence(0, size(w) - 3)), i -> struct(xxhash64(w[i], w[i + 1], w[i + 2]) as h, i as i))"
_TWICE = "sort_array(transform(filter(s, (x, i) -> coalesce(get(s, i - 1).h = x.h, false) or coalesce(get(s, i + 1).h = x.h, false)), x -> x.i))"
_COVERED = "aggregate(transform(p, (v, i) -> least(3, coalesce(get(p, i + 1) - v, 3))), 0L, (a, x) -> a + x)"
_REPEATS = f"transform(array(__q_w), w -> transform(array(sort_array({_WINDOWS})), s -> transform(array({_TWICE}), p -> {_COVERED})[0])[0])[0]"


def text_metrics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the rules."""
    t = df.withColumn("__q_t", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    t = t.withColumn("__q_w", F.expr(f"filter(split(__q_t, '{_SPACE}+'), x -> x <> '')"))
    t = t.withColumn("__q_l", F.expr(f"filter(split(__q_t, '\\n'), x -> x rlike '[^ \\\\t-\\\\r]')"))
    t = t.withColumn("n_words", F.size("__q_w").cast("long"))
    t = t.withColumn("n_repeat_words", F.expr(_REPEATS))
    t = t.withColumn("word_chars", F.length(F.array_join("__q_w", "")).cast("long"))
    t = t.withColumn("n_symbols", (F.length("__q_t") - F.length(F.regexp_replace("__q_t", "[#*$%&|<>]", ""))).cast("long"))
    t = t.withColumn("__q_n", F.size("__q_l").cast("long"))
    t = t.withColumn("n_dup_lines", F.col("__q_n") - F.size(F.array_distinct("__q_l")))
    return t.select(
        "*",
        F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words").alias("base_failed"),
        F.expr("10 * n_symbols > 3 * n_words").alias("symbol_heavy"),
        F.expr("10 * n_dup_lines > 3 * __q_n").alias("line_repeats"),
        F.expr("10 * word_chars < 25 * n_words or word_chars > 12 * n_words").alias("odd_words"),
    ).drop("__q_t", "__q_w", "__q_l", "__q_n")


#: Least correlation of documents of one host that the prior assumes; bounds its strength.
LEAST_RHO = 0.001


def host_verdicts(judged: DataFrame, host_col: str, host_limit: float) -> DataFrame:
    """(host, host_failed) from documents with the rules' columns.

    The prior of a rule is a beta distribution with the mean and the spread of the hosts' rates,
    from which the spread that rates of so few documents have by chance is taken off: of the
    variance v of rates around their mean m, m(1 - m) times the mean of 1/n is chance.
    """
    hosts = judged.where(F.col(host_col).isNotNull()).groupBy(F.col(host_col).alias("host"))
    hosts = hosts.agg(F.count("*").alias("n"), *(F.sum(F.col(r).cast("long")).alias(r) for r in RULES))
    # one row for all hosts: the moments of their rates
    moments = hosts.agg(F.avg(1 / F.col("n")).alias("u"), *(f(F.col(r) / F.col("n")).alias(f"{r}_{k}") for r in RULES for k, f in (("m", F.avg), ("v", F.var_pop)))).first().asDict()
    failed, u = F.lit(False), moments["u"] or 1.0
    for r in RULES:
        m, v = moments[f"{r}_m"] or 0.0, moments[f"{r}_v"] or 0.0
        rho = (v / (m * (1 - m)) - u) / (1 - u) if 0 < m < 1 and u < 1 else 0.0
        strength = 1 / min(max(rho, LEAST_RHO), 1.0) - 1
        failed = failed | ((F.col(r) + F.lit(m * strength)) / (F.col("n") + F.lit(strength)) > host_limit)
    return hosts.select("host", failed.alias("host_failed"))


def _failed_hosts(judged: DataFrame, scratch: Scratch, host_limit: float) -> DataFrame:
    """(__q_bad, __q_salt): the failed hosts, to be joined by ``_host_key``; broadcast where small."""
    failed = scratch.keep(host_verdicts(judged, "__q_host", host_limit).where("host_failed").select(F.col("host").alias("__q_bad"), F.lit(0).alias("__q_salt")))
    width = failed.agg(F.coalesce(F.sum(F.octet_length(F.col("__q_bad").cast("string")) + 64), F.lit(0))).first()[0]
    return F.broadcast(failed) if width <= BROADCAST_BYTES else failed


def _host_key(t: DataFrame) -> DataFrame:
    """t with a salt that spreads the rows without host, which meet no failed host."""
    return t.withColumn("__q_spread", F.when(F.col("__q_host").isNull(), F.pmod(F.xxhash64("n_words", "word_chars"), F.lit(1024)).cast("int")).otherwise(0))


def _meets():
    return (F.col("__q_host") == F.col("__q_bad")) & (F.col("__q_spread") == F.col("__q_salt"))


def quality_report(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", host_limit: float = 0.6) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(host_col).alias("__q_host"))
    judged = scratch.keep(text_metrics(docs).drop("text"))
    out = _host_key(judged).join(_failed_hosts(judged, scratch, host_limit), _meets(), "left")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("__q_bad").isNull()).alias("kept"))


def keep_good(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", host_limit: float = 0.6) -> DataFrame:
    """The rows of df that their text and their host pass.  Rows are written once with their
    verdicts, so that no text is judged twice."""
    inner = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__q_row"), F.col(text_col).alias("text"), F.col(host_col).alias("__q_host"))
    judged = scratch.keep(text_metrics(inner).select("__q_row", "__q_host", "n_words", "word_chars", *RULES))
    good = _host_key(judged.where("not base_failed")).join(_failed_hosts(judged, scratch, host_limit), _meets(), "left_anti")
    return good.select("__q_row.*")


def _rate(rule: str) -> str:
    m, v, u = f"avg(1.0 * {rule} / n)", f"var_pop(1.0 * {rule} / n)", "avg(1.0 / n)"
    rho = f"CASE WHEN {m} > 0 AND {m} < 1 AND {u} < 1 THEN ({v} / ({m} * (1 - {m})) - {u}) / (1 - {u}) ELSE 0 END"
    s = f"1 / least(greatest({rho}, {LEAST_RHO}), 1.0) - 1"
    return f"{m} * ({s}) AS {rule}_a, {s} AS {rule}_s"


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls FROM d),
g AS (SELECT doc_id, i, ws[i] || chr(32) || ws[i + 1] || chr(32) || ws[i + 2] k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) i FROM w)),
r AS (SELECT doc_id, count(DISTINCT i + o) n FROM (SELECT *, unnest([0, 1, 2]) o FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) c FROM g) WHERE c > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, source, len(ws)::BIGINT n_words, length(array_to_string(ws, ''))::BIGINT word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT n_dup_lines, len(ls) n_lines, coalesce(r.n, 0)::BIGINT n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words base_failed, 10 * n_symbols > 3 * n_words symbol_heavy,
        10 * n_dup_lines > 3 * n_lines line_repeats, 10 * word_chars < 25 * n_words OR word_chars > 12 * n_words odd_words FROM m),
h AS (SELECT source, count(*) n, {", ".join(f"sum({x}::INT) {x}" for x in RULES)} FROM j WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT {", ".join(_rate(x) for x in RULES)} FROM h),
v AS (SELECT source, {" OR ".join(f"({x} + {x}_a) / (n + {x}_s) > 0.6" for x in RULES)} bad FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(bad, false) AS kept
FROM j LEFT JOIN v USING (source)
"""
