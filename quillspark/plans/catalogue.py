"""All queries of the library by name, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calls, fixed, numbers, privacy, text
from ..operators import anonymise, classify, clean, evaluate, extract, lines, neighbours, render, sampling
from ..sources import models, readers, writers
from .fixtures import frame
from .fixtures import sql as values

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rules_sql(c: str, rules) -> str:
    """The replacements as nested SQL calls (RE2: \\1 references)."""
    for pattern, to in rules:
        c = f"regexp_replace({c}, {_q(pattern)}, {_q(to.replace('$1', chr(92) + '1'))}, 'g')"
    return c


# --- neighbours --------------------------------------------------------------------------

_KNN = """s AS (SELECT a.vec_id q, a.label y, b.vec_id nb, b.label lb, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) sim
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, nb) r FROM s) WHERE r <= 5),
v AS (SELECT q, lb, sum(sim) votes, max(sim) ms FROM k GROUP BY q, lb)"""
_FEATURES = """e AS (SELECT *, exp((votes - max(votes) OVER (PARTITION BY q)) / 0.7) ex FROM v),
g AS (SELECT *, ex / (sum(ex) OVER (PARTITION BY q) + 1e-12) p1, row_number() OVER (PARTITION BY q ORDER BY votes DESC, lb) rn,
  votes - lead(votes, 1, 0.0) OVER (PARTITION BY q ORDER BY votes DESC, lb) margin FROM e),
f AS (SELECT q, lb top1, ms max_sim, margin, p1, label y FROM g JOIN embeddings ON q = vec_id WHERE rn = 1)"""


def _near(spark, d):
    e = table(spark, d, "embeddings")
    return neighbours.top_k(e.where("vec_id % 100 = 0"), e)


def _feats(spark, d, **more):
    truth = table(spark, d, "embeddings").select(F.col("vec_id").alias("q"), F.col("label").alias("y_true"))
    return neighbours.features(neighbours.votes(_near(spark, d), **more)).join(truth, "q")


@query(f"WITH {_KNN}, {_FEATURES} SELECT q, y AS y_true, top1, round(max_sim, 6) AS max_sim, round(margin, 6) AS margin, CASE WHEN max_sim >= 0.35 AND margin >= 0.08 THEN top1 ELSE -1 END AS pred FROM f")
def knn_vote_margin(spark, d):
    f = _feats(spark, d)
    return f.select("q", "y_true", "top1", F.round("max_sim", 6).alias("max_sim"), F.round("margin", 6).alias("margin"), neighbours.decided().alias("pred"))


@query(f"WITH {_KNN} SELECT q, nb, lb AS label, r AS rank, round(sim, 6) AS sim FROM k")
def knn_neighbours(spark, d):
    return _near(spark, d).select("q", "nb", "label", F.col("rank").cast("long").alias("rank"), F.round("sim", 6).alias("sim"))


@query(f"""WITH {_KNN}, {_FEATURES} SELECT q, top1, round(p1, 6) AS p1, CASE WHEN p1 >= 0.3 THEN top1 ELSE -1 END AS pred_prob,
CASE WHEN p1 >= 0.3 AND max_sim >= 0.35 AND margin >= 0.08 THEN top1 ELSE -1 END AS pred_mixed FROM f""")
def knn_softmax_prob(spark, d):
    return _feats(spark, d).select("q", "top1", F.round("p1", 6).alias("p1"), neighbours.decided("prob").alias("pred_prob"), neighbours.decided("mixed").alias("pred_mixed"))


@query(f"""WITH {_KNN}, {_FEATURES}, t(label, ts, tm) AS (VALUES (0, 0.2, 0.01), (1, 0.5, 0.2), (2, 0.3, 0.3))
SELECT q, top1, CAST(coalesce(ts, 0.35) AS DOUBLE) AS ts, CAST(coalesce(tm, 0.08) AS DOUBLE) AS tm, CASE WHEN max_sim >= coalesce(ts, 0.35) AND margin >= coalesce(tm, 0.08) THEN top1 ELSE -1 END AS pred
FROM f LEFT JOIN t ON label = top1""")
def knn_per_class_threshold(spark, d):
    per = spark.createDataFrame([(0, 0.2, 0.01), (1, 0.5, 0.2), (2, 0.3, 0.3)], "label int, sim double, margin double")
    t = neighbours.with_thresholds(_feats(spark, d), per)
    return t.select("q", "top1", "ts", "tm", neighbours.decided(sim=F.col("ts"), margin=F.col("tm")).alias("pred"))


@query(f"""WITH {_KNN}, w AS (SELECT q, lb, votes * CASE lb WHEN 3 THEN 1.2 ELSE 1.0 END votes, ms FROM v UNION ALL SELECT vec_id, (label + 1) % 10, 0.05, -1e9 FROM embeddings WHERE vec_id % 100 = 0),
x AS (SELECT q, lb, sum(votes) votes, max(ms) ms FROM w GROUP BY q, lb) SELECT q, lb AS label, round(votes, 6) AS votes, round(ms, 6) AS max_sim FROM x""")
def knn_rule_bonus_prior(spark, d):
    prior = spark.createDataFrame([(3, 1.2)], "label int, weight double")
    bonus = table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), ((F.col("label") + 1) % 10).alias("label"), F.lit(0.05).alias("delta"))
    return neighbours.votes(_near(spark, d), prior, bonus).select("q", "label", F.round("votes", 6).alias("votes"), F.round("max_sim", 6).alias("max_sim"))


_GRID_S, _GRID_M = numbers.linspace(0.30, 0.45, 16), numbers.linspace(0.05, 0.15, 11)


@query(f"""WITH {_KNN}, {_FEATURES}, gs AS (SELECT unnest({_GRID_S}::DOUBLE[]) ts), gm AS (SELECT unnest({_GRID_M}::DOUBLE[]) tm),
c AS (SELECT ts, tm, y, CASE WHEN max_sim >= ts AND margin >= tm THEN top1 ELSE -1 END p FROM f, gs, gm), labels AS (SELECT DISTINCT y l FROM f),
h AS (SELECT ts, tm, l, count(*) FILTER (y = l AND p = l) tp, count(*) FILTER (y = l) sup, count(*) FILTER (p = l) pre FROM c, labels GROUP BY ts, tm, l)
SELECT ts, tm, round(avg(CASE WHEN tp > 0 THEN 2.0 * tp / (sup + pre) ELSE 0 END), 6) AS macro_f1, round(sum(tp) / sum(sup), 6) AS accuracy FROM h GROUP BY ts, tm""")
def threshold_grid_macro_f1(spark, d):
    s = neighbours.sweep(_feats(spark, d), _GRID_S, _GRID_M)
    return s.select("ts", "tm", F.round("macro_f1", 6).alias("macro_f1"), F.round("accuracy", 6).alias("accuracy"))


@query()
def threshold_best_and_per_class(spark, d):
    f = _feats(spark, d)
    best = neighbours.best_cell(neighbours.sweep(f, _GRID_S, _GRID_M)).first()
    tuned = neighbours.tuned_per_class(f, best.ts, best.tm) if best and best.ts is not None else []
    per = spark.createDataFrame(tuned, "label int, sim double, margin double")
    t = neighbours.with_thresholds(f, per, best.ts or 0.35, best.tm or 0.08)
    return t.select("q", "y_true", "top1", F.round("ts", 6).alias("ts"), F.round("tm", 6).alias("tm"), neighbours.decided(sim=F.col("ts"), margin=F.col("tm")).alias("pred"))


@query(f"WITH {_KNN}, {_FEATURES} SELECT top1, round(quantile_cont(max_sim, 0.2), 6) AS sim_p20, round(quantile_cont(max_sim, 0.8), 6) AS sim_p80, round(quantile_cont(margin, 0.2), 6) AS margin_p20, round(quantile_cont(margin, 0.8), 6) AS margin_p80 FROM f GROUP BY top1")
def feature_percentiles(spark, d):
    p = lambda c, q, n: F.round(F.percentile(c, q), 6).alias(n)
    return _feats(spark, d).groupBy("top1").agg(p("max_sim", 0.2, "sim_p20"), p("max_sim", 0.8, "sim_p80"), p("margin", 0.2, "margin_p20"), p("margin", 0.8, "margin_p80"))


@query()
def linear_classifier(spark, d):
    e = table(spark, d, "embeddings")
    return classify.LinearClassifier().fit(e).transform(e).select("vec_id", F.col("label").cast("string").alias("label"), "pred")


_THREE = ["扣押命令", "撤銷令", "通知函"]


@query(f"""WITH t AS (SELECT row_no, [ln(greatest(p1, 1e-9)) + CASE WHEN regexp_matches(coalesce(text, ''), '扣押|支付轉給命令|禁止給付|強制執行法|執行處') THEN 0.5 ELSE 0 END,
ln(greatest(p2, 1e-9)) + CASE WHEN contains(coalesce(text, ''), '撤銷') THEN 0.4 ELSE 0 END, ln(greatest(p3, 1e-9)) + CASE WHEN regexp_matches(coalesce(text, ''), '請查照|如說明辦理|轉知|知會') THEN 0.2 ELSE 0 END] z FROM {values("nudge_rows")})
SELECT row_no, {_THREE}[list_position(z, list_max(z))] AS pred, round(list_max(z), 6) AS score FROM t""")
def rule_nudged_argmax(spark, d):
    t = frame(spark, "nudge_rows").withColumn("p", F.array("p1", "p2", "p3"))
    t = t.withColumn("z", classify.nudged("p", "text", _THREE))
    return t.select("row_no", classify.argmax_label("z", _THREE).alias("pred"), F.round(F.array_max("z"), 6).alias("score"))


# --- evaluation: languages of documents against words that give them away -------------------

_RULE = "CASE WHEN contains(text, ' the ') THEN 'en' WHEN contains(text, ' der ') THEN 'de' WHEN contains(text, ' le ') THEN 'fr' WHEN contains(text, ' el ') THEN 'es' ELSE 'Other' END"
_RULE_2 = "CASE WHEN contains(text, ' la ') THEN 'fr' WHEN contains(text, ' und ') THEN 'de' ELSE 'en' END"
_PRED = f"p AS (SELECT doc_id, text, lang AS label_true, {_RULE} AS label_pred, {_RULE_2} AS label_2 FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL)"


def _preds(spark, d):
    return table(spark, d, "documents").where("lang is not null and text is not null").selectExpr("doc_id", "text", "lang AS label_true", f"{_RULE} AS label_pred", f"{_RULE_2} AS label_2")


@query(f"""WITH {_PRED}, g AS (SELECT text, label_true, row_number() OVER (PARTITION BY text ORDER BY doc_id) - 1 o FROM p),
h AS (SELECT text, label_pred, row_number() OVER (PARTITION BY text ORDER BY doc_id) - 1 o FROM p WHERE label_pred <> 'Other')
SELECT o AS occurrence, count(*) AS n_rows, round(avg(CASE WHEN label_true = label_pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM g JOIN h USING (text, o) GROUP BY o""")
def eval_align_occurrence(spark, d):
    # a text is known by its SHA-256: the texts themselves are not shuffled
    p = _preds(spark, d).withColumn("text", F.unhex(F.sha2("text", 256)))
    gold = p.select("text", F.col("doc_id").alias("row_id"), F.col("label_true").alias("label"))
    pred = p.where("label_pred <> 'Other'").select("text", F.col("doc_id").alias("row_id"), F.col("label_pred").alias("label"))
    return evaluate.aligned(gold, pred).groupBy("occurrence").agg(F.count("*").alias("n_rows"), F.round(F.avg((F.col("label_true") == F.col("label_pred")).cast("double")), 6).alias("accuracy"))


@query(f"WITH {_PRED} SELECT count(*) AS n_rows, round(avg(CASE WHEN label_true = label_pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM p")
def eval_accuracy(spark, d):
    return evaluate.accuracy(_preds(spark, d))


@query(f"WITH {_PRED} SELECT label_true, count(*) AS errors FROM p WHERE label_true <> label_pred GROUP BY label_true")
def eval_errors_by_label(spark, d):
    return evaluate.errors_by_label(_preds(spark, d))


_CELLS = "SELECT a.l AS label_true, b.l AS label_pred, count(p.doc_id) AS n FROM {a} a CROSS JOIN {b} b LEFT JOIN p ON p.label_true = a.l AND p.label_pred = b.l GROUP BY a.l, b.l"


@query(f"WITH {_PRED}, u AS (SELECT label_true l FROM p UNION SELECT label_pred FROM p) {_CELLS.format(a='u', b='u')}")
def eval_confusion(spark, d):
    return evaluate.confusion(_preds(spark, d))


@query(f"WITH {_PRED}, u AS (SELECT DISTINCT label_true l FROM p) {_CELLS.format(a='u', b='u')}")
def confusion_true_labels_only(spark, d):
    return evaluate.confusion(_preds(spark, d), true_only=True)


@query(f"""WITH {_PRED}, u AS (SELECT unnest(['de', 'en', 'es', 'fr', 'Other']) l)
SELECT l AS label_true, {', '.join(f"count(*) FILTER (label_pred = '{x}') AS {x}" for x in ('de', 'en', 'es', 'fr', 'Other'))} FROM u LEFT JOIN p ON label_true = l GROUP BY l""")
def confusion_matrix_pivot(spark, d):
    return evaluate.confusion_matrix(_preds(spark, d), ["de", "en", "es", "fr", "Other"])


_PRF = f"""WITH {_PRED}, u AS (SELECT label_true l FROM p UNION SELECT label_pred FROM p),
h AS (SELECT l, count(*) FILTER (label_true = l AND label_pred = l) tp, count(*) FILTER (label_true = l) support, count(*) FILTER (label_pred = l) predicted FROM p, u GROUP BY l),
x AS (SELECT l AS label, support, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END prec, CASE WHEN support > 0 THEN tp / support ELSE 0 END rec, CASE WHEN tp > 0 THEN 2.0 * tp / (support + predicted) ELSE 0 END f1 FROM h)"""


@query(f"{_PRF} SELECT label, CAST(support AS BIGINT) AS support, round(prec, 6) AS precision, round(rec, 6) AS recall, round(f1, 6) AS f1 FROM x")
def eval_prf_report(spark, d):
    s = evaluate.per_class(_preds(spark, d), true="label_true", pred="label_pred")
    return s.select("label", F.col("support").cast("long").alias("support"), *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(f"""{_PRF} SELECT 'macro' AS average, round(avg(prec), 6) AS precision, round(avg(rec), 6) AS recall, round(avg(f1), 6) AS f1, CAST(sum(support) AS BIGINT) AS support FROM x
UNION ALL SELECT 'macro_true', round(avg(prec), 6), round(avg(rec), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM x WHERE support > 0
UNION ALL SELECT 'weighted', round(sum(prec * support) / sum(support), 6), round(sum(rec * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM x""")
def eval_macro_f1_union_vs_true(spark, d):
    return evaluate.averages(evaluate.per_class(_preds(spark, d), true="label_true", pred="label_pred")).withColumn("support", F.col("support").cast("long"))


@query(f"""WITH {_PRED}, j AS (SELECT label_true AS label, CASE WHEN label_pred <> 'Other' THEN label_pred ELSE '<missing>' END m, label_2 u FROM p),
x AS (SELECT label, count(*) n, avg(CASE WHEN m = label THEN 1.0 ELSE 0.0 END) a, avg(CASE WHEN u = label THEN 1.0 ELSE 0.0 END) b FROM j GROUP BY label)
SELECT label, n, round(a, 6) AS acc_masked, round(b, 6) AS acc_unmasked, round(b - a, 6) AS delta FROM x""")
def eval_dual_delta(spark, d):
    p = _preds(spark, d)
    return evaluate.dual_delta(p.select("doc_id", F.col("label_true").alias("label")), p.where("label_pred <> 'Other'").select("doc_id", F.col("label_pred").alias("pred")), p.select("doc_id", F.col("label_2").alias("pred")))


_FIELDS = ["base_date", "agency", "receipt_no", "subject"]
_NORM = "trim(regexp_replace(coalesce({}, ''), '\\s+', ' ', 'g'))"


@query(f"""WITH j AS (SELECT trim(a.key) AS key, {', '.join(f'a.{f}, p.{f} AS p_{f}' for f in _FIELDS)} FROM {values("answers")} a LEFT JOIN {values("preds")} p ON trim(a.key) = trim(p.key)),
x AS ({' UNION ALL '.join(f"SELECT key, '{f}' AS field, {_NORM.format(f)} <> {_NORM.format('p_' + f)} AS wrong FROM j" for f in _FIELDS)})
SELECT field, count(*) AS total, CAST(sum(CAST(wrong AS INT)) AS BIGINT) AS wrong, round(1 - sum(CAST(wrong AS INT)) / count(*), 6) AS accuracy FROM x GROUP BY field""")
def field_match_accuracy(spark, d):
    w = evaluate.field_accuracy(frame(spark, "answers"), frame(spark, "preds"), _FIELDS)
    return w.groupBy("field").agg(F.count("*").alias("total"), F.sum(F.col("wrong").cast("long")).alias("wrong"), F.round(1 - F.avg(F.col("wrong").cast("double")), 6).alias("accuracy"))


_SECONDS = r"""CASE WHEN regexp_full_match(trim(time_str), '(?:(\d+)\s*分)?\s*(?:(\d+(?:\.\d+)?)\s*秒)?') AND trim(time_str) <> '' THEN
 coalesce(TRY_CAST(regexp_extract(time_str, '(\d+)\s*分', 1) AS DOUBLE), 0) * 60 + coalesce(TRY_CAST(regexp_extract(time_str, '(\d+(?:\.\d+)?)\s*秒', 1) AS DOUBLE), 0) END"""


def _metrics_sql(name: str) -> str:
    return f"SELECT trim(model) AS model, TRY_CAST(acc AS DOUBLE) AS acc, time_str, {_SECONDS} AS seconds FROM (SELECT *, row_number() OVER (PARTITION BY trim(model) ORDER BY pos DESC) rn FROM {values(name)} WHERE trim(coalesce(model, '')) <> '') WHERE rn = 1"


@query(f"WITH m AS ({_metrics_sql('metrics_a')}) SELECT model, acc, time_str, seconds, CASE WHEN regexp_extract(lower(model), '^(.+?)[:\\-_]\\d+\\.?\\d*b', 1) <> '' THEN regexp_extract(lower(model), '^(.+?)[:\\-_]\\d+\\.?\\d*b', 1) ELSE lower(model) END AS family FROM m")
def metrics_normalise(spark, d):
    return evaluate.normalised_metrics(frame(spark, "metrics_a"))


@query(f"""WITH a AS ({_metrics_sql('metrics_a')}), b AS ({_metrics_sql('metrics_b')}),
j AS (SELECT coalesce(a.model, b.model) AS model, a.acc AS acc1, b.acc AS acc2, a.seconds AS sec1, b.seconds AS sec2 FROM a FULL JOIN b ON a.model = b.model),
k AS (SELECT *, sec2 - sec1 AS gap FROM j)
SELECT model, acc1, acc2, round(acc2 - acc1, 6) AS acc_diff, sec1, sec2, round(gap, 6) AS time_diff_sec, round(gap / nullif(sec1, 0) * 100, 6) AS time_diff_pct,
CASE WHEN gap IS NULL THEN 'N/A' ELSE CASE WHEN gap < 0 THEN '-' ELSE '' END || CASE WHEN abs(gap) >= 60 THEN CAST(CAST(floor(abs(gap) / 60) AS BIGINT) AS VARCHAR) || '分' ELSE '' END ||
 CASE WHEN abs(gap) % 60 = floor(abs(gap) % 60) THEN CAST(CAST(abs(gap) % 60 AS BIGINT) AS VARCHAR) ELSE printf('%.2f', abs(gap) % 60) END || '秒' END AS time_diff FROM k""")
def run_diff(spark, d):
    return evaluate.run_diff(*(evaluate.normalised_metrics(frame(spark, n)) for n in ("metrics_a", "metrics_b")))


@query(f"WITH {_PRED} SELECT doc_id, label_true, label_pred, CASE WHEN length(s) <= 80 THEN s ELSE substr(s, 1, 80) || '…' END AS text FROM (SELECT *, replace(trim(text, chr(10) || ' ' || chr(9) || chr(13)), chr(10), ' ') s FROM p WHERE label_true <> label_pred ORDER BY doc_id LIMIT 20)")
def top_error_examples(spark, d):
    return evaluate.top_errors(_preds(spark, d), "doc_id")


@query("""WITH f AS (SELECT doc_id, source AS label, text, source || '/' || doc_id AS path FROM documents), g AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'elsewhere' ELSE NULL END AS label FROM labels),
a AS (SELECT doc_id, min_by(text, path) t FROM f GROUP BY doc_id), o AS (SELECT doc_id, label, min_by(text, path) t FROM f GROUP BY doc_id, label)
SELECT g.doc_id, g.label, length(coalesce(o.t, a.t, '')) AS n_chars FROM g LEFT JOIN o USING (doc_id, label) LEFT JOIN a USING (doc_id)""")
def locate_with_fallback(spark, d):
    files = table(spark, d, "documents").select("doc_id", F.col("source").alias("label"), "text", F.concat_ws("/", "source", "doc_id").alias("path"))
    gold = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "elsewhere").alias("label"))
    return evaluate.located(gold, files).select("doc_id", "label", F.length("text").cast("long").alias("n_chars"))


@query("""SELECT doc_id, coalesce(max_by(p, pos), lang) AS class FROM (SELECT doc_id, lang FROM documents) LEFT JOIN (SELECT doc_id, 'p' || toxic AS p, quality AS pos FROM labels) USING (doc_id) GROUP BY doc_id, lang""")
def last_prediction_wins(spark, d):
    preds = table(spark, d, "labels").select("doc_id", F.concat(F.lit("p"), F.col("toxic").cast("string")).alias("pred"), F.col("quality").alias("pos"))
    return evaluate.with_last_prediction(table(spark, d, "documents").select("doc_id", F.col("lang").alias("label")), preds).select("doc_id", "class")


# --- lines -----------------------------------------------------------------------------------

_LINES = r"""l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM
 (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '\r\n?|[\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]', chr(10), 'g'), '\n\z', ''), chr(10)) ls FROM documents WHERE length(text) > 0))"""
_WSQ = _q("".join(fixed.SPACES))
_ZH = f"z AS (SELECT * FROM {values('zh_lines')})"


def _lines(spark, d):
    return lines.explode_lines(table(spark, d, "documents"))


@query(f"WITH {_LINES} SELECT doc_id, count(*) AS n_lines, count(*) FILTER (trim(line, {_WSQ}) = '') AS n_blank, count(*) FILTER (NOT regexp_matches(line, '[\\p{{L}}\\p{{N}}]')) AS n_punct, count(*) FILTER (regexp_matches(line, '^[\\p{{P}}\\p{{S}}]+$')) AS n_symbols FROM l GROUP BY doc_id")
def line_punct_only(spark, d):
    n = lambda c: F.count_if(c)
    return _lines(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_lines"), n(text.utrim("line") == "").alias("n_blank"), n(text.is_punct_only("line")).alias("n_punct"), n(text.is_symbols_only("line")).alias("n_symbols"))


@query(f"""WITH {_ZH} SELECT doc_id, line_no, regexp_matches(trim(line), '^第\\s*\\d+\\s*頁(?:\\s*/\\s*共\\s*\\d+\\s*頁)?\\s*$|^(?i:Page)\\s*\\d+(?:\\s*/\\s*\\d+)?\\s*$|^\\s*-+\\s*\\d+\\s*-+\\s*$|^\\s*_{{2,}}\\s*$') AS page,
regexp_matches(trim(line), '{fixed.PAGE_MARKER_STRICT}') AS strict, regexp_matches(trim(line), '{fixed.PAGE_MARKER_LOOSE}') AS loose, line_no < 5 AS head FROM z""")
def line_page_markers(spark, d):
    t, s = frame(spark, "zh_lines"), text.utrim("line")
    return t.select("doc_id", "line_no", text.is_page_line("line").alias("page"), text.found(s, fixed.PAGE_MARKER_STRICT).alias("strict"), text.found(s, fixed.PAGE_MARKER_LOOSE).alias("loose"), (F.col("line_no") < 5).alias("head"))


_NOISE_RE = _q(f"[{fixed.NOISE_CHARS}]").replace("\\·", "·").replace("\\•", "•")


@query(f"""WITH {_LINES}, s AS (SELECT doc_id, line_no, trim(line, {_WSQ}) s FROM l)
SELECT doc_id, line_no, s <> '' AND (regexp_full_match(s, {_NOISE_RE} || '+') OR (length(s) <= 3 AND length(regexp_replace(s, {_NOISE_RE}, '', 'g')) <= 1)) AS noise FROM s""")
def line_filter_noise(spark, d):
    return _lines(spark, d).select("doc_id", "line_no", text.is_noise_line("line").alias("noise"))


@query(f"""WITH {_ZH} SELECT doc_id, line_no, trim(line) <> '' AND ((line_no < 30 AND regexp_matches(line, '[:：]') AND regexp_matches(trim(line), '^[一-鿿]')) OR regexp_matches(line, {_q(text.any_of(fixed.KEEP_LINE))})) AS keep,
(regexp_matches(rtrim(line), {_q(text.any_of(fixed.BANNED_LINE).replace(chr(92) + '·', '·').replace(chr(92) + '•', '•'))}) OR (length(trim(line)) <= 1 AND NOT regexp_matches(line, '[一-鿿]'))) AND NOT regexp_matches(line, {_q('|'.join(fixed.KEEP_WORDS))}) AS banned FROM z""")
def line_filter_keep_ban(spark, d):
    return frame(spark, "zh_lines").select("doc_id", "line_no", text.must_keep("line", F.col("line_no")).alias("keep"), text.is_banned("line").alias("banned"))


@query(f"""WITH {_LINES}, s AS (SELECT *, trim(line, {_WSQ}) key FROM l), c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, key) copies, count(*) OVER (PARTITION BY doc_id) n FROM s)
SELECT doc_id, line_no, line FROM c WHERE NOT (n >= 40 AND copies >= 2 AND key <> '' AND length(key) < 30 AND NOT regexp_matches(key, {_q('|'.join(fixed.KEEP_WORDS))}))""")
def line_repeat_header_footer(spark, d):
    t = table(spark, d, "documents").where(F.length("text") > 0)
    return t.select("doc_id", F.inline(text.let(text.lines("text"), lambda ls: lines.without_repeated_short_lines(ls))))


_HEAD_SQL = _q(fixed.PARAGRAPH_HEAD)


@query(f"""WITH {_LINES}, r AS (SELECT doc_id, line_no, rtrim(line, ' ' || chr(9)) AS line FROM l),
n AS (SELECT *, lag(line) OVER w AS prev FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
b AS (SELECT *, CASE WHEN prev IS NULL THEN 'start' WHEN prev = '' OR ltrim(line, ' ' || chr(9)) = '' THEN 'break' WHEN regexp_matches(prev, '[A-Za-z]-$') THEN 'hyphen'
 WHEN regexp_matches(prev, '[{fixed.END_PUNC}]$') OR regexp_matches(line, {_HEAD_SQL}) THEN 'break' WHEN regexp_matches(prev, '[一-鿿]$') AND regexp_matches(ltrim(line, ' ' || chr(9)), '^[一-鿿]') THEN 'none' ELSE 'space' END how FROM n),
i AS (SELECT *, sum(CASE WHEN how IN ('start', 'break') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) isl,
 CASE WHEN lead(how) OVER (PARTITION BY doc_id ORDER BY line_no) = 'hyphen' THEN substr(line, 1, length(line) - 1) ELSE line END AS body FROM b)
SELECT doc_id, md5(string_agg(t, chr(10) ORDER BY isl)) AS text_md5, count(*) AS n_lines FROM (SELECT doc_id, isl, string_agg(CASE how WHEN 'space' THEN ' ' || ltrim(body, ' ' || chr(9)) WHEN 'none' THEN ltrim(body, ' ' || chr(9)) WHEN 'hyphen' THEN ltrim(body, ' ' || chr(9)) ELSE body END, '' ORDER BY line_no) t FROM i GROUP BY doc_id, isl) GROUP BY doc_id""")
def line_soft_wrap_merge(spark, d):
    docs = table(spark, d, "documents").where(F.length("text") > 0).select("doc_id", F.array_join(text.lines("text"), "\n").alias("text"))
    t = docs.select("doc_id", text.joined_soft_wraps(text.replaced("text", [(r"[ \t]+\z", "")])).alias("text"))
    return t.select("doc_id", F.md5("text").alias("text_md5"), F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"))


@query(f"""WITH {_LINES}, r AS (SELECT doc_id, line_no, trim(line, {_WSQ}) AS line FROM l), n AS (SELECT *, lag(line) OVER w AS prev FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
b AS (SELECT *, CASE WHEN prev IS NULL OR prev = '' OR line = '' OR regexp_matches(prev, '{fixed.SENTENCE_END}[{fixed.CLOSERS}]*$') OR regexp_matches(line, {_q(fixed.SECTION_HEAD)}) THEN 1 ELSE 0 END brk FROM n),
i AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY line_no) isl FROM b)
SELECT doc_id, md5(string_agg(t, chr(10) ORDER BY isl)) AS text_md5, count(*) AS n_lines FROM (SELECT doc_id, isl, string_agg(line, ' ' ORDER BY line_no) t FROM i GROUP BY doc_id, isl) GROUP BY doc_id""")
def broken_line_merge(spark, d):
    t = table(spark, d, "documents").where(F.length("text") > 0).select("doc_id", text.joined_broken_lines("text").alias("text"))
    return t.select("doc_id", F.md5("text").alias("text_md5"), F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"))


@query()
def line_hard_wrap_merge(spark, d):
    t = table(spark, d, "documents").where(F.length("text") > 0).select("doc_id", text.joined_hard_wraps(F.array_join(text.lines("text"), "\n")).alias("text"))
    return t.select("doc_id", F.md5("text").alias("text_md5"), F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"))


@query(f"""WITH {_LINES}, n AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) prev FROM l)
SELECT doc_id, count(*) AS n_kept, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM n WHERE prev IS NULL OR line = '' OR line <> prev OR regexp_matches(line, {_q('|'.join(fixed.KEEP_WORDS))}) GROUP BY doc_id""")
def line_adjacent_dedupe(spark, d):
    counted = lambda ls: F.struct(F.size(ls).cast("long").alias("n_kept"), F.aggregate(ls, F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("n_chars"))
    kept = F.array(text.let(text.let(text.lines("text"), lambda ls: text.adjacent_once(ls)), counted))
    return table(spark, d, "documents").where(F.length("text") > 0).select("doc_id", F.inline(kept))


@query(f"""WITH {_LINES}, b AS (SELECT *, trim(line, {_WSQ}) = '' AS blank FROM l), g AS (SELECT *, sum(CASE WHEN blank THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) isl FROM b),
k AS (SELECT *, CASE WHEN blank THEN row_number() OVER (PARTITION BY doc_id, isl, blank ORDER BY line_no) ELSE 0 END rn FROM g)
SELECT doc_id, count(*) AS n_lines FROM k WHERE rn <= 1 GROUP BY doc_id""")
def line_blank_collapse(spark, d):
    t = table(spark, d, "documents").where(F.length("text") > 0).select("doc_id", text.collapsed_blanks(F.array_join(text.lines("text"), "\n")).alias("text"))
    return t.select("doc_id", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"))


@query(f"""WITH {_ZH}, t AS (SELECT *, length(trim(line)) BETWEEN 1 AND 2 AS thin FROM z), c AS (SELECT *, CASE WHEN thin = lag(thin) OVER (PARTITION BY doc_id ORDER BY line_no) THEN 0 ELSE 1 END ch FROM t),
i AS (SELECT *, sum(ch) OVER (PARTITION BY doc_id ORDER BY line_no) isl FROM c), n AS (SELECT *, thin AND count(*) OVER (PARTITION BY doc_id, isl) >= 6 AS m FROM i)
SELECT doc_id, line_no, line FROM n WHERE NOT m UNION ALL SELECT doc_id, min(line_no), string_agg(trim(line), '' ORDER BY line_no) FROM n WHERE m GROUP BY doc_id, isl HAVING string_agg(trim(line), '' ORDER BY line_no) NOT IN ('裝訂線', '撕裂線', '裝訂處')""")
def line_vertical_runs(spark, d):
    return lines.merge_vertical_runs(frame(spark, "zh_lines"))


# --- characters -------------------------------------------------------------------------------


@query(f"SELECT doc_id, CAST(length(text) - length(translate(text, {_q(fixed.BINDING_CHARS)}, '')) AS BIGINT) AS n_removed, CAST(length(text) - length(translate(text, 'aeiou', '')) AS BIGINT) AS n_vowels FROM documents")
def char_blacklist_count(spark, d):
    return table(spark, d, "documents").select("doc_id", text.n_removed("text", fixed.BINDING_CHARS).cast("long").alias("n_removed"), text.n_removed("text", "aeiou").cast("long").alias("n_vowels"))


@query(f"SELECT doc_id, md5({rules_sql('text', fixed.COLLAPSE_RUNS)}) AS text_md5 FROM documents WHERE text IS NOT NULL")
def inline_noise_collapse(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(text.replaced("text", fixed.COLLAPSE_RUNS)).alias("text_md5"))


@query()
def inline_noise_single_pass(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.without_inline_noise("text", tuple(fixed.INLINE_NOISE_NARROW), 1)).alias("text_md5"), F.md5(text.without_inline_noise("text")).alias("passes_md5"))


@query(f"SELECT doc_id, md5({rules_sql('text', [(a.replace('(?m)', '(?m)'), b) for a, b in fixed.PUNCTUATION])}) AS text_md5 FROM documents WHERE text IS NOT NULL")
def punct_normalise(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(text.punctuated("text")).alias("text_md5"))


@query(f"WITH {_LINES} SELECT doc_id, line_no, {rules_sql(rules_sql(rules_sql('line', fixed.COLONS), fixed.DOT_LADDERS), fixed.DOT_NOISE)} AS line FROM l")
def dot_colon_normalise(spark, d):
    return _lines(spark, d).select("doc_id", "line_no", text.replaced(text.replaced(text.replaced("line", fixed.COLONS), fixed.DOT_LADDERS), fixed.DOT_NOISE).alias("line"))


@query(f"WITH {_LINES} SELECT doc_id, line_no, {rules_sql('line', [(a.replace(chr(92) + '•', '•').replace(chr(92) + '·', '·').replace(chr(92) + '（', '（').replace(chr(92) + '）', '）'), b) for a, b in fixed.BULLETS])} AS line FROM l")
def bullet_normalise(spark, d):
    return _lines(spark, d).select("doc_id", "line_no", text.replaced("line", fixed.BULLETS).alias("line"))


_TOKEN_OK = r"""regexp_full_match(t, '[\x21-\x7E：﹕，、]+') AND regexp_matches(t, '[0-9]') AND regexp_matches(t, '[^,./\\:：﹕，、\s-]')"""


@query(f"""WITH {_LINES}, t AS (SELECT doc_id, line_no, unnest(ts) t, generate_subscripts(ts, 1) i FROM (SELECT doc_id, line_no, string_split(line, ' ') ts FROM l))
SELECT doc_id, line_no, string_agg(CASE WHEN {_TOKEN_OK} THEN translate(t, 'OIlZSB', '011258') ELSE t END, ' ' ORDER BY i) AS line FROM t GROUP BY doc_id, line_no""")
def digit_confusion_fix(spark, d):
    return _lines(spark, d).select("doc_id", "line_no", text.fixed_digits("line").alias("line"))


@query(f"SELECT doc_id, md5(trim({rules_sql('text', [(r'[\x00-\x08\x0b-\x1f\x7f-\x{9f}\x{ad}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{feff}]', ' '), (r'[ \t\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]+', ' '), (r' *\n *', chr(10))])}, {_WSQ})) AS text_md5 FROM documents WHERE text IS NOT NULL")
def control_scrub(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(text.scrubbed("text")).alias("text_md5"))


def _corrected_sql(c: str) -> str:
    for a, b in [*fixed.CORRECTIONS, ("\r\n", "\n"), ("\r", "\n")]:
        c = f"replace({c}, {_q(a)}, {_q(b)})"
    kept = f"list_filter(list_transform(string_split({c}, chr(10)), lambda x: trim(x, {_WSQ})), lambda x: NOT regexp_matches(x, {_q(fixed.SEPARATOR_LINE)}))"
    return rf"array_to_string(list_transform({kept}, lambda x: regexp_replace(x, '^\(?\d{{1,3}}\)?[\s\x0b\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{3000}}]+', '')), chr(10))"


@query(f"SELECT doc_id, md5({_corrected_sql('text')}) AS text_md5 FROM (SELECT doc_id, replace(text, '主旨', '王旨') AS text FROM {values('zh_letters')} UNION ALL SELECT doc_id, text FROM documents)")
def lexical_correction(spark, d):
    t = frame(spark, "zh_letters").select("doc_id", F.replace("text", F.lit("主旨"), F.lit("王旨")).alias("text"))
    return t.unionByName(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.md5(text.corrected("text")).alias("text_md5"))


@query(f"SELECT doc_id, {rules_sql('text', [(a, b.replace(chr(10), chr(10))) for a, b in fixed.ENUMERATORS])} AS text FROM {values('zh_letters')}")
def enumerator_breaks(spark, d):
    return frame(spark, "zh_letters").select("doc_id", text.with_enumerators("text").alias("text"))


@query()
def nfkc_normalise(spark, d):
    t = frame(spark, "zh_letters").select("doc_id", "text").unionByName(table(spark, d, "documents").select("doc_id", "text"))
    return t.select("doc_id", F.md5(text.visible("text")).alias("text_md5"))


_EN_END = "[.!?]"


@query(rf"""WITH p AS (SELECT doc_id, unnest(ps) p, generate_subscripts(ps, 1) pi FROM (SELECT doc_id, string_split(regexp_replace(text, '[ \t]+', ' ', 'g'), chr(10)) ps FROM documents WHERE text IS NOT NULL)),
s AS (SELECT doc_id, pi, unnest(ss) s, generate_subscripts(ss, 1) si FROM (SELECT doc_id, pi, string_split(regexp_replace(trim(p, {_WSQ}), '([.!?]["'')]*) ', '\1' || chr(1), 'g'), chr(1)) ss FROM p)),
m AS (SELECT doc_id, pi, si, CASE WHEN NOT regexp_matches(trim(s, {_WSQ}), '[.!?]["'')]*$') AND length(trim(s, {_WSQ})) >= 25 THEN trim(s, {_WSQ}) || '.' ELSE trim(s, {_WSQ}) END s FROM s)
SELECT doc_id, count(*) AS n_sentences, md5(string_agg(s, chr(10) ORDER BY pi, si)) AS text_md5 FROM m WHERE trim(regexp_replace(s, '\p{{P}}+', '', 'g'), {_WSQ}) <> '' GROUP BY doc_id""")
def sentence_split(spark, d):
    counted = lambda s: F.struct(F.size(s).cast("long").alias("n_sentences"), F.md5(F.array_join(s, "\n")).alias("text_md5"))
    one = F.array(text.let(text.sentences("text", _EN_END, "\"')", "."), counted))
    # filtered inside the row: a pushed filter would split the text again
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.inline(F.filter(one, lambda x: x["n_sentences"] > 0)))


@query(f"""WITH {_ZH}, d AS (SELECT *, regexp_matches(line, {_q(fixed.SECTION_HEAD)}) OR regexp_matches(line, '[。！？；!?]$') AS done FROM z)
SELECT doc_id, line_no, CASE WHEN done THEN line ELSE line || '。' END AS plain, CASE WHEN done OR regexp_matches(line, '[：）】」』]$') OR regexp_matches(line, '身分證|統一編號') OR regexp_matches(line, '(號|号)$') THEN line ELSE line || '。' END AS careful FROM d""")
def terminal_punct_fix(spark, d):
    return frame(spark, "zh_lines").select("doc_id", "line_no", text.ended(F.col("line"), False).alias("plain"), text.ended(F.col("line")).alias("careful"))


@query(f"SELECT doc_id, md5(regexp_replace(text, 'license[sd]?|copyright', '[MASK]', 'g')) AS text_md5, CAST(len(regexp_extract_all(text, 'license[sd]?|copyright')) AS BIGINT) AS n_terms FROM documents WHERE text IS NOT NULL")
def label_term_mask(spark, d):
    terms = ("license[sd]?", "copyright")
    n = F.size(text.extract_all("text", f"({text.any_of(terms)})", 1)).cast("long")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(text.masked_terms("text", terms)).alias("text_md5"), n.alias("n_terms"))


@query(f"SELECT doc_id, regexp_replace(text, {_q(text.any_of(fixed.LABEL_TERMS))}, '[MASK]', 'g') AS text FROM {values('zh_letters')}")
def label_term_mask_letters(spark, d):
    return frame(spark, "zh_letters").select("doc_id", text.masked_terms("text").alias("text"))


@query("SELECT page_id, replace(replace(replace(CASE WHEN length(s) <= 60 THEN s ELSE substr(s, 1, 60) || '…' END, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS short FROM (SELECT page_id, replace(trim(coalesce(html, ''), chr(10) || ' ' || chr(9) || chr(13)), chr(10), ' ') s FROM pages)")
def html_escape_short(spark, d):
    return table(spark, d, "pages").select("page_id", text.html(text.short("html", 60)).alias("short"))


@query("SELECT doc_id, md5(regexp_replace(text, '(email|phone\\.)', '<mark>\\1</mark>', 'gi')) AS text_md5 FROM documents WHERE text IS NOT NULL")
def highlight_terms(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(text.highlighted("text", ["email", "phone."])).alias("text_md5"))


@query("SELECT doc_id, length(regexp_replace(text, '[，。、「」『』【】（）()\\[\\]\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', '', 'g')) AS n_chars FROM documents WHERE text IS NOT NULL")
def detection_text(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.length(text.detection_text("text")).cast("long").alias("n_chars"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'license') AND contains(lower(text), 'the')")
def keyword_and_search(spark, d):
    return table(spark, d, "documents").where(text.has_all_words("text", "License  the")).select("doc_id")


# --- whole cleaners -------------------------------------------------------------------------


def _cleaner(name):
    def run(spark, d):
        t = frame(spark, "zh_letters").select((-F.col("doc_id")).alias("doc_id"), "text").unionByName(table(spark, d, "documents").select("doc_id", "text"))
        out = t.select("doc_id", clean.EXPRESSIONS[name]("text").alias("text")) if name in clean.EXPRESSIONS else clean.RELATIONS[name](t)
        return out.select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))

    run.__name__ = f"clean_{name}"
    return run


for _name in (*clean.EXPRESSIONS, *clean.RELATIONS):
    query()(_cleaner(_name))


# --- letters ---------------------------------------------------------------------------------

_F = {k: p.replace("(?s)", "(?s)") for k, p in fixed.FIELD_PATTERNS.items()}
_FIELD_SQL = ", ".join(f"trim(regexp_extract(text, {_q(p)}, 1), {_WSQ}) AS {'descr' if k == 'desc' else k}" for k, p in _F.items())


@query(f"""WITH f AS (SELECT doc_id, text, {_FIELD_SQL} FROM {values('zh_letters')}), g AS (SELECT * REPLACE (CASE WHEN basis <> '' THEN basis ELSE trim(regexp_extract(text, {_q(fixed.LAW)}, 1)) END AS basis) FROM f)
SELECT doc_id, subject, descr, basis, agency, case_id, address, officer, phone, fax, CAST(length(text) AS BIGINT) AS raw_text_len, substr(concat_ws(' / ', CASE WHEN subject <> '' THEN '[SUBJECT]' || subject END, CASE WHEN descr <> '' THEN '[DESC]' || descr END,
CASE WHEN basis <> '' THEN '[BASIS]' || basis END, CASE WHEN agency <> '' THEN '[AGENCY]' || agency END, CASE WHEN case_id <> '' THEN '[CASE]' || case_id END), 1, 300) AS built_text FROM g""")
def field_extract_build_text(spark, d):
    f = extract.fields("text")
    t = frame(spark, "zh_letters").select("doc_id", *(c.alias(n) for n, c in f.items()))
    return t.withColumn("built_text", extract.dense_text()).withColumn("raw_text_len", F.col("raw_text_len").cast("long")).withColumnRenamed("desc", "descr")


_ALL_HEADS = "|".join(sorted({a for v in fixed.FIELD_ALIASES.values() for a in v}, key=lambda x: (-len(x), x)))
_SECTION_SQL = rf"""l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) ls FROM {values('zh_letters')} WHERE length(text) > 0)),
h AS (SELECT *, nullif(regexp_extract(line, '^({_ALL_HEADS})\s*:?[^\S\n]*(.*)$', 1), '') field, trim(regexp_extract(line, '^({_ALL_HEADS})\s*:?[^\S\n]*(.*)$', 2)) rest FROM l),
s AS (SELECT *, count(field) OVER (PARTITION BY doc_id ORDER BY line_no) part FROM h),
b AS (SELECT doc_id, part, max(field) field, trim(string_agg(CASE WHEN field IS NULL THEN line ELSE rest END, chr(10) ORDER BY line_no), {_WSQ}) block FROM s WHERE part > 0 GROUP BY doc_id, part),
e AS (SELECT doc_id, field, coalesce(string_agg(block, chr(10) ORDER BY part) FILTER (block <> ''), '') block FROM b GROUP BY doc_id, field)"""


@query(f"WITH {_SECTION_SQL} SELECT doc_id, field, block FROM e")
def sectionise_letters(spark, d):
    return extract.sections(frame(spark, "zh_letters"))


_RANKS = ", ".join(f"('{a}', '{k}', {i})" for k, v in fixed.FIELD_ALIASES.items() for i, a in enumerate(v))


@query(f"WITH {_SECTION_SQL}, a(field, key, rank) AS (VALUES {_RANKS}) SELECT doc_id, key, min_by(block, rank) AS value FROM e JOIN a USING (field) WHERE block <> '' GROUP BY doc_id, key")
def canonical_fields(spark, d):
    return extract.canonical(extract.sections(frame(spark, "zh_letters")))


@query()
def body_fallback(spark, d):
    return extract.bodies(frame(spark, "zh_letters"))


@query(rf"""WITH c AS (SELECT doc_id, unnest(cs) c, generate_subscripts(cs, 1) - 1 AS case_no FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '＝{{3,}}'), lambda x: trim(x, {_WSQ})), lambda x: x <> '') cs FROM {values('cases')})),
p AS (SELECT doc_id, case_no, unnest(ps) b, generate_subscripts(ps, 1) - 1 AS person_no FROM (SELECT *, list_filter(list_transform(regexp_split_to_array(c, '調查人[ㄧ一二三四五]'), lambda x: trim(x, {_WSQ})), lambda x: x <> '') ps FROM c))
SELECT doc_id, case_no, person_no, trim(regexp_extract(b, '姓名：([^\n]*)', 1)) AS name, trim(regexp_extract(b, '身分證字號：([^\n]*)', 1)) AS id_number, trim(regexp_extract(b, '財產基準日：([^\n]*)', 1)) AS as_of FROM p""")
def case_people_parse(spark, d):
    t = extract.case_people(frame(spark, "cases"))
    return t.withColumn("case_no", F.col("case_no").cast("long")).withColumn("person_no", F.col("person_no").cast("long"))


@query()
def role_person_extract(spark, d):
    return extract.role_persons(frame(spark, "zh_letters"))


_ACTION_SQL = ", ".join("CASE " + " ".join(f"WHEN contains(text, '{w}') THEN '{a}:{w}'" for w in ws) + " END" for a, ws in fixed.ACTIONS.items())
_URGENT_RE = "|".join(fixed.URGENT)


@query(f"SELECT doc_id, array_to_string(list_filter([{_ACTION_SQL}], lambda x: x IS NOT NULL), '；') AS actions, regexp_matches(replace(text, '速別', ''), '{_URGENT_RE}') AS is_urgent FROM (SELECT doc_id, coalesce(text, '') AS text FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -doc_id, text FROM {values('zh_letters')}))")
def action_urgency_flags(spark, d):
    t = table(spark, d, "documents").select("doc_id", "text").unionByName(frame(spark, "zh_letters").select((-F.col("doc_id")).alias("doc_id"), "text")).na.fill("", ["text"])
    acts = F.array_join(F.transform(privacy.actions("text"), lambda a: F.concat_ws(":", a["action"], a["trigger"])), "；")
    return t.select("doc_id", acts.alias("actions"), numbers.urgency("text", F.lit(None).cast("int"))["is_urgent"].alias("is_urgent"))


_DATE_SQL = rf"""SELECT row_no, CASE WHEN d1 IS NOT NULL THEN d1 WHEN d2 IS NOT NULL THEN d2 WHEN n IS NOT NULL THEN DATE '2025-08-30' + n WHEN c IS NOT NULL THEN DATE '2025-08-30' + c END AS due,
CASE WHEN d1 IS NOT NULL THEN regexp_extract(text, '{fixed.DATE_SLASH}', 0) WHEN d2 IS NOT NULL THEN regexp_extract(text, '{fixed.DATE_YEARS}', 0) WHEN n IS NOT NULL THEN regexp_extract(text, '{fixed.WITHIN_DAYS}', 0) WHEN c IS NOT NULL THEN regexp_extract(text, '{fixed.WITHIN_NUMERAL}', 0) END AS phrase
FROM (SELECT row_no, text, try_strptime(regexp_replace(regexp_extract(text, '{fixed.DATE_SLASH}', 0), '/', '-', 'g'), '%Y-%m-%d')::DATE d1,
try_strptime((CASE WHEN y < 1911 THEN y + 1911 ELSE y END) || '-' || regexp_extract(text, '{fixed.DATE_YEARS}', 2) || '-' || regexp_extract(text, '{fixed.DATE_YEARS}', 3), '%Y-%m-%d')::DATE d2,
TRY_CAST(regexp_extract(text, '{fixed.WITHIN_DAYS}', 1) AS INT) n, CASE regexp_extract(text, '{fixed.WITHIN_NUMERAL}', 1) WHEN '二十五' THEN 25 WHEN '十' THEN 10 WHEN '三' THEN 3 END c
FROM (SELECT *, TRY_CAST(regexp_extract(text, '{fixed.DATE_YEARS}', 1) AS INT) y FROM {values('dates')}))"""


@query(f"WITH x AS ({_DATE_SQL}) SELECT row_no, CAST(due AS VARCHAR) AS due, phrase, CAST(due - DATE '2025-08-30' AS BIGINT) AS days_left FROM x")
def due_date_cascade(spark, d):
    t = frame(spark, "dates").withColumn("x", numbers.due_date("text", F.to_date(F.lit("2025-08-30"))))
    return t.select("row_no", F.col("x.due").cast("string").alias("due"), F.col("x.phrase").alias("phrase"), F.col("x.days_left").cast("long").alias("days_left"))


def _summaries(spark):
    return extract.summaries(frame(spark, "zh_letters").withColumnRenamed("label", "class"), "2025-08-30")


@query()
def summary_sentence(spark, d):
    return _summaries(spark).select("doc_id", "summary_text", F.col("urgency.is_urgent").alias("is_urgent"), F.col("urgency.reason").alias("reason"))


@query()
def summary_flat(spark, d):
    return extract.flat_summaries(_summaries(spark))


# --- dashboards and briefs ---------------------------------------------------------------------


@query("""SELECT event_id, days_left, CASE WHEN days_left <= 0 THEN 'now' WHEN days_left <= 7 THEN 'soon' ELSE 'later' END AS due_bucket FROM
(SELECT event_id, event_type, value, props, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS days_left FROM events) WHERE event_type = 'purchase' AND days_left <= 7 AND contains(lower(event_type || ' ' || props), 'purchase')""")
def dashboard_filter_sort(spark, d):
    t = table(spark, d, "events").select("event_id", F.col("event_type").alias("class"), F.to_date("ts").cast("string").alias("due_date"), "props", (F.col("value") > 50).alias("is_urgent"))
    t = render.dashboard_filter(render.dashboard_rows(t, "2024-01-01"), "purchase", words="purchase").orderBy(F.desc("is_urgent"), F.asc_nulls_last("days_left"), "event_id")
    return t.select("event_id", F.col("days_left").cast("long").alias("days_left"), "due_bucket")


@query(f"SELECT row_no, coalesce(regexp_replace(regexp_replace(name, '(\\d+)', '00000000000000000000\\1', 'g'), '0+(\\d{{20}})', '\\1', 'g'), '') AS key FROM {values('rank_names')}")
def natural_sort_key(spark, d):
    return frame(spark, "rank_names").select("row_no", render.natural_key("name").alias("key"))


def _briefs(spark):
    t = frame(spark, "briefs")
    return t.select(
        "filename", "category", "insurer", "title", "summary", F.when(F.col("name").isNotNull(), F.array(F.struct("name", "id_number"))).alias("persons"), F.array(F.lit("某人")).alias("person_names"), F.array("id_number").alias("ids"),
        F.array("policy").alias("policy_numbers"), F.when(F.col("action").isNotNull(), F.array("action")).alias("actions"), F.array(F.lit("114年")).alias("date_mentions"), F.lit(None).cast("string").alias("deadline"),
        F.array().cast("array<string>").alias("required_documents"), F.array(F.lit("a"), F.lit("b")).alias("agent_todo"), F.array().cast("array<string>").alias("rationale_points"), F.struct("doc_no").alias("extra"),
    )


_MASK_ID = "CASE WHEN regexp_full_match({0}, '[A-Z][0-9]{{9}}') THEN substr({0}, 1, 4) || '****' || right({0}, 2) ELSE {0} END"
_MASK_POL = "CASE WHEN regexp_full_match({0}, '[A-Za-z0-9]{{8,20}}') THEN substr({0}, 1, 3) || repeat('*', CAST(greatest(length({0}) - 5, 4) AS INT)) || right({0}, 2) ELSE {0} END"


@query(f"""SELECT coalesce(filename, '') AS filename, coalesce(category, '') AS category, coalesce(insurer, '') AS insurer, coalesce(title, '') AS title, CASE WHEN length(s) <= 120 THEN s ELSE substr(s, 1, 120) || '…' END AS summary_short,
coalesce(name, '某人') AS persons, {_MASK_ID.format('id_number')} AS ids, {_MASK_POL.format('policy')} AS policy_numbers, coalesce(action, '') AS actions, '114年' AS date_mentions, '' AS required_documents, 'a、b' AS agent_todo, '' AS rationale_points, '' AS deadline, coalesce(doc_no, '') AS doc_no
FROM (SELECT *, replace(trim(coalesce(summary, '')), chr(10), ' ') s FROM {values('briefs')})""")
def briefs_union_sorted(spark, d):
    return render.flat_briefs(_briefs(spark)).orderBy("category", "filename")


@query()
def brief_cards_html(spark, d):
    return render.brief_cards(_briefs(spark)).orderBy("category", "filename")


@query()
def dashboard_payload(spark, d):
    return extract.flat_summaries(_summaries(spark)).select("doc_id", render.payload().alias("payload"))


@query()
def entity_highlight(spark, d):
    spans = F.transform(anonymise.select_spans(anonymise.find_spans("text")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("tag")))
    return frame(spark, "zh_letters").select("doc_id", "text", spans.alias("spans")).select("doc_id", render.entity_html("text", "spans").alias("html"))


# --- personal data -----------------------------------------------------------------------------


@query(rf"""SELECT doc_id, array_to_string(list_sort(regexp_extract_all(text, '{fixed.ANY_EMAIL}')), ',') AS emails, CAST(len(regexp_extract_all(text, '{fixed.LINE_PHONE}')) AS BIGINT) AS n_phones FROM documents WHERE text IS NOT NULL""")
def pii_email_phone_extract(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(F.array_sort(text.extract_all("text", f"({fixed.ANY_EMAIL})", 1)), ",").alias("emails"), F.size(text.extract_all("text", f"({fixed.LINE_PHONE})", 1)).cast("long").alias("n_phones"))


@query()
def pii_span_select(spark, d):
    t = table(spark, d, "documents").select("doc_id", "text").unionByName(frame(spark, "zh_letters").select((-F.col("doc_id")).alias("doc_id"), "text"))
    return t.select("doc_id", F.explode(anonymise.select_spans(anonymise.find_spans("text"))).alias("s")).select("doc_id", "s.*")


_PROFILE_SQL = rf"""p AS (SELECT row_number() OVER (ORDER BY profile_no) - 1 AS profile_idx, trim(name) AS name, trim(birth_date) AS birth_date, upper(trim(id_number)) AS id_number, trim(address) AS address,
CASE WHEN starts_with(m, '09') AND length(m) >= 10 THEN substr(m, 1, 10) ELSE trim(mobile) END AS mobile, trim(email) AS email FROM (SELECT *, CASE WHEN starts_with(g, '886') AND length(g) >= 11 THEN '0' || substr(g, 4) ELSE g END m
FROM (SELECT *, regexp_replace(mobile, '\D', '', 'g') g FROM {values('profiles')})) WHERE trim(name) || trim(birth_date) || trim(id_number) || trim(address) || trim(mobile) || trim(email) <> '')"""


@query(f"WITH {_PROFILE_SQL} SELECT profile_idx, name, birth_date, id_number, address, mobile, email FROM p")
def profile_dimension(spark, d):
    return anonymise.profile_dimension(frame(spark, "profiles")).select("profile_idx", "profile.*")


@query(f"WITH {_PROFILE_SQL}, c AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) SELECT doc_id, name, email FROM c JOIN p ON profile_idx = i % 4")
def pii_anonymise_round_robin(spark, d):
    p = anonymise.profile_dimension(frame(spark, "profiles"))
    return anonymise.assign_round_robin(table(spark, d, "documents").select("doc_id"), p, "doc_id").select("doc_id", "profile.name", "profile.email")


_HASHED = "CAST('0x' || substr(md5('42:' || doc_id), 1, 15) AS BIGINT)"


@query(f"WITH {_PROFILE_SQL} SELECT doc_id, name, ['a', 'b', 'c'][{_HASHED} % 3 + 1] AS pool_draw FROM documents JOIN p ON profile_idx = {_HASHED} % 4")
def pii_hash_assign(spark, d):
    p = anonymise.profile_dimension(frame(spark, "profiles"))
    t = anonymise.assign_hashed(table(spark, d, "documents").select("doc_id"), p, "doc_id")
    return t.select("doc_id", "profile.name", anonymise.drawn(F.array(*map(F.lit, "abc")), "doc_id").alias("pool_draw"))


@query(rf"""WITH r AS (SELECT conv_id AS doc_id, turn AS line_no, coalesce(text, '') AS line FROM conversations WHERE role = 'user'),
w AS (SELECT doc_id, line_no, line, lead(line, 1) OVER x AS l1, lead(line, 2) OVER x AS l2 FROM r WINDOW x AS (PARTITION BY doc_id ORDER BY line_no)),
c AS (SELECT doc_id, line AS raw FROM w UNION ALL SELECT doc_id, line || l1 FROM w UNION ALL SELECT doc_id, line || l1 || l2 FROM w UNION ALL SELECT doc_id, string_agg(line, '' ORDER BY line_no) FROM r GROUP BY doc_id),
n AS (SELECT DISTINCT doc_id, regexp_replace(raw, '[，。、「」『』【】（）()\[\]\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}\x{{2028}}\x{{2029}}\x{{3000}}]+', '', 'g') AS candidate FROM c WHERE raw IS NOT NULL)
SELECT doc_id, count(*) AS n_candidates, CAST(max(length(candidate)) AS BIGINT) AS longest FROM n WHERE candidate <> '' GROUP BY doc_id""")
def pii_window_candidates(spark, d):
    r = table(spark, d, "conversations").where("role = 'user'").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("line_no"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")).alias("line"))
    return lines.adjacent_windows(r).groupBy("doc_id").agg(F.count("*").alias("n_candidates"), F.max(F.length("candidate")).cast("long").alias("longest"))


def _transcripts(spark):
    return extract.segments(frame(spark, "zh_transcript"))


@query()
def pii_found_in_transcripts(spark, d):
    s = _transcripts(spark).where("speaker = 'R'").select(F.col("conv_id").alias("doc_id"), F.col("seg_no").alias("line_no"), text.utrim("content").alias("line"))
    docs = frame(spark, "zh_transcript").select(F.col("conv_id").alias("doc_id"), "text")
    profiles = anonymise.assign_hashed(docs.select("doc_id"), anonymise.profile_dimension(frame(spark, "profiles")), "doc_id").select("doc_id", "profile")
    return anonymise.anonymise_found(docs, s, profiles)


@query()
def pii_segment_rewrite(spark, d):
    ids = frame(spark, "zh_transcript").select("conv_id")
    profiles = anonymise.assign_round_robin(ids, anonymise.profile_dimension(frame(spark, "profiles")), "conv_id").select("conv_id", "profile")
    return anonymise.anonymise_segments(_transcripts(spark), profiles)


@query("""SELECT conv_id, turn, CAST(coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, n AS n_compact FROM
(SELECT conv_id, turn, CAST(length(regexp_replace(coalesce(text, ''), '[\\s\\x0b\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]', '', 'g')) AS BIGINT) n FROM conversations)""")
def segment_offset_map(spark, d):
    t = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("seg_no"), F.coalesce("text", F.lit("")).alias("content"))
    return extract.compact_offsets(t).select("conv_id", F.col("seg_no").alias("turn"), F.col("start").cast("long").alias("start"), F.col("n_compact").cast("long").alias("n_compact"))


@query(rf"""WITH l AS (SELECT conv_id AS doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM (SELECT conv_id, string_split(text, chr(10)) ls FROM {values('zh_transcript')})),
t AS (SELECT *, regexp_full_match(line, '[RLrl]\s*[:：]\s*\d[\d\s\-]*') AND length(regexp_replace(regexp_replace(line, '^[RLrl]\s*[:：]\s*', ''), '[\s\-]', '', 'g')) BETWEEN 2 AND 6 AS tag FROM l),
f AS (SELECT *, tag AND NOT coalesce(lag(tag) OVER (PARTITION BY doc_id ORDER BY line_no), false) AS first FROM t)
SELECT doc_id, line_no, CASE WHEN tag THEN regexp_extract(line, '^([RLrl]\s*[:：]\s*)', 1) || '0900000000' ELSE line END AS line FROM f WHERE (NOT tag OR first) AND trim(line) <> ''""")
def phone_fragment_islands(spark, d):
    t = lines.explode_lines(frame(spark, "zh_transcript"), "conv_id").withColumn("line", privacy.phone_fragment("line"))
    return lines.resolve_phone_fragments(t, F.lit("0900000000"))


@query()
def line_pii_pipeline(spark, d):
    profile = F.struct(*(F.lit(v).alias(k) for k, v in zip(fixed.PROFILE_FIELDS, ("NAME", "1990-01-01", "A000000000", "ADDR", "0900000000", "x@example.org"), strict=True)))
    t = _lines(spark, d).withColumn("profile", profile)
    t = t.withColumn("line", privacy.phone_fragment(privacy.without_line_pii("line"))).select("doc_id", "line_no", "line")
    return lines.implode_lines(lines.resolve_phone_fragments(t, F.lit("0900000000"))).select("doc_id", F.md5("text").alias("text_md5"))


@query(f"""SELECT row_no, {_MASK_ID.format('id_number')} AS id_masked, {_MASK_POL.format('policy')} AS policy_masked, CASE WHEN length(name) = 1 THEN '○' WHEN length(name) = 2 THEN substr(name, 1, 1) || '○' ELSE substr(name, 1, 1) || repeat('○', CAST(length(name) - 2 AS INT)) || right(name, 1) END AS name_redacted,
substr(id_number, 1, 2) || '******' || right(id_number, 2) AS id_redacted FROM {values('people_ids')}""")
def mask_ids_policies(spark, d):
    return frame(spark, "people_ids").select("row_no", privacy.masked_id("id_number").alias("id_masked"), privacy.masked_policy("policy").alias("policy_masked"), privacy.redacted_name("name").alias("name_redacted"), privacy.redacted_id("id_number").alias("id_redacted"))


@query(f"SELECT o_orderkey, {_MASK_POL.format('k')} AS masked FROM (SELECT o_orderkey, 'PN' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS k FROM orders)")
def mask_order_numbers(spark, d):
    return table(spark, d, "orders").select("o_orderkey", privacy.masked_policy(F.concat(F.lit("PN"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"))).alias("masked"))


@query(f"""SELECT id, regexp_full_match(id, '[A-Z][12]\\d{{8}}') AND coalesce((((n // 10) + (n % 10) * 9 + {" + ".join(f"TRY_CAST(substr(id, {i + 2}, 1) AS INT) * {w}" for i, w in enumerate((8, 7, 6, 5, 4, 3, 2, 1, 1)))}) % 10) = 0, false) AS valid
FROM (SELECT id, instr('{fixed.ID_LETTERS}', substr(id, 1, 1)) + 9 AS n FROM {values('twids')})""")
def twid_checksum(spark, d):
    return frame(spark, "twids").select("id", privacy.valid_id("id").alias("valid"))


_LIKE = "".join(rf"WHEN regexp_matches(original, '^\d{{2,3}}[{s}]\d{{1,2}}[{s}]\d{{1,2}}$') THEN printf('%d{s}%d{s}%d', y - 1911, m, d) WHEN regexp_matches(original, '^\d{{4}}[{s}]\d{{1,2}}[{s}]\d{{1,2}}$') THEN printf('%d{s}%02d{s}%02d', y, m, d) " for s in "/-.")
_PADDED = "CASE WHEN length(regexp_extract(original, '(\\d{{1,2}})月(\\d{{1,2}})', {0})) = 2 THEN printf('%02d', {1}) ELSE CAST({1} AS VARCHAR) END".replace("\\\\", "\\")


@query(rf"""WITH n AS (SELECT row_no, original, fake, trim(fake) AS f, regexp_extract_all(fake, '\d+') AS n FROM {values('births')}),
p AS (SELECT *, CASE WHEN regexp_matches(f, '^\d{{4}}[-/.]\d{{1,2}}[-/.]\d{{1,2}}$') THEN CAST(n[1] AS INT) WHEN regexp_matches(f, '^(民國\d{{2,3}}年\d{{1,2}}月\d{{1,2}}日|\d{{2,3}}[-/.]\d{{1,2}}[-/.]\d{{1,2}})$') THEN CAST(n[1] AS INT) + 1911 END AS y, CAST(n[2] AS INT) AS m, CAST(n[3] AS INT) AS d FROM n),
t AS (SELECT *, (y - 1911) || '年' || {_PADDED.format(1, 'm')} || '月' || {_PADDED.format(2, 'd')} AS said FROM p)
SELECT row_no, CASE WHEN contains(original, '民國') AND contains(original, '年') AND contains(original, '月') THEN printf('民國%d年%d月%d日', y - 1911, m, d) {_LIKE} WHEN contains(original, '年') AND contains(original, '月') AND contains(original, '日') THEN printf('%d年%d月%d日', y, m, d) ELSE fake END AS out,
CASE WHEN regexp_matches(original, '^民國\d{{2,3}}年') THEN '民國' || said WHEN regexp_matches(original, '^\d{{2,3}}年') THEN said WHEN regexp_matches(original, '^\d{{6,7}}$') THEN printf('%02d%02d%02d', y - 1911, m, d) ELSE original END AS spoken FROM t""")
def birth_date_formats(spark, d):
    return frame(spark, "births").select("row_no", privacy.birth_like("original", F.col("fake")).alias("out"), privacy.spoken_birth_like("original", F.col("fake")).alias("spoken"))


# --- transcripts and replies ---------------------------------------------------------------------


@query(f"""SELECT conv_id, coalesce(string_agg(s, chr(10) ORDER BY turn) FILTER (role = 'assistant'), '') AS text_l, coalesce(string_agg(s, chr(10) ORDER BY turn) FILTER (role = 'user'), '') AS text_r
FROM (SELECT conv_id, turn, role, trim(coalesce(text, ''), {_WSQ}) s FROM conversations) WHERE s <> '' GROUP BY conv_id""")
def speaker_grouping(spark, d):
    return extract.by_speaker(table(spark, d, "conversations"), {"assistant": "l", "user": "r"})


@query()
def call_json_flatten(spark, d):
    t = models.parsed_replies(frame(spark, "call_json"))
    return t.where("error is null").select("id", F.array_join(calls.report_lines("call"), "\n").alias("report"))


_REPLIES = f"""r AS (SELECT id, contains(reply, '{fixed.HUMAN_TAG}') AND contains(reply, '{fixed.JSON_TAG}') AS tagged, reply FROM {values('call_json')}),
c AS (SELECT id, CASE WHEN tagged THEN trim(split_part(split_part(reply, '{fixed.HUMAN_TAG}', 2), '{fixed.JSON_TAG}', 1), chr(10) || ' ') END AS human,
 regexp_extract(CASE WHEN tagged THEN split_part(reply, '{fixed.JSON_TAG}', 2) ELSE reply END, '(?s)\\{{.*\\}}', 0) AS body FROM r),
e AS (SELECT id, human, CASE WHEN body = '' THEN '找不到 JSON 物件' WHEN NOT json_valid(body) THEN 'JSON 解析失敗' END AS error FROM c)"""


@query(f"WITH {_REPLIES} SELECT id, human, error FROM e")
def llm_block_parse(spark, d):
    return models.parsed_replies(frame(spark, "call_json")).select("id", "human", "error")


@query(f"WITH {_REPLIES} SELECT count(*) AS total, count(*) FILTER (error IS NULL) AS ok, count(*) FILTER (error IS NOT NULL) AS failed FROM e")
def status_rollup(spark, d):
    return writers.outcome(models.parsed_replies(frame(spark, "call_json")))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (props IS NOT NULL AND json_valid(props)) AS n_valid FROM events GROUP BY event_type")
def event_props_valid(spark, d):
    ok = F.col("props").isNotNull() & F.get_json_object("props", "$").isNotNull()
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(ok).alias("n_valid"))


@query("SELECT doc_id, md5('System rules' || chr(10) || chr(10) || '=== Transcript ===' || chr(10) || coalesce(text, '')) AS prompt_md5 FROM documents")
def prompt_assembly(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(models.prompt("System rules", "text")).alias("prompt_md5"))


@query(f"SELECT row_no, concat_ws(chr(10), nullif(case_no, ''), nullif(year_no, '')) AS receipt_no FROM {values('ids')}")
def two_line_receipt_no(spark, d):
    return frame(spark, "ids").select("row_no", F.concat_ws("\n", F.nullif("case_no", F.lit("")), F.nullif("year_no", F.lit(""))).alias("receipt_no"))


@query(f"SELECT coalesce(text, '') AS text, coalesce(label, '') AS label FROM {values('zh_letters')}")
def rename_reorder(spark, d):
    return frame(spark, "zh_letters").select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("label", F.lit("")).alias("label"))


@query(f"""WITH n AS (SELECT row_no, list_transform(regexp_extract_all(box, '-?\\d+(?:\\.\\d+)?'), lambda x: CAST(round_even(CAST(x AS DOUBLE), 0) AS INT)) ns FROM {values('ids')}),
b AS (SELECT row_no, ns, unnest(range(0, len(ns) // 4)) AS i FROM n)
SELECT row_no, i AS box_no, least(ns[4 * i + 1], ns[4 * i + 3]) AS x1, least(ns[4 * i + 2], ns[4 * i + 4]) AS y1, greatest(ns[4 * i + 1], ns[4 * i + 3]) AS x2, greatest(ns[4 * i + 2], ns[4 * i + 4]) AS y2 FROM b""")
def position_boxes(spark, d):
    return readers.boxes(frame(spark, "ids"), "box", "row_no").withColumn("box_no", F.col("box_no").cast("long"))


# --- sampling, ids, sets ----------------------------------------------------------------------------


@query("""WITH n AS (SELECT lang AS label, count(*) n, CAST(round(count(*) * 0.3) AS BIGINT) h FROM documents WHERE lang IS NOT NULL GROUP BY lang)
SELECT label, 'train' AS split, n - h AS n FROM n WHERE n > h UNION ALL SELECT label, 'valid', h // 2 FROM n WHERE h // 2 > 0 UNION ALL SELECT label, 'test', h - h // 2 FROM n WHERE h - h // 2 > 0""")
def stratified_split(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.col("lang").alias("label"))
    return sampling.stratified_split(t).groupBy("label", "split").agg(F.count("*").alias("n"))


@query("""SELECT source, count(*) AS n, greatest(0, least(count(*), CASE WHEN source = 'nowhere' THEN 5 ELSE greatest(1, CAST(round_even(count(*) * 0.1, 0) AS BIGINT)) END)) AS picked FROM documents WHERE source IS NOT NULL GROUP BY source""")
def per_category_sample(spark, d):
    t = sampling.per_category_sample(table(spark, d, "documents").where("source is not null").select("doc_id", "source"), "source", "doc_id", {"nowhere": 5}, ratio=0.1)
    return t.groupBy("source").agg(F.count("*").alias("n"), F.count_if("picked").alias("picked"))


@query("SELECT p_partkey, 'B' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS seq_id FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) n FROM part WHERE trim(coalesce(p_name, '')) <> '')")
def sequential_ids(spark, d):
    return sampling.sequential_ids(table(spark, d, "part").where("trim(coalesce(p_name, '')) <> ''").select("p_partkey"), "p_partkey").select("p_partkey", "seq_id")


@query("SELECT doc_id, source || '/' || lang || CASE WHEN n > 0 THEN '_' || n ELSE '' END || '.txt' AS target FROM (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL)")
def collision_suffixes(spark, d):
    t = table(spark, d, "documents").where("source is not null and lang is not null").select("doc_id", "source", F.concat("lang", F.lit(".txt")).alias("name"))
    return sampling.placement(t, "source", "name", "doc_id").select("doc_id", "target")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def incremental_anti(spark, d):
    return writers.not_yet_written(table(spark, d, "documents"), table(spark, d, "labels")).select("doc_id")


@query("SELECT k FROM (SELECT lang AS k FROM documents UNION SELECT source FROM documents UNION SELECT regexp_extract(url, '^https?://([^/]+)', 1) FROM pages)")
def key_set_union_distinct(spark, d):
    docs = table(spark, d, "documents")
    hosts = table(spark, d, "pages").select(text.extract("url", "^https?://([^/]+)", 1).alias("k"))
    return docs.select(F.col("lang").alias("k")).union(docs.select("source")).union(hosts).distinct()


@query("SELECT d.doc_id, l.quality, l.toxic FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL AND d.text IS NOT NULL")
def nonnull_required_rows(spark, d):
    labels = evaluate.require_columns(table(spark, d, "labels"), ["doc_id", "quality", "toxic"])
    return labels.join(table(spark, d, "documents").select("doc_id", "text"), "doc_id").dropna(subset=["quality", "text"]).select("doc_id", "quality", "toxic")


