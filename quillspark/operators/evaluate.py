"""Alignment of predictions with gold labels, scores, confusion and run-to-run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers, text
from .ranking import numbered

MISSING = "<missing>"


def require_columns(df: DataFrame, names: list[str], loose: bool = True) -> DataFrame:
    """df with the columns renamed to ``names`` where only case or outer spaces differ; an error if one is missing."""
    have = {(c.strip().lower() if loose else c): c for c in df.columns}
    gone = [n for n in names if (n.lower() if loose else n) not in have]
    if gone:
        raise ValueError(f"missing columns: {', '.join(gone)}; found: {', '.join(df.columns)}")
    for n in names:
        df = df.withColumnRenamed(have[n.lower() if loose else n], n)
    return df


def aligned(gold: DataFrame, pred: DataFrame, key: str = "text", order: str = "row_id") -> DataFrame:
    """(key, occurrence, label_true, label_pred): the i-th row of a key in one table meets the i-th in
    the other.  Occurrences are numbered shard by shard, so one hot key does not fill one task."""
    g = numbered(gold.select(key, order, "label"), order, [key], "occurrence")
    p = numbered(pred.select(key, order, "label"), order, [key], "occurrence")
    return g.select(key, "occurrence", F.col("label").alias("label_true")).join(p.select(key, "occurrence", F.col("label").alias("label_pred")), [key, "occurrence"])


def accuracy(df: DataFrame, true: str = "label_true", pred: str = "label_pred") -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.round(F.avg((F.col(true) == F.col(pred)).cast("double")), 6).alias("accuracy"))


def errors_by_label(df: DataFrame) -> DataFrame:
    return df.where("not (label_true <=> label_pred)").groupBy("label_true").agg(F.count("*").alias("errors"))


def confusion(df: DataFrame, true_only: bool = False) -> DataFrame:
    """(label_true, label_pred, n) over all pairs of labels, zeros included; true_only leaves out
    predictions that are no true label."""
    counts = df.groupBy("label_true", "label_pred").agg(F.count("*").alias("n"))
    labels = counts.select(F.col("label_true").alias("label"))
    labels = (labels if true_only else labels.union(counts.select("label_pred"))).distinct()
    # labels x labels: the matrix itself
    cells = labels.select(F.col("label").alias("label_true"), F.lit(1).alias("k")).join(labels.select(F.col("label").alias("label_pred"), F.lit(1).alias("k")), "k").drop("k")
    return cells.join(counts, ["label_true", "label_pred"], "left").na.fill(0, ["n"])


def confusion_matrix(df: DataFrame, labels: list) -> DataFrame:
    """The matrix with a column for each label."""
    cells = df.groupBy("label_true").pivot("label_pred", labels).count().na.fill(0)
    return df.sparkSession.createDataFrame([(x,) for x in labels], f"label_true {dict(df.dtypes)['label_true']}").join(cells, "label_true", "left").na.fill(0)


def per_class(df: DataFrame, by: list[str] | None = None, true: str = "y_true", pred: str = "y_pred", weight: str | None = None) -> DataFrame:
    """(by..., label, tp, support, predicted, precision, recall, f1) over true and predicted labels; 0 where undefined."""
    by = by or []
    w = F.col(weight) if weight else F.lit(1)
    counts = df.groupBy(*by, true, pred).agg(F.sum(w).alias("n"))
    hit = F.when(F.col(true) == F.col(pred), F.col("n")).otherwise(0)
    both = counts.select(*by, F.explode(F.array(
        F.struct(F.col(true).alias("label"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"), hit.cast("long").alias("tp")),
        F.struct(F.col(pred).alias("label"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"), F.lit(0).cast("long").alias("tp")),
    )).alias("x"))
    s = both.groupBy(*by, F.col("x.label").alias("label")).agg(F.sum("x.tp").alias("tp"), F.sum("x.t").alias("support"), F.sum("x.p").alias("predicted"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    s = s.withColumn("precision", ratio("tp", "predicted")).withColumn("recall", ratio("tp", "support"))
    return s.withColumn("f1", F.when(F.col("tp") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def averages(scores: DataFrame) -> DataFrame:
    """(average, precision, recall, f1, support): macro over all labels, macro over true ones, weighted."""
    w = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support"))
    m = lambda c: F.avg(c)
    t = lambda c: F.avg(F.when(F.col("support") > 0, F.col(c)))
    rows = [F.struct(F.lit(name).alias("average"), *(F.round(f(c), 6).alias(c) for c in ("precision", "recall", "f1")), F.sum("support").alias("support")) for name, f in (("macro", m), ("macro_true", t), ("weighted", w))]
    return scores.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def dual_delta(gold: DataFrame, masked: DataFrame, unmasked: DataFrame) -> DataFrame:
    """(label, n, acc_masked, acc_unmasked, delta) of gold(doc_id, label) and two predictions(doc_id, pred)."""
    j = gold.join(masked.withColumnRenamed("pred", "m"), "doc_id", "left").join(unmasked.withColumnRenamed("pred", "u"), "doc_id", "left")
    ok = lambda c: F.avg((F.coalesce(c, F.lit(MISSING)) == F.col("label")).cast("double"))
    t = j.groupBy("label").agg(F.count("*").alias("n"), ok("m").alias("a"), ok("u").alias("b"))
    return t.select("label", "n", F.round("a", 6).alias("acc_masked"), F.round("b", 6).alias("acc_unmasked"), F.round(F.col("b") - F.col("a"), 6).alias("delta"))


def field_accuracy(answers: DataFrame, preds: DataFrame, fields: list[str]) -> DataFrame:
    """(key, field, wrong) counted from the answers' side; keys and fields that are missing are wrong unless empty."""
    p = preds.select(F.trim("key").alias("key"), *(F.col(f).alias(f"p_{f}") for f in fields))
    j = answers.select(F.trim("key").alias("key"), *fields).join(p, "key", "left")
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), (text.collapse_key(f) != text.collapse_key(f"p_{f}")).alias("wrong")) for f in fields))
    return j.select("key", F.explode(pairs).alias("x")).select("key", "x.field", "x.wrong")


def normalised_metrics(df: DataFrame) -> DataFrame:
    """(model, acc, time_str, seconds, family): blank models dropped, the last of repeated models kept."""
    t = df.where(text.utrim(F.coalesce("model", F.lit(""))) != "").groupBy(text.utrim("model").alias("model")).agg(F.max_by(F.struct("acc", "time_str"), "pos").alias("x"))
    return t.select("model", numbers.safe_double("x.acc").alias("acc"), F.col("x.time_str").alias("time_str"), numbers.seconds("x.time_str").alias("seconds"), numbers.model_family("model").alias("family"))


def run_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two normalised runs side by side by model, with differences; missing sides are null."""
    l, r = (t.select("model", F.col("acc").alias(f"acc{i}"), F.col("seconds").alias(f"sec{i}"), F.col("time_str").alias(f"time{i}")) for i, t in ((1, a), (2, b)))
    j = l.join(r, "model", "full_outer")
    gap = F.col("sec2") - F.col("sec1")
    return j.select("model", "acc1", "acc2", F.round(F.col("acc2") - F.col("acc1"), 6).alias("acc_diff"), "sec1", "sec2", F.round(gap, 6).alias("time_diff_sec"), F.round(gap / F.nullif("sec1", F.lit(0.0)) * 100, 6).alias("time_diff_pct"), numbers.duration_text(gap).alias("time_diff"))


def top_errors(df: DataFrame, order: str, n: int = 20, width: int = 80) -> DataFrame:
    """The first n wrong rows, their texts cut."""
    return df.where("label_true <> label_pred").orderBy(order).limit(n).select(order, "label_true", "label_pred", text.short("text", width).alias("text"))


def located(gold: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, label, text): the file of the row's own class, else the first path of that id, else empty."""
    own = files.groupBy("doc_id", "label").agg(F.min_by("text", "path").alias("own"))
    anywhere = files.groupBy("doc_id").agg(F.min_by("text", "path").alias("any"))
    j = gold.join(own, ["doc_id", "label"], "left").join(anywhere, "doc_id", "left")
    return j.select("doc_id", "label", F.coalesce("own", "any", F.lit("")).alias("text"))


def with_last_prediction(gold: DataFrame, preds: DataFrame) -> DataFrame:
    """Gold rows with the last prediction of their id (preds: doc_id, pred, pos), else their own label."""
    last = preds.groupBy("doc_id").agg(F.max_by("pred", "pos").alias("pred"))
    return gold.join(last, "doc_id", "left").withColumn("class", F.coalesce("pred", "label")).drop("pred")

