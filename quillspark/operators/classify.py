"""A calibrated linear classifier over vectors, with rule nudges.

Fitting is Spark ML's; the calibration is one isotonic curve per class and fold, and
scores are the mean over folds, divided by their sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text


def class_weights(df: DataFrame, label: str, most: int = 100_000) -> DataFrame:
    """df with ``weight``: rows / (classes * rows of the class); up to ``most`` classes are broadcast."""
    sizes = df.groupBy(label).agg(F.count("*").alias("__q_n"))
    total = sizes.agg(F.sum("__q_n").alias("n"), F.count("*").alias("k")).first()
    side = F.broadcast(sizes) if total.k <= most else sizes
    return df.join(side, label).withColumn("weight", F.lit(float(total.n or 0)) / (F.col("__q_n") * total.k)).drop("__q_n")


class LinearClassifier:
    """Multinomial logistic regression with balanced weights; isotonic calibration over folds."""

    def __init__(self, max_iter: int = 1000, c: float = 1.0, folds: int = 3, seed: int = 42):
        self.max_iter, self.c, self.folds, self.seed = max_iter, c, folds, seed
        self.models: list = []
        self.labels: list[str] = []

    def _vectors(self, df: DataFrame, vector: str) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        return df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))

    def fit(self, df: DataFrame, label: str = "label", vector: str = "embedding", key: str = "vec_id") -> LinearClassifier:
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.functions import vector_to_array
        from pyspark.ml.regression import IsotonicRegression

        df = df.dropna(subset=[label, vector]).withColumn(label, F.col(label).cast("string"))
        self.labels = sorted(r[0] for r in df.select(label).distinct().collect())
        number = F.array_position(F.array(*map(F.lit, self.labels)), F.col(label)) - 1
        rows = self._vectors(class_weights(df, label), vector).withColumn("y", number.cast("double")).withColumn("fold", F.pmod(F.xxhash64(F.lit(self.seed), F.col(key)), F.lit(self.folds)))
        rows = rows.select("features", "y", "weight", "fold").cache()
        n = max(1, rows.count())
        self.models = []
        for k in range(self.folds):
            lr = LogisticRegression(featuresCol="features", labelCol="y", weightCol="weight", maxIter=self.max_iter, regParam=1.0 / (self.c * n), family="multinomial")
            model = lr.fit(rows.where(F.col("fold") != k))
            held = model.transform(rows.where(F.col("fold") == k)).withColumn("p", vector_to_array("probability"))
            curves = []
            for j in range(len(self.labels)):
                one = held.select(F.get("p", F.lit(j)).alias("p"), (F.col("y") == j).cast("double").alias("y"))
                m = IsotonicRegression(featuresCol="p", labelCol="y").fit(self._one(one))
                curves.append((list(map(float, m.boundaries)), list(map(float, m.predictions))))
            self.models.append((model, curves))
        rows.unpersist()
        return self

    @staticmethod
    def _one(df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        return df.withColumn("p", array_to_vector(F.array("p")))

    @staticmethod
    def _curve(p: Column, xs: list[float], ys: list[float]) -> Column:
        """Linear between the boundaries, flat outside."""
        if not xs:
            return p
        points = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in zip(xs, ys, strict=True)))
        lo, hi = F.element_at(F.filter(points, lambda q: q["x"] <= p), -1), F.get(F.filter(points, lambda q: q["x"] > p), F.lit(0))
        return F.when(p < xs[0], F.lit(ys[0])).when(p >= xs[-1], F.lit(ys[-1])).otherwise(lo["y"] + (hi["y"] - lo["y"]) * (p - lo["x"]) / (hi["x"] - lo["x"]))

    def transform(self, df: DataFrame, vector: str = "embedding") -> DataFrame:
        """df with ``probs`` (in the order of ``labels``) and ``pred``."""
        from pyspark.ml.functions import vector_to_array

        columns, t, folds = df.columns, self._vectors(df, vector), []
        for k, (model, curves) in enumerate(self.models):
            t = model.setProbabilityCol(f"__q_p{k}").setRawPredictionCol(f"__q_r{k}").setPredictionCol(f"__q_c{k}").transform(t).withColumn(f"__q_a{k}", vector_to_array(f"__q_p{k}"))
            folds.append([self._curve(F.get(f"__q_a{k}", F.lit(j)), *curves[j]) for j in range(len(self.labels))])
        raw = F.array(*(sum(f[j] for f in folds) / len(folds) for j in range(len(self.labels))))
        t = t.withColumn("__q_raw", raw).withColumn("__q_sum", F.aggregate("__q_raw", F.lit(0.0), lambda a, x: a + x))
        t = t.withColumn("probs", F.transform("__q_raw", lambda x: F.when(F.col("__q_sum") > 0, x / F.col("__q_sum")).otherwise(F.lit(1.0 / max(1, len(self.labels))))))
        return t.select(*columns, "probs", argmax_label("probs", self.labels).alias("pred"))

    def save(self, path: str, spark) -> None:
        """The folds' models, their curves and the labels, below ``path``."""
        for k, (model, curves) in enumerate(self.models):
            model.write().overwrite().save(f"{path}/fold{k}")
            spark.createDataFrame([(j, x, y) for j, (x, y) in enumerate(curves)], "label int, x array<double>, y array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/curves{k}")
        spark.createDataFrame([(self.labels, len(self.models))], "labels array<string>, folds int").coalesce(1).write.mode("overwrite").json(f"{path}/labels")

    @classmethod
    def load(cls, path: str, spark) -> LinearClassifier:
        from pyspark.ml.classification import LogisticRegressionModel

        out = cls()
        out.labels, out.folds = spark.read.schema("labels array<string>, folds int").json(f"{path}/labels").first()
        for k in range(out.folds):
            curves = [(r.x, r.y) for r in spark.read.parquet(f"{path}/curves{k}").orderBy("label").collect()]
            out.models.append((LogisticRegressionModel.load(f"{path}/fold{k}"), curves))
        return out


def argmax_label(scores: str, labels: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, labels)), F.array_position(scores, F.array_max(scores)).cast("int") - 1)


def nudged(probs: str, text_col: str, labels: list[str], rules=None) -> Column:
    """Log-probabilities plus each label's delta where one of its patterns occurs in the text."""
    rules = rules if rules is not None else fixed.NUDGES
    deltas = F.array(*(F.when(text.contains_any(F.coalesce(text_col, F.lit("")), rules[x][0]), rules[x][1]).otherwise(0.0) if x in rules else F.lit(0.0) for x in labels))
    logs = F.transform(probs, lambda p: F.ln(F.least(F.greatest(p, F.lit(1e-9)), F.lit(1.0))))
    return F.zip_with(logs, deltas, lambda a, b: a + b)
