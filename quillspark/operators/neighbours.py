"""Exact top-k neighbours of a stated query set, votes and decisions.

Queries go out in passes of bounded bytes, each pass one scan of the index; every task
multiplies blocks of its rows with blocks of the pass and keeps k rows for each query, so what
is shuffled is k rows a query and task.  No pair of rows is ever materialised.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_NEAR = pa.schema([("q", pa.int64()), ("nb", pa.int64()), ("label", pa.int32()), ("sim", pa.float64())])


_QUERIES, _ROWS = 4096, 1024  # a product holds 32 MB


def _vectors(column) -> np.ndarray:
    """Rows of one length as a matrix, from the values' buffer."""
    if pc.count_distinct(column.value_lengths()).as_py() > 1:
        raise ValueError("vectors differ in length")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def _closest(best: list[np.ndarray], ids, vectors, nb, labels, rows, k: int) -> list[np.ndarray]:
    """(query, row, label, similarity) of the k best so far for each query, with these rows seen too."""
    sims = vectors @ rows.T
    sims[(ids[:, None] == nb[None, :]) | ~np.isfinite(sims)] = -np.inf
    m = min(k, len(nb))
    # rows that tie with the k-th stay until the merge decides by id
    cut = -np.partition(-sims, m - 1, axis=1)[:, m - 1]
    q, j = np.nonzero((sims >= cut[:, None]) & np.isfinite(sims))
    best = [np.concatenate(x) for x in zip(best, (ids[q], nb[j], labels[j], sims[q, j]), strict=True)]
    order = np.lexsort((best[1], -best[3], best[0]))
    best = [x[order] for x in best]
    keep = np.arange(len(best[0])) - np.searchsorted(best[0], best[0]) < k
    return [x[keep] for x in best]


def _pass(ids: np.ndarray, vectors: np.ndarray, k: int):
    def run(batches):
        starts = range(0, len(ids), _QUERIES)
        best = [[np.empty(0, t) for t in (np.int64, np.int64, np.int32, np.float64)] for _ in starts]
        for b in batches:
            if not b.num_rows:
                continue
            nb, labels, rows = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), _vectors(b.column(2))
            for at in range(0, len(nb), _ROWS):
                part = slice(at, at + _ROWS)
                for i, start in enumerate(starts):
                    asked = slice(start, start + _QUERIES)
                    best[i] = _closest(best[i], ids[asked], vectors[asked], nb[part], labels[part], rows[part], k)
        for found in best:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], schema=_NEAR)

    return run


def top_k(queries: DataFrame, index: DataFrame, k: int = 5, pass_bytes: int = 64 << 20) -> DataFrame:
    """(q, nb, label, sim, rank): the k index rows of greatest inner product, other than the query
    itself, for queries and index rows (vec_id, label, embedding).  Ties go to the smaller id.  The
    driver holds about ``pass_bytes`` of query vectors at a time; the index is read once a pass."""
    rows = index.where("embedding is not null").select(F.col("vec_id").cast("long"), F.coalesce(F.col("label").cast("int"), F.lit(-1)), F.col("embedding").cast("array<double>"))
    wanted = queries.where("embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    passes = max(1, -(-(wanted.agg(F.sum(F.size("embedding") * F.lit(8).cast("long"))).first()[0] or 0) // pass_bytes))
    parts = []
    for i in range(passes):  # a pass holds about ``pass_bytes``, whatever the table's size
        held = wanted.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == i).toArrow()
        if held.num_rows:
            ids, vectors = held["vec_id"].to_numpy(), _vectors(held["embedding"].combine_chunks())
            parts.append(rows.mapInArrow(_pass(ids, vectors, k), "q long, nb long, label int, sim double"))
    if not parts:
        return index.sparkSession.createDataFrame([], "q long, nb long, label int, sim double, rank int")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "nb"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def votes(near: DataFrame, prior: DataFrame | None = None, bonus: DataFrame | None = None) -> DataFrame:
    """(q, label, votes, max_sim); prior(label, weight) scales votes, bonus(q, label, delta) adds to
    them, with a max_sim of -1e9 for labels that no neighbour has."""
    v = near.groupBy("q", "label").agg(F.sum("sim").alias("votes"), F.max("sim").alias("max_sim"))
    if prior is not None:
        v = v.join(prior, "label", "left").withColumn("votes", F.col("votes") * F.coalesce("weight", F.lit(1.0))).drop("weight")
    if bonus is not None:
        more = bonus.select("q", "label", F.col("delta").alias("votes"), F.lit(-1e9).alias("max_sim"))
        v = v.select("q", "label", "votes", "max_sim").unionByName(more).groupBy("q", "label").agg(F.sum("votes").alias("votes"), F.max("max_sim").alias("max_sim"))
    return v


def features(v: DataFrame, temperature: float = 0.7) -> DataFrame:
    """(q, top1, max_sim, margin, p1): the label of most votes, its lead and its softmax share."""
    order = Window.partitionBy("q").orderBy(F.desc("votes"), "label")
    scaled = F.col("votes") / F.lit(max(temperature, 1e-6))
    t = v.withColumn("s", scaled).withColumn("e", F.exp(F.col("s") - F.max("s").over(Window.partitionBy("q"))))
    t = t.withColumn("p1", F.col("e") / (F.sum("e").over(Window.partitionBy("q")) + 1e-12))
    t = t.withColumn("rn", F.row_number().over(order)).withColumn("second", F.lead("votes", 1, 0.0).over(order))
    return t.where("rn = 1").select("q", F.col("label").alias("top1"), "max_sim", (F.col("votes") - F.col("second")).alias("margin"), "p1")


def decided(mode: str = "sim_margin", sim: Column | float = 0.35, margin: Column | float = 0.08, prob: float = 0.3, other=-1) -> Column:
    """The first label, or ``other`` below the thresholds of the mode (sim_margin, prob, mixed)."""
    near = (F.col("max_sim") >= sim) & (F.col("margin") >= margin)
    ok = {"sim_margin": near, "prob": F.col("p1") >= prob, "mixed": near & (F.col("p1") >= prob)}[mode]
    return F.when(ok, F.col("top1")).otherwise(F.lit(other))


def with_thresholds(feats: DataFrame, per_class: DataFrame, sim: float = 0.35, margin: float = 0.08) -> DataFrame:
    """Features with (ts, tm) of their label from per_class(label, sim, margin), else the global ones."""
    t = per_class.select(F.col("label").alias("top1"), F.col("sim").alias("ts"), F.col("margin").alias("tm"))
    return feats.join(t, "top1", "left").withColumn("ts", F.coalesce("ts", F.lit(sim))).withColumn("tm", F.coalesce("tm", F.lit(margin)))


def sweep(feats: DataFrame, sims: list[float], margins: list[float], other=-1) -> DataFrame:
    """(ts, tm, macro_f1, accuracy) of every grid cell for features with y_true, in one aggregation:
    rows are first reduced to counts per (label, first label, cells passed)."""
    passed = feats.select("y_true", "top1", F.size(F.filter(F.array(*map(F.lit, sims)), lambda x: F.col("max_sim") >= x)).alias("i"), F.size(F.filter(F.array(*map(F.lit, margins)), lambda x: F.col("margin") >= x)).alias("j"))
    counts = passed.groupBy("y_true", "top1", "i", "j").agg(F.count("*").alias("n"))
    grid = F.explode(F.array(*(F.struct(F.lit(a).alias("i0"), F.lit(b).alias("j0"), F.lit(s).alias("ts"), F.lit(m).alias("tm")) for a, s in enumerate(sims) for b, m in enumerate(margins))))
    cell = counts.select("y_true", "top1", "n", "i", "j", grid.alias("g"))
    cell = cell.select("g.ts", "g.tm", "y_true", "n", F.when((F.col("i") > F.col("g.i0")) & (F.col("j") > F.col("g.j0")), F.col("top1")).otherwise(F.lit(other)).alias("y_pred"))
    from .evaluate import per_class

    scores = per_class(cell, ["ts", "tm"], weight="n")
    return scores.where("support > 0").groupBy("ts", "tm").agg(F.avg("f1").alias("macro_f1"), (F.sum("tp") / F.sum("support")).alias("accuracy"))


def best_cell(swept: DataFrame) -> DataFrame:
    """The cell of greatest macro F1; ties go to the smaller thresholds."""
    best = F.max_by(F.struct("ts", "tm", "macro_f1", "accuracy"), F.struct(F.round("macro_f1", 12), -F.col("ts"), -F.col("tm"))).alias("b")
    return swept.agg(best).select("b.*")


def tuned_per_class(feats: DataFrame, base_sim: float, base_margin: float, steps: int = 8, span: float = 0.1, rounds: int = 1) -> list[tuple]:
    """[(label, sim, margin)]: thresholds around the middle of each label's 20th and 80th percentile,
    tuned label by label, each seeing those tuned before.  Driver work is the labels' number."""
    feats = feats.select("y_true", "top1", "max_sim", "margin").cache()
    mids = feats.groupBy("top1").agg(F.percentile("max_sim", F.array(F.lit(0.2), F.lit(0.8))).alias("s"), F.percentile("margin", F.array(F.lit(0.2), F.lit(0.8))).alias("m")).orderBy("top1").collect()
    chosen = {r.top1: (base_sim, base_margin) for r in mids}
    from ..functions.numbers import linspace

    for _ in range(rounds):
        for r in mids:
            ms, mm = sum(r.s) / 2, sum(r.m) / 2
            clip = lambda x: min(1.0, max(0.0, x))
            sims, margins = sorted({clip(x) for x in linspace(ms - span / 2, ms + span / 2, steps)}), sorted({clip(x) for x in linspace(mm - span / 2, mm + span / 2, steps)})
            pass_others = F.lit(False)
            for label, (s, m) in chosen.items():
                if label != r.top1:
                    pass_others = pass_others | ((F.col("top1") == label) & (F.col("max_sim") >= s) & (F.col("margin") >= m))
            # other labels' rows pass or fail whatever the cell
            t = feats.select("y_true", "top1", F.when(F.col("top1") == r.top1, F.col("max_sim")).otherwise(F.when(pass_others, 9.0).otherwise(-9.0)).alias("max_sim"), F.when(F.col("top1") == r.top1, F.col("margin")).otherwise(F.when(pass_others, 9.0).otherwise(-9.0)).alias("margin"))
            b = best_cell(sweep(t, sims, margins)).first()
            chosen[r.top1] = (b.ts, b.tm)
    feats.unpersist()
    return [(label, s, m) for label, (s, m) in sorted(chosen.items())]
