"""Row numbers over whole tables and over groups of any size.

A window over one hot group, or over no group at all, would put all its rows in one
task.  Here rows are cut into shards of the order key, shards are counted (a map-side
combined aggregation), their counts are added up, and only a shard is ever sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _position(df: DataFrame, order: str) -> Column:
    """A number that rises with the key: the key itself, or a string's first bytes."""
    if dict(df.dtypes)[order] == "string":
        return F.conv(F.substring(F.rpad(F.hex(F.coalesce(F.col(order), F.lit(""))), 14, "0"), 1, 14), 16, 10).cast("double")
    return F.col(order).cast("double")


def numbered(df: DataFrame, order: str, by: list[str] | None = None, out: str = "row_no", shards: int = 64) -> DataFrame:
    """df with ``out``: 0, 1, ... along ``order`` (ties in any order) within each group of ``by``."""
    by = by or []
    at = _position(df, order)
    cuts = df.select(F.percentile_approx(at, [i / shards for i in range(1, shards)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    shard = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < at)) if cuts else F.lit(0)
    rows = df.withColumn("__q_shard", F.coalesce(F.when(at.isNotNull(), shard), F.lit(-1)))
    keys = [*by, "__q_shard"]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__q_n"))
    # at most ``shards`` rows for each group
    before = Window.partitionBy(*by).orderBy("__q_shard").rowsBetween(Window.unboundedPreceding, -1) if by else Window.partitionBy(F.lit(0)).orderBy("__q_shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*(F.col(k).alias(f"__q_k{i}") for i, k in enumerate(keys)), F.coalesce(F.sum("__q_n").over(before), F.lit(0)).alias("__q_before"))
    ranked = rows.withColumn("__q_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
    on = [F.col(k).eqNullSafe(F.col(f"__q_k{i}")) for i, k in enumerate(keys)]
    joined = ranked.join(F.broadcast(offsets) if not by else offsets, on)
    return joined.withColumn(out, (F.col("__q_rank") + F.col("__q_before")).cast("long")).drop("__q_shard", "__q_rank", "__q_before", *(f"__q_k{i}" for i in range(len(keys))))
