"""Stratified splits and samples, drawn by hashes: order-free and the same on every run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import extract
from .ranking import numbered


def _drawn(df: DataFrame, label: str, key: str, seed: int, most: int = 100_000) -> DataFrame:
    """Row numbers within each label along a hash; hot labels are numbered shard by shard.  Sizes of
    more than ``most`` labels are not broadcast."""
    t = numbered(df.withColumn("__q_draw", F.xxhash64(F.lit(seed), F.col(key))), "__q_draw", [label], "__q_no")
    sizes = df.groupBy(label).agg(F.count("*").alias("__q_size"))
    side = F.broadcast(sizes) if sizes.count() <= most else sizes
    return t.join(side, label).drop("__q_draw")


def stratified_split(df: DataFrame, label: str = "label", key: str = "doc_id", seed: int = 42, held: float = 0.3) -> DataFrame:
    """df with ``split``: per label, ``held`` of the rows are held out, half of them for validation."""
    t = _drawn(df.dropna(subset=[label]), label, key, seed)
    out = F.round(F.col("__q_size") * held)
    valid = F.floor(out / 2)
    return t.withColumn("split", F.when(F.col("__q_no") >= out, "train").when(F.col("__q_no") < valid, "valid").otherwise("test")).drop("__q_no", "__q_size")


def sample_sizes(size, wanted: dict[str, int] | None, category, ratio: float | None, n: int | None):
    """Rows to draw: the category's own number, else the ratio (one at least), else n; never more than there are."""
    k = F.lit(None).cast("long")
    for c, v in (wanted or {}).items():
        k = F.when(category == c, F.lit(v).cast("long")).otherwise(k)
    rest = F.greatest(F.lit(1).cast("long"), F.bround(size * ratio).cast("long")) if ratio is not None else F.lit(n if n is not None else 0).cast("long")
    return F.greatest(F.lit(0).cast("long"), F.least(F.coalesce(k, rest), size))


def per_category_sample(df: DataFrame, label: str, key: str, wanted: dict[str, int] | None = None, ratio: float | None = None, n: int | None = None, seed: int = 42) -> DataFrame:
    """df with ``picked``; picked and not picked rows are all rows."""
    t = _drawn(df, label, key, seed)
    return t.withColumn("picked", F.col("__q_no") < sample_sizes(F.col("__q_size"), wanted, F.col(label), ratio, n)).drop("__q_no", "__q_size")


def parse_sizes(text: str) -> dict[str, int]:
    """``a=5,b=8`` as a mapping; an error for a part without a number of 0 or more."""
    out = {}
    for part in filter(None, (p.strip() for p in text.replace("，", ",").split(","))):
        name, eq, value = part.rpartition("=")
        if not eq or not name.strip() or not value.strip().isdigit():
            raise ValueError(f"not a size of a category: {part!r}")
        out[name.strip()] = int(value)
    return out


def placement(df: DataFrame, folder: str, name: str, order: str) -> DataFrame:
    """df with ``target``: folder/name, with _1, _2 ... before the extension where names collide."""
    t = numbered(df, order, [folder, name], "__q_no")
    stem, ext = extract(name, r"^(.*?)(\.[^.]*)?$", 1), extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    return t.withColumn("target", F.concat(F.col(folder), F.lit("/"), stem, F.when(F.col("__q_no") > 0, F.concat(F.lit("_"), F.col("__q_no").cast("string"))).otherwise(""), ext)).drop("__q_no")


def sequential_ids(df: DataFrame, order: str, prefix: str = "B", width: int = 3) -> DataFrame:
    """df with ``seq_id``: prefix and a number from 1 along ``order``."""
    t = numbered(df, order, out="__q_no")
    n = (F.col("__q_no") + 1).cast("string")
    return t.withColumn("seq_id", F.concat(F.lit(prefix), F.when(F.length(n) < width, F.lpad(n, width, "0")).otherwise(n))).drop("__q_no")
