"""Documents as ordered lines, and operators that need whole runs of lines.

All windows share ``partitionBy(doc_id).orderBy(line_no)``, so a plan of several of
them has one exchange and one sort.  A document is one window partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import fixed, text



def line_order() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("line_no")


def explode_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no from 0, line); null and empty texts have no lines."""
    some = df.where(F.length(text_col) > 0)
    return some.select(F.col(id_col).alias("doc_id"), F.posexplode(text.lines(text_col)).alias("line_no", "line"))


def implode_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """(doc_id, text) of lines in order."""
    held = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", line))).alias("ls"))
    return held.select("doc_id", F.array_join(F.transform("ls", lambda s: s[line]), "\n").alias("text"))


def with_islands(lines: DataFrame, starts: Column, name: str = "island") -> DataFrame:
    """Numbers the islands of consecutive lines; ``starts`` marks each one's first line."""
    return lines.withColumn(name, F.sum(starts.cast("long")).over(line_order().rowsBetween(Window.unboundedPreceding, 0)))


def merge_vertical_runs(lines: DataFrame, least: int = 6, width: int = 2, drop=tuple(fixed.VERTICAL_WORDS)) -> DataFrame:
    """Runs of ``least`` or more lines of 1 to ``width`` characters become one line; binding words go."""
    s = text.utrim("line")
    thin = (F.length(s) >= 1) & (F.length(s) <= width)
    t = lines.withColumn("thin", thin)
    t = with_islands(t, F.coalesce(F.col("thin") != F.lag("thin").over(line_order()), F.lit(True)))
    run = Window.partitionBy("doc_id", "island")
    t = t.withColumn("merge", F.col("thin") & (F.count("*").over(run) >= least))
    kept = t.where("not merge").select("doc_id", "line_no", "line")
    merged = t.where("merge").groupBy("doc_id", "island").agg(F.min("line_no").alias("line_no"), F.array_sort(F.collect_list(F.struct("line_no", s.alias("s")))).alias("ls"))
    merged = merged.select("doc_id", "line_no", F.array_join(F.transform("ls", lambda x: x["s"]), "").alias("line")).where(~F.col("line").isin(list(drop)))
    return kept.unionByName(merged)


def drop_repeated_short_lines(lines: DataFrame, least_lines: int = 40, repeats: int = 2, longest: int = 30, keep=tuple(fixed.KEEP_WORDS)) -> DataFrame:
    """In long documents, short lines that repeat (headers, footers) go with all their copies."""
    s = text.utrim("line")
    t = lines.withColumn("key", s)
    counts = t.groupBy("doc_id", "key").agg(F.count("*").alias("copies"))  # map-side combined
    counts = counts.withColumn("n_lines", F.sum("copies").over(Window.partitionBy("doc_id")))
    bad = counts.where((F.col("n_lines") >= least_lines) & (F.col("copies") >= repeats) & (F.col("key") != "") & (F.length("key") < longest) & ~text.contains_any("key", keep))
    return t.join(bad.select("doc_id", "key"), ["doc_id", "key"], "left_anti").select("doc_id", "line_no", "line")


def without_repeated_short_lines(ls: Column, least_lines: int = 40, repeats: int = 2, longest: int = 30, keep=tuple(fixed.KEEP_WORDS)) -> Column:
    """Array of (line_no, line) of an array of lines, as ``drop_repeated_short_lines`` leaves them; a
    document is judged inside its row, so nothing is shuffled."""
    short = lambda key: (key != "") & (F.length(key) < longest) & ~text.contains_any(key, keep)
    ordered = lambda keys: F.array_sort(F.filter(keys, short))
    often = lambda s: F.array_distinct(F.filter(s, lambda x, i: F.coalesce(F.get(s, i - (repeats - 1)) == x, F.lit(False))))
    numbered = F.transform(ls, lambda x, i: F.struct(i.alias("line_no"), x.alias("line")))
    left = lambda bad: F.filter(numbered, lambda x: ~F.array_contains(bad, text.utrim(x["line"])))
    judged = text.let(ordered(F.transform(ls, text.utrim)), lambda s: text.let(often(s), left))
    return F.when(F.size(ls) < least_lines, numbered).otherwise(judged)


def resolve_phone_fragments(lines: DataFrame, phone: Column) -> DataFrame:
    """A run of tagged lines becomes one line with ``phone`` behind its prefix; blank lines go."""
    tagged = F.contains("line", F.lit("[PHONE_FRAGMENT:"))
    t = lines.withColumn("tagged", tagged).withColumn("first", F.col("tagged") & ~F.coalesce(F.lag("tagged").over(line_order()), F.lit(False)))
    head = text.extract("line", r"^([RLrl]\s*[:：]\s*)", 1)
    t = t.where(~F.col("tagged") | F.col("first")).withColumn("line", F.when(F.col("tagged"), F.concat(head, phone)).otherwise(F.col("line")))
    return t.where(text.utrim("line") != "").select("doc_id", "line_no", "line")


def adjacent_windows(lines: DataFrame, widths=(1, 2, 3)) -> DataFrame:
    """(doc_id, candidate): one, two and three lines together and all of them, cleaned, each once."""
    ahead = [F.lead("line", i).over(line_order()) for i in range(max(widths))]
    t = lines.select("doc_id", "line_no", "line", *(a.alias(f"l{i}") for i, a in enumerate(ahead)))
    joined = [F.concat(*(F.col(f"l{i}") for i in range(w))) for w in widths]
    some = t.select("doc_id", F.explode(F.array_compact(F.array(*joined))).alias("raw"))
    whole = implode_lines(lines).select("doc_id", F.replace("text", F.lit("\n"), F.lit("")).alias("raw"))
    return some.unionByName(whole).select("doc_id", text.detection_text("raw").alias("candidate")).where("candidate <> ''").distinct()
