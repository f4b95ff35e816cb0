"""Finding personal data and putting stand-ins in its place."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed, privacy, text
from .lines import adjacent_windows
from .ranking import numbered

SPAN = "array<struct<start:int,end:int,kind:string,value:string>>"
_SPAN_TYPE = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())]))
_FINDERS = [("email", fixed.GMAIL, 0), ("id_number", fixed.TW_ID, 0), ("mobile", fixed.MOBILE, 0), ("birth_date", fixed.BIRTH_DATE, 0), ("address", fixed.ADDRESS, 0), ("name", fixed.NAME_AFTER, 1), ("name", fixed.NAME_BEFORE, 1)]


def spans_of(compact: str) -> list[tuple[int, int, str, str]]:
    return [(m.start(g), m.end(g), kind, m.group(g)) for kind, p, g in _FINDERS for m in re.finditer(p, compact)]


@F.pandas_udf(_SPAN_TYPE)
def find_spans(c: pd.Series) -> pd.Series:
    """All candidate spans of a text; positions are what Spark's regexes do not give."""
    return c.map(lambda t: [] if t is None else [dict(zip(("start", "end", "kind", "value"), s, strict=True)) for s in spans_of(t)])


def select_spans(c):
    """Spans that do not overlap: by start, the longer first, each kept if it is free of those before it."""
    ordered = F.array_sort(F.transform(c, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg"), s["kind"].alias("kind"), s["value"].alias("value"))))
    empty = F.expr("cast(array() as array<struct<start:int,neg:int,kind:string,value:string>>)")
    # kept spans come in order, so the last one ends latest
    kept = F.aggregate(ordered, empty, lambda acc, s: F.when((F.size(acc) == 0) | (s["start"] >= -F.element_at(acc, -1)["neg"]), F.concat(acc, F.array(s))).otherwise(acc))
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), (-s["neg"]).alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))


def rewrite_segments(contents: list[str], spans: list[tuple[int, int, str]]) -> list[str]:
    """Replaces spans of the text without white space inside the segments it came from: the first
    segment of a span gets the replacement, those between become empty, the last keeps its end."""
    at = [(i, j) for i, s in enumerate(contents) for j, ch in enumerate(s or "") if not ch.isspace()]
    out = [s or "" for s in contents]
    for start, end, to in sorted(spans, reverse=True):
        (a, i), (b, j) = at[start], at[end - 1]
        tail = out[b][j + 1 :]
        if a == b:
            out[a] = out[a][:i] + to + tail
        else:
            out[a] = out[a][:i] + to
            out[a + 1 : b] = [""] * (b - a - 1)
            out[b] = tail
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _rewritten(contents: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([rewrite_segments(list(c), [(s["start"], s["end"], s["to"]) for s in p]) for c, p in zip(contents, spans, strict=True)], index=contents.index)


def anonymise_segments(segs: DataFrame, profiles: DataFrame) -> DataFrame:
    """(conv_id, text, n_found) of segments (conv_id, seg_no, speaker, content), with the stand-ins of
    profiles (conv_id, profile struct).  Spans are found over segments, white space left out."""
    held = segs.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seg_no", "speaker", "content"))).alias("segs"))
    held = held.join(profiles, "conv_id", "left")
    contents = F.transform("segs", lambda s: s["content"])
    held = held.withColumn("compact", F.regexp_replace(F.array_join(contents, ""), f"[{fixed.SPACES}]", ""))
    held = held.withColumn("spans", select_spans(find_spans("compact"))).withColumn("birth", privacy.birth_parts("profile.birth_date"))
    to = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), privacy.replacement(s["kind"], s["value"], parts="birth").alias("to")))
    held = held.withColumn("new", _rewritten(contents, to))
    line = F.transform(F.arrays_zip("segs", "new"), lambda z: F.when(z["segs"]["speaker"].isNotNull(), F.concat(z["segs"]["speaker"], F.lit(": "), z["new"])).otherwise(z["new"]))
    return held.select("conv_id", F.array_join(line, "\n").alias("text"), F.size("spans").alias("n_found"))


# --- stand-ins ------------------------------------------------------------------------


def profile_dimension(raw: DataFrame) -> DataFrame:
    """(profile_idx, profile struct) of a table of stand-ins: trimmed, mobiles unified, blank rows dropped."""
    clean = raw.select("profile_no", *(text.utrim(F.coalesce(f, F.lit(""))).alias(f) for f in fixed.PROFILE_FIELDS)).where(" or ".join(f"{f} <> ''" for f in fixed.PROFILE_FIELDS))
    clean = clean.withColumn("mobile", privacy.mobile("mobile")).withColumn("id_number", privacy.id_key("id_number"))
    return numbered(clean, "profile_no", out="profile_idx").select("profile_idx", F.struct(*fixed.PROFILE_FIELDS).alias("profile"))


def _assigned(t: DataFrame, profiles: DataFrame, most: int) -> DataFrame:
    n = profiles.count()
    if not n:
        raise ValueError("no usable stand-in profile")
    side = F.broadcast(profiles) if n <= most else profiles
    return t.withColumn("profile_idx", F.pmod("__q_at", F.lit(n)).cast("long")).join(side, "profile_idx").drop("__q_at")


def assign_round_robin(df: DataFrame, profiles: DataFrame, order: str, most: int = 100_000) -> DataFrame:
    """Stand-ins in turn along ``order``; a dimension above ``most`` rows is not broadcast."""
    return _assigned(numbered(df, order, out="__q_at"), profiles, most)


def _hashed(key: str, seed: int):
    """A draw of 60 bits, as any engine with MD5 makes it."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 15), 16, 10).cast("long")


def assign_hashed(df: DataFrame, profiles: DataFrame, key: str, seed: int = 42, most: int = 100_000) -> DataFrame:
    """A stand-in drawn by a hash of the key: the same on every run, in any order."""
    return _assigned(df.withColumn("__q_at", _hashed(key, seed)), profiles, most)


def drawn(pool: str, key: str, seed: int = 42):
    """An element of an array column, drawn by a hash of the key."""
    return F.element_at(pool, (F.pmod(_hashed(key, seed), F.size(pool)) + 1).cast("int"))


def candidates_pii(lines: DataFrame) -> DataFrame:
    """(doc_id, kind, value): for each kind the find in the longest candidate text (ties: by text)."""
    kinds = [("email", fixed.GMAIL, 0), ("mobile", fixed.MOBILE_PLAIN, 0), ("id_number", fixed.TW_ID, 0), ("birth_date", fixed.SPOKEN_ROC_DATE, 0)]
    found = F.array(*(F.struct(F.lit(k).alias("kind"), F.regexp_replace(text.extract("candidate", p, g), "^[^0-9民A-Za-z]|[^0-9A-Za-z]$", "").alias("value")) for k, p, g in kinds))
    t = adjacent_windows(lines).select("doc_id", "candidate", F.explode(F.filter(found, lambda f: f["value"] != "")).alias("f"))
    return t.groupBy("doc_id", F.col("f.kind").alias("kind")).agg(F.min_by("f.value", F.struct(-F.length("candidate"), "candidate")).alias("value"))


def anonymise_found(docs: DataFrame, lines: DataFrame, profiles: DataFrame) -> DataFrame:
    """(doc_id, text): each found value and its stand-in, longest value first, whatever the case."""
    found = candidates_pii(lines).join(profiles, "doc_id")
    to = F.when(F.col("kind") == "birth_date", privacy.spoken_birth_like("value", F.col("profile.birth_date"))).otherwise(privacy.replacement("kind", "value"))
    table = found.select("doc_id", F.struct((-F.length("value")).alias("n"), F.col("value").alias("word"), to.alias("to")).alias("w")).groupBy("doc_id").agg(F.array_sort(F.collect_list("w")).alias("table"))
    t = docs.join(table, "doc_id", "left")
    return t.select("doc_id", F.when(F.col("table").isNull(), F.col("text")).otherwise(privacy.replaced_words("text", F.col("table"))).alias("text"))


def replace_entities(df: DataFrame, recogniser, profile: str = "profile", kinds=None) -> DataFrame:
    """Entities of ``recogniser(text) -> [(word, tag)]`` replaced by the profile's name or address."""
    kinds = kinds or fixed.ENTITY_KINDS

    @F.pandas_udf(T.StringType())
    def run(c: pd.Series, name: pd.Series, address: pd.Series) -> pd.Series:
        def one(t, n, a):
            if t is None:
                return None
            for word, tag in dict(recogniser(t)).items():
                kind = kinds.get(tag.split("-")[-1])
                t = t.replace(word, {"name": n, "address": a}[kind] or "") if kind and word else t
            return t

        return pd.Series(map(one, c, name, address), index=c.index, dtype=object)

    return df.withColumn("text", run("text", F.col(f"{profile}.name"), F.col(f"{profile}.address")))
