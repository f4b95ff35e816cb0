"""Flat and HTML forms of briefs and summaries; one expression per row, joined only by the writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers, privacy, text

BRIEF_SCHEMA = (
    "filename string, category string, insurer string, title string, summary string, persons array<struct<name:string,id_number:string>>, person_names array<string>,"
    "ids array<string>, policy_numbers array<string>, actions array<string>, date_mentions array<string>, deadline string, required_documents array<string>, agent_todo array<string>,"
    "rationale_points array<string>, extra struct<doc_no:string,court:string>"
)
_LISTS = ("actions", "date_mentions", "required_documents", "agent_todo", "rationale_points")


def _blank(c) -> Column:
    return F.coalesce(text.col(c), F.lit(""))


def _person_lists(mask_ids: bool) -> tuple[Column, Column]:
    some = F.coalesce(F.size("persons") > 0, F.lit(False))
    names = F.when(some, F.transform("persons", lambda p: _blank(p["name"]))).otherwise(F.coalesce("person_names", F.array().cast("array<string>")))
    ids = F.when(some, F.transform("persons", lambda p: _blank(p["id_number"]))).otherwise(F.coalesce("ids", F.array().cast("array<string>")))
    return names, F.transform(ids, privacy.masked_id) if mask_ids else ids


def _policies(mask: bool) -> Column:
    p = F.coalesce("policy_numbers", F.array().cast("array<string>"))
    return F.transform(p, privacy.masked_policy) if mask else p


def flat_briefs(df: DataFrame, mask_ids: bool = True, mask_policies: bool = True, width: int = 120) -> DataFrame:
    names, ids = _person_lists(mask_ids)
    j = lambda c: F.array_join(c, "、")
    return df.select(
        *(_blank(c).alias(c) for c in ("filename", "category", "insurer", "title")), text.short("summary", width).alias("summary_short"),
        j(names).alias("persons"), j(ids).alias("ids"), j(_policies(mask_policies)).alias("policy_numbers"),
        *(j(F.coalesce(c, F.array().cast("array<string>"))).alias(c) for c in _LISTS), _blank("deadline").alias("deadline"), _blank("extra.doc_no").alias("doc_no"),
    )


def brief_cards(df: DataFrame) -> DataFrame:
    """(category, filename, card): one HTML card a brief, ids masked with their full form beside them."""
    names, ids = _person_lists(False)
    secret = lambda full, masked: F.concat(F.lit('<span class="pii" data-full="'), text.html(full), F.lit('" data-masked="'), text.html(masked), F.lit('">'), text.html(masked), F.lit("</span>"))
    person = F.transform(names, lambda n, i: F.concat(text.html(n), F.lit(" "), secret(F.coalesce(F.get(ids, i), F.lit("")), privacy.masked_id(F.coalesce(F.get(ids, i), F.lit(""))))))
    policy = F.transform(_policies(False), lambda p: secret(p, privacy.masked_policy(p)))
    row = lambda label, c: F.concat(F.lit(f'<div class="row"><b>{label}</b> '), F.coalesce(F.nullif(c, F.lit("")), F.lit("—")), F.lit("</div>"))
    listed = lambda c: F.array_join(F.transform(F.coalesce(c, F.array().cast("array<string>")), text.html), "、")
    card = F.concat(
        F.lit('<article class="card"><h3>'), text.html("title"), F.lit('</h3><span class="pill">'), text.html("category"), F.lit('</span><span class="pill">'), text.html("insurer"), F.lit("</span>"),
        row("summary", text.html("summary")), row("persons", F.array_join(person, "、")), row("policies", F.array_join(policy, "、")),
        *(row(c, listed(c)) for c in _LISTS), row("deadline", text.html("deadline")), F.lit("</article>"),
    )
    return df.select(_blank("category").alias("category"), _blank("filename").alias("filename"), card.alias("card"))


def dashboard_rows(df: DataFrame, as_of: str) -> DataFrame:
    """Flat summaries with days_left, the due bucket and the lower-cased search text."""
    days = F.date_diff(F.try_to_date("due_date", "yyyy-MM-dd"), F.to_date(F.lit(as_of)))
    blob = F.lower(F.concat_ws(" ", *(F.col(c).cast("string") for c, t in df.dtypes if t == "string")))
    return df.withColumn("days_left", days).withColumn("due_bucket", numbers.due_bucket(F.col("days_left"))).withColumn("blob", blob)


def dashboard_filter(df: DataFrame, cls: str | None = None, urgent: bool = False, within: int | None = 7, words: str = "") -> DataFrame:
    """Class, urgent only, due within so many days (hides rows without a due date), all words found."""
    if cls:
        df = df.where(F.col("class") == cls)
    if urgent:
        df = df.where("is_urgent")
    if within is not None:
        df = df.where(F.col("days_left") <= within)
    return df.where(text.has_all_words("blob", words)) if words else df


def natural_key(c) -> Column:
    """Sort key in which runs of digits order as numbers."""
    parts = F.regexp_extract_all(F.coalesce(text.col(c), F.lit("")), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, 20, "0")).otherwise(p)), "")


def payload(c: Column | str = "*") -> Column:
    return F.to_json(F.struct(c), {"ignoreNullFields": "false"})


def entity_html(text_col: str, spans: str) -> Column:
    """Text with array(struct(start, end, tag)) marked, in order of start."""
    c = F.col(text_col)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        out = F.concat(acc["out"], text.html(F.substring(c, acc["at"] + 1, s["start"] - acc["at"])), F.lit('<mark class="'), s["tag"], F.lit('">'), text.html(F.substring(c, s["start"] + 1, s["end"] - s["start"])), F.lit("</mark>"))
        return F.struct(s["end"].alias("at"), out.alias("out"))

    return F.aggregate(F.array_sort(spans), start, step, lambda acc: F.concat(acc["out"], text.html(F.substring(c, acc["at"] + 1, F.length(c)))))


PAGE = '<!doctype html><meta charset="utf-8"><title>{title}</title><main>{body}</main>'
