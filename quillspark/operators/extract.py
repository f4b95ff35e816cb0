"""Fields, sections, persons and summaries of letters; speakers of transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, numbers, privacy, text
from .lines import explode_lines, line_order


def fields(c) -> dict[str, Column]:
    """One column for each field; a missing basis falls back to the first law cited."""
    c = F.coalesce(text.col(c), F.lit(""))
    out = {name: text.utrim(text.extract(c, p, 1)) for name, p in fixed.FIELD_PATTERNS.items()}
    law = text.utrim(text.extract(c, fixed.LAW, 1))
    out["basis"] = F.when(out["basis"] != "", out["basis"]).otherwise(law)
    return out | {"raw_text_len": F.length(c)}


def first_clause(c) -> Column:
    return text.utrim(text.extract(text.col(c), fixed.FIRST_CLAUSE, 1))


def dense_text(most: int = 300) -> Column:
    """The filled fields, tagged, cut at ``most`` characters."""
    return F.substring(F.concat_ws(" / ", *(F.when(F.col(f) != "", F.concat(F.lit(tag), F.col(f))) for f, tag in fixed.DENSE_PARTS)), 1, most)


def with_alternatives(df: DataFrame, columns: dict[str, list[str]]) -> DataFrame:
    """Fields from the first of their columns that is not empty."""
    have = set(df.columns)
    return df.select("*", *(F.coalesce(*(F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")) for c in cs if c in have), F.lit("")).alias(f) for f, cs in columns.items()))


def _heads() -> str:
    names = sorted({a for v in fixed.FIELD_ALIASES.values() for a in v}, key=lambda x: (-len(x), x))
    return r"^(" + "|".join(names) + r")\s*:?[^\S\n]*(.*)$"


def sections(df: DataFrame) -> DataFrame:
    """(doc_id, field, block): text from each field's heading to the next; repeats are joined by line ends."""
    t = explode_lines(df)
    t = t.withColumn("field", F.nullif(text.extract("line", _heads(), 1), F.lit("")))
    t = t.withColumn("rest", F.when(F.col("field").isNotNull(), text.utrim(text.extract("line", _heads(), 2))).otherwise(F.col("line")))
    t = t.withColumn("part", F.count("field").over(line_order().rowsBetween(Window.unboundedPreceding, 0))).where("part > 0")
    parts = t.groupBy("doc_id", "part").agg(F.max("field").alias("field"), F.array_sort(F.collect_list(F.struct("line_no", "rest"))).alias("ls"))
    parts = parts.select("doc_id", "field", "part", text.utrim(F.array_join(F.transform("ls", lambda x: x["rest"]), "\n")).alias("block"))
    blocks = parts.groupBy("doc_id", "field").agg(F.array_sort(F.collect_list(F.struct("part", "block"))).alias("bs"))
    return blocks.select("doc_id", "field", text.utrim(F.array_join(F.filter(F.transform("bs", lambda b: b["block"]), lambda b: b != ""), "\n")).alias("block"))


def canonical(sections_: DataFrame) -> DataFrame:
    """(doc_id, key, value): for each key its first alias with a value, in the aliases' order."""
    rank = [F.struct(F.lit(a).alias("field"), F.lit(k).alias("key"), F.lit(i).alias("rank")) for k, v in fixed.FIELD_ALIASES.items() for i, a in enumerate(v)]
    table = F.filter(F.array(*rank), lambda r: r["field"] == F.col("field"))
    t = sections_.where("block <> ''").select("doc_id", "block", F.explode(table).alias("r"))
    return t.groupBy("doc_id", F.col("r.key").alias("key")).agg(F.min_by("block", "r.rank").alias("value"))


def bodies(df: DataFrame) -> DataFrame:
    """(doc_id, body, rule): the body field; else what follows the subject's line up to a closing
    field; else from the first enumerator; else the middle three fifths."""
    keys = canonical(sections(df)).where("key = 'body'").select("doc_id", F.col("value").alias("named"))
    tail = "|".join(a for k in fixed.TAIL_FIELDS for a in fixed.FIELD_ALIASES[k])
    c = F.col("text")
    after = text.extract(c, rf"(?ms)^主旨[^\n]*\n(.*?)(?:^(?:{tail})\s*:?|\z)", 1)
    after = text.utrim(F.regexp_replace(after, "(?m)" + _heads(), ""))
    listed = text.utrim(text.extract(c, rf"(?s)({fixed.FIRST_ENUMERATOR}.*)", 1))
    n = F.length(c)
    low = F.floor(n * 0.2).cast("int")
    middle = text.utrim(F.substring(c, low + 1, F.floor(n * 0.8).cast("int") - low))
    t = df.select("doc_id", "text").join(keys, "doc_id", "left")
    choice = [(F.col("named"), "field"), (after, "after_subject"), (listed, "enumerator"), (middle, "middle")]
    ok = lambda v: F.coalesce(v, F.lit("")) != ""
    return t.select("doc_id", F.coalesce(*(F.when(ok(v), v) for v, _ in choice), F.lit("")).alias("body"), F.coalesce(*(F.when(ok(v), r) for v, r in choice), F.lit("none")).alias("rule"))


def case_people(df: DataFrame) -> DataFrame:
    """(doc_id, case_no, person_no, name, id_number, as_of) of a text of cases."""
    t = df.select("doc_id", F.posexplode(F.filter(F.transform(F.split("text", "＝{3,}"), text.utrim), lambda x: x != "")).alias("case_no", "case"))
    t = t.select("doc_id", "case_no", F.posexplode(F.filter(F.transform(F.split("case", "調查人[ㄧ一二三四五]"), text.utrim), lambda x: x != "")).alias("person_no", "block"))
    field = lambda label: text.utrim(text.extract("block", f"{label}：([^\\n]*)", 1))
    return t.select("doc_id", "case_no", "person_no", *(field(f).alias(n) for f, n in zip(fixed.PERSON_FIELDS, ("name", "id_number", "as_of"), strict=True)))


def _is_name(t: Column) -> Column:
    plain = (F.length(t) >= 2) & (F.length(t) <= 4) & ~t.rlike("[0-9A-Za-z]") & ~t.isin(fixed.NOT_NAMES) & t.rlike(rf"^[{fixed.SURNAMES}][{fixed.CJK}·‧・]+$")
    return t.rlike(fixed.MASKED_NAME) | plain


def _tokens(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(c, fixed.PARENTHESES, " "), fixed.NAME_SPLIT), lambda x: x != "")


def _name_in(c: Column) -> Column:
    masked = F.get(F.filter(_tokens(c), lambda t: t.rlike(fixed.MASKED_NAME)), F.lit(0))
    return F.coalesce(masked, F.get(F.filter(_tokens(c), _is_name), F.lit(0)))


def role_persons(df: DataFrame) -> DataFrame:
    """(doc_id, line_no, role, name) of role lines: the name left of an id, else the first in
    the segment, else in the next line; each (role, name) once."""
    t = explode_lines(df).withColumn("next", F.lead("line").over(line_order()))
    t = t.withColumn("role", text.extract("line", fixed.ROLE_LINE, 1)).where("role <> ''")
    left = text.extract("line", rf"^(.*?){fixed.LINE_ID}", 1)
    by_id = F.when(left != "", F.element_at(F.filter(F.concat(F.array(F.lit("")), _tokens(left)), lambda x: (x == "") | _is_name(x)), -1))
    name = F.coalesce(F.nullif(by_id, F.lit("")), _name_in(text.extract("line", fixed.ROLE_LINE, 2)), _name_in(F.coalesce("next", F.lit(""))))
    t = t.select("doc_id", "line_no", "role", name.alias("name")).where("name is not null")
    return t.groupBy("doc_id", "role", "name").agg(F.min("line_no").alias("line_no")).select("doc_id", "line_no", "role", "name")


def summary_text(cls, agency, who, acts, pols, phrase, due) -> Column:
    """One sentence of the filled parts; who: array(struct(role, name)), acts: array(struct(action, ..))."""
    some = lambda c: F.when(F.coalesce(text.col(c), F.lit("")) != "", text.col(c))
    tagged = lambda label, c, end="": F.when(c.isNotNull(), F.concat(F.lit(label), c, F.lit(end)))
    people = some(F.array_join(F.transform(who, lambda w: F.trim(F.concat_ws(" ", w["role"], w["name"]))), "、"))
    todo = some(F.array_join(F.array_sort(F.array_distinct(F.transform(acts, lambda a: a["action"]))), "、"))
    held = some(F.array_join(F.slice(pols, 1, 3), "、"))
    phrase, due = some(phrase), some(due)
    end = F.coalesce(F.concat(phrase, F.lit("（至 "), due, F.lit("）")), phrase, F.concat(F.lit("截至 "), due))
    return F.concat(F.concat_ws("；", some(agency), tagged("就「", some(cls), "」來文"), tagged("涉及 ", people), tagged("關聯保單 ", held), tagged("需辦事項：", todo), end), F.lit("。"))


def summaries(df: DataFrame, as_of: str, urgent_days: int = 7, redact: bool = True) -> DataFrame:
    """Nested summary records of (doc_id, class, text)."""
    f = fields("text")
    who = role_persons(df).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "role", "name"))).alias("ws"))
    t = df.join(who, "doc_id", "left")
    name = lambda w: (privacy.redacted_name(w["name"]) if redact else w["name"]).alias("name")
    t = t.withColumn("who", F.transform(F.coalesce("ws", F.expr("cast(array() as array<struct<line_no:int,role:string,name:string>>)")), lambda w: F.struct(w["role"].alias("role"), name(w))))
    t = t.withColumn("due", numbers.due_date("text", F.to_date(F.lit(as_of)))).withColumn("acts", privacy.actions("text")).withColumn("policies", privacy.policies("text"))
    ids = privacy.valid_ids("text")
    t = t.withColumn("ids", F.transform(ids, privacy.redacted_id) if redact else ids)
    urgent = numbers.urgency("text", F.col("due.days_left"), urgent_days)
    return t.select(
        "doc_id", "class", F.struct(urgent["is_urgent"].alias("is_urgent"), urgent["reason"].alias("reason"), F.col("due.due").cast("string").alias("due_date")).alias("urgency"),
        "who", "ids", "policies", F.filter(F.array(f["basis"]), lambda x: x != "").alias("basis"), f["agency"].alias("agency"), f["case_id"].alias("case_id"), f["subject"].alias("subject"),
        summary_text("class", f["agency"], F.col("who"), F.col("acts"), F.col("policies"), F.col("due.phrase"), F.col("due.due").cast("string")).alias("summary_text"),
    )


def flat_summaries(s: DataFrame) -> DataFrame:
    j = lambda c: F.array_join(c, "；").alias(c)
    who = F.array_join(F.transform("who", lambda w: F.concat_ws(":", w["role"], w["name"])), "；").alias("who")
    return s.select("doc_id", "class", F.col("urgency.is_urgent").alias("is_urgent"), F.col("urgency.due_date").alias("due_date"), "agency", "case_id", j("ids"), who, j("policies"), j("basis"), "subject", "summary_text")


# --- transcripts --------------------------------------------------------------------


def segments(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, seg_no, speaker, content); lines without a speaker stay, with a null one."""
    t = explode_lines(df, id_col).withColumnRenamed("doc_id", "conv_id").withColumnRenamed("line_no", "seg_no")
    said = F.col("line").rlike(r"^(L|R)\s*:")
    return t.select("conv_id", "seg_no", F.when(said, F.substring("line", 1, 1)).alias("speaker"), F.when(said, text.extract("line", r"^(L|R)\s*:\s?(.*)$", 2)).otherwise(F.col("line")).alias("content"))


def render_segment(speaker: str = "speaker", content: str = "content") -> Column:
    return F.when(F.col(speaker).isNotNull(), F.concat(F.col(speaker), F.lit(": "), F.col(content))).otherwise(F.col(content))


def compact_offsets(segs: DataFrame) -> DataFrame:
    """Segments with the place of each one in the text without white space."""
    n = F.length(text.replaced("content", [(f"[{fixed.SPACES}]", "")]))
    w = Window.partitionBy("conv_id").orderBy("seg_no").rowsBetween(Window.unboundedPreceding, -1)
    return segs.withColumn("n_compact", n).withColumn("start", F.coalesce(F.sum("n_compact").over(w), F.lit(0)))


def by_speaker(turns: DataFrame, speakers: dict[str, str], id_col: str = "conv_id", order: str = "turn") -> DataFrame:
    """(conv_id, text_<name>...): what each role said, trimmed, blank turns dropped, in order."""
    said = text.utrim(F.coalesce("text", F.lit("")))
    t = turns.select(id_col, order, "role", said.alias("said")).where("said <> ''")
    cols = [F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == r, F.struct(order, "said")))), lambda s: s["said"]), "\n").alias(f"text_{n}") for r, n in speakers.items()]
    return t.groupBy(id_col).agg(*cols)
