"""Nested call reports and model replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import col, extract, utrim

CALL_SCHEMA = (
    "summary array<string>, todo struct<status:string,items:array<struct<description:string,need_follow_up:boolean,need_callback:boolean,need_internal_transfer:boolean,note:string>>>,"
    "personal_info struct<is_policy_holder:boolean,name:string,phone:string,address:struct<old:string,new:string>,id_number:string,birth_date:string,policy_number:string>,"
    "complaint struct<has_complaint:boolean,description:string,mentioned_authority:array<string>>, narrative string"
)
_L = F.lit


def shown(c) -> Column:
    c = col(c).cast("string")
    return F.when(c.isNull() | (utrim(c) == ""), fixed.MISSING).otherwise(c)


def shown_bool(c) -> Column:
    return F.when(col(c), fixed.YES).when(~col(c), fixed.NO).otherwise(fixed.MISSING)


def _some(c) -> Column:
    return F.coalesce(F.size(c) > 0, F.lit(False))


def report_lines(call: str) -> Column:
    """Array of the readable report's lines for a struct column of CALL_SCHEMA."""
    g = lambda p: F.col(f"{call}.{p}")
    line = lambda label, v: F.concat(_L(label), v)
    summary = F.when(_some(g("summary")), F.transform(g("summary"), lambda x: F.concat(_L("- "), shown(x)))).otherwise(F.array(_L(fixed.NONE)))

    def item(it, i):
        flags = F.concat(_L("   - 需追蹤："), shown_bool(it["need_follow_up"]), _L("；需回電："), shown_bool(it["need_callback"]), _L("；需內轉："), shown_bool(it["need_internal_transfer"]))
        note = F.when(F.coalesce(it["note"], _L("")) != "", line("   - 備註：", shown(it["note"])))
        return F.array_compact(F.array(F.concat((i + 1).cast("string"), _L(". "), shown(it["description"])), flags, note))

    items = F.when(_some(g("todo.items")), F.flatten(F.transform(g("todo.items"), item))).otherwise(F.array(_L(fixed.NONE)))
    status = shown(F.when(g("todo.status").isNull(), "unknown").otherwise(g("todo.status")))
    holder = F.when(g("personal_info.is_policy_holder").isNull(), fixed.MISSING).otherwise(F.initcap(g("personal_info.is_policy_holder").cast("string")))
    fields = [("姓名：", "name"), ("電話：", "phone"), ("舊地址：", "address.old"), ("新地址：", "address.new"), ("身分證字號：", "id_number"), ("出生年月日：", "birth_date"), ("保單編號：", "policy_number")]
    said = F.when(F.coalesce(g("complaint.description"), _L("")) != "", line("內容：", shown(g("complaint.description"))))
    units = F.when(_some(g("complaint.mentioned_authority")), line("提及單位：", F.array_join(g("complaint.mentioned_authority"), "、"))).otherwise(_L("提及單位：無"))
    return F.flatten(F.array(
        F.array(_L("【摘要】")), summary, F.array(_L(""), _L("【待辦事項】"), line("狀態：", status)), items,
        F.array(_L(""), _L("【個人資訊】"), line("是否為保戶本人：", holder), *(line(label, shown(g(f"personal_info.{f}"))) for label, f in fields)),
        F.array_compact(F.array(_L(""), _L("【申訴與不滿】"), line("是否有申訴：", shown_bool(g("complaint.has_complaint"))), said, units)),
        F.array(_L(""), _L("【內容描述】"), shown(g("narrative"))),
    ))


def reply_parts(c) -> Column:
    """struct(human, json): the two tagged parts of a reply, or all of it as JSON text."""
    c = col(c)
    both = c.contains(fixed.HUMAN_TAG) & c.contains(fixed.JSON_TAG)
    after = lambda t, tag: F.substring(t, F.instr(t, tag) + len(tag), F.length(t))
    human = utrim(F.substring_index(after(c, fixed.HUMAN_TAG), fixed.JSON_TAG, 1))
    return F.struct(F.when(both, human).alias("human"), F.when(both, utrim(after(c, fixed.JSON_TAG))).otherwise(c).alias("json"))


def json_candidate(c) -> Column:
    """From the first { to the last }; null if there are none."""
    found = extract(col(c), r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def straight_quotes(c) -> Column:
    return F.translate(col(c), "“”", '""')


def reply_error(c) -> Column:
    """What is wrong with a reply's JSON; null if it is an object."""
    found = json_candidate(c)
    parsed = F.try_parse_json(found) if hasattr(F, "try_parse_json") else F.get_json_object(found, "$")
    return F.when(found.isNull(), "找不到 JSON 物件").when(parsed.isNull(), "JSON 解析失敗")
