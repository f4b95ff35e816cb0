"""Masks, checks and replacements of personal data, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import col, extract, extract_all, let, replaced, utrim


def masked_id(c) -> Column:
    c = col(c)
    return F.when(c.rlike(fixed.MASKABLE_ID), F.concat(F.substring(c, 1, 4), F.lit("****"), F.right(c, F.lit(2)))).otherwise(c)


def masked_policy(c) -> Column:
    c = col(c)
    stars = F.repeat(F.lit("*"), F.greatest(F.length(c) - 5, F.lit(4)))
    return F.when(c.rlike(fixed.MASKABLE_POLICY), F.concat(F.substring(c, 1, 3), stars, F.right(c, F.lit(2)))).otherwise(c)


def redacted_name(c) -> Column:
    c = col(c)
    n = F.length(c)
    middle = F.repeat(F.lit("○"), F.greatest(n - 2, F.lit(0)))
    return F.when(n <= 1, F.when(n == 1, "○").otherwise(c)).when(n == 2, F.concat(F.substring(c, 1, 1), F.lit("○"))).otherwise(F.concat(F.substring(c, 1, 1), middle, F.right(c, F.lit(1))))


def redacted_id(c) -> Column:
    c = col(c)
    return F.concat(F.substring(c, 1, 2), F.lit("*" * 6), F.right(c, F.lit(2)))


def valid_id(c) -> Column:
    """The check digit holds: weights over the letter's two digits and all nine others."""
    c = col(c)
    code = F.instr(F.lit(fixed.ID_LETTERS), F.substring(c, 1, 1)) + 9
    total = F.floor(code / 10) * fixed.ID_WEIGHTS[0] + code % 10 * fixed.ID_WEIGHTS[1]
    for i, w in enumerate(fixed.ID_WEIGHTS[2:]):
        total = total + F.substring(c, i + 2, 1).try_cast("int") * w
    return F.when(c.rlike(r"^[A-Z][12]\d{8}$"), total % 10 == 0).otherwise(F.lit(False))


def valid_ids(c) -> Column:
    return F.array_distinct(F.filter(extract_all(col(c), f"({fixed.LINE_ID})", 1), valid_id))


def policies(c) -> Column:
    return F.array_distinct(extract_all(col(c), fixed.POLICY, 1))


def actions(c, table=None) -> Column:
    """array(struct(action, trigger)): for each action the first of its words that occurs."""
    c, table = col(c), table or fixed.ACTIONS
    found = [F.coalesce(*(F.when(F.contains(c, F.lit(w)), F.struct(F.lit(a).alias("action"), F.lit(w).alias("trigger"))) for w in words)) for a, words in table.items()]
    return F.array_compact(F.array(*found))


def mobile(c) -> Column:
    """Ten digits from 09 where there are any; else as it is."""
    c = col(c)
    digits = replaced(c, [(r"[^0-9]", "")])
    digits = F.when(digits.startswith("886") & (F.length(digits) >= 11), F.concat(F.lit("0"), F.substring(digits, 4, 64))).otherwise(digits)
    return F.when(digits.startswith("09") & (F.length(digits) >= 10), F.substring(digits, 1, 10)).otherwise(utrim(c))


def id_key(c) -> Column:
    return F.upper(utrim(c))


def birth_parts(c) -> Column:
    """struct(y, m, d) of a birth date in AD or ROC years; null if it is none."""
    s = utrim(c)
    out = []
    for pattern, shift in ((r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$", 0), (r"^民國(\d{2,3})年(\d{1,2})月(\d{1,2})日$", 1911), (r"^(\d{2,3})[-/.](\d{1,2})[-/.](\d{1,2})$", 1911)):
        y, m, d = (extract(s, pattern, i).try_cast("int") for i in (1, 2, 3))
        out.append(F.when(s.rlike(pattern), F.struct((y + shift).alias("y"), m.alias("m"), d.alias("d"))))
    return F.coalesce(*out)


def birth_like(original, fake, parts=None) -> Column:
    """The fake birth date in the format of the original one; ``parts`` as ``birth_parts(fake)`` has them."""
    if parts is not None:
        return _birth_as(col(original), col(parts), col(fake))
    return let(birth_parts(fake), lambda p: _birth_as(col(original), p, col(fake)))


def _birth_as(o: Column, p: Column, fake: Column) -> Column:
    y, m, d = p["y"], p["m"], p["d"]
    roc = y - 1911
    out = F.when(o.contains("民國") & o.contains("年") & o.contains("月"), F.format_string("民國%d年%d月%d日", roc, m, d))
    for sep, pattern in (("/", "/"), ("-", "-"), (".", r"\.")):
        out = out.when(o.rlike(rf"^\d{{2,3}}{pattern}\d{{1,2}}{pattern}\d{{1,2}}$"), F.format_string(f"%d{sep}%d{sep}%d", roc, m, d))
        out = out.when(o.rlike(rf"^\d{{4}}{pattern}\d{{1,2}}{pattern}\d{{1,2}}$"), F.format_string(f"%d{sep}%02d{sep}%02d", y, m, d))
    return out.when(o.contains("年") & o.contains("月") & o.contains("日"), F.format_string("%d年%d月%d日", y, m, d)).otherwise(fake)


def spoken_birth_like(original, fake) -> Column:
    """ROC form; month and day are padded where the original pads them; six digits stay six or seven."""
    return let(birth_parts(fake), lambda p: _spoken_as(col(original), p))


def _spoken_as(o: Column, p: Column) -> Column:
    roc, m, d = p["y"] - 1911, p["m"], p["d"]
    pad = lambda i: F.length(extract(o, r"(\d{1,2})月(\d{1,2})", i)) == 2
    month = F.when(pad(1), F.format_string("%02d", m)).otherwise(m.cast("string"))
    day = F.when(pad(2), F.format_string("%02d", d)).otherwise(d.cast("string"))
    text = F.concat(roc.cast("string"), F.lit("年"), month, F.lit("月"), day)
    return F.when(o.rlike(r"^民國\d{2,3}年"), F.concat(F.lit("民國"), text)).when(o.rlike(r"^\d{2,3}年"), text).when(o.rlike(r"^\d{6,7}$"), F.format_string("%02d%02d%02d", roc, m, d)).otherwise(o)


def replacement(kind, value, profile: str = "profile", parts=None) -> Column:
    """What stands for a found value of a kind; unknown kinds keep their value.  Inside a lambda whose
    result goes to a Python function give the profile's ``birth_parts``: Spark does not extract a
    Python function with a lambda inside a lambda among its arguments."""
    kind = col(kind)
    p = lambda f: F.col(f"{profile}.{f}")
    return (
        F.when(kind == "email", p("email")).when(kind == "mobile", p("mobile")).when(kind == "id_number", id_key(p("id_number")))
        .when(kind == "birth_date", birth_like(value, p("birth_date"), parts)).when(kind == "address", p("address")).when(kind == "name", p("name")).otherwise(col(value))
    )


def _dollars(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(r"([\\$])"), F.lit(r"\\$1"))


def without_line_pii(c, profile: str = "profile") -> Column:
    """E-mail, id, birthday and phone in one line, one stand-in for each kind."""
    p = lambda f: _dollars(F.col(f"{profile}.{f}"))
    c = col(c)
    for pattern, field in ((fixed.ANY_EMAIL, "email"), (fixed.LINE_ID, "id_number"), (fixed.LINE_BIRTHDAY, "birth_date"), (fixed.LINE_PHONE, "mobile")):
        c = F.regexp_replace(c, F.lit(pattern), p(field))
    return c


def phone_fragment(c) -> Column:
    """Two to six digits that are all a speaker says, tagged."""
    c = col(c)
    head = extract(c, r"^([RLrl]\s*[:：]\s*)(.*)$", 1)
    digits = replaced(extract(c, r"^([RLrl]\s*[:：]\s*)(.*)$", 2), [(r"[\s\-]", "")])
    return F.when((head != "") & digits.rlike(r"^\d{2,6}$"), F.concat(head, F.lit("[PHONE_FRAGMENT:"), digits, F.lit("]"))).otherwise(c)


def replaced_words(c, table: Column) -> Column:
    """array(struct(word, to)) applied in order, whatever the words' case."""
    quoted = lambda w: F.concat(F.lit(r"(?i)\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.aggregate(table, col(c), lambda acc, x: F.when(x["word"] != "", F.regexp_replace(acc, quoted(x["word"]), _dollars(x["to"]))).otherwise(acc))

