"""Numbers, durations and dates as expressions; missing is null, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import col, extract, utrim


def safe_double(c) -> Column:
    """The number, or null where there is none."""
    v = F.expr("cast(null as double)") if c is None else col(c).try_cast("double")
    return F.when(F.isnan(v), None).otherwise(v)


def seconds(c) -> Column:
    """Seconds of M分S秒, either part optional; null if it is neither."""
    s = utrim(c)
    m, sec = (extract(s, fixed.MIN_SEC, i) for i in (1, 2))
    ok = s.rlike(fixed.MIN_SEC) & ((m != "") | (sec != ""))
    return F.when(ok, F.coalesce(m.try_cast("double"), F.lit(0.0)) * 60 + F.coalesce(sec.try_cast("double"), F.lit(0.0)))


def seconds_both(c) -> Column:
    """Seconds where both parts occur somewhere, else 0."""
    c = F.coalesce(col(c), F.lit(""))
    m, s = (extract(c, fixed.MIN_SEC_BOTH, i).try_cast("long") for i in (1, 2))
    return F.coalesce(m * 60 + s, F.lit(0).cast("long"))


def duration_text(c) -> Column:
    c = col(c)
    sign = F.when(c < 0, "-").otherwise("")
    a = F.abs(c)
    m, s = F.floor(a / 60), F.pmod(a, F.lit(60.0))
    text = F.when(s == F.floor(s), F.floor(s).cast("string")).otherwise(F.format_string("%.2f", s))
    return F.when(c.isNull(), "N/A").otherwise(F.concat(sign, F.when(m > 0, F.concat(m.cast("string"), F.lit("分"))).otherwise(""), text, F.lit("秒")))


def model_family(c) -> Column:
    low = F.lower(col(c))
    found = extract(low, fixed.MODEL_FAMILY, 1)
    return F.when(found != "", found).otherwise(low)


def linspace(lo: float, hi: float, n: int) -> list[float]:
    return [round(lo + i * (hi - lo) / max(1, n - 1), 6) for i in range(n)]


def ad_year(y: Column) -> Column:
    return F.when(y < 1911, y + 1911).otherwise(y)


def numeral(c) -> Column:
    """Chinese numerals 1 to 99, or plain digits to 365, as an int; null if neither."""
    c = col(c)
    d = lambda x: F.translate(x, *fixed.NUMERALS).try_cast("int")
    before, after = F.substring_index(c, "十", 1), F.substring_index(c, "十", -1)
    tens = F.when(before == "", 1).otherwise(d(before)) * 10 + F.when(after == "", 0).otherwise(d(after))
    plain = c.try_cast("int")
    return F.when(c.contains("十"), tens).when(c.rlike("^[0-9]+$"), F.when(plain <= 365, plain)).otherwise(F.when(F.length(c) == 1, d(c)))


def due_date(c, as_of: Column) -> Column:
    """struct(due, phrase, days_left) by the first rule that gives a valid date."""
    c = col(c)

    def date_of(pattern, year):
        y, m, d = (extract(c, pattern, i) for i in (1, 2, 3))
        text = F.concat_ws("-", F.lpad(year(y.try_cast("int")).cast("string"), 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
        due = F.try_to_date(text, "yyyy-MM-dd")
        return F.when(due.isNotNull(), F.struct(due.alias("due"), extract(c, pattern, 0).alias("phrase"), F.date_diff(due, as_of).alias("days_left")))

    def within(pattern, number):
        n = number(extract(c, pattern, 1))
        return F.when(n.isNotNull(), F.struct(F.date_add(as_of, n).alias("due"), extract(c, pattern, 0).alias("phrase"), n.alias("days_left")))

    return F.coalesce(
        date_of(fixed.DATE_SLASH, lambda y: y), date_of(fixed.DATE_YEARS, ad_year),
        within(fixed.WITHIN_DAYS, lambda x: x.try_cast("int")), within(fixed.WITHIN_NUMERAL, numeral),
    )


def urgency(c, days_left, limit: int = 7, words=tuple(fixed.URGENT), skip: str = "速別") -> Column:
    """struct(is_urgent, reason); the heading ``skip`` is no urgent word."""
    from .text import contains_any

    hit = contains_any(F.replace(col(c), F.lit(skip), F.lit("")), words)
    near = F.coalesce(col(days_left) <= limit, F.lit(False))
    return F.struct((hit | near).alias("is_urgent"), F.concat_ws("；", F.when(hit, "命中急件詞"), F.when(near, f"{limit}日內")).alias("reason"))


def due_bucket(days: Column) -> Column:
    return F.when(days <= 0, "now").when(days <= 7, "soon").when(days > 7, "later")
