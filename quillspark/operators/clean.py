"""Text cleaners as compositions of text rules; each maps a text column to a text column.

All but ``structured`` and ``keyword_aware`` are one expression over one row.  Those two
need runs of lines or counts of lines, so they work on the line relation.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text
from . import lines as L


@dataclass(frozen=True)
class CleanConfig:
    """Parameters of the cleaners; the defaults are the rules for official letters."""

    blacklist: str = fixed.BINDING_CHARS
    keep_words: tuple[str, ...] = tuple(fixed.KEEP_WORDS)
    banned: tuple[str, ...] = tuple(fixed.BANNED_LINE)
    level: int = 1
    head_lines: int = 30
    vertical_run: int = 6
    drop_pages: bool = True
    max_blank: int = 1
    conversion: dict[str, str] = field(default_factory=dict)


def noise_free(c, cfg: CleanConfig = CleanConfig()) -> Column:
    """Normalised, without binding characters, leading dots, page markers and inline noise."""
    c = text.without_chars(text.visible(c), cfg.blacklist)
    c = text.without_page_markers(text.without_leading_dots(c))
    return text.trimmed_lines(text.without_inline_noise(c))


def plain(c, cfg: CleanConfig = CleanConfig()) -> Column:
    """Normalised, without binding characters, blank lines and lines of punctuation."""
    return text.trimmed_lines(text.without_chars(text.visible(c), cfg.blacklist))


def dotted(c, cfg: CleanConfig = CleanConfig()) -> Column:
    """As ``noise_free``, with looser page markers and one narrow pass over inline noise."""
    c = text.without_chars(text.visible(c), cfg.blacklist)
    c = text.without_page_markers(text.without_leading_dots(c, r"\."), fixed.PAGE_MARKER_LOOSE)
    return text.trimmed_lines(text.without_inline_noise(c, tuple(fixed.INLINE_NOISE_NARROW), 1))


def _sentences(c, cfg: CleanConfig, careful: bool) -> Column:
    c = text.converter(cfg.conversion)(text.scrubbed(text.nfkc(c)))
    found = text.sentences(text.punctuated(text.joined_broken_lines(c)))
    return text.utrim(text.punctuated(F.array_join(F.transform(found, lambda s: text.ended(s, careful)), "\n")))


def sentence_lines(c, cfg: CleanConfig = CleanConfig()) -> Column:
    """One sentence a line: scrubbed, broken lines joined, punctuation unified, stops added."""
    return _sentences(c, cfg, careful=False)


def sentence_lines_filtered(c, cfg: CleanConfig = CleanConfig(blacklist=fixed.BINDING_CHARS_WIDE)) -> Column:
    """As ``sentence_lines`` without listed characters and symbol lines; stops are added with care."""
    c = text.where_lines(text.without_chars(c, cfg.blacklist), lambda x: (text.utrim(x) != "") & ~text.is_symbols_only(x))
    return _sentences(c, cfg, careful=True)


def structured(df: DataFrame, cfg: CleanConfig = CleanConfig()) -> DataFrame:
    """(doc_id, text): noise and page lines dropped unless they must stay, vertical runs and
    soft wraps joined, runs of marks and blank lines collapsed."""
    t = L.explode_lines(df.select("doc_id", text.visible("text", fixed.ZERO_WIDTH).alias("text")))
    t = t.withColumn("line", text.rtrim("line"))
    page = text.is_page_line("line") if cfg.drop_pages else F.lit(False)
    # the long list of patterns is tried on noise and page lines alone
    t = t.where(~(page | text.is_noise_line("line")) | text.must_keep("line", F.col("line_no"), cfg.head_lines))
    out = L.implode_lines(L.merge_vertical_runs(t, cfg.vertical_run))
    c = text.each_line(text.joined_soft_wraps("text"), lambda x: text.replaced(x, fixed.COLLAPSE_RUNS))
    return out.select("doc_id", text.utrim(text.collapsed_blanks(c, cfg.max_blank)).alias("text"))


def keyword_aware(df: DataFrame, cfg: CleanConfig = CleanConfig()) -> DataFrame:
    """(doc_id, text): repeated short lines dropped, hard wraps joined, banned lines dropped
    unless they hold a keyword, colons, dots, digits and bullets unified."""
    t = L.explode_lines(df.select("doc_id", text.squeezed("text").alias("text")))
    t = L.drop_repeated_short_lines(t, keep=cfg.keep_words) if cfg.level >= 1 else t
    c = text.joined_hard_wraps("text")
    c = text.each_line(c, lambda x: text.replaced(x, fixed.DOT_NOISE))
    c = text.where_lines(c, lambda x: ~text.is_banned(x, cfg.level, cfg.keep_words, cfg.banned))

    def fine(x):
        x = text.replaced(text.replaced(x, fixed.COLONS), fixed.DOT_LADDERS)
        return text.utrim(text.replaced(text.fixed_digits(text.replaced(x, fixed.DOT_NOISE)), fixed.BULLETS))

    c = text.without_adjacent_repeats(text.each_line(c, fine), cfg.keep_words)
    return L.implode_lines(t).select("doc_id", F.concat(text.utrim(c), F.lit("\n")).alias("text"))


EXPRESSIONS = {"noise_free": noise_free, "plain": plain, "dotted": dotted, "sentence_lines": sentence_lines, "sentence_lines_filtered": sentence_lines_filtered}
RELATIONS = {"structured": structured, "keyword_aware": keyword_aware}
