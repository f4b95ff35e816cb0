"""Text expressions: white space, ordered replacements, line rules inside one row.

All of them are Catalyst expressions over one row, so they neither shuffle nor leave
the JVM; only the decoding of files needs Python and goes through Arrow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed

Rules = Iterable[tuple[str, str]]
_WS = f"[{fixed.SPACES}]"
_NEWLINES = "\r\n?|[\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: classes over all of Unicode, and line feeds as the only line ends
_FLAGS = "(?Ud)"


def replaced(c, rules: Rules) -> Column:
    """The rules one after another; Java patterns, ``$1`` references."""
    c = col(c)
    for pattern, to in rules:
        c = F.regexp_replace(c, F.lit(_FLAGS + pattern), F.lit(to))
    return c


def found(c, pattern: str) -> Column:
    return col(c).rlike(_FLAGS + pattern)


def extract(c, pattern: str, group: int) -> Column:
    """The group of the first match; empty if there is none."""
    return F.regexp_extract(col(c), _FLAGS + pattern, group)


def extract_all(c, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(col(c), F.lit(_FLAGS + pattern), F.lit(group))


def utrim(c) -> Column:
    """Trim of all Unicode white space."""
    return F.btrim(col(c), F.lit(fixed.SPACES))


def rtrim(c) -> Column:
    return F.rtrim(col(c), F.lit(fixed.SPACES))


def collapse_key(c) -> Column:
    """Comparison key: white space collapsed and trimmed; null is empty."""
    return utrim(replaced(F.coalesce(col(c), F.lit("")), [(f"{_WS}+", " ")]))


def lines(c) -> Column:
    """Array of lines under all line ends; a last line end makes no empty line."""
    return F.split(replaced(c, [(_NEWLINES, "\n"), (r"\n\z", "")]), "\n", -1)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def each_line(c, f: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(lines(c), f), "\n")


def where_lines(c, keep: Callable) -> Column:
    return F.array_join(F.filter(lines(c), keep), "\n")


def any_of(patterns: Iterable[str]) -> str:
    """One alternation of many patterns."""
    return "|".join(f"(?:{p})" for p in patterns)


def literal(s: str) -> str:
    return "".join("\\" + ch if not (ch.isalnum() or ch.isspace() or ord(ch) > 127) else ch for ch in s)


def contains_any(c, words: Iterable[str]) -> Column:
    words = list(words)
    hit = found(c, any_of(map(literal, words))) if words else F.lit(False)
    # words that all need a character outside ASCII are not looked for where there is none
    return col(c).rlike(r"[^\x00-\x7F]") & hit if words and not any(w.isascii() for w in words) else hit


def without_chars(c, chars: str) -> Column:
    return F.translate(col(c), chars, "")


def n_removed(c, chars: str) -> Column:
    return F.length(col(c)) - F.length(without_chars(c, chars))


# --- Unicode ---------------------------------------------------------------------


def nfkc(c) -> Column:
    """NFKC by the ICU library that Spark ships; rows of ASCII alone are passed by.  The call counts as
    nondeterministic, so that merged projections do not repeat it."""
    c = col(c)
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    return F.when(c.rlike(r"[^\x00-\x7F]"), composed).otherwise(c)


def visible(c, chars: str = fixed.INVISIBLE) -> Column:
    return without_chars(nfkc(c), chars)


def converter(table: dict[str, str] | None) -> Callable[[Column], Column]:
    """Script conversion by a table of single characters; none: as it is."""
    if not table:
        return lambda c: c
    return lambda c: F.translate(c, "".join(table), "".join(table.values()))


def decode_bytes(raw: bytes, encodings=tuple(fixed.ENCODINGS)) -> tuple[str, str]:
    """(text, encoding) by the first encoding that reads all bytes; else UTF-8 without the bad ones."""
    for name in encodings:
        try:
            return raw.decode(name), name
        except (UnicodeDecodeError, UnicodeError):
            continue
    return raw.decode("utf-8", "ignore"), "utf-8(ignore)"


def decoder(encodings=tuple(fixed.ENCODINGS)):
    """Arrow function: binary -> struct(text, encoding)."""

    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("encoding", T.StringType())]))
    def decoded(raw: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if r is None else decode_bytes(bytes(r), encodings) for r in raw], columns=["text", "encoding"])

    return decoded


# --- line rules ------------------------------------------------------------------


def is_punct_only(c) -> Column:
    """No letter and no number; blank lines too."""
    return ~found(c, r"[\p{L}\p{N}]")


def is_symbols_only(c) -> Column:
    return found(c, rf"^{_WS}*[\p{{P}}\p{{S}}]+{_WS}*$")


def is_page_line(c) -> Column:
    return found(utrim(c), any_of(fixed.PAGE_LINE))


def is_noise_line(c) -> Column:
    """Noise characters alone, or up to three characters of which one at most is not noise."""
    s = utrim(c)
    core = replaced(s, [(f"[{fixed.NOISE_CHARS}]", "")])
    return (s != "") & (found(s, f"^[{fixed.NOISE_CHARS}]+$") | ((F.length(s) <= 3) & (F.length(core) <= 1)))


def must_keep(c, line_no, head: int = 30, patterns=tuple(fixed.KEEP_LINE)) -> Column:
    """A listed pattern, or a heading with a colon among the first ``head`` lines."""
    s = utrim(c)
    return (s != "") & (((line_no < head) & found(s, "[:：]") & found(s, f"^[{fixed.CJK}]")) | found(s, any_of(patterns)))


def is_banned(c, level: int = 1, keep=tuple(fixed.KEEP_WORDS), banned=tuple(fixed.BANNED_LINE)) -> Column:
    s = rtrim(c)
    bad = found(s, any_of(banned))
    if level >= 1:
        bad = bad | ((F.length(utrim(s)) <= 1) & ~found(s, f"[{fixed.CJK}]"))
    return bad & ~contains_any(s, keep)


def without_page_markers(c, pattern: str = fixed.PAGE_MARKER_STRICT) -> Column:
    return where_lines(c, lambda x: ~found(utrim(x), pattern))


def without_leading_dots(c, dots: str = r"\.．…") -> Column:
    return each_line(c, lambda x: replaced(x, [(rf"^{_WS}*[{dots}]+{_WS}*", "")]))


def without_inline_noise(c, rules=tuple(fixed.INLINE_NOISE), passes: int = 5) -> Column:
    """The rules over each line until they change nothing, ``passes`` times at most."""
    once = lambda x: utrim(replaced(x, rules))
    if passes == 1:
        return each_line(c, once)

    def step(acc, _):
        return F.when(acc["more"], let(once(acc["s"]), lambda n: F.struct(n.alias("s"), (n != acc["s"]).alias("more")))).otherwise(acc)

    start = lambda x: F.struct(x.alias("s"), F.lit(True).alias("more"))
    return each_line(c, lambda x: F.aggregate(F.sequence(F.lit(1), F.lit(passes)), start(x), step, lambda acc: acc["s"]))


def trimmed_lines(c) -> Column:
    """Trimmed lines that have a letter or number."""
    return F.array_join(F.filter(F.transform(lines(c), utrim), lambda x: ~is_punct_only(x)), "\n")


def adjacent_once(ls: Column, keep=tuple(fixed.KEEP_WORDS)) -> Column:
    """The lines without those that repeat the line before them; the keywords are looked for in repeats alone."""
    return F.filter(ls, lambda x, i: (i == 0) | (x != F.coalesce(F.get(ls, i - 1), F.lit(""))) | (x == "") | contains_any(x, keep))


def without_adjacent_repeats(c, keep=tuple(fixed.KEEP_WORDS)) -> Column:
    return F.array_join(let(lines(c), lambda ls: adjacent_once(ls, keep)), "\n")


def collapsed_blanks(c, most: int = 1) -> Column:
    return replaced(c, [(rf"(?m)^[{fixed.SPACES.replace(chr(10), '')}]+$", ""), (r"\n{%d,}" % (most + 2), "\n" * (most + 1))])


# --- joining lines: a line end goes where its two neighbours allow it ---------------


def joined_soft_wraps(c) -> Column:
    """Lines joined unless one ends a sentence, the next heads a paragraph, or either is blank;
    nothing between CJK characters, else a space; a hyphen at a line's end goes."""
    blank = " \t"
    head = fixed.PARAGRAPH_HEAD.removeprefix("^")
    c = replaced(c, [(rf"[{blank}]+(?=\n)", ""), (rf"(?<=[A-Za-z])-\n[{blank}]*(?=[^\n])", "")])
    stop = rf"\n(?<=[^\n{fixed.END_PUNC}\s]\n)(?!{head})[{blank}]*"
    return replaced(c, [(rf"\n(?<=[{fixed.CJK}]\n)(?!{head})[{blank}]*(?=[{fixed.CJK}])", ""), (stop + r"(?=[^\n])", " ")])


def joined_hard_wraps(c) -> Column:
    """Lines joined by a space unless one ends with punctuation or the next is a bullet;
    every blank line inside leaves one space more."""
    end = fixed.WRAP_END.removesuffix("$")
    bullet = fixed.WRAP_BULLET.removeprefix("^")
    c = replaced(c, [(r"[ \t]+(?=\n)|[ \t]+\z", ""), (r"\A\n+", "")])
    # the first line end of a run decides, the others follow it
    join = rf"(?:(?<=[^\n])(?<!{end})(?=\n++(?!{bullet})(?!\z))|(?!\A)\G)\n[ \t]*"
    return replaced(c, [(join, " "), (r"\n{2,}", "\n"), (r"\n+\z", "")])


def joined_broken_lines(c) -> Column:
    """A line is glued to the next unless it ends a sentence, the next heads a section, or either is blank."""
    head = fixed.SECTION_HEAD.removeprefix("^")
    c = each_line(c, utrim)
    # no trimmed line ends with a tab, so one marks the ends of sentences
    return replaced(c, [(rf"({fixed.SENTENCE_END}[{fixed.CLOSERS}]*+)\n", "$1\t\n"), (rf"\n(?<!\n\n|\A\n|\t\n)(?!{head})(?=[^\n])", " "), (r"\t\n", "\n")])


# --- characters and tokens ----------------------------------------------------------


def fixed_digits(c, need_digit: bool = True) -> Column:
    """Letters that look like digits, in tokens of ASCII characters (that hold a digit)."""
    digit = r"(?=\S*[0-9])" if need_digit else ""
    pieces = F.split(col(c), r"(?<=\s)(?=\S)|(?<=\S)(?=\s)", -1)
    plain = rf"^{digit}[\x21-\x7E：﹕，、]+$"
    core = r"[^,./\\:：﹕，、\s-]"
    return F.array_join(F.transform(pieces, lambda t: F.when(found(t, plain) & found(t, core), F.translate(t, *fixed.LOOKALIKES)).otherwise(t)), "")


def squeezed(c) -> Column:
    return utrim(replaced(nfkc(c), [("[ \t\u3000]+", " ")]))


def scrubbed(c) -> Column:
    """Control and format characters become spaces; line ends stay."""
    return utrim(replaced(c, fixed.CONTROLS))


def punctuated(c) -> Column:
    return replaced(c, fixed.PUNCTUATION)


def sentences(c, end: str = fixed.SENTENCE_END, closers: str = fixed.CLOSERS, stop: str = "。", long: int = 25) -> Column:
    """Array of sentences; a long piece without an end mark gets one, pieces of punctuation go."""
    paragraphs = F.transform(F.split(replaced(c, [("[ \t]+", " ")]), "\n", -1), utrim)
    pieces = F.flatten(F.transform(paragraphs, lambda p: F.split(replaced(p, [(f"({end}[{closers}]*+) ", "$1\n")]), "\n", -1)))
    pieces = F.transform(pieces, utrim)
    marked = F.transform(pieces, lambda s: F.when(~found(s, f"{end}[{closers}]*$") & (F.length(s) >= long), F.concat(s, F.lit(stop))).otherwise(s))
    return F.filter(marked, lambda s: utrim(replaced(s, [(r"\p{P}+", "")])) != "")


def ended(s: Column, careful: bool = True, stop: str = "。") -> Column:
    """A stop behind a sentence that has none; headings stay, and so (careful) do
    brackets, numbered ids and number words."""
    done = found(s, fixed.SECTION_HEAD) | found(s, "[。！？；!?]$")
    if careful:
        done = done | found(s, "[：）】」』]$") | found(s, "身分證|統一編號") | found(s, "(號|号)$")
    return F.when(done, s).otherwise(F.concat(s, F.lit(stop)))


def corrected(c) -> Column:
    """Frequent recognition errors and variants of colons, spaces and dashes."""
    c = col(c)
    for a, b in fixed.CORRECTIONS:
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    kept = F.filter(F.transform(F.split(c, "\n", -1), utrim), lambda s: ~found(s, fixed.SEPARATOR_LINE))
    return F.array_join(F.transform(kept, lambda s: replaced(s, [(r"^\s*\(?\d{1,3}\)?\s+", "")])), "\n")


def with_enumerators(c) -> Column:
    return replaced(c, fixed.ENUMERATORS)


def masked_terms(c, terms=tuple(fixed.LABEL_TERMS), mask: str = "[MASK]") -> Column:
    return replaced(c, [(any_of(terms), mask)])


def short(c, n: int) -> Column:
    s = F.replace(utrim(F.coalesce(col(c), F.lit(""))), F.lit("\n"), F.lit(" "))
    return F.when(F.length(s) <= n, s).otherwise(F.concat(F.substring(s, 1, n), F.lit("…")))


def html(c) -> Column:
    c = F.coalesce(col(c), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def highlighted(c, words: list[str]) -> Column:
    return replaced(c, [(f"(?i){any_of(map(literal, words))}", "<mark>$0</mark>")]) if words else col(c)


def has_all_words(c, query: str) -> Column:
    low = F.lower(col(c))
    out = F.lit(True)
    for w in query.lower().split():
        out = out & F.contains(low, F.lit(w))
    return out


def detection_text(c) -> Column:
    return replaced(c, fixed.DETECTION_REMOVE)
