"""Text rewriting as column expressions.

Every function maps a string column to a string (or array) column and stays
inside the JVM; only compatibility folding calls Python, and only for rows
that contain characters it can change.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .unicode import nfkc

SPACE = r"[\s\x1c-\x1f]"  # used with (?U)


class Signs(NamedTuple):
    """The classes of characters that the language rules and formats ask for."""

    flag: str
    space: str
    other: str  # no space
    letter: str
    start: str  # of a word
    end: str

    def of(self, pattern: str) -> str:
        """A fixed pattern with these classes."""
        return self.flag + pattern.replace(r"\w", self.letter).replace(r"\b", self.end)


UNICODE = Signs("(?U)", SPACE, r"[^\s\x1c-\x1f]", r"\w", r"\b", r"\b")
#: Spaces, digits and edges of words as DuckDB's patterns have them; what may stand before a day is any letter.
ASCII = Signs("", r"\s", r"\S", r"[\p{L}\p{N}_]", r"(?<!\w)", r"(?!\w)")


def collapse_spaces(text: Column) -> Column:
    """One space for each run of white space; single spaces, nearly all runs, are left as they are."""
    return F.trim(F.regexp_replace(text, rf"(?U)(?:[\s\x1c-\x1f&&[^ ]]| {SPACE}){SPACE}*", " "))


#: Blanks of any width, cut off at both ends.
BLANKS = " \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def collapse_ascii(text: Column) -> Column:
    """One space for each run of ASCII white space, blanks of any width cut off at the ends; all else stays as it is."""
    return F.btrim(F.regexp_replace(text, r"(?:[\t\n\r\x0b\f]| [ \t\n\r\x0b\f])[ \t\n\r\x0b\f]*", " "), F.lit(BLANKS))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def gated(text: Column, cue: Callable[[Column], Column], rule: Callable[[Column], Column]) -> Column:
    """``rule(text)`` where ``cue(text)`` holds, else ``text``: rules whose fixed part is not there are not tried.

    ``cue`` has to hold wherever ``rule`` can change anything.
    """
    return bound(text, lambda value: F.when(cue(value), rule(value)).otherwise(value))


def has(*literals: str) -> Callable[[Column], Column]:
    """Whether a text contains one of ``literals``."""

    def cue(value: Column) -> Column:
        found = [F.contains(value, F.lit(x)) for x in literals]
        out = found[0]
        for x in found[1:]:
            out = out | x
        return out

    return cue


def rewrite_hits(text: Column, pattern: str, fix: Callable[[Column], Column]) -> Column:
    """Replace each match of ``pattern`` by ``fix`` of it; linear in the text."""

    def woven(value: Column) -> Column:
        hits = F.transform(F.regexp_extract_all(value, F.lit(pattern), F.lit(0)), fix)
        parts = F.zip_with(F.split(value, pattern, -1), hits, lambda gap, hit: F.concat(gap, F.coalesce(hit, F.lit(""))))
        return F.array_join(parts, "")

    return bound(text, woven)


#: An address begins where its run of characters does or the last match ended, so long runs are read once.
ADDRESS = r"(?:\G|(?<![a-zA-Z0-9_.+-]))" + fixed.EMAIL_CASE


def lower_email_tail(text: Column) -> Column:
    """Lower-case what follows the first dot of each address's domain."""

    def fix(hit: Column) -> Column:
        head = F.regexp_extract(hit, r"^[^@]*@[^.]*\.", 0)
        return F.concat(head, F.lower(F.substr(hit, F.length(head) + 1)))

    return gated(text, has("@"), lambda value: rewrite_hits(value, ADDRESS, fix))


def normalize_folded(text: Column) -> Column:
    """The part of the common clean-up that follows compatibility folding."""
    return lower_email_tail(collapse_spaces(text))


def normalize_common(text: Column) -> Column:
    return normalize_folded(nfkc(text))


def ascii_digits(text: Column) -> Column:
    return F.translate(text, fixed.FULLWIDTH_DIGITS, fixed.ASCII_DIGITS)


def plain_dots(text: Column) -> Column:
    return F.translate(text, fixed.MIDDLE_DOTS, "・" * len(fixed.MIDDLE_DOTS))


def japanese(text: Column, signs: Signs = UNICODE) -> Column:
    return F.regexp_replace(
        ascii_digits(plain_dots(text)), rf"{signs.flag}(?<=[。．！？]){signs.space}*(?={signs.other})", "\n"
    )


def korean(text: Column, signs: Signs = UNICODE) -> Column:
    glued = F.regexp_replace(
        ascii_digits(text), rf"{signs.flag}([가-힣]){signs.space}+({fixed.KOREAN_PARTICLES})", "$1$2"
    )
    return F.regexp_replace(glued, rf"{signs.flag}(?<=[.!?]){signs.space}+(?={signs.other})", "\n")


def _capital(letter: Column) -> Column:
    """The capital of one letter: one letter too, as in the SQL."""
    single = F.translate(letter, fixed.SINGLE_CAPITALS[0], fixed.SINGLE_CAPITALS[1])
    upper = F.upper(single)
    return F.when(F.length(upper) == F.length(single), upper).otherwise(single)


def capitals(text: Column, signs: Signs = UNICODE) -> Column:
    """Sentences begin with a capital and stand one space apart."""
    sentences = F.split(text, rf"{signs.flag}(?<=[.!?]){signs.space}+")
    capital = F.transform(
        sentences, lambda s: F.concat(_capital(F.substring(s, 1, 1)), F.substr(s, F.lit(2)))
    )
    return F.array_join(capital, " ")


def english(text: Column, signs: Signs = UNICODE) -> Column:
    def terms(value: Column) -> Column:
        for wrong, right in fixed.ENGLISH_TERMS.items():
            value = F.regexp_replace(value, rf"{signs.flag}{signs.start}{re.escape(wrong)}(?!\w)", right)
        return value

    return gated(capitals(text, signs), has(*fixed.ENGLISH_TERMS), terms)


def chinese(text: Column, signs: Signs = UNICODE) -> Column:
    return F.regexp_replace(plain_dots(ascii_digits(text)), rf"{signs.flag}。{signs.space}*", "。\n")


def _grouped(digits: Column) -> Column:
    """``1234567`` to ``1,234,567``, for any number of digits."""
    return F.reverse(F.regexp_replace(F.reverse(digits), "([0-9]{3})(?=[0-9])", "$1,"))


def _amount(text: Column, pattern: str, before: str, after: str) -> Column:
    """Rewrite runs of four or more digits at a currency sign: no leading zeros, digits in groups."""

    def fix(hit: Column) -> Column:
        digits = F.regexp_extract(hit, "[0-9]+", 0)
        return F.concat(F.lit(before), _grouped(F.regexp_replace(digits, "^0+(?=[0-9])", "")), F.lit(after))

    return rewrite_hits(text, pattern, fix)


def _format_cue(kind: str, pattern: str, signs: Signs) -> Callable[[Column], Column]:
    """What a text must hold before a format rule can change it."""
    if kind in ("prefix_amount", "suffix_amount"):
        return has(pattern)
    for sign in ("年", "년", "〒", "식", "Inc", "Corp", "Ltd", "LLC", "LLP"):
        if sign in pattern:
            return has(sign)
    if kind == "company":
        return has(pattern)
    if kind == "registration":
        return lambda value: value.rlike(signs.flag + r"\d{5}")
    return has("/") if ")/(" in pattern else lambda value: value.rlike(signs.flag + r"\d[./,-]")


def business_formats(text: Column, lang: str, signs: Signs = UNICODE) -> Column:
    """Fold the language's ordered format rules into one expression; a rule is tried only where its fixed part stands."""
    out, rules = text, fixed.BUSINESS_FORMATS.get(lang, [])
    for kind, pattern, replacement in rules:
        out = gated(out, _format_cue(kind, pattern, signs), _format_rule(kind, pattern, replacement, signs))
    return out


def _format_rule(kind: str, pattern: str, replacement: str, signs: Signs = UNICODE) -> Callable[[Column], Column]:
    if kind == "prefix_amount":
        return lambda v: _amount(v, rf"{signs.flag}{re.escape(pattern)}{signs.space}*[0-9]{{4,}}", pattern, "")
    if kind == "suffix_amount":
        return lambda v: _amount(v, rf"{signs.flag}(?<![0-9])[0-9]{{4,}}+{signs.space}*{pattern}", "", replacement + pattern)
    return lambda v: F.regexp_replace(v, signs.of(pattern), replacement)


LANGUAGE_RULES = {
    "jpn": japanese,
    "kor": korean,
    "eng": english,
    "chi_sim": chinese,
    "chi_tra": chinese,
}


def steps(signs: Signs = UNICODE) -> dict[str, Callable[[Column], Column]]:
    """Rules and business formats of every language."""
    return {code: lambda value, code=code, rule=rule: business_formats(rule(value, signs), code, signs) for code, rule in LANGUAGE_RULES.items()}


def language_steps(text: Column, lang: Column, rules: dict[str, Callable[[Column], Column]] | None = None) -> Column:
    """The language's ``rules`` for already commonly normalised text: its rules and business formats unless others are given."""
    lang = F.coalesce(lang, F.lit("eng"))

    def chosen(value: Column) -> Column:
        branches = F
        for code, rule in (steps() if rules is None else rules).items():
            branches = branches.when(lang == code, rule(value))
        return value if branches is F else branches.otherwise(value)

    return bound(text, chosen)


def split_sentences(text: Column, lang: Column) -> Column:
    """Sentences of a text; languages without a rule of their own use the English one."""
    branches = None
    for code, rule in fixed.SENTENCE_BREAKS.items():
        parts = F.split(text, "(?U)" + rule, -1)
        branches = F.when(lang == code, parts) if branches is None else branches.when(lang == code, parts)
    other = F.split(text, "(?U)" + fixed.SENTENCE_BREAKS["eng"], -1)
    return F.when(F.length(text) > 0, branches.otherwise(other))


def chunks(text: Column, size: int = 1000, overlap: int = 100) -> Column:
    """Array of (start, chunk) windows; the last window is the first to reach the end."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than the chunk size")
    length, step = F.length(text), size - overlap
    count = F.when(length <= size, 1).otherwise(F.ceil((length - overlap) / step)).cast("int")
    starts = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: i * step)
    windows = F.transform(
        starts,
        lambda s: F.struct(s.alias("start"), F.substr(text, s + 1, F.lit(size)).alias("chunk")),
    )
    return F.when(length > 0, windows)


def strip_markup(html: Column) -> Column:
    out = F.regexp_replace(html, "<[^>]*>", "")
    for raw, escaped in fixed.HTML_ESCAPES:
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return out


EXTENSION = r"(?s)^(?:.*/)?\.*[^./][^/]*(\.[^./]*)$"


def extension(name: Column) -> Column:
    """Lower-cased extension with its dot; leading dots start a name, not an extension."""
    return F.lower(F.regexp_extract(name, EXTENSION, 1))


def clean_stem(name: Column) -> Column:
    """Stem of a file name without illegal characters and spaces; empty if nothing is left."""
    stem = F.substr(name, F.lit(1), F.length(name) - F.length(F.regexp_extract(name, EXTENSION, 1)))
    stem = F.regexp_replace(stem, r'[\\/*?:"<>|]', "")
    stem = F.regexp_replace(stem, rf"(?U){SPACE}+", "_")
    return F.regexp_replace(stem, "_+", "_")


def safe_file_name(name: Column, max_chars: int = fixed.MAX_NAME_CHARS) -> Column:
    """Clean stem of at most ``max_chars`` and the extension; a name without a stem gets one from its hash."""
    stem = F.substring(clean_stem(name), 1, max_chars)
    fallback = F.concat(F.lit("file_"), F.substring(F.md5(name.cast("binary")), 1, 12))
    return F.concat(F.when(stem == "", fallback).otherwise(stem), F.regexp_extract(name, EXTENSION, 1))


def readable_size(size: Column) -> Column:
    """``1536`` to ``1.50 KB``; a size moves up a unit only when strictly above 1024."""
    out = F
    for power, unit in enumerate(fixed.SIZE_UNITS):
        scaled = size.cast("double") / float(1024**power)
        text = F.format_string(f"%.2f {unit}", F.bround(scaled, 2))
        if power == len(fixed.SIZE_UNITS) - 1:
            return out.otherwise(text)
        out = out.when(scaled <= 1024, text)
    return out
