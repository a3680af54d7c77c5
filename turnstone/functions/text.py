"""String expressions shared by the operators; the SQL twins are used by the registry's oracle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space when texts are trimmed: all of Unicode's, and the four ASCII separators.
BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TAGS = ["decision", "preference", "gotcha", "config", "architecture", "project"]
DEFAULT_TAG = "project"
LETTERS = r"(\p{L}+)"
KEYWORD = r"(\p{L}{4,})"


def strip(text: Column) -> Column:
    """Without blanks at both ends; only a text that has one there is searched as a whole."""
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    return F.when(ends.rlike(BLANK), F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")).otherwise(text)


def dedup_key(text: Column) -> Column:
    return F.lower(strip(text))


def normalize_keyword(text: Column) -> Column:
    return F.regexp_replace(dedup_key(text), f"{BLANK}+", "-")


def clean_keywords(words: Column) -> Column:
    """Normalised, without blanks and repeats, in the order given."""
    return F.array_distinct(F.filter(F.transform(words, normalize_keyword), lambda w: w.isNotNull() & (w != "")))


def clean_terms(terms: Column) -> Column:
    """Search terms: trimmed and lower-cased only, so a term with inner blanks matches no stored keyword."""
    return F.filter(F.transform(terms, dedup_key), lambda w: w.isNotNull() & (w != ""))


def coerce_tag(tag: Column) -> Column:
    known = dedup_key(tag)
    return F.when(known.isin(TAGS), known).otherwise(F.lit(DEFAULT_TAG))


def clean_project(raw: Column) -> Column:
    """`-home-user-rest` becomes `rest`, `-home-user` becomes `home`, all else stays."""
    pieces = F.split(F.regexp_replace(raw, "^-+|-+$", ""), "-")
    rest = F.array_join(F.slice(pieces, 3, F.greatest(F.size(pieces) - 2, F.lit(0))), "-")
    return F.when((F.size(pieces) >= 2) & (F.get(pieces, F.lit(0)) == "home"), F.when(rest == "", F.lit("home")).otherwise(rest)).otherwise(raw)


def project_of_path(path: Column) -> Column:
    return clean_project(F.concat(F.lit("-"), F.regexp_replace(F.regexp_replace(path, "^/+", ""), "/", "-")))


def tokens(text: Column) -> Column:
    """Runs of letters, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(LETTERS), F.lit(1))


def keyword_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(KEYWORD), F.lit(1))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, f"{BLANK}+"), lambda w: w != "")).cast("long")


def cut_at_word(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.regexp_replace(F.left(text, F.lit(most)), " [^ ]*$", ""), F.lit("…"))).otherwise(text)


def plural_tag(tag: Column, count: Column) -> Column:
    return F.when(count == 1, tag).when(tag == "architecture", F.lit("architecture notes")).otherwise(F.concat(tag, F.lit("s")))


def age(seconds: Column) -> Column:
    """`n seconds/minutes/hours/days ago`, one second at least."""
    s = F.floor(seconds)
    n = F.when(s < 60, F.greatest(s, F.lit(1))).when(s < 3600, F.floor(s / 60)).when(s < 86400, F.floor(s / 3600)).otherwise(F.floor(s / 86400)).cast("long")
    unit = F.when(s < 60, F.lit("second")).when(s < 3600, F.lit("minute")).when(s < 86400, F.lit("hour")).otherwise(F.lit("day"))
    return F.concat(n.cast("string"), F.lit(" "), unit, F.when(n == 1, F.lit("")).otherwise(F.lit("s")), F.lit(" ago"))


def whole_numbers(raw: Column) -> Column:
    """An array of texts as longs: decimals lose their fraction, what is no number goes."""
    return F.filter(F.transform(raw, lambda x: x.try_cast("double").try_cast("long")), lambda x: x.isNotNull())


def thousands(number: Column) -> Column:
    return F.format_number(number, 0)
