"""Column expressions for titles, tokens, numbers held as text, and facts found in captions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about what a table is about.
STOP_WORDS = ("a", "an", "the", "of", "and", "or", "by", "for", "in", "on", "to", "with", "as", "at", "from", "per", "no", "sl", "nos", "table", "statement")
# Words that tell apart variants of one table.
VARIANT_WORDS = ("urban", "rural", "all", "total", "male", "female", "others", "other")
# How a missing figure is written.
PLACEHOLDERS = ("", "-", "--", "—", "–", "na", "n.a.", "n/a", "nil", "..", "...")


def base_title(title: Column) -> Column:
    """The title without a trailing bracketed scope, white space collapsed, in capitals."""
    short = F.upper(F.trim(F.regexp_replace(F.regexp_replace(title, r"\s*\([^()]*\)\s*$", ""), r"\s+", " ")))
    return F.when(short == "", F.upper(F.trim(title))).otherwise(short)


def title_tokens(title: Column) -> Column:
    """Distinct lower-case tokens of three characters or more that aren't stop words, variants or numbers."""
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(title), F.lit("([a-z0-9]+)"), 1))
    return F.filter(tokens, lambda t: (F.length(t) >= 3) & ~t.isin(*STOP_WORDS, *VARIANT_WORDS) & ~t.rlike("^[0-9]+$"))


def slug(name: Column) -> Column:
    """A name with white space, underscores, dots, slashes and dashes taken out, in lower case."""
    return F.lower(F.regexp_replace(name, r"[\s_\-./]", ""))


def is_placeholder(cell: Column) -> Column:
    return cell.isNull() | F.lower(F.trim(cell)).isin(*PLACEHOLDERS)


def is_numeric(cell: Column) -> Column:
    """Whether a cell reads as a number once commas, stars, one percent sign and brackets are gone."""
    bare = F.regexp_replace(F.trim(cell), r"[,*%()]", "")
    return ~is_placeholder(cell) & F.coalesce(bare.rlike(r"^[-+]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][-+]?[0-9]+)?$"), F.lit(False))


def is_plain_number(cell: Column) -> Column:
    """The stricter reading used in classification: digits with at most one decimal mark."""
    return F.regexp_replace(cell, ",", "").rlike(r"^[-+]?[0-9]+([.,][0-9]+)?$")


def years_in(text: Column) -> Column:
    """Every year from 1900 to 2099 in a text, in order."""
    return F.regexp_extract_all(text, F.lit(r"\b((?:19|20)[0-9]{2})\b"), 1)


def unit_in(text: Column) -> Column:
    """The last bracketed remark of a text; null without one."""
    found = F.regexp_extract(text, r"\(([^()]+)\)\s*$", 1)
    return F.when(found != "", found)


def like_needle(needle: str) -> str:
    """A needle for ilike in which % and _ stay wildcards and a backslash is itself."""
    return "%" + needle.replace("\\", "\\\\") + "%"


def occupation_key(label: Column) -> Column:
    """A label in lower case with anything but ASCII letters and digits as single blanks; empty for null."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), r"[^a-z0-9\s]", " "), r"\s+", " "))


def is_hierarchy_code(code: Column) -> Column:
    """Whether a code has one to four digits, and further ones behind dots."""
    return F.coalesce(F.trim(code).rlike(r"^[0-9]{1,4}(\.[0-9]+)*$"), F.lit(False))


def id_key(raw: Column) -> Column:
    """An id's capitals and digits."""
    return F.regexp_replace(F.upper(F.coalesce(raw, F.lit(""))), "[^A-Z0-9]", "")


def id_stem(raw: Column) -> Column:
    """id_key without a trailing year and version."""
    return id_key(F.regexp_replace(F.upper(raw), r"_[0-9]{4}_[A-Z0-9]+$", ""))


def inventory_code(raw: Column) -> Column:
    """A printed table number without the word for table and bracketed remarks; bracketed numbers stay."""
    bare = F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(raw, F.lit(""))), "TABLE", ""), r"\([^)0-9][^)]*\)", "")
    return F.regexp_replace(bare, "[^A-Z0-9&]", "")
