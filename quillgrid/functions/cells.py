"""Column expressions for single cells of printed grids: their text, whether they hold a number, a code or a label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed pattern: how a reader writes a missing cell.
MISSING = r"(?i)^(?:nan|none|<na>)\z"
# The longest code under a spanning header, the least count that can't be a code, and the years that are codes.
CODE_LENGTH, COUNT_FROM, YEARS = 24, 100, (1800, 2100)
# Fixed patterns: what a table's own number looks like as a banner, and open codes as >8 or 5+.
TABLE_NUMBER = r"(?i)^(?:table\s*[:.\-–—]?\s*[a-z0-9][\w\s.\-–—/]*|statement\s*[:.\-–—]?\s*[0-9]+|annex(?:ure)?\s*[:.\-–—]?\s*[a-z0-9]+)$"
OPEN_CODE = r"^[<>]=?[0-9]+\+?$|^[0-9]+\+$"
#: A number in plain or exponent notation.
NUMBER = r"^([-+]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)\z"


def canonical(cell: Column) -> Column:
    """A cell's text with single blanks; empty for null and for the ways a missing cell is written."""
    text = F.trim(F.regexp_replace(F.coalesce(cell, F.lit("")), r"\s+", " "))
    return F.regexp_replace(text, MISSING, "")


def bare_number(text: Column) -> Column:
    """A canonical text without thousands marks, percent signs, stars and one pair of brackets around it."""
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(text, "[,%*]", "")), r"^\((.+)\)$\R?", "$1"))


def size_of(text: Column) -> Column:
    """The absolute value of a canonical text that is a number; null for any other."""
    return F.abs(F.regexp_extract(bare_number(text), NUMBER, 1).try_cast("double"))


def is_year(text: Column) -> Column:
    plain = F.regexp_replace(text, ",", "")
    return plain.rlike(r"^[0-9]{4}$") & plain.try_cast("int").between(*YEARS)


def is_count(text: Column) -> Column:
    """Whether a canonical text is a figure that belongs into the body: large, or with decimals; years aren't."""
    size = size_of(text)
    decimal = bare_number(text).rlike(r"^[0-9]+\.[0-9]+$") & (size >= 1)
    return F.coalesce(~is_year(text) & ((size >= COUNT_FROM) | decimal), F.lit(False))


def is_code(text: Column) -> Column:
    """Whether a canonical text can stand for a column below a spanning header: short, and no count or zero."""
    open_ = F.replace(text, F.lit(" "), F.lit("")).rlike(OPEN_CODE)
    small = F.coalesce(size_of(text) > 0, F.lit(True))
    return (text != "") & (F.length(text) <= CODE_LENGTH) & (is_year(text) | (~is_count(text) & (open_ | small)))
