"""Column expressions for captions and titles: doubled letters, broken characters, lists of columns, and what is wrong with an id or title."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgrid.functions.stacks import let, steps

# Fixed patterns: the word for table before its number, serial headers, and characters that fonts or encodings have broken.
TABLE_WORD, SERIAL_WORD = r"(?i)\bTABLE[\s:\-]", r"(?i)\bSL\.?\s*NO\.?\b"
BROKEN = "[\ue000-\uf8ff\ufffd]|[\u00c0-\u00ff][\u0080-\u00bf]"
# Marks behind which a title may list columns, in the order in which they are looked for; the longest title.
DASHES, LONGEST = (" — ", " – ", " —", " –"), 220


def one_blank(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def is_garbled(text: Column) -> Column:
    """Whether a text holds private glyphs, replacement characters or bytes read in the wrong encoding."""
    return F.coalesce(text.rlike(BROKEN), F.lit(False))


def undoubled(text: Column) -> Column:
    """A text of which each letter is printed twice, with single letters; any other as it is.

    Doubled is a text of six letters or more of which four fifths stand in pairs of equal letters, without regard to case.
    """

    def of(x: Column) -> Column:
        letters = x["letters"]
        paired = F.aggregate(F.regexp_extract_all(letters, F.lit(r"(\p{L})\1*"), 0), F.lit(0), lambda n, r: n + F.length(r) - F.length(r) % 2)
        return F.when((F.length(letters) >= 6) & (paired >= 0.8 * F.length(letters)), F.regexp_replace(x["text"], r"(?iu)(\p{L})\1", "$1")).otherwise(x["text"])

    return steps({"text": text}, lambda x: {"text": x["text"], "letters": F.lower(F.regexp_replace(x["text"], r"[^\p{L}]", ""))}, body=of)


def is_column_list(text: Column) -> Column:
    """Whether a text lists columns: two parts or more, all but one short, in 160 characters."""

    def of(x: Column) -> Column:
        short = F.size(F.filter(x["parts"], lambda p: (F.length(p) <= 40) & (F.size(F.split(p, " ")) <= 5)))
        return (F.length(x["said"]) <= 160) & (F.size(x["parts"]) >= 2) & (short >= F.greatest(F.lit(2), F.size(x["parts"]) - 1))

    def parts(said: Column) -> Column:
        return F.filter(F.transform(F.split(said, "[,;/|]"), lambda p: F.trim(p)), lambda p: p != "")

    return steps({"said": one_blank(text)}, lambda x: {"said": x["said"], "parts": parts(x["said"])}, body=of)


def told_names(columns: Column) -> Column:
    """The names of columns in capitals, without those of fewer than three characters."""
    return F.filter(F.transform(F.coalesce(columns, F.array().cast("array<string>")), lambda c: F.upper(F.trim(c))), lambda c: F.length(c) >= 3)


def reads_as_headers(title: Column, columns: Column) -> Column:
    """Whether a title is really a table's number, a serial header, or names of half its first columns."""
    return let({"said": F.upper(one_blank(title)), "names": told_names(columns)}, lambda x: names_headers(x["said"], x["names"]))


def names_headers(said: Column, names: Column) -> Column:
    """reads_as_headers() for a title and names in capitals."""
    first = F.slice(names, 1, 6)
    hits = F.size(F.filter(first, lambda c: F.contains(said, c)))
    listed = (F.size(names) >= 2) & (hits >= F.greatest(F.lit(2), F.floor(0.5 * F.least(F.lit(4), F.size(first)))))
    return (said != "") & ((said.rlike(TABLE_WORD) & (F.length(said) < 40)) | said.rlike(SERIAL_WORD) | listed)


def normal_title(title: Column, columns: Column) -> Column:
    """A title with single blanks and letters, without a list of columns behind a dash; empty where it is nothing but that.

    Beyond 220 characters a title ends at a dash after twelve or more, else at a word. Each step is computed once, however
    often the next one reads it.
    """

    def dashed(x: Column) -> dict[str, Column]:
        dash = F.lit(None).cast("string")
        for mark in reversed(DASHES):
            dash = F.when(F.contains(x["said"], F.lit(mark)), mark).otherwise(dash)
        return {"said": x["said"], "names": x["names"], "dash": dash}

    def halved(x: Column) -> dict[str, Column]:
        at = F.instr(x["said"], x["dash"])
        left, right = F.trim(F.substring(x["said"], F.lit(1), at - 1)), F.trim(F.substring(x["said"], at + F.length(x["dash"]), F.length(x["said"])))
        return {"said": x["said"], "names": x["names"], "left": left, "right": right}

    def shortened(x: Column) -> dict[str, Column]:
        long = (F.length(x["said"]) > LONGEST) & (F.length(x["left"]) >= 12)
        drop = (x["left"] != "") & (long | headed(x["right"], x["names"]) | is_column_list(x["right"]))
        return {"kept": F.when(F.coalesce(drop, F.lit(False)), x["left"]).otherwise(x["said"]), "names": x["names"]}

    def headed(t: Column, names: Column) -> Column:
        return let({"said": F.upper(one_blank(t))}, lambda x: names_headers(x["said"], names))

    def at_a_word(x: Column) -> dict[str, Column]:
        cut = F.left(x["kept"], F.lit(LONGEST))
        return {"kept": x["kept"], "cut": cut, "word": F.regexp_replace(cut, r"\s\S*$", ""), "none": headed(x["kept"], x["names"]) | is_column_list(x["kept"])}

    def ended(x: Column) -> Column:
        whole = F.when(F.contains(x["cut"], F.lit(" ")), x["word"]).otherwise(x["cut"])
        short = F.when(F.length(whole) >= 20, F.regexp_replace(whole, r"[ ,;:—–-]+$", "")).otherwise(F.rtrim(x["cut"]))
        return F.when(x["none"], "").when(F.length(x["kept"]) > LONGEST, short).otherwise(x["kept"])

    return steps({"said": undoubled(one_blank(title)), "names": told_names(columns)}, dashed, halved, shortened, at_a_word, body=ended)


def id_title_issues(table_id: Column, title: Column) -> Column:
    """What is wrong with a table's id and title, as an array of texts: missing, swapped, or an id without the word for table."""
    own, said = F.trim(F.coalesce(table_id, F.lit(""))), F.trim(F.coalesce(title, F.lit("")))
    marked, title_marked = own.rlike(TABLE_WORD), said.rlike(TABLE_WORD)
    missing = F.when((own == "") & (said == ""), "id and title missing").when(own == "", "id missing").when(said == "", "title missing")
    swapped = F.when((own != "") & (said != "") & title_marked & ~marked, "id and title swapped")
    bare = F.when((own != "") & ~marked & ~title_marked, "id without table")
    return F.filter(F.array(missing, swapped, bare), lambda x: x.isNotNull())
