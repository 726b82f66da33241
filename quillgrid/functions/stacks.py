"""Column expressions for cells in which a reader has stacked the lines of several rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgrid.functions import cells as C

# Fixed patterns: words at a line's end that want another line, and beginnings of titles that stand for themselves.
HANGING = r"(?i)(?:&\s*miliary|&|and|of|the|or|to|as|for|with|by|from|in|elsewhere|presumed?|advers|not)\s*$"
TITLE_STARTS = r"^(?:All |Other |Total|INFECTIOUS|NEOPLASMS|Malignant)"
JOINING_ENDS = r"(?:,|-|&|/|to|and|of|the|or|as)$"
NOTHING = "array<string>"


def let(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """body(values as a struct), with each value computed and written down once however often body uses it."""
    return F.get(F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), body), F.lit(0))


def steps(values: dict[str, Column], *more: Callable[[Column], dict[str, Column]], body: Callable[[Column], Column]) -> Column:
    """body of the last of some structs, each made of the one before and computed once.

    The steps stand one after another, not one within another as nested let() would: Spark asks for the types of nested
    functions again at each level, which takes time that doubles and more with every level.
    """
    at = F.array(F.struct(*(v.alias(k) for k, v in values.items())))
    for step in more:
        at = F.transform(at, made_of(step))
    return F.get(F.transform(at, body), F.lit(0))


def made_of(step: Callable[[Column], dict[str, Column]]) -> Callable[[Column], Column]:
    return lambda x: F.struct(*(v.alias(k) for k, v in step(x).items()))


def none() -> Column:
    return F.array().cast(NOTHING)


def lines(cell: Column) -> Column:
    """The trimmed lines of a cell that aren't blank."""
    return F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(cell, F.lit("")), "\r\n?", "\n"), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def n_words(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))


def is_number(text: Column) -> Column:
    return C.size_of(C.canonical(text)).isNotNull()


def is_share(text: Column) -> Column:
    return C.canonical(text).rlike(r"^\*?\(\s*[-+]?[0-9]+(?:[.,][0-9]+)?\s*%?\s*\)$")


def measures(cell: Column) -> Column:
    """The lines of a cell, a share in brackets together with the figure right above it."""
    def told(x: Column) -> dict[str, Column]:
        return {"parts": x["parts"], "share": F.transform(x["parts"], is_share), "number": F.transform(x["parts"], is_number)}

    def joining(x: Column) -> dict[str, Column]:
        plain = F.concat(F.array(F.lit(False)), F.zip_with(x["number"], x["share"], lambda n, s: n & ~s))
        return {"parts": x["parts"], "joins": F.zip_with(x["share"], plain, lambda s, b: F.coalesce(s & b, F.lit(False)))}

    def joined(x: Column) -> Column:
        held = F.transform(x["parts"], lambda p, i: F.when(~F.get(x["joins"], i), F.when(F.coalesce(F.get(x["joins"], i + 1), F.lit(False)) & (i + 1 < F.size(x["parts"])), F.concat(p, F.lit("\n"), F.get(x["parts"], i + 1))).otherwise(p)))
        return F.filter(held, lambda p: p.isNotNull())

    return steps({"parts": lines(cell)}, told, joining, body=joined)


def sex_of(text: Column) -> Column:
    """M or F for a line that says so, alone or glued to a figure or letter; else null."""
    return F.upper(F.get(F.regexp_extract_all(F.trim(text), F.lit(r"^(?=.{1,4}$)[0-9.]*[a-eg-ln-z]?([MFmf])[0-9.]*$"), 1), F.lit(0)))


def sexes(cell: Column) -> Column:
    """The sexes stacked or strung together in a cell; none unless there are two or more and nothing else."""
    def all_of(parts: Column) -> Column:
        return let({"told": F.transform(parts, sex_of)}, lambda x: F.when((F.size(x["told"]) >= 2) & F.forall(x["told"], lambda s: s.isNotNull()), x["told"]))

    return F.coalesce(all_of(lines(cell)), all_of(F.filter(F.split(C.canonical(cell), " "), lambda x: x != "")), none())


def has_code(text: Column) -> Column:
    return text.rlike(r"\([A-Za-z]?[0-9]")


def continues(line: Column, before: Column) -> Column:
    """Whether a line of a label goes on with the text before it, rather than beginning a label of its own."""
    def taken_apart(x: Column) -> dict[str, Column]:
        s, p = x["s"], x["p"]
        clause = F.regexp_replace(F.regexp_extract(p, r"(?i)\bsuch as\b(.*)$", 1), r"^[\s,;/]+|[\s,;/]+$", "")
        a, b = (F.regexp_replace(F.lower(F.substring_index(t, " ", 1)), "^[,;]+|[,;]+$", "") for t in (p, s))
        return {"s": s, "p": p, "tail": s.rlike(r"^[A-Z]?[0-9][0-9A-Za-z,\-\s&/)]*$"), "clause": clause, "a": a, "b": b}

    return steps({"s": C.canonical(line), "p": C.canonical(before)}, taken_apart, body=goes_on)


def goes_on(x: Column) -> Column:
    s, p, tail, clause = x["s"], x["p"], x["tail"], x["clause"]
    code = (s.rlike(r"^[0-9A-Za-z,\-\s&/()]+$") & ~s.rlike("[A-Za-z]{5,}")) | (tail & s.rlike(r"[-&]|\)$"))
    closed = F.length(F.regexp_replace(p, r"[^(]", "")) <= F.length(F.regexp_replace(p, r"[^)]", ""))
    title = s.rlike(r"^\p{Lu}") & (n_words(s) >= 3) & (has_code(s) | s.rlike(TITLE_STARTS))
    listed = p.rlike(r"[,\-&/]$") & (tail | (n_words(s) <= 6))
    hanging = p.rlike(HANGING) & (tail | (F.length(s) < 45))
    such = (clause != "") & ~clause.rlike(r"[.)]$") & (n_words(clause) <= 6)
    same = (F.length(x["a"]) >= 5) & (x["a"] == x["b"]) & has_code(s) & ~has_code(p)
    by_text = (p != "") & closed & (listed | same | ((hanging | such) & ~title))
    return (s == "") | (~s.rlike("^[0-9]{1,4}$") & (s.rlike(r"^[(&,]|^\p{Ll}") | code | by_text))


def merge_score(group: Column, line: Column, last: Column) -> Column:
    """How unwelcome it is to join a group of lines (its text and its last line) and the next group's first line; the lowest comes first."""
    def of(x: Column) -> Column:
        g, s = x["g"], x["s"]
        capital = s.rlike(r"^\p{Lu}")
        score = F.when(x["on"], -100).otherwise(0) + F.when(g.rlike(JOINING_ENDS), -50).otherwise(0)
        score += F.when(F.lower(g).rlike("elsewhere$"), -40).otherwise(0) + F.when(g.rlike(r"(?i)\bsuch as\b"), -40).otherwise(0)
        score += F.when((n_words(s) <= 2) & capital, -20).otherwise(0)
        return score + F.when((n_words(x["l"]) >= 2) & (n_words(s) >= 2) & capital & ~x["on"], 35).otherwise(0)

    return steps({"g": group, "s": line, "l": last}, lambda x: {"g": x["g"], "s": x["s"], "l": x["l"], "on": continues(x["s"], x["g"])}, body=of)


def padded(values: Column, n: Column) -> Column:
    return F.slice(F.concat(values, F.array_repeat(F.lit(None).cast("string"), n)), F.lit(1), n)


def named(**values: Column) -> Column:
    return F.named_struct(*(x for k, v in values.items() for x in (F.lit(k), v)))


def labels_on_rows(parts: Column, n: Column) -> Column:
    """Stacked label lines on n rows: lines that go on join the one before, then neighbours by the lowest score until they fit."""
    group = "array<struct<text:string,first:string,last:string>>"

    def gather(groups: Column, line: Column) -> Column:
        def of(x: Column) -> Column:
            head = x["head"]
            joined = F.concat(F.slice(groups, F.lit(1), F.size(groups) - 1), F.array(named(text=F.concat(head["text"], F.lit(" "), line), first=head["first"], last=line)))
            begun = F.concat(groups, F.array(named(text=line, first=line, last=line)))
            return F.when(head.isNotNull() & continues(line, head["text"]), joined).otherwise(begun).cast(group)

        return let({"head": F.get(groups, F.size(groups) - 1)}, of)

    def join_best(groups: Column, _: Column) -> Column:
        scores = F.zip_with(groups, F.slice(groups, F.lit(2), F.size(groups)), lambda g, h: F.when(h.isNotNull(), merge_score(g["text"], h["first"], g["last"])))

        def of(x: Column) -> Column:
            at = (F.array_position(x["scores"], F.array_min(x["scores"])) - 1).cast("int")
            a, b = F.get(groups, at), F.get(groups, at + 1)
            both = F.array(named(text=F.concat(a["text"], F.lit(" "), b["text"]), first=a["first"], last=b["last"]))
            return F.concat(F.slice(groups, F.lit(1), at), both, F.slice(groups, at + 3, F.size(groups))).cast(group)

        return let({"scores": scores}, of)

    def fitted(x: Column) -> dict[str, Column]:
        over = F.size(x["groups"]) - n
        less = F.aggregate(F.when(over > 0, F.sequence(F.lit(1), over)).otherwise(F.array().cast("array<int>")), x["groups"], join_best)
        return {"parts": x["parts"], "texts": F.transform(less, lambda g: g["text"])}

    def gathered(x: Column) -> dict[str, Column]:
        # Lines that fit need no groups.
        return {"parts": x["parts"], "groups": F.aggregate(F.when(F.size(x["parts"]) > n, x["parts"]).otherwise(none()), F.array().cast(group), gather)}

    return steps({"parts": parts}, gathered, fitted, body=lambda x: padded(F.when(F.size(x["parts"]) <= n, x["parts"]).otherwise(x["texts"]), n))


def labels_on_pairs(parts: Column, pairs: Column) -> Column:
    """Stacked label lines on rows that alternate M and F: a label stands on its M row, and lines that go on with it on the F row.

    As many lines as rows stay where they are, and no more lines than pairs are the pairs' labels. Lines beyond the last pair's join its F row.
    """
    pair = "array<struct<m:string,f:string>>"

    def place(found: Column, line: Column) -> Column:
        def of(x: Column) -> Column:
            now = x["now"]
            more = F.concat(F.slice(found, F.lit(1), F.size(found) - 1), F.array(named(m=now["m"], f=F.concat_ws(" ", now["f"], line))))
            begun = F.concat(found, F.array(named(m=line, f=F.lit(None).cast("string"))))
            return F.when(now.isNotNull() & ((F.size(found) >= pairs) | continues(line, F.concat_ws(" ", now["m"], now["f"]))), more).otherwise(begun).cast(pair)

        return let({"now": F.get(found, F.size(found) - 1)}, of)

    def of(x: Column) -> Column:
        parts = x["parts"]
        placed = F.flatten(F.transform(F.aggregate(parts, F.array().cast(pair), place), lambda p: F.array(p["m"], p["f"])))
        alone = F.flatten(F.transform(parts, lambda p: F.array(p, F.lit(None).cast("string"))))
        return padded(F.when(F.size(parts) == 2 * pairs, parts).when(F.size(parts) <= pairs, alone).otherwise(placed), 2 * pairs)

    return let({"parts": parts}, of)


def figures_on_rows(cell: Column, n: Column) -> Column:
    """A stacked cell of figures on n rows. Lines beyond n are left out rather than crowded into the last row."""
    def of(x: Column) -> Column:
        spaced = F.filter(F.split(x["flat"], " "), lambda w: w != "")
        digits = F.replace(x["flat"], F.lit(" "), F.lit(""))
        single = digits.rlike("^[0-9]+$") & (F.length(digits) == n) & (F.size(spaced) > 1)
        return padded(F.when(F.size(x["parts"]) == n, x["parts"]).when(F.size(spaced) == n, spaced).when(single, F.slice(F.split(digits, ""), F.lit(1), n)).otherwise(x["parts"]), n)

    return let({"parts": measures(cell), "flat": C.canonical(cell)}, of)


def sexes_on_rows(cell: Column, n: Column) -> Column:
    """The sex of each of n rows: as stacked, or line by line with single gaps filled from their neighbours, or as far as they go."""
    def of(x: Column) -> Column:
        raw, told = x["raw"], x["told"]

        def fill(found: Column, i: Column) -> Column:
            own, after, before = F.get(raw, i), F.get(raw, i + 1), F.when(i > 0, F.get(found, i - 1))
            guess = F.when(before == "M", F.when(after == "F", "M").otherwise("F")).when(before == "F", F.when(after == "M", "F").otherwise("M")).when(after == "F", "M").when(after == "M", "F")
            return F.concat(found, F.array(F.coalesce(own, guess)))

        every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        known = F.size(F.filter(raw, lambda s: s.isNotNull()))
        by_line = F.when(known >= F.greatest(F.lit(2), F.floor(0.75 * n)), F.aggregate(every, none(), fill)).otherwise(raw)
        return padded(F.when(F.size(told) == n, told).when(x["n_lines"] >= n, by_line).when(F.size(told) > 0, told).otherwise(F.array(sex_of(x["flat"]))), n)

    rows = F.split(F.regexp_replace(F.coalesce(cell, F.lit("")), "\r\n?", "\n"), "\n")
    return let({"told": sexes(cell), "raw": F.slice(F.transform(rows, sex_of), F.lit(1), n), "n_lines": F.size(rows), "flat": C.canonical(cell)}, of)
