"""Column expressions that take a JSON object out of a model's reply and mend what such replies get wrong."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgrid.functions.stacks import let

#: A text in quotes, one that never ends, a brace, or a run of anything else.
TOKENS = r'"(?:[^"\\]++|\\[\s\S])*+"|"[\s\S]*|[{}]|[^"{}]+'


def first_object(text: Column) -> Column:
    """The first balanced object of a text, braces in quotes apart; null without one."""

    def step(s: Column, token: Column) -> Column:
        depth = s["depth"] + F.when(token == "{", 1).when(token == "}", -1).otherwise(0)
        read = s["read"] + F.length(token)
        end = F.when((token == "}") & (depth == 0), read)
        return F.when(s["end"].isNotNull(), s).otherwise(F.named_struct(F.lit("depth"), depth, F.lit("read"), read, F.lit("end"), end))

    begin = F.named_struct(F.lit("depth"), F.lit(0), F.lit("read"), F.lit(0), F.lit("end"), F.lit(None).cast("int"))

    def cut(x: Column) -> Column:
        end = F.aggregate(F.regexp_extract_all(x["rest"], F.lit(TOKENS), 0), begin, step, lambda s: s["end"])
        return F.substring(x["rest"], F.lit(1), end)

    return F.when(F.contains(text, F.lit("{")), let({"rest": F.substring(text, F.instr(text, "{"), F.length(text))}, cut))


def mended(text: Column) -> Column:
    """A reply's object without fences, with plain quotes and without commas before closing brackets; the whole text without one."""
    bare = F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "```[a-zA-Z]*\n?", "")), "`+$", ""))
    bare = F.regexp_replace(bare, r"^\s+|\s+$", "")
    whole = let({"plain": F.translate(bare, "“”‘’", "\"\"''")}, lambda x: F.coalesce(first_object(x["plain"]), x["plain"]))
    return F.regexp_replace(whole, r",\s*([}\]])", "$1")


def fields(text: Column, names: tuple[str, ...]) -> dict[str, Column]:
    """The named fields of a reply's object as text; null where they are missing or no object can be read."""
    held = F.from_json(mended(text), "map<string,string>")
    return {n: held[n] for n in names}
