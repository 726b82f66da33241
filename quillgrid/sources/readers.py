"""Sources and sinks: by file kind, delimited text, a relation behind a read-only SQL gate, text stores."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {"csv": "csv", "parquet": "parquet", "json": "json", "jsonl": "json", "orc": "orc", "xlsx": "sheet", "xls": "sheet", "pdf": "pdf"}
# Fixed words: what a read-only statement may begin with, and what it may not hold.
MAY_BEGIN = ("select", "with", "table", "values", "show", "explain")
MAY_NOT_HOLD = ("insert", "update", "delete", "drop", "alter", "create", "truncate", "grant", "revoke", "merge", "copy", "call", "vacuum", "execute", "do", "reindex", "cluster", "comment", "security", "set role", "set session")


def kind_of(name: str, hint: str | None = None) -> str:
    """The kind of a source by its file name; a hint must agree."""
    kind = KINDS.get(name.rpartition(".")[2].lower())
    if kind is None:
        raise ValueError(f"unknown kind of file: {name}")
    if hint and KINDS.get(hint.lower(), hint.lower()) != kind:
        raise ValueError(f"{name} is not {hint}")
    return kind


def read(spark: SparkSession, path: str, hint: str | None = None) -> DataFrame:
    """A file or folder as a DataFrame; csv cells stay text, as published tables hold them."""
    kind = kind_of(path, hint)
    if kind == "csv":
        return spark.read.option("header", True).option("multiLine", True).csv(path)
    if kind in ("sheet", "pdf"):
        raise ValueError(f"{kind} files need a reader library that this machine lacks; give their cells as a table")
    return spark.read.format(kind).load(path)


#: Texts in quotes, and comments, which are none inside of such.
QUOTED = r"""'(?:[^']|'')*'|"(?:[^"]|"")*"|`[^`]*`"""
COMMENT = r"--[^\n]*|/\*.*?\*/"


def gate(statement: str) -> str:
    """A single read-only statement without comments and its last semicolon; anything else is an error.

    What stands in quotes stays as it is, and counts: a word or semicolon that isn't allowed isn't there either.
    """
    bare = re.sub(f"({QUOTED})|{COMMENT}", lambda m: m[1] or " ", statement or "", flags=re.DOTALL).strip().rstrip(";").strip()
    if not bare or ";" in bare:
        raise ValueError("one statement is wanted")
    begins = bare.split(None, 1)[0].lower()
    if begins not in MAY_BEGIN:
        raise ValueError("only statements that read are allowed")
    words = " ".join(bare.lower().split())
    if held := re.search(rf"\b({'|'.join(MAY_NOT_HOLD)})\b", words):
        raise ValueError(f"not allowed: {held[1]}")
    if begins == "explain" and re.search(r"\banalyze\b", words):
        raise ValueError("explain analyze runs its statement")
    return bare


def query(spark: SparkSession, statement: str, limit: int = 50_000) -> DataFrame:
    """A gated statement, of which at most limit rows are read: an extract, by definition of the source."""
    return spark.sql(gate(statement)).limit(limit)


def flatten_json(rows: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """rows with the named top-level keys of a JSON text as columns of text."""
    return rows.withColumns({k: F.get_json_object(column, f"$['{k}']") for k in keys})


def write_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("header", True).csv(path)
