"""License scans by ordered signature rules, in DataFrame functions only.

A text is brought to lower-case words with one space between them. A few key words decide whether any
rule can match; of the rules, only those whose own key word occurs are tried. Detections carry the
rule's priority; one that lies inside a detection of the same or a better priority is suppressed.
The base phrases of the contract are found on their own and are never suppressed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import NON_WORD_RUN, ascii_lower, let

# Fixed base phrases and labels of the contract.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

VERSION = r"(?: version| v)?"
# Families: label, key word, and how the name reads in lower-case words.
FAMILIES = (
    ("apache-2.0", "apache", rf"apache(?: software)?(?: license| licence)?{VERSION} ?(?:v2|2)(?: 0)?"),
    ("apache-1.1", "apache", rf"apache(?: software)?(?: license| licence)?{VERSION} 1 [01]"),
    ("mit", "mit", r"mit(?: x11)?"),
    ("bsd-2-clause", "bsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: license)?"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: license)?"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)(?: license)?"),
    ("0bsd", "bsd", r"(?:0bsd|zero clause bsd|bsd 0 clause)(?: license)?"),
    ("gpl-1.0", "general public", rf"(?:gnu )?general public licen[sc]e{VERSION} 1(?: 0)?"),
    ("gpl-2.0", "general public", rf"(?:gnu )?general public licen[sc]e{VERSION} (?:v2|2)(?: 0)?(?: only| or(?: \w+)? later)?"),
    ("gpl-3.0", "general public", rf"(?:gnu )?general public licen[sc]e{VERSION} (?:v3|3)(?: 0)?(?: only| or(?: \w+)? later)?"),
    ("gpl", "gpl", r"(?:gnu )?gpl(?: ?v?[123])?(?: 0)?(?: only| or later)?"),
    ("lgpl-2.1", "lesser", rf"(?:gnu )?lesser general public licen[sc]e{VERSION} 2 1"),
    ("lgpl-3.0", "lesser", rf"(?:gnu )?lesser general public licen[sc]e{VERSION} 3(?: 0)?"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl(?: ?v?[23])?(?: [01])?(?: only| or later)?"),
    ("lgpl-2.0", "library general", rf"(?:gnu )?library general public licen[sc]e{VERSION} 2(?: 0)?"),
    ("agpl-3.0", "affero", rf"(?:gnu )?affero general public licen[sc]e{VERSION} 3(?: 0)?"),
    ("agpl", "agpl", r"(?:gnu )?agpl(?: ?v?3)?(?: 0)?"),
    ("gfdl", "free documentation", rf"(?:gnu )?free documentation licen[sc]e(?:{VERSION} 1 [123])?"),
    ("mpl-1.1", "mozilla", rf"mozilla public licen[sc]e{VERSION} 1 1"),
    ("mpl-2.0", "mozilla", rf"mozilla public licen[sc]e{VERSION} 2(?: 0)?"),
    ("epl-1.0", "eclipse", rf"eclipse public licen[sc]e{VERSION} 1(?: 0)?"),
    ("epl-2.0", "eclipse", rf"eclipse public licen[sc]e{VERSION} 2(?: 0)?"),
    ("cddl-1.0", "common development", rf"common development and distribution licen[sc]e(?:{VERSION} 1 [01])?"),
    ("cpl-1.0", "common public", rf"common public licen[sc]e(?:{VERSION} 1(?: 0)?)?"),
    ("eupl-1.2", "european union", rf"european union public licen[sc]e(?:{VERSION} 1 [12])?"),
    ("isc", "isc", r"isc licen[sc]e"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e"),
    ("bsl-1.0", "boost", rf"boost software licen[sc]e(?:{VERSION} 1(?: 0)?)?"),
    ("artistic-2.0", "artistic", rf"artistic licen[sc]e(?:{VERSION} [12](?: 0)?)?"),
    ("unlicense", "unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("python-2.0", "python", rf"python software foundation licen[sc]e(?:{VERSION} 2(?: 0)?)?"),
    ("php-3.01", "php", rf"php licen[sc]e(?:{VERSION} 3(?: 01)?)?"),
    ("ofl-1.1", "open font", rf"(?:sil )?open font licen[sc]e(?:{VERSION} 1 1)?"),
    ("odbl-1.0", "open database", rf"open database licen[sc]e(?:{VERSION} 1(?: 0)?)?"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-4.0", "cc by", r"cc by 4 0"),
    ("cc-by-3.0", "cc by", r"cc by 3 0"),
    ("cc-by-sa", "cc by", r"cc by sa(?: [234] [05])?"),
    ("cc-by-nc", "cc by", r"cc by nc(?: [234] [05])?"),
    ("cc-by-nd", "cc by", r"cc by nd(?: [234] [05])?"),
    ("cc-by-nc-sa", "cc by", r"cc by nc sa(?: [234] [05])?"),
    ("cc-by-nc-nd", "cc by", r"cc by nc nd(?: [234] [05])?"),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial(?: [234] [05])?(?: international)?"),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike(?: [234] [05])?(?: international)?"),
    ("cc-by", "creative commons", r"creative commons attribution(?: [234] [05])?(?: international)?"),
)
#: Families whose bare name is a word of everyday language; the weaker forms want "license" after it.
EVERYDAY = {"mit"}
# How a family is referred to: priority (less is better), words before and after the name, weight.
FORMS = (
    (1, r"spdx licen[sc]e identifier ", r"", 1.0),
    (1, r"(?:re)?licen[sc]ed (?:under|with|by) (?:the |a |an )?(?:terms (?:and conditions )?of (?:the |a )?)?", r"(?: licen[sc]e)?", 0.98),
    (2, r"(?:released|distributed|available|published|provided|covered|shared|offered) (?:publicly |freely )?(?:under|by) (?:the |a |an )?(?:terms (?:and conditions )?of (?:the |a )?)?", r"(?: licen[sc]e)?", 0.95),
    (2, r"(?:subject to|in accordance with|in compliance with|governed by) (?:the |a )?(?:terms (?:and conditions )?of (?:the |a )?)?", r"(?: licen[sc]e)?", 0.9),
    (3, r"(?:see|read|refer to|copy of) (?:the )?", r"(?: licen[sc]e)?(?: for details| for more)?", 0.7),
    (4, r"", r"(?: licen[sc]e)?", 0.6),
)
# Single rules: priority, label, key word, reading, weight.
NOTICES = (
    (1, "mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy", 1.0),
    (1, "isc", "permission to use copy", r"permission to use copy modify and (?:or )?distribute this software", 0.95),
    (1, "bsd", "redistribution and use", r"redistribution and use in source and binary forms", 0.95),
    (2, "bsd-3-clause", "endorse or promote", r"endorse or promote products derived from this software without specific prior written permission", 0.9),
    (2, "gpl", "free software", r"(?:this program|it|this) is free software(?: you can redistribute it)?", 0.85),
    (2, "public-domain", "public domain", r"(?:released|dedicated|placed) (?:in|into|to) the public domain", 0.9),
    (3, "public-domain", "public domain", r"(?:in the )?public domain", 0.5),
    (3, "warranty-disclaimer", "warrant", r"(?:without warranty of any kind|without warranties or conditions of any kind|without any warranty)", 0.4),
    (3, "warranty-disclaimer", "as is", r"provided (?:by \w+ )?as is", 0.4),
    (3, "copyright", "copyright", r"copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)?\d\d)*", 0.4),
    (4, "copyright", "copyright", r"(?:copyright (?:c|by)|copyrighted)", 0.3),
    (3, "proprietary", "rights reserved", r"(?:all|some|no) rights reserved", 0.4),
    (3, "proprietary", "proprietary", r"(?:proprietary (?:and|or) confidential|confidential (?:and|or) proprietary|proprietary licen[sc]e|commercial licen[sc]e)", 0.5),
    (3, "eula", "end user", r"end user licen[sc]e agreement", 0.5),
    (4, "unknown-license", "licen", r"(?:licensed|released|distributed) under", 0.3),
    (4, "unknown-license", "licen", r"(?:licen[sc]e agreement|terms of (?:the|this) licen[sc]e|licen[sc]e terms)", 0.3),
)
PRIORITIES = (1, 2, 3, 4)
#: Without one of these in it, no rule can match a text.
GATES = ("licen", "spdx", " cc by ", "cc0", "gpl", " mit ", "bsd", "apache", "creative commons", "wtfpl", "public domain", "copyright", "rights reserved", "permission ", "redistribution and use", "endorse or promote", "free software", "warrant", " as is ", "proprietary")


def rules() -> list[tuple[int, str, str, str, float]]:
    """(priority, label, key word, regex, weight): every form of every family, and the notices."""
    made = []
    for label, key, name in FAMILIES:
        for p, before, after, weight in FORMS:
            if label in EVERYDAY and p > 2:
                after = r" licen[sc]e"
            made.append((p, label, key, f" {before}{name}{after}(?= )", weight))
    return made + [(p, label, key, f" {reading}(?= )", w) for p, label, key, reading, w in NOTICES]


def normal_text(text: Column) -> Column:
    """Lower-case words with one space before, between and after them; spaces only without a word."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), NON_WORD_RUN, " ")), F.lit(" "))


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def literal_rules(made: list[tuple[int, str, str, str, float]]) -> Column:
    def struct(p: int, label: str, key: str, regex: str, weight: float) -> Column:
        return F.struct(F.lit(p).alias("priority"), F.lit(label).alias("label"), F.lit(key).alias("key"), F.lit(regex).alias("regex"), F.lit(weight).alias("weight"))

    return F.array(*(struct(*r) for r in made))


def detections(text: Column, rule: Column) -> Column:
    """Every place where a rule matches: from, to (characters), priority, label, weight."""
    pairs = F.arrays_zip(
        F.split(text, rule["regex"]).alias("gap"),
        F.regexp_extract_all(text, rule["regex"], F.lit(0)).alias("match"),
    )
    kind = "array<struct<from:int,to:int,priority:int,label:string,weight:double>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("found"))

    def add(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["gap"])
        end = begin + F.coalesce(F.length(pair["match"]), F.lit(0))
        place = F.struct(begin.alias("from"), end.alias("to"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["weight"].alias("weight"))
        return F.struct(end.alias("at"), F.when(pair["match"].isNull(), state["found"]).otherwise(F.concat(state["found"], F.array(place))).alias("found"))

    return F.aggregate(pairs, start, add)["found"]


def resolved(found: Column) -> Column:
    """labels (distinct), n_kept and score (the best weight) of the detections that are not suppressed.

    In order of start, longest first, a detection is suppressed if one before it of the same or a
    better priority reaches as far. What begins later can't contain it.
    """
    ordered = F.transform(
        F.array_sort(F.transform(found, lambda d: F.struct(d["from"], (-d["to"]).alias("to"), d["priority"], d["label"], d["weight"]))),
        lambda d: F.struct(d["from"].alias("from"), (-d["to"]).alias("to"), d["priority"].alias("priority"), d["label"].alias("label"), d["weight"].alias("weight")),
    )
    start = F.struct(
        *(F.lit(-1).alias(f"reach{p}") for p in PRIORITIES),
        F.array().cast("array<string>").alias("labels"),
        F.lit(0).cast("long").alias("n_kept"),
        F.lit(0.0).alias("score"),
    )

    def add(state: Column, d: Column) -> Column:
        inside = F.lit(False)
        for p in PRIORITIES:
            inside = inside | ((d["priority"] >= p) & (state[f"reach{p}"] >= d["to"]))
        reaches = [F.greatest(state[f"reach{p}"], F.when(d["priority"] == p, d["to"]).otherwise(-1)).alias(f"reach{p}") for p in PRIORITIES]
        return F.struct(
            *reaches,
            F.when(inside, state["labels"]).otherwise(F.array_union(state["labels"], F.array(d["label"]))).alias("labels"),
            (state["n_kept"] + F.when(inside, 0).otherwise(1)).cast("long").alias("n_kept"),
            F.when(inside, state["score"]).otherwise(F.greatest(state["score"], d["weight"])).alias("score"),
        )

    return F.aggregate(ordered, start, add)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, n_detections and score of every row.

    A null text counts as empty: no words, no labels, score 0. Each row is judged by itself, so
    repeated rows and very long texts need no shuffle; other columns are not read; an empty table
    gives an empty table. Base labels stay whatever the rules suppress.
    """
    norm = docs.select("doc_id", normal_text(F.col("text")).alias("norm"))
    n_words = F.when(F.trim("norm") == "", 0).otherwise(spaces(F.col("norm")) - 1)
    n_base, firsts, lasts, base_labels = F.lit(0), [F.lit(None).cast("int")], [F.lit(None).cast("int")], []
    parts = {f"gaps{i}": F.when(F.contains("norm", F.lit(f" {phrase} ")), F.split("norm", f" {phrase}(?= )")) for i, (phrase, _) in enumerate(BASE)}
    rows = norm.select("doc_id", "norm", n_words.alias("n_words"), *(c.alias(k) for k, c in parts.items()))
    for i, (phrase, label) in enumerate(BASE):
        gaps, k = F.col(f"gaps{i}"), len(phrase.split())
        n_base = n_base + F.coalesce(F.size(gaps) - 1, F.lit(0))
        firsts.append(spaces(F.element_at(gaps, 1)))
        lasts.append(F.col("n_words") - (spaces(F.element_at(gaps, -1)) - 1) - k)
        base_labels.append(F.when(gaps.isNotNull(), F.lit(label)))
    gate = F.lit(False)
    for key in GATES:
        gate = gate | F.contains("norm", F.lit(key))
    tried = F.filter(literal_rules(rules()), lambda r: F.contains(F.col("norm"), r["key"]))
    found = F.flatten(F.transform(tried, lambda r: detections(F.col("norm"), r)))
    kept = F.when(gate, let(found, lambda f: resolved(f)))
    base = F.array_compact(F.array(*base_labels))
    return rows.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        n_base.cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        base.alias("_base"),
        kept.alias("_kept"),
    ).select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        "base_labels",
        F.array_join(F.array_sort(F.array_union("_base", F.coalesce("_kept.labels", F.array().cast("array<string>")))), ",").alias("labels"),
        F.coalesce("_kept.n_kept", F.lit(0)).cast("long").alias("n_detections"),
        F.greatest(F.coalesce("_kept.score", F.lit(0.0)), F.when(F.size("_base") > 0, 0.4).otherwise(0.0)).alias("score"),
    )
