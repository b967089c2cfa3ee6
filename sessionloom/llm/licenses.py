"""License scans by ordered signature rules.

A text is lower-cased (A-Z only) and reduced to its words joined by single spaces.  Each rule is a regular expression
over that form with a label, a priority, a confidence and a keyword; it runs only on texts that hold its keyword.
Detections are intervals; one that lies inside another of the same or a higher priority is suppressed, equal intervals
go to the higher priority and then to the earlier rule.  What is left gives the labels and the score.

All of it is one projection of built-in functions, without a shuffle; the rules are literals of the plan.  Null texts
count as empty; texts without a keyword get no labels and score 0.  Whole texts are scanned, and columns of the input
never clash with inner names because only the text column is used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import blank

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Phrases and labels that the base report must have.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: label | keyword | names. Names are regular expressions over words joined by single spaces.
SIGNATURES = r"""
agpl-3.0 | affero | (?:gnu )?affero general public licen[cs]e(?: version| v)? ?3(?: 0)?
agpl-3.0 | agpl | (?:gnu )?agpl ?v?3(?: 0)?
agpl | affero | (?:gnu )?affero general public licen[cs]e
agpl | agpl | (?:gnu )?agpl
lgpl-3.0 | lesser | (?:gnu )?lesser general public licen[cs]e(?: version| v)? ?3(?: 0)?
lgpl-2.1 | lesser | (?:gnu )?lesser general public licen[cs]e(?: version| v)? ?2 1
lgpl-2.0 | library general | (?:gnu )?library general public licen[cs]e(?: version| v)? ?2(?: 0)?
lgpl | lesser | (?:gnu )?lesser general public licen[cs]e
lgpl | lgpl | (?:gnu )?lgpl(?: ?v?[23](?: [01])?)?
gpl-3.0 | general public | (?:gnu )?general public licen[cs]e(?: as published by the free software foundation)?(?: either)?(?: version| v) ?3(?: 0)?
gpl-2.0 | general public | (?:gnu )?general public licen[cs]e(?: as published by the free software foundation)?(?: either)?(?: version| v) ?2(?: 0)?
gpl-1.0 | general public | (?:gnu )?general public licen[cs]e(?: version| v) ?1(?: 0)?
gpl-3.0 | gpl | (?:gnu )?gpl(?: version)? ?v?3(?: 0)?
gpl-2.0 | gpl | (?:gnu )?gpl(?: version)? ?v?2(?: 0)?
gpl | general public | gnu general public licen[cs]e
gpl | gpl | gnu gpl
gfdl | free documentation | (?:gnu )?free documentation licen[cs]e(?:(?: version| v)? ?1 [123])?
apache-2.0 | apache | apache(?: software)?(?: licen[cs]e)?(?: version| v)? ?2(?: 0)?
apache-1.1 | apache | apache(?: software)? licen[cs]e(?: version| v)? ?1 1
apache-1.0 | apache | apache(?: software)? licen[cs]e(?: version| v)? ?1 0
apache | apache | apache(?: software)? licen[cs]e
mit | mit licen | (?:the )?mit licen[cs]e
mit | mit x11 | (?:the )?mit x11 licen[cs]e
mit | mit expat | (?:the )?mit expat licen[cs]e
mit | expat | (?:the )?expat licen[cs]e
mit-0 | mit no attribution | mit no attribution(?: licen[cs]e)?
x11 | x11 | (?:the )?x11 licen[cs]e
bsd-4-clause | bsd | (?:original|4 clause|four clause) bsd licen[cs]e
bsd-3-clause | bsd | (?:new|modified|revised|3 clause|three clause) bsd licen[cs]e
bsd-3-clause | bsd | bsd 3 clause(?: licen[cs]e)?
bsd-2-clause | bsd | (?:simplified|freebsd|2 clause|two clause) bsd licen[cs]e
bsd-2-clause | bsd | bsd 2 clause(?: licen[cs]e)?
0bsd | bsd | (?:zero clause bsd|0bsd|bsd zero clause)(?: licen[cs]e)?
bsd | bsd | bsd(?: style)? licen[cs]e
mpl-2.0 | mozilla | mozilla public licen[cs]e(?: version| v)? ?2(?: 0)?
mpl-1.1 | mozilla | mozilla public licen[cs]e(?: version| v)? ?1 1
mpl | mozilla | mozilla public licen[cs]e
mpl | mpl | mpl(?: ?v?[12] [01])?
epl-2.0 | eclipse | eclipse public licen[cs]e(?: version| v)? ?2(?: 0)?
epl-1.0 | eclipse | eclipse public licen[cs]e(?: version| v)? ?1(?: 0)?
epl | eclipse | eclipse public licen[cs]e
edl | eclipse | eclipse distribution licen[cs]e(?: version| v)? ?(?:1 0)?
cddl-1.1 | development and distribution | common development and distribution licen[cs]e(?: version| v)? ?1 1
cddl | development and distribution | common development and distribution licen[cs]e
cpl | common public | common public licen[cs]e
eupl | european union | european union public licen[cs]e(?:(?: version| v)? ?1 [012])?
isc | isc | (?:the )?isc licen[cs]e
zlib | zlib | (?:the )?zlib(?: libpng)? licen[cs]e
boost | boost | boost software licen[cs]e(?:(?: version| v)? ?1 0)?
artistic-2.0 | artistic | (?:perl )?artistic licen[cs]e(?: version| v)? ?2(?: 0)?
artistic | artistic | (?:perl )?artistic licen[cs]e
python-2.0 | python | python(?: software foundation)? licen[cs]e(?:(?: version| v)? ?2(?: 0)?)?
php | php | php licen[cs]e(?:(?: version| v)? ?3 0(?: 1)?)?
ruby | ruby | ruby licen[cs]e
openssl | openssl | openssl licen[cs]e
unlicense | unlicense | (?:the )?unlicense
wtfpl | wtfpl | wtfpl
wtfpl | want to public | do what the \S+ you want to public licen[cs]e
ofl | open font | (?:sil )?open font licen[cs]e(?:(?: version| v)? ?1 [01])?
ms-pl | microsoft | microsoft public licen[cs]e
ms-rl | microsoft | microsoft reciprocal licen[cs]e
odbl | open database | (?:odc )?open database licen[cs]e(?: odbl)?
pddl | public domain dedication | public domain dedication and licen[cs]e
odc-by | open data commons | open data commons attribution licen[cs]e
busl | business source | business source licen[cs]e(?:(?: version| v)? ?1 1)?
sspl | server side | server side public licen[cs]e
elastic | elastic | elastic licen[cs]e(?:(?: version| v)? ?2(?: 0)?)?
openrail | openrail | (?:creativeml |bigscience )?openrail(?: m)?(?: licen[cs]e)?
llama | llama | llama [1-9](?: [0-9])? community licen[cs]e
cc0 | cc0 | (?:creative commons )?cc0(?: 1 0)?
cc0 | creative commons | creative commons zero
cc-by-nc-nd | cc by | cc by nc nd(?: [1-4] 0)?
cc-by-nc-sa | cc by | cc by nc sa(?: [1-4] 0)?
cc-by-nc | cc by | cc by nc(?: [1-4] 0)?
cc-by-nd | cc by | cc by nd(?: [1-4] 0)?
cc-by-sa | cc by | cc by sa(?: [1-4] 0)?
cc-by | cc by | cc by(?: [1-4] 0)?
cc-by-nc-nd | creative commons | creative commons attribution non ?commercial no ?deriv(?:s|atives|ative works)
cc-by-nc-sa | creative commons | creative commons attribution non ?commercial share ?alike
cc-by-nc | creative commons | creative commons attribution non ?commercial
cc-by-nd | creative commons | creative commons attribution no ?deriv(?:s|atives|ative works)
cc-by-sa | creative commons | creative commons attribution share ?alike
cc-by | creative commons | creative commons attribution
creative-commons | creative commons | creative commons licen[cs]e
"""

#: How a name may be used: pattern around the name, priority (1 is the highest), confidence.
USES = (
    (r"(?:is |are |be )?(?:licen[cs]ed|released|distributed|published|available|provided|shared|made available) (?:under|with|by)(?: the)?(?: terms of)?(?: the)? {name}", 1, 1.0),
    (r"spdx licen[cs]e identifier {name}", 1, 1.0),
    (r"{name}", 2, 0.9),
)

#: Single rules: label | keyword | pattern | priority | confidence.
SINGLE = r"""
mit | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software | 1 | 1.0
isc | permission to use copy | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted | 1 | 1.0
bsd | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted | 1 | 1.0
zlib | without any express or implied warranty | this software is provided as is without any express or implied warranty | 1 | 0.8
unlicense | unencumbered | this is free and unencumbered software released into the public domain | 1 | 1.0
gpl | free software | this program is free software you can redistribute it and or modify it | 1 | 0.9
public-domain | public domain | (?:released|dedicated|placed) (?:in|into|to) the public domain | 2 | 0.9
all-rights-reserved | all rights reserved | all rights reserved | 2 | 0.7
proprietary | proprietary | proprietary and confidential | 2 | 0.9
proprietary | proprietary | proprietary licen[cs]e | 2 | 0.8
copyright-notice | copyright | copyright(?: c)? (?:19|20)[0-9]{2} | 3 | 0.4
copyright-notice | copyright | copyright(?: c)? by | 3 | 0.4
unknown-license | licen | licen[cs]ed under the terms of | 3 | 0.3
unknown-license | licen | see (?:the )?licen[cs]e file | 3 | 0.3
"""


@dataclass(frozen=True)
class Rule:
    """A detection rule; ``pattern`` is matched between spaces."""

    label: str
    keyword: str
    pattern: str
    priority: int
    confidence: float


def default_rules() -> list[Rule]:
    """All signatures in all uses, then the single rules, in order."""
    rules = []
    for line in filter(None, map(str.strip, SIGNATURES.splitlines())):
        label, keyword, name = (x.strip() for x in line.split(" | "))
        rules += [Rule(label, keyword, use.format(name=f"(?:{name})"), priority, sure) for use, priority, sure in USES]
    for line in filter(None, map(str.strip, SINGLE.splitlines())):
        label, keyword, pattern, priority, sure = (x.strip() for x in line.split(" | "))
        rules.append(Rule(label, keyword, pattern, int(priority), float(sure)))
    return rules


def joined_words(text: Column) -> Column:
    """The words of the lower-cased text between single spaces, with a space at either end."""
    spaced = F.regexp_replace(F.concat(F.lit(" "), blank(text), F.lit(" ")), SEPARATORS, " ")
    # Only A-Z are lowered; other letters stay as they are.
    return F.translate(spaced, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rule_table(rules: list[Rule]) -> Column:
    rows = [F.struct(F.lit(i).alias("rule"), F.lit(r.keyword).alias("keyword"), F.lit(f"(?<= )(?:{r.pattern})(?= )").alias("pattern"),
                     F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.lit(r.confidence).alias("confidence")) for i, r in enumerate(rules)]
    return F.array(*rows)


def _gate(rules: list[Rule]) -> str:
    """One pass over the raw text tells whether any keyword may be there."""
    return "(?i)" + "|".join(sorted({r.keyword.replace(" ", SEPARATORS) for r in rules}))


def _places(joined: Column, pattern: Column) -> Column:
    """Start and end (0-based, in characters of the joined words) of all matches of a pattern, from left to right."""
    found = F.regexp_extract_all(joined, pattern, F.lit(0))
    gaps = F.split(joined, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["hit"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(begin.alias("start"), end.alias("end")))).alias("out"))

    pairs = F.zip_with(gaps, found, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    pairs = F.slice(pairs, F.lit(1), F.size(found))
    return F.when(F.size(found) == 0, start["out"]).otherwise(F.aggregate(pairs, start, step, lambda s: s["out"]))


def detections(joined: Column, rules: list[Rule]) -> Column:
    """All matches of all rules whose keyword is there, before suppression."""
    near = F.filter(_rule_table(rules), lambda r: F.contains(joined, r["keyword"]))
    each = F.transform(near, lambda r: F.transform(_places(joined, r["pattern"]), lambda p: F.struct(
        p["start"].alias("start"), (-p["end"]).alias("minus_end"), r["priority"].alias("priority"), r["rule"].alias("rule"), r["label"].alias("label"), r["confidence"].alias("confidence"))))
    return F.array_sort(F.flatten(each))


def unsuppressed(found: Column) -> Column:
    """Detections that no earlier one of the same or a higher priority contains; ``found`` is sorted by start, then longest first."""
    none = F.lit(-1)
    start = F.struct(none.alias("p1"), none.alias("p2"), none.alias("p3"), F.slice(found, 1, 0).alias("out"))

    def step(s: Column, d: Column) -> Column:
        end = -d["minus_end"]
        cover = F.when(d["priority"] == 1, s["p1"]).when(d["priority"] == 2, F.greatest(s["p1"], s["p2"])).otherwise(F.greatest(s["p1"], s["p2"], s["p3"]))
        far = lambda name, p: F.when(d["priority"] == p, F.greatest(s[name], end)).otherwise(s[name]).alias(name)
        return F.struct(far("p1", 1), far("p2", 2), far("p3", 3), F.when(end <= cover, s["out"]).otherwise(F.concat(s["out"], F.array(d))).alias("out"))

    return F.aggregate(found, start, step, lambda s: s["out"])


def scan(docs: DataFrame, text: str = "text", id_col: str = "doc_id", rules: list[Rule] | None = None) -> DataFrame:
    """One row per document: base places and labels, the labels of the rules, score and surviving detections."""
    rules = default_rules() if rules is None else rules
    df = docs.select(F.col(id_col).alias("doc_id"), blank(text).alias("text"))
    df = df.withColumn("n_words", F.regexp_count("text", F.lit(WORDS)).cast("long"))
    df = df.withColumn("joined", F.when(F.col("text").rlike(_gate([*rules, *(Rule("", p, "", 1, 1.0) for p, _ in BASE)])), joined_words(F.col("text"))).otherwise(F.lit(" ")))
    base = F.array(*[F.struct(F.lit(label).alias("label"), _places(F.col("joined"), F.lit(f"(?<= ){phrase}(?= )")).alias("places")) for phrase, label in BASE])
    empty = F.array().cast("array<struct<label:string,places:array<struct<start:int,end:int>>>>")
    df = df.withColumn("base", F.when(F.col("joined") == " ", empty).otherwise(F.filter(base, lambda b: F.size(b["places"]) > 0)))
    df = df.withColumn("found", F.when(F.col("joined") != " ", detections(F.col("joined"), rules)))
    df = df.withColumn("found", F.coalesce(unsuppressed(F.col("found")), F.array().cast(df.schema["found"].dataType)))
    starts = F.flatten(F.transform("base", lambda b: F.transform(b["places"], lambda p: p["start"])))
    # Words before a place: the spaces before it, less the one at the start.
    word = lambda at: (F.regexp_count(F.substring("joined", F.lit(1), at), F.lit(" ")) - 1).cast("long")
    base_labels = F.transform("base", lambda b: b["label"])
    labels = F.array_union(base_labels, F.transform("found", lambda d: d["label"]))
    score = F.aggregate(F.col("found"), F.lit(0.0), lambda a, d: F.greatest(a, d["confidence"]))
    score = F.greatest(score, F.when(F.size("base") > 0, F.lit(0.9)).otherwise(F.lit(0.0)))
    join = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return df.withColumn("starts", starts).select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"), word(F.array_min("starts")).alias("first_word"), word(F.array_max("starts")).alias("last_word"),
        join(base_labels).alias("base_labels"), join(labels).alias("labels"), score.alias("score"),
        F.transform("found", lambda d: F.struct(d["label"].alias("label"), d["start"].alias("start"), (-d["minus_end"]).alias("end"), d["priority"].alias("priority"))).alias("detections"),
    )
