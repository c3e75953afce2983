"""Licence scans by rules over sentences: known sentences become identifiers, and sequences of identifiers make licences.

A document with a marker word is normalised (lower case, letters and digits, single spaces) and known sentences are looked
for between the places where sentences end: punctuation, blank lines and line ends. A sentence may also run over line ends
and the comment signs that lead lines, so wrapped notices are known as well as notices of one line. The identifiers found, in order, are one string; rules, longest first, are sequences looked for in it. What
a rule has matched does not count for another. No row leaves its partition, and no Python runs.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import text_or_empty

# Sentences of well-known licences and of the notices that refer to them.
SENTENCES: dict[int, str] = {
    1: "Released under the MIT License.",
    2: "Licensed under the MIT License.",
    3: "Licensed under the Apache License, Version 2.0.",
    4: 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    5: "You may obtain a copy of the License at",
    6: 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    7: "See the License for the specific language governing permissions and limitations under the License.",
    8: "This work is licensed under the GNU General Public License, version 3.",
    9: "This work is licensed under the GNU General Public License, version 2.",
    10: "Licensed under CC BY-NC 4.0.",
    11: "Licensed under CC BY 4.0.",
    12: "Licensed under CC BY-SA 4.0.",
    13: "All rights reserved.",
    14: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    15: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    16: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    17: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    18: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    19: "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    20: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    21: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    22: "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    23: "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    24: "This is free and unencumbered software released into the public domain.",
    25: "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    26: "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    27: "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
}
#: Licence, its sentences in order; longer sequences are tried first, then in this order.
RULES: list[tuple[str, tuple[int, ...]]] = [
    ("Apache-2.0", (4, 5, 6, 7)),
    ("BSD-3-Clause", (16, 17, 18, 19)),
    ("BSD-2-Clause", (16, 17, 18)),
    ("MIT", (14, 15)),
    ("MIT", (1,)),
    ("MIT", (2,)),
    ("Apache-2.0", (3,)),
    ("Apache-2.0", (4,)),
    ("GPL-3.0", (8,)),
    ("GPL-2.0", (9,)),
    ("GPL-3.0-or-later", (21,)),
    ("GPL-2.0-or-later", (22,)),
    ("CC-BY-NC-4.0", (10,)),
    ("CC-BY-4.0", (11,)),
    ("CC-BY-SA-4.0", (12,)),
    ("CC-BY-4.0", (25,)),
    ("CC-BY-SA-4.0", (26,)),
    ("CC-BY-NC-4.0", (27,)),
    ("ISC", (20,)),
    ("MPL-2.0", (23,)),
    ("Unlicense", (24,)),
    ("Proprietary", (13,)),
]
#: "All rights reserved." right after a copyright line is this, and a licence of its own only where no other is found.
RESERVED, RESERVED_ID, RESERVED_NAME = "all rights reserved", 28, "Proprietary"
#: Every known sentence has one of these words, and sentences end at these places.
MARKERS = "licen[sc]e|copyright|permission|permitted|redistribut|rights reserved|free software|unencumbered|applicable law"
BREAK = r"[.!?:;]+[ \t\r]+|[\r\n]+"
#: Comment signs that lead a line, and what ends every sentence once lines end in newlines alone: punctuation before a space
#: or line end (its last sign alone: others become spaces), and blank lines. Nothing here repeats a group, as each
#: repetition of one takes stack in Java, and nothing is looked at again, so a text costs no more than its length.
SIGNS = r"(?m)^[ \t]*+(?:/\*++|\*++/?|//++!?|#++|--++|;++|%++|<!--)[ \t]*+"
ENDS = r"[.!?:;](?=\s)|\n[ \t]*+\n[ \t\n]*+"


def normalised(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def pieces(sentence: str) -> list[str]:
    """A known sentence as it is cut in a document, normalised."""
    return [p for p in map(normalised, re.split(BREAK, sentence)) if p]


def sentence_table(sentences: dict[int, str] = SENTENCES) -> dict[str, int]:
    """Normalised piece to identifier. A sentence that holds a break is known by its pieces with a marker, the longest."""
    table: dict[str, int] = {}
    for i, s in sentences.items():
        marked = [p for p in pieces(s) if re.search(MARKERS, p)]
        table.setdefault(max(marked, key=len), i)
    return table


def ordered_rules(rules: list[tuple[str, tuple[int, ...]]] = RULES) -> list[tuple[str, str]]:
    return [(name, "".join(f"<{i}>" for i in ids)) for name, ids in sorted(rules, key=lambda r: -len(r[1]))]


def identifiers(text: Column, table: dict[str, int]) -> Column:
    """The known sentences of a text, in order, as one string of ``<id>``."""
    lookup = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(f"<{v}>"))])
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(text), r"\r\n?", "\n"), "[|~]+", " "), SIGNS, "")
    # "|" ends a sentence; "~" is a line end, which may end one or lie within it.
    lines = F.regexp_replace(F.regexp_replace(plain, ENDS, " | "), r"\n+", " ~ ")
    clean = F.concat(F.lit("| "), F.trim(F.regexp_replace(lines, "[^a-z0-9|~]+", " ")), F.lit(" |"))
    if RESERVED in table:
        table = {**table, f"copyright {RESERVED}": RESERVED_ID}
        over = RESERVED.replace(" ", "(?: ~)? ")
        clean = F.regexp_replace(clean, rf"(?<=[|~] )((?:c )?copyright\b[^|~]*+[|~] [|~ ]*+){over}(?= [|~])", f"$1copyright {RESERVED}")
        lookup = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(f"<{v}>"))])
    known = "|".join(k.replace(" ", "(?: ~)? ") for k in sorted(table, key=len, reverse=True))
    hits = F.regexp_extract_all(clean, F.lit(f"(?<=[|~] )(?:{known})(?= [|~])"), F.lit(0))
    ids = F.array_join(F.transform(hits, lambda s: F.try_element_at(lookup, F.replace(s, F.lit(" ~"), F.lit("")))), "")
    return F.when(F.lower(text).rlike(MARKERS.replace(" ", "[^a-z0-9]+")), ids).otherwise(F.lit(""))


def scan_licenses(
    docs: DataFrame, sentences: dict[int, str] = SENTENCES, rules: list[tuple[str, tuple[int, ...]]] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row a row of ``docs``: doc_id, n_known (known sentences), sentence_ids, licenses (distinct names, in the order
    of the rules, joined by commas; empty if none).

    Null text counts as empty. Repeated rows give repeated results; other columns are ignored; an empty table gives an
    empty result. Whole texts are read.
    """
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), identifiers(text_or_empty(text_col), sentence_table(sentences)).alias("sentence_ids"))
    start = F.struct(F.col("sentence_ids").alias("rest"), F.array().cast("array<string>").alias("names"))
    table = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(p).alias("ids")) for n, p in ordered_rules(rules)))
    step = lambda acc, r: F.struct(
        F.replace(acc["rest"], r["ids"], F.lit("|")).alias("rest"),
        F.when(F.contains(acc["rest"], r["ids"]), F.concat(acc["names"], F.array(r["name"]))).otherwise(acc["names"]).alias("names"),
    )
    names = F.array_join(F.array_distinct(F.aggregate(table, start, step, lambda acc: acc["names"])), ",")
    names = F.when((names == "") & F.contains("sentence_ids", F.lit(f"<{RESERVED_ID}>")), F.lit(RESERVED_NAME)).otherwise(names)
    known = (F.length("sentence_ids") - F.length(F.replace(F.col("sentence_ids"), F.lit("<"), F.lit("")))).cast("long")
    return found.select("doc_id", known.alias("n_known"), "sentence_ids", F.when(F.col("sentence_ids") == "", F.lit("")).otherwise(names).alias("licenses"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    """The same by another way: lines are cut into segments at sentence ends, and a known sentence is looked up as every
    row of neighbouring segments of one sentence."""
    table = ", ".join(f"('{k}', '<{v}>')" for k, v in sentence_table().items())
    most = max(len(k.split()) for k in sentence_table())
    rules = ordered_rules()
    steps = "s0 AS (SELECT doc_id, ids, ids AS rest, []::VARCHAR[] AS names FROM found)"
    for k, (name, ids) in enumerate(rules):
        steps += f",\ns{k + 1} AS (SELECT doc_id, ids, replace(rest, '{ids}', '|') AS rest, CASE WHEN contains(rest, '{ids}') AND NOT list_contains(names, '{name}') THEN list_append(names, '{name}') ELSE names END AS names FROM s{k})"
    return f"""
WITH known(sentence, id) AS (VALUES {table}),
doc AS (SELECT doc_id, string_split(replace(replace(lower(text), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS ls FROM documents WHERE regexp_matches(lower(text), '{MARKERS.replace(" ", "[^a-z0-9]+")}')),
line AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS k FROM doc),
bare AS (SELECT doc_id, k, regexp_replace(l, '^[ \t]*(/[*]+|[*]+/?|//+!?|#+|--+|;+|%+|<!--)[ \t]*', '') AS l FROM line),
cut AS (SELECT doc_id, k, string_split_regex(l || ' ', '[.!?:;]+[ \t]') AS parts, trim(l) = '' AS blank FROM bare),
seg AS (SELECT doc_id, k, unnest(parts) AS s, generate_subscripts(parts, 1) AS j, len(parts) AS n, blank FROM cut),
told AS (SELECT doc_id, trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')) AS s, row_number() OVER w AS r,
  coalesce(sum((j < n OR blank)::INT) OVER (PARTITION BY doc_id ORDER BY k, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM seg WINDOW w AS (PARTITION BY doc_id ORDER BY k, j)),
word AS (SELECT *, lag(s) OVER (PARTITION BY doc_id ORDER BY r) AS prior FROM told WHERE s <> ''),
whole AS (SELECT doc_id, sentence, list(s ORDER BY r) AS parts, list(r ORDER BY r) AS rs, list(coalesce(prior, '') ORDER BY r) AS priors FROM word GROUP BY doc_id, sentence),
start AS (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM whole),
span AS (SELECT doc_id, rs[i] AS r, priors[i] AS prior, array_to_string(parts[i:e], ' ') AS s FROM (SELECT *, unnest(range(i, least(len(parts), i + {most}) + 1)) AS e FROM start)),
hit AS (SELECT doc_id, string_agg(CASE WHEN s = '{RESERVED}' AND regexp_matches(prior, '^(c )?copyright( |$)') THEN '<{RESERVED_ID}>' ELSE id END, '' ORDER BY r) AS ids FROM span JOIN known ON s = sentence GROUP BY doc_id),
found AS (SELECT d.doc_id, coalesce(h.ids, '') AS ids FROM documents d LEFT JOIN hit h USING (doc_id)),
{steps}
SELECT doc_id, length(ids) - length(replace(ids, '<', '')) AS n_known, ids AS sentence_ids,
  CASE WHEN len(names) = 0 AND contains(ids, '<{RESERVED_ID}>') THEN '{RESERVED_NAME}' ELSE array_to_string(names, ',') END AS licenses FROM s{len(rules)}
"""


OP4_SQL = _oracle()
