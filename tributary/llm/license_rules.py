"""Licence scan by sentence rules.

A text is normalised to lower-case words with marks where a sentence may begin
or end: at line ends and at sentence ends.  Known licence sentences have
identifiers; one is found wherever its words stand between two marks, whatever
marks are between them.  So a wrapped notice is found under a line without a
full stop, and notices on lines of their own beside notices inside paragraphs.
A text becomes the sequence of the identifiers it holds, in text order.  A
licence is recognised where one of its rules, an ordered list of identifiers,
occurs in that sequence (other known sentences may stand between); of the rules
of a licence the first that matches, from long to short, is reported.

Everything is DataFrame functions inside one projection: no shuffle.  Only
texts with one of the ``CUES``, which every known sentence has, are searched.

Rows: null and empty texts have no sentences and no licences; repeated rows
get equal results; other columns are ignored; an empty table gives an empty
table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, fold

# Sentences of public licences and the usual ways to name one.
SENTENCES = {
    "mit-named": "Released under the MIT License.",
    "mit-named-2": "Licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                 "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
                 "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
                 "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
                 "following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial "
                  "portions of the Software.",
    "as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED "
             "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "apache-named": "Licensed under the Apache License, Version 2.0.",
    "apache-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                     "compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl3-named": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                 "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                 "option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
                    "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                 "that the following conditions are met:",
    "cc-by-nc-named": "Licensed under CC BY-NC 4.0.",
    "cc-by-named": "Licensed under CC BY 4.0.",
    "cc-by-sa-named": "Licensed under CC BY-SA 4.0.",
    "cc0-named": "Dedicated to the public domain under CC0 1.0.",
}
# Licences by their ordered sentences.
RULES = {
    "MIT": [["mit-grant", "mit-notice", "as-is"], ["mit-grant", "mit-notice"], ["mit-named"], ["mit-named-2"]],
    "Apache-2.0": [["apache-notice", "apache-copy"], ["apache-notice"], ["apache-named"]],
    "GPL-3.0": [["gpl-grant", "gpl-warranty"], ["gpl-grant"], ["gpl3-named"]],
    "BSD": [["bsd-grant", "as-is"], ["bsd-grant"]],
    "CC-BY-NC-4.0": [["cc-by-nc-named"]],
    "CC-BY-4.0": [["cc-by-named"]],
    "CC-BY-SA-4.0": [["cc-by-sa-named"]],
    "CC0-1.0": [["cc0-named"]],
}
CUES = ("licen", "permission", "warranty", "redistribution", "public domain")
SENTENCE_END = rf"(?<=[.!?]){GAP}|(?<=:){GAP}(?=[A-Z0-9(])"
LINE_END = r"[\n\x0B\x0C\r]"


def normal_key(sentence: str) -> str:
    """The normalised form of a known sentence (ASCII)."""
    return " ".join("".join(c if c.isalnum() else " " for c in sentence.lower()).split())


def _normal(text: Column) -> Column:
    """Lower-case words between line feeds where a sentence may begin or end
    and spaces elsewhere; the first and the last character are line feeds."""
    marked = F.regexp_replace(F.regexp_replace(text, SENTENCE_END, "\n"), LINE_END, "\n")
    marked = F.concat(F.lit("\n"), marked, F.lit("\n"))
    return F.regexp_replace(F.regexp_replace(F.lower(marked), r"[^\p{L}\p{N}\n]+", " "), r" ?\n[ \n]*", "\n")


def _identifiers(normal: Column) -> Column:
    """Identifiers of the known sentences of a normalised text, in their order;
    of sentences that begin at one place the longest."""
    keys = {normal_key(text): k for k, text in SENTENCES.items()}
    known = F.create_map(*[F.lit(x) for key, k in keys.items() for x in (key, k)])
    some = "|".join(key.replace(" ", r"[ \n]") for key in sorted(keys, key=len, reverse=True))
    found = F.regexp_extract_all(normal, F.lit(rf"(?<=\n)(?:{some})(?=\n)"), F.lit(0))
    return F.transform(found, lambda s: F.element_at(known, F.translate(s, "\n", " ")))


def _holds(sequence: Column, rule: list[str]) -> Column:
    """Whether the identifiers occur in this order in ' a b c '."""
    return sequence.like("% " + " %".join(f"{k} " for k in rule) + "%")


def _licences(sequence: Column) -> Column:
    """Array of structs (licence, rule) recognised in a sequence."""
    found = []
    for name, rules in RULES.items():
        hit = F.lit(None).cast("string")
        for rule in reversed(rules):
            hit = F.when(_holds(sequence, rule), F.lit(" ".join(rule))).otherwise(hit)
        found.append(F.when(hit.isNotNull(), F.struct(F.lit(name).alias("licence"), hit.alias("rule"))))
    return F.array_compact(F.array(*found))


def scan_licences(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, sentences (identifiers in text order), licences
    (structs of licence and rule)."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold().alias("text"))
    cue = F.col("text").rlike("(?i)" + "|".join(c.replace(" ", r"\s+") for c in CUES))
    df = df.withColumn("cued", F.when(cue, F.col("text")).otherwise(""))
    df = df.select("doc_id", _identifiers(_normal(F.col("cued"))).alias("sentences"))
    df = df.withColumn("sequence", F.concat(F.lit(" "), F.array_join("sentences", "  "), F.lit(" ")))
    return df.select("doc_id", "sentences", _licences(F.col("sequence")).alias("licences"))
