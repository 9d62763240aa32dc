"""Licence scan by sentence rules.

A text is normalised to lower-case words with marks where sentences, clauses and lines end. A known
licence sentence that begins and ends at marks becomes an identifier, the longest first; inside it
single line ends and semicolons are white space, so wrapped texts count, but a blank line, the
end of a sentence or a list mark ends it. The identifiers of a document, in order, are matched against
licence rules: sequences of identifiers, tried in the listed order at each place, each match
using up its sentences. Sentences that are not known do not break a sequence.

Defined cases: NULL and empty texts have no sentences; repeated licence lines are reported each
time they occur; repeated rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence sentences, normalised, with their identifiers.
SENTENCES: dict[str, str] = {
    "mit-line": "released under the mit license",
    "mit-line-licensed": "licensed under the mit license",
    "mit-name": "the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache-line": "licensed under the apache license version 2 0",
    "apache-grant": "licensed under the apache license version 2 0 the license",
    "apache-terms": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "gpl3-line": "this work is licensed under the gnu general public license version 3",
    "gpl-grant": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc-by-nc-line": "licensed under cc by nc 4 0",
    "cc-by-line": "licensed under cc by 4 0",
    "cc-by-sa-line": "licensed under cc by sa 4 0",
    "cc-by-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "spdx-mit": "spdx license identifier mit",
    "spdx-apache": "spdx license identifier apache 2 0",
    "spdx-gpl3": "spdx license identifier gpl 3 0 only",
}
# Ordered rules; a longer rule stands before the rules it contains.
RULES: list[tuple[str, list[str]]] = [
    ("MIT", ["mit-name", "mit-grant", "mit-notice", "mit-warranty"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("MIT-partial", ["mit-grant", "mit-notice"]),
    ("MIT-partial", ["mit-grant"]),
    ("MIT-reference", ["mit-line"]),
    ("MIT-reference", ["mit-line-licensed"]),
    ("MIT-reference", ["mit-name"]),
    ("MIT-reference", ["spdx-mit"]),
    ("Apache-2.0", ["apache-grant", "apache-terms", "apache-copy"]),
    ("Apache-2.0-reference", ["apache-grant", "apache-terms"]),
    ("Apache-2.0-reference", ["apache-grant"]),
    ("Apache-2.0-reference", ["apache-line"]),
    ("Apache-2.0-reference", ["spdx-apache"]),
    ("GPL-3.0-or-later", ["gpl-grant", "gpl-hope"]),
    ("GPL-3.0-or-later", ["gpl-grant"]),
    ("GPL-3.0-reference", ["gpl3-line"]),
    ("GPL-3.0-reference", ["spdx-gpl3"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-line"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-line"]),
    ("CC-BY-4.0", ["cc-by-line"]),
    ("CC-BY-4.0", ["cc-by-work"]),
]
#: Every known sentence holds one of these words, so a text without any has no known sentence.
TRIGGERS = ["licens", "permission", "warrant", "permitted", "redistribut", "notice"]

#: Where sentences of texts without wrapped lines end, for the SQL of the query.
SENTENCE_END = r"[.!?;]\s+|\n"

#: Marks of a normalised text, in the order in which they are set: paragraphs and list marks,
#: sentences, clauses, lines. Capitals, as the words are in lower case.
MARKS = [
    (r"\n\s*\n", " X "),
    (r"(^|[\nX])\s*(?:\(?[0-9]{1,2}[.)]|\(?[a-z]\)|[-•])\s+", " X "),
    (r"[.!?]\s+", " X "),
    (r";\s+", " S "),
    (r"\n", " L "),
    (r"[^a-z0-9XSL]+", " "),
]


def _symbol(name: str) -> str:
    """One character for each identifier, so that rules become a regular expression."""
    return chr(0x4E00 + list(SENTENCES).index(name))


def _rule(sequence: list[str]) -> str:
    return "".join(map(_symbol, sequence))


def rule_pattern() -> str:
    return "|".join(dict.fromkeys(_rule(s) for _, s in RULES))


def sentence_pattern() -> str:
    """Known sentences between marks, over line ends and semicolons, in a normalised text."""
    longest = sorted(SENTENCES.values(), key=len, reverse=True)
    return "(?<=^|[XSL] )(?:" + "|".join(s.replace(" ", "(?: [SL])? ") for s in longest) + ")(?= [XSL]|$)"


def _lookup(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: known sentences in order, matched rules in order, and the licences, sorted."""
    whole = F.coalesce(F.col(text), F.lit(""))
    known = _lookup({v: _symbol(k) for k, v in SENTENCES.items()})
    marked = F.lower(whole)
    for pattern, mark in MARKS:
        marked = F.regexp_replace(marked, pattern, mark)
    hits = F.regexp_extract_all(F.trim(marked), F.lit(sentence_pattern()), F.lit(0))
    symbols = F.transform(hits, lambda s: F.element_at(known, F.regexp_replace(s, " [SL] ", " ")))
    likely = F.lower(whole).rlike("|".join(TRIGGERS))
    sequence = F.when(likely, F.array_join(symbols, "")).otherwise(F.lit(""))
    found = docs.select(F.col(doc_id).alias("doc_id"), sequence.alias("_seq"))
    names, rules = _lookup({_symbol(k): k for k in SENTENCES}), _lookup({_rule(s): name for name, s in reversed(RULES)})
    matched = F.transform(F.regexp_extract_all("_seq", F.lit(f"({rule_pattern()})"), F.lit(1)), lambda m: F.element_at(rules, m))
    letters = F.filter(F.split("_seq", ""), lambda c: c != "")
    out = found.select(
        "doc_id",
        F.length("_seq").cast("long").alias("n_sentences"),
        F.array_join(F.transform(letters, lambda c: F.element_at(names, c)), ",").alias("sentences"),
        matched.alias("_rules"),
    )
    return out.select(
        "doc_id", "n_sentences", "sentences",
        F.array_join("_rules", ",").alias("matches"),
        F.array_join(F.array_sort(F.array_distinct("_rules")), ",").alias("licences"),
    )
