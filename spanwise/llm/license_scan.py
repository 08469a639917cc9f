"""License scans by sentence-rule recognition.

A text is cut into sentences, each normalised to lower-case words. Lines are joined first, without
comment marks, as license texts are mostly wrapped; a closing mark with white space, a blank line and a
list mark end a sentence. Known license sentences get their identifiers, all others are passed over.
Identifiers of sentences that only a cut at every line break shows, such as notices of one line without a
full stop, follow those. The sequence of identifiers is matched against ordered rules, the longest first;
what a rule has used is not used again. One pass over the table in built-in functions, without a shuffle.

Results for odd input. Null or empty text has no sentence and no license; a very long text is read whole.
Repeated rows give repeated results; an empty table gives an empty result. A license that occurs more
than once is named once. Of rules with the same number of sentences the one listed first goes first.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import table

_ANY_LATER = "as published by the free software foundation either version {} of the license or at your option any later version"
_GNU = "you can redistribute it and or modify it under the terms of the gnu {} " + _ANY_LATER
_CC = {"CC-BY-4.0": "attribution", "CC-BY-SA-4.0": "attribution sharealike", "CC-BY-NC-4.0": "attribution noncommercial", "CC-BY-ND-4.0": "attribution noderivatives", "CC-BY-NC-SA-4.0": "attribution noncommercial sharealike", "CC-BY-NC-ND-4.0": "attribution noncommercial noderivatives"}
#: Names that notices of one line give to licenses.
NAMES = {
    "MIT": ["mit license"],
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache 2 0 license"],
    "BSD-2-Clause": ["bsd 2 clause license", "simplified bsd license"],
    "BSD-3-Clause": ["bsd 3 clause license", "new bsd license"],
    "GPL-2.0-only": ["gnu general public license version 2", "gnu gpl version 2", "gplv2 license"],
    "GPL-3.0-only": ["gnu general public license version 3", "gnu gpl version 3", "gplv3 license"],
    "LGPL-2.1-only": ["gnu lesser general public license version 2 1"],
    "LGPL-3.0-only": ["gnu lesser general public license version 3"],
    "AGPL-3.0-only": ["gnu affero general public license version 3"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license 2 0"],
    "EPL-2.0": ["eclipse public license 2 0", "eclipse public license version 2 0"],
    "EPL-1.0": ["eclipse public license 1 0", "eclipse public license version 1 0"],
    "EUPL-1.2": ["european union public licence version 1 2"],
    "CDDL-1.0": ["common development and distribution license version 1 0"],
    "ISC": ["isc license"],
    "Zlib": ["zlib license"],
    "BSL-1.0": ["boost software license version 1 0", "boost software license 1 0"],
    "Artistic-2.0": ["artistic license 2 0"],
    "PostgreSQL": ["postgresql license"],
    "OFL-1.1": ["sil open font license version 1 1"],
    "WTFPL": ["wtfpl"],
    "Unlicense": ["unlicense"],
    "CC0-1.0": ["cc0 1 0 license", "cc0 1 0 universal license"],
}
_BEFORE = ["licensed under the", "released under the", "distributed under the", "this project is licensed under the", "this work is licensed under the", "this software is licensed under the", "this code is released under the"]
#: Sentences of widely used licenses as normalised text, by identifier.
SENTENCES = {
    "mit.grant": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
    ],
    "mit0.grant": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"
    ],
    "mit.notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit.warranty": [
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
    ],
    "bsd.grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd.source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd.binary": [
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
    ],
    "bsd.advertising": ["all advertising materials mentioning features or use of this software must display the following acknowledgement"],
    "bsd.names": [
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
    ],
    "isc.grant": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "0bsd.grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "postgresql.grant": [
        "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies"
    ],
    "zlib.warranty": ["this software is provided as is without any express or implied warranty"],
    "zlib.grant": [
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"
    ],
    "bsl.grant": [
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"
    ],
    "unlicense.domain": ["this is free and unencumbered software released into the public domain"],
    "wtfpl.terms": ["everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"],
    "apache.header": ["licensed under the apache license version 2 0 the license"],
    "apache.comply": ["you may not use this file except in compliance with the license"],
    "apache.copy": ["you may obtain a copy of the license at"],
    "apache.terms": ["terms and conditions for use reproduction and distribution"],
    "apache.definitions": ["license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document"],
    "gnu.free": ["this program is free software", "this library is free software"],
    "gpl2.later": [_GNU.format("general public license", 2)],
    "gpl3.later": [_GNU.format("general public license", 3)],
    "lgpl21.later": [_GNU.format("lesser general public license", "2 1")],
    "lgpl3.later": [_GNU.format("lesser general public license", 3)],
    "agpl3.later": [_GNU.format("affero general public license", 3)],
    "gnu.hope": [f"this {x} is distributed in the hope that it will be useful but without any warranty" for x in ("program", "library")],
    "mpl2.form": ["this source code form is subject to the terms of the mozilla public license v", "this source code form is subject to the terms of the mozilla public license version 2 0"],
    "epl2.terms": [
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which accompanies this distribution and is available at https www eclipse org legal epl 2 0",
    ],
    "reserved.line": ["all rights reserved"],
} | {f"{name}.line": [f"{before} {x}" for x in names for before in _BEFORE] for name, names in NAMES.items()} | {
    f"{name}.line": [f"{before} {x}" for before in ("licensed under", "this work is licensed under", "released under") for x in (name.lower().replace("-", " ").replace(".", " "), f"a creative commons {words} 4 0 international license")]
    for name, words in _CC.items()
}
#: License, and the identifiers that must follow each other.
RULES = [
    ("BSD-4-Clause", ["bsd.grant", "bsd.source", "bsd.binary", "bsd.advertising", "bsd.names"]),
    ("BSD-3-Clause", ["bsd.grant", "bsd.source", "bsd.binary", "bsd.names"]),
    ("BSD-2-Clause", ["bsd.grant", "bsd.source", "bsd.binary"]),
    ("BSD-1-Clause", ["bsd.grant", "bsd.source"]),
    ("MIT", ["mit.grant", "mit.notice", "mit.warranty"]),
    ("MIT-0", ["mit0.grant", "mit.warranty"]),
    ("Apache-2.0", ["apache.header", "apache.comply", "apache.copy"]),
    ("Apache-2.0", ["apache.terms", "apache.definitions"]),
    ("GPL-2.0-or-later", ["gnu.free", "gpl2.later", "gnu.hope"]),
    ("GPL-3.0-or-later", ["gnu.free", "gpl3.later", "gnu.hope"]),
    ("LGPL-2.1-or-later", ["gnu.free", "lgpl21.later", "gnu.hope"]),
    ("LGPL-3.0-or-later", ["gnu.free", "lgpl3.later", "gnu.hope"]),
    ("AGPL-3.0-or-later", ["gnu.free", "agpl3.later", "gnu.hope"]),
    ("Zlib", ["zlib.warranty", "zlib.grant"]),
    ("Apache-2.0", ["apache.header"]),
    ("ISC", ["isc.grant"]),
    ("0BSD", ["0bsd.grant"]),
    ("PostgreSQL", ["postgresql.grant"]),
    ("BSL-1.0", ["bsl.grant"]),
    ("Unlicense", ["unlicense.domain"]),
    ("WTFPL", ["wtfpl.terms"]),
    ("MPL-2.0", ["mpl2.form"]),
    ("EPL-2.0", ["epl2.terms"]),
    ("All-Rights-Reserved", ["reserved.line"]),
    *((name, [f"{name}.line"]) for name in [*NAMES, *_CC]),
]
#: Comment marks at the start of a line, blank lines, list marks, and the ends of sentences.
LEADERS, BLANK = r"\n[ \t]*(?:[*#>;|/]+|--+|<!--)[ \t]*", r"\n[ \t\n]*\n"
LIST, ENDS = r"\n[ \t]*\(?(?:[0-9]+|[a-z])[.)][ \t]", r"[.!?;:]+[ \t\n]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lines(text: Column) -> Column:
    """Lower-case lines without comment marks, each after a line break."""
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER + "\r", _LOWER)
    return F.regexp_replace(F.concat(F.lit("\n"), lower), LEADERS, "\n")


def _cut(marked: Column) -> Column:
    """Normalised sentences, between marks \\x01, that have a letter or digit of ASCII."""
    return F.filter(F.transform(F.split(F.regexp_replace(marked, r"[^a-z0-9\x01]+", " "), "\x01"), lambda s: F.trim(s)), lambda s: s != "")


def sentences_of(text: Column) -> Column:
    """Sentences of the text with its lines joined."""
    return _cut(F.regexp_replace(F.regexp_replace(F.regexp_replace(_lines(text), BLANK, ".\n"), LIST, ".\n"), ENDS, "\x01"))


def line_sentences_of(text: Column) -> Column:
    """Sentences of each line by itself."""
    return _cut(F.regexp_replace(_lines(text), r"[.!?;:]+[ \t\n]+|\n", "\x01"))


def _known(sentences: dict[str, list[str]]) -> dict[str, str]:
    return {s: name for name, group in sentences.items() for s in group}


def recognize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, list[str]] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    """One row per row of `docs`: id, n_sentences, sentence_ids array, licenses array."""
    known = _known(sentences)
    names = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    ordered = sorted(rules, key=lambda r: -len(r[1]))
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), F.lit("|" + "||".join(ids) + "|").alias("ids")) for name, ids in ordered))
    start = F.struct(F.array_join(F.transform("sentence_ids", lambda s: F.concat(F.lit("|"), s, F.lit("|"))), "").alias("left"), F.array().cast("array<string>").alias("hits"))

    def step(held: Column, rule: Column) -> Column:
        hit = held["left"].contains(rule["ids"])
        return F.struct(F.replace(held["left"], rule["ids"], F.lit("/")).alias("left"), F.when(hit, F.array_union(held["hits"], F.array(rule["name"]))).otherwise(held["hits"]).alias("hits"))

    hits = lambda of: F.transform(F.filter(of, lambda s: s.isin(list(known))), lambda s: names[s])
    found = docs.select(F.col(id_col), sentences_of(F.col(text_col)).alias("sentences"), hits(line_sentences_of(F.col(text_col))).alias("of_lines"))
    found = found.select(id_col, F.size("sentences").cast("long").alias("n_sentences"), hits(F.col("sentences")).alias("whole"), "of_lines")
    only_lines = F.filter("of_lines", lambda s: ~F.array_contains("whole", s))
    found = found.select(id_col, "n_sentences", F.concat("whole", only_lines).alias("sentence_ids"))
    licenses = F.when(F.size("sentence_ids") > 0, F.aggregate(wanted, start, step)["hits"]).otherwise(F.array().cast("array<string>"))
    return found.withColumn("licenses", F.array_sort(licenses))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recognize(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_sentences", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def _sql() -> str:
    known = ", ".join(f"('{s}', '{name}')" for s, name in _known(SENTENCES).items())
    ordered = sorted(RULES, key=lambda r: -len(r[1]))
    left, hits = "joined", []
    steps = []
    for k, (name, ids) in enumerate(ordered):
        pattern = "|" + "||".join(ids) + "|"
        steps.append(f"r{k} AS (SELECT *, replace(left{k}, '{pattern}', '/') AS left{k + 1}, contains(left{k}, '{pattern}') AS hit{k} FROM {f'r{k - 1}' if k else 'seqs'})")
        hits.append(f"CASE WHEN hit{k} THEN '{name}' END")
    return f"""
WITH known(sentence, name) AS (VALUES {known}),
lines AS (SELECT doc_id, regexp_replace(chr(10) || translate(coalesce(text, ''), '{_UPPER}' || chr(13), '{_LOWER}'), '{LEADERS}', chr(10), 'g') AS t FROM documents),
cut AS (
  SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '{BLANK}', '.' || chr(10), 'g'), '{LIST}', '.' || chr(10), 'g'), '{ENDS}', chr(1), 'g') AS joined,
    regexp_replace(t, '[.!?;:]+[ \\t\\n]+|\\n', chr(1), 'g') AS by_line
  FROM lines
),
clean AS (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(joined, '[^a-z0-9\\x01]+', ' ', 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') AS sentences,
    list_filter(list_transform(string_split(regexp_replace(by_line, '[^a-z0-9\\x01]+', ' ', 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') AS by_line
  FROM cut
),
whole AS (SELECT doc_id, 0 AS part, k, name FROM (SELECT doc_id, unnest(sentences) AS sentence, generate_subscripts(sentences, 1) AS k FROM clean) JOIN known USING (sentence)),
flat AS (
  SELECT * FROM whole
  UNION ALL
  SELECT doc_id, 1 AS part, k, name FROM (SELECT doc_id, unnest(by_line) AS sentence, generate_subscripts(by_line, 1) AS k FROM clean) l JOIN known USING (sentence)
  WHERE NOT EXISTS (SELECT 1 FROM whole w WHERE w.doc_id = l.doc_id AND w.name = known.name)
),
seqs AS (
  SELECT c.doc_id, CAST(len(c.sentences) AS BIGINT) AS n_sentences, coalesce(f.ids, '') AS sentence_ids, coalesce(f.joined, '') AS left0
  FROM clean c LEFT JOIN (
    SELECT doc_id, string_agg(name, ',' ORDER BY part, k) AS ids, string_agg('|' || name || '|', '' ORDER BY part, k) AS joined FROM flat GROUP BY doc_id
  ) f USING (doc_id)
),
{", ".join(steps)}
SELECT doc_id, n_sentences, sentence_ids,
       array_to_string(list_sort(list_distinct(list_filter([{", ".join(hits)}], lambda x: x IS NOT NULL))), ',') AS licenses
FROM r{len(ordered) - 1}
"""


OP9_SQL = _sql()
