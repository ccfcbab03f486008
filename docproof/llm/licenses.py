"""Licence scans by sentence rules. DataFrame operations only, no shuffle.

A text is cut into sentences at punctuation and blank lines, each normalised to lower-case words of
letters and digits. A single line break, with the comment marks of the next line, is a blank inside a
known sentence and an end elsewhere, so that hard-wrapped and commented texts are read like flowing ones. A line with an SPDX
identifier is one sentence for each identifier of its expression. Known licence sentences become identifiers, and the sequence
of identifiers is matched against ordered rules. A rule that matches names a licence and consumes its identifiers, so that a
longer rule stands before the shorter ones it contains.

Defined cases: null or empty text has no known sentence and no licence; rows are judged one by one,
so ties, repeated rows and null ids change nothing; an empty table gives no rows; further columns
are ignored. Runs of blanks, tabs and punctuation inside a sentence count as one blank.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docproof.llm._common import table

# Public licence sentences in normalised form, by identifier.
SENTENCES = {
    "ApacheTitle": "apache license version 2 0 january 2004",
    "ApacheLine": "licensed under the apache license version 2 0",
    "ApacheGrant": "licensed under the apache license version 2 0 the license",
    "ApacheUse": "you may not use this file except in compliance with the license",
    "ApacheAsIs": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "ApacheSee": "see the license for the specific language governing permissions and limitations under the license",
    "MitLine": "released under the mit license",
    "MitGrant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "Mit0Grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    "MitNotice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "MitAsIs": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "MitLiable": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "IscGrant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "ZeroBsdGrant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "IscAsIs": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "BsdGrant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "BsdSource": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "BsdBinary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "BsdAdvertise": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "BsdEndorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "BsdAsIs": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "Gpl1Title": "gnu general public license version 1 february 1989",
    "Gpl2Title": "gnu general public license version 2 june 1991",
    "Gpl3Title": "gnu general public license version 3 29 june 2007",
    "Lgpl20Title": "gnu library general public license version 2 june 1991",
    "Lgpl21Title": "gnu lesser general public license version 2 1 february 1999",
    "Lgpl3Title": "gnu lesser general public license version 3 29 june 2007",
    "Agpl3Title": "gnu affero general public license version 3 19 november 2007",
    "Gfdl13Title": "gnu free documentation license version 1 3 3 november 2008",
    "Gpl3Line": "this work is licensed under the gnu general public license version 3",
    "GplFree": "this program is free software",
    "LgplFree": "this library is free software",
    "Gpl2Later": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "Gpl3Later": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "Gpl2Only": "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "Lgpl21Later": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "Lgpl3Later": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "Agpl3Later": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "GplTerms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "LgplTerms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "LibraryTerms": "you can redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation",
    "Later2": "either version 2 of the license or at your option any later version",
    "Later21": "either version 2 1 of the license or at your option any later version",
    "Later3": "either version 3 of the license or at your option any later version",
    "Mpl2Title": "mozilla public license version 2 0",
    "Mpl2Terms": "this source code form is subject to the terms of the mozilla public license v",
    "Mpl2Copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "Mpl2CopySafe": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "Epl1Title": "eclipse public license v 1 0",
    "Epl2Title": "eclipse public license v 2 0",
    "Cddl1Title": "common development and distribution license cddl version 1 0",
    "BoostTitle": "boost software license version 1 0 august 17th 2003",
    "BoostLine": "distributed under the boost software license version 1 0",
    "Unlicense": "this is free and unencumbered software released into the public domain",
    "Cc0Title": "cc0 1 0 universal",
    "CcBy4Title": "creative commons attribution 4 0 international public license",
    "CcBySa4Title": "creative commons attribution sharealike 4 0 international public license",
    "CcByNc4Title": "creative commons attribution noncommercial 4 0 international public license",
    "CcByNd4Title": "creative commons attribution noderivatives 4 0 international public license",
    "CcByNc4Line": "licensed under cc by nc 4 0",
    "CcBySa4Line": "licensed under cc by sa 4 0",
    "CcBy4Line": "licensed under cc by 4 0",
    "ZlibAsIs": "this software is provided as is without any express or implied warranty",
    "ZlibGrant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "PostgresGrant": "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    "Ofl11Line": "this font software is licensed under the sil open font license version 1 1",
    "Artistic2Title": "the artistic license 2 0",
    "PythonTitle": "python software foundation license version 2",
}

# Identifiers of the SPDX list. Each is a sentence "spdx <identifier>" and a rule of its own.
SPDX = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-1.1", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0",
    "CC-BY-ND-4.0", "CC-BY-SA-4.0", "CC0-1.0", "CDDL-1.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "GFDL-1.3-only", "GPL-1.0-only", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0",
    "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.0-only", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", "NCSA",
    "OFL-1.1", "PostgreSQL", "PSF-2.0", "Unlicense", "WTFPL", "Zlib",
)


def plain(identifier: str) -> str:
    return re.sub("[^a-z0-9]+", " ", identifier.lower()).strip()


SENTENCES |= {"Spdx:" + x: "spdx " + plain(x) for x in SPDX}

# Ordered rules, identifiers in sequence and the licence they name.
RULES = [
    ("ApacheGrant ApacheUse ApacheAsIs ApacheSee", "Apache-2.0"),
    ("MitGrant MitNotice MitAsIs MitLiable", "MIT"),
    ("Mit0Grant MitAsIs MitLiable", "MIT-0"),
    ("IscGrant IscAsIs", "ISC"),
    ("ZeroBsdGrant IscAsIs", "0BSD"),
    ("BsdGrant BsdSource BsdBinary BsdAdvertise BsdEndorse BsdAsIs", "BSD-4-Clause"),
    ("BsdGrant BsdSource BsdBinary BsdEndorse BsdAsIs", "BSD-3-Clause"),
    ("BsdGrant BsdSource BsdBinary BsdEndorse", "BSD-3-Clause"),
    ("BsdGrant BsdSource BsdBinary BsdAsIs", "BSD-2-Clause"),
    ("GplFree Gpl3Later", "GPL-3.0-or-later"),
    ("GplFree Gpl2Later", "GPL-2.0-or-later"),
    ("GplFree Gpl2Only", "GPL-2.0-only"),
    ("GplFree GplTerms Later2", "GPL-2.0-or-later"),
    ("GplFree GplTerms Later3", "GPL-3.0-or-later"),
    ("GplFree Agpl3Later", "AGPL-3.0-or-later"),
    ("LgplFree LgplTerms Later21", "LGPL-2.1-or-later"),
    ("LgplFree LgplTerms Later3", "LGPL-3.0-or-later"),
    ("LgplFree LibraryTerms Later2", "LGPL-2.0-or-later"),
    ("LgplFree Lgpl21Later", "LGPL-2.1-or-later"),
    ("LgplFree Lgpl3Later", "LGPL-3.0-or-later"),
    ("GplFree Lgpl3Later", "LGPL-3.0-or-later"),
    ("Mpl2Terms Mpl2Copy", "MPL-2.0"),
    ("Mpl2Terms Mpl2CopySafe", "MPL-2.0"),
    ("ZlibAsIs ZlibGrant", "Zlib"),
    ("MitGrant MitNotice MitAsIs", "MIT"),
    ("BsdGrant BsdSource BsdBinary", "BSD-2-Clause"),
    ("ApacheGrant ApacheUse", "Apache-2.0"),
    ("MitGrant MitNotice", "MIT"),
    ("ApacheTitle", "Apache-2.0"),
    ("ApacheLine", "Apache-2.0"),
    ("MitLine", "MIT"),
    ("IscGrant", "ISC"),
    ("ZeroBsdGrant", "0BSD"),
    ("Gpl1Title", "GPL-1.0"),
    ("Gpl2Title", "GPL-2.0"),
    ("Gpl3Title", "GPL-3.0"),
    ("Gpl3Line", "GPL-3.0"),
    ("Lgpl20Title", "LGPL-2.0"),
    ("Lgpl21Title", "LGPL-2.1"),
    ("Lgpl3Title", "LGPL-3.0"),
    ("Agpl3Title", "AGPL-3.0"),
    ("Gfdl13Title", "GFDL-1.3"),
    ("Mpl2Title", "MPL-2.0"),
    ("Epl1Title", "EPL-1.0"),
    ("Epl2Title", "EPL-2.0"),
    ("Cddl1Title", "CDDL-1.0"),
    ("BoostTitle", "BSL-1.0"),
    ("BoostLine", "BSL-1.0"),
    ("Unlicense", "Unlicense"),
    ("Cc0Title", "CC0-1.0"),
    ("CcBy4Title", "CC-BY-4.0"),
    ("CcBySa4Title", "CC-BY-SA-4.0"),
    ("CcByNc4Title", "CC-BY-NC-4.0"),
    ("CcByNd4Title", "CC-BY-ND-4.0"),
    ("CcByNc4Line", "CC-BY-NC-4.0"),
    ("CcBySa4Line", "CC-BY-SA-4.0"),
    ("CcBy4Line", "CC-BY-4.0"),
    ("PostgresGrant", "PostgreSQL"),
    ("Ofl11Line", "OFL-1.1"),
    ("Artistic2Title", "Artistic-2.0"),
    ("PythonTitle", "PSF-2.0"),
]
#: The names of SPDX identifiers that the list has given up for the ones above.
RENAMED = {"GPL-2.0": "GPL-2.0", "GPL-3.0": "GPL-3.0"}
RULES += [("Spdx:" + x, RENAMED.get(x, x)) for x in SPDX]

#: Marks of sentence ends and of single line breaks in a normalised text.
END, BREAK = "\x01", "\x02"
KNOWN = f"(?<=[{END}{BREAK}])(?:" + "|".join(s.replace(" ", f"[ {BREAK}]") for s in sorted(SENTENCES.values(), key=len, reverse=True)) + f")(?=[{END}{BREAK}])"


def anchors(sentences: tuple[str, ...] = tuple(SENTENCES.values())) -> tuple[str, ...]:
    """Words of which each known sentence holds one, few of them: a text without any has no known sentence. Chosen greedily, the one in
    the most sentences first; only longer words, which ordinary texts rarely hold, are candidates."""
    left, out = [s.split() for s in sentences], []
    while left:
        words = {w for s in left for w in s if len(w) >= 4}
        best = max(words, key=lambda w: (sum(w in s for s in left), len(w), w))
        out.append(best)
        left = [s for s in left if best not in s]
    return tuple(out)


ANCHORS = anchors()


def spdx_lines(low: Column) -> Column:
    """Each line with an SPDX identifier becomes a sentence for every identifier of its expression."""
    marked = F.transform(
        F.split(low, r"\x0D\x0A?|\x0A"),
        lambda line: F.when(
            F.contains(line, F.lit("spdx-license-identifier:")),
            F.concat(F.lit("\n\nspdx "), F.regexp_replace(F.regexp_replace(F.substring_index(line, "spdx-license-identifier:", -1), r"([0-9])\+", "$1-or-later"), r"[\x20\t()]+(or|and|with)[\x20\t(]+", "\n\nspdx "), F.lit("\n\n")),
        ).otherwise(line),
    )
    return F.when(F.contains(low, F.lit("spdx-license-identifier:")), F.array_join(marked, "\n")).otherwise(low)


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    low = F.lower(text)
    anchored = F.lit(False)
    for a in ANCHORS:
        anchored = anchored | low.contains(a)
    known = F.create_map(*[F.lit(x) for name, sentence in SENTENCES.items() for x in (sentence, name)])
    s = F.concat(F.lit("\n\n"), F.translate(spdx_lines(low), END + BREAK, "##"), F.lit("\n\n"))
    for pattern, mark in (
        (r"\x0D\x0A?", "\n"),
        (r"\n[^a-z0-9\n]+", "\n"),  # indents, comment marks, bullets
        (r"\n\n+|[.!?:;]+[\x20\x09-\x0D]+", END),
        (r"\n", BREAK),
        (f"[^a-z0-9{END}{BREAK}]+", " "),
        (f" ?([{END}{BREAK}]) ?", "$1"),
    ):
        s = F.regexp_replace(s, pattern, mark)
    found = F.transform(F.regexp_extract_all(s, F.lit(KNOWN), F.lit(0)), lambda x: F.element_at(known, F.translate(x, BREAK, " ")))
    return F.when(anchored, found).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids, licenses (in rule order) and the identifiers that no rule used."""
    rows = docs.select("doc_id", sentence_ids(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("sentence_ids"))
    # most texts have no known sentence; rules are folded over the sequence, which is replaced as they consume it
    rules = F.array(*[F.struct(F.lit(" " + sequence.replace(" ", "  ") + " ").alias("pattern"), F.lit(name).alias("name")) for sequence, name in RULES])
    sequence = F.concat(F.lit(" "), F.array_join(F.transform("sentence_ids", lambda x: F.concat(x, F.lit(" "))), " "))
    start = F.struct(sequence.alias("rest"), F.array().cast("array<string>").alias("names"))

    def apply(a: Column, rule: Column) -> Column:
        hit = F.struct(F.replace(a["rest"], rule["pattern"], F.lit("  ")).alias("rest"), F.concat(a["names"], F.array(rule["name"])).alias("names"))
        return F.when(F.contains(a["rest"], rule["pattern"]), hit).otherwise(a)

    rows = rows.withColumn("__r", F.when(F.size("sentence_ids") > 0, F.aggregate(rules, start, apply)))
    rest = F.filter(F.split(F.coalesce("__r.rest", F.lit("")), " +"), lambda x: x != "")
    licenses = F.array_distinct(F.coalesce("__r.names", F.array().cast("array<string>")))
    return rows.select("doc_id", "sentence_ids", licenses.alias("licenses"), rest.alias("unmatched"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"),
        F.size("unmatched").cast("long").alias("n_unmatched"),
    )


def _sql() -> str:
    """Stated without the operator's patterns: lines are cleaned and put together word by word, with '|' where a sentence ends and '/' where only
    a line does; a known sentence stands between two such marks, its own words apart by blanks or '/'."""
    known = ", ".join(f"('{s}', '{n}')" for n, s in SENTENCES.items())
    steps, last = [], "joined"
    for k, (sequence, _) in enumerate(RULES):
        pattern = " " + sequence.replace(" ", "  ") + " "
        steps.append(f"r{k} AS (SELECT * REPLACE (replace(rest, '{pattern}', '  ') AS rest), contains(rest, '{pattern}') AS m{k} FROM {last})")
        last = f"r{k}"
    first = ", ".join(f"CASE WHEN m{k} THEN '{n}' END" for k, (_, n) in enumerate(RULES))
    spdx = "'| spdx ' || regexp_replace(regexp_replace(string_split(x, 'spdx-license-identifier:')[-1], '([0-9])\\+', '\\1-or-later', 'g'), '[ \t()]+(or|and|with)[ \t(]+', ' | spdx ', 'g') || ' |'"
    return rf"""
WITH known(sentence, name) AS (VALUES {known}),
lines AS (SELECT doc_id, list_transform(string_split(replace(replace(translate(lower(coalesce(text, '')), '|/', '##'), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)),
    lambda x: CASE WHEN contains(x, 'spdx-license-identifier:') THEN {spdx} ELSE regexp_replace(regexp_replace(x, '^[^a-z0-9]+', ''), '[.!?:;]+([ \t\v\f]+|$)', ' | ', 'g') END) AS l FROM documents),
flat AS (SELECT doc_id, '| ' || list_reduce(list_transform(l, lambda x: CASE WHEN regexp_matches(x, '[a-z0-9|]') THEN x ELSE '|' END), lambda a, b: a || ' / ' || b) || ' |' AS t FROM lines),
clean AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[^a-z0-9|/]+', ' ', 'g'), '([|/])', ' \1\1 ', 'g') AS t FROM flat),
tidy AS (SELECT doc_id, regexp_replace(t, ' +', ' ', 'g') AS t FROM clean),
hits AS (SELECT doc_id, name, t, '[|/] ' || replace(sentence, ' ', ' (?:// )*') || ' [|/]' AS pattern FROM tidy CROSS JOIN known WHERE contains(t, split_part(sentence, ' ', 1))),
pieces AS (SELECT doc_id, name, regexp_extract_all(t, pattern) AS m, regexp_split_to_array(t, pattern) AS g FROM hits WHERE regexp_matches(t, pattern)),
spots AS (SELECT doc_id, name, unnest(list_transform(range(1, len(m) + 1), lambda k: {{'k': list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0), 'n': length(m[k])}})) AS h FROM pieces),
named AS (SELECT doc_id, name, h.k AS k FROM spots a WHERE NOT EXISTS (SELECT 1 FROM spots b WHERE b.doc_id = a.doc_id AND b.h.n > a.h.n AND b.h.k <= a.h.k AND b.h.k + b.h.n >= a.h.k + a.h.n)),
sequences AS (
  SELECT doc_id, string_agg(name, ',' ORDER BY k) AS ids, ' ' || string_agg(name || ' ', ' ' ORDER BY k) AS rest FROM named GROUP BY doc_id
), joined AS (
  SELECT d.doc_id, coalesce(ids, '') AS sentence_ids, coalesce(rest, ' ') AS rest FROM documents d LEFT JOIN sequences USING (doc_id)
), {", ".join(steps)},
listed AS (SELECT *, list_filter([{first}], lambda x: x IS NOT NULL) AS l FROM {last})
SELECT doc_id, sentence_ids,
       coalesce(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ','), '') AS licenses,
       CAST(len(list_filter(string_split(rest, ' '), lambda x: x <> '')) AS BIGINT) AS n_unmatched
FROM listed
"""


OP6_SQL = _sql()
