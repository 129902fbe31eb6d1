"""Licence scan by sentence rules.

A text is cut into sentences, each sentence is normalised and looked up in a fixed table of
known licence sentences, and the resulting sequence of identifiers is matched against
ordered rules; a rule consumes the identifiers it matches, so a full licence text is not
reported again by a weaker rule. Everything is a column expression: no shuffle, no join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storytrack.llm.common import table

# Normalised sentences of public licence texts and notices, by identifier.
SENTENCES = {
    "rights": ["all rights reserved"],
    "mit-ref": ["released under the mit license", "licensed under the mit license",
                "this project is licensed under the mit license", "distributed under the mit license",
                "this code is licensed under the mit license", "the mit license", "mit license"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and "
                  "associated documentation files the software to deal in the software without restriction including "
                  "without limitation the rights to use copy modify merge publish distribute sublicense and/or sell "
                  "copies of the software and to permit persons to whom the software is furnished to do so subject to "
                  "the following conditions"],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or "
                   "substantial portions of the software"],
    "as-is": ["the software is provided as is without warranty of any kind express or implied including but not "
              "limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "mit-liability": ["in no event shall the authors or copyright holders be liable for any claim damages or other "
                      "liability whether in an action of contract tort or otherwise arising from out of or in "
                      "connection with the software or the use or other dealings in the software"],
    "apache2-ref": ["licensed under the apache license version 2.0",
                    "this project is licensed under the apache license version 2.0",
                    "released under the apache license version 2.0", "apache license version 2.0"],
    "apache2-header": ["licensed under the apache license version 2.0 the license",
                       "this file is licensed under the apache license version 2.0 the license"],
    "apache2-comply": ["you may not use this file except in compliance with the license"],
    "apache2-copy": ["you may obtain a copy of the license at http //www.apache.org/licenses/license-2.0",
                     "you may obtain a copy of the license at https //www.apache.org/licenses/license-2.0",
                     "you may obtain a copy of the license at"],
    "apache2-asis": ["unless required by applicable law or agreed to in writing software distributed under the license "
                     "is distributed on an as is basis without warranties or conditions of any kind either express or "
                     "implied"],
    "gpl3-ref": ["this work is licensed under the gnu general public license version 3",
                 "licensed under the gnu general public license version 3",
                 "this program is licensed under the gnu general public license version 3"],
    "gpl2-ref": ["this work is licensed under the gnu general public license version 2",
                 "licensed under the gnu general public license version 2",
                 "this program is licensed under the gnu general public license version 2"],
    "free-software": ["this program is free software", "this file is free software", "this library is free software"],
    "gpl3+-terms": ["you can redistribute it and/or modify it under the terms of the gnu general public license as "
                    "published by the free software foundation either version 3 of the license or at your option any "
                    "later version"],
    "gpl2+-terms": ["you can redistribute it and/or modify it under the terms of the gnu general public license as "
                    "published by the free software foundation either version 2 of the license or at your option any "
                    "later version"],
    "gpl2-terms": ["you can redistribute it and/or modify it under the terms of the gnu general public license "
                   "version 2 as published by the free software foundation"],
    "lgpl21+-terms": ["you can redistribute it and/or modify it under the terms of the gnu lesser general public "
                      "license as published by the free software foundation either version 2.1 of the license or at "
                      "your option any later version"],
    "lgpl3+-terms": ["you can redistribute it and/or modify it under the terms of the gnu lesser general public "
                     "license as published by the free software foundation either version 3 of the license or at your "
                     "option any later version"],
    "agpl3+-terms": ["you can redistribute it and/or modify it under the terms of the gnu affero general public license "
                     "as published by the free software foundation either version 3 of the license or at your option "
                     "any later version"],
    # Parts of notices with semicolons, each a sentence to the scanner.
    "gpl-terms": ["you can redistribute it and/or modify it under the terms of the gnu general public license as "
                  "published by the free software foundation"],
    "lgpl-terms": ["you can redistribute it and/or modify it under the terms of the gnu lesser general public license "
                   "as published by the free software foundation"],
    "agpl-terms": ["you can redistribute it and/or modify it under the terms of the gnu affero general public license "
                   "as published by the free software foundation"],
    "either-2+": ["either version 2 of the license or at your option any later version"],
    "either-2.1+": ["either version 2.1 of the license or at your option any later version"],
    "either-3+": ["either version 3 of the license or at your option any later version"],
    "version-2": ["version 2 of the license"],
    "version-2.1": ["version 2.1 of the license"],
    "version-3": ["version 3 of the license"],
    "gpl-hope": ["this program is distributed in the hope that it will be useful but without any warranty",
                 "this library is distributed in the hope that it will be useful but without any warranty"],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted "
                  "provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and "
                   "the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions "
                   "and the following disclaimer in the documentation and/or other materials provided with the "
                   "distribution"],
    "bsd-endorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse "
                    "or promote products derived from this software without specific prior written permission"],
    "isc-grant": ["permission to use copy modify and/or distribute this software for any purpose with or without fee is "
                  "hereby granted provided that the above copyright notice and this permission notice appear in all "
                  "copies",
                  "permission to use copy modify and distribute this software for any purpose with or without fee is "
                  "hereby granted provided that the above copyright notice and this permission notice appear in all "
                  "copies"],
    "mpl2-terms": ["this source code form is subject to the terms of the mozilla public license v"],
    "mpl2-copy": ["if a copy of the mpl was not distributed with this file you can obtain one at "
                  "http //mozilla.org/mpl/2.0/",
                  "if a copy of the mpl was not distributed with this file you can obtain one at "
                  "https //mozilla.org/mpl/2.0/"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "cc-by": ["licensed under cc by 4.0", "this work is licensed under cc by 4.0",
              "this work is licensed under a creative commons attribution 4.0 international license"],
    "cc-by-sa": ["licensed under cc by-sa 4.0", "this work is licensed under cc by-sa 4.0",
                 "this work is licensed under a creative commons attribution-sharealike 4.0 international license"],
    "cc-by-nc": ["licensed under cc by-nc 4.0", "this work is licensed under cc by-nc 4.0",
                 "this work is licensed under a creative commons attribution-noncommercial 4.0 international license"],
    "cc-by-nd": ["licensed under cc by-nd 4.0", "this work is licensed under cc by-nd 4.0"],
    "cc-by-nc-nd": ["licensed under cc by-nc-nd 4.0", "this work is licensed under cc by-nc-nd 4.0"],
    "cc0": ["released under cc0", "released under cc0 1.0", "licensed under cc0 1.0", "dedicated to the public domain"],
}

# Ordered rules; the first ones are the longest, so that they win.
RULES = [
    ("MIT", ["mit-ref", "mit-grant", "mit-notice", "as-is", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", ["apache2-header", "apache2-comply", "apache2-copy", "apache2-asis"]),
    ("Apache-2.0", ["apache2-header", "apache2-comply"]),
    ("GPL-3.0-or-later", ["free-software", "gpl3+-terms", "gpl-hope"]),
    ("GPL-3.0-or-later", ["free-software", "gpl3+-terms"]),
    ("GPL-2.0-or-later", ["free-software", "gpl2+-terms", "gpl-hope"]),
    ("GPL-2.0-or-later", ["free-software", "gpl2+-terms"]),
    ("GPL-2.0-only", ["free-software", "gpl2-terms", "gpl-hope"]),
    ("GPL-2.0-only", ["free-software", "gpl2-terms"]),
    ("LGPL-2.1-or-later", ["free-software", "lgpl21+-terms", "gpl-hope"]),
    ("LGPL-2.1-or-later", ["free-software", "lgpl21+-terms"]),
    ("LGPL-3.0-or-later", ["free-software", "lgpl3+-terms", "gpl-hope"]),
    ("LGPL-3.0-or-later", ["free-software", "lgpl3+-terms"]),
    ("AGPL-3.0-or-later", ["free-software", "agpl3+-terms", "gpl-hope"]),
    ("AGPL-3.0-or-later", ["free-software", "agpl3+-terms"]),
    *[(f"{family}-{version}-{kind}", ["free-software", f"{family.lower()}-terms", part, *hope])
      for family, version, kind, part in [
          ("GPL", "2.0", "or-later", "either-2+"), ("GPL", "3.0", "or-later", "either-3+"),
          ("GPL", "2.0", "only", "version-2"), ("GPL", "3.0", "only", "version-3"),
          ("LGPL", "2.1", "or-later", "either-2.1+"), ("LGPL", "3.0", "or-later", "either-3+"),
          ("LGPL", "2.1", "only", "version-2.1"), ("LGPL", "3.0", "only", "version-3"),
          ("AGPL", "3.0", "or-later", "either-3+"), ("AGPL", "3.0", "only", "version-3")]
      for hope in (["gpl-hope"], [])],
    ("ISC", ["isc-grant"]),
    ("MPL-2.0", ["mpl2-terms", "mpl2-copy"]), ("MPL-2.0", ["mpl2-terms"]),
    ("Unlicense", ["unlicense"]),
    ("MIT", ["mit-ref"]),
    ("Apache-2.0", ["apache2-header"]), ("Apache-2.0", ["apache2-ref"]),
    ("GPL-3.0-only", ["gpl3-ref"]),
    ("GPL-2.0-only", ["gpl2-ref"]),
   
   
    ("CC-BY-NC-ND-4.0", ["cc-by-nc-nd"]), ("CC-BY-NC-4.0", ["cc-by-nc"]), ("CC-BY-SA-4.0", ["cc-by-sa"]),
    ("CC-BY-ND-4.0", ["cc-by-nd"]), ("CC-BY-4.0", ["cc-by"]), ("CC0-1.0", ["cc0"]),
    ("all-rights-reserved", ["rights"]),
]

# Identifiers of SPDX expressions, and what the older ones among them are called now.
SPDX_IDS = ["0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-1.1", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause",
            "BSD-3-Clause", "BSD-4-Clause", "BSL-1.0", "CC-BY-3.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-NC-ND-4.0",
            "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC-BY-SA-3.0", "CC-BY-SA-4.0", "CC0-1.0", "CDDL-1.0", "EPL-1.0",
            "EPL-2.0", "EUPL-1.2", "GPL-1.0-only", "GPL-1.0-or-later", "GPL-2.0-only", "GPL-2.0-or-later",
            "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.0-only", "LGPL-2.0-or-later", "LGPL-2.1-only",
            "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0",
            "MS-PL", "OFL-1.1", "PSF-2.0", "Unlicense", "WTFPL", "Zlib"]
SPDX = {x.lower(): x for x in SPDX_IDS} | {
    old: new for x in SPDX_IDS if "GPL" in x for old, new in (
        [(x.lower().removesuffix("-only"), x)] if x.endswith("-only") else [(x.lower().removesuffix("-or-later") + "+", x)])}

# Every known sentence holds one of these, so a text without any of them has no known sentence.
# They are parts of single words: blanks and line ends of a text are as they are when it is tested.
CUES = ["licen", "reserved", "permi", "copyright", "warrant", "redistribut", "software", "domain", "cc0", "mpl"]

# An expression runs to the end of its line; what stands after "with" is an exception to a licence.
SPDX_EXPRESSION = r"spdx-license-identifier[ \t]*:[ \t]*([a-z0-9.+() \t-]+)"
SPDX_EXCEPTION = r"[ \t]with[ \t]+[a-z0-9.+-]+"
SPDX_TOKEN = r"[a-z0-9]+(?:[.+-]+[a-z0-9]+)*\+?"
COMMENT_LEAD = r"(^|\n)[ \t]*(//+|/\*+|\*+/?|#+|;+|--+|<!--)[ \t]*"
SENTENCE_END = r"[.;:!?]+([ \t\r\n]+|$)"
LINE_OR_SENTENCE_END = r"\n|[.;:!?]+([ \t\r\n]+|$)"
# What ends a sentence of a wrapped text without a full stop: blank lines, ends of comments, copyright lines.
CLOSING = r"[ \t]*\*+/[ \t\r]*(\n|$)"
COPYRIGHT_LINE = r"(^|\n)[ \t]*(copyright[ \t]*(\(c\)|©|[0-9])|\(c\)|©)[^\n]*"
PARAGRAPH_OR_SENTENCE_END = r"\n[ \t\r]*\n[ \t\r\n]*|[.;:!?]+([ \t\r\n]+|$)"
NOT_KEPT = r"[^a-z0-9.+/-]+"


def _sentence_map() -> Column:
    pairs = [F.lit(x) for ident, texts in SENTENCES.items() for text in texts for x in (text, ident)]
    return F.create_map(*pairs)


def _identifiers(text: Column, end: str) -> Column:
    """Identifiers of the known sentences of a prepared text, in order, as '<a><b>…'."""
    known = _sentence_map()
    sentences = F.transform(F.split(text, end), lambda s: F.btrim(F.regexp_replace(s, NOT_KEPT, " "), F.lit(" .-")))
    ids = F.transform(sentences, lambda s: F.try_element_at(known, s))
    named = F.transform(F.filter(ids, lambda x: x.isNotNull()), lambda x: F.concat(F.lit("<"), x, F.lit(">")))
    return F.array_join(named, "")


def _licences(ids: Column) -> Column:
    """Licences named by the ordered rules, each once, in order of place in the text."""
    for name, seq in RULES:
        ids = F.replace(ids, F.lit("".join(f"<{x}>" for x in seq)), F.lit(f"<={name}>"))
    return F.array_distinct(F.regexp_extract_all(ids, F.lit("<=([^>]+)>"), F.lit(1)))


def _spdx(text: Column) -> Column:
    """Names of the licences in the SPDX expressions of a lower-case text, in order, each once."""
    names = F.create_map(*[F.lit(x) for pair in SPDX.items() for x in pair])
    expressions = F.array_join(F.regexp_extract_all(text, F.lit(SPDX_EXPRESSION), F.lit(1)), " ; ")
    tokens = F.regexp_extract_all(F.regexp_replace(expressions, SPDX_EXCEPTION, " "), F.lit(SPDX_TOKEN), F.lit(0))
    return F.array_distinct(F.filter(F.transform(tokens, lambda x: F.try_element_at(names, x)), lambda x: x.isNotNull()))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, sentence_ids, licenses (both arrays of strings).

    Sentences are read three times: with line ends as sentence ends (notices on a line of their
    own), with line ends as spaces (wrapped licence texts, comment leaders removed), and with
    only blank lines, comment ends and copyright lines as sentence ends (wrapped texts after a title or a
    copyright line without a full stop); the sequences are matched apart and their findings
    united. The licences of SPDX expressions come last (sentence id ``spdx-<licence>``): those
    joined by OR, AND and parentheses all count, exceptions after WITH do not, unknown names
    are passed over. Null and empty texts have empty arrays, an empty table gives no rows;
    whole texts of any length are read; repeated rows are scanned apart; other columns are ignored.
    """
    lowered = docs.select(F.col(id_col), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_t"))
    cue = reduce(lambda a, b: a | b, [F.contains(F.col("_t"), F.lit(c)) for c in CUES])
    prepared = lowered.select(F.col(id_col), F.when(cue, F.col("_t")).alias("_t"),
                              F.when(cue, F.regexp_replace(F.col("_t"), COMMENT_LEAD, "$1")).alias("_p"))
    found = prepared.select(
        F.col(id_col),
        F.when(F.col("_p").isNotNull(), _identifiers(F.col("_p"), LINE_OR_SENTENCE_END)).alias("_lines"),
        F.when(F.col("_p").isNotNull(), _identifiers(F.replace(F.col("_p"), F.lit("\n"), F.lit(" ")), SENTENCE_END))
        .alias("_flow"),
        F.when(F.col("_p").isNotNull(), _identifiers(F.regexp_replace(
            F.regexp_replace(F.col("_p"), CLOSING, "\n\n"), COPYRIGHT_LINE, "\n\n"), PARAGRAPH_OR_SENTENCE_END))
        .alias("_paragraphs"),
        F.when(F.col("_t").isNotNull(), _spdx(F.col("_t"))).alias("_spdx"))
    named = F.lit("<([^>]+)>")
    empty = F.array().cast("array<string>")
    readings = ["_lines", "_flow", "_paragraphs"]
    spdx_ids = F.transform("_spdx", lambda x: F.concat(F.lit("spdx-"), x))
    return found.select(
        F.col(id_col),
        F.when(F.col("_lines").isNull(), empty).otherwise(reduce(F.array_union, [
            *[F.regexp_extract_all(F.col(c), named, F.lit(1)) for c in readings], spdx_ids])).alias("sentence_ids"),
        F.when(F.col("_lines").isNull(), empty).otherwise(
            reduce(F.array_union, [*[_licences(F.col(c)) for c in readings], F.col("_spdx")])).alias("licenses"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"),
                        F.array_join("licenses", ",").alias("licenses"))


def _sql() -> str:
    values = ", ".join("('" + t + "', '" + i + "')" for i, texts in SENTENCES.items() for t in texts)
    names = ", ".join("('" + k + "', '" + v + "')" for k, v in SPDX.items())
    rules = "s"
    for name, seq in RULES:
        rules = f"replace({rules}, '{''.join(f'<{x}>' for x in seq)}', '<={name}>')"
    ordered = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"  # first places only
    return rf"""
WITH known(sentence, ident) AS (VALUES {values}),
names(token, licence) AS (VALUES {names}),
low AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents),
prep AS (SELECT doc_id, regexp_replace(t, '{COMMENT_LEAD}', '\1', 'g') AS p FROM low),
parts AS (
  SELECT doc_id, 1 AS way, string_split_regex(p, '{LINE_OR_SENTENCE_END}') AS ss FROM prep
  UNION ALL
  SELECT doc_id, 2, string_split_regex(replace(p, chr(10), ' '), '{SENTENCE_END}') FROM prep
  UNION ALL
  SELECT doc_id, 3, string_split_regex(regexp_replace(regexp_replace(p, '{CLOSING}', chr(10) || chr(10), 'g'),
    '{COPYRIGHT_LINE}', chr(10) || chr(10), 'g'), '{PARAGRAPH_OR_SENTENCE_END}') FROM prep),
one AS (
  SELECT doc_id, way, i, trim(regexp_replace(ss[i], '{NOT_KEPT}', ' ', 'g'), ' .-') AS sentence
  FROM (SELECT doc_id, way, ss, unnest(range(1, len(ss) + 1)) AS i FROM parts)),
seqs AS (
  SELECT doc_id, way, string_agg('<' || ident || '>', '' ORDER BY i) AS s
  FROM one JOIN known USING (sentence) GROUP BY 1, 2),
ruled AS (SELECT doc_id, way, s, {rules} AS r FROM seqs),
tokens AS (
  SELECT doc_id, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS token FROM (
    SELECT doc_id, regexp_extract_all(regexp_replace(array_to_string(
      regexp_extract_all(t, '{SPDX_EXPRESSION}', 1), ' ; '), '{SPDX_EXCEPTION}', ' ', 'g'), '{SPDX_TOKEN}') AS x FROM low)),
spdx AS (SELECT doc_id, list(licence ORDER BY i) AS l FROM tokens JOIN names USING (token) GROUP BY doc_id),
every AS (
  SELECT doc_id, string_agg(s, '' ORDER BY way) AS s, string_agg(r, '' ORDER BY way) AS r FROM ruled GROUP BY doc_id),
lists AS (
  SELECT doc_id, list_concat(regexp_extract_all(coalesce(s, ''), '<([^>]+)>', 1), [('spdx-' || x) FOR x IN coalesce(l, [])]) AS ids,
    list_concat(regexp_extract_all(coalesce(r, ''), '<=([^>]+)>', 1), coalesce(l, [])) AS lic
  FROM every FULL JOIN spdx USING (doc_id))
SELECT d.doc_id, coalesce(array_to_string({ordered.format('ids')}, ','), '') AS sentence_ids,
  coalesce(array_to_string({ordered.format('lic')}, ','), '') AS licenses
FROM documents d LEFT JOIN lists USING (doc_id)
"""


OP1_SQL = _sql()
