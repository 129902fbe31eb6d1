"""Column-only operators: licence texts, seeds, hosts, markup, heavy hitters."""

import itertools
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from storytrack.llm import decontaminate, exact_dedup, license_scan, line_dedup
from storytrack.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
GPL = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version."""


@pytest.mark.parametrize("text, expected", [
    ("MIT License\n\nCopyright (c) 2020 A B\n\n" + MIT, ["MIT"]),
    ("/*\n" + GPL + "\n */\nint main();", ["GPL-3.0-or-later"]),
    ("text without end\nLicensed under CC BY-NC 4.0.\nmore", ["CC-BY-NC-4.0"]),
    ("// SPDX-License-Identifier: Apache-2.0\ncode", ["Apache-2.0"]),
    ("Released under the MIT License. All rights reserved.", ["MIT", "all-rights-reserved"]),
    ("This work is licensed under the GNU General Public License,\nversion 3.", ["GPL-3.0-only"]),
    ("no licence at all, permission denied", []),
])
def test_licences(spark, text, expected):
    got = license_scan.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.licenses == expected


GNU = """    This {what} is free software{mark} you can redistribute it and/or modify
    it under the terms of the GNU {family}General Public License as published by
    the Free Software Foundation{mark2} {version}

    This {what} is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU {family}General Public License for more details."""
LATER = "either version {} of the License, or\n    (at your option) any later version."


def gnu(name):
    """The standard notice of a GNU licence, in its older and its newer punctuation."""
    family, version, kind = name.split("-", 2)
    words = {"GPL": "", "LGPL": "Lesser ", "AGPL": "Affero "}[family]
    number = version.removesuffix(".0")
    upto = LATER.format(number) if kind == "or-later" else f"version {number} of the License."
    old = GNU.format(what="library" if family == "LGPL" else "program", mark=";", mark2=";", family=words, version=upto)
    new = GNU.format(what="program", mark=":", mark2=",", family=words, version=upto)
    return [old] + ([new] if kind == "or-later" else [])


BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
HEADERS = [
    *[(n, t) for n in ("GPL-2.0-or-later", "GPL-3.0-or-later", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-or-later",
                       "LGPL-3.0-or-later", "LGPL-2.1-only", "LGPL-3.0-only", "AGPL-3.0-or-later", "AGPL-3.0-only")
      for t in gnu(n)],
    ("GPL-2.0-only", """This program is free software; you can redistribute it and/or modify it
under the terms of the GNU General Public License version 2 as
published by the Free Software Foundation."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""),
    ("BSD-2-Clause", BSD2),
    ("BSD-3-Clause", BSD2 + """

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""),
    ("ISC", """Permission to use, copy, modify, and distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy."),
    ("MIT", MIT),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "This work is licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"), ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0"), ("CC0-1.0", "Dedicated to the public domain."),
    ("all-rights-reserved", "(c) 2020 Foo Inc. All rights\nreserved."),
]
EXPRESSIONS = [
    ("SPDX-License-Identifier: MIT OR Apache-2.0", ["MIT", "Apache-2.0"]),
    ("# spdx-license-identifier : LGPL-2.1-or-later", ["LGPL-2.1-or-later"]),
    ("/* SPDX-License-Identifier: (GPL-2.0+ WITH Linux-syscall-note) AND bsd-3-clause */\nint x;", ["GPL-2.0-or-later", "BSD-3-Clause"]),
    ("SPDX-License-Identifier: GPL-2.0.", ["GPL-2.0-only"]),
    ("<!-- SPDX-License-Identifier: CC-BY-SA-4.0 -->\nSPDX-License-Identifier: Own-1.0\nSPDX-License-Identifier: AGPL-3.0-only",
     ["CC-BY-SA-4.0", "AGPL-3.0-only"]),
]


def test_every_rule_has_a_header_here():
    assert {n for n, _ in HEADERS} == {n for n, _ in license_scan.RULES}


def notices():
    """Each header bare, as a comment, and after a title and copyright line without a full stop."""
    out = []
    for name, text in HEADERS:
        lines = text.split("\n")
        out += [(text, [name]), ("\n".join("// " + x.strip() for x in lines) + "\nint main() {}", [name]),
                ("/*\n" + "\n".join(" * " + x.strip() for x in lines) + "\n */\nint main();", [name]),
                ("Some title\n\nCopyright (c) 2020 Jane Doe\n\n" + text, [name])]
    return out + EXPRESSIONS


def test_full_headers_and_expressions(spark):
    rows = [(i, t) for i, (t, _) in enumerate(notices())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in license_scan.license_scan(docs).collect()}
    wrong = {(notices()[i][0][:60], tuple(notices()[i][1]), tuple(x)) for i, x in got.items() if x != notices()[i][1]}
    assert not wrong


def test_sql_reads_headers_alike(spark):
    rows = [(i, t) for i, (t, _) in enumerate(notices())] + [(10_000, None), (10_001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = license_scan.license_scan(docs).select(
        "doc_id", F.array_join("sentence_ids", ","), F.array_join("licenses", ",")).collect()
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert sorted(map(tuple, got)) == sorted(con.execute(license_scan.OP1_SQL).fetchall())


ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""


def test_wrapped_licences_after_lines_without_a_full_stop(spark):
    line = "Copyright (c) 2020 Jane Doe\n"
    rows = [(1, line + "\n" + ISC, ["ISC"]), (2, line + ISC, ["ISC"]), (3, line + "\n" + MIT, ["MIT"]),
            (4, "/*\n * " + line + " *\n" + GPL + "\n */\nint main();", ["GPL-3.0-or-later"]),
            (5, line + "\n" + GPL.replace(" * ", "")[:-1] + " */\nint main();", ["GPL-3.0-or-later"])]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    assert {r.doc_id: r.licenses for r in license_scan.license_scan(docs).collect()} == {r[0]: r[2] for r in rows}


@pytest.mark.parametrize("text, expected", [
    ("(c) 2020 Foo Inc. All rights\nreserved.", ["all-rights-reserved"]),
    ("This is dedicated. Dedicated to the public\ndomain.", ["CC0-1.0"]),
    ("(c) 2020 Foo Inc. All rights  reserved.", ["all-rights-reserved"]),
])
def test_cues_do_not_depend_on_blanks(spark, text, expected):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert license_scan.license_scan(docs).first().licenses == expected
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT 1 AS doc_id, ? AS text", [text])
    assert con.execute(ORACLE["op1_license_scan"]).fetchone()[-1] == ",".join(expected)


def test_order_of_sentences_matters(spark):
    first, second = MIT.split("\n\n")[:2]
    rows = [(1, first + "\n\n" + second), (2, second + "\n\n" + first)]
    got = {r.doc_id: r.licenses for r in license_scan.license_scan(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["MIT"], 2: []}


def test_rules_name_known_sentences_and_cues_cover_them():
    assert {x for _, seq in license_scan.RULES for x in seq} <= set(license_scan.SENTENCES)
    assert all(any(c in t for c in license_scan.CUES) for i, ts in license_scan.SENTENCES.items() for t in ts
               if i not in ("mit-liability", "gpl2-terms"))


def test_substituted_words_are_tolerated(spark):
    words = [f"w{i}" for i in range(40)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")

    def copy(changed, part=slice(None)):
        return "before it " + " ".join("x" if i in changed else w for i, w in enumerate(words[part])) + " and after"
    rows = [(1, copy(())), (2, copy((5, 13, 22, 31))), (3, copy((), slice(5, 30))), (4, copy(range(0, 40, 2))),
            (5, copy((), slice(0, 8))), (6, copy(()).upper().replace(" ", " -- "))]
    got = {r.doc_id for r in decontaminate.contaminated(
        spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {1, 2, 3, 6}


def substituted():
    """Documents with items of 5 to 30 words, as many words substituted as the rule allows, at random."""
    rng, items, docs = random.Random(4), [], []
    for n in range(5, 31):
        words = [f"w{n}x{i}" for i in range(n)]
        items.append((n, " ".join(words)))
        for k in range(12):
            lost = set(rng.sample(range(n), n - math.ceil(0.8 * n - 1e-9)))
            docs.append((n * 100 + k, "some words before " + " ".join("zz" if i in lost else w for i, w in enumerate(words))
                         + " and behind it " * (k % 3)))
    return items, docs


def test_short_items_are_found_with_substitutions(spark):
    """All of the patterns for items under 20 words; for longer ones those in a verified window of 20."""
    items, docs = substituted()
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                                     spark.createDataFrame(items, "item_id long, text string")).collect()
    assert all(r.doc_id // 100 == r.item_id for r in got)
    found = {r.doc_id for r in got}
    assert all(i in found for i, _ in docs if i // 100 < 20)
    assert len(found) >= 0.9 * len(docs)


def test_masks_miss_almost_no_pattern():
    def seen(n, masks, lost):
        return any(all(a + i not in lost for i, c in enumerate(m) if c == "1") for m in masks for a in range(n - len(m) + 1))
    for n, masks, least in [(n, decontaminate.SHORT_MASKS, 1) for n in range(5, 20)] + [(20, decontaminate.MASKS, 0.99)]:
        every = list(itertools.combinations(range(n), n - math.ceil(0.8 * n - 1e-9)))
        assert sum(seen(n, masks, set(x)) for x in every) >= least * len(every)


def test_tiny_items_and_sql(spark):
    items, docs = substituted()
    items += [(900, "Yes."), (901, "the end of it"), (902, ""), (903, None), (904, "w7x0 w7x1 w7x2 w7x3 w7x4 w7x5 w7x6")]
    docs += [(9000, "yes"), (9001, "yes and no"), (9002, " The end, of it!"), (9003, "it is the end of it all"), (9004, ""), (9005, None),
             (9000, "yes")]
    bench, rows = (spark.createDataFrame(x, f"{c} long, text string") for x, c in ((items, "item_id"), (docs, "doc_id")))
    got = decontaminate.mark_contaminated(rows, bench).filter("contaminated")
    tiny = {(r.doc_id, tuple(r["items"])) for r in got.filter("doc_id >= 9000").collect()}
    assert tiny == {(9000, (900,)), (9002, (901,))}
    con = duckdb.connect()
    con.register("benchmark", bench.toPandas())
    con.register("documents", rows.toPandas())
    want = con.execute(decontaminate.OP9_SQL).fetchall()
    have = got.select("doc_id", "contaminated", "n_items", F.array_join(F.transform("items", lambda x: x.cast("string")), ","))
    assert sorted(map(tuple, have.collect())) == sorted(want)
    assert decontaminate.contaminated(rows, bench.limit(0)).collect() == []
    assert decontaminate.contaminated(rows.limit(0), bench).collect() == []


def test_blocks_and_parts_do_not_change_the_result(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    pairs = sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()))
    assert pairs and sorted(map(tuple, decontaminate.contaminated(docs, bench, block_rows=300).collect())) == pairs
    monkeypatch.setattr(decontaminate, "PART", 37)
    assert sorted(map(tuple, decontaminate.contaminated(docs, bench).collect())) == pairs


def test_heavy_texts_take_the_broadcast_way(spark):
    rows = spark.range(3_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same")
                                     .otherwise(F.concat(F.lit("t"), F.col("id") % 700)).alias("text"))
    digests = rows.select("doc_id", F.col("text").alias("k"))
    heavy = exact_dedup.heavy_winners(digests, "k", "doc_id", 0.1).collect()
    assert [(r.k, r["_keep"], r["_size"]) for r in heavy] == [("same", 0, 1000)]
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(rows, support=0.1).collect()}
    assert got[3].keep_id == 0 and got[3].group_size == 1000 and got[701].keep_id == 1 and len(got) == 3000


def test_hosts(spark):
    urls = ["http://A.Example.com:80/x", "https://u@b.org?q", "nonsense", None, "ftp://c.net"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select(line_dedup.url_host(F.col("url")).alias("h"))
    assert [r.h for r in rows.collect()] == ["a.example.com", "b.org", "", None, "c.net"]


def test_markup(spark):
    html = "<html><style>p{}</style><p>One &amp; <b>two</b></p><!-- x --><script>var t='</p>'</script><li>3</li>"
    row = spark.createDataFrame([(html,), (None,)], "h string").select(line_dedup.html_lines(F.col("h")).alias("t"))
    assert [r.t for r in row.collect()] == ["One & two\n3", ""]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = QUERIES[name](spark, SF)
    said = con.execute(ORACLE[name])
    order = [c[0] for c in said.description]
    assert sorted(map(str, said.fetchall())) == sorted(str(tuple(r)) for r in found.select(order).collect())
