"""Queries' operators against their own SQL, over tables with planted cases that the given ones lack."""

from __future__ import annotations

import random
import time

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillstone.llm import licenses, queries, secrets
from quillstone.llm.oracles import ORACLES


def both(spark, tmp_path, name, tables):
    con = duckdb.connect()
    for table, df in tables.items():
        df.to_parquet(f"{tmp_path}/{table}.parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    ours = queries.queries()[name](spark, str(tmp_path))
    theirs = con.sql(ORACLES[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    return sorted(map(tuple, ours.collect()), key=repr), sorted(theirs.select(*ours.columns).fetchall(), key=repr)


def documents(values):
    return pd.DataFrame({"doc_id": pd.array([None if i == 3 else i // 2 for i in range(len(values))], dtype="Int64"), "text": values, "lang": "en", "kind": 1, "found": 2, "t": 3})


def test_secrets(spark, tmp_path):
    rng = random.Random(5)
    letters = {"hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "b32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "b36": "abcdefghijklmnopqrstuvwxyz0123456789", "B36": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "b64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
    plant = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    values = [None, "", "plain prose"] + [f"{rng.choice(['key', 'token=', 'é ', 'x: '])}{plant(a, rng.randrange(15, 60))}{rng.choice(['', ' ', '='])} and {plant(rng.choice(list(letters.values())), 30)}." for a in letters.values() for _ in range(40)]
    values += ["example" + plant(letters["b64"], 30), "123e4567-e89b-12d3-a456-426614174000", "internationalization_of_long_lower_words", "a" * 40 + plant(letters["b36"], 24), " ".join(plant(letters["b64"], 24) for _ in range(600)), "password=" + plant(letters["b64"], 30) + " " + plant(letters["b36"], 40)]
    ours, theirs = both(spark, tmp_path, "op4_secret_scan", {"documents": documents(values)})
    assert ours == theirs
    found = secrets.secret_spans(spark.createDataFrame([(a, plant(letters[a], 40)) for a in letters for _ in range(20)], "kind string, text string"), id_col="kind")
    rows = found.select("kind", (F.size("base") + F.size("added") > 0).alias("hit")).groupBy("kind").agg(F.avg(F.col("hit").cast("int")).alias("share")).collect()
    assert len(rows) == 6 and all(r.share >= 0.95 for r in rows)


def test_secrets_in_a_very_long_text(spark):
    rng = random.Random(6)
    a = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    make = lambda n: spark.createDataFrame([(1, " ".join("".join(rng.choice(a) for _ in range(24)) + " token=abcdef123" for _ in range(n)))], "doc_id long, text string")
    seconds = []
    for n in (500, 4_000, 32_000):
        df, begin = make(n), time.time()
        row = secrets.secret_spans(df).select(F.size("base").alias("b"), F.size("added").alias("a")).first()
        seconds.append(time.time() - begin)
        assert row.b == n and row.a > 0.9 * n
    assert seconds[2] < 20 * max(seconds[1], 1.0)  # eight times the text, in proportion


def pages(rows):
    return pd.DataFrame([(i, *r) for i, r in enumerate(rows)], columns=["page_id", "url", "html"]).assign(key="k", rule="r", action="a")


def test_redirects_and_canonical_links(spark, tmp_path):
    link = lambda to: f'<html><link rel="canonical" href="{to}"></html>'
    move = lambda to: f"<meta http-equiv=refresh content='0; url={to}'>"
    rows = [(None, link("http://x.com/en/1")), ("no scheme", link("http://x.com/en/1")), ("http://lone.fr/", "")]
    rows += [(f"http://chain.fr/{i}", link(f"/{i + 1}")) for i in range(45)] + [("http://chain.fr/45", move("http://b.com/en/3"))]  # a long chain to a blocked page
    rows += [(f"http://spoke{i}.fr/a?id={i}&utm_source=z", link("http://www.hub.fr/index.html")) for i in range(30)] + [("http://hub.fr/", move("http://c.org/es/9"))]  # a hub
    rows += [("http://d.fr/p?id=1", link("http://b.com/en/3")), ("http://d.fr/p?id=2", ""), ("http://d.fr/p?id=1&utm_medium=q#x", "")]
    rows += [("http://e.fr/1", link("http://b.com/en/4") + move("http://q.net/de/1")), ("http://b.com/en/4", ""), ("http://f.fr/a/b", link("c?x=1&amp;y=2")), ("http://f.fr/a/c?x=1&y=2", move("//c.org/es/1")), ("http://f.fr", link("?k=1") + link("#top"))]
    ours, theirs = both(spark, tmp_path, "op6_url_filter", {"pages": pages(rows + rows[:5])})
    assert ours == theirs
    verdict = {r[0]: r[4] for r in ours}
    assert verdict[3] == "block" and verdict[49] == "block" and verdict[2] == "allow"


FORMS = [("http://foo.com/en", "http://foo.com/en/"), ("http://www.foo.com/en/1", "http://foo.com/en/1"), ("http://foo.com:80/en/1", "http://foo.com/en/1"), ("http://foo.org/es", "http://foo.org/es/index.html"), ("http://foo.com/en?utm_source=a", "/en/"), ("http://bar.net/de", "http://bar.net/de/"), ("https://q.com/en?x=1&gclid=2", "http://q.com/en/?x=1")]


@pytest.mark.parametrize("forms", [FORMS, *([f] for f in FORMS)])
def test_a_links_other_form_of_the_same_url(spark, tmp_path, forms):
    """Both ends have one key; also where that is the only link of the table, a rule for one form decides for the other."""
    link = lambda to: f'<html><link href="{to}" rel=canonical></html>'
    rows = [(url, link(to)) for url, to in forms] + [("http://other.com/en", ""), ("http://other.com/en/", ""), ("http://foo.fr/", "")]
    ours, theirs = both(spark, tmp_path, "op6_url_filter", {"pages": pages(rows)})
    assert ours == theirs
    want = {0: "block", 1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "block"}
    assert all(r[4] == want[FORMS.index(forms[r[0]])] for r in ours if r[0] < len(forms))
    assert [r[4] for r in ours if r[0] >= len(forms)] == ["allow", "block", "allow"]


MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
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
SOFTWARE.
"""
BSD = """Copyright (c) 2020, Somebody
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
%s
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION).
"""
ENDORSE = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
import os
"""
GPL3 = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""
LGPL2 = """ * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version.
"""
MPL = "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed with this\n// file, You can obtain one at https://mozilla.org/MPL/2.0/.\n"
ISC = 'Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES\nWITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF\nMERCHANTABILITY AND FITNESS.'
LICENCES = [(MIT, ["MIT"]), (BSD % "", ["BSD-2-Clause", "Proprietary"]), (BSD % ENDORSE, ["BSD-3-Clause", "Proprietary"]), (APACHE, ["Apache-2.0"]), (GPL3, ["GPL-3.0-or-later"]), (LGPL2, ["LGPL-2.1-or-later"]), (MPL, ["MPL-2.0"]), (ISC, ["ISC"]), ("x = 1  # SPDX-License-Identifier: MIT\n", []), ("// SPDX-License-Identifier: GPL-2.0-only\nint x;", ["GPL-2.0-only"]), ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["CC-BY-SA-4.0"]), ("Prose. This is free and unencumbered software released into the public domain.\nMore", ["Unlicense"])]


def test_whole_licences(spark, tmp_path):
    values = [t for t, _ in LICENCES]
    rng = random.Random(2)
    mixed = ["\n".join(rng.choice(rng.choice(values).split("\n")) for _ in range(rng.randrange(1, 40))) for _ in range(60)] + ["".join(rng.sample(values, 3)) for _ in range(20)] + [None, "", "\u0001", ". . ;\n\n#\n"]
    ours, theirs = both(spark, tmp_path, "op10_license_scan", {"documents": documents(values + mixed)})
    assert ours == theirs
    out = licenses.license_scan(spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.licenses for r in out} == {i: want for i, (_, want) in enumerate(LICENCES)}


def test_a_callers_own_table_is_used(spark):
    df = spark.createDataFrame([(1, "Do what you\nwant to."), (2, "MIT license"), (3, "Do what you want, too")], "doc_id long, text string")
    out = {r.doc_id: (r.identifiers, r.licenses) for r in licenses.license_scan(df, {"do what you want to": "Free"}, [(("Free",), "Free-1")]).collect()}
    assert out == {1: (["Free"], ["Free-1"]), 2: ([], []), 3: ([], [])}
    assert [r.unmatched for r in licenses.license_scan(df, {"do what you want to": "Free"}, []).orderBy("doc_id").collect()] == [1, 0, 0]
    assert [r.identifiers for r in licenses.license_scan(df, {}, []).collect()] == [[]] * 3


@pytest.mark.parametrize("known", [licenses.SENTENCES, {"a": "x", "b c": "y"}, {"": "z", "a": "x"}])
def test_hints_leave_no_sentence_out(known):
    words = licenses.hints(known)
    assert not words and "" in known or all(any(w in s for w in words) for s in known)


def test_conversations_without_id(spark, tmp_path):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (None, 0, "user", "a"), (None, 5, "user", "c"), (None, 6, "user", "c"), (None, 0, None, ""), (2, 0, "user", "c"), (3, 0, None, None), (3, 0, None, None), (None, None, None, None)]
    frame = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    ours, theirs = both(spark, tmp_path, "op1_chat_snapshots", {"conversations": frame})
    assert ours == theirs and sorted((r[0] or 0, r[1]) for r in ours) == [(0, 1), (1, 2), (2, 1), (3, 1)]
