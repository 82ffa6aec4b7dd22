"""Licence scans: SQL, a literal version on random texts, wrapped headers, directories, odd input."""

import math
import random
import textwrap
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.llm import licenses
from tests.conftest import SF, canonical, same_as_duck

TEMPLATES = licenses.templates()


def wrapped(text, mark, width=72):
    return "\n".join(mark + line for line in textwrap.wrap(text, width - len(mark)))


def declared(spark, texts):
    files = spark.createDataFrame([(i, "f", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")
    return [r.license for r in sorted(licenses.declared(files).collect(), key=lambda r: r.file_key)]


def test_query_equals_sql(spark):
    df = licenses.op10_license_scan(spark, SF)
    same_as_duck(df, licenses.oracle())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "NestedLoop", "Cartesian"))


NOTICE = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {}General Public License for more details."
GPL = "This program is free software{} you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
HEADERS = [
    (GPL.format(":", "", ",", "3") + NOTICE.format(""), "GPL-3.0"),
    (GPL.format(";", "", ";", "2") + NOTICE.format(""), "GPL-2.0"),
    (GPL.format(":", "Lesser ", ",", "3") + NOTICE.format("Lesser "), "LGPL-3.0"),
    (GPL.format(";", "Lesser ", ";", "2.1").replace("program", "library") + NOTICE.format("Lesser "), "LGPL-2.1"),
    (GPL.format(":", "Affero ", ",", "3") + NOTICE.format("Affero "), "AGPL-3.0"),
    (APACHE, "Apache-2.0"),
    (MPL, "MPL-2.0"),
    *((f"Copyright (c) 2019 The Authors of Something. All rights reserved. {text}", lic) for lic, _, text in licenses.WHOLE),
    (licenses.WHOLE[7][2].replace("the copyright holder", "the University of Somewhere"), "BSD-3-Clause"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, and so on.", "MIT"),
]


@pytest.mark.parametrize("mark", ["# ", " * ", "// ", "", "dnl ", "rem "])
def test_wrapped_headers(spark, mark):
    code = "\n\nimport nothing\nreturn 1 + 2\n"
    texts = [f"#!/bin/sh\n{wrapped(text, mark)}{code}" for text, _ in HEADERS] + ["word " * 300 + text + " word" * 300 for text, _ in HEADERS]
    want = [lic for _, lic in HEADERS] * 2
    if mark:
        texts, want = texts[: len(HEADERS)], want[: len(HEADERS)]
    assert list(zip(declared(spark, texts), texts)) == list(zip(want, texts))


def test_identifiers_and_short_notices(spark):
    lines = {f"SPDX-License-Identifier: {x}": x for x in licenses.IDENTIFIERS}
    lines |= {"SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0", "SPDX-License-Identifier: LGPL-2.1+": "LGPL-2.1", "SPDX-License-Identifier: Foo-1.0": None}
    lines |= {"SPDX-License-Identifier: CC-BY-NC-SA-4.0": None, "Released under the MIT License": "MIT", "licensed under CC BY-NC 4.0": "CC-BY-NC-4.0"}
    lines |= {"Licensed under the GNU Lesser General Public License, version 3": "LGPL-3.0", "a licence to print money": None, "Licensed under the Apache Foundation": None}
    lines |= {"one two\nthis is free and unencumbered software released into the public\ndomain.": "Unlicense", "the mit of 2 bsd clauses": None}
    texts = [f"/* {x} */\nint main;\n" for x in lines] + [f"-- {x}" for x in lines]
    assert dict(zip(texts, declared(spark, texts))) == dict(zip(texts, [*lines.values()] * 2))


def test_openings_of_whole_texts(spark):
    rows = [(t.license, " ".join(t.words)) for t in TEMPLATES if t.words[:2] in (("gnu", "general"), ("gnu", "lesser"), ("gnu", "affero")) or t.words[:2] == ("apache", "license")]
    assert len(rows) == 6
    assert declared(spark, [f"{text} preamble the licenses for most software are designed" for _, text in rows]) == [lic for lic, _ in rows]


def brute(texts):
    """(license, score) of each text, from every statement and template."""
    split = [licenses._split(t or "") for t in texts]
    n = len(texts)
    df = Counter(x for w in split for x in set(w))
    vocabulary = {x for t in TEMPLATES for x in t.words}
    idf = lambda x: math.log((n + 1) / ((df[x] if x in vocabulary else 0) + 1)) + 1
    out = []
    for text, w in zip(texts, split, strict=True):
        lines = [licenses._split(line) for line in (text or "").split("\n")]
        found = []
        for t in TEMPLATES:
            own = {x: c * idf(x) for x, c in Counter(t.words).items()}
            norm = math.sqrt(sum(v * v for v in own.values()))
            runs = [w[s : s + size] for size in t.sizes for s in range(max(0, len(w) - size) + 1) if s % t.step == 0 or s == len(w) - size]
            best = 0
            for x in {*runs, *lines}:
                if set(t.decisive) <= set(x) and not set(t.foreign) & set(x):
                    tf = {y: c * idf(y) for y, c in Counter(x).items()}
                    best = max(best, round(sum(v * own.get(y, 0) for y, v in tf.items()) / norm / math.sqrt(sum(v * v for v in tf.values())), 6))
            if best >= licenses.THRESHOLD:
                found.append((t.opening, -round(best * norm, 6), t.license, best))
        out.append(min(found)[2:] if found else (None, None))
    return out


def random_texts(r, n):
    """Templates cut, mixed, doubled and spoilt, among other words."""
    out = [None, "", "\n \n"]
    while len(out) < n:
        w = []
        for _ in range(r.randint(1, 3)):
            t = r.choice(TEMPLATES[:30] + TEMPLATES[41:])
            a = r.choice([0, 0, r.randrange(len(t.words))])
            part = list(t.words[a : a + r.choice([len(t.words), r.randint(1, 30)])])
            for _ in range(r.randint(0, 4)):
                part[r.randrange(len(part))] = r.choice(["other", "lesser", "nc", "2", "3", "word"])
            w += part + [r.choice(["alpha", "beta", "of", "the", "gnu", "É"]) for _ in range(r.choice([0, 3, 30]))]
        out.append("".join(x.upper() + r.choice([" ", " ", ", ", "\n", "\n# "]) for x in w))
    return out


def test_random_texts_equal_a_literal_version_and_sql(spark, tmp_path):
    texts = random_texts(random.Random(10), 150)
    rows = [(i, t, r, s, 1) for i, (t, r, s) in enumerate(zip(texts, ["en", None] * 75, ["a", "b", None] * 50, strict=True))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, license long")
    files = docs.withColumn("path", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")))
    found = {r.file_key: (r.license, r.score) for r in licenses.declared(files).collect()}
    want = brute(texts)
    assert sum(lic is not None for lic, _ in want) > 60
    for i, (lic, score) in enumerate(want):
        assert found[i][0] == lic and (score is None) == (found[i][1] is None) and (score is None or abs(score - found[i][1]) < 2e-6), texts[i]
    docs.write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents/*.parquet'")
    sql = con.execute(licenses.oracle())
    got = licenses.scan(files, by_majority=True)
    assert canonical([tuple(x) for x in got.collect()], got.columns) == canonical(sql.fetchall(), [c[0] for c in sql.description])


def test_licences_inherit_from_the_nearest_directory(spark):
    rows = [
        ("a/LICENSE", "Licensed under the Apache License, Version 2.0."),
        ("a/b/x.py", "# code"),
        ("a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        ("a/b/c/d/y.py", None),
        ("a/b/c/z.py", "Released under the MIT License.\nother"),
        ("q.py", "nothing"),
        (None, "text"),
        ("a/b/x.py", "# code"),
        ("e/LICENSE.txt", ""),
        ("g/LICENSE", licenses.WHOLE[1][2]),
        ("g/COPYING", "Released under the MIT License."),
        ("g/NOTICE", licenses.WHOLE[7][2]),
        ("g/h.c", "x"),
    ]
    files = spark.createDataFrame([(i, p, t, "l") for i, (p, t) in enumerate(rows)], "doc_id long, path string, text string, license string")
    got = {r.doc_id: (r.license, r.origin, r.license_dir) for r in licenses.scan(files).collect()}
    assert got == {
        0: ("Apache-2.0", "header", None),
        1: ("Apache-2.0", "inherited", "a"),
        2: ("GPL-3.0", "header", None),
        3: ("GPL-3.0", "inherited", "a/b/c"),
        4: ("MIT", "header", None),
        5: (None, "none", None),
        6: (None, "none", None),
        7: ("Apache-2.0", "inherited", "a"),
        8: (None, "none", None),
        9: ("MIT", "header", None),
        10: ("MIT", "header", None),
        11: ("BSD-3-Clause", "header", None),
        12: ("MIT", "inherited", "g"),
    }
    assert licenses.scan(files.limit(0)).count() == 0


def test_a_majority_is_more_than_half(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [("a/1", mit), ("a/2", "x"), ("b/1", mit), ("b/2", mit), ("b/3", "x"), ("c/1", mit), ("c/2", "x"), ("c/3", "x")]
    rows += [("d/1", mit), ("d/2", apache), ("d/3", "x"), ("d/e/1", "x"), ("b/e/f/1", None)]
    files = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "doc_id long, path string, text string")
    got = lambda **by: {r.doc_id for r in licenses.scan(files, **by).collect() if r.origin == "inherited"}
    assert (got(), got(by_majority=True)) == (set(), {4, 12})


def test_ties_copies_and_long_texts(spark):
    short = "Licensed under CC BY-NC 4.0."
    tie = "SPDX-License-Identifier: MIT\nSPDX-License-Identifier: ISC"
    long = "filler words of prose \n" * 60_000 + short + " and so on" * 50_000
    assert declared(spark, [tie, tie, short, short, long]) == ["ISC", "ISC", *["CC-BY-NC-4.0"] * 3]
