"""Licence scans: sparse TF-IDF cosine to templates, and inheritance by directory.

A statement is a line of a text, or a run of its words as long as a template or half as
long again, whatever lines, comment marks and punctuation are between; so headers are
found that are wrapped, indented or inside a paragraph, and whole licence texts. Each is
compared with templates: notices, SPDX lines, whole short licences, and the openings of long ones.
Term weights come from the document frequency of the templates' terms over the whole
corpus. A template asks for its decisive words (names and versions), and a statement must
have none of the words that turn a licence into another one.

One pass over the texts counts terms; from the counts follows which texts can be near which
templates (a cosine is at most the share of the template's length that lies in terms of the
text), and only those are read again. A file without a statement of its own takes the
licence of its nearest ancestor directory that has one.

DataFrame functions only.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import ascii_lower, table, words, written

#: (licence, decisive words, text). Usual notices, short licences, and openings of long ones.
NOTICES = (
    ("MIT", "mit", "Released under the MIT License."),
    ("MIT", "mit", "Licensed under the MIT License. See LICENSE in the project root for license information."),
    ("Apache-2.0", "apache 2", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "apache 2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "apache 2", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-2.0", "gnu general 2", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "gnu general 2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-2.0", "gnu general 2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "gnu general 2 1991", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GPL-3.0", "gnu general 3", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "gnu general 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "gnu general 3 2007", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("LGPL-2.1", "gnu lesser 2 1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "gnu lesser 2 1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "gnu lesser 2 1 1999", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("LGPL-3.0", "gnu lesser 3", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "gnu lesser 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "gnu lesser 3 2007", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("AGPL-3.0", "gnu affero 3", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "gnu affero 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "gnu affero 3 2007", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("MPL-2.0", "mozilla 2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "mozilla 2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "mozilla 2", "Mozilla Public License Version 2.0"),
    ("CC-BY-4.0", "cc by 4", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "attribution 4", "This work is licensed under the Creative Commons Attribution 4.0 International License, CC BY 4.0."),
    ("CC-BY-SA-4.0", "cc by sa 4", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "attribution sharealike 4", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "cc by nc 4", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "attribution noncommercial 4", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "cc0", "To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0."),
    ("Unlicense", "unencumbered", "This is free and unencumbered software released into the public domain."),
)
#: The same for whole licences.
_GRANT_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_NO_WARRANTY_MIT = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_GRANT_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution."
)
_NO_ENDORSEMENT_BSD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission."
)
_NO_WARRANTY_BSD = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GRANT_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
    "and this permission notice appear in all copies."
)
_NO_WARRANTY_ISC = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. "
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
    "3. This notice may not be removed or altered from any source distribution."
)
WHOLE = (
    ("MIT", "granted sublicense", _GRANT_MIT),
    ("MIT", "granted sublicense warranty", f"{_GRANT_MIT} {_NO_WARRANTY_MIT}"),
    ("ISC", "fee granted", _GRANT_ISC),
    ("ISC", "fee granted disclaims", f"{_GRANT_ISC} {_NO_WARRANTY_ISC}"),
    ("BSD-2-Clause", "redistributions binary", _GRANT_BSD),
    ("BSD-2-Clause", "redistributions binary disclaimed", f"{_GRANT_BSD} {_NO_WARRANTY_BSD}"),
    ("BSD-3-Clause", "redistributions binary endorse", f"{_GRANT_BSD} {_NO_ENDORSEMENT_BSD}"),
    ("BSD-3-Clause", "redistributions binary endorse disclaimed", f"{_GRANT_BSD} {_NO_ENDORSEMENT_BSD} {_NO_WARRANTY_BSD}"),
    ("Zlib", "misrepresented altered", _ZLIB),
)
#: The same for openings that more than one licence has: taken where nothing else is found.
OPENINGS = (
    ("MIT", "granted charge", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("BSD-3-Clause", "redistribution binary", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
)
#: Identifiers of SPDX lines; all their words are decisive.
IDENTIFIERS = (
    "MIT", "MIT-0", "ISC", "Zlib", "Unlicense", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0",
    "AGPL-3.0", "EPL-2.0", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0",
)
#: Words that turn a licence into another one.
QUALIFIERS = frozenset("lesser affero lgpl agpl noncommercial commercial nc sharealike sa noderivatives noderivs nd endorse".split())
#: Words of a statement to a template's words: its own wording, and one with a clause more.
SPANS = (1.0, 1.5)
#: Runs begin at every word of templates of fewer words, at each so many-th part of longer ones.
STEPS = 16
COMMENT_WORD = "(?im)^[ \\t]*(?:rem|dnl)[ \\t]"
LICENCE_FILE = r"(?i)(^|/)((un)?licen[cs]e|copying|notice)([.-][a-z0-9.-]*)?$"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.6
#: Texts that may state a licence are picked by a broadcast of up to so many ids of 16 bytes.
BROADCAST_TEXTS = 500_000


@dataclass(frozen=True)
class Template:
    license: str
    decisive: tuple[str, ...]
    words: tuple[str, ...]
    opening: bool = False
    foreign: tuple[str, ...] = field(default=())

    @property
    def sizes(self) -> list[int]:
        return [math.ceil(len(self.words) * x) for x in SPANS]

    @property
    def step(self) -> int:
        return max(1, len(self.words) // STEPS)


def _split(text: str) -> tuple[str, ...]:
    return tuple(re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)))


def templates() -> list[Template]:
    """All templates, in a fixed order."""
    spdx = [(x, " ".join(_split(x)), f"SPDX-License-Identifier: {x}") for x in IDENTIFIERS]
    made = []
    for rows, opening in ((NOTICES, False), (WHOLE, False), (spdx, False), (OPENINGS, True)):
        for lic, decisive, text in rows:
            own = _split(text)
            made.append(Template(lic, tuple(decisive.split()), own, opening, tuple(sorted(QUALIFIERS.difference(own)))))
    return made


def terms(text: Column) -> Column:
    return words(ascii_lower(text), BREAK)


@dataclass(frozen=True)
class Weights:
    """Term weights of a corpus, and what follows from them for the templates."""

    idf: dict[str, float]
    rare: float  # of terms that no template has

    def norm(self, t: Template) -> float:
        return math.sqrt(math.fsum((n * self.idf[x]) ** 2 for x, n in Counter(t.words).items()))

    def literal(self, made: list[Template]) -> Column:
        """The templates as a constant array; shares are those of a template's squared length."""
        rows = []
        for i, t in enumerate(made):
            norm, tf = self.norm(t), Counter(t.words)
            rows.append(
                {
                    "template": i, "license": t.license, "opening": t.opening, "norm": norm, "sizes": t.sizes, "step": t.step,
                    "decisive": list(t.decisive), "foreign": list(t.foreign),
                    "terms": {x: n * self.idf[x] for x, n in tf.items()},
                    "shares": [{"x": x, "share": (n * self.idf[x] / norm) ** 2} for x, n in tf.items()],
                }
            )
        return F.from_json(F.lit(json.dumps(rows)), _TEMPLATES)


_TEMPLATES = (
    "array<struct<template:int,license:string,opening:boolean,norm:double,sizes:array<int>,step:int,"
    "decisive:array<string>,foreign:array<string>,terms:map<string,double>,shares:array<struct<x:string,share:double>>>>"
)


def _let(value: Column, then) -> Column:
    """``then(value)``, with ``value`` computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _sum(xs: Column, of) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + of(x))


def _can_reach(known: Column, t: Column) -> Column:
    """Whether a text of these different terms may hold a statement near a template."""
    share = _sum(t["shares"], lambda s: F.when(F.array_contains(known, s["x"]), s["share"]).otherwise(0.0))
    return F.forall(t["decisive"], lambda d: F.array_contains(known, d)) & (share >= (THRESHOLD - 1e-6) ** 2)


def _runs(w: Column, t: Column) -> Column:
    """Runs of words that hold a template's first decisive word, at its steps and at the end of the text."""
    places = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i)["x"] == F.get(t["decisive"], 0))

    def of(size: Column) -> Column:
        last = F.greatest(F.size(w) - size, F.lit(0))
        around = F.flatten(F.transform(places, lambda p: F.sequence(F.greatest(p - size + 1, F.lit(0)), F.least(p, last))))
        starts = F.filter(F.array_distinct(around), lambda i: (i % t["step"] == 0) | (i == last))
        return F.transform(starts, lambda i: F.slice(w, i + 1, size))

    return F.flatten(F.transform(t["sizes"], of))


def _score(x: Column, t: Column) -> Column:
    """The cosine of a statement and a template, null below THRESHOLD and where words decide against it.

    x: (x, v, c) of each word: itself, its weight, the weight of its term in the template. As a term's
    weight counts as often as the word occurs, squares sum up by word. The sum without repeats bounds the
    cosine from above and spares most statements the quadratic count.
    """
    dot = _sum(x, lambda y: y["v"] * y["c"])
    least = _sum(x, lambda y: y["v"] * y["v"])
    whole = _sum(x, lambda y: y["v"] * y["v"] * F.size(F.filter(x, lambda z: z["x"] == y["x"])))
    fits = _let(
        F.transform(x, lambda y: y["x"]),
        lambda own: F.forall(t["decisive"], lambda d: F.array_contains(own, d)) & ~F.arrays_overlap(own, t["foreign"]),
    )
    cosine = lambda square: dot / (F.sqrt(square) * t["norm"])
    return F.when(
        fits & (cosine(least) >= THRESHOLD - 1e-6),
        _let(F.round(cosine(whole), 6), lambda s: F.when(s >= THRESHOLD, s)),
    )


def _best(text: Column) -> Column:
    """(opening, weight, license, score), least first, of the best template of a text, null if none is near.
    text: its words and lines with weights, and the templates to compare."""

    def of(t: Column) -> Column:
        marked = lambda xs: F.transform(xs, lambda y: F.struct(y["x"].alias("x"), y["v"].alias("v"), F.coalesce(F.element_at(t["terms"], y["x"]), F.lit(0.0)).alias("c")))
        statements = F.concat(_let(marked(text["w"]), lambda m: _runs(m, t)), F.transform(text["lines"], marked))
        return _let(
            F.array_max(F.transform(statements, lambda x: _score(x, t))),
            lambda score: F.struct(
                t["opening"].alias("opening"), F.round(-score * t["norm"], 6).alias("weight"), t["license"].alias("license"), score.alias("score")
            ),
        )

    return F.array_min(F.filter(F.transform(text["made"], of), lambda b: b["score"].isNotNull()))


def _identity(text: Column) -> list[Column]:
    """128 bits of a text, in two columns."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def declared(files: DataFrame, key: str = "doc_id", text: str = "text", path: str = "path") -> DataFrame:
    """(row, file_key, path, license, score) of every row: the licence of the template that any of
    the text's statements is near, at or above THRESHOLD, else nulls.

    Of several, openings that licences share come last, then the one of most weight counts (a
    template's length times its score), then the licence that sorts first. A null text has no
    statements; a null path is kept; texts that occur twice are compared twice; very long ones are
    compared around decisive words only.
    """
    rows = files.select(F.col(key).alias("file_key"), F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    made = templates()
    vocabulary = sorted({x for t in made for x in t.words})
    known = F.array_intersect(terms(F.col("text")), F.array(*map(F.lit, vocabulary)))
    seen = written(
        rows.select(F.monotonically_increasing_id().alias("row"), "file_key", "path", *_identity(F.col("text")), known.alias("known")), "terms"
    )
    n = seen.count()
    counted = seen.select(F.explode("known").alias("x")).groupBy("x").agg(F.count("*").alias("df")).collect()  # a few hundred, as many as templates have
    df = {r["x"]: r["df"] for r in counted}
    log = lambda d: math.log((n + 1) / (d + 1)) + 1
    weights = Weights({x: log(df.get(x, 0)) for x in vocabulary}, log(0))
    constant = weights.literal(made)

    near = F.transform(F.filter(constant, lambda t: _can_reach(F.col("known"), t)), lambda t: t["template"])
    picked = written(
        seen.select("h1", "h2", near.alias("near")).filter(F.size("near") > 0).groupBy("h1", "h2").agg(F.first("near").alias("near")), "near"
    )
    few = F.broadcast(picked) if picked.count() <= BROADCAST_TEXTS else picked

    value = F.create_map(*[F.lit(y) for x in weights.idf.items() for y in x])
    valued = lambda xs: F.transform(xs, lambda x: F.struct(x.alias("x"), F.coalesce(F.element_at(value, x), F.lit(weights.rare)).alias("v")))
    prepared = F.struct(
        F.filter(constant, lambda t: F.array_contains(F.col("near"), t["template"])).alias("made"),
        valued(terms(F.regexp_replace("text", COMMENT_WORD, ""))).alias("w"),
        F.transform(F.filter(F.split("text", "\n"), lambda x: x.rlike("[0-9A-Za-z]")), lambda x: valued(terms(x))).alias("lines"),
    )
    best = (
        rows.select("text", *_identity(F.col("text")))
        .join(few, ["h1", "h2"])
        .select("h1", "h2", F.explode(F.filter(F.array(_let(prepared, _best)), lambda b: b.isNotNull())).alias("b"))
    )
    found = written(best.groupBy("h1", "h2").agg(F.first("b").alias("b")).select("h1", "h2", "b.license", "b.score"), "statements")
    return seen.join(found, ["h1", "h2"], "left").select("row", "file_key", "path", "license", "score")


def directory(path: Column) -> Column:
    """The path up to its last slash; the root is empty."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def ancestors(of: Column) -> Column:
    """(directory, depth) of a directory and all above it, the root at depth 0."""
    parts = F.when(of == "", F.array().cast("array<string>")).otherwise(F.split(of, "/"))
    return F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda d: F.struct(F.array_join(F.slice(parts, F.lit(1), d), "/").alias("dir"), d.alias("depth")),
    )


def scan(files: DataFrame, key: str = "doc_id", text: str = "text", path: str = "path", by_majority: bool = False) -> DataFrame:
    """(key, license, score, origin, license_dir) of every row.

    origin is ``header`` for a file's own statement, ``inherited`` for its nearest ancestor
    directory's licence, else ``none``. A directory's licence is that of the licence files in it
    (the most frequent, then the first); where it has none, with ``by_majority``, that which
    more than half of its files state. Nearest ancestors are found once per directory, so
    a directory that holds a third of all files costs its files one lookup each, in a join
    that can be split.

    A null path is in no directory; repeated rows give a row each; columns not named
    aren't read; no rows give none.
    """
    found = written(declared(files, key, text, path), "licences").withColumn("dir", directory(F.col("path")))
    is_file = F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False))
    placed = found.filter("dir is not null")
    votes = (
        placed.filter(F.col("license").isNotNull() & (F.lit(by_majority) | is_file))
        .groupBy("dir", "license")
        .agg(F.sum(is_file.cast("int")).alias("files"), F.count("*").alias("n"))
    )
    if by_majority:
        sizes = written(placed.groupBy("dir").agg(F.count("*").alias("all")), "sizes")
        votes = votes.join(sizes, "dir").filter("files > 0 or 2 * n > `all`").drop("all")
    best = Window.partitionBy("dir").orderBy(F.desc("files"), F.desc("n"), "license")
    grants = votes.withColumn("k", F.row_number().over(best)).filter("k = 1").select(F.col("dir").alias("grant_dir"), F.col("license").alias("grant"))
    up = placed.select("dir").distinct().select("dir", F.explode(ancestors(F.col("dir"))).alias("a"))
    nearest = (
        up.join(grants, F.col("a.dir") == F.col("grant_dir"))
        .groupBy("dir")
        .agg(F.max(F.struct(F.col("a.depth").alias("depth"), "grant_dir", "grant")).alias("g"))
        .select(F.col("dir").alias("of"), "g.grant_dir", "g.grant")
    )
    nearest = written(nearest, "nearest")
    own = F.col("license").isNotNull()
    return found.join(nearest, F.col("dir") == F.col("of"), "left").select(
        F.col("file_key").alias(key),
        F.coalesce("license", "grant").alias("license"),
        "score",
        F.when(own, "header").when(F.col("grant").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~own, F.col("grant_dir")).alias("license_dir"),
    )


def op10_license_scan(spark, sf_dir):
    """Documents lie in a tree of source and language, since the table has no paths."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path")
    )
    return scan(docs, by_majority=True)


def oracle() -> str:
    """The same rows in DuckDB SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    listed = lambda xs: "[" + ", ".join(map(q, xs)) + "]"
    rows = ",\n".join(
        f"({i}, {q(t.license)}, {t.opening}, {listed(t.decisive)}, {listed(t.foreign)}, {t.sizes}, {t.step}, {listed(t.words)})" for i, t in enumerate(templates())
    )
    term = lambda c: f"regexp_extract_all(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return rf"""
WITH t(template, license, opening, decisive, other, sizes, step, w) AS (VALUES {rows}),
ttf AS (SELECT template, term, count(*) AS tf FROM (SELECT template, unnest(w) AS term FROM t) GROUP BY ALL),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, concat_ws('/', source, lang, CAST(doc_id AS VARCHAR)) AS path FROM documents),
dt AS (SELECT r, list_distinct({term('text')}) AS terms FROM d),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(terms) AS term FROM dt) WHERE term IN (SELECT term FROM ttf) GROUP BY term),
n AS (SELECT count(*) AS n FROM d),
idf AS (SELECT DISTINCT ttf.term, ln((n + 1.0::DOUBLE) / (coalesce(df, 0) + 1)) + 1 AS idf FROM ttf LEFT JOIN df USING (term), n),
tw AS (SELECT template, term, tf * idf AS weight FROM ttf JOIN idf USING (term)),
tn AS (SELECT template, sqrt(sum(weight * weight)) AS norm FROM tw GROUP BY 1),
cand AS (SELECT r, template FROM dt, t WHERE list_has_all(terms, decisive)),
cw AS (SELECT r, text, {term(f"regexp_replace(text, '{COMMENT_WORD}', '', 'g')")} AS w FROM d WHERE r IN (SELECT r FROM cand)),
sz AS (SELECT template, unnest(sizes) AS size FROM t),
st0 AS (SELECT r, template, w[s + 1 : s + size] AS x FROM (
    SELECT r, template, cw.w, size, step, len(cw.w) - size AS last, unnest(range(0, greatest(len(cw.w) - size, 0) + 1)) AS s FROM cand JOIN cw USING (r) JOIN sz USING (template) JOIN t USING (template)) WHERE s % step = 0 OR s = last
  UNION ALL SELECT r, template, {term('l')} FROM (SELECT r, template, unnest(string_split(text, chr(10))) AS l FROM cand JOIN cw USING (r))),
st AS (SELECT template, x, row_number() OVER () AS id FROM (SELECT DISTINCT template, x FROM st0 JOIN t USING (template) WHERE list_has_all(x, decisive) AND NOT list_has_any(x, other))),
tf AS (SELECT id, template, term, count(*) AS tf FROM (SELECT id, template, unnest(x) AS term FROM st) GROUP BY ALL),
sc AS (SELECT id, template, round(sum(tf * coalesce(idf, rare) * coalesce(tw.weight, 0)) / (sqrt(sum((tf * coalesce(idf, rare)) ** 2)) * any_value(norm)), 6) AS score, any_value(norm) AS norm
  FROM tf LEFT JOIN idf USING (term) LEFT JOIN tw USING (template, term) JOIN tn USING (template), (SELECT ln((n + 1.0::DOUBLE) / 1) + 1 AS rare FROM n) GROUP BY id, template),
best AS (SELECT r, license, score, row_number() OVER (PARTITION BY r ORDER BY opening, round(score * norm, 6) DESC, license, score) AS k FROM (
  SELECT r, template, max(score) AS score, any_value(norm) AS norm FROM st0 JOIN st USING (template, x) JOIN sc USING (id, template) WHERE score >= {THRESHOLD} GROUP BY r, template) JOIN t USING (template)),
f AS (SELECT d.r, doc_id, regexp_replace(path, '/[^/]*$', '') AS dir, license, score FROM d LEFT JOIN best ON best.r = d.r AND k = 1),
v AS (SELECT dir, license, count(*) AS c FROM f WHERE license IS NOT NULL GROUP BY dir, license),
g AS (SELECT dir, license FROM v JOIN (SELECT dir, count(*) AS whole FROM f GROUP BY dir) USING (dir) WHERE 2 * c > whole)
SELECT doc_id, coalesce(f.license, g1.license, g2.license, g3.license) AS license, score,
  CASE WHEN f.license IS NOT NULL THEN 'header' WHEN coalesce(g1.license, g2.license, g3.license) IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN f.license IS NULL THEN coalesce(g1.dir, g2.dir, g3.dir) END AS license_dir
FROM f LEFT JOIN g g1 ON g1.dir = f.dir LEFT JOIN g g2 ON g2.dir = regexp_replace(f.dir, '/[^/]*$', '') LEFT JOIN g g3 ON g3.dir = ''
"""
