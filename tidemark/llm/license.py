"""Licence scan in DataFrame operations only.

Segments are stretches of a file's lines: each line that holds a licence cue with some of its
neighbours (WINDOWS), from a line that opens a licence's terms the next OPENING lines too, and the
whole text of files named as licence files. So a header wrapped over comment lines, a title over
two lines and a whole file each are one segment. A segment is a sparse TF-IDF vector over words
and version numbers (comment marks are neither); its cosines to all templates are sums over its
tokens, joined with the templates' weights, a fixed table. The best template at or above
`threshold` is the file's own licence; one that says no more than a family (GENERIC) only where
no other is.

A directory's licence is the best one of the licence files right in it. A file without its own
takes that of the nearest ancestor directory, found by joining the distinct directories,
expanded to their ancestors, with the licensed directories.

A null or empty text has no licence of its own; a null path has no directory and inherits
nothing; ties go to the template, then the directory, that sorts first; rows of one path are
one file with the best of their segments, and each row is returned; an empty table gives an
empty table; other columns are ignored. A text's segments are at most some OPENING times as
large as the text, so a very long one needs that much memory where each of its lines is an opening.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored, table

THRESHOLD = 0.6
TOKEN = r"[a-z]+|[0-9]+(?:\.[0-9]+)*"
LICENSE_NAME = r"(?i)^(un)?licen[cs]es?([.-].*)?$|^copying([.-].*)?$|^copyright([.-].*)?$|^notice([.-].*)?$"
#: Lines before and after a line with a cue that make a segment with it; lines from an opening on.
WINDOWS = ((0, 0), (0, 1), (0, 2), (0, 3), (1, 2))
OPENING = 30

#: What a line with a licence notice contains, in lower case.
CUES = (
    "licen", "copyright", "rights reserved", "public domain", "spdx", "creative commons", "mozilla public",
    "permission is hereby granted", "permission to use", "redistribution and use", "free software", "this software is provided",
)
#: How terms begin that are stated in full.
OPENINGS = ("permission is hereby granted", "permission to use", "redistribution and use", "this is free and unencumbered", "this software is provided 'as-is'")

#: Licences that a notice of a few words can't tell from others.
GENERIC = ("BSD", "Proprietary")

#: Titles of the licences' texts.
TITLES = (
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Artistic-1.0", "The Artistic License Preamble"),
    ("Artistic-2.0", "The Artistic License 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("GFDL-1.2", "GNU Free Documentation License Version 1.2, November 2002"),
    ("GFDL-1.3", "GNU Free Documentation License Version 1.3, 3 November 2008"),
    ("GPL-1.0", "GNU General Public License Version 1, February 1989"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("ISC", "ISC License"),
    ("LGPL-2.0", "GNU Library General Public License Version 2, June 1991"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("MIT", "The MIT License (MIT)"),
    ("MPL-1.1", "Mozilla Public License Version 1.1"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Zlib", "zlib License"),
)

#: Notices by licence, as their publishers word them.
NOTICES = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", "Use of this source code is governed by the BSD 2-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by the BSD 3-Clause License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Copyright. All rights reserved. Unauthorized copying is strictly prohibited."),
)

#: Terms that are stated in full.
TERMS = (
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"""),
)

#: The licences whose header has one wording, with the name of the work, of the licence and the version in it.
_GNU = "This {work} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
HEADERS = (
    ("AGPL-3.0", "program", "GNU Affero General Public License", "3"),
    ("GPL-1.0", "program", "GNU General Public License", "1"),
    ("GPL-2.0", "program", "GNU General Public License", "2"),
    ("GPL-3.0", "program", "GNU General Public License", "3"),
    ("LGPL-2.0", "library", "GNU Library General Public License", "2"),
    ("LGPL-2.1", "library", "GNU Lesser General Public License", "2.1"),
    ("LGPL-3.0", "library", "GNU Lesser General Public License", "3"),
)

TEMPLATES = (
    *TITLES,
    *NOTICES,
    *TERMS,
    *((name, _GNU.format(work=work, name=title, version=version)) for name, work, title, version in HEADERS),
    *((name, f"SPDX-License-Identifier: {name}{end}") for name in sorted({n for n, _ in TITLES} | {"Unlicense"}) for end in (("", "-only", "-or-later") if "GPL" in name else ("",))),
)


def _weights() -> tuple[list[tuple[int, str, str, float]], dict[str, float], float]:
    """((template, licence, token, unit weight) rows, idf by token, idf of other tokens)."""
    bags = [Counter(re.findall(TOKEN, text.lower())) for _, text in TEMPLATES]
    n = len(bags)
    idf = {t: math.log((1 + n) / (1 + sum(t in b for b in bags))) + 1 for t in sorted(set().union(*bags))}
    rows = []
    for i, ((name, _), bag) in enumerate(zip(TEMPLATES, bags, strict=True)):
        norm = math.sqrt(sum((c * idf[t]) ** 2 for t, c in bag.items()))
        rows += [(i, name, t, c * idf[t] / norm) for t, c in sorted(bag.items())]
    return rows, idf, math.log(1 + n) + 1


_ROWS, _IDF, _IDF_OTHER = _weights()


def _by_token() -> str:
    """The templates' weights as JSON: per token its idf, and its weight in each template times that."""
    dense = {t: [0.0] * len(TEMPLATES) for t in _IDF}
    for i, _, t, w in _ROWS:
        dense[t][i] = w * _IDF[t]
    return json.dumps([{"token": t, "idf": _IDF[t], "w": [x or 0 for x in dense[t]]} for t in _IDF])


def _cue(text: Column, cues: tuple[str, ...] = CUES) -> Column:
    out = F.contains(text, F.lit(cues[0]))
    for cue in cues[1:]:
        out = out | F.contains(text, F.lit(cue))
    return out


def _directory(path: Column) -> Column:
    """Without the last part; the root is the empty string."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.when(path.isNotNull(), ""))


def _segments(lines: Column) -> Column:
    def window(i: Column, before: int, after: int) -> Column:
        start = F.greatest(i - before, F.lit(0))
        return F.array_join(F.slice(lines, start + 1, i + after + 1 - start), "\n")

    places = lambda cues: F.filter(F.transform(lines, lambda x, i: F.when(_cue(x, cues), i)), lambda i: i.isNotNull())
    near = F.flatten(F.transform(places(CUES), lambda i: F.array(*[window(i, *w) for w in WINDOWS])))
    return F.concat(near, F.transform(places(OPENINGS), lambda i: window(i, 0, OPENING)))


def own_licenses(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(path, license, score) of the files (path, text) with a licence of their own."""
    spark = files.sparkSession
    low = files.select("path", F.lower("text").alias("text"), F.element_at(F.split("path", "/"), -1).rlike(LICENSE_NAME).alias("named")).where(_cue(F.col("text")))
    near = _segments(F.split("text", "\n"))
    segments = low.select("path", F.explode(F.array_distinct(F.when(F.col("named"), F.concat(near, F.array("text"))).otherwise(near))).alias("segment"))
    # equal segments of rows of one path are one, with their tokens counted as often: the cosine is the same
    tokens = segments.select("path", F.xxhash64("segment").alias("segment"), F.explode(F.regexp_extract_all("segment", F.lit(TOKEN), F.lit(0))).alias("token"))
    bags = tokens.groupBy("path", "segment", "token").agg(F.count("*").alias("tf"))
    parsed = F.inline(F.from_json(F.lit(_by_token()), "array<struct<token: string, idf: double, w: array<double>>>"))
    weighted = bags.join(F.broadcast(spark.range(1).select(parsed)), "token", "left")  # fixed size
    squares = F.sum(F.pow(F.col("tf") * F.coalesce("idf", F.lit(_IDF_OTHER)), 2.0))
    sums = weighted.groupBy("path", "segment").agg(squares.alias("norm"), *[F.sum(F.col("tf") * F.col("w")[i]).alias(f"d{i}") for i in range(len(TEMPLATES))])
    score = lambda i: F.round(F.coalesce(f"d{i}", F.lit(0.0)) / F.sqrt("norm"), 6)
    found = [F.struct(F.lit(name in GENERIC).alias("generic"), (-score(i)).alias("minus"), F.lit(name).alias("license")) for i, (name, _) in enumerate(TEMPLATES)]
    per = sums.select("path", F.array_min(F.filter(F.array(*found), lambda x: x.minus <= -threshold)).alias("best")).where("best IS NOT NULL")
    best = per.groupBy("path").agg(F.min("best").alias("best"))
    return best.select("path", F.col("best.license").alias("license"), (-F.col("best.minus")).alias("score"), F.col("best.generic").alias("generic"))


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(path, own_license, own_score, license, licensed_by) per row; licensed_by is the path itself or the directory inherited from."""
    rows = files.select(F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    own, _ = stored(own_licenses(rows.where("path IS NOT NULL"), threshold), "licenses")
    named = own.where(F.element_at(F.split("path", "/"), -1).rlike(LICENSE_NAME)).select(_directory(F.col("path")).alias("dir"), "license", "score", "generic")
    licensed = named.groupBy("dir").agg(F.min(F.struct("generic", (-F.col("score")).alias("minus"), "license")).alias("best")).select(F.col("dir").alias("ancestor"), F.col("best.license").alias("inherited"))
    paths = rows.select("path", _directory(F.col("path")).alias("dir"))
    parts = F.split("dir", "/")
    ancestors = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(
        F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    )
    up = paths.where("dir IS NOT NULL").select("dir").distinct().select("dir", F.posexplode(ancestors).alias("depth", "ancestor"))
    nearest = up.join(licensed, "ancestor").groupBy("dir").agg(F.max_by(F.struct("ancestor", "inherited"), "depth").alias("near"))
    out = paths.join(own.select("path", F.col("license").alias("own_license"), F.col("score").alias("own_score")), "path", "left").join(nearest, "dir", "left")
    by = F.when(F.col("own_license").isNotNull(), F.col("path")).otherwise(F.col("near.ancestor"))
    return out.select("path", "own_license", "own_score", F.coalesce("own_license", "near.inherited").alias("license"), by.alias("licensed_by"))


def op1_license(spark, sf_dir: str) -> DataFrame:
    """documents has no paths: a tree is laid out from source and id, where each hundredth document stands as its folder's licence file."""
    docs = table(spark, sf_dir, "documents")
    folder = F.concat_ws("/", F.col("source"), F.expr("doc_id div 1000").cast("string"), F.expr("doc_id div 100").cast("string"))
    name = F.when(F.col("doc_id") % 100 == 0, F.concat(F.lit("LICENSE-"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    found = scan(docs.select(F.concat_ws("/", folder, name).alias("path"), "text"))
    number = F.regexp_extract("path", r"([0-9]+)(\.txt)?$", 1).cast("bigint")
    return found.select(number.alias("doc_id"), "path", "own_license", "own_score", "license", "licensed_by")


_SQL_CUE = " OR ".join(f"contains(%s, '{c}')" for c in CUES)
_SQL_OPENING = " OR ".join("contains(l, '" + c.replace("'", "''") + "')" for c in OPENINGS)
_WEIGHT_VALUES = ", ".join(f"({i}, '{name}', '{t}', CAST({w!r} AS DOUBLE), CAST({_IDF[t]!r} AS DOUBLE))" for i, name, t, w in _ROWS)
_IDF_VALUES = ", ".join(f"('{t}', CAST({w!r} AS DOUBLE))" for t, w in _IDF.items())
_GENERIC_NAMES = ", ".join(f"'{x}'" for x in GENERIC)
OP1_SQL = f"""
WITH weights(template, license, token, weight, idf) AS (VALUES {_WEIGHT_VALUES}),
idfs(token, idf) AS (VALUES {_IDF_VALUES}),
windows(before, after) AS (VALUES {", ".join(map(str, WINDOWS))}),
files AS (
  SELECT doc_id, concat_ws('/', source, doc_id // 1000, doc_id // 100) AS dir,
         CASE WHEN doc_id % 100 = 0 THEN 'LICENSE-' || doc_id ELSE doc_id || '.txt' END AS name, doc_id % 100 = 0 AS named, lower(text) AS text
  FROM documents
),
texts AS (SELECT doc_id, named, text, string_split(text, chr(10)) AS lines FROM files WHERE {_SQL_CUE.replace("%s", "text")}),
places AS (SELECT doc_id, lines, i, lines[i] AS l FROM texts, unnest(range(1, len(lines) + 1)) AS r(i) WHERE {_SQL_CUE.replace("%s", "lines[i]")}),
segments AS (
  SELECT doc_id, row_number() OVER () AS segment, s FROM (
    SELECT doc_id, array_to_string(lines[greatest(i - before, 1) : i + after], chr(10)) AS s FROM places, windows
    UNION SELECT doc_id, array_to_string(lines[i : i + {OPENING}], chr(10)) FROM places WHERE {_SQL_OPENING}
    UNION SELECT doc_id, text FROM texts WHERE named
  )
),
tokens AS (SELECT doc_id, segment, unnest(regexp_extract_all(s, '{TOKEN}')) AS token FROM segments),
bags AS (SELECT doc_id, segment, token, count(*) AS tf FROM tokens GROUP BY ALL),
norms AS (SELECT segment, sqrt(sum(pow(tf * coalesce(idf, {_IDF_OTHER!r}), 2))) AS norm FROM bags LEFT JOIN idfs USING (token) GROUP BY segment),
dots AS (SELECT doc_id, segment, template, license, sum(tf * idf * weight) AS dot FROM bags JOIN weights USING (token) GROUP BY ALL),
scores AS (SELECT doc_id, license, round(dot / norm, 6) AS score, license IN ({_GENERIC_NAMES}) AS generic FROM dots JOIN norms USING (segment)),
own AS (
  SELECT doc_id, license AS own_license, score AS own_score, generic FROM scores WHERE score >= {THRESHOLD}
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY generic, score DESC, license) = 1
),
licensed AS (
  SELECT dir, own_license AS inherited FROM own JOIN files USING (doc_id) WHERE named
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY generic, own_score DESC, own_license) = 1
),
nearest AS (
  SELECT files.dir, licensed.dir AS ancestor, inherited FROM (SELECT DISTINCT dir FROM files) AS files
  JOIN licensed ON licensed.dir = '' OR files.dir = licensed.dir OR starts_with(files.dir, licensed.dir || '/')
  QUALIFY row_number() OVER (PARTITION BY files.dir ORDER BY length(licensed.dir) DESC) = 1
)
SELECT doc_id, files.dir || '/' || name AS path, own_license, own_score, coalesce(own_license, inherited) AS license,
       CASE WHEN own_license IS NOT NULL THEN files.dir || '/' || name ELSE ancestor END AS licensed_by
FROM files LEFT JOIN own USING (doc_id) LEFT JOIN nearest ON nearest.dir = files.dir
"""
