"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle
containment verifies them.

Windows are graded by the size of what is looked for: a template, or a piece of a long one, of n to 1.5 n shingles
is looked for in windows of twice as many shingles, one starting at every half window; so a passage of its size lies
whole in some window, and a short notice fills its window whatever stands next to it.  A window is made of its
relevant shingles, those that any template has (all others can't add to a containment); where a text has none
there is no window.  Bands have one row each: if a passage holds ``CONTAINED`` of a piece's m shingles, its window's
Jaccard similarity with the piece is at least j = 0.7 m / (3 m + 0.3 m), where all else in the window is relevant
too, and at least 0.7 where nothing else is; it collides in some of the bands with probability 1 - (1 - j) ** BANDS:
0.9995 at the worst.  Long templates are cut into pieces one after the other, of which one at least is held as far
as the whole.  Verification is exact: of the template's shingles, as words, the whole
document holds a share of ``CONTAINED`` or more, and of those
that a related license does not have ``OWN`` or more, for each such license; so inexact copies count, and
versions and variants stay apart.  A template that lies whole within a found template of another
license (the first sentence of BSD texts) adds nothing.  A license's containment is its best template's.

What is found are the listed wordings, up to such changes: a license named in other words, or a GNU
license without its version, is not.

Edge cases: null and empty texts match nothing.  Null ids and repeated rows are told apart by
id and text hash; one row per input row.  Very long texts are cut up in time in proportion to their length; only
relevant shingles leave them.  Containments that tie give the same names, which are in order.  Empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm._common import LOWER, UPPER, cut, lower_ascii, pinned, small

SHINGLE, BANDS, CONTAINED, OWN = 3, 32, 0.7, 0.5
#: Most shingles of a piece, by grade; a grade's windows have twice as many.
GRADES = (2, 3, 4, 6, 9, 13, 20, 30)
BETWEEN = "[^0-9A-Za-z]+"

#: Short notices by which licenses are applied (fixed values).
TEMPLATES = {
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
}

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'


def _gnu(kind: str, short: str, version: str, program: str = "program") -> list[str]:
    """Wordings of one version of a GNU license."""
    name, major = f"GNU {kind}General Public License", version.removesuffix(".0")
    return [
        f"This {program} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {major} of the License, or (at your option) any later version.",
        f"This {program} is free software; you can redistribute it and/or modify it under the terms of the {name} version {major} as published by the Free Software Foundation.",
        f"This work is licensed under the {name}, version {major}.",
        f"{name}, version {major}",
        f"{name} v{major}",
        f"{name} {version}",
        f"version {major} of the {name}",
        f"{name.upper()} Version {major}, {dict(zip(('2', '2.1', '3'), ('June 1991', 'February 1999', '29 June 2007'), strict=True))[major] if kind != 'Affero ' else '19 November 2007'}",
        f"{short} version {major}",
        f"under the {short}v{major}",
        f"{short}v{major} or later",
        f"SPDX-License-Identifier: {short}-{version}",
        f"SPDX-License-Identifier: {short}-{version}-only",
        f"SPDX-License-Identifier: {short}-{version}-or-later",
    ]


def _creative(kind: str, short: str) -> list[str]:
    name = f"Creative Commons {kind} 4.0 International"
    return [f"licensed under a {name} License", f"{name} Public License", name, f"CC {short} 4.0", f"creativecommons.org/licenses/{short.lower()}/4.0", f"SPDX-License-Identifier: CC-{short}-4.0"]


#: Headers, texts and further wordings, tags too.
WORDINGS = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS,
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "Released under MIT License", "the MIT License", "under MIT license", "under an MIT license", "under the MIT licence", "The MIT License (MIT)", "MIT License Copyright (c)", "SPDX-License-Identifier: MIT",
    ],
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache 2.0 license", "version 2.0 of the Apache License", "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL-2.0": _gnu("", "GPL", "2.0"),
    "GPL-3.0": _gnu("", "GPL", "3.0"),
    "LGPL-2.1": _gnu("Lesser ", "LGPL", "2.1", "library"),
    "LGPL-3.0": _gnu("Lesser ", "LGPL", "3.0", "library"),
    "AGPL-3.0": _gnu("Affero ", "AGPL", "3.0"),
    "BSD-3-Clause": [
        _BSD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END,
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "BSD 3-Clause License", "3-clause BSD license", "new BSD license", "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "BSD-2-Clause": [_BSD + " " + _BSD_END, "BSD 2-Clause License", "2-clause BSD license", "simplified BSD license", "SPDX-License-Identifier: BSD-2-Clause"],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "Mozilla Public License v2.0", "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY-4.0": _creative("Attribution", "BY"),
    "CC-BY-SA-4.0": _creative("Attribution-ShareAlike", "BY-SA"),
    "CC-BY-NC-4.0": _creative("Attribution-NonCommercial", "BY-NC"),
    "CC0-1.0": ["CC0 1.0 Universal", "CC0 1.0 Public Domain Dedication", "creativecommons.org/publicdomain/zero/1.0", "SPDX-License-Identifier: CC0-1.0"],
    "ISC": [_ISC + ", provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_END, "the ISC License", "under ISC license", "SPDX-License-Identifier: ISC"],
    "0BSD": [_ISC + ". " + _ISC_END, "SPDX-License-Identifier: 0BSD"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
}


def _words(text):
    return F.filter(F.split(lower_ascii(text), BETWEEN), lambda w: w != "")


def _shingles(words):
    """Array of shingles as text (a whole shorter text is one)."""
    n = F.least(F.lit(SHINGLE), F.size(words))
    return F.when(F.size(words) > 0, F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.concat_ws(" ", F.slice(words, i + 1, n)))).otherwise(F.array().cast("array<string>"))


def _pieces(words: list[str]) -> list[list[str]]:
    """Shingles of a template, or of near-equal pieces of a long one, in order."""
    found = [" ".join(words[i : i + SHINGLE]) for i in range(max(len(words) - SHINGLE + 1, 1))]
    count = -(-len(found) // GRADES[-1])
    cuts = [len(found) * k // count for k in range(count + 1)]
    return [sorted(set(found[i:j])) for i, j in zip(cuts, cuts[1:], strict=False)]


def grade_of(piece: list[str]) -> int:
    return next(g for g in GRADES if len(piece) <= g)


def templates(texts: dict[str, str] | None = None) -> list[tuple[str, list[list[str]]]]:
    """(license, shingles of each piece), one a template."""
    named = list((TEMPLATES if texts is None else texts).items()) + [(k, t) for k, ts in (WORDINGS if texts is None else {}).items() for t in ts]
    split = [(k, [w for w in re.split(BETWEEN, t.translate(str.maketrans(UPPER, LOWER))) if w]) for k, t in named]
    return [(k, _pieces(w)) for k, w in split if w]


def tests_of(known: list[tuple[str, list[list[str]]]]) -> tuple[list, list]:
    """Rows (template, license, part, shingle, n, need, parts): part 0 is the whole template, each other one what a
    related license lacks of it; and pairs (template, template of another license that has all of it)."""
    sets = [{s for piece in pieces for s in piece} for _, pieces in known]
    of: dict[str, set] = {}
    for (k, _), x in zip(known, sets, strict=True):
        of.setdefault(k, set()).update(x)
    rows, within = [], []
    for t, ((k, _), x) in enumerate(zip(known, sets, strict=True)):
        own = {frozenset(x - y) for other, y in of.items() if other != k and x & y} - {frozenset()}
        parts = [(x, CONTAINED), *((o, OWN) for o in sorted(own, key=sorted))]
        rows += [(t, k, p, s, len(part), need, len(parts)) for p, (part, need) in enumerate(parts) for s in sorted(part)]
        within += [(t, u) for u, ((other, _), y) in enumerate(zip(known, sets, strict=True)) if other != k and x < y]
    return rows, within


def _bands(shingles):
    """Least hash of the shingles under each of BANDS seeded functions."""

    def band(b: int):
        return F.struct(F.lit(b).alias("band"), F.array_min(F.transform(shingles, lambda s: F.xxhash64(F.lit(b), s))).alias("least"))

    return F.array(*[band(b) for b in range(BANDS)])


def scan(docs: DataFrame, texts: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, licenses (sorted names) and containment (per name)."""
    spark = docs.sparkSession
    known = templates(texts)
    # The templates are the operator's own list: bounded, and read here to drop irrelevant shingles early.
    listed = sorted({s for _, pieces in known for piece in pieces for s in piece})
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    docs = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    words = docs.select("doc_id", "th", pinned(_words(F.col("text"))).alias("w"))
    n = F.greatest(F.size("w") - SHINGLE, F.lit(0))
    hashed = words.withColumn("s", pinned(F.transform(F.sequence(F.lit(0), n), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))))
    singles = spark.createDataFrame([(s,) for s in listed] or [("",)], "s string").select(F.split("s", " ").alias("w"))
    numbers = [r[0] for r in singles.select(F.xxhash64(F.get("w", F.lit(0)), F.get("w", F.lit(1)), F.get("w", F.lit(2)))).collect()]
    # Tests of membership in a list of literals are lookups in a hash set.
    some = hashed.withColumn("at", pinned(F.filter(F.transform("s", lambda x, i: F.when(x.isin(sorted(set(numbers))), i)), lambda i: i.isNotNull()))).filter("size(at) > 0")
    hits = some.select("doc_id", "th", F.explode(F.transform("at", lambda i: F.struct(i.alias("i"), F.array_join(F.slice("w", i + 1, F.lit(SHINGLE)), " ").alias("s")))).alias("hit"))
    hits = cut(hits.select("doc_id", "th", "hit.i", "hit.s").filter(F.col("s").isin(listed or [""])), "hits")
    # Windows of a grade begin at every multiple of it, so a hit lies in two of them.
    in_windows = F.explode(F.array(*[F.struct(F.lit(g).alias("grade"), (F.floor(F.col("i") / g) - k).alias("window")) for g in GRADES for k in (0, 1)]))
    windows = hits.withColumn("v", in_windows).groupBy("doc_id", "th", "v.grade", "v.window").agg(F.collect_set("s").alias("x"))  # two grades' worth at most
    probes = windows.select("doc_id", "th", "grade", F.explode(_bands("x")).alias("b")).select("doc_id", "th", "grade", "b.band", "b.least")
    pieces = spark.createDataFrame([(t, grade_of(p), p) for t, (_, ps) in enumerate(known) for p in ps], "template int, grade int, shingles array<string>")
    index = pieces.select("template", "grade", F.explode(_bands("shingles")).alias("b")).select("template", "grade", F.col("b.band").alias("band"), F.col("b.least").alias("least"))
    met = probes.join(F.broadcast(index), ["grade", "band", "least"]).select(F.col("doc_id").alias("i_id"), F.col("th").alias("k"), "template").distinct()
    distinct = hits.select("doc_id", "th", "s").distinct()
    each = distinct.join(met, F.col("doc_id").eqNullSafe(F.col("i_id")) & (F.col("th") == F.col("k"))).select("doc_id", "th", "template", "s")
    rows, within = tests_of(known)
    tests = spark.createDataFrame(rows, "t int, license string, part int, shingle string, n int, need double, parts int")
    found = each.join(F.broadcast(tests), (F.col("template") == F.col("t")) & (F.col("s") == F.col("shingle"))).groupBy("doc_id", "th", "t", "part").agg(F.first("license").alias("license"), (F.count("*") / F.max("n")).alias("share"), F.max("need").alias("need"), F.max("parts").alias("parts"))
    found = found.filter("share >= need").groupBy("doc_id", "th", "t").agg(F.first("license").alias("license"), F.max(F.when(F.col("part") == 0, F.col("share"))).alias("share"), F.count("*").alias("passed"), F.max("parts").alias("parts")).filter("passed = parts")
    found = found.groupBy("doc_id", "th").agg(F.collect_list(F.struct("t", "license", "share")).alias("a"))
    codes = [t * len(known) + u for t, u in within] or [-1]
    found = found.withColumn("f", F.filter("a", lambda x: ~F.exists("a", lambda y: (x["t"] * len(known) + y["t"]).isin(codes))))
    names = F.array_sort(F.array_distinct(F.transform("f", lambda x: x["license"])))
    best = lambda k: F.array_max(F.transform(F.filter("f", lambda x: x["license"] == k), lambda x: x["share"]))
    found = found.select("doc_id", "th", F.transform(names, lambda k: F.struct(k.alias("license"), F.round(best(k), 4).alias("share"))).alias("m"))
    found = small(cut(found.select(F.col("doc_id").alias("i"), F.col("th").alias("k"), "m"), "licenses"))
    out = docs.select("doc_id", "th").join(found, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("k")), "left")
    none = F.array().cast("array<string>")
    return out.select("doc_id", F.coalesce(F.transform("m", lambda x: x["license"]), none).alias("licenses"), F.coalesce(F.transform("m", lambda x: x["share"]), F.array().cast("array<double>")).alias("containment"))
