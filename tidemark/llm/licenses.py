"""License scans with DataFrame functions only: MinHash bands retrieve templates, shingle containment verifies.

Texts and templates are cut into lower-cased words (letters and digits) and five-word shingles. A window is six
words (two shingles); text windows start at every second word, so each shingle lies in one, and template windows
at every word. Each window has BANDS one-row MinHash bands. A window inside a copy of a template longer than five
words equals one of its windows and always collides; one that holds a single shingle of a template misses it with a
chance below 0.002. A collision retrieves the template for the window, whose shingles and those of its neighbours
are compared exactly with the template's; the share of the template's shingles found in the whole document must
reach LEAST.

Null texts and texts below five words have no shingle and no result; very long texts are read whole; repeated rows
give one result each pair of id and template, with the shingles of all rows of the id; extra columns are ignored,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
BANDS = 16
LEAST = 0.8
#: Texts and notices of public licenses, as their publishers word them; fixed values.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT-notice", "Released under the MIT License"),
    ("MIT-notice", "Licensed under the MIT License"),
    ("GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("GPL-3.0-notice", "the GNU General Public License, version 3"),
    ("GPL-2.0-notice", "the GNU General Public License, version 2"),
    ("LGPL-3.0", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("LGPL-2.1", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("LGPL-notice", "licensed under the GNU Lesser General Public License"),
    ("AGPL-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("AGPL-notice", "licensed under the GNU Affero General Public License"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-notice", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("BUSL-1.1", "Use of this software is governed by the Business Source License included in the LICENSE file"),
    ("Artistic-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License (2.0)"),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC0-1.0", "has waived all copyright and related or neighboring rights to this work"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-4.0-notice", "licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0-notice", "licensed under CC BY-SA 4.0"),
    ("CC-BY-ND-4.0-notice", "licensed under CC BY-ND 4.0"),
    ("CC-BY-NC-4.0-notice", "licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-SA-4.0-notice", "licensed under CC BY-NC-SA 4.0"),
    ("CC-BY-NC-ND-4.0-notice", "licensed under CC BY-NC-ND 4.0"),
)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingles(ws: Column) -> Column:
    """The distinct shingles of a word array, as strings; none below SHINGLE words."""
    last = F.size(ws) - SHINGLE
    every = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.concat_ws(" ", *[F.get(ws, i + j) for j in range(SHINGLE)]))
    return F.when(last >= 0, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def _windows(df: DataFrame, step: int) -> DataFrame:
    """``df``, with word arrays ``_w``, and its windows: first word ``at``, hashes ``s`` and ``t`` of its two shingles (equal at the end).

    Words are read one by one, as slice() copies the whole array; explode and inline stay in generated code,
    and inline keeps the hashes from being computed anew for every band.
    """
    last = F.size("_w") - SHINGLE
    shingle = lambda i: F.xxhash64(*[F.get(F.col("_w"), i + j) for j in range(SHINGLE)])
    every = df.withColumn("at", F.explode(F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step)))))
    return every.select("*", F.inline(F.array(F.struct(shingle(F.col("at")).alias("s"), shingle(F.least(F.col("at") + 1, last)).alias("t")))))


def _band(k: int) -> Column:
    return F.least(F.xxhash64(F.lit(k), "s"), F.xxhash64(F.lit(k), "t"))


def _bands() -> Column:
    return F.inline(F.array(*[F.struct(F.lit(k).alias("k"), _band(k).alias("b")) for k in range(BANDS)]))


def templates(spark: SparkSession, rows=TEMPLATES) -> DataFrame:
    """template (its place in ``rows``), license, _w (words), _shingles of each template; as many rows as templates."""
    listed = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(n).alias("license"), F.lit(t).alias("_text")) for i, (n, t) in enumerate(rows)])
    df = spark.range(1).select(F.inline(listed)).withColumn("_w", words(F.col("_text")))
    return df.where(F.size("_w") >= SHINGLE).select("template", "license", "_w", shingles(F.col("_w")).alias("_shingles"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rows=TEMPLATES, least: float = LEAST) -> DataFrame:
    """One row for each document and license found in it: key, license, containment (of its best template), at (first word of the first window that holds some of it)."""
    spark = docs.sparkSession
    known = templates(spark, rows)
    bands = _windows(known, 1).select("template", _bands()).distinct()
    values: list[set[int]] = [set() for _ in range(BANDS)]
    for r in bands.collect():  # bounded by the templates' words
        values[r["k"]].add(r["b"])

    retrieved = F.lit(False)
    for k in range(BANDS):
        listed = ", ".join(f"{v}L" for v in sorted(values[k]))
        retrieved = retrieved | F.expr(f"least(xxhash64({k}, s), xxhash64({k}, t)) IN ({listed})")
    hits = _windows(docs.select(F.col(key).alias("_key"), words(F.col(text)).alias("_w")), 2).where(retrieved)
    # the window's two shingles and two on either side
    shingle = lambda i: F.when((i >= 0) & (i + SHINGLE <= F.size("_w")), F.concat_ws(" ", *[F.get(F.col("_w"), i + j) for j in range(SHINGLE)]))
    near = hits.select("_key", "at", "s", "t", F.array(*[shingle(F.col("at") + d) for d in range(-2, 4)]).alias("_near"))
    found = near.select("_key", "at", "_near", _bands()).join(F.broadcast(bands), ["k", "b"]).groupBy("_key", "template", "at").agg(F.first("_near").alias("_near"))
    parts = known.select("template", "license", F.size("_shingles").alias("_n"), F.explode("_shingles").alias("_s"))
    same = found.select("_key", "template", "at", F.explode("_near").alias("_s")).join(F.broadcast(parts), ["template", "_s"])
    share = same.groupBy("_key", "template", "license", "_n").agg(F.size(F.collect_set("_s")).alias("_c"), F.min("at").alias("at"))
    share = share.withColumn("containment", F.col("_c") / F.col("_n")).where(F.col("containment") >= least)
    return share.groupBy(F.col("_key").alias(key), "license").agg(F.max("containment").alias("containment"), F.min("at").cast("long").alias("at"))
