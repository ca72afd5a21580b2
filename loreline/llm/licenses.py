"""Licences of files: TF-IDF cosine of licence files and headers to templates, inherited from the nearest directory above."""

from __future__ import annotations

import re
from collections import Counter
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loreline.llm.common import packed, stored, text_or_empty

# SPDX ids whose tag is a template.
TAGGED = [
    "AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-3.0",
    "MIT", "MPL-2.0", "Unlicense", "Zlib",
]

# Notices, headings and whole texts of well-known licences, by SPDX id.
TEXTS = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
and limitations under the License."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission."""),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law the author has waived all copyright and related rights, CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies."""),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
arising from the use of this software."""),
]
TEMPLATES = TEXTS + [(name, f"SPDX-License-Identifier: {name}") for name in TAGGED]
TERM = r"[a-z0-9]++(?:\.[0-9]++)*+"
#: Names of files whose licence holds for their directory.
LICENCE_FILE = r"(?i)^(?:licen[sc]e|copying|notice)(?:[.-][^/]*)?$"
#: Least cosine of a passage to a template.
LEAST = 0.8


def terms(text: Column) -> Column:
    """Terms in their order, in lower case: runs of ASCII letters and digits, version numbers as one."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def template_terms() -> list[tuple[str, list[str]]]:
    return [(name, re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", text.lower())) for name, text in TEMPLATES]


def idf(n: int, frequency: int) -> float:
    return log((n + 1) / (frequency + 1)) + 1


def weights(words: DataFrame) -> tuple[dict[str, float], float]:
    """Inverse document frequency over all documents of each term of a template, and that of any other term.

    At most as many numbers as the templates have terms reach the driver. Other terms weigh as if no
    document had them, so that words foreign to a template count against it.
    """
    vocabulary = sorted({t for _, ts in template_terms() for t in ts})
    shown = F.array_intersect(F.array(*[F.lit(t) for t in vocabulary]), F.col("words"))
    counted = words.select(F.explode(F.concat(shown, F.array(F.lit("")))).alias("term")).groupBy("term").count().collect()
    frequency = {r["term"]: r["count"] for r in counted}
    n = frequency.get("", 0)
    return {t: idf(n, frequency.get(t, 0)) for t in vocabulary}, idf(n, 0)


def anchors(counts: Counter, idfs: dict[str, float], least: float) -> list[str]:
    """The heaviest terms of a template, up to those without which the rest is too light for a cosine of `least`.

    A passage that holds none of them shares only the rest, so its cosine is below.
    """
    order = sorted(counts, key=lambda t: (-counts[t] * idfs[t], t))
    squares = [(counts[t] * idfs[t]) ** 2 for t in order]
    return [t for i, t in enumerate(order) if sum(squares[i:]) >= least * least * sum(squares)]


def template_tables(spark: SparkSession, idfs: dict[str, float], least: float) -> tuple[DataFrame, DataFrame]:
    """Weights (template, licence, size, norm, term, weight) and anchors (term, template, place, mass) of the templates."""
    weighed, placed = [], []
    for k, (name, ts) in enumerate(template_terms()):
        counts = Counter(ts)
        norm = sum((n * idfs[t]) ** 2 for t, n in counts.items()) ** 0.5
        weighed += [(k, name, len(ts), norm, t, n * idfs[t]) for t, n in counts.items()]
        held = set(anchors(counts, idfs, least))
        placed += [(t, k, i, idfs[t] ** 2) for i, t in enumerate(ts) if t in held]
    return (
        spark.createDataFrame(weighed, "template int, licence string, size int, norm double, term string, weight double"),
        spark.createDataFrame(placed, "term string, template int, place int, mass double"),
    )


def cosines(counted: DataFrame, keys: list[str], by: list[str], template: DataFrame, idfs: DataFrame, foreign: float) -> DataFrame:
    """(keys, template, licence, score) of counted terms (keys, term, tf) and the templates they meet by `by`."""
    weight = F.col("tf") * F.coalesce("idf", F.lit(foreign))
    norms = counted.join(idfs, "term", "left").groupBy(*keys).agg(F.sqrt(F.sum(weight * weight)).alias("length"))
    shared = counted.join(idfs, "term").join(template, by)
    dots = shared.groupBy(*dict.fromkeys([*keys, "template"]), "licence", "norm").agg(F.sum(F.col("tf") * F.col("idf") * F.col("weight")).alias("dot"))
    return dots.join(norms, keys).select(*dict.fromkeys([*keys, "template"]), "licence", F.round(F.col("dot") / (F.col("length") * F.col("norm")), 6).alias("score"))


def own_licences(files: DataFrame, least: float) -> DataFrame:
    """The files (at, is_file, text and more) with score and licence in place of text: those of the nearest template, ties by name.

    A template is looked for where its anchors stand: each anchor in the text tells where the template would begin, and of
    these places the one with most anchors in line counts (mass, then the first). The passage there, as long as
    the template, is compared by TF-IDF; lines and comment signs between its words don't matter. Licence files are compared whole, too.
    """
    spark = files.sparkSession
    keep = [c for c in files.columns if c != "text"]
    words = files.select(*keep, terms(F.col("text")).alias("words"))
    idfs, foreign = weights(words)
    template, placed = template_tables(spark, idfs, least)
    idf_table = spark.createDataFrame(list(idfs.items()), "term string, idf double")
    held = sorted({r["term"] for r in placed.select("term").distinct().collect()})
    found = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("term"), i.alias("at_word"))), lambda s: s["term"].isin(*held))
    # Only texts with an anchor go on; theirs are the only words that are kept.
    anchored = F.arrays_overlap("words", F.array(*[F.lit(t) for t in held]))
    rows = stored(words.select(*keep, F.when(anchored, F.col("words")).alias("words"), F.when(anchored, found).alias("found")), "licence-rows")
    marked = rows.where("words IS NOT NULL")
    begun = marked.select("at", F.inline("found")).join(placed, "term").withColumn("begin", F.col("at_word") - F.col("place"))
    lined = begun.groupBy("at", "template", "begin").agg(F.sum("mass").alias("mass"))
    best = lined.groupBy("at", "template").agg(F.min(F.struct((-F.round("mass", 6)).alias("below"), "begin"))["begin"].alias("begin"))
    sizes = template.select("template", "size").distinct()
    windows = stored(best.join(sizes, "template"), "licence-windows")
    first = F.greatest("begin", F.lit(0))
    inside = F.slice("words", first + 1, F.greatest(F.col("begin") + F.col("size") - first, F.lit(0)))
    passages = marked.select("at", "words").join(windows, "at").select("at", "template", F.explode(inside).alias("term"))
    counted = stored(passages.groupBy("at", "template", "term").agg(F.count("*").alias("tf")), "licence-passages")
    headers = cosines(counted, ["at", "template"], ["term", "template"], template, idf_table, foreign)
    whole = marked.where("is_file").select("at", F.explode("words").alias("term")).groupBy("at", "term").agg(F.count("*").alias("tf"))
    files_whole = cosines(stored(whole, "licence-whole"), ["at"], ["term"], template, idf_table, foreign)
    both = headers.select("at", "licence", "score").unionByName(files_whole.select("at", "licence", "score")).where(F.col("score") >= least)
    nearest = both.groupBy("at").agg(F.min(F.struct((-F.col("score")).alias("below"), "licence")).alias("best"))
    nearest = stored(nearest.select("at", (-F.col("best.below")).alias("score"), "best.licence"), "licence-found")
    return rows.select(*keep).join(nearest, "at", "left")


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def ancestors(folder: Column) -> Column:
    """A directory and those above it, the root (empty) last of all."""
    steps = F.split(folder, "/")
    return F.when(folder == "", F.array(F.lit(""))).otherwise(
        F.concat(F.transform(F.sequence(F.size(steps), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(steps, 1, n), "/")), F.array(F.lit("")))
    )


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """(doc_id, path, licence, score, origin) of each file.

    A file's own licence is that of the nearest template (`own_licences`), if the cosine is `least` or more: of a
    passage anywhere in it, or of a licence file as a whole; origin is then 'header', or 'file' for licence
    files. Other files inherit the licence of the nearest directory above with a licence file that has one
    (of several the nearest to a template, then the first by name); origin is 'inherited' and the score that
    file's. Without any, licence, score and origin are null.

    Texts are cut into terms in place; only those that hold a weighty term of some template are kept as words. Directories are
    made distinct before they are joined with the licences of those above them; files meet their directory as narrow rows.

    Null and empty texts have no licence of their own; a null path is the root's and no licence file. Null
    and repeated ids keep their rows. Very long texts are searched whole; of several places in a text with as many anchors in line
    the first counts. Empty tables give no rows.
    """
    row = packed(docs)
    folder = directory(F.coalesce("path", F.lit("")))
    named = F.coalesce(F.regexp_extract("path", "[^/]*$", 0).rlike(LICENCE_FILE), F.lit(False))
    rows = row.select(F.monotonically_increasing_id().alias("at"), F.col(f"row.`{id_col}`").alias("doc_id"), F.col(f"row.`{path_col}`").alias("path"), text_or_empty(F.col(f"row.`{text_col}`")).alias("text"))
    files = rows.select("at", "doc_id", "path", folder.alias("folder"), named.alias("is_file"), "text")
    own = stored(own_licences(files, least).drop("at"), "licence-own")

    granted = own.where("is_file AND licence IS NOT NULL").groupBy(F.col("folder").alias("above"))
    granted = stored(granted.agg(F.min(F.struct((-F.col("score")).alias("below"), "licence")).alias("grant")), "licence-files")
    folders = own.select("folder").distinct().select("folder", F.posexplode(ancestors(F.col("folder"))).alias("steps", "above"))
    nearest_above = stored(folders, "licence-folders").join(granted, "above").groupBy("folder").agg(F.min_by("grant", "steps").alias("grant"))
    inherited = stored(nearest_above.select(F.col("folder").alias("in_folder"), "grant.licence", (-F.col("grant.below")).alias("score")).toDF("in_folder", "i_licence", "i_score"), "licence-inherited")
    joined = own.join(inherited, F.col("folder") == F.col("in_folder"), "left")
    has = F.col("licence").isNotNull()
    origin = F.when(has & F.col("is_file"), "file").when(has, "header").when(F.col("i_licence").isNotNull(), "inherited")
    return joined.select("doc_id", "path", F.coalesce("licence", "i_licence").alias("licence"), F.coalesce("score", "i_score").alias("score"), origin.alias("origin"))
