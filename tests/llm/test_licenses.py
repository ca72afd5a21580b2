"""Licences found in headers and files, against plain Python and hand cases."""

import random
import re
from collections import Counter
from math import log

import pytest

from loreline.llm import licenses

MPL = """// This Source Code Form is subject to the terms
// of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
// distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
ISC = "ISC License\n\nCopyright (c) 2020, Someone\n\n" + dict(licenses.TEXTS)["ISC"] + "\n"
FULL_MIT = max((t for n, t in licenses.TEXTS if n == "MIT"), key=len)

CASES = [
    ("a/LICENSE", "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.", "GPL-3.0", "file"),
    ("a/x/main.c", "int main() { return 0; }", "GPL-3.0", "inherited"),
    ("b/COPYING", ISC, "ISC", "file"),
    ("b/deep/er/file.py", "print('no notice here')", "ISC", "inherited"),
    ("c/one.py", "#!/usr/bin/env python\n# SPDX-License-Identifier: MIT\nimport os", "MIT", "header"),
    ("c/two.js", MPL + "\nlet x = 1;", "MPL-2.0", "header"),
    ("c/LICENSE.txt", "   Apache License\n  Version 2.0, January 2004\n  http://www.apache.org/licenses/\n\nTERMS AND CONDITIONS", "Apache-2.0", "file"),
    ("c/three.go", "package main", "Apache-2.0", "inherited"),
    ("d/LICENSE", "MIT License\n\nCopyright 2021 A. Name\n\n" + FULL_MIT, "MIT", "file"),
    ("d/four.txt", "The license of this text is told elsewhere, and mit is a school.", "MIT", "inherited"),
    ("e/five.txt", "words without any notice", None, None),
    ("e/six.txt", None, None, None),
]


def test_real_files(spark):
    filler = [(f"f/{i}.txt", f"prose number {i} with words of its own like w{i} and v{i}", None, None) for i in range(40)]
    docs = spark.createDataFrame([(i, p, t) for i, (p, t, _, _) in enumerate(CASES + filler)], "doc_id long, path string, text string")
    got = {r.path: (r.licence, r.origin) for r in licenses.license_scan(docs).collect()}
    assert got == {p: (licence, origin) for p, _, licence, origin in CASES + filler}


def plain(files):
    """(licence, score) of each file (text, is_file), every template tried at every place where an anchor puts it."""

    def cut(t):
        return re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", (t or "").lower())

    texts = [cut(t) for t, _ in files]
    templates = [(name, cut(t)) for name, t in licenses.TEMPLATES]
    n, vocabulary = len(texts), {t for _, ts in templates for t in ts}
    df = Counter(t for ts in texts for t in set(ts))
    idf = {t: log((n + 1) / (df[t] + 1)) + 1 for t in vocabulary}
    foreign = log(n + 1) + 1

    def cosine(a, b):
        x, y = Counter(a), Counter(b)
        dot = sum(x[t] * idf[t] * y[t] * idf[t] for t in y if t in x)
        return round(dot / sum((c * idf.get(t, foreign)) ** 2 for t, c in x.items()) ** 0.5 / sum((c * idf[t]) ** 2 for t, c in y.items()) ** 0.5, 6) if dot else 0.0

    out = []
    for ts, (_, is_file) in zip(texts, files, strict=True):
        found = []
        for name, b in templates:
            held = set(licenses.anchors(Counter(b), idf, 0.8))
            begun = Counter()
            for i, t in enumerate(ts):
                for place, u in enumerate(b):
                    if t == u and t in held:
                        begun[i - place] += idf[t] ** 2
            if begun:
                at = min(begun, key=lambda s: (-round(begun[s], 6), s))
                found.append((-cosine(ts[max(0, at) : max(0, at + len(b))], b), name))
                if is_file:
                    found.append((-cosine(ts, b), name))
            else:
                # What holds no anchor can't be near.
                assert cosine(ts, b) < 0.8
        best = min(found, default=(0.0, None))
        out.append((best[1], -best[0]) if -best[0] >= 0.8 else (None, None))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_every_place(spark, seed):
    draw = random.Random(seed)
    bits = [w for _, t in licenses.TEXTS for w in t.split()]
    files = []
    for i in range(120):
        words = draw.choices(bits + ["other", "words"], k=draw.choice([0, 3, 30]))
        if draw.random() < 0.7:
            _, t = draw.choice(licenses.TEMPLATES)
            ts = t.split()
            for _ in range(draw.choice([0, 0, 1, 3])):
                ts[draw.randrange(len(ts))] = draw.choice(["changed", "", "// "])
            at = draw.randint(0, len(words))
            words[at:at] = ts
        files.append((draw.choice([" ", "\n# "]).join(words), i % 3 == 0))
    docs = spark.createDataFrame([(i, f"{i}/LICENSE" if f else f"{i}/x.c", t) for i, (t, f) in enumerate(files)], "doc_id long, path string, text string").repartition(3)
    got = {r.doc_id: (r.licence, r.score) for r in licenses.license_scan(docs).collect()}
    assert got == dict(enumerate(plain(files)))
