import math
import re
from collections import Counter

from tessera.llm import license_scan as ls


def cosine(line, text):
    bags = [Counter(re.findall(ls.TERM, t.lower())) for _, t in ls.TEMPLATES]
    df = Counter(t for b in bags for t in b)
    idf = lambda t: math.log((1 + len(bags)) / (1 + df[t])) + 1
    a, b = (Counter(re.findall(ls.TERM, x.lower())) for x in (line, text))
    norm = lambda c: math.sqrt(sum((n * idf(t)) ** 2 for t, n in c.items()))
    return round(sum(a[t] * b[t] * idf(t) ** 2 for t in a) / (norm(a) * norm(b)), 9) if a and b else 0.0


LINES = [
    "Licensed under the Apache License, Version 2.0.", "licensed UNDER the apache license version 2.0", "# Released under the MIT License", "All rights reserved.",
    "Copyright 2020 someone. All rights reserved.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0", "the of and to",
    "You may use the license server under the desk.", "rights", "", "Permission is hereby granted, free of charge, to any person obtaining a copy",
]


def test_lines_equal_brute_force_without_the_leading_word_filter(spark):
    df = spark.createDataFrame([("p", "\n".join(LINES)), ("q", None)], "path string, text string")
    got = {r.place: (r.license, r.score) for r in ls.license_units(df, ["path"], "text").where("kind = 0").collect()}
    want = {}
    for i, line in enumerate(LINES):
        score, order, name = max((cosine(line, t), -n, name) for n, (name, t) in enumerate(ls.TEMPLATES))
        if score >= ls.THRESHOLD:
            want[i] = (name, score)
    assert {i: x[0] for i, x in got.items()} == {i: x[0] for i, x in want.items()} and len(want) >= 7
    assert all(abs(got[i][1] - want[i][1]) < 1e-8 for i in want)


def wrap(text, width, mark=""):
    import textwrap

    return "\n".join(mark + x for x in textwrap.wrap(text, width))


def template(name, start):
    return next(" ".join(t.split()) for n, t in ls.TEMPLATES if n == name and t.startswith(start) and len(t) > 150)


def test_paragraphs_and_whole_files_equal_brute_force(spark):
    mit, bsd3, bsd2 = template("MIT", "Permission"), template("BSD-3-Clause", "Redist"), template("BSD-2-Clause", "Redist")
    apache, gpl = template("Apache-2.0", "Licensed"), template("GPL-3.0", "This program")
    warranty = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND."
    texts = {
        "mit/LICENSE": f"MIT License\n\nCopyright (c) 2020 Some One\n\n{wrap(mit, 70)}\n\n{warranty}", "bsd/LICENSE.txt": wrap(bsd3, 60), "bsd2/COPYING": wrap(bsd2, 60),
        "apache/LICENSE": f"{wrap(apache, 50)}\n\nmore\nwords", "gpl/COPYING": wrap(gpl, 66), "src/a.py": f"#!/bin/x\n#\n{wrap(apache, 60, '# ')}\n#\nimport os",
        "src/b.c": f"/*\n{wrap(gpl, 60, ' * ')}\n */\nint main;", "src/none.c": "int x;\n\nint y;",
    }
    df = spark.createDataFrame([(p, t, 1) for p, t in texts.items()], "path string, text string, `_text.x` int")
    whole = {p: bool(re.match(ls.LICENSE_FILE, p.rpartition("/")[2])) for p in texts}
    got = {(r.path, r.kind, r.place): (r.license, r.score) for r in ls.license_units(df, ["path"], "text", ls.F.rlike("path", ls.F.lit("(LICENSE|COPYING)"))).collect()}
    want = {}
    for p, t in texts.items():
        low = t.lower()
        units = [(0, i, x) for i, x in enumerate(low.split("\n"))] + [(1, i, x) for i, x in enumerate(re.split(ls.GAP, low)) if "\n" in x] + [(2, 0, low)] * whole[p]
        for kind, i, x in units:
            score, order, name = max((cosine(x, t2), -n, name) for n, (name, t2) in enumerate(ls.TEMPLATES))
            if score >= ls.THRESHOLD:
                want[p, kind, i] = (name, score)
    assert {k: x[0] for k, x in got.items()} == {k: x[0] for k, x in want.items()} and {k[1] for k in want} == {0, 1, 2}
    assert all(abs(got[k][1] - want[k][1]) < 1e-8 for k in want)
    below = [(f"{p.partition('/')[0]}/deep/x.py", "x = 1", 1) for p in texts if whole[p]]
    found = {r.path: (r.own_license, r.license, r.inherited_from) for r in ls.license_scan(df.unionByName(spark.createDataFrame(below, df.schema))).collect()}
    names = {"mit": "MIT", "bsd": "BSD-3-Clause", "bsd2": "BSD-2-Clause", "apache": "Apache-2.0", "gpl": "GPL-3.0"}
    assert {f: found[f"{f}/deep/x.py"] for f in names} == {f: (None, n, f) for f, n in names.items()}
    assert (found["src/a.py"][0], found["src/b.c"][0], found["src/none.c"][1]) == ("Apache-2.0", "GPL-3.0", None)


def test_inheritance(spark):
    mit, gpl, none = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "x = 1"
    rows = [
        ("LICENSE", mit), ("a.py", none), ("lib/b.py", none), ("lib/deep/c.py", none), ("lib/gpl/COPYING.txt", f"{gpl}\n{none}"), ("lib/gpl/d.py", none), ("lib/gpl/x/e.py", none),
        ("lib/gpl/f.py", f"{none}\n{mit}\n{mit}\n{gpl}"), ("libgpl/g.py", none), ("notes/license.md", none), ("notes/h.py", None), (None, "All rights reserved."), ("a.py", none), ("dup.py", mit), ("dup.py", mit),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "path string, text string, license long")
    got = {r.path: (r.n_matches, r.own_license, r.license, r.inherited_from) for r in ls.license_scan(df).collect()}
    assert got == {
        "LICENSE": (2, "MIT", "MIT", None), "a.py": (0, None, "MIT", ""), "lib/b.py": (0, None, "MIT", ""), "lib/deep/c.py": (0, None, "MIT", ""),
        "lib/gpl/COPYING.txt": (1, "GPL-3.0", "GPL-3.0", None), "lib/gpl/d.py": (0, None, "GPL-3.0", "lib/gpl"), "lib/gpl/x/e.py": (0, None, "GPL-3.0", "lib/gpl"),
        "lib/gpl/f.py": (4, "MIT", "MIT", None), "libgpl/g.py": (0, None, "MIT", ""), "notes/license.md": (0, None, "MIT", ""), "notes/h.py": (0, None, "MIT", ""),
        "": (1, "Proprietary", "Proprietary", None), "dup.py": (1, "MIT", "MIT", None),
    }
    assert ls.license_scan(df.limit(0)).count() == 0
