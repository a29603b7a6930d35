"""License scans: sparse TF-IDF cosine of headers and license files to templates, and inheritance by directory.

DataFrame functions only. The units compared are lines, paragraphs of several lines (a
header block: lines up to one without words, comment marks aside), and the whole text of
a license file. Each is a vector over words; only words of some template matter for the
dot product, the others lengthen the norm. A unit is compared with a template only if it
holds one of the template's leading words: the longest ones, taken until those left out
could not reach the threshold, so none is missed. A file without a license of its own
takes that of the nearest directory above it which has a license file.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import col
from .common import stored, text_key, text_of

#: Names of public licenses and the statements by which files declare them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright to the public domain worldwide."),
    ("Proprietary", "All rights reserved."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and
this permission notice appear in all copies."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
License at http://www.apache.org/licenses/LICENSE-2.0"""),
    ("Apache-2.0", """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS
OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
http://mozilla.org/MPL/2.0/."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions
of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder
nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions
of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
]
#: Words of every kind of text; they lead a template only if its other words cannot.
COMMON = set("a all an and any are as at be by for from if in is it may not of on or such that the this to under was with you your".split())
#: A word of a statement: letters and digits, with inner dots and hyphens.
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
THRESHOLD = 0.8
#: Between paragraphs: lines without a letter or digit, in lower-cased text.
GAP = r"\n(?:[^a-z0-9\n]*\n)+"
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice)([._-].*)?$"


def template_vectors(templates: list[tuple[str, str]], threshold: float):
    """(vectors, weight of a word in no template): unit vectors as (number, license, term, weight, leads)."""
    bags = [Counter(re.findall(TERM, text.lower())) for _, text in templates]
    df = Counter(term for bag in bags for term in bag)
    idf = {term: math.log((1 + len(bags)) / (1 + n)) + 1 for term, n in df.items()}
    rows = []
    for number, ((name, _), bag) in enumerate(zip(templates, bags)):
        raw = {t: n * idf[t] for t, n in bag.items()}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        left = 1.0
        for term, w in sorted(raw.items(), key=lambda x: (x[0] in COMMON, -len(x[0]), x[0])):  # long words first: they are rare in texts
            rows.append((number, name, term, w / norm, left >= threshold * threshold))
            left -= (w / norm) ** 2
    return rows, idf, math.log(1 + len(bags)) + 1


def any_word(words: list[str]) -> str:
    """A pattern that finds any of the words at a word's start; their common beginnings are tried once."""
    tree: dict = {}
    for w in words:
        at = tree
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}

    def pattern(at: dict) -> str:
        if "" in at:
            return ""  # found already
        parts = [re.escape(c) + pattern(below) for c, below in sorted(at.items())]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return rf"\b{pattern(tree)}"


#: Kinds of units; a license file's whole text says most about it.
LINE, PARAGRAPH, FILE = 0, 1, 2


def license_units(files: DataFrame, keys: list[str], text_col: str, whole: Column | None = None, templates=None, threshold: float = THRESHOLD) -> DataFrame:
    """(keys, kind, place, license, score): each unit's best template at the threshold or above.

    `keys` tell files apart; `whole` says which are license files. Paragraphs of one line
    are lines only. The texts are read once: the words of units that hold a leading word
    are written to the shared folder and counted from there. A very long text is one row
    and its units are at most three times its size.
    """
    spark = files.sparkSession
    rows, idf, unknown = template_vectors(templates or TEMPLATES, threshold)
    leads = sorted({t for _, _, t, _, leading in rows if leading})
    vectors = F.broadcast(spark.createDataFrame([(n, name, t, w) for n, name, t, w, _ in rows], "_template int, license string, _term string, _weight double"))
    weights = F.broadcast(spark.createDataFrame(list(idf.items()), "_term string, _idf double"))
    found = lambda c: F.rlike(c, F.lit(any_word(leads)))
    text = files.select(*[col(k) for k in keys], (F.lit(False) if whole is None else whole).alias("_whole"), F.lower(text_of(col(text_col))).alias("_text")).where(found("_text"))
    unit = lambda kind: lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("place"), x.alias("text"))
    several = lambda u: found(u["text"]) & F.contains(u["text"], F.lit("\n"))
    lines = F.filter(F.transform(F.split("_text", "\n", -1), unit(LINE)), lambda u: found(u["text"]))
    paragraphs = F.filter(F.transform(F.split("_text", GAP, -1), unit(PARAGRAPH)), several)
    everything = F.when(F.col("_whole"), F.array(unit(FILE)(F.col("_text"), F.lit(0)))).otherwise(F.array().cast("array<struct<kind:int,place:int,text:string>>"))
    units = text.select(*keys, F.inline(F.concat(lines, paragraphs, everything)))
    units = units.withColumn("_terms", F.regexp_extract_all("text", F.lit(TERM), F.lit(0))).drop("text")
    units = units.where(F.arrays_overlap("_terms", F.array(*[F.lit(t) for t in leads])))
    keys = [*keys, "kind", "place"]
    term = units.select(*keys, F.explode("_terms").alias("_term")).groupBy(*keys, "_term").agg(F.count("*").alias("_n"))
    term = stored(term, "license-terms").join(weights, "_term", "left").withColumn("_w", F.col("_n") * F.coalesce("_idf", F.lit(unknown)))
    norm = term.groupBy(*keys).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
    dot = term.join(vectors, "_term").groupBy(*keys, "_template", "license").agg(F.sum(F.col("_w") * F.col("_weight")).alias("_dot"))
    scored = dot.join(norm, keys).select(*keys, "license", "_template", F.round(F.col("_dot") / F.col("_norm"), 9).alias("score"))
    best = F.max_by(F.struct("license", "score"), F.struct("score", -F.col("_template")))
    return scored.where(F.col("score") >= threshold).groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.license", "_best.score")


def license_scan(files: DataFrame, path_col: str = "path", text_col: str = "text", templates=None, threshold: float = THRESHOLD) -> DataFrame:
    """Per file path: n_matches, own_license, own_score, license, inherited_from (a directory or null).

    A file's own license is that which its whole text matches, else that of most of its
    matching lines and paragraphs, ties going to the higher score and then the name. License files (LICENSE, COPYING, NOTICE, with any
    suffix) give theirs to their directory, ties alike; a file without one takes that
    of the nearest directory at or above its own. Directories are resolved once each,
    by an equi-join of their ancestors (the root, whose name is empty, included), so a
    directory of many files costs no more than another. Null texts are empty and null
    paths the empty path; equal rows are one file, and the texts of one path are taken
    together; an empty table gives no rows.
    """
    body = text_of(col(text_col))
    paths = files.select(F.coalesce(col(path_col), F.lit("")).alias("_path"), text_key(body).alias("_key"), body.alias("_text"))
    named = F.rlike(F.regexp_extract("_path", r"([^/]*)$", 1), F.lit(LICENSE_FILE))
    units = license_units(paths, ["_path", "_key"], "_text", named, templates, threshold)
    votes = units.groupBy("_path", "license").agg(F.max((F.col("kind") == FILE).cast("int")).alias("_whole"), F.count("*").alias("_n"), F.max("score").alias("_score"))
    pick = lambda *first: F.min_by(F.struct("license", F.col("_score").alias("score")), F.struct(*[-F.col(n) for n in first], -F.col("_score"), F.col("license")))
    own = votes.groupBy("_path").agg(pick("_whole", "_n").alias("_own"), F.sum("_n").alias("n_matches"))
    folder = F.regexp_extract("_path", r"^(.*)/[^/]*$", 1).alias("_dir")
    every = paths.select("_path").distinct().select("_path", folder).join(own, "_path", "left")
    given = every.where(named & F.col("_own").isNotNull()).select("_dir", F.col("_own.license").alias("license"), F.col("_own.score").alias("_score"))
    given = given.groupBy("_dir", "license").agg(F.count("*").alias("_n"), F.max("_score").alias("_score"))
    given = given.groupBy("_dir").agg(pick("_n").alias("_given")).select(F.col("_dir").alias("_above"), F.col("_given.license").alias("_license"))
    steps = F.split("_dir", "/", -1)
    above = F.explode(F.array_union(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))))
    heir = paths.select(folder).distinct().select("_dir", above.alias("_above")).join(given, "_above")
    heir = heir.groupBy("_dir").agg(F.max_by(F.struct("_above", "_license"), F.length("_above")).alias("_heir"))
    out = every.join(heir, "_dir", "left")
    none = F.col("_own").isNull()
    return out.select(
        F.col("_path").alias(path_col),
        F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"),
        F.col("_own.license").alias("own_license"),
        F.col("_own.score").alias("own_score"),
        F.when(none, F.col("_heir._license")).otherwise(F.col("_own.license")).alias("license"),
        F.when(none, F.col("_heir._above")).alias("inherited_from"),
    )


def document_paths(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents as files of a tree: source/lang/id.txt; of each hundred ids the first is its directory's license file, of each thousand its source's."""
    source, lang = F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none"))
    doc = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    path = (
        F.when(F.col(id_col) % 1000 == 0, F.concat(source, F.lit("/LICENSE."), doc))
        .when(F.col(id_col) % 100 == 0, F.concat(source, F.lit("/"), lang, F.lit("/LICENSE."), doc))
        .otherwise(F.concat(source, F.lit("/"), lang, F.lit("/"), doc, F.lit(".txt")))
    )
    return docs.select(F.col(id_col), path.alias("path"), F.col("text"))


def oracle_sql() -> str:
    """The query over documents in DuckDB SQL, without the leading-word filter."""
    rows, idf, unknown = template_vectors(TEMPLATES, THRESHOLD)
    vectors = ", ".join(f"({n}, '{name}', '{t}', {w!r}::DOUBLE)" for n, name, t, w, _ in rows)
    weights = ", ".join(f"('{t}', {w!r}::DOUBLE)" for t, w in idf.items())
    return rf"""
WITH vec(template, license, term, weight) AS (VALUES {vectors}), wt(term, idf) AS (VALUES {weights}),
d AS (
  SELECT doc_id, coalesce(text, '') AS t, CASE WHEN doc_id % 1000 = 0 THEN source || '/LICENSE.' || doc_id
    WHEN doc_id % 100 = 0 THEN source || '/' || lang || '/LICENSE.' || doc_id
    ELSE source || '/' || lang || '/' || doc_id || '.txt' END AS path FROM documents
), low AS (SELECT path, lower(t) AS t, path LIKE '%/LICENSE.%' AS whole FROM d),
l AS (
  SELECT path, 0 AS kind, generate_subscripts(ls, 1) AS place, unnest(ls) AS txt FROM (SELECT path, string_split(t, chr(10)) AS ls FROM low)
  UNION ALL SELECT * FROM (SELECT path, 1 AS kind, generate_subscripts(ls, 1) AS place, unnest(ls) AS txt FROM (SELECT path, string_split_regex(t, '{GAP}') AS ls FROM low)) WHERE contains(txt, chr(10))
  UNION ALL SELECT path, 2, 0, t FROM low WHERE whole
),
term AS (
  SELECT path, kind, place, term, count(*) AS n
  FROM (SELECT path, kind, place, unnest(regexp_extract_all(txt, '{TERM}')) AS term FROM l) GROUP BY ALL
), tw AS (SELECT path, kind, place, term.term, n * coalesce(idf, {unknown!r}) AS w FROM term LEFT JOIN wt ON term.term = wt.term),
norm AS (SELECT path, kind, place, sqrt(sum(w * w)) AS norm FROM tw GROUP BY ALL),
dot AS (SELECT path, kind, place, template, license, sum(w * weight) AS dot FROM tw JOIN vec ON tw.term = vec.term GROUP BY ALL),
best AS (
  SELECT path, kind, place, license, score FROM (
    SELECT path, kind, place, license, score, row_number() OVER (PARTITION BY path, kind, place ORDER BY score DESC, template) AS r
    FROM (SELECT path, kind, place, template, license, round(dot / norm, 9) AS score FROM dot JOIN norm USING (path, kind, place)) WHERE score >= {THRESHOLD}
  ) WHERE r = 1
), votes AS (SELECT path, license, max(kind = 2) AS whole, count(*) AS n, max(score) AS score FROM best GROUP BY ALL),
own AS (
  SELECT path, license, score, total FROM (
    SELECT *, sum(n) OVER (PARTITION BY path) AS total, row_number() OVER (PARTITION BY path ORDER BY whole DESC, n DESC, score DESC, license) AS r FROM votes
  ) WHERE r = 1
), f AS (
  SELECT doc_id, d.path, regexp_extract(d.path, '^(.*)/[^/]*$', 1) AS dir, license, score, total FROM d LEFT JOIN own ON d.path = own.path
), given AS (
  SELECT dir, license FROM (
    SELECT dir, license, row_number() OVER (PARTITION BY dir ORDER BY count(*) DESC, max(score) DESC, license) AS r
    FROM f WHERE license IS NOT NULL AND path LIKE '%/LICENSE.%' GROUP BY dir, license
  ) WHERE r = 1
), heir AS (
  SELECT f.doc_id, g.dir AS above, g.license, row_number() OVER (PARTITION BY f.doc_id ORDER BY length(g.dir) DESC) AS r
  FROM f JOIN given g ON g.dir = '' OR f.dir = g.dir OR starts_with(f.dir, g.dir || '/')
)
SELECT f.doc_id, coalesce(total, 0)::BIGINT AS n_matches, f.license AS own_license, f.score AS own_score,
  coalesce(f.license, heir.license) AS license, CASE WHEN f.license IS NULL THEN heir.above END AS inherited_from
FROM f LEFT JOIN heir ON f.doc_id = heir.doc_id AND heir.r = 1
"""


def scan_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """`license_scan` of the documents as files, back by id."""
    tree = document_paths(docs)
    found = license_scan(tree, "path", "text")
    return tree.select("doc_id", "path").join(found, "path").drop("path")
