"""License scans: sparse TF-IDF cosine of notices to templates, then inheritance from the nearest licensed directory.

A notice is a line, or as many terms in a row as the template has, wherever they stand in the text and across line
breaks; a whole text that is near to a template, or whose header is near to a licence's title, is a licence file and
holds for its folder. Dot products of lines and windows are differences of running sums; the sum of their terms'
squared weights bounds their norm from below, so only those that can be near enough are counted term by term.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

#: Short notices by SPDX identifier.
TEMPLATES = [
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("Apache-2.0", "licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License; apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "released under the BSD 2-Clause License"),
    ("BSD-3-Clause", "released under the BSD 3-Clause License"),
    ("BSD-3-Clause", "redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC-BY-4.0", "licensed under CC BY 4.0"),
    ("CC-BY-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "dedicated to the public domain under CC0 1.0"),
    ("GPL-2.0", "licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "this work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("ISC", "released under the ISC License"),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "released under the MIT License"),
    ("MIT", "permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "this source code form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Proprietary", "all rights reserved"),
    ("Unlicense", "this is free and unencumbered software released into the public domain"),
]
#: How the texts of licences begin.
TITLES = [
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("ISC", "ISC License"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("MIT", "The MIT License (MIT)"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
]
#: A header is near to a title from this cosine on: it is the title, give or take a word.
TITLE_COSINE = 0.9
#: A line, window or whole text is near to a template from this cosine on.
LEAST_COSINE = 0.6
#: Terms of a text whose windows are compared at once.
BLOCK = 1 << 16
_TERM = "[a-z0-9]+(?:[.-][a-z0-9]+)*"


def _weights(texts: list[str]) -> tuple[dict[str, float], float, list[dict[str, float]]]:
    """(idf of each term of the texts, idf of any other, normalised weights of each text)."""
    terms = [Counter(re.findall(_TERM, text.lower())) for text in texts]
    df = Counter(t for c in terms for t in c)
    n = len(texts)
    idf = {t: math.log((1 + n) / (1 + k)) + 1 for t, k in df.items()}
    rows = []
    for c in terms:
        norm = math.sqrt(sum((k * idf[t]) ** 2 for t, k in c.items()))
        rows.append({t: k * idf[t] ** 2 / norm for t, k in c.items()})
    return idf, math.log(1 + n) + 1, rows


class Vectors:
    """The TF-IDF vectors of some named texts."""

    def __init__(self, named: list[tuple[str, str]]):
        idf, other, rows = _weights([text for _, text in named])
        self.place = {t: i for i, t in enumerate(idf)}
        self.idf = np.array([*idf.values(), other])
        self.weight = np.zeros((len(named), len(idf) + 1))
        for i, row in enumerate(rows):
            for term, w in row.items():
                self.weight[i, self.place[term]] = w
        self.size = np.array([len(re.findall(_TERM, text.lower())) for _, text in named])
        self.license = np.array([name for name, _ in named])

    def places(self, terms: list[str]) -> np.ndarray:
        return np.array([self.place.get(t, -1) for t in terms], dtype=np.int64)

    def cosines(self, terms: list[str]) -> np.ndarray:
        """The cosine of some terms to each text."""
        count = Counter(terms)
        n, at = np.array([*count.values()], dtype=float), self.places([*count])
        return np.round(self.weight[:, at] @ n / math.sqrt(((n * self.idf[at]) ** 2).sum()), 9)


class Scanner:
    """The best template of a text over its lines and its windows, and whether the text is a licence file."""

    def __init__(self):
        self.templates, self.titles = Vectors(TEMPLATES), Vectors(TITLES)
        self.term = re.compile(_TERM)

    def best(self, text: str) -> tuple[float, int] | None:
        """(cosine, minus the template's number) of the nearest template, the first of equals, if near enough."""
        v, found = self.templates, (0.0, 0)
        terms = self.term.findall(text.lower())
        if not terms:
            return None
        # lines, as runs of terms: the first term of each line that has any
        counts = np.cumsum([0] + [len(self.term.findall(line)) for line in text.lower().split("\n")])
        lines = np.unique(counts)
        longest = int(v.size.max())
        for block in range(0, len(terms), BLOCK):
            at = v.places(terms[block : block + BLOCK + longest - 1])
            known = np.flatnonzero(at >= 0)
            if not len(known):
                continue
            dot = np.concatenate((np.zeros((len(TEMPLATES), 1)), np.cumsum(v.weight[:, at], 1)), 1)
            square = np.concatenate(([0.0], np.cumsum(v.idf[at] ** 2)))
            for size in np.unique(np.minimum(v.size, len(at))).tolist():
                mine = np.flatnonzero(np.minimum(v.size, len(at)) == size)
                bound = (dot[mine, size:] - dot[mine, :-size]).max(0) / np.sqrt(square[size:] - square[:-size])
                for w in np.flatnonzero(bound >= LEAST_COSINE - 1e-6).tolist():
                    c = v.cosines(terms[block + w : block + w + size])
                    i = int(mine[c[mine].argmax()])
                    # words that two licences share tell neither
                    if c[i] >= LEAST_COSINE and c[i] > c[v.license != v.license[i]].max():
                        found = max(found, (float(c[i]), -i))
        for a, b in zip(lines[:-1].tolist(), lines[1:].tolist()):
            at = v.places(terms[a:b]) if b - a <= BLOCK else np.empty(0, np.int64)  # a longer line has windows enough
            if (at >= 0).any() and v.weight[:, at].sum(1).max() / math.sqrt((v.idf[at] ** 2).sum()) >= LEAST_COSINE - 1e-6:
                c = v.cosines(terms[a:b])
                i = int(c.argmax())
                found = max(found, (float(c[i]), -i))
        return found if found[0] >= LEAST_COSINE else None

    def whole(self, text: str) -> str | None:
        """The licence that the whole text states: by its cosine to a template, or its header's to a title."""
        terms = self.term.findall(text.lower())
        if not terms:
            return None
        c = self.templates.cosines(terms)
        i = int(c.argmax())
        if c[i] >= LEAST_COSINE:
            return str(self.templates.license[i])
        # as with windows, the exact cosine is counted only where its bound suffices
        head = self.titles.places(terms[: int(self.titles.size.max())])
        ends = np.minimum(self.titles.size, len(head)) - 1
        dot, square = np.cumsum(self.titles.weight[:, head], 1), np.cumsum(self.titles.idf[head] ** 2)
        near = np.flatnonzero(dot[np.arange(len(ends)), ends] >= (TITLE_COSINE - 1e-6) * np.sqrt(square[ends]))
        top, back = max([(self.titles.cosines(terms[: self.titles.size[j]])[j], -j) for j in near.tolist()], default=(0, 0))
        return str(self.titles.license[-back]) if top >= TITLE_COSINE else None


def notices(files: DataFrame) -> DataFrame:
    """(path, license, cosine, grants) of files with a notice: the best template over all lines and windows of the text.

    ``grants`` tells that the whole text is a licence file; its licence is then the one it states.
    """

    def run(batches):
        scanner = Scanner()
        for batch in batches:
            rows = []
            for p, t in zip(batch["path"], batch["text"]):
                best, stated = (scanner.best(t), scanner.whole(t)) if t else (None, None)
                if stated:
                    rows.append((p, best[0] if best else 1.0, best[1] if best else 0, stated, True))
                elif best:
                    rows.append((p, best[0], best[1], TEMPLATES[-best[1]][0], False))
            if rows:
                yield pd.DataFrame(rows, columns=["path", "cosine", "back", "license", "grants"])

    found = files.select("path", "text").mapInPandas(run, "path string, cosine double, back int, license string, grants boolean")
    best = found.groupBy("path").agg(F.max(F.struct("grants", "cosine", "back", "license")).alias("b"))
    return best.select("path", F.col("b.license").alias("license"), F.col("b.cosine").alias("cosine"), F.col("b.grants").alias("grants"))


def scan(files: DataFrame, is_licence_file: Column | None = None) -> DataFrame:
    """(path, license, cosine, origin) of every distinct path: its own notice, else its nearest licensed ancestor's.

    ``files`` has path ("a/b/c.txt") and text. A licence file's notice holds for its folder and all below (of several in
    a folder the nearest to its template, then the smallest path): a file whose whole text states a licence, or that
    ``is_licence_file`` marks, which may read path and text. ``origin`` is the folder inherited from, null for an own
    notice; files without either have a null license. Null texts have no notice; of repeated paths any text counts; rows
    without path are left out; empty tables give no rows; other columns are not read.
    """
    rows = files.where(F.col("path").isNotNull()).select("path", "text", F.coalesce(F.lit(False) if is_licence_file is None else is_licence_file, F.lit(False)).alias("licence"))
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    paths = rows.groupBy("path").agg(F.max("licence").alias("licence")).withColumn("folder", folder)
    known = paths.join(notices(rows), "path", "left").withColumn("licence", F.col("licence") | F.coalesce("grants", F.lit(False)))
    known = materialise(known.drop("grants"), "notices")
    licensed = known.where(F.col("licence") & F.col("license").isNotNull())
    # the first by cosine and then by path, combined before the shuffle
    best = licensed.groupBy("folder").agg(F.min(F.struct((-F.col("cosine")).alias("far"), "path", "license")).alias("b"))
    granted = best.select(F.col("folder").alias("origin"), F.col("b.license").alias("granted"), (-F.col("b.far")).alias("granted_cosine"))
    # each distinct folder with itself and all above, joined by equal paths; the deepest licensed one wins
    steps = F.split("folder", "/")
    above = known.select("folder").distinct().select("folder", F.explode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/")))).alias("origin")).distinct()
    nearest = above.join(granted, "origin").groupBy("folder").agg(F.max(F.struct(F.length("origin").alias("depth"), "origin", "granted", "granted_cosine")).alias("g"))
    out = known.join(materialise(nearest, "nearest"), "folder", "left")
    inherits = F.col("license").isNull()
    return out.select("path", F.coalesce("license", "g.granted").alias("license"), F.coalesce("cosine", "g.granted_cosine").alias("cosine"), F.when(inherits, F.col("g.origin")).alias("origin"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, license, cosine, origin) of every document, as a file source/thousand/doc_id.txt.

    A repeated document is returned as often; one without doc_id has no path and no licence.
    """
    thousand = F.floor(F.col("doc_id") / 1000).cast("string")
    path = F.when(F.col("doc_id").isNotNull(), F.concat_ws("/", "source", thousand, F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), path.alias("path"), "text")
    found = materialise(scan(docs), "licenses")
    return docs.select("doc_id", "path").join(found, "path", "left").select("doc_id", "path", "license", "cosine", "origin")
