"""Licence scan: TF-IDF cosine against notice templates, then inheritance from directories.

Every line and every paragraph of a whole text without its comment marks, a short text as a whole, and
every run of words as long as a template in texts of several lines or many words, is compared with the
templates as a sparse TF-IDF vector. Document frequencies of the template words are counted over the
whole corpus; any other word has the weight of a word seen once. Files without a notice of their own
take the licence of the nearest directory above them that has a licence file, by joining the ancestors
of their directory with the directories that have one.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .common import in_arrow, query, store, table

# fixed values: short notices of public licences
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
            "to deal in the Software without restriction",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
            "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
            "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
            "substantial portions of the Software.",
            "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
            "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
            "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
            "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); "
                   "you may not use this file except in compliance with the License.", "Released under the Apache License 2.0."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Released under the GNU GPL version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
                "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "Released under the GNU GPL version 2.",
                "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
                "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
                "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
                "version 2 as published by the Free Software Foundation."],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
                     "conditions are met", "Released under the BSD 3-Clause License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

# the identifier line of every licence; the two versions of the GPL have names with and without later versions
for _name, _texts in TEMPLATES.items():
    _texts += [f"SPDX-License-Identifier: {_name}{_end}" for _end in (("-only", "-or-later") if "GPL" in _name else ("",))]

THRESHOLD, LICENCE_SHARE, LEAST_RUN = 0.7, 0.5, 3
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
_PARAGRAPH = re.compile(r"\n\s*\n")
_MARK = re.compile(r"(?m)^[ \t]*(?:/\*+|\*+/|\*+|//+|#+|;+|--+|<!--|\(\*|%+|\"\"\")[ \t]*|[ \t]*(?:\*+/|-->|\*\))[ \t]*$")


def terms(text: str) -> Counter:
    return Counter(_WORD.findall(text.lower()))


class Scanner:
    """Cosine of texts with the templates for given document frequencies."""

    def __init__(self, templates: dict[str, list[str]], df: dict[str, int], documents: int, threshold: float):
        self.threshold, self.other = threshold, self._idf(1, documents) ** 2
        self.idf = {t: self._idf(n, documents) for t, n in df.items()}
        self.vectors = []
        for name, texts in sorted(templates.items()):
            for text in texts:
                v = {t: n * self.idf[t] for t, n in terms(text).items()}
                length = math.sqrt(sum(x * x for x in v.values()))
                self.vectors.append((name, {t: x / length for t, x in v.items()}))
        # a text without any of these words stays below the threshold with every template, by Cauchy-Schwarz
        needed = set()
        for _, v in self.vectors:
            rest = 1.0
            for t in sorted(v, key=lambda t: (-v[t], t)):
                if rest < threshold ** 2 - 1e-9:
                    break
                needed.add(t)
                rest -= v[t] ** 2
        self.finder = re.compile(r"(?<![^\W_])(?:" + "|".join(map(re.escape, sorted(needed, key=lambda t: (-len(t), t)))) + r")(?![^\W_])")
        self.postings: dict[str, list[tuple[int, float]]] = {}
        for k, (_, v) in enumerate(self.vectors):
            for t, x in v.items():
                self.postings.setdefault(t, []).append((k, x))
        self.column = {t: i for i, t in enumerate(self.idf)}
        weight = np.array([*self.idf.values(), math.sqrt(self.other)])
        # by template: what one word adds to the dot product; by word: the least it adds to the squared length
        self.adds = np.array([[v.get(t, 0.0) for t in self.column] + [0.0] for _, v in self.vectors]) * weight
        self.squares = weight ** 2
        self.lengths = [sum(terms(text).values()) for _, texts in sorted(templates.items()) for text in texts]

    @staticmethod
    def _idf(n: int, documents: int) -> float:
        return math.log((1 + documents) / (1 + n)) + 1

    def cosine(self, text: str) -> tuple[float, str | None]:
        """Largest cosine and its licence (ties: the first name)."""
        found, length = {}, 0.0
        for t, n in terms(text).items():
            if t in self.idf:
                x = n * self.idf[t]
                length += x * x
                for k, y in self.postings.get(t, ()):
                    found[k] = found.get(k, 0.0) + x * y
            else:
                length += n * n * self.other
        if not found:
            return 0.0, None
        best = min(found, key=lambda k: (-found[k], self.vectors[k][0]))
        return found[best] / math.sqrt(length), self.vectors[best][0]

    def windows(self, words: list[str]) -> list[tuple[float, str, int, int]]:
        """(cosine, licence, start, end) of runs of words as long as a template that reach the threshold.

        Identifier lines of fewer than ``LEAST_RUN`` words are units of their own and no runs.
        """
        at, out = np.array([self.column.get(w, -1) for w in words], dtype=np.int64), []
        square = np.r_[0.0, np.cumsum(self.squares[at])]
        for adds, length in zip(self.adds, self.lengths):
            if length > len(words) or length < LEAST_RUN:
                continue
            dot = np.r_[0.0, np.cumsum(adds[at])]
            # repeated words make a run longer than this: no run that reaches the threshold is passed over
            upper = (dot[length:] - dot[:-length]) / np.sqrt(square[length:] - square[:-length])
            for s in np.nonzero(upper >= self.threshold - 1e-9)[0].tolist():
                score, found = self.cosine(" ".join(words[s:s + length]))
                if score >= self.threshold:
                    out.append((score, found, s, s + length))
        return out

    def scan(self, text: str) -> tuple[float, str | None, bool]:
        """(cosine, licence, whether the text is a licence file) over all units of a whole text.

        A licence file has at least half of its words in one matching unit, or in all matching runs of its licence.
        """
        best, name, words = 0.0, None, 0
        if not self.finder.search(text.lower()):
            return 0.0, None, False
        text = _MARK.sub("", text)
        units = text.split("\n")
        units += [p for p in _PARAGRAPH.split(text) if "\n" in p.strip()]
        total = len(text.split())
        if "\n" in text:
            units.append(text)
        for unit in units:
            if self.finder.search(unit.lower()):
                score, found = self.cosine(unit)
                if score >= self.threshold and (score, -len(unit)) > (best, -words):
                    best, name, words = score, found, len(unit.split())
        whole = name is not None and words >= LICENCE_SHARE * total
        run = _WORD.findall(text.lower())
        covered: dict[str, np.ndarray] = {}
        for score, found, s, e in self.windows(run):
            covered.setdefault(found, np.zeros(len(run), dtype=bool))[s:e] = True
            if score > best + 1e-12:
                best, name = score, found
        if name in covered:
            whole = whole or int(covered[name].sum()) >= LICENCE_SHARE * len(run)
        return best, name, whole


def scan_licences(files: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None,
                  threshold: float = THRESHOLD) -> DataFrame:
    """Columns id, licence, score, origin ('own', 'inherited' or null), directory; one row per input row.

    A licence file is a file named like one (LICENSE, LICENCE, COPYING, NOTICE, UNLICENSE) that holds a
    notice, or any file of which the notice is at least half of the words. If a directory has several,
    the best score counts, then the first name. Null and empty texts hold no notice; a file with a null
    path inherits nothing. Repeated rows and null ids keep one row each; extra columns are not read; an
    empty table gives an empty result. Every line of every whole text is looked at.
    """
    templates = templates or TEMPLATES
    rows = files.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.encode(F.col(text_col), "UTF-8"), F.lit(b"")).alias("text"),
                        path.cast("string").alias("path"))
    known = sorted({t for texts in templates.values() for text in texts for t in terms(text)})
    wanted = frozenset(known)

    def count(batches):
        seen, n = Counter(), 0
        for b in batches:
            for text in b["text"]:
                seen.update(wanted.intersection(_WORD.findall(text.decode("utf-8", "replace").lower())))
                n += 1
        yield {"term": [None, *seen], "n": [n, *seen.values()]}

    # one row per template word, whatever the size of the corpus
    counted = {r["term"]: r["n"] for r in in_arrow(rows.select("text"), count, "term string, n long").groupBy("term").agg(
        F.sum("n").alias("n")).collect()}
    df = {t: counted.get(t, 0) for t in known}
    documents = counted.get(None, 0)

    def scan(batches):
        scanner = Scanner(templates, df, documents, threshold)
        for b in batches:
            found = [scanner.scan(t.decode("utf-8", "replace")) for t in b["text"]]
            yield {"id": b["id"], "path": b["path"], "score": [f[0] if f[1] else None for f in found], "licence": [f[1] for f in found],
                   "whole": [f[2] for f in found]}
    scanned = store(in_arrow(rows, scan, "id long, path string, score double, licence string, whole boolean").withColumns({
        "directory": F.regexp_replace("path", "/?[^/]*$", ""),
        "named": F.coalesce(F.col("path").rlike("(?i)(^|/)(un)?(licen[cs]e|copying|notice)[^/]*$"), F.lit(False))}), "licences")
    given = scanned.filter("licence is not null and directory is not null and (whole or named)").groupBy("directory").agg(
        F.min_by(F.struct("licence", "score"), F.struct(-F.col("score"), "licence")).alias("given"))
    # ancestors of distinct directories, nearest first; few files share work with many
    above = scanned.filter("licence is null and directory is not null").select("directory").distinct().withColumn(
        "parts", F.filter(F.split("directory", "/"), lambda p: p != "")).withColumn("top", F.when(F.col("directory").startswith("/"), "/").otherwise("")).select(
        "directory", F.explode(F.sequence(F.lit(0), F.size("parts"))).alias("depth"), "parts", "top").select(
        F.col("directory").alias("of"), "depth",
        F.concat("top", F.array_join(F.slice("parts", 1, F.col("depth")), "/")).alias("directory"))
    nearest = cut_lineage(above.join(given, "directory").groupBy("of").agg(
        F.max_by(F.struct("given", F.col("directory").alias("source")), "depth").alias("near")).select(
        F.col("of").alias("directory"), "near"))
    joined = scanned.join(nearest, "directory", "left")
    own = F.col("licence").isNotNull()
    return joined.select(
        "id", F.coalesce("licence", "near.given.licence").alias("licence"), F.coalesce("score", "near.given.score").alias("score"),
        F.when(own, "own").when(F.col("near").isNotNull(), "inherited").alias("origin"),
        F.when(own, F.col("directory")).otherwise(F.col("near.source")).alias("directory"))


@query("op3_license_scan")
def op3(spark, sf_dir):
    """Documents lie at <source>/<language>/<thousands of the id>/<id>.txt."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.floor(F.col("doc_id") / 1000).cast("string"),
                       F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan_licences(table(spark, sf_dir, "documents"), path).select(
        F.col("id").alias("doc_id"), "licence", F.round("score", 9).alias("score"), "origin", "directory")
