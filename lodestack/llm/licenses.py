"""Licence scans: sparse TF-IDF cosine to templates, then inheritance along directories.

Every line of a file, every run of lines between lines without words (a
header is one of these, however it is wrapped) and the file as a whole are
compared with the templates. The weight of a word is tf * idf, with
idf = ln((N + 1) / (df + 1)) + 1 over all files for the words of the templates,
and df = 0 for other words. A line or run is only weighed if it has a word outside the
light set: words so common that text made of them alone stays below the
threshold for every template, by its share of the template's norm.

Templates of two licences may be nearly equal, as those of two versions are.
A text then counts for one of them only if it has a word of it that the
other lacks; where one's words are all in the other, the cosine tells.

A file without a licence of its own takes that of the nearest directory above
it which holds a licence file: the distinct directories are joined, by path,
with those of the licence files.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .textkernel import ALNUM, U64, chunks, split

_GPL = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
_REST = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. You should have received a copy of the GNU {0} along with this program."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."

# Notices in common use, by SPDX identifier.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("AGPL-3.0", (_GPL + _REST.replace("{0}", "Affero General Public License")).format("Affero General Public License", "3")),
    ("AGPL-3.0", _GPL.format("Affero General Public License", "3")),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", _BSD),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", f"{_BSD} 3. {_BSD3}"),
    ("BSD-3-Clause", _BSD3),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("GPL-2.0", (_GPL + _REST.replace("{0}", "General Public License")).format("General Public License", "2")),
    ("GPL-2.0", _GPL.format("General Public License", "2")),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", (_GPL + _REST.replace("{0}", "General Public License")).format("General Public License", "3")),
    ("GPL-3.0", _GPL.format("General Public License", "3")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", (_GPL + _REST.replace("{0}", "Lesser General Public License")).format("Lesser General Public License", "2.1").replace("program", "library")),
    ("LGPL-2.1", _GPL.format("Lesser General Public License", "2.1").replace("program", "library")),
    ("LGPL-3.0", (_GPL + _REST.replace("{0}", "Lesser General Public License")).format("Lesser General Public License", "3").replace("program", "library")),
    ("LGPL-3.0", _GPL.format("Lesser General Public License", "3").replace("program", "library")),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("proprietary", "All rights reserved."),
)
#: Templates are near to each other if the second has this share of the first one's words.
NEAR = 0.6

LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense|notice)([.\-_][^/]*)?$"


def _hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return split(raw, np.array([0, len(raw)]), ALNUM, lower=True).hashes[0]


def needs(templates: tuple[tuple[str, str], ...]) -> list[tuple[int, tuple[str, ...]]]:
    """(template, words): a text counts for the template only if it has one of the words. From every near template of another licence, the words that it lacks."""
    words = [set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())) for _, t in templates]
    found = {(t, tuple(sorted(words[t] - words[u]))) for t in range(len(words)) for u in range(len(words)) if templates[t][0] != templates[u][0] and len(words[t] & words[u]) >= NEAR * len(words[t])}
    return sorted(x for x in found if x[1])


class Matcher:
    """Templates weighted by the document frequencies of their words."""

    def __init__(self, templates: tuple[tuple[str, str], ...], df: dict[int, int], n_files: int, threshold: float) -> None:
        self.names = [name for name, _ in templates]
        self.threshold = threshold
        self.words = np.unique(np.concatenate([_hashes(t) for _, t in templates]))
        count = np.array([df.get(int(w.view(np.int64)), 0) for w in self.words], float)
        self.idf = np.log((n_files + 1) / (count + 1)) + 1
        self.other = math.log(n_files + 1) + 1
        self.light = np.ones(len(self.words), bool)
        entries = []
        for t, (_, text) in enumerate(templates):
            at, tf = np.unique(np.searchsorted(self.words, _hashes(text)), return_counts=True)
            weight = tf * self.idf[at]
            weight /= np.sqrt((weight**2).sum())
            entries.append((at, np.full(len(at), t), weight))
            rising = np.argsort(weight, kind="stable")
            mass = np.sqrt(np.cumsum(weight[rising] ** 2))
            self.light[at[rising][mass >= threshold * 0.999]] = False
        at, template, weight = map(np.concatenate, zip(*entries, strict=True))
        order = np.argsort(at, kind="stable")
        # The templates of each word: from[word] to from[word + 1].
        self.template, self.weight = template[order], weight[order]
        self.start = np.searchsorted(at[order], np.arange(len(self.words) + 1))
        self.needs = [(t, np.searchsorted(self.words, np.concatenate([_hashes(w) for w in ws]))) for t, ws in needs(templates)]
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(self.words >> U64(48)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each word among the template words, or -1."""
        out = np.full(len(hashes), -1)
        maybe = np.flatnonzero(self.filter[(hashes >> U64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.words, hashes[maybe]), len(self.words) - 1)
        hit = self.words[at] == hashes[maybe]
        out[maybe[hit]] = at[hit]
        return out

    def cosines(self, group: np.ndarray, hashes: np.ndarray, found: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, template, cosine) of ``n`` groups of words and the templates that share a word with them and may count."""
        order = np.lexsort((hashes, group))
        g, h, f = group[order], hashes[order], found[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (h[1:] != h[:-1])
        at = np.flatnonzero(new)
        tf = np.diff(np.concatenate((at, [len(g)])))
        g, f = g[at], f[at]
        weight = tf * np.where(f >= 0, self.idf[np.maximum(f, 0)], self.other)
        norm = np.sqrt(np.bincount(g, weight**2, n))
        known = f >= 0
        g, f, weight = g[known], f[known], weight[known]
        many = self.start[f + 1] - self.start[f]
        entry = np.repeat(self.start[f] - np.cumsum(many) + many, many) + np.arange(many.sum())
        pair, at = np.unique(np.repeat(g, many) * len(self.names) + self.template[entry], return_inverse=True)
        dots = np.bincount(at, np.repeat(weight, many) * self.weight[entry], len(pair))
        group, template = pair // len(self.names), pair % len(self.names)
        counts = np.ones(len(pair), bool)
        for t, words in self.needs:
            has = np.zeros(n, bool)
            has[g[np.isin(f, words)]] = True
            counts &= (template != t) | has[group]
        return group[counts], template[counts], (dots / norm[group])[counts]

    def best(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text the best cosine, its template, and the line where its unit begins (-1: the whole text; as is where there is none)."""
        n = len(offsets) - 1
        words = split(data, offsets, ALNUM, lower=True)
        found, doc = self.find(words.hashes[0]), words.doc_of()
        breaks = np.concatenate(([0], np.cumsum(data == 10)))
        line = breaks[words.starts] + doc
        heavy = np.flatnonzero((found >= 0) & ~self.light[np.maximum(found, 0)])
        best, name, place = np.zeros(n), np.full(n, -1), np.full(n, -1)
        if len(heavy):
            # The run of a word: a new one begins with a text or after a line without words.
            fresh = np.ones(len(line), bool)
            fresh[1:] = (doc[1:] != doc[:-1]) | (line[1:] > line[:-1] + 1)
            run_of = np.cumsum(fresh)
            met = []
            for kind, unit in enumerate((line, run_of, doc)):
                units = np.unique(unit[heavy])
                take = np.flatnonzero(np.isin(unit, units))
                group = np.searchsorted(units, unit[take])
                ends = np.searchsorted(group, np.arange(len(units) + 1))
                first, last = take[ends[:-1]], take[ends[1:] - 1]
                g, t, value = self.cosines(group, words.hashes[0][take], found[take], len(units))
                keep = line[first[g]] < line[last[g]] if kind == 1 else np.ones(len(g), bool)
                g, t, value = g[keep], t[keep], value[keep]
                of = doc[first[g]]
                at = line[first[g]] - of - breaks[offsets[of]] if kind < 2 else np.full(len(g), -1)
                met.append((of, np.full(len(g), kind), at, t, value))
            of, kind, at, t, value = map(np.concatenate, zip(*met, strict=True))
            order = np.lexsort((t, at, kind, -np.round(value, 9), of))
            order = order[np.concatenate((np.ones(min(1, len(order)), bool), of[order][1:] != of[order][:-1]))]
            best[of[order]], name[of[order]], place[of[order]] = value[order], t[order], at[order]
        return best, name, place


def _template_frequencies(files: DataFrame, words: np.ndarray) -> dict[int, int]:
    def run(batches):
        for batch in batches:
            total = np.zeros(len(words), np.int64)
            for lo, hi, data, offsets in chunks(batch.column(0)):
                found = split(data, offsets, ALNUM, lower=True)
                at = np.minimum(np.searchsorted(words, found.hashes[0]), len(words) - 1)
                hit = words[at] == found.hashes[0]
                pair = np.unique(found.doc_of()[hit] * len(words) + at[hit])
                total += np.bincount(pair % len(words), minlength=len(words))
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(total)], names=["word", "n"])

    counts = files.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r.word: r.n for r in counts.collect()}  # a row for each template word


def own_licences(files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = 0.6, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, own_license, own_score, in_line`` of every file.

    The best template over the lines, the runs of lines with words, and the
    whole text, null below the threshold; ``own_score`` is that cosine (0 below the threshold),
    ``in_line`` where the first line, or else run, that reaches it begins (null: the whole text). Ties (to
    nine places) go to the template listed first. Null and empty texts have no licence.
    """
    spark = files.sparkSession
    src = scratch.columns(files, key=key, text=text)
    vocabulary = np.unique(np.concatenate([_hashes(t) for _, t in templates]))
    matcher = Matcher(templates, _template_frequencies(src, vocabulary), src.count(), threshold)
    shared = spark.sparkContext.broadcast(matcher)

    def run(batches):
        m = shared.value
        for batch in batches:
            names, scores, places = [], [], []
            for lo, hi, data, offsets in chunks(batch.column(1)):
                best, name, place = m.best(data, offsets)
                ok = best >= m.threshold
                best[~ok] = 0
                names += [m.names[k] if good else None for k, good in zip(name.tolist(), ok.tolist(), strict=True)]
                scores.append(best)
                places += [int(p) if good and p >= 0 else None for p, good in zip(place.tolist(), ok.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0)), pa.array(places, pa.int64())], names=["key", "own_license", "own_score", "in_line"])

    kind = dict(src.dtypes)["key"]
    return src.mapInArrow(run, f"key {kind}, own_license string, own_score double, in_line long")


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def inherited(files: DataFrame) -> DataFrame:
    """``files(path, own_license, ...)`` with ``license, license_from``.

    ``license_from``: null without a licence, the file's own path, or the
    directory of the licence file it comes from. Several licence files in one
    directory: the one with the least path that has a licence. Files with a
    null path inherit nothing.
    """
    rows = files.withColumn("dir", directory(F.col("path")))
    holders = rows.where(F.col("path").rlike(LICENCE_FILE) & F.col("own_license").isNotNull()).groupBy("dir").agg(F.min(F.struct("path", "own_license"))["own_license"].alias("dir_license"))
    parts = F.split("dir", "/")
    above = rows.select("dir").where("dir is not null").distinct().select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("up")))).alias("a"))
    nearest = above.select("dir", "a.depth", F.col("a.up").alias("up")).join(holders.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max(F.struct("depth", "up", "dir_license")).alias("n"))
    out = rows.join(nearest.select("dir", F.col("n.up").alias("up"), F.col("n.dir_license").alias("dir_license")), "dir", "left")
    own = F.col("own_license").isNotNull()
    return out.select(*files.columns, F.coalesce("own_license", "dir_license").alias("license"), F.when(own, F.col("path")).otherwise(F.col("up")).alias("license_from"))


def scan(files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = 0.6, path: str = "path", text: str = "text") -> DataFrame:
    """``path, own_license, own_score, in_line, license, license_from`` of every file; repeated rows stay."""
    return inherited(scratch.table(own_licences(files, templates, threshold, key=path, text=text).withColumnRenamed("key", "path")))


def example_path(doc_id: Column, source: Column) -> Column:
    """Where the query places a document: source/hundred/id.txt; each hundredth document is its folder's licence file."""
    name = F.when(doc_id % 100 == 0, F.lit("LICENSE")).otherwise(F.concat(doc_id.cast("string"), F.lit(".txt")))
    return F.concat_ws("/", F.coalesce(source, F.lit("unknown")), F.floor(doc_id / 1000).cast("string"), F.floor(doc_id / 100).cast("string"), name)




def example_id(path: Column) -> Column:
    """The document that ``example_path`` placed there."""
    return F.coalesce(F.regexp_extract(path, r"/([0-9]+)\.txt$", 1).try_cast("long"), F.regexp_extract(path, r"/([0-9]+)/LICENSE$", 1).try_cast("long") * 100)
