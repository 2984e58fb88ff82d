"""License scans: sparse TF-IDF cosine to templates, then inheritance by path joins.

Every text is compared with short templates, whatever its lines: a template is laid
on each token that it shares, but for its commonest tokens, which alone could never
reach the threshold, and the window of as many tokens as the template has
is weighted by term frequency and by rarity over all texts and compared by cosine.
Line ends and comment marks are no tokens, so wrapped headers are seen, and prose
before and after a statement is outside its window. A file takes its best
statement. A licence file, told by its name or by a text that is mostly statement,
also covers its directory; files without a statement inherit from the nearest
directory above them that is covered. DataFrame functions only.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windowmill.llm import common

#: Licence names and typical statements.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPL-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version"),
    ("LGPL-3.0", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("AGPL-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain under the Unlicense"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("LGPL-2.1", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version"),
]
#: Names after the SPDX mark, with the licence that each stands for. Their lines must be whole.
SPDX = [
    ("MIT", "MIT"), ("Apache-2.0", "Apache-2.0"), ("GPL-3.0", "GPL-3.0-only"), ("GPL-3.0", "GPL-3.0-or-later"), ("GPL-2.0", "GPL-2.0-only"), ("GPL-2.0", "GPL-2.0-or-later"),
    ("LGPL-3.0", "LGPL-3.0-only"), ("LGPL-3.0", "LGPL-3.0-or-later"), ("AGPL-3.0", "AGPL-3.0-only"), ("AGPL-3.0", "AGPL-3.0-or-later"), ("BSD-3-Clause", "BSD-3-Clause"), ("MPL-2.0", "MPL-2.0"),
    ("CC-BY-4.0", "CC-BY-4.0"), ("CC-BY-SA-4.0", "CC-BY-SA-4.0"), ("CC-BY-NC-4.0", "CC-BY-NC-4.0"), ("ISC", "ISC"), ("Unlicense", "Unlicense"), ("EPL-2.0", "EPL-2.0"), ("BSL-1.0", "BSL-1.0"), ("CC0-1.0", "CC0-1.0"),
    ("Zlib", "Zlib"), ("BSD-2-Clause", "BSD-2-Clause"), ("LGPL-2.1", "LGPL-2.1-only"), ("LGPL-2.1", "LGPL-2.1-or-later"),
]
TEMPLATES += [(name, f"SPDX-License-Identifier: {said}") for name, said in SPDX]
FILE_NAME = r"(?i)^(un)?(licen[sc]e|copying|notice)([._-].*)?$"
#: A long statement may be worded otherwise; of one of few tokens nearly all must be there, since prose shares most.
COSINE, BRIEF_COSINE, BRIEF = 0.6, 0.85, 8
#: An SPDX line differs from another in its name alone, so it counts only if all of it is there.
WHOLE = 0.999
#: A text is a licence file if statements make up at least this share of its tokens.
MOSTLY = 0.5


_CUT = r"[^a-z0-9.]+|\.(?![0-9])"
#: A place of a template is one number: the start, which may lie before the text, and the template.
_BEFORE, _BASE = 1024, 64  # more than the templates


def least_cosine(text: str, cosine: float = COSINE) -> float:
    """The cosine that a window must reach for a template."""
    return WHOLE if text.startswith("SPDX") else max(cosine, BRIEF_COSINE) if len([t for t in re.split(_CUT, text.lower()) if t]) <= BRIEF else cosine


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _CUT), lambda t: t != "")


def _constant(value, schema: str) -> Column:
    """A nested value as one literal: the optimizer folds it, and the plan does not hold a node for each part."""
    return F.from_json(F.lit(json.dumps(value)), schema)


class _Templates:
    """The fixed list with its weights, as literals; everything here is bounded by that list.

    ``places`` are the tokens on which a template is laid: all but its commonest,
    which are left out as long as they alone can never reach the cosine. By the
    inequality of Cauchy and Schwarz a window cannot pass the share of the
    template's length that its tokens have, so nothing that could pass is lost.
    """

    def __init__(self, cosine: float):
        self.words = [[t for t in re.split(_CUT, text.lower()) if t] for _, text in TEMPLATES]
        self.known = sorted({t for w in self.words for t in w})
        self.cosine = [least_cosine(text, cosine) for _, text in TEMPLATES]

    def weigh(self, total: int, df: dict[str, int]) -> None:
        self.weights = [{t: n * _idf(total, df.get(t, 0)) for t, n in Counter(w).items()} for w in self.words]
        self.floor = [(c - 1e-5) ** 2 * sum(x * x for x in w.values()) for c, w in zip(self.cosine, self.weights, strict=True)]
        self.places: dict[str, list[tuple[int, int]]] = {}
        for k, (words, weights) in enumerate(zip(self.words, self.weights, strict=True)):
            left, common = 0.0, set()
            for t in sorted(weights, key=lambda t: (weights[t], t)):
                left += weights[t] ** 2
                if left >= self.floor[k]:
                    break
                common.add(t)
            for back, t in enumerate(words):
                if t not in common:
                    self.places.setdefault(t, []).append((k, back))

    def table(self, spark: SparkSession) -> DataFrame:
        """template, token, v: vectors of unit length."""
        rows = [(k, t, x / math.sqrt(sum(y * y for y in w.values()))) for k, w in enumerate(self.weights) for t, x in w.items()]
        return spark.createDataFrame(rows, "template int, token string, v double")

    def _enough(self) -> Callable[[Column, Column], Column]:
        """Whether these tokens hold so much of a template that a window of them may reach the cosine."""
        floors = _constant(self.floor, "array<double>")
        vectors = _constant([[{"token": t, "square": x * x} for t, x in w.items()] for w in self.weights], "array<array<struct<token: string, square: double>>>")

        def enough(template: Column, present: Column) -> Column:
            held = F.aggregate(F.get(vectors, template), F.lit(0.0), lambda a, e: a + F.when(F.array_contains(present, e.token), e.square).otherwise(0.0))
            return held >= F.get(floors, template)

        return enough

    def _shared(self, words: Column) -> Column:
        return F.array_distinct(F.filter(words, lambda t: t.isin(self.known)))

    def possible(self, words: Column) -> Column:
        """Whether the whole text holds enough of any template; of most texts no window need be looked at."""
        enough, templates = self._enough(), F.sequence(F.lit(0), F.lit(len(self.words) - 1))
        return F.exists(F.array(self._shared(words)), lambda w: F.exists(templates, lambda k: enough(k, w)))

    def windows(self, words: Column) -> Column:
        """array of (template, start, stop, said): the windows that may reach the cosine, each once.

        What lies around a token, as far as any template on it may lie, is looked up
        once for all templates; only of those that it could hold are windows cut. An array of one
        element gives a name to a value within a lambda, which is else computed at each use.
        """
        at = _constant({t: [(_BEFORE - back) * _BASE + k for k, back in found] for t, found in self.places.items()}, "map<string, array<int>>")
        sizes, widest, enough = _constant([len(w) for w in self.words], "array<int>"), max(map(len, self.words)), self._enough()
        start = lambda c: F.shiftright(c, 6) - _BEFORE
        template = lambda c: c.bitwiseAND(_BASE - 1)
        first = lambda c: F.greatest(F.lit(0), start(c))
        stop = lambda c: F.least(F.size(words), start(c) + F.get(sizes, template(c)))
        window = lambda c: F.slice(words, first(c) + 1, stop(c) - first(c))
        around = lambda i: self._shared(F.slice(words, F.greatest(F.lit(0), i - widest) + 1, F.lit(2 * widest + 1)))
        hits = F.array_compact(F.transform(words, lambda t, i: F.when(t.isin(list(self.places)), i)))
        fit = lambda i: F.flatten(F.transform(F.array(around(i)), lambda w: F.filter(F.element_at(at, F.get(words, i)), lambda c: enough(template(c), w))))
        codes = F.array_distinct(F.flatten(F.transform(hits, lambda i: F.transform(fit(i), lambda c: i * _BASE + c))))
        near = F.filter(codes, lambda c: F.exists(F.array(window(c)), lambda w: enough(template(c), w)))
        return F.transform(near, lambda c: F.struct(template(c).alias("template"), first(c).alias("start"), stop(c).alias("stop"), F.array_join(window(c), " ").alias("said")))


def _idf(total: int, df: int) -> float:
    return math.log((1 + total) / (1 + df)) + 1


def scan(files: DataFrame, id_col: str, path_col: str, text_col: str, cosine: float = COSINE) -> DataFrame:
    """One row per input row: id, path, license, score, found_by, license_path.

    found_by is statement, inherited or none. A null or empty text has no
    statement; a null path has no directory and inherits nothing; the root is above
    every path. What a statement says is not parsed: one that is denied counts as
    well. Of two licences
    of equal score the first by name counts, and of two licence files of one
    directory that of the smallest path. Equal windows are scored once, so that
    a statement which millions of files repeat costs no more than one. Repeated
    rows stay as they are; where an id is repeated, each row is judged by its own text.
    Other columns are ignored.
    """
    spark = files.sparkSession
    own = files.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    words = own.select("id", "path", "text_key", F.explode(F.array(tokens(F.col("text")))).alias("words")).filter(F.size("words") > 0)
    rarity = common.materialize(words.select(F.explode(F.array_distinct("words")).alias("token")).groupBy("token").agg(F.count("*").alias("df")), "license-rarity")
    total = own.filter("text is not null").count()
    fixed = _Templates(cosine)
    fixed.weigh(total, {r.token: r.df for r in rarity.filter(F.col("token").isin(fixed.known)).collect()})  # tokens of a fixed list

    found = words.filter(fixed.possible(F.col("words"))).select("id", "path", "text_key", F.size("words").alias("size"), F.explode(fixed.windows(F.col("words"))).alias("w"))
    marked = common.materialize(found.select("id", "path", "text_key", "size", "w.*"), "license-statements")
    counts = marked.select("template", "said").distinct().select("template", "said", F.explode(F.split("said", " ")).alias("token")).groupBy("template", "said", "token").agg(F.count("*").alias("tf"))
    idf = F.log((1 + F.lit(total)) / (1 + F.col("df"))) + 1
    weighed = counts.join(rarity, "token").select("template", "said", "token", (F.col("tf") * idf).alias("w"))
    weighed = weighed.join(F.broadcast(fixed.table(spark)), ["template", "token"], "left")  # a fixed list
    near = weighed.groupBy("template", "said").agg(F.round(F.sum(F.col("w") * F.coalesce("v", F.lit(0.0))) / F.sqrt(F.sum(F.col("w") * F.col("w"))), 6).alias("score"))
    license = F.get(F.array(*[F.lit(name) for name, _ in TEMPLATES]), F.col("template"))
    least = F.get(F.array(*[F.lit(c) for c in fixed.cosine]), F.col("template"))
    near = near.filter(F.col("score") >= least).select("template", "said", license.alias("license"), "score")
    spans = F.array_sort(F.collect_set(F.struct("start", "stop")))
    said_size = F.aggregate(  # tokens in any statement
        spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.struct((a.n + F.greatest(F.lit(0), x.stop - F.greatest(x.start, a.end))).alias("n"), F.greatest(a.end, x.stop).alias("end")), lambda a: a.n,
    )
    by_file = marked.join(near, ["template", "said"]).groupBy("id", "text_key").agg(F.min_by(F.struct("license", "score"), F.struct(-F.col("score"), F.col("license"))).alias("best"), said_size.alias("said_size"))
    direct = common.materialize(by_file.select("id", "text_key", "best.license", "best.score", "said_size"), "license-direct")

    parts = F.split("path", "/")
    folder = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    covers = marked.select("id", "path", "text_key", "size").distinct().join(direct, ["id", "text_key"]).filter(F.element_at(parts, -1).rlike(FILE_NAME) | (F.col("said_size") >= MOSTLY * F.col("size"))).filter("path is not null")
    covered = covers.groupBy(folder.alias("folder")).agg(F.min_by(F.struct("license", "score", "path"), "path").alias("cover"))
    placed = own.select("id", "path", "text_key", folder.alias("folder"))
    folders = placed.select("folder").distinct().filter("folder is not null")
    steps = F.split("folder", "/")
    above = folders.select("folder", F.explode(F.sequence(F.lit(0), F.when(F.col("folder") == "", 0).otherwise(F.size(steps)))).alias("depth"), steps.alias("steps")).select("folder", "depth", F.array_join(F.slice("steps", 1, F.col("depth")), "/").alias("above"))
    nearest = above.join(covered.withColumnRenamed("folder", "above"), "above").groupBy("folder").agg(F.max_by("cover", "depth").alias("cover"))
    out = placed.join(direct.drop("said_size"), ["id", "text_key"], "left").join(nearest, "folder", "left")
    has = F.col("license").isNotNull()
    return out.select(
        "id", "path",
        F.coalesce("license", "cover.license").alias("license"),
        F.when(has, F.col("score")).otherwise(F.col("cover.score")).alias("score"),
        F.when(has, "statement").when(F.col("cover").isNotNull(), "inherited").otherwise("none").alias("found_by"),
        F.when(has, F.col("path")).otherwise(F.col("cover.path")).alias("license_path"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op7: licences of all documents, as files of a tree of sources, languages and hundreds of ids."""
    docs = common.table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 100).cast("string"), F.col("doc_id").cast("string"))
    return scan(docs.withColumn("path", path), "doc_id", "path", "text").withColumnRenamed("id", "doc_id")
