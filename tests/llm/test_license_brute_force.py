"""The licence scan against a plain version that lays every template on every token that it shares but its commonest."""

import math
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from windowmill.llm import license_scan as ls


def tokens(text):
    return [t for t in re.split(ls._CUT, (text or "").lower()) if t]


def brute(files):
    texts = {i: tokens(t) for i, _, t in files}
    total, df = sum(t is not None for *_, t in files), Counter(t for w in texts.values() for t in set(w))
    weigh = lambda words: {t: n * (math.log((1 + total) / (1 + df.get(t, 0))) + 1) for t, n in Counter(words).items()}
    length = lambda w: math.sqrt(sum(x * x for x in w.values()))
    templates = [(name, tokens(text), weigh(tokens(text)), ls.least_cosine(text)) for name, text in ls.TEMPLATES]
    best, covered = {}, {}
    for i, path, _ in files:
        words, found, spans = texts[i], [], set()
        for name, template, weights, least in templates:
            rare, passed = set(weights), 0.0
            for t in sorted(weights, key=lambda t: (weights[t], t)):  # the commonest, which alone cannot reach the cosine
                passed += weights[t] ** 2
                if passed >= (least - 1e-5) ** 2 * length(weights) ** 2:
                    break
                rare.discard(t)
            for start in {i - back for i, w in enumerate(words) for back, t in enumerate(template) if t == w and t in rare}:
                a, b = max(0, start), min(len(words), start + len(template))
                said = weigh(words[a:b])
                score = round(sum(x * weights.get(t, 0) for t, x in said.items()) / length(said) / length(weights), 6)
                if score >= least:
                    found.append((-score, name))
                    spans.update(range(a, b))
        if found:
            best[i] = min(found)
            if path is not None and (re.search(ls.FILE_NAME, path.split("/")[-1]) or len(spans) >= ls.MOSTLY * len(words)):
                folder = path.rpartition("/")[0]
                covered[folder] = min(covered.get(folder, (path, best[i])), (path, best[i]))
    out = {}
    for i, path, _ in files:
        if i in best:
            out[i] = (best[i][1], -best[i][0], "statement", path)
            continue
        out[i] = (None, None, "none", None)
        if path is not None:
            steps = path.split("/")[:-1]
            for k in range(len(steps), -1, -1):
                if "/".join(steps[:k]) in covered:
                    at, (score, name) = covered["/".join(steps[:k])]
                    out[i] = (name, -score, "inherited", at)
                    break
    return out


LINES = ["Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: EUPL-1.2", "under a public licence of the free kind", "software is hereby granted"]
PROSE = "the river ran down from the hills to the town of stone and nobody said a word about the water".split()


def test_scan_equals_brute_force(spark):
    files = [(0, "LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"), (1, "top.py", "x = 1"), (2, "src/a/b.py", None), (3, None, ""), (4, "src/COPYING.md", LINES[1]), (5, "src/c/d.py", "y")]
    for k in range(30):
        said = " ".join(PROSE[(k * 7 + j) % len(PROSE)] for j in range(10 + k))
        files.append((10 + k, f"{'pqr'[k % 3]}/{k % 5}/f{k}.txt", said + ("\n# " + LINES[k % 6] + "\n" + said if k % 4 else "")))
    files += [(99, "z/very/long.txt", " ".join(PROSE * 300) + LINES[0] + " " + " ".join(PROSE * 300)), (50, "p/0/LICENSE", LINES[0]), (51, "p/0/COPYING", LINES[1])]
    given = spark.createDataFrame(files, "id long, path string, text string").withColumns({c: F.lit("clash") for c in ("license", "folder", "said", "token", "template", "depth")})
    found = {r.id: (r.license, r.score, r.found_by, r.license_path) for r in ls.scan(given, "id", "path", "text").collect()}
    want = brute(files)
    assert {i: (x[0], x[2], x[3]) for i, x in found.items()} == {i: (x[0], x[2], x[3]) for i, x in want.items()}
    assert all(x[1] is None or abs(x[1] - want[i][1]) < 2e-6 for i, x in found.items())
    assert found[1][:1] + found[1][2:] == ("MIT", "inherited", "LICENSE") and found[2][0] == "GPL-2.0"


def test_spdx_lines_name_their_own_licence(spark):
    files = [(k, f"{k}/a.c", f"// SPDX-License-Identifier: {said}\nint main;") for k, (_, said) in enumerate(ls.SPDX)] + [(90, "q/a.c", "// SPDX-License-Identifier: EUPL-1.2")] * 2
    found = defaultdict(set)
    for r in ls.scan(spark.createDataFrame(files, "id long, path string, text string"), "id", "path", "text").collect():
        found[r.id].add(r.license)
    assert found == {k: {name} for k, (name, _) in enumerate(ls.SPDX)} | {90: {None}}


HEADERS = {
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/": "EPL-2.0",
    "Distributed under the Boost Software License, Version 1.0. (See accompanying file or copy at the address)": "BSL-1.0",
    "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.": "CC0-1.0",
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.": "Zlib",
    "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.": "LGPL-2.1",
    "// SPDX-License-Identifier: BSD-2-Clause": "BSD-2-Clause",
    "The report was released under the embargo of the ministry and gives the bearer a license to drive.": None,
    "The papers were released under the license of the court.": None,
    "The meeting was held under the terms of the agreement and the general public was not there.": None,
}


def test_headers_and_prose(spark):
    files = [(k, f"{k}/a.c", f"{' '.join(PROSE)} {text} {' '.join(PROSE)}") for k, text in enumerate(HEADERS)] + [(100 + k, f"n{k}/b", " ".join(PROSE[k:] + PROSE[:k])) for k in range(20)]
    found = {r.id: r.license for r in ls.scan(spark.createDataFrame(files, "id long, path string, text string"), "id", "path", "text").collect()}
    assert {text: found[k] for k, text in enumerate(HEADERS)} == HEADERS


def test_rows_of_one_id_are_judged_apart(spark):
    files = [(1, "a/x", LINES[0]), (1, "b/y", "plain text without any"), (2, "c/z", LINES[0]), (2, "c/z", LINES[0])]
    found = sorted((r.id, r.path, r.license or "", r.found_by) for r in ls.scan(spark.createDataFrame(files, "id long, path string, text string"), "id", "path", "text").collect())
    assert found == [(1, "a/x", "Apache-2.0", "statement"), (1, "b/y", "", "none"), (2, "c/z", "Apache-2.0", "statement"), (2, "c/z", "Apache-2.0", "statement")]


def test_ties(spark):
    files = [(1, "a/LICENSE", LINES[0]), (2, "a/COPYING", LINES[1]), (3, "a/b/c", "plain"), (4, "d", f"{LINES[1]} {LINES[0]}")]
    found = {r.id: (r.license, r.license_path) for r in ls.scan(spark.createDataFrame(files, "id long, path string, text string"), "id", "path", "text").collect()}
    assert found[3] == ("GPL-2.0", "a/COPYING") and found[4][0] == "Apache-2.0"  # of equal scores the first by name, of two files the smallest path
