"""The training-data operators against brute-force versions, round trips and odd rows."""

import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from windowmill.llm import catalog, components, decontaminate, html_text, license_scan, near_vectors, ngram_join, packing, piece_counts, quality, token_files, warc

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one two three four five six seven eight nine ten eleven"), (5, "one two three four five six seven eight nine ten eleven"), (5, "one two three four five six seven eight nine ten eleven"), (None, "a b c"), (7, "x" * 300_000 + " " + "word " * 50_000), (8, "Ünïcödé 漢字 \x00 \U0001f600")]


def frame(spark, rows, text="text", key="doc_id"):
    """Rows with extra columns whose names clash with the operators' own."""
    df = spark.createDataFrame(rows, f"{key} long, {text} string")
    return df.withColumns({c: F.lit("clash") for c in ("id", "cluster", "key", "mark", "node", "words", "start", "part", "score", "path", "level", "url") if c not in (key, text)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def brute_components(rows, size=3):
    sets, parent = {}, {}
    for i, t in rows:
        w = words(t)
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i in sorted(sets):
        near = {j for g in sets[i] for j in holders[g]}
        for j in near:
            both = len(sets[i] & sets[j])
            if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for g in sets[i]:
            holders[g].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_ngram_join_equals_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    base = [f"w{k}" for k in range(60)]
    docs += [(100_000 + k, " ".join(base[:k] + ["changed"] + base[k + 1 :])) for k in range(60)] + [(200_000 + k, " ".join(base)) for k in range(3)]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(frame(spark, docs)).collect()}
    assert found == brute_components(docs)


def test_ngram_join_odd_rows(spark):
    found = ngram_join.ngram_components(frame(spark, ODD)).collect()
    assert len(found) == len(ODD)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found if r.doc_id in (1, 2, 3, 4, 5)) == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 9, 4), (5, 9, 4), (5, 9, 4)]
    assert ngram_join.ngram_components(frame(spark, [])).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(50, 60), (60, 50), (7, 7), (None, 3)], "a long, b long")
    found = {r.id: r.component_id for r in components.components(edges, "a", "b").collect()}
    assert found == {k: 1 for k in range(1, 41)} | {50: 50, 60: 50}


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies on this site and you accept them</div>
<article><h1>Heading</h1><p>This is the   first paragraph of the article &amp; it has a lot of words, as it is the text that is to be kept.</p>
<p>Short one.</p></article><div id="comments"><p>This is a comment by a reader and it is not to be kept in the text of the page.</p></div><footer>Imprint</footer></body></html>"""


def test_html_text(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (None, "v", "<p>cut <b"), (4, "w", "")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    found = {r.page_id: (r.text, r.n_chars) for r in html_text.main_text(pages).collect()}
    kept = "Heading\n\nThis is the first paragraph of the article & it has a lot of words, as it is the text that is to be kept.\n\nShort one."
    assert found == {1: (kept, len(kept)), 2: ("", 0), None: ("cut", 3), 4: ("", 0)}


def test_quality_holds_out(spark):
    folder = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in quality.query(spark, folder).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [(found[i].predicted, q) for i, q in labels.items() if found[i].held_out]
    assert len(found) == spark.read.parquet(f"{folder}/documents.parquet").count() and len(held) > 40
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in found.items())
    assert sum(p == q for p, q in held) / len(held) >= 0.85


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1), (5, 0), (7, None)], "doc_id long, quality int")
    model = quality.train(frame(spark, ODD), labels)
    found = quality.score(frame(spark, ODD), model, ["doc_id"]).collect()
    assert len(found) == len(ODD) and all(0 <= r.score <= 1 for r in found)
    assert quality.score(frame(spark, []), quality.train(frame(spark, []), labels), ["doc_id"]).count() == 0


def test_quality_gradients():
    rng = np.random.default_rng(1)
    x, bag, target = rng.standard_normal((9, 4)), np.array([0, 0, 0, 1, 1, 2, 2, 2, 2]), np.array([1.0, 0.0, 1.0])
    model = quality.Model(np.zeros(4), np.ones(4))
    loss = lambda: -np.mean(np.log(np.where(target == 1, (y := model.forward(x, bag, 3)[-1]), 1 - y)))
    for p, g in zip(model.p, model.gradients(x, bag, target), strict=True):
        i = tuple(0 for _ in p.shape)
        p[i] += 1e-6
        up = loss()
        p[i] -= 2e-6
        assert g[i] == pytest.approx((up - loss()) / 2e-6, abs=1e-5)
        p[i] += 1e-6


def test_near_vectors_equal_brute_force(spark, sf_dir):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    dim = len(rows[0][1])
    rows += [(90_001, rows[0][1]), (90_002, [2 * x for x in rows[0][1]]), (90_003, None), (90_004, [0.0] * dim), (90_005, [float("nan")] * dim), (90_006, [1e300] + [0.0] * (dim - 1)), (90_007, [1e-300] + [0.0] * (dim - 1)), (90_008, [])]
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    usable = [(i, v) for i, v in rows if v and np.isfinite(v).all() and any(v)]
    unit = np.array([np.array(v) / np.abs(v).max() for _, v in usable])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    ids, near = np.array([i for i, _ in usable]), unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    root = ids.copy()
    for _ in ids:
        low = np.array([min([root[k], *root[near[k]]]) for k in range(len(ids))])
        if (low == root).all():
            break
        root = low
    expected = {i: (0, i, True) for i, _ in rows} | {int(i): (int(near[k].sum()), int(root[k]), bool(i == root[k])) for k, i in enumerate(ids)}
    assert found == expected


def brute_contamination(docs, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = defaultdict(set)
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(i)
    sizes, out = {len(w) for w in windows}, {}
    for i, t in docs:
        w, hit, found = cut(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out[i] = (len(w), len(hit), len(found), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def test_decontamination_equals_brute_force(spark):
    item = [f"t{k}" for k in range(20)]
    items = [(1, " ".join(item)), (2, "short item"), (3, None), (4, "!?"), (2, "short item"), (None, "word word")]
    docs = [(1, "x " * 50 + ", ".join(item).upper() + " y" * 300), (2, "a short item, short item"), (3, " ".join(item[:12])), (4, None), (5, "z " * 1000 + " ".join(item[3:16])), (6, " ".join(item[2:15]) + " q " + " ".join(item[2:18]))]
    odd = frame(spark, docs)
    found = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.contamination(odd, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == brute_contamination(docs, [x for x in items if x[0] is not None])
    assert decontaminate.contamination(frame(spark, []), spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(odd, spark.createDataFrame([], "item_id long, text string")).collect()} == {0}


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "u\r\nx", "<p>ä</p>"), (2, None, "<p>ä</p>"), (3, "w", None), (4, "w", ""), (5, "w", "WARC/1.1\r\n\r\nbody"), (6, "w", "y" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"order": F.lit(9), "refers": F.lit(9)})
    manifest = warc.write(pages, f"file://{tmp_path}/a", roll_bytes=300)
    found = {r.page_id: r for r in warc.read(manifest, f"file://{tmp_path}/a").collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in found.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), 6: ("response", None)}
    assert bytes(found[5].payload).decode() == rows[4][2] and found[6].payload_bytes == 200_000 and found[1].payload_bytes == 9
    again = warc.write(pages, f"file://{tmp_path}/b", roll_bytes=300)
    assert sorted(r.sha256 for r in manifest.collect()) == sorted(r.sha256 for r in again.collect()) and manifest.count() > 1
    assert warc.read(warc.write(pages.filter("false"), f"file://{tmp_path}/c"), f"file://{tmp_path}/c").count() == 0


def test_license_scan(spark):
    rows = [
        (1, "a/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software under the MIT License"), (2, "a/b/c.py", "code only"), (3, "a/b/d.py", "# Licensed under the Apache License, Version 2.0.\n" + "run(code)\n" * 20),
        (4, "z.py", None), (5, None, ""), (6, "q/LICENSE", "Licensed under the GNU General Public License, version 3"), (7, "q/r.py", "x"),
    ]
    files = spark.createDataFrame(rows, "doc_id long, p string, text string").withColumns({c: F.lit("clash") for c in ("id", "path", "said", "license", "folder", "score")})
    found = {r.id: (r.license, r.found_by, r.license_path) for r in license_scan.scan(files, "doc_id", "p", "text").collect()}
    assert found == {1: ("MIT", "statement", "a/LICENSE"), 2: ("MIT", "inherited", "a/LICENSE"), 3: ("Apache-2.0", "statement", "a/b/d.py"), 4: (None, "none", None), 5: (None, "none", None), 6: ("GPL-3.0", "statement", "q/LICENSE"), 7: ("GPL-3.0", "inherited", "q/LICENSE")}
    assert license_scan.scan(files.filter("false"), "doc_id", "p", "text").count() == 0


def library_ids(name, texts):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_token_files_equal_the_library(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    start = 0
    expected = {}
    for (i, _), ids in zip(docs, library_ids("byte_bpe_50k.json", [t or "" for _, t in docs]), strict=True):
        expected[i] = (start, len(ids) + 1, zlib.crc32(struct.pack(f"<{len(ids) + 1}I", *ids, 2)))
        start += len(ids) + 1
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.query(spark, sf_dir).collect()} == expected


@pytest.mark.parametrize("ids", [[7] * 3, list(range(5000)), [0, 2**32 - 1] * 600, [1] * 1023 + [2**31]])
def test_blocks_round_trip(ids):
    import io

    ids = np.array(ids, np.uint32)
    assert (token_files.decode_group(io.BytesIO(token_files.encode_group(ids))) == ids).all()


def test_token_files_odd_rows(spark, tmp_path):
    target = f"file://{tmp_path}/ids"
    rows = [r for r in ODD if r[0] != 7]
    manifest = token_files.write(frame(spark, rows), target, public_tokenizers.path("byte_bpe_50k.json"), 2)
    found = token_files.read(manifest, target).collect()
    assert sorted((-1 if r.id is None else r.id) for r in found) == sorted((-1 if i is None else i) for i, _ in rows)
    assert {bytes(r.ids) for r in found if r.id in (1, 2)} == {struct.pack("<I", 2)}
    empty = f"file://{tmp_path}/none"
    assert token_files.read(token_files.write(frame(spark, []), empty, public_tokenizers.path("byte_bpe_50k.json"), 2), empty).count() == 0


def test_piece_counts_equal_greedy_matching(spark, sf_dir):
    import json

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        vocab = set(json.load(f)["model"]["vocab"])
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in visible)}

    def pieces(word):
        at = n = 0
        while at < len(word):
            at = next(e for e in range(len(word), at, -1) if word[at:e] in vocab and (at == 0 or word[at] != shown[32]))
            n += 1
        return n

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + [(-1, None), (-2, " "), (-3, "Ünï漢字")]
    known = {}
    for _, t in docs:
        for w in (t or "").encode().split():
            if w not in known:
                known[w] = pieces("".join(shown[b] for b in b" " + w))
    expected = {i: (len((t or "").encode().split()), sum(known[w] for w in (t or "").encode().split())) for i, t in docs}
    assert {r.doc_id: (r.n_words, r.n_tokens) for r in piece_counts.piece_counts(frame(spark, docs), public_tokenizers.path("byte_bpe_50k.json")).collect()} == expected


def check_packing(found, docs):
    by_doc, by_sequence = defaultdict(dict), defaultdict(list)
    for r in found:
        by_doc[r.doc_id][r.piece] = r
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for i, ids in zip([i for i, _ in docs], library_ids("word_bpe_49k.json", [t or "" for _, t in docs]), strict=True):
        ids = [*ids, 0]
        assert len(by_doc[i]) == -(-len(ids) // 2048)
        for k, r in by_doc[i].items():
            part = ids[k * 2048 : (k + 1) * 2048]
            assert (r.start, r.length, r.ids_crc32) == (k * 2048, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    return len(by_sequence), sum(r.length for r in found)


def test_packing(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()] + [(-1, None), (-2, "")]
    docs += [(-3, "one <|endoftext|> two <|startoftext|>"), (-4, "a\u2003b\u2009 - c -\u2001- d\u205f")]
    sequences, ids = check_packing(packing.pack_documents(frame(spark, docs), public_tokenizers.path("word_bpe_49k.json"), 0).collect(), docs)
    assert sequences <= 1.02 * ids / 2048 + 4


def test_packing_is_the_same_from_any_order(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = ODD * 3 + [(None, None), (20, "y " * 5000)]
    pack = lambda df: packing.pack_documents(df.coalesce(1), path, 0)
    once, again = pack(frame(spark, rows)).collect(), pack(frame(spark, rows[::-1])).collect()
    assert sorted(map(repr, once)) == sorted(map(repr, again)) and sum(r.doc_id == 5 for r in once) == 6
    assert all(r.offset + r.length <= 2048 for r in once) and pack(frame(spark, [])).count() == 0


def test_token_files_order_repeated_ids_by_text(spark, tmp_path):
    rows, path = [(3, "b"), (3, "a"), (3, None), (1, "z")], public_tokenizers.path("byte_bpe_50k.json")
    found = [token_files.read(token_files.write(frame(spark, x), f"file://{tmp_path}/{k}", path, 2), f"file://{tmp_path}/{k}").collect() for k, x in enumerate((rows, rows[::-1]))]
    assert sorted((r.id, r.start, bytes(r.ids)) for r in found[0]) == sorted((r.id, r.start, bytes(r.ids)) for r in found[1])


def test_piece_counts_odd_rows(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    found = piece_counts.piece_counts(frame(spark, ODD), path).collect()
    assert len(found) == len(ODD) and {r.n_tokens for r in found if r.doc_id in (1, 2, 3)} == {0} and len({(r.n_words, r.n_tokens) for r in found if r.doc_id == 5}) == 1
    assert next(r.n_words for r in found if r.doc_id == 7) == 50_001 and piece_counts.piece_counts(frame(spark, []), path).count() == 0


def test_best_fit_is_bounded():
    bins = packing.BestFit(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 4, 9, 8, 5)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0), (4, 0)]
    assert bins.open <= 2


def test_catalog_names():
    assert [n.split("_")[0] for n in catalog.queries()] == [f"op{k}" for k in range(1, 14)]


@pytest.mark.parametrize("name", catalog.oracle_sql())
def test_query_equals_sql(spark, sf_dir, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = catalog.queries()[name](spark, sf_dir)
    found = c.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(repr(tuple(r[k] for k in sorted(columns))) for r in df.collect()) == sorted(repr(tuple(dict(zip(columns, r, strict=True))[k] for k in sorted(columns))) for r in found.fetchall())
