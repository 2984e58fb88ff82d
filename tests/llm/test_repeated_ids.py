"""Rows that repeat an id: each links, hits and is stored by its own content."""

import numpy as np
from pyspark.sql import functions as F

from windowmill.llm import decontaminate, near_vectors, ngram_join

WORDS = [f"w{k}" for k in range(60)]
A, A2, B = " ".join(WORDS), " ".join([*WORDS[:59], "other"]), " ".join(f"v{k}" for k in range(40))


def test_ngram_join_keeps_every_text_of_an_id(spark):
    for rows in ([(5, A), (5, B), (6, A2), (7, B)], [(7, B), (6, A2), (5, B), (5, A)]):
        found = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == [(5, 38, 5), (5, 58, 5), (6, 58, 5), (7, 38, 5)]
    apart = ngram_join.ngram_components(spark.createDataFrame([(4, A), (5, A), (5, B), (6, B)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in apart) == [(4, 58, 4), (5, 38, 5), (5, 58, 4), (6, 38, 5)]


def test_near_vectors_of_one_id(spark):
    rows = [(5, [1.0, 0.0, 0.0]), (5, [0.0, 1.0, 0.0]), (6, [1.0, 0.001, 0.0]), (None, [1.0, 0.0, 0.0]), (7, [1.0, 0.0])]
    odd = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("cls", "rep", "dim", "copies", "key_a", "bucket", "table", "raw")})
    found = near_vectors.near_vectors(odd).collect()
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, r.kept) for r in found) == [(-1, 0, True), (5, 0, True), (5, 1, True), (6, 1, False), (7, 0, True)]
    assert near_vectors.near_vectors(odd.filter("false")).count() == 0


def test_near_vectors_recall_at_the_threshold(spark):
    """Planted pairs at cosine 0.9501 to 0.96 among unlike vectors: at most one in 200 is missed."""
    rng = np.random.default_rng(5)
    n, dim = 1500, 32
    a, b = rng.standard_normal((n, dim)), rng.standard_normal((n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    cos = rng.uniform(0.9501, 0.96, (n, 1))
    rows = [(2 * i, v.tolist()) for i, v in enumerate(a)] + [(2 * i + 1, v.tolist()) for i, v in enumerate(cos * a + np.sqrt(1 - cos**2) * b)]
    found = {r.vec_id: r for r in near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert sum(found[2 * i].n_links >= 1 and found[2 * i + 1].n_links >= 1 for i in range(n)) >= 0.995 * n


def test_tables_follow_the_number_of_vectors():
    seen = [near_vectors.tables(n, 0.95) for n in (0, 1000, 10**6, 10**9)]
    assert [bits for _, bits in seen] == [8, 10, 20, 30]
    for count, bits in seen:
        assert (1 - (1 - np.arccos(0.95) / np.pi) ** bits) ** count <= near_vectors.MISSED


def test_decontamination_judges_each_text_of_an_id(spark):
    item = [f"t{k}" for k in range(13)]
    docs = [(5, " ".join(item)), (5, " ".join(f"z{k}" for k in range(40))), (6, None), (5, None), (None, " ".join(item)), (7, "filler " * 60_000 + " ".join(item)), (7, "filler " * 60_000 + " ".join(item))]
    odd = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("hash", "at", "start", "window", "n", "places", "item_id", "text_key")})
    found = decontaminate.contamination(odd, spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item))], "item_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in found) == [
        (0, 13, 0, 0, False), (5, 0, 0, 0, False), (5, 13, 13, 2, True), (5, 40, 0, 0, False), (6, 0, 0, 0, False), (7, 60_013, 13, 2, False), (7, 60_013, 13, 2, False),
    ]
