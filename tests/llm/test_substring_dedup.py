"""Repeated passages against a plain version."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from windowmill.llm import substring_dedup

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(docs, width=13):
    cut = [(i, WORD.findall(t or "")) for i, t in docs]
    least = {}
    for i, w in cut:
        for s in range(len(w) - width + 1):
            if i is not None:
                key = tuple(w[s : s + width])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, w in cut:
        gone = {s + k for s in range(len(w) - width + 1) if i is not None and least[tuple(w[s : s + width])] < i for k in range(width)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("key", "packed", "start", "windows", "hits", "text_key", "high", "n")})


def result(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=repr)


def corpus(seed=5):
    pick = random.Random(seed)
    text = lambda n, words=60: [f"v{pick.randrange(words)}" for _ in range(n)]
    passage, hot = text(40), text(90)
    docs = [(k, text(pick.randrange(5, 120))) for k in range(80)]
    docs += [(100 + k, text(20) + passage[k % 5 :] + text(15)) for k in range(30)]  # a passage in many contexts
    docs += [(200 + k, text(k) + hot + text(9)) for k in range(60)]
    docs += [(300, ["again"] * 500), (299, ["again"] * 14), (301, ["a", "b"] * 90)]
    return [(i, "\n \t"[i % 3].join(w)) for i, w in docs]


ODD = [
    (1, None), (2, ""), (3, " \t\r\n\x0b\x0c "), (4, "twelve " * 12), (4, "twelve " * 13), (4, "twelve " * 14), (9, "twelve " * 13), (None, "twelve " * 20), (5, "é漢 " * 30 + " x y"),
    (6, "é漢 " * 30), (7, "Case case " * 10), (8, "case Case " * 10), (10, "x" * 300_000 + " " + "long " * 60_000), (11, "long " * 20), (11, "long " * 20),
]


def test_equals_plain_version(spark):
    docs = corpus()
    assert result(substring_dedup.substring_dedup(frame(spark, docs).repartition(5))) == plain(docs)


def every_minimiser(texts, width):
    cut = [substring_dedup._strings(r.text.encode() + b" ", width) for r in texts.select("text").collect() if r.text]
    return np.unique(np.concatenate([s[3] for s in cut if s]).view(np.int64))


def test_equals_plain_version_where_every_minimiser_is_hot_or_none(spark, monkeypatch):
    docs = corpus(6)
    for hot in (every_minimiser, lambda texts, width: np.empty(0, np.int64)):
        monkeypatch.setattr(substring_dedup, "_hot", hot)
        assert result(substring_dedup.substring_dedup(frame(spark, docs))) == plain(docs)


def test_common_passages_are_found_hot(spark):
    texts = frame(spark, [(k, " ".join([f"u{k}-{j}" for j in range(30)] + [f"p{j}" for j in range(60)])) for k in range(200)])
    assert 0 < len(substring_dedup._hot(texts, 13)) <= 16


def test_odd_rows(spark):
    assert result(substring_dedup.substring_dedup(frame(spark, ODD))) == plain(ODD)
    assert substring_dedup.substring_dedup(frame(spark, [])).count() == 0


@pytest.mark.parametrize("width", [1, 2, 5])
def test_other_widths(spark, width):
    docs = corpus(7)[:60]
    assert result(substring_dedup.substring_dedup(frame(spark, docs), width)) == plain(docs, width)


def test_words_of_a_long_text_are_cut_alike(monkeypatch):
    raw = np.frombuffer(("wörd " * 5000 + "y" * 9000 + " end").encode(), np.uint8)
    whole = substring_dedup._words(raw, 2)
    monkeypatch.setattr(substring_dedup, "_CHUNK", 100)
    parts = substring_dedup._words(raw, 2)
    assert all((a == b).all() for a, b in zip([*whole[:2], *whole[2]], [*parts[:2], *parts[2]], strict=True))


def test_sample_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert result(substring_dedup.substring_dedup(docs)) == plain([(r.doc_id, r.text) for r in docs.collect()])
