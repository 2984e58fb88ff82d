"""The pipeline, stage by stage, against plain versions of what each stage decides."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_llm import brute_components, brute_contamination, check_packing
from windowmill.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "this is a plain sentence about the life of a small town by the river and of the people who lived in it for many years".split()


def prose(seed, n=60):
    return " ".join(PROSE[(seed * 7 + k * (seed % 5 + 1)) % len(PROSE)] + ("" if k % 9 else f" name{seed}x{k}") for k in range(n))


def rows(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in df.collect())


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_every_stage_equals_a_plain_version(spark, size):
    folder = f"/root/testdata/{size}"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "n-gram join", "decontamination", "best-fit packing"]

    accepted = stages["quality classifier"](spark, docs, folder).cache()
    score = {r.doc_id: r.score for r in quality.query(spark, folder).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert accepted.columns == docs.columns and rows(accepted) == sorted((i, t or "") for i, t in texts.items() if score[i] >= 0.3) and accepted.count() < docs.count()

    kept = stages["n-gram join"](spark, accepted, folder).cache()
    groups = brute_components([(i, t) for i, t in rows(accepted)])
    assert kept.columns == docs.columns and rows(kept) == [(i, t) for i, t in rows(accepted) if groups[i][1] == i] and kept.count() < accepted.count()

    clean = stages["decontamination"](spark, kept, folder).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    hit = brute_contamination(rows(kept), items)
    assert clean.columns == docs.columns and rows(clean) == [(i, t) for i, t in rows(kept) if not hit[i][-1]] and clean.count() < kept.count()

    packed = stages["best-fit packing"](spark, clean, folder).collect()
    check_packing(packed, rows(clean))
    whole = corpus_pipeline.run(spark, folder).collect()
    pieces = lambda found: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found)
    assert pieces(whole) == pieces(packed)


def test_odd_rows(spark, tmp_path):
    near = prose(3).replace("river", "stream", 1)
    given = [
        (1, None), (2, ""), (3, " \n"), (4, prose(1)), (5, prose(3)), (5, prose(3)), (5, near), (6, prose(3)), (7, prose(7)), (7, prose(8)), (8, prose(8)), (None, prose(9)), (None, prose(9)), (9, prose(2) + " " + " ".join(prose(k) for k in range(20, 520))),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in given], SCHEMA)
    docs.withColumns({c: F.lit("clash") for c in ("text_key", "group_key", "score", "words", "cluster")}).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(2, 20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    folder = str(tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert stages["quality classifier"](spark, docs, folder).columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    kept = rows(stages["n-gram join"](spark, docs, folder))
    assert [i for i, _ in kept] == [-1, -1, 1, 2, 3, 4, 5, 7, 7, 9] and sum(i == 5 for i, _ in kept) == 1
    assert [i for i, _ in rows(stages["decontamination"](spark, docs, folder))] == sorted(-1 if i is None else i for i, _ in given)
    found = corpus_pipeline.run(spark, folder).collect()
    assert sorted({-1 if r.doc_id is None else r.doc_id for r in found}) == [-1, 1, 2, 3, 4, 5, 7, 9] and len({r.sequence_id for r in found}) >= 2
    assert public_tokenizers.path("word_bpe_49k.json")


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
