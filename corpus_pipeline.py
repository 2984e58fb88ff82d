"""Corpus pipeline: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windowmill.llm import common, decontaminate, ngram_join, packing, quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def accept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality.train(docs, common.table(spark, sf_dir, "labels"))
    return quality.score(docs, model, COLUMNS).filter(F.col("score") >= quality.ACCEPT).select(*COLUMNS)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Documents but those rows; a row is told by its id and its text, so that a repeated id loses only what is meant."""
    keyed = docs.select(*COLUMNS, F.xxhash64("text").alias("text_key"))
    return keyed.join(gone.select("doc_id", "text_key").distinct(), ["doc_id", "text_key"], "left_anti").select(*COLUMNS)


def dedupe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id.

    Of rows of a group that repeat this id, one of the smallest text key stays. Rows of
    a null id and texts without words belong to no group and are kept.
    """
    found = common.materialize(ngram_join.ngram_components(docs).filter("group_key is not null"), "near-copies")
    copies = found.filter("doc_id <> component_id").select("doc_id", "text_key")
    first = found.filter("doc_id = component_id")
    several = first.groupBy("group_key", "doc_id").agg(F.min("text_key").alias("text_key"), F.count("*").alias("rows")).filter("rows > 1").drop("rows")
    several = common.materialize(several, "repeated-ids")
    if several.isEmpty():
        return _without(docs, copies)
    gone = copies.unionByName(first.join(several.select("group_key"), "group_key", "left_semi").select("doc_id", "text_key"))
    keyed = docs.select(*COLUMNS, F.xxhash64("text").alias("text_key"))
    once = keyed.join(several.select("doc_id", "text_key"), ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"])
    return _without(docs, gone).unionByName(once.select(*COLUMNS))


def decontaminate_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage to the extent of the contract's rule."""
    found = decontaminate.contamination(docs, common.table(spark, sf_dir, "benchmark"))
    return _without(docs, found.filter("contaminated"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All kept documents in sequences of at most 2,048 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0)


STAGES = [("quality classifier", accept), ("n-gram join", dedupe), ("decontamination", decontaminate_), ("best-fit packing", pack)]
ORACLE_SQL = None  # learned weights, tokenizer ids and packing have no SQL form; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over documents, each written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
