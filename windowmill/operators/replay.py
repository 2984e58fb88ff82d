"""Replays: keep one observation per key, or report a conflict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["network", "source", "signature", "instruction_index", "event_index"]
#: Fields that a replay may not change.
FIXED = ["slot", "mint", "asset", "kind", "side", "wallet", "creator", "base", "quote", "base_reserve", "quote_reserve", "evidence"]


def keyed(arrivals: DataFrame) -> DataFrame:
    """Per key: copies, contents and known transaction indexes, and the kept row.

    ``arrivals`` has an ``arrival`` number. The kept row is the first to arrive, with
    the earliest receipt unless it opened a window, and its own transaction index
    or else the first known. One aggregate that combines before it shuffles.
    """
    content = F.xxhash64(*FIXED)
    rest = [c for c in arrivals.columns if c not in KEY]
    found = arrivals.withColumn("content", content).groupBy(*KEY).agg(
        F.count("*").alias("copies"), F.min("content").alias("low"), F.max("content").alias("high"), F.min("transaction_index").alias("low_tx"), F.max("transaction_index").alias("high_tx"),
        F.min("received_ms").alias("earliest_ms"), F.min_by(F.struct(*rest), "arrival").alias("kept"),
    )
    conflict = (F.col("low") != F.col("high")) | F.coalesce(F.col("low_tx") != F.col("high_tx"), F.lit(False))
    return found.withColumn("conflict", conflict)


def deduplicated(arrivals: DataFrame) -> DataFrame:
    """The kept rows of keys without a conflict."""
    found = keyed(arrivals).filter("not conflict")
    rest = [c for c in arrivals.columns if c not in (*KEY, "received_ms")]
    received = F.when(F.col("kept.kind") == "CREATE", F.col("kept.received_ms")).otherwise(F.col("earliest_ms"))
    return found.select(*KEY, *(F.col(f"kept.{c}").alias(c) for c in rest), received.alias("received_ms"), "copies")


def conflicts(arrivals: DataFrame) -> DataFrame:
    """Keys whose copies differ in content or in a known transaction index."""
    found = keyed(arrivals).filter("conflict")
    return found.select(*KEY, "copies", F.when(F.col("low") != F.col("high"), "CONTENT").otherwise("TRANSACTION_INDEX").alias("conflict_kind"))
