"""Checks and merges of stored evidence: recovery pages, members, pools, reasons, merges of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windowmill.operators.replay import KEY


def same_reasons(expected: Column, given: Column) -> Column:
    """Do two lists hold the same reasons, and the given one each but once?"""
    once = F.size(F.array_distinct(given)) == F.size(given)
    return F.coalesce(once & (F.size(F.array_except(expected, given)) == 0) & (F.size(F.array_except(given, expected)) == 0), F.lit(False))


def duplicate_members(member: DataFrame) -> DataFrame:
    """mint, opened_ms, key and copies of observations that a window holds more than once."""
    return member.groupBy("mint", "opened_ms", *KEY).agg(F.count("*").alias("copies")).filter("copies > 1")


def admitted(member: DataFrame) -> DataFrame:
    """Each window's observations once, with the earliest time at which one was admitted."""
    return member.groupBy("mint", "opened_ms", "event_id").agg(F.min("admitted_ms").alias("admitted_ms"))


def count_guard(submitted: DataFrame, member: DataFrame) -> DataFrame:
    """Windows whose evidence count is not that of their stored members: mint, opened_ms, submitted, stored."""
    stored = member.groupBy("mint", "opened_ms").agg(F.count("*").alias("stored"))
    out = submitted.join(stored, ["mint", "opened_ms"], "full").select("mint", "opened_ms", "submitted", F.coalesce("stored", F.lit(0)).alias("stored"))
    return out.filter(~F.col("submitted").eqNullSafe(F.col("stored")))


def pools(rows: DataFrame) -> DataFrame:
    """Per pool: the mints that came first, the newest slot and signature of rows that agree with them, and how many do not.

    A later row of an equal slot replaces, so ties go by arrival. A row of other mints is
    reported and changes nothing; a pool of two equal mints, or of a NULL, has no identity.
    """
    mints, at = F.struct("base_mint", "quote_mint"), F.struct("observed_slot", "arrival")
    named = rows.withColumn("_mints", F.when(F.col("base_mint") != F.col("quote_mint"), mints))
    first = named.filter("_mints is not null").groupBy("network", "pool").agg(F.min_by("_mints", "arrival").alias("_first"))
    found = named.join(first, ["network", "pool"], "left").withColumn("_same", F.coalesce(F.col("_mints") == F.col("_first"), F.lit(False)))
    newest = F.max_by(F.when(F.col("_same"), F.struct("observed_slot", "observed_signature")), F.when(F.col("_same"), at))
    out = found.groupBy("network", "pool").agg(F.max("_first").alias("_first"), newest.alias("_at"), F.count_if(~F.col("_same")).alias("conflicts"))
    return out.select("network", "pool", F.col("_first.base_mint").alias("base_mint"), F.col("_first.quote_mint").alias("quote_mint"), F.col("_at.observed_slot").alias("observed_slot"), F.col("_at.observed_signature").alias("observed_signature"), "conflicts")


def page_faults(pages: DataFrame, limit: int) -> DataFrame:
    """page, fault of signature pages that are too long, repeat a signature or rise in slot; ``position`` is newest first."""
    order = Window.partitionBy("page").orderBy("position")
    rising = pages.withColumn("_rises", F.col("slot") > F.lag("slot").over(order))
    found = rising.groupBy("page").agg(F.count("*").alias("n"), F.count_distinct("signature").alias("d"), F.bool_or(F.coalesce("_rises", F.lit(False))).alias("r"))
    fault = F.when(F.col("n") > limit, "OVERSIZE").when(F.col("d") < F.col("n"), "DUPLICATE_SIGNATURE").when(F.col("r"), "RISING_SLOT")
    return found.select("page", fault.alias("fault")).filter("fault is not null")


def recovered(records: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """What came after each source's checkpoint, oldest first, with recovery_error instead of a part of it.

    ``records`` has source, signature, slot and position (0 is the newest). The
    checkpoint's signature must be among them with an equal slot; else the one row of the
    source says CHECKPOINT_NOT_FOUND or CHECKPOINT_SLOT_MISMATCH, and nothing is released.
    """
    mark = records.join(checkpoints.select("source", F.col("last_signature").alias("signature"), "last_slot"), ["source", "signature"])
    mark = mark.groupBy("source").agg(F.min("position").alias("_until"), F.bool_or(F.col("slot") != F.col("last_slot")).alias("_off"))
    state = checkpoints.select("source").join(mark, "source", "left")
    error = F.when(F.col("_until").isNull(), "CHECKPOINT_NOT_FOUND").when(F.col("_off"), "CHECKPOINT_SLOT_MISMATCH")
    state = state.select("source", "_until", error.alias("recovery_error"))
    failed = state.filter("recovery_error is not null").select("source", F.lit(None).cast("string").alias("signature"), F.lit(None).cast("long").alias("slot"), F.lit(None).cast("long").alias("step"), "recovery_error")
    good = records.join(state.filter("recovery_error is null"), "source").filter("position < _until")
    return good.select("source", "signature", "slot", (F.col("_until") - 1 - F.col("position")).cast("long").alias("step"), "recovery_error").unionByName(failed)


def finalization_conflicts(evaluations: DataFrame) -> DataFrame:
    """mint, opened_ms of windows that were finalized twice with different evidence; the time of evaluation may differ."""
    found = evaluations.groupBy("mint", "opened_ms").agg(F.min(F.xxhash64("decision", "reasons", "evidence")).alias("low"), F.max(F.xxhash64("decision", "reasons", "evidence")).alias("high"), F.count("*").alias("copies"))
    return found.filter("low <> high").select("mint", "opened_ms", "copies")
