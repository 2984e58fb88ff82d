"""Bounded, non-extending observation windows per market."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windowmill.functions.ordering import order_key
from windowmill.functions.text import blank
from windowmill.operators.asof import asof_position

DAY_MS = 86_400_000


def _greedy(length: int):
    """Sorted (mint, opened_ms) to the openers that start a window; constant state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mint, closes = None, 0
        for batch in batches:
            names, times, chosen = batch["mint"].to_numpy(zero_copy_only=False), batch["opened_ms"].to_numpy(), []
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if names[a] != mint:
                    mint, closes = names[a], times[a]
                while (i := a + int(np.searchsorted(times[a:b], closes, "left"))) < b:
                    chosen.append(i)
                    closes = times[i] + length
            yield batch.take(pa.array(chosen, pa.int64()))

    return run


def open_windows(openers: DataFrame, length_ms: int) -> DataFrame:
    """mint, source, asset, opened_ms, closes_ms, opener of each window.

    An opener starts [t, t + length); openers inside it are ignored; the next at or
    after its close starts another. One shuffle by market; a task reads its openers
    in order and keeps one close, so a busy market needs no memory. Openers of a null
    time or market open nothing.
    """
    found = openers.select("mint", F.col("received_ms").alias("opened_ms"), "source", "asset", F.col("signature").alias("opener"))
    found = found.filter("mint is not null and opened_ms is not null").repartition("mint").sortWithinPartitions("mint", "opened_ms", "opener")
    opened = found.mapInArrow(_greedy(length_ms), "mint string, opened_ms long, source string, asset string, opener string")
    return opened.withColumn("closes_ms", F.col("opened_ms") + length_ms)


def members(observations: DataFrame, windows: DataFrame, length_ms: int, keep: list[str]) -> DataFrame:
    """Observations inside [opened, closes) of their market's window.

    A range join by time slots of one window length: a window covers at most two,
    so each observation meets the few windows of its market and slot, and a busy
    market is spread over its slots.
    """
    slot = lambda c: F.floor(F.col(c) / length_ms)
    spread = windows.withColumn("_slot", F.explode(F.array(slot("opened_ms"), slot("opened_ms") + 1)))
    own = observations.withColumn("_slot", slot("received_ms"))
    w = spread.select("mint", "_slot", "opened_ms", "closes_ms")
    return own.join(w, ["mint", "_slot"]).filter("received_ms >= opened_ms and received_ms < closes_ms").select("mint", "opened_ms", "closes_ms", *keep)


def validated(member: DataFrame) -> DataFrame:
    """Add valid and invalid_reason: trades of a blank wallet or a zero amount stay members."""
    trade = F.col("kind") == "TRADE"
    reason = F.when(trade & blank(F.col("wallet")), "INVALID_TRADE_WALLET").when(trade & ((F.coalesce("base", F.lit(0)) <= 0) | (F.coalesce("quote", F.lit(0)) <= 0)), "INVALID_TRADE_AMOUNT")
    return member.withColumn("invalid_reason", reason).withColumn("valid", trade & reason.isNull())


def gap_reasons(windows: DataFrame, gaps: DataFrame, length_ms: int) -> DataFrame:
    """mint, opened_ms, gap_reason: the first recorded gap of the source inside a window.

    Gaps are joined by source and time slot, so that a source with many gaps and
    windows is split by time.
    """
    slot = lambda c: F.floor(F.col(c) / length_ms)
    w = windows.select("mint", "opened_ms", "closes_ms", "source", F.explode(F.array(slot("opened_ms"), slot("opened_ms") + 1)).alias("_slot"))
    g = gaps.select("source", "gap_ms", "gap_id", "reason", slot("gap_ms").alias("_slot"))
    inside = w.join(g, ["source", "_slot"]).filter("gap_ms >= opened_ms and gap_ms < closes_ms")
    return inside.groupBy("mint", "opened_ms").agg(F.min_by("reason", F.struct("gap_ms", "gap_id")).alias("gap_reason"))


def completeness(windows: DataFrame, member: DataFrame, gaps: DataFrame, length_ms: int) -> DataFrame:
    """Windows with reason: NULL if complete, else the gap's, else the first invalid trade's."""
    gapped = windows.join(gap_reasons(windows, gaps, length_ms), ["mint", "opened_ms"], "left").withColumnRenamed("gap_reason", "reason")
    return named_first(gapped, member)


def named_first(windows: DataFrame, member: DataFrame) -> DataFrame:
    """Windows with their reason, or that of their first invalid trade if they have none."""
    bad = validated(member).filter("invalid_reason is not null").groupBy("mint", "opened_ms").agg(F.min_by("invalid_reason", order_key()).alias("_trade"))
    out = windows.join(bad, ["mint", "opened_ms"], "left")
    return out.withColumn("reason", F.coalesce("reason", "_trade")).drop("_trade")


def gated(complete: DataFrame, progress: DataFrame) -> DataFrame:
    """Add finalizable: an incomplete window at once, a complete one when its source has passed the close."""
    out = complete.join(progress, "source", "left")
    return out.withColumn("finalizable", F.col("reason").isNotNull() | F.coalesce(F.col("progress_ms") >= F.col("closes_ms"), F.lit(False)))


def superseded(windows: DataFrame) -> DataFrame:
    """Add is_current: the latest (opened, opener) of its market."""
    latest = Window.partitionBy("mint")
    return windows.withColumn("is_current", F.struct("opened_ms", "opener") == F.max(F.struct("opened_ms", "opener")).over(latest))


def mismatch(source: str, window: str, fields: tuple[str, ...] = ("source", "mint", "asset")) -> Column:
    """The first field by which an observation does not belong to a window; NULL if it does.

    ``fields`` must be equal, NULL to NULL, in this order; the receipt comes last.
    """
    o, w = (lambda c: F.col(f"{source}.{c}")), (lambda c: F.col(f"{window}.{c}"))
    checks = [(c, ~o(c).eqNullSafe(w(c))) for c in fields]
    checks += [("received_before_open", o("received_ms") < w("opened_ms")), ("received_after_close", o("received_ms") >= w("closes_ms"))]
    return F.coalesce(*(F.when(wrong, name) for name, wrong in checks))


#: Fields by which a member must be its window's, in the order in which they are told.
IDENTITY = ("network", "source", "venue", "market_address", "mint", "quote_mint")


def membership_violation(source: str, window: str) -> Column:
    """Why an observation cannot be stored for a window: WINDOW_NOT_ACTIVE, or the first field that differs; NULL if it can."""
    o, w = (lambda c: F.col(f"{source}.{c}")), (lambda c: F.col(f"{window}.{c}"))
    fields = [F.when(~o(c).eqNullSafe(w(c)), c) for c in IDENTITY]
    inside = (o("received_ms") >= w("opened_ms")) & (o("received_ms") < w("closes_ms"))
    return F.coalesce(F.when(~F.coalesce(w("status") == "ACTIVE", F.lit(False)), "WINDOW_NOT_ACTIVE"), *fields, F.when(~F.coalesce(inside, F.lit(False)), "received_ms"))


def late(observations: DataFrame, windows: DataFrame) -> DataFrame:
    """Each observation against the latest window opened at or before it: an as-of join.

    Rows without an earlier window get NO_WINDOW.
    """
    w = windows.select("mint", F.col("opened_ms").alias("_at"), F.struct("source", "mint", "asset", "opened_ms", "closes_ms").alias("w"))
    own = observations.select("event_id", "source", "mint", "asset", "received_ms", F.col("received_ms").alias("_at"))
    seen = asof_position(own, w, ["mint"], ["_at"], "w", strict=False).drop("_at")
    seen = seen.withColumn("o", F.struct("source", "mint", "asset", "received_ms"))
    return seen.select("event_id", "mint", F.col("w.opened_ms").alias("opened_ms"), F.when(F.col("w").isNull(), "NO_WINDOW").otherwise(mismatch("o", "w")).alias("mismatch_field"))
