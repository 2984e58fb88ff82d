"""Settings, checkpoints, coverage gaps, flow and quarantine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windowmill.operators.asof import asof, asof_position
from windowmill.operators.windows import DAY_MS, validated

#: Evidence limits: bytes of decoded evidence, characters of a code and of a detail.
EVIDENCE_BYTES, CODE_CHARS, DETAIL_CHARS = 16_384, 128, 2_048
NATIVE, STABLE = "NATIVE", "STABLE"


def settings_asof(windows: DataFrame, revisions: DataFrame) -> DataFrame:
    """Windows with the last revision in effect when they opened; NULL before the first."""
    r = revisions.select(F.col("effective_ms").alias("_at"), F.col("revision").cast("int").alias("revision")).filter("_at is not null")
    w = windows.select("mint", "opened_ms", F.col("opened_ms").alias("_at"))
    return asof_position(w, r, [], ["_at"], "revision", strict=False).select("mint", "opened_ms", "revision")


def checkpoints(positions: DataFrame) -> DataFrame:
    """Per source the last (slot, transaction_index) of a monotonic upsert in order of arrival.

    A higher slot replaces; an equal slot only where both indexes are known and
    the new one is greater, so that an unknown index stays once its slot is held.
    """
    per = positions.groupBy("source", "slot").agg(F.min_by(F.struct("transaction_index"), "arrival").alias("first"), F.max("transaction_index").alias("most"))
    per = per.select("source", "slot", F.when(F.col("first.transaction_index").isNotNull(), F.col("most")).alias("transaction_index"))
    return per.groupBy("source").agg(F.max_by(F.struct("slot", "transaction_index"), "slot").alias("at")).select("source", F.col("at.slot").alias("last_slot"), F.col("at.transaction_index").alias("last_transaction_index"))


def gap_resolution(gaps: DataFrame, creations: DataFrame) -> DataFrame:
    """Each gap with the next creation of its source; one at a slot below the gap's is rejected."""
    c = creations.select("source", "received_ms", F.struct(F.col("received_ms").alias("ms"), "slot").alias("next"))
    found = asof(gaps.select("gap_id", "source", "gap_ms", "slot"), c, ["source"], "gap_ms", "received_ms", "next", DAY_MS, after=True)
    status = F.when(F.col("next").isNull(), "ACTIVE").when(F.col("next.slot") < F.col("slot"), "REJECTED").otherwise("RESOLVED")
    return found.select("gap_id", "source", "gap_ms", F.col("next.ms").alias("resolved_ms"), status.alias("status"))


def flow(observations: DataFrame, span_ms: int) -> DataFrame:
    """Per observation: how many of its source came within the span up to it.

    A row counts in its own time slot of one span and in the next, so that a busy
    source is spread over its slots.
    """
    slot = F.floor(F.col("received_ms") / span_ms)
    spread = observations.select("event_id", "source", "received_ms", slot.alias("_own"), F.explode(F.array(slot, slot + 1)).alias("_slot"))
    trailing = Window.partitionBy("source", "_slot").orderBy("received_ms").rangeBetween(-(span_ms - 1), 0)
    return spread.withColumn("flow", F.count("*").over(trailing)).filter("_own = _slot").select("event_id", "source", "received_ms", "flow")


def network_check(tables: list[DataFrame]) -> DataFrame:
    """One row: how many networks the tables name, and whether that is at most one."""
    named = reduce(DataFrame.union, [t.select("network").distinct() for t in tables]).distinct()
    return named.agg(F.count("*").alias("networks")).select("networks", (F.col("networks") <= 1).alias("consistent"))


def quarantine(observations: DataFrame) -> DataFrame:
    """Per reason: the invalid trades, distinct keys and the last one seen."""
    bad = validated(observations).filter("invalid_reason is not null")
    per = bad.groupBy("network", "source", "slot", "signature", "instruction_index", "event_index", F.col("invalid_reason").alias("reason_code")).agg(F.count("*").alias("occurrences"), F.max("received_ms").alias("seen_ms"))
    return per.groupBy("reason_code").agg(F.count("*").alias("records"), F.sum("occurrences").alias("occurrences"), F.max("seen_ms").alias("last_seen_ms"))


def evidence_violation(evidence: Column, code: Column, detail: Column) -> Column:
    """The first limit that a quarantine record breaks, else NULL."""
    raw = F.try_to_binary(evidence, F.lit("base64"))
    return (
        F.when(raw.isNull(), "evidence_base64").when(F.octet_length(raw) > EVIDENCE_BYTES, "evidence_size")
        .when(F.coalesce(F.length(F.trim(code)), F.lit(0)) == 0, "reason_code").when(F.length(code) > CODE_CHARS, "reason_code").when(F.length(detail) > DETAIL_CHARS, "reason_detail")
    )


def oriented(pools: DataFrame, quotes: dict[str, str]) -> DataFrame:
    """Turn pool trades so that the token is the base.

    ``quotes`` maps supported quote mints to their asset class. Exactly one side
    must be one of them; otherwise orientation is NULL and a reason is given. On a
    reversed pool amounts swap and a buy is a sell of the token.
    """
    known = F.create_map(*(F.lit(x) for kv in quotes.items() for x in kv))
    base_class, quote_class = known[F.col("base_mint")], known[F.col("quote_mint")]
    straight, turned = base_class.isNull() & quote_class.isNotNull(), base_class.isNotNull() & quote_class.isNull()
    pick = lambda a, b: F.when(straight, F.col(a)).when(turned, F.col(b))
    flipped = F.when(F.col("side") == "BUY", "SELL").otherwise("BUY")
    return pools.select(
        "pool", F.when(straight, "BASE_IS_TOKEN").when(turned, "QUOTE_IS_TOKEN").alias("orientation"),
        F.when(base_class.isNotNull() & quote_class.isNotNull(), "BOTH_SIDES_QUOTE").when(base_class.isNull() & quote_class.isNull(), "NO_SUPPORTED_QUOTE").alias("quarantine_reason"),
        pick("base_mint", "quote_mint").alias("token"), F.coalesce(F.when(straight, quote_class), F.when(turned, base_class)).alias("asset"),
        F.when(straight, F.col("side")).when(turned, flipped).alias("side"), pick("base", "quote").alias("base"), pick("quote", "base").alias("quote"),
    )
