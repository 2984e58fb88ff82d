"""Intake: which notifications matter, and which market an event belongs to."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windowmill.operators.asof import asof_position
from windowmill.operators.windows import members
from windowmill.sources import coverage, layouts, logs

DISCOVERY = ["CREATE", "CREATE_POOL"]
#: Events that are tracked by their pool; the others by their mint.
BY_POOL = ["BUY", "SELL", "LIQUIDITY_DEPOSIT", "LIQUIDITY_WITHDRAW"]
CLOCK_SKEW_MS = 10_000
#: Which venue each program trades on.
VENUES = {"PUMP": "PUMP_BONDING_CURVE", "PUMP_SWAP": "PUMP_SWAP", "RAYDIUM_CPMM": "RAYDIUM_CPMM", "RAYDIUM_CLMM": "RAYDIUM_CLMM", "RAYDIUM_AMM_V4": "RAYDIUM_AMM_V4"}

_JUDGED = [pa.field("instruction_index", pa.int32()), pa.field("calls", pa.int32()), pa.field("gap", pa.bool_()), pa.field("payload", pa.string()), pa.field("scope_error", pa.string())]


def mentions(lines: Column, program: str) -> Column:
    """Does any line invoke the program?"""
    return F.exists(lines, lambda x: x.startswith(f"Program {program} invoke ["))


def fresh(event_ms: Column, now_ms: Column, max_age_ms: int) -> Column:
    """Not older than the age and not further ahead than the clocks may differ, both bounds included; NULL is not fresh."""
    age = F.try_subtract(now_ms, event_ms)
    return F.coalesce((age <= max_age_ms) & (age >= -CLOCK_SKEW_MS), F.lit(False))


def tracking_target(kind: Column, mint: Column, pool: Column) -> Column:
    """What an event is followed by; NULL for those that open a window."""
    return F.when(kind.isin(DISCOVERY), None).when(kind.isin(BY_POOL), F.concat(F.lit("pool:"), pool)).otherwise(F.concat(F.lit("mint:"), mint))


def seeds(events: DataFrame, max_age_ms: int) -> DataFrame:
    """The first fresh discovery of each target of a notification: signature, target, event_order, event_ms."""
    found = events.filter(F.col("kind").isin(DISCOVERY) & fresh(F.col("event_ms"), F.col("received_ms"), max_age_ms))
    first = found.groupBy("signature", "target").agg(F.min_by(F.struct("event_order", "event_ms"), "event_order").alias("e"))
    return first.select("signature", "target", "e.event_order", "e.event_ms")


def tracked(events: DataFrame, windows: DataFrame, length_ms: int) -> DataFrame:
    """Events other than discoveries that an open window of their market takes."""
    other = events.filter(~F.col("kind").isin(DISCOVERY))
    return members(other, windows, length_ms, ["signature", "target", "event_order"])


def line_faults(notifications: DataFrame, program: str, name: str) -> DataFrame:
    """signature, malformed, cause of notifications that mention a program, from their log lines.

    Lines that do not nest, and events that are unknown or do not decode whole, are
    malformed, and a DECODE_GAP of the source. Else events and the calls that carry them
    must pair within each instruction; where they don't, the source has a gap of
    CPI_INSTRUCTION_DATA_UNAVAILABLE. cause is NULL where all is well. ``name`` is the
    program's in ``layouts.OWN``. Several rows of a signature count as one.
    """

    def judge(signature: str | None, lines: list[str | None]) -> list[tuple]:
        if not any(x is not None and x.startswith(f"Program {program} invoke [") for x in lines):
            return []
        found, unpaired = coverage.paired(lines, program)
        events, unscoped = logs.events(signature, lines, program)
        return [(None, None, None, None, unscoped or unpaired), *((*f, None, None) for f in found), *((i, None, None, payload, None) for i, _, payload in events)]

    rows = layouts.dispatched(logs.by_lines(notifications, judge, _JUDGED).withColumn("program", F.lit(name)))
    kept, invalid = [*rows.columns], F.when(F.col("kind").isNull(), F.col("status") != "IGNORED")
    for kind in layouts.OWN.get(name, []):  # a payload is decoded by the one layout of its kind
        rows = layouts.decoded(rows.withColumn("_own", F.when(F.col("kind") == kind, F.col("payload"))), kind, "_own").withColumnRenamed("decode_error", f"_{kind}").select(*kept, f"_{kind}")
        kept.append(f"_{kind}")
        invalid = invalid.when(F.col("kind") == kind, F.col(f"_{kind}").isNotNull())
    rows = rows.select("signature", "instruction_index", "calls", "gap", F.col("scope_error").isNotNull().alias("broken"), F.when(F.col("payload").isNotNull(), invalid).alias("invalid"))
    direct = rows.groupBy("signature", "instruction_index").agg(
        F.bool_or(F.col("broken") | F.coalesce("invalid", F.lit(False))).alias("malformed"), F.coalesce(F.bool_or("gap"), F.lit(False)).alias("gap"),
        F.count_if(~F.col("invalid")).alias("eligible"), *(F.coalesce(f("calls"), F.lit(0)).alias(c) for c, f in (("least", F.min), ("most", F.max))),
    )
    parted = F.col("gap") | (F.col("least") != F.col("eligible")) | (F.col("most") != F.col("eligible"))
    marks = direct.groupBy("signature").agg(F.max(F.when(F.col("malformed"), 2).when(parted, 1).otherwise(0)).alias("_m"))
    return marks.select("signature", (F.col("_m") == 2).alias("malformed"), F.when(F.col("_m") == 2, "DECODE_GAP").when(F.col("_m") == 1, "CPI_INSTRUCTION_DATA_UNAVAILABLE").alias("cause"))


def classified(notifications: DataFrame, events: DataFrame, windows: DataFrame, max_age_ms: int, length_ms: int) -> DataFrame:
    """signature, disposition, seeds, tracked of each notification.

    A failed transaction goes first, whatever it says. Else a fresh discovery is
    fetched, activity of an open window is collected, and the rest is dropped as stale
    discovery, malformed logs or irrelevant, in this order. Each part is one aggregate
    by signature that combines before it shuffles. ``notifications`` has signature,
    failed and malformed; ``events`` signature, kind, mint, target, event_order,
    event_ms and received_ms.
    """
    found = seeds(events, max_age_ms).groupBy("signature").agg(F.count("*").alias("seeds"))
    taken = tracked(events, windows, length_ms).groupBy("signature").agg(F.count_distinct("target").alias("tracked"))
    stale = events.filter(F.col("kind").isin(DISCOVERY) & ~fresh(F.col("event_ms"), F.col("received_ms"), max_age_ms)).select("signature", F.lit(True).alias("_stale")).distinct()
    out = notifications.join(found, "signature", "left").join(taken, "signature", "left").join(stale, "signature", "left")
    alive = ~F.col("failed")
    counts = {c: F.when(alive, F.coalesce(c, F.lit(0))).otherwise(0) for c in ("seeds", "tracked")}
    kind = (
        F.when(~alive, "FAILED_TRANSACTION").when(F.col("seeds") > 0, "FETCH_DISCOVERY").when(F.col("tracked") > 0, "COLLECT_TRACKED_ACTIVITY")
        .when(F.col("_stale"), "STALE_DISCOVERY").when(F.col("malformed"), "MALFORMED_LOGS").otherwise("IRRELEVANT")
    )
    return out.withColumns(counts).select("signature", kind.alias("disposition"), "seeds", "tracked")


#: A position on the chain: discoveries come first within a transaction, then the order of programs, instructions and events.
POSITION = ["slot", "transaction_index", "after_discovery", "program_rank", "instruction_index", "event_index"]
_RANKS = {"PUMP": 0, "PUMP_SWAP": 1}


def positioned(events: DataFrame) -> DataFrame:
    """Add after_discovery and program_rank, by which the events of a transaction are taken in order."""
    rank = F.create_map(*(F.lit(x) for kv in _RANKS.items() for x in kv))
    return events.withColumns({"after_discovery": (~F.coalesce(F.col("kind").isin(DISCOVERY), F.lit(False))).cast("int"), "program_rank": F.coalesce(rank[F.col("program")], F.lit(len(_RANKS)))})


def registered(events: DataFrame) -> DataFrame:
    """Events that are no discoveries, with quarantine_reason, NULL where their market takes them, and registered_slot of it.

    A creation registers its market (mint and quote_mint), a completion or migration
    retires it behind itself, so that the event that completes a market still belongs to
    it. What was registered before an event counts, by position: a trade in the very
    transaction that creates its market finds it, whichever instruction comes first. A
    trade of a zero amount is refused before its market is looked up; a market is
    unresolved if none is open; a trade must be in its market's quote mint, where two
    unknown ones are equal.
    """
    placed = positioned(events)
    ends = F.col("kind").isin("COMPLETE", "MIGRATION")
    entries = placed.filter(F.col("kind").isin(DISCOVERY) | ends).withColumn("market", F.struct((~ends).alias("open"), "slot", "quote_mint"))
    out = asof_position(placed.filter(~F.col("kind").isin(DISCOVERY)), entries, ["mint"], POSITION, "market")
    trade = F.col("kind") == "TRADE"
    reason = (
        F.when(trade & ((F.coalesce("base", F.lit(0)) <= 0) | (F.coalesce("quote", F.lit(0)) <= 0)), "ZERO_TRADE_AMOUNT")
        .when(~F.coalesce("market.open", F.lit(False)), "UNRESOLVED_MARKET").when(trade & ~F.col("quote_mint").eqNullSafe(F.col("market.quote_mint")), "QUOTE_MINT_MISMATCH")
    )
    return out.withColumn("quarantine_reason", reason).withColumn("registered_slot", F.when(reason.isNull(), F.col("market.slot"))).drop("market")


def event_order(events: DataFrame) -> DataFrame:
    """Add place: the place of each event among those of its transaction, discoveries first, from 0."""
    within = Window.partitionBy("signature").orderBy(*POSITION[2:])
    return positioned(events).withColumn("place", (F.row_number().over(within) - 1).cast("long"))


def source_matches_venue(source: Column, venue: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in VENUES.items() for x in kv))
    return F.coalesce(known[source] == venue, F.lit(False))


def opening_violation() -> Column:
    """The first rule that an opener breaks, of a row with the opener's and its window's fields; NULL if none.

    Columns: kind, source, venue, mint, market_address, received_ms; target_kind,
    target_address, collector_run_id, opened_ms, closes_ms.
    """
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    curve = (F.col("kind") == "CREATE") & (F.col("source") == "PUMP") & (F.col("venue") == "PUMP_BONDING_CURVE") & (F.col("target_kind") == "PUMP_MINT") & (F.col("target_address") == F.col("mint"))
    pool = (F.col("kind") == "CREATE_POOL") & (F.col("source") == "PUMP_SWAP") & (F.col("venue") == "PUMP_SWAP") & (F.col("target_kind") == "PUMP_SWAP_POOL") & (F.col("target_address") == F.col("market_address"))
    return (
        F.when(F.col("closes_ms") <= F.col("opened_ms"), "window bounds").when(empty("target_address"), "target_address").when(empty("collector_run_id"), "collector_run_id")
        .when(~F.coalesce(curve | pool, F.lit(False)), "opening target").when(~F.col("received_ms").eqNullSafe(F.col("opened_ms")), "opened_ms")
    )


def token_violation(fields: dict[str, str]) -> Column:
    """The first field of a token that differs from its source's, by token column and source column; NULL equals NULL."""
    return F.coalesce(*(F.when(~F.col(a).eqNullSafe(F.col(b)), a) for a, b in fields.items()), F.lit(None).cast("string"))


def token_shape_violation() -> Column:
    """The first rule that a served token breaks, in the order in which they are told; NULL if none.

    Columns: mint, market_address, last_event_kind, latest_signature, name, symbol,
    quote_mint, base_volume, quote_volume, buys, sells, trades, traders,
    first_observed_ms, last_observed_ms, source, venue, stage, and a qualification with
    decision, completeness, trades, buys, sells, traders, buyers, sellers, opened_ms,
    closed_ms, evaluated_ms, top_share_bps (NULL if there is none).
    """
    blank = lambda c: F.trim(c) == ""
    empty = lambda c: F.coalesce(blank(c), F.lit(True))
    unsigned = lambda c: F.coalesce(F.col(c).rlike("^[0-9]+$"), F.lit(False))
    q = lambda c: F.col(f"qualification.{c}")
    totals = (
        (F.col("buys") + F.col("sells") != F.col("trades")) | (F.col("traders") > F.col("trades")) | (F.col("first_observed_ms") > F.col("last_observed_ms")) | ~source_matches_venue(F.col("source"), F.col("venue"))
    )
    qualified = q("decision").isNotNull() & (
        (q("buys") + q("sells") != q("trades")) | (q("traders") > q("trades")) | (q("buyers") > q("buys")) | (q("sellers") > q("sells")) | (q("closed_ms") <= q("opened_ms"))
        | (q("evaluated_ms") < q("opened_ms")) | F.coalesce(q("top_share_bps") > 10_000, F.lit(False))
    )
    passed = F.coalesce((q("decision") == "PASS") & (q("completeness") == "COMPLETE"), F.lit(False))
    out = F.when(empty("mint"), "mint")
    for c in ("market_address", "last_event_kind", "latest_signature"):
        out = out.when(empty(c), c)
    for c in ("name", "symbol", "quote_mint"):
        out = out.when(blank(c), c)
    for c in ("base_volume", "quote_volume"):
        out = out.when(~unsigned(c), c)
    return out.when(totals, "activity").when(qualified, "qualification totals").when(F.col("stage").isin("QUALIFIED", "APPROVED") & ~passed, "qualification")
