"""Current token state, lifetime activity, counters and served snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windowmill.functions.exact import wide
from windowmill.functions.text import blank
from windowmill.operators.asof import before
from windowmill.operators.windows import DAY_MS

MODES = {"OBSERVE_ALL": ["OBSERVED", "QUALIFIED", "APPROVED"], "QUALIFIED_ONLY": ["QUALIFIED", "APPROVED"], "APPROVED_ONLY": ["APPROVED"]}
MAX_ROWS = 5_000


def lifetime_activity(observations: DataFrame) -> DataFrame:
    """Per market over all time: trades, buys, sells, volumes and exact distinct traders.

    Two levels, per wallet and then per market, so that both combine before they
    shuffle. Stale observations count too.
    """
    trade = observations.filter((F.col("kind") == "TRADE") & ~blank(F.col("wallet")) & (F.col("base") > 0) & (F.col("quote") > 0))
    market = ["network", "source", "mint", "asset"]
    per = trade.groupBy(*market, "wallet").agg(
        F.count("*").alias("trades"), F.count_if(F.col("side") == "BUY").alias("buys"), F.count_if(F.col("side") == "SELL").alias("sells"),
        F.sum("base").alias("base_volume"), F.sum("quote").alias("quote_volume"),
    )
    return per.groupBy(*market).agg(*(F.sum(c).alias(c) for c in ("trades", "buys", "sells")), F.count("*").alias("traders"), *(wide(F.sum(c)).alias(c) for c in ("base_volume", "quote_volume")))


def marked_stale(observations: DataFrame) -> DataFrame:
    """Add stale: a lower slot than one that arrived before it for the same mint."""
    seen = before(observations, ["mint"], [F.asc_nulls_first("received_ms"), F.col("event_id")], "received_ms", DAY_MS, F.max, F.col("slot"), "_highest")
    return seen.withColumn("stale", F.coalesce(F.col("slot") < F.col("_highest"), F.lit(False))).drop("_highest")


def token_state(observations: DataFrame) -> DataFrame:
    """Per mint: the latest observation by slot, first and last time, and the name.

    Stale rows change neither the state nor the times. The last creation that was
    not stale names the token; if there is none the first stale one does.
    """
    row = F.struct("slot", "received_ms", "event_id", "kind", "signature")
    latest = F.struct("slot", "received_ms", "event_id")
    fresh, made = ~F.col("stale"), F.col("kind") == "CREATE"
    at = F.struct("received_ms", "event_id")
    found = marked_stale(observations).groupBy("mint").agg(
        F.max_by(row, latest).alias("row"), F.min(F.when(fresh, F.col("received_ms"))).alias("first_observed_ms"), F.max(F.when(fresh, F.col("received_ms"))).alias("last_observed_ms"),
        F.max_by(F.when(fresh & made, F.col("name")), F.when(fresh & made, at)).alias("own"), F.min_by(F.when(~fresh & made, F.col("name")), F.when(~fresh & made, at)).alias("filled"),
        F.count_if("stale").alias("stale_rows"),
    )
    outcome = F.when(F.col("own").isNotNull(), "CREATED").when(F.col("filled").isNotNull(), "ENRICHED_FROM_STALE_CREATION").otherwise("UNNAMED")
    return found.select("mint", F.col("row.slot").alias("latest_slot"), F.col("row.kind").alias("latest_kind"), F.col("row.signature").alias("latest_signature"), "first_observed_ms", "last_observed_ms", "stale_rows", F.coalesce("own", "filled").alias("name"), outcome.alias("metadata"))


def snapshot(stage: DataFrame, mode: str, rows: int = 500) -> DataFrame:
    """The newest visible tokens of a mode, by slot and then mint."""
    if not 0 < rows <= MAX_ROWS:
        raise ValueError(f"rows must be 1 to {MAX_ROWS}")
    return stage.filter(F.col("stage").isin(MODES[mode])).orderBy(F.desc("latest_slot"), "mint").limit(rows)


def page_totals(stage: DataFrame, mode: str, rows: int = 500) -> DataFrame:
    """One row: how many tokens a mode shows, how many a snapshot returns, and whether it cuts."""
    total = stage.filter(F.col("stage").isin(MODES[mode])).agg(F.count("*").alias("tokens_total"))
    returned = F.least("tokens_total", F.lit(rows).cast("long"))
    return total.select("tokens_total", returned.alias("returned"), (F.col("tokens_total") > returned).alias("tokens_truncated"))


def counters(tables: list[tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """counter, value: how many rows of each table meet each condition; one pass for each table."""
    found = []
    for df, named in tables:
        counted = df.agg(*(F.count_if(condition).alias(name) for name, condition in named.items()))
        found.append(counted.select(F.explode(F.array(*(F.struct(F.lit(name).alias("counter"), F.col(name).alias("value")) for name in named))).alias("c")).select("c.*"))
    return reduce(DataFrame.unionByName, found)


def live_markets(observations: DataFrame) -> DataFrame:
    """Markets that were created and have neither completed nor migrated."""
    made = observations.filter("kind = 'CREATE'").groupBy("source", "mint").agg(F.min("received_ms").alias("registered_ms"))
    return made.join(observations.filter("kind in ('COMPLETE', 'MIGRATION')").select("mint").distinct(), "mint", "left_anti")


def retention_candidates(observations: DataFrame, member: DataFrame, gate: DataFrame, cutoff_ms: int) -> DataFrame:
    """Old observations of a finalized window that no open window holds and that opened none."""
    old = observations.filter(F.col("received_ms") < cutoff_ms).select("event_id", "mint", "signature", "received_ms")
    held = member.select("event_id", "mint", "opened_ms").join(gate.select("mint", "opened_ms", "finalizable"), ["mint", "opened_ms"])
    done = held.groupBy("event_id").agg(F.bool_and("finalizable").alias("done")).filter("done").select("event_id")
    openers = gate.select(F.col("opener").alias("signature"))
    return old.join(done, "event_id", "left_semi").join(openers, "signature", "left_anti").select("event_id", "mint", "received_ms")


def retention_classes(observations: DataFrame, quarantined: DataFrame, applied: DataFrame, now_ms: int, hours: dict[str, int]) -> DataFrame:
    """class, candidates: rows of each class that are older than its own number of hours."""
    parts = []
    for name, df, at in (("observations", observations, "received_ms"), ("quarantine", quarantined, "seen_ms"), ("projection_events", applied, "applied_ms")):
        old = df.filter(F.col(at) < now_ms - hours[name] * 3_600_000)
        parts.append(old.agg(F.count("*").alias("candidates")).select(F.lit(name).alias("class"), "candidates"))
    return reduce(DataFrame.unionByName, parts)
