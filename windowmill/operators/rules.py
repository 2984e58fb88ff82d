"""Versioned qualification rules, eight rows per window, and the decision."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windowmill.operators.metrics import WINDOW


@dataclass(frozen=True)
class Policy:
    """Thresholds, all inclusive."""

    minimum_trades: int = 5
    minimum_unique_traders: int = 3
    minimum_buys: int = 1
    minimum_sells: int = 1
    minimum_native_quote_units: int = 50_000_000
    minimum_stable_quote_units: int = 5_000_000
    maximum_wallet_share_bps: int = 9_000

    def violation(self, strict: bool = True) -> str | None:
        """The first setting that is out of range or at odds with another; None if valid."""
        ranges = {
            "minimum_trades": (1, 10_000), "minimum_unique_traders": (1, 10_000), "minimum_buys": (0, 10_000), "minimum_sells": (0, 10_000),
            "minimum_native_quote_units": (0, 2**53 - 1), "minimum_stable_quote_units": (0, 2**53 - 1), "maximum_wallet_share_bps": (1_000 if strict else 0, 10_000),
        }
        for f in fields(self):
            low, high = ranges[f.name]
            if not low <= getattr(self, f.name) <= high:
                return f.name
        for name in ("minimum_unique_traders", "minimum_buys", "minimum_sells"):
            if getattr(self, name) > self.minimum_trades:
                return name
        return None


@dataclass(frozen=True)
class Prefilter:
    max_event_age_ms: int = 15_000
    observation_window_ms: int = 60_000
    max_active_windows: int = 128
    requests_per_second: int = 1
    max_in_flight: int = 4
    request_timeout_ms: int = 5_000
    rate_limit_cooldown_ms: int = 5_000

    def violation(self) -> str | None:
        ranges = {
            "max_event_age_ms": (1_000, 300_000), "observation_window_ms": (1_000, 3_600_000), "max_active_windows": (1, 100_000), "requests_per_second": (1, 1_000),
            "max_in_flight": (1, 128), "request_timeout_ms": (1, 300_000), "rate_limit_cooldown_ms": (100, 300_000),
        }
        for f in fields(self):
            low, high = ranges[f.name]
            if not low <= getattr(self, f.name) <= high:
                return f.name
        if self.request_timeout_ms > self.max_event_age_ms:
            return "request_timeout_ms"
        return "observation_window_ms" if self.observation_window_ms < self.request_timeout_ms else None


#: Rule ids in contractual order.
RULES = [
    "qualification.window-complete", "qualification.supported-quote-asset", "qualification.minimum-trades", "qualification.minimum-unique-traders",
    "qualification.minimum-buys", "qualification.minimum-sells", "qualification.minimum-quote-volume", "qualification.maximum-single-wallet-quote-volume",
]


def _row(number: int, decision: Column, code: Column, evidence: Column) -> Column:
    incomplete = F.col("reason").isNotNull()
    return F.struct(
        F.lit(number + 1).alias("rule_no"), F.lit(RULES[number]).alias("rule_id"), F.when(incomplete, "UNKNOWN").otherwise(decision).alias("decision"),
        F.when(incomplete, F.col("reason")).otherwise(code).alias("reason_code"), F.when(~incomplete, evidence).alias("evidence"),
    )


def _minimum(number: int, actual: str, minimum: Column, met: str, below: str) -> Column:
    ok = F.col(actual) >= minimum
    evidence = F.concat(F.lit("actual="), F.col(actual).cast("string"), F.lit(";minimum="), minimum.cast("string"))
    return _row(number, F.when(ok, "PASS").otherwise("REJECT"), F.when(ok, met).otherwise(below), evidence)


def rule_rows(metrics: DataFrame, policy: Policy, quote_rule: bool = True) -> DataFrame:
    """Eight rows per window from its metrics and its reason (NULL if complete).

    An incomplete window is UNKNOWN on every rule, with its own reason. Without
    ``quote_rule`` every asset counts as native.
    """
    asset = F.col("asset") if quote_rule else F.lit("NATIVE")
    native, stable = asset == "NATIVE", asset == "STABLE"
    none = F.lit(None).cast("string")
    threshold = F.when(native, policy.minimum_native_quote_units).when(stable, policy.minimum_stable_quote_units).cast("decimal(38,0)")
    volume = F.col("quote_volume").cast("string")
    enough = F.col("quote_volume") >= threshold
    share, most = F.col("top_share_bps"), policy.maximum_wallet_share_bps
    within = share <= most
    rows = [
        _row(0, F.lit("PASS"), F.lit("WINDOW_COMPLETE"), none),
        _row(1, F.when(native | stable, "PASS").otherwise("REJECT"), F.when(native, "SUPPORTED_NATIVE_QUOTE_ASSET").when(stable, "SUPPORTED_STABLE_QUOTE_ASSET").otherwise("UNSUPPORTED_QUOTE_ASSET"), asset),
        _minimum(2, "trades", F.lit(policy.minimum_trades), "MINIMUM_TRADES_MET", "TRADES_BELOW_MINIMUM"),
        _minimum(3, "traders", F.lit(policy.minimum_unique_traders), "MINIMUM_UNIQUE_TRADERS_MET", "UNIQUE_TRADERS_BELOW_MINIMUM"),
        _minimum(4, "buys", F.lit(policy.minimum_buys), "MINIMUM_BUYS_MET", "BUYS_BELOW_MINIMUM"),
        _minimum(5, "sells", F.lit(policy.minimum_sells), "MINIMUM_SELLS_MET", "SELLS_BELOW_MINIMUM"),
        _row(
            6, F.when(threshold.isNull(), "UNKNOWN").when(enough, "PASS").otherwise("REJECT"),
            F.when(threshold.isNull(), "QUOTE_VOLUME_THRESHOLD_UNAVAILABLE").when(enough, "MINIMUM_QUOTE_VOLUME_MET").otherwise("QUOTE_VOLUME_BELOW_MINIMUM"),
            F.when(threshold.isNull(), F.concat(F.lit("observed_units="), volume)).otherwise(F.concat(F.lit("actual="), volume, F.lit(";minimum="), threshold.cast("string"))),
        ),
        _row(
            7, F.when(share.isNull(), "UNKNOWN").when(within, "PASS").otherwise("REJECT"),
            F.when(share.isNull(), "WALLET_CONCENTRATION_UNAVAILABLE").when(within, "WALLET_CONCENTRATION_WITHIN_LIMIT").otherwise("WALLET_CONCENTRATION_EXCEEDS_LIMIT"),
            F.when(share.isNull(), F.concat(F.lit("observed_quote_units="), volume)).otherwise(F.concat(F.lit("wallet="), F.col("top_wallet"), F.lit(";actual_bps="), share.cast("string"), F.lit(f";maximum_bps={most}"))),
        ),
    ]
    return metrics.select(*WINDOW, "latest_slot", F.explode(F.array(*rows)).alias("r")).select(*WINDOW, "latest_slot", "r.*")


def fold(decision: str, *keys: str):
    """Any REJECT is REJECT, else any UNKNOWN or no row at all is UNKNOWN, else PASS."""
    rank = F.max(F.when(F.col(decision) == "REJECT", 2).when(F.col(decision) == "UNKNOWN", 1).otherwise(0))
    return F.when(rank == 2, "REJECT").when(rank == 0, "PASS").otherwise("UNKNOWN")


def decisions(rows: DataFrame) -> DataFrame:
    """One row per window: decision and the sorted distinct reasons that equal it.

    Eight rows per window, so the list is bounded.
    """
    found = rows.groupBy(*WINDOW).agg(fold("decision").alias("decision"), F.collect_set(F.struct("decision", "reason_code")).alias("all"))
    own = F.array_sort(F.array_distinct(F.transform(F.filter("all", lambda r: r.decision == F.col("decision")), lambda r: r.reason_code)))
    return found.select(*WINDOW, "decision", F.when(F.col("decision") == "PASS", "").otherwise(F.array_join(own, ",")).alias("reasons"))


def reason_counts(rows: DataFrame, decided: DataFrame, seen: DataFrame, decision: str) -> DataFrame:
    """How many windows of a decision have each reason, and when one was last seen.

    A window adds once to each of its distinct reasons.
    """
    mine = decided.filter(F.col("decision") == decision).select(*WINDOW).join(rows.filter(F.col("decision") == decision), WINDOW).select(*WINDOW, "reason_code").distinct()
    return mine.join(seen, WINDOW).groupBy("reason_code").agg(F.count("*").alias("windows"), F.max("closes_ms").alias("last_seen_ms"))


def evidence_rule(availability: Column) -> Column:
    """Available passes, invalid rejects, missing and stale evidence is unknown."""
    return F.when(availability == "AVAILABLE", "PASS").when(availability == "INVALID", "REJECT").otherwise("UNKNOWN")


#: Condition operators of strategies.
_OPERATORS = {
    "EQ": lambda c, v: c == v, "NE": lambda c, v: c != v, "GT": lambda c, v: c > v, "GTE": lambda c, v: c >= v,
    "LT": lambda c, v: c < v, "LTE": lambda c, v: c <= v, "IN": lambda c, v: c.isin(*v),
}


def strategy(conditions: list[tuple[str, str, object]]) -> Column:
    """All conditions (input, operator, value) as one predicate; unknown inputs never match."""
    out = F.lit(True)
    for name, operator, value in conditions:
        if operator not in _OPERATORS:
            raise ValueError(f"unknown condition operator {operator}")
        out = out & F.coalesce(_OPERATORS[operator](F.col(name), value), F.lit(False))
    return out
