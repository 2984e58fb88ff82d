"""The plans that users run, from a folder of tables to a result."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windowmill.functions.ordering import order_columns
from windowmill.operators import evidence, intake, lifecycle, metrics, projection, registry, replay, rules, tokens, windows
from windowmill.operators.asof import before
from windowmill.operators.storage import checkpointed, shared_folder, written
from windowmill.sources import adapters, coverage, layouts, logs, samples
from windowmill.streaming import stateful

LENGTH_MS = 7 * windows.DAY_MS
SHIP_LENGTH_MS = 90 * windows.DAY_MS
POLICY = rules.Policy(minimum_native_quote_units=20_000, minimum_stable_quote_units=20_000, maximum_wallet_share_bps=6_000)
CAPACITY = 128
CLAIM_TTL_MS = 2 * windows.DAY_MS
FLOW_MS = 60_000
MAX_AGE_MS = 15_000
IDLE_MS = 21_600_000
CUTOFF_MS = 1_705_708_800_000
#: (revision, effective from, minimum trades)
REVISIONS = [(1, 1_704_067_200_000, 5), (2, 1_704_931_200_000, 8), (3, 1_705_795_200_000, 3)]
CONDITIONS = [("trades", "GTE", 5), ("top_share_bps", "LTE", 6_000), ("asset", "IN", ["NATIVE", "STABLE"]), ("sells", "NE", 0)]
QUOTES = {"WRAPPED": "NATIVE", "DOLLAR": "STABLE"}


def longs(df: DataFrame) -> DataFrame:
    """Whole decimals as BIGINT."""
    return df.select(*(F.col(c).cast("long").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes))


class Scene:
    """Observations of a folder with their windows and members."""

    def __init__(self, spark: SparkSession, sf_dir: str, invalid: bool = True, liquidity: bool = True, registered: bool = True, once: bool = False):
        self.registered = registered
        self.spark, self.sf_dir = spark, sf_dir
        #: With ``once`` the events are parsed once and written, for plans that read them many times.
        self.events = written(adapters.raw_events(spark, sf_dir, adapters.spread), "events") if once else None
        self.observations = adapters.observations(spark, sf_dir, invalid, liquidity, events=self.events)
        self.windows = windows.open_windows(self.observations.filter("kind = 'CREATE'"), LENGTH_MS)
        keep = [c for c in self.observations.columns if c != "mint"]
        self.member = windows.members(self.observations, self.windows, LENGTH_MS, keep)
        self.gaps = adapters.gaps(spark, sf_dir, self.events)

    def complete(self) -> DataFrame:
        return windows.completeness(self.windows, self.member, self.gaps, LENGTH_MS)

    def gate(self) -> DataFrame:
        return windows.gated(self.complete(), adapters.progress(self.spark, self.sf_dir, self.events))

    @cached_property
    def registry_events(self) -> DataFrame:
        return adapters.registry_events(self.spark, self.sf_dir, self.events)

    @cached_property
    def states(self) -> DataFrame:
        """Windows of the registry, with what ended them and when they were claimed."""
        opened = registry.registry(self.registry_events, LENGTH_MS, CAPACITY)
        return checkpointed(registry.settled(opened, self.registry_events, adapters.feed_times(self.spark, self.sf_dir, self.events)))

    @cached_property
    def decided_member(self) -> tuple[DataFrame, DataFrame]:
        """Claimed windows with their reason, and their members: what was admitted before they left."""
        if not self.registered:
            return self.complete(), self.member
        claimed = self.states.filter("claimed_ms is not null").select("mint", "source", "asset", "opener", "opened_ms", "closes_ms", "left_ms", "reason", "claimed_ms")
        keep = [c for c in self.observations.columns if c != "mint"]
        member = windows.members(self.observations, claimed.drop("closes_ms").withColumnRenamed("left_ms", "closes_ms"), LENGTH_MS, keep)
        return windows.named_first(claimed.drop("left_ms"), member), member

    @cached_property
    def _metrics(self) -> DataFrame:
        found = metrics.counts(*self.decided_member)
        return checkpointed(found) if self.events is not None else found

    def metrics(self) -> DataFrame:
        """Metrics of claimed windows; written once with ``once``, as several steps read them."""
        return self._metrics

    def rules(self, quote_rule: bool = True) -> DataFrame:
        return rules.rule_rows(self.metrics(), POLICY, quote_rule)

    @cached_property
    def decided(self) -> DataFrame:
        """mint, opened_ms, decision, reasons, claimed_ms, is_current of claimed windows; written once, as several steps read it."""
        durable = windows.superseded(self.states.filter("status in ('CONFIRMED', 'CANCELLED_CONFIRMED', 'OPEN')"))
        return checkpointed(rules.decisions(self.rules()).join(durable.select(*metrics.WINDOW, "claimed_ms", "is_current"), metrics.WINDOW))

    @cached_property
    def token_rows(self) -> DataFrame:
        """What each event does to its token, and the tokens that there are after all."""
        return tokens.projected(token_events(self))

    @cached_property
    def tokens_left(self) -> DataFrame:
        """The tokens alone."""
        return tokens.projected(token_events(self), outcomes=False)

    def stage(self) -> DataFrame:
        named = self.observations.withColumn("name", F.when(F.col("kind") == "CREATE", F.concat(F.lit("name-"), F.col("event_id").cast("string"))))
        return projection.token_state(named).join(self.tokens_left.select("mint", "stage"), "mint")


def scene(query, once: bool = False):
    return lambda spark, sf_dir: query(Scene(spark, sf_dir, once=once))


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with replays: earlier receipts, changed evidence, known indexes."""
    o = adapters.observations(spark, sf_dir).withColumns({"evidence": F.concat(F.lit("h-"), F.col("event_id").cast("string")), "arrival": F.col("event_id") * 10})
    copy = lambda divisor, n, **changes: o.filter(F.col("event_id") % divisor == 0).withColumns({"arrival": F.col("arrival") + n} | changes)
    index = lambda plus: (F.col("k") + plus).cast("long")
    return (
        o.unionByName(copy(7, 1, received_ms=F.col("received_ms") - 1000)).unionByName(copy(11, 2, evidence=F.concat(F.lit("x-"), F.col("event_id").cast("string"))))
        .unionByName(copy(13, 3, transaction_index=index(0))).unionByName(copy(26, 4, transaction_index=index(1)))
    )


def ship(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    trades = adapters.shipments(spark, sf_dir)
    opened = checkpointed(windows.open_windows(trades.filter("l_linenumber = 1"), SHIP_LENGTH_MS))  # read for members and for their metrics
    return opened, windows.members(trades, opened, SHIP_LENGTH_MS, [c for c in trades.columns if c != "mint"])


def ship_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    opened, member = ship(spark, sf_dir)
    return longs(metrics.counts(opened, member).select(*metrics.WINDOW, "observations", "trades", "buys", "sells", "traders", "buyers", "sellers", "buy_base", "buy_quote", "sell_base", "sell_quote", "top_wallet", "top_quote", "top_share_bps"))


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    from windowmill.functions.text import trimmed

    return longs(adapters.observations(spark, sf_dir).select("event_id", "source", "mint", "asset", "kind", "side", trimmed(F.col("wallet")).alias("wallet"), "creator", "base", "quote", "base_reserve", "quote_reserve", "received_ms"))


def line_faults(s: Scene) -> DataFrame:
    return intake.line_faults(samples.traffic(s.spark, s.sf_dir, s.events), samples.PROGRAM, "CURVE")


def intake_marks(s: Scene) -> DataFrame:
    """Windows of the registry where faults of log lines mark the windows of their source as well."""
    faults = line_faults(s).filter("cause is not null").join(samples.traffic(s.spark, s.sf_dir, s.events).drop("log_messages"), "signature")
    none = F.lit(None).cast("string")
    marks = faults.select(F.lit("MARK").alias("action"), F.col("received_ms").alias("at_ms"), (F.col("event_id") * 4 + 3).alias("ordinal"), F.lit("source").alias("reach"), F.col("cause").alias("reason"), "mint", "source", "asset", none.alias("opener"))
    return registry.registry(s.registry_events.unionByName(marks), LENGTH_MS, CAPACITY).select("mint", "opened_ms", "status", "reason", "reason_ms")


def intake_events(s: Scene) -> tuple[DataFrame, DataFrame]:
    """Notifications, some of them failed or malformed, and their events with an age, an order and a repeated target."""
    note = adapters.notifications(s.spark, s.sf_dir, events=s.events)
    faults = line_faults(s).select("signature", "malformed")
    marked = note.select("signature", (F.col("k") % 17 == 3).alias("failed")).join(faults, "signature", "left").withColumn("malformed", F.coalesce("malformed", F.lit(False)))
    e = s.observations.withColumns({"target": F.concat(F.lit("mint:"), F.col("mint")), "event_ms": F.col("received_ms") - F.col("k") * 400 + 5_000, "event_order": F.lit(0)})
    again = e.filter("k % 5 = 0").withColumn("event_order", F.lit(1))
    return marked, e.unionByName(again)


def intake_classified(s: Scene) -> DataFrame:
    note, events = intake_events(s)
    return intake.classified(note, events, s.windows, MAX_AGE_MS, LENGTH_MS)


def intake_seeds(s: Scene) -> DataFrame:
    return intake.seeds(intake_events(s)[1], MAX_AGE_MS)


def market_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events against the markets that are registered before their position."""
    found = intake.registered(adapters.chain_events(spark, sf_dir))
    return found.select("event_id", "instruction_index", "event_index", "kind", "mint", "quarantine_reason", "registered_slot")


def event_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.event_order(adapters.chain_events(spark, sf_dir)).select("signature", "instruction_index", "event_index", "kind", "place")


def decode_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layouts.decoded(samples.completions(spark, sf_dir), "COMPLETE")
    return found.select("event_id", "decode_error", "user", "mint", "bonding_curve", "timestamp", "quote_mint")


def event_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layouts.dispatched(samples.first_bytes(spark, sf_dir)).select("event_id", "program", "kind", "status")


def cpi_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layouts.unmatched_copies(*samples.copies(spark, sf_dir)).groupBy("signature", "instruction_index", "payload", "reason_code").agg(F.count("*").alias("copies"))


def coverage_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = samples.calls(spark, sf_dir)
    direct = logs.scoped(lines, samples.PROGRAM).filter("scope_error is null").groupBy("signature", "instruction_index").agg(F.count("*").alias("eligible"), F.lit(False).alias("invalid"))
    return coverage.incomplete(coverage.call_coverage(lines, samples.PROGRAM), direct)


def window_states(s: Scene) -> DataFrame:
    return registry.runs(s.states, s.registry_events)


def pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pools of the four kinds of pairs."""
    key, kind = F.col("p_partkey"), F.col("p_partkey") % 4
    token = F.concat(F.lit("T"), key.cast("string"))
    return adapters.table(spark, sf_dir, "part").select(
        key.alias("pool"), F.when(kind == 0, token).when(kind == 1, "WRAPPED").when(kind == 2, "WRAPPED").otherwise(token).alias("base_mint"),
        F.when(kind == 0, "DOLLAR").when(kind == 1, token).when(kind == 2, "DOLLAR").otherwise(F.concat(token, F.lit("x"))).alias("quote_mint"),
        F.when(key % 3 == 0, "BUY").otherwise("SELL").alias("side"), key.alias("base"), F.round(F.col("p_retailprice") * 100).cast("long").alias("quote"),
    )


def risk(s: Scene) -> DataFrame:
    """Per market, the fold of the evidence of all its views; none at all is unknown."""
    k = F.col("k") % 4
    state = F.when(k == 0, "AVAILABLE").when(k == 1, "MISSING").when(k == 2, "STALE").otherwise("INVALID")
    seen = s.observations.filter("kind like 'LIQUIDITY%'").withColumn("decision", rules.evidence_rule(state))
    folded = seen.groupBy("mint").agg(rules.fold("decision").alias("decision"), F.count("*").alias("evidence"))
    out = s.observations.select("mint").distinct().join(folded, "mint", "left")
    return out.select("mint", F.coalesce("decision", F.lit("UNKNOWN")).alias("decision"), F.coalesce("evidence", F.lit(0)).alias("evidence"))


def summary(s: Scene) -> DataFrame:
    out = s.metrics().drop("claimed_ms").join(s.decided, metrics.WINDOW)
    return longs(out.select(*metrics.WINDOW, "closes_ms", "source", "asset", "observations", "trades", "buys", "sells", "traders", "quote_volume", "top_wallet", "top_share_bps", "reason", "claimed_ms", "is_current", "decision", "reasons"))


def counters(s: Scene) -> DataFrame:
    every, is_stage, is_decision = F.lit(True), (lambda x: F.col("stage") == x), (lambda x: F.col("decision") == x)
    return projection.counters(
        [(s.stage(), {"tokens": every, "qualified": is_stage("QUALIFIED"), "approved": is_stage("APPROVED")}), (s.decided, {"rejected": is_decision("REJECT"), "unknown": is_decision("UNKNOWN")}),
         (s.observations, {"observations": every}), (s.gaps, {"gaps": every})]
    )


def token_events(s: Scene) -> DataFrame:
    """Observations, decisions of claimed windows, approvals and removals as events of tokens."""
    k, mint = F.col("k"), F.col("mint").cast("long")
    durable = s.states.filter("status in ('CONFIRMED', 'CANCELLED_CONFIRMED', 'OPEN')")
    holding = durable.select("mint", "opened_ms", F.coalesce("left_ms", "closes_ms").alias("closes_ms"))
    held = windows.members(s.observations, holding, LENGTH_MS, ["event_id"]).select("event_id", F.col("opened_ms").alias("window_ms"))
    market = F.when(k >= 90, F.concat(F.col("asset"), F.lit("-B"))).otherwise(F.col("asset"))
    seen = s.observations.join(held, "event_id", "left").withColumn("market", market)
    event = lambda action, plus: F.struct(F.lit(action).alias("action"), (F.col("event_id") * 4 + plus).alias("ordinal"))
    said = F.array_compact(F.array(event("OBSERVE", 0), F.when((k % 10 == 3) & (mint % 3 == 0), event("APPROVE", 1)), F.when((k == 51) & (mint % 7 == 0), event("REMOVE", 2))))
    name = F.when(F.col("kind") == "CREATE", F.concat(F.lit("name-"), F.col("event_id").cast("string")))
    none = F.lit(None).cast("string")
    seen = seen.select("mint", F.col("received_ms").alias("at_ms"), F.explode(said).alias("e"), "slot", "market", "window_ms", none.alias("decision"), "kind", name.alias("name")).select("e.*", "*").drop("e")
    newer = Window.partitionBy("mint").orderBy("opened_ms", "opener")
    newest = durable.withColumn("_newer", F.lead("opened_ms").over(newer)).select("mint", "opened_ms", "opener", "asset", (F.col("_newer").isNull() | (F.col("_newer") > F.col("claimed_ms"))).alias("newest"))
    final = s.decided.join(newest, metrics.WINDOW).select(
        "mint", F.col("claimed_ms").alias("at_ms"), F.lit("FINALIZE").alias("action"), (F.substring("opener", 5, 20).cast("long") * 4 + 3).alias("ordinal"), F.lit(0).cast("long").alias("slot"),
        F.col("asset").alias("market"), F.col("opened_ms").alias("window_ms"), F.when(F.col("newest"), F.col("decision")).alias("decision"), none.alias("kind"), none.alias("name"),
    )
    return seen.unionByName(final)


def token_outcomes(s: Scene) -> DataFrame:
    return s.token_rows.filter("what = 'OUTCOME'").select("mint", "ordinal", "outcome")


def token_fold(s: Scene) -> DataFrame:
    """The tokens with their activity: that of their finalized window, or of their market's whole life."""
    market = F.when(F.col("k") >= 90, F.concat(F.col("asset"), F.lit("-B"))).otherwise(F.col("asset"))
    life = windows.validated(s.observations.withColumn("market", market)).filter("valid").groupBy("mint", "market").agg(F.count("*").alias("_life"))
    own = s.metrics().select("mint", F.col("opened_ms").alias("activity_window_ms"), F.col("trades").alias("_own"))
    found = s.tokens_left.join(life, ["mint", "market"], "left").join(own, ["mint", "activity_window_ms"], "left")
    trades = F.coalesce(F.when(F.col("activity_window_ms").isNotNull(), F.col("_own")).otherwise(F.col("_life")), F.lit(0)).cast("long")
    return found.select("mint", "market", "stage", "window_ms", "activity_window_ms", "latest_slot", "first_ms", "last_ms", "name", trades.alias("trades"))


def token_counters(s: Scene) -> DataFrame:
    """How often each outcome was, and how many tokens are left in each stage."""
    return s.token_rows.groupBy("what", F.coalesce("outcome", "stage").alias("name")).agg(F.count("*").alias("value"))


def live_window_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, run to its end: each window that the watermark closed."""
    seen = adapters.observations(spark, sf_dir, read=adapters.stream)
    return longs(stateful.collected(stateful.window_metrics(seen, LENGTH_MS), f"{shared_folder(spark)}/live-window-metrics"))


def live_idle_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = adapters.notifications(spark, sf_dir, read=adapters.stream)
    return stateful.collected(stateful.idle_gaps(seen, IDLE_MS), f"{shared_folder(spark)}/live-idle-gaps")


def reasons(decision: str):
    def query(s: Scene) -> DataFrame:
        rows = s.rules()
        return rules.reason_counts(rows, rules.decisions(rows), s.states.select(*metrics.WINDOW, "closes_ms"), decision).orderBy(F.desc("windows"), "reason_code")

    return query


def snapshot(mode: str):
    return lambda s: projection.snapshot(s.stage().select("mint", "latest_slot", "latest_kind", "name", "stage"), mode)


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.notifications(spark, sf_dir)
    index = F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 3)
    return e.select("source", F.floor(F.col("event_id") / 3).alias("slot"), index.cast("long").alias("transaction_index"), F.col("received_ms").alias("arrival"))


def claims(s: Scene) -> DataFrame:
    keyed = s.observations.withColumn("mint", F.concat_ws("/", "mint", "kind"))
    return windows.open_windows(keyed, CLAIM_TTL_MS).select(F.col("mint").alias("claim"), F.col("opened_ms").alias("claimed_ms"), F.col("closes_ms").alias("expires_ms"))


def total_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = adapters.observations(spark, sf_dir)
    placed = before(o, ["mint"], order_columns(), "received_ms", windows.DAY_MS, F.sum, F.lit(1), "_earlier")
    return placed.select("mint", "event_id", (F.coalesce("_earlier", F.lit(0)) + 1).cast("long").alias("position"))


def dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.deduplicated(arrivals(spark, sf_dir)).select("signature", "received_ms", "transaction_index", "kind", "copies")


def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.conflicts(arrivals(spark, sf_dir)).select("signature", "copies", "conflict_kind")


QUERIES = {
    "obs_normalize": normalized,
    "obs_dedup_replay": dedup,
    "obs_replay_conflicts": conflicts,
    "obs_total_order": total_order,
    "windows_open": scene(lambda s: s.windows),
    "windows_evict": scene(lambda s: registry.evicted(s.registry_events, LENGTH_MS, CAPACITY), once=True),
    "log_scope": lambda spark, sf_dir: logs.scoped(samples.notifications(spark, sf_dir), samples.PROGRAM),
    "decode_events": decode_events,
    "event_dispatch": event_dispatch,
    "cpi_pairing": cpi_pairing,
    "call_coverage": lambda spark, sf_dir: coverage.call_coverage(samples.calls(spark, sf_dir), samples.PROGRAM),
    "coverage_incomplete": coverage_incomplete,
    "token_outcomes": scene(token_outcomes, once=True),
    "token_fold": scene(token_fold, once=True),
    "token_counters": scene(token_counters, once=True),
    "live_window_metrics": live_window_metrics,
    "live_idle_gaps": live_idle_gaps,
    "snapshot_totals": scene(lambda s: projection.page_totals(s.stage(), "OBSERVE_ALL", 50), once=True),
    "window_states": scene(window_states, once=True),
    "intake_classified": scene(intake_classified, once=True),
    "intake_faults": scene(line_faults),
    "intake_marks": scene(intake_marks, once=True),
    "intake_seeds": scene(intake_seeds, once=True),
    "market_matched": market_matched,
    "event_order": event_order,
    "window_superseded": scene(lambda s: windows.superseded(s.windows).select("mint", "opened_ms", "is_current")),
    "window_membership": scene(lambda s: s.member.select("mint", "opened_ms", "event_id")),
    "membership_mismatch": scene(lambda s: windows.late(s.observations, s.windows)),
    "window_completeness": scene(lambda s: s.complete().select("mint", "opened_ms", "reason")),
    "window_watermark_gate": scene(lambda s: s.gate().select("mint", "opened_ms", "progress_ms", "finalizable")),
    "window_counts_volumes": scene(lambda s: longs(metrics.counts(s.windows, s.member).select(*metrics.WINDOW, "observations", "latest_slot", "trades", "buys", "sells", "buy_base", "buy_quote", "sell_base", "sell_quote"))),
    "window_unique_traders": scene(lambda s: metrics.counts(s.windows, s.member).select(*metrics.WINDOW, "traders", "buyers", "sellers")),
    "window_wallets": scene(lambda s: longs(metrics.wallets(s.member))),
    "window_top_wallet": scene(lambda s: longs(metrics.counts(s.windows, s.member).select(*metrics.WINDOW, "top_wallet", "top_quote", "top_share_bps"))),
    "window_creator_share": scene(lambda s: longs(metrics.creators(s.windows, s.member))),
    "window_prices": scene(lambda s: longs(metrics.prices(s.member))),
    "window_reserves": scene(lambda s: longs(metrics.reserves(s.member))),
    "window_liquidity": scene(lambda s: longs(metrics.liquidity(s.member))),
    "window_lifecycle_flags": scene(lambda s: metrics.lifecycle(s.windows, s.member)),
    "rule_results": scene(lambda s: s.rules(), once=True),
    "qualification_decisions": scene(lambda s: rules.decisions(s.rules()), once=True),
    "reject_reasons": scene(reasons("REJECT"), once=True),
    "unknown_reasons": scene(reasons("UNKNOWN"), once=True),
    "discovery_summary": scene(summary, once=True),
    "lifetime_activity": scene(lambda s: longs(projection.lifetime_activity(s.observations))),
    "token_state": scene(lambda s: s.stage(), once=True),
    "projection_counters": scene(counters, once=True),
    "snapshot_observe_all": scene(snapshot("OBSERVE_ALL"), once=True),
    "snapshot_qualified_only": scene(snapshot("QUALIFIED_ONLY"), once=True),
    "snapshot_approved_only": scene(snapshot("APPROVED_ONLY"), once=True),
    "live_markets": scene(lambda s: projection.live_markets(s.observations)),
    "retention_candidates": scene(lambda s: projection.retention_candidates(s.observations, s.member, s.gate(), CUTOFF_MS)),
    "settings_asof": scene(lambda s: lifecycle.settings_asof(s.windows, s.spark.createDataFrame(REVISIONS, "revision int, effective_ms long, minimum_trades int"))),
    "checkpoint_latest": lambda spark, sf_dir: lifecycle.checkpoints(positions(spark, sf_dir)),
    "gap_resolution": scene(lambda s: lifecycle.gap_resolution(s.gaps, s.observations.filter("kind = 'CREATE'"))),
    "flow_per_minute": scene(lambda s: lifecycle.flow(s.observations, FLOW_MS)),
    "network_check": scene(lambda s: lifecycle.network_check([s.observations, s.member, adapters.notifications(s.spark, s.sf_dir)])),
    "quarantine_summary": scene(lambda s: lifecycle.quarantine(s.observations)),
    "signature_claims": scene(claims),
    "pool_orientation": lambda spark, sf_dir: lifecycle.oriented(pools(spark, sf_dir), QUOTES),
    "risk_fold": scene(risk),
    "strategy_match": scene(lambda s: s.metrics().filter(rules.strategy(CONDITIONS)).select(*metrics.WINDOW), once=True),
    "ship_window_metrics": ship_metrics,
}
