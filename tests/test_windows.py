"""Literal cases of windows, members, metrics and rules."""

from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from windowmill.functions import exact, text
from windowmill.operators import lifecycle, metrics, projection, replay, rules, windows

COLUMNS = (
    "event_id long, network string, source string, slot long, transaction_index long, signature string, instruction_index int, event_index int, received_ms long, mint string, asset string, "
    "kind string, side string, wallet string, creator string, base decimal(20,0), quote decimal(20,0), base_reserve decimal(20,0), quote_reserve decimal(20,0)"
)
U64 = 2**64 - 1


def observed(spark, rows):
    """Rows of (received, kind, more) as observations of one market."""
    out = []
    for i, (received, kind, more) in enumerate(rows):
        row = dict(event_id=i, network="MAINNET", source="S", slot=more.pop("slot", i), transaction_index=None, signature=f"s{i}", instruction_index=0, event_index=0, received_ms=received, mint="m", asset="NATIVE", kind=kind, side=None, wallet=None, creator=None, base=None, quote=None, base_reserve=None, quote_reserve=None)
        out.append(tuple((row | more).values()))
    return spark.createDataFrame(_decimals(out), COLUMNS)


def _decimals(rows):
    from decimal import Decimal

    return [(*r[:15], *(None if x is None else Decimal(x) for x in r[15:])) for r in rows]


def trade(received, base, quote, wallet="a", side="BUY", **more):
    return received, "TRADE", dict(base=base, quote=quote, wallet=wallet, side=side) | more


def members(spark, rows, length):
    o = observed(spark, rows)
    w = windows.open_windows(o.filter("kind = 'CREATE'"), length)
    return w, windows.members(o, w, length, [c for c in o.columns if c != "mint"])


def test_window_is_half_open(spark):
    w, m = members(spark, [(100, "CREATE", {}), trade(99, 1, 1), trade(100, 1, 1), trade(199, 1, 1), trade(200, 1, 1)], 100)
    row = metrics.counts(w, m).first()
    assert (row.opened_ms, row.closes_ms, row.trades, row.observations) == (100, 200, 2, 3)


def test_openers_inside_a_window_do_not_extend_it(spark):
    w, _ = members(spark, [(1000, "CREATE", {}), (1200, "CREATE", {}), (1499, "CREATE", {}), (1500, "CREATE", {}), (1900, "CREATE", {})], 500)
    assert sorted((r.opened_ms, r.closes_ms) for r in w.collect()) == [(1000, 1500), (1500, 2000)]


def test_no_openers_give_no_window(spark):
    w, m = members(spark, [trade(5, 1, 1)], 10)
    assert w.count() == 0 and metrics.counts(w, m).count() == 0


def test_largest_wallet_and_creator_share(spark):
    w, m = members(spark, [(0, "CREATE", {"creator": "a"}), trade(1, 6, 60, "a"), trade(2, 2, 20, "a", "SELL"), trade(3, 2, 20, "b")], 100)
    row, made = metrics.counts(w, m).first(), metrics.creators(w, m).first()
    assert (row.top_wallet, row.top_quote, row.top_share_bps, row.traders, row.buyers, row.sellers) == ("a", 80, 8000, 2, 2, 1)
    assert (made.n_creators, made.creator_quote, made.creator_share_bps) == (1, 80, 8000)


def test_tied_wallets_give_the_smallest(spark):
    w, m = members(spark, [(0, "CREATE", {}), trade(1, 1, 5, "b"), trade(2, 1, 5, "B")], 100)
    assert metrics.counts(w, m).first().top_wallet == "B"


def test_prices(spark):
    _, m = members(spark, [(0, "CREATE", {}), trade(1, 3, 6), trade(2, 2, 8), trade(3, 10, 10)], 100)
    row = metrics.prices(m).first()
    assert [(row[f"{p}_quote"], row[f"{p}_base"]) for p in ("first", "high", "low", "last")] == [(6, 3), (8, 2), (10, 10), (10, 10)]
    assert row.price_change_bps == -5000


def test_prices_of_the_largest_amounts(spark):
    _, m = members(spark, [(0, "CREATE", {}), trade(1, U64, U64 - 1), trade(2, U64 - 1, U64), trade(3, U64, U64)], 100)
    row = metrics.prices(m).first()
    assert (row.low_quote, row.high_quote, row.price_change_bps) == (U64 - 1, U64, 0)


def test_unrepresentable_change_is_null(spark):
    _, m = members(spark, [(0, "CREATE", {}), trade(1, U64, 1), trade(2, 1, U64)], 100)
    assert metrics.prices(m).first().price_change_bps is None


def test_invalid_trade_stays_an_observation(spark):
    w, m = members(spark, [(0, "CREATE", {}), trade(1, 1, 5), trade(2, 1, 0)], 100)
    row = metrics.counts(w, m).first()
    no_gaps = spark.createDataFrame([], "source string, gap_ms long, gap_id long, reason string")
    assert (row.observations, row.trades) == (3, 1)
    assert windows.completeness(w, m, no_gaps, 100).first().reason == "INVALID_TRADE_AMOUNT"


def test_first_invalid_trade_and_gap_decide_the_reason(spark):
    w, m = members(spark, [(0, "CREATE", {}), trade(1, 0, 5, " \t"), trade(2, 1, 0)], 100)
    gaps = lambda *ms: spark.createDataFrame([("S", t, t, f"R{t}") for t in ms], "source string, gap_ms long, gap_id long, reason string")
    assert windows.completeness(w, m, gaps(100, 101), 100).first().reason == "INVALID_TRADE_WALLET"
    assert windows.completeness(w, m, gaps(99, 50), 100).first().reason == "R50"


def test_reserves_keep_the_earliest_extreme(spark):
    at = lambda ms, b, q: (ms, "LIQUIDITY_DEPOSIT", dict(base=1, quote=1, base_reserve=b, quote_reserve=q))
    _, m = members(spark, [(0, "CREATE", {}), at(1, 100, 300), at(2, 80, 320), at(3, 80, 320), at(4, None, 310)], 100)
    row = metrics.reserves(m).first()
    assert (row.samples, row.min_base_reserve, row.min_base_reserve_signature, row.max_quote_reserve, row.max_quote_reserve_signature, row.latest_base, row.latest_quote) == (4, 80, "s2", 320, "s2", None, 310)


def test_share_rounds_up_and_rejects(spark):
    row = spark.range(1).select(exact.share_bps(F.lit(9001).cast("decimal(20,0)"), F.lit(10001).cast("decimal(20,0)")).alias("x"), exact.share_bps(F.lit(0).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)")).alias("y")).first()
    assert (row.x, row.y) == (9001, None)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(1, U64), st.integers(1, U64)), min_size=2, max_size=12))
def test_ratio_keys_sort_as_fractions(spark, pairs):
    df = spark.createDataFrame([(i, str(a), str(b)) for i, (a, b) in enumerate(pairs)], "i int, a string, b string").select("i", F.col("a").cast("decimal(20,0)").alias("a"), F.col("b").cast("decimal(20,0)").alias("b"))
    order = [r.i for r in df.orderBy(exact.ratio_key(F.col("a"), F.col("b")), "i").collect()]
    assert order == sorted(range(len(pairs)), key=lambda i: (Fraction(*pairs[i]), i))


@pytest.mark.parametrize(("a", "b", "g"), [(12, 18, 6), (U64, 5, 5), (7, 0, 7), (U64 - 1, U64, 1)])
def test_gcd(spark, a, b, g):
    assert int(spark.range(1).select(exact.gcd(F.lit(str(a)).cast("decimal(20,0)"), F.lit(str(b)).cast("decimal(20,0)"))).first()[0]) == g


def test_policy_bounds():
    assert rules.Policy().violation() is None
    assert rules.Policy(minimum_unique_traders=6).violation() == "minimum_unique_traders"
    assert rules.Policy(maximum_wallet_share_bps=999).violation() == "maximum_wallet_share_bps" and rules.Policy(maximum_wallet_share_bps=999).violation(strict=False) is None
    assert rules.Prefilter(request_timeout_ms=20_000).violation() == "request_timeout_ms"
    assert rules.Prefilter(observation_window_ms=4_000).violation() == "observation_window_ms"


def test_incomplete_window_is_unknown_on_every_rule(spark):
    w, m = members(spark, [(0, "CREATE", {}), trade(1, 1, 0)], 100)
    no_gaps = spark.createDataFrame([], "source string, gap_ms long, gap_id long, reason string")
    found = rules.rule_rows(metrics.counts(windows.completeness(w, m, no_gaps, 100), m), rules.Policy()).collect()
    assert len(found) == 8 and {(r.decision, r.reason_code) for r in found} == {("UNKNOWN", "INVALID_TRADE_AMOUNT")}


def test_thresholds_are_inclusive(spark):
    rows = [(0, "CREATE", {}), trade(1, 1, 90, "a"), trade(2, 1, 5, "b"), trade(3, 1, 5, "c", "SELL")]
    w, m = members(spark, rows, 100)
    policy = rules.Policy(minimum_trades=3, minimum_unique_traders=3, minimum_native_quote_units=100, maximum_wallet_share_bps=9000)
    found = metrics.counts(w.withColumn("reason", F.lit(None).cast("string")), m)
    assert rules.decisions(rules.rule_rows(found, policy)).first().decision == "PASS"
    strict = rules.Policy(minimum_trades=3, minimum_unique_traders=3, minimum_native_quote_units=101, maximum_wallet_share_bps=8999)
    assert rules.decisions(rules.rule_rows(found, strict)).first().reasons == "QUOTE_VOLUME_BELOW_MINIMUM,WALLET_CONCENTRATION_EXCEEDS_LIMIT"


def test_fold_of_nothing_is_unknown(spark):
    assert spark.createDataFrame([], "decision string").agg(rules.fold("decision")).first()[0] == "UNKNOWN"


def test_strategy_operators(spark):
    df = spark.createDataFrame([(5, "x"), (6, None)], "n int, s string")
    assert df.filter(rules.strategy([("n", "GTE", 5), ("s", "IN", ["x"])])).count() == 1
    with pytest.raises(ValueError):
        rules.strategy([("n", "LIKE", 1)])


def test_replays(spark):
    o = observed(spark, [trade(100, 1, 1), trade(200, 1, 1)]).withColumns({"evidence": F.lit("h"), "arrival": F.col("event_id")})
    early = o.filter("event_id = 0").withColumns({"arrival": F.lit(5).cast("long"), "received_ms": F.lit(50).cast("long"), "transaction_index": F.lit(3).cast("long")})
    changed = o.filter("event_id = 1").withColumns({"arrival": F.lit(6).cast("long"), "evidence": F.lit("other")})
    kept = replay.deduplicated(o.unionByName(early)).orderBy("signature").collect()
    assert [(r.signature, r.received_ms, r.copies) for r in kept] == [("s0", 50, 2), ("s1", 200, 1)]
    assert [(r.signature, r.conflict_kind) for r in replay.conflicts(o.unionByName(changed)).collect()] == [("s1", "CONTENT")]


def test_checkpoint_is_monotonic(spark):
    df = spark.createDataFrame([("a", 5, 4, 1), ("a", 5, 3, 2), ("a", 5, 5, 3), ("a", 4, 9, 4), ("b", 5, None, 1), ("b", 5, 7, 2)], "source string, slot long, transaction_index long, arrival long")
    assert sorted(map(tuple, lifecycle.checkpoints(df).collect())) == [("a", 5, 5), ("b", 5, None)]


def test_stale_creation_fills_the_name_only(spark):
    o = observed(spark, [trade(1, 9, 1, slot=60), (2, "CREATE", {"slot": 50})]).withColumn("name", F.when(F.col("kind") == "CREATE", "n"))
    row = projection.token_state(o).first()
    assert (row.name, row.latest_slot, row.latest_signature, row.last_observed_ms, row.metadata) == ("n", 60, "s0", 1, "ENRICHED_FROM_STALE_CREATION")


def test_snapshot_limits(spark):
    stage = spark.createDataFrame([("a", 1, "OBSERVED"), ("b", 1, "OBSERVED")], "mint string, latest_slot long, stage string")
    assert [r.mint for r in projection.snapshot(stage, "OBSERVE_ALL", 1).collect()] == ["a"]
    with pytest.raises(ValueError):
        projection.snapshot(stage, "OBSERVE_ALL", 0)


def test_text(spark):
    df = spark.createDataFrame([("\t a  ",), (" ",), (None,)], "x string")
    assert [tuple(r) for r in df.select(text.blank(F.col("x")), text.trimmed(F.col("x"))).collect()] == [(False, "a"), (True, None), (True, None)]


def test_evidence_limits(spark):
    df = spark.createDataFrame([("aGk=", "C", "d"), ("!", "C", "d"), ("aGk=", " ", "d"), ("aGk=", "C", "d" * 2049)], "e string, c string, d string")
    assert [r[0] for r in df.select(lifecycle.evidence_violation(F.col("e"), F.col("c"), F.col("d"))).collect()] == [None, "evidence_base64", "reason_code", "reason_detail"]
