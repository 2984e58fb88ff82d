"""The registry of windows: races by literal events, slices against one fold, states against a plain version."""

import random

import pytest

from windowmill.operators import registry

SCHEMA = "at_ms long, ordinal long, action string, reach string, mint string, source string, asset string, opener string, reason string"
LENGTH = 100


def opened(at, mint, source="S", confirm=0):
    """An opener and, unless confirm is None, its confirmation so much later."""
    both = [(at, "OPEN", "window", mint, source, f"{mint}@{at}", None)]
    return both if confirm is None else [*both, (at + confirm, "CONFIRM", "window", mint, source, f"{mint}@{at}", None)]


def cause(at, reason, mint=None, source=None):
    reach, action = registry.CAUSES[reason]
    return [(at, action, reach, mint, source, None, reason)]


def frame(spark, *groups):
    rows = sorted((e for g in groups for e in g), key=lambda e: e[0])
    return spark.createDataFrame([(at, n, action, reach, mint, source, "NATIVE", opener, reason) for n, (at, action, reach, mint, source, opener, reason) in enumerate(rows)], SCHEMA)


def found(df):
    return {r.opener: (r.status, r.reason, r.left_ms) for r in df.collect()}


def states(spark, progress, *groups):
    events = frame(spark, *groups)
    seen = spark.createDataFrame(progress, "source string, at_ms long")
    return {r.opener: (r.status, r.reason, r.claimed_ms) for r in registry.settled(registry.registry(events, LENGTH, 8), events, seen, 50).collect()}


def test_an_evicted_market_reopens_inside_its_old_window(spark):
    events = frame(spark, opened(0, "a"), opened(10, "b"), opened(20, "a"))
    assert found(registry.registry(events, LENGTH, 1)) == {
        "a@0": ("CANCELLED_CONFIRMED", "CAPACITY_EVICTED", 10), "b@10": ("CANCELLED_CONFIRMED", "CAPACITY_EVICTED", 20), "a@20": ("OPEN", None, None),
    }
    assert {(r.mint, r.opened_ms, r.evicted_ms) for r in registry.evicted(events, LENGTH, 1).collect()} == {("a", 0, 10), ("b", 10, 20), ("a", 20, None)}


def test_the_smallest_market_goes_where_several_close_first(spark):
    events = frame(spark, opened(0, "c"), opened(0, "b"), opened(5, "a"), opened(9, "d"))
    assert {o for o, x in found(registry.registry(events, LENGTH, 3)).items() if x[1] == "CAPACITY_EVICTED"} == {"b@0"}


def test_windows_are_half_open_and_do_not_extend(spark):
    events = frame(spark, opened(0, "a"), opened(50, "a"), opened(99, "a"), opened(100, "a"))
    assert found(registry.registry(events, LENGTH, 8)) == {"a@0": ("CONFIRMED", None, 100), "a@100": ("OPEN", None, None)}


def test_a_pending_window_that_ends_has_no_reason_and_frees_its_market(spark):
    failed = [(20, "FAIL", "window", "f", "S", "f@0", None)]
    events = frame(spark, opened(0, "p", confirm=None), cause(10, "STREAM_STOPPED"), opened(20, "p"), opened(0, "f", confirm=None), opened(15, "f", confirm=None), failed, opened(0, "q", confirm=30))
    got = found(registry.registry(events, LENGTH, 8))
    assert got["p@0"] == ("CANCELLED_PENDING", None, 10) and got["p@20"] == ("OPEN", None, None)
    assert got["f@0"] == ("CANCELLED_PENDING", None, 10) and got["q@0"] == ("CANCELLED_PENDING", None, 10)


def test_a_late_confirmation_of_a_closed_window_is_in_vain(spark):
    events = frame(spark, opened(0, "a", confirm=120), opened(150, "b"))
    assert found(registry.registry(events, LENGTH, 8))["a@0"] == ("DISCARDED", None, 100)


def test_the_first_cause_stays(spark):
    got = states(spark, [("S", 999)], opened(0, "a"), cause(10, "DECODE_GAP", source="S"), cause(90, "SOURCE_DISCONNECTED", source="S"))
    assert got["a@0"] == ("CANCELLED_CONFIRMED", "DECODE_GAP", 90)
    got = states(spark, [("S", 999)], opened(0, "a"), cause(10, "PROCESSING_FAILED", mint="a"), cause(20, "CPI_INSTRUCTION_DATA_UNAVAILABLE", source="S"))
    assert got["a@0"] == ("OPEN", None, None)  # marks let a window be
    got = states(spark, [("S", 999)], opened(0, "a"), cause(10, "PROCESSING_FAILED", mint="a"), cause(20, "DECODE_GAP", source="S"), opened(200, "b"))
    assert got["a@0"] == ("CONFIRMED", "PROCESSING_FAILED", 100)


def test_a_gap_before_the_confirmation_counts_once_confirmed(spark):
    got = states(spark, [("S", 999)], opened(0, "a", confirm=50), cause(10, "DECODE_GAP", source="S"), opened(200, "b"))
    assert got["a@0"] == ("CONFIRMED", "DECODE_GAP", 100)


def test_an_outage_reaches_its_source_alone(spark):
    got = states(spark, [("S", 999), ("T", 999)], opened(0, "a"), opened(0, "b", "T"), cause(50, "SOURCE_DISCONNECTED", source="S"), opened(500, "z", "T"))
    assert got["a@0"] == ("CANCELLED_CONFIRMED", "SOURCE_DISCONNECTED", 50) and got["b@0"] == ("CONFIRMED", None, 999)


@pytest.mark.parametrize(
    ("progress", "stop", "expected"),
    [
        ([("S", 100)], 101, ("CONFIRMED", None, 100)),  # the claim won
        ([("S", 130)], 120, ("CANCELLED_CONFIRMED", "STREAM_STOPPED", 120)),  # closed, not yet final
        ([("S", 130)], 130, ("CANCELLED_CONFIRMED", "STREAM_STOPPED", 130)),
        ([("S", 99)], 500, ("CANCELLED_CONFIRMED", "STREAM_STOPPED", 500)),  # no progress since the close
        ([("S", 99)], 50, ("CANCELLED_CONFIRMED", "STREAM_STOPPED", 50)),
        ([("T", 130)], 2000, ("CANCELLED_CONFIRMED", "STREAM_STOPPED", 2000)),  # another source's progress is none
    ],
)
def test_close_stop_and_claim_race(spark, progress, stop, expected):
    assert states(spark, progress, opened(0, "a"), opened(110, "b"), cause(stop, "STREAM_STOPPED"))["a@0"] == expected


def test_without_progress_nothing_is_claimed(spark):
    assert states(spark, [("S", 99)], opened(0, "a"), opened(150, "b"))["a@0"] == ("CONFIRMED", None, None)


def test_runs(spark):
    events = frame(spark, opened(0, "a"), cause(10, "PIPELINE_RESTARTED"), opened(10, "b"), opened(11, "c"), cause(30, "PIPELINE_RESTARTED"), opened(40, "a"))
    assert {r.opener: r.run for r in registry.runs(registry.registry(events, LENGTH, 8), events, 7).collect()} == {"a@0": 0, "b@10": 0, "c@11": 1, "a@40": 2}


def crowd(spark, n=1500, seed=1):
    pick = random.Random(seed)
    groups = []
    for _ in range(n):
        at, mint = pick.randrange(6000), f"m{pick.randrange(40)}"
        kind = pick.random()
        if kind < 0.7:
            groups.append(opened(at, mint, f"S{int(mint[1:]) % 5}", pick.choice([None, 0, 3, 30, 150])))
        else:
            reason = pick.choice([r for r in registry.CAUSES if kind < 0.99 and registry.CAUSES[r][0] != "all" or kind >= 0.99 and registry.CAUSES[r][0] == "all"])
            groups.append(cause(at, reason, mint, f"S{pick.randrange(5)}"))
    return frame(spark, *groups)


@pytest.mark.parametrize("rows", [1000, 250])
def test_slices_equal_one_fold(spark, rows):
    events = crowd(spark)
    whole = registry.registry(events, LENGTH, 10)
    sliced = registry.registry(events, LENGTH, 10, rows)
    assert sorted(map(str, whole.collect())) == sorted(map(str, sliced.collect())) and whole.count() > 100


def test_no_events(spark):
    events = frame(spark)
    empty = registry.registry(events, LENGTH, 3)
    assert empty.count() == 0
    assert registry.runs(registry.settled(empty, events, spark.createDataFrame([], "source string, at_ms long")), events).count() == 0
    nameless = spark.createDataFrame([(1, 1, "OPEN", "window", None, "S", "NATIVE", "x", None), (None, 2, "OPEN", "window", "a", "S", "NATIVE", "y", None)], SCHEMA)
    assert registry.registry(nameless, LENGTH, 3).count() == 0


POSITIONS = "event_id long, slot long, transaction_index long, signature string, kind string, program string, instruction_index int, event_index int, mint string, quote_mint string, base long, quote long"


def matched(spark, rows):
    from windowmill.operators import intake

    df = spark.createDataFrame([(n, slot, tx, f"s{slot}-{tx}", kind, "PUMP", i, e, "m", "Q", 1, 1) for n, (slot, tx, kind, i, e) in enumerate(rows)], POSITIONS)
    return {r.event_id: (r.quarantine_reason, r.registered_slot) for r in intake.registered(df).collect()}


def test_a_trade_finds_the_market_that_its_own_transaction_creates(spark):
    got = matched(spark, [(5, 1, "TRADE", 0, 0), (5, 1, "CREATE", 3, 0), (5, 1, "TRADE", 3, 1), (5, 0, "TRADE", 9, 0), (4, 9, "TRADE", 0, 0), (5, None, "TRADE", 0, 0), (6, None, "TRADE", 0, 0)])
    assert got == {0: (None, 5), 2: (None, 5), 3: ("UNRESOLVED_MARKET", None), 4: ("UNRESOLVED_MARKET", None), 5: ("UNRESOLVED_MARKET", None), 6: (None, 5)}


def test_a_market_takes_what_completes_it_and_nothing_after(spark):
    rows = [(1, 0, "CREATE", 0, 0), (2, 0, "TRADE", 0, 0), (2, 0, "COMPLETE", 0, 1), (2, 0, "TRADE", 0, 2), (3, 0, "MIGRATION", 0, 0), (4, 0, "CREATE", 1, 0), (4, 0, "TRADE", 0, 0)]
    assert matched(spark, rows) == {1: (None, 1), 2: (None, 1), 3: ("UNRESOLVED_MARKET", None), 4: ("UNRESOLVED_MARKET", None), 6: (None, 4)}


@pytest.mark.parametrize("strict", [True, False])
def test_position_asof_splits_a_hot_key(spark, strict):
    from windowmill.operators.asof import asof_position

    pick = random.Random(3)
    left = [("hot" if pick.random() < 0.9 else f"k{pick.randrange(9)}", pick.choice([None, *range(40)]), pick.randrange(5), n) for n in range(3000)]
    right = [("hot" if pick.random() < 0.9 else f"k{pick.randrange(9)}", pick.choice([None, *range(40)]), pick.randrange(5), n) for n in range(300)]
    l, r = spark.createDataFrame(left, "k string, a int, b int, n int"), spark.createDataFrame(right, "k string, a int, b int, v int")  # noqa: E741
    key = lambda a, b: (a is not None, a or 0, b)
    got = {x.n: x.v for x in asof_position(l, r, ["k"], ["a", "b"], "v", strict).collect()}
    for k, a, b, n in left:
        before = [(key(x, y), v) for j, x, y, v in right if j == k and (key(x, y) < key(a, b) or not strict and key(x, y) == key(a, b))]
        assert got[n] == (max(before)[1] if before else None)
