"""The fold of tokens: literal merges, and any cut against one loop."""

import random

import pytest

from windowmill.operators import tokens
from windowmill.operators.tokens import Event

SCHEMA = "mint string, at_ms long, ordinal long, action string, slot long, market string, window_ms long, decision string, kind string, name string"


def frame(spark, events):
    return spark.createDataFrame([(m, e.at_ms, e.ordinal, e.action, e.slot, e.market, e.window_ms, e.decision, e.kind, e.name) for m, e in events], SCHEMA)


def result(df):
    rows = df.collect()
    ended = {r.mint: (r.market, r.stage, r.window_ms, r.activity_window_ms, r.first_ms, r.last_ms, r.name) for r in rows if r.what == "TOKEN"}
    return {r.ordinal: r.outcome for r in rows if r.what == "OUTCOME"}, ended


def expected(events):
    outcomes, found = tokens.plain(events)
    return outcomes, {m: (t.market, t.stage, t.window_ms, t.activity_window_ms, t.first_ms, t.last_ms, t.given or t.filled) for m, t in found.items()}


def observe(at, slot, market="A", window=None, kind="TRADE", name=None):
    return Event(at, at, "OBSERVE", slot, market, window, None, kind, name)


def final(at, window, decision="PASS", market="A"):
    return Event(at, at, "FINALIZE", 0, market, window, decision, None, None)


def approve(at, market="A"):
    return Event(at, at, "APPROVE", 0, market, None, None, None, None)


def remove(at):
    return Event(at, at, "REMOVE", 0, None, None, None, None, None)


CASES = {
    "a pass of the window that holds the last observation qualifies": ([observe(1, 1, window=1), final(2, 1)], ["INSERTED", "FINALIZED_QUALIFIED"], "QUALIFIED"),
    "another window does not": ([observe(1, 1, window=7), final(2, 1)], ["INSERTED", "NOT_CURRENT"], "OBSERVED"),
    "nor does one with a newer beside it": ([observe(1, 1, window=1), final(2, 1, None)], ["INSERTED", "NOT_CURRENT"], "OBSERVED"),
    "a pass of market A says nothing for market B": ([observe(1, 1, "B", 1), final(2, 1)], ["INSERTED", "MARKET_MISMATCH"], "OBSERVED"),
    "a change of a market that never passed is an update": ([observe(1, 1, "B"), observe(2, 2, "A")], ["INSERTED", "UPDATED"], "OBSERVED"),
    "a change after a pass demotes": ([observe(1, 1, window=1), final(2, 1), observe(3, 3, "B")], ["INSERTED", "FINALIZED_QUALIFIED", "DEMOTED_BY_MARKET_CHANGE"], "OBSERVED"),
    "the same market keeps its stage": ([observe(1, 1, window=1), final(2, 1), observe(3, 3)], ["INSERTED", "FINALIZED_QUALIFIED", "UPDATED"], "QUALIFIED"),
    "an equal slot is not stale": ([observe(1, 5), observe(2, 5, "B")], ["INSERTED", "UPDATED"], "OBSERVED"),
    "a stale row takes nothing over": ([observe(1, 5), observe(2, 4, "B")], ["INSERTED", "STALE_OBSERVATION_IGNORED"], "OBSERVED"),
    "an approval needs a qualified token": ([observe(1, 1), approve(2)], ["INSERTED", "CANDIDATE_NOT_QUALIFIED"], "OBSERVED"),
    "of its market": ([observe(1, 1, window=1), final(2, 1), approve(3, "B"), approve(4)], ["INSERTED", "FINALIZED_QUALIFIED", "MARKET_MISMATCH", "APPROVED"], "APPROVED"),
    "a further pass leaves approved": ([observe(1, 1, window=1), final(2, 1), approve(3), final(4, 1)], ["INSERTED", "FINALIZED_QUALIFIED", "APPROVED", "FINALIZED_APPROVED"], "APPROVED"),
    "a rejection takes the approval": ([observe(1, 1, window=1), final(2, 1), approve(3), final(4, 1, "REJECT")], ["INSERTED", "FINALIZED_QUALIFIED", "APPROVED", "FINALIZED_OBSERVED"], "OBSERVED"),
    "what is removed starts anew, at any slot": ([observe(1, 9, window=1), final(2, 1), remove(3), approve(4), observe(5, 1)], ["INSERTED", "FINALIZED_QUALIFIED", "REMOVED", "NO_TOKEN", "INSERTED"], "OBSERVED"),
}


@pytest.mark.parametrize("name", CASES)
def test_merges(name):
    events, outcomes, stage = CASES[name]
    got, found = tokens.plain([("m", e) for e in events])
    assert [got[e.ordinal] for e in events] == outcomes and found["m"].stage == stage


def test_names_and_activity():
    got, found = tokens.plain([("m", e) for e in (observe(1, 5), observe(2, 4, kind="CREATE", name="old"), observe(3, 3, kind="CREATE", name="older"))])
    assert list(got.values())[1:] == ["METADATA_ENRICHED_FROM_STALE_CREATION", "STALE_OBSERVATION_IGNORED"] and (found["m"].given or found["m"].filled) == "old"
    run = lambda *events: tokens.plain([("m", e) for e in events])[1]["m"].activity_window_ms
    assert run(observe(1, 5, window=1), final(2, 1)) == 1
    assert run(observe(1, 5, window=1), final(2, 1), observe(3, 4)) is None  # even a stale row of the market counts in its life
    assert run(observe(1, 5, window=1), final(2, 1), observe(3, 4, "B")) == 1


def crowd(seed, n=1200, mints=4):
    pick = random.Random(seed)
    out = []
    for at in range(n):
        mint = "hot" if pick.random() < 0.8 else f"m{pick.randrange(mints)}"
        kind, market, window = pick.random(), pick.choice("AAAB"), pick.choice([None, 1, 1, 2])
        if kind < 0.45:
            e = observe(at, pick.choice([at, at, at - 40, 3]), market, window, pick.choice(["TRADE", "CREATE"]), None)
            e = Event(*[*vars(e).values()][:8], f"n{at}" if e.kind == "CREATE" and pick.random() < 0.5 else None)
        else:
            e = final(at, window or 1, pick.choice(["PASS", "PASS", "REJECT", None]), market) if kind < 0.75 else approve(at, market) if kind < 0.985 else remove(at)
        out.append((mint, e))
    return out


@pytest.mark.parametrize(("seed", "parts"), [(1, 1), (2, 7), (3, 40)])
def test_any_cut_equals_one_loop(spark, seed, parts):
    events = crowd(seed)
    assert result(tokens.projected(frame(spark, events), parts)) == expected(events)


@pytest.mark.parametrize("seed", range(30))
def test_effects_compose(seed):
    pick = random.Random(seed)
    events = [e for _, e in crowd(seed, 60, 1)]
    token, slots = None, tokens.Slots()
    at = 0
    while at < len(events):
        to = at + pick.randrange(1, 15)
        effect, inner = tokens.Effect(), tokens.Slots(slots.top)
        alone, direct, seen = tokens.Slots(), token, tokens.Slots(slots.top)
        for e in events[at:to]:
            effect.feed(e, inner.stale(e))
            alone.stale(e)
            direct, _ = tokens.step(direct, e, seen.stale(e))
        token = effect.apply(token)
        assert token == direct and alone.after(slots.top) == seen.top
        slots, at = seen, to


def test_no_events(spark):
    assert tokens.projected(frame(spark, [])).count() == 0
    assert tokens.projected(frame(spark, [(None, observe(1, 1))])).count() == 0
