"""The projection of tokens as one fold per mint that is cut anywhere.

Events, in the order (at_ms, ordinal): OBSERVE (slot, market, window_ms of the window that
holds it or NULL, kind, name), FINALIZE (window_ms, market, decision; NULL if a newer
window was there), APPROVE (market), REMOVE.

* The first observation inserts a token. One of a lower slot than before is stale: a stale
  creation may name a nameless token. Any other takes the token over; the stage stays if
  the market does.
* A finalized window decides the stage if the token's last observation belongs to it: a
  pass qualifies, or leaves approved what is; else the token is observed again. The
  window's activity then stands for the token's until the market is observed again.
* An approval needs a qualified token of the same market. A removal ends the token.

Events are range-partitioned by mint and order, so a mint that holds most events lies in
several parts. What a part does to the token that enters it is summed up in a few fields
whatever it holds, these are applied from part to part, and then all parts are folded at
once from what enters them. One small row per part comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windowmill.functions.arrow import listed
from windowmill.operators.storage import checkpointed

EVENTS = ["mint", "at_ms", "ordinal", "action", "slot", "market", "window_ms", "decision", "kind", "name"]
SCHEMA = "what string, mint string, ordinal long, outcome string, market string, stage string, window_ms long, activity_window_ms long, latest_slot long, first_ms long, last_ms long, name string"
_FIELDS = [c.split() for c in SCHEMA.split(", ")]
_KINDS = {"string": pa.string(), "long": pa.int64()}
STAGES = ("OBSERVED", "QUALIFIED", "APPROVED")


@dataclass(frozen=True)
class Token:
    market: str | None
    stage: str = "OBSERVED"
    window_ms: int | None = None
    activity_window_ms: int | None = None
    first_ms: int | None = None
    last_ms: int | None = None
    given: str | None = None  # the last name of a current observation
    filled: str | None = None  # or else the first of a stale creation


@dataclass(frozen=True)
class Event:
    at_ms: int
    ordinal: int
    action: str
    slot: int
    market: str | None
    window_ms: int | None
    decision: str | None
    kind: str | None
    name: str | None


def step(token: Token | None, e: Event, stale: bool) -> tuple[Token | None, str]:
    """The token after an event, and what the event did."""
    if e.action == "OBSERVE":
        if token is None:
            return Token(e.market, "OBSERVED", e.window_ms, None, e.at_ms, e.at_ms, e.name), "INSERTED"
        if stale:
            out, outcome = token, "STALE_OBSERVATION_IGNORED"
            if e.kind == "CREATE" and e.name and not (token.given or token.filled):
                out, outcome = replace(token, filled=e.name), "METADATA_ENRICHED_FROM_STALE_CREATION"
            return (replace(out, activity_window_ms=None) if token.market == e.market else out), outcome
        same = token.market == e.market
        demoted = not same and token.stage != "OBSERVED"
        first, last = (f(x for x in (own, e.at_ms) if x is not None) for f, own in ((min, token.first_ms), (max, token.last_ms)))
        given = e.name or token.given
        taken = Token(e.market, token.stage if same else "OBSERVED", e.window_ms, None, first, last, given, None if given else token.filled)
        return taken, "DEMOTED_BY_MARKET_CHANGE" if demoted else "UPDATED"
    if token is None:
        return None, "NO_TOKEN"
    if e.action == "FINALIZE":
        if e.decision is None or token.window_ms is None or token.window_ms != e.window_ms:
            return token, "NOT_CURRENT"
        if token.market != e.market:
            return token, "MARKET_MISMATCH"
        stage = ("APPROVED" if token.stage == "APPROVED" else "QUALIFIED") if e.decision == "PASS" else "OBSERVED"
        return replace(token, stage=stage, activity_window_ms=e.window_ms), f"FINALIZED_{stage}"
    if e.action == "APPROVE":
        if token.market != e.market:
            return token, "MARKET_MISMATCH"
        return (token, "CANDIDATE_NOT_QUALIFIED") if token.stage == "OBSERVED" else (replace(token, stage="APPROVED"), "APPROVED")
    return None, "REMOVED"


class Slots:
    """The highest slot of the life of a token, and whether a removal began that life here."""

    def __init__(self, top: int | None = None):
        self.top, self.removed = top, False

    def stale(self, e: Event) -> bool:
        if e.action == "REMOVE":
            self.top, self.removed = None, True
        if e.action != "OBSERVE":
            return False
        stale = self.top is not None and e.slot < self.top
        self.top = e.slot if self.top is None else max(self.top, e.slot)
        return stale

    def after(self, top: int | None) -> int | None:
        return self.top if self.removed or top is None else top if self.top is None else max(top, self.top)


@dataclass
class Effect:
    """What a run of events does to any token: those before its first observation or removal, once each, and what then is, by the stage before."""

    pending: list = field(default_factory=list)
    anchor: Event | None = None
    then: dict = field(default_factory=dict)
    same_life: bool = True

    def feed(self, e: Event, stale: bool) -> None:
        if self.anchor is None and (stale or e.action in ("FINALIZE", "APPROVE")):
            self._wait(replace(e, at_ms=0, ordinal=0, slot=0), stale)
            return
        if self.anchor is None:
            self.anchor = e
            self.then = {s: Token(e.market, s) for s in STAGES} | {None: None}
        self.same_life &= e.action != "REMOVE"
        self.then = {s: step(t, e, stale)[0] for s, t in self.then.items()}

    def _wait(self, e: Event, stale: bool) -> None:
        """Keep what may matter: of stale observations the market, once between others, and the first name."""
        if stale:
            names = e.kind == "CREATE" and e.name and not any(x.name for x, _ in self.pending)
            e = replace(e, window_ms=None, decision=None, kind="CREATE" if names else None, name=e.name if names else None)
            since = next((i for i in range(len(self.pending), 0, -1) if not self.pending[i - 1][1]), 0)
            if not names and any(x.market == e.market for x, _ in self.pending[since:]):
                return
        elif self.pending and self.pending[-1] == (e, stale):
            return
        self.pending.append((e, stale))

    def apply(self, token: Token | None) -> Token | None:
        for e, stale in self.pending:
            token, _ = step(token, e, stale)
        if self.anchor is None:
            return token
        if token is None:
            return self.then[None]
        out = self.then[token.stage if token.market == self.anchor.market else "OBSERVED"]
        if out is None or not self.same_life:
            return out
        least, most = ([x for x in pair if x is not None] for pair in ((token.first_ms, out.first_ms), (token.last_ms, out.last_ms)))
        given = out.given or token.given
        return replace(out, first_ms=min(least, default=None), last_ms=max(most, default=None), given=given, filled=None if given else token.filled or out.filled)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, list[Event]]]:
    """The events of each mint of each batch, in order; a mint may come in several."""
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch[c].to_pylist() for c in ("mint", *EVENTS[1:])]
        mints, rows, part = columns[0], list(zip(*columns[1:], strict=True)), batch["_part"][0].as_py()
        cuts = [0, *(i for i in range(1, len(mints)) if mints[i] != mints[i - 1]), len(mints)]
        for a, b in zip(cuts, cuts[1:]):
            yield part, mints[a], [Event(*r) for r in rows[a:b]]


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of batches sorted by mint the rows of the last mint of each, and the very first row."""
    begun = False
    for batch in batches:
        if len(batch):
            at = pc.index(batch["mint"], batch["mint"][-1]).as_py()
            if at and not begun:
                yield batch.slice(0, 1)
            begun = True
            yield batch.slice(at)


def _summed(tops: dict[int, int | None] | None):
    """A part to one row: its first and last mint, and what it does to the last one; to the highest slot if ``tops`` is None, else to the token.

    A batch that ends with another mint ends what came before, so only the rows of its last mint are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        part = first = last = None
        slots, effect = Slots(), Effect()
        for part, mint, events in _runs(_ends(batches)):
            if mint != last:
                slots = Slots((tops or {}).get(part) if first is None else None)
                first, last, effect = first if first is not None else mint, mint, Effect()
            for e in events:
                stale = slots.stale(e)
                if tops is not None:
                    effect.feed(e, stale)
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first]), pa.array([last]), pa.array([pickle.dumps(slots if tops is None else effect)], pa.binary())], ["part", "first", "last", "does"])

    return run


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted part to its first and last mint."""
    part = first = last = None
    for batch in batches:
        if len(batch):
            part, last = batch["_part"][0].as_py(), batch["mint"][-1].as_py()
            first = batch["mint"][0].as_py() if first is None else first
    if part is not None:
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "first": [first], "last": [last]})


def _folded(tops: dict[int, int | None], entering: dict[int, Token | None], going_on: frozenset[int], outcomes: bool = True):
    """Events to an OUTCOME each, if they are asked for, and to a TOKEN for each mint that ends in the part with one.

    The same as ``step`` and ``Slots``, on the values of the one token that is held instead of an object per event.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = last = held = None
        market = stage = window = activity = first = most = given = filled = top = None
        row = lambda: ("TOKEN", last, None, None, market, stage, window, activity, top, first, most, given or filled)
        for batch in batches:
            if not len(batch):
                continue
            ended, did = [], []
            columns = [listed(batch[c]) for c in EVENTS]
            for mint, at, _, action, slot, e_market, e_window, decision, kind, name in zip(*columns, strict=True):
                if mint != last:
                    if held:
                        ended.append(row())
                    held = top = None
                    if part is None:
                        part = batch["_part"][0].as_py()
                        top = tops.get(part)
                        if held := entering.get(part):
                            market, stage, window, activity, first, most, given, filled = held.market, held.stage, held.window_ms, held.activity_window_ms, held.first_ms, held.last_ms, held.given, held.filled
                    last = mint
                if action == "OBSERVE":
                    stale = top is not None and slot < top
                    if top is None or slot > top:
                        top = slot
                    if not held:
                        held, market, stage, window, activity, first, most, given, filled = True, e_market, "OBSERVED", e_window, None, at, at, name, None
                        outcome = "INSERTED"
                    elif stale:
                        outcome = "STALE_OBSERVATION_IGNORED"
                        if kind == "CREATE" and name and not (given or filled):
                            filled, outcome = name, "METADATA_ENRICHED_FROM_STALE_CREATION"
                        if market == e_market:
                            activity = None
                    else:
                        outcome = "UPDATED"
                        if market != e_market:
                            outcome = "UPDATED" if stage == "OBSERVED" else "DEMOTED_BY_MARKET_CHANGE"
                            market, stage = e_market, "OBSERVED"
                        window, activity = e_window, None
                        if at is not None:
                            first = at if first is None or at < first else first
                            most = at if most is None or at > most else most
                        given = name or given
                        filled = None if given else filled
                elif action == "REMOVE":
                    outcome = "REMOVED" if held else "NO_TOKEN"
                    held = top = None
                elif not held:
                    outcome = "NO_TOKEN"
                elif action == "FINALIZE":
                    if decision is None or window is None or window != e_window:
                        outcome = "NOT_CURRENT"
                    elif market != e_market:
                        outcome = "MARKET_MISMATCH"
                    else:
                        stage = ("APPROVED" if stage == "APPROVED" else "QUALIFIED") if decision == "PASS" else "OBSERVED"
                        activity, outcome = e_window, f"FINALIZED_{stage}"
                elif market != e_market:
                    outcome = "MARKET_MISMATCH"
                elif stage == "OBSERVED":
                    outcome = "CANDIDATE_NOT_QUALIFIED"
                else:
                    stage = outcome = "APPROVED"
                if outcomes:
                    did.append(outcome)
            if ended:
                yield _batch(ended)
            if outcomes:
                filled_in = {"what": pa.repeat("OUTCOME", len(did)), "mint": batch["mint"], "ordinal": batch["ordinal"], "outcome": pa.array(did, pa.string())}
                yield pa.RecordBatch.from_arrays([filled_in[n] if n in filled_in else pa.nulls(len(did), _KINDS[k]) for n, k in _FIELDS], [n for n, _ in _FIELDS])
        if held and part not in going_on:
            yield _batch([row()])

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(zip(*rows, strict=True), _FIELDS, strict=True)], [n for n, _ in _FIELDS])


def projected(events: DataFrame, parts: int | None = None, outcomes: bool = True) -> DataFrame:
    """Rows of SCHEMA: an OUTCOME per event, unless ``outcomes`` is false, and a TOKEN per mint that has one after its last event.

    Events of a null mint do nothing and have no row. Order within a mint must be total.
    Only the events of a mint that goes on in the next part are read for what they do.
    """
    import pickle

    rows = events.select(*EVENTS).filter("mint is not null")
    order = ["mint", "at_ms", "ordinal"]
    ranged = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    cut = checkpointed(ranged.sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    by_part = lambda df: sorted(df.collect(), key=lambda r: r.part)  # noqa: E731  # one row per part
    seen = by_part(cut.select("_part", "mint").mapInArrow(_bounds, "part int, first string, last string"))
    going_on = frozenset(a.part for a, b in zip(seen, seen[1:]) if a.last == b.first)
    whole = {r.part for r in seen if r.first == r.last}
    tops: dict[int, int | None] = {}
    entering: dict[int, Token | None] = {}
    if going_on:
        lasts = {r.part: r.last for r in seen if r.part in going_on}
        own = cut.filter(F.col("mint") == F.get(F.array(*(F.lit(lasts.get(p)).cast("string") for p in range(max(lasts) + 1))), F.col("_part")))

        def effects(tops: dict | None) -> dict:
            return {r.part: pickle.loads(r.does) for r in by_part(own.mapInArrow(_summed(tops), "part int, first string, last string, does binary"))}

        does = effects(None)
        for a, b in zip(seen, seen[1:]):
            if a.part in going_on:
                tops[b.part] = does[a.part].after(tops.get(a.part) if a.part in whole else None)
        does = effects({p: top for p, top in tops.items() if p in whole})
        for a, b in zip(seen, seen[1:]):
            if a.part in going_on:
                entering[b.part] = does[a.part].apply(entering.get(a.part) if a.part in whole else None)
    return checkpointed(cut.mapInArrow(_folded(tops, entering, going_on, outcomes), SCHEMA))


def plain(events: list[tuple[str, Event]]) -> tuple[dict[int, str], dict[str, Token]]:
    """The same by one loop, for tests: outcomes by ordinal, tokens by mint."""
    tokens: dict[str, Token] = {}
    slots: dict[str, Slots] = {}
    outcomes = {}
    for mint, e in sorted(events, key=lambda x: (x[1].at_ms, x[1].ordinal)):
        after, outcomes[e.ordinal] = step(tokens.get(mint), e, slots.setdefault(mint, Slots()).stale(e))
        if after is None:
            tokens.pop(mint, None)
        else:
            tokens[mint] = after
    return outcomes, tokens
