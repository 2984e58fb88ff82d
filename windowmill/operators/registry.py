"""The registry of windows: opening under a cap, eviction, confirmation, cancellation, first cause.

Events, one row each: at_ms, ordinal (tells rows of one time apart), action, reach
(window, mint, source or all), mint, source, asset, opener, reason.

* OPEN starts a window of fixed length, unless its market has an open one. At the cap, the
  window that closes first goes, the smallest market on a tie. A market whose window was
  evicted, cancelled or failed has none, so that its next opener starts another.
* CONFIRM and FAIL concern the window of that opener, if it is still open.
* CANCEL ends the open windows in its reach; MARK names them incomplete and lets them be.
* The first cause of a window stays.
"""

from __future__ import annotations

import json
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windowmill.functions.arrow import listed
from windowmill.operators.asof import asof, before
from windowmill.operators.slices import ROWS, sliced_fold
from windowmill.operators.storage import checkpointed

DAY_MS = 86_400_000
BROADCAST_ROWS = 200_000
WINDOWS = "mint string, source string, asset string, opener string, opened_ms long, status string, reason string, reason_ms long, left_ms long"
_TYPES = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
_NAMES = [c.split()[0] for c in WINDOWS.split(", ")]
#: How far a cause reaches, and whether it ends windows or only marks them.
CAUSES = {
    "SOURCE_DISCONNECTED": ("source", "CANCEL"), "STREAM_STOPPED": ("all", "CANCEL"), "PIPELINE_RESTARTED": ("all", "CANCEL"), "QUEUE_OVERFLOW": ("mint", "CANCEL"),
    "DECODE_GAP": ("source", "MARK"), "CPI_INSTRUCTION_DATA_UNAVAILABLE": ("source", "MARK"), "PROCESSING_FAILED": ("mint", "MARK"),
}


class _Window:
    __slots__ = ("asset", "confirmed", "mint", "opened", "opener", "reason", "reason_ms", "source")

    def __init__(self, mint, source, asset, opener, opened, confirmed=False, reason=None, reason_ms=None):
        self.mint, self.source, self.asset, self.opener, self.opened = mint, source, asset, opener, opened
        self.confirmed, self.reason, self.reason_ms = confirmed, reason, reason_ms

    def kept(self) -> list:
        return [self.mint, self.source, self.asset, self.opener, self.opened, self.confirmed, self.reason, self.reason_ms]


def _registry(length_ms: int, capacity: int):
    """A fold whose state is the open windows, at most ``capacity``, in the order of opening."""

    class Registry:
        def __init__(self, state: str):
            self.open: dict[str, _Window] = {}
            self.by_source: dict[str, dict[str, _Window]] = defaultdict(dict)
            self.out: list[tuple] = []
            for kept in json.loads(state or "[]"):
                self._add(_Window(*kept))

        def _add(self, w: _Window) -> None:
            self.open[w.mint] = self.by_source[w.source][w.mint] = w

        def _leave(self, w: _Window, at: int, status: str, cause: str | None = None) -> None:
            del self.open[w.mint], self.by_source[w.source][w.mint]
            if cause and w.confirmed and w.reason is None:
                w.reason, w.reason_ms = cause, at
            self._write(w, at, status)

        def _write(self, w: _Window, at: int | None, status: str) -> None:
            named = w.confirmed and status != "OPEN"  # what was never confirmed has no say
            self.out.append((w.mint, w.source, w.asset, w.opener, w.opened, status, w.reason if named else None, w.reason_ms if named else None, at))

        def _evict(self, at: int) -> None:
            first = next(iter(self.open.values())).opened
            tied = []
            for w in self.open.values():
                if w.opened != first:
                    break
                tied.append(w)
            w = min(tied, key=lambda x: x.mint)
            self._leave(w, at, "CANCELLED_CONFIRMED" if w.confirmed else "CANCELLED_PENDING", "CAPACITY_EVICTED")

        def _reached(self, reach: str, mint: str, source: str) -> list[_Window]:
            if reach == "all":
                return list(self.open.values())
            if reach == "source":
                return list(self.by_source[source].values())
            return [self.open[mint]] if mint in self.open else []

        def feed(self, batch: pa.RecordBatch) -> pa.RecordBatch:
            self.out = []
            columns = (listed(batch[c]) for c in ("at_ms", "action", "reach", "mint", "source", "asset", "opener", "reason"))
            for at, action, reach, mint, source, asset, opener, reason in zip(*columns, strict=True):
                while self.open and (w := next(iter(self.open.values()))).opened + length_ms <= at:
                    self._leave(w, w.opened + length_ms, "CONFIRMED" if w.confirmed else "DISCARDED")
                if action == "OPEN":
                    if mint not in self.open:
                        if len(self.open) >= capacity:
                            self._evict(at)
                        self._add(_Window(mint, source, asset, opener, at))
                elif action in ("CONFIRM", "FAIL"):
                    if (w := self.open.get(mint)) and w.opener == opener and not w.confirmed:
                        if action == "CONFIRM":
                            w.confirmed = True
                        else:
                            self._leave(w, at, "CANCELLED_PENDING")
                else:
                    for w in self._reached(reach, mint, source):
                        if action == "CANCEL":
                            self._leave(w, at, "CANCELLED_CONFIRMED" if w.confirmed else "CANCELLED_PENDING", reason)
                        elif w.reason is None:
                            w.reason, w.reason_ms = reason, at
            return self._batch()

        def state(self) -> str:
            return json.dumps([w.kept() for w in self.open.values()])

        def rest(self) -> pa.RecordBatch:
            self.out = []
            for w in self.open.values():
                self._write(w, None, "OPEN" if w.confirmed else "PENDING")
            return self._batch()

        def _batch(self) -> pa.RecordBatch:
            columns = zip(*self.out, strict=True) if self.out else [[]] * len(_NAMES)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)

    return Registry


def registry(events: DataFrame, length_ms: int, capacity: int, rows_per_slice: int = ROWS) -> DataFrame:
    """One row per window: its market, opener and opening, status, reason, reason_ms, left_ms, closes_ms.

    status is CONFIRMED or DISCARDED (never confirmed) if the window reached its close,
    CANCELLED_CONFIRMED or CANCELLED_PENDING if it was ended before, OPEN or PENDING if
    it is open after the last event. left_ms is when it left. Only confirmed windows
    have a reason. Events of a null time, and openers of a null market, do nothing.
    """
    order = ["at_ms", "ordinal"]
    columns = [*order, "action", "reach", "mint", "source", "asset", "opener", "reason"]
    rows = events.select(*columns).filter("at_ms is not null and (mint is not null or reach in ('source', 'all'))")
    return sliced_fold(rows, "at_ms", order, _registry(length_ms, capacity), WINDOWS, rows_per_slice).withColumn("closes_ms", F.col("opened_ms") + length_ms)


def evicted(events: DataFrame, length_ms: int, capacity: int, rows_per_slice: int = ROWS) -> DataFrame:
    """mint, opened_ms, closes_ms, evicted_ms of windows that openers alone start; each counts as confirmed at once."""
    sure = F.transform(F.array(F.lit("OPEN"), F.lit("CONFIRM")), lambda a, i: F.struct(a.alias("action"), (F.col("ordinal") * 2 + i).alias("ordinal")))
    both = events.filter("action = 'OPEN'").withColumn("_a", F.explode(sure)).withColumns({"action": F.col("_a.action"), "ordinal": F.col("_a.ordinal")}).drop("_a")
    return registry(both, length_ms, capacity, rows_per_slice).select("mint", "opened_ms", "closes_ms", F.when(F.col("status") == "CANCELLED_CONFIRMED", F.col("left_ms")).alias("evicted_ms"))


def settled(windows: DataFrame, events: DataFrame, progress: DataFrame, slot_ms: int = DAY_MS) -> DataFrame:
    """Windows after their close: add claimed_ms, NULL if there is no claim yet; ends that come before the claim count.

    A complete window is claimed when its source (progress: source, at_ms) is seen at or
    after the close, an incomplete one at once. A CANCEL that reaches a complete window
    between its close and its claim, or at the claim's time, ends it as well; later ones
    do nothing. Windows that were never confirmed, or are open, are not claimed. Times
    are cut into slots of ``slot_ms``, which a task takes for one source. Only complete
    windows are joined: the cap bounds how many there are, so that of all rows of
    ``progress`` few are shuffled.
    """
    windows = checkpointed(windows)  # read several times, and what gives them is a fold
    complete = F.coalesce((F.col("status") == "CONFIRMED") & F.col("reason").isNull(), F.lit(False))
    waiting = windows.filter(complete)
    firsts = checkpointed(waiting.groupBy("source").agg(F.min("closes_ms").alias("_first")))
    small = firsts.count() <= BROADCAST_ROWS

    def wanted(df: DataFrame) -> DataFrame:
        """Rows that a window may wait for: of its source, from the first close on."""
        return df.alias("d").join((F.broadcast(firsts) if small else firsts).alias("f"), F.col("d.source").eqNullSafe(F.col("f.source")) & (F.col("d.at_ms") >= F.col("f._first"))).select("d.*")

    at, none = F.col("at_ms").alias("at"), F.lit(None).cast("long").alias("ordinal")
    cancels = events.filter("action = 'CANCEL' and at_ms is not null")
    seen = wanted(progress.filter("at_ms is not null").select("source", "at_ms")).select("source", "at_ms", F.struct(at, F.lit(1).alias("side"), none, F.lit(None).cast("string").alias("reason")).alias("e"))
    said = F.struct(at, F.lit(0).alias("side"), F.col("ordinal").cast("long").alias("ordinal"), "reason").alias("e")
    of_source = seen.unionByName(wanted(cancels.filter("reach = 'source'")).select("source", "at_ms", said)).groupBy("source", "at_ms").agg(F.min("e").alias("_of_source"))
    of_all = cancels.filter("reach = 'all'").select("at_ms", said).groupBy("at_ms").agg(F.min("e").alias("_of_all")).withColumn("_everyone", F.lit(0))
    whole = asof(waiting.withColumn("_everyone", F.lit(0)), of_source, ["source"], "closes_ms", "at_ms", "_of_source", slot_ms, after=True)
    whole = asof(whole, of_all, ["_everyone"], "closes_ms", "at_ms", "_of_all", slot_ms, after=True)
    whole = whole.withColumn("_next", F.array_min(F.array_compact(F.array("_of_source", "_of_all")))).withColumn("_ended", F.coalesce(F.col("_next.side") == 0, F.lit(False)))
    put = lambda c, value: F.when(F.col("_ended"), value).otherwise(F.col(c)).alias(c)
    claimed = whole.select(
        "mint", "source", "asset", "opener", "opened_ms", "closes_ms", put("status", F.lit("CANCELLED_CONFIRMED")), put("reason", F.col("_next.reason")), put("reason_ms", F.col("_next.at")), "left_ms", F.col("_next.at").alias("claimed_ms"),
    )
    at_once = F.when(F.col("status").isin("CONFIRMED", "CANCELLED_CONFIRMED"), F.col("left_ms"))
    return claimed.unionByName(windows.filter(~complete).select(*claimed.columns[:-1], at_once.alias("claimed_ms")))


def runs(windows: DataFrame, events: DataFrame, slot_ms: int = DAY_MS) -> DataFrame:
    """Add run: the restarts before the opening. Windows of an earlier run are those that a restart interrupts."""
    starts = windows.select(F.struct(*windows.columns).alias("_w"), F.col("opened_ms").alias("at_ms"), F.lit(0).alias("restart"))
    restarts = events.filter("action = 'CANCEL' and reason = 'PIPELINE_RESTARTED' and at_ms is not null").select("at_ms", F.lit(1).alias("restart"))
    order = [F.asc_nulls_first("at_ms"), F.asc("restart")]
    counted = before(starts.unionByName(restarts, allowMissingColumns=True), [], order, "at_ms", slot_ms, F.sum, F.col("restart"), "run").filter("restart = 0")
    return counted.select("_w.*", F.coalesce("run", F.lit(0)).cast("long").alias("run"))


def finalization_order(windows: DataFrame, slot_ms: int = DAY_MS) -> DataFrame:
    """Add place: claimed windows in the order of their close, market and opener, from 0; numbered within slots of time and across them by their sizes."""
    claimed = windows.filter("claimed_ms is not null")
    order = [F.asc("closes_ms"), F.asc("mint"), F.asc("opener")]
    return before(claimed, [], order, "closes_ms", slot_ms, F.sum, F.lit(1), "place").withColumn("place", F.coalesce("place", F.lit(0)).cast("long"))


def held_at(windows: DataFrame, at_ms: int) -> DataFrame:
    """mint, opened_ms, held: the windows that the registry holds at a time, ACTIVE or, behind their close or cancellation and not yet claimed, RETAINED."""
    there = F.col("opened_ms") <= at_ms
    active = there & F.coalesce(F.col("left_ms") > at_ms, F.lit(True))
    kept = F.col("status").isin("CONFIRMED", "CANCELLED_CONFIRMED") & F.coalesce(F.col("left_ms") <= at_ms, F.lit(False)) & F.coalesce(F.col("claimed_ms") > at_ms, F.lit(True))
    return windows.select("mint", "opened_ms", F.when(active, "ACTIVE").when(kept, "RETAINED").alias("held")).filter("held is not null")
