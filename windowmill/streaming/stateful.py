"""Stateful operators on streams: window metrics, idle sources, held activity, merges by key.

Rows may come in any order within the watermark's delay. Each market or source keeps
them until the watermark has passed them, and then takes them in order, so that the
result is that of the batch operators whatever files the rows came in. State goes with
the window. What comes later than the watermark is dropped and counted by Spark.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROW = "received_ms long, event_id long, kind string, side string, wallet string, base string, quote string, source string, signature string"
METRICS = (
    "mint string, opened_ms long, closes_ms long, source string, opener string, observations long, trades long, buys long, sells long, traders long,"
    " buy_base decimal(38,0), buy_quote decimal(38,0), sell_base decimal(38,0), sell_quote decimal(38,0), first_invalid string"
)
_COUNTS = ["observations", "buys", "sells", "buy_base", "buy_quote", "sell_base", "sell_quote"]
_WINDOW = "opened_ms long, source string, opener string, first_invalid string, " + ", ".join(f"{c} string" for c in _COUNTS)  # whole numbers of any size as text


def timed(stream: DataFrame, at: str, delay: str) -> DataFrame:
    """With a watermark on the time in milliseconds; the state store is the one that timers need."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return stream.withColumn("_at", F.timestamp_millis(at)).withWatermark("_at", delay)


class _Ordered(StatefulProcessor):
    """Rows of a key wait for the watermark and are then taken in order."""

    order = 2  # so many leading fields of a row order it; the first is its time

    def wait(self, handle: StatefulProcessorHandle, row: str) -> None:
        self.handle, self.names = handle, [c.split()[0] for c in row.split(", ")]
        self.waiting = handle.getListState("waiting", row)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        soonest = None
        for frame in rows:
            columns = (frame[c].tolist() for c in self.names)
            got = [tuple(None if x is None or x != x else x for x in r) for r in zip(*columns, strict=True)]
            self.waiting.appendList(got)
            soonest = min([r[0] for r in got] + ([] if soonest is None else [soonest]))
        if soonest is not None:
            self.handle.registerTimer(int(soonest))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get(), key=lambda r: r[: self.order])
        ready, later = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(int(later[0][0]))
        else:
            self.waiting.clear()
        out = self.take(key, ready, now)
        yield pd.DataFrame(out, columns=self.columns) if out else pd.DataFrame()

    def close(self) -> None:
        pass


class WindowMetrics(_Ordered):
    """Per market: opens windows that do not extend, adds up their members, writes each at its close."""

    def __init__(self, length_ms: int):
        self.length_ms = length_ms
        self.columns = [c.split()[0] for c in METRICS.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.wait(handle, ROW)
        self.window = handle.getValueState("window", _WINDOW)
        self.wallets = handle.getMapState("wallets", "wallet string", "trades long")

    def take(self, key, rows: list[tuple], now: int) -> list[tuple]:
        from decimal import Decimal

        out: list[tuple] = []
        opened = self.window.get() if self.window.exists() else None
        at = None if opened is None else dict(zip(["opened_ms", "source", "opener", "first_invalid"], opened[:4])) | {c: int(v) for c, v in zip(_COUNTS, opened[4:])}

        stored = opened is not None  # the window and its wallets so far are in the state; what is new is kept here until the end
        fresh: Counter[str] = Counter()

        def closed(until: int) -> None:
            nonlocal at, stored
            if at is not None and at["opened_ms"] + self.length_ms <= until:
                sums = [Decimal(at[c]) for c in _COUNTS[3:]]
                traders = len(fresh.keys() | ({k[0] for k in self.wallets.keys()} if stored else set()))
                out.append((key[0], at["opened_ms"], at["opened_ms"] + self.length_ms, at["source"], at["opener"], at["observations"], at["buys"] + at["sells"], at["buys"], at["sells"], traders, *sums, at["first_invalid"]))
                if stored:
                    self.window.clear()
                    self.wallets.clear()
                fresh.clear()
                at, stored = None, False

        for received, _, kind, side, wallet, base, quote, source, signature in rows:
            closed(received)
            if at is None and kind == "CREATE":
                at = {"opened_ms": received, "source": source, "opener": signature, "first_invalid": None} | dict.fromkeys(_COUNTS, 0)
            if at is None:
                continue
            at["observations"] += 1
            if kind == "TRADE":
                wrong = "INVALID_TRADE_WALLET" if not (wallet or "").strip() else "INVALID_TRADE_AMOUNT" if int(base or 0) <= 0 or int(quote or 0) <= 0 else None
                if wrong:
                    at["first_invalid"] = at["first_invalid"] or wrong
                    continue
                way = "buy" if side == "BUY" else "sell"
                at[f"{way}s"] += 1
                at[f"{way}_base"] += int(base)
                at[f"{way}_quote"] += int(quote)
                fresh[wallet] += 1
        closed(now)
        if at is not None:
            for wallet, trades in fresh.items():
                before = self.wallets.getValue((wallet,))[0] if stored and self.wallets.containsKey((wallet,)) else 0
                self.wallets.updateValue((wallet,), (before + trades,))
            self.window.update((at["opened_ms"], at["source"], at["opener"], at["first_invalid"], *(str(at[c]) for c in _COUNTS)))
            self.handle.registerTimer(at["opened_ms"] + self.length_ms)
        return out


def window_metrics(stream: DataFrame, length_ms: int, delay: str = "1 minute") -> DataFrame:
    """A row of METRICS for each window, once the watermark passes its close."""
    kept = stream.filter("mint is not null and received_ms is not null").withColumns({c: F.col(c).cast("string") for c in ("base", "quote")})
    return timed(kept, "received_ms", delay).groupBy("mint").transformWithStateInPandas(WindowMetrics(length_ms), METRICS, "append", "EventTime")


class IdleSources(_Ordered):
    """Per source: a row when nothing came for so long."""

    columns = ["source", "last_seen_ms", "gap_ms"]  # noqa: RUF012

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.wait(handle, "received_ms long, event_id long")
        self.seen = handle.getValueState("seen", "last_ms long")

    def take(self, key, rows: list[tuple], now: int) -> list[tuple]:
        last, out = (self.seen.get()[0] if self.seen.exists() else None), []

        def silent(until: int) -> bool:
            if last is None or until - last < self.idle_ms:
                return False
            out.append((key[0], last, last + self.idle_ms))
            return True

        for row in rows:
            silent(row[0])
            last = row[0]
        if silent(now):
            last = None
        if last is None:
            self.seen.clear()  # told once, until the source is seen again
        else:
            self.seen.update((last,))
            self.handle.registerTimer(last + self.idle_ms)
        return out


def idle_gaps(stream: DataFrame, idle_ms: int, delay: str = "1 minute") -> DataFrame:
    """source, last_seen_ms, gap_ms: when a source was silent for ``idle_ms``; once for each silence."""
    kept = stream.filter("source is not null and received_ms is not null")
    return timed(kept, "received_ms", delay).groupBy("source").transformWithStateInPandas(IdleSources(idle_ms), "source string, last_seen_ms long, gap_ms long", "append", "EventTime")


class HeldActivity(_Ordered):
    """Per market: activity behind an opener waits for its confirmation, for a bounded time and number."""

    columns = ["mint", "event_id", "received_ms", "released_ms", "outcome"]  # noqa: RUF012

    def __init__(self, hold_ms: int, capacity: int):
        self.hold_ms, self.capacity = hold_ms, capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.wait(handle, "received_ms long, event_id long, action string, opener string")
        self.pending = handle.getValueState("pending", "opener string, opened_ms long, confirmed boolean")
        self.held = handle.getListState("held", "received_ms long, event_id long")

    def take(self, key, rows: list[tuple], now: int) -> list[tuple]:
        out: list[tuple] = []
        opener, opened, confirmed = self.pending.get() if self.pending.exists() else (None, None, False)
        held = list(self.held.get())

        def release(until: int, outcome: str, at: int | None = None) -> None:
            nonlocal held
            while held and held[0][0] <= until:
                received, event = held.pop(0)
                out.append((key[0], event, received, received + self.hold_ms if at is None else at, outcome))

        for received, event, action, by in rows:
            release(received - self.hold_ms, "HOLD_EXPIRED")
            if action == "OPEN":
                if opener is None:
                    opener, opened, confirmed = by, received, False
            elif action in ("CONFIRM", "FAIL"):
                if by == opener and not confirmed:
                    release(received, "RELEASED" if action == "CONFIRM" else "CANCELLED", received)
                    opener, opened, confirmed = (opener, opened, True) if action == "CONFIRM" else (None, None, False)
            elif opener is None:
                out.append((key[0], event, received, received, "UNTRACKED"))
            elif confirmed:
                out.append((key[0], event, received, received, "READY"))
            elif len(held) >= self.capacity:  # the window can't be whole any more; what it holds goes with it
                out.append((key[0], event, received, received, "QUEUE_OVERFLOW"))
                release(received, "CANCELLED", received)
                opener, opened, confirmed = None, None, False
            else:
                held.append((received, event))
        release(now - self.hold_ms, "HOLD_EXPIRED")
        self.held.clear()
        if held:
            self.held.put(held)
            self.handle.registerTimer(held[0][0] + self.hold_ms)
        if opener is None:
            self.pending.clear()
        else:
            self.pending.update((opener, opened, confirmed))
        return out


def held_activity(stream: DataFrame, hold_ms: int, capacity: int, delay: str = "1 minute") -> DataFrame:
    """mint, event_id, received_ms, released_ms, outcome of the ACTIVITY of markets, whose OPEN, CONFIRM and FAIL the stream has as well.

    Activity behind an opener waits: RELEASED at its confirmation, CANCELLED if it fails,
    HOLD_EXPIRED after ``hold_ms``. Beyond ``capacity`` rows the market's window is lost: the row
    says QUEUE_OVERFLOW, by which ``registry`` cancels it, and those held are CANCELLED.
    READY is activity of a confirmed market, UNTRACKED of one that has no opener.
    """
    kept = stream.filter("mint is not null and received_ms is not null")
    out = "mint string, event_id long, received_ms long, released_ms long, outcome string"
    return timed(kept, "received_ms", delay).groupBy("mint").transformWithStateInPandas(HeldActivity(hold_ms, capacity), out, "append", "EventTime")


def merged(batch: DataFrame, batch_id: int, table: str, keys: list[str], content: str) -> None:
    """One micro-batch into a stored table, the same however often it is repeated.

    A key is inserted once. A row of a known key and equal content may bring an earlier
    receipt; one of other content is a conflict and changes nothing. What a batch adds
    lies in a folder of its number, made from the batches before it alone, so that a
    repeated batch writes the same again. ``stored`` reads the table.
    """
    spark = batch.sparkSession
    first = F.min_by(F.struct("received_ms", content), F.struct("received_ms", F.xxhash64(content)))
    known = stored(spark, table, keys, content, batch_id).select(*keys, F.col(content).alias("_content"), F.col("received_ms").alias("_received"))
    rows = batch.join(known, keys, "left")
    began = rows.filter("_content is null").groupBy(*keys).agg(first.alias("f")).select(*keys, F.col("f.received_ms").alias("received_ms"), F.col(f"f.{content}").alias(content))
    among = rows.join(began.select(*keys, F.col(content).alias("_first")), keys, "left").withColumn("_content", F.coalesce("_content", "_first"))
    earlier = among.filter((F.col(content) == F.col("_content")) & (F.col("received_ms") < F.col("_received"))).groupBy(*keys).agg(F.min("received_ms").alias("received_ms"), F.first("_content").alias(content))
    began.withColumn("change", F.lit("INSERT")).unionByName(earlier.withColumn("change", F.lit("EARLIER"))).write.mode("overwrite").parquet(f"{table}/rows/batch={batch_id}")
    against = among.filter(~F.col(content).eqNullSafe(F.col("_content"))).groupBy(*keys, content).agg(F.min("received_ms").alias("received_ms"), F.count("*").alias("copies"))
    against.write.mode("overwrite").parquet(f"{table}/conflicts/batch={batch_id}")


def stored(spark: SparkSession, table: str, keys: list[str], content: str, before: int | None = None) -> DataFrame:
    """The table of ``merged``: keys, content, earliest receipt; as it was before a batch if one is named."""
    schema = ", ".join([*(f"{k} string" for k in keys), "received_ms long", f"{content} string", "change string", "batch long"])
    try:
        rows = spark.read.schema(schema).option("basePath", f"{table}/rows").parquet(f"{table}/rows")
    except Exception as missing:  # no batch yet
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        rows = spark.createDataFrame([], schema)
    if before is not None:
        rows = rows.filter(F.col("batch") < before)
    return rows.groupBy(*keys).agg(F.min("received_ms").alias("received_ms"), F.min_by(content, "batch").alias(content))


def conflicts(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.option("basePath", f"{table}/conflicts").parquet(f"{table}/conflicts").drop("batch")


def merge_stream(stream: DataFrame, table: str, checkpoint: str, keys: list[str], content: str) -> None:
    """All that has arrived, batch by batch, into the stored table."""
    sink = stream.writeStream.foreachBatch(lambda df, n: merged(df, n, table, keys, content))
    sink.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def collected(df: DataFrame, root: str) -> DataFrame:
    """A stream over what is there, run to its end and read back from the shared folder."""
    from windowmill.streaming.live import run_once

    path = f"{root}-{uuid.uuid4().hex}"
    run_once(df, f"{path}/rows", f"{path}/state")
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")
