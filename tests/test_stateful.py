"""Stateful streams: shuffled files equal the batch, state ends, holds are bounded, repeated batches change nothing."""

import random

import pytest
from pyspark.sql import functions as F

from windowmill.operators import metrics, windows
from windowmill.sources import adapters
from windowmill.streaming import live, stateful

LENGTH_MS = 7 * 86_400_000
COLUMNS = ["event_id", "kind", "side", "wallet", "base", "quote", "source", "signature", "mint", "received_ms", "asset"]


def files(spark, df, folder):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(folder)


def test_shuffled_files_equal_the_batch_and_no_state_is_left(spark, sf_dir, tmp_path):
    seen = adapters.observations(spark, sf_dir).select(*COLUMNS)
    seen.orderBy(F.xxhash64("event_id")).repartition(5).write.parquet(f"{tmp_path}/in")
    run = lambda: live.run_once(stateful.window_metrics(files(spark, seen, f"{tmp_path}/in"), LENGTH_MS, "60 days"), f"{tmp_path}/out", f"{tmp_path}/cp")
    run()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 0  # the watermark is before all
    far = seen.limit(1).withColumns({"received_ms": F.lit(1_800_000_000_000).cast("long"), "kind": F.lit("TRADE"), "mint": F.lit("far")})
    far.write.mode("append").parquet(f"{tmp_path}/in")
    run()  # goes on from the checkpoint
    run()
    got = {(r.mint, r.opened_ms): (r.observations, r.trades, r.buys, r.sells, r.traders, int(r.buy_quote), int(r.sell_base), r.first_invalid) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    opened = windows.open_windows(seen.filter("kind = 'CREATE'"), LENGTH_MS)
    member = windows.members(adapters.observations(spark, sf_dir), opened, LENGTH_MS, [c for c in adapters.observations(spark, sf_dir).columns if c != "mint"])
    whole = metrics.counts(windows.named_first(opened.withColumn("reason", F.lit(None).cast("string")), member), member)
    assert got == {(r.mint, r.opened_ms): (r.observations, r.trades, r.buys, r.sells, r.traders, int(r.buy_quote), int(r.sell_base), r.reason) for r in whole.collect()}
    state = lambda name: spark.read.format("statestore").option("stateVarName", name).load(f"{tmp_path}/cp")
    assert state("window").count() == 0 and state("wallets").count() == 0


START = 1000  # the first watermark is 0


def activity(spark, rows, folder, far=10_000_000):
    schema = "mint string, received_ms long, event_id long, action string, opener string"
    rows = [("m", at + START, n, action, by) for n, (at, action, by) in enumerate(rows)] + [("far", far, 99, "ACTIVITY", None)]
    df = spark.createDataFrame(rows, schema)
    df.repartition(3).write.parquet(f"{folder}/in")
    live.run_once(stateful.held_activity(files(spark, df, f"{folder}/in"), 1000, 3, "2 hours"), f"{folder}/out", f"{folder}/cp")
    return {r.event_id: (r.outcome, r.released_ms - START) for r in spark.read.parquet(f"{folder}/out").filter("mint = 'm'").collect()}


@pytest.mark.parametrize(
    ("rows", "expected"),
    [
        ([(0, "OPEN", "o"), (10, "ACTIVITY", None), (20, "ACTIVITY", None), (500, "CONFIRM", "o"), (600, "ACTIVITY", None)], {1: ("RELEASED", 500), 2: ("RELEASED", 500), 4: ("READY", 600)}),
        ([(0, "OPEN", "o"), (10, "ACTIVITY", None), (700, "ACTIVITY", None), (1500, "CONFIRM", "o")], {1: ("HOLD_EXPIRED", 1010), 2: ("RELEASED", 1500)}),  # a late confirmation
        ([(0, "OPEN", "o"), (10, "ACTIVITY", None), (20, "FAIL", "o"), (30, "ACTIVITY", None)], {1: ("CANCELLED", 20), 3: ("UNTRACKED", 30)}),
        ([(0, "OPEN", "o"), *[(10 + k, "ACTIVITY", None) for k in range(4)], (20, "CONFIRM", "o")], {1: ("CANCELLED", 13), 2: ("CANCELLED", 13), 3: ("CANCELLED", 13), 4: ("QUEUE_OVERFLOW", 13)}),
        ([(0, "ACTIVITY", None), (5, "OPEN", "o"), (6, "CONFIRM", "other"), (7, "ACTIVITY", None)], {0: ("UNTRACKED", 0), 3: ("HOLD_EXPIRED", 1007)}),
    ],
)
def test_activity_is_held_for_a_bounded_time_and_number(spark, tmp_path, rows, expected):
    assert activity(spark, rows, str(tmp_path)) == expected


def test_silence_is_told_once(spark, tmp_path):
    rows = [("a", t, t) for t in (1, 50, 99, 250, 300)] + [("b", t, t) for t in range(90, 1000, 90)] + [("far", 900_000, 1)]
    df = spark.createDataFrame(rows, "source string, received_ms long, event_id long")
    df.repartition(4).write.parquet(f"{tmp_path}/in")
    live.run_once(stateful.idle_gaps(files(spark, df, f"{tmp_path}/in"), 100, "10 minutes"), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = sorted((r.source, r.last_seen_ms, r.gap_ms) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("a", 99, 199), ("a", 300, 400), ("b", 990, 1090)]


def plain_merge(rows):
    """Batches in order, each as a whole: the earliest row of a new key is what it is."""
    kept, against = {}, 0
    for batch in rows:
        fresh = {}
        for key, at, content in batch:
            if key not in kept:
                fresh[key] = min(fresh.get(key, (at, content)), (at, content), key=lambda x: x[0])
        kept |= fresh
        for key, at, content in batch:
            if content == kept[key][1]:
                kept[key] = (min(kept[key][0], at), content)
            else:
                against += 1
    return kept, against


def test_a_killed_and_restarted_merge_is_the_same(spark, tmp_path):
    pick = random.Random(9)
    batches = [[(f"k{pick.randrange(30)}", pick.randrange(10**9), f"c{pick.randrange(2)}") for _ in range(40)] for _ in range(4)]
    frames = [spark.createDataFrame(b, "key string, received_ms long, evidence string") for b in batches]
    table = f"{tmp_path}/table"
    merge = lambda df, n: stateful.merged(df, n, table, ["key"], "evidence")
    read = lambda: {r.key: (r.received_ms, r.evidence) for r in stateful.stored(spark, table, ["key"], "evidence").collect()}
    for n, df in enumerate(frames):
        merge(df, n)
        merge(df.repartition(3), n)  # the batch again, after a crash before its commit
    kept, against = plain_merge(batches)
    assert read() == kept and stateful.conflicts(spark, table).agg(F.sum("copies")).first()[0] == against


def test_merge_stream_goes_on_after_a_failed_batch(spark, tmp_path):
    df = spark.createDataFrame([(f"k{n % 7}", n, "x") for n in range(50)], "key string, received_ms long, evidence string")
    df.repartition(4).write.parquet(f"{tmp_path}/in")
    table, failed = f"{tmp_path}/table", []

    def fails_once(batch, n):
        stateful.merged(batch, n, table, ["key"], "evidence")
        if n == 1 and not failed:
            failed.append(n)
            raise RuntimeError("killed behind the write")

    sink = lambda: files(spark, df, f"{tmp_path}/in").writeStream.foreachBatch(fails_once).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="killed"):
        sink().awaitTermination()
    sink().awaitTermination()
    assert failed and {r.key: (r.received_ms, r.evidence) for r in stateful.stored(spark, table, ["key"], "evidence").collect()} == {f"k{n}": (n, "x") for n in range(7)}
