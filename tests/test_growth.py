"""What a plan may cost as its tables grow: how often it reads and folds them, and over how many tasks."""

import uuid
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from windowmill.functions.arrow import listed
from windowmill.operators import intake, metrics, registry, slices, tokens
from windowmill.plans import flows
from windowmill.sources import coverage, logs, samples
from windowmill.streaming import stateful


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_line_faults_fold_each_notification_once(spark):
    lines = [["Program P invoke [1]", "Program data: AA==", "Program P success"], ["Program P invoke [2]"], ["Program Q invoke [1]", "Program Q success"], None]
    df = spark.createDataFrame([(f"s{n}", x) for n, x in enumerate(lines)], "signature string, log_messages array<string>")
    found = intake.line_faults(df, "P", "CURVE")
    assert {(r.signature, r.malformed, r.cause) for r in found.collect()} == {("s0", True, "DECODE_GAP"), ("s1", True, "DECODE_GAP")}
    assert _plan(found).split("== Initial Plan ==")[0].count("MapInArrow") == 1
    twice = intake.line_faults(df.unionByName(df), "P", "CURVE")  # several rows of a signature count as one
    assert twice.count() == 2


def test_lines_as_spark_matches_them():
    go, end = "Program P invoke [1]", "Program P success"
    assert logs.scope([go, None, "Program data: x", end + "\n"], "P") == ([(0, "x")], None)
    assert logs.scope([go, "Program data: success"], "P") == ([], "UNEXPECTED_PROGRAM_EXIT")  # an exit of a program named data:
    assert logs.scope(["Program P invoke [01]", end], "P") == ([], None)
    assert logs.scope(["Program P invoke [99999999999]"], "P") == ([], "INVALID_INVOCATION_DEPTH")
    assert logs.scope(["Program P invoke [١]"], "P") == ([], None)  # digits are those of ASCII
    assert logs.scope([go, "Program P failed: a\nb"], "P") == ([], "UNCLOSED_INVOCATIONS")
    assert logs.events(" ", [go, end], "P") == ([], "EMPTY_SIGNATURE")
    assert coverage.paired([go, "Program data: x", "Program P invoke [2]", end, end], "P") == ([(0, 1, False)], None)
    assert coverage.paired([go, end] * 65_537, "P") == ([], "TOO_MANY_INSTRUCTIONS")


def test_lines_of_one_row_group_reach_all_tasks(spark, sf_dir):
    for made in (samples.traffic, samples.calls, samples.notifications):
        assert "hashpartitioning(event_id" in _plan(made(spark, sf_dir)), made


def test_events_of_a_scene_are_parsed_once(spark, sf_dir):
    s = flows.Scene(spark, sf_dir, once=True)
    plain = flows.Scene(spark, sf_dir)
    for name in ("registry_events", "observations", "gaps"):
        one, other = getattr(s, name), getattr(plain, name)
        assert not any(f.endswith("/events.parquet") for f in one.inputFiles()), name
        assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))


def test_parts_of_tokens_are_summed_by_their_last_mint():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"mint": m, "n": list(range(len(m)))}) for m in (["a", "a", "b", "c", "c"], ["c"], [], ["c", "d"])]
    assert [[tuple(r.values()) for r in b.to_pylist()] for b in tokens._ends(iter(batches))] == [[("a", 0)], [("c", 3), ("c", 4)], [("c", 0)], [("d", 1)]]
    assert [b.num_rows for b in tokens._ends(iter([batches[1], batches[0]]))] == [1, 2]


class _State:
    """A state that counts what is asked of it."""

    def __init__(self, value=None):
        self.value, self.calls = value, 0

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            return {"exists": self.value is not None, "get": self.value}.get(name)

        return call


def test_wallets_of_a_window_that_closes_at_once_are_not_asked_of_the_state():
    fold = stateful.WindowMetrics(10)
    fold.window, fold.wallets, fold.handle = _State(), _State(), _State()
    trades = [(n, n, "TRADE", "BUY", f"w{n % 3}", "1", "2", "s", "x") for n in range(1, 9)]
    rows = fold.take(("m",), [(0, 0, "CREATE", None, None, None, None, "s", "o"), *trades], 100)
    assert rows[0][5:10] == (9, 8, 8, 0, 3)
    assert fold.wallets.calls == 0
    fold.take(("m",), [(200, 0, "CREATE", None, None, None, None, "s", "o"), *((200 + r[0], *r[1:]) for r in trades)], 205)
    assert fold.wallets.calls == 3  # one for each wallet of a window that stays open, not one for each trade


def _latest(folder, forgets):
    """A fold whose state is the last value, or how many there were; each that starts leaves a file."""
    import pyarrow as pa

    class Fold:
        def __init__(self, state):
            self.value = state
            (folder / uuid.uuid4().hex).touch()

        def feed(self, batch):
            before = []
            for x in batch["at"].to_pylist():
                before.append(self.value or "0")
                self.value = str(x + 1) if forgets else str(int(self.value or 0) + 1)
            return pa.RecordBatch.from_pydict({"value": batch["at"], "before": before})

        def state(self):
            return self.value

        def rest(self):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.string())], ["value", "before"])

    return Fold


@pytest.mark.parametrize("forgets", [True, False])
def test_slices_of_a_fold_that_forgets_are_folded_once(spark, tmp_path, forgets):
    rows = spark.range(4000).select(F.col("id").alias("at"))
    found = slices.sliced_fold(rows, "at", ["at"], _latest(tmp_path, forgets), "value long, before string", 500)
    folds = len(list(tmp_path.iterdir()))
    assert sorted((r.value, r.before) for r in found.collect()) == [(n, str(n)) for n in range(4000)]
    assert folds == 8 if forgets else folds > 8


def test_metrics_of_a_scene_are_made_once(spark, sf_dir):
    s = flows.Scene(spark, sf_dir, once=True)
    assert s.metrics() is s.metrics() and "InArrow" not in _plan(s.metrics()) and "Join" not in _plan(s.metrics())


def test_settled_takes_its_windows_once_and_of_the_progress_what_is_waited_for(spark, tmp_path):
    def fold(batches):
        (tmp_path / uuid.uuid4().hex).touch()
        yield from batches

    schema = registry.WINDOWS + ", closes_ms long"
    rows = [("a", "S", "N", "a0", 0, "CONFIRMED", None, None, 100, 100), ("b", "T", "N", "b0", 0, "CANCELLED_CONFIRMED", "DECODE_GAP", 5, 50, 100), ("c", None, "N", "c0", 0, "CONFIRMED", None, None, 100, 100), ("d", "U", "N", "d0", 0, "OPEN", None, None, None, 100)]
    windows = spark.createDataFrame(rows, schema).coalesce(1).mapInArrow(fold, schema)
    events = spark.createDataFrame([(120, 1, "CANCEL", "source", None, "STOP"), (90, 2, "CANCEL", "source", "S", "EARLY")], "at_ms long, ordinal long, action string, reach string, source string, reason string")
    progress = spark.createDataFrame([("S", 99), ("S", 130), ("T", 140), (None, 150)], "source string, at_ms long")
    found = registry.settled(windows, events, progress, 50)
    assert {(r.opener, r.status, r.reason, r.claimed_ms) for r in found.collect()} == {
        ("a0", "CONFIRMED", None, 130), ("b0", "CANCELLED_CONFIRMED", "DECODE_GAP", 50), ("c0", "CANCELLED_CONFIRMED", "STOP", 120), ("d0", "OPEN", None, None),
    }
    assert len(list(tmp_path.iterdir())) == 1


def test_tokens_alone_come_without_outcomes(spark):
    schema = "mint string, at_ms long, ordinal long, action string, slot long, market string, window_ms long, decision string, kind string, name string"
    rows = [("hot" if n % 5 else f"m{n % 3}", n, n, "REMOVE" if n % 97 == 5 else "OBSERVE", n - (n % 7) * 3, "A" if n % 11 else "B", n % 4 or None, None, "CREATE" if n % 13 == 0 else "TRADE", f"n{n}" if n % 13 == 0 else None) for n in range(600)]
    events = spark.createDataFrame(rows, schema)
    ended = lambda df: sorted(str(r) for r in df.collect() if r.what == "TOKEN")
    alone, one = tokens.projected(events, 9, outcomes=False), tokens.projected(events, 1)
    assert {r.what for r in alone.collect()} == {"TOKEN"} and ended(alone) == ended(one) == ended(tokens.projected(events, 9))


def test_lists_of_arrow_columns_are_what_pylist_gives():
    import pyarrow as pa

    for values in ([1, 2**62 + 1, -3], [None, 2**62 + 1, 0], ["a", None, ""], [], [None]):
        for kind in (pa.int64(), pa.string()):
            if all(x is None or isinstance(x, str) == (kind == pa.string()) for x in values):
                got = listed(pa.array(values, kind))
                assert got == pa.array(values, kind).to_pylist() and [type(x) for x in got] == [type(x) for x in values]


def test_counts_read_members_once(spark, tmp_path):
    def fold(batches):
        (tmp_path / uuid.uuid4().hex).touch()
        yield from batches

    schema = "mint string, opened_ms long, kind string, wallet string, side string, base decimal(20,0), quote decimal(20,0), slot long"
    trade = lambda wallet, side, quote, slot: ("m", 0, "TRADE", wallet, side, Decimal(1), Decimal(quote), slot)
    rows = [trade("b", "BUY", 7, 1), trade("a", "SELL", 7, 2), trade("", "BUY", 99, 3), trade("c", "BUY", 0, 4), ("m", 0, "CREATE", None, None, None, None, 9), ("n", 5, "CREATE", None, None, None, None, 6)]
    member = spark.createDataFrame(rows, schema).coalesce(1).mapInArrow(fold, schema)
    windows = spark.createDataFrame([("m", 0), ("n", 5), ("o", 0)], "mint string, opened_ms long")
    names = ["mint", "observations", "latest_slot", "trades", "buys", "sells", "quote_volume", "traders", "buyers", "sellers", "top_wallet", "top_quote", "top_share_bps"]
    got = {tuple(r) for r in metrics.counts(windows, member).select(*names).collect()}
    assert got == {("m", 5, 9, 2, 1, 1, 14, 2, 1, 1, "a", 7, 5000), ("n", 1, 6, 0, 0, 0, 0, 0, 0, 0, None, None, None), ("o", 0, None, 0, 0, 0, 0, 0, 0, 0, None, None, None)}
    assert len(list(tmp_path.iterdir())) == 1
