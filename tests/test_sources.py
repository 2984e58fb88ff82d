"""Log scoping, event bytes and the live windows."""

import base64
import struct

import pytest

from windowmill.operators import windows
from windowmill.plans.flows import LENGTH_MS, Scene
from windowmill.sources import logs
from windowmill.streaming import live

DATA = "Program data: "
CASES = {
    "paired": (["Program P invoke [1]", DATA + "a", DATA + "b", "Program P consumed 5 of 9 compute units", "Program P success", "Program P invoke [1]", DATA + "c", "Program P success"], [(0, 0, "a"), (0, 1, "b"), (1, 0, "c")]),
    "nested": (["Program X invoke [1]", DATA + "no", "Program P invoke [2]", DATA + "a", "Program P success", DATA + "no", "Program X failed: custom", "Program P invoke [1]", DATA + "b", "Program P success"], [(0, 0, "a"), (1, 0, "b")]),
    "outside": ([DATA + "no"], []),
    "truncated": (["Program P invoke [1]", "Log truncated"], "TRUNCATED_LOGS"),
    "depth": (["Program P invoke [2]"], "INVALID_INVOCATION_DEPTH"),
    "exit": (["Program P invoke [1]", "Program X success"], "UNEXPECTED_PROGRAM_EXIT"),
    "unclosed": (["Program P invoke [1]", DATA + "a"], "UNCLOSED_INVOCATIONS"),
    " ": ([], "EMPTY_SIGNATURE"),
    "none": (None, []),
}


def test_log_scope(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "signature string, log_messages array<string>")
    found = {k: [] for k in CASES}
    for r in logs.scoped(df, "P").collect():
        found[r.signature].append(r.scope_error or (r.instruction_index, r.event_index, r.payload))
    assert {k: sorted(v, key=str) for k, v in found.items()} == {k: [v[1]] if isinstance(v[1], str) else v[1] for k, v in CASES.items()}


def event(timestamp=-5, extra=b""):
    return logs.DISCRIMINATORS["COMPLETE"] + b"\x01" * 32 + b"\x02" * 32 + b"\x03" * 32 + struct.pack("<q", timestamp) + b"\x04" * 32 + extra


@pytest.mark.parametrize(("raw", "error"), [(event(), None), (event(2**62), None), (event()[:-1], "TRUNCATED"), (event(extra=b"\x00"), "TRAILING_BYTES"), (b"12345678" + event()[8:], "UNKNOWN_DISCRIMINATOR"), (b"", "UNKNOWN_DISCRIMINATOR")])
def test_decode(spark, raw, error):
    df = spark.createDataFrame([(base64.b64encode(raw).decode(),)], "payload string")
    row = logs.decoded(df, "COMPLETE", logs.COMPLETE).first()
    assert row.decode_error == error
    expected = (None, None) if error else (struct.unpack("<q", raw[104:112])[0], "02" * 32)
    assert (row.timestamp, row.mint) == expected


def test_decode_u64_and_booleans(spark):
    layout = [("amount", "u64"), ("flag", "bool")]
    rows = [(base64.b64encode(logs.DISCRIMINATORS["TRADE"] + struct.pack("<Q", 2**64 - 1) + bytes([b])).decode(),) for b in (0, 1, 2)] + [("!",)]
    found = logs.decoded(spark.createDataFrame(rows, "payload string"), "TRADE", layout).collect()
    assert [(r.amount, r.flag, r.decode_error) for r in found] == [(2**64 - 1, False, None), (2**64 - 1, True, None), (None, None, "INVALID_BOOLEAN"), (None, None, "INVALID_BASE64")]


def test_live_windows_equal_batch(spark, sf_dir, tmp_path):
    s = Scene(spark, sf_dir)
    rows = s.observations.select("event_id", "source", "mint", "asset", "kind", "signature", "received_ms")
    cuts = [r[0] for r in rows.selectExpr("percentile_approx(received_ms, array(0.3, 0.6, 1.0)) as p").first().asDict().values() for r in [[r]]][0]
    before = 0
    for k, cut in enumerate(cuts):  # one file after the other
        rows.filter(f"received_ms > {before} and received_ms <= {cut}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        before = cut
    live.run_once(live.open_windows(live.observations(spark, f"{tmp_path}/in"), LENGTH_MS), f"{tmp_path}/out", f"{tmp_path}/cp")
    found = {(r.mint, r.opened_ms, r.closes_ms, r.opener) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert found == {(r.mint, r.opened_ms, r.closes_ms, r.opener) for r in windows.open_windows(s.observations.filter("kind = 'CREATE'"), LENGTH_MS).collect()}


def test_claims_drop_repeats(spark, sf_dir, tmp_path):
    rows = Scene(spark, sf_dir).observations.select("event_id", "source", "mint", "asset", "kind", "signature", "received_ms")
    rows.unionByName(rows).coalesce(1).write.parquet(f"{tmp_path}/in")
    live.run_once(live.claims(live.observations(spark, f"{tmp_path}/in"), "1 hour"), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert spark.read.parquet(f"{tmp_path}/out").count() == rows.count()
