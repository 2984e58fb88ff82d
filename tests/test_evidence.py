"""Checks and merges of evidence on literal rows."""

from decimal import Decimal

from pyspark.sql import functions as F

from windowmill.functions import exact, text
from windowmill.operators import evidence, intake, projection, windows
from windowmill.operators.asof import asof
from windowmill.sources import layouts


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def test_asof_before_after_strict_and_nulls(spark):
    left = spark.createDataFrame([("a", 10), ("a", 25), ("a", 5), ("b", 10), (None, 10), ("a", None)], "k string, at long")
    right = spark.createDataFrame([("a", 10, "x"), ("a", 20, "y"), ("a", 400, "z"), (None, 9, "n"), ("a", None, "w")], "k string, t long, v string")
    run = lambda **how: {(r.k, r.at): r.v for r in asof(left, right, ["k"], "at", "t", "v", 7, **how).collect()}
    assert run() == {("a", 10): "x", ("a", 25): "y", ("a", 5): None, ("b", 10): None, (None, 10): "n", ("a", None): None}
    assert run(strict=True)[("a", 10)] is None and run(strict=True)[("a", 25)] == "y"
    assert run(after=True) == {("a", 10): "x", ("a", 25): "z", ("a", 5): "x", ("b", 10): None, (None, 10): None, ("a", None): None}
    assert asof(left.filter("false"), right, ["k"], "at", "t", "v", 7).count() == 0


def test_reasons_members_and_counts(spark):
    a = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, evidence.same_reasons(a("x", "y"), a("y", "x")), evidence.same_reasons(a("x"), a("x", "x")), evidence.same_reasons(a("x", "y"), a("x"))) == (True, False, False)
    m = spark.createDataFrame([("m", 1, "N", "S", "sig", 0, 0, 7, 50), ("m", 1, "N", "S", "sig", 0, 0, 7, 40), ("m", 1, "N", "S", "sig", 0, 1, 8, 60)], "mint string, opened_ms long, network string, source string, signature string, instruction_index int, event_index int, event_id long, admitted_ms long")
    assert [r.copies for r in evidence.duplicate_members(m).collect()] == [2]
    assert sorted((r.event_id, r.admitted_ms) for r in evidence.admitted(m).collect()) == [(7, 40), (8, 60)]
    given = spark.createDataFrame([("m", 1, 3), ("n", 1, 2)], "mint string, opened_ms long, submitted long")
    assert [(r.mint, r.submitted, r.stored) for r in evidence.count_guard(given, m).collect()] == [("n", 2, 0)]


def test_pools_pages_and_recovery(spark):
    rows = spark.createDataFrame([("N", "p", "A", "B", 5, "s1", 1), ("N", "p", "A", "B", 9, "s2", 2), ("N", "p", "A", "B", 9, "s3", 3), ("N", "q", "A", "B", 1, "t", 4), ("N", "q", "A", "C", 2, "u", 5)], "network string, pool string, base_mint string, quote_mint string, observed_slot long, observed_signature string, arrival long")
    assert sorted((r.pool, r.quote_mint, r.observed_slot, r.observed_signature, r.conflicts) for r in evidence.pools(rows).collect()) == [("p", "B", 9, "s3", 0), ("q", "B", 1, "t", 1)]
    e = spark.createDataFrame([("m", 1, "PASS", "", "x", 5), ("m", 1, "PASS", "", "x", 6), ("n", 1, "PASS", "", "x", 5), ("n", 1, "REJECT", "R", "x", 5)], "mint string, opened_ms long, decision string, reasons string, evidence string, evaluated_ms long")
    assert [r.mint for r in evidence.finalization_conflicts(e).collect()] == ["n"]
    pages = spark.createDataFrame([(1, 0, "a", 9), (1, 1, "b", 8), (2, 0, "a", 9), (2, 1, "a", 8), (3, 0, "a", 5), (3, 1, "b", 6), (4, 0, "a", 3), (4, 1, "b", 2), (4, 2, "c", 1)], "page int, position int, signature string, slot long")
    assert sorted(tuple(r) for r in evidence.page_faults(pages, 2).collect()) == [(2, "DUPLICATE_SIGNATURE"), (3, "RISING_SLOT"), (4, "OVERSIZE")]
    records = spark.createDataFrame([("s", "d", 9, 0), ("s", "c", 8, 1), ("s", "b", 7, 2), ("s", "a", 6, 3), ("t", "x", 5, 0), ("u", "y", 5, 0)], "source string, signature string, slot long, position int")
    marks = spark.createDataFrame([("s", "b", 7), ("t", "gone", 4), ("u", "y", 6)], "source string, last_signature string, last_slot long")
    found = sorted(((r.source, r.step, r.signature, r.recovery_error) for r in evidence.recovered(records, marks).collect()), key=str)
    assert found == [("s", 0, "c", None), ("s", 1, "d", None), ("t", None, None, "CHECKPOINT_NOT_FOUND"), ("u", None, None, "CHECKPOINT_SLOT_MISMATCH")]


def test_openers_tokens_and_membership(spark):
    base = {"kind": "CREATE", "source": "PUMP", "venue": "PUMP_BONDING_CURVE", "mint": "m", "market_address": "c", "received_ms": 5, "target_kind": "PUMP_MINT", "target_address": "m", "collector_run_id": "r", "opened_ms": 5, "closes_ms": 9}
    given = [base, base | {"closes_ms": 5}, base | {"target_address": " "}, base | {"collector_run_id": ""}, base | {"source": "PUMP_SWAP"}, base | {"received_ms": 6}, base | {"kind": "CREATE_POOL", "source": "PUMP_SWAP", "venue": "PUMP_SWAP", "target_kind": "PUMP_SWAP_POOL", "target_address": "c"}]
    found = [r.v for r in spark.createDataFrame(given).coalesce(1).select(intake.opening_violation().alias("v")).collect()]
    assert found == [None, "window bounds", "target_address", "collector_run_id", "opening target", "opened_ms", None]
    schema = (
        "mint string, market_address string, last_event_kind string, latest_signature string, name string, symbol string, quote_mint string, base_volume string, quote_volume string, buys int, sells int, trades int, traders int, first_observed_ms long,"
        " last_observed_ms long, source string, venue string, stage string, qualification struct<decision:string,completeness:string,trades:int,buys:int,sells:int,traders:int,buyers:int,sellers:int,opened_ms:long,closed_ms:long,evaluated_ms:long,top_share_bps:int>"
    )
    good = {"decision": "PASS", "completeness": "COMPLETE", "trades": 3, "buys": 1, "sells": 2, "traders": 2, "buyers": 1, "sellers": 1, "opened_ms": 1, "closed_ms": 5, "evaluated_ms": 6, "top_share_bps": 10_000}
    token = {"mint": "m", "market_address": "c", "last_event_kind": "TRADE", "latest_signature": "s", "name": "n", "symbol": None, "quote_mint": "q", "base_volume": "10", "quote_volume": "20", "buys": 1, "sells": 2, "trades": 3, "traders": 2}
    token |= {"first_observed_ms": 1, "last_observed_ms": 2, "source": "PUMP", "venue": "PUMP_BONDING_CURVE", "stage": "QUALIFIED", "qualification": good}
    cases = [
        ({}, None), ({"mint": " "}, "mint"), ({"mint": None, "name": ""}, "mint"), ({"latest_signature": None}, "latest_signature"), ({"name": "  ", "symbol": ""}, "name"), ({"symbol": ""}, "symbol"), ({"quote_mint": None}, None), ({"quote_mint": " "}, "quote_mint"),
        ({"base_volume": "-1"}, "base_volume"), ({"quote_volume": None}, "quote_volume"), ({"buys": 2}, "activity"), ({"traders": 9}, "activity"), ({"first_observed_ms": 3}, "activity"), ({"venue": "PUMP_SWAP"}, "activity"),
        ({"qualification": good | {"buyers": 2}}, "qualification totals"), ({"qualification": good | {"closed_ms": 1}}, "qualification totals"), ({"qualification": good | {"top_share_bps": 10_001}}, "qualification totals"), ({"qualification": good | {"top_share_bps": None}}, None),
        ({"qualification": None}, "qualification"), ({"qualification": None, "stage": "OBSERVED"}, None), ({"qualification": good | {"decision": "REJECT"}}, "qualification"), ({"qualification": good | {"completeness": "INCOMPLETE"}}, "qualification"),
    ]
    shapes = spark.createDataFrame([tuple((token | change)[c.split()[0]] if not isinstance((token | change)[c.split()[0]], dict) else tuple((token | change)[c.split()[0]].values()) for c in schema.split(", ")) for change, _ in cases], schema)
    assert [r.v for r in shapes.coalesce(1).select(intake.token_shape_violation().alias("v")).collect()] == [v for _, v in cases]
    fields = ("network", "source", "venue", "market_address", "mint", "quote_mint")
    o = F.struct(*(F.lit(f).alias(f) for f in fields), F.lit(5).alias("received_ms"))
    for at, name in [(None, None), *((f, f) for f in fields)]:
        w = F.struct(*((F.lit("other") if f == at else F.lit(f)).alias(f) for f in fields), F.lit(5).alias("opened_ms"), F.lit(9).alias("closes_ms"))
        assert spark.range(1).select(o.alias("o"), w.alias("w")).select(windows.mismatch("o", "w", fields)).first()[0] == name
        active, ended = (F.struct(*(F.col(f"w.{c}").alias(c) for c in (*fields, "opened_ms", "closes_ms")), F.lit(status).alias("status")) for status in ("ACTIVE", "FINALIZED"))
        found = spark.range(1).select(o.alias("o"), w.alias("w")).select("o", active.alias("a"), ended.alias("e")).select(windows.membership_violation("o", "a"), windows.membership_violation("o", "e")).first()
        assert tuple(found) == (name, "WINDOW_NOT_ACTIVE")


def test_small_functions(spark):
    n = lambda x: F.lit(x).cast("long")
    assert one(spark, text.iso(n(1_704_067_200_123)), text.floor_zero(n(-3)), text.retention_cutoff(n(7_200_000), n(1)), text.retention_cutoff(n(-(2**63)), n(9))) == ("2024-01-01T00:00:00.123Z", 0, 3_600_000, -(2**63))
    assert one(spark, text.admission_deadline(n(1_000), n(3_000), 5_000, n(4_000)), text.admission_deadline(n(1_000), n(3_000), 5_000, n(6_000))) == (2_000, None)
    kept = text.evidence_columns(F.lit(b"x" * 13_000))
    digest, said, cut = one(spark, *kept.values())
    assert len(digest) == 64 and len(said.replace("\r\n", "")) == 16_384 and cut
    rule = lambda j: text.contract_violation(F.lit(j), {"n": (1, 9)}, {"mode": ["A", "B"]})
    assert one(spark, rule('{"n": 3, "mode": "A"}'), rule("[1]"), rule('{"n": 3.5, "mode": "A"}'), rule('{"n": 10, "mode": "A"}'), rule('{"n": 3, "mode": "C"}')) == (None, "$", "n", "n", "mode")
    assert one(spark, intake.mentions(F.array(F.lit("Program P invoke [2]")), "P"), intake.mentions(F.array(F.lit("Program PQ invoke [1]")), "P")) == (True, False)
    assert one(spark, *(intake.fresh(n(t), n(100_000), 15_000) for t in (85_000, 84_999, 110_000, 110_001, None))) == (True, False, True, False, False)


def test_dispatch_and_batches(spark):
    import base64

    row = lambda program, raw: (program, base64.b64encode(raw).decode())
    mark = layouts.FIRST_BYTES
    rows = [row("CURVE", layouts.INSTRUCTION_PREFIX + mark["TRADE"]), row("SWAP", mark["TRADE"]), row("SWAP", layouts.IGNORED["SWAP"][0]), row("CURVE", b"1234"), ("CURVE", "***"), row("SWAP", mark["BUY"] + b"x"), row(None, mark["BUY"])]
    found = [(r.kind, r.status) for r in layouts.dispatched(spark.createDataFrame(rows, "program string, payload string").coalesce(1)).collect()]
    assert found == [("TRADE", "DECODED"), (None, "UNKNOWN"), (None, "IGNORED"), (None, "TRUNCATED"), (None, "UNKNOWN"), ("BUY", "DECODED"), (None, "UNKNOWN")]
    batch = spark.createDataFrame([("a", 0, None), ("a", 1, "TRUNCATED"), ("a", 2, "LATER"), ("b", 0, None)], "signature string, position int, decode_error string")
    assert sorted((r.signature, r.position, r.batch_error) for r in layouts.one_fault_fails_all(batch, ["signature"]).collect()) == [("a", 0, "TRUNCATED"), ("a", 1, "TRUNCATED"), ("a", 2, "TRUNCATED"), ("b", 0, None)]


def test_wide_price_change_and_retention(spark):
    d = lambda x: None if x is None else Decimal(x)
    rows = [(100, 10, 150, 10), (2**63, 2**62, 2**64 - 1, 2**62), (2**64 - 1, 1, 1, 2**64 - 1), (None, 1, 1, 1), (0, 1, 1, 1), (1, 2**64 - 1, 2**64 - 1, 1)]
    df = spark.createDataFrame([tuple(map(d, r)) for r in rows], "a decimal(20,0), b decimal(20,0), c decimal(20,0), d decimal(20,0)").coalesce(1)
    assert [r.price_change_bps for r in exact.with_price_change(df, "a", "b", "c", "d").collect()] == [5000, 9999, -9999, None, None, None]
    one_col = lambda name, *at: spark.createDataFrame([(x,) for x in at], f"{name} long")
    found = projection.retention_classes(one_col("received_ms", 1, 10**9), one_col("seen_ms", 5), one_col("applied_ms"), 2 * 10**9, {"observations": 300, "quarantine": 1, "projection_events": 1})
    assert sorted(tuple(r) for r in found.collect()) == [("observations", 1), ("projection_events", 0), ("quarantine", 1)]
