"""Log lines and event bytes made from the driver's events, for the decoders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windowmill.sources import adapters
from windowmill.sources.layouts import FIRST_BYTES, INSTRUCTION_PREFIX, LAYOUTS

PROGRAM, OTHER = "Prog1111", "Other222"


def _said(letter: str) -> Column:
    """The base64 payload of a line of an event."""
    return F.base64(F.concat(F.lit(letter), F.col("event_id").cast("string")).cast("binary"))


def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signature, log_messages: six shapes of a transaction, by k."""
    data = lambda letter: F.concat(F.lit("Program data: "), _said(letter))
    go = lambda program, depth: F.lit(f"Program {program} invoke [{depth}]")
    ok = lambda program: F.lit(f"Program {program} success")
    used = F.lit(f"Program {PROGRAM} consumed 10 of 200 compute units")
    shapes = [
        [go(PROGRAM, 1), data("a"), ok(PROGRAM)],
        [go(OTHER, 1), data("x"), ok(OTHER), go(PROGRAM, 1), data("a"), data("b"), used, ok(PROGRAM)],
        [go(OTHER, 1), go(PROGRAM, 2), data("a"), ok(PROGRAM), data("x"), ok(OTHER)],
        [go(PROGRAM, 1), data("a"), F.lit("Log truncated")],
        [go(PROGRAM, 2), data("a"), ok(PROGRAM)],
        [go(PROGRAM, 1), data("a")],
    ]
    lines = F.lit(None).cast("array<string>")
    for n, shape in enumerate(shapes):
        lines = F.when(F.col("k") % len(shapes) == n, F.array(*shape)).otherwise(lines)
    return adapters.notifications(spark, sf_dir, read=adapters.spread).select("signature", lines.alias("log_messages"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signature, log_messages: one notification for each event, in six shapes by k, of direct events and the calls that carry them."""
    go = lambda program, depth: F.lit(f"Program {program} invoke [{depth}]")
    data, call, ok = F.concat(F.lit("Program data: "), _said("a")), go(PROGRAM, 2), F.lit(f"Program {PROGRAM} success")
    used = F.lit(f"Program {PROGRAM} consumed 10 of 200 compute units")
    shapes = [
        [go(PROGRAM, 1), data, call, used, ok, ok],
        [go(PROGRAM, 1), data, ok],
        [go(PROGRAM, 1), data, data, call, ok, ok],
        [go(PROGRAM, 1), data, F.lit("Program log: between"), call, ok, ok],
        [go(OTHER, 1), F.lit(f"Program {OTHER} success"), go(PROGRAM, 1), data, used, call, ok, ok],
        [go(PROGRAM, 1), data, call, ok],
    ]
    lines = F.lit(None).cast("array<string>")
    for n, shape in enumerate(shapes):
        lines = F.when(F.col("k") % len(shapes) == n, F.array(*shape)).otherwise(lines)
    return adapters.notifications(spark, sf_dir, read=adapters.spread).select(F.concat(F.lit("n"), F.col("event_id").cast("string")).alias("signature"), lines.alias("log_messages"))


def _key(letter: str) -> Column:
    return F.sha2(F.concat(F.lit(letter), F.col("event_id").cast("string")), 256)


def _little(number: Column) -> Column:
    """Sixteen hexadecimal digits of a non-negative number, lowest byte first."""
    digits = F.lpad(F.hex(number), 16, "0")
    return F.concat(*(F.substring(digits, n, 2) for n in range(15, 0, -2)))


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, payload: completion events; by k some are cut, too long, of unknown first bytes, or no base64."""
    fault = F.col("k") % 7
    first = F.when(fault == 2, "00" * 8).otherwise(FIRST_BYTES["COMPLETE"].hex())
    whole = F.concat(first, _key("u"), _key("m"), _key("c"), _little(F.col("received_ms")), _key("q"))
    whole = F.when(fault == 0, F.substring(whole, 1, 2 * (8 + 4 * 32 + 7))).when(fault == 1, F.concat(whole, F.lit("00"))).otherwise(whole)
    return adapters.notifications(spark, sf_dir, read=adapters.spread).select("event_id", F.when(fault == 3, "***").otherwise(F.base64(F.unhex(whole))).alias("payload"))


def first_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, program, payload: a decoded event, one behind the instruction prefix, an ignored and an unknown one, by k."""
    turn = F.col("k") % 4
    raw = (
        F.when(turn == 0, FIRST_BYTES["COMPLETE"].hex()).when(turn == 1, (INSTRUCTION_PREFIX + FIRST_BYTES["TRADE"]).hex())
        .when(turn == 2, bytes([64, 69, 192, 104, 29, 30, 25, 107]).hex()).otherwise("01" * 8)
    )
    return adapters.notifications(spark, sf_dir, read=adapters.spread).select("event_id", F.when(F.col("k") % 2 == 0, "CURVE").otherwise("SWAP").alias("program"), F.base64(F.unhex(raw)).alias("payload"))


def copies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(direct, sent) events: signature, instruction_index, payload; many are equal, and some are sent twice."""
    e = adapters.notifications(spark, sf_dir, read=adapters.spread)
    row = [F.concat(F.lit("s"), F.floor(F.col("event_id") / 40).cast("string")).alias("signature"), (F.col("k") % 2).alias("instruction_index"), F.concat(F.lit("p"), (F.col("k") % 3).cast("string")).alias("payload")]
    sent = e.filter("event_id % 2 = 0")
    return e.select(*row), sent.unionByName(e.filter("event_id % 3 = 0")).select(*row)


def traffic(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """signature, source, received_ms, event_id, log_messages: a notification for each event, with a completion and the call that carries it.

    Some, by k, are cut short, call at a wrong depth, hold unknown or cut bytes, lack the
    call, hold an ignored event, or name another program alone.
    """
    k = F.col("k")
    go = lambda program, depth: F.lit(f"Program {program} invoke [{depth}]")
    ok, used = F.lit(f"Program {PROGRAM} success"), F.lit(f"Program {PROGRAM} consumed 10 of 200 compute units")
    whole = F.concat(F.lit(FIRST_BYTES["COMPLETE"].hex()), _key("u"), _key("m"), _key("c"), _little(F.col("received_ms")), _key("q"))
    ignored = bytes([64, 69, 192, 104, 29, 30, 25, 107]).hex()
    raw = F.when(k == 83, "00" * 8).when(k == 84, F.substring(whole, 1, 100)).when(k == 86, ignored).otherwise(whole)
    data, call = F.concat(F.lit("Program data: "), F.base64(F.unhex(raw))), go(PROGRAM, 2)
    lines = (
        F.when(k == 81, F.array(go(PROGRAM, 1), data, F.lit("Log truncated"))).when(k == 82, F.array(go(PROGRAM, 2), data, ok)).when(k == 85, F.array(go(PROGRAM, 1), data, ok))
        .when(k == 87, F.array(go(OTHER, 1), F.lit(f"Program {OTHER} success"))).otherwise(F.array(go(PROGRAM, 1), data, call, used, ok, ok))
    )
    return adapters.notifications(spark, sf_dir, read=adapters.spread, events=events).select("signature", "source", "mint", "asset", "received_ms", "event_id", lines.alias("log_messages"))


#: What the numbers of a layout are made from: (event id + place of the field) modulo this.
WRAPS = {"u8": 200, "u16": 60_000, "u64": 1 << 40, "i64": 1 << 40, "i128": 1 << 40}


def _digits(number: Column, size: int) -> Column:
    """Hexadecimal digits of ``size`` bytes, lowest first."""
    return F.substring(_little(number.cast("long")), 1, 2 * size) if size <= 8 else F.concat(_little(number.cast("long")), F.lit("00" * (size - 8)))


def _encoded(kind: str, place: int) -> Column:
    """A field of a layout, made from the event and the field's place."""
    event = F.col("event_id")
    if kind == "key":
        return _key(f"f{place}-")
    if kind == "bool":
        return F.when((event + place) % 2 == 0, "00").otherwise("01")
    if kind.startswith("str"):
        text = F.concat(F.lit(f"t{place}-"), event.cast("string"))
        return F.concat(_digits(F.length(text), 4), F.hex(text.cast("binary")))
    if kind.startswith("shares"):
        return F.concat(_digits(event % 3, 4), *(F.when(event % 3 > n, F.concat(_key(f"s{n}-"), _digits((event + n) % 9000, 2))).otherwise("") for n in range(2)))
    return _digits((event + place) % WRAPS[kind], {"u8": 1, "u16": 2, "i128": 16}.get(kind, 8))


def layout_events(spark: SparkSession, sf_dir: str, kind: str, turn: int) -> DataFrame:
    """event_id, payload: every so manieth event as bytes of a layout; by k one is a byte short, one a byte too long, one behind the instruction prefix."""
    k = F.col("k")
    whole = F.concat(F.lit(FIRST_BYTES[kind].hex()), *(_encoded(t, n) for n, (_, t) in enumerate(LAYOUTS[kind])))
    raw = F.when(k == 71, F.expr("left(_whole, length(_whole) - 2)")).when(k == 72, F.concat("_whole", F.lit("00"))).when(k == 73, F.concat(F.lit(INSTRUCTION_PREFIX.hex()), F.col("_whole"))).otherwise(F.col("_whole"))
    return adapters.notifications(spark, sf_dir, read=adapters.spread).filter(F.col("event_id") % len(LAYOUTS) == turn).withColumn("_whole", whole).select("event_id", F.base64(F.unhex(raw)).alias("payload"))
