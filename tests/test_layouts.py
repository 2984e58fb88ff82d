"""Every event layout there and back, each error, addresses and pairing."""

import base64
import struct

import pytest

from windowmill.sources import layouts

ODD = {"str": "né", "shares": [("ab" * 32, 7), ("00" * 32, 65535)]}
WHOLE = {"u8": 255, "u16": 65535, "u64": 2**64 - 1, "i64": -3, "i128": -(2**100) - 5, "bool": True}
PACK = {"u8": "<B", "u16": "<H", "u64": "<Q", "i64": "<q", "bool": "<B"}


def written(kind, changes=()):
    """The bytes of an event and its values, from the layout."""
    data, values = layouts.FIRST_BYTES[kind], {}
    for k, (name, t) in enumerate(layouts.LAYOUTS[kind]):
        if t == "key":
            value = f"{k:02x}" * 32
            raw = bytes.fromhex(value)
        elif t.startswith("str"):
            value = ODD["str"] * (k % 2 + 1)
            raw = struct.pack("<I", len(value.encode())) + value.encode()
        elif t.startswith("shares"):
            value = ODD["shares"]
            raw = struct.pack("<I", len(value)) + b"".join(bytes.fromhex(a) + struct.pack("<H", n) for a, n in value)
        else:
            value = WHOLE[t]
            raw = value.to_bytes(16, "little", signed=True) if t == "i128" else struct.pack(PACK[t], value)
        data += dict(changes).get(name, raw)
        values[name] = value
    return data, values


def read(spark, kind, raws):
    df = spark.createDataFrame([(i, None if r is None else r if isinstance(r, str) else base64.b64encode(r).decode()) for i, r in enumerate(raws)], "i int, payload string")
    return sorted(layouts.decoded(df, kind).collect())


@pytest.mark.parametrize("kind", sorted(layouts.LAYOUTS))
def test_round_trip(spark, kind):
    data, values = written(kind)
    rows = read(spark, kind, [data, layouts.INSTRUCTION_PREFIX + data, data[:-1], data + b"\0", data[:40], b"\0" * 8 + data[8:], "!", None])
    assert [r.decode_error for r in rows] == [None, None, "TRUNCATED", "TRAILING_BYTES", "TRUNCATED", "UNKNOWN_DISCRIMINATOR", "INVALID_BASE64", "INVALID_BASE64"]
    for row in rows[:2]:
        found = {k: [tuple(x) for x in v] if isinstance(v, list) else v for k, v in row.asDict().items() if k in values}
        assert found == values
    assert all(row[name] is None for row in rows[2:] for name in values)


def test_first_error_wins(spark):
    long, utf8 = struct.pack("<I", 257) + b"a" * 257, struct.pack("<I", 2) + b"\xc3\x28"
    cases = [{"name": long}, {"name": utf8}, {"name": struct.pack("<I", 0)}, {"is_mayhem_mode": b"\2"}, {"name": utf8, "is_mayhem_mode": b"\2"}, {"name": b"\xff" * 4}, {"name": struct.pack("<I", 256) + b"a" * 256}]
    found = [r.decode_error for r in read(spark, "CREATE", [written("CREATE", c)[0] for c in cases])]
    assert found == ["LIMIT_EXCEEDED", "INVALID_UTF8", None, "INVALID_BOOLEAN", "INVALID_UTF8", "LIMIT_EXCEEDED", None]
    shares = [struct.pack("<I", n) + bytes(34 * n) for n in (0, 64, 65)]
    rows = read(spark, "TRADE", [written("TRADE", {"shareholders": s})[0] for s in shares])
    assert [(r.decode_error, r.shareholders and len(r.shareholders)) for r in rows] == [(None, []), (None, 64), ("LIMIT_EXCEEDED", None)]


def test_wide_number_beyond_38_digits_is_null(spark):
    raw = written("SELL", {"virtual_quote_reserves": (2**127 - 1).to_bytes(16, "little")})[0]
    row = read(spark, "SELL", [raw])[0]
    assert (row.decode_error, row.virtual_quote_reserves, row.base_supply) == (None, None, 2**64 - 1)


def test_addresses(spark):
    cases = {b"Hello World!": "2NEpo7TZRRrLZSi2U", b"": "", bytes(32): "1" * 32, b"\0\0\1": "112"}
    rows = [(k.hex(), v) for k, v in cases.items()] + [(None, None), (None, "0OIl")]
    found = spark.createDataFrame(rows, "h string, t string").select("h", "t", layouts.address("h").alias("to"), layouts.address_bytes("t").alias("back")).collect()
    assert [(r.to, r.back) for r in found] == [(v, k.hex()) for k, v in cases.items()] + [(None, None)] * 2


def test_unmatched_copies(spark):
    schema = "signature string, instruction_index int, payload string"
    direct = spark.createDataFrame([("s", 0, "a"), ("s", 0, "b"), ("s", None, "n")], schema)
    sent = spark.createDataFrame([("s", 0, "a"), ("s", 0, "a"), ("s", 1, "b"), ("s", None, "n")], schema)
    rows = layouts.unmatched_copies(direct, sent).collect()
    assert sorted(tuple(r) for r in rows) == [("s", 0, "a", "CPI_EVENT_WITHOUT_CANONICAL_LOG"), ("s", 1, "b", "CPI_EVENT_WITHOUT_CANONICAL_LOG")]
    assert layouts.unmatched_copies(direct, sent.limit(0)).count() == 0
