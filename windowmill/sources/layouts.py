"""Event bytes of all layouts, also those with strings and lists, to typed columns; addresses; pairing of copies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from windowmill.sources.logs import COMPLETE, DISCRIMINATORS, little_endian

#: What precedes the bytes of an event that is sent as an instruction.
INSTRUCTION_PREFIX = bytes([228, 69, 165, 46, 81, 203, 154, 29])
#: The first eight bytes of each event.
FIRST_BYTES = DISCRIMINATORS | {
    "CREATE_POOL": bytes([177, 49, 12, 210, 160, 118, 167, 116]),
    "BUY": bytes([103, 244, 82, 31, 44, 245, 119, 119]),
    "SELL": bytes([62, 47, 55, 10, 165, 3, 220, 42]),
    "LIQUIDITY_DEPOSIT": bytes([120, 248, 61, 83, 31, 142, 107, 144]),
    "LIQUIDITY_WITHDRAW": bytes([22, 9, 133, 26, 160, 44, 71, 192]),
}

#: First bytes of the events that a program also sends and that are known but not decoded.
IGNORED = {
    "CURVE": [
        bytes([64, 69, 192, 104, 29, 30, 25, 107]), bytes([245, 59, 70, 34, 75, 185, 109, 92]), bytes([147, 250, 108, 120, 247, 29, 67, 222]), bytes([226, 214, 246, 33, 7, 242, 147, 229]),
        bytes([79, 172, 246, 49, 205, 91, 206, 232]), bytes([146, 159, 189, 172, 146, 88, 56, 244]), bytes([122, 2, 127, 1, 14, 191, 12, 175]), bytes([165, 55, 129, 112, 4, 179, 202, 40]),
        bytes([97, 97, 215, 144, 93, 146, 22, 124]), bytes([134, 36, 13, 72, 232, 101, 130, 216]), bytes([155, 167, 104, 220, 213, 108, 243, 3]), bytes([168, 216, 132, 239, 235, 182, 49, 52]),
        bytes([43, 188, 250, 18, 221, 75, 187, 95]), bytes([237, 52, 123, 37, 245, 251, 72, 210]), bytes([142, 203, 6, 32, 127, 105, 191, 162]), bytes([223, 195, 159, 246, 62, 48, 143, 131]),
        bytes([197, 122, 167, 124, 116, 81, 91, 255]), bytes([182, 195, 137, 42, 35, 206, 207, 247]), bytes([117, 123, 228, 182, 161, 168, 220, 214]),
    ],
    "SWAP": [
        bytes([45, 220, 93, 24, 25, 97, 172, 104]), bytes([147, 250, 108, 120, 247, 29, 67, 222]), bytes([63, 69, 28, 22, 48, 92, 194, 185]), bytes([226, 214, 246, 33, 7, 242, 147, 229]),
        bytes([79, 172, 246, 49, 205, 91, 206, 232]), bytes([146, 159, 189, 172, 146, 88, 56, 244]), bytes([232, 245, 194, 238, 234, 218, 58, 89]), bytes([107, 52, 89, 129, 55, 226, 81, 22]),
        bytes([107, 253, 193, 76, 228, 202, 27, 104]), bytes([97, 97, 215, 144, 93, 146, 22, 124]), bytes([174, 124, 74, 249, 4, 81, 246, 17]), bytes([134, 36, 13, 72, 232, 101, 130, 216]),
        bytes([170, 221, 82, 199, 147, 165, 247, 46]), bytes([43, 188, 250, 18, 221, 75, 187, 95]), bytes([242, 231, 235, 102, 65, 99, 189, 211]), bytes([89, 128, 240, 141, 91, 202, 71, 105]),
        bytes([150, 107, 199, 123, 124, 207, 102, 228]), bytes([197, 122, 167, 124, 116, 81, 91, 255]), bytes([225, 152, 171, 87, 246, 63, 66, 234]), bytes([90, 23, 65, 35, 62, 244, 188, 208]),
    ],
}
#: Which events each program's own are.
OWN = {"CURVE": ["CREATE", "TRADE", "COMPLETE", "COMPLETE_PUMP_AMM_MIGRATION"], "SWAP": ["CREATE_POOL", "BUY", "SELL", "LIQUIDITY_DEPOSIT", "LIQUIDITY_WITHDRAW"]}


def dispatched(events: DataFrame, program: str = "program", payload: str = "payload") -> DataFrame:
    """Add kind and status of base64 payloads by their first bytes, the instruction prefix taken off.

    status is DECODED for a program's own events, which have a kind, IGNORED for those
    that are known, UNKNOWN for any other, and TRUNCATED below eight bytes. A payload
    that is no base64, or a program that is not known, is UNKNOWN.
    """
    whole = F.try_to_binary(F.col(payload), F.lit("base64"))
    bare = F.when(F.substring(whole, 1, 8) == F.lit(INSTRUCTION_PREFIX), F.substring(whole, F.lit(9), F.octet_length(whole))).otherwise(whole)
    mark = F.concat_ws(":", program, F.lower(F.hex(F.substring(bare, 1, 8))))
    kinds = {f"{p}:{FIRST_BYTES[k].hex()}": k for p, own in OWN.items() for k in own}
    kind = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))[mark]
    ignored = mark.isin([f"{p}:{b.hex()}" for p, known in IGNORED.items() for b in known])
    status = F.when(F.octet_length(bare) < 8, "TRUNCATED").when(kind.isNotNull(), "DECODED").when(ignored, "IGNORED").otherwise("UNKNOWN")
    return events.withColumn("kind", kind).withColumn("status", status)


def one_fault_fails_all(decoded_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Add batch_error: the first decode_error, by position, among the rows of a batch; NULL if there is none."""
    bad = decoded_rows.filter("decode_error is not null").groupBy(*keys).agg(F.min_by("decode_error", "position").alias("batch_error"))
    return decoded_rows.join(bad, keys, "left")


def _fields(text: str) -> list[tuple[str, str]]:
    """``type: name name ...`` lines to (name, type)."""
    return [(name, kind.strip()) for kind, names in (line.split(":") for line in text.strip().splitlines()) for name in names.split()]


#: The fields of each event in order. ``str`` and ``shares`` carry the most bytes or entries allowed.
LAYOUTS = {
    "CREATE": _fields("""
        str256: name
        str64: symbol
        str4096: uri
        key: mint bonding_curve user creator
        i64: timestamp
        u64: virtual_token_reserves virtual_sol_reserves real_token_reserves token_total_supply
        key: token_program
        bool: is_mayhem_mode is_cashback_enabled
        key: quote_mint
        u64: virtual_quote_reserves"""),
    "TRADE": _fields("""
        key: mint
        u64: sol_amount token_amount
        bool: is_buy
        key: user
        i64: timestamp
        u64: virtual_sol_reserves virtual_token_reserves real_sol_reserves real_token_reserves
        key: fee_recipient
        u64: fee_basis_points fee
        key: creator
        u64: creator_fee_basis_points creator_fee
        bool: track_volume
        u64: total_unclaimed_tokens total_claimed_tokens current_sol_volume
        i64: last_update_timestamp
        str96: ix_name
        bool: mayhem_mode
        u64: cashback_fee_basis_points cashback buyback_fee_basis_points buyback_fee
        shares64: shareholders
        key: quote_mint
        u64: quote_amount virtual_quote_reserves real_quote_reserves"""),
    "COMPLETE": COMPLETE,
    "COMPLETE_PUMP_AMM_MIGRATION": _fields("""
        key: user mint
        u64: mint_amount sol_amount pool_migration_fee
        key: bonding_curve
        i64: timestamp
        key: pool quote_mint"""),
    "CREATE_POOL": _fields("""
        i64: timestamp
        u16: index
        key: creator base_mint quote_mint
        u8: base_mint_decimals quote_mint_decimals
        u64: base_amount_in quote_amount_in pool_base_amount pool_quote_amount minimum_liquidity initial_liquidity lp_token_amount_out
        u8: pool_bump
        key: pool lp_mint user_base_token_account user_quote_token_account coin_creator
        bool: is_mayhem_mode"""),
    "BUY": _fields("""
        i64: timestamp
        u64: base_amount_out max_quote_amount_in user_base_token_reserves user_quote_token_reserves pool_base_token_reserves pool_quote_token_reserves quote_amount_in
        u64: lp_fee_basis_points lp_fee protocol_fee_basis_points protocol_fee quote_amount_in_with_lp_fee user_quote_amount_in
        key: pool user user_base_token_account user_quote_token_account protocol_fee_recipient protocol_fee_recipient_token_account coin_creator
        u64: coin_creator_fee_basis_points coin_creator_fee
        bool: track_volume
        u64: total_unclaimed_tokens total_claimed_tokens current_sol_volume
        i64: last_update_timestamp
        u64: min_base_amount_out
        str96: ix_name
        u64: cashback_fee_basis_points cashback buyback_fee_basis_points buyback_fee
        i128: virtual_quote_reserves
        bool: can_boost
        u64: base_supply"""),
    "SELL": _fields("""
        i64: timestamp
        u64: base_amount_in min_quote_amount_out user_base_token_reserves user_quote_token_reserves pool_base_token_reserves pool_quote_token_reserves quote_amount_out
        u64: lp_fee_basis_points lp_fee protocol_fee_basis_points protocol_fee quote_amount_out_without_lp_fee user_quote_amount_out
        key: pool user user_base_token_account user_quote_token_account protocol_fee_recipient protocol_fee_recipient_token_account coin_creator
        u64: coin_creator_fee_basis_points coin_creator_fee cashback_fee_basis_points cashback buyback_fee_basis_points buyback_fee
        i128: virtual_quote_reserves
        bool: can_boost
        u64: base_supply"""),
    "LIQUIDITY_DEPOSIT": _fields("""
        i64: timestamp
        u64: lp_token_amount_out max_base_amount_in max_quote_amount_in user_base_token_reserves user_quote_token_reserves pool_base_token_reserves pool_quote_token_reserves
        u64: base_amount_in quote_amount_in lp_mint_supply
        key: pool user user_base_token_account user_quote_token_account user_pool_token_account"""),
    "LIQUIDITY_WITHDRAW": _fields("""
        i64: timestamp
        u64: lp_token_amount_in min_base_amount_out min_quote_amount_out user_base_token_reserves user_quote_token_reserves pool_base_token_reserves pool_quote_token_reserves
        u64: base_amount_out quote_amount_out lp_mint_supply
        key: pool user user_base_token_account user_quote_token_account user_pool_token_account"""),
}
SIZES = {"key": 32, "u8": 1, "u16": 2, "u64": 8, "i64": 8, "i128": 16, "bool": 1}
SHARE = 34  # an address and two bytes


def _big(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(20,0)")


def _signed(number: Column) -> Column:
    return F.when(number >= _big(2**63), number - _big(2**64)).otherwise(number).cast("decimal(20,0)")


def _hexed(raw: Column, at: Column) -> Column:
    return F.lower(F.hex(F.substring(raw, at + 1, F.lit(32))))


def _value(raw: Column, kind: str, at: Column) -> Column:
    if kind == "key":
        return _hexed(raw, at)
    if kind == "i128":  # NULL beyond 38 digits
        return F.try_add(F.try_multiply(_signed(little_endian(raw, at + 8, 8)), _big(2**64)), little_endian(raw, at, 8)).cast("decimal(38,0)")
    number = little_endian(raw, at, SIZES[kind])
    return {"bool": number == 1, "i64": _signed(number).cast("long"), "u64": number}.get(kind, number.cast("int"))


def _share(raw: Column, first: Column):
    """The i-th share of a list; ``transform`` would take a second parameter for its index."""
    return lambda i: F.struct(_hexed(raw, first + i * SHARE).alias("address"), little_endian(raw, first + i * SHARE + 32, 2).cast("int").alias("share_bps"))


def decoded(events: DataFrame, kind: str, payload: str = "payload") -> DataFrame:
    """Add the fields of an event and decode_error, for base64 payloads with or without the instruction prefix.

    The error is the first in the order of the bytes: INVALID_BASE64 (a null payload
    too), UNKNOWN_DISCRIMINATOR, TRUNCATED, LIMIT_EXCEEDED, INVALID_UTF8,
    INVALID_BOOLEAN, at last TRAILING_BYTES; then every field is NULL. Keys are
    hexadecimal. A field behind a string or a list starts where that one ends, so
    each of these adds a column of the offset, and nothing leaves the JVM. A column
    of ``events`` named like a field is replaced.
    """
    whole = F.try_to_binary(F.col(payload), F.lit("base64"))
    bare = F.when(F.substring(whole, 1, 8) == F.lit(INSTRUCTION_PREFIX), F.substring(whole, F.lit(9), F.octet_length(whole))).otherwise(whole)
    out, raw, size = events.withColumn("_raw", bare).withColumn("_at0", F.lit(8)), F.col("_raw"), F.octet_length("_raw")
    steps, fields, base, plus, turn = [], {}, F.col("_at0"), 0, 0
    for name, t in LAYOUTS[kind]:
        at = base + plus
        if t in SIZES:
            fields[name], plus = _value(raw, t, at), plus + SIZES[t]
            if t == "bool":
                steps += [F.when(size < base + plus, "TRUNCATED"), F.when(little_endian(raw, at, 1) > 1, "INVALID_BOOLEAN")]
            continue
        text = t.startswith("str")
        most, width = int(t.removeprefix("str" if text else "shares")), 1 if text else SHARE
        turn += 1
        count = little_endian(raw, at, 4)
        out = out.withColumn(f"_n{turn}", F.when(count <= most, count).cast("int")).withColumn(f"_at{turn}", at + 4 + F.col(f"_n{turn}") * width)
        steps += [F.when(size < at + 4, "TRUNCATED"), F.when(count > most, "LIMIT_EXCEEDED"), F.when(size < F.col(f"_at{turn}"), "TRUNCATED")]
        n, first = F.col(f"_n{turn}"), at + 4
        if text:
            fields[name] = F.substring(raw, first + 1, n).cast("string")
            steps.append(F.when(~F.is_valid_utf8(fields[name]), "INVALID_UTF8"))
        else:
            fields[name] = F.transform(F.slice(F.sequence(F.lit(0), F.lit(most - 1)), F.lit(1), n), _share(raw, first))
        base, plus = F.col(f"_at{turn}"), 0
    wrong = F.when(raw.isNull(), "INVALID_BASE64").when(~F.coalesce(F.substring(raw, 1, 8) == F.lit(FIRST_BYTES[kind]), F.lit(False)), "UNKNOWN_DISCRIMINATOR")
    ends = F.when(size < base + plus, "TRUNCATED").when(size > base + plus, "TRAILING_BYTES")
    out = out.withColumn("decode_error", F.coalesce(wrong, *steps, ends))
    out = out.withColumns({name: F.when(F.col("decode_error").isNull(), value) for name, value in fields.items()})
    return out.drop("_raw", *(f"_{c}{k}" for k in range(turn + 1) for c in ("at", "n")))


#: The digits of base 58.
DIGITS = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def to_base58(data: bytes) -> str:
    number, out = int.from_bytes(data, "big"), []
    while number:
        number, digit = divmod(number, 58)
        out.append(DIGITS[digit])
    return DIGITS[0] * (len(data) - len(data.lstrip(b"\0"))) + "".join(reversed(out))


def from_base58(text: str) -> bytes | None:
    """None if a character is no digit."""
    number = 0
    for c in text:
        digit = DIGITS.find(c)
        if digit < 0:
            return None
        number = number * 58 + digit
    return bytes(len(text) - len(text.lstrip(DIGITS[0]))) + number.to_bytes(-(-number.bit_length() // 8), "big")


@F.pandas_udf(StringType())
def address(hexed: pd.Series) -> pd.Series:
    """Base 58 of hexadecimal keys; NULL stays NULL. Spark has no such function."""
    return hexed.map(lambda x: to_base58(bytes.fromhex(x)), na_action="ignore")


@F.pandas_udf(StringType())
def address_bytes(text: pd.Series) -> pd.Series:
    """Hexadecimal bytes of base-58 text; NULL if it is none."""
    found = text.map(from_base58, na_action="ignore")
    return found.map(lambda x: x.hex() if isinstance(x, bytes) else None)


def unmatched_copies(direct: DataFrame, sent: DataFrame) -> DataFrame:
    """Rows of ``sent`` without an own equal row in ``direct``: signature, instruction_index, payload, reason_code.

    Both hold signature, instruction_index and payload, the prefix taken off; equal
    rows pair one to one, and direct rows alone are no fault. A NULL equals a NULL.
    """
    keys = ["signature", "instruction_index", "payload"]
    numbered = lambda df: df.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1))).alias("copy"))
    a, b = numbered(sent).alias("a"), numbered(direct).alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*keys, "copy"]]
    return a.join(b, same, "left_anti").select(*keys, F.lit("CPI_EVENT_WITHOUT_CANONICAL_LOG").alias("reason_code"))
