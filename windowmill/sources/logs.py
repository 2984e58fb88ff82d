"""Program logs to events: scoping of log lines by a small function inside tasks, and decoding of event bytes."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The first eight bytes of each event.
DISCRIMINATORS = {
    "COMPLETE": bytes([95, 114, 97, 156, 212, 46, 152, 8]),
    "COMPLETE_PUMP_AMM_MIGRATION": bytes([189, 233, 93, 185, 92, 148, 234, 148]),
    "CREATE": bytes([27, 114, 169, 77, 222, 235, 99, 118]),
    "TRADE": bytes([189, 219, 127, 211, 78, 230, 97, 238]),
}
#: Fields of the layouts whose size is fixed, in order.
COMPLETE = [("user", "key"), ("mint", "key"), ("bonding_curve", "key"), ("timestamp", "i64"), ("quote_mint", "key")]
_SIZES = {"key": 32, "u64": 8, "i64": 8, "bool": 1}
MAX_INDEX = 65_535
#: As Spark's own patterns match: ASCII classes, no line end inside, and ``$`` also before a last line end.
_END, _ANY = "(?=(?:\\r\\n|[\\n\\r\\x85\\u2028\\u2029])?\\Z)", "[^\\n\\r\\x85\\u2028\\u2029]*"
INVOKE = re.compile(rf"Program (\S+) invoke \[(\d+)\]{_END}", re.ASCII)
EXIT = re.compile(rf"Program (\S+)(?: success| failed: {_ANY}){_END}", re.ASCII)
SUCCESS = re.compile(rf"Program \S+ success{_END}", re.ASCII)
MAX_DEPTH = (1 << 31) - 1
_EVENTS = [pa.field("instruction_index", pa.int32()), pa.field("event_index", pa.int32()), pa.field("payload", pa.string()), pa.field("scope_error", pa.string())]


def scope(lines: Iterable[str | None], program: str) -> tuple[list[tuple[int, str]], str | None]:
    """(instruction, payload) of each data line, and the first error: invocations push, exits pop, data of the active program is kept; a null line does nothing."""
    stack: list[tuple[str, int]] = []
    out: list[tuple[int, str]] = []
    following = 0
    for line in lines:
        if line is None:
            continue
        if line.startswith("Log truncated"):
            return [], "TRUNCATED_LOGS"
        if call := INVOKE.match(line):
            depth = int(call[2])
            if depth > MAX_DEPTH or depth != len(stack) + 1:
                return [], "INVALID_INVOCATION_DEPTH"
            if depth == 1:
                if following > MAX_INDEX:
                    return [], "TOO_MANY_INSTRUCTIONS"
                following += 1
            stack.append((call[1], following - 1))
        elif ended := EXIT.match(line):
            if not stack or stack[-1][0] != ended[1]:
                return [], "UNEXPECTED_PROGRAM_EXIT"
            stack.pop()
        elif stack and stack[-1][0] == program and line.startswith("Program data: "):
            out.append((stack[-1][1], line[14:]))
    return ([], "UNCLOSED_INVOCATIONS") if stack else (out, None)


def by_lines(notifications: DataFrame, judge: Callable[[str | None, list[str | None]], list[tuple]], fields: list[pa.Field]) -> DataFrame:
    """signature, and the fields of each row that ``judge`` gives for the signature and lines of a notification; a null list has no lines.

    Each line is read once, by a small function inside tasks; no shuffle. The lines themselves go no further.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, owner = [], []
            for n, (signature, lines) in enumerate(zip(batch["signature"].to_pylist(), batch["log_messages"].to_pylist(), strict=True)):
                found = judge(signature, lines or [])
                rows += found
                owner += [n] * len(found)
            columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["signature"].take(pa.array(owner, pa.int32())), *arrays], ["signature", *(f.name for f in fields)])

    kinds = {pa.int32(): "int", pa.string(): "string", pa.bool_(): "boolean"}
    schema = ", ".join(["signature string", *(f"{f.name} {kinds[f.type]}" for f in fields)])
    return notifications.select("signature", F.col("log_messages").cast("array<string>").alias("log_messages")).mapInArrow(run, schema)


def numbered(events: list[tuple[int, str]]) -> list[tuple[int, int, str]]:
    """(instruction, event, payload): the events of each instruction numbered from 0."""
    seen: dict[int, int] = defaultdict(int)
    out = []
    for instruction, payload in events:
        out.append((instruction, seen[instruction], payload))
        seen[instruction] += 1
    return out


def events(signature: str | None, lines: list[str | None], program: str) -> tuple[list[tuple[int, int, str]], str | None]:
    """(instruction, event, payload) of each data line, and the first error; a blank signature is one."""
    if not (signature or "").strip(" "):
        return [], "EMPTY_SIGNATURE"
    out, error = scope(lines, program)
    return numbered(out), error


def scoped(notifications: DataFrame, program: str) -> DataFrame:
    """signature, event_index, instruction_index, payload of each data line of a program; else one row with scope_error.

    An instruction's events are numbered from 0. A null list has no lines; a blank signature is an error.
    """

    def judge(signature: str | None, lines: list[str | None]) -> list[tuple]:
        out, error = events(signature, lines, program)
        return [(None, None, None, error)] if error else [(*e, None) for e in out]

    return by_lines(notifications, judge, _EVENTS)


def little_endian(raw: Column, at: int, size: int) -> Column:
    """An unsigned number of ``size`` bytes from byte ``at`` on, as a decimal."""
    reversed_bytes = F.concat(*(F.substring(raw, at + 1 + n, F.lit(1)) for n in reversed(range(size))))
    return F.conv(F.hex(reversed_bytes), 16, 10).cast("decimal(20,0)")


def decoded(events: DataFrame, kind: str, layout: list[tuple[str, str]], payload: str = "payload") -> DataFrame:
    """Add the fields of a fixed-size layout and decode_error, for base64 payloads.

    Errors: INVALID_BASE64, UNKNOWN_DISCRIMINATOR, TRUNCATED, TRAILING_BYTES and
    INVALID_BOOLEAN; then every field is NULL. Keys are hexadecimal.
    """
    size = 8 + sum(_SIZES[t] for _, t in layout)
    raw = F.try_to_binary(F.col(payload), F.lit("base64"))
    at, fields, wrong = 8, {}, F.lit(False)
    for name, t in layout:
        if t == "key":
            fields[name] = F.lower(F.hex(F.substring(raw, at + 1, 32)))
        elif t == "bool":
            wrong = wrong | (little_endian(raw, at, 1) > 1)
            fields[name] = little_endian(raw, at, 1) == 1
        else:
            number = little_endian(raw, at, 8)
            fields[name] = number if t == "u64" else F.when(number >= F.lit(str(2**63)).cast("decimal(20,0)"), number - F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(number).cast("long")
        at += _SIZES[t]
    error = (
        F.when(raw.isNull(), "INVALID_BASE64").when(~F.coalesce(F.substring(raw, 1, 8) == F.lit(DISCRIMINATORS[kind]), F.lit(False)), "UNKNOWN_DISCRIMINATOR")
        .when(F.octet_length(raw) < size, "TRUNCATED").when(F.octet_length(raw) > size, "TRAILING_BYTES").when(wrong, "INVALID_BOOLEAN")
    )
    out = events.withColumn("decode_error", error)
    return out.withColumns({name: F.when(F.col("decode_error").isNull(), value) for name, value in fields.items()})
