"""Whether each direct event of a program is followed by the silent call of the program to itself that carries it."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windowmill.sources.logs import EXIT, INVOKE, MAX_DEPTH, MAX_INDEX, SUCCESS, by_lines

_CALLS = [pa.field("instruction_index", pa.int32()), pa.field("calls", pa.int32()), pa.field("gap", pa.bool_()), pa.field("scope_error", pa.string())]


def paired(lines: Iterable[str | None], program: str) -> tuple[list[tuple[int, int, bool]], str | None]:
    """(instruction, calls, gap) of each top-level instruction, and the first error; a null line does nothing.

    All frames of a stack belong to one instruction, so one count, one gap and one open event are enough.
    A frame is [program, own_call, silent, expected].
    """
    stack: list[list] = []
    found: list[tuple[int, int, bool]] = []
    following, calls, pending, gap = 0, 0, False, False
    for line in lines:
        if line is None:
            continue
        if line.startswith("Log truncated"):
            return [], "TRUNCATED_LOGS"
        top = stack[-1] if stack else None
        in_call = top is not None and top[1]
        in_program = top is not None and top[0] == program and not top[1]
        if call := INVOKE.match(line):
            depth = int(call[2])
            if depth > MAX_DEPTH or depth != len(stack) + 1:
                return [], "INVALID_INVOCATION_DEPTH"
            if depth == 1 and following > MAX_INDEX:
                return [], "TOO_MANY_INSTRUCTIONS"
            own_call = call[1] == program and any(f[0] == program for f in stack)
            expected = in_program and own_call and pending
            if in_call:
                top[2] = False
            if depth == 1:
                following, calls, pending, gap = following + 1, 0, False, False
            elif in_program and pending and not expected:
                pending, gap = False, True
            stack.append([call[1], own_call, own_call, expected])
        elif ended := EXIT.match(line):
            if top is None or top[0] != ended[1]:
                return [], "UNEXPECTED_PROGRAM_EXIT"
            succeeded = SUCCESS.match(line) is not None
            if top[1]:
                carried = top[3] and succeeded and top[2] and pending
                gap |= not carried if top[3] else succeeded and top[2]
                calls += carried
                pending = pending and not top[3]
            elif top[0] == program:
                gap, pending = gap or pending, False
            stack.pop()
            if not stack:
                found.append((following - 1, calls, gap))
        elif in_call or in_program:
            data = line.startswith("Program data: ")
            used = line.startswith(f"Program {top[0]} consumed ") and line.endswith(" compute units")
            if in_call:
                if data or not used:
                    top[2] = False
            elif data:
                gap, pending = gap or pending, True
            elif pending and not used:
                gap, pending = True, False
    return ([], "UNCLOSED_INVOCATIONS") if stack else (found, None)


def call_coverage(notifications: DataFrame, program: str) -> DataFrame:
    """signature, instruction_index, calls, gap, scope_error: of each top-level instruction, its silent calls that carry a direct event.

    ``gap`` tells of an event or call without its partner. Lines that do not nest give
    one row with scope_error. A null list has no instructions and gives no row.
    """

    def judge(_: str | None, lines: list[str | None]) -> list[tuple]:
        found, error = paired(lines, program)
        return [(None, None, None, error)] if error else [(*f, None) for f in found]

    return by_lines(notifications, judge, _CALLS)


def incomplete(coverage: DataFrame, direct: DataFrame) -> DataFrame:
    """signature, incomplete: a gap, an invalid event, or other counts of calls than of eligible direct events in any instruction.

    ``direct`` has signature, instruction_index, eligible and invalid; an instruction that
    only one side has counts as zero on the other. Rows of scope errors are left out.
    """
    covered = coverage.filter("scope_error is null").select("signature", "instruction_index", "calls", "gap")
    both = covered.join(direct.select("signature", "instruction_index", "eligible", "invalid"), ["signature", "instruction_index"], "full")
    wrong = F.coalesce("gap", F.lit(False)) | F.coalesce("invalid", F.lit(False)) | (F.coalesce("calls", F.lit(0)) != F.coalesce("eligible", F.lit(0)))
    return both.groupBy("signature").agg(F.bool_or(wrong).alias("incomplete"))
