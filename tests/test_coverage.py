"""Silent calls behind direct events, point reads, flat instructions, and folds over earlier rows."""

import random

import pytest
from pyspark.sql import functions as F

from windowmill.operators.asof import before
from windowmill.sources import coverage, transactions

GO, CALL, OK, DATA, USED = "Program P invoke [1]", "Program P invoke [2]", "Program P success", "Program data: a", "Program P consumed 5 of 9 compute units"
CASES = {
    "paired": ([GO, DATA, CALL, USED, OK, USED, OK], [(0, 1, False)]),
    "used between": ([GO, DATA, USED, CALL, OK, OK], [(0, 1, False)]),
    "two": ([GO, DATA, CALL, OK, DATA, CALL, OK, OK, GO, OK], [(0, 2, False), (1, 0, False)]),
    "no call": ([GO, DATA, OK], [(0, 0, True)]),
    "no event": ([GO, CALL, OK, OK], [(0, 0, True)]),
    "two events": ([GO, DATA, DATA, CALL, OK, OK], [(0, 1, True)]),
    "line between": ([GO, DATA, "Program log: x", CALL, OK, OK], [(0, 0, True)]),
    "other between": ([GO, DATA, "Program X invoke [2]", "Program X success", CALL, OK, OK], [(0, 0, True)]),
    "failed": ([GO, DATA, CALL, "Program P failed: no", OK], [(0, 0, True)]),
    "loud": ([GO, DATA, CALL, "Program log: x", OK, OK], [(0, 0, True)]),
    "half used": ([GO, DATA, "Program P consumed 5", CALL, OK, OK], [(0, 0, True)]),
    "loud alone": ([GO, CALL, "Program log: x", OK, OK], [(0, 0, False)]),
    "deep": ([GO, DATA, CALL, "Program X invoke [3]", "Program X success", OK, OK], [(0, 0, True)]),
    "inside another": (["Program X invoke [1]", "Program P invoke [2]", DATA, "Program P invoke [3]", OK, OK, "Program X success"], [(0, 1, False)]),
    "truncated": ([GO, "Log truncated"], "TRUNCATED_LOGS"),
    "depth": ([CALL], "INVALID_INVOCATION_DEPTH"),
    "exit": ([GO, "Program X success"], "UNEXPECTED_PROGRAM_EXIT"),
    "unclosed": ([GO], "UNCLOSED_INVOCATIONS"),
    "none": (None, []),
}


def test_call_coverage(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "signature string, log_messages array<string>")
    found = {k: [] for k in CASES}
    for r in coverage.call_coverage(df, "P").collect():
        found[r.signature].append(r.scope_error or (r.instruction_index, r.calls, r.gap))
    assert {k: sorted(v, key=str) for k, v in found.items()} == {k: [v[1]] if isinstance(v[1], str) else v[1] for k, v in CASES.items()}


def test_incomplete(spark):
    covered = spark.createDataFrame([("a", 0, 1, False, None), ("b", 0, 1, False, None), ("c", 0, 0, True, None), ("d", None, None, None, "TRUNCATED_LOGS")], "signature string, instruction_index int, calls int, gap boolean, scope_error string")
    direct = spark.createDataFrame([("a", 0, 1, False), ("b", 0, 1, False), ("b", 1, 1, False), ("e", 0, 0, False), ("f", 0, 0, True)], "signature string, instruction_index int, eligible int, invalid boolean")
    assert {tuple(r) for r in coverage.incomplete(covered, direct).collect()} == {("a", False), ("b", True), ("c", True), ("e", False), ("f", True)}


def test_enriched(spark):
    asked = spark.createDataFrame([("a", 5), ("a", 9), ("b", None), ("c", 1), ("d", 1), ("", 1), (None, 1)], "signature string, minimum_slot long")
    read = spark.createDataFrame([("a", 7, True, ["x"]), ("a", 6, True, ["old"]), ("b", 1, False, None), ("c", 1, True, None), ("", 1, True, [])], "signature string, slot long, has_meta boolean, log_messages array<string>")
    found = sorted(((r.signature, r.minimum_slot, r.read_status, r.log_messages) for r in transactions.enriched(asked, read).collect()), key=str)
    want = [("", 1, "EMPTY_SIGNATURE", None), ("a", 5, "OK", ["x"]), ("a", 9, "SLOT_TOO_LOW", None), ("b", None, "NO_META", None), ("c", 1, "NO_LOGS", None), ("d", 1, "NOT_FOUND", None), (None, 1, "EMPTY_SIGNATURE", None)]
    assert found == sorted(want, key=str)


def test_instructions(spark):
    call = "struct<program_id_index:int,accounts:array<int>,data:string>"
    schema = f"signature string, account_keys array<string>, loaded_writable array<string>, loaded_readonly array<string>, instructions array<{call}>, inner array<struct<index:int,instructions:array<{call}>>>"
    keys, one = (["k0", "k1"], ["w"], ["r"]), [(3, [0, 2], "d0"), (1, None, "d1")]
    rows = [
        ("good", *keys, one, [(1, [(0, [3], "i0"), (2, [], "i1")])]), ("beyond", *keys, one, [(2, [])]), ("twice", *keys, one, [(0, []), (0, [])]),
        ("range", *keys, [(4, [], "x")], None), ("account", *keys, [(0, [9], "x")], None), ("empty", None, None, None, None, None),
    ]
    found = {}
    for r in transactions.instructions(spark.createDataFrame(rows, schema)).collect():
        found.setdefault(r.signature, []).append(r.instruction_error or (r.outer_index, r.inner_index, r.program, r.accounts, r.data))
    assert sorted(found.pop("good"), key=str) == sorted([(0, None, "r", ["k0", "w"], "d0"), (1, None, "k1", [], "d1"), (1, 0, "k0", ["r"], "i0"), (1, 1, "w", [], "i1")], key=str)
    assert found == {"beyond": ["NO_OUTER_INSTRUCTION"], "twice": ["DUPLICATE_INNER_GROUP"], "range": ["PROGRAM_OUT_OF_RANGE"], "account": [(0, None, "k0", [None], "x")]}


@pytest.mark.parametrize(("fold", "plain"), [(F.max, max), (F.sum, sum), (F.min, min)])
def test_before_equals_plain(spark, fold, plain):
    draw = random.Random(4)
    rows = [(draw.choice(["hot", "hot", "a", None]), draw.choice([None, *range(40)]), i, draw.choice([None, 1, 5, 9])) for i in range(300)]
    df = spark.createDataFrame(rows, "mint string, at long, id long, v long")
    found = {r.id: r.seen for r in before(df, ["mint"], [F.asc_nulls_first("at"), F.col("id")], "at", 7, fold, F.col("v"), "seen").collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2])
    for r in rows:
        values = [o[3] for o in rows if o[0] == r[0] and key(o) < key(r) and o[3] is not None]
        assert found[r[2]] == (plain(values) if values else None)
