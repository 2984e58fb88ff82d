"""Contracts of JSON texts and episodes of gaps, by literal cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from windowmill.functions import contract
from windowmill.functions.contract import Field
from windowmill.operators import gaps

FIELDS = [
    Field("$.mint", "string"), Field("$.stage", "string", names=("OBSERVED", "APPROVED")), Field("$.counts", "object"), Field("$.counts.trades", "integer"), Field("$.counts.share", "integer", required=False, nullable=True, high=10_000),
    Field("$.open", "boolean"), Field("$.tags", "strings", required=False),
]
GOOD = {"mint": "m", "stage": "OBSERVED", "counts": {"trades": 3, "share": 9}, "open": True, "tags": ["a", "b"]}


def but(**changes):
    out = json.loads(json.dumps(GOOD))
    for path, value in changes.items():
        *parents, name = path.split("__")
        at = out
        for p in parents:
            at = at[p]
        if value is ...:
            del at[name]
        else:
            at[name] = value
    return json.dumps(out)


CASES = {
    json.dumps(GOOD): None, "{": "INVALID_JSON $", "": "INVALID_JSON $", "[1]": "WRONG_TYPE $", "null": "WRONG_TYPE $", '{"mint": "m", "mint": "n"}': "INVALID_JSON $",
    but(mint=...): "MISSING $.mint", but(mint=None): "WRONG_TYPE $.mint", but(mint=5): "WRONG_TYPE $.mint", but(stage="X"): "UNKNOWN_NAME $.stage", but(counts=[1]): "WRONG_TYPE $.counts",
    but(counts__trades="3"): "WRONG_TYPE $.counts.trades", but(counts__trades=1.5): "WRONG_TYPE $.counts.trades", but(counts__trades=-1): "OUT_OF_RANGE $.counts.trades", but(counts__trades=2**53): "OUT_OF_RANGE $.counts.trades",
    but(counts__trades=2**70): "OUT_OF_RANGE $.counts.trades", but(counts__share=None): None, but(counts__share=...): None, but(counts__share=10_001): "OUT_OF_RANGE $.counts.share", but(counts__other=1): "UNKNOWN_FIELD $.counts.other",
    but(extra=1): "UNKNOWN_FIELD $.extra", but(open="true"): "WRONG_TYPE $.open", but(tags=["a", 1]): "WRONG_TYPE $.tags[]", but(tags="a"): "WRONG_TYPE $.tags", but(tags=[]): None, but(tags=...): None,
}


def test_first_faults(spark):
    df = spark.createDataFrame([*CASES.items(), (None, "INVALID_JSON $")], "text string, expected string").withColumn("found", contract.fault(F.col("text"), FIELDS))
    assert [r for r in df.collect() if r.found != r.expected] == []
    loose = df.withColumn("found", contract.fault(F.col("text"), FIELDS, strict=False)).filter("expected like 'UNKNOWN_FIELD%'")
    assert {r.found for r in loose.collect()} == {None}


def message(**changes):
    out = {"jsonrpc": "2.0", "method": "logsNotification", "params": {"result": {"context": {"slot": 5}, "value": {"signature": "s", "logs": ["a"], "err": None}}, "subscription": 7}}
    return json.dumps(out | changes)


@pytest.mark.parametrize(
    ("text", "status", "fault"),
    [
        (message(), "ACCEPTED", None), (message(extra=1), "ACCEPTED", None), (message(method="other"), "SKIPPED", None), (message(method=None), "SKIPPED", None), ('{"id": 1, "result": 7}', "SKIPPED", None),
        (message(error={"code": 1}), "REJECTED", "RPC_ERROR $.error"), ("no", "REJECTED", "INVALID_JSON $"), (message(jsonrpc="1.0"), "REJECTED", "NOT_JSON_RPC_2 $.jsonrpc"),
        (message(params={"subscription": 7}), "REJECTED", "MISSING $.params.result"), (message().replace('"subscription": 7', '"subscription": 8'), "REJECTED", "FOREIGN_SUBSCRIPTION $.params.subscription"),
        (message().replace('"slot": 5', '"slot": "5"'), "REJECTED", "WRONG_TYPE $.params.result.context.slot"),
    ],
)
def test_notifications(spark, text, status, fault):
    row = spark.createDataFrame([(text,)], "text string").select(*(c.alias(n) for n, c in contract.notifications(F.col("text"), F.lit(7)).items())).first()
    assert (row.status, row.fault) == (status, fault) and (row.slot, row.log_messages) == ((5, ["a"]) if status == "ACCEPTED" else (None, None))


GAP = "network string, source string, reason string, prior_slot long, prior_signature string, at_ms long, ordinal long, action string, prior_index long, details string, through_slot long, through_index long, through_signature string"


def plain_episodes(rows):
    out, active = {}, {}
    for r in sorted(rows, key=lambda r: (r[5], r[6])):
        key, (at, _, action, index, details, slot, through, signature) = r[:5], r[5:]
        done = out.setdefault(key, [])
        a = active.get(key)
        if action == "DETECT":
            active[key] = [at, index, details, 1, 0] if a is None else [min(a[0], at), a[1] if a[1] is not None else index, details, a[3] + 1, a[4]]
        elif a is not None:
            if slot < key[3] or slot == key[3] and through is not None and a[1] is not None and through < a[1]:
                a[4] += 1
            else:
                done.append((*active.pop(key), "RESOLVED", at, slot, through, signature))
    return sorted(((*k, n, *e) for k, es in out.items() for n, e in enumerate(es + ([(*active[k], "ACTIVE", None, None, None, None)] if k in active else []))), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_gap_episodes(spark, seed):
    pick = random.Random(seed)
    rows = []
    for n in range(300):
        key = ("MAINNET", pick.choice("AB"), pick.choice(["R", "S"]), pick.choice([5, 6]), "p")
        detect = pick.random() < 0.6
        rows.append((*key, pick.randrange(400), n, "DETECT" if detect else "RESOLVE", pick.choice([None, 1, 2, 3]) if detect else None, f"d{n}" if detect else None, None if detect else pick.choice([4, 5, 5, 6]), None if detect else pick.choice([None, 1, 2]), None if detect else f"s{n}"))
    found = gaps.episodes(spark.createDataFrame(rows, GAP), 50)
    assert sorted(map(tuple, found.collect()), key=repr) == plain_episodes(rows)
    assert gaps.episodes(spark.createDataFrame([], GAP)).count() == 0
