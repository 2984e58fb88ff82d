"""The filter audit against a plain count over all orders."""

import re
from collections import Counter
from itertools import permutations

import pytest

from windowmill.llm import filter_audit

WORD = re.compile("[^\x20\x09-\x0d]+")


def fails(text):
    words = WORD.findall(text)
    found = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
    return {f for f, wrong in found.items() if wrong}


def plain(docs, labels):
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good, toxic = ({i for i, *marks in labels if i is not None and marks[k] == 1} for k in range(2))
    out = {}
    for part in {p or "" for *_, p in docs}:
        own = [(i, fails(t or "") | ({"E"} if i is not None and i > least[t or ""] else set())) for i, t, p in docs if (p or "") == part]
        removed, cells = Counter(), []
        for order in permutations("ABCDE"):
            left = list(own)
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                removed[f] += len(gone)
                failing = sum(f in x[1] for x in own)
                cells.append((f, "".join(order), step, (len(left), len(gone), failing - len(gone), sum(x[1] == {f} for x in own), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone))))
        out |= {(part, o, s): (*figures, removed[f]) for f, o, s, figures in cells}
    return out


def result(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


LONG = " ".join(f"w{k}" for k in range(250))
DOCS = [
    (1, LONG, "a"), (2, LONG, "a"), (2, LONG, "b"), (3, LONG, None), (None, LONG, "a"), (4, None, ""), (5, "", None), (6, " \t\n\x0b", "a"), (7, "same " * 300, "b"), (8, "same " * 300, "b"),
    (9, LONG.upper(), "b"), (10, LONG + " #", "a"), (11, "x" * 200_000, "c"), (11, "# A", "c"), (11, "# A", "c"), (12, "漢字   é " * 80, "c"), (13, LONG.replace("w1", "W1"), "a"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (None, 1, 1), (9, 1, 1), (11, None, 1), (99, 1, 1), (4, 1, 0)]


def frames(spark, docs, labels):
    from pyspark.sql import functions as F

    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({c: F.lit("clash") for c in ("part", "rows", "failures", "content", "labels", "quality", "first")})
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))


def test_audit_equals_plain_count_on_odd_rows(spark):
    found = filter_audit.filter_audit(*frames(spark, DOCS, LABELS))
    assert result(found) == plain(DOCS, LABELS)
    assert found.count() == 4 * 600


def test_audit_of_empty_tables(spark):
    assert filter_audit.filter_audit(*frames(spark, [], LABELS)).count() == 0
    assert result(filter_audit.filter_audit(*frames(spark, DOCS[:3], []))) == plain(DOCS[:3], [])


def test_many_parts_and_any_partitions(spark):
    docs = [(k, DOCS[k % 13][1], f"part{k % 97}") for k in range(400)]
    d, labels = frames(spark, docs, LABELS)
    assert result(filter_audit.filter_audit(d.repartition(7), labels)) == plain(docs, LABELS)


@pytest.mark.parametrize("order", ["ABCDE", "EDCBA", "CAEBD"])
def test_table_holds_the_first_failure(order):
    at = filter_audit.ORDERS.index(order)
    for m in range(32):
        failing = [s for s, f in enumerate(order) if m >> "ABCDE".index(f) & 1]
        assert filter_audit.FIRST[m, at] == (failing[0] if failing else 5)
