"""How filters interact: what each removes, alone and after the others, in every order.

The failures of a document are a number of five bits. A table of 32 by 120, made
once, says for each such number and each order of the filters at which step the
document falls. Tasks look their documents up and count (part, order, step, labels)
in arrays; the arrays of a part are then added up, and every figure follows from them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windowmill.llm import common

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
#: first[failures, order]: the step at which a document falls, or STEPS if it passes.
FIRST = np.array([[next((s for s, f in enumerate(o) if m >> FILTERS.index(f) & 1), STEPS) for o in ORDERS] for m in range(1 << STEPS)], np.int64)
MIN_WORDS = 200
_UPPER, _MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
_LABELS = 4
_SHAPE = (len(ORDERS), STEPS + 1, _LABELS)
_FIGURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _FIGURES)


def failures(text: bytes) -> int:
    """Bits 0 to 3, for A to D: few words, few distinct words, many capitals, marks."""
    words = text.split()  # at ASCII white space
    capitals, points = len(text) - len(text.translate(None, _UPPER)), len(text.decode("utf-8", "surrogatepass"))
    marked = len(text.translate(None, _MARKS)) < len(text)
    return (len(words) < MIN_WORDS) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * capitals > 2 * points) << 2 | marked << 3


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, part, text to doc_id, part, failures, content: the digest of the text."""
    for batch in batches:
        fails, content = [], []
        for text in batch["text"].cast(pa.binary()):
            data = text.as_py() or b""
            fails.append(failures(data))
            content.append(hashlib.sha256(data).digest())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["part"], pa.array(fails, pa.int32()), pa.array(content, pa.binary())], ["doc_id", "part", "failures", "content"])


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, failures, labels, rows, sorted by part, to the array of each part in this task."""
    part, total = None, np.zeros(_SHAPE, np.int64).ravel()
    orders = np.arange(len(ORDERS))
    for batch in batches:
        coded = batch["part"].dictionary_encode()
        at, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        fails, labels, rows = (batch[c].to_numpy() for c in ("failures", "labels", "rows"))
        cuts = np.searchsorted(at, np.arange(len(names) + 1))  # sorted, so codes ascend
        for k, name in enumerate(names):
            if name != part:
                if part is not None:
                    yield _array(part, total)
                part, total = name, np.zeros_like(total)
            a, b = cuts[k], cuts[k + 1]
            cell = ((orders * (STEPS + 1) + FIRST[fails[a:b]]) * _LABELS + labels[a:b, None]).ravel()
            total += np.bincount(cell, np.repeat(rows[a:b], len(ORDERS)), len(total)).astype(np.int64)
    if part is not None:
        yield _array(part, total)


def _array(part: str, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([total.astype("<i8").tobytes()], pa.binary())], ["part", "total"])


def _figures(part: str, total: np.ndarray) -> pa.RecordBatch:
    """All rows of a part from its array."""
    by_label = total.reshape(_SHAPE)
    fell, good, toxic = by_label.sum(axis=2), by_label[:, :, [1, 3]].sum(axis=2), by_label[:, :, [2, 3]].sum(axis=2)
    name = np.array([[FILTERS.index(f) for f in o] for o in ORDERS])
    removed, every = fell[:, :STEPS], int(fell[0].sum())
    fails = np.array([removed[name[:, 0] == f, 0][0] for f in range(STEPS)])  # who comes first removes all it can
    alone = np.array([removed[name[:, -1] == f, -1][0] for f in range(STEPS)])  # who comes last, what no other does
    shapley = np.bincount(name.ravel(), removed.ravel(), STEPS).astype(np.int64)
    figures = [every - removed.cumsum(axis=1), removed, fails[name] - removed, alone[name], good[:, :STEPS], toxic[:, :STEPS], shapley[name]]
    n = len(ORDERS) * STEPS
    fixed = [pa.array([part] * n), pa.array(np.repeat(ORDERS, STEPS).tolist()), pa.array(np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS)))]
    return pa.RecordBatch.from_arrays([*fixed, *(pa.array(x.ravel().astype(np.int64)) for x in figures)], ["part", "filter_order", "step", *_FIGURES])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, total, sorted by part, to the figures of each part; one array is held at a time."""
    part, sum_ = None, None
    for name, total in common.rows(batches):
        if name != part:
            if part is not None:
                yield _figures(part, sum_)
            part, sum_ = name, np.zeros(int(np.prod(_SHAPE)), np.int64)
        sum_ += np.frombuffer(total, "<i8")
    if part is not None:
        yield _figures(part, sum_)


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", quality_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """One row per part, order of the filters and step; see SCHEMA.

    A null text is empty, a null part is ''. Texts are told apart by their SHA-256. A
    document repeats another if its id is larger than the smallest id of its text; rows
    of this smallest id, and rows of a null id, repeat none. A document is good (toxic)
    if any label row of its id says so; labels of a null id count for none. Repeated
    rows count each. Other columns are ignored; no document gives no row.

    The smallest ids come back by a join on text and id together, and equal rows are
    added up before they are shuffled, so no text, id or part, however common, meets
    in one task. A part reaches its last task as one array per task before.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text"))
    judged = common.materialize(own.mapInArrow(_judged, "doc_id long, part string, failures int, content binary"), "audit-judged")
    least = judged.filter("doc_id is not null").groupBy("content").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    rows = judged.groupBy("doc_id", "content", "part", "failures").agg(F.count("*").alias("rows"))
    said = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(quality_col).alias("_q"), F.col(toxic_col).alias("_t")).filter("doc_id is not null")
    marks = marks.groupBy("doc_id").agg((said("_q") + 2 * said("_t")).alias("labels"))
    rows = rows.join(least, ["doc_id", "content"], "left").join(marks, "doc_id", "left")
    repeats = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    rows = rows.select("part", (F.col("failures") + repeats).cast("int").alias("failures"), F.coalesce("labels", F.lit(0)).cast("int").alias("labels"), "rows")
    arrays = rows.sortWithinPartitions("part").mapInArrow(_looked_up, "part string, total binary")
    n = common.partitions(docs.sparkSession)
    return arrays.repartition(n, "part").sortWithinPartitions("part").mapInArrow(_added, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    """op11: all documents by source."""
    return filter_audit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, coalesce(max(CASE WHEN quality = 1 THEN 1 END), 0) AS good, coalesce(max(CASE WHEN toxic = 1 THEN 1 END), 0) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
        || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails
      FROM w LEFT JOIN l USING (doc_id)),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
o(ord) AS (SELECT '' UNION ALL SELECT ord || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(ord, x)),
orders AS (SELECT ord FROM o WHERE length(ord) = 5),
cells AS (SELECT part, ord, step, ord[step] AS filter, n, good, toxic, contains(fails, ord[step]) AS failing, fails = ord[step] AS only_it,
            len(list_filter(string_split(ord[1 : step - 1], ''), lambda x: x <> '' AND contains(fails, x))) > 0 AS gone
          FROM g, orders, (SELECT unnest(range(1, 6)) AS step)),
c AS (SELECT part, ord, step, filter, sum(CASE WHEN NOT gone AND NOT failing THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND failing THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN gone AND failing THEN n ELSE 0 END) AS redundant, sum(CASE WHEN only_it THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN NOT gone AND failing THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND failing THEN toxic ELSE 0 END) AS toxic_lost
      FROM cells GROUP BY part, ord, step, filter)
SELECT part, ord AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM c
"""
