"""A fold over all rows in time order, cut into slices of time that are folded at once.

Each slice needs the state that the one before it leaves. All slices are first folded
from a guess, the state to which the last rows of the one before it lead; then each slice whose guess was wrong is folded again from what
the one before it left, until no guess is wrong. That is the result of one fold from
the first row to the last, whatever the fold; how soon it settles depends on how soon
the fold forgets. In every round the slices run side by side, and the part before the
first wrong guess grows by at least one slice.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windowmill.operators.storage import checkpointed

ROWS = 250_000
#: The part of the rows of a slice that lead to the first guess for the next one.
LEAD = 0.125


#: What a row is to its slice: the state from which it starts, a row before it, or its own.
STATE, LEADS, OWN = 0, 1, 2


class Fold(Protocol):
    """A small state, fed with batches of rows in order."""

    def feed(self, batch: pa.RecordBatch) -> pa.RecordBatch: ...
    def state(self) -> str: ...
    def rest(self) -> pa.RecordBatch: ...


def _tagged(at: int, out: pa.RecordBatch) -> pa.RecordBatch:
    fixed = [pa.array(np.full(len(out), at, np.int32)), pa.nulls(len(out), pa.string()), pa.nulls(len(out), pa.string())]
    return pa.RecordBatch.from_arrays([*fixed, *out.columns], ["_slice", "_state", "_began", *out.schema.names])


def _ended(at: int, fold: Fold, began: str, last: int) -> Iterator[pa.RecordBatch]:
    end, rest = fold.state(), fold.rest()
    if at == last:
        yield _tagged(at, rest)
    kept = [pa.array([at], pa.int32()), pa.array([end]), pa.array([began]), *(pa.nulls(1, c.type) for c in rest.columns)]
    yield pa.RecordBatch.from_arrays(kept, ["_slice", "_state", "_began", *rest.schema.names])


def _task(make: Callable[[str], Fold], last: int):
    """Rows sorted by slice, the first of each with its state and then those that lead to it, to results and the states at its begin and end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, fold, began = -1, None, None
        for batch in batches:
            ids, sides = batch["_slice"].to_numpy(), batch["_side"].to_numpy()
            cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]) | (sides[1:] != sides[:-1])) + 1).tolist(), len(ids)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if sides[a] == STATE:
                    if fold is not None:
                        yield from _ended(at, fold, fold.state() if began is None else began, last)
                    at, fold, began = int(ids[a]), make(batch["_state"][a].as_py() or ""), None
                elif sides[a] == LEADS:
                    fold.feed(batch.slice(a, b - a))
                else:
                    began = fold.state() if began is None else began
                    yield _tagged(at, fold.feed(batch.slice(a, b - a)))
        if fold is not None:
            yield from _ended(at, fold, fold.state() if began is None else began, last)

    return run


def sliced_fold(rows: DataFrame, at: str, order: list[str], make: Callable[[str], Fold], schema: str, rows_per_slice: int = ROWS) -> DataFrame:
    """What ``make('')``, fed with all rows in order, gives, its rest included.

    ``make(state)`` starts from a state. ``order`` must begin with the time ``at``; rows of
    one time stay in one slice. A slice holds about ``rows_per_slice`` rows, and a task
    keeps the state alone. Few rows are one slice, in one pass.
    """
    n = max(1, math.ceil(rows.count() / rows_per_slice))
    full = f"_slice int, _state string, _began string, {schema}"
    states = rows.sparkSession.range(n).select(F.col("id").cast("int").alias("_slice"), F.lit("").alias("_state"))

    def once(own: DataFrame, todo: DataFrame) -> DataFrame:
        both = own.withColumn("_state", F.lit(None).cast("string")).unionByName(todo.withColumn("_side", F.lit(STATE)), allowMissingColumns=True)
        return both.repartitionById(n, "_slice").sortWithinPartitions("_slice", "_side", *order).mapInArrow(_task(make, n - 1), full)

    if n == 1:
        return once(rows.withColumns({"_slice": F.lit(0), "_side": F.lit(OWN)}), states).filter("_state is null").drop("_slice", "_state", "_began")
    cut = checkpointed(rows.repartitionByRange(n, at).withColumns({"_slice": F.spark_partition_id(), "_side": F.lit(OWN)}))
    since = dict(cut.groupBy("_slice").agg(F.percentile_approx(at, 1 - LEAD)).collect())  # one time per slice
    leads = cut.filter(F.col(at) >= F.get(F.array(*(F.lit(since.get(i)).cast("long") for i in range(n - 1))), F.col("_slice"))).withColumns({"_slice": F.col("_slice") + 1, "_side": F.lit(LEADS)})
    todo, rounds = states, []
    while True:
        own = cut.join(todo.select("_slice"), "_slice", "left_semi") if rounds else cut.unionByName(leads)
        out = checkpointed(once(own, todo))
        ended = out.filter("_state is not null")
        states = ended.select("_slice", F.col("_began").alias("_state")) if not rounds else states
        rounds.append(out.withColumn("_round", F.lit(len(rounds))))
        left = ended.select((F.col("_slice") + 1).alias("_slice"), F.col("_state").alias("_new")).filter(F.col("_slice") < n)
        todo = checkpointed(states.join(left, "_slice").filter("_state <> _new").select("_slice", F.col("_new").alias("_state")))
        if todo.isEmpty():
            break
        states = checkpointed(states.join(todo.select("_slice"), "_slice", "left_anti").unionByName(todo))
    every = rounds[0]
    for more in rounds[1:]:
        every = every.unionByName(more)
    valid = every.filter("_state is not null").groupBy("_slice").agg(F.max("_round").alias("_round"))
    return every.filter("_state is null").join(valid, ["_slice", "_round"]).drop("_slice", "_round", "_state", "_began")
