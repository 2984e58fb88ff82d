"""As-of joins and running totals that split a busy key by time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windowmill.operators.storage import checkpointed


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, value: str, slot_ms: int, after: bool = False, strict: bool = False) -> DataFrame:
    """``left`` with the column ``value`` of the last row of ``right`` at or before its time, or the next at or after it.

    Both sides are cut into time slots. Rows of one key and slot are merged in order and
    the last value is carried forward; what enters a slot from earlier ones comes from
    one row for each key and slot. So a key that holds most rows is spread over its
    slots, and no row meets more than one other. ``strict`` leaves out equal times.
    Values of rows of equal keys and times are taken in the order of the value. Rows of
    a null time, and keys that ``right`` lacks, get NULL.
    """
    sign = -1 if after else 1
    kind = right.schema[value].dataType
    first, second = (0, 1) if not strict else (1, 0)
    row = F.struct(*left.columns)
    a = left.select(*keys, (F.col(left_at) * sign).alias("_at"), F.lit(second).alias("_side"), F.lit(None).cast(kind).alias("_value"), row.alias("_row"), F.floor(F.col(left_at) / slot_ms).alias("_slot"))
    b = right.filter(F.col(right_at).isNotNull()).select(*keys, (F.col(right_at) * sign).alias("_at"), F.lit(first).alias("_side"), F.col(value).alias("_value"), F.floor(F.col(right_at) / slot_ms).alias("_slot"))
    both = a.unionByName(b.withColumn("_row", F.lit(None).cast(a.schema["_row"].dataType)))
    of_right = F.col("_side") == first
    return _carried(both, keys, first, value, after)


def _carried(both: DataFrame, keys: list[str], right_side: int, value: str, after: bool = False) -> DataFrame:
    """Rows (_row) of one side with the last _value of the other before them; both are cut into slots of ascending _slot."""
    of_right = F.col("_side") == right_side
    slots = both.groupBy(*keys, "_slot").agg(F.max_by(F.when(of_right, F.col("_value")), F.when(of_right, F.struct("_at", "_value"))).alias("_last"))
    order = F.desc("_slot") if after else F.asc("_slot")
    entering = Window.partitionBy(*keys, F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select(*keys, "_slot", F.last("_last", ignorenulls=True).over(entering).alias("_enters"))
    inside = Window.partitionBy(*keys, "_slot").orderBy("_at", "_side", "_value").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("_inside", F.last("_value", ignorenulls=True).over(inside)).filter(F.col("_row").isNotNull())
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys] + [F.col("c._slot") == F.col("s._slot")]
    out = carried.alias("c").join(slots.alias("s"), same, "left")
    return out.select("c._row.*", F.coalesce("_inside", "_enters").alias(value))


def asof_position(left: DataFrame, right: DataFrame, keys: list[str], position: list[str], value: str, strict: bool = True) -> DataFrame:
    """``left`` with ``value`` of the last row of ``right`` before its position, a list of columns that both have.

    Positions compare column by column, NULL first. ``strict`` leaves out equal ones.
    Both sides are range-partitioned by keys and position together, so that each part
    holds about as many rows, and a key that holds most of them is split at ranks, however
    its positions are spread. What enters a part comes from one row for each key and
    part. The parts are written once, as their borders are sampled. Rows of ``right`` of
    equal keys and positions are taken in the order of the value.
    """
    kind, row = right.schema[value].dataType, F.struct(*left.columns)
    first, second = (1, 0) if strict else (0, 1)
    at = F.struct(*position).alias("_at")
    a = left.select(*keys, at, F.lit(second).alias("_side"), F.lit(None).cast(kind).alias("_value"), row.alias("_row"))
    b = right.select(*keys, at, F.lit(first).alias("_side"), F.col(value).alias("_value")).withColumn("_row", F.lit(None).cast(a.schema["_row"].dataType))
    both = checkpointed(a.unionByName(b).repartitionByRange(*keys, "_at", "_side").withColumn("_slot", F.spark_partition_id()))
    return _carried(both, keys, first, value)


def before(df: DataFrame, keys: list[str], order: list[Column], at: str, slot_ms: int, fold: Callable, value: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the fold (F.sum, F.max or F.min) of a value over earlier rows of the same keys; NULL if there are none.

    ``order`` must begin with the time ``at``, nulls first. Rows are folded within a time slot, and
    what enters a slot comes from one row for each key and slot, so a key that holds most rows is spread over its slots.
    """
    both = F.greatest if fold is F.max else F.least if fold is F.min else (lambda a, b: F.coalesce(a + b, a, b))
    cut = df.withColumn("_value", value).withColumn("_slot", F.floor(F.col(at) / slot_ms))
    slots = cut.groupBy(*keys, "_slot").agg(fold("_value").alias("_own"))
    entering = Window.partitionBy(*keys, F.lit(0)).orderBy(F.asc_nulls_first("_slot")).rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select(*keys, "_slot", fold("_own").over(entering).alias("_enters"))
    inside = Window.partitionBy(*keys, "_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("_inside", fold("_value").over(inside))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*keys, "_slot"]]
    return cut.alias("c").join(slots.alias("s"), same).select(*(F.col(f"c.`{c}`") for c in df.columns), both(F.col("_enters"), F.col("_inside")).alias(name))
