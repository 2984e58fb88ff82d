"""Coverage gaps as episodes: repeated detections merge, a resolution behind the prior position ends one.

Events: DETECT and RESOLVE rows of a gap's key (network, source, reason, prior_slot,
prior_signature), in the order (at_ms, ordinal); a detection has prior_index (may be
NULL) and details, a resolution through_slot, through_index and through_signature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windowmill.operators.asof import before

KEY = ["network", "source", "reason", "prior_slot", "prior_signature"]
DAY_MS = 86_400_000
_SEEN = "struct<detected_ms:bigint,prior_index:bigint,details:string,detections:bigint,rejected:bigint>"
_ENDED = "struct<seen:struct<detected_ms:bigint,prior_index:bigint,details:string,detections:bigint,rejected:bigint>,end:struct<at_ms:bigint,through_slot:bigint,through_index:bigint,through_signature:string>>"
_STATE = f"struct<active:{_SEEN},ended:array<{_ENDED}>,ignored:bigint>"


def precedes(slot: Column, index: Column, prior_slot: Column, prior_index: Column) -> Column:
    """Is a position before another? Of one slot only where both indexes are known."""
    return (slot < prior_slot) | ((slot == prior_slot) & F.coalesce(index < prior_index, F.lit(False)))


def _merged(s: Column, x: Column) -> Column:
    """The state after the detections of a group and the resolution behind them, either of which may be absent."""
    seen = F.when(x.seen.detections == 0, s.active).when(s.active.isNull(), x.seen).otherwise(
        F.struct(
            F.least(s.active.detected_ms, x.seen.detected_ms).alias("detected_ms"), F.coalesce(s.active.prior_index, x.seen.prior_index).alias("prior_index"), x.seen.details.alias("details"),
            (s.active.detections + x.seen.detections).alias("detections"), s.active.rejected.alias("rejected"),
        ).cast(_SEEN)
    )
    back = precedes(x.end.through_slot, x.end.through_index, x.prior_slot, seen.prior_index)
    refused = F.struct(seen.detected_ms.alias("detected_ms"), seen.prior_index.alias("prior_index"), seen.details.alias("details"), seen.detections.alias("detections"), (seen.rejected + 1).alias("rejected")).cast(_SEEN)
    none = F.lit(None).cast(_SEEN)
    state = lambda active, ended, ignored: F.struct(active.alias("active"), ended.alias("ended"), ignored.alias("ignored")).cast(_STATE)
    return (
        F.when(x.end.isNull(), state(seen, s.ended, s.ignored)).when(seen.isNull(), state(none, s.ended, s.ignored + 1))
        .when(back, state(refused, s.ended, s.ignored)).otherwise(state(none, F.concat(s.ended, F.array(F.struct(seen.alias("seen"), x.end.alias("end")).cast(_ENDED))), s.ignored))
    )


def episodes(events: DataFrame, slot_ms: int = DAY_MS) -> DataFrame:
    """One row per gap: KEY, episode, detected_ms, prior_index, details, detections, rejected, status, resolved_ms, through_slot, through_index, through_signature.

    A detection of an unresolved gap merges into it: the earliest time, the first known
    index, the last details. A resolution before the prior position is refused and
    counted, one without an open gap does nothing; the next detection begins another
    episode. Detections between two resolutions are added up before they are shuffled to
    their key, so a gap that is told without end is a few rows there.
    """
    told = events.filter("at_ms is not null").withColumn("_ends", (F.col("action") == "RESOLVE").cast("int"))
    placed = before(told, KEY, [F.asc("at_ms"), F.asc("ordinal")], "at_ms", slot_ms, F.sum, F.col("_ends"), "_n").withColumn("_n", F.coalesce("_n", F.lit(0)))
    at, seen = F.struct("at_ms", "ordinal"), F.col("_ends") == 0
    end = F.struct("at_ms", F.col("through_slot").cast("long").alias("through_slot"), F.col("through_index").cast("long").alias("through_index"), "through_signature")
    grouped = placed.groupBy(*KEY, "_n").agg(
        F.struct(
            F.min(F.when(seen, F.col("at_ms"))).alias("detected_ms"), F.min_by(F.when(seen, F.col("prior_index")), F.when(seen & F.col("prior_index").isNotNull(), at)).cast("long").alias("prior_index"),
            F.max_by(F.when(seen, F.col("details")), F.when(seen, at)).alias("details"), F.count_if(seen).alias("detections"), F.lit(0).cast("long").alias("rejected"),
        ).alias("seen"), F.max(F.when(~seen, end)).alias("end"),
    )
    steps = grouped.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("_n", "prior_slot", "seen", "end"))).alias("steps"))
    start = F.struct(F.lit(None).cast(_SEEN).alias("active"), F.array().cast(f"array<{_ENDED}>").alias("ended"), F.lit(0).cast("long").alias("ignored")).cast(_STATE)
    folded = steps.select(*KEY, F.aggregate("steps", start, _merged).alias("s"))
    active = F.when(F.col("s.active").isNotNull(), F.array(F.struct(F.col("s.active").alias("seen"), F.lit(None).cast(_ENDED).getField("end").alias("end")))).otherwise(F.array().cast(f"array<{_ENDED}>"))
    out = folded.select(*KEY, F.posexplode(F.concat("s.ended", active)).alias("episode", "e"))
    return out.select(*KEY, "episode", "e.seen.*", F.when(F.col("e.end").isNull(), "ACTIVE").otherwise("RESOLVED").alias("status"), F.col("e.end.at_ms").alias("resolved_ms"), "e.end.through_slot", "e.end.through_index", "e.end.through_signature")
