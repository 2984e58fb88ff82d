"""Text and JSON helpers of the observation schema."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank(x: Column) -> Column:
    """Empty or Unicode white space only; Spark's trim strips spaces alone."""
    return x.isNull() | x.rlike(r"^[\s\p{Z}]*$")


def trimmed(x: Column) -> Column:
    """Trimmed of white space; NULL if nothing is left."""
    return F.nullif(F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), F.lit(""))


def unsigned(x: Column) -> Column:
    return x.rlike("^[0-9]+$")


def title(kind: Column) -> Column:
    """EVENT_KIND to Event Kind."""
    return F.initcap(F.replace(F.lower(kind), F.lit("_"), F.lit(" ")))


def seconds_to_ms(seconds: Column) -> Column:
    """NULL if negative or beyond 64 bits."""
    return F.when((seconds >= 0) & (seconds <= (2**63 - 1) // 1000), seconds * 1000)


def abbreviated(x: Column, head: int = 4, tail: int = 4) -> Column:
    return F.when(F.length(x) <= head + tail, x).otherwise(F.concat(F.substring(x, 1, head), F.lit("…"), F.right(x, F.lit(tail))))


def iso(ms: Column) -> Column:
    """ISO 8601 in UTC with milliseconds, whatever the zone of the session."""
    at = F.to_utc_timestamp(F.timestamp_millis(ms), F.current_timezone())
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def floor_zero(x: Column) -> Column:
    """A counter that never falls below zero."""
    return F.greatest(x, F.lit(0))


def retention_cutoff(now_ms: Column, keep_hours: Column) -> Column:
    """The time before which evidence may go; at the least 64-bit number if it would lie before that."""
    low = F.lit(-(2**63)).cast("decimal(38,0)")
    return F.greatest(low, now_ms.cast("decimal(38,0)") - keep_hours.cast("decimal(38,0)") * 3_600_000).cast("long")


def admission_deadline(event_ms: Column, received_ms: Column, age_ms: int, now_ms: Column) -> Column:
    """Milliseconds left to admit a discovery: both its own time and its receipt limit its age; NULL if none are left."""
    left = F.least(event_ms + age_ms, received_ms + age_ms) - now_ms
    return F.when(left > 0, left)


#: Most raw bytes that a quarantine record keeps.
KEPT_BYTES = 12_288


def evidence_columns(raw: Column) -> dict[str, Column]:
    """The digest of all bytes, and the base64 of as many as are kept."""
    return {"evidence_sha256": F.sha2(raw, 256), "evidence_base64": F.base64(F.substring(raw, 1, KEPT_BYTES)), "evidence_cut": F.octet_length(raw) > KEPT_BYTES}


def contract_violation(json: Column, integers: dict[str, tuple[int, int]], enums: dict[str, list[str]]) -> Column:
    """The first field by which a JSON object breaks a contract: no object, a field that is no whole safe number in range, or no known name."""
    out = F.when(F.get_json_object(json, "$").isNull() | ~F.coalesce(json.rlike(r"^\s*\{"), F.lit(False)), "$")
    for name, (low, high) in integers.items():
        said = F.get_json_object(json, f"$.{name}")
        whole = said.rlike(r"^-?[0-9]{1,16}$") & (F.abs(said.try_cast("long")) <= 2**53 - 1) & said.try_cast("long").between(low, high)
        out = out.when(~F.coalesce(whole, F.lit(False)), name)
    for name, known in enums.items():
        out = out.when(~F.coalesce(F.get_json_object(json, f"$.{name}").isin(known), F.lit(False)), name)
    return out
