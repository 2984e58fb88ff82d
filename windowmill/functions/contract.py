"""Strict contracts of JSON objects: the first fault and its path, in DataFrame functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SAFE = 2**53 - 1


@dataclass(frozen=True)
class Field:
    """A field by its path: kind is object, integer, string, boolean or strings (an array); integers have a range, strings may have names."""

    path: str
    kind: str
    required: bool = True
    nullable: bool = False
    low: int = 0
    high: int = SAFE
    names: tuple[str, ...] = ()


def _typed(field: Field, kind: Column) -> Column:
    if field.kind == "object":
        return kind.startswith("OBJECT")
    if field.kind == "strings":
        return kind.startswith("ARRAY")
    if field.kind == "integer":
        return (kind == "BIGINT") | kind.rlike(r"^DECIMAL\([0-9]+,0\)$")
    return kind == {"string": "STRING", "boolean": "BOOLEAN"}[field.kind]


def fault(json: Column, fields: list[Field], strict: bool = True) -> Column:
    """``CODE path`` of the first fault in the order of the fields, NULL if there is none.

    Codes: INVALID_JSON, WRONG_TYPE, MISSING, OUT_OF_RANGE, UNKNOWN_NAME and, where
    ``strict``, UNKNOWN_FIELD. An object's unknown fields are looked for before what is in
    it. A null text is no JSON. Of a field that may be absent, absence is no fault.
    """
    whole = F.try_parse_json(json)
    known: dict[str, list[str]] = {}
    for f in [Field("$", "object"), *fields]:
        parent, _, name = f.path.rpartition(".")
        known.setdefault(f.path, []) if f.kind == "object" else None
        if parent:
            known.setdefault(parent, []).append(name)
    said = lambda code, path: F.lit(f"{code} {path}")
    out = F.when(whole.isNull(), said("INVALID_JSON", "$"))
    for f in [Field("$", "object"), *fields]:
        value = whole if f.path == "$" else F.try_variant_get(whole, f.path, "variant")
        kind = F.schema_of_variant(value)
        null = kind == "VOID"
        held = value.isNotNull() & ~null
        if f.required:
            out = out.when(value.isNull(), said("MISSING", f.path))
        if not f.nullable:
            out = out.when(null, said("WRONG_TYPE", f.path))
        out = out.when(held & ~_typed(f, kind), said("WRONG_TYPE", f.path))
        if f.kind == "object" and strict:
            extra = F.array_except(F.json_object_keys(F.get_json_object(json, f.path)), F.array(*(F.lit(x) for x in known[f.path])).cast("array<string>"))
            out = out.when(held & (F.size(extra) > 0), F.concat(F.lit(f"UNKNOWN_FIELD {f.path}."), F.try_element_at(extra, F.lit(1))))
        if f.kind == "strings":
            out = out.when(held & F.exists(F.try_variant_get(value, "$", "array<variant>"), lambda x: ~F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False))), said("WRONG_TYPE", f"{f.path}[]"))
        if f.kind == "integer":
            number = F.try_variant_get(value, "$", "decimal(38,0)")
            out = out.when(held & ~F.coalesce(number.between(f.low, f.high), F.lit(False)), said("OUT_OF_RANGE", f.path))
        if f.names:
            out = out.when(held & ~F.coalesce(F.try_variant_get(value, "$", "string").isin(*f.names), F.lit(False)), said("UNKNOWN_NAME", f.path))
    return out


#: A notification of a subscription; other fields may stand beside these.
NOTIFICATION = [
    Field("$.jsonrpc", "string"), Field("$.params", "object"), Field("$.params.result", "object"), Field("$.params.result.context", "object"), Field("$.params.result.context.slot", "integer", high=2**63 - 1),
    Field("$.params.result.value", "object"), Field("$.params.result.value.signature", "string"), Field("$.params.result.value.logs", "strings"), Field("$.params.subscription", "integer", high=2**63 - 1),
]


def notifications(text: Column, subscription: Column) -> dict[str, Column]:
    """Columns status (ACCEPTED, SKIPPED or REJECTED), fault, slot, signature and log_messages of messages of a socket.

    What is no notification is skipped, after errors; a notification must be whole, of
    JSON-RPC 2.0 and of this subscription.
    """
    whole = F.try_parse_json(text)
    get = lambda path, kind: F.try_variant_get(whole, path, kind)
    wrong = F.when(whole.isNull(), "INVALID_JSON $").when(get("$.error", "variant").isNotNull(), "RPC_ERROR $.error")
    skipped = wrong.isNull() & ~F.coalesce((F.schema_of_variant(get("$.method", "variant")) == "STRING") & (get("$.method", "string") == "logsNotification"), F.lit(False))
    foreign = F.when(get("$.jsonrpc", "string") != "2.0", "NOT_JSON_RPC_2 $.jsonrpc").when(get("$.params.subscription", "decimal(38,0)") != subscription, "FOREIGN_SUBSCRIPTION $.params.subscription")
    found = F.when(~skipped, F.coalesce(wrong, fault(text, NOTIFICATION, strict=False), foreign))
    kept = lambda path, kind: F.when(~skipped & found.isNull(), get(path, kind))
    return {
        "status": F.when(skipped, "SKIPPED").when(found.isNull(), "ACCEPTED").otherwise("REJECTED"), "fault": found, "slot": kept("$.params.result.context.slot", "bigint"),
        "signature": kept("$.params.result.value.signature", "string"), "log_messages": kept("$.params.result.value.logs", "array<string>"),
    }
