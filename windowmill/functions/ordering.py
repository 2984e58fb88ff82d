"""The total order of observations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Receipt, slot, transaction (unknown first), signature, instruction, event, source.
KEYS = ["received_ms", "slot", "transaction_index", "signature", "instruction_index", "event_index", "source"]


def order_key() -> Column:
    """A struct that sorts as the observations do; nulls sort first inside structs."""
    return F.struct(*KEYS)


def order_columns() -> list[Column]:
    return [F.col(k).asc_nulls_first() for k in KEYS]
