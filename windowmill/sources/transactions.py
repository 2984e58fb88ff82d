"""Transactions read for notifications: enrichment by signature and flat instructions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def enriched(requests: DataFrame, records: DataFrame) -> DataFrame:
    """Each request with read_status, slot and log_messages of the record of its signature.

    Requests have signature and minimum_slot (NULL: any); records have signature, slot,
    has_meta and log_messages, and of several the one of the highest slot counts. Status: OK,
    EMPTY_SIGNATURE, NOT_FOUND, SLOT_TOO_LOW, NO_META or NO_LOGS; only OK carries logs.
    """
    newest = records.groupBy("signature").agg(F.max_by(F.struct("slot", "has_meta", "log_messages"), F.struct("slot", "has_meta")).alias("_read"))
    out = requests.join(newest, "signature", "left")
    status = (
        F.when(F.coalesce("signature", F.lit("")) == "", "EMPTY_SIGNATURE").when(F.col("_read").isNull(), "NOT_FOUND").when(F.col("_read.slot") < F.col("minimum_slot"), "SLOT_TOO_LOW")
        .when(~F.coalesce("_read.has_meta", F.lit(False)), "NO_META").when(F.col("_read.log_messages").isNull(), "NO_LOGS").otherwise("OK")
    )
    return out.withColumn("read_status", status).withColumn("slot", F.col("_read.slot")).withColumn("log_messages", F.when(F.col("read_status") == "OK", F.col("_read.log_messages"))).drop("_read")


def instructions(transactions: DataFrame) -> DataFrame:
    """signature, outer_index, inner_index, program, accounts, data of each instruction; else one row with instruction_error.

    Accounts are numbered over account_keys, loaded_writable and loaded_readonly in turn.
    ``instructions`` are structs of program_id_index, accounts and data; ``inner`` are structs of the
    index of an outer one and its inner instructions. Outer instructions have no inner_index. Errors:
    NO_OUTER_INSTRUCTION, DUPLICATE_INNER_GROUP and PROGRAM_OUT_OF_RANGE; an account out of range is NULL. Null lists are empty.
    """
    kinds = dict(transactions.dtypes)
    given = lambda c: F.coalesce(F.col(c), F.array().cast(kinds[c]))
    t = transactions.select("signature", F.concat(given("account_keys"), given("loaded_writable"), given("loaded_readonly")).alias("keys"), given("instructions").alias("outer"), given("inner").alias("inner"))

    def flat(i: Column, outer: Column, inner: Column) -> Column:
        return F.struct(outer.cast("int").alias("outer_index"), inner.cast("int").alias("inner_index"), i.program_id_index.alias("program_at"), F.coalesce(i.accounts, F.array().cast("array<int>")).alias("accounts_at"), i.data.alias("data"))

    tops = F.transform("outer", lambda i, n: flat(i, n, F.lit(None)))
    nested = F.flatten(F.transform("inner", lambda g: F.transform(g.instructions, lambda i, n: flat(i, g["index"], n))))
    t = t.withColumn("all", F.concat(tops, nested))
    outside = lambda at: (at < 0) | (at >= F.size("keys")) | at.isNull()
    groups = F.transform("inner", lambda g: g["index"])
    error = (
        F.when(F.exists(groups, lambda n: (n < 0) | (n >= F.size("outer")) | n.isNull()), "NO_OUTER_INSTRUCTION").when(F.size(F.array_distinct(groups)) < F.size(groups), "DUPLICATE_INNER_GROUP")
        .when(F.exists("all", lambda i: outside(i.program_at)), "PROGRAM_OUT_OF_RANGE")
    )
    out = t.withColumn("instruction_error", error).select("signature", "keys", "instruction_error", F.explode_outer(F.when(F.col("instruction_error").isNull(), F.col("all"))).alias("i"))
    out = out.filter("instruction_error is not null or i is not null")
    accounts = F.transform("i.accounts_at", lambda at: F.get("keys", at))
    return out.select("signature", "i.outer_index", "i.inner_index", F.get("keys", F.col("i.program_at")).alias("program"), accounts.alias("accounts"), "i.data", "instruction_error")
