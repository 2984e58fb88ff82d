"""Exact window metrics by two levels of aggregation: per wallet, then per window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windowmill.functions.exact import negated, ratio_key, share_bps, wide, with_price_change
from windowmill.functions.ordering import order_key
from windowmill.operators.windows import validated

WINDOW = ["mint", "opened_ms"]


def _totals(valid: Column) -> list[Column]:
    """Numbers and volumes of valid trades."""
    buy, sell = valid & (F.col("side") == "BUY"), valid & (F.col("side") == "SELL")
    zero = F.lit(0).cast("decimal(20,0)")
    total = lambda flag, c: F.sum(F.when(flag, F.col(c)).otherwise(zero))
    return [
        F.count_if(valid).alias("trades"), F.count_if(buy).alias("buys"), F.count_if(sell).alias("sells"),
        total(buy, "base").alias("buy_base"), total(buy, "quote").alias("buy_quote"), total(sell, "base").alias("sell_base"), total(sell, "quote").alias("sell_quote"),
    ]


def _volumes() -> dict[str, Column]:
    return {f"{unit}_volume": wide(F.col(f"buy_{unit}") + F.col(f"sell_{unit}")) for unit in ("base", "quote")}


def wallets(member: DataFrame) -> DataFrame:
    """Per window and wallet: trades, buys, sells and the four volumes, of valid trades.

    The aggregate combines before it shuffles, so that a wallet or a window with
    very many trades reaches a task as few rows.
    """
    return validated(member).filter("valid").groupBy(*WINDOW, "wallet").agg(*_totals(F.lit(True))).withColumns(_volumes())


def counts(windows: DataFrame, member: DataFrame) -> DataFrame:
    """Per window: observations and latest slot over all members, trade counts and volumes over valid trades.

    Members are read once: those that are no valid trades count in the row of their wallet, or of none.
    """
    per = validated(member).groupBy(*WINDOW, "wallet").agg(F.count("*").alias("observations"), F.max("slot").alias("latest_slot"), *_totals(F.col("valid")))
    largest = F.struct((-wide(F.col("buy_quote") + F.col("sell_quote"))).alias("less"), "wallet")
    found = per.groupBy(*WINDOW).agg(
        F.sum("observations").alias("observations"), F.max("latest_slot").alias("latest_slot"),
        *(F.sum(c).alias(c) for c in ("trades", "buys", "sells", "buy_base", "buy_quote", "sell_base", "sell_quote")),
        F.count_if(F.col("trades") > 0).alias("traders"), F.count_if(F.col("buys") > 0).alias("buyers"), F.count_if(F.col("sells") > 0).alias("sellers"),
        F.min(F.when(F.col("trades") > 0, largest)).alias("largest"),
    )
    out = windows.join(found, WINDOW, "left").withColumns(_volumes())
    filled = {c: F.coalesce(c, F.lit(0)) for c in ("observations", "trades", "buys", "sells", "traders", "buyers", "sellers")}
    filled |= {c: F.coalesce(wide(F.col(c)), wide(F.lit(0))) for c in ("buy_base", "buy_quote", "sell_base", "sell_quote", "base_volume", "quote_volume")}
    out = out.withColumns(filled)
    top = wide(-F.col("largest.less"))
    return out.withColumns({"top_wallet": F.col("largest.wallet"), "top_quote": top, "top_share_bps": share_bps(top, F.col("quote_volume"))}).drop("largest")


def creators(windows: DataFrame, member: DataFrame) -> DataFrame:
    """Distinct creators of a window's creation events, in order, and their share of the quote volume.

    share is NULL if no creator is known or nothing was traded.
    """
    made = member.filter("kind in ('CREATE', 'CREATE_POOL') and creator <> ''").select(*WINDOW, "creator").distinct()
    per = wallets(member).select(*WINDOW, F.col("wallet").alias("creator"), "quote_volume")
    total = per.groupBy(*WINDOW).agg(F.sum("quote_volume").alias("total"))
    own = made.join(per, [*WINDOW, "creator"], "left").groupBy(*WINDOW).agg(F.count("*").alias("n_creators"), F.coalesce(F.sum("quote_volume"), F.lit(0)).alias("creator_quote"), F.array_join(F.array_sort(F.collect_list("creator")), ",").alias("creators"))
    out = windows.select(*WINDOW).join(own, WINDOW, "left").join(total, WINDOW, "left")
    return out.select(*WINDOW, F.coalesce("n_creators", F.lit(0)).alias("n_creators"), F.coalesce("creators", F.lit("")).alias("creators"), wide(F.col("creator_quote")).alias("creator_quote"), share_bps(F.col("creator_quote"), F.col("total")).alias("creator_share_bps"))


def prices(member: DataFrame) -> DataFrame:
    """First, last, low and high price (quote / base) of valid trades, and the change in bps.

    Compared as exact fractions; on a tie the earliest trade in the total order counts.
    """
    trade = validated(member).filter("valid").withColumns({"point": F.struct("quote", "base", "signature"), "ord": order_key(), "key": ratio_key(F.col("quote"), F.col("base"))})
    agg = trade.groupBy(*WINDOW).agg(
        F.min_by("point", "ord").alias("first"), F.max_by("point", "ord").alias("last"),
        F.min_by("point", F.struct("key", "ord")).alias("low"), F.min_by("point", F.struct(negated(F.col("key")), F.col("ord"))).alias("high"),
        F.min("received_ms").alias("first_trade_ms"), F.max("received_ms").alias("last_trade_ms"), F.min_by("slot", "ord").alias("first_trade_slot"), F.max_by("slot", "ord").alias("last_trade_slot"),
    )
    flat = agg.select(*WINDOW, "first_trade_ms", "last_trade_ms", "first_trade_slot", "last_trade_slot", *(F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in ("first", "last", "low", "high") for c in ("quote", "base", "signature")))
    return with_price_change(flat, "first_quote", "first_base", "last_quote", "last_base")


def reserves(member: DataFrame) -> DataFrame:
    """Extremes of base and quote reserves, the earliest on a tie; unknown reserves are skipped."""
    at = member.filter("base_reserve is not null or quote_reserve is not null").withColumn("ord", order_key())
    both = at.groupBy(*WINDOW).agg(
        F.count("*").alias("samples"), F.min_by(F.struct("base_reserve", "quote_reserve"), "ord").alias("first"), F.max_by(F.struct("base_reserve", "quote_reserve"), "ord").alias("latest"),
        *(F.min_by(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), F.col("signature").alias("s"))), F.when(F.col(c).isNotNull(), F.struct(F.col(c) * sign, F.col("ord")))).alias(f"{n}_{c}") for c in ("base_reserve", "quote_reserve") for n, sign in (("min", 1), ("max", -1))),
    )
    return both.select(
        *WINDOW, "samples", F.col("first.base_reserve").alias("first_base"), F.col("first.quote_reserve").alias("first_quote"),
        F.col("latest.base_reserve").alias("latest_base"), F.col("latest.quote_reserve").alias("latest_quote"),
        *(F.col(f"{n}_{c}.{f}").alias(f"{n}_{c}" if f == "v" else f"{n}_{c}_signature") for c in ("base_reserve", "quote_reserve") for n in ("min", "max") for f in ("v", "s")),
    )


def liquidity(member: DataFrame) -> DataFrame:
    """Deposits and withdrawals with their volumes."""
    kind, zero = F.col("kind"), F.lit(0).cast("decimal(20,0)")
    into, out = kind == "LIQUIDITY_DEPOSIT", kind == "LIQUIDITY_WITHDRAW"
    total = lambda flag, c: wide(F.sum(F.when(flag, F.col(c)).otherwise(zero)))
    return member.filter(into | out).groupBy(*WINDOW).agg(
        F.count_if(into).alias("deposits"), F.count_if(out).alias("withdrawals"), total(into, "base").alias("deposit_base"), total(into, "quote").alias("deposit_quote"),
        total(out, "base").alias("withdraw_base"), total(out, "quote").alias("withdraw_quote"),
    )


def lifecycle(windows: DataFrame, member: DataFrame) -> DataFrame:
    """Completions and migrations inside the window: whether, how many, and their keys by the total order."""
    done, moved = F.col("kind") == "COMPLETE", F.col("kind") == "MIGRATION"
    key = F.struct(order_key().alias("o"), F.concat_ws("/", "signature", "instruction_index", "event_index").alias("key"))
    keys = lambda flag: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(flag, key))), lambda x: x.key), ",")
    ended = member.filter(done | moved).groupBy(*WINDOW).agg(F.count_if(done).alias("completions"), F.count_if(moved).alias("migrations"), keys(done).alias("completion_keys"), keys(moved).alias("migration_keys"))
    out = windows.select(*WINDOW).join(ended, WINDOW, "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("completions", "migrations")]
    return out.select(*WINDOW, *counts, *(F.coalesce(c, F.lit("")).alias(c) for c in ("completion_keys", "migration_keys")))
