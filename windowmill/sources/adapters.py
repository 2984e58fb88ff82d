"""The driver's tables as live observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GAP_CENTS = 25_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def naive_ms(at: Column) -> Column:
    """Milliseconds since 1970 of a time without a zone, whatever the zone of the session."""
    since = F.datediff(F.to_date(at), F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000
    return since + ((F.hour(at) * 60 + F.minute(at)) * 60_000).cast("long") + F.floor(F.extract(F.lit("SECOND"), at) * 1000).cast("long")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder as a stream of its files."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).option("pathGlobFilter", f"{name}.parquet*").option("recursiveFileLookup", "true").parquet(sf_dir)


def spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of events dealt to all tasks, for work that costs far more than reading: a file of few row groups would be as few tasks."""
    return table(spark, sf_dir, name).repartition(4 * spark.sparkContext.defaultParallelism, "event_id")


def raw_events(spark: SparkSession, sf_dir: str, read=table) -> DataFrame:
    """Events with receipt time, k and cents; only the columns that are used are read."""
    e = read(spark, sf_dir, "events")
    return e.select(
        "event_id", "user_id", "event_type", naive_ms(F.col("ts")).alias("received_ms"),
        F.get_json_object("props", "$.k").cast("int").alias("k"), F.round(F.col("value") * 100).cast("long").alias("cents"),
    )


def notifications(spark: SparkSession, sf_dir: str, invalid: bool = True, read=table, events: DataFrame | None = None) -> DataFrame:
    """All events as notifications: observations, coverage gaps (kind GAP) and irrelevant ones (NONE).

    ``invalid`` adds trades of no quote amount and of a blank wallet. ``events`` are the folder's
    ``raw_events``, if they are at hand.
    """
    e = raw_events(spark, sf_dir, read) if events is None else events
    kind = F.col("event_type")
    purchase, click, view, error = kind == "purchase", kind == "click", kind == "view", kind == "error"
    event_kind = (
        F.when(kind == "signup", "CREATE").when(purchase | click, "TRADE")
        .when(view, F.when(F.col("k") % 2 == 0, "LIQUIDITY_DEPOSIT").otherwise("LIQUIDITY_WITHDRAW"))
        .when(error & (F.col("cents") >= GAP_CENTS), "GAP").when(error & (F.col("k") == 0), "COMPLETE")
        .when(error & (F.col("k") == 1), "MIGRATION").otherwise("NONE")
    )
    wallet = F.concat(F.lit("w"), (F.col("k") % 25).cast("string"))
    quote, trader = F.col("cents"), wallet
    if invalid:
        quote = F.when(purchase & (F.col("k") == 13), F.lit(0)).otherwise(quote)
        trader = F.when(click & (F.col("k") == 14), F.lit("")).otherwise(wallet)
    units = lambda x: x.cast("decimal(20,0)")
    asset = F.col("user_id") % 10
    return e.select(
        "event_id", F.lit("MAINNET").alias("network"), F.concat(F.lit("SRC_"), F.floor(F.col("user_id") / 10).cast("string")).alias("source"),
        F.col("event_id").alias("slot"), F.lit(None).cast("long").alias("transaction_index"),
        F.concat(F.lit("sig-"), F.col("event_id").cast("string")).alias("signature"), F.lit(0).alias("instruction_index"), F.lit(0).alias("event_index"),
        "received_ms", F.col("user_id").cast("string").alias("mint"),
        F.when(asset == 0, "UNSUPPORTED").when(asset <= 2, "STABLE").otherwise("NATIVE").alias("asset"),
        event_kind.alias("kind"), F.when(purchase, "BUY").when(click, "SELL").alias("side"),
        F.when(purchase | click, trader).alias("wallet"), F.when(kind == "signup", wallet).alias("creator"),
        units(F.when(purchase | click | view, F.col("k") + 1)).alias("base"), units(F.when(purchase | click | view, quote)).alias("quote"),
        units(F.when(view, 1000 + F.col("k"))).alias("base_reserve"), units(F.when(view, 100000 + F.col("cents"))).alias("quote_reserve"), "k",
    )


def observations(spark: SparkSession, sf_dir: str, invalid: bool = True, liquidity: bool = True, read=table, events: DataFrame | None = None) -> DataFrame:
    found = notifications(spark, sf_dir, invalid, read, events).filter(~F.col("kind").isin("GAP", "NONE"))
    return found if liquidity else found.filter(~F.col("kind").isin("LIQUIDITY_DEPOSIT", "LIQUIDITY_WITHDRAW"))


def gaps(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Source coverage gaps: gap_id, source, gap_ms, reason."""
    found = notifications(spark, sf_dir, events=events).filter("kind = 'GAP'")
    return found.select(F.col("event_id").alias("gap_id"), "source", F.col("received_ms").alias("gap_ms"), "slot", F.lit("DECODE_GAP").alias("reason"))


#: Which control an irrelevant notification stands for, by k.
CONTROL_KINDS = {2: "SOURCE_DISCONNECTED", 3: "STREAM_STOPPED", 4: "PROCESSING_FAILED", 5: "QUEUE_OVERFLOW", 6: "CPI_INSTRUCTION_DATA_UNAVAILABLE", 7: "PIPELINE_RESTARTED"}


def chain_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations as events of transactions that hold several: a creation may bring a first trade, which its instruction precedes
    or follows; trades stand on both sides of the instruction that completes or migrates a market."""
    o = observations(spark, sf_dir)
    k, one = F.col("k"), F.lit(1)
    event = lambda kind, instruction, event: F.struct(kind.alias("kind"), instruction.cast("int").alias("instruction_index"), F.lit(event).alias("event_index"))
    own = lambda at: event(F.col("kind"), at, 0)
    trade = lambda at, event_index=0: event(F.lit("TRADE"), at, event_index)
    bare = F.array(own(k % 3))
    said = (
        F.when(F.col("kind") == "CREATE", F.when(k % 3 == 0, F.array(own(one * 2), trade(one))).when(k % 3 == 1, F.array(own(one), trade(one, 1), trade(one * 3))).otherwise(bare))
        .when(F.col("kind").isin("COMPLETE", "MIGRATION"), F.array(trade(one * 0), own(one), trade(one, 1), trade(one * 2))).otherwise(bare)
    )
    amounts = {c: F.coalesce(F.when(F.col("e.kind") == F.col("kind"), F.col(c)), F.when(F.col("e.kind") == "TRADE", (k + 1).cast("decimal(20,0)"))) for c in ("base", "quote")}
    cut = o.withColumn("e", F.explode(said)).withColumns(amounts)
    swap = F.when(k % 4 == 3, "PUMP_SWAP").otherwise("PUMP")
    return cut.select(
        "event_id", F.floor(F.col("slot") / 2).alias("slot"), (F.col("slot") % 2).alias("transaction_index"), "signature", "e.*", swap.alias("program"), "source", "mint",
        F.when((k % 19 == 4) & (F.col("e.kind") == "TRADE"), "OTHER").otherwise(F.col("asset")).alias("quote_mint"), "base", "quote", "received_ms",
    )


#: Discoveries are read after so long, a multiple by k; of one k they can't be read.
READ_MS, UNREAD_K = 1_200_000, 7
#: Stops and restarts are told by what this source sends alone.
COLLECTOR, COLLECTOR_KS = "SRC_0", [3, 7]


def registry_events(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Creations, their readings, controls and gaps as events of the window registry, in the order of arrival."""
    from windowmill.operators.registry import CAUSES

    note = notifications(spark, sf_dir, events=events)
    k, created = F.col("k"), F.col("kind") == "CREATE"
    control = (F.col("kind") == "NONE") & F.col("k").between(2, 7) & (~k.isin(COLLECTOR_KS) | (F.col("source") == COLLECTOR))  # one collector for all
    named = F.create_map(*(F.lit(x) for kv in CONTROL_KINDS.items() for x in kv))
    cause = F.when(F.col("kind") == "GAP", "DECODE_GAP").when(control, named[k])
    reach, action = (F.create_map(*(F.lit(x) for c, v in CAUSES.items() for x in (c, v[i]))) for i in range(2))
    act = lambda a, at, plus, r, why: F.struct(a.alias("action"), at.alias("at_ms"), (F.col("event_id") * 4 + plus).alias("ordinal"), r.alias("reach"), why.alias("reason"))
    none, window = F.lit(None).cast("string"), F.lit("window")
    opened = F.array(
        act(F.lit("OPEN"), F.col("received_ms"), 0, window, none),
        act(F.when(k % 23 == UNREAD_K, "FAIL").otherwise("CONFIRM"), F.col("received_ms") + (k % 9) * READ_MS, 1, window, none),
    )
    said = F.when(created, opened).when(cause.isNotNull(), F.array(act(action[cause], F.col("received_ms"), 2, reach[cause], cause)))
    return note.select("mint", "source", "asset", F.when(created, F.col("signature")).alias("opener"), F.explode(said).alias("e")).select("e.*", "mint", "source", "asset", "opener")


def feed_times(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """When each source was seen: source, at_ms of all notifications but controls."""
    return notifications(spark, sf_dir, events=events).filter("not (kind = 'NONE' and k between 2 and 7)").select("source", F.col("received_ms").alias("at_ms"))


def progress(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Source watermark: the largest receipt of any notification."""
    return notifications(spark, sf_dir, events=events).groupBy("source").agg(F.max("received_ms").alias("progress_ms"))


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as trades of a supplier's market: high volume, frequent ties."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    units = lambda x: x.cast("decimal(20,0)")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.lit("MAINNET").alias("network"), F.lit("SHIP").alias("source"), F.col("l_orderkey").alias("slot"), F.col("l_partkey").alias("transaction_index"),
        F.concat_ws("-", F.lit("line"), "l_orderkey", "l_linenumber").alias("signature"), F.col("l_linenumber").alias("instruction_index"), F.lit(0).alias("event_index"),
        naive_ms(F.col("l_shipdate")).alias("received_ms"), F.col("l_suppkey").cast("string").alias("mint"), F.lit("NATIVE").alias("asset"),
        F.lit("TRADE").alias("kind"), F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"), F.col("o_custkey").cast("string").alias("wallet"),
        F.lit(None).cast("string").alias("creator"), units(F.col("l_quantity").cast("long")).alias("base"), units(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("quote"),
        F.lit(None).cast("decimal(20,0)").alias("base_reserve"), F.lit(None).cast("decimal(20,0)").alias("quote_reserve"), "l_linenumber",
    )
