"""Queries over stored evidence, messages and positions, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windowmill.functions import text
from windowmill.functions.contract import Field, fault, notifications
from windowmill.functions.exact import floor_div, gcd
from windowmill.operators import evidence, gaps, intake, lifecycle, registry, windows
from windowmill.operators.asof import asof_position
from windowmill.plans.flows import CUTOFF_MS, Scene, scene
from windowmill.plans.sql import BASE, DECIDED, NOTES, STAGED, STATES
from windowmill.sources import adapters, layouts, samples, transactions

SUBSCRIPTION, PAGE, PAGE_LIMIT = 7, 40, 38


def gap_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as detections of gaps, views as resolutions of some: keys repeat, and positions lie before and behind."""
    k = F.col("k")
    e = adapters.notifications(spark, sf_dir).withColumn("action", F.when(F.col("kind").isin("GAP", "NONE"), "DETECT").when(F.col("kind").startswith("LIQUIDITY") & (k % 4 == 0), "RESOLVE")).filter("action is not null")
    prior, detect = F.floor(F.col("slot") / 4000) * 4000, F.col("action") == "DETECT"
    return e.select(
        "network", "source", F.when(k % 2 == 0, "STREAM_GAP").otherwise("RECOVERY_LIMIT").alias("reason"), prior.alias("prior_slot"), F.concat(F.lit("p"), prior.cast("string")).alias("prior_signature"),
        F.col("received_ms").alias("at_ms"), F.col("event_id").alias("ordinal"), "action", F.when(detect & (k % 3 != 0), (k % 5).cast("long")).alias("prior_index"), F.when(detect, F.concat(F.lit("d"), k.cast("string"))).alias("details"),
        F.when(~detect, prior + (k / 8).cast("int") % 3 - 1).alias("through_slot"), F.when(~detect & (k % 3 != 1), (k % 7).cast("long")).alias("through_index"), F.when(~detect, F.col("signature")).alias("through_signature"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages of a socket; by k some are cut, of another kind or subscription, or of wrong fields."""
    e, k = adapters.notifications(spark, sf_dir, read=adapters.spread), F.col("k")
    slot = F.when(k % 13 == 4, F.concat(F.lit('"'), F.col("slot").cast("string"), F.lit('"'))).otherwise(F.col("slot").cast("string"))
    logs = F.when(k % 13 == 5, F.lit("")).when(k % 13 == 6, F.lit(',"logs":["a",1]')).otherwise(F.concat(F.lit(',"logs":["'), F.col("kind"), F.lit('","b"]')))
    signature = F.when(k % 13 == 8, F.lit("null")).otherwise(F.concat(F.lit('"'), F.col("signature"), F.lit('"')))
    body = F.concat(
        F.lit('{"jsonrpc":"'), F.when(k % 13 == 2, "1.0").otherwise("2.0"), F.lit('","method":"'), F.when(k % 13 == 1, "other").otherwise("logsNotification"), F.lit('"'), F.when(k % 13 == 7, F.lit(',"error":{"code":1}')).otherwise(F.lit("")),
        F.lit(',"params":{"result":{"context":{"slot":'), slot, F.lit('},"value":{"signature":'), signature, logs, F.lit('}},"subscription":'), F.when(k % 13 == 3, F.lit("8")).otherwise(F.lit("7")), F.lit("}}"),
    )
    return e.select("event_id", F.when(k % 13 == 0, F.substring(body, 1, 60)).otherwise(body).alias("text"))


_MESSAGES = NOTES + """, msg AS (SELECT event_id, CASE WHEN k % 13 = 0 THEN substr(body, 1, 60) ELSE body END AS text FROM (SELECT *, '{"jsonrpc":"' || CASE WHEN k % 13 = 2 THEN '1.0' ELSE '2.0' END || '","method":"' || CASE WHEN k % 13 = 1 THEN 'other' ELSE 'logsNotification' END || '"'
    || CASE WHEN k % 13 = 7 THEN ',"error":{"code":1}' ELSE '' END || ',"params":{"result":{"context":{"slot":' || CASE WHEN k % 13 = 4 THEN '"' || slot || '"' ELSE CAST(slot AS VARCHAR) END || '},"value":{"signature":' || CASE WHEN k % 13 = 8 THEN 'null' ELSE '"' || signature || '"' END
    || CASE WHEN k % 13 = 5 THEN '' WHEN k % 13 = 6 THEN ',"logs":["a",1]' ELSE ',"logs":["' || kind || '","b"]' END || '}},"subscription":' || CASE WHEN k % 13 = 3 THEN '8' ELSE '7' END || '}}' AS body FROM note)),
  typed AS (SELECT event_id, text, json_valid(text) AS ok, CASE WHEN json_valid(text) THEN text END AS j FROM msg),
  ty AS (SELECT *, json_type(j, '$.params.result.context.slot') AS t_slot, json_type(j, '$.params.result.value.signature') AS t_sig, json_type(j, '$.params.result.value.logs') AS t_logs, json_extract(j, '$.error') AS err,
    json_extract_string(j, '$.method') AS method, json_extract_string(j, '$.jsonrpc') AS rpc, CAST(json_extract(j, '$.params.subscription') AS BIGINT) AS sub FROM typed),
  judged AS (SELECT *, CASE WHEN NOT ok THEN 'INVALID_JSON $' WHEN err IS NOT NULL THEN 'RPC_ERROR $.error' WHEN method <> 'logsNotification' THEN NULL WHEN t_slot NOT IN ('UBIGINT', 'BIGINT') THEN 'WRONG_TYPE $.params.result.context.slot'
      WHEN t_sig <> 'VARCHAR' THEN 'WRONG_TYPE $.params.result.value.signature' WHEN t_logs IS NULL THEN 'MISSING $.params.result.value.logs' WHEN t_logs = 'ARRAY' AND len(list_filter(CAST(json_extract(j, '$.params.result.value.logs') AS JSON[]), lambda x: json_type(x) <> 'VARCHAR')) > 0 THEN 'WRONG_TYPE $.params.result.value.logs[]'
      WHEN rpc <> '2.0' THEN 'NOT_JSON_RPC_2 $.jsonrpc' WHEN sub <> 7 THEN 'FOREIGN_SUBSCRIPTION $.params.subscription' END AS fault FROM ty)
  SELECT event_id, CASE WHEN ok AND err IS NULL AND method <> 'logsNotification' THEN 'SKIPPED' WHEN fault IS NULL THEN 'ACCEPTED' ELSE 'REJECTED' END AS status, fault,
    CASE WHEN fault IS NULL AND method = 'logsNotification' THEN CAST(json_extract(j, '$.params.result.context.slot') AS BIGINT) END AS slot, CASE WHEN fault IS NULL AND method = 'logsNotification' THEN json_extract_string(j, '$.params.result.value.signature') END AS signature,
    CASE WHEN fault IS NULL AND method = 'logsNotification' THEN CAST(json_array_length(j, '$.params.result.value.logs') AS INT) END AS lines FROM judged"""


def notification_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = notifications(F.col("text"), F.lit(SUBSCRIPTION))
    return messages(spark, sf_dir).select("event_id", *(c.alias(n) for n, c in found.items())).withColumn("lines", F.when(F.col("log_messages").isNotNull(), F.size("log_messages"))).drop("log_messages")


SUMMARY = [
    Field("$.mint", "string"), Field("$.asset", "string", names=("NATIVE", "STABLE", "UNSUPPORTED")), Field("$.counts", "object"), Field("$.counts.base", "integer", nullable=True, high=90), Field("$.counts.quote", "integer", nullable=True),
    Field("$.wallet", "string", required=False),
]


def summary_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations as nested objects against a strict contract; by k some have an unknown field or another type."""
    o, k = adapters.observations(spark, sf_dir), F.col("k")
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    body = F.concat(
        F.lit('{"mint":'), F.when(k % 17 == 1, F.col("mint")).otherwise(F.concat(F.lit('"'), F.col("mint"), F.lit('"'))), F.lit(',"asset":"'), F.when(k % 17 == 2, "OTHER").otherwise(F.col("asset")), F.lit('","counts":{"base":'), number("base"),
        F.lit(',"quote":'), number("quote"), F.when(k % 17 == 3, F.lit(',"more":1')).otherwise(F.lit("")), F.lit("}"), F.when(F.col("wallet").isNotNull(), F.concat(F.lit(',"wallet":"'), F.col("wallet"), F.lit('"'))).otherwise(F.lit("")), F.when(k % 17 == 4, F.lit(',"z":{}')).otherwise(F.lit("")), F.lit("}"),
    )
    return o.select("event_id", fault(body, SUMMARY).alias("fault"))


_SUMMARY = NOTES + """, body AS (SELECT event_id, '{"mint":' || CASE WHEN k % 17 = 1 THEN mint ELSE '"' || mint || '"' END || ',"asset":"' || CASE WHEN k % 17 = 2 THEN 'OTHER' ELSE asset END || '","counts":{"base":' || coalesce(CAST(base AS VARCHAR), 'null') || ',"quote":' || coalesce(CAST(quote AS VARCHAR), 'null')
    || CASE WHEN k % 17 = 3 THEN ',"more":1' ELSE '' END || '}' || CASE WHEN wallet IS NOT NULL THEN ',"wallet":"' || wallet || '"' ELSE '' END || CASE WHEN k % 17 = 4 THEN ',"z":{}' ELSE '' END || '}' AS j FROM obs),
  x AS (SELECT *, list_filter(json_keys(j), lambda n: n NOT IN ('mint', 'asset', 'counts', 'wallet')) AS extra, list_filter(json_keys(j, '$.counts'), lambda n: n NOT IN ('base', 'quote')) AS inner_extra FROM body)
  SELECT event_id, CASE WHEN len(extra) > 0 THEN 'UNKNOWN_FIELD $.' || extra[1] WHEN json_type(j, '$.mint') <> 'VARCHAR' THEN 'WRONG_TYPE $.mint' WHEN json_extract_string(j, '$.asset') NOT IN ('NATIVE', 'STABLE', 'UNSUPPORTED') THEN 'UNKNOWN_NAME $.asset' WHEN len(inner_extra) > 0 THEN 'UNKNOWN_FIELD $.counts.' || inner_extra[1]
    WHEN CAST(json_extract_string(j, '$.counts.base') AS BIGINT) NOT BETWEEN 0 AND 90 THEN 'OUT_OF_RANGE $.counts.base' WHEN CAST(json_extract_string(j, '$.counts.quote') AS BIGINT) NOT BETWEEN 0 AND 9007199254740991 THEN 'OUT_OF_RANGE $.counts.quote' END AS fault FROM x"""


def membership_validated(s: Scene) -> DataFrame:
    """Each observation against the last window of the registry that opened at or before it."""
    k = F.col("k")
    identity = lambda asset: {"venue": F.lit("CURVE"), "market_address": F.concat(F.lit("c-"), F.col("mint")), "quote_mint": F.col(asset)}
    durable = s.states.filter("status in ('CONFIRMED', 'CANCELLED_CONFIRMED', 'OPEN')").withColumns(identity("asset") | {"network": F.lit("MAINNET"), "status": F.when(F.col("status").isin("CONFIRMED", "OPEN"), "ACTIVE").otherwise("CANCELLED")})
    w = durable.select("mint", F.col("opened_ms").alias("at"), F.struct("opened_ms", "closes_ms", "status", *windows.IDENTITY).alias("w"))
    seen = s.observations.withColumns(identity("asset")).withColumns(
        {"venue": F.when(k % 29 == 7, "POOL").otherwise(F.col("venue")), "market_address": F.when(k % 31 == 9, "c-other").otherwise(F.col("market_address")), "quote_mint": F.when(k % 37 == 3, F.lit(None)).otherwise(F.col("quote_mint"))}
    )
    o = seen.select("event_id", "mint", F.col("received_ms").alias("at"), F.struct("received_ms", *windows.IDENTITY).alias("o"))
    found = asof_position(o, w, ["mint"], ["at"], "w", strict=False)
    return found.select("event_id", "mint", F.col("w.opened_ms").alias("opened_ms"), F.when(F.col("w").isNull(), "NO_WINDOW").otherwise(windows.membership_violation("o", "w")).alias("violation"))


_MEMBERSHIP = STATES + """, durable AS (SELECT * FROM states WHERE status IN ('CONFIRMED', 'CANCELLED_CONFIRMED', 'OPEN'))
  SELECT o.event_id, o.mint, d.opened_ms, CASE WHEN d.mint IS NULL THEN 'NO_WINDOW' WHEN d.status = 'CANCELLED_CONFIRMED' THEN 'WINDOW_NOT_ACTIVE' WHEN o.source <> d.source THEN 'source' WHEN o.k % 29 = 7 THEN 'venue' WHEN o.k % 31 = 9 THEN 'market_address'
    WHEN (CASE WHEN o.k % 37 = 3 THEN NULL ELSE o.asset END) IS DISTINCT FROM d.asset THEN 'quote_mint' WHEN o.received_ms >= d.closes_ms THEN 'received_ms' END AS violation FROM obs o ASOF LEFT JOIN durable d ON o.mint = d.mint AND o.received_ms >= d.opened_ms"""


def token_shape(s: Scene) -> DataFrame:
    """Tokens as they are served, some of them damaged, and the first rule that each breaks."""
    from windowmill.plans.flows import token_fold

    m = F.col("mint").cast("long")
    metrics = s.metrics().select("mint", "opened_ms", F.struct(F.lit("PASS").alias("decision"), F.lit("COMPLETE").alias("completeness"), "trades", "buys", "sells", "traders", "buyers", "sellers", "opened_ms", F.col("closes_ms").alias("closed_ms"), F.col("claimed_ms").alias("evaluated_ms"), "top_share_bps").alias("qualification"))
    t = token_fold(s).join(metrics.withColumnRenamed("opened_ms", "activity_window_ms"), ["mint", "activity_window_ms"], "left")
    half = F.floor(F.col("trades") / 2)
    served = t.select(
        "mint", F.when(m % 13 == 1, " ").otherwise(F.concat(F.lit("c-"), F.col("mint"))).alias("market_address"), F.lit("TRADE").alias("last_event_kind"), F.when(m % 13 == 2, F.lit(None)).otherwise(F.lit("s")).alias("latest_signature"),
        F.when(m % 13 == 3, "  ").otherwise(F.col("name")).alias("name"), F.lit(None).cast("string").alias("symbol"), F.col("market").alias("quote_mint"), F.when(m % 13 == 4, "-1").otherwise("10").alias("base_volume"), F.lit("0").alias("quote_volume"),
        half.alias("buys"), (F.col("trades") - half).alias("sells"), (F.col("trades") + (m % 13 == 5).cast("int")).alias("trades"), F.lit(0).alias("traders"), F.col("first_ms").alias("first_observed_ms"), F.col("last_ms").alias("last_observed_ms"),
        F.lit("PUMP").alias("source"), F.when(m % 13 == 6, "PUMP_SWAP").otherwise("PUMP_BONDING_CURVE").alias("venue"), "stage", "qualification",
    )
    return served.select("mint", intake.token_shape_violation().alias("violation"))


_SHAPE = STAGED + """ SELECT e.mint, CASE CAST(e.mint AS BIGINT) % 13 WHEN 1 THEN 'market_address' WHEN 2 THEN 'latest_signature' WHEN 3 THEN 'name' WHEN 4 THEN 'base_volume' WHEN 5 THEN 'activity' WHEN 6 THEN 'activity'
    ELSE CASE WHEN e.stage <> 'OBSERVED' AND m.mint IS NULL THEN 'qualification' END END AS violation FROM ended e LEFT JOIN m ON m.mint = e.mint AND m.opened_ms = e.act_ms WHERE e.stage IS NOT NULL"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as pages of signatures, newest first; some repeat one, some rise in slot, some are too long."""
    e, k = adapters.notifications(spark, sf_dir), F.col("k")
    page, at = F.floor(F.col("event_id") / PAGE), F.col("event_id") % PAGE
    rows = e.select(F.concat_ws("-", "source", page.cast("string")).alias("page"), (PAGE - at).alias("position"), F.when((k == 40) & (F.col("event_id") % 2 == 0), F.concat(F.lit("twice-"), page.cast("string"))).otherwise(F.col("signature")).alias("signature"), F.when(k == 41, F.col("slot") + 500).otherwise(F.col("slot")).alias("slot"))
    return rows


_PAGES = NOTES + """, p AS (SELECT source || '-' || (event_id // 40) AS page, 40 - event_id % 40 AS position, CASE WHEN k = 40 AND event_id % 2 = 0 THEN 'twice-' || (event_id // 40) ELSE signature END AS signature, CASE WHEN k = 41 THEN slot + 500 ELSE slot END AS slot FROM note),
  r AS (SELECT *, slot > lag(slot) OVER (PARTITION BY page ORDER BY position) AS rises FROM p),
  f AS (SELECT page, CASE WHEN count(*) > 3 THEN 'OVERSIZE' WHEN count(DISTINCT signature) < count(*) THEN 'DUPLICATE_SIGNATURE' WHEN bool_or(coalesce(rises, false)) THEN 'RISING_SLOT' END AS fault FROM r GROUP BY page) SELECT * FROM f WHERE fault IS NOT NULL"""


def recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What came after a checkpoint of each source; of some sources the checkpoint is unknown, or of another slot."""
    e = adapters.notifications(spark, sf_dir)
    n = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    records = e.select("source", "signature", "slot", (F.lit(0) - F.col("event_id")).alias("position"))
    mark = e.groupBy("source").agg(F.max(F.when(F.col("k") % 10 == 3, F.col("event_id"))).alias("at"))
    checkpoints = mark.select("source", F.when(n % 5 == 1, "lost").otherwise(F.concat(F.lit("sig-"), F.col("at").cast("string"))).alias("last_signature"), (F.col("at") + (n % 5 == 2).cast("int")).alias("last_slot"))
    return evidence.recovered(records, checkpoints).drop("step")


_RECOVERY = NOTES + """, mark AS (SELECT source, max(event_id) FILTER (k % 10 = 3) AS pos, CAST(regexp_extract(source, '(\\d+)', 1) AS INT) AS n FROM note GROUP BY source),
  bad AS (SELECT source, CASE WHEN n % 5 = 1 OR pos IS NULL THEN 'CHECKPOINT_NOT_FOUND' WHEN n % 5 = 2 THEN 'CHECKPOINT_SLOT_MISMATCH' END AS recovery_error, pos FROM mark)
  SELECT source, NULL AS signature, CAST(NULL AS BIGINT) AS slot, recovery_error FROM bad WHERE recovery_error IS NOT NULL UNION ALL SELECT o.source, o.signature, o.slot, NULL FROM note o JOIN bad b ON b.source = o.source AND b.recovery_error IS NULL AND o.event_id > b.pos"""


def read_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of all events against records of most of them."""
    e, k = adapters.notifications(spark, sf_dir), F.col("k")
    requests = e.select("event_id", F.when(k == 60, "").otherwise(F.col("signature")).alias("signature"), F.when(k % 4 == 1, F.col("slot") + 1).when(k % 4 == 2, F.col("slot")).alias("minimum_slot"))
    again = F.explode(F.when(k % 6 == 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    records = e.filter("k % 9 <> 7").select("signature", again.alias("n"), "slot", "k").select("signature", (F.col("slot") + F.col("n")).alias("slot"), (k % 8 != 5).alias("has_meta"), F.when(k % 7 != 6, F.array(F.col("signature"))).alias("log_messages"))
    return transactions.enriched(requests, records).select("event_id", "read_status", "slot", F.coalesce(F.size("log_messages"), F.lit(-1)).alias("lines"))


_READ = NOTES + """, rec AS (SELECT signature, max(slot + CASE WHEN k % 6 = 2 THEN 1 ELSE 0 END) AS slot, any_value(k % 8 <> 5) AS has_meta, any_value(k % 7 <> 6) AS has_logs FROM note WHERE k % 9 <> 7 GROUP BY signature),
  req AS (SELECT event_id, CASE WHEN k = 60 THEN '' ELSE signature END AS signature, CASE k % 4 WHEN 1 THEN slot + 1 WHEN 2 THEN slot END AS least FROM note),
  j AS (SELECT event_id, r.slot, CASE WHEN q.signature = '' THEN 'EMPTY_SIGNATURE' WHEN r.signature IS NULL THEN 'NOT_FOUND' WHEN r.slot < q.least THEN 'SLOT_TOO_LOW' WHEN NOT has_meta THEN 'NO_META' WHEN NOT has_logs THEN 'NO_LOGS' ELSE 'OK' END AS read_status FROM req q LEFT JOIN rec r USING (signature))
  SELECT event_id, read_status, slot, CASE WHEN read_status = 'OK' THEN 1 ELSE -1 END AS lines FROM j"""


def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scalar helpers over all observations."""
    o, k = adapters.observations(spark, sf_dir), F.col("k")
    return o.select(
        "event_id", text.title(F.col("kind")).alias("title"), text.unsigned(F.coalesce(F.col("quote").cast("string"), F.lit("-"))).alias("is_unsigned"), text.abbreviated(F.concat(F.col("signature"), F.lit("-"), F.col("kind"))).alias("short"),
        text.iso(F.col("received_ms")).alias("iso"), text.seconds_to_ms(k.cast("long") - 3).alias("ms"), text.floor_zero(k - 50).alias("floored"), text.retention_cutoff(F.col("received_ms"), (k * 10).cast("long")).alias("cutoff_ms"),
        text.admission_deadline(F.col("received_ms") - k * 500, F.col("received_ms"), 15_000, F.col("received_ms") + k * 100).alias("left_ms"),
    )


_FORMATS = NOTES + """ SELECT event_id, CASE kind WHEN 'CREATE' THEN 'Create' WHEN 'TRADE' THEN 'Trade' WHEN 'LIQUIDITY_DEPOSIT' THEN 'Liquidity Deposit' WHEN 'LIQUIDITY_WITHDRAW' THEN 'Liquidity Withdraw' WHEN 'COMPLETE' THEN 'Complete' ELSE 'Migration' END AS title,
    regexp_full_match(coalesce(CAST(quote AS VARCHAR), '-'), '[0-9]+') AS is_unsigned, CASE WHEN length(signature || '-' || kind) <= 8 THEN signature || '-' || kind ELSE left(signature || '-' || kind, 4) || '…' || right(signature || '-' || kind, 4) END AS short,
    strftime(epoch_ms(received_ms), '%Y-%m-%dT%H:%M:%S.%gZ') AS iso, CASE WHEN k >= 3 THEN CAST(k - 3 AS BIGINT) * 1000 END AS ms, greatest(k - 50, 0) AS floored, received_ms - CAST(k AS BIGINT) * 36000000 AS cutoff_ms, CASE WHEN 15000 - k * 600 > 0 THEN CAST(15000 - k * 600 AS BIGINT) END AS left_ms FROM obs"""


def admissions(s: Scene) -> DataFrame:
    """Members as they were admitted, some twice, and what each window submitted: earliest admission, copies and faulty counts."""
    k = F.col("k")
    twice = F.explode(F.when(k % 5 == 0, F.array(F.lit(900), F.lit(100))).otherwise(F.array(F.lit(300))))
    given = s.member.select("mint", "opened_ms", "event_id", "k", "received_ms", twice.alias("later")).withColumn("admitted_ms", F.col("received_ms") + F.col("later"))
    once = evidence.admitted(given)
    stored = once.groupBy("mint", "opened_ms").agg(F.count("*").alias("n"), F.max("admitted_ms").alias("last_admitted_ms"))
    submitted = stored.select("mint", "opened_ms", (F.col("n") + (F.col("mint").cast("long") % 4 == 0).cast("int")).alias("submitted"))
    faulty = evidence.count_guard(submitted, once).select("mint", "opened_ms", (F.col("submitted") - F.col("stored")).alias("missing"))
    return stored.select("mint", "opened_ms", F.col("n").alias("members"), "last_admitted_ms").join(faulty, ["mint", "opened_ms"], "left").withColumn("missing", F.coalesce("missing", F.lit(0)).cast("long"))


_ADMISSIONS = BASE + """ SELECT mint, opened_ms, count(*) AS members, max(received_ms + CASE WHEN k % 5 = 0 THEN 100 ELSE 300 END) AS last_admitted_ms, CAST(CASE WHEN CAST(mint AS BIGINT) % 4 = 0 THEN 1 ELSE 0 END AS BIGINT) AS missing FROM member GROUP BY mint, opened_ms"""
_GAPS = NOTES + """, ev AS (SELECT *, CASE WHEN kind IN ('GAP', 'NONE') THEN 'DETECT' WHEN kind LIKE 'LIQUIDITY%' AND k % 4 = 0 THEN 'RESOLVE' END AS action, (slot // 4000) * 4000 AS prior, CASE WHEN k % 2 = 0 THEN 'STREAM_GAP' ELSE 'RECOVERY_LIMIT' END AS reason FROM note),
  st AS (SELECT *, CASE WHEN action = 'DETECT' AND k % 3 <> 0 THEN k % 5 END AS pidx, CASE WHEN action = 'RESOLVE' THEN prior + (k // 8) % 3 - 1 END AS through, CASE WHEN action = 'RESOLVE' AND k % 3 <> 1 THEN k % 7 END AS tidx, row_number() OVER (PARTITION BY source, reason, prior ORDER BY received_ms, event_id) AS rn FROM ev WHERE action IS NOT NULL),
  walk(source, reason, prior, rn, active, episode, detected_ms, pidx, details, n, refused, done, done_ms, done_slot, done_index, done_sig) AS (
    SELECT DISTINCT source, reason, prior, CAST(0 AS BIGINT), false, 0, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(0 AS BIGINT), CAST(0 AS BIGINT), false, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR) FROM st
    UNION ALL SELECT s.source, s.reason, s.prior, s.rn, CASE WHEN s.action = 'DETECT' THEN true ELSE w.active AND back END, w.episode + CASE WHEN w.done THEN 1 ELSE 0 END,
      CASE WHEN s.action = 'DETECT' AND w.active THEN least(w.detected_ms, s.received_ms) WHEN s.action = 'DETECT' THEN s.received_ms ELSE w.detected_ms END, CASE WHEN s.action <> 'DETECT' THEN w.pidx WHEN w.active THEN coalesce(w.pidx, s.pidx) ELSE s.pidx END,
      CASE WHEN s.action = 'DETECT' THEN 'd' || s.k ELSE w.details END, CASE WHEN s.action <> 'DETECT' THEN w.n WHEN w.active THEN w.n + 1 ELSE 1 END, CASE WHEN s.action = 'DETECT' THEN CASE WHEN w.active THEN w.refused ELSE 0 END WHEN w.active AND back THEN w.refused + 1 ELSE w.refused END,
      s.action = 'RESOLVE' AND w.active AND NOT back, s.received_ms, s.through, s.tidx, s.signature
    FROM walk w JOIN (SELECT *, through < prior AS below FROM st) s ON s.source = w.source AND s.reason = w.reason AND s.prior = w.prior AND s.rn = w.rn + 1, LATERAL (SELECT coalesce(s.below OR s.through = s.prior AND coalesce(s.tidx < w.pidx, false), false) AS back)),
  ends AS (SELECT *, row_number() OVER (PARTITION BY source, reason, prior ORDER BY rn DESC) AS fromlast FROM walk)
  SELECT 'MAINNET' AS network, source, reason, prior AS prior_slot, 'p' || prior AS prior_signature, episode, detected_ms, CAST(pidx AS BIGINT) AS prior_index, details, n AS detections, refused AS rejected, CASE WHEN done THEN 'RESOLVED' ELSE 'ACTIVE' END AS status, CASE WHEN done THEN done_ms END AS resolved_ms,
    CASE WHEN done THEN done_slot END AS through_slot, CASE WHEN done THEN CAST(done_index AS BIGINT) END AS through_index, CASE WHEN done THEN done_sig END AS through_signature FROM ends WHERE done OR fromlast = 1 AND active"""

def decode_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nine layouts: each field of each event as text, or the error of the event."""
    out = []
    for turn, (kind, fields) in enumerate(layouts.LAYOUTS.items()):
        found = layouts.decoded(samples.layout_events(spark, sf_dir, kind, turn), kind)
        said = lambda name, t: F.array_join(F.transform(name, lambda x: F.concat_ws(":", x.address, x.share_bps.cast("string"))), ",") if t.startswith("shares") else F.col(name).cast("string")
        rows = F.array(*(F.struct(F.lit(n).alias("place"), F.lit(name).alias("field"), said(name, t).alias("value")) for n, (name, t) in enumerate(fields)))
        out.append(found.select("event_id", F.lit(kind).alias("kind"), "decode_error", F.explode(rows).alias("f")).select("event_id", "kind", "decode_error", "f.*"))
    return reduce(DataFrame.unionByName, out)


def _layout_sql() -> str:
    key = lambda letter: f"sha256('{letter}' || event_id)"
    rows = []
    for turn, (kind, fields) in enumerate(layouts.LAYOUTS.items()):
        for n, (name, t) in enumerate(fields):
            if t == "key":
                value = key(f"f{n}-")
            elif t == "bool":
                value = f"CASE WHEN (event_id + {n}) % 2 = 0 THEN 'false' ELSE 'true' END"
            elif t.startswith("str"):
                value = f"'t{n}-' || event_id"
            elif t.startswith("shares"):
                value = f"CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN {key('s0-')} || ':' || (event_id % 9000) ELSE {key('s0-')} || ':' || (event_id % 9000) || ',' || {key('s1-')} || ':' || ((event_id + 1) % 9000) END"
            else:
                value = f"CAST((event_id + {n}) % {samples.WRAPS[t]} AS VARCHAR)"
            rows.append(f"SELECT event_id, '{kind}' AS kind, k, {n} AS place, '{name}' AS field, {value} AS value FROM note WHERE event_id % {len(layouts.LAYOUTS)} = {turn}")
    return f"{NOTES}, f AS ({' UNION ALL '.join(rows)}) SELECT event_id, kind, CASE k WHEN 71 THEN 'TRUNCATED' WHEN 72 THEN 'TRAILING_BYTES' END AS decode_error, place, field, CASE WHEN k NOT IN (71, 72) THEN value END AS value FROM f"


def screening_conflicts(s: Scene) -> DataFrame:
    """Decisions that were saved again, some of them with other reasons: only those are conflicts."""
    m = F.col("mint").cast("long")
    saved = s.decided.select("mint", "opened_ms", "decision", "reasons", F.lit("e").alias("evidence"), F.col("claimed_ms").alias("evaluated_ms"))
    again = saved.filter(m % 4 == 0).withColumn("evaluated_ms", F.col("evaluated_ms") + 5)
    other = saved.filter(m % 5 == 0).withColumn("evidence", F.lit("f"))
    return evidence.finalization_conflicts(saved.unionByName(again).unionByName(other))


def pool_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations as sightings of pools, some with other mints or two equal ones."""
    o, k = adapters.observations(spark, sf_dir), F.col("k")
    quote = F.when(k == 33, "OTHER").when(k == 34, F.col("mint")).otherwise(F.col("asset"))
    return evidence.pools(o.select("network", F.concat(F.lit("pool-"), F.col("mint")).alias("pool"), F.col("mint").alias("base_mint"), quote.alias("quote_mint"), F.col("slot").alias("observed_slot"), F.col("signature").alias("observed_signature"), F.col("event_id").alias("arrival")))


_POOLS = NOTES + """, p AS (SELECT 'pool-' || mint AS pool, mint AS base_mint, CASE k WHEN 33 THEN 'OTHER' WHEN 34 THEN mint ELSE asset END AS quote_mint, slot, signature FROM obs),
  f AS (SELECT pool, arg_min(quote_mint, slot) AS q FROM p WHERE quote_mint <> base_mint GROUP BY pool)
  SELECT 'MAINNET' AS network, p.pool, CASE WHEN any_value(f.q) IS NOT NULL THEN any_value(base_mint) END AS base_mint, any_value(f.q) AS quote_mint, max(slot) FILTER (quote_mint = f.q AND quote_mint <> base_mint) AS observed_slot,
    arg_max(signature, slot) FILTER (quote_mint = f.q AND quote_mint <> base_mint) AS observed_signature, count(*) FILTER (NOT coalesce(quote_mint = f.q AND quote_mint <> base_mint, false)) AS conflicts FROM p LEFT JOIN f USING (pool) GROUP BY p.pool"""


def opening_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Creations as openers of windows, some of which break a rule."""
    o, k = adapters.observations(spark, sf_dir).filter("kind = 'CREATE'"), F.col("k")
    given = o.select(
        "event_id", F.when(k == 1, "TRADE").otherwise(F.col("kind")).alias("kind"), F.lit("PUMP").alias("source"), F.when(k == 2, "PUMP_SWAP").otherwise("PUMP_BONDING_CURVE").alias("venue"), "mint", F.concat(F.lit("c-"), F.col("mint")).alias("market_address"),
        "received_ms", F.lit("PUMP_MINT").alias("target_kind"), F.when(k == 3, " ").when(k == 4, "elsewhere").otherwise(F.col("mint")).alias("target_address"), F.when(k == 5, "").otherwise("run").alias("collector_run_id"),
        F.when(k == 6, F.col("received_ms") - 1).otherwise(F.col("received_ms")).alias("opened_ms"), F.when(k == 7, F.col("received_ms")).otherwise(F.col("received_ms") + 60_000).alias("closes_ms"),
    )
    return given.select("event_id", intake.opening_violation().alias("violation"))


def evidence_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarantine records of all events: by k the evidence is no base64 or too long, the code blank or too long, the detail too long."""
    e, k = adapters.notifications(spark, sf_dir), F.col("k")
    raw = F.when(k == 1, "*").when(k == 2, F.base64(F.repeat(F.lit("x"), 16_385).cast("binary"))).otherwise(F.base64(F.col("signature").cast("binary")))
    code = F.when(k == 3, "  ").when(k == 4, F.repeat(F.lit("c"), 129)).otherwise(F.col("kind"))
    detail = F.when(k == 5, F.repeat(F.lit("d"), 2_049)).otherwise(F.lit("d"))
    kept = text.evidence_columns(F.col("signature").cast("binary"))
    return e.select("event_id", lifecycle.evidence_violation(raw, code, detail).alias("violation"), *(c.alias(n) for n, c in kept.items()))


_LIMITS = NOTES + """ SELECT event_id, CASE k WHEN 1 THEN 'evidence_base64' WHEN 2 THEN 'evidence_size' WHEN 3 THEN 'reason_code' WHEN 4 THEN 'reason_code' WHEN 5 THEN 'reason_detail' END AS violation,
    sha256(signature) AS evidence_sha256, base64(encode(signature)) AS evidence_base64, octet_length(encode(signature)) > 12288 AS evidence_cut FROM note"""

def flat_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as transactions of two instructions, one of them with an inner one; some name an outer one that is not there, twice the same, or a program out of range."""
    e, k = adapters.notifications(spark, sf_dir), F.col("k")
    i = lambda program, account, data: F.struct(program.alias("program_id_index"), F.array(account).cast("array<int>").alias("accounts"), F.lit(data).alias("data"))
    n = lambda x: F.lit(x)
    group = lambda at: F.struct(at.cast("int").alias("index"), F.array(i(n(1), k % 6, "in")).alias("instructions"))
    inner = F.when(k % 10 == 1, F.array(group(n(7)))).when(k % 10 == 2, F.array(group(n(0)), group(n(0)))).when(k % 10 == 3, F.array().cast("array<struct<index:int,instructions:array<struct<program_id_index:int,accounts:array<int>,data:string>>>>")).otherwise(F.array(group(k % 2)))
    rows = e.select(
        "signature", F.array(F.col("mint"), F.lit("P")).alias("account_keys"), F.array(F.lit("W")).alias("loaded_writable"), F.array(F.lit("R")).alias("loaded_readonly"),
        F.array(i(F.when(k % 10 == 4, 9).otherwise(1), n(0), "a"), i(n(1), n(2), "b")).alias("instructions"), inner.alias("inner"),
    )
    found = transactions.instructions(rows)
    return found.withColumn("accounts", F.array_join(F.transform("accounts", lambda x: F.coalesce(x, F.lit("-"))), ",")).select("signature", "outer_index", "inner_index", "program", "accounts", "data", "instruction_error")


_FLAT = NOTES + """, t AS (SELECT signature, mint, k, CASE k % 10 WHEN 1 THEN 'NO_OUTER_INSTRUCTION' WHEN 2 THEN 'DUPLICATE_INNER_GROUP' WHEN 4 THEN 'PROGRAM_OUT_OF_RANGE' END AS err FROM note),
  keyed AS (SELECT *, [mint, 'P', 'W', 'R'] AS keys FROM t)
  SELECT signature, CAST(NULL AS INT) AS outer_index, CAST(NULL AS INT) AS inner_index, NULL AS program, NULL AS accounts, NULL AS data, err AS instruction_error FROM t WHERE err IS NOT NULL
  UNION ALL SELECT signature, 0, NULL, keys[2], keys[1], 'a', NULL FROM keyed WHERE err IS NULL UNION ALL SELECT signature, 1, NULL, keys[2], keys[3], 'b', NULL FROM keyed WHERE err IS NULL
  UNION ALL SELECT signature, k % 2, 0, keys[2], coalesce(keys[k % 6 + 1], '-'), 'in', NULL FROM keyed WHERE err IS NULL AND k % 10 <> 3"""


def price_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades with their price as a reduced fraction."""
    t = windows.validated(adapters.observations(spark, sf_dir)).filter("valid").withColumn("g", gcd(F.col("quote"), F.col("base")))
    return t.select("event_id", floor_div(F.col("quote"), F.col("g")).cast("long").alias("numerator"), floor_div(F.col("base"), F.col("g")).cast("long").alias("denominator"))


def active_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many gaps of each source are open, and since when."""
    found = gaps.episodes(gap_events(spark, sf_dir)).filter("status = 'ACTIVE'")
    return found.groupBy("source").agg(F.count("*").alias("gaps"), F.min("detected_ms").alias("since_ms"))


QUERIES = {
    "flat_instructions": flat_instructions,
    "price_ratios": price_ratios,
    "active_gaps": active_gaps,
    "finalization_order": scene(lambda s: registry.finalization_order(s.states).select("mint", "opened_ms", "closes_ms", "place"), once=True),
    "windows_held": scene(lambda s: registry.held_at(s.states, CUTOFF_MS), once=True),
    "screening_conflicts": scene(screening_conflicts, once=True),
    "pool_registry": pool_registry,
    "opening_validated": opening_validated,
    "evidence_limits": evidence_limits,
    "decode_layouts": decode_layouts,
    "gap_episodes": lambda spark, sf_dir: gaps.episodes(gap_events(spark, sf_dir)),
    "notification_contract": notification_contract,
    "summary_contract": summary_contract,
    "membership_validated": scene(membership_validated, once=True),
    "token_shape": scene(token_shape, once=True),
    "page_faults": lambda spark, sf_dir: evidence.page_faults(pages(spark, sf_dir), 3),
    "recovery_pages": recovery,
    "transactions_read": read_transactions,
    "scalar_formats": formats,
    "window_admissions": scene(admissions, once=True),
}
ORACLES = {
    "flat_instructions": _FLAT,
    "price_ratios": BASE + " SELECT event_id, CAST(quote // gcd(quote, base) AS BIGINT) AS numerator, CAST(base // gcd(quote, base) AS BIGINT) AS denominator FROM obs WHERE kind = 'TRADE' AND trim(coalesce(wallet, '')) <> '' AND base > 0 AND quote > 0",
    "active_gaps": f"SELECT source, count(*) AS gaps, min(detected_ms) AS since_ms FROM ({_GAPS}) WHERE status = 'ACTIVE' GROUP BY source",
    "finalization_order": STATES + " SELECT mint, opened_ms, closes_ms, row_number() OVER (ORDER BY closes_ms, mint, opener) - 1 AS place FROM states WHERE claimed_ms IS NOT NULL",
    "windows_held": STATES + f""" SELECT mint, opened_ms, CASE WHEN coalesce(left_ms > {CUTOFF_MS}, true) THEN 'ACTIVE' ELSE 'RETAINED' END AS held FROM states
      WHERE opened_ms <= {CUTOFF_MS} AND (coalesce(left_ms > {CUTOFF_MS}, true) OR status IN ('CONFIRMED', 'CANCELLED_CONFIRMED') AND coalesce(claimed_ms > {CUTOFF_MS}, true))""",
    "screening_conflicts": DECIDED + " SELECT mint, opened_ms, 2 + CASE WHEN CAST(mint AS BIGINT) % 4 = 0 THEN 1 ELSE 0 END AS copies FROM dec WHERE CAST(mint AS BIGINT) % 5 = 0",
    "pool_registry": _POOLS, "evidence_limits": _LIMITS,
    "opening_validated": NOTES + " SELECT event_id, CASE k WHEN 7 THEN 'window bounds' WHEN 3 THEN 'target_address' WHEN 5 THEN 'collector_run_id' WHEN 1 THEN 'opening target' WHEN 2 THEN 'opening target' WHEN 4 THEN 'opening target' WHEN 6 THEN 'opened_ms' END AS violation FROM obs WHERE kind = 'CREATE'",
    "decode_layouts": _layout_sql(), "gap_episodes": _GAPS, "notification_contract": _MESSAGES, "summary_contract": _SUMMARY, "membership_validated": _MEMBERSHIP, "token_shape": _SHAPE, "page_faults": _PAGES, "recovery_pages": _RECOVERY,
    "transactions_read": _READ, "scalar_formats": _FORMATS, "window_admissions": _ADMISSIONS,
}
