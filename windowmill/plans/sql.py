"""The same queries in DuckDB SQL, over one chain of common table expressions."""

from windowmill.plans.flows import CAPACITY, CLAIM_TTL_MS, CUTOFF_MS, FLOW_MS, IDLE_MS, LENGTH_MS, MAX_AGE_MS, POLICY, REVISIONS, SHIP_LENGTH_MS
from windowmill.operators.rules import RULES
from windowmill.operators.registry import CAUSES
from windowmill.sources.adapters import COLLECTOR, COLLECTOR_KS, CONTROL_KINDS, GAP_CENTS, READ_MS, UNREAD_K

_NOTES = f"""
WITH RECURSIVE raw AS (SELECT event_id, user_id, event_type AS t, epoch_us(ts) // 1000 AS received_ms, CAST(json_extract(props, '$.k') AS INT) AS k, CAST(round(value * 100) AS BIGINT) AS cents FROM events),
note AS (SELECT event_id, 'MAINNET' AS network, 'SRC_' || (user_id // 10) AS source, event_id AS slot, 'sig-' || event_id AS signature, received_ms, CAST(user_id AS VARCHAR) AS mint,
  CASE WHEN user_id % 10 = 0 THEN 'UNSUPPORTED' WHEN user_id % 10 <= 2 THEN 'STABLE' ELSE 'NATIVE' END AS asset,
  CASE WHEN t = 'signup' THEN 'CREATE' WHEN t IN ('purchase', 'click') THEN 'TRADE' WHEN t = 'view' THEN CASE WHEN k % 2 = 0 THEN 'LIQUIDITY_DEPOSIT' ELSE 'LIQUIDITY_WITHDRAW' END
       WHEN t = 'error' AND cents >= {GAP_CENTS} THEN 'GAP' WHEN t = 'error' AND k = 0 THEN 'COMPLETE' WHEN t = 'error' AND k = 1 THEN 'MIGRATION' ELSE 'NONE' END AS kind,
  CASE t WHEN 'purchase' THEN 'BUY' WHEN 'click' THEN 'SELL' END AS side,
  CASE WHEN t = 'click' AND k = 14 THEN '' WHEN t IN ('purchase', 'click') THEN 'w' || (k % 25) END AS wallet,
  CASE WHEN t = 'signup' THEN 'w' || (k % 25) END AS creator,
  CASE WHEN t IN ('purchase', 'click', 'view') THEN CAST(k + 1 AS BIGINT) END AS base,
  CASE WHEN t = 'purchase' AND k = 13 THEN 0 WHEN t IN ('purchase', 'click', 'view') THEN cents END AS quote,
  CASE WHEN t = 'view' THEN CAST(1000 + k AS BIGINT) END AS base_reserve, CASE WHEN t = 'view' THEN 100000 + cents END AS quote_reserve, k FROM raw),
obs AS (SELECT * FROM note WHERE kind NOT IN ('GAP', 'NONE')),
opener AS (SELECT mint, source, asset, received_ms AS opened_ms, signature AS opener FROM obs WHERE kind = 'CREATE'),"""
_GREEDY = f"""
chain(mint, opened_ms) AS (SELECT mint, min(opened_ms) FROM opener GROUP BY mint UNION ALL
  SELECT o.mint, min(o.opened_ms) FROM chain c JOIN opener o ON o.mint = c.mint AND o.opened_ms >= c.opened_ms + {LENGTH_MS} GROUP BY o.mint),
win AS (SELECT mint, source, asset, opened_ms, opened_ms + {LENGTH_MS} AS closes_ms, min(opener) AS opener FROM chain JOIN opener USING (mint, opened_ms) GROUP BY ALL),"""
_MEMBER = """
member AS (SELECT w.opened_ms, w.closes_ms, o.* FROM win w JOIN obs o ON o.mint = w.mint AND o.received_ms >= w.opened_ms AND o.received_ms < w.UNTIL),
judged AS (SELECT *, CASE WHEN kind = 'TRADE' AND trim(coalesce(wallet, '')) = '' THEN 'INVALID_TRADE_WALLET' WHEN kind = 'TRADE' AND (base <= 0 OR quote <= 0) THEN 'INVALID_TRADE_AMOUNT' END AS invalid_reason FROM member),
valid AS (SELECT * FROM judged WHERE kind = 'TRADE' AND invalid_reason IS NULL),
wal AS (SELECT mint, opened_ms, wallet, count(*) AS trades, count(*) FILTER (side = 'BUY') AS buys, count(*) FILTER (side = 'SELL') AS sells,
  CAST(sum(CASE WHEN side = 'BUY' THEN base ELSE 0 END) AS BIGINT) AS buy_base, CAST(sum(CASE WHEN side = 'BUY' THEN quote ELSE 0 END) AS BIGINT) AS buy_quote,
  CAST(sum(CASE WHEN side = 'SELL' THEN base ELSE 0 END) AS BIGINT) AS sell_base, CAST(sum(CASE WHEN side = 'SELL' THEN quote ELSE 0 END) AS BIGINT) AS sell_quote,
  CAST(sum(base) AS BIGINT) AS base_volume, CAST(sum(quote) AS BIGINT) AS quote_volume FROM valid GROUP BY ALL),
traded AS (SELECT mint, opened_ms, sum(trades) AS trades, sum(buys) AS buys, sum(sells) AS sells, sum(buy_base) AS buy_base, sum(buy_quote) AS buy_quote, sum(sell_base) AS sell_base, sum(sell_quote) AS sell_quote,
  CAST(sum(quote_volume) AS BIGINT) AS quote_volume, count(*) AS traders, count(*) FILTER (buys > 0) AS buyers, count(*) FILTER (sells > 0) AS sellers FROM wal GROUP BY ALL),
largest AS (SELECT mint, opened_ms, wallet AS top_wallet, quote_volume AS top_quote FROM wal QUALIFY row_number() OVER (PARTITION BY mint, opened_ms ORDER BY quote_volume DESC, wallet) = 1),
seen AS (SELECT mint, opened_ms, count(*) AS observations, max(slot) AS latest_slot FROM member GROUP BY ALL),
bad AS (SELECT mint, opened_ms, invalid_reason FROM judged WHERE invalid_reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY mint, opened_ms ORDER BY received_ms, slot) = 1),"""
_GAPPED = """
gap AS (SELECT source, event_id AS gap_id, received_ms AS gap_ms FROM note WHERE kind = 'GAP'),
gapped AS (SELECT DISTINCT mint, opened_ms FROM win JOIN gap USING (source) WHERE gap_ms >= opened_ms AND gap_ms < closes_ms),
complete AS (SELECT w.*, CASE WHEN g.mint IS NOT NULL THEN 'DECODE_GAP' ELSE b.invalid_reason END AS reason FROM win w LEFT JOIN gapped g USING (mint, opened_ms) LEFT JOIN bad b USING (mint, opened_ms)),
progress AS (SELECT source, max(received_ms) AS progress_ms FROM note GROUP BY source),
gate AS (SELECT c.*, progress_ms, reason IS NOT NULL OR coalesce(progress_ms >= closes_ms, false) AS finalizable FROM complete c LEFT JOIN progress USING (source)),"""
_METRICS = """
m AS (SELECT c.mint, c.opened_ms, c.closes_ms, c.source, c.asset, c.reason, coalesce(observations, 0) AS observations, latest_slot, CAST(coalesce(trades, 0) AS BIGINT) AS trades, CAST(coalesce(buys, 0) AS BIGINT) AS buys,
  CAST(coalesce(sells, 0) AS BIGINT) AS sells, coalesce(traders, 0) AS traders, coalesce(buyers, 0) AS buyers, coalesce(sellers, 0) AS sellers, CAST(coalesce(buy_base, 0) AS BIGINT) AS buy_base,
  CAST(coalesce(buy_quote, 0) AS BIGINT) AS buy_quote, CAST(coalesce(sell_base, 0) AS BIGINT) AS sell_base, CAST(coalesce(sell_quote, 0) AS BIGINT) AS sell_quote, coalesce(quote_volume, 0) AS quote_volume, top_wallet, top_quote,
  CASE WHEN quote_volume > 0 THEN CAST((CAST(top_quote AS HUGEINT) * 10000 + quote_volume - 1) // CAST(quote_volume AS HUGEINT) AS INT) END AS top_share_bps
  FROM complete c LEFT JOIN seen USING (mint, opened_ms) LEFT JOIN traded USING (mint, opened_ms) LEFT JOIN largest USING (mint, opened_ms))"""
_BASE = _NOTES + _GREEDY + _MEMBER.replace("UNTIL", "closes_ms") + _GAPPED + _METRICS
_W = "mint VARCHAR, source VARCHAR, asset VARCHAR, opener VARCHAR, opened BIGINT, confirmed BOOLEAN, reason VARCHAR, reason_ms BIGINT, status VARCHAR, left_ms BIGINT"
_KEPT = "mint := x.mint, source := x.source, asset := x.asset, opener := x.opener, opened := x.opened"
_CAUSES = ", ".join(f"('{c}', '{r}', '{a}')" for c, (r, a) in CAUSES.items())
_ACTS = f"""
caused AS (SELECT *, CASE WHEN kind = 'GAP' THEN 'DECODE_GAP' WHEN kind = 'NONE' AND k BETWEEN 2 AND 7 AND (k NOT IN {tuple(COLLECTOR_KS)} OR source = '{COLLECTOR}') THEN CASE k {' '.join(f"WHEN {k} THEN '{r}'" for k, r in CONTROL_KINDS.items())} END END AS cause FROM note),
acts AS (SELECT *, row_number() OVER (ORDER BY at_ms, ord) AS rn FROM (
  SELECT received_ms AS at_ms, event_id * 4 AS ord, 'OPEN' AS action, 'window' AS reach, mint, source, asset, signature AS opener, CAST(NULL AS VARCHAR) AS reason FROM note WHERE kind = 'CREATE'
  UNION ALL SELECT received_ms + (k % 9) * {READ_MS}, event_id * 4 + 1, CASE WHEN k % 23 = {UNREAD_K} THEN 'FAIL' ELSE 'CONFIRM' END, 'window', mint, source, asset, signature, NULL FROM note WHERE kind = 'CREATE'
  UNION ALL SELECT received_ms, event_id * 4 + 2, action, reach, mint, source, asset, NULL, cause FROM caused JOIN (VALUES {_CAUSES}) v(cause, reach, action) USING (cause))),"""
_OPENS = """
acts AS (SELECT *, row_number() OVER (ORDER BY at_ms, ord) AS rn FROM (
  SELECT received_ms AS at_ms, event_id * 4 + i AS ord, CASE i WHEN 0 THEN 'OPEN' ELSE 'CONFIRM' END AS action, 'window' AS reach, mint, source, asset, signature AS opener, CAST(NULL AS VARCHAR) AS reason
  FROM note, (SELECT unnest([0, 1]) AS i) WHERE kind = 'CREATE')),"""
_WALK = f"""
walk(rn, act, gone) AS (SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT({_W})[]), CAST([] AS STRUCT({_W})[]) UNION ALL
  SELECT rn, list_filter(moved, lambda x: x.status IS NULL) || CASE WHEN opens THEN [struct_pack(mint := mint, source := source, asset := asset, opener := opener, opened := at_ms, confirmed := false,
      reason := CAST(NULL AS VARCHAR), reason_ms := CAST(NULL AS BIGINT), status := CAST(NULL AS VARCHAR), left_ms := CAST(NULL AS BIGINT))] ELSE [] END, list_filter(moved, lambda x: x.status IS NOT NULL)
  FROM (SELECT *, list_transform(act, lambda x: CASE
      WHEN x.opened + {LENGTH_MS} <= at_ms THEN struct_pack({_KEPT}, confirmed := x.confirmed, reason := x.reason, reason_ms := x.reason_ms, status := CASE WHEN x.confirmed THEN 'CONFIRMED' ELSE 'DISCARDED' END, left_ms := x.opened + {LENGTH_MS})
      WHEN x.mint = victim OR action = 'CANCEL' AND (reach = 'all' OR reach = 'source' AND x.source = source OR reach = 'mint' AND x.mint = mint) THEN struct_pack({_KEPT}, confirmed := x.confirmed,
        reason := coalesce(x.reason, CASE WHEN action = 'OPEN' THEN 'CAPACITY_EVICTED' ELSE reason END), reason_ms := CASE WHEN x.reason IS NULL THEN at_ms ELSE x.reason_ms END,
        status := CASE WHEN x.confirmed THEN 'CANCELLED_CONFIRMED' ELSE 'CANCELLED_PENDING' END, left_ms := at_ms)
      WHEN action = 'FAIL' AND x.opener = opener AND NOT x.confirmed THEN struct_pack({_KEPT}, confirmed := false, reason := x.reason, reason_ms := x.reason_ms, status := 'CANCELLED_PENDING', left_ms := at_ms)
      WHEN action = 'CONFIRM' AND x.opener = opener THEN struct_pack({_KEPT}, confirmed := true, reason := x.reason, reason_ms := x.reason_ms, status := x.status, left_ms := x.left_ms)
      WHEN action = 'MARK' AND x.reason IS NULL AND (reach = 'all' OR reach = 'source' AND x.source = source OR reach = 'mint' AND x.mint = mint) THEN struct_pack({_KEPT}, confirmed := x.confirmed, reason := reason, reason_ms := at_ms, status := x.status, left_ms := x.left_ms)
      ELSE x END) AS moved
    FROM (SELECT *, CASE WHEN opens AND len(live) >= {CAPACITY} THEN list_min(list_transform(live, lambda x: struct_pack(opened := x.opened, mint := x.mint))).mint END AS victim
      FROM (SELECT *, action = 'OPEN' AND len(list_filter(live, lambda x: x.mint = mint)) = 0 AS opens FROM (SELECT e.*, w.act, list_filter(w.act, lambda x: x.opened + {LENGTH_MS} > e.at_ms) AS live FROM walk w JOIN acts e ON e.rn = w.rn + 1))))),
left_open AS (SELECT unnest(act) AS x FROM walk WHERE rn = (SELECT max(rn) FROM walk)),
registry AS (SELECT x.mint AS mint, x.source AS source, x.asset AS asset, x.opener AS opener, x.opened AS opened_ms, x.opened + {LENGTH_MS} AS closes_ms, x.status AS status, CASE WHEN x.confirmed THEN x.reason END AS reason, CASE WHEN x.confirmed THEN x.reason_ms END AS reason_ms, x.left_ms AS left_ms
    FROM (SELECT unnest(gone) AS x FROM walk)
  UNION ALL SELECT x.mint, x.source, x.asset, x.opener, x.opened, x.opened + {LENGTH_MS}, CASE WHEN x.confirmed THEN 'OPEN' ELSE 'PENDING' END, NULL, NULL, NULL FROM left_open)"""
_STATES = _NOTES + _ACTS + _WALK + """,
feed AS (SELECT source, received_ms AS at_ms FROM note WHERE NOT (kind = 'NONE' AND k BETWEEN 2 AND 7)),
seen_after AS (SELECT r.opener, min(f.at_ms) AS seen_ms FROM registry r JOIN feed f ON f.source = r.source AND f.at_ms >= r.closes_ms GROUP BY r.opener),
cancelled AS (SELECT r.opener, arg_min(a.reason, a.rn) AS late_reason, min(a.at_ms) AS late_ms FROM registry r JOIN acts a ON a.action = 'CANCEL' AND a.at_ms >= r.closes_ms AND (a.reach = 'all' OR a.reach = 'source' AND a.source = r.source) GROUP BY r.opener),
closed AS (SELECT r.*, seen_ms, late_reason, late_ms, status = 'CONFIRMED' AND reason IS NULL AS waits, status = 'CONFIRMED' AND reason IS NULL AND late_ms IS NOT NULL AND late_ms <= coalesce(seen_ms, late_ms) AS ended
  FROM registry r LEFT JOIN seen_after USING (opener) LEFT JOIN cancelled USING (opener)),
states AS (SELECT mint, source, asset, opener, opened_ms, closes_ms, CASE WHEN ended THEN 'CANCELLED_CONFIRMED' ELSE status END AS status, CASE WHEN ended THEN late_reason ELSE reason END AS reason, CASE WHEN ended THEN late_ms ELSE reason_ms END AS reason_ms, left_ms,
  CASE WHEN ended THEN late_ms WHEN waits THEN seen_ms WHEN status IN ('CONFIRMED', 'CANCELLED_CONFIRMED') THEN left_ms END AS claimed_ms FROM closed)"""
_CLAIMED = _STATES + """,
win AS (SELECT mint, source, asset, opener, opened_ms, closes_ms, left_ms, reason AS cause, claimed_ms FROM states WHERE claimed_ms IS NOT NULL),""" + _MEMBER.replace("UNTIL", "left_ms") + """
complete AS (SELECT w.*, coalesce(w.cause, b.invalid_reason) AS reason FROM win w LEFT JOIN bad b USING (mint, opened_ms)),""" + _METRICS



def _rule(number: int, decision: str, code: str, evidence: str) -> str:
    return (
        f"SELECT mint, opened_ms, latest_slot, {number + 1} AS rule_no, '{RULES[number]}' AS rule_id, CASE WHEN reason IS NOT NULL THEN 'UNKNOWN' ELSE {decision} END AS decision,"
        f" CASE WHEN reason IS NOT NULL THEN reason ELSE {code} END AS reason_code, CASE WHEN reason IS NULL THEN {evidence} END AS evidence FROM m"
    )


def _least(number: int, actual: str, least: int, name: str) -> str:
    ok = f"CASE WHEN {actual} >= {least} THEN"
    return _rule(number, f"{ok} 'PASS' ELSE 'REJECT' END", f"{ok} 'MINIMUM_{name}_MET' ELSE '{name}_BELOW_MINIMUM' END", f"'actual=' || {actual} || ';minimum={least}'")


_UNITS = POLICY.minimum_native_quote_units  # the same for stable assets here
_VOLUME = f"CASE WHEN asset = 'UNSUPPORTED' THEN '{{}}' WHEN quote_volume >= {_UNITS} THEN '{{}}' ELSE '{{}}' END"
_SHARE = f"CASE WHEN top_share_bps IS NULL THEN '{{}}' WHEN top_share_bps <= {POLICY.maximum_wallet_share_bps} THEN '{{}}' ELSE '{{}}' END"
_RULES = " UNION ALL ".join(
    [
        _rule(0, "'PASS'", "'WINDOW_COMPLETE'", "NULL"),
        _rule(1, "CASE WHEN asset = 'UNSUPPORTED' THEN 'REJECT' ELSE 'PASS' END", "CASE asset WHEN 'NATIVE' THEN 'SUPPORTED_NATIVE_QUOTE_ASSET' WHEN 'STABLE' THEN 'SUPPORTED_STABLE_QUOTE_ASSET' ELSE 'UNSUPPORTED_QUOTE_ASSET' END", "asset"),
        _least(2, "trades", POLICY.minimum_trades, "TRADES"),
        _least(3, "traders", POLICY.minimum_unique_traders, "UNIQUE_TRADERS"),
        _least(4, "buys", POLICY.minimum_buys, "BUYS"),
        _least(5, "sells", POLICY.minimum_sells, "SELLS"),
        _rule(6, _VOLUME.format("UNKNOWN", "PASS", "REJECT"), _VOLUME.format("QUOTE_VOLUME_THRESHOLD_UNAVAILABLE", "MINIMUM_QUOTE_VOLUME_MET", "QUOTE_VOLUME_BELOW_MINIMUM"), f"CASE WHEN asset = 'UNSUPPORTED' THEN 'observed_units=' || quote_volume ELSE 'actual=' || quote_volume || ';minimum={_UNITS}' END"),
        _rule(7, _SHARE.format("UNKNOWN", "PASS", "REJECT"), _SHARE.format("WALLET_CONCENTRATION_UNAVAILABLE", "WALLET_CONCENTRATION_WITHIN_LIMIT", "WALLET_CONCENTRATION_EXCEEDS_LIMIT"), f"CASE WHEN top_share_bps IS NULL THEN 'observed_quote_units=' || quote_volume ELSE 'wallet=' || top_wallet || ';actual_bps=' || top_share_bps || ';maximum_bps={POLICY.maximum_wallet_share_bps}' END"),
    ]
)
_DECIDED = _CLAIMED + f""",
rr AS ({_RULES}),
folded AS (SELECT mint, opened_ms, CASE WHEN bool_or(decision = 'REJECT') THEN 'REJECT' WHEN bool_or(decision = 'UNKNOWN') THEN 'UNKNOWN' ELSE 'PASS' END AS decision FROM rr GROUP BY ALL),
dec AS (SELECT f.mint, f.opened_ms, f.decision, CASE WHEN f.decision = 'PASS' THEN '' ELSE (SELECT string_agg(c, ',' ORDER BY c) FROM (SELECT DISTINCT reason_code AS c FROM rr r WHERE r.mint = f.mint AND r.opened_ms = f.opened_ms AND r.decision = f.decision)) END AS reasons FROM folded f),
current AS (SELECT mint, opened_ms, row_number() OVER (PARTITION BY mint ORDER BY opened_ms DESC, opener DESC) = 1 AS is_current FROM states WHERE status IN ('CONFIRMED', 'CANCELLED_CONFIRMED', 'OPEN'))"""
_STAGED = _DECIDED + """,
aged AS (SELECT *, CASE WHEN kind = 'CREATE' THEN 'name-' || event_id END AS name, coalesce(slot < max(slot) OVER (PARTITION BY mint ORDER BY received_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stale FROM obs),
latest AS (SELECT mint, slot AS latest_slot, kind AS latest_kind, signature AS latest_signature FROM obs QUALIFY row_number() OVER (PARTITION BY mint ORDER BY slot DESC, received_ms DESC) = 1),
times AS (SELECT mint, min(received_ms) FILTER (NOT stale) AS first_observed_ms, max(received_ms) FILTER (NOT stale) AS last_observed_ms, count(*) FILTER (stale) AS stale_rows,
  arg_max(name, received_ms) FILTER (NOT stale AND kind = 'CREATE') AS own, arg_min(name, received_ms) FILTER (stale AND kind = 'CREATE') AS filled FROM aged GROUP BY mint),
durable AS (SELECT *, coalesce(lead(opened_ms) OVER (PARTITION BY mint ORDER BY opened_ms, opener) > claimed_ms, lead(opened_ms) OVER (PARTITION BY mint ORDER BY opened_ms, opener) IS NULL) AS newest FROM states WHERE status IN ('CONFIRMED', 'CANCELLED_CONFIRMED', 'OPEN')),
held AS (SELECT o.*, d.opened_ms AS window_ms, CASE WHEN o.k >= 90 THEN o.asset || '-B' ELSE o.asset END AS market FROM obs o LEFT JOIN durable d ON d.mint = o.mint AND o.received_ms >= d.opened_ms AND o.received_ms < coalesce(d.left_ms, d.closes_ms)),
tev AS (SELECT *, row_number() OVER (PARTITION BY mint ORDER BY at_ms, ordinal) AS rn FROM (
  SELECT mint, received_ms AS at_ms, event_id * 4 AS ordinal, 'OBSERVE' AS action, slot, market, window_ms, CAST(NULL AS VARCHAR) AS decision, kind, CASE WHEN kind = 'CREATE' THEN 'name-' || event_id END AS name FROM held
  UNION ALL SELECT mint, received_ms, event_id * 4 + 1, 'APPROVE', slot, market, window_ms, NULL, kind, NULL FROM held WHERE k % 10 = 3 AND CAST(mint AS BIGINT) % 3 = 0
  UNION ALL SELECT mint, received_ms, event_id * 4 + 2, 'REMOVE', slot, market, window_ms, NULL, kind, NULL FROM held WHERE k = 51 AND CAST(mint AS BIGINT) % 7 = 0
  UNION ALL SELECT d.mint, d.claimed_ms, CAST(substr(d.opener, 5) AS BIGINT) * 4 + 3, 'FINALIZE', 0, d.asset, d.opened_ms, CASE WHEN d.newest THEN c.decision END, NULL, NULL FROM durable d JOIN dec c USING (mint, opened_ms))),
tok(mint, rn, ordinal, outcome, top, market, stage, window_ms, act_ms, first_ms, last_ms, name) AS (
  SELECT DISTINCT mint, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR) FROM tev
  UNION ALL SELECT mint, next_rn, new_ordinal,
    CASE WHEN inserts THEN 'INSERTED' WHEN stale THEN CASE WHEN kind = 'CREATE' AND name IS NULL THEN 'METADATA_ENRICHED_FROM_STALE_CREATION' ELSE 'STALE_OBSERVATION_IGNORED' END
      WHEN takes THEN CASE WHEN NOT same AND stage <> 'OBSERVED' THEN 'DEMOTED_BY_MARKET_CHANGE' ELSE 'UPDATED' END WHEN NOT present THEN 'NO_TOKEN' WHEN action = 'REMOVE' THEN 'REMOVED'
      WHEN action = 'FINALIZE' THEN CASE WHEN NOT current THEN 'NOT_CURRENT' WHEN NOT same THEN 'MARKET_MISMATCH' ELSE 'FINALIZED_' || decided END WHEN NOT same THEN 'MARKET_MISMATCH' WHEN stage = 'OBSERVED' THEN 'CANDIDATE_NOT_QUALIFIED' ELSE 'APPROVED' END,
    CASE WHEN action = 'REMOVE' THEN NULL WHEN action = 'OBSERVE' THEN greatest(top, slot) ELSE top END,
    CASE WHEN action = 'REMOVE' THEN NULL WHEN takes THEN new_market ELSE market END,
    CASE WHEN action = 'REMOVE' THEN NULL WHEN takes THEN CASE WHEN present AND same THEN stage ELSE 'OBSERVED' END WHEN action = 'FINALIZE' AND current AND same THEN decided WHEN action = 'APPROVE' AND same AND stage <> 'OBSERVED' THEN 'APPROVED' ELSE stage END,
    CASE WHEN action = 'REMOVE' THEN NULL WHEN takes THEN new_window ELSE window_ms END,
    CASE WHEN action = 'REMOVE' OR takes OR stale AND same THEN NULL WHEN action = 'FINALIZE' AND current AND same THEN new_window ELSE act_ms END,
    CASE WHEN action = 'REMOVE' THEN NULL WHEN takes THEN least(first_ms, at_ms) ELSE first_ms END, CASE WHEN action = 'REMOVE' THEN NULL WHEN takes THEN greatest(last_ms, at_ms) ELSE last_ms END,
    CASE WHEN action = 'REMOVE' THEN NULL WHEN takes THEN coalesce(new_name, name) WHEN stale THEN coalesce(name, new_name) ELSE name END
  FROM (SELECT *, action = 'OBSERVE' AND NOT present AS inserts, action = 'OBSERVE' AND NOT stale AS takes, CASE WHEN decision = 'PASS' THEN CASE WHEN stage = 'APPROVED' THEN 'APPROVED' ELSE 'QUALIFIED' END ELSE 'OBSERVED' END AS decided
    FROM (SELECT t.* EXCLUDE (ordinal, outcome), e.rn AS next_rn, e.* EXCLUDE (mint, rn, ordinal, market, window_ms, name), e.ordinal AS new_ordinal, e.market AS new_market, e.window_ms AS new_window, e.name AS new_name, t.stage IS NOT NULL AS present,
        coalesce(t.market = e.market, false) AS same, coalesce(e.action = 'OBSERVE' AND t.stage IS NOT NULL AND e.slot < t.top, false) AS stale, coalesce(e.decision IS NOT NULL AND t.window_ms = e.window_ms, false) AS current
      FROM tok t JOIN tev e ON e.mint = t.mint AND e.rn = t.rn + 1))),
ended AS (SELECT * FROM tok QUALIFY row_number() OVER (PARTITION BY mint ORDER BY rn DESC) = 1),
token AS (SELECT l.*, first_observed_ms, last_observed_ms, stale_rows, coalesce(own, filled) AS name, CASE WHEN own IS NOT NULL THEN 'CREATED' WHEN filled IS NOT NULL THEN 'ENRICHED_FROM_STALE_CREATION' ELSE 'UNNAMED' END AS metadata,
  t.stage FROM latest l JOIN times USING (mint) JOIN (SELECT mint, stage FROM ended WHERE stage IS NOT NULL) t USING (mint))"""


def _order(kind: str) -> str:
    return f"(SELECT mint, opened_ms, string_agg(signature || '/0/0', ',' ORDER BY received_ms, slot) AS keys, count(*) AS n FROM member WHERE kind = '{kind}' GROUP BY ALL)"


def _point(name: str, order: str) -> str:
    return f"(SELECT mint, opened_ms, quote, base, signature FROM valid QUALIFY row_number() OVER (PARTITION BY mint, opened_ms ORDER BY {order}) = 1) {name}"


def _reserve(name: str, order: str) -> str:
    return f"(SELECT mint, opened_ms, base_reserve AS b, quote_reserve AS q, signature AS s FROM member WHERE base_reserve IS NOT NULL QUALIFY row_number() OVER (PARTITION BY mint, opened_ms ORDER BY {order}) = 1) {name}"


def _reasons(decision: str) -> str:
    return f"{_DECIDED} SELECT reason_code, count(*) AS windows, max(closes_ms) AS last_seen_ms FROM (SELECT DISTINCT mint, opened_ms, reason_code FROM dec d JOIN rr r USING (mint, opened_ms) WHERE d.decision = '{decision}' AND r.decision = '{decision}') JOIN win USING (mint, opened_ms) GROUP BY reason_code"


def _snapshot(stages: str) -> str:
    return f"{_STAGED} SELECT mint, latest_slot, latest_kind, name, stage FROM token WHERE stage IN ({stages}) ORDER BY latest_slot DESC, mint LIMIT 500"


_COPIES = _BASE + """,
arr AS (SELECT *, 'h-' || event_id AS evidence, CAST(NULL AS BIGINT) AS tx, event_id * 10 AS arrival FROM obs
  UNION ALL SELECT * REPLACE (received_ms - 1000 AS received_ms), 'h-' || event_id, NULL, event_id * 10 + 1 FROM obs WHERE event_id % 7 = 0
  UNION ALL SELECT *, 'x-' || event_id, NULL, event_id * 10 + 2 FROM obs WHERE event_id % 11 = 0
  UNION ALL SELECT *, 'h-' || event_id, k, event_id * 10 + 3 FROM obs WHERE event_id % 13 = 0
  UNION ALL SELECT *, 'h-' || event_id, k + 1, event_id * 10 + 4 FROM obs WHERE event_id % 26 = 0),
byk AS (SELECT signature, count(*) AS copies, count(DISTINCT evidence) AS contents, count(DISTINCT tx) AS indexes, min(received_ms) AS earliest, arg_min(received_ms, arrival) AS first_ms, min(kind) AS kind FROM arr GROUP BY signature)"""
_PRICE = "CAST(quote AS HUGEINT) * 1000000 // base"  # amounts are small here: base at most 100, so six digits tell fractions apart
_CHAIN = _NOTES.rstrip().rstrip(",") + """,
said AS (SELECT *, unnest(CASE WHEN kind = 'CREATE' AND k % 3 = 0 THEN [(2, 0, 'CREATE'), (1, 0, 'TRADE')] WHEN kind = 'CREATE' AND k % 3 = 1 THEN [(1, 0, 'CREATE'), (1, 1, 'TRADE'), (3, 0, 'TRADE')]
    WHEN kind IN ('COMPLETE', 'MIGRATION') THEN [(0, 0, 'TRADE'), (1, 0, kind), (1, 1, 'TRADE'), (2, 0, 'TRADE')] ELSE [(k % 3, 0, kind)] END) AS e FROM obs),
che AS (SELECT event_id, slot // 2 AS cslot, slot % 2 AS tx, signature, e[3] AS kind, e[1] AS instruction_index, e[2] AS event_index, CASE WHEN k % 4 = 3 THEN 1 ELSE 0 END AS program_rank, mint,
    CASE WHEN k % 19 = 4 AND e[3] = 'TRADE' THEN 'OTHER' ELSE asset END AS qm, CASE WHEN e[3] = kind THEN base WHEN e[3] = 'TRADE' THEN k + 1 END AS base, CASE WHEN e[3] = kind THEN quote WHEN e[3] = 'TRADE' THEN k + 1 END AS quote,
    CASE WHEN e[3] = 'CREATE' THEN 0 ELSE 1 END AS after_discovery FROM said)"""
_INTAKE = _BASE + f""",
marked AS (SELECT signature, k % 17 = 3 AS failed, k BETWEEN 81 AND 84 AS malformed FROM note),
ev AS (SELECT o.*, 'mint:' || mint AS target, received_ms - k * 400 + 5000 AS event_ms, unnest(CASE WHEN k % 5 = 0 THEN [0, 1] ELSE [0] END) AS event_order FROM obs o),
disc AS (SELECT *, event_ms BETWEEN received_ms - {MAX_AGE_MS} AND received_ms + 10000 AS fresh FROM ev WHERE kind IN ('CREATE', 'CREATE_POOL')),
seeds AS (SELECT signature, target, min(event_order) AS event_order, arg_min(event_ms, event_order) AS event_ms FROM disc WHERE fresh GROUP BY ALL),
taken AS (SELECT e.signature, count(DISTINCT e.target) AS n FROM ev e JOIN win w ON w.mint = e.mint AND e.received_ms >= w.opened_ms AND e.received_ms < w.closes_ms WHERE e.kind NOT IN ('CREATE', 'CREATE_POOL') GROUP BY e.signature)"""
NOTES, BASE, STATES, DECIDED, STAGED = _NOTES.rstrip().rstrip(","), _BASE, _STATES, _DECIDED, _STAGED
ORACLES = {
    "windows_evict": _NOTES + _OPENS + _WALK + " SELECT mint, opened_ms, closes_ms, CASE WHEN status = 'CANCELLED_CONFIRMED' THEN left_ms END AS evicted_ms FROM registry",
    "window_states": _STATES + " SELECT *, (SELECT count(*) FROM acts a WHERE a.reason = 'PIPELINE_RESTARTED' AND a.at_ms < s.opened_ms) AS run FROM states s",
    "intake_faults": _NOTES.rstrip().rstrip(",") + " SELECT signature, k BETWEEN 81 AND 84 AS malformed, CASE WHEN k BETWEEN 81 AND 84 THEN 'DECODE_GAP' WHEN k = 85 THEN 'CPI_INSTRUCTION_DATA_UNAVAILABLE' END AS cause FROM note WHERE k <> 87",
    "intake_marks": _STATES.replace("USING (cause))),", """USING (cause)
  UNION ALL SELECT received_ms, event_id * 4 + 3, 'MARK', 'source', mint, source, asset, NULL, CASE WHEN k = 85 THEN 'CPI_INSTRUCTION_DATA_UNAVAILABLE' ELSE 'DECODE_GAP' END FROM note WHERE k BETWEEN 81 AND 85)),""") + " SELECT mint, opened_ms, status, reason, reason_ms FROM registry",
    "log_scope": _BASE + """, shape AS (SELECT signature, event_id, unnest(CASE k % 6
        WHEN 0 THEN [{'i': 0, 'e': 0, 'l': 'a', 'x': NULL}] WHEN 1 THEN [{'i': 1, 'e': 0, 'l': 'a', 'x': NULL}, {'i': 1, 'e': 1, 'l': 'b', 'x': NULL}] WHEN 2 THEN [{'i': 0, 'e': 0, 'l': 'a', 'x': NULL}]
        WHEN 3 THEN [{'i': NULL, 'e': NULL, 'l': NULL, 'x': 'TRUNCATED_LOGS'}] WHEN 4 THEN [{'i': NULL, 'e': NULL, 'l': NULL, 'x': 'INVALID_INVOCATION_DEPTH'}] ELSE [{'i': NULL, 'e': NULL, 'l': NULL, 'x': 'UNCLOSED_INVOCATIONS'}] END) AS s FROM note)
      SELECT signature, CAST(s.i AS INT) AS instruction_index, CAST(s.e AS INT) AS event_index, CASE WHEN s.l IS NOT NULL THEN to_base64(encode(s.l || event_id)) END AS payload, s.x AS scope_error FROM shape""",
    "decode_events": _BASE + """, f AS (SELECT event_id, received_ms, CASE k % 7 WHEN 0 THEN 'TRUNCATED' WHEN 1 THEN 'TRAILING_BYTES' WHEN 2 THEN 'UNKNOWN_DISCRIMINATOR' WHEN 3 THEN 'INVALID_BASE64' END AS decode_error FROM note)
      SELECT event_id, decode_error, CASE WHEN decode_error IS NULL THEN sha256('u' || event_id) END AS user, CASE WHEN decode_error IS NULL THEN sha256('m' || event_id) END AS mint,
        CASE WHEN decode_error IS NULL THEN sha256('c' || event_id) END AS bonding_curve, CASE WHEN decode_error IS NULL THEN received_ms END AS timestamp, CASE WHEN decode_error IS NULL THEN sha256('q' || event_id) END AS quote_mint FROM f""",
    "event_dispatch": _BASE + " SELECT event_id, CASE WHEN k % 2 = 0 THEN 'CURVE' ELSE 'SWAP' END AS program, CASE WHEN k % 4 = 0 THEN 'COMPLETE' END AS kind, CASE k % 4 WHEN 0 THEN 'DECODED' WHEN 2 THEN 'IGNORED' ELSE 'UNKNOWN' END AS status FROM note",
    "cpi_pairing": _BASE + """, e AS (SELECT event_id, 's' || (event_id // 40) AS signature, k % 2 AS instruction_index, 'p' || (k % 3) AS payload FROM note),
      sent AS (SELECT * FROM e WHERE event_id % 2 = 0 UNION ALL SELECT * FROM e WHERE event_id % 3 = 0),
      a AS (SELECT signature, instruction_index, payload, count(*) AS n FROM sent GROUP BY ALL), b AS (SELECT signature, instruction_index, payload, count(*) AS n FROM e GROUP BY ALL)
      SELECT a.signature, a.instruction_index, a.payload, 'CPI_EVENT_WITHOUT_CANONICAL_LOG' AS reason_code, a.n - coalesce(b.n, 0) AS copies FROM a LEFT JOIN b USING (signature, instruction_index, payload) WHERE a.n > coalesce(b.n, 0)""",
    "call_coverage": _BASE + """, shape AS (SELECT event_id, unnest(CASE k % 6
        WHEN 0 THEN [{'i': 0, 'c': 1, 'g': false, 'x': NULL}] WHEN 1 THEN [{'i': 0, 'c': 0, 'g': true, 'x': NULL}] WHEN 2 THEN [{'i': 0, 'c': 1, 'g': true, 'x': NULL}] WHEN 3 THEN [{'i': 0, 'c': 0, 'g': true, 'x': NULL}]
        WHEN 4 THEN [{'i': 0, 'c': 0, 'g': false, 'x': NULL}, {'i': 1, 'c': 1, 'g': false, 'x': NULL}] ELSE [{'i': NULL, 'c': NULL, 'g': NULL, 'x': 'UNCLOSED_INVOCATIONS'}] END) AS s FROM note)
      SELECT 'n' || event_id AS signature, CAST(s.i AS INT) AS instruction_index, CAST(s.c AS INT) AS calls, CAST(s.g AS BOOLEAN) AS gap, s.x AS scope_error FROM shape""",
    "coverage_incomplete": _BASE + " SELECT 'n' || event_id AS signature, k % 6 IN (1, 2, 3) AS incomplete FROM note WHERE k % 6 <> 5",
    "snapshot_totals": _STAGED + " SELECT count(*) AS tokens_total, least(count(*), 50) AS returned, count(*) > 50 AS tokens_truncated FROM token",
    "token_outcomes": _STAGED + " SELECT mint, ordinal, outcome FROM tok WHERE rn > 0",
    "token_counters": _STAGED + " SELECT 'OUTCOME' AS what, outcome AS name, count(*) AS value FROM tok WHERE rn > 0 GROUP BY outcome UNION ALL SELECT 'TOKEN', stage, count(*) FROM ended WHERE stage IS NOT NULL GROUP BY stage",
    "token_fold": _STAGED + """, life AS (SELECT mint, market, count(*) AS n FROM held WHERE kind = 'TRADE' AND trim(coalesce(wallet, '')) <> '' AND base > 0 AND quote > 0 GROUP BY ALL)
      SELECT e.mint, e.market, e.stage, e.window_ms, e.act_ms AS activity_window_ms, e.top AS latest_slot, e.first_ms, e.last_ms, e.name, CAST(coalesce(CASE WHEN e.act_ms IS NULL THEN l.n ELSE m.trades END, 0) AS BIGINT) AS trades
      FROM ended e LEFT JOIN life l ON l.mint = e.mint AND l.market = e.market LEFT JOIN m ON m.mint = e.mint AND m.opened_ms = e.act_ms WHERE e.stage IS NOT NULL""",
    "intake_seeds": _INTAKE + " SELECT * FROM seeds",
    "intake_classified": _INTAKE + """ SELECT m.signature, CASE WHEN failed THEN 'FAILED_TRANSACTION' WHEN s.n > 0 THEN 'FETCH_DISCOVERY' WHEN t.n > 0 THEN 'COLLECT_TRACKED_ACTIVITY' WHEN d.signature IS NOT NULL THEN 'STALE_DISCOVERY' WHEN malformed THEN 'MALFORMED_LOGS' ELSE 'IRRELEVANT' END AS disposition,
      CASE WHEN failed THEN 0 ELSE coalesce(s.n, 0) END AS seeds, CASE WHEN failed THEN 0 ELSE coalesce(t.n, 0) END AS tracked
      FROM marked m LEFT JOIN (SELECT signature, count(*) AS n FROM seeds GROUP BY ALL) s USING (signature) LEFT JOIN taken t USING (signature) LEFT JOIN (SELECT DISTINCT signature FROM disc WHERE NOT fresh) d USING (signature)""",
    "live_window_metrics": _BASE + """ SELECT w.mint, w.opened_ms, w.closes_ms, w.source, w.opener, m.observations, m.trades, m.buys, m.sells, m.traders, m.buy_base, m.buy_quote, m.sell_base, m.sell_quote, b.invalid_reason AS first_invalid
      FROM win w JOIN m USING (mint, opened_ms) LEFT JOIN bad b USING (mint, opened_ms) WHERE w.closes_ms <= (SELECT max(received_ms) - 60000 FROM obs)""",
    "live_idle_gaps": _BASE + f""", t AS (SELECT source, received_ms, coalesce(lead(received_ms) OVER (PARTITION BY source ORDER BY received_ms), (SELECT max(received_ms) - 60000 FROM note)) AS next_ms FROM note WHERE received_ms <= (SELECT max(received_ms) - 60000 FROM note))
      SELECT source, received_ms AS last_seen_ms, received_ms + {IDLE_MS} AS gap_ms FROM t WHERE least(next_ms, (SELECT max(received_ms) - 60000 FROM note)) - received_ms >= {IDLE_MS}""",
    "event_order": _CHAIN + " SELECT signature, instruction_index, event_index, kind, row_number() OVER (PARTITION BY signature ORDER BY after_discovery, program_rank, instruction_index, event_index) - 1 AS place FROM che",
    "market_matched": _CHAIN + """, side AS (SELECT *, 0 AS side, CAST(NULL AS INT) AS entry FROM che WHERE kind <> 'CREATE' UNION ALL SELECT *, 1, 1 FROM che WHERE kind IN ('CREATE', 'COMPLETE', 'MIGRATION')),
      j AS (SELECT *, last_value(CASE WHEN entry = 1 THEN kind = 'CREATE' END IGNORE NULLS) OVER o AS m_open, last_value(CASE WHEN entry = 1 THEN cslot END IGNORE NULLS) OVER o AS m_slot, last_value(CASE WHEN entry = 1 THEN qm END IGNORE NULLS) OVER o AS m_qm FROM side
        WINDOW o AS (PARTITION BY mint ORDER BY cslot, tx, after_discovery, program_rank, instruction_index, event_index, side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
      r AS (SELECT *, CASE WHEN kind = 'TRADE' AND (base <= 0 OR quote <= 0) THEN 'ZERO_TRADE_AMOUNT' WHEN NOT coalesce(m_open, false) THEN 'UNRESOLVED_MARKET' WHEN kind = 'TRADE' AND qm IS DISTINCT FROM m_qm THEN 'QUOTE_MINT_MISMATCH' END AS reason FROM j WHERE side = 0)
      SELECT event_id, instruction_index, event_index, kind, mint, reason AS quarantine_reason, CASE WHEN reason IS NULL THEN m_slot END AS registered_slot FROM r""",
    "obs_normalize": _BASE + " SELECT event_id, source, mint, asset, kind, side, nullif(trim(wallet), '') AS wallet, creator, base, quote, base_reserve, quote_reserve, received_ms FROM obs",
    "obs_dedup_replay": _COPIES + " SELECT signature, CASE WHEN kind = 'CREATE' THEN first_ms ELSE earliest END AS received_ms, CAST(NULL AS BIGINT) AS transaction_index, kind, copies FROM byk WHERE contents = 1 AND indexes <= 1",
    "obs_replay_conflicts": _COPIES + " SELECT signature, copies, CASE WHEN contents > 1 THEN 'CONTENT' ELSE 'TRANSACTION_INDEX' END AS conflict_kind FROM byk WHERE contents > 1 OR indexes > 1",
    "obs_total_order": _BASE + " SELECT mint, event_id, row_number() OVER (PARTITION BY mint ORDER BY received_ms, slot) AS position FROM obs",
    "windows_open": _BASE + " SELECT * FROM win",
    "window_superseded": _BASE + " SELECT mint, opened_ms, row_number() OVER (PARTITION BY mint ORDER BY opened_ms DESC) = 1 AS is_current FROM win",
    "window_membership": _BASE + " SELECT mint, opened_ms, event_id FROM member",
    "membership_mismatch": _BASE + " SELECT o.event_id, o.mint, w.opened_ms, CASE WHEN w.mint IS NULL THEN 'NO_WINDOW' WHEN o.received_ms >= w.closes_ms THEN 'received_after_close' END AS mismatch_field FROM obs o ASOF LEFT JOIN win w ON o.mint = w.mint AND o.received_ms >= w.opened_ms",
    "window_completeness": _BASE + " SELECT mint, opened_ms, reason FROM complete",
    "window_watermark_gate": _BASE + " SELECT mint, opened_ms, progress_ms, finalizable FROM gate",
    "window_counts_volumes": _BASE + " SELECT mint, opened_ms, observations, latest_slot, trades, buys, sells, buy_base, buy_quote, sell_base, sell_quote FROM m",
    "window_unique_traders": _BASE + " SELECT mint, opened_ms, traders, buyers, sellers FROM m",
    "window_wallets": _BASE + " SELECT * FROM wal",
    "window_top_wallet": _BASE + " SELECT mint, opened_ms, top_wallet, top_quote, top_share_bps FROM m",
    "window_creator_share": _BASE + """, made AS (SELECT DISTINCT mint, opened_ms, creator AS wallet FROM member WHERE kind = 'CREATE' AND creator <> ''),
      own AS (SELECT mint, opened_ms, count(*) AS n, string_agg(wallet, ',' ORDER BY wallet) AS creators, CAST(coalesce(sum(quote_volume), 0) AS BIGINT) AS q FROM made LEFT JOIN wal USING (mint, opened_ms, wallet) GROUP BY ALL)
      SELECT mint, opened_ms, coalesce(n, 0) AS n_creators, coalesce(creators, '') AS creators, q AS creator_quote, CASE WHEN quote_volume > 0 THEN CAST((CAST(q AS HUGEINT) * 10000 + quote_volume - 1) // CAST(quote_volume AS HUGEINT) AS INT) END AS creator_share_bps
      FROM win LEFT JOIN own USING (mint, opened_ms) LEFT JOIN traded USING (mint, opened_ms)""",
    "window_prices": _BASE + f""", span AS (SELECT mint, opened_ms, min(received_ms) AS first_trade_ms, max(received_ms) AS last_trade_ms, arg_min(slot, (received_ms, slot)) AS first_trade_slot, arg_max(slot, (received_ms, slot)) AS last_trade_slot FROM valid GROUP BY ALL)
      SELECT mint, opened_ms, first_trade_ms, last_trade_ms, first_trade_slot, last_trade_slot, {', '.join(f'{p}.{c} AS {p}_{c}' for p in ('first', 'last', 'low', 'high') for c in ('quote', 'base', 'signature'))},
        CAST((CASE WHEN CAST(last.quote AS HUGEINT) * first.base >= CAST(first.quote AS HUGEINT) * last.base THEN 1 ELSE -1 END) * (abs(CAST(last.quote AS HUGEINT) * first.base - CAST(first.quote AS HUGEINT) * last.base) * 10000 // (CAST(first.quote AS HUGEINT) * last.base)) AS BIGINT) AS price_change_bps
      FROM span JOIN {_point('first', 'received_ms, slot')} USING (mint, opened_ms) JOIN {_point('last', 'received_ms DESC, slot DESC')} USING (mint, opened_ms)
      JOIN {_point('low', f'{_PRICE}, received_ms')} USING (mint, opened_ms) JOIN {_point('high', f'{_PRICE} DESC, received_ms')} USING (mint, opened_ms)""",
    "window_reserves": _BASE + f""", n AS (SELECT mint, opened_ms, count(*) AS samples FROM member WHERE base_reserve IS NOT NULL GROUP BY ALL)
      SELECT mint, opened_ms, samples, f.b AS first_base, f.q AS first_quote, l.b AS latest_base, l.q AS latest_quote, b0.b AS min_base_reserve, b0.s AS min_base_reserve_signature, b1.b AS max_base_reserve, b1.s AS max_base_reserve_signature,
        q0.q AS min_quote_reserve, q0.s AS min_quote_reserve_signature, q1.q AS max_quote_reserve, q1.s AS max_quote_reserve_signature
      FROM n JOIN {_reserve('f', 'received_ms')} USING (mint, opened_ms) JOIN {_reserve('l', 'received_ms DESC')} USING (mint, opened_ms) JOIN {_reserve('b0', 'base_reserve, received_ms')} USING (mint, opened_ms)
      JOIN {_reserve('b1', 'base_reserve DESC, received_ms')} USING (mint, opened_ms) JOIN {_reserve('q0', 'quote_reserve, received_ms')} USING (mint, opened_ms) JOIN {_reserve('q1', 'quote_reserve DESC, received_ms')} USING (mint, opened_ms)""",
    "window_liquidity": _BASE + """ SELECT mint, opened_ms, count(*) FILTER (kind = 'LIQUIDITY_DEPOSIT') AS deposits, count(*) FILTER (kind = 'LIQUIDITY_WITHDRAW') AS withdrawals,
      CAST(sum(CASE WHEN kind = 'LIQUIDITY_DEPOSIT' THEN base ELSE 0 END) AS BIGINT) AS deposit_base, CAST(sum(CASE WHEN kind = 'LIQUIDITY_DEPOSIT' THEN quote ELSE 0 END) AS BIGINT) AS deposit_quote,
      CAST(sum(CASE WHEN kind = 'LIQUIDITY_WITHDRAW' THEN base ELSE 0 END) AS BIGINT) AS withdraw_base, CAST(sum(CASE WHEN kind = 'LIQUIDITY_WITHDRAW' THEN quote ELSE 0 END) AS BIGINT) AS withdraw_quote
      FROM member WHERE kind LIKE 'LIQUIDITY%' GROUP BY mint, opened_ms""",
    "window_lifecycle_flags": _BASE + f" SELECT mint, opened_ms, coalesce(c.n, 0) AS completions, coalesce(g.n, 0) AS migrations, coalesce(c.keys, '') AS completion_keys, coalesce(g.keys, '') AS migration_keys FROM win LEFT JOIN {_order('COMPLETE')} c USING (mint, opened_ms) LEFT JOIN {_order('MIGRATION')} g USING (mint, opened_ms)",
    "rule_results": _DECIDED + " SELECT * FROM rr",
    "qualification_decisions": _DECIDED + " SELECT * FROM dec",
    "reject_reasons": _reasons("REJECT"),
    "unknown_reasons": _reasons("UNKNOWN"),
    "discovery_summary": _DECIDED + """ SELECT mint, opened_ms, m.closes_ms, m.source, m.asset, observations, trades, buys, sells, traders, quote_volume, top_wallet, top_share_bps, m.reason, claimed_ms, is_current, decision, reasons
      FROM current c JOIN m USING (mint, opened_ms) JOIN win USING (mint, opened_ms) JOIN dec USING (mint, opened_ms)""",
    "lifetime_activity": _BASE + """ SELECT network, source, mint, asset, count(*) AS trades, count(*) FILTER (side = 'BUY') AS buys, count(*) FILTER (side = 'SELL') AS sells, count(DISTINCT wallet) AS traders, CAST(sum(base) AS BIGINT) AS base_volume, CAST(sum(quote) AS BIGINT) AS quote_volume
      FROM obs WHERE kind = 'TRADE' AND trim(coalesce(wallet, '')) <> '' AND base > 0 AND quote > 0 GROUP BY ALL""",
    "token_state": _STAGED + " SELECT * FROM token",
    "projection_counters": _STAGED + """ SELECT 'tokens' AS counter, count(*) AS value FROM token UNION ALL SELECT 'qualified', count(*) FROM token WHERE stage = 'QUALIFIED' UNION ALL SELECT 'approved', count(*) FROM token WHERE stage = 'APPROVED'
      UNION ALL SELECT 'rejected', count(*) FROM dec WHERE decision = 'REJECT' UNION ALL SELECT 'unknown', count(*) FROM dec WHERE decision = 'UNKNOWN' UNION ALL SELECT 'observations', count(*) FROM obs UNION ALL SELECT 'gaps', count(*) FROM note WHERE kind = 'GAP'""",
    "snapshot_observe_all": _snapshot("'OBSERVED', 'QUALIFIED', 'APPROVED'"),
    "snapshot_qualified_only": _snapshot("'QUALIFIED', 'APPROVED'"),
    "snapshot_approved_only": _snapshot("'APPROVED'"),
    "live_markets": _BASE + " SELECT source, mint, min(received_ms) AS registered_ms FROM obs WHERE kind = 'CREATE' AND mint NOT IN (SELECT mint FROM obs WHERE kind IN ('COMPLETE', 'MIGRATION')) GROUP BY ALL",
    "retention_candidates": _BASE + f""" SELECT event_id, mint, received_ms FROM obs WHERE received_ms < {CUTOFF_MS} AND event_id IN (SELECT event_id FROM member JOIN gate USING (mint, opened_ms) WHERE finalizable)
      AND event_id NOT IN (SELECT event_id FROM member JOIN gate USING (mint, opened_ms) WHERE NOT finalizable) AND signature NOT IN (SELECT opener FROM win)""",
    "settings_asof": _BASE + f" SELECT mint, opened_ms, r.revision FROM win w ASOF LEFT JOIN (VALUES {', '.join(str(r[:2]) for r in REVISIONS)}) r(revision, effective_ms) ON w.opened_ms >= r.effective_ms",
    "checkpoint_latest": _BASE + """, pos AS (SELECT source, event_id // 3 AS slot, CASE WHEN event_id % 5 <> 0 THEN event_id % 3 END AS tx, received_ms FROM note),
      top AS (SELECT * FROM pos QUALIFY slot = max(slot) OVER (PARTITION BY source)), f AS (SELECT * FROM top QUALIFY row_number() OVER (PARTITION BY source ORDER BY received_ms) = 1)
      SELECT f.source, f.slot AS last_slot, CASE WHEN f.tx IS NOT NULL THEN (SELECT max(tx) FROM top t WHERE t.source = f.source) END AS last_transaction_index FROM f""",
    "gap_resolution": _BASE + """, c AS (SELECT source, received_ms, slot FROM obs WHERE kind = 'CREATE')
      SELECT gap_id, g.source, gap_ms, c.received_ms AS resolved_ms, CASE WHEN c.source IS NULL THEN 'ACTIVE' WHEN c.slot < gap_id THEN 'REJECTED' ELSE 'RESOLVED' END AS status FROM gap g ASOF LEFT JOIN c ON g.source = c.source AND g.gap_ms <= c.received_ms""",
    "flow_per_minute": _BASE + f" SELECT event_id, source, received_ms, count(*) OVER (PARTITION BY source ORDER BY received_ms RANGE BETWEEN {FLOW_MS - 1} PRECEDING AND CURRENT ROW) AS flow FROM obs",
    "network_check": _BASE + " SELECT count(DISTINCT network) AS networks, count(DISTINCT network) <= 1 AS consistent FROM (SELECT network FROM obs UNION ALL SELECT network FROM member UNION ALL SELECT network FROM note)",
    "quarantine_summary": _BASE + """ SELECT CASE WHEN trim(coalesce(wallet, '')) = '' THEN 'INVALID_TRADE_WALLET' ELSE 'INVALID_TRADE_AMOUNT' END AS reason_code, count(DISTINCT signature) AS records, count(*) AS occurrences, max(received_ms) AS last_seen_ms
      FROM obs WHERE kind = 'TRADE' AND (trim(coalesce(wallet, '')) = '' OR base <= 0 OR quote <= 0) GROUP BY ALL""",
    "signature_claims": _BASE + f""", keyed AS (SELECT mint || '/' || kind AS claim, received_ms AS ms FROM obs),
      claims(claim, ms) AS (SELECT claim, min(ms) FROM keyed GROUP BY claim UNION ALL SELECT k.claim, min(k.ms) FROM claims c JOIN keyed k ON k.claim = c.claim AND k.ms >= c.ms + {CLAIM_TTL_MS} GROUP BY k.claim)
      SELECT claim, ms AS claimed_ms, ms + {CLAIM_TTL_MS} AS expires_ms FROM claims""",
    "pool_orientation": """WITH p AS (SELECT p_partkey AS pool, p_partkey % 4 AS kind, CASE WHEN p_partkey % 3 = 0 THEN 'BUY' ELSE 'SELL' END AS side, CAST(round(p_retailprice * 100) AS BIGINT) AS quote FROM part)
      SELECT pool, CASE kind WHEN 0 THEN 'BASE_IS_TOKEN' WHEN 1 THEN 'QUOTE_IS_TOKEN' END AS orientation, CASE kind WHEN 2 THEN 'BOTH_SIDES_QUOTE' WHEN 3 THEN 'NO_SUPPORTED_QUOTE' END AS quarantine_reason,
        CASE WHEN kind < 2 THEN 'T' || pool END AS token, CASE kind WHEN 0 THEN 'STABLE' WHEN 1 THEN 'NATIVE' END AS asset, CASE WHEN kind = 0 THEN side WHEN kind = 1 AND side = 'BUY' THEN 'SELL' WHEN kind = 1 THEN 'BUY' END AS side,
        CASE kind WHEN 0 THEN pool WHEN 1 THEN quote END AS base, CASE kind WHEN 0 THEN quote WHEN 1 THEN pool END AS quote FROM p""",
    "risk_fold": _BASE + """, e AS (SELECT mint, CASE k % 4 WHEN 0 THEN 'PASS' WHEN 3 THEN 'REJECT' ELSE 'UNKNOWN' END AS d FROM obs WHERE kind LIKE 'LIQUIDITY%')
      SELECT o.mint, CASE WHEN bool_or(d = 'REJECT') THEN 'REJECT' WHEN bool_or(d = 'UNKNOWN') OR count(d) = 0 THEN 'UNKNOWN' ELSE 'PASS' END AS decision, count(d) AS evidence FROM (SELECT DISTINCT mint FROM obs) o LEFT JOIN e USING (mint) GROUP BY o.mint""",
    "strategy_match": _CLAIMED + " SELECT mint, opened_ms FROM m WHERE trades >= 5 AND top_share_bps <= 6000 AND asset IN ('NATIVE', 'STABLE') AND sells <> 0",
    "ship_window_metrics": f"""WITH RECURSIVE t AS (SELECT CAST(l_suppkey AS VARCHAR) AS mint, epoch_us(CAST(l_shipdate AS TIMESTAMP)) // 1000 AS ms, l_linenumber AS ln, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, CAST(o_custkey AS VARCHAR) AS wallet,
        CAST(l_quantity AS BIGINT) AS base, CAST(round(l_extendedprice * 100) AS BIGINT) AS quote FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
      op AS (SELECT DISTINCT mint, ms FROM t WHERE ln = 1),
      win(mint, opened_ms) AS (SELECT mint, min(ms) FROM op GROUP BY mint UNION ALL SELECT o.mint, min(o.ms) FROM win w JOIN op o ON o.mint = w.mint AND o.ms >= w.opened_ms + {SHIP_LENGTH_MS} GROUP BY o.mint),
      mem AS (SELECT w.opened_ms, t.* FROM win w JOIN t ON t.mint = w.mint AND t.ms >= w.opened_ms AND t.ms < w.opened_ms + {SHIP_LENGTH_MS}),
      wal AS (SELECT mint, opened_ms, wallet, count(*) AS n, count(*) FILTER (side = 'BUY') AS buys, count(*) FILTER (side = 'SELL') AS sells, sum(quote) AS q FROM mem WHERE base > 0 AND quote > 0 GROUP BY ALL),
      top AS (SELECT mint, opened_ms, wallet, CAST(q AS BIGINT) AS q FROM wal QUALIFY row_number() OVER (PARTITION BY mint, opened_ms ORDER BY q DESC, wallet) = 1),
      people AS (SELECT mint, opened_ms, count(*) AS traders, count(*) FILTER (buys > 0) AS buyers, count(*) FILTER (sells > 0) AS sellers, CAST(sum(q) AS HUGEINT) AS total FROM wal GROUP BY ALL),
      agg AS (SELECT mint, opened_ms, count(*) AS trades, count(*) FILTER (side = 'BUY') AS buys, count(*) FILTER (side = 'SELL') AS sells, CAST(sum(CASE WHEN side = 'BUY' THEN base ELSE 0 END) AS BIGINT) AS buy_base, CAST(sum(CASE WHEN side = 'BUY' THEN quote ELSE 0 END) AS BIGINT) AS buy_quote,
        CAST(sum(CASE WHEN side = 'SELL' THEN base ELSE 0 END) AS BIGINT) AS sell_base, CAST(sum(CASE WHEN side = 'SELL' THEN quote ELSE 0 END) AS BIGINT) AS sell_quote FROM mem WHERE base > 0 AND quote > 0 GROUP BY ALL)
      SELECT mint, opened_ms, (SELECT count(*) FROM mem x WHERE x.mint = agg.mint AND x.opened_ms = agg.opened_ms) AS observations, trades, buys, sells, traders, buyers, sellers, buy_base, buy_quote, sell_base, sell_quote, top.wallet AS top_wallet, top.q AS top_quote,
        CAST((CAST(top.q AS HUGEINT) * 10000 + total - 1) // total AS INT) AS top_share_bps FROM agg JOIN people USING (mint, opened_ms) JOIN top USING (mint, opened_ms)""",
}
