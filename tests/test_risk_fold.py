"""The risk fold against a fold in Python over all liquidity rows of the events table."""

import json
from collections import defaultdict

from windowmill.plans import catalog


def test_every_liquidity_row_is_folded(spark):
    folder = "/root/testdata/sf0.001"
    seen, mints = defaultdict(list), set()
    for r in spark.read.parquet(f"{folder}/events.parquet").collect():
        k = json.loads(r.props)["k"]
        if r.event_type == "error" and (round(r.value * 100) >= 25_000 or k > 1):
            continue
        mints.add(str(r.user_id))
        if r.event_type == "view":
            seen[str(r.user_id)].append({0: "PASS", 3: "REJECT"}.get(k % 4, "UNKNOWN"))
    fold = lambda found: next((d for d in ("REJECT", "UNKNOWN") if d in found), "PASS" if found else "UNKNOWN")
    found = {r.mint: (r.decision, r.evidence) for r in catalog.queries()["risk_fold"](spark, folder).collect()}
    assert found == {m: (fold(seen[m]), len(seen[m])) for m in mints}
