"""Figures of the transaction view, measured once in two engines."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from txrisk.fixtures import transactions
from txrisk.plans import triage
from txrisk.plans.scoring import score
from txrisk.schema import INDICATOR_COLUMNS, SCORED_COLUMNS
from txrisk.sources.staging import stage

ANCHORS = {
    "0.001": {
        "rows": 1000, "flags": [50, 16, 4, 342, 457, 118, 244, 96, 126], "fraud": 40,
        "points": 14628, "bands": [905, 93, 2], "triage": [2, 26, 972], "max": 72, "scores": 31,
        "amount": 50050.19, "high_amount": 466.78,
    },
    "0.01": {
        "rows": 10000, "flags": [500, 182, 64, 3731, 3411, 1212, 2657, 953, 1252], "fraud": 406,
        "points": 138863, "bands": [9303, 693, 4], "triage": [8, 276, 9716], "max": 77,
        "scores": 40, "amount": 496306.57, "high_amount": 2213.4,
    },
}


@pytest.mark.parametrize("scale", ANCHORS)
def test_anchors(spark, scale):
    want = ANCHORS[scale]
    scored = stage(score(transactions(spark, f"/root/testdata/sf{scale}"), exact=True), "scored")
    assert scored.columns == SCORED_COLUMNS
    got = scored.agg(
        F.count("*").alias("rows"),
        *[F.sum(c).alias(c) for c in INDICATOR_COLUMNS],
        F.sum("is_fraud").alias("fraud"),
        F.sum("risk_score").alias("points"),
        F.max("risk_score").alias("max"),
        F.min("risk_score").alias("min"),
        F.count_distinct("risk_score").alias("scores"),
    ).first()
    assert [got[c] for c in INDICATOR_COLUMNS] == want["flags"]
    assert [got[k] for k in ("rows", "fraud", "points", "max", "scores")] == [
        want[k] for k in ("rows", "fraud", "points", "max", "scores")
    ]
    assert got["min"] >= 0
    levels = triage.level_counts(scored).first()
    assert [levels[k] for k in ("low_risk", "medium_risk", "high_risk")] == want["bands"]
    assert sum(want["bands"]) == levels["total_transactions"]
    bands = {r["risk_level"]: r["transaction_count"] for r in triage.band_counts(scored).collect()}
    assert [bands[k] for k in ("High Risk", "Medium Risk", "Low Risk")] == want["triage"]
    figures = triage.kpis(scored).first()
    assert figures["total_transaction_amount"] == want["amount"]
    assert figures["high_risk_amount"] == want["high_amount"]
