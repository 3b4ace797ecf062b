"""Links between tables, robust deviation, thresholds of the score."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tests.frames import frame, row, same_rows
from txrisk.operators.robust import robust_anomalies, robust_deviation
from txrisk.plans import links, triage
from txrisk.spec import SkewPolicy

HOT = SkewPolicy(min_rows=0)


def plain_links(tables, bound, least):
    values = {(t, c): {v for v in col if v is not None} for t, cols in tables.items() for c, col in cols.items()}
    out = {}
    for (t, c), own in values.items():
        for (u, d), other in values.items():
            if t == u or len(own) < least or len(other) < least or type(next(iter(own))) is not type(next(iter(other))):
                continue
            if len(own & other) >= bound * len(own):
                out[t, c, u, d] = len(own), len(own & other)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_links_are_those_of_brute_force(spark, seed):
    """Keys under other names, dirty ones about the bound, and a small column within a far larger one."""
    r = random.Random(seed)
    ids = r.sample(range(10**9), 4000)
    few = r.sample(ids, 40)
    tables = {
        "people": {"id": ids, "name": [f"n{k % 900}" for k in range(4000)], "flag": [k % 2 for k in range(4000)]},
        "pays": {
            "payer": [r.choice(ids) if r.random() < 0.93 else -(k % 50) for k in range(3000)],
            "dirty": [r.choice(ids) if r.random() < 0.8 else -k for k in range(3000)],
            "who": [None if k % 9 == 0 else f"n{r.randrange(950)}" for k in range(3000)],
        },
        "vips": {"vip": few * 3, "alias": [f"n{k}" for k in range(120)]},
    }
    frames = {
        t: spark.createDataFrame(list(zip(*cols.values(), strict=True)), list(cols)).withColumn("amount", F.rand())
        for t, cols in tables.items()
    }
    found = {tuple(x)[:4]: (x["left_values"], x["shared_values"]) for x in links.discovered_links(frames).collect()}
    assert found == plain_links(tables, 0.9, 20)
    assert ("pays", "payer", "people", "id") in found and ("vips", "vip", "people", "id") in found


def test_links_in_a_database(spark):
    spark.sql("CREATE DATABASE linked")
    try:
        spark.range(100).toDF("key").write.saveAsTable("linked.a")
        spark.range(50).toDF("other").write.saveAsTable("linked.b")
        found = links.links_in_database(spark, "linked").collect()
        assert [tuple(r)[:4] for r in found] == [("b", "other", "a", "key")]
    finally:
        spark.sql("DROP DATABASE linked CASCADE")
    with pytest.raises(ValueError, match="key"):
        links.discovered_links({"t": spark.createDataFrame([(1.5,)], "x double")})
    assert links.discovered_links({"a": spark.range(0), "b": spark.range(30)}).count() == 0


def test_robust_deviation_is_median_and_mad(spark):
    r = random.Random(4)
    amounts = [(k, k % 7 or None, None if k % 19 == 0 else float(r.choice([5, 5, 6, 7.5, r.randrange(400)]))) for k in range(400)]
    amounts += [(900, 50, 3.0), (901, 51, 2.0), (902, 51, 2.0), (903, 52, None)]
    tx = frame(spark, *[row(k, user=u, amount=a) for k, u, a in amounts])
    of_user: dict = {}
    for _, u, a in amounts:
        if u is not None and a is not None:
            of_user.setdefault(u, []).append(a)
    found = {x["transaction_id"]: x for x in robust_deviation(tx).collect()}
    assert set(found) == {k for k, u, _ in amounts if u is not None}
    for k, u, a in amounts:
        if u is None:
            continue
        own = of_user.get(u, [])
        med = statistics.median(own) if own else None
        mad = statistics.median(abs(x - med) for x in own) if own else None
        assert found[k]["median_amount"] == pytest.approx(med) and found[k]["mad_amount"] == pytest.approx(mad)
        z = None if a is None or not mad else (a - med) / (1.4826 * mad)
        assert found[k]["robust_z"] == (None if z is None else pytest.approx(z, abs=1e-4))
    assert same_rows(robust_deviation(tx, HOT), robust_deviation(tx, None))
    assert same_rows(robust_anomalies(tx, policy=HOT), robust_anomalies(tx, policy=None))
    assert robust_anomalies(tx.limit(0)).count() == 0


def test_thresholds_and_auc(spark):
    r = random.Random(5)
    rows = [(r.randrange(0, 101, 5), r.choice([0, 0, 1])) for _ in range(300)] + [(50, None)]
    scored = spark.createDataFrame(rows, "risk_score int, is_fraud int")
    known = [x for x in rows if x[1] is not None]
    p, n = sum(f for _, f in known), sum(1 - f for _, f in known)
    for x in triage.threshold_table(scored).collect():
        hit = [f for s, f in known if s >= x["risk_score"]]
        assert (x["flagged"], x["flagged_fraud"]) == (len(hit), sum(hit))
        want = sum(hit) / len(hit), sum(hit) / p, (len(hit) - sum(hit)) / n
        assert (x["precision"], x["recall"], x["false_positive_rate"]) == pytest.approx(want, abs=1e-4)
    wins = sum((a > b) + (a == b) / 2 for a, f in known for b, g in known if f == 1 and g == 0)
    assert triage.score_auc(scored).first()["auc"] == pytest.approx(wins / (p * n), abs=1e-6)
    none = scored.filter("is_fraud = 0")
    assert triage.score_auc(none).first()["auc"] is None and triage.threshold_table(scored.limit(0)).count() == 0
