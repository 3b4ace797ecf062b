"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
data and the cores. Transactions and the scored table are first stored as Parquet,
as in use; every query then runs once to warm up and REPEATS times for the median,
its result forced by the noop sink. ``--plain`` also times the long form of the
score, one leg per statistic, for comparison.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from tests.plain import plain_score  # noqa: E402
from tests.session import make_session  # noqa: E402
from txrisk.fixtures import transactions  # noqa: E402
from txrisk.operators import profile  # noqa: E402
from txrisk.operators.amounts import amount_stats  # noqa: E402
from txrisk.operators.frequency import txn_frequency  # noqa: E402
from txrisk.plans import investigate, report, triage  # noqa: E402
from txrisk.plans.scoring import score  # noqa: E402
from txrisk.sources.staging import stage  # noqa: E402
from txrisk.spec import SkewPolicy  # noqa: E402

REPEATS = 5


def timed(build) -> float:
    def once() -> float:
        start = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    once()
    return round(statistics.median(once() for _ in range(REPEATS)), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = make_session(cpus)
    spark.conf.set("spark.sql.shuffle.partitions", cpus)
    tx = stage(transactions(spark, sf_dir), "tx")
    scored = stage(score(tx), "scored")

    headline = {
        "scored_transactions": lambda: score(tx),
        "scored_trusted_keys": lambda: score(tx, policy=None),
        "txn_frequency": lambda: txn_frequency(tx),
        "amount_stats": lambda: amount_stats(tx),
        "amount_stats_exact": lambda: amount_stats(tx, exact=True),
        "value_distribution": lambda: profile.value_distribution(tx),
        "summary_stats": lambda: profile.summary_stats(tx),
        "summary_stats_exact": lambda: profile.summary_stats(tx, exact=True),
        "fraud_rate_by_level": lambda: triage.fraud_rate_by_level(scored),
        "kpis": lambda: triage.kpis(scored),
        "top100_high_risk": lambda: triage.top_cases(scored),
        "customer_profile": lambda: investigate.customer_profile(scored),
        "country_switch": lambda: investigate.country_switch(tx),
        "indicator_pairs": lambda: investigate.indicator_pairs(scored),
        "customer_report": lambda: report.customer_report(scored),
    }
    if "--plain" in sys.argv:
        window = investigate.previous_row
        headline |= {
            "plain_score": lambda: plain_score(tx),
            "plain_percentile_disc": lambda: tx.agg(
                F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY amount)").alias("p95")
            ),
            "scored_hot_users": lambda: score(tx, policy=SkewPolicy(min_rows=0)),
            "sequence_trusted_keys": lambda: window(tx, ["country"], None),
        }
    seconds = {name: timed(build) for name, build in headline.items()}
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "rows": tx.count(),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
