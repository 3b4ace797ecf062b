"""The nine risk indicators, each with what it looks at and its threshold.

The parts are SQL expressions over the transaction and behaviour columns and the
statistics columns of ``STATS``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column

from txrisk.spec import RiskSpec

STATS = {"p95_amount": "_p95", "avg_amount": "_mean", "stddev_amount": "_stddev"}


@dataclass(frozen=True)
class Indicator:
    name: str
    weight: int
    fires: str
    observed: str
    threshold: str

    @property
    def column(self) -> str:
        return f"indicator_{self.name}"

    @property
    def flag(self) -> str:
        """0/1; a comparison with NULL does not fire."""
        return f"CASE WHEN {self.fires} THEN 1 ELSE 0 END AS {self.column}"


def stats_columns(stats: Column) -> list[Column]:
    """The fields of the statistics struct under the names the indicators use."""
    return [stats[field].alias(name) for field, name in STATS.items()]


def indicators(spec: RiskSpec) -> list[Indicator]:
    extreme = f"_mean + {spec.amount_sigmas} * _stddev"

    def make(name: str, fires: str, observed: str, threshold: str) -> Indicator:
        return Indicator(name, spec.weights[name], fires, observed, threshold)

    def at_least(name: str, column: str, minimum: int) -> Indicator:
        return make(name, f"{column} >= {minimum}", column, str(minimum))

    def differs(name: str, column: str, usual: str) -> Indicator:
        return make(name, f"{column} != {usual}", column, usual)

    return [
        make("high_amount", "amount > _p95", _money("amount"), _money("_p95")),
        make("extreme_amount", f"amount > {extreme}", _money("amount"), _money(extreme)),
        at_least("high_frequency_1hr", "txn_count_1hr", spec.min_count_1hr),
        at_least("high_frequency_24hr", "txn_count_24hr", spec.min_count_24hr),
        at_least("multiple_countries", "distinct_countries_user", spec.min_countries),
        differs("unusual_country", "country", "user_primary_country"),
        at_least("multiple_devices", "distinct_devices_user", spec.min_devices),
        differs("unusual_device", "device", "user_primary_device"),
        make(
            "unusual_hour",
            f"hour >= {spec.night_from} AND hour < {spec.night_before}",
            "hour",
            f"'{spec.night_from}-{spec.night_before}'",
        ),
    ]


def risk_score(spec: RiskSpec) -> str:
    points = " + ".join(f"indicator_{name} * {weight}" for name, weight in spec.weights.items())
    return f"least({spec.max_score}, {points}) AS risk_score"


def _money(value: str) -> str:
    """Two decimals, NULL for NaN."""
    return f"try_cast(CASE WHEN NOT isnan({value}) THEN round({value}, 2) END AS decimal(38,2))"
