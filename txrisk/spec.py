"""Parameters of the risk model and of the skew handling."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Bands:
    """Labels for ranges of a score.

    ``cuts`` are tried in order; ``inclusive_upper`` says whether a cut is an
    upper bound (``score <= cut``) or a lower bound (``score >= cut``).
    """

    cuts: tuple[tuple[int, str], ...]
    otherwise: str
    inclusive_upper: bool

    @property
    def labels(self) -> tuple[str, ...]:
        return tuple(label for _, label in self.cuts) + (self.otherwise,)


# The two bandings. They disagree on purpose (a score of 70 is
# Medium in the first and High Risk in the second), so their labels differ.
SCORING_BANDS = Bands(((30, "Low"), (70, "Medium")), "High", inclusive_upper=True)
TRIAGE_BANDS = Bands(((70, "High Risk"), (40, "Medium Risk")), "Low Risk", inclusive_upper=False)

# The nine indicators and their weights, in output order.
INDICATOR_WEIGHTS = {
    "high_amount": 15,
    "extreme_amount": 25,
    "high_frequency_1hr": 20,
    "high_frequency_24hr": 10,
    "multiple_countries": 12,
    "unusual_country": 8,
    "multiple_devices": 10,
    "unusual_device": 5,
    "unusual_hour": 5,
}


@dataclass(frozen=True)
class RiskSpec:
    """Thresholds, weights and bands of the score; the defaults are the model."""

    amount_percentile: str = "0.95"
    amount_lower_percentile: str = "0.90"
    amount_sigmas: float = 3.0
    hour_window: int = 3600
    day_window: int = 86400
    min_count_1hr: int = 3
    min_count_24hr: int = 10
    min_countries: int = 3
    min_devices: int = 3
    night_from: int = 2
    night_before: int = 5
    max_score: int = 100
    high_risk_score: int = 70
    weights: dict[str, int] = field(default_factory=lambda: dict(INDICATOR_WEIGHTS))
    bands: Bands = SCORING_BANDS
    triage: Bands = TRIAGE_BANDS

    @property
    def trailing_windows(self) -> dict[str, int]:
        return {"txn_count_1hr": self.hour_window, "txn_count_24hr": self.day_window}


@dataclass(frozen=True)
class SkewPolicy:
    """When a key counts as hot.

    A key is hot with more than ``max(min_rows, rows / max_keys)`` rows, so there
    can never be more than ``max_keys`` hot keys, whatever the data: that is the
    size bound that lets the hot keys (and one row per hot key) be broadcast.
    """

    min_rows: int = 100_000
    max_keys: int = 500_000

    def __post_init__(self) -> None:
        if not 1 <= self.max_keys <= 1_000_000:
            raise ValueError("max_keys bounds a broadcast: 1 to 1,000,000")
