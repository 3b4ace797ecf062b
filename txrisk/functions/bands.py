"""Score bands and shares as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from txrisk.spec import Bands


def band(score: Column, bands: Bands) -> Column:
    label = None
    for cut, name in bands.cuts:
        hit = score <= cut if bands.inclusive_upper else score >= cut
        label = F.when(hit, name) if label is None else label.when(hit, name)
    return F.lit(bands.otherwise) if label is None else label.otherwise(bands.otherwise)


def level_rank(level: Column) -> Column:
    """Sort key High, Medium, Low; other labels are NULL and come first."""
    return F.when(level == "High", 1).when(level == "Medium", 2).when(level == "Low", 3)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """``100 * part / whole`` of two counts, rounded half up in decimal; NULL on zero."""
    exact = F.lit(100).cast("decimal(4,1)") * part.cast("decimal(20,0)")
    return F.round(F.try_divide(exact, whole.cast("decimal(20,0)")), digits).cast("double")


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """``part / whole`` rounded; NULL on zero."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), digits)


def money_total(amount: str = "amount") -> Column:
    """A sum of money in cents, free of the noise of adding doubles."""
    return F.round(F.sum(amount), 2)


def money_mean(amount: str = "amount") -> Column:
    """The mean of money, from its total in cents, rounded half up in decimal."""
    return money_cents(money_total(amount), F.count(amount))


def money_cents(total: Column, count: Column) -> Column:
    """A total in cents over a count, rounded half up in decimal."""
    exact = F.try_divide(total.try_cast("decimal(28,2)"), count.cast("decimal(20,0)"))
    return F.round(exact, 4).cast("double")
