"""Exact quantiles that never sort the whole column in one place.

``percentile_disc`` and ``median`` keep every distinct value in one task. Here
approximate quantiles only choose where to look: each wanted rank gets a narrow
bracket, brackets are cut into equal slices, and the slices are counted in one
pass with map-side aggregation. The counts say which slice holds the rank, and
only that slice is sorted. A poor approximation makes the slice larger, never
the answer wrong.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 4096


def exact_quantiles(
    df: DataFrame,
    value: Column,
    probabilities: list[str],
    series: Column | None = None,
    interpolate: bool = False,
    accuracy: int = 10_000,
) -> DataFrame:
    """``(series, probability, value)``, one row per series and probability.

    ``series`` must take few values (column names, bands): there is one bracket
    list per series. ``interpolate`` gives the continuous quantile (the median),
    otherwise the smallest value that reaches the probability.
    """
    label = F.lit("all") if series is None else series
    rows = df.select(label.alias("series"), value.cast("double").alias("v")).filter("v IS NOT NULL")

    margin = Decimal(2) / accuracy
    wanted = [Decimal(p) for p in probabilities]
    around = sorted({min(Decimal(1), max(Decimal(0), p + d)) for p in wanted for d in (-margin, margin)})
    bracket = F.array_sort(F.percentile_approx("v", [float(p) for p in around], accuracy)).alias("e")
    if series is None:
        bracketed = rows.withColumn("e", rows.agg(bracket).scalar())
    else:
        bracketed = rows.join(rows.groupBy("series").agg(bracket), "series")
    edges = [F.get("e", F.lit(i)) for i in range(len(around))]
    seg = sum(((edge < F.col("v")).cast("int") for edge in edges), F.lit(0))
    low, high = F.get("e", F.col("seg") - 1), F.get("e", F.col("seg"))
    share = (F.col("v") - low) / (high - low)
    placed = (
        bracketed.withColumn("seg", seg)
        .select("series", "v", "seg", F.coalesce(F.floor(share * SLICES), F.lit(0)).alias("slice"))
    )

    before = Window.partitionBy("series").orderBy("seg", "slice")
    whole = Window.partitionBy("series")
    tally = (
        placed.groupBy("series", "seg", "slice")
        .agg(F.count("*").alias("n"))
        .select(
            "series", "seg", "slice", "n",
            F.sum("n").over(before).alias("upto"),
            F.sum("n").over(whole).alias("total"),
        )
    )
    targets = (
        tally.withColumn("t", F.explode(F.array(*_ranks(wanted, probabilities, interpolate))))
        .select("series", "seg", "slice", (F.col("upto") - F.col("n")).alias("below"), "upto", "t.*")
        .filter((F.col("rank") > F.col("below")) & (F.col("rank") <= F.col("upto")))
        .drop("upto")
    )
    # Only rows of a target's slice go on, counted per value. A single series has at
    # most two targets per probability, hence broadcast.
    target = ["series", "probability", "rank", "weight", "below"]
    inside = Window.partitionBy(*target).orderBy("v")
    found = (
        placed.join(F.broadcast(targets) if series is None else targets, ["series", "seg", "slice"])
        .groupBy(*target, "v")
        .agg(F.count("*").alias("n"))
        .select(*target, "v", F.sum("n").over(inside).alias("reached"))
        .filter(F.col("below") + F.col("reached") >= F.col("rank"))
        .groupBy(*target)
        .agg(F.min("v").alias("v"))
    )
    answer = F.max("v") if not interpolate else F.sum(F.col("v") * F.col("weight"))
    return found.groupBy("series", "probability").agg(answer.alias("value"))


def _ranks(wanted: list[Decimal], names: list[str], interpolate: bool) -> list[Column]:
    total = F.col("total").cast("decimal(20,0)")
    one = F.lit(1).cast("bigint")
    entries = []
    for p, name in zip(wanted, names):
        if interpolate:
            position = F.lit(p) * (total - 1)
            lower = F.floor(position)
            upper_weight = (position - lower).cast("double")
            pairs = [(lower + 1, F.lit(1.0) - upper_weight), (F.ceil(position) + 1, upper_weight)]
            if p in (Decimal(0), Decimal(1)):
                pairs = pairs[:1]
        else:
            pairs = [(F.ceil(F.lit(p) * total), F.lit(1.0))]
        for rank, weight in pairs:
            entries.append(
                F.struct(
                    F.lit(name).alias("probability"),
                    F.greatest(one, rank.cast("bigint")).alias("rank"),
                    weight.alias("weight"),
                )
            )
    return entries


def quantile_columns(quantiles: DataFrame, names: dict[str, str], by_series: bool = False) -> DataFrame:
    """The long result of ``exact_quantiles`` as one column per probability."""
    picks = [
        F.max(F.when(F.col("probability") == p, F.col("value"))).alias(name)
        for p, name in names.items()
    ]
    return quantiles.groupBy("series").agg(*picks) if by_series else quantiles.agg(*picks)
