"""Investigators' questions over the scored table.

Every function takes the scored table (or, where no score is needed, the
transactions) and returns a lazy DataFrame.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txrisk.functions.bands import money_mean, money_total, percent, ratio
from txrisk.functions.indicators import indicators, stats_columns
from txrisk.operators.deviation import habits
from txrisk.operators.quantiles import exact_quantiles, quantile_columns
from txrisk.operators.rows import merge_rows
from txrisk.operators.sequence import previous_row
from txrisk.schema import INDICATORS, INDICATOR_COLUMNS
from txrisk.spec import RiskSpec, SkewPolicy

TIMELINE_COLUMNS = [
    "user_id", "timestamp", "transaction_id", "amount", "country", "device", "channel",
    "risk_score", "risk_level",
]


# --- distributions -----------------------------------------------------------


def monthly_count(df: DataFrame) -> DataFrame:
    return _monthly(df).agg(F.count("*").alias("transaction_count")).orderBy("month")


def monthly_amount(df: DataFrame) -> DataFrame:
    return _monthly(df).agg(money_total().alias("total_amount")).orderBy("month")


def _monthly(df: DataFrame):
    return df.groupBy(F.date_trunc("month", "timestamp").alias("month"))


def amount_distribution(df: DataFrame) -> DataFrame:
    """Minimum, maximum, average and exact median, one row."""
    median = quantile_columns(
        exact_quantiles(df, F.col("amount"), ["0.5"], interpolate=True), {"0.5": "median_amount"}
    )
    rest = df.agg(
        F.min("amount").alias("min_amount"),
        F.max("amount").alias("max_amount"),
        F.avg("amount").alias("avg_amount"),
    )
    return merge_rows(rest, median)


def amount_histogram(df: DataFrame, bins: int = 20) -> DataFrame:
    """Equal-width bins from minimum to maximum; empty bins are left out.

    NaN amounts are bin 0 without borders, NULL amounts are left out."""
    number = F.when(~F.isnan("amount"), F.col("amount"))
    span = df.agg(F.struct(F.min(number).alias("lo"), F.max(number).alias("hi"))).scalar()
    width = (span["hi"] - span["lo"]) / bins
    place = F.coalesce(F.width_bucket("amount", span["lo"], span["hi"], F.lit(bins)), F.lit(1))
    return (
        df.filter(F.col("amount").isNotNull())
        .groupBy(F.when(F.isnan("amount"), 0).otherwise(F.least(place, F.lit(bins))).alias("bin"))
        .agg(F.count("*").alias("transaction_count"))
        .withColumn("bin_from", F.when(F.col("bin") > 0, F.round(span["lo"] + width * (F.col("bin") - 1), 4)))
        .withColumn("bin_to", F.when(F.col("bin") > 0, F.round(span["lo"] + width * F.col("bin"), 4)))
        .orderBy("bin")
    )


def counts_by(df: DataFrame, column: str = "country") -> DataFrame:
    """Count and share per value."""
    everything = df.agg(F.count("*")).scalar()
    return (
        df.groupBy(column)
        .agg(F.count("*").alias("transaction_count"))
        .withColumn("percentage", percent(F.col("transaction_count"), everything))
        .orderBy(F.desc("transaction_count"), column)
    )


def results_by_level(scored: DataFrame) -> DataFrame:
    # A window over the few levels, so that the rows are read once.
    everything = F.sum("transaction_count").over(Window.partitionBy())
    return (
        scored.groupBy("risk_level")
        .agg(
            F.count("*").alias("transaction_count"),
            money_total().alias("total_amount"),
        )
        .withColumn("percentage", percent(F.col("transaction_count"), everything))
    )


def table_links(tables: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """How tables hang together: for each pair of tables with the same key column,
    how many of the left table's key values the right table has."""
    results = []
    for key in keys:
        holders = [name for name, df in tables.items() if key in df.columns]
        if len(holders) < 2:
            continue
        values = None
        for name in holders:
            part = tables[name].select(
                F.col(key).cast("string").alias("value"),
                *[F.lit(int(name == other)).alias(other) for other in holders],
            )
            values = part if values is None else values.unionByName(part)
        # One row per key value with a flag per table, whatever the number of pairs.
        flags = (
            values.filter(F.col("value").isNotNull())
            .groupBy("value")
            .agg(*[F.max(name).alias(name) for name in holders])
        )
        pairs = [(a, b) for a in holders for b in holders if a != b]
        both = {(a, b): F.sum(F.col(a) * F.col(b)) for a, b in pairs}
        results.append(
            flags.agg(
                F.array(
                    *[
                        F.struct(
                            F.lit(key).alias("key_column"),
                            F.lit(a).alias("left_table"),
                            F.lit(b).alias("right_table"),
                            F.sum(a).alias("left_values"),
                            both[a, b].alias("shared_values"),
                            ratio(both[a, b], F.sum(a)).alias("containment"),
                        )
                        for a, b in pairs
                    ]
                ).alias("links")
            ).select(F.inline("links"))
        )
    if not results:
        raise ValueError("no key column is shared by two tables")
    union = results[0]
    for more in results[1:]:
        union = union.unionByName(more)
    return union


# --- customers ---------------------------------------------------------------


def customer_profile(scored: DataFrame, indicator_counts: bool = False) -> DataFrame:
    """One row per user of the given rows: activity, amounts, places, devices, scores
    and levels, and on request how often each indicator fired. Rows without a user
    have no profile."""
    level = F.col("risk_level")
    counts = [F.sum(c).alias(c) for c in INDICATOR_COLUMNS] if indicator_counts else []
    return scored.filter(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.count("*").alias("transaction_count"),
        F.count_distinct(F.to_date("timestamp")).alias("days_active"),
        money_total().alias("total_amount"),
        money_mean().alias("avg_amount"),
        F.max("amount").alias("max_amount"),
        F.count_distinct("country").alias("distinct_countries"),
        F.count_distinct("device").alias("distinct_devices"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
        F.max("risk_score").alias("max_score"),
        F.round(F.avg("risk_score"), 4).alias("avg_score"),
        F.count_if(level == "High").alias("high_count"),
        F.count_if(level == "Medium").alias("medium_count"),
        F.count_if(level == "Low").alias("low_count"),
        *counts,
    )


def _gap() -> Column:
    return F.unix_timestamp("timestamp") - F.unix_timestamp("previous.timestamp")


def customer_timeline(
    scored: DataFrame, users: list[int] | None = None, policy: SkewPolicy | None = SkewPolicy()
) -> DataFrame:
    """Transactions with the whole seconds since the user's one before.

    Sorted by user and time when ``users`` are named; for all users the caller
    decides whether a global sort is worth its shuffle.
    """
    rows = scored.select(*TIMELINE_COLUMNS)
    if users is not None:
        rows = rows.filter(F.col("user_id").isin(users))
    timeline = previous_row(rows, [], policy).select(
        *TIMELINE_COLUMNS, _gap().alias("gap_seconds")
    )
    return timeline if users is None else timeline.orderBy("user_id", "timestamp", "transaction_id")


def country_switch(
    df: DataFrame, within: int = 3600, policy: SkewPolicy | None = SkewPolicy()
) -> DataFrame:
    """A user's consecutive transactions in different countries within ``within`` seconds."""
    rows = df.select("user_id", "timestamp", "transaction_id", "country")
    before = F.col("previous.country")
    return (
        previous_row(rows, ["country"], policy)
        .filter((F.col("country") != before) & (_gap() <= within))
        .select(
            "user_id", "transaction_id",
            F.col("previous.transaction_id").alias("previous_transaction_id"),
            before.alias("previous_country"), "country", _gap().alias("gap_seconds"),
        )
    )


def behaviour_change(df: DataFrame, threshold: float = 2.0, days: int = 7) -> DataFrame:
    """User days whose count or amount is at least ``threshold`` times the user's
    mean over the ``days`` active days before."""
    before = Window.partitionBy("user_id").orderBy("day").rowsBetween(-days, -1)
    daily = (
        df.filter(F.col("user_id").isNotNull() & F.col("timestamp").isNotNull())
        .groupBy("user_id", F.to_date("timestamp").alias("day"))
        .agg(
            F.count("*").alias("transaction_count"),
            money_total().alias("total_amount"),
        )
    )
    ratios = daily.select(
        "*",
        ratio(F.col("transaction_count"), F.avg("transaction_count").over(before)).alias("count_ratio"),
        ratio(F.col("total_amount"), F.avg("total_amount").over(before)).alias("amount_ratio"),
    )
    flags = ratios.select(
        "*",
        *[
            F.when(F.col(f"{kind}_ratio") >= threshold, 1).otherwise(0).alias(f"{kind}_changed")
            for kind in ("count", "amount")
        ],
    )
    return flags.filter("count_changed = 1 OR amount_changed = 1")


def users_with_many(df: DataFrame, column: str, minimum: int = 3) -> DataFrame:
    """Users with at least ``minimum`` distinct values, and how many; see ``values_of_users``."""
    return (
        _values(df, column)
        .groupBy("user_id")
        .agg(
            F.count("*").alias("distinct_values"),
            F.sum("value_count").alias("transaction_count"),
        )
        .filter(F.col("distinct_values") >= minimum)
    )


def values_of_users(df: DataFrame, column: str, minimum: int = 3) -> DataFrame:
    """Which values those users have: one row per user and value, so that a user
    with any number of values (device fingerprints) is never one row."""
    users = users_with_many(df, column, minimum)
    return _values(df, column).join(users, "user_id").select(
        "user_id", "value", "value_count", "distinct_values", "transaction_count"
    )


def _values(df: DataFrame, column: str) -> DataFrame:
    return (
        df.filter(F.col("user_id").isNotNull() & F.col(column).isNotNull())
        .groupBy("user_id", F.col(column).alias("value"))
        .agg(F.count("*").alias("value_count"))
    )


def top_risk_per_user(scored: DataFrame, n: int = 3) -> DataFrame:
    """Each user's ``n`` worst transactions; every task keeps only ``n`` per user."""
    worst = Window.partitionBy("user_id").orderBy(
        F.desc("risk_score"), F.desc("amount"), "transaction_id"
    )
    return (
        scored.filter(F.col("user_id").isNotNull())
        .select("user_id", "transaction_id", "amount", "risk_score", "risk_level")
        .withColumn("rank", F.row_number().over(worst))
        .filter(F.col("rank") <= n)
    )


# --- single transactions -----------------------------------------------------


def fired(spec: RiskSpec) -> str:
    """Array of the indicators that fired, with weight, observed value and threshold."""
    factors = [
        f"""CASE WHEN {i.column} = 1 THEN named_struct(
            'indicator', '{i.name}', 'weight', {i.weight},
            'observed', CAST({i.observed} AS STRING), 'threshold', CAST({i.threshold} AS STRING)
        ) END"""
        for i in indicators(spec)
    ]
    return f"array_compact(array({', '.join(factors)}))"


def explain(scored: DataFrame, stats: Column, spec: RiskSpec = RiskSpec()) -> DataFrame:
    """Score, level and what contributed to it, per transaction.

    ``stats`` is the struct of ``stats_struct`` for the table the score came from.
    """
    return scored.select("*", *stats_columns(stats)).selectExpr(
        "transaction_id", "risk_score", "risk_level", f"{fired(spec)} AS factors"
    )


def unusual_characteristics(
    df: DataFrame, policy: SkewPolicy | None = SkewPolicy()
) -> DataFrame:
    """Amount against the user's habits, and whether country and device are new."""
    rows = df.select("transaction_id", "user_id", "timestamp", "amount", "country", "device")
    flags = {"country": "new_country", "device": "new_device"}
    return habits(rows, flags, policy).select(
        "transaction_id", "user_id", "amount", "amount_z", *flags.values()
    )


def amount_anomalies(
    df: DataFrame,
    stats: Column,
    spec: RiskSpec = RiskSpec(),
    max_z: float = 3.0,
    policy: SkewPolicy | None = SkewPolicy(),
) -> DataFrame:
    """Rows with an amount that is high for the table or for the user."""
    tests = {
        "above_p95": "amount > _p95",
        "above_extreme": f"amount > _mean + {spec.amount_sigmas} * _stddev",
        "above_user_z": f"amount_z > {max_z}",
    }
    rows = df.select("transaction_id", "user_id", "amount")
    return (
        habits(rows, policy=policy)
        .select("*", *stats_columns(stats))
        .selectExpr(
            *rows.columns,
            "amount_z",
            *[f"CASE WHEN {test} THEN 1 ELSE 0 END AS {name}" for name, test in tests.items()],
        )
        .filter(" OR ".join(f"{name} = 1" for name in tests))
    )


# --- patterns ----------------------------------------------------------------


def _combinations(scored: DataFrame) -> DataFrame:
    """Rows per combination of the nine flags: at most 512 rows."""
    return scored.groupBy(*INDICATOR_COLUMNS).agg(
        F.count("*").alias("n"), F.sum("is_fraud").alias("fraud")
    )


def indicator_prevalence(scored: DataFrame) -> DataFrame:
    """Per indicator: rows, share, fraud rate, and lift over the overall fraud rate."""
    n, fraud = F.sum("n"), F.sum("fraud")
    rows = []
    for name, column in zip(INDICATORS, INDICATOR_COLUMNS):
        hits, caught = F.sum(F.col(column) * F.col("n")), F.sum(F.col(column) * F.col("fraud"))
        rows.append(
            F.struct(
                F.lit(name).alias("indicator"),
                hits.alias("transaction_count"),
                percent(hits, n).alias("percentage"),
                percent(caught, hits).alias("fraud_rate_percent"),
                _lift(caught, hits, fraud, n).alias("lift"),
            )
        )
    return _combinations(scored).agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def _lift(fraud: Column, n: Column, all_fraud: Column, all_n: Column) -> Column:
    rate = F.try_divide(fraud.cast("double"), n.cast("double"))
    overall = F.try_divide(all_fraud.cast("double"), all_n.cast("double"))
    return F.round(F.try_divide(rate, overall), 4)


def indicator_combinations(scored: DataFrame) -> DataFrame:
    """Each set of indicators that fired together, as one signature."""
    names = [F.when(F.col(c) == 1, n) for n, c in zip(INDICATORS, INDICATOR_COLUMNS)]
    signature = F.concat_ws("+", *names)
    return (
        _combinations(scored)
        .select(
            F.when(signature == "", "none").otherwise(signature).alias("signature"),
            F.col("n").alias("transaction_count"),
            F.col("fraud").alias("fraud_count"),
            percent(F.col("fraud"), F.col("n")).alias("fraud_rate_percent"),
        )
        .orderBy(F.desc("transaction_count"), "signature")
    )


def indicator_pairs(scored: DataFrame) -> DataFrame:
    """How often two indicators fired together, cut from the combination counts."""
    pairs = [
        F.when(
            (F.col(f"indicator_{a}") == 1) & (F.col(f"indicator_{b}") == 1),
            F.struct(F.lit(a).alias("first"), F.lit(b).alias("second")),
        )
        for a, b in combinations(INDICATORS, 2)
    ]
    return (
        _combinations(scored)
        .select("n", "fraud", F.explode(F.array_compact(F.array(*pairs))).alias("pair"))
        .groupBy(F.col("pair.first").alias("first"), F.col("pair.second").alias("second"))
        .agg(
            F.sum("n").alias("transaction_count"),
            F.sum("fraud").alias("fraud_count"),
            percent(F.sum("fraud"), F.sum("n")).alias("fraud_rate_percent"),
        )
        .orderBy(F.desc("transaction_count"), "first", "second")
    )


def anomalies_by(scored: DataFrame, columns: list[str], high_risk_score: int = 70) -> DataFrame:
    """Per value of each column: share, fraud rate, high-risk rate, and lift.

    The overall figures are sums over the groups, so the rows are read once.
    """
    everything = Window.partitionBy("dimension")
    n, fraud, high = F.col("transaction_count"), F.col("fraud"), F.col("high")
    grouped = (
        scored.select(
            *[F.col(c).cast("string").alias(c) for c in columns], "is_fraud", "risk_score"
        )
        .unpivot(["is_fraud", "risk_score"], columns, "dimension", "value")
        .groupBy("dimension", "value")
        .agg(
            F.count("*").alias("transaction_count"),
            F.sum("is_fraud").alias("fraud"),
            F.count_if(F.col("risk_score") >= high_risk_score).alias("high"),
        )
    )
    return grouped.select(
        "dimension", "value", "transaction_count",
        percent(n, F.sum(n).over(everything)).alias("percentage"),
        percent(fraud, n).alias("fraud_rate_percent"),
        percent(high, n).alias("high_risk_percent"),
        _lift(fraud, n, F.sum(fraud).over(everything), F.sum(n).over(everything)).alias("lift"),
    )


def geo_anomalies(scored: DataFrame) -> DataFrame:
    return anomalies_by(scored, ["country"])


def device_anomalies(scored: DataFrame) -> DataFrame:
    return anomalies_by(scored, ["device"])


def time_anomalies(scored: DataFrame) -> DataFrame:
    return anomalies_by(scored, ["hour", "dayofweek"])


def risk_comparison(scored: DataFrame) -> DataFrame:
    """Levels side by side: users, amounts, and the share of each indicator."""
    n = F.count("*")
    groups = scored.groupBy("risk_level").agg(
        n.alias("transaction_count"),
        F.count_distinct("user_id").alias("distinct_users"),
        money_mean().alias("avg_amount"),
        *[
            percent(F.sum(column), n).alias(f"{name}_percent")
            for name, column in zip(INDICATORS, INDICATOR_COLUMNS)
        ],
    )
    medians = quantile_columns(
        exact_quantiles(
            scored, F.col("amount"), ["0.5"], series=F.col("risk_level"), interpolate=True
        ),
        {"0.5": "median_amount"},
        by_series=True,
    ).withColumn("median_amount", F.round("median_amount", 4))
    # One row per level on both sides.
    return groups.join(
        F.broadcast(medians), F.col("risk_level") == F.col("series"), "left"
    ).drop("series")


def coordinated_activity(
    scored: DataFrame, min_users: int = 3, min_risky: int = 0, length: str = "1 hour"
) -> DataFrame:
    """Clock hours with several users on one country, device and channel.

    Rows are first counted per user, so a busy hour is no single task's load.
    """
    place = ["slot", "country", "device", "channel"]
    risky = F.count_if(F.col("risk_level").isin("High", "Medium"))
    return (
        scored.filter(F.col("timestamp").isNotNull() & F.col("user_id").isNotNull())
        .groupBy(F.window("timestamp", length).alias("slot"), *place[1:], "user_id")
        .agg(F.count("*").alias("n"), risky.alias("risky"), F.sum("amount").alias("amount"))
        .groupBy(*place)
        .agg(
            F.count("*").alias("distinct_users"),
            F.sum("n").alias("transaction_count"),
            F.sum("risky").alias("risky_count"),
            money_total().alias("total_amount"),
        )
        .filter((F.col("distinct_users") >= min_users) & (F.col("risky_count") >= min_risky))
        .select(F.col("slot.start").alias("window_start"), *place[1:], "distinct_users",
                "transaction_count", "risky_count", "total_amount")
    )
