"""Monthly states, rules among indicators, groups of users that meet."""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tests.frames import START, frame, row, same_rows
from txrisk.plans import investigate, patterns, states
from txrisk.plans.scoring import score
from txrisk.schema import INDICATOR_COLUMNS, INDICATORS


def profile(rows):
    numbers = states.number_values(rows)
    return states.profiles(states.monthly_states(rows, numbers), numbers)


@pytest.fixture(scope="module")
def history(spark):
    """Users over four months, with many countries, NULLs and users without rows in some months."""
    rows = [
        row(k, user=k % 5 or None, when=None if k % 13 == 0 else 40_000.0 * k, amount=None if k % 11 == 0 else k / 7,
            country=None if k % 17 == 0 else f"C{k * 31 % 150:03}", device=f"d{k % 3}")
        for k in range(260)
    ]
    return score(frame(spark, *rows))


def test_profiles_from_states_are_the_profiles(history):
    assert same_rows(profile(history), investigate.customer_profile(history))
    plan = profile(history)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    assert profile(history.limit(0)).count() == 0


def test_states_of_later_rows_are_merged(history):
    """Rows that arrive later, with new countries and in months that have a state already."""
    parts = [history.filter(f"transaction_id % 3 = {k}") for k in range(3)]
    numbers = states.number_values(parts[0])
    kept = states.monthly_states(parts[0], numbers)
    for part in parts[1:]:
        before, numbers = numbers, states.number_values(part, numbers)
        assert all(numbers[c][v] == n for c in before for v, n in before[c].items())
        kept = states.merge_states(kept, states.monthly_states(part, numbers), numbers)
    assert same_rows(states.profiles(kept, numbers), investigate.customer_profile(history))


def test_too_many_values_are_refused(history):
    with pytest.raises(ValueError, match="country"):
        states.number_values(history, most=20)


def test_indicator_counts_of_states(history):
    numbers = states.number_values(history)
    found = states.monthly_states(history, numbers, INDICATOR_COLUMNS).agg(*[F.sum(c).alias(c) for c in INDICATOR_COLUMNS])
    assert found.first() == history.filter("user_id IS NOT NULL").agg(*[F.sum(c).alias(c) for c in INDICATOR_COLUMNS]).first()


def test_rules_are_those_of_counting(spark):
    flags = [tuple(int(k * p % 7 < 3) for p in range(2, 11)) + (k % 3 % 2,) for k in range(80)] + [(1,) * 9 + (1,), (0,) * 10]
    df = spark.createDataFrame(flags, [*INDICATOR_COLUMNS, "is_fraud"])
    names = [*INDICATORS, "fraud"]
    rows = [{n for n, v in zip(names, f, strict=True) if v} for f in flags]
    want = {}
    for size in range(1, 10):
        for own in combinations(INDICATORS, size):
            have = [r for r in rows if set(own) <= r]
            for then in names:
                support = sum(then in r for r in have)
                if then not in own and support:
                    of_all = sum(then in r for r in rows) / len(rows)
                    want["+".join(own), then] = support, len(have), support / len(have), support / len(have) / of_all
    found = {(r[0], r[1]): r[2:] for r in patterns.indicator_rules(df).collect()}
    assert set(found) == set(want)
    for key, (support, base, confidence, lift) in want.items():
        assert found[key][:2] == (support, base)
        assert found[key][2:] == pytest.approx((confidence, lift), abs=1e-4)
    assert {r["support"] >= 30 for r in patterns.indicator_rules(df, 30).collect()} == {True}
    assert patterns.indicator_rules(df.limit(0)).count() == 0


def plain_groups(rows, least, most):
    at: dict = {}
    for user, hour, country in rows:
        at.setdefault((hour, country), set()).add(user)
    counts: Counter = Counter()
    for users in at.values():
        for size in range(2, most + 1):
            counts.update(combinations(sorted(users), size))
    return {users: n for users, n in counts.items() if n >= least}


@pytest.mark.parametrize("least,most", [(3, 4), (2, 3), (1, 2)])
def test_groups_that_meet_again(spark, least, most):
    """A planted group of five, chance meetings, and one slot where everyone is."""
    rows = [(u, h, "P") for h in (3, 50, 90, 120) for u in (11, 12, 13, 14, 15)]
    rows += [(u, 7, "everyone") for u in range(60)]
    rows += [(k * 17 % 60, k * 5 % 30, "AB"[k % 2]) for k in range(200)]
    tx = frame(spark, *[row(k, user=u, when=3600.0 * h + k % 60, country=c) for k, (u, h, c) in enumerate(rows)],
               row(900, user=None), row(901, user=11, when=None))
    found = patterns.recurring_groups(tx, least, most).collect()
    assert {tuple(r["users"]): r["meetings"] for r in found} == plain_groups(rows, least, most)
    planted = [r for r in found if set(r["users"]) <= {11, 12, 13, 14, 15} and r["n_users"] == most]
    assert planted or least < 3
    assert all(r["first_meeting"] <= r["last_meeting"] and len(r["users"]) == r["n_users"] for r in found)


def test_a_slot_where_everyone_is_makes_no_pairs(spark, monkeypatch):
    rows = [row(k, user=k, when=5.0, country="everyone") for k in range(400)]
    rows += [row(1000 + k, user=k, when=3600.0 * (k + 2)) for k in range(400)]
    made = []
    whole = patterns.stage
    monkeypatch.setattr(patterns, "stage", lambda df, name: made.append(whole(df, name)) or made[-1])
    assert patterns.recurring_groups(frame(spark, *rows), 2).count() == 0
    assert made[0].count() == 0  # nobody has two slots with others in them
    assert patterns.recurring_groups(frame(spark, *rows).limit(0)).count() == 0
    with pytest.raises(ValueError):
        patterns.recurring_groups(frame(spark, *rows), 0)


def test_drift_is_the_sum_of_what_days_are_above(spark):
    """User 1 rises slowly at the end, user 2 falls, user 3 is always the same, user 4 has one day."""
    amounts = {1: [10, 12, 11, 9, 10, 13, 10, 11, 16, 17, 18, 17, 18], 2: [30, 31, 29, 30, 30, 20, 19, 18, 20], 3: [5] * 6, 4: [7]}
    rows = [row(100 * u + k, user=u, when=86_400.0 * k, amount=float(a)) for u, own in amounts.items() for k, a in enumerate(own)]
    rows += [row(900, user=None), row(901, user=1, when=None), row(902, user=1, amount=None)]
    want = set()
    for u, own in amounts.items():
        mean = sum(own) / len(own)
        sd = (sum((a - mean) ** 2 for a in own) / max(1, len(own) - 1)) ** 0.5
        up = down = 0.0
        for k, a in enumerate(own):
            if sd:
                up, down = max(0.0, up + (a - mean) / sd - 0.5), max(0.0, down - (a - mean) / sd - 0.5)
                if max(up, down) >= 1.5:
                    want.add((u, k, round(up, 4), round(down, 4)))
    found = patterns.behaviour_drift(frame(spark, *rows), limit=1.5).collect()
    assert {(r["user_id"], (r["day"] - START.date()).days, r["drift_up"], r["drift_down"]) for r in found} == want
    assert {u for u, *_ in want} == {1, 2}
    assert patterns.behaviour_drift(frame(spark, *rows).limit(0)).count() == 0


def test_meetings_of_sets_are_bits_by_time(spark, monkeypatch):
    """Three users in 130 hours, two of them in 65 more, in an order that is not that of time."""
    hours = [k * 37 % 195 for k in range(195)]
    rows = [(u, h, "P") for h in hours for u in ((1, 2, 3) if 20 <= h < 150 else (1, 2))]
    tx = frame(spark, *[row(k, user=u, when=3600.0 * h, country=c) for k, (u, h, c) in enumerate(rows)])
    made = []
    whole = patterns.stage
    monkeypatch.setattr(patterns, "stage", lambda df, name: made.append(whole(df, name)) or made[-1])
    found = {tuple(r["users"]): r for r in patterns.recurring_groups(tx, 10).collect()}
    assert {u: r["meetings"] for u, r in found.items()} == {(1, 2): 195, (1, 3): 130, (2, 3): 130, (1, 2, 3): 130}
    hour = {u: [(r[c] - START).total_seconds() // 3600 for c in ("first_meeting", "last_meeting")] for u, r in found.items()}
    assert hour == {(1, 2): [0, 194], (1, 3): [20, 149], (2, 3): [20, 149], (1, 2, 3): [20, 149]}
    # Larger sets come from the masks of their parts, not from lists of slots.
    assert all(df.columns == ["a", "users", "later"] for df in made[1:])
    assert {len(x["mask"]) for r in made[1].collect() for x in r["later"]} == {3, 4} or made[1].count() == 2


@pytest.mark.parametrize("short", [0, 8])
@pytest.mark.parametrize("most,stored", [(2, 2), (4, 2), (5, 3)])
def test_largest_sets_are_made_while_they_are_read(spark, monkeypatch, short, most, stored):
    """Six users over three words of a mask, in compiled code and in lambdas: only levels that two others are
    made from are stored, and every set has its meetings, the first and the last of them."""
    rows = [(u, h, "P") for h in range(150) for u in range(1, 7) if h * 7 % (u + 2) < 3 or h in (0, 61, 62, 149)]
    tx = frame(spark, *[row(k, user=u, when=3600.0 * h, country=c) for k, (u, h, c) in enumerate(rows)],
               row(9000, user=None), row(9001, user=1, when=None))
    made = []
    whole = patterns.stage
    monkeypatch.setattr(patterns, "stage", lambda df, name: made.append(whole(df, name)) or made[-1])
    monkeypatch.setattr(patterns, "SHORT", short)
    found = patterns.recurring_groups(tx, 5, most).collect()
    assert len(made) == stored
    hours: dict = {}
    for u, h, _ in rows:
        hours.setdefault(u, set()).add(h)
    sets = {s: set.intersection(*[hours[u] for u in s]) for n in range(2, most + 1) for s in combinations(range(1, 7), n)}
    want = {(s, len(s), len(met), min(met), max(met)) for s, met in sets.items() if len(met) >= 5}
    hour = lambda at: (at - START).total_seconds() // 3600
    assert len(found) == len(want)
    assert {(tuple(r["users"]), r["n_users"], r["meetings"], hour(r["first_meeting"]), hour(r["last_meeting"])) for r in found} == want
