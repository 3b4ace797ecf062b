"""The same questions as DuckDB SQL, written apart from the Spark code."""

from __future__ import annotations

from itertools import combinations

TX = """
e AS (
  SELECT event_id, ts, value, event_type, user_id // 4 AS uid,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events
), g AS (
  SELECT *, CASE WHEN k < 12 AND uid % 3 = 0 THEN (uid + 1 + k) % 25
                 WHEN k < 12 THEN (uid + 1) % 25 ELSE uid % 25 END AS nk FROM e
), tx AS (
  SELECT event_id AS transaction_id, uid AS user_id, ts AS "timestamp", value AS amount,
         n_name AS country,
         CASE WHEN k BETWEEN 12 AND 19 THEN 'desktop'
              WHEN k BETWEEN 20 AND 24 AND uid % 4 = 0 THEN 'tablet' ELSE 'mobile' END AS device,
         event_type AS channel, CAST(hour(ts) AS INTEGER) AS "hour",
         CAST(isodow(ts) - 1 AS INTEGER) AS dayofweek, k % 2 AS coupon_applied,
         1 + k % 5 AS num_items,
         CASE WHEN (value > 140 AND k % 2 = 0) OR k = 7 THEN 1 ELSE 0 END AS is_fraud,
         CAST(floor(epoch(ts)) AS BIGINT) AS sec
  FROM g JOIN nation ON nk = n_nationkey
)"""
TX_COLUMNS = [
    "transaction_id", "user_id", '"timestamp"', "amount", "country", "device", "channel",
    '"hour"', "dayofweek", "coupon_applied", "num_items", "is_fraud",
]

BEHAVIOUR = """
freq AS (
  SELECT *,
    count(*) OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) - 1 AS txn_count_1hr,
    count(*) OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) - 1 AS txn_count_24hr
  FROM tx
), seen AS (
  SELECT user_id, count(DISTINCT country) AS distinct_countries_user,
         count(DISTINCT device) AS distinct_devices_user FROM tx GROUP BY user_id
), homes AS (
  SELECT user_id, country AS user_primary_country
  FROM (SELECT user_id, country, count(*) AS n FROM tx GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, country NULLS FIRST) = 1
), gadgets AS (
  SELECT user_id, device AS user_primary_device
  FROM (SELECT user_id, device, count(*) AS n FROM tx GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, device NULLS FIRST) = 1
), behaviour AS (
  SELECT * FROM freq LEFT JOIN seen USING (user_id) LEFT JOIN homes USING (user_id)
                     LEFT JOIN gadgets USING (user_id)
)"""
BEHAVIOUR_COLUMNS = [
    "txn_count_1hr", "txn_count_24hr", "distinct_countries_user", "distinct_devices_user",
    "user_primary_country", "user_primary_device",
]

STATS = """
stats AS (
  SELECT quantile_disc(amount, 0.90) AS p90, quantile_disc(amount, 0.95) AS p95,
         avg(amount) AS mu, stddev_samp(amount) AS sd FROM tx
)"""

# name, condition, points, observed value, threshold
RULES = [
    ("high_amount", "amount > p95", 15, "money(amount)", "money(p95)"),
    ("extreme_amount", "amount > mu + 3 * sd", 25, "money(amount)", "money(mu + 3 * sd)"),
    ("high_frequency_1hr", "txn_count_1hr >= 3", 20, "txn_count_1hr", "3"),
    ("high_frequency_24hr", "txn_count_24hr >= 10", 10, "txn_count_24hr", "10"),
    ("multiple_countries", "distinct_countries_user >= 3", 12, "distinct_countries_user", "3"),
    ("unusual_country", "country <> user_primary_country", 8, "country", "user_primary_country"),
    ("multiple_devices", "distinct_devices_user >= 3", 10, "distinct_devices_user", "3"),
    ("unusual_device", "device <> user_primary_device", 5, "device", "user_primary_device"),
    ("unusual_hour", '"hour" BETWEEN 2 AND 4', 5, '"hour"', "'2-5'"),
]
NAMES = [r[0] for r in RULES]
FLAGS = [f"indicator_{n}" for n in NAMES]

_FLAG_SQL = ",\n    ".join(
    f"CAST(coalesce({cond}, false) AS INTEGER) AS indicator_{name}" for name, cond, *_ in RULES
)
_POINTS_SQL = " + ".join(f"{points} * indicator_{name}" for name, _, points, *_ in RULES)
SCORED = f"""
flagged AS (
  SELECT behaviour.*, stats.*,
    {_FLAG_SQL}
  FROM behaviour, stats
), pointed AS (
  SELECT *, CAST(least(100, {_POINTS_SQL}) AS INTEGER) AS risk_score FROM flagged
), scored AS (
  SELECT *, CASE WHEN risk_score > 70 THEN 'High' WHEN risk_score > 30 THEN 'Medium'
                 ELSE 'Low' END AS risk_level FROM pointed
)"""
SCORED_COLUMNS = TX_COLUMNS + BEHAVIOUR_COLUMNS + FLAGS + ["risk_score", "risk_level"]

POSTINGS = """
postings AS (
  SELECT l_orderkey AS transaction_id, l_suppkey AS user_id, date_trunc('second', l_shipdate) AS "timestamp",
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS amount,
         l_returnflag AS country, l_linestatus AS device, CAST(l_linenumber AS VARCHAR) AS channel,
         l_linenumber AS "hour", CAST(NULL AS INTEGER) AS dayofweek,
         CAST(l_linestatus = 'O' AS INTEGER) AS coupon_applied,
         CAST(l_quantity AS INTEGER) AS num_items,
         CASE WHEN l_discount > 0.05 THEN 1 WHEN l_discount > 0 THEN 0 END AS is_fraud
  FROM lineitem
)"""
_POSTING_ORDER = ", ".join(
    f"{c} NULLS FIRST" for c in ['"timestamp"'] + [c for c in TX_COLUMNS[1:] if c != '"timestamp"']
)


def _with(ctes: list[str], body: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + body


def on_tx(body: str) -> str:
    return _with([TX], body)


def on_behaviour(body: str) -> str:
    return _with([TX, BEHAVIOUR], body)


def on_scored(body: str) -> str:
    return _with([TX, BEHAVIOUR, STATS, SCORED], body)


def on_postings(body: str) -> str:
    return _with([POSTINGS], body)


def _cols(names: list[str]) -> str:
    return ", ".join(names)


def _money(sql: str) -> str:
    inner = sql.removeprefix("money(").removesuffix(")")
    return f"CAST(round({inner}, 2) AS DECIMAL(38,2))" if sql.startswith("money(") else sql


def _pct(part: str, whole: str, digits: int = 2) -> str:
    return f"round(100.0 * ({part}) / nullif({whole}, 0), {digits})"


def _lift(part: str, whole: str, all_part: str, all_whole: str) -> str:
    return (
        f"round((({part})::DOUBLE / nullif({whole}, 0)) / "
        f"nullif(({all_part})::DOUBLE / nullif({all_whole}, 0), 0), 4)"
    )


def _anomalies(columns: list[str]) -> str:
    parts = " UNION ALL ".join(
        f"""SELECT '{c.strip('"')}' AS dimension, CAST({c} AS VARCHAR) AS value, is_fraud, risk_score FROM scored"""
        for c in columns
    )
    return on_scored(
        f"""
SELECT dimension, value, count(*) AS transaction_count,
       {_pct('count(*)', '(SELECT count(*) FROM scored)')} AS percentage,
       {_pct('sum(is_fraud)', 'count(*)')} AS fraud_rate_percent,
       {_pct('count(*) FILTER (risk_score >= 70)', 'count(*)')} AS high_risk_percent,
       {_lift('sum(is_fraud)', 'count(*)', '(SELECT sum(is_fraud) FROM scored)', '(SELECT count(*) FROM scored)')} AS lift
FROM ({parts}) GROUP BY dimension, value"""
    )


def _distribution() -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM tx"
        for c in ["country", "device", "channel", "coupon_applied", "is_fraud"]
    )
    return on_tx(
        f"""SELECT "column", value, count(*) AS "count",
        {_pct('count(*)', '(SELECT count(*) FROM tx)')} AS percentage
        FROM ({parts}) GROUP BY ALL"""
    )


def _summary() -> str:
    return on_tx(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", count({q}) AS "count", round(avg({q}), 6) AS mean,
            round(stddev_samp({q}), 6) AS stddev, CAST(min({q}) AS DOUBLE) AS "min",
            CAST(quantile_disc({q}, 0.25) AS DOUBLE) AS p25,
            CAST(quantile_disc({q}, 0.5) AS DOUBLE) AS p50,
            CAST(quantile_disc({q}, 0.75) AS DOUBLE) AS p75,
            CAST(max({q}) AS DOUBLE) AS "max" FROM tx"""
            for c, q in [
                ("amount", "amount"), ("hour", '"hour"'), ("dayofweek", "dayofweek"),
                ("num_items", "num_items"),
            ]
        )
    )


def _fraud_by(column: str) -> str:
    return on_scored(
        f"""SELECT {column}, CAST(sum(is_fraud) AS BIGINT) AS fraud_transactions,
        count(*) AS total_transactions FROM scored GROUP BY {column}"""
    )


def _users_with_many(column: str) -> str:
    return on_tx(
        f"""SELECT user_id, count(DISTINCT {column}) AS distinct_values,
        count(*) AS transaction_count
        FROM tx GROUP BY user_id HAVING count(DISTINCT {column}) >= 3"""
    )


def _values_of_users(column: str) -> str:
    return on_tx(
        f"""SELECT *, count(*) OVER u AS distinct_values,
        CAST(sum(value_count) OVER u AS BIGINT) AS transaction_count
        FROM (SELECT user_id, {column} AS "value", count(*) AS value_count FROM tx GROUP BY ALL)
        WINDOW u AS (PARTITION BY user_id)
        QUALIFY distinct_values >= 3"""
    )


def _prevalence() -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{n}' AS indicator, {f} AS fired, is_fraud FROM scored" for n, f in zip(NAMES, FLAGS)
    )
    return on_scored(
        f"""
SELECT indicator, count(*) FILTER (fired = 1) AS transaction_count,
       {_pct('count(*) FILTER (fired = 1)', 'count(*)')} AS percentage,
       {_pct('sum(is_fraud) FILTER (fired = 1)', 'count(*) FILTER (fired = 1)')} AS fraud_rate_percent,
       {_lift('sum(is_fraud) FILTER (fired = 1)', 'count(*) FILTER (fired = 1)', 'sum(is_fraud)', 'count(*)')} AS lift
FROM ({parts}) GROUP BY indicator"""
    )


def _signature(separator: str) -> str:
    cases = ", ".join(f"CASE WHEN {f} = 1 THEN '{n}' END" for n, f in zip(NAMES, FLAGS))
    return f"concat_ws('{separator}', {cases})"


def _pairs() -> str:
    parts = " UNION ALL ".join(
        f"""SELECT '{a}' AS "first", '{b}' AS "second", count(*) AS transaction_count,
        CAST(sum(is_fraud) AS BIGINT) AS fraud_count,
        {_pct('sum(is_fraud)', 'count(*)')} AS fraud_rate_percent
        FROM scored WHERE indicator_{a} = 1 AND indicator_{b} = 1 HAVING count(*) > 0"""
        for a, b in combinations(NAMES, 2)
    )
    return on_scored(parts)


def _explained() -> str:
    return on_scored(
        " UNION ALL ".join(
            f"""SELECT transaction_id, risk_score, risk_level, '{name}' AS indicator,
            {points} AS weight, CAST({_money(observed)} AS VARCHAR) AS observed,
            CAST({_money(threshold)} AS VARCHAR) AS threshold
            FROM scored WHERE indicator_{name} = 1"""
            for name, _, points, observed, threshold in RULES
        )
    )


_NEXT = """CASE {0} WHEN 'High' THEN 'escalation' WHEN 'Medium' THEN 'further review'
           WHEN 'Low' THEN 'monitoring' END"""

_PROFILE = """
SELECT user_id, count(*) AS transaction_count, count(DISTINCT CAST("timestamp" AS DATE)) AS days_active,
       round(sum(amount), 2) AS total_amount, round(round(sum(amount), 2) / count(amount), 4) AS avg_amount,
       max(amount) AS max_amount, count(DISTINCT country) AS distinct_countries,
       count(DISTINCT device) AS distinct_devices, min("timestamp") AS first_seen,
       max("timestamp") AS last_seen, max(risk_score) AS max_score,
       round(avg(risk_score), 4) AS avg_score,
       count(*) FILTER (risk_level = 'High') AS high_count,
       count(*) FILTER (risk_level = 'Medium') AS medium_count,
       count(*) FILTER (risk_level = 'Low') AS low_count
FROM scored GROUP BY user_id"""

_WORST = """
SELECT user_id, transaction_id, amount, risk_score, risk_level,
       CAST(row_number() OVER (PARTITION BY user_id
            ORDER BY risk_score DESC, amount DESC, transaction_id) AS INTEGER) AS "rank"
FROM scored QUALIFY "rank" <= 3"""


def _customer_report() -> str:
    fired = " UNION ALL ".join(
        f"SELECT user_id, {i} AS i, '{n}' AS name, sum({f}) AS k FROM scored GROUP BY user_id"
        for i, (n, f) in enumerate(zip(NAMES, FLAGS))
    )
    level = """CASE WHEN high_count > 0 THEN 'High' WHEN medium_count > 0 THEN 'Medium' ELSE 'Low' END"""
    return on_scored(
        f"""
SELECT p.*, {level} AS worst_level, coalesce(main_indicators, '') AS main_indicators,
       {_NEXT.format(level)} AS next_step, evidence
FROM ({_PROFILE}) p
JOIN (SELECT user_id, string_agg(CAST(transaction_id AS VARCHAR), ',' ORDER BY "rank") AS evidence
      FROM ({_WORST}) GROUP BY user_id) USING (user_id)
LEFT JOIN (SELECT user_id, string_agg(name, ',' ORDER BY k DESC, i) AS main_indicators
      FROM (SELECT * FROM ({fired}) WHERE k > 0
            QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC, i) <= 3)
      GROUP BY user_id) USING (user_id)"""
    )


def _transaction_report() -> str:
    codes = ", ".join(
        f"CASE WHEN indicator_{n} = 1 THEN '{n}+{points}' END" for n, _, points, *_ in RULES
    )
    observed = [
        "user_id", '"timestamp"', "amount", "country", "device", "channel", '"hour"',
        *BEHAVIOUR_COLUMNS,
    ]
    return on_scored(
        f"""SELECT transaction_id, {_cols(observed)}, risk_score, risk_level,
        {_signature(',')} AS indicators, concat_ws(',', {codes}) AS explanation,
        {_NEXT.format('risk_level')} AS next_step,
        CAST(transaction_id AS VARCHAR) AS evidence FROM scored"""
    )


def _comparison() -> str:
    shares = ", ".join(f"{_pct(f'sum({f})', 'count(*)')} AS {n}_percent" for n, f in zip(NAMES, FLAGS))
    return on_scored(
        f"""SELECT risk_level, count(*) AS transaction_count,
        count(DISTINCT user_id) AS distinct_users, round(round(sum(amount), 2) / count(amount), 4) AS avg_amount, {shares},
        round(median(amount), 4) AS median_amount FROM scored GROUP BY risk_level"""
    )


def _links() -> str:
    def both(key, a, a_sql, b, b_sql):
        return f"""SELECT '{key}' AS key_column, '{a}' AS left_table, '{b}' AS right_table,
        count(DISTINCT l.{key}) AS left_values, count(DISTINCT r.{key}) AS shared_values,
        round(count(DISTINCT r.{key})::DOUBLE / count(DISTINCT l.{key}), 4) AS containment
        FROM {a_sql} l LEFT JOIN (SELECT DISTINCT {key} FROM {b_sql}) r ON l.{key} = r.{key}"""

    t, s = ("transactions", "tx"), ("scored_transactions", "scored")
    d, b = ("documents", "documents"), ("labels", "labels")
    pairs = [("transaction_id", t, s), ("user_id", t, s), ("doc_id", d, b)]
    return on_scored(
        " UNION ALL ".join(
            both(key, *x, *y) for key, one, two in pairs for x, y in ((one, two), (two, one))
        )
    )


_ROBUST = _with(
    [TX],
    """SELECT transaction_id, user_id, amount, round(med, 6) AS median_amount, round(mad, 6) AS mad_amount,
    round((amount - med) / (1.4826 * mad), 4) AS robust_z
    FROM (SELECT *, quantile_cont(abs(amount - med), 0.5) OVER (PARTITION BY user_id) AS mad
          FROM (SELECT *, quantile_cont(amount, 0.5) OVER (PARTITION BY user_id) AS med FROM tx))
    WHERE mad > 0 AND abs(round((amount - med) / (1.4826 * mad), 4)) >= 3.5""",
)

# The sums of drift, day after day.
_DRIFT = (
    "WITH RECURSIVE "
    + TX
    + """,
daily AS (SELECT user_id, CAST("timestamp" AS DATE) AS day, round(sum(amount), 2) AS total FROM tx GROUP BY ALL),
usual AS (SELECT user_id, avg(total) AS mean, stddev_samp(total) AS sd FROM daily GROUP BY user_id),
steps AS (
  SELECT user_id, day, total, (total - mean) / sd AS z, row_number() OVER (PARTITION BY user_id ORDER BY day) AS k
  FROM daily JOIN usual USING (user_id) WHERE sd > 0
), drift AS (
  SELECT user_id, day, total, k, greatest(0, z - 0.5) AS up, greatest(0, -z - 0.5) AS down FROM steps WHERE k = 1
  UNION ALL
  SELECT s.user_id, s.day, s.total, s.k, greatest(0, d.up + s.z - 0.5), greatest(0, d.down - s.z - 0.5)
  FROM drift d JOIN steps s ON s.user_id = d.user_id AND s.k = d.k + 1
)
SELECT user_id, day, total AS total_amount, round(up, 4) AS drift_up, round(down, 4) AS drift_down
FROM drift WHERE round(up, 4) >= 4 OR round(down, 4) >= 4"""
)

_KEYS_OF = {
    "number": {
        "region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey"],
        "supplier": ["s_suppkey", "s_nationkey"], "part": ["p_partkey", "p_size"],
        "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
    },
    "text": {
        "region": ["r_name"], "nation": ["n_name"], "customer": ["c_name", "c_mktsegment"], "supplier": ["s_name"],
        "part": ["p_name", "p_brand", "p_type"], "orders": ["o_orderstatus", "o_orderpriority"],
        "lineitem": ["l_returnflag", "l_linestatus"],
    },
}


def _discovered() -> str:
    """All pairs of columns, counted one by one."""
    cells = " UNION ".join(
        f"SELECT '{kind}' AS kind, '{t}' AS t, '{c}' AS c, CAST({c} AS VARCHAR) AS v FROM {t} WHERE {c} IS NOT NULL"
        for kind, tables in _KEYS_OF.items()
        for t, columns in tables.items()
        for c in columns
    )
    return f"""
WITH cells AS ({cells}),
many AS (SELECT t, c, count(*) AS n FROM cells GROUP BY ALL HAVING count(*) >= 20),
used AS (SELECT * FROM cells JOIN many USING (t, c))
SELECT a.t AS left_table, a.c AS left_column, b.t AS right_table, b.c AS right_column, a.n AS left_values,
       count(*) AS shared_values, round(count(*)::DOUBLE / a.n, 4) AS containment
FROM used a JOIN used b ON a.kind = b.kind AND a.v = b.v AND a.t <> b.t
GROUP BY a.t, a.c, b.t, b.c, a.n HAVING count(*) >= 0.9 * a.n"""


def _rules() -> str:
    """Rules by counting the rows of each set of indicators, one set after another."""
    mask = " + ".join(f"{1 << k} * {flag}" for k, flag in enumerate(FLAGS))
    named = ", ".join(f"CASE WHEN m & {1 << k} <> 0 THEN '{n}' END" for k, n in enumerate(NAMES))
    then = " UNION ALL ".join(f"SELECT '{n}' AS consequent, {1 << k} AS b" for k, n in enumerate(NAMES))
    ctes = f"""
masks AS (SELECT {mask} AS mask, is_fraud FROM scored),
wanted AS (SELECT CAST(m AS INTEGER) AS m FROM unnest(generate_series(0, 511)) AS t(m)),
counts AS (SELECT m, count(mask) AS n, coalesce(sum(is_fraud), 0) AS fraud
           FROM wanted LEFT JOIN masks ON mask & m = m GROUP BY m),
rules AS (
  SELECT a.m, consequent, c.n AS support, a.n AS own, o.n AS of_all
  FROM counts a JOIN ({then}) ON a.m & b = 0 JOIN counts c ON c.m = a.m | b JOIN counts o ON o.m = b
  UNION ALL SELECT a.m, 'fraud', a.fraud, a.n, o.fraud FROM counts a JOIN counts o ON o.m = 0
)"""
    return _with(
        [TX, BEHAVIOUR, STATS, SCORED, ctes],
        f"""SELECT concat_ws('+', {named}) AS antecedent, consequent, CAST(support AS BIGINT) AS support,
        own AS antecedent_count, round(support::DOUBLE / own, 4) AS confidence,
        round((support::DOUBLE / own) / (of_all::DOUBLE / (SELECT n FROM counts WHERE m = 0)), 4) AS lift
        FROM rules WHERE m > 0 AND support >= 1""",
    )


def _groups() -> str:
    """Sets of two, three and four users by joining who was where with itself."""
    met = """
met AS (SELECT DISTINCT date_trunc('day', "timestamp") AS day, country, device, channel, user_id AS u FROM tx)"""

    def of(n: int) -> str:
        users = ", ',', ".join(f"m{k}.u" for k in range(n))
        joins = " ".join(
            f"JOIN met m{k} ON m{k}.u > m{k - 1}.u AND m{k}.day = m0.day AND m{k}.country = m0.country "
            f"AND m{k}.device = m0.device AND m{k}.channel = m0.channel"
            for k in range(1, n)
        )
        return f"""SELECT concat({users}) AS users, {n} AS n_users, CAST(count(*) AS INTEGER) AS meetings,
        CAST(min(m0.day) AS TIMESTAMP) AS first_meeting, CAST(max(m0.day) AS TIMESTAMP) AS last_meeting
        FROM met m0 {joins} GROUP BY 1 HAVING count(*) >= 10"""

    return _with([TX, met], " UNION ALL ".join(of(n) for n in (2, 3, 4)))


def _rejects() -> str:
    zero = [c.strip('"') for c in TX_COLUMNS if c != "dayofweek"]
    return on_postings(
        "SELECT 'dayofweek' AS \"column\", count(*) AS rejected FROM postings UNION ALL "
        + " UNION ALL ".join(f"SELECT '{c}', 0" for c in zero)
    )


def _with_copies(body: str) -> str:
    copied = f"""copied AS (
      SELECT {_cols(TX_COLUMNS)} FROM postings
      UNION ALL SELECT {_cols(TX_COLUMNS)} FROM postings WHERE num_items > 25)"""
    return _with([POSTINGS, copied], body)


def _listing() -> str:
    columns = [
        ("transaction_id", "bigint"), ("user_id", "bigint"), ("timestamp", "timestamp"), ("amount", "double"),
        ("country", "string"), ("device", "string"), ("channel", "string"), ("hour", "int"),
        ("dayofweek", "int"), ("coupon_applied", "int"), ("num_items", "int"), ("is_fraud", "int"),
    ]
    rows = ", ".join(f"({i}, '{c}', '{t}', true)" for i, (c, t) in enumerate(columns))
    return f'SELECT * FROM (VALUES {rows}) v(position, "column", type, nullable)'


# Lines of the postings file that are damaged on purpose, and why they are not taken.
_DAMAGED = """
WITH p AS (
  SELECT l_orderkey % 40 AS fault, l_returnflag AS country,
         concat(l_orderkey, ',', l_suppkey, ',', strftime(l_shipdate, '%Y-%m-%d %H:%M:%S'), ',',
                CAST(l_extendedprice AS DECIMAL(18,2)), ',') AS front,
         concat(',', l_linestatus, ',', l_linenumber, ',', l_linenumber, ',', l_returnflag, ',',
                CASE WHEN l_linestatus = 'O' THEN 'true' ELSE 'false' END, ',',
                CAST(l_quantity AS DECIMAL(10,1))) AS rear,
         CASE WHEN l_discount > 0.05 THEN ',1' WHEN l_discount > 0 THEN ',0' ELSE ',' END AS fraud
  FROM lineitem
)
SELECT 'surplus fields' AS reason, concat(front, country, rear, fraud, ',extra') AS line FROM p WHERE fault = 1
UNION ALL SELECT 'missing fields', concat(front, country, rear) FROM p WHERE fault = 2
UNION ALL SELECT 'open quote', concat(front, '"', country, rear, fraud) FROM p WHERE fault = 3
UNION ALL SELECT 'open quote', concat(front, '"', country) FROM p WHERE fault = 4
UNION ALL SELECT 'open quote', concat('x"', rear, fraud) FROM p WHERE fault = 4
UNION ALL SELECT 'stray quote', concat(front, country, '"b"', rear, fraud) FROM p WHERE fault = 5"""

def _column_facts() -> str:
    kinds = dict.fromkeys(("transaction_id", "user_id"), "bigint") | dict.fromkeys(("country", "device", "channel"), "string")
    columns = [c for c in TX_COLUMNS if c not in ('"timestamp"', "amount")]
    return " UNION ALL ".join(
        f"""SELECT {i} AS position, '{c.strip('"')}' AS "column", '{kinds.get(c, "int")}' AS type,
        count({c}) AS value_count, CAST(min({c}) AS VARCHAR) AS smallest, CAST(max({c}) AS VARCHAR) AS largest FROM kept"""
        for i, c in enumerate(columns)
    )


_KEPT = f"""SELECT {_cols(TX_COLUMNS)} FROM postings QUALIFY row_number() OVER
            (PARTITION BY transaction_id ORDER BY {_POSTING_ORDER}) = 1"""
_REMOVED = f"""
SELECT {_cols(TX_COLUMNS)}, count(*) AS removed_copies,
       row({_cols(TX_COLUMNS)}) IS DISTINCT FROM any_value(kept) AS is_conflict
FROM (SELECT *, row_number() OVER o AS rn,
             first_value(row({_cols(TX_COLUMNS)})) OVER o AS kept
      FROM postings WINDOW o AS (PARTITION BY transaction_id ORDER BY {_POSTING_ORDER}))
WHERE rn > 1 GROUP BY {_cols(TX_COLUMNS)}"""

_ZSCORE = """zs AS (
  SELECT *, round((amount - avg(amount) OVER (PARTITION BY user_id))
         / nullif(stddev_samp(amount) OVER (PARTITION BY user_id), 0), 4) AS amount_z FROM tx
)"""
_UNUSUAL = _with(
    [TX, _ZSCORE],
    """SELECT transaction_id, user_id, amount, amount_z,
    CAST("timestamp" = min("timestamp") OVER (PARTITION BY user_id, country) AS INTEGER) AS new_country,
    CAST("timestamp" = min("timestamp") OVER (PARTITION BY user_id, device) AS INTEGER) AS new_device
    FROM zs""",
)
_SWITCH = on_tx(
    """
SELECT user_id, transaction_id, previous_transaction_id, previous_country, country, sec - previous_sec AS gap_seconds
FROM (SELECT *, lag(transaction_id) OVER w AS previous_transaction_id,
             lag(country) OVER w AS previous_country, lag(sec) OVER w AS previous_sec
      FROM tx WINDOW w AS (PARTITION BY user_id ORDER BY "timestamp", transaction_id))
WHERE country <> previous_country AND sec - previous_sec <= 3600"""
)
_ALL_SCORED = on_scored(f"SELECT {_cols(SCORED_COLUMNS)} FROM scored")
_TIMELINE = on_scored(
        """SELECT user_id, "timestamp", transaction_id, amount, country, device, channel, risk_score,
        risk_level, sec - lag(sec) OVER (PARTITION BY user_id ORDER BY "timestamp", transaction_id)
        AS gap_seconds FROM scored"""
    )
_NAMED = "(0, 1, 2, 3, 17, 30)"
_FREQUENCY = on_behaviour("SELECT transaction_id, user_id, txn_count_1hr, txn_count_24hr FROM freq")


def oracle_sql() -> dict[str, str]:
    return {
        "table_shape": on_tx("SELECT count(*) AS row_count, 12 AS column_count FROM tx"),
        "summary_stats": _summary(),
        "value_distribution": _distribution(),
        "fraud_rate": on_tx(
            f"""SELECT count(*) AS total_transactions, count(*) FILTER (is_fraud = 1) AS fraud_transactions,
            count(*) FILTER (is_fraud <> 1) AS legitimate_transactions,
            {_pct('count(*) FILTER (is_fraud = 1)', 'count(*)', 4)} AS fraud_rate FROM tx"""
        ),
        "amount_stats": _with(
            [TX, STATS],
            """SELECT p90 AS p90_amount, p95 AS p95_amount, round(mu, 6) AS avg_amount,
            round(sd, 6) AS stddev_amount FROM stats""",
        ),
        "txn_frequency": _FREQUENCY,
        "txn_frequency_hot_users": _FREQUENCY,
        "distinct_countries": on_behaviour("SELECT user_id, distinct_countries_user FROM seen"),
        "distinct_devices": on_behaviour("SELECT user_id, distinct_devices_user FROM seen"),
        "primary_country": on_behaviour("SELECT * FROM homes"),
        "primary_device": on_behaviour("SELECT * FROM gadgets"),
        "country_frequency": on_tx(
            "SELECT user_id, country, count(*) AS country_count FROM tx GROUP BY ALL"
        ),
        "device_frequency": on_tx(
            "SELECT user_id, device, count(*) AS device_count FROM tx GROUP BY ALL"
        ),
        "user_profile": on_behaviour(
            "SELECT * FROM seen JOIN homes USING (user_id) JOIN gadgets USING (user_id)"
        ),
        "user_patterns": on_behaviour(
            f"SELECT transaction_id, user_id, {_cols(BEHAVIOUR_COLUMNS)} FROM behaviour"
        ),
        "sample_rows": on_tx(f"SELECT {_cols(TX_COLUMNS)} FROM tx ORDER BY transaction_id LIMIT 10"),
        "monthly_count": on_tx(
            """SELECT CAST(date_trunc('month', "timestamp") AS TIMESTAMP) AS "month",
            count(*) AS transaction_count FROM tx GROUP BY 1"""
        ),
        "monthly_amount": on_tx(
            """SELECT CAST(date_trunc('month', "timestamp") AS TIMESTAMP) AS "month",
            round(sum(amount), 2) AS total_amount FROM tx GROUP BY 1"""
        ),
        "amount_distribution": on_tx(
            """SELECT min(amount) AS min_amount, max(amount) AS max_amount,
            round(avg(amount), 6) AS avg_amount, median(amount) AS median_amount FROM tx"""
        ),
        "amount_histogram": on_tx(
            """SELECT bin, count(*) AS transaction_count,
            round(any_value(lo) + any_value((hi - lo) / 20) * (bin - 1), 4) AS bin_from,
            round(any_value(lo) + any_value((hi - lo) / 20) * bin, 4) AS bin_to
            FROM (SELECT lo, hi, CAST(least(floor(20 * (amount - lo) / (hi - lo)) + 1, 20) AS BIGINT) AS bin
                  FROM tx, (SELECT min(amount) AS lo, max(amount) AS hi FROM tx))
            GROUP BY bin"""
        ),
        "txn_by_country": on_tx(
            f"""SELECT country, count(*) AS transaction_count,
            {_pct('count(*)', '(SELECT count(*) FROM tx)')} AS percentage FROM tx GROUP BY country"""
        ),
        "behaviour_change": on_tx(
            """
SELECT *, CAST(coalesce(count_ratio >= 2, false) AS INTEGER) AS count_changed,
       CAST(coalesce(amount_ratio >= 2, false) AS INTEGER) AS amount_changed
FROM (SELECT *, round(transaction_count / avg(transaction_count) OVER w, 4) AS count_ratio,
             round(total_amount / avg(total_amount) OVER w, 4) AS amount_ratio
      FROM (SELECT user_id, CAST("timestamp" AS DATE) AS "day", count(*) AS transaction_count,
                   round(sum(amount), 2) AS total_amount FROM tx GROUP BY ALL)
      WINDOW w AS (PARTITION BY user_id ORDER BY "day" ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
WHERE count_ratio >= 2 OR amount_ratio >= 2"""
        ),
        "multi_country_users": _users_with_many("country"),
        "multi_device_users": _users_with_many("device"),
        "countries_of_users": _values_of_users("country"),
        "devices_of_users": _values_of_users("device"),
        "country_switch": _SWITCH,
        "country_switch_hot_users": _SWITCH,
        "unusual_characteristics": _UNUSUAL,
        "unusual_characteristics_hot_users": _UNUSUAL,
        "amount_anomalies": _with(
            [TX, STATS, _ZSCORE],
            """SELECT * FROM (SELECT transaction_id, user_id, amount, amount_z,
            CAST(amount > p95 AS INTEGER) AS above_p95,
            CAST(amount > mu + 3 * sd AS INTEGER) AS above_extreme,
            CAST(coalesce(amount_z > 3, false) AS INTEGER) AS above_user_z FROM zs, stats)
            WHERE above_p95 + above_extreme + above_user_z > 0""",
        ),
        "indicators": on_scored(f"SELECT transaction_id, {_cols(FLAGS)} FROM scored"),
        "risk_scores": on_scored("SELECT transaction_id, risk_score, risk_level FROM scored"),
        "scored_transactions": _ALL_SCORED,
        "scored_transactions_hot_users": _ALL_SCORED,
        "level_counts": on_scored(
            """SELECT count(*) AS total_transactions, count(*) FILTER (risk_level = 'High') AS high_risk,
            count(*) FILTER (risk_level = 'Medium') AS medium_risk,
            count(*) FILTER (risk_level = 'Low') AS low_risk FROM scored"""
        ),
        "top20_risk": on_scored(
            f"""SELECT transaction_id, user_id, amount, country, device, channel, "hour", {_cols(FLAGS)},
            risk_score, risk_level, is_fraud FROM scored
            ORDER BY risk_score DESC, transaction_id LIMIT 20"""
        ),
        "high_risk_rows": on_scored(
            f"SELECT {_cols(SCORED_COLUMNS)} FROM scored WHERE risk_level = 'High'"
        ),
        "score_histogram": on_scored(
            """SELECT risk_score, risk_level, count(*) AS transaction_count,
            CAST(sum(is_fraud) AS BIGINT) AS actual_fraud_count FROM scored GROUP BY ALL"""
        ),
        "fraud_rate_by_level": on_scored(
            f"""SELECT risk_level, count(*) AS total_transactions,
            CAST(sum(is_fraud) AS BIGINT) AS actual_fraud,
            {_pct('sum(is_fraud)', 'count(*)')} AS fraud_rate_percent FROM scored GROUP BY risk_level"""
        ),
        "kpis": on_scored(
            f"""SELECT count(*) AS total_transactions,
            CAST(sum(CAST(risk_score >= 70 AS INTEGER)) AS BIGINT) AS high_risk_transactions,
            {_pct('sum(CAST(risk_score >= 70 AS INTEGER))', 'count(*)')} AS high_risk_percentage,
            round(sum(amount), 2) AS total_transaction_amount,
            round(sum(amount) FILTER (risk_score >= 70), 2) AS high_risk_amount FROM scored"""
        ),
        "triage_band_counts": on_scored(
            """SELECT CASE WHEN risk_score < 40 THEN 'Low Risk' WHEN risk_score < 70 THEN 'Medium Risk'
            ELSE 'High Risk' END AS risk_level, count(*) AS transaction_count FROM scored GROUP BY 1"""
        ),
        "fraud_by_device": _fraud_by("device"),
        "fraud_by_country": _fraud_by("country"),
        "fraud_by_channel": _fraud_by("channel"),
        "top100_high_risk": on_scored(
            """SELECT transaction_id, user_id, "timestamp", amount, country, device, channel,
            risk_score, is_fraud FROM scored WHERE risk_score >= 70
            ORDER BY risk_score DESC, amount DESC, transaction_id LIMIT 100"""
        ),
        "results_by_level": on_scored(
            f"""SELECT risk_level, count(*) AS transaction_count, round(sum(amount), 2) AS total_amount,
            {_pct('count(*)', '(SELECT count(*) FROM scored)')} AS percentage
            FROM scored GROUP BY risk_level"""
        ),
        "customer_profile": on_scored(_PROFILE),
        "customer_timeline": _TIMELINE,
        "customer_timeline_hot_users": _TIMELINE,
        "top_risk_per_user": on_scored(_WORST),
        "indicator_prevalence": _prevalence(),
        "indicator_combinations": on_scored(
            f"""SELECT coalesce(nullif({_signature('+')}, ''), 'none') AS signature,
            count(*) AS transaction_count, CAST(sum(is_fraud) AS BIGINT) AS fraud_count,
            {_pct('sum(is_fraud)', 'count(*)')} AS fraud_rate_percent FROM scored GROUP BY 1"""
        ),
        "indicator_pairs": _pairs(),
        "geo_anomalies": _anomalies(["country"]),
        "device_anomalies": _anomalies(["device"]),
        "time_anomalies": _anomalies(['"hour"', "dayofweek"]),
        "risk_comparison": _comparison(),
        "coordinated_activity": on_scored(
            """SELECT date_trunc('hour', "timestamp") AS window_start, country, device, channel,
            count(DISTINCT user_id) AS distinct_users, count(*) AS transaction_count,
            count(*) FILTER (risk_level IN ('High', 'Medium')) AS risky_count,
            round(sum(amount), 2) AS total_amount
            FROM scored GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT user_id) >= 2"""
        ),
        "customer_profile_from_states": on_scored(_PROFILE),
        "threshold_table": on_scored(
            """SELECT risk_score, n AS flagged, f AS flagged_fraud, round(f::DOUBLE / n, 4) AS precision,
            round(f::DOUBLE / all_f, 4) AS recall, round((n - f)::DOUBLE / all_o, 4) AS false_positive_rate
            FROM (SELECT a.risk_score, count(*) AS n, CAST(sum(b.is_fraud) AS BIGINT) AS f
                  FROM (SELECT DISTINCT risk_score FROM scored) a JOIN scored b ON b.risk_score >= a.risk_score
                  GROUP BY 1),
                 (SELECT sum(is_fraud) AS all_f, sum(1 - is_fraud) AS all_o FROM scored)"""
        ),
        "score_auc": on_scored(
            """SELECT CAST(any_value(p) AS BIGINT) AS fraud, CAST(any_value(n) AS BIGINT) AS other,
            round((sum(r) FILTER (is_fraud = 1) - any_value(p)::DOUBLE * (any_value(p) + 1) / 2)
                  / (any_value(p)::DOUBLE * any_value(n)), 6) AS auc
            FROM (SELECT is_fraud, rank() OVER (ORDER BY risk_score)
                         + (count(*) OVER (PARTITION BY risk_score) - 1) / 2.0 AS r,
                         sum(is_fraud) OVER () AS p, sum(1 - is_fraud) OVER () AS n FROM scored)"""
        ),
        "discovered_links": _discovered(),
        "behaviour_drift": _DRIFT,
        "robust_anomalies": _ROBUST,
        "robust_anomalies_hot_users": _ROBUST,
        "indicator_rules": _rules(),
        "recurring_groups": _groups(),
        "transaction_report": _transaction_report(),
        "customer_report": _customer_report(),
        "table_links": _links(),
        "explain_transaction": _explained(),
        "cast_to_schema": on_postings(f"SELECT {_cols(TX_COLUMNS)} FROM postings"),
        "reject_counts": _rejects(),
        "null_counts": on_postings(
            "SELECT " + ", ".join(f"count(*) - count({c}) AS {c}" for c in TX_COLUMNS) + " FROM postings"
        ),
        "duplicate_rows": on_postings(
            """SELECT count(*) AS total_rows, count(DISTINCT (user_id, country, device, num_items, is_fraud))
            AS distinct_rows, count(*) - count(DISTINCT (user_id, country, device, num_items, is_fraud))
            AS duplicate_rows FROM postings"""
        ),
        "duplicate_whole_rows": _with_copies(
            f"""SELECT count(*) AS total_rows, count(DISTINCT ({_cols(TX_COLUMNS)})) AS distinct_rows,
            count(*) - count(DISTINCT ({_cols(TX_COLUMNS)})) AS duplicate_rows FROM copied"""
        ),
        "distinct_rows": _with_copies("SELECT DISTINCT * FROM copied"),
        "duplicate_keys": on_postings(
            """SELECT count(*) AS duplicate_keys FROM
            (SELECT transaction_id FROM postings GROUP BY 1 HAVING count(*) > 1)"""
        ),
        "dedup_by_id": on_postings(_KEPT),
        "dedup_audit": on_postings(_REMOVED),
        "csv_transactions": on_postings(f"SELECT {_cols(TX_COLUMNS)} FROM postings"),
        "csv_sound_transactions": on_postings(
            f"SELECT {_cols(TX_COLUMNS)} FROM postings WHERE transaction_id % 40 NOT BETWEEN 1 AND 5"
        ),
        "csv_rejected_lines": _DAMAGED,
        "stored_transactions": on_postings(_KEPT),
        "stored_rejects": on_postings(_REMOVED),
        "stored_reject_counts": _rejects(),
        "stored_scored": _ALL_SCORED,
        "table_sizes": _with(
            [POSTINGS, f"kept AS ({_KEPT})", f"gone AS ({_REMOVED})"],
            """SELECT 'payments' AS table_name, count(*) AS row_count, 12 AS column_count FROM kept
            UNION ALL SELECT 'payments_rejects', count(*), 14 FROM gone
            UNION ALL SELECT 'payments_reject_counts', 12, 2""",
        ),
        "column_facts": _with([POSTINGS, f"kept AS ({_KEPT})"], _column_facts()),
        "dictionary_rows": """SELECT CAST(p_partkey AS INTEGER) AS "column",
            concat(p_name, ', ', p_type) AS description FROM part""",
        "staged_transactions": on_tx(f"SELECT {_cols(TX_COLUMNS)} FROM tx"),
        "timeline_of_users": f"SELECT * FROM ({_TIMELINE}) WHERE user_id IN {_NAMED}",
        "profile_of_users": f"SELECT * FROM ({on_scored(_PROFILE)}) WHERE user_id IN {_NAMED}",
        "worst_of_users": f"SELECT * FROM ({on_scored(_WORST)}) WHERE user_id IN {_NAMED}",
        "rescored_after_append": _ALL_SCORED,
        "schema_listing": _listing(),
        "table_listing": """SELECT * FROM (VALUES ('payments'), ('payments_reject_counts'),
            ('payments_rejects')) v(table_name)""",
    }
