"""Expected results of the queries in ``checks``, as SQL over the same tables.

Written from the definitions of the operators, without looking at their plans:
plain windows, no splitting, no pre-aggregation.
"""

from __future__ import annotations

from riskweave.operators.forest import average_path
from riskweave.plans.stored_forest import CONTAMINATION, SAMPLE, TREES, node_rule
from riskweave.schema import ACTIONS, EXPLORER_URL, FEATURE_COLUMNS

MINUTE = 60_000_000
WINDOWS = {"5 minutes": 5, "7 days": 7 * 24 * 60}

EVENTS_TX = """
SELECT CAST(event_id AS VARCHAR) AS hash, CAST(user_id AS VARCHAR) AS account,
       json_extract_string(props, '$.k') AS destination, event_id AS ledger_index,
       CAST(ts AS TIMESTAMP) AS close_time, value AS amount_value, 'XRP' AS currency,
       CAST(json_extract_string(props, '$.k') AS DOUBLE) AS fee,
       CASE event_type WHEN 'click' THEN 'OfferCreate' WHEN 'view' THEN 'OfferCancel'
            ELSE event_type END AS transaction_type,
       event_type <> 'error' AS success, props AS memo_text
FROM events"""

ORDERS_TX = """
SELECT CAST(o_orderkey AS VARCHAR) AS hash, CAST(o_custkey AS VARCHAR) AS account,
       o_orderpriority AS destination,
       CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS ledger_index,
       CAST(o_orderdate AS TIMESTAMP) AS close_time, o_totalprice AS amount_value,
       'XRP' AS currency, 0.0::DOUBLE AS fee, o_orderstatus AS transaction_type,
       o_orderstatus <> 'F' AS success, '' AS memo_text
FROM orders"""

LINES_TX = """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS hash,
       CAST(l_suppkey AS VARCHAR) AS account, CAST(l_partkey % 97 AS VARCHAR) AS destination,
       CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS ledger_index,
       CAST(l_shipdate AS TIMESTAMP) AS close_time, l_extendedprice AS amount_value, 'XRP' AS currency,
       l_quantity AS fee, CASE l_returnflag WHEN 'R' THEN 'OfferCancel' WHEN 'A' THEN 'OfferCreate'
       ELSE 'Payment' END AS transaction_type, l_linestatus <> 'F' AS success, l_returnflag AS memo_text
FROM lineitem"""

RAW = """
SELECT
  CASE event_id % 8
    WHEN 0 THEN d WHEN 1 THEN ' ' || d || ' ' WHEN 2 THEN t
    WHEN 3 THEN '{"value":"' || t || '","currency":"USD","issuer":"r1"}'
    WHEN 4 THEN '{"value":"' || d || '","currency":"XRP"}'
    WHEN 5 THEN '{"value":"' || d || '"}'
    WHEN 6 THEN '' END AS amount,
  CASE WHEN event_id % 16 = 7 THEN d END AS deliver_max,
  CASE WHEN event_id % 8 = 7
       THEN '{"value":"' || t || '","currency":"EUR","issuer":"r2"}' END AS taker_gets,
  CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%b-%d %H:%M:%S.%f') || '000 UTC'
       WHEN 1 THEN '' END AS human,
  CASE event_id % 4 WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') WHEN 3 THEN 'bad' END AS date_text,
  CASE event_id % 4 WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') END AS time_text,
  CASE WHEN event_id % 5 <> 4 THEN CAST(event_id AS VARCHAR) END AS ledger_text,
  CASE event_id % 3 WHEN 0 THEN 'h' || event_id WHEN 1 THEN '' END AS h1,
  CASE event_id % 3 WHEN 1 THEN 'x' || event_id END AS h2,
  's' || event_id AS h3,
  CASE WHEN event_id % 5 <> 0 THEN event_type END AS type1,
  CASE WHEN event_id % 5 = 0 THEN event_type END AS type2,
  CASE WHEN event_id % 5 <> 1 THEN CAST(user_id AS VARCHAR) END AS account1,
  CASE WHEN event_id % 5 = 1 AND event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) END AS account2,
  CASE WHEN event_id % 5 = 2 THEN k ELSE '' END AS dest1,
  CASE WHEN event_id % 5 = 3 THEN k END AS dest2,
  CASE WHEN event_id % 3 = 0 THEN k END AS fee1,
  CASE event_id % 3 WHEN 1 THEN k WHEN 2 THEN 'none' END AS fee2
FROM (SELECT *, CAST(CAST(round(value * 1000000) AS BIGINT) AS VARCHAR) AS d,
             printf('%.2f', value) AS t, json_extract_string(props, '$.k') AS k FROM events)"""

NORMALISED = f"""
picked AS (SELECT *, trim(coalesce(amount, deliver_max, taker_gets)) AS p FROM ({RAW})),
parsed AS (
  SELECT *,
    CASE WHEN p LIKE '{{%' THEN try_cast(json_extract_string(p, '$.value') AS DOUBLE)
              / CASE WHEN coalesce(json_extract_string(p, '$.currency'), 'XRP') = 'XRP'
                     THEN 1000000 ELSE 1 END
         WHEN regexp_matches(p, '^[+-]?[0-9]+$') THEN CAST(p AS BIGINT) / 1000000 END AS v,
    CASE WHEN p LIKE '{{%' THEN coalesce(json_extract_string(p, '$.currency'), 'XRP')
         ELSE 'XRP' END AS c,
    CASE WHEN p LIKE '{{%' THEN json_extract_string(p, '$.issuer') END AS i,
    CASE WHEN nullif(human, '') IS NOT NULL
           THEN try_strptime(replace(human, '000 UTC', ''), '%Y-%b-%d %H:%M:%S.%f')
         ELSE try_cast(replace(coalesce(nullif(date_text, ''), time_text), 'Z', '') AS TIMESTAMP)
    END AS tm
  FROM picked),
norm AS (
  SELECT tm AS "timestamp", coalesce(CAST(ledger_text AS BIGINT), 0) AS ledger_index,
    coalesce(nullif(h1, ''), nullif(h2, ''), h3) AS tx_hash,
    coalesce(type1, type2) AS tx_type, coalesce(account1, account2) AS account,
    coalesce(nullif(dest1, ''), dest2) AS destination,
    coalesce(try_cast(coalesce(fee1, fee2) AS BIGINT), 0) AS fee,
    v AS amount_xrp, c AS currency, i AS issuer, h3
  FROM parsed)"""

NORM_OUT = (
    'CAST(epoch_us("timestamp") AS BIGINT) AS time_us, ledger_index, tx_hash, tx_type, account, destination, '
    "fee, amount_xrp, currency, issuer"
)

TX_OUT = (
    "hash, account, destination, ledger_index, CAST(epoch_us(close_time) AS BIGINT) AS close_us, "
    "amount_value, currency, success, memo_text"
)


def features(tx: str, minutes: int, positional: bool = False) -> str:
    """CTEs ending in ``f``: all features of ``tx`` with their plain definitions."""
    us = minutes * MINUTE - 1
    order = "ledger_index, close_time, hash"
    spread = f"PARTITION BY account ORDER BY close_time RANGE BETWEEN INTERVAL '{us} microseconds' PRECEDING AND CURRENT ROW"
    measures = {
        "vol": "sum(amount_value)",
        "cnt": "count(hash)",
        "dst": "count(DISTINCT destination)",
        "can": "sum(CASE WHEN transaction_type = 'OfferCancel' THEN 1 ELSE 0 END)",
        "off": "sum(CASE WHEN transaction_type IN ('OfferCreate', 'OfferCancel') THEN 1 ELSE 0 END)",
        "bad": "sum(CASE WHEN success THEN 0 ELSE 1 END)",
    }
    if positional:
        # A row sees the rows of its account that are later than (t - window) and not after it.
        trailing = f"""
        SELECT a.hash, {", ".join(f"{m.replace('(', '(b.', 1) if 'CASE' not in m and 'DISTINCT' not in m else m.replace('DISTINCT ', 'DISTINCT b.').replace('WHEN success', 'WHEN b.success').replace('transaction_type', 'b.transaction_type')} AS {n}" for n, m in measures.items())}
        FROM tx a JOIN tx b ON a.account = b.account
          AND b.close_time > a.close_time - INTERVAL '{us + 1} microseconds'
          AND (b.close_time < a.close_time OR (b.close_time = a.close_time
               AND (b.ledger_index, b.hash) <= (a.ledger_index, a.hash)))
        GROUP BY a.hash"""
        timed = f"SELECT tx.*, {', '.join(measures)} FROM tx JOIN ({trailing}) USING (hash)"
    else:
        timed = f"SELECT *, {', '.join(f'{m} OVER w AS {n}' for n, m in measures.items())} FROM tx WINDOW w AS ({spread})"
    return f"""
    tx AS ({tx}),
    t1 AS ({timed}),
    t2 AS (SELECT *,
        (rank() OVER (PARTITION BY account ORDER BY amount_value)
          + (count(*) OVER (PARTITION BY account, amount_value) - 1) / 2.0)
          / count(*) OVER (PARTITION BY account) AS pct,
        row_number() OVER (PARTITION BY account, memo_text ORDER BY {order}) - 1 AS dup,
        cnt / CAST({minutes} AS DOUBLE) AS rate FROM t1),
    t3 AS (SELECT *, count(*) OVER r AS n, avg(vol) OVER r AS vmean, avg(rate) OVER r AS rmean,
        stddev_samp(rate) OVER r AS rstd, median(rate) OVER r AS med, list(rate) OVER r AS rates,
        lag(ledger_index) OVER (PARTITION BY account ORDER BY {order}) AS prev
      FROM t2 WINDOW r AS (PARTITION BY account ORDER BY {order}
                           ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
    t4 AS (SELECT *, list_aggregate(list_transform(rates, lambda x: abs(x - med)), 'median') AS mad
      FROM t3),
    f AS (SELECT hash, account, ledger_index, close_time,
        pct AS tx_size_percentile_local,
        CAST(pct >= 0.95 AS INTEGER) AS is_large_tx,
        vol AS total_volume_5m,
        CASE WHEN n < 3 OR vmean = 0 THEN 0.0 ELSE vol / vmean END AS volume_spike_ratio,
        CASE WHEN amount_value > 0 THEN fee / (amount_value * 1e6) ELSE 0.0 END AS fee_rate,
        CAST(cnt AS DOUBLE) AS rolling_tx_count_5m,
        rate AS tx_per_minute,
        CASE WHEN n < 3 THEN rate WHEN abs(rstd) < 1e-12 THEN 0.0
             ELSE (rate - rmean) / rstd END AS tx_rate_z_score,
        CASE WHEN n < 3 OR mad < 1e-12 THEN 0.0
             ELSE greatest(least((rate - med) / (1.4826 * mad), 10.0), -10.0) END AS tx_rate_mad_z,
        CASE WHEN memo_text = '' THEN 0.0 ELSE {ENTROPY.format(text="memo_text")} END AS memo_entropy,
        CAST(length(memo_text) AS DOUBLE) AS memo_length,
        CAST(dup AS DOUBLE) AS duplicate_memo_count,
        CAST(regexp_matches(memo_text, '(?i)(https?://|www\\.)') AS INTEGER) AS contains_url,
        1.0 / greatest(dst, 1) AS dest_concentration,
        greatest(dst, 1) / CAST(greatest(cnt, 1) AS DOUBLE) AS unique_dest_ratio,
        can / CAST(greatest(off, 1) AS DOUBLE) AS offer_cancel_ratio,
        bad / CAST(greatest(cnt, 1) AS DOUBLE) AS failed_tx_ratio,
        CAST(least(coalesce(ledger_index - prev, 0), 100000) AS DOUBLE) AS dormancy_gap
      FROM t4)"""


#: Bits per character: counts of the distinct characters over the length.
ENTROPY = (
    "list_sum(list_transform(list_distinct(string_split({text}, '')), "
    "lambda c: -((length({text}) - length(replace({text}, c, ''))) / length({text})) "
    "* log2((length({text}) - length(replace({text}, c, ''))) / length({text}))))"
)


def rounded(column: str, places: int = 6) -> str:
    if column in ("is_large_tx", "contains_url", "account", "ledger_index"):
        return column
    return f"round({column}, {12 if column == 'fee_rate' else places}) AS {column}"


def feature_sql(columns: list[str], tx: str = EVENTS_TX, positional: bool = False) -> str:
    """Chosen features for both windows, as one union."""
    picked = ", ".join(rounded(c) for c in columns)
    parts = [
        f"SELECT * FROM (WITH {features(tx, minutes, positional)} "
        f"SELECT '{name}' AS time_window, hash, {picked} FROM f)"
        for name, minutes in WINDOWS.items()
    ]
    return " UNION ALL ".join(parts)


WEEK = features(EVENTS_TX, WINDOWS["7 days"])
ALL = ["account", "ledger_index", *FEATURE_COLUMNS]


def cut(share_rows: str) -> str:
    """Orders in ledger order with their 0-based row number."""
    return f"""
    WITH tx AS ({ORDERS_TX}),
    o AS (SELECT *, row_number() OVER (ORDER BY ledger_index, close_time, hash) - 1 AS rn,
                 count(*) OVER () AS n FROM tx) {share_rows}"""


SEGMENT = "greatest(0, CAST(floor((rn - (n - 5 * (n // 6))) / CAST(n // 6 AS DOUBLE)) AS INTEGER) + 1)"

SCORED = f"""
WITH {WEEK},
s AS (SELECT f.*, e.value / (e.value + 10) AS score
      FROM f JOIN events e ON f.hash = CAST(e.event_id AS VARCHAR))"""

# Signal predicates and texts, in output order.
SIGNALS = [
    ("tx_rate_z_score", "abs(tx_rate_z_score) > 2",
     "printf('Tx rate %.1fσ above account''s normal', tx_rate_z_score)"),
    ("tx_rate_mad_z", "abs(tx_rate_mad_z) > 2",
     "printf('Tx rate MAD z-score %.1f (robust spike)', tx_rate_mad_z)"),
    ("volume_spike_ratio", "volume_spike_ratio > 5",
     "printf('Volume %.1f× above 5-min baseline', volume_spike_ratio)"),
    ("offer_cancel_ratio", "offer_cancel_ratio > 0.5",
     "printf('Offer cancel ratio %.0f%% — possible spoofing', offer_cancel_ratio * 100)"),
    ("dest_concentration", "dest_concentration < 0.3",
     "printf('Fan-out to many destinations (conc=%.2f)', dest_concentration)"),
    ("failed_tx_ratio", "failed_tx_ratio > 0.2",
     "printf('Failed tx ratio %.0f%% — probing or bot', failed_tx_ratio * 100)"),
    ("dormancy_gap", "dormancy_gap > 2000",
     "printf('Dormant %.0f ledgers then suddenly active', dormancy_gap)"),
    ("memo_entropy_low", "memo_entropy > 0 AND memo_entropy < 0.5",
     "printf('Memo entropy %.2f — repetitive spam content', memo_entropy)"),
    ("memo_entropy_high", "memo_entropy > 4.5",
     "printf('Memo entropy %.2f — possible encoded payload', memo_entropy)"),
    ("contains_url", "contains_url = 1", "'Memo contains URL'"),
    ("duplicate_memo_count", "duplicate_memo_count > 3",
     "printf('Same memo repeated %.0f times', duplicate_memo_count)"),
    ("tx_size_percentile_local", "tx_size_percentile_local > 0.95",
     "printf('Tx size at %.0f%% of this account''s history', tx_size_percentile_local * 100)"),
    ("fee_rate", "fee_rate > 0.001",
     "printf('Fee rate %.4f — disproportionate to amount', fee_rate)"),
]
CODES = "concat_ws(',', " + ", ".join(f"CASE WHEN {p} THEN '{c}' END" for c, p, _ in SIGNALS) + ")"
TEXTS = "concat_ws(' | ', " + ", ".join(f"CASE WHEN {p} THEN {t} END" for _, p, t in SIGNALS) + ")"
SEVERITY = (
    "CASE WHEN NOT (score > 0.7) THEN NULL WHEN score >= 1 - 0.15 * 0.2 THEN 'HIGH' "
    "WHEN score >= 1 - 0.15 THEN 'MEDIUM' ELSE 'LOW' END"
)
LABEL = (
    "CASE WHEN score >= 0.8 THEN 'Extreme' WHEN score >= 0.6 THEN 'Very high' "
    "WHEN score >= 0.4 THEN 'High' WHEN score >= 0.2 THEN 'Moderate' ELSE 'Low' END"
)
EXPLORER = "'" + EXPLORER_URL.replace("{account}", "' || account || '") + "'"
ACTION = (
    f"CASE {SEVERITY} WHEN 'HIGH' THEN '" + ACTIONS["HIGH"].replace("{account}", "' || account || '")
    + f"' WHEN 'MEDIUM' THEN '{ACTIONS['MEDIUM']}' ELSE '{ACTIONS['LOW']}' END"
)
CLOSE_TEXT = (
    "strftime(close_time, '%Y-%m-%d %H:%M:%S') || CASE WHEN epoch_us(close_time) % 1000000 <> 0 "
    "THEN strftime(close_time, '.%f') ELSE '' END || '+00:00'"
)
ALERT_COLUMNS = f"""
  {SEVERITY} AS severity, round(score, 4) AS anomaly_score, {LABEL} AS risk_label, account, ledger_index,
  {CLOSE_TEXT} AS close_time,
  CASE WHEN {CODES} = '' THEN printf('Multivariate anomaly — score %.3f (unusual combination of 18 features)', score)
       ELSE {TEXTS} END AS signals,
  {ACTION} AS action, {EXPLORER} AS explorer_url"""
FLAT = ", ".join(f"round(CAST({c} AS DOUBLE), 4) AS feat_{c}" for c in FEATURE_COLUMNS)
ALERTS_FLAT = f"{SCORED} SELECT {ALERT_COLUMNS}, {FLAT} FROM s WHERE score > 0.7"


def tree_sql(tree: int, node: int = 0) -> str:
    """Path length of a tree of the stored forest, over the scaled features x0, x1, ..."""
    feature, threshold, path = node_rule(tree, node)
    if feature < 0:
        return str(path)
    left, right = tree_sql(tree, 2 * node + 1), tree_sql(tree, 2 * node + 2)
    return f"CASE WHEN x{feature} >= {threshold!r}::DOUBLE THEN {right} ELSE {left} END"


def forest_sql(rows: str = "o", training: str = "SELECT * FROM o WHERE rn < floor(n * 0.8)") -> str:
    """CTEs from features ``f`` to ``scored``: raw, pct, an (the excess) and flag of each row."""
    scaled = ", ".join(
        f"(CAST({c} AS DOUBLE) - q{i}[2]) / CASE WHEN q{i}[3] = q{i}[1] THEN 1 ELSE q{i}[3] - q{i}[1] END AS x{i}"
        for i, c in enumerate(FEATURE_COLUMNS)
    )
    quantiles = ", ".join(
        f"quantile_cont(CAST({c} AS DOUBLE), [0.25, 0.5, 0.75]) AS q{i}" for i, c in enumerate(FEATURE_COLUMNS)
    )
    paths = " + ".join(tree_sql(t) for t in range(TREES))
    raw = f"pow(2::DOUBLE, -(({paths}) / {TREES}::DOUBLE) / {float(average_path(SAMPLE))!r}::DOUBLE)"
    return f"""
    o AS (SELECT *, row_number() OVER (ORDER BY ledger_index, close_time, hash) - 1 AS rn,
                 count(*) OVER () AS n FROM f),
    tr AS ({training}), q AS (SELECT {quantiles} FROM tr),
    trained AS (SELECT {raw} AS raw FROM (SELECT {scaled} FROM tr, q)),
    cal AS (SELECT quantile_cont(raw, {1.0 - CONTAMINATION}) AS threshold, count(*) AS k,
              list_sort(list(floor(raw * 131072))) AS cells FROM trained),
    marks AS (SELECT threshold, list_transform(range(1001), lambda i:
              cells[1 + CAST(floor(CAST(i AS DOUBLE) / 1000::DOUBLE * (k - 1)) AS BIGINT)] / 131072::DOUBLE) AS grid
              FROM cal),
    scored AS (SELECT r.*, raw > threshold AS flag, least(greatest(raw - threshold, 0), 1) AS an,
                 least(greatest((len(list_filter(grid, lambda m: m <= raw)) - 1) / 1000::DOUBLE, 0), 1) AS pct
               FROM (SELECT *, {raw} AS raw FROM (SELECT {rows}.*, {scaled} FROM {rows}, q)) r, marks)"""


FOREST = f"WITH {WEEK}, {forest_sql()}"
FOREST_SCORES = (
    "round(raw, 6) AS raw_score, round(pct, 6) AS score_pct, round(an, 6) AS anomaly_score"
)
OLDEST = f"""
SELECT hash, account, destination, ledger_index, close_time, amount_value, currency, 0.0::DOUBLE AS fee,
       '' AS transaction_type, success, memo_text
FROM ({EVENTS_TX}) ORDER BY ledger_index, close_time, hash LIMIT 4000"""


def oldest_scored() -> str:
    """The oldest rows by themselves, scored by the forest calibrated on the usual training rows."""
    own = features(OLDEST, WINDOWS["7 days"])
    rows = f"SELECT * FROM (WITH {own} SELECT * FROM f)"
    return f"""WITH {WEEK}, few AS ({rows}), {forest_sql("few")}
    SELECT hash, account, ledger_index, {FOREST_SCORES}, flag AS risk_flag, {", ".join(rounded(c) for c in FEATURE_COLUMNS)},
      CAST(row_number() OVER (ORDER BY an DESC, account, ledger_index, close_time, hash) AS INTEGER) AS place
    FROM scored"""


def forest_alerts(rows: str) -> str:
    severity = SEVERITY.replace("score > 0.7", "flag").replace("0.15", str(CONTAMINATION))
    texts = f"""CASE WHEN {CODES} = '' THEN printf('Multivariate anomaly — score %.3f (unusual combination of 18 features)', score)
       ELSE {TEXTS} END"""
    names = ", ".join(f"CASE WHEN round(CAST({c} AS DOUBLE), 4) <> 0 THEN '{c}' END" for c in FEATURE_COLUMNS)
    return f"""{FOREST}, a AS (
      SELECT *, {severity} AS severity, {CLOSE_TEXT} AS time_text, {texts} AS signals,
        array_to_string(list_filter([{names}], lambda x: x IS NOT NULL)[1:6], ',') AS top_names
      FROM (SELECT *, pct AS score FROM scored WHERE {rows}) WHERE flag)
    SELECT CAST(row_number() OVER (ORDER BY CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END,
             round(score, 4) DESC, account, ledger_index, time_text) AS INTEGER) AS place,
      severity, round(score, 4) AS anomaly_score, account, ledger_index, signals, top_names FROM a"""


def forest_validation_sql() -> str:
    train, test = "rn < floor(n * 0.8)", "rn >= floor(n * 0.8)"
    distance = ks("scores", f"SELECT an AS x FROM scored WHERE {train}", f"SELECT an AS x FROM scored WHERE {test}")
    distance = distance.replace("round(stat, 6)", "stat")
    return f"""{FOREST}, k AS ({distance}),
    m AS (SELECT avg(CAST(flag AS INTEGER)) FILTER (WHERE {train}) AS a, avg(CAST(flag AS INTEGER)) FILTER (WHERE {test}) AS b,
            quantile_cont(an, 0.95) FILTER (WHERE {test}) - quantile_cont(an, 0.5) FILTER (WHERE {test}) AS sep,
            avg(an) FILTER (WHERE {test}) AS mean, stddev_pop(an) FILTER (WHERE {test}) AS dev FROM scored),
    r AS (SELECT round(a, 4) AS train_flag_rate, round(b, 4) AS test_flag_rate, round(abs(a - b), 4) AS rate_drift,
            round(ks_stat, 4) AS ks_stat, round(ks_p_value, 4) AS ks_p_value, round(sep, 4) AS score_separation,
            round(mean, 4) AS test_score_mean, round(dev, 4) AS test_score_std FROM m, k)
    SELECT *, rate_drift > 0.05 AS high_drift, ks_p_value <= 0.05 AS distribution_shift,
      score_separation < 0.1 AS low_separation FROM r"""


def quantile_scaled(column: str) -> str:
    q = f"quantile_cont(CAST({column} AS DOUBLE), [0.25, 0.5, 0.75])"
    return (
        f"round((CAST({column} AS DOUBLE) - q_{column}[2]) / "
        f"CASE WHEN q_{column}[3] = q_{column}[1] THEN 1 ELSE q_{column}[3] - q_{column}[1] END, 6) AS {column}",
        f"{q} AS q_{column}",
    )


_SCALE = [
    quantile_scaled(c)
    for c in ("total_volume_5m", "volume_spike_ratio", "dormancy_gap", "tx_rate_mad_z", "contains_url")
]


def fence(origin: str, column: str) -> str:
    return f"""
    SELECT '{origin}' AS origin, n, round(low, 6) AS low, round(high, 6) AS high, outliers,
      round(CASE WHEN n < 20 THEN 0.05 ELSE least(greatest(outliers / CAST(n AS DOUBLE), 0.01), 0.15) END, 6)
        AS contamination
    FROM (SELECT count(*) AS n, any_value(low) AS low, any_value(high) AS high,
             count(*) FILTER (WHERE x < low OR x > high) AS outliers
          FROM (SELECT {column} AS x FROM {origin}),
               (SELECT q[1] - 3 * (q[2] - q[1]) AS low, q[2] + 3 * (q[2] - q[1]) AS high
                FROM (SELECT quantile_cont({column}, [0.25, 0.75]) AS q FROM {origin})))"""


def ks(origin: str, a: str, b: str) -> str:
    """KS distance over the union of values, and the Kolmogorov series."""
    return f"""
    SELECT * FROM (WITH v AS (SELECT x, 1 AS a, 0 AS b FROM ({a}) UNION ALL SELECT x, 0, 1 FROM ({b})),
    g AS (SELECT x, sum(a) AS a, sum(b) AS b FROM v GROUP BY x),
    t AS (SELECT sum(a) AS n_a, sum(b) AS n_b FROM g),
    c AS (SELECT sum(a) OVER (ORDER BY x) AS ra, sum(b) OVER (ORDER BY x) AS rb FROM g),
    d AS (SELECT any_value(n_a) AS n_a, any_value(n_b) AS n_b,
                 max(abs(ra / CAST(n_a AS DOUBLE) - rb / CAST(n_b AS DOUBLE))) AS stat FROM c, t),
    l AS (SELECT *, stat * sqrt(CAST(n_a AS DOUBLE) * n_b / (n_a + n_b)) AS lam FROM d)
    SELECT '{origin}' AS origin, CAST(n_a AS BIGINT) AS n_a, CAST(n_b AS BIGINT) AS n_b,
      round(stat, 6) AS ks_stat,
      round(CASE WHEN lam < 0.1 THEN 1.0 ELSE greatest(0.0, least(1.0, 2 * list_sum(list_transform(range(1, 101),
        lambda k: CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(-2.0 * k * k * lam * lam))))) END, 6) AS ks_p_value
    FROM l)"""


def ledger_counts(origin: str, tx: str) -> str:
    frame = "OVER (PARTITION BY account ORDER BY ledger_index RANGE BETWEEN {} PRECEDING AND CURRENT ROW)"
    return f"""
    SELECT DISTINCT account, ledger_index,
      count(*) {frame.format(4)} AS tx_count_last_5_ledgers,
      count(*) {frame.format(19)} AS tx_count_last_20_ledgers, '{origin}' AS origin
    FROM ({tx})"""


def bursts(kind: str, slide: int, steps: list[int]) -> str:
    """Counts per account and hour; a row is in the window it falls in and in earlier ones."""
    us = slide * MINUTE
    return f"""
    SELECT account, '{kind}' AS kind, CAST(s AS BIGINT) AS start_us, CAST(s + {60 * MINUTE} AS BIGINT) AS end_us,
      count(*) AS n, round(sum(amount_value), 6) AS volume
    FROM (SELECT account, amount_value, (epoch_us(close_time) // {us} - k) * {us} AS s
          FROM ({EVENTS_TX}), (SELECT unnest({steps}) AS k)) GROUP BY account, s"""


LABELLED = """
SELECT CAST(d.doc_id AS VARCHAR) AS hash, d.source AS account, CAST(NULL AS VARCHAR) AS destination,
  d.doc_id AS ledger_index, TIMESTAMP '2024-01-01' AS close_time, CAST(d.n_chars AS DOUBLE) AS amount_value,
  d.text AS memo_text, l.toxic AS label
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""


def asof(origin: str, tx: str) -> str:
    """Average-tie rank among the account's rows so far, over their number."""
    numbered = f"SELECT *, row_number() OVER (ORDER BY account, ledger_index, close_time, hash) AS r FROM ({tx})"
    return f"""
    SELECT '{origin}' AS origin, any_value(a.hash) AS hash,
      round((count(*) FILTER (WHERE b.amount_value < a.amount_value)
        + (count(*) FILTER (WHERE b.amount_value = a.amount_value) + 1) / 2.0) / count(*), 6) AS percentile
    FROM ({numbered}) a JOIN ({numbered}) b ON a.account = b.account AND b.r <= a.r GROUP BY a.r"""


AMOUNT_CELLS = f"""
c AS (SELECT hash, account, CASE WHEN amount_value > 0 THEN CAST(floor(log2(amount_value) * 32) AS INTEGER)
        ELSE -1048576 END AS cell FROM ({EVENTS_TX})),
g AS (SELECT account, cell, count(*) AS n FROM c GROUP BY account, cell),
u AS (SELECT *, sum(n) OVER (PARTITION BY account ORDER BY cell) - n AS below,
        sum(n) OVER (PARTITION BY account) AS total FROM g)"""


def build_sql() -> dict[str, str]:
    one = feature_sql
    norm = f"WITH {NORMALISED} SELECT {NORM_OUT} FROM norm"
    kept = 'account IS NOT NULL AND "timestamp" IS NOT NULL'
    return {
        "scan_transactions": f"SELECT {TX_OUT} FROM ({EVENTS_TX})",
        "scan_oldest_n": f"SELECT {TX_OUT} FROM ({ORDERS_TX}) "
        "ORDER BY ledger_index, close_time, hash LIMIT 5000",
        "scan_newest_n": f"SELECT {TX_OUT} FROM ({ORDERS_TX}) "
        "ORDER BY ledger_index DESC, close_time DESC, hash DESC LIMIT 5000",
        "src_csv_normalize": norm,
        "src_json_normalize": norm,
        "norm_amount": f"WITH {NORMALISED} SELECT h3 AS id, round(amount_xrp, 8) AS value, currency, issuer FROM norm",
        "norm_amount_typed": """
            SELECT 'typed' AS origin, 's' || event_id AS id, round(value * 1000.5::DOUBLE / 1000000, 10) AS value,
              event_id AS ledger_index, event_id % 7 AS fee, '' AS rejects FROM events
            UNION ALL
            SELECT 'json', 's' || event_id, round(CASE event_id % 4 WHEN 0 THEN trunc(value * 1000) / 1000000
                WHEN 1 THEN CAST(printf('%.2f', value) AS DOUBLE) / 1000000 END, 10),
              event_id, event_id % 7, CASE WHEN event_id % 4 >= 2 THEN 'amount' ELSE '' END FROM events""",
        "norm_timestamp": f'WITH {NORMALISED} SELECT h3 AS id, CAST(epoch_us("timestamp") AS BIGINT) AS time_us FROM norm',
        "norm_aliases": f"WITH {NORMALISED} SELECT tx_hash, tx_type, account, destination, fee, ledger_index FROM norm",
        "normalize_all": norm,
        "normalize_filter": f"{norm} WHERE {kept}",
        "profile_load": f"""WITH {NORMALISED}
            SELECT (SELECT count(*) FROM norm) AS raw_rows, CAST(15 AS BIGINT) AS raw_columns, count(*) AS kept_rows,
              CAST(epoch_us(min("timestamp")) AS BIGINT) AS first_us,
              CAST(epoch_us(max("timestamp")) AS BIGINT) AS last_us, count(DISTINCT account) AS accounts
            FROM norm WHERE {kept}""",
        "profile_types": f"WITH {NORMALISED} SELECT tx_type, count(*) AS n FROM norm WHERE {kept} GROUP BY tx_type",
        "unify_schema": f"""WITH {NORMALISED}
            SELECT account, ledger_index, CAST(epoch_us("timestamp") AS BIGINT) AS close_us, tx_hash AS hash,
              round(coalesce(amount_xrp, 0.0), 8) AS amount_value, currency, CAST(fee AS DOUBLE) AS fee,
              coalesce(destination, '') AS destination, tx_type AS transaction_type, true AS success,
              '' AS memo_text, 'raw' AS origin FROM norm WHERE {kept}
            UNION ALL
            SELECT account, ledger_index, CAST(epoch_us(close_time) AS BIGINT), hash, round(amount_value, 8), currency,
              fee, destination, transaction_type, success, memo_text, 'table' FROM ({EVENTS_TX})""",
        "feat_size_percentile": one(["tx_size_percentile_local"]),
        "feat_is_large": one(["is_large_tx"]),
        "feat_volume_5m": one(["total_volume_5m"]),
        "feat_volume_spike": one(["volume_spike_ratio"]),
        "feat_fee_rate": one(["fee_rate"]),
        "feat_tx_count_5m": one(["rolling_tx_count_5m", "tx_per_minute"]),
        "feat_rate_zscore": one(["tx_rate_z_score"]),
        "feat_rate_mad_z": one(["tx_rate_mad_z"]),
        "feat_memo_entropy": f"""
            SELECT origin, id, sub, round(CASE WHEN text = '' THEN 0.0 ELSE {ENTROPY.format(text="text")} END, 6)
              AS memo_entropy
            FROM (SELECT 'documents' AS origin, doc_id AS id, CAST(0 AS BIGINT) AS sub, text FROM documents
                  UNION ALL SELECT 'conversations', conv_id, turn, text FROM conversations)""",
        "feat_memo_len_url": """
            SELECT page_id, CAST(length(url) AS DOUBLE) AS url_length,
              CAST(regexp_matches(url, '(?i)(https?://|www\\.)') AS INTEGER) AS url_has_url,
              CAST(length(html) AS DOUBLE) AS html_length,
              CAST(regexp_matches(html, '(?i)(https?://|www\\.)') AS INTEGER) AS html_has_url FROM pages""",
        "feat_duplicate_memo": """
            SELECT CAST(doc_id AS VARCHAR) AS hash, CAST(row_number() OVER
              (PARTITION BY source, text ORDER BY doc_id) - 1 AS DOUBLE) AS duplicate_memo_count FROM documents""",
        "feat_dest": one(["dest_concentration", "unique_dest_ratio"]),
        "feat_cancel_ratio": one(["offer_cancel_ratio"]),
        "feat_failed_ratio": one(["failed_tx_ratio"]),
        "feat_dormancy": one(["dormancy_gap"]),
        "feat_tx_count_ledgers": ledger_counts("events", EVENTS_TX)
        + " UNION ALL "
        + ledger_counts("orders", ORDERS_TX),
        "features_all": one(ALL),
        "features_ties": one(ALL, ORDERS_TX),
        "features_positional": one(ALL, ORDERS_TX, positional=True),
        "features_hot_accounts": one(ALL),
        "features_hot_ties": one(ALL, ORDERS_TX),
        "feat_size_percentile_asof": " UNION ALL ".join(
            asof(n, tx) for n, tx in (("events", EVENTS_TX), ("orders", ORDERS_TX), ("lineitem", LINES_TX))
        ),
        "features_asof": f"""WITH {WEEK}, p AS ({asof("events", EVENTS_TX)})
            SELECT hash, percentile AS tx_size_percentile_local, CAST(percentile >= 0.95 AS INTEGER) AS is_large_tx,
              {rounded("tx_rate_z_score")}, {rounded("duplicate_memo_count")} FROM f JOIN p USING (hash)""",
        "stream_amount_rank": f"""WITH {AMOUNT_CELLS}
            SELECT hash, round((below + (n + 1) / 2.0) / total, 6) AS tx_size_percentile_local
            FROM c JOIN u USING (account, cell)""",
        "features_dense": f"WITH {features(LINES_TX, 4000 * 24 * 60)} "
        f"SELECT hash, {', '.join(rounded(c, 4) for c in ALL)} FROM f",
        "topk_volume_spike": f"""WITH {WEEK}
            SELECT hash, account, ledger_index, round(total_volume_5m, 6) AS total_volume_5m,
              round(volume_spike_ratio, 6) AS volume_spike_ratio FROM f
            ORDER BY round(f.volume_spike_ratio, 6) DESC, hash LIMIT 100""",
        "dq_nan_inf": "SELECT count(*) AS feature_rows, CAST(0 AS BIGINT) AS nan_count, "
        "CAST(0 AS BIGINT) AS inf_count FROM events",
        "temporal_split": cut(
            "SELECT hash, CASE WHEN rn < floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM o"
        ),
        "split_profile": cut(
            "SELECT CASE WHEN rn < floor(n * 0.8) THEN 'train' ELSE 'test' END AS split, count(*) AS n, "
            "min(ledger_index) AS first_ledger, max(ledger_index) AS last_ledger FROM o GROUP BY 1"
        ),
        "ts_folds": cut(
            f""", g AS (SELECT *, {SEGMENT} AS segment FROM o)
            SELECT CAST(fold AS INTEGER) AS fold, CASE WHEN segment = fold THEN 'test' ELSE 'train' END AS side,
              count(*) AS n, min(ledger_index) AS first_ledger, max(ledger_index) AS last_ledger
            FROM g, (SELECT unnest([1, 2, 3, 4, 5]) AS fold) WHERE segment <= fold GROUP BY 1, 2"""
        ),
        "ts_fold_rows": cut(f"SELECT hash, {SEGMENT} AS segment FROM o"),
        "feature_vector": f"WITH {WEEK} SELECT hash, 18 AS width, "
        + ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS x{i}" for i, c in enumerate(FEATURE_COLUMNS))
        + " FROM f",
        "split_xy": f"""WITH tx AS ({LABELLED})
            SELECT hash, round((rank() OVER (PARTITION BY account ORDER BY amount_value)
                + (count(*) OVER (PARTITION BY account, amount_value) - 1) / 2.0)
                / count(*) OVER (PARTITION BY account), 6) AS tx_size_percentile_local,
              CAST(length(memo_text) AS DOUBLE) AS memo_length,
              CAST(row_number() OVER (PARTITION BY account, memo_text ORDER BY ledger_index, hash) - 1 AS DOUBLE)
                AS duplicate_memo_count, CAST(label AS INTEGER) AS label FROM tx""",
        "stratified_split": """
            WITH d AS (SELECT doc_id, toxic,
                CAST('0x' || substr(md5('42:' || doc_id), 1, 13) AS BIGINT) AS draw FROM labels),
            c AS (SELECT toxic, count(*) AS n, sum(count(*)) OVER () AS total FROM d GROUP BY toxic),
            w AS (SELECT *, ceil(total * 0.2) AS wanted, ceil(total * 0.2) * n / total AS exact FROM c),
            q AS (SELECT *, floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, toxic)
                  <= wanted - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS take FROM w)
            SELECT doc_id, d.toxic, CASE WHEN row_number() OVER
                (PARTITION BY d.toxic ORDER BY draw, CAST(doc_id AS VARCHAR)) <= take THEN 'test' ELSE 'train' END AS split
            FROM d JOIN q ON d.toxic = q.toxic""",
        "stratified_customers": """
            WITH d AS (SELECT o_orderkey, o_custkey,
                CAST('0x' || substr(md5('42:' || o_orderkey), 1, 13) AS BIGINT) AS draw FROM orders),
            c AS (SELECT o_custkey, count(*) AS n, sum(count(*)) OVER () AS total FROM d GROUP BY o_custkey),
            w AS (SELECT *, ceil(total * 0.2) AS wanted, ceil(total * 0.2) * n / total AS exact FROM c),
            q AS (SELECT *, floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, o_custkey)
                  <= wanted - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS take FROM w)
            SELECT o_orderkey, d.o_custkey, CASE WHEN row_number() OVER
                (PARTITION BY d.o_custkey ORDER BY draw, CAST(o_orderkey AS VARCHAR)) <= take THEN 'test' ELSE 'train' END AS split
            FROM d JOIN q ON d.o_custkey = q.o_custkey""",
        "robust_scale": f"""WITH {WEEK}, q AS (SELECT {", ".join(a for _, a in _SCALE)} FROM f)
            SELECT hash, {", ".join(e for e, _ in _SCALE)} FROM f, q""",
        "exact_quantiles": " UNION ALL ".join(
            f"SELECT '{c}' AS name, CAST({p} AS DOUBLE) AS p, round(quantile_cont({c}, {p}), 6) AS value FROM lineitem"
            for c in ("l_extendedprice", "l_quantity")
            for p in (0.0, 0.25, 0.5, 0.95, 1.0)
        ),
        "tukey_fence": fence("lineitem", "l_extendedprice") + " UNION ALL " + fence("events", "value"),
        "ks_two_sample": ks(
            "events",
            "SELECT value AS x FROM events WHERE ts < TIMESTAMP '2024-01-20'",
            "SELECT value AS x FROM events WHERE ts >= TIMESTAMP '2024-01-20'",
        )
        + " UNION ALL "
        + ks(
            "orders",
            "SELECT o_totalprice AS x FROM orders WHERE o_orderstatus = 'F'",
            "SELECT o_totalprice AS x FROM orders WHERE o_orderstatus = 'O'",
        ),
        # Paths inside the band, line by line: points (i, j) reached from (i - 1, j) or (i, j - 1).
        "ks_exact": """
            WITH RECURSIVE v AS (SELECT s_acctbal AS x, CAST(s_nationkey < 12 AS INTEGER) AS a FROM supplier),
            t AS (SELECT sum(a)::BIGINT AS n, (count(*) - sum(a))::BIGINT AS m FROM v),
            r AS (SELECT max(abs(ra / n - rb / m)) AS d FROM (SELECT sum(a) OVER w AS ra, sum(1 - a) OVER w AS rb FROM
                  v WINDOW w AS (ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), t),
            k AS (SELECT n, m, d, round(d * n * m) AS h FROM t, r),
            line AS (
              SELECT CAST(0 AS BIGINT) AS i, list_transform(range(m + 1), lambda j:
                CASE WHEN j * n < h THEN 1::DOUBLE ELSE 0 END) AS c, n, m, h FROM k
              UNION ALL
              SELECT i + 1, list_transform(range(m + 1), lambda j: CASE WHEN abs((i + 1) * m - j * n) < h THEN
                list_sum(list_transform(range(j + 1), lambda q:
                  CASE WHEN abs((i + 1) * m - q * n) < h THEN c[q + 1] ELSE 0 END)) ELSE 0 END), n, m, h
              FROM line WHERE i < n),
            total AS (SELECT list_product(list_transform(range(1, n + 1), lambda q: (m + q) / q::DOUBLE)) AS paths FROM t)
            SELECT k.n AS n_a, k.m AS n_b, round(d, 6) AS ks_stat, round(1 - c[line.m + 1] / paths, 6) AS ks_p_value
            FROM line, k, total WHERE i = line.n""",
        "score_separation": "SELECT round(quantile_cont(value, 0.95) - quantile_cont(value, 0.5), 6) "
        "AS score_separation, round(avg(value), 6) AS score_mean, round(stddev_pop(value), 6) AS score_std FROM events",
        "cv_summary": cut(
            f""", g AS (SELECT {SEGMENT} AS segment, amount_value FROM o),
            x AS (SELECT segment, avg(CAST(amount_value > 400000 AS INTEGER)) AS c,
                    avg(CAST(amount_value > 450000 AS INTEGER)) AS r FROM g WHERE segment > 0 GROUP BY segment)
            SELECT round(avg(c), 4) AS mean_contamination, round(stddev_pop(c), 4) AS std_contamination,
              round(avg(r), 4) AS mean_flag_rate, round(stddev_pop(r), 4) AS std_flag_rate,
              stddev_pop(r) < 0.025 AS stable FROM x"""
        ),
        "severity": f"SELECT event_id, {SEVERITY} AS severity FROM (SELECT event_id, value / (value + 10) AS score FROM events)",
        "risk_label": f"SELECT event_id, {LABEL} AS label FROM (SELECT event_id, value / (value + 10) AS score FROM events)",
        "signals": f"WITH {WEEK} SELECT hash, {CODES} AS codes, {TEXTS} AS texts FROM f",
        "alerts": f"{SCORED} SELECT {ALERT_COLUMNS} FROM s WHERE score > 0.7",
        "alerts_flat": ALERTS_FLAT,
        "alerts_json_roundtrip": ALERTS_FLAT,
        "alert_summary": f"{SCORED} SELECT {SEVERITY} AS severity, count(*) AS n FROM s WHERE score > 0.7 GROUP BY 1",
        "topk_flagged": f"""{SCORED} SELECT account, ledger_index, round(score, 6) AS score,
            round(tx_rate_mad_z, 6) AS tx_rate_mad_z, round(volume_spike_ratio, 6) AS volume_spike_ratio,
            round(dest_concentration, 6) AS dest_concentration, round(offer_cancel_ratio, 6) AS offer_cancel_ratio,
            round(dormancy_gap, 6) AS dormancy_gap
            FROM s WHERE score > 0.7 ORDER BY s.score DESC, account, ledger_index LIMIT 20""",
        "forest_score": f"{FOREST} SELECT hash, {FOREST_SCORES}, round(raw, 6) AS native_raw_score, "
        "round(pct, 6) AS native_score_pct, round(an, 6) AS native_anomaly_score FROM scored",
        "forest_predict": f"{FOREST} SELECT hash, CAST(flag AS INTEGER) AS prediction FROM scored",
        "forest_proba": f"{FOREST} SELECT hash, round(1 - an, 6) AS p_normal, round(an, 6) AS p_anomaly FROM scored",
        "forest_roundtrip": f"{FOREST} SELECT hash, {FOREST_SCORES}, flag AS risk_flag FROM scored",
        "forest_validation": forest_validation_sql(),
        "run_report": f"""{FOREST}, a AS ({forest_alerts("true").split("SELECT CAST(row_number()")[0].rsplit("a AS (", 1)[1].rsplit(")", 1)[0]}),
            counts AS (SELECT * FROM (VALUES
              ('transactions', 'rows', (SELECT count(*) FROM events)),
              ('transactions', 'kept_rows', (SELECT count(*) FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL)),
              ('transactions', 'first_us', (SELECT min(epoch_us(ts)) FROM events)),
              ('transactions', 'last_us', (SELECT max(epoch_us(ts)) FROM events)),
              ('transactions', 'failed_rows', (SELECT count(*) FROM events WHERE event_type = 'error')),
              ('features', 'rows', (SELECT count(*) FROM events)), ('features', 'not_numbers', 0),
              ('scored', 'rows', (SELECT count(*) FROM scored)),
              ('scored', 'flagged_rows', (SELECT count(*) FROM scored WHERE flag)),
              ('alerts', 'high', (SELECT count(*) FROM a WHERE severity = 'HIGH')),
              ('alerts', 'medium', (SELECT count(*) FROM a WHERE severity = 'MEDIUM')),
              ('alerts', 'low', (SELECT count(*) FROM a WHERE severity = 'LOW'))) AS v(part, metric, value))
            SELECT part, metric, CAST(value AS DOUBLE) AS value FROM counts
            UNION ALL SELECT 'scored', 'mean_score', round(avg(an), 6) FROM scored""",
        "score_stored": oldest_scored(),
        "alerts_of_test_rows": forest_alerts("rn >= floor(n * 0.8)"),
        "alerts_of_all_rows": forest_alerts("true"),
        "stream_normalize": f"{norm} WHERE {kept}",
        "stream_csv_normalize": f"{norm} WHERE {kept}",
        # A file is a batch; its watermark is the newest time of the files before it.
        "stream_late": """
            WITH e AS (SELECT CAST(event_id AS VARCHAR) AS hash, CAST(user_id AS VARCHAR) AS account,
                event_id % 150 AS batch, epoch_us(ts) AS us FROM events),
            m AS (SELECT batch, max(max(us)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                AS newest FROM e GROUP BY batch)
            SELECT hash, account, batch FROM e JOIN m USING (batch) WHERE us < newest - 20 * 86400000000""",
        "stream_dedup": "SELECT CAST(event_id AS VARCHAR) AS hash, CAST(user_id AS VARCHAR) AS account, "
        "event_id AS ledger_index, value AS amount_value FROM events",
        # The watermark counts in milliseconds: newest time less ten minutes.
        "stream_features": f"""WITH {WEEK} SELECT hash, account, ledger_index, {", ".join(
            rounded(c) for c in FEATURE_COLUMNS if c not in ("tx_size_percentile_local", "is_large_tx"))}
            FROM f WHERE epoch_us(close_time) <=
              ((SELECT max(epoch_us(ts)) FROM events) // 1000 - 600000) * 1000""",
        "stream_bursts": bursts("tumbling", 60, [0])
        + " UNION ALL "
        + bursts("sliding", 15, [0, 1, 2, 3]),
    }
