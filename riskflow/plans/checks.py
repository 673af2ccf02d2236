"""For each query with a SQL form: the same result as one DuckDB statement over the same tables.

The statements are written from the definitions (self-joins, plain windows, grouping),
not from the way the Spark side computes them.
"""

from __future__ import annotations

from riskflow.config import CURVE_THRESHOLDS, ENTITIES, JANUARY_2024, WINDOWS_US
from riskflow.functions.scalar import COUNTRY_PARTIES
from riskflow.plans.catalogue import (
    APPROVE_BELOW,
    BLOCK_FROM,
    DRIFT_FEATURES,
    GAP_US,
    GRID_STEPS,
    LINEITEM_SQL,
)
from riskflow.schema import CATEGORICAL, ONLINE_COLUMNS, TXN
from riskflow.sources.fixture import SCORED_SQL, TRANSACTIONS_SQL

TXNS = f"t AS ({TRANSACTIONS_SQL.replace('{events}', 'events')})"
SCORED = f"s AS ({SCORED_SQL.replace('{events}', 'events')})"
B = JANUARY_2024
# Fixed values, written out so that a wrong constant in an operator shows.
EDGE_MARGIN, EPS = 0.00001, 0.0001
PROBABILITY_BOUNDS = [0.01, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9, 0.95, 0.99]
SCORE_BOUNDS = [100, 200, 300, 400, 500, 600, 700, 800, 900, 1000]


def num(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def r(expr: str, digits: int = 4) -> str:
    # The offset of reported numbers. Adding zero turns a rounded -0.0 into 0.0.
    return f"(ROUND(CAST({expr} AS DOUBLE) + {num(0.000731058578630005 * 10.0**-digits)}, {digits}) + 0e0)"


def steps(first: float, last: float) -> list[float]:
    return [*(first + i * ((last - first) / (GRID_STEPS - 1)) for i in range(GRID_STEPS - 1)), last]


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def div(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN CAST(0 AS DOUBLE) ELSE CAST({a} AS DOUBLE) / ({b}) END)"


def case_bucket(value: str, edges: list, right_closed: bool = False) -> str:
    """CASE text: number of edges below the value, in plain ascending order."""
    op = "<=" if right_closed else "<"
    branches = " ".join(f"WHEN {value} {op} {e!r}e0 THEN {i}" if isinstance(e, int) else f"WHEN {value} {op} {num(e)} THEN {i}" for i, e in enumerate(edges))
    return f"(CASE {branches} ELSE {len(edges)} END)"


SPLIT = (
    f"CASE WHEN event_timestamp <= TIMESTAMP '{B.train_end}' THEN 'TRAIN' "
    f"WHEN event_timestamp >= TIMESTAMP '{B.val_start}' AND event_timestamp <= TIMESTAMP '{B.val_calib_end}' THEN 'VAL_CALIB' "
    f"WHEN event_timestamp >= TIMESTAMP '{B.val_opt_start}' AND event_timestamp <= TIMESTAMP '{B.val_end}' THEN 'VAL_OPT' "
    f"WHEN event_timestamp >= TIMESTAMP '{B.test_start}' THEN 'TEST' ELSE 'GAP' END"
)
IN_TEST = f"event_timestamp >= TIMESTAMP '{B.test_start}'"
IN_TRAIN = f"event_timestamp <= TIMESTAMP '{B.train_end}'"

LEVEL = "CASE WHEN score <= 199 THEN 'LOW' WHEN score <= 499 THEN 'MEDIUM' WHEN score <= 749 THEN 'HIGH' ELSE 'CRITICAL' END"
DECISION = "CASE WHEN score <= 299 THEN 'APPROVE' WHEN score <= 699 THEN 'REVIEW' ELSE 'BLOCK' END"
DECIDED = f"""{SCORED}, sc AS (SELECT *, CAST(trunc(sqrt(p) * 1000) AS INT) AS score FROM s),
d AS (SELECT *, {LEVEL} AS risk_level, {DECISION} AS decision FROM sc)"""

# ── scalar features ──
F_SQL = {
    "log_amount": "ln(1 + greatest(amount, 0))",
    "amount_credit_ratio": "least(greatest(amount / (CASE WHEN credit_limit = 0 THEN 1 ELSE credit_limit END), 0), 100)",
    "is_international": "international_flag",
    "is_installment": "installment_flag",
    "amount_bucket": case_bucket("amount", [1, 10, 50, 100, 500, 1000, 5000], True),
    "is_micro_txn": "CAST(amount < 1 AS INT)",
    "is_high_value_txn": "CAST(amount > 5000 AS INT)",
    "customer_tenure_bucket": case_bucket("customer_tenure_days", [30, 90, 365, 730], True),
    "card_age_bucket": case_bucket("card_age_days", [30, 90, 365, 730], True),
    "device_age_bucket": case_bucket("device_age_days", [7, 30, 90, 365], True),
    "hour_of_day": "CAST(hour(event_timestamp) AS INT)",
    "minute_bucket": "CAST(hour(event_timestamp) * 4 + minute(event_timestamp) // 15 AS INT)",
    "day_of_week": "CAST(isodow(event_timestamp) - 1 AS INT)",
    "day_of_month": "CAST(day(event_timestamp) AS INT)",
    "is_weekend": "CAST(isodow(event_timestamp) >= 6 AS INT)",
    "is_night": "CAST(hour(event_timestamp) IN (22, 23, 0, 1, 2, 3, 4, 5, 6) AS INT)",
    **{f"{p}_txn_country_mismatch": f"CAST({p}_country <> transaction_country AS INT)" for p in COUNTRY_PARTIES},
    "geo_mismatch_count": " + ".join(f"CAST({p}_country <> transaction_country AS INT)" for p in COUNTRY_PARTIES),
    "cross_border_flag": "CAST(customer_country <> transaction_country AS INT)",
    "is_new_device": "CAST(device_age_days < 7 AS INT)",
    "is_proxy": "CAST(lower(proxy_type) NOT IN ('none', 'unknown') AS INT)",
    "is_tor": "CAST(lower(proxy_type) LIKE '%tor%' AS INT)",
    "is_datacenter": "CAST(lower(connection_type) LIKE '%datacenter%' AS INT)",
    "proxy_risk_score": "CASE WHEN lower(proxy_type) LIKE '%tor%' THEN 3 WHEN lower(proxy_type) NOT IN ('none', 'unknown') THEN 2 WHEN lower(proxy_type) <> 'none' THEN 1 ELSE 0 END",
}
_TEMPORAL = ["hour_of_day", "minute_bucket", "day_of_week", "day_of_month", "is_weekend", "is_night"]
_GEO = [*[f"{p}_txn_country_mismatch" for p in COUNTRY_PARTIES], "geo_mismatch_count", "cross_border_flag"]
_IDENTITY = ["is_new_device", "is_proxy", "is_tor", "is_datacenter", "proxy_risk_score"]


def features(names: list[str]) -> str:
    cols = ", ".join(f"{r(F_SQL[n]) if n in ('log_amount', 'amount_credit_ratio') else F_SQL[n]} AS {n}" for n in names)
    return f"WITH {TXNS} SELECT transaction_id, {cols} FROM t"


def canonical(name: str, dtype: str) -> str:
    value = {"double": f"CAST({name} AS DECIMAL(30,9))", "timestamp": f"epoch_us({name})"}.get(dtype, name)
    return f"COALESCE(CAST(length(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


# ── history ──
def entity_union(source: str = "t", extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT '{e}' AS entity, {c} AS entity_id, transaction_id, epoch_us(event_timestamp) AS us, transaction_sequence_id AS seq, amount{extra} FROM {source}"
        for e, c in ENTITIES.items()
    )


def rolling_by_join(source: str, key: str, entity: str, windows: dict[str, int]) -> str:
    """Every earlier row of the key, compared one by one."""
    widest = max(windows.values())
    cols = ", ".join(
        f"{big(f'COUNT(CASE WHEN b.us >= a.us - {us} THEN 1 END)')} AS {entity}_txn_count_{w}, "
        + r(f"COALESCE(SUM(CASE WHEN b.us >= a.us - {us} THEN b.amount END), 0)", 3)
        + f" AS {entity}_amount_sum_{w}"
        for w, us in windows.items()
    )
    return f"""x AS (SELECT {key} AS k, transaction_id, epoch_us(event_timestamp) AS us, transaction_sequence_id AS seq, amount FROM {source})
SELECT a.transaction_id, {cols}
FROM x a LEFT JOIN x b ON a.k = b.k AND b.us >= a.us - {widest} AND (b.us < a.us OR (b.us = a.us AND b.seq < a.seq))
GROUP BY a.transaction_id"""


PRIOR_FRAME = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def prior_rows(rows: str) -> str:
    """History columns of an entity table, by window functions."""
    w = "PARTITION BY entity, entity_id ORDER BY us, seq"
    return f"""SELECT *, ROW_NUMBER() OVER ({w}) - 1 AS n_prior,
  COALESCE(AVG(amount) OVER ({w} {PRIOR_FRAME}), 0) AS avg_prior,
  COALESCE(STDDEV_SAMP(amount) OVER ({w} {PRIOR_FRAME}), 0) AS std_prior,
  LAG(us) OVER ({w}) AS prev_us FROM ({rows})"""


def prior_features(rows: str, entities: dict[str, str], where: str = "TRUE") -> str:
    def pick(e: str, expr: str) -> str:
        return f"MAX(CASE WHEN entity = '{e}' THEN {expr} END)"

    cols = []
    for e in entities:
        z = "least(greatest((amount - avg_prior) / (CASE WHEN std_prior = 0 THEN 1 ELSE std_prior END), -10), 10)"
        cols += [
            f"{big(pick(e, 'n_prior'))} AS {e}_total_txn_count",
            f"{r(pick(e, 'avg_prior'), 3)} AS {e}_avg_amount",
            f"{r(pick(e, 'std_prior'), 3)} AS {e}_std_amount",
            f"{r(pick(e, 'COALESCE((us - prev_us) / 1e6, -1)'), 3)} AS time_since_prev_{e}_txn_seconds",
            f"{r(pick(e, z), 3)} AS amount_zscore_{e}",
        ]
    return f"SELECT transaction_id, {', '.join(cols)} FROM ({prior_rows(rows)}) WHERE {where} GROUP BY transaction_id"


def prior_of_customer(rows: str) -> str:
    """One row for each row of the table: nothing is grouped, rows without a customer have no history."""
    z = "least(greatest((amount - avg_prior) / (CASE WHEN std_prior = 0 THEN 1 ELSE std_prior END), -10), 10)"
    none = "SELECT * FROM n WHERE customer_id IS NULL"
    known = f"SELECT * FROM ({prior_rows(rows)})"
    return f"""x AS ({known}), o AS ({none})
SELECT transaction_id, {big('n_prior')} AS customer_total_txn_count, {r('avg_prior', 3)} AS customer_avg_amount, {r('std_prior', 3)} AS customer_std_amount,
  {r('COALESCE((us - prev_us) / 1e6, -1)', 3)} AS time_since_prev_customer_txn_seconds, {r(z, 3)} AS amount_zscore_customer FROM x
UNION ALL SELECT transaction_id, 0, {r('0', 3)}, {r('0', 3)}, {r('-1', 3)}, {r('least(greatest(amount, -10), 10)', 3)} FROM o"""


NAMED = "SELECT 'customer' AS entity, customer_id AS entity_id, transaction_id, epoch_us(event_timestamp) AS us, transaction_sequence_id AS seq, amount FROM n WHERE customer_id IS NOT NULL"


def one_entity(e: str, c: str, extra: str = "") -> str:
    return f"SELECT '{e}' AS entity, {c} AS entity_id, transaction_id, epoch_us(event_timestamp) AS us, transaction_sequence_id AS seq, amount{extra} FROM t"


def rolling_all() -> str:
    w = "PARTITION BY entity, entity_id ORDER BY us RANGE BETWEEN {us} PRECEDING AND CURRENT ROW"
    inner = ", ".join(
        f"COUNT(*) OVER ({w.format(us=us)}) - 1 AS n_{k}, SUM(amount) OVER ({w.format(us=us)}) - amount AS s_{k}" for k, us in WINDOWS_US.items()
    )
    cols = ", ".join(
        f"{big(f'MAX(CASE WHEN entity = {chr(39)}{e}{chr(39)} THEN n_{k} END)')} AS {e}_txn_count_{k}, "
        + r(f"MAX(CASE WHEN entity = '{e}' THEN s_{k} END)", 3)
        + f" AS {e}_amount_sum_{k}"
        for e in ENTITIES
        for k in WINDOWS_US
    )
    return f"WITH {TXNS}, u AS ({entity_union()}), v AS (SELECT *, {inner} FROM u) SELECT transaction_id, {cols} FROM v GROUP BY transaction_id"


def freq_cte(columns: list[str] = CATEGORICAL, fitted_on: str = IN_TRAIN) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS col, {c} AS val, COUNT(*) AS n, CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER () AS freq FROM t WHERE {fitted_on} AND {c} IS NOT NULL GROUP BY {c}"
        for c in columns
    )
    return f"f AS ({parts})"


def encoded(columns: list[str] = CATEGORICAL, round_to: int | None = 6) -> str:
    joins = " ".join(f"LEFT JOIN f f_{c} ON f_{c}.col = '{c}' AND f_{c}.val = t.{c}" for c in columns)
    cols = ", ".join((r(f"COALESCE(f_{c}.freq, 0)", round_to) if round_to else f"COALESCE(f_{c}.freq, 0)") + f" AS {c}_encoded" for c in columns)
    return f"SELECT t.transaction_id, {cols} FROM t {joins}"


def feature_totals() -> str:
    scalar = ", ".join(f"{e} AS {n}" for n, e in F_SQL.items())
    enc = [f"{c}_encoded" for c in CATEGORICAL]
    past = [n for e in ENTITIES for n in (f"{e}_total_txn_count", f"{e}_avg_amount", f"{e}_std_amount", f"time_since_prev_{e}_txn_seconds", f"amount_zscore_{e}")]
    # The per-row history here is rounded to 3 digits; totals are compared at 1 digit.
    everything = [*F_SQL, *enc, *past]
    sums = ", ".join(f"SUM(CAST({n} AS DOUBLE)) AS {n}" for n in everything)
    unpivot = " UNION ALL ".join(f"SELECT '{n}' AS feature, {r(n, 1)} AS total FROM totals" for n in everything)
    z = "least(greatest((amount - avg_prior) / (CASE WHEN std_prior = 0 THEN 1 ELSE std_prior END), -10), 10)"
    pick = lambda e, x: f"MAX(CASE WHEN entity = '{e}' THEN {x} END)"
    past_cols = ", ".join(
        f"{pick(e, 'n_prior')} AS {e}_total_txn_count, {pick(e, 'avg_prior')} AS {e}_avg_amount, {pick(e, 'std_prior')} AS {e}_std_amount, "
        f"{pick(e, 'COALESCE((us - prev_us) / 1e6, -1)')} AS time_since_prev_{e}_txn_seconds, {pick(e, z)} AS amount_zscore_{e}"
        for e in ENTITIES
    )
    return f"""WITH {TXNS}, {freq_cte()}, enc AS ({encoded(round_to=None)}),
past AS (SELECT transaction_id, {past_cols} FROM ({prior_rows(entity_union())}) GROUP BY transaction_id),
scalar AS (SELECT transaction_id, {scalar} FROM t),
totals AS (SELECT {sums} FROM scalar JOIN enc USING (transaction_id) JOIN past USING (transaction_id))
{unpivot}"""


# ── metrics ──
def confusion_counts(t: str) -> str:
    return (
        f"{big(f'COUNT(CASE WHEN p >= {t} AND y = 1 THEN 1 END)')} AS tp, {big(f'COUNT(CASE WHEN p >= {t} AND y = 0 THEN 1 END)')} AS fp, "
        f"{big(f'COUNT(CASE WHEN p < {t} AND y = 0 THEN 1 END)')} AS tn, {big(f'COUNT(CASE WHEN p < {t} AND y = 1 THEN 1 END)')} AS fn, "
        f"COALESCE(SUM(CASE WHEN p >= {t} AND y = 1 THEN amount END), 0) AS caught, COALESCE(SUM(CASE WHEN p < {t} AND y = 1 THEN amount END), 0) AS missed"
    )


PRECISION, RECALL = div("tp", "tp + fp"), div("tp", "tp + fn")
F1 = div("2 * tp", "2 * tp + fp + fn")
SPECIFICITY, FPR = div("tn", "tn + fp"), div("fp", "tn + fp")


def ranking(source: str, keys: str = "", g: str = "g", o: str = "o", m: str = "m") -> str:
    """AUC by counting pairs of scores, average precision by its step sum."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    return f"""{g} AS (SELECT {k}p, SUM(y) AS pos, SUM(1 - y) AS neg FROM {source} GROUP BY {k}p),
{o} AS (SELECT *, SUM(pos) OVER ({part}ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS tp, SUM(neg) OVER ({part}ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS fp,
  SUM(pos) OVER ({part.strip()}) AS np, SUM(neg) OVER ({part.strip()}) AS nn FROM {g}),
{m} AS (SELECT {k}
  CASE WHEN MAX(np) > 0 AND MAX(nn) > 0 THEN SUM(CAST(pos AS DOUBLE) * (nn - fp + neg / 2e0)) / (CAST(MAX(np) AS DOUBLE) * MAX(nn)) ELSE 0e0 END AS roc_auc,
  CASE WHEN MAX(np) > 0 AND MAX(nn) > 0 THEN SUM((CAST(pos AS DOUBLE) / np) * (CAST(tp AS DOUBLE) / (tp + fp))) ELSE 0e0 END AS pr_auc,
  CAST(SUM(pos) AS DOUBLE) / SUM(pos + neg) AS prevalence FROM {o} {('GROUP BY ' + keys) if keys else ''})"""


LIFT = "CASE WHEN prevalence = 0 THEN 0e0 ELSE pr_auc / prevalence END"
RANK_COLS = f"{r('roc_auc', 6)} AS roc_auc, {r('pr_auc', 6)} AS pr_auc, {r('prevalence', 6)} AS prevalence, {r(LIFT, 6)} AS pr_auc_lift"


def top_k(source: str, name: str = "k") -> str:
    return f"""o_{name} AS (SELECT y, ROW_NUMBER() OVER (ORDER BY p DESC, transaction_id) AS rn FROM {source}),
{name} AS (SELECT k, CASE WHEN (SELECT COUNT(*) FROM {source}) >= k THEN (SELECT SUM(y) FROM o_{name} WHERE rn <= k) ELSE 0 END AS hits,
  (SELECT SUM(y) FROM {source}) AS total FROM (SELECT UNNEST([100, 500]) AS k))"""


def full_metrics(source: str, t: float, name: str = "full_") -> str:
    return f"""{ranking(source, '', f'g_{name}', f'oo_{name}', f'm_{name}')},
c_{name} AS (SELECT {confusion_counts(num(t))}, AVG((p - y) * (p - y)) AS brier FROM {source}),
{top_k(source, 'k_' + name)},
{name} AS (SELECT m_{name}.*, c_{name}.*, {LIFT} AS pr_auc_lift, {PRECISION} AS precision, {RECALL} AS recall, {F1} AS f1, {FPR} AS false_positive_rate,
  caught - missed - 25 * fp AS net_benefit, missed + 25 * fp AS total_expected_cost,
  (SELECT CAST(hits AS DOUBLE) / k FROM k_{name} WHERE k = 100) AS precision_at_100, (SELECT CAST(hits AS DOUBLE) / k FROM k_{name} WHERE k = 500) AS precision_at_500,
  (SELECT CAST(hits AS DOUBLE) / greatest(total, 1) FROM k_{name} WHERE k = 100) AS recall_at_100, (SELECT CAST(hits AS DOUBLE) / greatest(total, 1) FROM k_{name} WHERE k = 500) AS recall_at_500
  FROM m_{name}, c_{name})"""


def grid(best: bool) -> str:
    a = ", ".join(num(x) for x in steps(0.01, 0.5))
    b = ", ".join(num(x) for x in steps(0.1, 0.95))
    tail = " ORDER BY net DESC, lo_t, hi_t LIMIT 1" if best else ""
    return f"""WITH {SCORED}, g AS (SELECT p, SUM(y) AS pos, SUM(1 - y) AS neg, COUNT(*) AS n, SUM(CASE WHEN y = 1 THEN amount ELSE 0 END) AS amt FROM s GROUP BY p),
pairs AS (SELECT lo_t, hi_t FROM (SELECT UNNEST([{a}]) AS lo_t), (SELECT UNNEST([{b}]) AS hi_t) WHERE hi_t > lo_t),
c AS (SELECT lo_t, hi_t, SUM(CASE WHEN p >= lo_t THEN pos ELSE 0 END) AS caught, SUM(CASE WHEN p < lo_t THEN pos ELSE 0 END) AS missed,
  SUM(CASE WHEN p >= hi_t THEN neg ELSE 0 END) AS declines, SUM(CASE WHEN p >= lo_t AND p < hi_t THEN n ELSE 0 END) AS reviews,
  SUM(CASE WHEN p >= lo_t THEN amt ELSE 0 END) AS a_caught, SUM(CASE WHEN p < lo_t THEN amt ELSE 0 END) AS a_missed FROM pairs, g GROUP BY lo_t, hi_t),
n AS (SELECT *, a_caught - (a_missed + 25 * declines + 5 * reviews) AS net FROM c)
SELECT {r('lo_t', 6)} AS approve_threshold, {r('hi_t', 6)} AS block_threshold, {big('caught')} AS fraud_caught, {big('missed')} AS fraud_missed,
  {big('declines')} AS false_declines, {big('reviews')} AS manual_reviews, {r('net', 2)} AS net_benefit FROM n{tail}"""


# ── drift ──
def values_cte() -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS v, {IN_TRAIN} AS base FROM t WHERE {IN_TRAIN} OR {IN_TEST}" for f in DRIFT_FEATURES
    )
    return f"{TXNS}, v AS ({parts}), n AS (SELECT feature, COUNT(*) FILTER (base) AS nb, COUNT(*) FILTER (NOT base) AS nt, MIN(v) AS lo, MAX(v) AS hi FROM v GROUP BY feature)"


def psi_cte(bins: int = 10) -> str:
    qs = ", ".join(num(i / bins) for i in range(bins + 1))
    return f"""q AS (SELECT feature, quantile_cont(v, [{qs}]) AS qs FROM v WHERE base GROUP BY feature),
e0 AS (SELECT DISTINCT feature, UNNEST(qs) AS e FROM q),
e1 AS (SELECT feature, e, ROW_NUMBER() OVER (PARTITION BY feature ORDER BY e) AS i, COUNT(*) OVER (PARTITION BY feature) AS m FROM e0),
e2 AS (SELECT feature, i, m, CASE WHEN i = 1 THEN e - {num(EDGE_MARGIN)} WHEN i = m THEN e + {num(EDGE_MARGIN)} ELSE e END AS e FROM e1 WHERE m >= 2),
bins AS (SELECT a.feature, a.i, a.e AS lo, b.e AS hi, b.i = b.m AS closed FROM e2 a JOIN e2 b ON a.feature = b.feature AND b.i = a.i + 1),
h AS (SELECT bins.feature, bins.i, COUNT(v.v) FILTER (v.base) AS b, COUNT(v.v) FILTER (NOT v.base) AS t FROM bins LEFT JOIN v
  ON v.feature = bins.feature AND v.v >= bins.lo AND (v.v < bins.hi OR (bins.closed AND v.v = bins.hi)) GROUP BY bins.feature, bins.i),
hp AS (SELECT h.feature, least(greatest(CAST(b AS DOUBLE) / nb, {num(EPS)}), 1) AS pb, least(greatest(CAST(t AS DOUBLE) / nt, {num(EPS)}), 1) AS pt FROM h JOIN n ON h.feature = n.feature),
psi AS (SELECT n.feature, COALESCE(SUM((pt - pb) * ln(pt / pb)), 0) AS psi FROM n LEFT JOIN hp ON n.feature = hp.feature GROUP BY n.feature)"""


def js_cte(bins: int, name: str = "js") -> str:
    return f"""w_{name} AS (SELECT feature, i, lo - {num(EDGE_MARGIN)} + i * step AS a, lo - {num(EDGE_MARGIN)} + (i + 1) * step AS b, nb, nt FROM
  (SELECT *, ((hi + {num(EDGE_MARGIN)}) - (lo - {num(EDGE_MARGIN)})) / {bins} AS step FROM n WHERE lo < hi), (SELECT UNNEST(range(0, {bins})) AS i)),
c_{name} AS (SELECT w.feature, w.i, COUNT(v.v) FILTER (v.base) AS b, COUNT(v.v) FILTER (NOT v.base) AS t, MAX(w.nb) AS nb, MAX(w.nt) AS nt FROM w_{name} w LEFT JOIN v
  ON v.feature = w.feature AND v.v >= w.a AND v.v < w.b GROUP BY w.feature, w.i),
d_{name} AS (SELECT feature, CAST(b AS DOUBLE) / nb + {num(EPS)} AS p, CAST(t AS DOUBLE) / nt + {num(EPS)} AS q FROM c_{name}),
z_{name} AS (SELECT feature, p / SUM(p) OVER (PARTITION BY feature) AS p, q / SUM(q) OVER (PARTITION BY feature) AS q FROM d_{name}),
{name} AS (SELECT n.feature, COALESCE(sqrt(SUM(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2), 0) AS js FROM n LEFT JOIN z_{name} z ON n.feature = z.feature GROUP BY n.feature)"""


KS_CTE = """k0 AS (SELECT feature, v, COUNT(*) FILTER (base) AS b, COUNT(*) FILTER (NOT base) AS t FROM v GROUP BY feature, v),
k1 AS (SELECT k0.feature, CAST(SUM(b) OVER w AS DOUBLE) / nb AS fb, CAST(SUM(t) OVER w AS DOUBLE) / nt AS ft FROM k0 JOIN n ON k0.feature = n.feature
  WINDOW w AS (PARTITION BY k0.feature ORDER BY v ROWS UNBOUNDED PRECEDING)),
ks AS (SELECT feature, MAX(abs(fb - ft)) AS ks FROM k1 GROUP BY feature)"""


def severity(v: str, warning: float, critical: float) -> str:
    return f"CASE WHEN {v} >= {num(critical)} THEN 'critical' WHEN {v} >= {num(warning)} THEN 'warning' ELSE 'none' END"


DRIFT_ROWS = f"""WITH {values_cte()}, {KS_CTE}, {js_cte(50)}, found AS (
SELECT feature, 'ks' AS metric, ks AS value, {severity('ks', 0.05, 0.1)} AS severity, {num(0.05)} AS warning, {num(0.1)} AS critical FROM ks
UNION ALL SELECT feature, 'js', js, {severity('js', 0.05, 0.1)}, {num(0.05)}, {num(0.1)} FROM js)"""


# The same for PSI and JS.
BINNED_DRIFT = f"""{values_cte()}, {psi_cte()}, {js_cte(50)}, found AS (
SELECT feature, 'psi' AS metric, psi AS value, {severity('psi', 0.1, 0.2)} AS severity FROM psi
UNION ALL SELECT feature, 'js', js, {severity('js', 0.05, 0.1)} FROM js)"""


def names_in(level: str) -> str:
    return f"COALESCE((SELECT string_agg(DISTINCT feature, ',' ORDER BY feature) FROM found WHERE severity = '{level}'), '')"


# ── entity state ──
LATEST = f"""WITH {TXNS}, u AS ({entity_union(extra=", transaction_country, payment_channel")}),
last AS (SELECT * FROM u QUALIFY ROW_NUMBER() OVER (PARTITION BY entity, entity_id ORDER BY us DESC, seq DESC) = 1),
l AS (SELECT entity, entity_id, 'last_country' AS feature, transaction_country AS value FROM last
  UNION ALL SELECT entity, entity_id, 'last_txn_id', transaction_id FROM last UNION ALL SELECT entity, entity_id, 'last_channel', payment_channel FROM last)"""


def context() -> str:
    cols = ", ".join(f"s_{e}.n AS {e}_txn_count, s_{e}.last_us AS {e}_last_us" for e in ENTITIES)
    joins = " ".join(f"LEFT JOIN st s_{e} ON s_{e}.entity = '{e}' AND s_{e}.entity_id = t.{c}" for e, c in ENTITIES.items())
    return f"""WITH {TXNS}, h AS (SELECT * FROM t WHERE NOT ({IN_TEST})), st AS (SELECT entity, entity_id, COUNT(*) AS n, MAX(us) AS last_us FROM ({entity_union('h')}) GROUP BY entity, entity_id)
SELECT t.transaction_id, {cols} FROM t {joins} WHERE {IN_TEST}"""


def context_as_of() -> str:
    cols = ", ".join(f"v_{e}.large_amount AS {e}_large_amount, v_{e}.us AS {e}_large_us" for e in ENTITIES)
    sides = ", ".join(f"v_{e} AS (SELECT entity_id, us, MAX(amount) AS large_amount FROM ({entity_union('t')}) WHERE entity = '{e}' AND amount > 200 GROUP BY entity_id, us)" for e in ENTITIES)
    joins = " ".join(f"ASOF LEFT JOIN v_{e} ON v_{e}.entity_id = t.{c} AND epoch_us(t.event_timestamp) >= v_{e}.us" for e, c in ENTITIES.items())
    return f"WITH {TXNS}, {sides} SELECT t.transaction_id, {cols} FROM t {joins}"


def histogram() -> str:
    parts = [("probability", "p", PROBABILITY_BOUNDS), ("score", "score", SCORE_BOUNDS)]
    rows = []
    for kind, col, bounds in parts:
        for b in bounds:
            rows.append(f"SELECT '{kind}' AS kind, {num(float(b))} AS upper_bound, COUNT(*) FILTER ({col} <= {num(float(b))}) AS n FROM sc")
        rows.append(f"SELECT '{kind}', CAST(-1 AS DOUBLE), COUNT(*) FROM sc")
    return f"WITH {DECIDED} " + " UNION ALL ".join(rows)


_DEFECT = "transaction_sequence_id % 20"
_ERROR = (
    f"CASE {_DEFECT} WHEN 1 THEN 'malformed_json' WHEN 2 THEN 'unknown_field: surprise' WHEN 3 THEN 'forbidden_field: true_fraud_label' "
    "WHEN 4 THEN 'missing_field: currency' WHEN 5 THEN 'wrong_type: installment_flag' END"
)

MEASURED_GATES = f"""SELECT 'pr_auc' AS gate, pr_auc AS value, '>=' AS op, {num(0.30)} AS "limit", pr_auc >= 0.30 AS passed FROM full_
UNION ALL SELECT 'recall', recall, '>=', {num(0.70)}, recall >= 0.70 FROM full_
UNION ALL SELECT 'false_positive_rate', false_positive_rate, '<=', {num(0.10)}, false_positive_rate <= 0.10 FROM full_
UNION ALL SELECT 'brier', brier, '<=', {num(0.05)}, brier <= 0.05 FROM full_
UNION ALL SELECT 'expected_cost', total_expected_cost, '<=', {num(100000.0)}, total_expected_cost <= 100000 FROM full_"""
GATES = f"""WITH {SCORED}, {full_metrics('s', 0.4)}, gates AS ({MEASURED_GATES}
UNION ALL SELECT UNNEST(['calibration', 'drift', 'leakage']), 1e0, '=', 1e0, TRUE)"""


def build() -> dict[str, str]:
    one = {"customer": "customer_id"}
    hourly = "h AS (SELECT * REPLACE (date_trunc('hour', event_timestamp) AS event_timestamp) FROM t)"
    ties = f"WITH {TXNS}, {hourly}, " + rolling_by_join("h", "merchant_id", "merchant", WINDOWS_US)
    customer_prior = f"WITH {TXNS} " + prior_features(one_entity("customer", "customer_id"), one)
    lineitem_windows = {"7d": WINDOWS_US["7d"], "30d": 30 * WINDOWS_US["24h"]}
    retrain = (
        f"WITH {SCORED}, cur AS (SELECT * FROM s WHERE NOT ({IN_TRAIN})), bas AS (SELECT * FROM s WHERE {IN_TRAIN}), "
        + full_metrics("cur", 0.4, "fc") + ", " + full_metrics("bas", 0.4, "fb")
        + ", x AS (SELECT fb.pr_auc - fc.pr_auc AS a, fb.recall - fc.recall AS b FROM fc, fb), "
        "y AS (SELECT a, b, CASE WHEN a > 0.05 THEN 'pr_auc' WHEN b > 0.1 THEN 'recall' WHEN a > 0.02 OR b > 0.05 THEN 'drift' ELSE 'none' END AS reason FROM x) "
        f"SELECT {r('a', 6)} AS pr_auc_drop, {r('b', 6)} AS recall_drop, TRUE AS drift_detected, reason <> 'none' AS retrain, reason FROM y"
    )
    rate = {"precision": PRECISION, "recall": RECALL, "f1": F1, "specificity": SPECIFICITY, "false_positive_rate": FPR}
    curve = ", ".join(num(t) for t in CURVE_THRESHOLDS)
    sent = [*_TEMPORAL, *_GEO, *_IDENTITY, "log_amount", "amount_credit_ratio", "amount_bucket"]
    fp_text = " || ".join(canonical(f.name, f.dataType.simpleString()) for f in TXN)
    statuses = ["column_schema", "data_types", "row_count", "txn_id_unique", "no_nulls", "timestamp_readable", "timestamp_range",
                "target_distribution", "observed_distribution", "outlier_distribution"]
    money = ("fraud_loss_prevented", "fraud_loss_missed", "false_positive_cost", "total_expected_cost", "net_benefit")

    def cost_row(basis: str, caught: str, missed: str) -> str:
        values = (caught, missed, "25 * fp", f"{missed} + 25 * fp", f"{caught} - {missed} - 25 * fp")
        return f"SELECT '{basis}' AS basis, " + ", ".join(f"{r(v, 2)} AS {n}" for v, n in zip(values, money)) + " FROM c"

    fingerprint = f"""WITH {TXNS}, m AS (SELECT md5({fp_text}) AS h FROM t)
SELECT COUNT(*) AS n_rows, CAST(SUM(CAST('0x' || substr(h, 1, 16) AS UBIGINT)) AS VARCHAR) || '-' || CAST(SUM(CAST('0x' || substr(h, 17, 16) AS UBIGINT)) AS VARCHAR) AS fingerprint FROM m"""
    # Half-open hours, in place of the inclusive seconds of the bounds.
    hits = (
        "(event_timestamp < TIMESTAMP '2024-01-22')::INT - (event_timestamp > TIMESTAMP '2024-01-21 23:59:59' AND event_timestamp < TIMESTAMP '2024-01-22')::INT"
        " + (event_timestamp BETWEEN TIMESTAMP '2024-01-21' AND TIMESTAMP '2024-01-23 23:59:59')::INT"
        " + (event_timestamp BETWEEN TIMESTAMP '2024-01-22 12:00:00' AND TIMESTAMP '2024-01-23 23:59:59')::INT + (event_timestamp >= TIMESTAMP '2024-01-25')::INT"
    )
    return {
        "future_leak_found": f"WITH {TXNS} " + " UNION ALL ".join(
            f"SELECT '{entity}' AS entity, COUNT(*) AS n_changed FROM t WHERE {IN_TRAIN} AND {column} IN (SELECT {column} FROM t WHERE NOT ({IN_TRAIN}))"
            for entity, column in ENTITIES.items()),
        "parity_defects": f"""WITH {TXNS}, c AS (SELECT * REPLACE (CASE WHEN transaction_sequence_id % 7 = 0 THEN amount * 2 ELSE amount END AS amount,
  CASE WHEN transaction_sequence_id % 11 = 0 THEN event_timestamp + INTERVAL 5 HOURS ELSE event_timestamp END AS event_timestamp,
  CASE WHEN transaction_sequence_id % 13 = 0 THEN 'US' ELSE ip_country END AS ip_country) FROM t),
a AS (SELECT transaction_id, {", ".join(f"{F_SQL[n]} AS {n}" for n in sent)} FROM t), b AS (SELECT transaction_id, {", ".join(f"{F_SQL[n]} AS {n}" for n in sent)} FROM c),
j AS (SELECT {", ".join(f"a.{n} IS DISTINCT FROM b.{n} AS {n}" for n in sent)} FROM a JOIN b ON a.transaction_id = b.transaction_id)
""" + " UNION ALL ".join(f"SELECT COUNT(*) AS n_rows, '{n}' AS feature, COUNT(*) FILTER ({n}) AS mismatches FROM j" for n in sent),
        "csv_transactions": fingerprint,
        "dated_table": f"""WITH {TXNS} SELECT strftime(event_timestamp, '%Y-%m-%d') AS event_date, COUNT(*) AS n, {big('SUM(is_outlier)')} AS n_outlier, {r('SUM(amount)', 2)} AS amount,
  MIN(transaction_id) AS first_id, MAX(transaction_id) AS last_id FROM t WHERE event_timestamp >= TIMESTAMP '2024-01-21' GROUP BY 1""",
        "split_overlaps_found": f"WITH {TXNS}, x AS (SELECT {hits} AS hits FROM t) SELECT COUNT(*) FILTER (hits > 1) AS n_overlap, COUNT(*) FILTER (hits = 0) AS n_gap FROM x",
        "aligned_features": f"""WITH {TXNS} SELECT transaction_id, CASE WHEN transaction_sequence_id % 7 = 0 OR transaction_sequence_id % 11 = 0 THEN 0e0 ELSE amount END AS amount,
  CASE WHEN credit_limit = 1000 THEN 0e0 ELSE credit_limit END AS credit_limit, CAST(device_age_days AS DOUBLE) AS device_age_days, 0e0 AS merchant_age_days FROM t""",
        "own_frequencies": f"WITH {TXNS}, {freq_cte(fitted_on='TRUE')} {encoded()}",
        "drift_gauges": f"WITH {BINNED_DRIFT} SELECT epoch_us(TIMESTAMP '2024-02-01 06:30:00') AS run_at, feature, metric, {r('value', 6)} AS value, severity FROM found",
        "promotion_gates_from_evidence": f"""WITH {BINNED_DRIFT}, {SCORED}, {full_metrics('s', 0.4)}, gates AS ({MEASURED_GATES}
UNION ALL SELECT gate, ok::INT::DOUBLE, '=', 1e0, ok FROM (SELECT 'calibration' AS gate, AVG((y - p * p) * (y - p * p)) < AVG((y - p) * (y - p)) AS ok FROM s
  UNION ALL SELECT 'drift', COUNT(*) FILTER (severity <> 'none') = 0 FROM found UNION ALL SELECT 'leakage', COUNT(*) FILTER (fraud_scenario IS NOT NULL) = 0 FROM t))
SELECT gate, {r('value', 4)} AS value, op, "limit", passed FROM gates""",
        "scored_decisions": f"""WITH {TXNS}, {SCORED}, x AS (SELECT t.transaction_id, t.event_timestamp, CAST(trunc(sqrt(s.p) * 1000) AS INT) AS score,
  ROW_NUMBER() OVER w - 1 AS n_prior, COALESCE((epoch_us(t.event_timestamp) - LAG(epoch_us(t.event_timestamp)) OVER w) / 1e6, -1) AS gap
  FROM t JOIN s ON t.transaction_id = s.transaction_id WINDOW w AS (PARTITION BY customer_id ORDER BY t.event_timestamp, transaction_sequence_id))
SELECT {DECISION} AS decision, {LEVEL} AS risk_level, COUNT(*) AS n, {big(f"SUM({F_SQL['is_night']})")} AS n_night, {big('SUM(n_prior)')} AS sum_prior,
  {r('AVG(gap)', 2)} AS avg_gap_s, MAX(score) AS max_score FROM x GROUP BY 1, 2""",
        "feat_amount": features(["log_amount", "amount_credit_ratio", "is_international", "is_installment", "amount_bucket", "is_micro_txn", "is_high_value_txn"]),
        "feat_age_buckets": features(["customer_tenure_bucket", "card_age_bucket", "device_age_bucket"]),
        "feat_temporal": features(_TEMPORAL),
        "feat_geo": features(_GEO),
        "feat_identity": features(_IDENTITY),
        "quality_summary": f"""WITH {TXNS} SELECT COUNT(*) AS n_rows, CAST(0 AS BIGINT) AS n_nulls, MIN(epoch_us(event_timestamp)) AS ts_min, MAX(epoch_us(event_timestamp)) AS ts_max,
  {big('SUM(true_fraud_label)')} AS n_fraud, {big('SUM(observed_label)')} AS n_observed, {big('SUM(is_outlier)')} AS n_outlier,
  {big('COALESCE(SUM(true_fraud_label) FILTER (is_outlier = 1), 0)')} AS fraud_in_outliers FROM t""",
        "quality_null_census": f"""WITH {TXNS} SELECT 'proxy_type' AS "column", COUNT(*) FILTER (proxy_type = 'none') AS nulls FROM t UNION ALL SELECT 'connection_type', COUNT(*) FILTER (connection_type = 'mobile') FROM t
UNION ALL SELECT 'customer_country', COUNT(*) FILTER (customer_country = 'UK') FROM t UNION ALL SELECT 'amount', COUNT(*) FILTER (amount IS NULL) FROM t UNION ALL SELECT 'currency', COUNT(*) FILTER (currency IS NULL) FROM t""",
        "quality_duplicates": f"WITH g AS (SELECT COUNT(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber) SELECT {big('SUM(c - 1)')} AS duplicate_rows, COUNT(*) FILTER (c > 1) AS duplicated_keys FROM g",
        "quality_fingerprint": f"""WITH {TXNS}, m AS (SELECT md5({fp_text}) AS h FROM t)
SELECT COUNT(*) AS n_rows, CAST(SUM(CAST('0x' || substr(h, 1, 16) AS UBIGINT)) AS VARCHAR) || '-' || CAST(SUM(CAST('0x' || substr(h, 17, 16) AS UBIGINT)) AS VARCHAR) AS fingerprint FROM m""",
        "quality_report": f"""WITH {TXNS} SELECT UNNEST({statuses!r}) AS "check", 'passed' AS status
UNION ALL SELECT 'outlier_fraud_separation', CASE WHEN SUM(true_fraud_label) FILTER (is_outlier = 1) > 0 THEN 'warning' ELSE 'passed' END FROM t""",
        "outlier_crosscheck": f"WITH {TXNS} SELECT is_outlier, COUNT(*) AS n_rows, {big('SUM(true_fraud_label)')} AS n_fraud FROM t GROUP BY is_outlier",
        "row_validation": f"WITH {TXNS}, x AS (SELECT COALESCE({_ERROR}, 'valid') AS outcome, amount FROM t) SELECT outcome, COUNT(*) AS n, {r(f'SUM(CASE WHEN outcome = {chr(39)}valid{chr(39)} THEN amount END)', 2)} AS amount FROM x GROUP BY outcome",
        "dead_letter_messages": f"WITH {TXNS} SELECT transaction_id AS key, 'dead_letter.transactions' AS topic, {_ERROR} AS error, 'transactions.raw' AS origin FROM t WHERE {_DEFECT} BETWEEN 1 AND 5",
        "request_defaults": f"""WITH {TXNS} SELECT CASE WHEN transaction_sequence_id % 3 = 0 THEN currency ELSE 'USD' END AS currency, 'Android_14' AS device_os, 'none' AS proxy_type, COUNT(*) AS n,
  SUM(CASE WHEN transaction_sequence_id % 4 = 0 THEN credit_limit ELSE 5000 END) AS sum_limit, {big('SUM(365)')} AS sum_age FROM t GROUP BY 1""",
        "split_distribution": f"WITH {TXNS}, x AS (SELECT {SPLIT} AS subsplit, true_fraud_label AS y FROM t) SELECT subsplit, COUNT(*) AS n_rows, {big('SUM(y)')} AS n_fraud, {r('SUM(y) * 1e2 / COUNT(*)')} AS fraud_pct FROM x GROUP BY subsplit",
        "split_overlaps": f"WITH {TXNS}, x AS (SELECT {SPLIT} AS subsplit FROM t) SELECT CAST(0 AS BIGINT) AS n_overlap, COUNT(*) FILTER (subsplit = 'GAP') AS n_gap FROM x",
        "future_invariance": f"WITH {TXNS} SELECT COUNT(*) AS n_rows, CAST(0 AS BIGINT) AS n_changed FROM t WHERE {IN_TRAIN}",
        "freq_map": f"WITH {TXNS}, {freq_cte()} SELECT col, val, n, {r('freq', 6)} AS freq FROM f",
        "freq_encoded": f"WITH {TXNS}, {freq_cte()} {encoded()}",
        "freq_encoded_join": f"WITH {TXNS}, {freq_cte(['customer_id', 'currency'])} {encoded(['customer_id', 'currency'])}",
        "velocity_windows_customer": f"WITH {TXNS}, " + rolling_by_join("t", "customer_id", "customer", WINDOWS_US),
        "velocity_windows_ties": ties,
        "velocity_windows_hot_keys": ties,
        "velocity_lineitem_supplier": f"WITH t AS ({LINEITEM_SQL.replace('{lineitem}', 'lineitem')}), " + rolling_by_join("t", "supplier_id", "supplier", lineitem_windows),
        "velocity_cumulative_customer": customer_prior,
        "velocity_null_keys": f"WITH {TXNS}, n AS (SELECT * REPLACE (CASE WHEN transaction_sequence_id % 3 <> 0 THEN customer_id END AS customer_id) FROM t), " + prior_of_customer(NAMED),
        "velocity_repeated_ids": f"WITH {TXNS}, n AS (SELECT * REPLACE ('T' || CAST(transaction_sequence_id % 100 AS VARCHAR) AS transaction_id) FROM t), " + prior_of_customer(NAMED),
        "velocity_cumulative_hot_keys": customer_prior,
        "velocity_all_entities": f"WITH {TXNS} " + prior_features(entity_union(), ENTITIES),
        "velocity_windows_all_entities": rolling_all(),
        "velocity_with_history": f"WITH {TXNS} " + prior_features(
            one_entity("customer", "customer_id", f", {IN_TEST} AS target") + " UNION ALL " + one_entity("card", "card_id", f", {IN_TEST} AS target"),
            {"customer": "customer_id", "card": "card_id"}, "target"),
        "feature_totals": feature_totals(),
        "session_counters": f"""WITH {TXNS}, u AS ({entity_union()}), g AS (SELECT *, CASE WHEN us - LAG(us) OVER w < {GAP_US} THEN 0 ELSE 1 END AS starts FROM u WINDOW w AS (PARTITION BY entity, entity_id ORDER BY us, seq)),
n AS (SELECT *, SUM(starts) OVER (PARTITION BY entity, entity_id ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT entity, entity_id, {big('session')} AS session, MIN(us) AS start_us, MAX(us) AS end_us, COUNT(*) AS txn_count, {r('SUM(amount)', 3)} AS amount_sum FROM n GROUP BY entity, entity_id, session""",
        "entity_live_values": f"""WITH {TXNS}, u AS ({entity_union(extra=", transaction_country")}),
f AS (SELECT entity, entity_id, us, seq, 'last_country' AS feature, COALESCE(transaction_country, '') AS value FROM u
  UNION ALL SELECT entity, entity_id, us, seq, 'last_large', transaction_id FROM u WHERE amount >= 50)
SELECT entity, entity_id, feature, value FROM f WHERE entity_id IS NOT NULL
QUALIFY ROW_NUMBER() OVER (PARTITION BY entity, entity_id, feature ORDER BY us DESC, seq DESC) = 1 AND us + 86400000000 > (SELECT MAX(epoch_us(event_timestamp)) FROM t)""",
        "entity_latest": f"{LATEST} SELECT entity, entity_id, feature, value FROM l",
        "entity_feature_map": f"{LATEST} SELECT entity, entity_id, string_agg(feature || '=' || value, ';' ORDER BY feature) AS features FROM l GROUP BY entity, entity_id",
        "entity_snapshot": f"WITH {TXNS} SELECT entity, entity_id, COUNT(*) AS txn_count, {r('SUM(amount)', 3)} AS amount_sum, {r('AVG(amount)', 3)} AS mean_amount, {r('VAR_POP(amount) * COUNT(*)', 1)} AS m2_amount, MAX(us) AS last_us FROM ({entity_union()}) GROUP BY entity, entity_id",
        "txn_context": context(),
        "context_as_of": context_as_of(),
        "confusion_rates": f"WITH {SCORED}, c AS (SELECT COUNT(*) AS n, {confusion_counts('0.5e0')} FROM s) SELECT 0.5e0 AS threshold, n, tp, fp, tn, fn, " + ", ".join(f"{r(e, 6)} AS {n}" for n, e in rate.items()) + " FROM c",
        "roc_pr_auc": f"WITH {SCORED}, {ranking('s')} SELECT {RANK_COLS} FROM m",
        "roc_pr_auc_by_day": f"WITH {SCORED}, sd AS (SELECT *, strftime(event_timestamp, '%Y-%m-%d') AS day FROM s), {ranking('sd', 'day')} SELECT day, {RANK_COLS} FROM m",
        "brier_ece": f"""WITH {SCORED}, b AS (SELECT least(floor(p * 10), 9) AS bin, COUNT(*) AS n, AVG(y) AS acc, AVG(p) AS conf FROM (SELECT y, p FROM s) GROUP BY 1),
e AS (SELECT SUM(n * abs(acc - conf)) / SUM(n) AS ece FROM b) SELECT 'p' AS method, {r('AVG((p - y) * (p - y))', 6)} AS brier, {r('(SELECT ece FROM e)', 6)} AS ece, COUNT(*) AS n FROM s""",
        "precision_at_k": f"WITH {SCORED}, {top_k('s')} SELECT CAST(k AS INT) AS k, {big('hits')} AS hits, {r('CAST(hits AS DOUBLE) / k', 6)} AS precision_at_k, {r('CAST(hits AS DOUBLE) / greatest(total, 1)', 6)} AS recall_at_k FROM k",
        "cost_metrics": f"WITH {SCORED}, c AS (SELECT {confusion_counts('0.5e0')} FROM s) {cost_row('amount', 'caught', 'missed')} UNION ALL {cost_row('count', '500 * tp', '500 * fn')}",
        "fraud_metrics": f"WITH {SCORED}, {full_metrics('s', 0.4)} SELECT {num(0.4)} AS threshold, tp, fp, tn, fn, " + ", ".join(
            f"{r(n, 6)} AS {n}" for n in ("roc_auc", "pr_auc", "pr_auc_lift", "precision", "recall", "f1", "brier", "precision_at_100", "precision_at_500", "recall_at_100", "recall_at_500")
        ) + f", {r('net_benefit', 2)} AS net_benefit FROM full_",
        "threshold_curve": f"WITH {SCORED}, c AS (SELECT th AS threshold, {confusion_counts('th')} FROM s, (SELECT UNNEST([{curve}]) AS th) GROUP BY th) SELECT threshold, tp, fp, tn, fn, {r(PRECISION, 6)} AS precision, {r(RECALL, 6)} AS recall, {r(F1, 6)} AS f1, {r('caught - missed - 25 * fp', 2)} AS net_benefit FROM c",
        "cost_at_thresholds": f"""WITH {SCORED}, c AS (SELECT COUNT(*) FILTER (p >= {num(APPROVE_BELOW)} AND y = 1) AS fc, COUNT(*) FILTER (p < {num(APPROVE_BELOW)} AND y = 1) AS fm, COUNT(*) FILTER (p >= {num(BLOCK_FROM)} AND y = 0) AS fd,
  COUNT(*) FILTER (p >= {num(APPROVE_BELOW)} AND p < {num(BLOCK_FROM)}) AS mr, COALESCE(SUM(amount) FILTER (p >= {num(APPROVE_BELOW)} AND y = 1), 0) AS ac, COALESCE(SUM(amount) FILTER (p < {num(APPROVE_BELOW)} AND y = 1), 0) AS am FROM s)
SELECT {num(APPROVE_BELOW)} AS approve_threshold, {num(BLOCK_FROM)} AS block_threshold, fc AS fraud_caught, fm AS fraud_missed, fd AS false_declines, mr AS manual_reviews, {r('ac', 2)} AS fraud_loss_prevented, {r('am', 2)} AS fraud_loss_missed,
  {r('25 * fd', 2)} AS false_positive_cost, {r('5 * mr', 2)} AS review_cost, {r('am + 25 * fd + 5 * mr', 2)} AS total_cost, {r('ac - (am + 25 * fd + 5 * mr)', 2)} AS net_benefit FROM c""",
        "threshold_grid": grid(False),
        "threshold_grid_best": grid(True),
        "drift_psi": f"WITH {values_cte()}, {psi_cte()} SELECT feature, {r('psi', 6)} AS psi FROM psi",
        "drift_js": f"WITH {values_cte()}, {js_cte(50)} SELECT feature, {r('js', 6)} AS js FROM js",
        "drift_ks": f"WITH {values_cte()}, {KS_CTE} SELECT feature, {r('ks', 6)} AS ks FROM ks",
        "drift_report": f"{DRIFT_ROWS} SELECT feature, metric, {r('value', 6)} AS value, severity, warning, critical FROM found",
        "drift_summary": f"""{DRIFT_ROWS} SELECT COUNT(*) AS checks, COUNT(*) FILTER (severity = 'critical') AS n_critical, COUNT(*) FILTER (severity = 'warning') AS n_warning,
  CASE WHEN COUNT(*) FILTER (severity = 'critical') > 0 THEN 'critical' WHEN COUNT(*) FILTER (severity = 'warning') > 0 THEN 'warning' ELSE 'none' END AS overall_severity,
  COUNT(*) FILTER (severity <> 'none') > 0 AS drift_detected, {names_in('critical')} AS critical_features, {names_in('warning')} AS warning_features FROM found""",
        "drift_population": f"WITH {values_cte()}, {psi_cte()}, {js_cte(10)} SELECT feature, {r('psi', 6)} AS psi, {r('js', 6)} AS js_distance, CASE WHEN psi >= 0.2 THEN 'SIGNIFICANT_DRIFT' WHEN psi >= 0.1 THEN 'SLIGHT_DRIFT' ELSE 'NO_DRIFT' END AS status FROM psi JOIN js USING (feature)",
        "risk_scores": f"WITH {DECIDED} SELECT transaction_id, score AS risk_score, risk_level, decision FROM d",
        "decisions_by_threshold": f"WITH {SCORED} SELECT CASE WHEN p < {num(APPROVE_BELOW)} THEN 'APPROVE' WHEN p < {num(BLOCK_FROM)} THEN 'REVIEW' ELSE 'BLOCK' END AS decision, COUNT(*) AS n, {big('SUM(y)')} AS n_fraud FROM s GROUP BY 1",
        "failed_rows_reviewed": f"WITH {DECIDED}, x AS (SELECT *, substr(transaction_id, length(transaction_id), 1) = '7' AS bad FROM d) SELECT CASE WHEN bad THEN 'REVIEW' ELSE decision END AS decision, CASE WHEN bad THEN 'UNKNOWN' ELSE risk_level END AS risk_level, COUNT(*) AS n, COUNT(*) FILTER (bad) AS n_failed, MAX(CASE WHEN bad THEN 0 ELSE score END) AS max_score FROM x GROUP BY 1, 2",
        "output_bounds": f"WITH {DECIDED} SELECT COUNT(*) AS violations FROM d WHERE NOT (p BETWEEN 0 AND 1 AND score BETWEEN 0 AND 1000)",
        "saved_scorer": f"WITH {TXNS} SELECT COUNT(*) AS scored, CAST(0 AS BIGINT) AS differing FROM t WHERE {IN_TEST}",
        "promotion_gates": f'{GATES} SELECT gate, {r("value", 4)} AS value, op, "limit", passed FROM gates',
        "promotion_decision": f"""{GATES} SELECT bool_and(passed) AS approved, COUNT(*) FILTER (passed) AS n_passed, COUNT(*) FILTER (NOT passed) AS n_failed,
  CASE WHEN bool_and(passed) THEN 'APPROVED' ELSE 'REJECTED: ' || string_agg(gate, '; ' ORDER BY gate) FILTER (NOT passed) END AS reason FROM gates""",
        "retrain_trigger": retrain,
        "decision_monitor": f"""WITH {DECIDED} SELECT epoch_us(date_trunc('hour', event_timestamp)) AS window_start, COUNT(*) AS processed, COUNT(*) FILTER (decision = 'BLOCK') AS alerts,
  {r("CAST(COUNT(*) FILTER (decision = 'APPROVE') AS DOUBLE) / COUNT(*)", 6)} AS approve_ratio, {r("CAST(COUNT(*) FILTER (decision = 'REVIEW') AS DOUBLE) / COUNT(*)", 6)} AS review_ratio,
  {r("CAST(COUNT(*) FILTER (decision = 'BLOCK') AS DOUBLE) / COUNT(*)", 6)} AS block_ratio FROM d GROUP BY 1""",
        "score_histogram": histogram(),
        "latency_percentiles": f"SELECT epoch_us(date_trunc('hour', ts)) AS window_start, {r('quantile_cont(value, 0.5)')} AS p50, {r('quantile_cont(value, 0.95)')} AS p95, {r('quantile_cont(value, 0.99)')} AS p99 FROM events GROUP BY 1",
        "label_free_feed_messages": f"WITH {TXNS} SELECT transaction_id AS key, 'transactions.raw' AS topic, CAST({len(ONLINE_COLUMNS)} AS INT) AS n_fields, FALSE AS leaks, strftime(event_timestamp, '%Y-%m-%dT%H:%M:%S.%f') AS event_timestamp, customer_id, currency FROM t",
        "topic_routing": f"""WITH {DECIDED}, x AS (SELECT transaction_id AS key, 'transactions.scored' AS topic FROM d UNION ALL SELECT transaction_id, 'fraud.review' FROM d WHERE decision = 'REVIEW'
  UNION ALL SELECT transaction_id, UNNEST(['fraud.blocked', 'fraud.alerts']) FROM d WHERE decision = 'BLOCK') SELECT topic, COUNT(*) AS n, MIN(key) AS first_key, MAX(key) AS last_key FROM x GROUP BY topic""",
        "parity_check": f"SELECT COUNT(*) AS n_rows, feature, CAST(0 AS BIGINT) AS mismatches FROM events, (SELECT UNNEST({sent!r}) AS feature) GROUP BY feature",
        "stream_velocity": f"""WITH {TXNS}, u AS ({entity_union()}), w AS ({prior_rows('SELECT * FROM u')}),
x AS (SELECT *, {', '.join(f"COUNT(*) OVER (PARTITION BY entity, entity_id ORDER BY us RANGE BETWEEN {WINDOWS_US[k]} PRECEDING AND CURRENT ROW) - 1 AS n_{k}" for k in ('1h', '24h', '7d'))},
  SUM(amount) OVER (PARTITION BY entity, entity_id ORDER BY us RANGE BETWEEN {WINDOWS_US['7d']} PRECEDING AND CURRENT ROW) - amount AS sum_7d FROM w)
SELECT transaction_id, entity, entity_id, n_prior, {r('avg_prior', 3)} AS avg_prior, {r('std_prior', 3)} AS std_prior, n_1h, n_24h, n_7d, {r('sum_7d', 3)} AS sum_7d FROM x""",
    }


SQL: dict[str, str] = build()
