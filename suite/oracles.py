"""DuckDB SQL with the same result as each registered query.

Common table expressions are chained as needed; every statement reads the whole tables.
"""

from __future__ import annotations

MEASURES = ("spend", "units", "scripts")
GROWING = ("spend", "units")
RATIO_NAMES = ("spend_per_script", "spend_per_unit", "medicaid_share")
KEYS = ("state", "ndc11_normalized", "product_name_fda10", "quarter_start")
TOTALS = ("total_units", "total_scripts", "total_spend", "medicaid_spend", "non_medicaid_spend")
FLAGS = (
    "high_cost", "very_high_cost", "high_vol", "extreme_vol", "fast_riser", "extreme_riser",
    "declining", "rapid_decline",
)


def r(expression: str, digits: int) -> str:
    return f"round_even(({expression}) * 1e{digits}, 0) / 1e{digits}"


def shown(name: str, digits: int) -> str:
    return f"{r(name, digits)} AS {name}"


def shown_as(expression: str, name: str, digits: int) -> str:
    return f"{r(expression, digits)} AS {name}"


AGG_SHOWN = [*KEYS, *TOTALS, *[shown(c, 6) for c in RATIO_NAMES]]

_LINES = """
lines AS (
  SELECT * FROM lineitem
  JOIN part ON l_partkey = p_partkey
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
),
priced AS (
  SELECT *, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
    CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2)), 2)
      AS DECIMAL(18,2)) AS other
  FROM lines
)"""

_CLAIMS = _LINES + """,
claims AS (
  SELECT CASE WHEN l_returnflag = 'R' THEN 'MCOU' ELSE 'FFSU' END AS record_type,
    lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS state,
    p_brand AS ndc11,
    CAST(year(l_shipdate) AS INTEGER) AS year,
    CAST(quarter(l_shipdate) AS INTEGER) AS quarter,
    'false' AS suppression_used,
    p_type AS product_name_fda10,
    l_quantity AS units_reimbursed,
    CAST(1 AS BIGINT) AS prescriptions,
    CAST(amount AS DOUBLE) AS total_amount,
    CAST(amount - other AS DOUBLE) AS medicaid_amount,
    CAST(other AS DOUBLE) AS non_medicaid_amount,
    make_date(CAST(year(l_shipdate) AS INTEGER), CAST(3 * quarter(l_shipdate) - 2 AS INTEGER), 1)
      AS quarter_start,
    lpad(regexp_replace(p_brand, '[^0-9]', '', 'g'), 11, '0') AS ndc11_normalized
  FROM priced
)"""

_MESSY = _LINES + """,
faulty AS (
  SELECT ' MCOU ' AS record_type,
    ' a' || CAST(c_nationkey AS VARCHAR) AS state,
    CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN 'abc'
      WHEN 3 THEN lpad(CAST(l_partkey AS VARCHAR), 13, '7') ELSE p_brand || '-80' END AS ndc11,
    CASE WHEN l_linenumber = 4 THEN NULL ELSE CAST(year(l_shipdate) AS INTEGER) END AS year,
    CAST(quarter(l_shipdate) + CASE l_linenumber WHEN 5 THEN 4 WHEN 6 THEN -4 ELSE 0 END
      AS INTEGER) AS quarter,
    CASE WHEN l_linenumber <> 7 THEN 'false' END AS suppression_used,
    p_brand || ' ' AS product_name_fda10,
    l_quantity * sign AS units_reimbursed,
    CASE WHEN l_linenumber <> 3 THEN CAST(1 AS BIGINT) END AS prescriptions,
    CAST(amount AS DOUBLE) * sign AS total_amount,
    CAST(amount - other AS DOUBLE) * sign
      + CASE WHEN l_linestatus = 'F' THEN 0.02::DOUBLE WHEN l_linenumber = 2 THEN 0.005::DOUBLE
        ELSE 0::DOUBLE END AS medicaid_amount,
    CASE WHEN l_linenumber <> 7 THEN CAST(other AS DOUBLE) * sign END AS non_medicaid_amount
  FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS sign FROM priced)
),
canonical AS (
  SELECT trim(record_type) AS record_type, upper(trim(state)) AS state, trim(ndc11) AS ndc11,
    year, quarter, suppression_used, trim(product_name_fda10) AS product_name_fda10,
    units_reimbursed, prescriptions, total_amount, medicaid_amount, non_medicaid_amount,
    CASE WHEN quarter BETWEEN 1 AND 4 THEN make_date(year, 3 * quarter - 2, 1) END AS quarter_start,
    substr(lpad(regexp_replace(trim(ndc11), '[^0-9]', '', 'g'), 11, '0'), 1, 11)
      AS ndc11_normalized,
    coalesce(abs(total_amount - (medicaid_amount + non_medicaid_amount)) > 0.01::DOUBLE, false)
      AS spend_mismatch
  FROM faulty
),
validated AS (
  SELECT * REPLACE (
      CASE WHEN units_reimbursed >= 0 THEN units_reimbursed END AS units_reimbursed,
      CASE WHEN prescriptions >= 0 THEN prescriptions END AS prescriptions,
      CASE WHEN total_amount >= 0 THEN total_amount END AS total_amount,
      CASE WHEN medicaid_amount >= 0 THEN medicaid_amount END AS medicaid_amount,
      CASE WHEN non_medicaid_amount >= 0 THEN non_medicaid_amount END AS non_medicaid_amount),
    coalesce(quarter < 1 OR quarter > 4, false) AS invalid_quarter,
    coalesce(length(state) <> 2, false) AS invalid_state,
    ndc11_normalized IS NULL OR NOT regexp_full_match(ndc11_normalized, '[0-9]{11}') AS invalid_ndc
  FROM canonical
),
cleansed AS (
  SELECT * FROM validated
  WHERE NOT invalid_quarter AND NOT invalid_state AND NOT invalid_ndc
    AND state IS NOT NULL AND quarter_start IS NOT NULL
)"""


def _totals(name: str, table: str, decimals: int = 2, units: str = "units_reimbursed") -> str:
    def total(column: str, out: str) -> str:
        digits = 3 if "/" in column else decimals
        exact = f"CAST(coalesce({column}, 0) AS DECIMAL(18,{digits}))"
        return f"CAST(sum({exact}) AS DOUBLE) AS {out}"

    return f""",
{name} AS (
  SELECT *,
    CASE WHEN total_scripts > 0 THEN total_spend / total_scripts END AS spend_per_script,
    CASE WHEN total_units > 0 THEN total_spend / total_units END AS spend_per_unit,
    CASE WHEN total_spend > 0 THEN medicaid_spend / total_spend END AS medicaid_share
  FROM (
    SELECT {', '.join(KEYS)},
      {total(units, 'total_units')},
      CAST(sum(coalesce(prescriptions, 0)) AS BIGINT) AS total_scripts,
      {total('total_amount', 'total_spend')},
      {total('medicaid_amount', 'medicaid_spend')},
      {total('non_medicaid_amount', 'non_medicaid_spend')}
    FROM {table} GROUP BY ALL)
)"""


_AGG = _CLAIMS + _totals("agg", "claims")

_WINDOWS = """
  WINDOW ser AS (PARTITION BY {keys} ORDER BY {order}),
    last4 AS (PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW),
    prior4 AS (PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN 7 PRECEDING AND 4 PRECEDING)"""

_DRUG = _WINDOWS.format(
    keys="state, ndc11_normalized", order="quarter_start, product_name_fda10"
)
_PRODUCT = _WINDOWS.format(
    keys="state, product_name_fda10", order="quarter_start, ndc11_normalized"
)


def _change(m: str) -> str:
    return (
        f"CASE WHEN prev_{m} <> 0 THEN (total_{m} - prev_{m}) / CAST(prev_{m} AS DOUBLE) END"
        f" AS qoq_{m}_change"
    )


def _direction(m: str) -> str:
    return (
        f"CASE WHEN qoq_{m}_change > 0.05::DOUBLE THEN 'increasing'"
        f" WHEN qoq_{m}_change < -0.05::DOUBLE THEN 'decreasing' ELSE 'stable' END"
        f" AS trend_direction_{m}"
    )


def _lags() -> list[str]:
    return [f"lag(total_{m}, {k}) OVER ser AS {m}_lag_{k}q" for k in (1, 2, 4) for m in MEASURES]


_FEATURES = _AGG + f""",
sliding AS (
  SELECT *, {', '.join(
    [f"lag(total_{m}) OVER ser AS prev_{m}" for m in MEASURES]
    + [f"avg(total_{m}) OVER last4 AS t4q_{m}_avg" for m in MEASURES]
    + [f"stddev_samp(total_{m}) OVER last4 AS t4q_{m}_std" for m in MEASURES]
    + [f"sum(total_{m}) OVER last4 AS last_{m}" for m in GROWING]
    + [f"sum(total_{m}) OVER prior4 AS prior_{m}" for m in GROWING]
    + _lags())}
  FROM agg {_DRUG}
),
changed AS (
  SELECT *, {', '.join(
    [_change(m) for m in MEASURES]
    + [f"CASE WHEN t4q_{m}_avg > 0 THEN t4q_{m}_std / t4q_{m}_avg END AS cv_{m}" for m in MEASURES]
    + [f"CASE WHEN prior_{m} > 0 THEN (last_{m} - prior_{m}) / prior_{m} END"
       f" AS rolling_4q_growth_{m}" for m in GROWING])}
  FROM sliding
),
features AS (SELECT *, {', '.join(_direction(m) for m in GROWING)} FROM changed)"""

CHANGES_SHOWN = [shown(f"qoq_{m}_change", 6) for m in MEASURES]
ROLLING_SHOWN = [
    *[shown(f"t4q_{m}_avg", 4) for m in MEASURES], *[shown(f"t4q_{m}_std", 3) for m in MEASURES]
]
CV_SHOWN = [shown(f"cv_{m}", 6) for m in MEASURES]
GROWTH_SHOWN = [shown(f"rolling_4q_growth_{m}", 6) for m in GROWING]
DIRECTIONS = [f"trend_direction_{m}" for m in GROWING]
LAGS = [f"{m}_lag_{k}q" for k in (1, 2, 4) for m in MEASURES]
FEATURES_SHOWN = [
    *AGG_SHOWN, *CHANGES_SHOWN, *ROLLING_SHOWN, *CV_SHOWN, *GROWTH_SHOWN, *DIRECTIONS
]


def _rules(name: str, quantiles: str) -> str:
    """Flags, level and score on features joined with their percentiles."""
    return f""",
{name}_flags AS (
  SELECT *,
    coalesce(total_spend >= spend_75th_percentile, false) AS high_cost,
    coalesce(total_spend >= spend_90th_percentile, false) AS very_high_cost,
    coalesce(cv_spend > 1, false) OR coalesce(abs(qoq_spend_change) > 0.35::DOUBLE, false)
      AS high_vol,
    coalesce(cv_spend > 2, false) OR coalesce(abs(qoq_spend_change) > 0.75::DOUBLE, false)
      AS extreme_vol,
    coalesce(rolling_4q_growth_spend > 0.25::DOUBLE, false) AS fast_riser,
    coalesce(rolling_4q_growth_spend > 0.5::DOUBLE, false) AS extreme_riser,
    coalesce(rolling_4q_growth_spend < -0.25::DOUBLE, false) AS declining,
    coalesce(rolling_4q_growth_spend < -0.5::DOUBLE, false) AS rapid_decline
  FROM {quantiles}
),
{name}_levels AS (
  SELECT *, CASE WHEN high_cost AND (high_vol OR fast_riser OR extreme_riser) THEN 'high'
    WHEN high_cost OR high_vol OR fast_riser OR extreme_riser OR extreme_vol OR rapid_decline
    THEN 'medium' ELSE 'low' END AS risk_level
  FROM {name}_flags
),
{name} AS (
  SELECT *, CAST(least(100, CASE risk_level WHEN 'high' THEN 100 WHEN 'medium' THEN 50 ELSE 0 END
    + 20 * high_cost::INT + 15 * high_vol::INT + 15 * fast_riser::INT + 10 * extreme_vol::INT
    + 10 * extreme_riser::INT + 10 * rapid_decline::INT) AS INTEGER) AS risk_score
  FROM {name}_levels
)"""


_RISKS = _FEATURES + """,
peers AS (
  SELECT *,
    quantile_disc(total_spend, 0.75) OVER (PARTITION BY state, quarter_start)
      AS spend_75th_percentile,
    quantile_disc(total_spend, 0.9) OVER (PARTITION BY state, quarter_start)
      AS spend_90th_percentile
  FROM features
)""" + _rules("risks", "peers")

_RISKS_GLOBAL = _FEATURES + """,
peers AS (
  SELECT features.*, q75 AS spend_75th_percentile, q90 AS spend_90th_percentile
  FROM features, (SELECT quantile_disc(total_spend, 0.75) AS q75,
    quantile_disc(total_spend, 0.9) AS q90 FROM agg)
)""" + _rules("risks", "peers")

RISKS_SHOWN = [
    *FEATURES_SHOWN, *LAGS, "spend_75th_percentile", "spend_90th_percentile", *FLAGS,
    "risk_level", "risk_score",
]

_TRENDS = _AGG + f""",
product_sliding AS (
  SELECT *, {', '.join(f"lag(total_{m}) OVER ser AS prev_{m}" for m in MEASURES)},
    avg(total_spend) OVER last4 AS rolling_4q_spend_avg,
    stddev_samp(total_spend) OVER last4 AS rolling_4q_spend_std,
    lag(total_spend, 3) OVER ser AS first_spend
  FROM agg {_PRODUCT}
),
trends AS (
  SELECT *, {', '.join(
    f"CASE WHEN prev_{m} <> 0 THEN (total_{m} - prev_{m}) / CAST(prev_{m} AS DOUBLE)"
    f" WHEN prev_{m} = 0 AND total_{m} <> 0 THEN sign(total_{m}) * 'inf'::DOUBLE END"
    f" AS qoq_{m}_change" for m in MEASURES)},
    CASE WHEN rolling_4q_spend_avg <> 0 THEN rolling_4q_spend_std / rolling_4q_spend_avg END
      AS cv_spend,
    CASE WHEN first_spend <> 0 THEN (total_spend - first_spend) / first_spend ELSE 0 END
      AS rolling_4q_growth_spend
  FROM product_sliding
)"""

TRENDS_SHOWN = [
    *AGG_SHOWN, *CHANGES_SHOWN, shown("rolling_4q_spend_avg", 4), shown("rolling_4q_spend_std", 3),
    shown("cv_spend", 6), shown("rolling_4q_growth_spend", 6),
]

_DASHBOARD = _TRENDS + """,
newest AS (
  SELECT *, quantile_cont(total_spend, 0.75) OVER (PARTITION BY state) AS spend_cut
  FROM trends WHERE quarter_start = (SELECT max(quarter_start) FROM trends)
),
demo_flags AS (
  SELECT *, total_spend >= spend_cut AS high_cost,
    coalesce(cv_spend > 1, false) OR coalesce(abs(qoq_spend_change) > 0.35::DOUBLE, false)
      AS high_vol,
    coalesce(rolling_4q_growth_spend > 0.25::DOUBLE, false) AS fast_riser
  FROM newest
),
demo AS (
  SELECT *, CASE WHEN high_cost AND (high_vol OR fast_riser) THEN 'high'
      WHEN high_cost OR high_vol OR fast_riser THEN 'medium' ELSE 'low' END AS risk_level,
    round_even((30 * high_cost::INT + 25 * high_vol::INT + 25 * fast_riser::INT
      + CASE WHEN cv_spend IS NOT NULL THEN greatest(0::DOUBLE, least(20::DOUBLE, cv_spend * 20))
        END) * 10, 0) / 10 AS risk_score
  FROM demo_flags
)"""

# One code per part instead of one per brand: series with gaps.
_SPARSE = _AGG.replace("p_brand AS ndc11", "CAST(p_partkey AS VARCHAR) AS ndc11").replace(
    "regexp_replace(p_brand,", "regexp_replace(CAST(p_partkey AS VARCHAR),")


def _span(a: int, b: int) -> str:
    side = lambda n: f"{-n} PRECEDING" if n else "CURRENT ROW"
    return (f"OVER (PARTITION BY state, ndc11_normalized ORDER BY qn RANGE BETWEEN {side(a)} AND {side(b)})")


def _lagged(m: str, k: int) -> str:
    value = f"sum(total_{m}) {_span(-k, -k)}"
    name = f"calendar_{m}_lag_{k}q"
    return f"CAST({value} AS BIGINT) AS {name}" if m == "scripts" else shown_as(value, name, 2)


_CALENDAR = _SPARSE + f""",
numbered AS (SELECT *, 4 * year(quarter_start) + quarter(quarter_start) AS qn FROM agg),
spans AS (
  SELECT *, {', '.join(
    [f"CAST(sum(total_{m}) {_span(0, 0)} AS DOUBLE) AS now_{m}" for m in MEASURES]
    + [f"CAST(sum(total_{m}) {_span(-1, -1)} AS DOUBLE) AS before_{m}" for m in MEASURES]
    + [f"sum(total_{m}) {_span(-3, 0)} AS last_{m}, sum(total_{m}) {_span(-7, -4)} AS prior_{m}" for m in GROWING]
    + [shown_as(f"avg(total_{m}) {_span(-3, 0)}", f"calendar_4q_{m}_avg", 4) for m in MEASURES]
    + [shown_as(f"stddev_samp(total_{m}) {_span(-3, 0)}", f"calendar_4q_{m}_std", 3) for m in MEASURES]
    + [_lagged(m, k) for k in (1, 2, 4) for m in MEASURES])}
  FROM numbered
)"""
CALENDAR_SHOWN = [
    *KEYS, *TOTALS, *[f"calendar_4q_{m}_{s}" for m in MEASURES for s in ("avg", "std")],
    *[f"calendar_{m}_lag_{k}q" for k in (1, 2, 4) for m in MEASURES],
    *[shown_as(f"CASE WHEN before_{m} <> 0 THEN (now_{m} - before_{m}) / before_{m} END", f"calendar_{m}_change", 6)
      for m in MEASURES],
    *[shown_as(f"CASE WHEN prior_{m} > 0 THEN (last_{m} - prior_{m}) / prior_{m} END", f"calendar_4q_growth_{m}", 6)
      for m in GROWING],
]

_LATEST_SERIES = """
  SELECT * FROM {table}
  QUALIFY row_number() OVER (PARTITION BY state, ndc11_normalized
    ORDER BY quarter_start DESC, product_name_fda10) = 1"""

_UNIVERSE = _AGG + f""",
latest AS ({_LATEST_SERIES.format(table="agg")}),
universe AS (
  SELECT * FROM latest QUALIFY row_number() OVER (PARTITION BY state
    ORDER BY total_spend DESC, ndc11_normalized, product_name_fda10) <= 10
)"""


def _forecast(universe: str, metric: str, exact: bool = False) -> str:
    """Linear trend times seasonal index on one point per quarter, four steps ahead.

    ``exact`` rounds to eight digits first, so that half a cent is half a cent.
    """
    cents = lambda value, name: shown_as(r(value, 8) if exact else value, name, 2)
    return f""",
points AS (
  SELECT state, ndc11_normalized, quarter_start AS ds, avg(total_{metric}) AS y,
    count(total_{metric}) AS n_rows,
    4 * year(quarter_start) + quarter(quarter_start) - 8001 AS t, quarter(quarter_start) AS season
  FROM agg SEMI JOIN {universe} USING (state, ndc11_normalized)
  WHERE total_{metric} IS NOT NULL GROUP BY ALL
),
fitted AS (
  SELECT *, mean_y + slope * (t - mean_t) AS base FROM (
    SELECT *, coalesce(regr_slope(y, t) OVER w, 0) AS slope, avg(t) OVER w AS mean_t,
      avg(y) OVER w AS mean_y, avg(abs(y)) OVER w AS level
    FROM points WINDOW w AS (PARTITION BY state, ndc11_normalized))
),
usable AS (
  SELECT *, CASE WHEN base > level * 0.05::DOUBLE THEN y / base END AS share FROM fitted
),
seasonal AS (
  SELECT *, count(share) OVER s > 1 AS own_season,
    CASE WHEN count(share) OVER s > 1 THEN avg(share) OVER s ELSE 1 END AS idx
  FROM usable WINDOW s AS (PARTITION BY state, ndc11_normalized, season)
),
fits AS (
  SELECT state, ndc11_normalized, sum(n_rows) AS n, max(ds) AS last, any_value(slope) AS slope,
    any_value(mean_t) AS mean_t, any_value(mean_y) AS mean_y,
    count(*) AS quarters, var_pop(t) * count(*) AS spread, sum((y - base * idx) ** 2) AS squares,
    count(*) - least(count(*), 2) - count(DISTINCT season) FILTER (own_season) AS dof,
    map_from_entries(list(DISTINCT (season, idx))) AS indices
  FROM seasonal GROUP BY ALL
),
steps AS (
  SELECT * EXCLUDE (h), CASE WHEN n >= 4 THEN h END AS h
  FROM {universe} LEFT JOIN fits USING (state, ndc11_normalized), range(1, 5) AS s(h)
  WHERE h = 1 OR n >= 4
),
ahead AS (
  SELECT *, CAST(last + to_months(CAST(3 * h AS INTEGER)) AS DATE) AS next_start FROM steps
),
away_ahead AS (
  SELECT *, 4 * year(next_start) + quarter(next_start) - 8001 - mean_t AS away FROM ahead
),
values_ahead AS (
  SELECT *, (mean_y + slope * away) * coalesce(indices[quarter(next_start)], 1) AS value,
    CASE WHEN dof > 0 THEN sqrt(squares / dof) * sqrt(1 + 1 / quarters
      + CASE WHEN spread > 0 THEN away * away / spread ELSE 0 END) END AS deviation
  FROM away_ahead
),
forecasts AS (
  SELECT state, ndc11_normalized AS ndc11, product_name_fda10 AS product_name,
    '{metric}' AS metric, CAST(h AS INTEGER) AS forecast_period,
    CAST(next_start - INTERVAL 1 DAY AS DATE) AS forecast_date,
    next_start AS forecast_quarter_start,
    {cents("value", "forecast_value")},
    {cents("value - 1.2815515655::DOUBLE * deviation", "forecast_lower")},
    {cents("value + 1.2815515655::DOUBLE * deviation", "forecast_upper")},
    CASE WHEN h IS NULL THEN 'Insufficient data' END AS error
  FROM values_ahead
)"""


_BATCH = _UNIVERSE + _forecast("universe", "spend")

# The changepoint model: columns, penalties and least quarters of an origin.
_DESIGN = [
    "1", "t", *[f"greatest(t - {c}, 0)" for c in (6, 12, 18, 24)],
    "CASE q WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END", "CASE q WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END",
    "1 - 2 * (q % 2)",
]
_PENALTIES = [0, 0.001, 8, 8, 8, 8, 0.5, 0.5, 0.5]


def _changepoints(universe: str, metric: str) -> str:
    """The model at every quarter of every series, by elimination on running sums."""
    size = len(_DESIGN)
    x = [f"CAST({c} AS DOUBLE) AS x{i}" for i, c in enumerate(_DESIGN)]
    rows = []
    for i in range(size):
        cells = [f"sum(x{min(i, j)} * x{max(i, j)}) OVER w" + (f" + {_PENALTIES[i]}::DOUBLE" if i == j else "")
                 for j in range(size)]
        rows.append(f"[{', '.join([*cells, f'sum(x{i} * y) OVER w'])}]")
    chain = f""",
points AS (
  SELECT state, ndc11_normalized, quarter_start AS ds, avg(total_{metric}) AS y, count(total_{metric}) AS n_rows
  FROM agg SEMI JOIN {universe} USING (state, ndc11_normalized)
  WHERE total_{metric} IS NOT NULL GROUP BY ALL
),
timed AS (
  SELECT *, 4 * year(ds) + quarter(ds) - min(4 * year(ds) + quarter(ds)) OVER s AS t, quarter(ds) - 1 AS q,
    sum(n_rows) OVER s AS n, max(ds) OVER s AS last
  FROM points WINDOW s AS (PARTITION BY state, ndc11_normalized)
),
design AS (SELECT *, {', '.join(x)} FROM timed),
solved0 AS (
  SELECT state, ndc11_normalized, ds, t, n, last, count(*) OVER w AS seen, [{', '.join(rows)}] AS m
  FROM design WINDOW w AS (PARTITION BY state, ndc11_normalized ORDER BY ds)
)"""
    for k in range(1, size + 1):
        chain += f""",
solved{k} AS (
  SELECT * EXCLUDE (head) REPLACE (list_transform(m, lambda row, i: CASE WHEN i = {k}
    THEN list_transform(head, lambda v: v / head[{k}])
    ELSE list_transform(row, lambda v, j: v - row[{k}] * head[j] / head[{k}]) END) AS m)
  FROM (SELECT *, m[{k}] AS head FROM solved{k - 1})
)"""
    terms = " + ".join(f"m[{i + 1}][{size + 1}] * ({c})" for i, c in enumerate(_DESIGN))
    return chain + f""",
model_ahead AS (
  SELECT state, ndc11_normalized, ds AS origin, last, n, seen, CAST(h AS INTEGER) AS step, {terms} AS value
  FROM (SELECT * EXCLUDE (t), t + h AS t, (quarter(ds) - 1 + h) % 4 AS q FROM solved{size}, range(1, 5) AS s(h))
),
tries AS (
  SELECT a.state, a.ndc11_normalized, origin, step, value AS forecast, p.y AS actual, p.y - value AS error
  FROM model_ahead a JOIN points p ON a.state = p.state AND a.ndc11_normalized = p.ndc11_normalized
    AND p.ds = CAST(origin + to_months(3 * step) AS DATE)
  WHERE seen >= 8
),
widths AS (
  SELECT state, ndc11_normalized, step, list_sort(newest)[CAST(ceil((len(newest) + 1) * 0.8::DOUBLE) AS BIGINT)] AS width
  FROM (SELECT state, ndc11_normalized, step, list(abs(error) ORDER BY origin DESC)[1:14] AS newest FROM tries GROUP BY ALL)
),
model_forecasts AS (
  SELECT u.state, u.ndc11_normalized AS ndc11, u.product_name_fda10 AS product_name, '{metric}' AS metric,
    a.step AS forecast_period,
    CAST(CAST(a.last + to_months(3 * a.step) AS DATE) - INTERVAL 1 DAY AS DATE) AS forecast_date,
    CAST(a.last + to_months(3 * a.step) AS DATE) AS forecast_quarter_start,
    {shown_as("value", "forecast_value", 1)}, {shown_as("value - width", "forecast_lower", 1)},
    {shown_as("value + width", "forecast_upper", 1)},
    CASE WHEN a.step IS NULL THEN 'Insufficient data' END AS error
  FROM {universe} u
  LEFT JOIN (SELECT * FROM model_ahead WHERE origin = last AND n >= 4) a
    ON u.state = a.state AND u.ndc11_normalized = a.ndc11_normalized
  LEFT JOIN widths w ON a.state = w.state AND a.ndc11_normalized = w.ndc11_normalized AND a.step = w.step
)"""

_DRIFT = _UNIVERSE + """,
points AS (
  SELECT state, ndc11_normalized, quarter_start AS ds, avg(total_spend) AS y,
    count(total_spend) AS n_rows
  FROM agg SEMI JOIN universe USING (state, ndc11_normalized) GROUP BY ALL
),
ends AS (
  SELECT state, ndc11_normalized, sum(n_rows) AS n, max(ds) AS last, arg_max(y, ds) AS y_last,
    (arg_max(y, ds) - arg_min(y, ds)) / (count(*) - 1) AS step
  FROM points GROUP BY ALL
),
drifted AS (
  SELECT * EXCLUDE (h), CASE WHEN n >= 4 AND step >= 0 THEN h END AS h
  FROM universe LEFT JOIN ends USING (state, ndc11_normalized), range(1, 5) AS s(h)
  WHERE h = 1 OR (n >= 4 AND step >= 0)
)"""


def select(chain: str, columns: list[str] | str, table: str, rest: str = "") -> str:
    listed = columns if isinstance(columns, str) else ", ".join(columns)
    return f"WITH {chain}\nSELECT {listed} FROM {table} {rest}"


CLAIM_COLUMNS = [
    "record_type", "state", "ndc11", "year", "quarter", "suppression_used", "product_name_fda10",
    "units_reimbursed", "prescriptions", "total_amount", "medicaid_amount", "non_medicaid_amount",
    "quarter_start", "ndc11_normalized",
]
PER_STATE_LATEST = (
    "WHERE quarter_start = (SELECT max(o.quarter_start) FROM risks o WHERE o.state = risks.state)"
)
TIES = "state, ndc11_normalized, product_name_fda10, quarter_start"
TOP_SPEND = [
    "state", "ndc11_normalized", "product_name_fda10", "total_spend", "total_units",
    "total_scripts", "quarter_start", "risk_level", "risk_score",
]
RISERS = [
    "state", "ndc11_normalized", "product_name_fda10", "total_spend",
    shown("qoq_spend_change", 6), shown("rolling_4q_growth_spend", 6), shown("cv_spend", 6),
    "risk_level", "risk_score", "quarter_start",
]
NEWEST = "WHERE quarter_start = (SELECT max(quarter_start) FROM {0})"
RISK_TOTALS = [
    "state", "risk_level", "count(*) AS drug_count",
    shown_as("sum(total_spend)", "total_spend_at_risk", 2),
    shown_as("avg(risk_score)", "avg_risk_score", 6),
]
DEMO_SHOWN = [*TRENDS_SHOWN, "high_cost", "high_vol", "fast_riser", "risk_level", "risk_score"]
WATCHED = "WHERE risk_level IN ('high', 'medium')"
WATCH_ORDER = f"ORDER BY risk_score DESC, total_spend DESC, {TIES} LIMIT 20"

# Claims as CSV text, under the raw headers.
RAW_SHOWN = ", ".join([
    'record_type AS "Utilization Type"', 'state AS "State"', 'ndc11 AS "NDC"',
    'CAST(year AS VARCHAR) AS "Year"', 'CAST(quarter AS VARCHAR) AS "Quarter"',
    'CASE WHEN year < 1999 THEN suppression_used END AS "Suppression Used"',
    'product_name_fda10 AS "Product Name"',
    'CAST(units_reimbursed AS VARCHAR) AS "Units Reimbursed"',
    'CAST(prescriptions AS VARCHAR) AS "Number of Prescriptions"',
    'CAST(total_amount AS VARCHAR) AS "Total Amount Reimbursed"',
    'CAST(medicaid_amount AS VARCHAR) AS "Medicaid Amount Reimbursed"',
    'CAST(non_medicaid_amount AS VARCHAR) AS "Non Medicaid Amount Reimbursed"',
])

_SAFE = _MESSY + _totals("messy_agg", "cleansed", 3)

ORACLES: dict[str, str] = {
    "scan_csv": select(_CLAIMS, [*CLAIM_COLUMNS, "false AS spend_mismatch"], "claims"),
    "union_by_name": select(_CLAIMS, RAW_SHOWN, "claims"),
    "scan_quarantine": f"""WITH {_LINES.strip()},
fields AS (
  SELECT l_linenumber AS line, lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS state, p_brand, p_type,
    year(l_shipdate) AS y, quarter(l_shipdate) AS q, CAST(l_quantity AS INTEGER) AS units, amount
  FROM priced)
SELECT NULL AS raw, state, lpad(regexp_replace(p_brand, '[^0-9]', '', 'g'), 11, '0') AS ndc11_normalized,
  CASE WHEN line = 3 THEN p_type || chr(10) || ', net' ELSE p_type END AS product_name_fda10,
  make_date(CAST(y AS INTEGER), CAST(3 * q - 2 AS INTEGER), 1) AS quarter_start,
  CAST(units AS DOUBLE) AS units_reimbursed, CAST(amount AS DOUBLE) AS total_amount
FROM fields WHERE line NOT IN (1, 2)
UNION ALL
SELECT concat_ws(',', state, p_brand, y, q, p_type, units) || CASE WHEN line = 2 THEN ',1,' || CAST(amount AS VARCHAR) || ',x,y' ELSE '' END,
  NULL, NULL, NULL, NULL, NULL, NULL
FROM fields WHERE line IN (1, 2)""",
    "parquet_roundtrip": select(_AGG, AGG_SHOWN, "agg"),
    "materialize": select(_AGG, AGG_SHOWN, "agg"),
    "load_or_empty": select(_BATCH, "*", "forecasts"),
    "export_csv": select(
        _RISKS,
        ["state", "ndc11_normalized", "product_name_fda10", "risk_level", "risk_score", "quarter_start"],
        "risks", f"{WATCHED} {WATCH_ORDER}",
    ),
    "combined_view": select(
        _RISKS,
        [*KEYS, "total_spend", shown("qoq_spend_change", 6), shown("cv_spend", 6), "risk_level", "risk_score"],
        "risks",
    ),
    "stage_counts": f"""WITH {_SAFE}
SELECT 'raw' AS stage, count(*) AS row_count FROM lineitem
UNION ALL SELECT 'cleansed', count(*) FROM cleansed
UNION ALL SELECT 'aggregates', count(*) FROM messy_agg""",
    "canonicalize": select(_MESSY, "*", "canonical"),
    "quarter_start": select(
        _MESSY, "year, quarter, quarter_start, count(*) AS claims", "canonical", "GROUP BY ALL"
    ),
    "normalize_ndc": select(
        _MESSY, "ndc11, ndc11_normalized, count(*) AS claims", "canonical", "GROUP BY ALL"
    ),
    "spend_mismatch": select(
        _MESSY, "total_amount, medicaid_amount, non_medicaid_amount, spend_mismatch", "canonical"
    ),
    "validate": select(_MESSY, "*", "validated"),
    "cleanse": select(_MESSY, "*", "cleansed"),
    "nonnegative_measures": f"""WITH {_CLAIMS}
SELECT * FROM (SELECT state, ndc11_normalized, quarter_start,
  CAST(sum(CAST(total_amount - 30000 AS DECIMAL(18,2))) AS DOUBLE) AS total_spend,
  CAST(sum(prescriptions) AS BIGINT) AS total_scripts FROM claims GROUP BY ALL)
WHERE total_spend >= 0 AND total_scripts >= 0""",
    "quarterly_aggregates": select(_AGG, AGG_SHOWN, "agg"),
    "quarterly_aggregates_by_state": select(_AGG, AGG_SHOWN, "agg"),
    "quarterly_units_fractional": select(
        _CLAIMS + _totals("agg", "claims", units="units_reimbursed / 8"), [*KEYS, *TOTALS], "agg"
    ),
    "trend_features_in_blocks": select(_FEATURES, FEATURES_SHOWN, "features"),
    "safe_ratios": select(_SAFE, AGG_SHOWN, "messy_agg"),
    "safe_ratios_zero": select(
        _SAFE,
        [*KEYS, *TOTALS] + [
            f"CASE WHEN total_{d}s > 0 THEN {r(f'total_spend / total_{d}s', 2)} ELSE 0 END"
            f" AS spend_per_{d}" for d in ("script", "unit")
        ],
        "messy_agg",
    ),
    "time_dimensions": select(
        _AGG,
        [*KEYS, *TOTALS, "CAST(year(quarter_start) AS INTEGER) AS year",
         "CAST(quarter(quarter_start) AS INTEGER) AS quarter"],
        "agg",
    ),
    "qoq_change": select(_FEATURES, [*KEYS, *TOTALS, *CHANGES_SHOWN], "features"),
    "rolling_stats": select(_FEATURES, [*KEYS, *TOTALS, *ROLLING_SHOWN], "features"),
    "cv": select(_FEATURES, [*KEYS, *TOTALS, *ROLLING_SHOWN, *CV_SHOWN], "features"),
    "rolling_growth": select(_FEATURES, [*KEYS, *TOTALS, *GROWTH_SHOWN], "features"),
    "trend_direction": select(
        _FEATURES, [*KEYS, *TOTALS, *CHANGES_SHOWN, *DIRECTIONS], "features"
    ),
    "lag_features": select(_FEATURES, [*KEYS, *TOTALS, *LAGS], "features"),
    "trend_features": select(_FEATURES, FEATURES_SHOWN, "features"),
    "latest_per_series": select(
        _AGG, AGG_SHOWN, f"({_LATEST_SERIES.format(table='agg')})"
    ),
    "qoq_change_by_product": select(_TRENDS, [*KEYS, *TOTALS, *CHANGES_SHOWN], "trends"),
    "rolling_stats_by_product": select(
        _TRENDS,
        [*KEYS, *TOTALS, shown("rolling_4q_spend_avg", 4), shown("rolling_4q_spend_std", 3),
         shown("cv_spend", 6)],
        "trends",
    ),
    "endpoint_growth": select(
        _TRENDS, [*KEYS, *TOTALS, shown("rolling_4q_growth_spend", 6)], "trends"
    ),
    "series_tiles": select(
        _TRENDS,
        ["state", "product_name_fda10", "quarter_start", shown("qoq_spend_change", 6),
         shown("rolling_4q_growth_spend", 6), shown("cv_spend", 6)],
        "trends",
        "QUALIFY row_number() OVER (PARTITION BY state, product_name_fda10"
        " ORDER BY quarter_start DESC, ndc11_normalized) = 1",
    ),
    "spend_percentiles": select(
        _RISKS, [*KEYS, *TOTALS, "spend_75th_percentile", "spend_90th_percentile"], "peers"
    ),
    "spend_percentiles_global": select(
        _RISKS_GLOBAL, [*KEYS, *TOTALS, "spend_75th_percentile", "spend_90th_percentile"], "peers"
    ),
    "risk_flags": select(_RISKS, [*KEYS, *FLAGS], "risks"),
    "risk_level": select(_RISKS, [*KEYS, "risk_level"], "risks"),
    "risk_score": select(_RISKS, [*KEYS, "risk_level", "risk_score"], "risks"),
    "flag_risks": select(
        _RISKS_GLOBAL,
        [*KEYS, "spend_75th_percentile", "spend_90th_percentile", *FLAGS, "risk_level", "risk_score"],
        "risks",
    ),
    "pipeline_risks": select(_RISKS, RISKS_SHOWN, "risks"),
    "pipeline_from_csv": select(_RISKS, RISKS_SHOWN, "risks"),
    "pipeline_incremental": select(_RISKS, RISKS_SHOWN, "risks"),
    "snapshot_read": select(
        _AGG, ["1 AS version", *AGG_SHOWN], "agg", "WHERE year(quarter_start) < 1999"
    ) + f" UNION ALL SELECT 2, {', '.join(AGG_SHOWN)} FROM agg",
    "high_cost_exact": select(
        _DASHBOARD, [*KEYS, "total_spend", shown("spend_cut", 4), "high_cost"], "demo"
    ),
    "demo_risk": select(_DASHBOARD, DEMO_SHOWN, "demo"),
    "filter_states": select(_AGG, AGG_SHOWN, "agg", "WHERE state IN ('03', '05', '11')"),
    "filter_quarter_range": select(
        _AGG, AGG_SHOWN, "agg",
        "WHERE quarter_start BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'",
    ),
    "history_by_series": select(
        _RISKS,
        ["quarter_start", "total_spend", "total_units", "total_scripts",
         shown("qoq_spend_change", 6), shown("rolling_4q_growth_spend", 6), shown("cv_spend", 6),
         "risk_level", "risk_score"],
        "risks",
        "WHERE state = '05' AND ndc11_normalized = '00000000013' ORDER BY quarter_start",
    ),
    "history_by_product": select(
        _TRENDS, TRENDS_SHOWN, "trends", "WHERE state = '05' AND product_name_fda10 = 'PROMO'"
    ),
    "top_spend_latest": select(
        _RISKS, TOP_SPEND, "risks",
        f"{PER_STATE_LATEST} ORDER BY total_spend DESC, {TIES} LIMIT 10",
    ),
    "top_spend_latest_state": select(
        _RISKS, TOP_SPEND, "risks",
        f"{PER_STATE_LATEST} AND state = '05' ORDER BY total_spend DESC, {TIES} LIMIT 10",
    ),
    "top_risers_latest": select(
        _RISKS, RISERS, "risks",
        f"{PER_STATE_LATEST} AND qoq_spend_change IS NOT NULL"
        f" ORDER BY risks.qoq_spend_change DESC, {TIES} LIMIT 10",
    ),
    "top_risers_latest_state": select(
        _RISKS, RISERS, "risks",
        f"{PER_STATE_LATEST} AND state = '05' AND qoq_spend_change IS NOT NULL"
        f" ORDER BY risks.qoq_spend_change DESC, {TIES} LIMIT 10",
    ),
    "latest_quarter_global": select(_AGG, AGG_SHOWN, "agg", NEWEST.format("agg")),
    "top_spend_latest_global": select(
        _AGG, AGG_SHOWN, "agg",
        f"{NEWEST.format('agg')} ORDER BY total_spend DESC, {TIES} LIMIT 10",
    ),
    "top_risers_latest_global": select(
        _TRENDS, TRENDS_SHOWN, "trends",
        f"{NEWEST.format('trends')} ORDER BY trends.qoq_spend_change DESC NULLS LAST, {TIES} LIMIT 10",
    ),
    "watchlist": select(_RISKS, RISERS, "risks", f"{WATCHED} {WATCH_ORDER}"),
    "watchlist_state": select(_RISKS, RISERS, "risks", f"{WATCHED} AND state = '05' {WATCH_ORDER}"),
    "watchlist_latest": select(
        _DASHBOARD,
        ["state", "product_name_fda10", "total_spend", "risk_level", "risk_score",
         shown("qoq_spend_change", 6)],
        "demo", f"{WATCHED} ORDER BY risk_score DESC NULLS LAST, {TIES} LIMIT 20",
    ),
    "combined_join": select(
        _RISKS, [c for c in RISKS_SHOWN if not c.endswith(RATIO_NAMES)], "risks"
    ),
    "kpi_summary": select(
        _AGG,
        [shown_as("sum(total_spend)", "total_spend", 2),
         "count(DISTINCT ndc11_normalized) AS unique_drugs", "count(DISTINCT state) AS states",
         "max(quarter_start) AS latest_quarter",
         "strftime(max(quarter_start), '%Y-%m') AS latest_month"],
        "agg",
    ),
    "risk_summary": select(_RISKS, RISK_TOTALS, "risks", "GROUP BY state, risk_level"),
    "risk_summary_ordered": select(
        _RISKS, [*RISK_TOTALS, "max(quarter_start) AS latest_quarter"], "risks",
        "GROUP BY state, risk_level ORDER BY state,"
        " CASE risk_level WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END",
    ),
    "risk_level_share": select(
        _RISKS, ["risk_level", "count(*) AS drug_count"], "risks", "GROUP BY risk_level"
    ),
    "risk_level_counts": select(
        _DASHBOARD, ["risk_level", "count(*) AS drug_count"], "demo", "GROUP BY risk_level"
    ),
    "state_spend_trend": select(
        _RISKS,
        ["state", "quarter_start", shown_as("sum(total_spend)", "state_total_spend", 2),
         "count(DISTINCT ndc11_normalized) AS unique_drugs",
         shown_as("avg(risk_score)", "avg_risk_score", 6)],
        "risks", "GROUP BY state, quarter_start ORDER BY state, quarter_start",
    ),
    "state_spend_trend_state": select(
        _RISKS,
        ["state", "quarter_start", shown_as("sum(total_spend)", "state_total_spend", 2),
         "count(DISTINCT ndc11_normalized) AS unique_drugs",
         shown_as("avg(risk_score)", "avg_risk_score", 6)],
        "risks", "WHERE state = '05' GROUP BY state, quarter_start ORDER BY quarter_start",
    ),
    "state_comparison": select(
        _AGG, ["state", shown_as("avg(total_spend)", "total_spend", 4)], "agg",
        f"{NEWEST.format('agg')} GROUP BY state ORDER BY avg(agg.total_spend) DESC, state LIMIT 10",
    ),
    "state_comparison_units": select(
        _AGG, ["state", shown_as("avg(total_units)", "total_units", 4)], "agg",
        f"{NEWEST.format('agg')} GROUP BY state ORDER BY avg(agg.total_units) DESC, state LIMIT 10",
    ),
    "dashboard_filtered": select(
        _TRENDS, TRENDS_SHOWN, "trends",
        "WHERE state IN ('03', '05', '11') AND quarter_start = (SELECT max(quarter_start) FROM trends"
        f" WHERE state IN ('03', '05', '11')) ORDER BY trends.total_spend DESC, {TIES} LIMIT 10",
    ),
    "universe_summary": select(
        _AGG,
        ["count(DISTINCT state) AS total_states",
         "count(DISTINCT ndc11_normalized) AS total_drugs",
         "count(DISTINCT state || ndc11_normalized) AS total_state_drug_combinations",
         "min(quarter_start) AS earliest_quarter", "max(quarter_start) AS latest_quarter",
         shown_as("sum(total_spend)", "total_spend_all_time", 2)],
        "agg",
    ),
    "distinct_states": select(_AGG, "DISTINCT state", "agg", "ORDER BY state"),
    "state_drugs": select(
        _AGG, "DISTINCT ndc11_normalized, product_name_fda10", "agg", "WHERE state = '05'"
    ),
    "state_products": select(_AGG, "DISTINCT product_name_fda10", "agg", "WHERE state = '05'"),
    "trend_features_by_series": select(_FEATURES, FEATURES_SHOWN, "features"),
    "trend_features_long_by_series": select(_FEATURES, FEATURES_SHOWN, "features"),
    "thresholds_merged": select(
        _AGG,
        ["state", "CAST(year(quarter_start) AS INTEGER) AS year", "count(*) AS rows",
         "quantile_disc(total_spend, 0.75) AS spend_75th_percentile",
         "quantile_disc(total_spend, 0.9) AS spend_90th_percentile"],
        "agg", "GROUP BY ALL",
    ),
    "kpi_from_bitmaps": select(
        _AGG + """,
subsets(subset, states, first, last) AS (VALUES
  ('all', NULL, NULL, NULL),
  ('three states', ['03', '05', '11'], NULL, NULL),
  ('newer', NULL, DATE '1996-01-01', NULL),
  ('one state, one year', ['05'], DATE '1994-01-01', DATE '1994-12-31'),
  ('no state', ['none'], NULL, NULL)
)""",
        ["subset", shown_as("sum(total_spend)", "total_spend", 2),
         "count(DISTINCT ndc11_normalized) AS unique_drugs", "count(DISTINCT state) AS states",
         "max(quarter_start) AS latest_quarter",
         "strftime(max(quarter_start), '%Y-%m') AS latest_month"],
        "subsets LEFT JOIN agg ON (states IS NULL OR list_contains(states, state))"
        " AND (first IS NULL OR quarter_start >= first) AND (last IS NULL OR quarter_start <= last)",
        "GROUP BY subset",
    ),
    "forecast_universe": select(_UNIVERSE, AGG_SHOWN, "universe"),
    "forecast_universe_units": select(
        _UNIVERSE.replace("ORDER BY total_spend DESC", "ORDER BY total_units DESC"), AGG_SHOWN, "universe"
    ),
    "calendar_features": select(_CALENDAR, CALENDAR_SHOWN, "spans"),
    "forecast_changepoint": select(_UNIVERSE + _changepoints("universe", "spend"), "*", "model_forecasts"),
    "forecast_backtest": select(
        _UNIVERSE + _changepoints("latest", "spend"),
        ["state", "ndc11_normalized", "origin", "step", shown("forecast", 1), shown("actual", 4), shown("error", 1)],
        "tries",
    ),
    "forecast_short_series": select(
        _UNIVERSE.replace("p_brand AS ndc11", "CAST(p_partkey AS VARCHAR) AS ndc11").replace(
            "regexp_replace(p_brand,", "regexp_replace(CAST(p_partkey AS VARCHAR),")
        + _forecast("latest", "spend", exact=True), "*", "forecasts"
    ),
    "forecast_input": select(
        _UNIVERSE, AGG_SHOWN, "agg SEMI JOIN universe USING (state, ndc11_normalized)"
    ),
    "series_frame": select(
        _UNIVERSE, "state, ndc11_normalized, quarter_start AS ds, total_spend AS y",
        "agg SEMI JOIN universe USING (state, ndc11_normalized)",
    ),
    "forecast_seasonal_trend": select(
        _UNIVERSE + _forecast("latest", "units"), "*", "forecasts"
    ),
    "forecast_batch": select(_BATCH, "*", "forecasts"),
    "forecast_dates": f"""WITH {_AGG},
last AS (SELECT state, ndc11_normalized, max(quarter_start) AS last_quarter FROM agg GROUP BY ALL)
SELECT last.*, CAST(h AS INTEGER) AS forecast_period,
  CAST(last_quarter + to_months(CAST(3 * h AS INTEGER)) - INTERVAL 1 DAY AS DATE) AS forecast_date,
  CAST(last_quarter + to_months(CAST(3 * h AS INTEGER)) AS DATE) AS forecast_quarter_start
FROM last, range(1, 5) AS s(h)""",
    "forecast_grouped_map": f"""WITH {_DRIFT}
SELECT state, ndc11_normalized AS ndc11, product_name_fda10 AS product_name, 'spend' AS metric,
  CAST(h AS INTEGER) AS forecast_period,
  CAST(last + to_months(CAST(3 * h AS INTEGER)) - INTERVAL 1 DAY AS DATE) AS forecast_date,
  CAST(last + to_months(CAST(3 * h AS INTEGER)) AS DATE) AS forecast_quarter_start,
  {shown_as("y_last + step * h", "forecast_value", 2)},
  {shown_as("y_last + step * h - step", "forecast_lower", 2)},
  {shown_as("y_last + step * h + step", "forecast_upper", 2)},
  CASE WHEN n IS NULL OR n < 4 THEN 'Insufficient data' WHEN step < 0 THEN 'falling series' END AS error
FROM drifted""",
    "forecast_faulty_models": f"""WITH {_UNIVERSE},
points AS (
  SELECT state, ndc11_normalized, quarter_start AS ds, avg(total_spend) AS y,
    count(total_spend) AS n_rows
  FROM agg SEMI JOIN universe USING (state, ndc11_normalized) GROUP BY ALL
),
ends AS (
  SELECT state, ndc11_normalized, sum(n_rows) AS n, count(*) % 5 AS kind, max(ds) AS last,
    arg_max(y, ds) AS value
  FROM points GROUP BY ALL
),
flat AS (
  SELECT * EXCLUDE (h), CASE WHEN n >= 4 AND kind = 0 THEN h END AS h
  FROM universe LEFT JOIN ends USING (state, ndc11_normalized), range(1, 5) AS s(h)
  WHERE h = 1 OR (n >= 4 AND kind = 0)
)
SELECT state, ndc11_normalized AS ndc11, product_name_fda10 AS product_name, 'spend' AS metric,
  CAST(h AS INTEGER) AS forecast_period,
  CAST(last + to_months(CAST(3 * h AS INTEGER)) - INTERVAL 1 DAY AS DATE) AS forecast_date,
  CAST(last + to_months(CAST(3 * h AS INTEGER)) AS DATE) AS forecast_quarter_start,
  {', '.join(shown_as("CASE WHEN h IS NOT NULL THEN value END", f"forecast_{c}", 2) for c in ("value", "lower", "upper"))},
  CASE WHEN n IS NULL OR n < 4 THEN 'Insufficient data' WHEN kind = 1
    THEN 'the model gave no yhat, yhat_lower, yhat_upper' WHEN kind = 2
    THEN 'the model gave 2 steps of 4' WHEN kind = 3 THEN 'no number' WHEN kind = 4
    THEN 'the model gave no yhat' END AS error
FROM flat""",
    "history_with_forecast": f"""WITH {_BATCH}
SELECT state, ndc11_normalized, quarter_start, {shown_as("total_spend", "value", 2)},
  'historical' AS type
FROM agg SEMI JOIN universe USING (state, ndc11_normalized)
UNION ALL
SELECT state, ndc11, forecast_date, forecast_value, 'forecast' FROM forecasts WHERE error IS NULL""",
}

# The same results by another way.
ORACLES |= {
    "combined_join_by_series": ORACLES["combined_join"],
    "history_in_place": ORACLES["history_by_series"],
    "sql_top_spend": ORACLES["top_spend_latest_state"],
    "sql_top_risers": ORACLES["top_risers_latest"],
    "sql_watchlist": ORACLES["watchlist"],
}
