"""The derived panels of ebbtide.plans.views, written for the SQL side."""

from ebbtide.plans.views import PANEL

HOURS = "date_diff('microsecond', {a}, {b}) / 3600000000.0::DOUBLE"


def hours(a: str, b: str) -> str:
    return HOURS.format(a=a, b=b)


EVENT_PANEL = f"""
ev0 AS (SELECT CAST(user_id AS VARCHAR) || '_' || event_type AS entity, CAST(user_id AS VARCHAR) AS owner,
  event_id AS seq, ts AS reading_ts, TIMESTAMP '2024-01-01' + (user_id % 24) * INTERVAL 1 HOUR AS published_at,
  CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id
       ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cents FROM events),
p AS (SELECT entity, owner, seq, reading_ts, published_at, {hours('published_at', 'reading_ts')} AS age_hours,
  cents / 100.0::DOUBLE * (CASE WHEN seq % 17 = 0 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END) AS value
  FROM ev0 WHERE reading_ts >= published_at)"""

PART_PANEL = f"""
li0 AS (SELECT CAST(l_partkey AS VARCHAR) AS entity, CAST(l_partkey % 25 AS VARCHAR) AS owner,
  l_orderkey * 100 + l_linenumber AS seq, l_shipdate AS reading_ts, l_orderkey AS k,
  CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_partkey
       ORDER BY l_shipdate, l_orderkey * 100 + l_linenumber ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM lineitem),
p AS (SELECT entity, owner, seq, reading_ts, TIMESTAMP '1992-01-01' AS published_at,
  {hours("TIMESTAMP '1992-01-01'", 'reading_ts')} AS age_hours,
  CAST(total AS DOUBLE) * (CASE WHEN k % 17 = 0 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END) AS value FROM li0)"""

WEEKLY_PANEL = f"""
wk0 AS (SELECT CAST(user_id AS VARCHAR) || '_' || strftime(date_trunc('week', ts), '%Y%m%d') AS entity,
  CAST(user_id AS VARCHAR) AS owner, CASE WHEN user_id % 3 = 0 THEN 'photo' ELSE 'video' END AS source,
  event_id AS seq, ts AS reading_ts,
  CAST(date_trunc('week', ts) AS TIMESTAMP) + (user_id % 24) * INTERVAL 1 HOUR AS published_at,
  CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS BIGINT) AS cents,
  CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS clicks,
  CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS buys
  FROM events WINDOW w AS (PARTITION BY user_id, date_trunc('week', ts) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
wk1 AS (SELECT entity, owner, source, seq, reading_ts, published_at, {hours('published_at', 'reading_ts')} AS age_hours,
  cents - CASE WHEN seq % 17 = 0 THEN cents // 10 ELSE 0 END AS views,
  CASE WHEN seq % 29 <> 0 THEN clicks END AS likes, buys AS comments FROM wk0 WHERE reading_ts >= published_at),
p AS (SELECT *, CASE source WHEN 'video' THEN 'views' WHEN 'photo' THEN 'likes' END AS primary_metric,
  CAST(CASE source WHEN 'video' THEN views WHEN 'photo' THEN likes END AS DOUBLE) AS value FROM wk1)"""

WEEKLY_ENTITIES = """
en0 AS (SELECT DISTINCT user_id, CAST(date_trunc('week', ts) AS TIMESTAMP) AS week FROM events),
en AS (SELECT CAST(user_id AS VARCHAR) || '_' || strftime(week, '%Y%m%d') AS entity, CAST(user_id AS VARCHAR) AS owner,
  CASE WHEN user_id % 3 = 0 THEN 'photo' ELSE 'video' END AS source,
  week + (user_id % 24) * INTERVAL 1 HOUR AS published_at,
  CASE WHEN round(c_acctbal * 100) > 0 THEN CAST(round(c_acctbal * 100) AS BIGINT) END AS follower_count,
  c_mktsegment AS stratum_category, nullif(CAST(user_id % 7 * 100 AS DOUBLE), 0) AS duration_sec,
  length(c_name) AS title_len, c_nationkey AS tag_count, user_id % 41 = 0 AS counts_hidden,
  CASE WHEN c_acctbal IS NULL OR round(c_acctbal * 100) <= 0 THEN 'unknown' WHEN round(c_acctbal * 100) < 10000 THEN 'micro'
       WHEN round(c_acctbal * 100) < 500000 THEN 'mid' ELSE 'large' END AS stratum_tier
  FROM en0 LEFT JOIN customer ON user_id = c_custkey)"""

ORDER_ENTITIES = """
oe AS (SELECT CAST(o_orderkey AS VARCHAR) AS entity, CAST(o_custkey % 7 AS VARCHAR) AS owner,
  CASE WHEN o_orderkey % 4 = 0 THEN 'photo' ELSE 'video' END AS source, o_orderdate AS published_at FROM orders)"""


def label_ctes(src: str = "p", frac: float = PANEL.frac, sustain: int = 2, min_intervals: int = 4,
               skip_first: bool = False, out: str = "lab") -> str:
    """The decay label of table `src`(entity, age_hours, value, seq) as CTEs ending in `out`."""
    lead = "".join(f", lead(vel, {j}) OVER e AS v{j}" for j in range(1, sustain))
    slow = " AND ".join([f"vel < {frac!r}::DOUBLE * peak"] +
                        [f"v{j} < {frac!r}::DOUBLE * peak" for j in range(1, sustain)])
    pool = "CASE WHEN iv > 1 OR n_iv <= 1 THEN vel END" if skip_first else "vel"
    return f"""
{out}_a AS (SELECT entity, arg_max(age_hours, seq) AS age, arg_max(value, seq) AS value FROM {src}
  WHERE value IS NOT NULL AND age_hours IS NOT NULL GROUP BY entity, round(age_hours, 9)),
{out}_b AS (SELECT *, max(value) OVER (PARTITION BY entity ORDER BY age ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pv,
  lag(age) OVER (PARTITION BY entity ORDER BY age) AS pa FROM {out}_a),
{out}_c AS (SELECT *, greatest(value, coalesce(pv, value)) AS cl, coalesce(value < pv, false) AS rep,
  CASE WHEN pa IS NOT NULL THEN (greatest(value, pv) - pv) / (age - pa) END AS vel FROM {out}_b),
{out}_c2 AS (SELECT *, count(vel) OVER (PARTITION BY entity ORDER BY age ROWS UNBOUNDED PRECEDING) AS iv,
  count(vel) OVER (PARTITION BY entity) AS n_iv FROM {out}_c),
{out}_d AS (SELECT *, {pool} AS pool, max({pool}) OVER (PARTITION BY entity) AS peak{lead} FROM {out}_c2
  WINDOW e AS (PARTITION BY entity ORDER BY age)),
{out}_e AS (SELECT entity, count(*) AS n_observations, count(vel) AS n_intervals, max(age) AS last_observed_hours,
  max(cl) AS final_value, sum(CASE WHEN rep THEN 1 ELSE 0 END) AS monotonicity_repairs, max(peak) AS peak,
  min(CASE WHEN pool = peak THEN age END) AS peak_at, min(CASE WHEN {slow} THEN age END) AS death
  FROM {out}_d GROUP BY entity),
{out} AS (SELECT entity,
  CASE WHEN n_intervals < {min_intervals} THEN 'insufficient_observations' WHEN peak <= 0 THEN 'no_positive_velocity' END AS exclude_reason,
  CASE WHEN n_intervals >= {min_intervals} AND peak > 0 THEN coalesce(death, last_observed_hours) END AS t_death,
  n_intervals >= {min_intervals} AND peak > 0 AND death IS NOT NULL AS event_observed,
  CASE WHEN n_intervals >= {min_intervals} THEN peak END AS peak_velocity,
  CASE WHEN n_intervals >= {min_intervals} THEN peak_at END AS peak_at_hours,
  n_observations, n_intervals, last_observed_hours, final_value, monotonicity_repairs FROM {out}_e)"""


LABEL_COLS = ("entity, ~t_death, event_observed, ~peak_velocity, ~peak_at_hours, #n_observations, #n_intervals, "
              "~last_observed_hours, ~final_value, #monotonicity_repairs, exclude_reason")


def value_at_ctes(targets, src: str = "p", value: str = "value", until: float | None = None,
                  out: str = "va") -> str:
    """Interpolated values v0, v1, ... per entity."""
    ok = f"{value} IS NOT NULL AND age_hours IS NOT NULL" + (f" AND age_hours <= {until!r}" if until else "")
    agg, sel = [], []
    for i, t in enumerate(targets):
        agg.append(f"max(CASE WHEN {ok} AND age_hours < {t!r} THEN age_hours END) AS a{i}, "
                   f"min(CASE WHEN {ok} AND age_hours >= {t!r} THEN age_hours END) AS b{i}, "
                   f"arg_max({value}, CASE WHEN {ok} AND age_hours < {t!r} THEN age_hours END) AS x{i}, "
                   f"arg_min({value}, CASE WHEN {ok} AND age_hours >= {t!r} THEN age_hours END) AS y{i}")
        sel.append(f"CASE WHEN b{i} = {t!r} AND n_readings >= 2 THEN y{i} WHEN b{i} > {t!r} AND a{i} IS NOT NULL "
                   f"THEN x{i} + ({t!r}::DOUBLE - a{i}) / (b{i} - a{i}) * (y{i} - x{i}) END AS v{i}")
    return f"""
{out}_0 AS (SELECT entity, count(*) AS n_rows, count({value}) AS n_values,
  sum(CASE WHEN {ok} THEN 1 ELSE 0 END) AS n_readings, min(CASE WHEN {ok} THEN age_hours END) AS first_age,
  max(CASE WHEN {ok} THEN age_hours END) AS last_age, {', '.join(agg)} FROM {src} GROUP BY entity),
{out} AS (SELECT entity, n_rows, n_values, n_readings, first_age, last_age, {', '.join(sel)} FROM {out}_0)"""


def early_ctes(cfg=PANEL, cutoff: float | None = None, src: str = "p", out: str = "ef") -> str:
    m = cfg.early_marks
    lr = lambda a, b: f"CASE WHEN {b} > 0 AND {a} > 0 THEN log10({a} / {b}) END"
    lg = lambda a: f"CASE WHEN {a} + 1 > 0 THEN log10({a} + 1) END"
    return value_at_ctes(m, src, until=cfg.feature_cutoff if cutoff is None else cutoff, out=out + "v") + f""",
{out} AS (SELECT *, n_readings AS n_early_observations, first_age AS first_observed_at_hours,
  v0 AS value_at_m1, v1 AS value_at_m2, v2 AS value_at_m3,
  v0 / {m[0]!r} AS velocity_to_m1, v1 / {m[1]!r} AS velocity_to_m2, v2 / {m[2]!r} AS velocity_to_m3,
  (v1 - v0) / {m[1] - m[0]!r} AS velocity_12, (v2 - v1) / {m[2] - m[1]!r} AS velocity_23,
  {lr('v1', 'v0')} AS log_growth_12, {lr('v2', 'v1')} AS log_growth_23,
  (v2 - v1) / {m[2] - m[1]!r} - (v1 - v0) / {m[1] - m[0]!r} AS acceleration,
  ((v2 - v1) / {m[2] - m[1]!r}) / nullif((v1 - v0) / {m[1] - m[0]!r}, 0) AS decay_ratio,
  {lg('v0')} AS log_value_m1, {lg('v1')} AS log_value_m2, {lg('v2')} AS log_value_m3 FROM {out}v)"""


EARLY_COLS = ("entity, #n_early_observations, ~first_observed_at_hours, ~value_at_m1, ~value_at_m2, ~value_at_m3, "
              "~velocity_to_m1, ~velocity_to_m2, ~velocity_to_m3, ~velocity_12, ~velocity_23, ~log_growth_12, "
              "~log_growth_23, ~acceleration, ~decay_ratio, ~log_value_m1, ~log_value_m2, ~log_value_m3")


def cap_ctes(src: str, caps=PANEL.daily_cap, out: str = "capped") -> str:
    limit = "CASE source " + " ".join(f"WHEN '{s}' THEN {n or 10**9}" for s, n in caps.items()) + f" ELSE {10**9} END"
    return f"""
{out} AS (SELECT *, row_number() OVER (PARTITION BY owner, CAST(published_at AS DATE) ORDER BY published_at, entity)
  > {limit} AS over_daily_cap FROM {src})"""
