"""DuckDB oracle SQL for the registered queries.

Every statement starts from the same adapter + cleaning CTEs over the raw
driver tables (``events`` seen as user-weeks), written independently of the
Spark code so that the two sides only share the specification.  Doubles are
rounded to 6 places on both sides.
"""

from __future__ import annotations

# Adapter (events as user-weeks) and cleaning: nulls out, first copy kept.
LOG_CTE = """
raw_log AS (
  SELECT CAST(user_id AS VARCHAR) || '-' || strftime(date_trunc('week', ts), '%Y-%m-%d') AS case_id,
         event_type AS activity,
         CAST(ts AS TIMESTAMP) AS ts,
         json_extract_string(props, '$.k') AS resource,
         CAST(value AS DOUBLE) AS requested_amount,
         CAST(event_id AS BIGINT) AS event_seq
  FROM events
),
log AS (
  SELECT * FROM raw_log
  WHERE case_id IS NOT NULL AND activity IS NOT NULL AND ts IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY case_id, activity, ts
                             ORDER BY event_seq NULLS FIRST, resource NULLS FIRST) = 1
)"""

TRANS_CTE = LOG_CTE + """,
trans AS (
  SELECT *, lag(ts) OVER w AS prev_ts, lag(activity) OVER w AS prev_activity,
         date_diff('microsecond', lag(ts) OVER w, ts) / 3600000000.0 AS waiting_hours,
         row_number() OVER w - 1 AS position
  FROM log
  WINDOW w AS (PARTITION BY case_id ORDER BY ts, event_seq, activity)
),
valid AS (
  SELECT * FROM trans
  WHERE prev_activity IS NOT NULL AND waiting_hours >= 0 AND waiting_hours < 1440
)"""


def _w(body: str, cte: str = LOG_CTE) -> str:
    return "WITH " + cte.strip() + "\n" + body.strip()


ORACLE: dict[str, str] = {}

ORACLE["cln_clean_log"] = _w("""
SELECT case_id, activity, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, resource,
       round(requested_amount, 6) AS requested_amount, event_seq
FROM log""")

ORACLE["cln_profile"] = _w("""
SELECT (SELECT count(*) FROM raw_log) AS original_events,
       (SELECT count(*) FROM raw_log) - count(*) AS removed_events,
       count(*) AS clean_events,
       count(DISTINCT case_id) AS unique_cases,
       count(DISTINCT activity) AS unique_activities,
       strftime(min(ts), '%Y-%m-%d') AS first_date,
       strftime(max(ts), '%Y-%m-%d') AS last_date
FROM log""")

ORACLE["win_transitions"] = _w("""
SELECT case_id, activity, event_seq, prev_activity,
       strftime(prev_ts, '%Y-%m-%d %H:%M:%S.%f') AS prev_ts,
       round(waiting_hours, 6) AS waiting_hours, CAST(position AS BIGINT) AS position
FROM trans""", TRANS_CTE)

ORACLE["btn_bottleneck"] = _w("""
SELECT activity,
       round(avg(waiting_hours), 6) AS mean_wait_hours,
       round(quantile_cont(waiting_hours, 0.5), 6) AS median_wait_hours,
       round(sum(waiting_hours), 4) AS total_wait_hours,
       count(waiting_hours) AS n_occurrences,
       round(quantile_cont(waiting_hours, 0.9), 6) AS p90_wait_hours,
       round(avg(waiting_hours) / 24, 6) AS mean_wait_days,
       round(sum(waiting_hours) / 24, 4) AS total_wait_days,
       round(avg(waiting_hours) * count(waiting_hours), 4) AS bottleneck_score
FROM valid GROUP BY activity""", TRANS_CTE)

ORACLE["btn_transition_waits"] = _w("""
SELECT prev_activity AS from_activity, activity,
       round(avg(waiting_hours), 6) AS mean_wait_hours,
       count(*) AS n_transitions
FROM valid GROUP BY prev_activity, activity""", TRANS_CTE)


# --- case level ----------------------------------------------------------------

def _outcome_sql(col: str) -> str:
    from caseflow.model import EVENTS_MODEL

    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in sorted(EVENTS_MODEL.outcome_map.items()))
    return f"CASE {col} {whens} ELSE '{EVENTS_MODEL.outcome_default}' END"


CASES_CTE = TRANS_CTE + f""",
case_raw AS (
  SELECT case_id,
         min(ts) AS case_start, max(ts) AS case_end,
         date_diff('microsecond', min(ts), max(ts)) / 3600000000.0 AS duration_hours,
         count(activity) AS n_events,
         count(DISTINCT activity) AS n_unique_activities,
         count(DISTINCT resource) AS n_resources,
         first(activity ORDER BY ts DESC, event_seq DESC, activity DESC) AS last_activity,
         first(activity ORDER BY ts, event_seq, activity) AS first_activity,
         first(requested_amount ORDER BY ts, event_seq, activity)
           FILTER (WHERE requested_amount IS NOT NULL) AS requested_amount,
         bool_or(activity IN ('error')) AS has_marker,
         min(position) FILTER (WHERE activity IN ('view')) AS first_a,
         max(position) FILTER (WHERE activity IN ('click')) AS last_o
  FROM trans GROUP BY case_id
),
cases AS (
  SELECT *, duration_hours / 24 AS duration_days,
         {_outcome_sql('last_activity')} AS outcome,
         CAST(duration_hours / 24 > 5 AS INTEGER) AS sla_breach,
         5 AS sla_days,
         CAST(month(case_start) AS INTEGER) AS start_month,
         CAST(quarter(case_start) AS INTEGER) AS start_quarter,
         dayname(case_start) AS start_dow,
         strftime(case_start, '%b') AS start_month_name,
         CASE WHEN duration_hours / 24 <= 7 THEN '1 - 0-7 days (Fast)'
              WHEN duration_hours / 24 <= 14 THEN '2 - 8-14 days (On Time)'
              WHEN duration_hours / 24 <= 21 THEN '3 - 15-21 days (Late)'
              WHEN duration_hours / 24 <= 30 THEN '4 - 22-30 days (Very Late)'
              ELSE '5 - 30+ days (Critical)' END AS duration_bucket,
         CAST(n_events - n_unique_activities AS BIGINT) AS rework_events,
         CAST(n_events > n_unique_activities AS INTEGER) AS has_rework
  FROM case_raw
),
variants AS (
  SELECT case_id, string_agg(activity, ' → ' ORDER BY ts, event_seq, activity) AS variant
  FROM log GROUP BY case_id
),
vcounts AS (
  SELECT variant, count(*) AS n_cases FROM variants GROUP BY variant
),
vranks AS (
  SELECT variant, n_cases,
         row_number() OVER (ORDER BY n_cases DESC, variant ASC) AS variant_rank
  FROM vcounts
),
cvar AS (
  SELECT c.case_id, c.sla_breach, v.variant, r.variant_rank
  FROM cases c LEFT JOIN variants v USING (case_id) LEFT JOIN vranks r USING (variant)
),
conf AS (
  SELECT case_id,
         coalesce(first_activity IN ('signup'), false) AS s_ok,
         coalesce(last_activity IN ('purchase'), false) AS e_ok,
         NOT coalesce(has_marker, false) AS r_ok,
         (first_a IS NULL OR last_o IS NULL OR first_a < last_o) AS o_ok
  FROM case_raw
),
conf2 AS (
  SELECT case_id,
         CAST(s_ok AND e_ok AND r_ok AND o_ok AS INTEGER) AS is_conformant,
         CAST(s_ok AS INTEGER) AS starts_correctly, CAST(e_ok AS INTEGER) AS ends_correctly,
         CAST(r_ok AS INTEGER) AS no_rework_conf, CAST(o_ok AS INTEGER) AS correct_order,
         coalesce(nullif(concat_ws(',',
             CASE WHEN NOT s_ok THEN 'bad_start' END, CASE WHEN NOT e_ok THEN 'bad_end' END,
             CASE WHEN NOT r_ok THEN 'rework_detected' END,
             CASE WHEN NOT o_ok THEN 'wrong_order' END), ''), 'none') AS deviation_types
  FROM conf
),
acounts AS (
  SELECT case_id, activity, count(*) AS count FROM log GROUP BY case_id, activity
)"""

ORACLE["cas_case_table"] = _w("""
SELECT case_id, strftime(case_start, '%Y-%m-%d %H:%M:%S') AS case_start,
       strftime(case_end, '%Y-%m-%d %H:%M:%S') AS case_end,
       round(duration_hours, 6) AS duration_hours, round(duration_days, 6) AS duration_days,
       n_events, n_unique_activities, n_resources, last_activity,
       CAST(NULL AS VARCHAR) AS loan_goal,
       round(requested_amount, 6) AS requested_amount,
       CAST(NULL AS VARCHAR) AS application_type, outcome, sla_breach, sla_days,
       start_month, start_quarter, start_dow, start_month_name, duration_bucket,
       has_rework, rework_events
FROM cases""", CASES_CTE)

ORACLE["cas_duration_profile"] = _w("""
SELECT count(*) AS n_cases, CAST(sum(sla_breach) AS BIGINT) AS sla_breaches,
       round(avg(sla_breach) * 100, 6) AS breach_pct,
       round((1 - avg(sla_breach)) * 100, 6) AS met_pct,
       round(avg(duration_days), 6) AS mean_days,
       round(quantile_cont(duration_days, 0.5), 6) AS median_days,
       round(min(duration_days), 6) AS min_days, round(max(duration_days), 6) AS max_days
FROM cases""", CASES_CTE)

ORACLE["cas_outcome_distribution"] = _w("""
SELECT outcome, count(*) AS n_cases,
       round(count(*) * 100.0 / (SELECT count(*) FROM cases), 6) AS share_pct
FROM cases GROUP BY outcome""", CASES_CTE)

ORACLE["cas_completed_cases"] = _w("""
SELECT case_id, outcome, round(duration_days, 6) AS duration_days, sla_breach
FROM cases WHERE outcome <> 'Still Processing'""", CASES_CTE)

ORACLE["var_case_variants"] = _w("""
SELECT case_id, variant, CAST(variant_rank AS BIGINT) AS variant_rank,
       CAST(coalesce(variant_rank <= 3, false) AS INTEGER) AS is_top3_variant,
       CAST(coalesce(variant_rank <= 10, false) AS INTEGER) AS is_top10_variant
FROM cvar""", CASES_CTE)

ORACLE["var_counts"] = _w("""
SELECT variant, n_cases, CAST(variant_rank AS BIGINT) AS variant_rank FROM vranks""", CASES_CTE)

ORACLE["var_activity_frequency"] = _w("""
SELECT activity, count(*) AS n_events,
       round(count(*) * 100.0 / (SELECT count(*) FROM log), 6) AS share_pct
FROM log GROUP BY activity""", CASES_CTE)

ORACLE["var_coverage"] = _w("""
SELECT count(*) AS n_variants, CAST(sum(n_cases) AS BIGINT) AS n_cases,
       round(sum(n_cases) FILTER (WHERE variant_rank <= 3) * 100.0 / sum(n_cases), 6) AS top3_share_pct,
       round(sum(n_cases) FILTER (WHERE variant_rank <= 10) * 100.0 / sum(n_cases), 6) AS top10_share_pct,
       round(100 - sum(n_cases) FILTER (WHERE variant_rank <= 3) * 100.0 / sum(n_cases), 6) AS tail_share_pct
FROM vranks""", CASES_CTE)

ORACLE["var_top5"] = _w("""
SELECT CAST(variant_rank AS BIGINT) AS variant_rank, variant, n_cases,
       round(n_cases * 100.0 / (SELECT sum(n_cases) FROM vranks), 6) AS share_pct,
       CASE WHEN length(variant) < 80 THEN variant ELSE substring(variant, 1, 77) || '...' END
         AS variant_short
FROM vranks WHERE variant_rank <= 5""", CASES_CTE)

ORACLE["var_pareto"] = _w("""
SELECT CAST(variant_rank AS BIGINT) AS variant_rank, n_cases,
       round(sum(n_cases) OVER (ORDER BY variant_rank) * 100.0
             / (SELECT sum(n_cases) FROM vranks), 6) AS cumulative_pct,
       CAST(sum(n_cases) OVER (ORDER BY variant_rank) * 100.0
             / (SELECT sum(n_cases) FROM vranks) >= 80 AS INTEGER) AS above_80
FROM vranks WHERE variant_rank <= 20""", CASES_CTE)

ORACLE["var_breach_by_rank_bucket"] = _w("""
SELECT CASE WHEN variant_rank <= 1 THEN 'Rank 1' || chr(10) || '(Most common)'
            WHEN variant_rank <= 3 THEN 'Rank 2-3' WHEN variant_rank <= 10 THEN 'Rank 4-10'
            WHEN variant_rank <= 50 THEN 'Rank 11-50' ELSE 'Rank 51+' END AS rank_bucket,
       CASE WHEN variant_rank <= 1 THEN 1 WHEN variant_rank <= 3 THEN 2
            WHEN variant_rank <= 10 THEN 3 WHEN variant_rank <= 50 THEN 4 ELSE 5 END AS bucket_order,
       round(avg(sla_breach) * 100, 6) AS breach_rate_pct, count(*) AS n_cases
FROM cvar GROUP BY 1, 2""", CASES_CTE)

ORACLE["rwk_activity_counts"] = _w("""
SELECT case_id, activity, count FROM acounts""", CASES_CTE)

ORACLE["rwk_prevalence"] = _w("""
SELECT CAST(sum(CAST(mx > 1 AS BIGINT)) AS BIGINT) AS cases_with_rework, count(*) AS total_cases,
       round(avg(CAST(mx > 1 AS DOUBLE)) * 100, 6) AS rework_pct,
       CAST(sum(extra) AS BIGINT) AS rework_events
FROM (SELECT case_id, max(count) AS mx, sum(count - 1) AS extra FROM acounts GROUP BY case_id)""",
                              CASES_CTE)

ORACLE["rwk_by_activity"] = _w("""
SELECT activity, count(*) AS cases_with_rework, round(avg(count), 6) AS avg_repeats,
       CAST(row_number() OVER (ORDER BY count(*) DESC, activity) AS BIGINT) AS rework_rank
FROM acounts WHERE count > 1 GROUP BY activity
ORDER BY cases_with_rework DESC, activity LIMIT 10""", CASES_CTE)

ORACLE["rwk_case_flags"] = _w("""
SELECT case_id, CAST(max(count) > 1 AS INTEGER) AS has_rework,
       CAST(sum(count - 1) AS BIGINT) AS rework_events
FROM acounts GROUP BY case_id""", CASES_CTE)

ORACLE["cnf_case_conformance"] = _w("""
SELECT * FROM conf2""", CASES_CTE)

ORACLE["cnf_rate"] = _w("""
SELECT round(avg(is_conformant) * 100, 6) AS conformance_rate_pct,
       CAST(sum(is_conformant) AS BIGINT) AS conformant_cases,
       CAST(sum(1 - is_conformant) AS BIGINT) AS non_conformant_cases,
       count(*) AS n_cases
FROM conf2""", CASES_CTE)

ORACLE["cnf_deviations"] = _w("""
SELECT deviation, count(*) AS n_cases
FROM (SELECT unnest(string_split(deviation_types, ',')) AS deviation
      FROM conf2 WHERE deviation_types <> 'none')
GROUP BY deviation""", CASES_CTE)

ORACLE["cnf_breach_by_conformance"] = _w("""
SELECT round(avg(sla_breach) FILTER (WHERE coalesce(is_conformant, 0) = 1) * 100, 6)
         AS breach_pct_conformant,
       round(avg(sla_breach) FILTER (WHERE coalesce(is_conformant, 0) = 0) * 100, 6)
         AS breach_pct_non_conformant,
       round(CASE WHEN avg(sla_breach) FILTER (WHERE coalesce(is_conformant, 0) = 1) > 0
             THEN avg(sla_breach) FILTER (WHERE coalesce(is_conformant, 0) = 0)
                  / avg(sla_breach) FILTER (WHERE coalesce(is_conformant, 0) = 1) END, 6)
         AS breach_ratio
FROM cases LEFT JOIN conf2 USING (case_id)""", CASES_CTE)

ORACLE["btn_top_bottlenecks"] = _w("""
SELECT activity, round(avg(waiting_hours), 6) AS mean_wait_hours,
       count(*) AS n_occurrences,
       round(sum(waiting_hours) / 24, 4) AS total_wait_days,
       round(avg(waiting_hours) * count(*), 4) AS bottleneck_score,
       CAST(row_number() OVER (ORDER BY avg(waiting_hours) * count(*) DESC, activity) AS BIGINT)
         AS bottleneck_rank
FROM valid GROUP BY activity
ORDER BY bottleneck_score DESC, activity LIMIT 10""", CASES_CTE)


# --- chart data and KPIs ---------------------------------------------------------

def _hist_sql(expr: str, clip: float, bins: int) -> str:
    return f"""
, hv AS (SELECT least(CAST({expr} AS DOUBLE), {clip}) AS x FROM cases),
hr AS (SELECT CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
              CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM hv),
hb AS (SELECT least(floor((x - lo) * ({float(bins)} / (hi - lo))), {bins - 1}) AS bin FROM hv, hr),
hc AS (SELECT bin, count(*) AS n FROM hb GROUP BY bin),
hm AS (SELECT quantile_cont(CAST({expr} AS DOUBLE), 0.5) AS median FROM cases)
SELECT CAST(g.range AS INTEGER) AS bin,
       round(lo + g.range * ((hi - lo) / {float(bins)}), 6) AS bin_start,
       round(lo + (g.range + 1) * ((hi - lo) / {float(bins)}), 6) AS bin_end,
       CAST(coalesce(hc.n, 0) AS BIGINT) AS n_cases, round(median, 6) AS median
FROM range(0, {bins}) g CROSS JOIN hr CROSS JOIN hm LEFT JOIN hc ON hc.bin = g.range"""


def _w_tail(tail: str) -> str:
    """Statement whose extra CTEs continue the case-level CTE list."""
    return "WITH " + CASES_CTE.strip() + "\n" + tail


ORACLE["cht_duration_histogram"] = _w_tail(_hist_sql("duration_days", 60.0, 40))
ORACLE["cht_events_histogram"] = _w_tail(_hist_sql("n_events", 50.0, 30))
ORACLE["cht_activities_histogram"] = _w_tail(_hist_sql("n_unique_activities", 20.0, 20))

ORACLE["cht_breach_by_month"] = _w("""
SELECT start_month, round(avg(sla_breach), 6) AS breach_rate, count(*) AS n_cases,
       CAST(row_number() OVER (ORDER BY avg(sla_breach) DESC, start_month) = 1 AS INTEGER) AS is_peak
FROM cases GROUP BY start_month""", CASES_CTE)

BOX_TAIL = """
, bq AS (SELECT {g}quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
                quantile_cont(v, 0.75) AS q3 FROM bv {gb}),
bf AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo_f, q3 + 1.5 * (q3 - q1) AS hi_f FROM bq)
SELECT {g}count(*) AS n, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median,
       round(any_value(q3), 6) AS q3,
       round(min(v) FILTER (WHERE v >= lo_f AND v <= hi_f), 6) AS whisker_low,
       round(max(v) FILTER (WHERE v >= lo_f AND v <= hi_f), 6) AS whisker_high,
       CAST(count(*) FILTER (WHERE NOT (v >= lo_f AND v <= hi_f)) AS BIGINT) AS n_outliers
FROM bv JOIN bf USING ({key}) {gb}"""

ORACLE["cht_duration_box_by_outcome"] = _w_tail("""
, bv AS (SELECT outcome, least(duration_days, 60.0) AS v FROM cases)""" + BOX_TAIL.format(
    g="outcome, ", gb="GROUP BY outcome", key="outcome"))

ORACLE["cht_breach_by_amount_quintile"] = _w_tail("""
, amt AS (SELECT requested_amount AS x, sla_breach FROM cases WHERE requested_amount IS NOT NULL),
ed AS (SELECT list_sort(list_distinct(quantile_cont(x, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS edges
       FROM amt),
bk AS (SELECT greatest(1, coalesce(CAST(edges[1] < x AS INTEGER), 0) + coalesce(CAST(edges[2] < x AS INTEGER), 0) + coalesce(CAST(edges[3] < x AS INTEGER), 0) + coalesce(CAST(edges[4] < x AS INTEGER), 0) + coalesce(CAST(edges[5] < x AS INTEGER), 0) + coalesce(CAST(edges[6] < x AS INTEGER), 0)) AS bucket,
              edges, sla_breach
       FROM amt, ed)
SELECT CAST(bucket AS INTEGER) AS bucket, round(edges[bucket], 6) AS lower_edge,
       round(edges[least(bucket + 1, len(edges))], 6) AS upper_edge,
       round(avg(sla_breach) * 100, 6) AS breach_rate_pct, count(*) AS n_cases,
       'Q' || CAST(bucket AS VARCHAR) AS label
FROM bk GROUP BY bucket, edges""")

ORACLE["cht_event_volume"] = _w("""
SELECT strftime(date_trunc('month', ts), '%Y-%m') AS month, count(*) AS n_events
FROM log GROUP BY 1""")

ORACLE["btn_wait_box_top5"] = _w_tail("""
, bstat AS (SELECT activity, avg(waiting_hours) * count(*) AS score FROM valid GROUP BY activity),
btop AS (SELECT activity, CAST(row_number() OVER (ORDER BY score DESC, activity) AS BIGINT)
                AS bottleneck_rank FROM bstat ORDER BY score DESC, activity LIMIT 5),
bcap AS (SELECT quantile_cont(waiting_hours, 0.95) AS cap FROM valid),
bv AS (SELECT activity, least(waiting_hours, cap) AS v FROM valid JOIN btop USING (activity), bcap)
""" + BOX_TAIL.format(g="activity, ", gb="GROUP BY activity", key="activity").replace(
    "SELECT activity, count(*) AS n,",
    "SELECT activity, any_value(bottleneck_rank) AS bottleneck_rank, count(*) AS n,").replace(
    "FROM bv JOIN bf USING (activity)", "FROM bv JOIN bf USING (activity) JOIN btop USING (activity)"))

ORACLE["kpi_discovery_summary"] = _w("""
SELECT (SELECT count(*) FROM log) AS n_events,
       (SELECT count(*) FROM cases) AS n_cases,
       (SELECT count(DISTINCT activity) FROM log) AS n_activities,
       (SELECT strftime(min(ts), '%Y-%m-%d') FROM log) AS first_date,
       (SELECT strftime(max(ts), '%Y-%m-%d') FROM log) AS last_date,
       (SELECT count(*) FROM vranks) AS n_variants,
       round((SELECT sum(n_cases) FILTER (WHERE variant_rank <= 3) * 100.0 / sum(n_cases)
              FROM vranks), 6) AS top3_share_pct,
       round(100 - (SELECT sum(n_cases) FILTER (WHERE variant_rank <= 3) * 100.0 / sum(n_cases)
              FROM vranks), 6) AS tail_share_pct,
       round(avg(duration_days), 6) AS mean_days,
       round(quantile_cont(duration_days, 0.5), 6) AS median_days,
       round(min(duration_days), 6) AS min_days, round(max(duration_days), 6) AS max_days,
       CAST(sum(sla_breach) AS BIGINT) AS sla_breaches,
       round(avg(sla_breach) * 100, 6) AS breach_pct,
       round((1 - avg(sla_breach)) * 100, 6) AS met_pct
FROM cases""", CASES_CTE)

ORACLE["kpi_bottleneck_summary"] = _w("""
SELECT t.activity AS top_bottleneck, round(t.mean_wait_hours, 6) AS top_mean_wait_hours,
       round(t.total_wait_days, 4) AS top_total_wait_days,
       round(r.rework_pct, 6) AS rework_pct, r.rework_events,
       round(c.conformance_rate_pct, 6) AS conformance_rate_pct,
       round(100 - c.conformance_rate_pct, 6) AS non_conformance_pct
FROM (SELECT activity, avg(waiting_hours) AS mean_wait_hours,
             sum(waiting_hours) / 24 AS total_wait_days
      FROM valid GROUP BY activity
      ORDER BY avg(waiting_hours) * count(*) DESC, activity LIMIT 1) t,
     (SELECT avg(CAST(mx > 1 AS DOUBLE)) * 100 AS rework_pct,
             CAST(sum(extra) AS BIGINT) AS rework_events
      FROM (SELECT case_id, max(count) AS mx, sum(count - 1) AS extra
            FROM acounts GROUP BY case_id)) r,
     (SELECT avg(is_conformant) * 100 AS conformance_rate_pct FROM conf2) c""", CASES_CTE)

ORACLE["kpi_monthly_trend"] = _w("""
SELECT strftime(date_trunc('month', case_start), '%Y-%m') AS start_period, count(*) AS n_cases,
       round(avg(sla_breach) * 100, 6) AS breach_rate_pct, round(avg(duration_days), 6) AS mean_days
FROM cases GROUP BY 1""", CASES_CTE)

ORACLE["kpi_outcome_sla"] = _w("""
SELECT outcome, CAST(count(*) FILTER (WHERE sla_breach = 0) AS BIGINT) AS sla_met,
       CAST(count(*) FILTER (WHERE sla_breach = 1) AS BIGINT) AS sla_breached
FROM cases GROUP BY outcome""", CASES_CTE)

ORACLE["kpi_complexity"] = _w("""
SELECT n_unique_activities, count(*) AS n_cases, round(avg(duration_days), 6) AS mean_days,
       round(quantile_cont(duration_days, 0.5), 6) AS median_days
FROM cases GROUP BY n_unique_activities""", CASES_CTE)


# --- sources, sinks, adapters ----------------------------------------------------

ORACLE["src_xes_roundtrip"] = _w("""
SELECT case_id, activity, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, resource FROM log""")

ORACLE["src_csv_event_roundtrip"] = ORACLE["cln_clean_log"]

ORACLE["src_csv_case_roundtrip"] = _w("""
SELECT case_id, strftime(case_start, '%Y-%m-%d %H:%M:%S') AS case_start,
       strftime(case_end, '%Y-%m-%d %H:%M:%S') AS case_end,
       round(duration_hours, 6) AS duration_hours, round(duration_days, 6) AS duration_days,
       n_events, n_unique_activities, n_resources, last_activity,
       CAST(NULL AS VARCHAR) AS loan_goal, round(requested_amount, 6) AS requested_amount,
       CAST(NULL AS VARCHAR) AS application_type, outcome, sla_breach, sla_days,
       start_month, start_quarter, start_dow, start_month_name, duration_bucket,
       has_rework, rework_events, variant, CAST(variant_rank AS BIGINT) AS variant_rank,
       CAST(coalesce(variant_rank <= 3, false) AS INTEGER) AS is_top3_variant,
       CAST(coalesce(variant_rank <= 10, false) AS INTEGER) AS is_top10_variant
FROM cases JOIN (SELECT case_id, variant, variant_rank FROM cvar) USING (case_id)""", CASES_CTE)

ORACLE["snk_sanitized_cases"] = _w("""
SELECT case_id, strftime(case_start, '%Y-%m-%d %H:%M:%S') AS case_start,
       strftime(case_end, '%Y-%m-%d %H:%M:%S') AS case_end,
       round(duration_hours, 6) AS duration_hours, round(duration_days, 6) AS duration_days,
       n_events, n_unique_activities, n_resources,
       trim(regexp_replace(last_activity, '[\\r\\n\\t]+', ' ', 'g')) AS last_activity,
       CAST(NULL AS VARCHAR) AS loan_goal, round(requested_amount, 6) AS requested_amount,
       CAST(NULL AS VARCHAR) AS application_type,
       trim(regexp_replace(outcome, '[\\r\\n\\t]+', ' ', 'g')) AS outcome, sla_breach, sla_days,
       start_month, start_quarter, start_dow, start_month_name,
       trim(regexp_replace(duration_bucket, '[\\r\\n\\t]+', ' ', 'g')) AS duration_bucket,
       has_rework, rework_events
FROM cases""", CASES_CTE)

ORACLE["snk_sanitize_conversations"] = """
SELECT conv_id, turn, trim(regexp_replace(role, '[\\r\\n\\t]+', ' ', 'g')) AS role,
       trim(regexp_replace(text, '[\\r\\n\\t]+', ' ', 'g')) AS text
FROM conversations"""

ORDERS_CTE = """
olog0 AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS case_id, 'Order placed' AS activity,
         CAST(o_orderdate AS TIMESTAMP) AS ts, o_orderpriority AS resource
  FROM orders
  UNION ALL
  SELECT CAST(l_orderkey AS VARCHAR), 'Ship ' || l_returnflag || l_linestatus,
         CAST(l_shipdate AS TIMESTAMP), CAST(NULL AS VARCHAR)
  FROM lineitem
),
olog AS (
  SELECT DISTINCT case_id, activity, ts FROM olog0
  WHERE case_id IS NOT NULL AND activity IS NOT NULL AND ts IS NOT NULL
),
otrans AS (
  SELECT activity, lag(activity) OVER w AS prev_activity,
         date_diff('microsecond', lag(ts) OVER w, ts) / 3600000000.0 AS waiting_hours
  FROM olog WINDOW w AS (PARTITION BY case_id ORDER BY ts, activity)
),
ovalid AS (
  SELECT * FROM otrans
  WHERE prev_activity IS NOT NULL AND waiting_hours >= 0 AND waiting_hours < 1440
)"""

ORACLE["adp_orders_bottleneck"] = "WITH " + ORDERS_CTE.strip() + """
SELECT activity,
       round(avg(waiting_hours), 6) AS mean_wait_hours,
       round(quantile_cont(waiting_hours, 0.5), 6) AS median_wait_hours,
       round(sum(waiting_hours), 4) AS total_wait_hours,
       count(waiting_hours) AS n_occurrences,
       round(quantile_cont(waiting_hours, 0.9), 6) AS p90_wait_hours,
       round(avg(waiting_hours) / 24, 6) AS mean_wait_days,
       round(sum(waiting_hours) / 24, 4) AS total_wait_days,
       round(avg(waiting_hours) * count(waiting_hours), 4) AS bottleneck_score
FROM ovalid GROUP BY activity"""

ORACLE["adp_conversation_variants"] = """
WITH clog AS (
  SELECT CAST(conv_id AS VARCHAR) AS case_id, role AS activity, turn
  FROM conversations WHERE conv_id IS NOT NULL AND role IS NOT NULL AND turn IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY conv_id, role, turn ORDER BY turn) = 1
),
cv AS (SELECT case_id, string_agg(activity, ' → ' ORDER BY turn, activity) AS variant
       FROM clog GROUP BY case_id),
cc AS (SELECT variant, count(*) AS n_cases FROM cv GROUP BY variant)
SELECT variant, n_cases,
       CAST(row_number() OVER (ORDER BY n_cases DESC, variant) AS BIGINT) AS variant_rank
FROM cc"""

ORACLE["adp_user_case_table"] = """
WITH ulog AS (
  SELECT CAST(user_id AS VARCHAR) AS case_id, event_type AS activity, CAST(ts AS TIMESTAMP) AS ts,
         event_id AS event_seq
  FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND ts IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY user_id, event_type, ts ORDER BY event_id) = 1
),
uc AS (
  SELECT case_id, date_diff('microsecond', min(ts), max(ts)) / 3600000000.0 / 24 AS duration_days,
         count(*) AS n_events, count(DISTINCT activity) AS n_unique_activities,
         first(activity ORDER BY ts DESC, event_seq DESC, activity DESC) AS last_activity
  FROM ulog GROUP BY case_id
)
SELECT case_id, round(duration_days, 6) AS duration_days, n_events, n_unique_activities,
       last_activity, """ + _outcome_sql("last_activity") + """ AS outcome,
       CAST(duration_days > 5 AS INTEGER) AS sla_breach
FROM uc"""


# --- models: features, weights, split --------------------------------------------

FEAT_CTE = CASES_CTE + """,
feat AS (
  SELECT case_id, CAST(n_events AS DOUBLE) AS n_events,
         CAST(n_unique_activities AS DOUBLE) AS n_unique_activities,
         CAST(n_resources AS DOUBLE) AS n_resources, CAST(has_rework AS DOUBLE) AS has_rework,
         CAST(rework_events AS DOUBLE) AS rework_events,
         CAST(start_month AS DOUBLE) AS start_month,
         ln(1 + coalesce(requested_amount, 0)) AS log_requested_amount,
         CAST(dense_rank() OVER (ORDER BY coalesce(outcome, 'Other')) - 1 AS DOUBLE)
           AS outcome_encoded,
         CAST(coalesce(isodow(case_start) - 1, 0) AS DOUBLE) AS dow_encoded,
         CAST(0 AS DOUBLE) AS app_type_encoded,
         sla_breach AS label
  FROM cases
)"""

ORACLE["ml_features"] = _w("""
SELECT case_id, n_events, n_unique_activities, n_resources, has_rework, rework_events,
       start_month, round(log_requested_amount, 6) AS log_requested_amount, outcome_encoded,
       dow_encoded, app_type_encoded, label
FROM feat""", FEAT_CTE)

ORACLE["ml_class_balance"] = _w("""
SELECT label, count(*) AS n_cases, round(count(*) * 100.0 / (SELECT count(*) FROM feat), 6)
       AS share_pct
FROM feat GROUP BY label""", FEAT_CTE)

ORACLE["ml_balanced_weights"] = _w("""
SELECT label, count(*) AS n_label,
       round((SELECT count(*) FROM feat) / (2.0 * count(*)), 6) AS weight
FROM feat GROUP BY label""", FEAT_CTE)

ORACLE["ml_split"] = _w("""
SELECT case_id, label,
       CAST(p <= ceil(n * 0.25) AS INTEGER) AS is_test,
       CASE WHEN p > ceil(n * 0.25) THEN CAST((p - ceil(n * 0.25) - 1) % 5 AS INTEGER) END AS fold
FROM (SELECT case_id, label,
             row_number() OVER (PARTITION BY label ORDER BY md5(case_id || '#42'), case_id) AS p,
             count(*) OVER (PARTITION BY label) AS n
      FROM feat)""", FEAT_CTE)


# --- streaming versions ------------------------------------------------------------

ORACLE["stm_live_activity_frequency"] = _w("""
SELECT activity, count(*) AS n_events FROM log GROUP BY activity""")

ORACLE["stm_live_event_volume"] = _w("""
SELECT strftime(date_trunc('month', ts), '%Y-%m') AS month, count(*) AS n_events
FROM log GROUP BY 1""")

ORACLE["adp_user_transitions"] = """
WITH ulog AS (
  SELECT CAST(user_id AS VARCHAR) AS case_id, event_type AS activity, CAST(ts AS TIMESTAMP) AS ts,
         event_id AS event_seq
  FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND ts IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY user_id, event_type, ts ORDER BY event_id) = 1
)
SELECT case_id, event_seq, lag(activity) OVER w AS prev_activity,
       round(date_diff('microsecond', lag(ts) OVER w, ts) / 3600000000.0, 6) AS waiting_hours,
       CAST(row_number() OVER w - 1 AS BIGINT) AS position
FROM ulog WINDOW w AS (PARTITION BY case_id ORDER BY ts, event_seq, activity)"""


# --- further rows ---------------------------------------------------------------------

ORACLE["var_top10_activities"] = _w("""
SELECT activity, n_events, round(n_events * 100.0 / total, 6) AS share_pct,
       row_number() OVER (ORDER BY n_events DESC, activity) AS activity_rank
FROM (SELECT activity, count(*) AS n_events, sum(count(*)) OVER () AS total FROM log GROUP BY activity)
ORDER BY n_events DESC, activity LIMIT 10""")

ORACLE["rwk_attached_cases"] = _w("""
SELECT case_id, n_events, has_rework, rework_events FROM cases""", CASES_CTE)

ORACLE["src_csv_conversation_roundtrip"] = """
SELECT CAST(conv_id AS VARCHAR) AS case_id, CAST(turn AS BIGINT) AS event_seq, role AS activity,
       text AS resource
FROM conversations"""


# --- the journal of orders: the raw part differs, the rest is the same ----------------

JOURNAL_CTE = """
raw_log AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS case_id, 'signup' AS activity,
         CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS ts, o_orderstatus AS resource,
         CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority || ' goal' END AS loan_goal,
         CAST(o_totalprice AS DOUBLE) AS requested_amount,
         CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS application_type,
         CAST(0 AS BIGINT) AS event_seq
  FROM orders
  UNION ALL
  SELECT CAST(o_orderkey AS VARCHAR), 'signup', CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP), 'copy',
         CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority || ' goal' END,
         CAST(o_totalprice AS DOUBLE), CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END,
         CAST(100 AS BIGINT)
  FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL
  SELECT CAST(l_orderkey AS VARCHAR),
         CASE WHEN l_returnflag = 'A' THEN 'purchase'
              WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'error'
              WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'click'
              WHEN l_returnflag = 'N' AND l_linestatus = 'O' AND l_linenumber = 6 THEN NULL
              ELSE 'view' END,
         CASE WHEN l_linenumber <> 7 THEN
           CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)
           + to_days(CAST(l_linenumber * 5 + ((date_diff('day', CAST(o_orderdate AS DATE),
                     CAST(l_shipdate AS DATE)) % 11) + 11) % 11 AS INTEGER))
           + to_hours(CAST(l_linenumber AS INTEGER)) END,
         l_returnflag || l_linestatus, NULL, NULL, NULL, CAST(l_linenumber AS BIGINT)
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
),
""" + LOG_CTE[LOG_CTE.index("log AS (", LOG_CTE.index("FROM events")):]


def _journal(sql: str) -> str:
    return sql.replace(LOG_CTE.strip(), JOURNAL_CTE.strip()).replace(
        "         bool_or(activity IN ('error'))",
        """         first(loan_goal ORDER BY ts, event_seq, activity)
           FILTER (WHERE loan_goal IS NOT NULL) AS loan_goal,
         first(application_type ORDER BY ts, event_seq, activity)
           FILTER (WHERE application_type IS NOT NULL) AS application_type,
         bool_or(activity IN ('error'))""")


ORACLE["jrn_clean_profile"] = _journal(ORACLE["cln_profile"])
ORACLE["jrn_clean_log"] = _journal(_w("""
SELECT case_id, activity, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, resource,
       round(requested_amount, 6) AS requested_amount, event_seq
FROM log"""))
ORACLE["jrn_case_table"] = _journal(ORACLE["cas_case_table"]).replace(
    "CAST(NULL AS VARCHAR) AS loan_goal", "loan_goal").replace(
    "CAST(NULL AS VARCHAR) AS application_type", "application_type")
ORACLE["jrn_ml_features"] = _journal(ORACLE["ml_features"]).replace(
    "CAST(0 AS DOUBLE) AS app_type_encoded",
    "CAST(dense_rank() OVER (ORDER BY coalesce(application_type, 'Unknown')) - 1 AS DOUBLE) AS app_type_encoded")
ORACLE["jrn_breach_by_month"] = _journal(ORACLE["cht_breach_by_month"])
ORACLE["jrn_event_volume"] = _journal(ORACLE["cht_event_volume"])
ORACLE["jrn_monthly_trend"] = _journal(ORACLE["kpi_monthly_trend"])
ORACLE["jrn_breach_by_conformance"] = _journal(ORACLE["cnf_breach_by_conformance"])


# --- model measures on fixed scores ---------------------------------------------------

SCORES_CTE = CASES_CTE + """,
fixed AS (
  SELECT case_id, sla_breach AS label,
         (CAST('0x' || substr(md5(case_id), 1, 6) AS BIGINT) % 101) / 100.0 AS score
  FROM cases
),
roc AS (
  SELECT score AS threshold,
         sum(sum(1 - label)) OVER (ORDER BY score DESC) / (SELECT sum(1 - label) FROM fixed) AS fpr,
         sum(sum(label)) OVER (ORDER BY score DESC) / (SELECT sum(label) FROM fixed) AS tpr
  FROM fixed GROUP BY score
  UNION ALL SELECT NULL, 0, 0
)"""

ORACLE["ml_roc_fixed"] = _w("""
SELECT round(threshold, 6) AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM roc""", SCORES_CTE)

ORACLE["ml_auc_fixed"] = _w("""
SELECT round(sum((fpr - pf) * (tpr + pt) / 2), 6) AS auc
FROM (SELECT fpr, tpr, lag(fpr) OVER w AS pf, lag(tpr) OVER w AS pt FROM roc
      WINDOW w AS (ORDER BY fpr, tpr))""", SCORES_CTE)

ORACLE["ml_confusion_fixed"] = _w("""
SELECT CAST(l.label AS INTEGER) AS label, CAST(p.prediction AS INTEGER) AS prediction,
       (SELECT count(*) FROM fixed f WHERE f.label = l.label
          AND CAST(f.score >= 0.5 AS INTEGER) = p.prediction) AS n_cases
FROM (VALUES (0), (1)) l(label), (VALUES (0), (1)) p(prediction)""", SCORES_CTE)

# the merged states of a growing log give the batch job's case table
ORACLE["stm_incremental_case_table"] = ORACLE["cas_case_table"]

# sketches: exact sizes, and every answer within the stated bound
ORACLE["btn_sketch_waits"] = _w("""
SELECT activity, count(*) AS n, true AS median_wait_hours_ok, true AS p90_wait_hours_ok
FROM valid GROUP BY activity""", TRANS_CTE)

ORACLE["cht_sketch_durations"] = _w("""
SELECT outcome, count(*) AS n, true AS q1_ok, true AS median_ok, true AS q3_ok
FROM cases GROUP BY outcome""", CASES_CTE)

ORACLE["cas_sketch_distinct"] = _w("""
SELECT case_id, n_unique_activities, n_resources FROM cases""", CASES_CTE)
