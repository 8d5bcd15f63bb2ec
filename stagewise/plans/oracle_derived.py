"""DuckDB SQL for measures on surfaces, their parity, and what is read off the metrics."""

from __future__ import annotations

from . import oracle
from .export import STAR as TABLES
from .measures import MEASURES, TOLERANCE, by_text
from .oracle import DRILL, RATES, STAR, A, I, R, kpis, n, rate, wilson

MONTHS = {"month": "applied_date", "reply_month": "replied", "activity_month": "last_activity_date"}
#: The memberships one by one, each a select of its own.
PLACED = "placed AS (" + " UNION ALL ".join((
    "SELECT 'all' AS surface, 'all' AS member, f.* FROM f",
    "SELECT 'platform', platform, f.* FROM f",
    *(f"SELECT '{s}', strftime({c}, '%Y-%m'), f.* FROM f WHERE {c} IS NOT NULL" for s, c in MONTHS.items()),
    *(f"SELECT 'set', '{name}', f.* FROM f WHERE {condition}" for name, condition in DRILL.items()),
)) + ")"


def long(source: str, value: str, columns) -> str:
    """Rows with nulls too: a measure without a value is one."""
    return " UNION ALL ".join(f"SELECT surface, member, '{c}' AS measure, CAST({c} AS DOUBLE) AS {value} FROM {source}" for c in columns)


def after_star(sql: str) -> str:
    """What a query selects, without the CTEs of the star that it begins with; its own stay."""
    rest = sql.removeprefix(STAR).strip()
    return f"WITH {rest[1:]}" if rest.startswith(",") else rest


#: Metrics that are measures too: by kpis over everything and over each set, the two periods, platforms, and months.
KPIS = [c for c in MEASURES if f" AS {c}" in kpis()]
PERIODS = ["last_30", "prev_30", "change", "last_30_response_pct", "prev_30_response_pct"]
RATED = ["applications", "responses", "interviews", "offers", "response_rate_pct", "response_rate_lo", "response_rate_hi", "interview_rate_pct", "median_days_to_response"]
COHORTS = ["applications", "responses", "interviews", "offers", "rejections", "ghosted", "response_rate_pct", "interview_rate_pct"]
METRICS = {
    "k_all": ("'all'", "'all'", after_star(kpis()), KPIS),
    "k_period": ("'all'", "'all'", after_star(oracle.SQL["period_compare"]), PERIODS),
    "k_platform": ("'platform'", "platform", f"SELECT platform, {RATES}, round(CAST(100.0 AS DOUBLE) * {I} / {A} - 6.87, 1) AS vs_direct_benchmark_pp FROM f GROUP BY 1", [*RATED, "vs_direct_benchmark_pp"]),
    "k_month": ("'month'", "month", f"""SELECT strftime(applied_date, '%Y-%m') AS month, {A} AS applications, {R} AS responses, {I} AS interviews, {n('reached_offer')} AS offers, {n('is_rejected')} AS rejections, {n('is_ghosted')} AS ghosted,
      {rate(R, A)} AS response_rate_pct, {rate(I, A)} AS interview_rate_pct FROM f GROUP BY 1""", COHORTS),
    **{f"k_{name}": ("'set'", f"'{name}'", after_star(kpis(condition)), KPIS) for name, condition in DRILL.items()},
}
TWINS = ", ".join(f"{k} AS MATERIALIZED (SELECT {surface} AS surface, {member} AS member, x.* FROM ({q}) x)" for k, (surface, member, q, _) in METRICS.items())
TWINS += ", twin AS (" + " UNION ALL ".join(long(k, "by_metric", columns) for k, (*_, columns) in METRICS.items()) + ")"

WIDE = f"{STAR}, {PLACED}, wide AS MATERIALIZED ({by_text('placed')})"
VALUES = f"value AS ({long('wide', 'by_text', MEASURES)})"
NEAR = f"coalesce(abs(by_text - by_metric) <= {TOLERANCE}, by_text IS NULL AND by_metric IS NULL)"

#: One curve for each platform and one for all, as for everything before.
CURVES = """o AS (SELECT key, CASE WHEN is_response THEN days_to_response ELSE days_since_applied END AS day, is_response AS e
  FROM (SELECT platform AS key, * FROM f UNION ALL SELECT '(all)', * FROM f) WHERE NOT is_response OR days_to_response IS NOT NULL),
d AS (SELECT key, day, count(CASE WHEN e THEN 1 END) AS replies, count(*) AS c FROM o GROUP BY 1, 2),
q AS (SELECT x.key, x.day, x.replies, (SELECT CAST(sum(y.c) AS BIGINT) FROM d y WHERE y.key = x.key AND y.day >= x.day) AS at_risk FROM d x),
km AS (SELECT key, day, round(CAST(100.0 AS DOUBLE) * exp(sum(ln(greatest(CAST(1.0 AS DOUBLE) - CAST(replies AS DOUBLE) / CAST(at_risk AS DOUBLE), CAST(1e-12 AS DOUBLE)))) OVER (PARTITION BY key ORDER BY day)), 2) AS waiting FROM q)"""
MARKS = ", ".join(f"round(CAST(100.0 AS DOUBLE) - (SELECT k.waiting FROM km k WHERE k.key = p.key AND k.day <= {h} ORDER BY k.day DESC LIMIT 1), 2) AS day_{h}" for h in (7, 14, 21, 30))

SEGMENTS = {"platform": "platform", "channel": "channel", "role_family": "role_family", "industry": "industry", "seniority": "seniority", "job_type": "job_type", "company": "company_name"}
RATED_BY = f"{A} AS n, {rate(R, A)} AS rate, {wilson(R, A, '-')} AS lo, {wilson(R, A, '+')} AS hi"
JUDGED = "seg AS (" + " UNION ALL ".join(f"SELECT '{k}' AS dim, {c} AS member, {RATED_BY} FROM f GROUP BY 2" for k, c in SEGMENTS.items()) + f"""),
ok AS (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY rate DESC, n DESC, member) AS up, row_number() OVER (PARTITION BY dim ORDER BY rate, n DESC, member) AS down, count(*) OVER (PARTITION BY dim) AS members FROM seg WHERE n >= 10),
everyone AS (SELECT {wilson(R, A, '+')} AS hi FROM f)"""

IN_WORDS = "CASE WHEN {0} >= 5 THEN '1 in ' || CAST(CAST(round_even(CAST(100.0 AS DOUBLE) / {0}, 0) AS INTEGER) AS VARCHAR) WHEN {0} IS NOT NULL THEN printf('%.1f', {0}) || '%' ELSE '-' END"


def exported(name: str, key: str) -> str:
    """What a table holds, counted in the database: its rows, its values that are not null, its keys."""
    body = oracle.SQL[name]
    return f"(SELECT '{name}' AS \"table\", count(*) AS rows, CAST(sum(known) AS BIGINT) AS known, count(DISTINCT {key}) AS keys FROM (SELECT {key}, len(list_filter(held, lambda x: x IS NOT NULL)) AS known FROM (SELECT {key}, list_value(*COLUMNS(*)) AS held FROM (SELECT CAST(COLUMNS(*) AS VARCHAR) FROM ({body})))))"


SQL = {
    "measures": f"{WIDE}, {VALUES} SELECT surface, member, measure, by_text AS value FROM value",
    "measure_parity": f"""{WIDE}, {VALUES}, {TWINS} SELECT surface, member, measure, by_text AS by_columns, by_text AS by_sql, by_metric, found IS NULL OR {NEAR} AS agree
      FROM value LEFT JOIN (SELECT *, true AS found FROM twin) t USING (surface, member, measure)""",
    "response_marks": f"{STAR}, {CURVES} SELECT p.key AS platform, {MARKS}, (SELECT min(k.day) FROM km k WHERE k.key = p.key AND k.waiting <= 50) AS median_day, (SELECT max(k.day) FROM km k WHERE k.key = p.key) AS last_day FROM (SELECT DISTINCT key FROM km) p",
    "segment_verdicts": f"""{STAR}, {JUDGED} SELECT b.dim, b.members, b.member AS best, b.rate AS best_rate_pct, w.member AS worst, w.rate AS worst_rate_pct, b.members > 1 AND b.lo > w.hi AS separated, b.lo > (SELECT hi FROM everyone) AS beats_overall
      FROM ok b JOIN ok w ON w.dim = b.dim AND w.down = 1 WHERE b.up = 1""",
    "fixed_levels": f"""{STAR}, x AS (SELECT *, strftime(applied_date, '%Y-%m') AS cohort FROM f) SELECT application_id, min(applied_date) OVER c AS company_first_applied, count(*) OVER c > 1 AS is_repeat_employer,
      round(CAST(100.0 AS DOUBLE) * sum(CAST(is_response AS INTEGER)) OVER p / count(*) OVER p, 1) AS platform_response_rate_pct, count(*) OVER p AS platform_applications,
      round(CAST(100.0 AS DOUBLE) * sum(CAST(is_response AS INTEGER)) OVER m / count(*) OVER m, 1) AS cohort_response_rate_pct, max(days_since_applied) OVER m < 30 AS cohort_is_maturing
      FROM x WINDOW c AS (PARTITION BY company_name), p AS (PARTITION BY platform), m AS (PARTITION BY cohort)""",
    "month_roles": f"""{STAR}, s AS (SELECT strftime(applied_date, '%Y-%m') AS month, count(*) AS sent FROM f GROUP BY 1), r AS (SELECT strftime(replied, '%Y-%m') AS month, count(*) AS replies FROM f WHERE is_response AND replied IS NOT NULL GROUP BY 1),
      t AS (SELECT strftime(last_activity_date, '%Y-%m') AS month, count(*) AS touched FROM f WHERE last_activity_date IS NOT NULL GROUP BY 1), c AS (SELECT strftime(occurred, '%Y-%m') AS month, count(*) AS changes FROM fe GROUP BY 1)
      SELECT month, coalesce(sent, 0) AS sent, coalesce(replies, 0) AS replies, coalesce(touched, 0) AS touched, coalesce(changes, 0) AS changes FROM s FULL JOIN r USING (month) FULL JOIN t USING (month) FULL JOIN c USING (month)""",
    "largest_drop": f"{STAR}, {oracle.FUNNEL} SELECT stage, prev - applications AS lost_at_step FROM p WHERE prev IS NOT NULL ORDER BY prev - applications DESC, stage_order LIMIT 1",
    "platform_words": f"{STAR}, x AS (SELECT platform, {RATES} FROM f GROUP BY 1) SELECT platform, applications, {IN_WORDS.format('response_rate_pct')} AS replies, {IN_WORDS.format('interview_rate_pct')} AS interviews FROM x",
    "star_csv": " UNION ALL ".join(exported(t, k) for t, k in TABLES.items()),
}
