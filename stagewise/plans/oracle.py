"""DuckDB SQL over the driver's tables for the warehouse queries; written on its own, from the recipe, not from the models."""

from __future__ import annotations

from html.entities import html5

from ..domain import CHANNELS, STATUSES
from ..functions import text

AS_OF = "DATE '2001-08-02'"


def _values() -> str:
    rows = ", ".join(f"('{s}', '{f}', {n}, {t}, {a}, {r}, {o})" for s, f, n, t, a, r, o in STATUSES)
    return f"st(status, funnel_stage, stage_order, is_terminal, is_active, responds, sort_order) AS (VALUES {rows}), ch(platform, channel, is_direct) AS (VALUES {', '.join(f"('{p}', '{c}', {d})" for p, c, d in CHANNELS)})"


STAR = f"""WITH {_values()},
line AS (
  SELECT l.*, CAST(o.o_orderdate AS DATE) AS applied, CAST(o.o_orderdate AS DATE) + CAST(l_partkey % 75 - 5 AS INTEGER) AS occurred,
         CASE l_returnflag || l_linestatus WHEN 'RO' THEN CASE WHEN l_discount >= 0.08 THEN 'Offer' ELSE 'Interview' END WHEN 'RF' THEN 'Rejected'
              WHEN 'AF' THEN 'Assessment / OA' WHEN 'AO' THEN 'Ghosted' WHEN 'NF' THEN 'Withdrawn' ELSE 'Applied' END AS to_status
  FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey),
seq AS (
  SELECT line.*, st.sort_order, st.stage_order, st.responds, row_number() OVER w AS n, lag(to_status) OVER w AS from_status,
         ['gmail', 'manual', 'llm', 'repair', 'system', 'legacy', 'inferred'][CAST(l_suppkey % 7 + 1 AS INTEGER)] AS source
  FROM line JOIN st ON st.status = to_status
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY occurred, sort_order, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount)),
ev AS (
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(n AS VARCHAR) AS event_id, l_orderkey, from_status, to_status, occurred, applied, source, stage_order,
         CASE WHEN l_partkey % 4 = 0 THEN 'part ' || CAST(l_partkey AS VARCHAR) END AS note,
         responds AND source <> 'system' AS by_employer, source NOT IN ('legacy', 'inferred') AS trusted
  FROM seq),
now AS (SELECT l_orderkey, arg_max(to_status, CAST(occurred - DATE '1990-01-01' AS BIGINT) * 10 + sort_order) AS status, max(occurred) AS last FROM seq GROUP BY 1),
ms AS (
  SELECT l_orderkey, max(stage_order) AS stage, min(CASE WHEN by_employer AND (trusted OR occurred > applied) THEN occurred END) AS replied,
         min(CASE WHEN to_status = 'Assessment / OA' THEN occurred END) AS tested, min(CASE WHEN to_status = 'Interview' THEN occurred END) AS talked,
         min(CASE WHEN to_status = 'Offer' THEN occurred END) AS offered, max(CASE WHEN to_status IN ('Rejected', 'Ghosted', 'Withdrawn') THEN occurred END) AS closed,
         bool_or(by_employer) AS responded, count(*) AS events, bool_or(NOT trusted) AS doubtful
  FROM ev GROUP BY 1),
cleaned AS (
  SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS application_id, c_name AS company_name, o_orderpriority AS platform, CASE WHEN o_orderkey % 29 = 0 THEN 'Other' ELSE c_mktsegment END AS industry, n_name AS role_family,
         CASE WHEN o_orderkey % 37 <> 0 THEN CAST(o_orderdate AS DATE) END AS applied_date,
         CASE o_orderkey % 32 WHEN 5 THEN 'Assessment / OA' WHEN 13 THEN 'Assessment / OA' WHEN 21 THEN 'Ghosted' WHEN 29 THEN 'Applied' WHEN 10 THEN 'Saved / Planning' WHEN 26 THEN 'Applied' ELSE coalesce(now.status, 'Applied') END AS current_status,
         CASE WHEN o_orderkey % 31 <> 0 THEN now.last END AS last_activity_date, o_orderkey % 16 <> 7 AS stays,
         CASE WHEN o_orderkey % 4 = 0 THEN 'Re: order ' || CAST(o_orderkey AS VARCHAR) END AS latest_subject, CASE WHEN o_orderkey % 9 = 0 THEN CAST(o_orderkey % 90 AS VARCHAR) || ' k' END AS salary_text,
         CASE WHEN o_orderkey % 7 = 0 THEN 'note ' || CAST(o_orderkey % 3 AS VARCHAR) END AS notes, CASE WHEN o_orderkey % 3 = 0 THEN 'description description description description' ELSE 'short' END AS job_description,
         CASE WHEN o_orderkey % 10 = 0 THEN '(role not stated)' ELSE 'Role ' || CAST(o_orderkey % 50 AS VARCHAR) END AS role_title,
         CASE WHEN o_orderkey % 25 = 0 THEN 'Full-Time' ELSE ['Full Time', 'Internship', 'Contract'][CAST(o_orderkey % 3 + 1 AS INTEGER)] END AS job_type,
         CASE WHEN o_orderkey % 27 = 0 THEN 'Not Specified' ELSE ['Junior', 'Mid', 'Senior', 'Lead'][CAST(o_custkey % 4 + 1 AS INTEGER)] END AS seniority,
         ['Kuala Lumpur', 'Penang', 'Remote', NULL, 'Johor'][CAST(o_orderkey % 5 + 1 AS INTEGER)] AS location, CAST(o_orderkey % 100 AS DOUBLE) / 100 AS parse_confidence,
         ['rules', 'llm'][CAST(o_orderkey % 2 + 1 AS INTEGER)] AS parsed_by, CASE WHEN o_orderkey % 20 = 0 THEN 'manual' ELSE 'gmail' END AS origin,
         CASE WHEN o_orderkey % 6 <> 0 THEN 'https://jobs.example/' || CAST(o_orderkey AS VARCHAR) END AS job_url, 'https://mail.example/' || CAST(o_orderkey AS VARCHAR) AS gmail_link,
         o_orderkey % 3 = 0 AS has_job_description
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN now ON l_orderkey = o_orderkey),
a AS (SELECT * FROM cleaned WHERE stays AND current_status <> 'Saved / Planning' AND applied_date IS NOT NULL),
m AS (
  SELECT a.*, greatest(coalesce(ms.stage, 0), st.stage_order, 1) AS max_stage_reached, coalesce(ms.responded, false) OR st.responds AS is_response,
         ms.replied, ms.tested, ms.talked, ms.offered, ms.closed, coalesce(ms.events, 0) AS event_count, coalesce(ms.doubtful, false) AS has_low_trust_dates,
         st.funnel_stage, st.is_terminal, st.is_active, coalesce(ch.channel, 'Other') AS channel, coalesce(ch.is_direct, false) AS is_direct
  FROM a LEFT JOIN ms ON ms.l_orderkey = a.k JOIN st ON st.status = a.current_status LEFT JOIN ch ON ch.platform = a.platform),
f AS (
  SELECT *, max_stage_reached >= 2 AS reached_assessment, max_stage_reached >= 3 AS reached_interview, max_stage_reached >= 4 AS reached_offer,
         current_status = 'Rejected' AS is_rejected, current_status = 'Ghosted' AS is_ghosted,
         CASE WHEN replied >= applied_date THEN CAST(replied - applied_date AS BIGINT) END AS days_to_response,
         CASE WHEN talked >= applied_date THEN CAST(talked - applied_date AS BIGINT) END AS days_to_interview,
         CAST({AS_OF} - applied_date AS BIGINT) AS days_since_applied, CAST({AS_OF} - coalesce(last_activity_date, applied_date) AS BIGINT) AS days_since_activity
  FROM m),
fe AS (SELECT ev.*, f.application_id, f.company_name, f.role_title, f.platform, CAST(occurred - applied AS BIGINT) AS since FROM ev JOIN f ON f.k = ev.l_orderkey),
cal AS (SELECT CAST(unnest(generate_series(CAST(least((SELECT min(applied_date) FROM f), {AS_OF} - 30) AS TIMESTAMP), CAST({AS_OF} AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day)
"""


def n(condition: str) -> str:
    return f"count(CASE WHEN {condition} THEN 1 END)"


def rate(x: str, total: str) -> str:
    return f"CASE WHEN {total} > 0 THEN round(CAST(100.0 AS DOUBLE) * {x} / {total}, 1) END"


def wilson(x: str, total: str, sign: str) -> str:
    s, p = f"CAST({total} AS DOUBLE)", f"(CAST({x} AS DOUBLE) / CAST({total} AS DOUBLE))"
    z, z2 = "CAST(1.96 AS DOUBLE)", f"CAST({1.96 * 1.96!r} AS DOUBLE)"
    bound = f"(({p} + {z2} / (CAST(2.0 AS DOUBLE) * {s})) {sign} ({z} * sqrt({p} * (1 - {p}) / {s} + {z2} / (CAST(4.0 AS DOUBLE) * {s} * {s})))) / (1 + {z2} / {s})"
    return f"CASE WHEN {total} > 0 THEN round(CAST(100.0 AS DOUBLE) * greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), {bound})), 1) END"


R, I, A = n("is_response"), n("reached_interview"), "count(*)"
RATES = f"""{A} AS applications, {R} AS responses, {I} AS interviews, {n('reached_offer')} AS offers, {rate(R, A)} AS response_rate_pct, {wilson(R, A, '-')} AS response_rate_lo,
  {wilson(R, A, '+')} AS response_rate_hi, {rate(I, A)} AS interview_rate_pct, CAST(median(days_to_response) AS DOUBLE) AS median_days_to_response"""


def kpis(where: str = "true") -> str:
    r = rate(R, A)
    return f"""{STAR} SELECT {A} AS applications, {R} AS responses, {n('reached_assessment')} AS assessments, {I} AS interviews, {n('reached_offer')} AS offers,
  {n('is_rejected')} AS rejections, {n('is_ghosted')} AS ghosted, {n('is_active')} AS active, {n('is_active AND days_since_activity >= 7')} AS needs_follow_up,
  count(DISTINCT company_name) AS companies, {r} AS response_rate_pct, {wilson(R, A, '-')} AS response_rate_lo, {wilson(R, A, '+')} AS response_rate_hi,
  {rate(I, A)} AS interview_rate_pct, {wilson(I, A, '-')} AS interview_rate_lo, {wilson(I, A, '+')} AS interview_rate_hi, {rate(n('reached_offer'), A)} AS offer_rate_pct,
  {rate(n('is_rejected'), A)} AS rejection_rate_pct, {rate(n('is_ghosted'), A)} AS ghost_rate_pct, CAST(median(days_to_response) AS DOUBLE) AS median_days_to_response,
  round(avg(days_to_response), 1) AS avg_days_to_response, count(days_to_response) AS responses_with_known_date, CAST(median(days_to_interview) AS DOUBLE) AS median_days_to_interview,
  {rate(n('is_direct'), A)} AS direct_share_pct,
  CASE WHEN {r} IS NULL THEN 'No data' WHEN {r} >= 5 THEN 'Strong' WHEN {r} >= 3 THEN 'Good' WHEN {r} >= 2 THEN 'Average' ELSE 'Below average' END AS response_band,
  min(applied_date) AS first_applied, max(applied_date) AS last_applied FROM f WHERE {where}"""


def segment(column: str) -> str:
    return f"{STAR} SELECT {column} AS segment, {RATES} FROM f GROUP BY 1"


def dimension(column: str, key: str) -> str:
    return f"{STAR} SELECT substr(md5(lower({column})), 1, 16) AS {key}, min({column}) AS {column} FROM f GROUP BY 1"


DRILL = {
    "response": "is_response",
    "no_response": "NOT is_response",
    "assessment": "reached_assessment",
    "interview": "reached_interview",
    "offer": "reached_offer",
    "rejected": "is_rejected",
    "ghosted": "is_ghosted",
    "active": "is_active",
    "awaiting": "is_active AND max_stage_reached = 1",
    "in_progress": "is_active AND max_stage_reached >= 2",
    "follow_up": "is_active AND days_since_activity >= 7",
    "dated_reply": "days_to_response IS NOT NULL",
}

FUNNEL = f"""c AS (SELECT {A} AS a, {R} AS r, {n('reached_assessment')} AS t, {I} AS i, {n('reached_offer')} AS o FROM f),
s AS (SELECT unnest([1, 2, 3, 4, 5]) AS stage_order, unnest(['Applied', 'Employer responded', 'Assessment', 'Interview', 'Offer']) AS stage, unnest([a, r, t, i, o]) AS applications,
             unnest([NULL, NULL, NULL, 5.0, 0.0]) AS lo, unnest([NULL, NULL, NULL, 10.0, 1.0]) AS hi FROM c),
p AS (SELECT *, first_value(applications) OVER (ORDER BY stage_order) AS top, lag(applications) OVER (ORDER BY stage_order) AS prev FROM s)"""

FLOWS = """g AS (
  SELECT unnest([
    CASE WHEN reached_assessment THEN 'Applied>Assessment' END, CASE WHEN reached_interview AND NOT reached_assessment THEN 'Applied>Interview' END,
    CASE WHEN max_stage_reached = 1 AND is_rejected THEN 'Applied>Rejected' END, CASE WHEN max_stage_reached = 1 AND is_ghosted THEN 'Applied>Ghosted' END,
    CASE WHEN max_stage_reached = 1 AND is_active THEN 'Applied>Awaiting reply' END, CASE WHEN max_stage_reached = 1 AND current_status = 'Withdrawn' THEN 'Applied>Withdrawn' END,
    CASE WHEN reached_assessment AND reached_interview THEN 'Assessment>Interview' END, CASE WHEN reached_offer THEN 'Interview>Offer' END,
    CASE WHEN max_stage_reached BETWEEN 2 AND 3 AND is_rejected THEN stood || '>Rejected' END, CASE WHEN max_stage_reached BETWEEN 2 AND 3 AND is_active THEN stood || '>In progress' END,
    CASE WHEN max_stage_reached BETWEEN 2 AND 3 AND current_status IN ('Ghosted', 'Withdrawn') THEN stood || '>Ghosted' END]) AS flow
  FROM (SELECT *, CASE max_stage_reached WHEN 2 THEN 'Assessment' WHEN 3 THEN 'Interview' END AS stood FROM f))"""

SURVIVAL = """o AS (SELECT CASE WHEN is_response THEN days_to_response ELSE days_since_applied END AS day, is_response AS e FROM f WHERE NOT is_response OR days_to_response IS NOT NULL),
d AS (SELECT day, count(CASE WHEN e THEN 1 END) AS responses, count(CASE WHEN NOT e THEN 1 END) AS censored, count(*) AS c FROM o GROUP BY day),
q AS (SELECT *, CAST(sum(c) OVER (ORDER BY day DESC) AS BIGINT) AS at_risk FROM d),
km AS (SELECT *, exp(sum(ln(greatest(CAST(1.0 AS DOUBLE) - CAST(responses AS DOUBLE) / CAST(at_risk AS DOUBLE), CAST(1e-12 AS DOUBLE)))) OVER (ORDER BY day)) AS s FROM q)"""

MESSAGES = """msg AS (
  SELECT CAST(doc_id AS VARCHAR) AS message_id, CAST(doc_id AS VARCHAR) AS application_id, CASE WHEN doc_id % 5 <> 0 THEN DATE '2001-07-01' + CAST(doc_id % 28 AS INTEGER) END AS message_date,
         CASE WHEN doc_id % 4 <> 0 THEN 'subject ' || CAST(doc_id % 10 AS VARCHAR) END AS subject, 'sender' || CAST(doc_id % 7 AS VARCHAR) || '@mail.example' AS sender, quality IS NOT NULL AND quality = 1 AS is_application_mail,
         CASE WHEN quality = 0 AND source <> '' THEN source END AS filter_reason, CASE WHEN doc_id % 6 = 0 THEN 'Interview' END AS detected_status, CASE WHEN doc_id % 17 <> 0 THEN CAST(doc_id % 100 AS DOUBLE) / 100 END AS confidence,
         CASE WHEN doc_id % 3 = 0 THEN 'llm' ELSE 'rules' END AS parsed_by
  FROM documents JOIN labels USING (doc_id))"""


def _tests() -> str:
    """(test, failures) of every data test."""
    found: list[tuple[str, str]] = []
    key = "substr(md5(lower({0})), 1, 16)"
    dims = {"company": "company_name", "platform": "platform", "role_family": "role_family", "industry": "industry", "job_type": "job_type", "seniority": "seniority"}
    keyed = [("raw_applications", "thread_id", "SELECT k AS v FROM cleaned"), ("raw_events", "event_id", "SELECT event_id AS v FROM ev"), ("stg_applications", "application_id", "SELECT application_id AS v FROM a")]
    keyed += [("stg_status_events", "event_id", "SELECT event_id AS v FROM ev"), ("stg_messages", "message_id", "SELECT message_id AS v FROM msg"), ("fct_applications", "application_id", "SELECT application_id AS v FROM f")]
    keyed += [("fct_status_events", "event_id", "SELECT event_id AS v FROM fe"), ("dim_date", "date_day", "SELECT day AS v FROM cal"), ("dim_status", "status_key", "SELECT status AS v FROM st")]
    keyed += [(f"dim_{d}", f"{d}_key", f"SELECT {key.format(c)} AS v FROM f GROUP BY lower({c})") for d, c in dims.items()]
    for model, column, rows in keyed:
        found.append((f"unique_{model}_{column}", f"SELECT count(*) FROM (SELECT v FROM ({rows}) WHERE v IS NOT NULL GROUP BY v HAVING count(*) > 1)"))
        found.append((f"not_null_{model}_{column}", f"SELECT count(*) FROM ({rows}) WHERE v IS NULL"))
    for model, column, rows in (("stg_applications", "applied_date", "SELECT applied_date AS v FROM a"), ("stg_applications", "current_status", "SELECT current_status AS v FROM a"), ("stg_status_events", "occurred_on", "SELECT occurred AS v FROM ev"),
                                ("fct_applications", "company_key", "SELECT company_name AS v FROM f"), ("fct_applications", "platform_key", "SELECT platform AS v FROM f"), ("fct_applications", "status_key", "SELECT current_status AS v FROM f"), ("fct_applications", "applied_date", "SELECT applied_date AS v FROM f")):
        found.append((f"not_null_{model}_{column}", f"SELECT count(*) FROM ({rows}) WHERE v IS NULL"))
    for name, rows, to in (("fct_applications_company_key", "SELECT company_name AS v FROM f", "SELECT company_name FROM a"), ("fct_applications_platform_key", "SELECT platform AS v FROM f", "SELECT platform FROM a"), ("fct_applications_status_key", "SELECT current_status AS v FROM f", "SELECT status FROM st"),
                           ("fct_applications_role_family_key", "SELECT role_family AS v FROM f", "SELECT role_family FROM a"), ("fct_applications_applied_date", "SELECT applied_date AS v FROM f", "SELECT day FROM cal"), ("fct_status_events_application_id", "SELECT application_id AS v FROM fe", "SELECT application_id FROM f")):
        found.append((f"related_{name}", f"SELECT count(*) FROM ({rows}) WHERE v IS NOT NULL AND v NOT IN ({to})"))
    found.append(("accepted_stg_applications_current_status", "SELECT count(*) FROM a WHERE current_status NOT IN (SELECT status FROM st WHERE sort_order > 0)"))
    found.append(("accepted_fct_applications_max_stage_reached", "SELECT count(*) FROM f WHERE max_stage_reached NOT BETWEEN 1 AND 4"))
    found.append(("calendar_is_contiguous", "SELECT CAST(max(day) - min(day) AS BIGINT) + 1 - count(DISTINCT day) FROM cal"))
    found.append(("funnel_is_monotone", f"SELECT CASE WHEN {n('reached_assessment')} > count(*) OR {n('reached_interview')} > {n('reached_assessment')} OR {n('reached_offer')} > {n('reached_interview')} THEN 1 ELSE 0 END FROM f"))
    found.append(("no_negative_durations", "SELECT count(*) FROM f WHERE days_to_response < 0 OR days_to_interview < 0 OR days_since_applied < 0"))
    found.append(("outcomes_imply_a_response", "SELECT count(*) FROM f WHERE (reached_assessment OR is_rejected) AND NOT is_response"))
    found.append(("no_reply_time_without_a_response", "SELECT count(*) FROM f WHERE NOT is_response AND days_to_response IS NOT NULL"))
    return f"{STAR}, {MESSAGES} " + " UNION ALL ".join(f"SELECT '{name}' AS test, CAST(({q}) AS BIGINT) AS failures" for name, q in found)


SQL = {
    "kpis": kpis(),
    "kpis_filtered": kpis("applied_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' AND platform IN ('1-URGENT', '3-MEDIUM') AND (company_name ILIKE '%7%' OR role_title ILIKE '%7%' OR coalesce(location, '') ILIKE '%7%')"),
    "period_compare": f"""{STAR}, p AS (SELECT *, applied_date > {AS_OF} - 30 AS l, applied_date > {AS_OF} - 60 AND applied_date <= {AS_OF} - 30 AS v FROM f)
      SELECT {n('l')} AS last_30, {n('v')} AS prev_30, {n('l')} - {n('v')} AS change, {rate(n('l AND is_response'), n('l'))} AS last_30_response_pct, {rate(n('v AND is_response'), n('v'))} AS prev_30_response_pct FROM p""",
    "funnel": f"""{STAR}, {FUNNEL} SELECT stage_order, stage, applications, CAST(lo AS DOUBLE) AS benchmark_per_100_lo, CAST(hi AS DOUBLE) AS benchmark_per_100_hi, {rate('applications', 'top')} AS pct_of_applied,
      {rate('applications', 'prev')} AS step_conversion_pct, prev - applications AS lost_at_step,
      CASE WHEN lo IS NOT NULL THEN CASE WHEN 100.0 * applications / top > hi THEN 'Ahead' WHEN 100.0 * applications / top >= lo THEN 'On par' ELSE 'Behind' END END AS vs_benchmark FROM p""",
    "sankey": f"{STAR}, {FLOWS} SELECT split_part(flow, '>', 1) AS source, split_part(flow, '>', 2) AS target, count(*) AS applications FROM g WHERE flow IS NOT NULL GROUP BY 1, 2",
    "weekly_velocity": f"""{STAR}, w AS (SELECT DISTINCT CAST(date_trunc('week', day) AS DATE) AS week_start FROM cal WHERE day >= (SELECT min(applied_date) FROM f)),
      c AS (SELECT CAST(date_trunc('week', applied_date) AS DATE) AS week_start, {A} AS a, {R} AS r, {I} AS i FROM f GROUP BY 1)
      SELECT week_start, coalesce(a, 0) AS applications, coalesce(r, 0) AS responses, coalesce(i, 0) AS interviews, round(avg(coalesce(a, 0)) OVER (ORDER BY week_start ROWS 3 PRECEDING), 1) AS rolling_4w_avg,
      CAST(sum(coalesce(a, 0)) OVER (ORDER BY week_start) AS BIGINT) AS cumulative FROM w LEFT JOIN c USING (week_start)""",
    "monthly_cohorts": f"""{STAR} SELECT strftime(applied_date, '%Y-%m') AS cohort_month, {A} AS applications, {R} AS responses, {I} AS interviews, {n('reached_offer')} AS offers, {n('is_rejected')} AS rejected,
      {n('is_ghosted')} AS ghosted, {n('is_active')} AS still_open, {rate(R, A)} AS response_rate_pct, {rate(I, A)} AS interview_rate_pct, max(days_since_applied) < 30 AS is_maturing FROM f GROUP BY 1""",
    "platform_performance": f"""{STAR}, g AS (SELECT platform, min(channel) AS channel, bool_or(is_direct) AS is_direct, {RATES} FROM f GROUP BY platform)
      SELECT *, round(CAST(100.0 AS DOUBLE) * interviews / applications - CAST(6.87 AS DOUBLE), 1) AS vs_direct_benchmark_pp, round(CAST(100.0 AS DOUBLE) * applications / CAST(sum(applications) OVER () AS BIGINT), 1) AS share_pct,
      dense_rank() OVER (ORDER BY CAST(responses AS DOUBLE) / applications DESC) AS response_rank, CASE WHEN applications >= 30 THEN 'Adequate' WHEN applications >= 10 THEN 'Indicative' ELSE 'Too small' END AS sample_confidence FROM g""",
    "segment_industry": segment("industry"),
    "segment_channel": segment("channel"),
    "segment_company": segment("company_name"),
    "segment_role_family": segment("role_family"),
    "segment_seniority": segment("seniority"),
    "segment_job_type": segment("job_type"),
    "segment_platform": segment("platform"),
    "response_survival": f"{STAR}, {SURVIVAL} SELECT day, at_risk, responses, censored, round(CAST(100.0 AS DOUBLE) * s, 2) AS still_waiting_pct, round(CAST(100.0 AS DOUBLE) * (CAST(1.0 AS DOUBLE) - s), 2) AS replied_pct FROM km",
    "response_time_buckets": f"""{STAR}, b AS (SELECT *, CASE WHEN days_to_response < 4 THEN '0-3 days' WHEN days_to_response < 8 THEN '4-7 days' WHEN days_to_response < 15 THEN '1-2 weeks' WHEN days_to_response < 31 THEN '2-4 weeks' ELSE '1 month+' END AS bucket FROM f WHERE days_to_response IS NOT NULL),
      g AS (SELECT bucket, min(days_to_response) AS sort_key, count(*) AS responses, {n('is_rejected')} AS rejections, {n('reached_assessment')} AS progressed FROM b GROUP BY bucket)
      SELECT *, round(CAST(100.0 AS DOUBLE) * responses / CAST(sum(responses) OVER () AS BIGINT), 1) AS share_pct FROM g""",
    "weekday_performance": f"{STAR} SELECT isodow(applied_date) AS weekday_num, strftime(applied_date, '%a') AS weekday, {A} AS applications, {R} AS responses, {rate(R, A)} AS response_rate_pct FROM f GROUP BY 1, 2",
    "activity_calendar": f"""{STAR} SELECT day AS date_day, CAST(date_trunc('week', day) AS DATE) AS week_start, isodow(day) AS day_of_week_num, count(application_id) AS applications
      FROM cal LEFT JOIN f ON applied_date = day WHERE day > {AS_OF} - 182 GROUP BY 1, 2, 3""",
    "status_mix": f"""{STAR}, g AS (SELECT current_status AS status, count(*) AS applications, round(avg(days_since_activity), 1) AS avg_days_since_activity FROM f GROUP BY 1)
      SELECT g.*, sort_order, round(CAST(100.0 AS DOUBLE) * applications / CAST(sum(applications) OVER () AS BIGINT), 1) AS share_pct FROM g JOIN st USING (status)""",
    "stage_timing": f"""{STAR} SELECT 'First reply' AS milestone, 1 AS sort_order, count(days_to_response) AS applications, CAST(median(days_to_response) AS DOUBLE) AS median_days, quantile_cont(days_to_response, 0.25) AS p25_days, quantile_cont(days_to_response, 0.75) AS p75_days FROM f
      UNION ALL SELECT 'Interview', 2, count(days_to_interview), CAST(median(days_to_interview) AS DOUBLE), quantile_cont(days_to_interview, 0.25), quantile_cont(days_to_interview, 0.75) FROM f""",
    "company_leaderboard": f"""{STAR} SELECT company_name, min(industry) AS industry, {A} AS applications, count(DISTINCT role_title) AS distinct_roles, {R} AS responses, {I} AS interviews, {n('reached_offer')} AS offers, {n('is_active')} AS open,
      {rate(R, A)} AS response_rate_pct, max(applied_date) AS last_applied FROM f GROUP BY company_name""",
    "follow_up_queue": f"""{STAR} SELECT application_id, company_name, role_title, platform, current_status, applied_date, last_activity_date, days_since_activity, gmail_link, job_url,
      CASE WHEN current_status = 'Interview' THEN 'Thank-you / status check' WHEN current_status = 'Assessment / OA' THEN 'Confirm the assessment was received' WHEN days_since_activity >= 18 THEN 'Final nudge' ELSE 'Polite follow-up' END AS suggested_action
      FROM f WHERE is_active AND days_since_activity >= 7""",
    "transitions": f"{STAR} SELECT coalesce(from_status, '(new)') AS from_status, to_status, count(*) AS transitions, round(avg(since), 1) AS avg_days_since_applied FROM fe WHERE from_status IS DISTINCT FROM to_status GROUP BY 1, 2",
    "recent_activity": f"{STAR} SELECT occurred AS occurred_on, company_name, role_title, from_status, to_status, source, note, application_id FROM fe ORDER BY occurred DESC, event_id DESC LIMIT 40",
    "data_quality": f"""{STAR}, c AS (SELECT {A} AS t, {n("role_title <> '(role not stated)'")} AS r, {n('has_job_description')} AS d, count(job_url) AS u, count(days_to_response) AS y, {R} AS yt, {n("parse_confidence >= 0.75 OR origin = 'manual'")} AS p, {n('NOT has_low_trust_dates')} AS e, {n("company_name <> 'Unknown'")} AS k FROM f)
      SELECT unnest(['Employer identified', 'Role title identified', 'Job description captured', 'Posting link captured', 'Reply date known (of replies)', 'High-confidence parse', 'Event dates from source emails']) AS check_name, unnest([k, r, d, u, y, p, e]) AS passing, unnest([t, t, t, t, yt, t, t]) AS total FROM c""",
    "applications": f"""{STAR} SELECT application_id, company_name, role_title, platform, channel, role_family, seniority, industry, job_type, location, current_status, funnel_stage, max_stage_reached, applied_date, last_activity_date,
      replied AS first_response_date, days_to_response, days_since_activity, is_response, reached_interview, is_active, origin, parsed_by, parse_confidence, job_url, gmail_link FROM f""",
    "parser_quality": f"""WITH {MESSAGES} SELECT coalesce(filter_reason, '(none)') AS filter_reason, is_application_mail, parsed_by, count(*) AS messages, round(avg(confidence), 3) AS avg_confidence,
      count(CASE WHEN confidence < 0.75 THEN 1 END) AS low_confidence_messages FROM msg GROUP BY 1, 2, 3""",
    "stg_messages": f"WITH {MESSAGES} SELECT * FROM msg",
    "stg_applications": f"""{STAR} SELECT application_id, company_name, CASE WHEN k % 10 <> 0 THEN role_title END AS role_title, platform, applied_date, current_status, last_activity_date, job_description, job_url, gmail_link, latest_subject,
      job_type, seniority, industry, role_family, location, salary_text, notes, parse_confidence, parsed_by, origin FROM a""",
    "filter_options": f"{STAR}, u AS (SELECT unnest(['platform', 'status', 'role_family', 'industry', 'job_type']) AS dim, unnest([platform, current_status, role_family, industry, job_type]) AS value FROM f) SELECT dim, value, count(*) AS n FROM u GROUP BY 1, 2",
    "date_bounds": f"{STAR} SELECT min(applied_date) AS first, max(applied_date) AS last FROM f",
    # models
    "stg_events": f"{STAR} SELECT event_id, CAST(l_orderkey AS VARCHAR) AS application_id, from_status, to_status, occurred AS occurred_on, source, CAST(NULL AS VARCHAR) AS message_id, note, CAST(stage_order AS INTEGER) AS stage_to, by_employer AS is_employer_response, trusted AS is_trusted_date FROM ev",
    "milestones": f"{STAR} SELECT application_id, max_stage_reached, is_response, replied AS first_response_on, tested AS assessment_on, talked AS interview_on, offered AS offer_on, closed AS closed_on, event_count, has_low_trust_dates FROM f",
    "fct_applications": f"""{STAR} SELECT application_id, substr(md5(lower(company_name)), 1, 16) AS company_key, substr(md5(lower(role_family)), 1, 16) AS role_family_key, substr(md5(lower(seniority)), 1, 16) AS seniority_key, substr(md5(lower(industry)), 1, 16) AS industry_key,
      substr(md5(lower(job_type)), 1, 16) AS job_type_key, substr(md5(lower(platform)), 1, 16) AS platform_key, current_status AS status_key, applied_date, last_activity_date, replied AS first_response_date, company_name, role_title, platform, channel, is_direct, role_family, seniority, industry, job_type,
      location, current_status, funnel_stage, is_terminal, is_active, origin, parsed_by, parse_confidence, job_url, gmail_link, max_stage_reached, is_response, reached_assessment, reached_interview, reached_offer, is_rejected, is_ghosted, days_to_response, days_to_interview, days_since_applied, days_since_activity,
      has_job_description, event_count, has_low_trust_dates, CAST(1 AS INTEGER) AS application_count FROM f""",
    "fct_status_events": f"{STAR} SELECT event_id, application_id, from_status, to_status, occurred AS occurred_on, source, note, by_employer AS is_employer_response, trusted AS is_trusted_date, company_name, role_title, platform, applied AS applied_date, since AS days_since_applied FROM fe",
    "dim_date": f"""{STAR} SELECT day AS date_day, CAST(strftime(day, '%Y%m%d') AS INTEGER) AS date_key, year(day) AS year, quarter(day) AS quarter, month(day) AS month, strftime(day, '%B') AS month_name, strftime(day, '%Y-%m') AS year_month,
      CAST(date_trunc('week', day) AS DATE) AS week_start, isodow(day) AS day_of_week_num, strftime(day, '%A') AS day_of_week, isodow(day) > 5 AS is_weekend, CAST({AS_OF} - day AS BIGINT) AS days_ago FROM cal""",
    "dim_company": dimension("company_name", "company_key"),
    "dim_industry": dimension("industry", "industry_key"),
    "dim_job_type": dimension("job_type", "job_type_key"),
    "dim_role_family": dimension("role_family", "role_family_key"),
    "dim_seniority": dimension("seniority", "seniority_key"),
    "dim_platform": f"{STAR} SELECT DISTINCT substr(md5(lower(platform)), 1, 16) AS platform_key, platform, channel, is_direct FROM f",
    "dim_status": f"WITH {_values()} SELECT status AS status_key, funnel_stage, stage_order, is_terminal, is_active, responds AS is_employer_response, sort_order FROM st",
    "data_tests": _tests(),
    "rpt_flat_months": f"{STAR} SELECT strftime(applied_date, '%Y-%m') AS applied_year_month, strftime(applied_date, '%A') AS applied_day_of_week, channel, count(*) AS applications, CAST(sum(event_count) AS BIGINT) AS events FROM f GROUP BY 1, 2, 3",
}
SQL |= {f"drill_{k}": f"{STAR} SELECT application_id, company_name, current_status, applied_date FROM f WHERE {c}" for k, c in DRILL.items()}

STATUS = "CASE k % 32 WHEN 5 THEN 'Screening/OA' WHEN 13 THEN 'Response' WHEN 21 THEN 'Ghosted/Inactive' WHEN 29 THEN ' Weird Legacy Status ' WHEN 26 THEN '' ELSE current_status END"
DATE = "CASE WHEN k % 37 = 0 THEN '' WHEN k % 2 = 0 THEN CAST(applied_date AS VARCHAR) || 'T09:00:00' ELSE CAST(applied_date AS VARCHAR) END"
RAW = f"""raw AS (
  SELECT *, application_id AS thread_id, k % 16 NOT IN (3, 7, 11, 15) AS valid, {STATUS} AS status, {DATE} AS day, CASE WHEN k % 31 = 0 THEN ' ' ELSE coalesce(CAST(last_activity_date AS VARCHAR), '') END AS last_updated,
         CASE WHEN k % 3 = 0 THEN 'description description description description ' ELSE 'short' END AS snippet
  FROM cleaned),
lc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY occurred DESC, event_id DESC) AS rn FROM ev) WHERE rn = 1 AND from_status IS NOT NULL)"""
SPACES = r"[ \t\n\r\f\x0B\x{00A0}]+"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def cut(x: str, patterns) -> str:
    """x before the first of the patterns, by the lengths of what stands before each."""
    at = ", ".join(f"nullif(length(string_split_regex({x}, {quoted(p)})[1]), 0)" for p in patterns)
    return f"substr({x}, 1, list_min([{at}]))"


def put_back(source: str, key: str, column: str) -> str:
    """CTEs after which `whole` has, for each key of the source, the column with its character references put back: pieces between ampersands joined with tables of names and numbers."""
    names = ", ".join(f"({quoted(n)}, {quoted(v)})" for n, v in html5.items())
    odd = ", ".join(f"({n}, {f'chr({ord(v)})' if v else quoted('')})" for n, v in text.odd_numbers().items() if n)
    short = "|".join(text.SHORT_NAMES)
    return f"""names(name, value) AS (VALUES {names}), odd(code, value) AS (VALUES {odd}),
cut_up AS (SELECT {key} AS key, unnest(string_split({column}, '&')) AS piece, unnest(range(CAST(len(string_split({column}, '&')) AS BIGINT))) AS i FROM {source}),
refs AS (SELECT *, CASE WHEN i > 0 THEN regexp_extract(piece, {quoted(text.REFERENCE)}, 1) ELSE '' END AS ref FROM cut_up),
coded AS (SELECT *, regexp_extract(ref, '^(?:{short})') AS short, ltrim(regexp_extract(ref, '^#[xX]?([0-9a-fA-F]+)', 1), '0') AS digits, ref[1:2] IN ('#x', '#X') AS hexed FROM refs),
numbers AS (SELECT *, CASE WHEN ref[1] = '#' THEN CASE WHEN length(digits) > 7 THEN 99999999 WHEN digits = '' THEN 0 WHEN hexed THEN TRY_CAST('0x' || digits AS BIGINT) ELSE TRY_CAST(digits AS BIGINT) END END AS code FROM coded),
pieces AS (
  SELECT key, i, CASE WHEN i = 0 THEN piece WHEN ref = '' THEN '&' || piece
      WHEN ref[1] = '#' THEN CASE WHEN code = 0 OR code BETWEEN 55296 AND 57343 OR code > 1114111 THEN chr(65533) WHEN odd.value IS NOT NULL THEN odd.value ELSE chr(CAST(code AS INTEGER)) END || substr(piece, length(ref) + 1)
      WHEN n.value IS NOT NULL THEN n.value || substr(piece, length(ref) + 1)
      WHEN short <> '' THEN s.value || substr(piece, length(short) + 1) ELSE '&' || piece END AS said
  FROM numbers LEFT JOIN names n ON n.name = ref LEFT JOIN names s ON s.name = short LEFT JOIN odd USING (code)),
whole AS (SELECT key, string_agg(said, '' ORDER BY i) AS said FROM pieces GROUP BY key)"""


def own_words(source: str, key: str, column: str) -> str:
    """CTEs after which `one_line` has, for each key, the new message of the column on one line."""
    return f"""sent AS (SELECT {key} AS id, coalesce({column}, '') AS body FROM {source}),
unquoted AS (SELECT id, {cut('body', text.QUOTES)} AS body FROM sent),
unsigned AS (SELECT id, {cut('body', [f'(?im){p}' for p in text.SIGNATURES])} AS body FROM unquoted),
own AS (SELECT id, array_to_string(list_filter(string_split_regex(body, '\\r\\n|[\\r\\n\\x0B\\f]'), lambda x: NOT regexp_matches(x, '^[\\s]*>')), chr(10)) AS body FROM unsigned),
{put_back('own', 'id', 'body')},
one_line AS (SELECT key AS id, array_to_string(list_filter(string_split_regex(regexp_replace(said, 'https?://\\S+', ' ', 'g'), '{SPACES}'), lambda w: w <> '')[1:400], ' ') AS one_line FROM whole)"""


WITHOUT_TAGS = r"regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script.*?>.*?</script>|<style.*?>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')"


def without_parameters(x: str) -> str:
    """A link with its query taken apart by one pattern for a parameter at its beginning or after an ampersand."""
    gone = f"regexp_replace(regexp_replace({x}, '(?i)([?&])(?:(?:{text.TRACKING})=[^&#]*&?)+', '\\1', 'g'), '[?&]+(#|$)', '\\1')"
    return f"CASE WHEN contains({x}, '?') THEN {gone} ELSE {x} END"


def labelled(x: str, rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower(coalesce({x}, '')), {quoted(p)}) THEN {quoted(n)}" for n, p in rules) + f" ELSE {quoted(default)} END"


SQL |= {
    "store_ghosting": f"""{STAR}, {RAW} SELECT thread_id, 'Applied' AS from_status, 'Ghosted' AS to_status, CAST(least(last_activity_date + 21, {AS_OF}) AS VARCHAR) AS occurred_on, 'system' AS source, 'no reply for 21+ days' AS note
      FROM raw WHERE valid AND status = 'Applied' AND last_activity_date < {AS_OF} - 21""",
    "store_last_changes": f"{STAR}, {RAW} SELECT CAST(l_orderkey AS VARCHAR) AS thread_id, event_id, from_status, to_status FROM lc",
    "store_undo": f"""{STAR}, {RAW}, g AS (SELECT * FROM lc WHERE l_orderkey % 3 = 0), rest AS (SELECT l_orderkey, max(occurred) AS latest FROM ev WHERE event_id NOT IN (SELECT event_id FROM g) GROUP BY 1)
      SELECT thread_id, coalesce(g.from_status, status) AS current_status, CASE WHEN g.event_id IS NOT NULL THEN CAST(latest AS VARCHAR) ELSE last_updated END AS last_updated
      FROM raw LEFT JOIN g ON g.l_orderkey = k LEFT JOIN rest ON rest.l_orderkey = k""",
    "store_upsert": """SELECT CAST(doc_id AS VARCHAR) AS message_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 <> 0 THEN '2001-08-01' WHEN doc_id % 5 = 0 THEN '' ELSE CAST(DATE '2001-07-01' + CAST(doc_id % 28 AS INTEGER) AS VARCHAR) END AS message_date,
      CASE WHEN doc_id % 2 = 0 THEN 'Offer' WHEN doc_id % 6 = 0 THEN 'Interview' ELSE '' END AS detected_status, 'sender' || CAST(doc_id % 7 AS VARCHAR) || '@mail.example' AS sender FROM documents JOIN labels USING (doc_id)""",
    "store_enrichment": f"""{STAR}, {RAW} SELECT thread_id, CASE WHEN k % 5 = 3 THEN 'Analyst - posting posting posting posting posting posting posting posting' ELSE snippet END AS job_description_snippet,
      CASE WHEN k % 5 = 3 THEN 'Ipoh' ELSE location END AS location, coalesce(salary_text, '') AS salary_text FROM raw""",
    "store_to_enrich": f"{STAR}, {RAW} SELECT thread_id, job_url, day AS application_date FROM raw WHERE valid AND job_url IS NOT NULL AND location IS NULL",
    "store_review_queue": f"{STAR}, {RAW} SELECT thread_id, company_name, status AS current_status, parse_confidence FROM raw WHERE valid AND parse_confidence < 0.75 AND origin <> 'manual'",
    "store_noise": f"{STAR}, {RAW} SELECT thread_id, day AS application_date, company_name, platform AS source_platform, '' AS filter_reason FROM raw WHERE k % 16 = 7",
    "store_changes": f"{STAR}, {RAW} SELECT thread_id, event_id, from_status IS NULL AS is_new FROM ev JOIN raw ON k = l_orderkey WHERE valid AND occurred >= DATE '2001-07-01'",
    "store_counts": f"{STAR}, {RAW} SELECT count(*) AS total, {n('valid')} AS valid, count(*) - {n('valid')} AS noise, (SELECT count(*) FROM documents JOIN labels USING (doc_id)) AS messages FROM raw",
    "text_messages": f"WITH c AS (SELECT conv_id, turn, text, row_number() OVER () AS r FROM conversations), {own_words('c', 'r', 'text')} SELECT conv_id, turn, CAST(length(one_line) AS INTEGER) AS chars, md5(one_line) AS digest FROM c JOIN one_line ON id = r",
    "text_job_types": f"SELECT {labelled('text', text.JOB_TYPES, text.JOB_TYPE)} AS job_type, count(*) AS documents FROM documents GROUP BY 1",
    "html_pages": rf"""WITH p AS (SELECT *, row_number() OVER () AS r FROM pages), bare AS (SELECT r, {WITHOUT_TAGS} AS bare FROM p), {put_back('bare', 'r', 'bare')},
      t AS (SELECT p.*, regexp_replace(regexp_replace(said, '{SPACES}', ' ', 'g'), '^ | $', '', 'g') AS said FROM p JOIN whole ON key = r)
      SELECT page_id, CAST(length(said) AS INTEGER) AS chars, md5(said) AS digest, regexp_replace(regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1), '{SPACES}', ' ', 'g') AS title,
             CAST(len(regexp_extract_all(coalesce(html, ''), '(?i)<a\s[^>]*href="([^"]*)"', 1)) AS INTEGER) AS links, nullif(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)), '') AS host,
             {without_parameters("coalesce(url, '')")} AS url FROM t""",
}

SENT_STATUSES = [s for s, *_, order in STATUSES if order > 0]
SQL |= {
    "status_by_platform": f"{STAR} SELECT platform, " + ", ".join(f"""count(CASE WHEN current_status = '{s}' THEN 1 END) AS "{s}\"""" for s in SENT_STATUSES) + " FROM f GROUP BY 1",
    "replies_by_month": f"{STAR} SELECT strftime(replied, '%Y-%m') AS reply_month, count(*) AS replies, {I} AS interviews FROM f WHERE replied IN (SELECT day FROM cal) GROUP BY 1",
    "industry_detail": f"""{STAR}, c AS (SELECT industry, company_name, count(*) AS n FROM f GROUP BY 1, 2), g AS (SELECT industry, count(*) AS companies, CAST(sum(n) AS BIGINT) AS applications, max(n) AS most_of_a_company FROM c GROUP BY 1)
      SELECT *, round(CAST(applications AS DOUBLE) / companies, 2) AS applications_per_company, {rate('applications', '(SELECT count(*) FROM f)')} AS share_pct FROM g""",
    "company_ranks": f"""{STAR}, c AS (SELECT company_name, count(*) AS applications FROM f GROUP BY 1)
      SELECT *, dense_rank() OVER (ORDER BY applications DESC) AS rank, CAST(sum(applications) OVER (ORDER BY applications DESC, company_name ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM c""",
    "platform_bands": f"""{STAR}, p AS (SELECT platform, {rate(R, A)} AS response_rate_pct FROM f GROUP BY 1)
      SELECT *, CASE WHEN response_rate_pct >= 5 THEN 'Strong' WHEN response_rate_pct >= 3 THEN 'Good' WHEN response_rate_pct >= 2 THEN 'Average' WHEN response_rate_pct >= 0 THEN 'Below average' END AS band FROM p""",
    "events_to_archive": f"""{STAR}, r AS (SELECT application_id, event_id, row_number() OVER (PARTITION BY application_id ORDER BY occurred DESC, event_id DESC) AS age FROM fe) SELECT * FROM r WHERE age > 3""",
    "evaluation": f"""WITH {MESSAGES}, c AS (SELECT parsed_by, {n('is_application_mail AND detected_status IS NOT NULL')} AS tp, {n('NOT is_application_mail AND detected_status IS NOT NULL')} AS fp,
        {n('is_application_mail AND detected_status IS NULL')} AS fn, {n('NOT is_application_mail AND detected_status IS NULL')} AS tn FROM msg GROUP BY 1)
      SELECT *, {rate('tp', '(tp + fp)')} AS precision_pct, {rate('tp', '(tp + fn)')} AS recall_pct, {rate('2 * tp', '(2 * tp + fp + fn)')} AS f1_pct FROM c""",
    "rpt_flat": SQL["fct_applications"].replace(STAR, f"{STAR}, x AS (", 1) + """) SELECT *, year(applied_date) AS applied_year, quarter(applied_date) AS applied_quarter, strftime(applied_date, '%Y-%m') AS applied_month,
      CAST(date_trunc('week', applied_date) AS DATE) AS applied_week, strftime(applied_date, '%A') AS applied_weekday, isodow(applied_date) AS applied_weekday_num, isodow(applied_date) > 5 AS applied_on_weekend FROM x""",
}

MERGED = """mail AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS thread_id, event_id AS message_id, CAST(occurred AS VARCHAR) AS day, source <> 'inferred' AS is_valid,
         CASE WHEN to_status NOT IN ('Ghosted', 'Withdrawn') THEN to_status END AS said, coalesce(note, '') AS subject, CAST(CASE WHEN note IS NULL THEN 0 ELSE length(note) + 1 END AS DOUBLE) / 10 AS confidence,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY occurred, event_id) AS n
  FROM ev),
marked AS (SELECT *, CASE WHEN (is_valid OR n = 1) AND said <> 'Applied' THEN said END AS counts FROM mail),
after AS (SELECT m.*, coalesce((SELECT arg_max(x.counts, x.n) FROM marked x WHERE x.thread_id = m.thread_id AND x.n <= m.n AND x.counts IS NOT NULL), 'Applied') AS status FROM marked m),
moves AS (SELECT a.*, lag(status) OVER (PARTITION BY thread_id ORDER BY n) AS before, is_valid AND n = min(CASE WHEN is_valid THEN n END) OVER (PARTITION BY thread_id) AS confirms, min(day) OVER (PARTITION BY thread_id) AS opened FROM after a)"""
SQL |= {
    "merge_threads": f"""{STAR}, {MERGED} SELECT thread_id, bool_or(is_valid) AS is_valid, arg_max(status, n) AS current_status, min(day) AS application_date,
      max(CASE WHEN n = 1 OR confirms OR (is_valid AND status <> before) THEN day END) AS last_updated, arg_max(subject, n) AS latest_subject, max(confidence) AS parse_confidence, count(*) AS messages FROM moves GROUP BY 1""",
    "merge_events": f"""{STAR}, {MERGED} SELECT thread_id, message_id, CAST(NULL AS VARCHAR) AS from_status, 'Applied' AS to_status, opened AS occurred_on FROM moves WHERE confirms
      UNION ALL SELECT thread_id, message_id, coalesce(before, 'Applied'), status, day FROM moves WHERE is_valid AND status <> coalesce(before, 'Applied')""",
}
