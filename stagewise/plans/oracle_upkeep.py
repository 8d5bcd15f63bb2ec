"""DuckDB SQL for edits, migration, repair and review."""

from __future__ import annotations

from ..functions import text
from .oracle import RAW, STAR, labelled
from .oracle_mail import EVENTS, READ

STATUSES = "('Saved / Planning', 'Applied', 'Assessment / OA', 'Interview', 'Offer', 'Rejected', 'Ghosted', 'Withdrawn')"
S = f"""{STAR}, {RAW}, ed AS (SELECT *, CASE WHEN k % 5 = 0 THEN CASE k % 3 WHEN 0 THEN 'Offer' WHEN 1 THEN 'Assessment / OA' ELSE 'Applied' END END AS new_status FROM raw), chg AS (SELECT *, new_status IS NOT NULL AND new_status <> status AS moves FROM ed)"""
OLD = f"""{STAR}, {RAW}, apps AS (SELECT *, CASE status WHEN 'Screening/OA' THEN 'Assessment / OA' WHEN 'Response' THEN 'Assessment / OA' WHEN 'Ghosted/Inactive' THEN 'Ghosted' ELSE status END AS st2 FROM raw),
stored AS (SELECT CAST(l_orderkey AS VARCHAR) AS thread_id, from_status, to_status, CAST(occurred AS VARCHAR) || 'T10:00:00' AS occurred_on, source, coalesce(' ' || note, '') AS note FROM ev WHERE l_orderkey % 8 NOT IN (0, 4)),
hist AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS thread_id, from_status, to_status, CAST(occurred AS VARCHAR) AS occurred_on, 'legacy' AS source, coalesce(' ' || note, '') AS note FROM ev WHERE l_orderkey % 8 = 0),
known AS (SELECT * FROM stored UNION ALL SELECT * FROM hist),
opening AS (SELECT thread_id, CAST(NULL AS VARCHAR) AS from_status, 'Applied' AS to_status, substr(day, 1, 10) AS occurred_on, 'inferred' AS source, 'opening event reconstructed' AS note FROM apps WHERE st2 <> 'Saved / Planning' AND NOT EXISTS (SELECT 1 FROM known e WHERE e.thread_id = apps.thread_id AND e.from_status IS NULL)),
now_at AS (SELECT thread_id, 'Applied' AS from_status, st2 AS to_status, substr(last_updated, 1, 10) AS occurred_on, 'inferred' AS source, 'current status reconstructed' AS note FROM apps WHERE st2 NOT IN ('Applied', 'Saved / Planning') AND NOT EXISTS (SELECT 1 FROM known e WHERE e.thread_id = apps.thread_id AND e.to_status = apps.st2)),
added AS (SELECT * FROM hist UNION ALL SELECT * FROM opening UNION ALL SELECT * FROM now_at)"""
DOUBT = f"""{READ}, ty AS (SELECT *, {labelled("role || ' ' || subject", text.JOB_TYPES, text.JOB_TYPE)} AS job_type, {labelled("employer || ' ' || role", text.INDUSTRIES, text.OTHER)} AS industry, truth IN {EVENTS} AS event FROM rd),
q AS (SELECT *, strftime(arrived, '%Y-%m') AS month, CAST(700 + length(snippet) AS BIGINT) AS cost FROM ty WHERE confidence < 0.75 OR (is_valid AND detected_status IS NULL) OR k % 4 = 0)"""


def differing(column: str, old: str, new: str) -> str:
    return f"SELECT message_id, '{column}' AS \"column\", CAST({old} AS VARCHAR) AS old, CAST({new} AS VARCHAR) AS new, 'recomputed' AS why FROM ty WHERE k % 11 <> 0 AND ({old}) IS DISTINCT FROM ({new})"


SQL = {
    "edit_status": f"""{S} SELECT thread_id, new_status AS current_status, '2001-08-01' AS last_updated, CASE WHEN status = 'Saved / Planning' AND new_status = 'Applied' THEN '2001-08-01' ELSE day END AS application_date FROM chg WHERE moves""",
    "edit_status_events": f"{S} SELECT thread_id, status AS from_status, new_status AS to_status, '2001-08-01' AS occurred_on, 'manual' AS source, 'by hand' AS note FROM chg WHERE moves",
    "edit_valid": f"""{STAR}, {RAW} SELECT thread_id, CASE WHEN k % 2 = 0 THEN '1' ELSE '0' END AS is_valid, CASE k % 3 WHEN 0 THEN CASE WHEN k % 2 = 0 THEN 'manual recovery' ELSE 'manual: marked as noise' END WHEN 1 THEN 'manual: seen' ELSE 'manual: sure' END AS filter_reason FROM raw WHERE k % 7 = 0""",
    "edit_valid_events": f"""{STAR}, {RAW} SELECT thread_id, CAST(NULL AS VARCHAR) AS from_status, 'Applied' AS to_status, 'manual' AS source, 'recovered from the noise filter' AS note FROM raw
      WHERE k % 14 = 0 AND (k % 9 = 0 OR k NOT IN (SELECT l_orderkey FROM ev))""",
    "edit_fields": f"""{STAR}, {RAW} SELECT thread_id, 'Data Analyst ' || CAST(k % 4 AS VARCHAR) AS role_title, 'Data & Analytics' AS role_family, CASE WHEN k % 4 = 3 THEN 'Ipoh' ELSE coalesce(location, '') END AS location FROM raw WHERE k % 6 = 1""",
    "edit_follow_up": f"""{STAR}, {RAW} SELECT thread_id, coalesce(notes || chr(10), '') || '[2001-08-01] Followed up' || CASE WHEN k % 4 = 3 THEN ': called' ELSE '' END AS notes, '2001-08-01' AS last_updated FROM raw WHERE k % 10 = 3""",
    "migration_events": f"{OLD} SELECT * FROM added",
    "migration_again": f"{OLD} SELECT source, count(*) AS once, count(*) AS twice FROM (SELECT source FROM stored UNION ALL SELECT source FROM added) GROUP BY 1",
    "repair_plan": f"{DOUBT} {differing('is_valid', 'event', 'is_valid')} UNION ALL {differing('detected_status', 'CASE WHEN event THEN truth END', 'detected_status')} UNION ALL {differing('job_type', "'Full-Time'", 'job_type')} UNION ALL {differing('industry', "CASE WHEN k % 3 = 0 THEN '' ELSE industry END", 'industry')}",
    "repaired_rows": f"{DOUBT} SELECT message_id, is_valid, detected_status, job_type, industry FROM ty WHERE k % 11 <> 0",
    "review_plan": f"""{DOUBT}, u AS (SELECT *, CAST(coalesce(sum(cost) OVER (PARTITION BY month ORDER BY arrived, message_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) + 500 < 9000 AS afforded FROM q WHERE k % 3 <> 0),
      c AS (SELECT *, count(CASE WHEN afforded THEN 1 END) OVER (ORDER BY arrived, message_id ROWS UNBOUNDED PRECEDING) AS n FROM u)
      SELECT message_id, month, cost, CASE WHEN NOT afforded THEN 'over budget' WHEN n > 400 THEN 'over cap' ELSE 'ask' END AS plan FROM c UNION ALL SELECT message_id, month, cost, 'cached' FROM q WHERE k % 3 = 0""",
    "review_results": f"""{DOUBT}, x AS (SELECT ty.*, q.k IS NOT NULL AND ty.k % 3 = 0 AND CAST(ty.k % 100 AS DOUBLE) / 100 >= 0.6 AS sure FROM ty LEFT JOIN (SELECT k FROM q) q USING (k))
      SELECT message_id, CASE WHEN sure THEN event ELSE is_valid END AS is_valid, CASE WHEN sure AND event THEN truth ELSE detected_status END AS detected_status, CAST(CASE WHEN sure THEN CAST(k % 100 AS DOUBLE) / 100 ELSE confidence END AS DOUBLE) AS confidence, CASE WHEN sure THEN 'llm' ELSE 'rules' END AS parsed_by FROM x""",
    "first_seen_customers": """WITH l AS (SELECT 1 AS listing, o_orderkey AS position, o_custkey AS id FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT 2, o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 3, o_orderkey, o_custkey FROM orders),
      f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY listing, position) AS rn FROM l) SELECT id, listing, position, row_number() OVER (ORDER BY listing, position, id) AS n FROM f WHERE rn = 1""",
}
