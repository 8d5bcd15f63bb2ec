"""DuckDB SQL for the queries over mail and pages."""

from __future__ import annotations

from ..domain import RANK
from ..functions import links, names, text
from ..functions import verdicts as v
from ..sources import job_pages, mail
from .oracle import labelled, own_words, put_back, quoted, rate, without_parameters

MAIL = f"WITH {mail.DUCKDB}, m AS (SELECT * FROM mail), {own_words('m', 'k', 'body')}, r AS (SELECT m.*, one_line AS snippet FROM m JOIN one_line ON id = k)"


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {quoted(pattern)})"


def first_rule(x: str, rules: v.Rules) -> str:
    return "CASE " + " ".join(f"WHEN {matches(x, p)} THEN {quoted(n)}" for n, p in rules) + " END"


HITS = f"""h AS (
  SELECT *, lower(subject || ' ' || snippet) AS txt, lower(sender || ' ' || subject) AS head, lower(sender) AS low FROM r),
g AS (
  SELECT *, {first_rule('head', v.BLOCKED)} AS blocked, {first_rule('low', v.BLOCKED_SENDERS)} AS from_blocked, {first_rule('txt', v.STRONG)} AS strong, {first_rule('txt', v.WEAK)} AS weak, {first_rule('txt', v.HARD)} AS hard,
         coalesce({first_rule('txt', v.GARBAGE)}, CASE WHEN {matches('low', v.BOARDS)} AND {matches('txt', v.BOARD_NOISE)} THEN 'board advert' END) AS garbage FROM h),
t AS (
  SELECT *, CASE WHEN blocked IS NOT NULL THEN 'blocked' WHEN from_blocked IS NOT NULL THEN 'blocked sender' WHEN hard IS NOT NULL AND coalesce(strong, weak) IS NOT NULL THEN 'vetoed'
      WHEN strong IS NOT NULL THEN 'strong' WHEN weak IS NOT NULL AND garbage IS NULL THEN 'weak' WHEN weak IS NOT NULL THEN 'noisy'
      WHEN garbage IS NULL AND hard IS NULL AND {matches('low', v.VENDORS)} AND {matches('txt', v.TEST_WORDS)} THEN 'vendor' WHEN garbage IS NULL AND {matches('low', v.PLATFORMS)} AND {matches('txt', v.LOOSE)} THEN 'loose'
      WHEN garbage IS NOT NULL THEN 'garbage' WHEN {matches('low', v.PLATFORMS)} OR {matches('txt', v.RECRUITING)} OR {matches('sender', v.PERSON)} THEN 'near miss' ELSE 'nothing' END AS tier FROM g),
d AS (
  SELECT *, tier IN ('strong', 'weak', 'vendor', 'loose') AS is_valid,
         CASE tier WHEN 'blocked' THEN 0.97 WHEN 'blocked sender' THEN 0.95 WHEN 'vetoed' THEN 0.8 WHEN 'strong' THEN 0.95 WHEN 'weak' THEN 0.85 WHEN 'noisy' THEN 0.55 WHEN 'vendor' THEN 0.8 WHEN 'loose' THEN 0.65 WHEN 'garbage' THEN 0.85 WHEN 'near miss' THEN 0.55 ELSE 0.85 END AS confidence,
         tier || ' (' || CASE tier WHEN 'blocked' THEN blocked WHEN 'blocked sender' THEN from_blocked WHEN 'vetoed' THEN hard WHEN 'strong' THEN strong WHEN 'weak' THEN weak WHEN 'noisy' THEN garbage WHEN 'vendor' THEN 'test' WHEN 'loose' THEN 'platform' WHEN 'garbage' THEN garbage
           WHEN 'near miss' THEN CASE WHEN {matches('low', v.PLATFORMS)} THEN 'platform' WHEN {matches('txt', v.RECRUITING)} THEN 'vocabulary' ELSE 'person' END ELSE 'no rule' END || ')' AS reason FROM t)"""


def told(x: str) -> str:
    """The rank of the strongest status that a text tells of, by sentences cut at stops once the dots of abbreviations are hidden."""
    hidden = rf"regexp_replace(lower({x}), '\b({'|'.join(v.ABBREVIATIONS)})\.(\s)', '\1' || chr(1) || '\2', 'g')"
    said = rf"replace(array_to_string(list_filter(string_split_regex({hidden}, '[.!?]\s+'), lambda s: NOT {matches('s', '|'.join(v.CONDITIONAL))}), ' '), chr(1), '.')"
    said = f"regexp_replace({said}, {quoted(v.RECORDED)}, 'video assessment', 'g')"
    return "greatest(" + ", ".join(f"CASE WHEN {matches(said, '|'.join(p))} THEN {RANK[s]} ELSE -1 END" for s, p in v.STATUSES) + ")"


BY_RANK = "CASE {} " + " ".join(f"WHEN {RANK[s]} THEN {quoted(s)}" for s, _ in v.STATUSES) + " END"
READ = f"""{MAIL}, {HITS}, b AS (SELECT *, {told('snippet')} AS in_body, {told('subject')} AS in_subject FROM d),
s AS (SELECT *, CASE WHEN is_valid AND {matches('low', v.VENDORS)} THEN greatest(in_body, in_subject, {RANK['Assessment / OA']}) ELSE greatest(in_body, in_subject) END AS rank FROM b),
rd AS (SELECT *, {BY_RANK.format('rank')} AS detected_status FROM s)"""
EVENTS = ("Applied", "Assessment / OA", "Interview", "Offer", "Rejected")
CELLS = f"""{READ}, e AS (
  SELECT split, tags, CASE WHEN truth IN {EVENTS} THEN truth ELSE '(none)' END AS expected,
         CASE WHEN is_valid THEN coalesce(detected_status, 'Applied') WHEN truth IN {EVENTS} THEN '(missed)' ELSE '(none)' END AS predicted FROM rd),
cells AS (
  SELECT 'all' AS dimension, 'all' AS value, expected, predicted, count(*) AS n FROM e GROUP BY 3, 4 UNION ALL SELECT 'split', split, expected, predicted, count(*) FROM e GROUP BY 2, 3, 4
  UNION ALL SELECT 'tag', tag, expected, predicted, count(*) FROM (SELECT *, unnest(list_filter(string_split(tags, ' '), lambda t: t <> '')) AS tag FROM e) GROUP BY 2, 3, 4)"""
SQL = {
    "mail_bodies": f"{MAIL} SELECT message_id, CAST(length(snippet) AS INTEGER) AS chars, md5(snippet) AS digest FROM r",
    "mail_verdicts": f"{MAIL}, {HITS} SELECT message_id, tier, is_valid, CAST(confidence AS DOUBLE) AS confidence, reason FROM d",
    "mail_tiers": f"{MAIL}, {HITS} SELECT tier, reason, count(*) AS messages FROM d GROUP BY 1, 2",
    "mail_statuses": f"{READ} SELECT message_id, detected_status, confidence < 0.75 OR (is_valid AND detected_status IS NULL) AS is_ambiguous FROM rd",
    "mail_labels": f"""WITH {mail.DUCKDB} SELECT {labelled("role || ' ' || subject", text.JOB_TYPES, text.JOB_TYPE)} AS job_type, {labelled('role', text.SENIORITIES, text.SENIORITY)} AS seniority,
      {labelled("employer || ' ' || role", text.INDUSTRIES, text.OTHER)} AS industry, {labelled('role', text.ROLE_FAMILIES, text.OTHER)} AS role_family, count(*) AS messages FROM mail GROUP BY 1, 2, 3, 4""",
    "evaluation_confusion": f"{CELLS} SELECT * FROM cells",
    "evaluation_by_class": f"""{CELLS}, x AS (
      SELECT dimension, value, expected, predicted, n FROM cells UNION ALL SELECT dimension, value, CASE WHEN expected <> '(none)' THEN '(event)' ELSE '(none)' END, CASE WHEN predicted NOT IN ('(none)', '(missed)') THEN '(event)' ELSE '(none)' END, n FROM cells),
      c AS (SELECT dimension, value, expected AS class FROM x UNION SELECT dimension, value, predicted FROM x),
      y AS (SELECT c.*, CAST(coalesce(sum(CASE WHEN expected = class THEN n END), 0) AS BIGINT) AS support, CAST(coalesce(sum(CASE WHEN x.predicted = class THEN n END), 0) AS BIGINT) AS predicted, CAST(coalesce(sum(CASE WHEN expected = class AND x.predicted = class THEN n END), 0) AS BIGINT) AS correct
        FROM c JOIN x USING (dimension, value) WHERE class NOT IN ('(none)', '(missed)') GROUP BY ALL)
      SELECT *, {rate('correct', 'predicted')} AS precision_pct, {rate('correct', 'support')} AS recall_pct, {rate('2 * correct', '(support + predicted)')} AS f1_pct FROM y""",
    "evaluation_gate": f"""{CELLS}, w AS (SELECT sum(CASE WHEN expected <> '(none)' AND predicted <> '(missed)' THEN n ELSE 0 END) AS tp, sum(CASE WHEN expected = '(none)' AND predicted <> '(none)' THEN n ELSE 0 END) AS fp,
        sum(CASE WHEN predicted = '(missed)' THEN n ELSE 0 END) AS fn, sum(CASE WHEN expected = predicted AND expected <> '(none)' THEN n ELSE 0 END) AS hit, sum(CASE WHEN expected <> '(none)' THEN n ELSE 0 END) AS events FROM cells WHERE dimension = 'all'),
      z AS (SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, {rate('2 * tp', '(2 * tp + fp + fn)')} AS f1_pct, {rate('hit', 'events')} AS status_pct FROM w) SELECT *, f1_pct >= 95 AND status_pct >= 90 AS passes FROM z""",
}

FOLD = f"""{READ.replace('WITH ', 'WITH RECURSIVE ', 1)}, msg AS (
  SELECT thread_id, message_id, 'mail' AS kind, CAST(arrived AS VARCHAR) AS arrived, CAST(day AS VARCHAR) AS day, is_valid, reason, detected_status AS said,
         CASE WHEN contains(sender, '@board.') THEN 'Board' WHEN contains(sender, '@ats.') THEN 'ATS' WHEN contains(sender, ' <hr@') THEN string_split(sender, ' <')[1] ELSE 'Unknown' END AS employer,
         coalesce(nullif(regexp_extract(subject, '^.* for (.+)$', 1), ''), regexp_extract(subject, '^(.+) at .+$', 1)) AS role, CASE WHEN contains(sender, '@ats.') THEN 'ATS' WHEN contains(sender, '@board.') THEN 'Board' ELSE 'Other' END AS platform,
         regexp_extract(body, '(https?://\\S+)', 1) AS url, substr(snippet, 1, 120) AS excerpt, subject, {labelled("role || ' ' || subject", text.JOB_TYPES, text.JOB_TYPE)} AS job_type, {labelled('role', text.SENIORITIES, text.SENIORITY)} AS seniority,
         {labelled("employer || ' ' || role", text.INDUSTRIES, text.OTHER)} AS industry, CAST(confidence AS DOUBLE) AS confidence, CASE WHEN k % 7 = 0 THEN 'llm' ELSE 'gmail' END AS origin FROM rd),
hand AS (SELECT thread_id, 'hand-' || thread_id AS message_id, 'verdict' AS kind, CAST(CAST(min(arrived) AS DATE) + 10 AS VARCHAR) AS arrived, CAST(thread_id AS BIGINT) % 2 = 0 AS is_valid FROM msg WHERE CAST(thread_id AS BIGINT) % 13 = 0 GROUP BY thread_id),
o AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY arrived, message_id) AS n FROM (SELECT * FROM msg UNION ALL BY NAME SELECT *, arrived AS day FROM hand)),
st AS (
  SELECT thread_id, n, is_valid AS valid, reason AS why, employer, role, platform, coalesce(said, 'Applied') AS status, day AS opened, day AS updated, subject, url, excerpt, job_type, seniority, industry, confidence,
         CASE WHEN is_valid THEN day END AS last, CASE WHEN is_valid THEN CASE WHEN coalesce(said, 'Applied') <> 'Applied' THEN 2 ELSE 1 END ELSE 0 END AS evs, 1 AS msgs,
         CAST(NULL AS VARCHAR) AS ghost, CASE WHEN is_valid THEN day END AS begun, 'gmail' AS begun_by, 'first email in thread' AS begun_note, CASE WHEN is_valid AND said <> 'Applied' THEN 'Applied' END AS e_from, CASE WHEN is_valid AND said <> 'Applied' THEN said END AS e_to, day AS e_day, origin AS e_by, subject AS e_note, message_id AS mid
  FROM o WHERE n = 1
  UNION ALL
  SELECT thread_id, n, valid2, why2, employer2, role2, platform2, status2, opened2, CASE WHEN m_valid AND mail AND (status2 <> status1 OR employer2 <> employer OR role2 <> role OR platform2 <> platform OR url2 <> url OR excerpt2 <> excerpt OR valid2 <> valid) THEN greatest(updated, m_day) ELSE updated END,
         CASE WHEN mail THEN m_subject ELSE subject END, url2, excerpt2, CASE WHEN m_job_type <> '' THEN m_job_type ELSE job_type END, CASE WHEN m_seniority <> '' THEN m_seniority ELSE seniority END, CASE WHEN m_industry <> '' THEN m_industry ELSE industry END, greatest(confidence, coalesce(m_confidence, 0)),
         CASE WHEN status2 <> status1 THEN greatest(coalesce(last2, m_day), m_day) ELSE last2 END, evs2 + CASE WHEN status2 <> status1 THEN 1 ELSE 0 END, msgs + CASE WHEN mail THEN 1 ELSE 0 END,
         CASE WHEN due THEN due_on END, CASE WHEN begins THEN opened2 END, CASE WHEN mail THEN 'gmail' ELSE 'manual' END, CASE WHEN mail THEN 'thread confirmed as an application' ELSE 'recovered from the noise filter' END,
         CASE WHEN status2 <> status1 THEN status1 END, CASE WHEN status2 <> status1 THEN status2 END, m_day, m_origin, m_subject, m_id
  FROM (SELECT *, CASE WHEN begins THEN greatest(coalesce(last1, opened2), opened2) ELSE last1 END AS last2, evs1 + CASE WHEN begins THEN 1 ELSE 0 END AS evs2
    FROM (SELECT *, valid2 AND evs1 = 0 AND (NOT mail OR NOT valid) AS begins
      FROM (SELECT *, CASE WHEN NOT mail THEN m_valid WHEN why LIKE 'manual%' THEN valid ELSE valid OR m_valid END AS valid2,
              CASE WHEN NOT mail THEN 'manual: looked at' WHEN why LIKE 'manual%' THEN why WHEN m_valid THEN coalesce(nullif(m_reason, ''), why) WHEN NOT valid THEN coalesce(nullif(m_reason, ''), nullif(why, ''), 'no positive affirmation') ELSE why END AS why2,
              CASE WHEN mail AND employer IN ('', 'Unknown', 'Board', 'ATS') AND m_employer NOT IN ('', 'Unknown', 'Board', 'ATS') THEN m_employer ELSE employer END AS employer2,
              CASE WHEN mail AND m_role <> '' AND NOT list_has_any(string_split(lower(role), ' '), ['analyst', 'clerk', 'engineer', 'planner', 'associate', 'officer', 'developer']) THEN m_role ELSE role END AS role2,
              CASE WHEN mail AND platform = 'Other' THEN m_platform ELSE platform END AS platform2, CASE WHEN mail AND m_valid THEN least(opened, m_day) ELSE opened END AS opened2,
              CASE WHEN url = '' AND mail THEN m_url ELSE url END AS url2, CASE WHEN excerpt = '' AND mail THEN m_excerpt ELSE excerpt END AS excerpt2,
              CASE WHEN NOT mail OR NOT m_valid THEN status1 WHEN m_said <> status1 AND m_day >= coalesce(last1, '') THEN CASE WHEN m_said = 'Applied' AND status1 <> 'Ghosted' THEN status1 ELSE m_said END
                   WHEN status1 = 'Ghosted' AND m_day > coalesce(last1, '') THEN coalesce(m_said, 'Applied') ELSE status1 END AS status2
        FROM (SELECT *, CASE WHEN due THEN 'Ghosted' ELSE status END AS status1, CASE WHEN due THEN greatest(coalesce(last, due_on), due_on) ELSE last END AS last1, evs + CASE WHEN due THEN 1 ELSE 0 END AS evs1
          FROM (SELECT s.* EXCLUDE (n, ghost, begun, begun_by, begun_note, e_from, e_to, e_day, e_by, e_note, mid), m.n, m.kind = 'mail' AS mail, m.message_id AS m_id, m.day AS m_day, m.is_valid AS m_valid, m.reason AS m_reason, m.said AS m_said, m.employer AS m_employer, m.role AS m_role, m.platform AS m_platform,
                  m.url AS m_url, m.excerpt AS m_excerpt, m.subject AS m_subject, m.job_type AS m_job_type, m.seniority AS m_seniority, m.industry AS m_industry, m.confidence AS m_confidence, m.origin AS m_origin, CAST(CAST(s.updated AS DATE) + 21 AS VARCHAR) AS due_on,
                  s.valid AND s.status = 'Applied' AND CAST(CAST(s.updated AS DATE) + 21 AS VARCHAR) < m.arrived AS due
            FROM st s JOIN o m ON m.thread_id = s.thread_id AND m.n = s.n + 1)))))),
fin AS (SELECT *, CAST(CAST(updated AS DATE) + 21 AS VARCHAR) AS due_on, valid AND status = 'Applied' AND CAST(CAST(updated AS DATE) + 21 AS VARCHAR) < '2001-08-02' AS due FROM (SELECT *, max(n) OVER (PARTITION BY thread_id) AS top FROM st) WHERE n = top)"""
SQL |= {
    "thread_states": f"""{FOLD} SELECT thread_id, valid AS is_valid, why AS reason, employer, role, platform, CASE WHEN due THEN 'Ghosted' ELSE status END AS status, opened AS application_date, updated AS last_updated, subject, url AS job_url, excerpt, job_type, seniority, industry, confidence,
      CASE WHEN due THEN greatest(coalesce(last, due_on), due_on) ELSE last END AS last_event, CAST(evs + CASE WHEN due THEN 1 ELSE 0 END AS BIGINT) AS events, CAST(msgs AS BIGINT) AS messages FROM fin""",
    "thread_events": f"""{FOLD}, all_events AS (
      SELECT thread_id, 'Applied' AS from_status, 'Ghosted' AS to_status, ghost AS occurred_on, 'system' AS source, '' AS message_id, 'no reply for 21+ days' AS note FROM st WHERE ghost IS NOT NULL
      UNION ALL SELECT thread_id, 'Applied', 'Ghosted', due_on, 'system', '', 'no reply for 21+ days' FROM fin WHERE due
      UNION ALL SELECT thread_id, NULL, 'Applied', begun, begun_by, mid, begun_note FROM st WHERE begun IS NOT NULL
      UNION ALL SELECT thread_id, e_from, e_to, e_day, e_by, mid, substr(e_note, 1, 160) FROM st WHERE e_to IS NOT NULL) SELECT * FROM all_events""",
}


def ld(j: str, key: str) -> str:
    """The text of a member: of a scalar, an object's first text, or a list's texts side by side."""
    v = f"json_extract({j}, '$.\"{key}\"')"

    def plain(x: str) -> str:
        inner = ", ".join(f"nullif(json_extract_string({x}, '$.\"{k}\"'), '')" for k in ("@value", "name", "text", "value"))
        return f"CASE json_type({x}) WHEN 'OBJECT' THEN coalesce({inner}, '') WHEN 'ARRAY' THEN '' WHEN 'NULL' THEN '' ELSE coalesce(json_extract_string({x}, '$'), '') END"

    return f"CASE WHEN json_type({v}) = 'ARRAY' THEN array_to_string(list_transform(CAST({v} AS JSON[]), lambda e: {plain('e')}), ' ') ELSE coalesce({plain(v)}, '') END"


def tag(wanted: str) -> str:
    """The content of the first meta tag of that name, by its position in the list of tags."""
    names, value = "property|name", r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    def attr(t: str, n: str) -> str:
        return "(" + " || ".join(f"regexp_extract({t}, {quoted(rf'(?i)[^\w:-](?:{n}){value}')}, {g})" for g in (1, 2, 3)) + ")"
    tags = r"regexp_extract_all(html, '(?is)(<meta\b[^>]*>)', 1)"
    return f"coalesce({attr(f'list_filter({tags}, lambda t: lower({attr("t", names)}) = {quoted(wanted)})[1]', 'content')}, '')"


ADDRESS = "concat_ws(', ', " + ", ".join(f"nullif({ld("json_extract(p, '$.address')", k)}, '')" for k in ("addressLocality", "addressRegion", "addressCountry")) + ")"
LOW, HIGH = (f"coalesce(json_extract_string(j, '$.baseSalary.{k}[0]'), json_extract_string(j, '$.baseSalary.{k}'), json_extract_string(j, '$.baseSalary.value.{k}'))" for k in ("minValue", "maxValue"))
POSTINGS = rf"""{job_pages.statement()},
blocks AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<script\b[^>]*\btype\s*=\s*["'']?application/ld\+json["'']?[^>]*>(.*?)</script>', 1)) AS b FROM job_pages),
tree AS (SELECT page_id, t.value AS j FROM (SELECT * FROM blocks WHERE json_valid(b)) x, json_tree(x.b) t WHERE t.type = 'OBJECT'),
jobs AS (SELECT page_id, j FROM tree WHERE list_contains(CASE WHEN json_type(json_extract(j, '$."@type"')) = 'ARRAY' THEN CAST(json_extract(j, '$."@type"') AS VARCHAR[]) ELSE [json_extract_string(j, '$."@type"')] END, 'JobPosting')),
told AS (
  SELECT page_id, {ld('j', 'title')} AS title, {ld('j', 'hiringOrganization')} AS company, {ld('j', 'description')} AS description, substr({ld('j', 'datePosted')}, 1, 10) AS posted_date,
         array_to_string(list_filter(list_transform(CASE WHEN json_type(json_extract(j, '$.jobLocation')) = 'ARRAY' THEN CAST(json_extract(j, '$.jobLocation') AS JSON[]) ELSE [json_extract(j, '$.jobLocation')] END, lambda p: {ADDRESS}), lambda x: x <> ''), '; ') AS location,
         CASE WHEN {LOW} IS NOT NULL AND {HIGH} IS NOT NULL THEN {LOW} || chr(8211) || {HIGH} WHEN json_type(json_extract(j, '$.baseSalary.value')) IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN json_extract_string(j, '$.baseSalary.value') END
           || coalesce(' ' || json_extract_string(j, '$.baseSalary.currency'), '') || coalesce(' / ' || lower(json_extract_string(j, '$.baseSalary.value.unitText')), '') AS salary,
         CASE WHEN json_type(json_extract(j, '$.employmentType')) = 'ARRAY' THEN array_to_string(CAST(json_extract(j, '$.employmentType') AS VARCHAR[]), ' / ') ELSE coalesce(json_extract_string(j, '$.employmentType'), '') END AS kind FROM jobs),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(description) DESC, title, posted_date) AS rn FROM told) WHERE rn = 1),
raw AS (SELECT p.page_id, {tag('og:title')} AS og_title, {tag('og:description')} AS og_description, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS page_title, b.* EXCLUDE (page_id, rn) FROM job_pages p LEFT JOIN best b USING (page_id)),
long AS (SELECT page_id, unnest(['og_title', 'og_description', 'page_title', 'title', 'company', 'description']) AS field, unnest([og_title, og_description, page_title, title, company, description]) AS t FROM raw),
keyed AS (SELECT page_id || '/' || field AS k, coalesce(t, '') AS t FROM long), {put_back('keyed', 'k', 't')},
clean AS (SELECT CAST(string_split(key, '/')[1] AS BIGINT) AS page_id, string_split(key, '/')[2] AS field, trim(regexp_replace(said, '\s+', ' ', 'g')) AS t FROM whole),
wide AS (SELECT page_id, max(CASE WHEN field = 'og_title' THEN t END) AS og_title, max(CASE WHEN field = 'og_description' THEN t END) AS og_description, max(CASE WHEN field = 'page_title' THEN substr(t, 1, 150) END) AS page_title, max(CASE WHEN field = 'title' THEN t END) AS ld_title,
  max(CASE WHEN field = 'company' THEN t END) AS company, max(CASE WHEN field = 'description' THEN substr(t, 1, 4000) END) AS ld_description FROM clean GROUP BY 1),
kinds AS (SELECT page_id, array_to_string(list_transform(string_split(replace(kind, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS employment_type FROM raw)"""
SQL |= {
    "page_postings": f"""WITH {POSTINGS}, final AS (SELECT w.page_id, coalesce(nullif(og_title, ''), nullif(ld_title, ''), page_title) AS title, CASE WHEN length(ld_description) >= length(og_description) THEN ld_description ELSE og_description END AS description, w.company,
        coalesce(raw.location, '') AS location, coalesce(raw.salary, '') AS salary, coalesce(raw.posted_date, '') AS posted_date, coalesce(k.employment_type, '') AS employment_type FROM wide w JOIN (SELECT page_id, location, salary, posted_date FROM raw) raw USING (page_id) JOIN kinds k USING (page_id))
      SELECT *, title <> '' OR description <> '' AS ok FROM final""",
}

LINKS = f"""WITH {mail.DUCKDB}, cut AS (SELECT k, message_id, body, regexp_extract_all(body, {quoted(links.LINK)}) AS l, string_split_regex(body, {quoted(links.LINK)}) AS w FROM mail),
each AS (SELECT k, message_id, body, unnest(l) AS link, unnest(w[1:len(l)]) AS word, unnest(range(1, CAST(len(l) + 1 AS BIGINT))) AS i FROM cut),
placed AS (SELECT *, CAST(sum(length(word)) OVER p + coalesce(sum(length(link)) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM each WINDOW p AS (PARTITION BY k ORDER BY i)),
bare AS (SELECT *, {without_parameters('link')} AS url, lower(substr(body, greatest(pos - 120, 0) + 1, least(pos, 120))) AS before FROM placed),
points AS (SELECT *, CASE WHEN {matches('before', links.CONTEXT)} THEN 4 ELSE 0 END + CASE WHEN {matches('lower(url)', links.HOST)} THEN 3 ELSE 0 END + CASE WHEN {matches('lower(url)', links.PATH)} THEN 2 ELSE 0 END - CASE WHEN {matches('lower(url)', links.EXCLUDED)} THEN 10 ELSE 0 END AS score FROM bare),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, i) AS rn FROM points WHERE score > 0) WHERE rn = 1)"""
SQL["mail_links"] = f"{LINKS} SELECT c.message_id, regexp_replace(coalesce(url, ''), {quoted(links.TRAILING)}, '') AS url, coalesce(score, 0) AS score FROM cut c LEFT JOIN top USING (k)"


def phrase(x: str, patterns) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({x}, {quoted(p)}, 1), '')" for p in patterns) + ", '')"


#: A label is spelt if it matches a pattern made of the name: each word whole or by its first letter, legal forms perhaps.
SPELT = f"""'^' || array_to_string(list_transform(list_filter(string_split(regexp_replace(lower(c), '[^a-z0-9. ]', '', 'g'), ' '), lambda w: w <> ''), lambda w: '(?:' || replace(w, '.', '[.]') || '|' || replace(w[1], '.', '[.]') || CASE WHEN w IN {names.LEGAL} THEN '|' ELSE '' END || ')'), '') || '$'"""
NAMES = f"""{MAIL}, lab AS (SELECT *, CASE WHEN {matches("lower(regexp_extract(sender, '@(?:[\\w-]+\\.)*([\\w-]+)\\.[A-Za-z]+', 1))", names.PLATFORM_HOSTS)} THEN '' ELSE lower(regexp_extract(sender, '@(?:[\\w-]+\\.)*([\\w-]+)\\.[A-Za-z]+', 1)) END AS label FROM r),
cand AS (SELECT k, label, unnest(regexp_extract_all(subject || chr(10) || snippet, {quoted(f"({names.NAME})")}, 1)) AS c FROM lab),
spelt AS (SELECT k, max(struct_pack(l := length(c), n := c)).n AS n FROM cand WHERE length(label) >= 3 AND regexp_matches(label, {SPELT}) GROUP BY k),
says AS (SELECT k, message_id, employer AS truth_name, unnest([coalesce(spelt.n, ''), {phrase('subject', names.SUBJECT_PHRASES)}, CASE WHEN {matches('sender', names.PERSON)} AND NOT {matches('sender', names.OFFICE)} THEN '' ELSE regexp_extract(sender, '^(.+) <', 1) END, {phrase('snippet', names.BODY_PHRASES)}, upper(label[1]) || label[2:]]) AS said,
  unnest({list(names.WITNESSES)}) AS witness, unnest([1, 2, 3, 4, 5]) AS i FROM lab LEFT JOIN spelt USING (k)),
good AS (SELECT *, regexp_replace(trim(said), '[ ,;:!?-]+$', '') AS name FROM says),
heard AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY i) AS n FROM good WHERE NOT {matches('name', names.NOT_NAMES)} AND length(name) >= 3),
up AS (
  SELECT k, message_id, truth_name, n, name, witness FROM heard WHERE n = 1 UNION ALL
  SELECT up.k, up.message_id, up.truth_name, h.n, CASE WHEN starts_with(lower(h.name), lower(up.name) || ' ') AND len(string_split(h.name, ' ')) - len(string_split(up.name, ' ')) <= 3 THEN h.name ELSE up.name END,
    CASE WHEN starts_with(lower(h.name), lower(up.name) || ' ') AND len(string_split(h.name, ' ')) - len(string_split(up.name, ' ')) <= 3 THEN h.witness ELSE up.witness END FROM up JOIN heard h ON h.k = up.k AND h.n = up.n + 1),
who AS (SELECT m.message_id, m.employer AS truth_name, coalesce(arg_max(name, n), 'Unknown') AS employer, coalesce(arg_max(witness, n), 'none') AS witness FROM m LEFT JOIN up USING (k) GROUP BY 1, 2)""".replace("WITH ", "WITH RECURSIVE ", 1)
NORMAL = "array_to_string(list_filter(string_split(regexp_replace(lower({}), '[^a-z0-9 ]', '', 'g'), ' '), lambda w: w NOT IN ('', " + ", ".join(f"'{x}'" for x in names.LEGAL if "." not in x) + ")), ' ')"
SQL |= {
    "mail_employers": f"{NAMES} SELECT message_id, employer, witness FROM who",
    "evaluation_employers": f"{NAMES}, x AS (SELECT witness, count(*) AS messages, count(CASE WHEN employer = truth_name THEN 1 END) AS e, count(CASE WHEN {NORMAL.format('employer')} = {NORMAL.format('truth_name')} THEN 1 END) AS l FROM who GROUP BY 1) SELECT witness, messages, {rate('e', 'messages')} AS exact_pct, {rate('l', 'messages')} AS lenient_pct FROM x",
}
