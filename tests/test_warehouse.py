"""Models, metrics, filters and data tests: over the driver's tables against DuckDB, and over a few untidy rows by hand."""

import html
import html.entities
import math
import random
import re
import shutil
import subprocess
import sys
from datetime import date
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from stagewise.domain import RANK
from stagewise.functions import text, verdicts
from stagewise.operators import merge, store
from stagewise.operators.filters import Filters
from stagewise.operators.prefix import running
from stagewise.plans import checks, evaluation, models, oracle, oracle_mail, oracle_upkeep, queries
from stagewise.plans.build import Frames, build, publish, read_published
from stagewise.plans.metrics import Metrics
from stagewise.sources import mail, tables

SF = "/root/testdata/sf0.001"
AS_OF = date(2026, 1, 31)


def plain(x):
    if isinstance(x, Decimal):
        x = int(x) if x == int(x) else float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return x


def rows_of(names, rows):
    keep = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in keep) for r in rows), key=repr)


@pytest.mark.parametrize("name", ["stg_applications", "stg_messages", "fct_applications", "parser_quality", "kpis", "kpis_filtered", "segment_seniority", "data_tests", "dim_platform", "drill_follow_up", *queries.STORE, *queries.MERGE, *queries.SEMANTIC, "mail_tiers", "mail_statuses", "mail_labels", "mail_links", "mail_employers", "evaluation_by_class", "thread_states", "thread_events", "repair_plan", "review_plan", "edit_status", "edit_valid_events", "migration_events", "page_postings", "first_seen_customers", "text_messages", "text_job_types", "html_pages"])
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents labels pages conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.queries()[name](spark, SF)
    sql = con.sql((oracle.SQL | oracle_mail.SQL | oracle_upkeep.SQL)[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(sql.columns, sql.fetchall())


def application(thread_id, **given):
    row = dict.fromkeys(tables.APPLICATION_SCHEMA, "") | {"thread_id": thread_id, "company_name": "Acme", "source_platform": "1-URGENT", "application_date": "2026-01-05", "current_status": "Applied", "is_valid": "1"}
    return row | given


def frames(spark, applications, events=(), messages=()):
    raw = {
        "raw_applications": spark.createDataFrame([[a[c] for c in tables.APPLICATION_SCHEMA] for a in applications], ", ".join(f"{c} string" for c in tables.APPLICATION_SCHEMA)),
        "raw_events": spark.createDataFrame([[e.get(c, "") for c in tables.EVENT_SCHEMA] for e in events], ", ".join(f"{c} string" for c in tables.EVENT_SCHEMA)),
        "raw_messages": spark.createDataFrame([list(m) for m in messages], "message_id string, thread_id string, message_date string, subject string, sender string, is_valid string, filter_reason string, detected_status string, confidence string, parsed_by string"),
    }
    return Frames(models.seeds(spark) | {"as_of": AS_OF} | raw)


UNTIDY = [
    application("a", current_status="Screening/OA", application_date="2026-01-05T09:00:00"),
    application("b", current_status=" Response ", is_valid=None, company_name="  "),
    application("c", current_status="Ghosted/Inactive", is_valid="", job_type=" ", last_updated=" "),
    application("d", current_status="Weird Legacy Status", is_valid="maybe", seniority_level=None, industry=""),
    application("e", current_status="Saved", is_valid="1.0"),
    application("f", is_valid="0"),
    application("g", current_status="Saved / Planning"),
    application("h", application_date="soon"),
]


def test_untidy_rows(spark):
    got = {r["application_id"]: r for r in frames(spark, UNTIDY)["stg_applications"].collect()}
    assert {k: r["current_status"] for k, r in got.items()} == {"a": "Assessment / OA", "b": "Assessment / OA", "c": "Ghosted", "d": "Applied", "e": "Applied"}
    assert got["a"]["applied_date"] == date(2026, 1, 5) and got["b"]["company_name"] == "Unknown"
    assert (got["c"]["job_type"], got["c"]["last_activity_date"], got["d"]["seniority"], got["d"]["industry"]) == ("Full-Time", None, "Not Specified", "Other")


def test_messages_and_their_audit(spark):
    rows = [("1", "a", "2026-01-02", "hi", "x", "1", "", "Applied", "0.9", ""), ("2", "a", "", "", "", "0.0", "newsletter", "", "0.5", "llm"), ("3", None, "bad", "s", "x", None, "", "", None, "rules")]
    f = frames(spark, UNTIDY, messages=rows)
    got = {r["message_id"]: r for r in f["stg_messages"].collect()}
    assert [got[i]["is_application_mail"] for i in "123"] == [True, False, False] and got["2"]["message_date"] is None and got["1"]["parsed_by"] == "rules"
    audit = {(r["filter_reason"], r["is_application_mail"], r["parsed_by"]): (r["messages"], r["avg_confidence"], r["low_confidence_messages"]) for r in f["mart_parser_quality"].collect()}
    assert audit == {("(none)", True, "rules"): (1, 0.9, 0), ("newsletter", False, "llm"): (1, 0.5, 1), ("(none)", False, "rules"): (1, None, 0)}


EVENTS = [
    {"event_id": "1", "thread_id": "a", "to_status": "Interview", "occurred_on": "2026-01-10", "source": "gmail"},
    {"event_id": "2", "thread_id": "a", "from_status": "Interview", "to_status": "Rejected", "occurred_on": "2026-01-20", "source": "system"},
    {"event_id": "3", "thread_id": "d", "to_status": "Offer", "occurred_on": "2026-01-05", "source": "legacy"},
    {"event_id": "4", "thread_id": "nobody", "to_status": "Offer", "occurred_on": "2026-01-06", "source": "gmail"},
    {"event_id": "5", "thread_id": "b", "to_status": "Offer", "occurred_on": "never", "source": "gmail"},
]


def test_how_far_and_when(spark):
    f = frames(spark, UNTIDY, EVENTS)
    got = {r["application_id"]: r for r in f["fct_applications"].collect()}
    assert (got["a"]["max_stage_reached"], got["a"]["days_to_response"], got["a"]["event_count"]) == (3, 5, 2)
    assert (got["d"]["max_stage_reached"], got["d"]["is_response"], got["d"]["days_to_response"], got["d"]["has_low_trust_dates"]) == (4, True, None, True)
    assert {r["event_id"] for r in f["fct_status_events"].collect()} == {"1", "2", "3"}


def test_no_rows(spark):
    f = build(frames(spark, []))
    assert f["fct_applications"].count() == 0 and f["dim_date"].count() == 31
    m = Metrics(f, AS_OF)
    kpis = m.query("kpis").first()
    assert kpis["applications"] == 0 and kpis["response_rate_pct"] is None and kpis["response_band"] == "No data"
    for name in m.names():
        m.query(name).collect()
    assert {r["failures"] for r in checks.data_tests(f).collect()} == {0}


def test_data_tests_count_what_is_broken(spark):
    f = build(frames(spark, UNTIDY, EVENTS))
    clean = {r["test"]: r["failures"] for r in checks.data_tests(f).collect()}
    assert len(clean) == 50 and set(clean.values()) == {0}
    facts = f["fct_applications"]
    f["fct_applications"] = facts.unionByName(facts.where("application_id = 'a'").withColumns({"company_key": F.lit("lost"), "is_response": F.lit(False), "days_to_response": F.lit(-1).cast("long"), "platform_key": F.lit(None).cast("string"), "max_stage_reached": F.lit(9)}))
    f["dim_date"] = f["dim_date"].where("date_day <> '2026-01-20'")
    got = {r["test"]: r["failures"] for r in checks.data_tests(f).collect() if r["failures"]}
    assert got == {
        "unique_fct_applications_application_id": 1,
        "related_fct_applications_company_key": 1,
        "not_null_fct_applications_platform_key": 1,
        "accepted_fct_applications_max_stage_reached": 1,
        "no_negative_durations": 1,
        "outcomes_imply_a_response": 1,
        "no_reply_time_without_a_response": 1,
        "calendar_is_contiguous": 1,
    }


def test_published_builds_replace_each_other(spark, tmp_path):
    f = frames(spark, UNTIDY)
    folder = str(tmp_path / "build")
    first = publish(spark, {"apps": f["stg_applications"]}, folder)
    second = publish(spark, {"apps": f["stg_applications"].limit(1)}, folder)
    assert first["at"] < second["at"] and read_published(spark, folder, "apps").count() == 1


def test_the_star_is_built_once_and_anew_when_a_table_changes(spark, tmp_path):
    for t in "orders lineitem customer nation documents labels".split():
        shutil.copy(f"{SF}/{t}.parquet", tmp_path)
    here = str(tmp_path)
    first, again = queries.frames(spark, here), queries.frames(spark, here)
    built = first["fct_applications"].inputFiles()
    assert built == again["fct_applications"].inputFiles() and "star-" in built[0]
    before = queries.queries()["kpis"](spark, here).first()["applications"]
    spark.read.parquet(f"{SF}/orders.parquet").orderBy("o_orderkey").limit(100).coalesce(1).write.parquet(f"{here}/new")
    part = next(Path(f"{here}/new").glob("part-*"))
    shutil.copy(part, f"{here}/orders.parquet")
    assert queries.queries()["kpis"](spark, here).first()["applications"] <= 100 < before
    queries.rebuild(spark, here)
    assert not any(Path(f.removeprefix("file:")).exists() for f in built) and not any(k[1] == here for k in queries.BUILDS)


def test_no_build_is_left_behind(tmp_path):
    script = f"""
from stagewise.session import local_session
from stagewise.plans import queries
spark = local_session(2, 2, "1g")
spark.conf.set("stagewise.checkpoint.dir", {str(tmp_path)!r})
queries.queries()["kpis"](spark, {SF!r}).collect()
"""
    subprocess.run([sys.executable, "-c", script], check=True, cwd=Path(__file__).parent.parent, capture_output=True)
    assert list(tmp_path.iterdir()) == []


def test_running_sums(spark):
    rng = random.Random(6)
    rows = [(i, rng.randrange(5), rng.choice([None, 1, 2, 7])) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, k int, v int").repartition(7)
    got = {r["id"]: (r["total"], r["n"]) for r in running(df, [F.desc("k"), F.col("id")], {"total": F.col("v"), "n": F.lit(1)}).collect()}
    total, wanted = 0, {}
    for n, (i, _, v) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
        total += v or 0
        wanted[i] = (total, n)
    assert got == wanted and running(df.limit(0), [F.col("id")], {"total": F.col("v")}).count() == 0


def test_filters(spark):
    facts = frames(spark, UNTIDY, EVENTS)["fct_applications"]

    def ids(**given):
        return {r["application_id"] for r in Filters(**given).apply(facts).collect()}

    assert ids() == {"a", "b", "c", "d", "e"}
    assert ids(date_from=date(2026, 1, 6)) == set() and ids(platforms=("1-URGENT",)) == ids()
    assert ids(reached=("interview",)) == {"a", "d"} and ids(reached=("ghosted",)) == {"c"}
    assert ids(search="ACME") == {"a", "c", "d", "e"} and ids(search="  ", month=" 2026-01 ") == ids()
    assert ids(reached=("active", "follow_up")) == ids(reached=("follow_up",)) and ids(industries=("Other",), statuses=("Applied",)) == {"d", "e"}
    with pytest.raises(ValueError):
        ids(reached=("nothing",))
    f = Filters.preset("30d", AS_OF)
    assert (f.date_from, f.date_to) == (date(2026, 1, 2), AS_OF) and Filters.from_dict(f.to_dict()) == f


def test_an_unknown_model_is_an_error(spark):
    with pytest.raises(KeyError):
        frames(spark, UNTIDY)["fct_nothing"]


def test_readers(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,body_text\n1,private\n")
    (tmp_path / "x.jsonl").write_text('{"a": 1, "b": "x"}\n')
    df = tables.read_csv(spark, str(tmp_path / "x.csv"), "a int, body_text string")
    assert tables.as_text(df).schema.simpleString() == "struct<a:string>" and tables.as_text(df).first()["a"] == "1"
    assert tables.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int, b string").first().asDict() == {"a": 1, "b": "x"}
    seen = spark.createDataFrame([("2026-01-10",), (None,)], "seen string").select(tables.after_date("2026-01-01", "seen").alias("d"))
    assert [r["d"] for r in seen.collect()] == [date(2026, 1, 8), date(2026, 1, 1)]


def test_store_rules_by_hand(spark):
    f = frames(spark, [application("a", last_updated="2026-01-01"), application("b", last_updated="2026-01-09"), application("c", last_updated=""), application("d", last_updated="2026-01-10", is_valid="0")], EVENTS[:2])
    after, events = store.ghosted(f["raw_applications"], AS_OF)
    assert {r["thread_id"]: r["current_status"] for r in after.collect()} == {"a": "Ghosted", "b": "Ghosted", "c": "Applied", "d": "Applied"}
    assert sorted((r["thread_id"], r["occurred_on"]) for r in events.collect()) == [("a", "2026-01-22"), ("b", "2026-01-30")]
    threads = f["raw_applications"].select("thread_id")
    undone, left = store.undone(f["raw_applications"], f["raw_events"], threads)
    assert {r["thread_id"]: (r["current_status"], r["last_updated"]) for r in undone.collect()}["a"] == ("Interview", "2026-01-10")
    assert [r["event_id"] for r in left.collect()] == ["1"]
    again, still = store.undone(undone, left, threads)
    assert still.count() == 1 and {r["current_status"] for r in again.where("thread_id = 'a'").collect()} == {"Interview"}
    spent = store.monthly_spend(spark.createDataFrame([("2026-01-02", 5, 1, 0.5), ("2026-01-30", 5, 1, 0.25), ("2026-02-01", 1, 1, 1.0)], "created_at string, input_tokens long, output_tokens long, cost_usd double"))
    assert {r["month"]: (r["calls"], r["cost_usd"]) for r in spent.collect()} == {"2026-01": (2, 0.75), "2026-02": (1, 1.0)}


def test_text_by_hand(spark):
    body = "Thanks, we got it: https://x.example/a?b=1\n\t> old line\nBye &amp; good luck\n--\nSignature\nOn Monday, Ann wrote:\nold text"
    df = spark.createDataFrame([(body, "<style>x</style><p>a &lt; b&nbsp;&middot;</p>\n<b>c</b>"), (None, None), ("Unsubscribe\nhello\nALL RIGHTS RESERVED x", "")], "body string, html string")
    got = df.select(text.sanitized("body").alias("b"), text.stripped_html("html").alias("h"), text.labelled("body", [("Old", "old"), ("Luck", "luck")], "None").alias("l")).collect()
    assert [tuple(r) for r in got] == [("Thanks, we got it: Bye & good luck", "a < b \u00b7 c", "Old"), ("", "", "None"), ("Unsubscribe hello", "", "None")]


def test_links_without_what_follows_readers(spark):
    links = {"https://shop.example/x?utm_medium=m&id=7": "https://shop.example/x?id=7", "http://h/p?id=5&REF=z&e=1#top": "http://h/p?id=5&e=1#top", "http://h/p?gclid=1": "http://h/p", "http://h/p?email_=a&mc_eid=2&q=emails": "http://h/p?q=emails", "http://h/p": "http://h/p"}
    df = spark.createDataFrame([(u,) for u in [*links, None]], "url string")
    assert [r[0] for r in df.select(text.without_parameters("url")).collect()] == [*links.values(), ""]
    assert [r[0] for r in df.select(text.host("url")).collect()] == ["shop.example", *["h"] * 4, None]


def test_character_references_as_in_browsers(spark):
    rng, names = random.Random(1), list(html.entities.html5)
    made = ["&notit; &not &NotEqualTilde; &#39;&#x27;&#0;&#x80;&#150;&#xD800;&#99999999;&#x1F600;&#1;&#xFFFF;&#13;", "& &; &# &#x; &&amp;&amp", "&#" + "0" * 30 + "65;", "&#" + "9" * 40 + ";", "&" + "a" * 50 + ";", ""]
    made += ["".join(rng.choice(["&", rng.choice(names), ";", "x", " ", f"&#{rng.randrange(70_000)};", f"&#x{rng.randrange(300):x}", "&" + rng.choice(names)]) for _ in range(8)) for _ in range(200)]
    got = spark.createDataFrame([(t,) for t in made], "t string").select(text.unescaped(F.col("t")).alias("u")).collect()
    assert [r["u"] for r in got] == [html.unescape(t) for t in made]


@pytest.mark.parametrize("rules,default", [(text.JOB_TYPES, text.JOB_TYPE), (text.SENIORITIES, text.SENIORITY), (text.INDUSTRIES, text.OTHER), (text.ROLE_FAMILIES, text.OTHER)])
def test_labels_by_the_first_rule(spark, rules, default):
    says = {"Summer intern, data": ("Internship", "Internship", "Tech & Digital", "Data & Analytics"), "Graduate trainee role": ("Graduate Programme / Trainee", "Graduate / Entry", "Other", "Other"), "Senior credit risk analyst, 6-months": ("Contract / Fixed-Term", "Senior / Lead", "Banking & Finance", "Risk & Quantitative"), "Nothing": ("Full-Time", "Not Specified", "Other", "Other")}
    at = (text.JOB_TYPES, text.SENIORITIES, text.INDUSTRIES, text.ROLE_FAMILIES).index(rules)
    got = spark.createDataFrame([(t,) for t in says], "t string").select(text.labelled("t", rules, default)).collect()
    assert [r[0] for r in got] == [x[at] for x in says.values()]


def one_by_one(rows):
    """The state and the events of threads, message by message."""
    state, events = {}, []
    for thread, i, day, valid, said, subject, confidence in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if thread not in state:
            s = state[thread] = {"is_valid": valid, "current_status": said or "Applied", "application_date": day, "last_updated": day, "latest_subject": subject, "parse_confidence": confidence, "messages": 1}
            if valid:
                events.append((thread, i, None, "Applied", day))
                if s["current_status"] != "Applied":
                    events.append((thread, i, "Applied", s["current_status"], day))
            continue
        s = state[thread]
        became = valid and not s["is_valid"]
        if became:
            events.append((thread, i, None, "Applied", s["application_date"]))
        moves = valid and said and said not in (s["current_status"], "Applied")
        if moves:
            events.append((thread, i, s["current_status"], said, day))
            s["current_status"] = said
        if moves or became:
            s["last_updated"] = day
        s |= {"is_valid": s["is_valid"] or valid, "latest_subject": subject, "parse_confidence": max(s["parse_confidence"], confidence), "messages": s["messages"] + 1}
    return state, events


def test_merging_at_once_is_merging_one_by_one(spark):
    rng = random.Random(3)
    rows = [(f"t{rng.randrange(25)}", f"m{i:03d}", f"2026-01-{rng.randrange(1, 20):02d}", rng.random() < 0.6, rng.choice([None, "Applied", "Interview", "Rejected", "Assessment / OA"]), f"s{i}", round(rng.random(), 2)) for i in range(200)]
    messages = spark.createDataFrame(rows, "thread_id string, message_id string, day string, is_valid boolean, detected_status string, subject string, confidence double")
    state, events = one_by_one(rows)
    assert {r["thread_id"]: {k: r[k] for k in state[r["thread_id"]]} for r in merge.threads(messages).collect()} == state
    got = [(r["thread_id"], r["message_id"], r["from_status"], r["to_status"], r["occurred_on"]) for r in merge.status_events(messages).collect()]
    assert sorted(got, key=repr) == sorted(events, key=repr)
    assert merge.threads(messages.limit(0)).count() == 0


VERDICTS = [
    ("x@a.example", "Your verification code", "", "blocked (one-time code)", False, 0.97),
    ("x@news.example", "We have received your application", "", "blocked sender (news)", False, 0.95),
    ("x@a.example", "Hello", "We have received your application. Join our webinar", "vetoed (webinar)", False, 0.8),
    ("x@a.example", "Hello", "We regret to inform you", "strong (declined)", True, 0.95),
    ("x@a.example", "Top jobs", "We have received your application", "strong (received)", True, 0.95),
    ("x@a.example", "About your application", "", "weak (application)", True, 0.85),
    ("x@a.example", "Top jobs", "your application", "noisy (job alert)", False, 0.55),
    ("tests@assess.example", "Your challenge", "", "vendor (test)", True, 0.8),
    ("x@ats.example", "Clerk at Jati Bank", None, "loose (platform)", True, 0.65),
    ("x@board.example", "Clerk at Jati Bank", "Apply now", "garbage (board advert)", False, 0.85),
    ("x@ats.example", "Hello", "", "near miss (platform)", False, 0.55),
    ("x@a.example", "Hello", "a vacancy", "near miss (vocabulary)", False, 0.55),
    ("Jane Tan <jane@a.example>", "Next steps", "", "near miss (person)", False, 0.55),
    (None, None, None, "nothing (no rule)", False, 0.85),
]


def test_the_first_tier_that_decides_gives_the_verdict(spark):
    df = spark.createDataFrame([(i, *v[:3]) for i, v in enumerate(VERDICTS)], "i int, sender string, subject string, snippet string")
    got = {r["i"]: r["verdict"] for r in verdicts.judged(df).collect()}
    assert [(got[i]["reason"], got[i]["is_valid"], got[i]["confidence"]) for i in range(len(VERDICTS))] == [v[3:] for v in VERDICTS]
    assert all(got[i]["reason"].startswith(got[i]["tier"]) for i in got)


def plain_status(text):
    """The status of a text by a plain walk over its sentences."""
    words, sentences, now = re.split(r"(\s+)", (text or "").lower()), [], ""
    for word in words:
        if word.isspace() and re.search(r"[.!?]$", now) and not re.search(rf"\b(?:{'|'.join(verdicts.ABBREVIATIONS)})\.$", now):
            sentences.append(now)
            now = ""
        else:
            now += word
    said = " ".join(s for s in [*sentences, now] if not any(re.search(p, s) for p in verdicts.CONDITIONAL))
    said = re.sub(verdicts.RECORDED, "video assessment", said)
    found = [s for s, patterns in verdicts.STATUSES if any(re.search(p, said) for p in patterns)]
    return max(found, key=RANK.get, default=None)


def test_statuses_against_a_plain_walk(spark):
    rng = random.Random(12)
    says = [t for texts in mail.SAYS.values() for t in texts] + ["If you do not hear from us, you were unsuccessful.", "Ask Jati Sdn. Bhd. or Co. for more.", "Only shortlisted candidates meet our hiring manager!", "Well?", "An on-demand video interview waits. Hurry."]
    made = [" ".join(rng.choice(says) for _ in range(rng.randrange(0, 4))) for _ in range(400)] + [None, "", "Your application to Jati Sdn. Bhd. was received"]
    got = spark.createDataFrame([(t,) for t in made], "t string").select(verdicts.detected("t")).collect()
    assert [r[0] for r in got] == [plain_status(t) for t in made]
    assert len({r[0] for r in got}) == 6
    pairs = spark.createDataFrame([("Offer", "Rejected"), ("Rejected", "Offer"), (None, "Applied"), ("Applied", None), ("Offer", "Offer"), (None, None)], "b string, s string")
    assert [r[0] for r in pairs.select(verdicts.stronger(F.col("b"), F.col("s"))).collect()] == ["Rejected", "Rejected", "Applied", "Applied", "Offer", None]


def test_scores_against_a_plain_count(spark):
    rng, classes = random.Random(2), ["Applied", "Offer", "Rejected"]
    rows = [(rng.choice(["dev", "holdout"]), rng.sample(["x", "y", "z"], rng.randrange(0, 3)), e, rng.choice([e, e, *classes, evaluation.MISSED if e in classes else evaluation.NONE])) for e in (rng.choice([*classes, evaluation.NONE]) for _ in range(300))]
    cells = evaluation.confusion(spark.createDataFrame(rows, "split string, tags array<string>, expected string, predicted string"))
    groups = {("all", "all"): rows} | {("split", s): [r for r in rows if r[0] == s] for s in ("dev", "holdout")} | {("tag", t): [r for r in rows if t in r[1]] for t in "xyz"}
    got = {(r["dimension"], r["value"], r["class"]): (r["support"], r["predicted"], r["correct"]) for r in evaluation.scores(cells).collect()}
    for group, some in groups.items():
        for c in classes:
            assert got[(*group, c)] == (sum(r[2] == c for r in some), sum(r[3] == c for r in some), sum(r[2] == r[3] == c for r in some))
        assert got[(*group, evaluation.ANY)] == (sum(r[2] in classes for r in some), sum(r[3] in classes for r in some), sum(r[2] in classes and r[3] in classes for r in some))
    g = evaluation.gate(cells).first()
    assert (g["tp"], g["fp"], g["fn"]) == tuple(sum((r[2] in classes) == a and (r[3] in classes) == b for r in rows) for a, b in ((True, True), (False, True), (True, False)))
    assert not g["passes"] and not evaluation.gate(cells.limit(0)).first()["passes"]


def test_drill_sets_hold_what_their_conditions_say(spark):
    """Sets of applications by their filters are those of the fact's own columns; flows keep all applications; waiting never grows."""
    facts = queries.frames(spark, SF)["fct_applications"]
    rows = facts.collect()
    sets = {
        "response": lambda r: r["is_response"], "no_response": lambda r: not r["is_response"], "interview": lambda r: r["reached_interview"], "offer": lambda r: r["max_stage_reached"] >= 4, "ghosted": lambda r: r["current_status"] == "Ghosted",
        "awaiting": lambda r: r["is_active"] and r["max_stage_reached"] == 1, "in_progress": lambda r: r["is_active"] and r["max_stage_reached"] >= 2, "dated_reply": lambda r: r["days_to_response"] is not None,
    }
    for name, holds in sets.items():
        assert {r["application_id"] for r in Filters(reached=(name,)).apply(facts).collect()} == {r["application_id"] for r in rows if holds(r)}, name
    m = Metrics(queries.frames(spark, SF), queries.AS_OF)
    waiting = [r["still_waiting_pct"] for r in m.query("response_survival").orderBy("day").collect()]
    assert waiting == sorted(waiting, reverse=True) and 0 <= waiting[-1] <= waiting[0] <= 100
    funnel = [r["applications"] for r in m.query("funnel").orderBy("stage_order").collect()]
    assert funnel[0] == len(rows) and funnel[2:] == sorted(funnel[2:], reverse=True)
    flows = [tuple(r) for r in m.query("sankey").collect()]
    names = m.query("sankey").columns
    source, target, n = (names.index(c) for c in ("source", "target", "applications"))
    assert sum(f[n] for f in flows if f[source] == "Applied") == len(rows)
    for stage in ("Assessment", "Interview"):
        assert sum(f[n] for f in flows if f[target] == stage) >= sum(f[n] for f in flows if f[source] == stage)
