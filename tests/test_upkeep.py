"""Edits, migration, repair and review against rows written by hand and plain loops."""

import random

import pytest

from stagewise.operators import edits, review, upkeep
from stagewise.sources.tables import APPLICATION_SCHEMA

APPLICATIONS = ", ".join(f"{c} string" for c in APPLICATION_SCHEMA)
EVENTS = ", ".join(f"{c} string" for c in upkeep.EVENT_COLUMNS)


@pytest.fixture(scope="module")
def apps(spark):
    def made(*rows):
        base = dict.fromkeys(APPLICATION_SCHEMA, "") | {"application_date": "2026-01-01", "last_updated": "2026-01-05", "current_status": "Applied", "is_valid": "1"}
        return spark.createDataFrame([tuple((base | r)[c] for c in APPLICATION_SCHEMA) for r in rows], APPLICATIONS)

    return made


def by_thread(df, *columns):
    return {r["thread_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_statuses_set_by_hand(spark, apps):
    a = apps({"thread_id": "a"}, {"thread_id": "b", "current_status": "Saved / Planning"}, {"thread_id": "c"}, {"thread_id": "d"})
    given = spark.createDataFrame([("a", "Offer", "2026-02-01T09:00", None), ("b", "Applied", "2026-02-02", "x"), ("c", "Applied", "2026-02-03", ""), ("z", "Offer", "2026-02-03", "")], "thread_id string, status string, day string, note string")
    after, events = edits.set_status(a, given)
    assert by_thread(after, "current_status", "last_updated", "application_date") == {"a": ("Offer", "2026-02-01", "2026-01-01"), "b": ("Applied", "2026-02-02", "2026-02-02"), "c": ("Applied", "2026-01-05", "2026-01-01"), "d": ("Applied", "2026-01-05", "2026-01-01")}
    assert by_thread(events, "from_status", "to_status", "occurred_on", "note") == {"a": ("Applied", "Offer", "2026-02-01", ""), "b": ("Saved / Planning", "Applied", "2026-02-02", "x")}
    assert after.columns == a.columns


def test_verdicts_fields_and_reminders_by_hand(spark, apps):
    a = apps({"thread_id": "a", "is_valid": "0", "notes": " old "}, {"thread_id": "b"}, {"thread_id": "c", "role_title": "Clerk", "role_family": "Other"})
    events = spark.createDataFrame([("1", "b", "", "Applied", "2026-01-01", "gmail", "")], EVENTS)
    verdicts = spark.createDataFrame([("a", True, None), ("b", False, "spam")], "thread_id string, valid boolean, reason string")
    after, new = edits.set_valid(a, events, verdicts)
    assert by_thread(after, "is_valid", "filter_reason") == {"a": ("1", "manual recovery"), "b": ("0", "manual: spam"), "c": ("1", "")} and by_thread(new, "to_status", "occurred_on") == {"a": ("Applied", "2026-01-01")}
    fields = edits.update_fields(a, spark.createDataFrame([("c", "  Risk Engineer ", None)], "thread_id string, role_title string, location string"))
    assert by_thread(fields, "role_title", "role_family", "location")["c"] == ("Risk Engineer", "Risk & Quantitative", "")
    with pytest.raises(ValueError, match="origin"):
        edits.update_fields(a, spark.createDataFrame([("c", "x")], "thread_id string, origin string"))
    notes = edits.followed_up(a, spark.createDataFrame([("a", "2026-02-01", "called"), ("b", "2026-02-02", " ")], "thread_id string, day string, note string"))
    assert by_thread(notes, "notes", "last_updated") == {"a": ("old\n[2026-02-01] Followed up: called", "2026-02-01"), "b": ("[2026-02-02] Followed up", "2026-02-02"), "c": ("", "2026-01-05")}


def test_entries_by_hand_and_deletion(spark, apps):
    entry = ("Acme Bank", " Intern ", None, "2026-03-01", "Offer")
    new = spark.createDataFrame([entry, entry, ("", "Clerk", "Fair", "2026-03-02", "Saved / Planning")], "company string, role string, platform string, day string, status string")
    after, events = edits.added(apps({"thread_id": "a"}), new)
    rows = {r["role_title"]: r for r in after.where("origin = 'manual'").collect()}
    assert (rows["Intern"]["company_name"], rows["Intern"]["job_type"], rows["Intern"]["industry"], rows["Intern"]["source_platform"]) == ("Acme Bank", "Internship", "Banking & Finance", "Other") and rows["Clerk"]["company_name"] == "Unknown"
    assert [(r["from_status"], r["to_status"]) for r in events.orderBy("to_status").collect()] == [(None, "Applied"), ("Applied", "Offer")]
    assert edits.added(after, new)[0].count() == after.count() == 3
    left, _ = edits.deleted(after, events.selectExpr("'1' AS event_id", "*"), spark.createDataFrame([("a",)], "thread_id string"))
    assert left.count() == 2


def test_migration_twice_is_migration_once(spark, apps):
    a = apps({"thread_id": "a", "current_status": "Screening/OA"}, {"thread_id": "manual:b", "role_title": "Data Clerk"}, {"thread_id": "c", "current_status": "Saved / Planning"}, {"thread_id": "d", "current_status": "Offer"}, {"thread_id": "e", "current_status": "Offer", "last_updated": "2026-02-02T01:00"})
    events = spark.createDataFrame([("1", "d", "Applied", "Offer", "2026-01-09", "gmail", "")], EVENTS)
    history = spark.createDataFrame([("e", "", "Applied", "2026-01-03T10:00", None), ("e", "", "Applied", "2026-01-03T10:00", None), ("e", "Applied", "", "2026-01-04", "")], "thread_id string, from_status string, to_status string, changed_at string, note string")
    once, log = upkeep.migrated(a, events, history)
    assert by_thread(once, "current_status", "role_family", "origin")["a"] == ("Assessment / OA", "Other", "") and by_thread(once, "role_family", "origin")["manual:b"] == ("Data & Analytics", "manual")
    got = sorted(((r["thread_id"], r["from_status"], r["to_status"], r["occurred_on"], r["source"]) for r in log.collect()), key=repr)
    assert got == sorted([("d", "Applied", "Offer", "2026-01-09", "gmail"), ("e", None, "Applied", "2026-01-03", "legacy"), ("a", None, "Applied", "2026-01-01", "inferred"), ("manual:b", None, "Applied", "2026-01-01", "inferred"), ("d", None, "Applied", "2026-01-01", "inferred"), ("a", "Applied", "Assessment / OA", "2026-01-05", "inferred"), ("e", "Applied", "Offer", "2026-02-02", "inferred")], key=repr)
    twice, log2 = upkeep.migrated(once, log, history)
    assert twice.exceptAll(once).count() == 0 and log2.count() == log.count() and log2.exceptAll(log).count() == 0


def test_a_plan_applied_gives_what_was_recomputed(spark):
    schema = "id long, ok boolean, status string, n int"
    rng = random.Random(3)
    old = [(i, rng.choice([True, False, None]), rng.choice(["a", "b", None]), rng.choice([1, 2, None])) for i in range(60)]
    new = [(i, rng.choice([True, False, None]), rng.choice(["a", "b", None]), rng.choice([1, 2, None])) for i in range(10, 70)]
    stored, recomputed = spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)
    plan = upkeep.repair_plan(stored, recomputed, "id", ["ok", "status", "n"])
    text = {True: "true", False: "false"}
    after = {r[0]: r for r in new}
    wanted = {(r[0], c, text.get(r[k], r[k]) if c == "ok" else r[k] and str(r[k]), text.get(after[r[0]][k], after[r[0]][k]) if c == "ok" else after[r[0]][k] and str(after[r[0]][k])) for r in old if r[0] in after for k, c in ((1, "ok"), (2, "status"), (3, "n")) if r[k] != after[r[0]][k]}
    assert {(r["id"], r["column"], r["old"], r["new"]) for r in plan.collect()} == wanted
    assert {tuple(r) for r in upkeep.repaired(stored, plan, "id").collect()} == {after.get(r[0], r) for r in old}
    assert upkeep.repair_plan(upkeep.repaired(stored, plan, "id"), recomputed, "id", ["ok", "status", "n"]).count() == 0
    changed = stored.selectExpr("id", "ok", "'z' AS status", "n")  # what changed since the plan was made stays
    assert {r["status"] for r in upkeep.repaired(changed, plan.where("column = 'status'"), "id").collect()} == {"z"}


def test_the_budget_is_cut_as_one_by_one(spark):
    rng = random.Random(8)
    rows = [(f"m{i:03d}", f"2026-0{rng.randrange(1, 4)}", f"2026-01-{rng.randrange(1, 29):02d}", rng.choice([0, 5, 40, 100])) for i in range(150)]
    known, spent, budget, cap = {f"m{i:03d}" for i in range(0, 150, 4)}, {"2026-01": 300, "2026-03": 5000}, 1500, 60
    wanted, left, asked = {}, {m: budget - spent.get(m, 0) for m in ("2026-01", "2026-02", "2026-03")}, []
    for i, month, arrived, cost in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if i in known:
            wanted[i] = "cached"
            continue
        wanted[i] = "ask" if left[month] > 0 else "over budget"
        left[month] -= cost
        asked += [(arrived, i)] * (wanted[i] == "ask")
    for _, i in sorted(asked)[cap:]:
        wanted[i] = "over cap"
    df = spark.createDataFrame(rows, "message_id string, month string, arrived string, cost long").repartition(5)
    got = review.planned(df, spark.createDataFrame([(k,) for k in known], "message_id string"), spark.createDataFrame(list(spent.items()), "month string, cost long"), budget, cap).collect()
    assert {r["message_id"]: r["plan"] for r in got} == wanted and set(wanted.values()) == {"cached", "ask", "over budget", "over cap"}
    messages = spark.createDataFrame([("1", False, None, 0.5, "rules"), ("2", True, "Offer", 0.5, "rules"), ("3", True, None, 0.5, "rules")], "message_id string, is_valid boolean, detected_status string, confidence double, parsed_by string")
    readings = spark.createDataFrame([("1", True, "Interview", 0.9), ("2", False, None, 0.59), ("3", False, "Offer", 0.6)], "message_id string, is_event boolean, status string, sureness double")
    assert sorted(tuple(r) for r in review.corrected(messages, readings).collect()) == [("1", True, "Interview", 0.9, "llm"), ("2", True, "Offer", 0.5, "rules"), ("3", False, None, 0.6, "llm")]
