"""The fold of messages into threads: its rules by hand, and batch against stream."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from stagewise.operators import fold

NAMES = fold.fields(fold.MESSAGE)


def message(message_id, arrived, said=None, thread="t", **given):
    row = dict.fromkeys(NAMES, "") | {"thread_id": thread, "message_id": message_id, "kind": "mail", "arrived": arrived, "day": arrived, "is_valid": True, "detected_status": said, "confidence": 0.5, "parsed_by": "rules"}
    return tuple((row | given)[n] for n in NAMES)


@pytest.fixture(scope="module")
def run(spark):
    def folded(*rows, as_of=None):
        out = fold.folded(spark.createDataFrame(list(rows), fold.MESSAGE), as_of).collect()
        return {r["thread_id"]: r for r in out if r["what"] == "state"}, [(r["from_status"], r["to_status"], r["occurred_on"], r["source"]) for r in out if r["what"] == "event"]

    return folded


def test_a_reply_moves_the_status_and_thanks_never_move_it_back(run):
    state, events = run(message("1", "2026-01-01"), message("2", "2026-01-05", "Interview"), message("3", "2026-01-06", "Applied"), message("4", "2026-01-07", "Rejected", is_valid=False))
    assert state["t"]["status"] == "Interview" and state["t"]["last_updated"] == "2026-01-05" and state["t"]["messages"] == 4
    assert events == [(None, "Applied", "2026-01-01", "gmail"), ("Applied", "Interview", "2026-01-05", "gmail")]


def test_older_evidence_that_comes_late_changes_no_status_but_the_first_day(run):
    state, events = run(message("1", "2026-01-10", "Interview"), message("2", "2026-01-12", "Assessment / OA", day="2026-01-02"))
    assert (state["t"]["status"], state["t"]["application_date"], len(events)) == ("Interview", "2026-01-02", 2)


def test_silence_ghosts_and_a_new_message_revives(run):
    state, events = run(message("1", "2026-01-01"), message("2", "2026-03-01"), message("3", "2026-03-02", "Offer", parsed_by="llm"), as_of=date(2026, 12, 1))
    assert events == [(None, "Applied", "2026-01-01", "gmail"), ("Applied", "Ghosted", "2026-01-22", "system"), ("Ghosted", "Applied", "2026-03-01", "gmail"), ("Applied", "Offer", "2026-03-02", "llm")]
    assert state["t"]["status"] == "Offer"
    state, events = run(message("1", "2026-01-01"), as_of=date(2026, 1, 22))
    assert state["t"]["status"] == "Applied"  # due on the day after
    state, events = run(message("1", "2026-01-01"), message("2", "2026-02-20", day="2026-01-20"), as_of=date(2026, 2, 21))
    assert state["t"]["status"] == "Ghosted"  # older than the ghosting


def test_verdicts_by_hand_stay(run):
    rows = [message("1", "2026-01-01"), message("h", "2026-01-02", kind="verdict", is_valid=False, reason="spam"), message("2", "2026-01-03", "Interview")]
    state, _ = run(*rows)
    assert (state["t"]["is_valid"], state["t"]["state_reason"], state["t"]["status"]) == (False, "manual: spam", "Interview")
    state, events = run(message("1", "2026-01-01", is_valid=False), message("h", "2026-01-02", kind="verdict"), message("2", "2026-01-03", is_valid=False, reason="x"))
    assert (state["t"]["is_valid"], state["t"]["state_reason"]) == (True, "manual: verdict") and events == [(None, "Applied", "2026-01-01", "manual")]
    assert run(message("h", "2026-01-02", kind="verdict")) == ({}, [])


def test_one_valid_message_makes_a_thread_valid(run):
    state, events = run(message("1", "2026-01-01", is_valid=False, reason="noise"), message("2", "2026-01-03", "Interview", reason="ok"), message("3", "2026-01-04", is_valid=False, reason="noise"))
    assert (state["t"]["is_valid"], state["t"]["state_reason"]) == (True, "ok")
    assert events == [(None, "Applied", "2026-01-01", "gmail"), ("Applied", "Interview", "2026-01-03", "gmail")]


def test_identity_only_improves_and_labels_are_the_last(run):
    rows = [
        message("1", "2026-01-01", employer="Board", role="hello", platform="", job_url="", job_type="Full-Time", excerpt="a"),
        message("2", "2026-01-02", employer="Acme", role="Data Analyst", platform="ATS", job_url="u", job_type="", confidence=0.9),
        message("3", "2026-01-03", employer="Zed", role="Clerk", platform="Board", job_url="v", job_type="Internship", excerpt="b"),
    ]
    t = run(*rows)[0]["t"]
    assert (t["employer"], t["role"], t["platform"], t["job_url"], t["job_type"], t["excerpt"], t["confidence"], t["last_updated"]) == ("Acme", "Data Analyst", "ATS", "u", "Internship", "a", 0.9, "2026-01-02")


def test_awkward_messages(run, spark):
    state, events = run(message("1", "2026-01-01", day=None, subject=None, employer=None, role=None, confidence=None, is_valid=None), message("2", None), message("3", "2026-01-01", thread=None))
    assert list(state) == ["t"] and state["t"]["application_date"] == "2026-01-01" and events == []
    assert fold.folded(spark.createDataFrame([], fold.MESSAGE)).count() == 0


def some_messages(n, seed):
    rng, out = random.Random(seed), []
    for i in range(n):
        day = date(2026, 1, 1).toordinal() + rng.randrange(160)
        arrived = date.fromordinal(day + rng.choice([0, 0, 0, 5, 30])).isoformat()
        given = {"kind": "verdict"} if rng.random() < 0.06 else {"employer": rng.choice(["Unknown", "Board", "Acme"]), "role": rng.choice(["", "hello", "Clerk"]), "platform": rng.choice(["Other", "ATS"]), "job_url": rng.choice(["", "u", "v"])}
        out.append(message(f"m{i:03d}", arrived, rng.choice([None, "Applied", "Interview", "Rejected", "Offer"]), f"t{rng.randrange(30)}", day=date.fromordinal(day).isoformat(), is_valid=rng.random() < 0.6, subject=f"s{i}", confidence=round(rng.random(), 2), parsed_by=rng.choice(["rules", "llm"]), **given))
    return sorted(out, key=lambda r: (r[3], r[1]))


def test_a_stream_folds_as_the_batch_does(spark, tmp_path):
    rows = some_messages(200, 3)
    batch = fold.folded(spark.createDataFrame(rows, fold.MESSAGE), date(2026, 12, 1)).collect()
    ends = [[message("z", "2026-12-01", thread="zz")], [message("z2", "2026-12-02", thread="zz")]]  # move the watermark past all that is due
    for part in [rows[i : i + 70] for i in range(0, 200, 70)] + ends:
        spark.createDataFrame(part, fold.MESSAGE).withColumn("ts", F.to_timestamp("arrived")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(f"{fold.MESSAGE}, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        fold.fold_stream(stream).writeStream.format("memory").queryName("threads").outputMode("append").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = [r for r in spark.table("threads").collect() if r["thread_id"] != "zz"]
    event = fold.fields(fold.EVENT)

    def events(out):
        return sorted([(r["thread_id"], *(r[n] for n in event)) for r in out if r["what"] == "event"], key=repr)

    assert events(got) == events(batch)
    assert any(e[1] == "Ghosted" for e in events(batch))  # some revive after their time-out: their state has outlived it
    state = [n for n in got[0].asDict() if n not in event]
    last = {r["thread_id"]: tuple(r[n] for n in state) for r in got if r["what"] == "state"}  # a later row replaces an earlier one
    assert last == {r["thread_id"]: tuple(r[n] for n in state) for r in batch if r["what"] == "state"}
