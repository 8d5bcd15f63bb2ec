"""Messages folded into the state of their threads, in the order in which they arrive: in batch and as a stream, by the same step.

The order matters: what a message does depends on all before it, so a thread is read one message at a time, and only its
state is held. In batch, threads are dealt out and sorted by Spark and read through once; in a stream the state lies in
Spark's state store and outlives the time after which a silent thread counts as ghosted.

- A thread is valid once one of its messages is; a verdict by hand stays, whatever comes later, until the next by hand.
- The employer, the role and the platform only improve: a placeholder gives way to a name, a text that is no role to a role.
- Only valid messages move the status, to what they say, if they are no older than the latest event, and never back to Applied.
- A thread without news for `after` days is ghosted on the day on which that was due; a newer valid message revives it.
- Labels are those of the last message that has any; links and excerpts those of the first; the confidence is the greatest.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, datetime, timedelta, timezone
from functools import partial
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..domain import GHOST_AFTER

#: What a message brings. kind: mail, or verdict for a judgement by hand. Days are texts, year first.
MESSAGE = (
    "thread_id string, message_id string, kind string, arrived string, day string, is_valid boolean, reason string, detected_status string, employer string, role string, "
    "platform string, job_url string, excerpt string, subject string, job_type string, seniority string, industry string, confidence double, parsed_by string"
)
STATE = (
    "is_valid boolean, reason string, employer string, role string, platform string, status string, application_date string, last_updated string, subject string, job_url string, "
    "excerpt string, job_type string, seniority string, industry string, confidence double, last_event string, events long, messages long"
)
EVENT = "from_status string, to_status string, occurred_on string, source string, message_id string, note string"
OUT = f"thread_id string, what string, {STATE.replace('reason', 'state_reason').replace('subject', 'state_subject')}, {EVENT}"
#: Names that stand for an employer that is not known yet.
PLACEHOLDERS = ("", "Unknown", "Board", "ATS")
ROLE_WORDS = ("analyst", "clerk", "engineer", "planner", "associate", "officer", "developer")
NOTE = 160

Row = dict[str, Any]


def fields(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def is_role(text: str) -> bool:
    return any(w in ROLE_WORDS for w in text.lower().split())


def later(day: str, days: int) -> str:
    return (date.fromisoformat(day) + timedelta(days=days)).isoformat()


def logged(state: Row, before: str | None, after: str, day: str, source: str, message: str, note: str) -> Row:
    """An event, which the state remembers."""
    state["events"] += 1
    state["last_event"] = max(state["last_event"] or day, day)
    return {"from_status": before, "to_status": after, "occurred_on": day, "source": source, "message_id": message, "note": note[:NOTE]}


def ghosting(state: Row | None, today: str, after: int | None) -> list[Row]:
    """A thread that was due before today becomes Ghosted, on the day it was due; when it was last updated stays."""
    if state is None or after is None or not state["is_valid"] or state["status"] != "Applied" or later(state["last_updated"], after) >= today:
        return []
    state["status"] = "Ghosted"
    return [logged(state, "Applied", "Ghosted", later(state["last_updated"], after), "system", "", f"no reply for {after}+ days")]


def opened(m: Row) -> tuple[Row, list[Row]]:
    """The state and the events of a thread's first message."""
    status = m["detected_status"] or "Applied"
    kept = ("reason", "employer", "role", "platform", "subject", "job_url", "excerpt", "job_type", "seniority", "industry")
    state = {n: m[n] or "" for n in kept} | {"is_valid": bool(m["is_valid"]), "status": status, "application_date": m["day"], "last_updated": m["day"], "confidence": m["confidence"] or 0.0, "last_event": None, "events": 0, "messages": 1}
    out = []
    if state["is_valid"]:
        out.append(logged(state, None, "Applied", m["day"], "gmail", m["message_id"], "first email in thread"))
        if status != "Applied":
            out.append(logged(state, "Applied", status, m["day"], "llm" if m["parsed_by"] == "llm" else "gmail", m["message_id"], m["subject"] or ""))
    return state, out


def by_hand(state: Row, m: Row) -> list[Row]:
    """A verdict by hand; a thread that it recovers gets its opening event."""
    state["is_valid"], state["reason"] = bool(m["is_valid"]), f"manual: {m['reason'] or 'verdict'}"
    if state["is_valid"] and not state["events"]:
        return [logged(state, None, "Applied", state["application_date"], "manual", m["message_id"], "recovered from the noise filter")]
    return []


def moved(state: Row, m: Row) -> str:
    """The status after a message."""
    now, said, latest = state["status"], m["detected_status"], state["last_event"] or ""
    if not m["is_valid"]:
        return now
    if said and said != now and m["day"] >= latest:
        return now if said == "Applied" and now not in ("Ghosted", "Saved / Planning") else said
    return said or "Applied" if now == "Ghosted" and m["day"] > latest else now


def merged(state: Row, m: Row) -> list[Row]:
    """Let a further message change the state; the events that come of it."""
    valid, before = bool(m["is_valid"]), dict(state)
    if not before["reason"].startswith("manual"):
        state["is_valid"] = before["is_valid"] or valid
        if valid:
            state["reason"] = m["reason"] or before["reason"]
        elif not before["is_valid"]:
            state["reason"] = m["reason"] or before["reason"] or "no positive affirmation"
    if before["employer"] in PLACEHOLDERS and (m["employer"] or "") not in PLACEHOLDERS:
        state["employer"] = m["employer"]
    if m["role"] and not is_role(before["role"]):
        state["role"] = m["role"]
    state["platform"] = before["platform"] or "Other"
    if state["platform"] == "Other" and m["platform"] not in (None, "", "Other"):
        state["platform"] = m["platform"]
    state["status"] = moved(before, m)
    if valid:
        state["application_date"] = min(before["application_date"], m["day"])
    for n in ("job_url", "excerpt"):
        state[n] = before[n] or m[n] or ""
    changed = any(state[n] != before[n] for n in ("status", "employer", "role", "platform", "job_url", "excerpt", "is_valid"))
    if changed and valid:
        state["last_updated"] = max(before["last_updated"], m["day"])
    for n in ("job_type", "seniority", "industry"):
        state[n] = m[n] or before[n]
    state["subject"], state["confidence"], state["messages"] = m["subject"] or "", max(before["confidence"], m["confidence"] or 0.0), before["messages"] + 1
    out = []
    if state["is_valid"] and not before["is_valid"] and not before["events"]:
        out.append(logged(state, None, "Applied", state["application_date"], "gmail", m["message_id"], "thread confirmed as an application"))
    if state["status"] != before["status"]:
        out.append(logged(state, before["status"], state["status"], m["day"], "llm" if m["parsed_by"] == "llm" else "gmail", m["message_id"], m["subject"] or ""))
    return out


def step(state: Row | None, m: Row, after: int | None) -> tuple[Row | None, list[Row]]:
    """The state after one message, and the events. A verdict on a thread without mail does nothing."""
    if state is None:
        return opened(m) if m["kind"] != "verdict" else (None, [])
    out = ghosting(state, m["arrived"], after)
    return state, out + (by_hand(state, m) if m["kind"] == "verdict" else merged(state, m))


def shown(thread: str, state: Row | None, events: list[Row]) -> list[Row]:
    """Output rows: the events, and then the state if there is one."""
    rows = [{"thread_id": thread, "what": "event", **e} for e in events]
    if state is not None:
        rows.append({"thread_id": thread, "what": "state", **{n: v for n, v in state.items() if n not in ("reason", "subject")}, "state_reason": state["reason"], "state_subject": state["subject"]})
    return rows


def folded(messages: DataFrame, as_of: date | None = None, after: int | None = GHOST_AFTER) -> DataFrame:
    """Rows of OUT for messages (MESSAGE): every event (what = event), and each thread's last state (what = state).

    Messages are taken by arrival, then by id. As of a day, silent threads are ghosted at the end too. A message without a day
    has that of its arrival; one without a thread, or an arrival, is left out. No messages give no rows.
    Threads are sorted on disk and read through once: a thread of any length needs the memory of its state, though one task.
    """
    kinds, names = fields_of(OUT), fields(MESSAGE)
    today = as_of.isoformat() if as_of else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        thread, state, end = None, None, partial(ghosting, today=today or "", after=after if today else None)
        for batch in batches:
            out = []
            for m in batch.to_pylist():
                if m["thread_id"] != thread:
                    late = end(state)
                    out += shown(thread, state, late)
                    thread, state = m["thread_id"], None
                state, events = step(state, m, after)
                out += shown(thread, None, events)
            yield pa.RecordBatch.from_pylist(out, kinds)
        late = end(state)
        yield pa.RecordBatch.from_pylist(shown(thread, state, late), kinds)

    ready = messages.where("thread_id is not null and arrived is not null").withColumn("day", F.coalesce("day", "arrived")).select(*names)
    return ready.repartition("thread_id").sortWithinPartitions("thread_id", "arrived", "message_id").mapInArrow(run, OUT)


def fields_of(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "long": pa.int64()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))])


def states(out: DataFrame) -> DataFrame:
    names = [n for n in fields(STATE) if n not in ("reason", "subject")]
    return out.where("what = 'state'").select("thread_id", *names, F.col("state_reason").alias("reason"), F.col("state_subject").alias("subject"))


def events(out: DataFrame) -> DataFrame:
    return out.where("what = 'event'").select("thread_id", *fields(EVENT))


class Threads(StatefulProcessor):
    """The same fold as a stream: state by thread, and a timer for the day on which silence is due."""

    def __init__(self, after: int) -> None:
        self.after = after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE)

    def read(self) -> Row | None:
        return dict(zip(fields(STATE), self.state.get(), strict=True)) if self.state.exists() else None

    def write(self, state: Row | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state is None:
            return
        self.state.update(tuple(state[n] for n in fields(STATE)))
        if state["is_valid"] and state["status"] == "Applied":
            due = datetime.fromisoformat(later(state["last_updated"], self.after + 1)).replace(tzinfo=timezone.utc)
            self.handle.registerTimer(int(due.timestamp() * 1000))

    def rows(self, key: tuple, state: Row | None, events: list[Row]) -> pd.DataFrame:
        return pd.DataFrame(shown(key[0], state, events), columns=fields(OUT)).astype(object).where(lambda x: x.notna(), None)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        given = pd.concat(list(rows)).sort_values(["arrived", "message_id"])  # what one micro-batch brings of a thread
        state, out = self.read(), []
        for m in given.astype(object).where(given.notna(), None).to_dict("records"):
            state, made = step(state, m, self.after)
            out += made
        self.write(state)
        yield self.rows(key, state, out)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self.read()
        today = datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000, timezone.utc).date().isoformat()
        out = ghosting(state, today, self.after)
        if out:
            self.state.update(tuple(state[n] for n in fields(STATE)))
        yield self.rows(key, state if out else None, out)


def fold_stream(messages: DataFrame, after: int = GHOST_AFTER, late: str = "0 days") -> DataFrame:
    """Rows of OUT as messages (MESSAGE and a timestamp ts, of the arrival) stream in: events, and a thread's state after each micro-batch that changes it.

    Needs the RocksDB state store. State is one row a thread and stays; a timer fires when the arrivals seen show that a thread is overdue.
    """
    marked = messages.withWatermark("ts", late)
    return marked.groupBy("thread_id").transformWithStateInPandas(Threads(after), OUT, "Append", "EventTime")
