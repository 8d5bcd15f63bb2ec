"""Measures in both compilations against plain Python, what is read off the metrics, and the exports."""

from __future__ import annotations

import math
import statistics
from datetime import date, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from stagewise.operators.filters import DRILL_SETS
from stagewise.plans import derived, export, measures, oracle_derived, queries
from stagewise.plans.metrics import Metrics
from test_warehouse import EVENTS, SF, UNTIDY, frames, rows_of

AS_OF = date(2026, 1, 31)


@pytest.mark.parametrize("name", [*queries.DERIVED])
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for t in "orders lineitem customer nation documents labels".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df, sql = queries.queries()[name](spark, SF), con.sql(oracle_derived.SQL[name])
    assert sorted(df.columns) == sorted(sql.columns)
    got = df.collect()
    assert rows_of(df.columns, got) == rows_of(sql.columns, sql.fetchall())
    if name == "measure_parity":
        assert all(r["agree"] for r in got)
        held = [r for r in got if r["by_metric"] is not None]
        assert {r["surface"] for r in held} == {"all", "set", "platform", "month"} and {r["member"] for r in held if r["surface"] == "set"} == set(DRILL_SETS)


def facts(spark, rows):
    """Facts by hand: (id, company, platform, days ago, days to response, stage)."""
    names = "application_id company_name platform days_since_applied days_to_response max_stage_reached"
    df = spark.createDataFrame(rows, "application_id string, company_name string, platform string, days_since_applied long, days_to_response long, max_stage_reached int")
    stage = F.col("max_stage_reached")
    applied = F.date_sub(F.lit(AS_OF), F.col("days_since_applied").cast("int"))
    return df.select(
        *names.split(), applied.alias("applied_date"), (F.col("days_to_response").isNotNull() | (stage >= 2)).alias("is_response"),
        *((stage >= k).alias(c) for k, c in ((2, "reached_assessment"), (3, "reached_interview"), (4, "reached_offer"))),
        F.lit(None).cast("long").alias("days_to_interview"), F.lit(False).alias("is_rejected"), F.lit(False).alias("is_ghosted"), (stage < 4).alias("is_active"), (F.col("platform") == "b").alias("is_direct"),
        F.col("days_since_applied").alias("days_since_activity"), F.date_add(applied, F.col("days_to_response").cast("int")).alias("first_response_date"), applied.alias("last_activity_date"),
        *(F.lit("x").alias(c) for c in ("channel", "role_family", "industry", "seniority", "job_type")),
    )


ROWS = [(str(i), f"c{i % 7}", "ab"[i % 3 == 0], i * 3 % 80, i % 11 if i % 4 == 0 else None, i % 5 if i % 2 else 1) for i in range(60)]


def test_measures_are_those_of_a_plain_loop(spark):
    df = facts(spark, ROWS)
    got = {(r["surface"], r["member"], r["measure"]): r["value"] for r in measures.measures(df).collect()}
    said = [r for r in ROWS if r[4] is not None or r[5] >= 2]
    overall = 100 * len(said) / len(ROWS)
    for p in "ab":
        of = [r for r in ROWS if r[2] == p]
        x, n = sum(r in said for r in of), len(of)
        last, prev = sum(r[3] < 30 for r in of), sum(30 <= r[3] < 60 for r in of)
        rate, z2 = x / n, 1.96**2
        half = 1.96 * math.sqrt(rate * (1 - rate) / n + z2 / (4 * n * n))
        want = {
            "applications": n, "companies": len({r[1] for r in of}), "change": last - prev, "change_pct": 100 * (last - prev) / prev, "response_rate_pct": 100 * rate, "response_vs_overall_pp": 100 * rate - overall,
            "response_rate_lo": 100 * max(0, (rate + z2 / (2 * n) - half) / (1 + z2 / n)), "median_days_to_response": statistics.median(r[4] for r in of if r[4] is not None), "overall_response_rate_pct": overall,
        }
        assert {k: got["platform", p, k] for k in want} == pytest.approx(want, abs=1e-3)
    assert got["set", "interview", "applications"] == sum(r[5] >= 3 for r in ROWS)
    replies = [AS_OF - timedelta(r[3]) + timedelta(r[4]) for r in ROWS if r[4] is not None]
    assert sum(v for (s, _, m), v in got.items() if (s, m) == ("reply_month", "applications")) == len(replies)


def test_measures_without_rows_or_denominators(spark):
    assert measures.measures(facts(spark, [])).count() == 0
    assert derived.response_marks(facts(spark, [])).count() == derived.segment_verdicts(facts(spark, [])).count() == 0
    got = {r["measure"]: r["value"] for r in measures.measures(facts(spark, [("1", None, None, 90, None, 1)])).where("surface = 'all'").collect()}
    assert (got["applications"], got["companies"], got["prev_30"], got["change_pct"], got["assessment_step_pct"], got["avg_days_to_response"]) == (1, 0, 0, None, None, None)
    assert all(r["agree"] for r in measures.parity(facts(spark, [("1", "c", "a", 90, None, 1)]), AS_OF).collect())


def test_parity_finds_a_measure_that_is_off(spark, monkeypatch):
    monkeypatch.setitem(measures.MEASURES, "interviews", measures.count("reached_offer"))
    off = measures.parity(facts(spark, ROWS), AS_OF).where("NOT agree").collect()
    assert {r["measure"] for r in off} == {"interviews"} and {r["surface"] for r in off} >= {"all", "platform"}


def test_named_parts_are_made_once():
    names = measures.named_leaves()
    assert len(names) == len(set(names)) and measures.by_text("t").count("count(DISTINCT") == 1
    with pytest.raises(TypeError):
        measures.sql(measures.Node(), names)


def test_marks_are_read_off_the_curve(spark):
    got = {r["platform"]: r for r in derived.response_marks(facts(spark, ROWS)).collect()}
    for p in ("a", "b", "(all)"):
        of = [r for r in ROWS if p in (r[2], "(all)")]
        seen = [(r[4], True) if r[4] is not None else (r[3], False) for r in of if r[4] is not None or r[5] < 2]
        left, curve = 1.0, {}
        for day in sorted({d for d, _ in seen}):
            left *= max(1 - sum(e for d, e in seen if d == day) / sum(d >= day for d, _ in seen), 1e-12)
            curve[day] = round(100 * left, 2)
        for h in derived.HORIZONS:
            days = [d for d in curve if d <= h]
            assert got[p][f"day_{h}"] == pytest.approx(100 - curve[max(days)], abs=0.011)
        assert got[p]["median_day"] == min((d for d, w in curve.items() if w <= 50), default=None)


def test_best_and_worst(spark):
    rows = [(f"{p}{i}", p, p, 5, 1 if i < x else None, 1) for p, n, x in (("few", 5, 5), ("high", 40, 38), ("low", 40, 2), ("same", 40, 2)) for i in range(n)]
    got = {r["dim"]: r for r in derived.segment_verdicts(facts(spark, rows)).collect()}
    r = got["platform"]
    assert (r["members"], r["best"], r["worst"], r["separated"], r["beats_overall"]) == (3, "high", "low", True, True)
    assert (got["industry"]["best"], got["industry"]["worst"], got["industry"]["separated"]) == ("x", "x", False)


def test_rates_in_words(spark):
    df = spark.createDataFrame([(100.0,), (24.9,), (5.0,), (4.9,), (None,)], "r double")
    assert [r[0] for r in df.select(derived.one_in(F.col("r"))).collect()] == ["1 in 1", "1 in 4", "1 in 20", "4.9%", "-"]


def test_csv_gives_back_what_it_was_given(spark, tmp_path):
    rows = [("1", 'said "no", twice', date(2026, 1, 2), 1.5, True), ("2", "", None, None, None), ("3", None, date(1999, 12, 31), -0.25, False), ("4", " two\nlines\\ ", None, 1e300, None), ("5", "ünï|cödé", None, 0.1, True)]
    df = spark.createDataFrame(rows, "id string, said string, day date, x double, yes boolean").repartition(3)
    export.export_star({"t": df, "none": df.where("false")}, str(tmp_path / "out"), {"t": "id", "none": "id"})
    back = export.read_star(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back["t"].collect())) == [tuple(None if x == "" else x for x in r) for r in rows] and back["none"].count() == 0 and back["t"].schema == df.schema


def test_report_says_what_the_metrics_say(spark):
    f = frames(spark, UNTIDY, EVENTS)
    said = export.report(Metrics(f, AS_OF))
    k = Metrics(f, AS_OF).query("kpis").first()
    assert f"{k['applications']} applications to {k['companies']} employers" in said
    for title in ("Where applications stop", "Channels", "Waiting", "Months", "Follow up"):
        assert f"## {title}\n" in said
    assert "| Offer | " in said and "Most are lost before" in said
    assert "No applications." in export.report(Metrics(frames(spark, []), AS_OF))
    assert export.cell(None) == "–" and export.cell("a|b\nc") == "a\\|b c"
