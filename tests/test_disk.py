"""What goes to disk: the export is packed, and partial sums by company do not go from task to task."""

from pathlib import Path

from stagewise.plans import export, measures, queries

SF = "/root/testdata/sf0.001"


def test_the_export_is_packed(spark, tmp_path):
    df = spark.range(5000).selectExpr("cast(id as string) as id", "'a text that is much like all others' as said")
    export.export_star({"t": df}, str(tmp_path / "out"), {"t": "id"})
    files = [p for p in Path(tmp_path / "out/star_schema/t").iterdir() if p.name.startswith("part-")]
    plain = sum(len(r["id"]) + len(r["said"]) + 2 for r in df.collect())
    assert files and sum(p.stat().st_size for p in files) < plain / 4
    assert export.read_star(spark, str(tmp_path / "out"))["t"].exceptAll(df).count() == 0


def test_measures_go_from_task_to_task_by_member_alone(spark):
    facts = queries.frames(spark, SF)["fct_applications"]
    for df in (measures.measures(facts), measures.parity(facts, queries.AS_OF)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        dealt = [x for x in plan.splitlines() if "Exchange" in x and "surface" in x]
        assert dealt and not any("company_name" in x for x in dealt)
