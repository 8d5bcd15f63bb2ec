"""What executors hold beside the results: Python workers of a task, and files of small tables."""

import public_tokenizers

from stagewise.llm import components, tokenfile

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_a_task_that_writes_token_files_has_one_python_worker(spark, tmp_path, monkeypatch):
    plans, plain = [], tokenfile.stash

    def watched(df, *rest):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, *rest)

    monkeypatch.setattr(tokenfile, "stash", watched)
    rows = [(7, "seven"), (-3, "minus three, minus three"), (None, "none"), (7, None), (2**40, "far")]
    manifest = tokenfile.write(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}", WORDS)
    assert [p.count("EvalPython") for p in plans] == [0] and plans[0].count("MapInArrow") == 2  # before and after the shuffle
    got = [(r["doc_id"], r["start"], r["n_tokens"]) for r in tokenfile.read(manifest, f"file://{tmp_path}").orderBy("start").collect()]
    assert [r[0] for r in got] == [-3, 7, 7, 2**40, None]
    assert [r[1] for r in got] == [sum(n for _, _, n in got[:i]) for i in range(len(got))]


def test_small_tables_of_components_are_not_written_by_all_tasks(spark, monkeypatch):
    files, plain = [], components.stash

    def watched(df, *rest):
        out = plain(df, *rest)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(components, "stash", watched)
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        links = [(i, i + 1) for i in range(400) if i % 50 != 49]
        got = components.components(spark.createDataFrame(links, "u long, v long")).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted((r["id"], r["component"]) for r in got) == [(i, i - i % 50) for i in range(400)]
    assert len(files) > 2 and max(files[1:]) == 1  # the first is written before its rows are counted
