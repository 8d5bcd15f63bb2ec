from datetime import datetime, timedelta

from pyspark.sql import functions as F

from stagewise.streaming import messages, retries

SCHEMA = "event_id long, key long, ts timestamp_ntz, status string"
START = datetime(2024, 1, 1, 12)


def files(spark, folder, *batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame([(a, b, START + timedelta(days=d), s) for a, b, d, s in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return f"{folder}/in"


def drained(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def test_events_come_once(spark, tmp_path):
    rows = [(i, i % 3, i // 10, "Applied") for i in range(40)]
    path = files(spark, str(tmp_path), rows, rows[20:])
    got = drained(messages.once(messages.read_events(spark, path, SCHEMA), overlap="30 days"), "once")
    assert sorted(r["event_id"] for r in got) == list(range(40))


def test_weeks_begin_on_mondays(spark, tmp_path):
    path = files(spark, str(tmp_path), [(i, 1, i, "Applied") for i in range(21)])
    got = drained(messages.weekly(messages.read_events(spark, path, SCHEMA), late="40 days"), "weeks", "complete")
    assert sorted((r["week_start"].isoformat(), r["events"]) for r in got) == [("2024-01-01", 7), ("2024-01-08", 7), ("2024-01-15", 7)]
    batch = messages.weekly(spark.read.schema(SCHEMA).parquet(path).withColumn("ts", F.col("ts").cast("timestamp")))
    assert batch.count() == 3


def test_quiet_keys_are_ghosted_and_late_events_roll_nothing_back(spark, tmp_path):
    path = files(spark, str(tmp_path), [(1, 1, 0, "Applied"), (2, 2, 0, "Applied")], [(3, 1, 2, "Interview"), (4, 1, 1, "Assessment / OA")], [(5, 2, 60, "Offer")], [(6, 2, 61, "Offer")])
    stream = messages.read_events(spark, path, SCHEMA).withWatermark("ts", "1 day").select("key", "ts", "status")
    got = drained(messages.fold_status(stream), "folded")
    last = [r for r in got if r["key"] == 1 and not r["ghosted"]][-1]
    assert last["status"] == "Interview"
    ghosts = [(r["key"], r["status"], r["events"]) for r in got if r["ghosted"]]
    assert (1, "Ghosted", 3) in ghosts


def test_what_is_older_than_a_time_out_revives_nothing(spark, tmp_path):
    path = files(spark, str(tmp_path), [(1, 1, 5, "Interview"), (2, 2, 0, "Applied")], [(3, 2, 60, "Offer")], [(4, 2, 61, "Offer")], [(5, 1, 4, "Applied")], [(6, 1, 62, "Offer")])
    stream = messages.read_events(spark, path, SCHEMA).withWatermark("ts", "1 day").select("key", "ts", "status")
    got = [(r["status"], r["ghosted"]) for r in drained(messages.fold_status(stream), "revived") if r["key"] == 1]
    assert got == [("Interview", False), ("Ghosted", True), ("Offer", False)]


def test_bodies_that_failed_are_read_again(spark, tmp_path):
    def at(name):
        return f"{tmp_path}/{name}"

    def fetch(batch):  # message i can be read at attempt i modulo 5; two of five never in time
        i = F.col("message_id").cast("int")
        return batch.withColumn("body", F.when(F.col("attempts") >= i % 5, F.concat(F.lit("body "), "message_id")))

    def arrive(ids, day):
        spark.createDataFrame([(str(i), START + timedelta(days=day)) for i in ids], retries.MESSAGE).coalesce(1).write.mode("append").parquet(at("new"))

    def run():
        retries.read_with_retries(spark, at("new"), at("dead"), at("out"), fetch, at("checkpoint")).awaitTermination()
        return spark.read.schema("message_id string, arrived timestamp, attempts int, body string").option("recursiveFileLookup", True).parquet(at("out"))

    arrive(range(10), 0)
    assert {r["message_id"] for r in run().collect()} == {"0", "5"}
    arrive([*range(10, 15), 0], 1)  # one is delivered twice
    assert {r["message_id"] for r in run().collect()} == {"0", "5", "1", "6", "10"}
    for _ in range(4):
        out = run()
    rows = {r["message_id"]: r for r in retries.first_arrivals(out).collect()}
    assert out.count() == 16 and len(rows) == 15
    assert {i for i, r in rows.items() if r["body"]} == {str(i) for i in range(15) if i % 5 < 3}
    assert all(r["attempts"] == (int(i) % 5 + 1 if r["body"] else 3) for i, r in rows.items())
    assert rows["0"]["arrived"] == START


def test_ids_in_the_order_in_which_they_were_first_seen(spark):
    rows = [(2, 1, "a"), (1, 2, "b"), (1, 1, "c"), (2, 2, "c"), (3, 1, None), (3, 2, "d"), (2, 3, "d")]
    got = retries.first_seen(spark.createDataFrame(rows, "listing int, position int, id string")).orderBy("n").collect()
    assert [(r["id"], r["n"]) for r in got] == [("c", 1), ("b", 2), ("a", 3), ("d", 4)]
