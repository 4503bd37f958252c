from mnemora.streaming import jobs, rollup, windows


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


EVENTS = "org_id int, user_id long, space_id long, ts timestamp, kind string, amount long"


def events(spark):
    return spark.range(200).selectExpr("1 as org_id", "id % 5 as user_id", "id % 2 as space_id", "timestamp_seconds(1700000000 + id * 60) as ts", "element_at(array('ingested','failed','memory','tokens','search'), cast(id % 5 + 1 as int)) as kind", "id as amount")


def test_rollup_counts_each_batch_once(spark, tmp_path):
    src, deltas = str(tmp_path / "in"), str(tmp_path / "deltas")
    events(spark).repartition(4).write.parquet(src)
    stream = spark.readStream.schema(events(spark).schema).option("maxFilesPerTrigger", 1).parquet(src)
    for _ in range(2):  # a restart finds nothing new
        rollup.start_rollup(stream, deltas, str(tmp_path / "ck")).awaitTermination()
    rows = lambda df: sorted(map(tuple, df.select("user_id", "space_id", "date", *rollup.COUNTERS).collect()))
    assert rows(rollup.daily_usage(spark, deltas)) == rows(rollup.usage_delta(events(spark)))


def test_rate_stream_equals_the_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    events(spark).select("user_id", "ts").write.parquet(src)
    stream = spark.readStream.schema("user_id long, ts timestamp").parquet(src)
    got = drain(windows.rate_stream(stream, "10 minutes", 1, "user_id"), "rates", "complete")
    want = windows.rate_windows(events(spark), {"w": (600, 1)}, "user_id")
    assert {(r.user_id, int(r.start.timestamp()), r.n, r.over) for r in got.collect()} == {(r.user_id, r.start, r.n, r.over) for r in want.collect()}


MESSAGES = [
    ("a", 1, "create", 0.0), ("a", 2, "claim", 1.0), ("a", 3, "claim", 100.0), ("a", 4, "beat", 200.0), ("a", 5, "claim", 400.0), ("a", 6, "claim", 501.0), ("a", 7, "completed", 510.0), ("a", 8, "failed", 511.0), ("a", 9, "claim", 900.0),
    ("b", 10, "claim", 5.0), ("c", 11, "create", 1.0), ("c", 12, "completed", 2.0), ("c", 13, "create", 3.0), ("c", 14, "dance", 4.0),
]
OUTCOMES = ["created", "claimed", "in_flight", "beat", "in_flight", "claimed", "ended", "terminal", "terminal", "not_found", "created", "ignored", "exists", "unknown"]


def test_job_states(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = spark.createDataFrame(MESSAGES, "job_id string, message_id long, action string, at double")
    want = {m[1]: o for m, o in zip(MESSAGES, OUTCOMES, strict=True)}
    assert {r.message_id: r.outcome for r in jobs.job_outcomes_batch(rows).collect()} == want
    rows.where("message_id % 2 = 1 or message_id < 7").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(rows.schema).parquet(src)
    got = {r.message_id: r.outcome for r in drain(jobs.job_outcomes(stream), "outcomes").collect()}
    assert {k: got[k] for k in range(1, 6)} == {k: want[k] for k in range(1, 6)}
    assert {r.message_id for r in jobs.dead_letters(jobs.job_outcomes_batch(rows)).collect()} == {10, 14}


def test_slots(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = spark.createDataFrame([(1, "x", "acquire", 0.0), (1, "y", "acquire", 1.0), (1, "z", "acquire", 2.0), (1, "x", "acquire", 3.0), (1, "y", "release", 4.0), (1, "z", "acquire", 5.0), (1, "w", "acquire", 50.0)], "owner long, lease_id string, action string, at double")
    rows.coalesce(1).write.parquet(src)
    out = drain(jobs.slots(spark.readStream.schema(rows.schema).parquet(src), 2, 10.0), "slots").orderBy("at").collect()
    assert [r.granted for r in out] == [True, True, False, True, False, True, True]
    assert out[-1].held == 1
