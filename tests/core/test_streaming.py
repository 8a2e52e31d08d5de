import datetime as dt


from siltstone.operators import operations
from siltstone.streaming import events as ev

T0 = dt.datetime(2024, 1, 1)


def _stream(spark, tmp_path, df, name, build, mode="append"):
    df.coalesce(1).write.parquet(str(tmp_path / name))
    rows = build(spark.readStream.schema(df.schema).parquet(str(tmp_path / name)))
    q = rows.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-cp")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_rate_limit_equals_the_batch_form(spark, tmp_path):
    rows = [(f"k{i % 3}", i, T0 + dt.timedelta(hours=(i * 7) % 60)) for i in range(60)]
    df = spark.createDataFrame(rows, "key string, event_id long, ts timestamp")
    got = {r.event_id: r.admitted for r in _stream(spark, tmp_path, df, "rates", lambda s: ev.rate_limit(s, 3, 86400))}
    assert got == {r.event_id: r.admitted for r in operations.admitted(df, 3, 86400).collect()}


def test_latest_state_and_once(spark, tmp_path):
    rows = [("u", 5, 1, "active"), ("u", 9, 2, "past_due"), ("u", 7, 3, "active"), ("u", 9, 4, "canceled"), ("w", 1, 5, "active")]
    df = spark.createDataFrame(rows, "user_id string, event_created long, arrival long, status string")
    got = {r.user_id: r.status for r in _stream(spark, tmp_path, df, "latest", lambda s: ev.latest_state(s, ["user_id"], ["status"]), "complete")}
    assert got == {"u": "canceled", "w": "active"} == {r.user_id: r.status for r in operations.upsert_latest(df, ["user_id"]).collect()}
    df = spark.createDataFrame([("e1", T0), ("e1", T0), ("e2", T0)], "id string, ts timestamp")
    assert sorted(r.id for r in _stream(spark, tmp_path, df, "once", lambda s: ev.once(s, ["id"]))) == ["e1", "e2"]


def test_windows_close_at_the_watermark(spark, tmp_path):
    df = spark.createDataFrame([("c", T0, 1.0), ("c", T0 + dt.timedelta(minutes=5), 2.0), ("c", T0 + dt.timedelta(hours=3), 4.0)], "event_type string, ts timestamp, value double")
    got = _stream(spark, tmp_path, df, "usage", lambda s: ev.usage_by_window(s))
    assert [(r.n, r.value) for r in got] == [(2, 3.0)]


def test_job_states(spark):
    states = spark.createDataFrame([(1, "pending"), (2, "running"), (3, "completed")], "job_id int, state string")
    moves = spark.createDataFrame([(1, "running"), (1, "completed"), (2, "completed"), (3, "running")], "job_id int, to string")
    assert {(r.job_id, r.to) for r in ev.job_moves(moves, states).collect()} == {(1, "running"), (2, "completed")}
    assert {r.job_id: r.state for r in ev.recover(states).collect()} == {1: "pending", 2: "failed", 3: "completed"}


def test_cache_with_expiry(spark, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [("a", 1, at(0), "get", None), ("a", 2, at(1), "put", "x"), ("a", 3, at(1), "get", None), ("a", 4, at(59), "get", None), ("a", 5, at(61), "get", None), ("a", 6, at(70), "put", "y"), ("a", 7, at(75), "get", None), ("b", 8, at(2), "get", None)]
    df = spark.createDataFrame(rows, "key string, event_id long, ts timestamp, kind string, value string")
    got = {r.event_id: (r.hit, r.value) for r in _stream(spark, tmp_path, df, "ttl", lambda s: ev.ttl_cache(s, 3600))}
    assert got == {1: (False, None), 3: (True, "x"), 4: (True, "x"), 5: (False, None), 7: (True, "y"), 8: (False, None)}
