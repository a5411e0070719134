"""Streams over several micro-batches against their batch forms."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.session import new_state_dir
from tidemark.streaming import limits
from tidemark.streaming import tables as st


def _events(spark, n=400):
    start = datetime(2024, 1, 1)
    rows, ts = [], start
    for i in range(n):
        ts += timedelta(seconds=(i * 37) % 60 + (7200 if i % 90 == 89 else 0))
        subject = "hot" if i % 3 else f"s{i % 5}"
        rows.append((i, ts, subject, ("request", "fail", "verify")[i % 7 % 3]))
    return spark.createDataFrame(rows, "event_id long, ts timestamp, subject string, action string")


def _brute(rows, limit):
    states, out = {}, {}
    for r in sorted(rows, key=lambda r: (r.ts, r.event_id)):
        us = int(r.ts.timestamp() * 1_000_000)
        states[r.subject], out[r.event_id] = limit.step(states.get(r.subject, limit.start), us, r.action)
    return out


def test_replay_in_pieces_equals_one_pass(spark):
    events = _events(spark)
    for limit in (limits.throttle(), limits.sign_in_codes()):
        got = {r.event_id: r.verdict for r in limits.replay(events, limit).collect()}
        assert got == _brute(events.collect(), limit)
        assert len(set(got.values())) > 1


def _files(spark, df, order, parts):
    path = new_state_dir(spark, "in")
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size:(i + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(path)
    return path


def test_throttle_stream_over_batches(spark):
    events = _events(spark)
    limit = limits.throttle()
    stream = st.read_stream(spark, _files(spark, events, "event_id", 4), files_per_trigger=1)
    out = new_state_dir(spark, "out")
    st.drain(limits.enforce(stream, limit), st.append_to(out))
    got = {r.event_id: r.verdict for r in spark.read.parquet(out).collect()}
    assert got == _brute(events.collect(), limit)


def test_silent_subjects_leave_the_state(spark):
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(hours=2 * i), f"s{i // 10}", "request") for i in range(40)]  # ten events each, one subject after the other
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, subject string, action string")
    stream = st.read_stream(spark, _files(spark, events, "event_id", 8), files_per_trigger=1)
    out = new_state_dir(spark, "out")
    limit = limits.throttle()
    progress = st.drain(limits.enforce(stream, limit, late="1 second"), st.append_to(out))
    got = {r.event_id: r.verdict for r in spark.read.parquet(out).collect()}
    assert got == _brute(events.collect(), limit)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert max(held) <= 2 and held[-1] == 1  # of four subjects


def test_long_logs_of_one_subject_wait_in_slots(spark):
    events = _events(spark, 300).withColumn("subject", F.lit("one"))
    limit = limits.throttle(window_s=600, maximum=5, block_s=900)
    stream = st.read_stream(spark, _files(spark, events.orderBy(F.xxhash64("event_id")), "action", 2), files_per_trigger=2)
    out = new_state_dir(spark, "out")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 40)
    try:
        st.drain(limits.enforce(stream, limit, ordered=60), st.append_to(out))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {r.event_id: r.verdict for r in spark.read.parquet(out).collect()}
    assert got == _brute(events.collect(), limit)


def test_first_seen_over_batches(spark):
    df = spark.createDataFrame([(i, f"k{i % 6}", i) for i in range(40)], "n int, key string, pos int")
    stream = st.read_stream(spark, _files(spark, df, "n", 4), files_per_trigger=1)
    out = new_state_dir(spark, "seen")
    progress = st.drain(st.first_seen(stream, ["key"], ["pos"]), st.append_to(out), mode="update")
    assert sorted((r.key, r.pos, r.n) for r in st.seen_rows(spark, out).collect()) == [(f"k{i}", i, i) for i in range(6)]
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 6


def test_upsert_stream_over_batches(spark):
    df = spark.createDataFrame([(i, f"k{i % 5}", i) for i in range(20)], "n int, key string, v int")
    stream = st.read_stream(spark, _files(spark, df, "n", 4), files_per_trigger=1)
    out = new_state_dir(spark, "up")
    st.drain(stream.select("key", "v"), st.upsert_into(out, None, ["key"], [F.col("v").desc()]))
    assert sorted(map(tuple, st.latest_version(spark, out).select("key", "v").collect())) == [(f"k{i}", 15 + i) for i in range(5)]


def test_small_batches_write_no_bucket_whole_and_compaction_keeps_the_table(spark):
    out, expected = new_state_dir(spark, "up"), {}
    start = spark.createDataFrame([(f"k{i}", i, "old" if i % 2 else None) for i in range(3000)], "key string, v int, note string")
    expected = {r.key: (r.v, r.note) for r in start.collect()}
    each = st.upsert_into(out, start, ["key"], [F.col("v").desc()], keep_if_null=["note"], deltas=3)

    def files(kind):
        return spark.read.parquet(f"{out}/{kind}").groupBy({"delta": "batch", "base": "upto"}[kind]).count().collect()

    for number in range(9):
        rows = [(f"k{(number * 7 + i * 3) % 40}", 10_000 + number, None if i % 2 else f"n{number}") for i in range(10)]
        batch = spark.createDataFrame(rows, "key string, v int, note string").dropDuplicates(["key"])
        for _ in range(2 if number in (4, 8) else 1):  # some batches are run again
            each(batch, number)
        for r in batch.collect():
            expected[r.key] = (r.v, r.note if r.note is not None else expected[r.key][1])
        got = {r.key: (r.v, r.note) for r in st.latest_version(spark, out).collect()}
        assert got == expected
    assert all(r["count"] <= 10 for r in files("delta"))
    rewritten = {r["upto"]: r["count"] for r in files("base")}
    assert len(rewritten) > 1 and all(n < 3000 for upto, n in rewritten.items() if upto >= 0)


def test_batches_without_rows_and_a_repeated_batch(spark):
    out = new_state_dir(spark, "up")
    each = st.upsert_into(out, None, ["key"], [F.col("v").desc()])
    df = spark.createDataFrame([("a", 1), ("b", 2)], "key string, v int")
    for number, batch in enumerate((df.limit(0), df, df.limit(0), df.filter("key = 'a'").withColumn("v", F.lit(9)))):
        each(batch, number)
    each(df.filter("key = 'a'").withColumn("v", F.lit(9)), 3)
    assert sorted(map(tuple, st.latest_version(spark, out).select("key", "v").collect())) == [("a", 9), ("b", 2)]


def test_trend_stream_over_batches(spark):
    from tidemark.operators.trend import trend

    df = spark.createDataFrame([(i, i % 2, datetime(2024, 1, 1) + timedelta(days=i), i if i % 4 else None) for i in range(60)],
                               "n int, role_id int, snapshot_at timestamp, rate int")
    stream = st.read_stream(spark, _files(spark, df, "n", 3), files_per_trigger=1)
    out = new_state_dir(spark, "trend")
    st.drain(st.trend_stream(stream), st.upsert_into(out, None, ["role_id", "grain", "bucket"], []), mode="update")
    got = st.trend_rates(st.latest_version(spark, out)).select("role_id", "grain", "bucket", "average_rate", "points")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, trend(df).select(got.columns).collect()))


def test_closed_trend_buckets_leave_the_state(spark):
    from tidemark.operators.trend import trend

    rows = [(i, i % 3, datetime(2024, 1, 1) + timedelta(days=i), i % 90) for i in range(420)]
    df = spark.createDataFrame(rows, "n int, role_id int, snapshot_at timestamp, rate int")
    stream = st.read_stream(spark, _files(spark, df, "n", 14), files_per_trigger=1)
    out = new_state_dir(spark, "trend")
    progress = st.drain(st.trend_stream(stream), st.upsert_into(out, None, ["role_id", "grain", "bucket"], []), mode="update")
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    all_buckets = trend(df).count()
    # three roles, a month and a few weeks open: the state does not grow with the months
    assert max(kept) < 100 < all_buckets and kept[-1] <= max(kept[3:6])
    got = st.trend_rates(st.latest_version(spark, out)).select("role_id", "grain", "bucket", "average_rate", "points")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, trend(df).select(got.columns).collect()))
