import json
import os
import random
import signal

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from crowdlens.operators import latency
from crowdlens.operators.predictions import topk_categories
from crowdlens.sources import events
from crowdlens.streaming import drain, last_values, manifest, offset_log, progress, scorer


def event(i):
    return {"review_id": f"r{i}", "business_id": f"b{i % 3}", "user_id": f"u{i}", "text": "t" * (i % 5), "stars": float(i % 5),
            "produced_at_ms": 1.0e12 + i}


@pytest.fixture
def folder(tmp_path):
    """Four files of ten events, each with one broken line."""
    source = tmp_path / "in"
    source.mkdir()
    for part in range(4):
        body = [json.dumps(event(10 * part + i)) for i in range(10)] + ['{"review_id": "cut']
        (source / f"{part}.json").write_text("\n".join(body) + "\n")
    return tmp_path


def probabilities():
    return F.array(F.col("stars") / 10.0, F.lit(0.25), F.lit(0.1))


def score(batch):
    return scorer.scored_events(batch, probabilities(), ["x", "y", "z"], 2, F.lit(2.0e12))


def start(spark, folder, **options):
    stream = scorer.read_messages(spark, str(folder / "in"), max_per_batch=1)
    return scorer.score_stream(stream, score, str(folder / "out"), str(folder / "ckpt"), quarantine=str(folder / "bad"), **options)


def test_stream_equals_batch_and_reports(spark, folder):
    log = progress.ProgressLog(echo=True)
    spark.streams.addListener(log)
    try:
        running = start(spark, folder)
        running.awaitTermination()
        got = {r.review_id: r for r in scorer.landed(spark, str(folder / "out")).collect()}
        good, bad = events.parse_events(spark.read.text(str(folder / "in")))
        batch = {r.review_id: r for r in score(good).collect()}
        assert got == batch and len(got) == 40 and bad.count() == 4
        assert scorer.landed(spark, str(folder / "bad")).count() == 4
        assert [p.category for p in got["r4"].predictions] == ["x", "y"] and got["r0"].e2e_ms == pytest.approx(1.0e12)
        report = progress.stream_report(progress.progress_table(spark, running)).head()
        assert report.events_scored == 44 and report.batches == 4 and report.final_lag == 0 and report.batch_size_mean == 11.0
        assert report.throughput_per_sec > 0
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        assert log.table(spark).groupBy().sum("rows").head()[0] == 44
    finally:
        spark.streams.removeListener(log)


def test_restart_after_a_crash_loses_and_repeats_nothing(spark, folder):
    def crash(batch_id):
        if batch_id == 2:
            raise RuntimeError("executor lost after the write, before the commit")

    with pytest.raises(Exception, match="executor lost"):
        start(spark, folder, before_commit=crash).awaitTermination()
    assert scorer.landed(spark, str(folder / "out")).count() == 30
    start(spark, folder).awaitTermination()
    rows = scorer.landed(spark, str(folder / "out"))
    assert rows.count() == 40 and rows.select("review_id").distinct().count() == 40
    sent = spark.range(40).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("review_id"))
    events.assert_delivered(events.delivery_audit(sent, rows, "review_id"))
    start(spark, folder).awaitTermination()           # nothing new: nothing happens
    assert scorer.landed(spark, str(folder / "out")).count() == 40


def test_timed_trigger_can_be_stopped(spark, folder):
    running = start(spark, folder, wait="50 milliseconds")
    running.processAllAvailable()
    running.stop()
    assert scorer.landed(spark, str(folder / "out")).count() == 40


def test_messages_round_trip_and_quarantine(spark, tmp_path):
    labelled = spark.createDataFrame([("r1", "b1", "u1", "t\n\"q\"", 4.0), ("r2", "b1", None, None, None)],
                                     "review_id string, business_id string, user_id string, text string, review_stars double")
    sent = events.as_messages(events.review_events(labelled, F.lit(5.0)), "business_id")
    assert {r.key for r in sent.collect()} == {"b1"}
    events.write_messages(sent, str(tmp_path / "messages"))
    good, bad = events.parse_events(spark.read.text(str(tmp_path / "messages")))
    assert {(r.review_id, r.user_id, r.text, r.stars) for r in good.collect()} == {("r1", "u1", "t\n\"q\"", 4.0), ("r2", None, None, None)}
    assert bad.count() == 0
    broken = spark.createDataFrame([("{bad",), ("[]x",), (None,)], "value string")
    good, bad = events.parse_events(broken)
    assert good.count() == 0 and bad.count() == 3


def test_delivery_gaps_raise(spark):
    sent = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    landed = spark.createDataFrame([("a",), ("a",), ("d",)], "k string")
    audit = events.delivery_audit(sent, landed, "k")
    assert tuple(audit.head()) == (3, 3, 2, 2)
    with pytest.raises(events.UndeliveredEvents):
        events.assert_delivered(audit)


def test_event_time_windows_drop_late_rows(spark, tmp_path):
    schema = "ts timestamp, kind string, ms double"
    early = [("2024-01-01 10:05:00", "a", 1.0), ("2024-01-01 10:25:00", "a", 3.0), ("2024-01-01 12:30:00", "a", 9.0)]
    late = [("2024-01-01 10:10:00", "a", 100.0), ("2024-01-01 14:00:00", "a", 5.0)]
    cast = [F.col("ts").cast("timestamp").alias("ts"), "kind", "ms"]
    source = str(tmp_path / "in")
    out = str(tmp_path / "out")

    def run():
        windows = scorer.rolling_window_latency(spark.readStream.schema(schema).parquet(source), "ts", "ms", "kind")
        windows.writeStream.foreachBatch(lambda batch, i: scorer.write_batch(batch, i, out)).outputMode("append").option(
            "checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start().awaitTermination()

    for rows in (early, late):
        spark.createDataFrame(rows, "ts string, kind string, ms double").select(*cast).coalesce(1).write.mode("append").parquet(source)
        run()
    got = {str(r.window_start): (r.n, r.mean_ms, r.max_ms) for r in scorer.landed(spark, out).collect()}
    assert got == {"2024-01-01 10:00:00": (2, 2.0, 3.0), "2024-01-01 12:00:00": (1, 9.0, 9.0)}


def test_lag_is_read_from_kafka_offsets():
    record = {"runId": "r", "batchId": 3, "numInputRows": 5, "batchDuration": 20,
              "sources": [{"endOffset": {"t": {"0": 10, "1": 5}}, "latestOffset": {"t": {"0": 14, "1": 6}}}]}
    assert progress.progress_row(record) == ("r", 3, 5, 20, 5)
    record["sources"] = [{"endOffset": '{"logOffset": 1}', "latestOffset": None}]
    assert progress.progress_row(record)[-1] == 0


def test_top_k_is_shared_with_the_batch(one):
    got = one(topk_categories(F.array(F.lit(0.123456), F.lit(0.5)), ["a", "b"], 2))
    assert [(p.category, p.probability) for p in got] == [("b", 0.5), ("a", 0.12346)]


def test_scored_events_are_stamped_and_published(spark, folder):
    def unstamped(batch):
        return score(batch).drop("scored_at_ms", "e2e_ms")
    stream = scorer.read_messages(spark, str(folder / "in"), max_per_batch=2)
    running = scorer.score_stream(
        stream, unstamped, str(folder / "out"), str(folder / "ckpt"), finish=scorer.stamped,
        publish=lambda rows, batch: scorer.publish_messages(rows, batch, str(folder / "sent")))
    running.awaitTermination()
    landed = scorer.landed(spark, str(folder / "out")).collect()
    assert len(landed) == 40 and all(r.e2e_ms == pytest.approx(r.scored_at_ms - r.produced_at_ms, abs=0.01) for r in landed)
    sent = spark.read.json(str(folder / "sent")).collect()
    assert len(sent) == 40 and all(json.loads(r.value)["business_id"] == r.key for r in sent)


def test_a_stream_without_broken_messages_has_an_empty_quarantine(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(event(1)) + "\n")
    running = scorer.score_stream(scorer.read_messages(spark, str(tmp_path / "in")), score, str(tmp_path / "out"),
                                  str(tmp_path / "ckpt"), quarantine=str(tmp_path / "bad"))
    running.awaitTermination()
    assert scorer.landed(spark, str(tmp_path / "bad"), "raw string").count() == 0


def test_the_progress_log_has_a_bound():
    assert progress.ProgressLog(keep=3).rows.maxlen == 3


def test_the_report_covers_more_batches_than_spark_and_the_log_keep(spark, folder):
    log = progress.ProgressLog(keep=1)
    spark.streams.addListener(log)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        running = start(spark, folder)
        running.awaitTermination()
        assert len(running.recentProgress) < 4        # what the report was made of before
        report = log.report(spark, running).head()
        assert (report.events_scored, report.batches, report.batch_size_mean, report.final_lag) == (44, 4, 11.0, 0)
        assert report.run_id == str(running.runId) and report.wall_seconds > 0 and report.throughput_per_sec > 0
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
        spark.streams.removeListener(log)


def test_a_job_reports_all_its_batches(spark, tmp_path, monkeypatch):
    """`python -m crowdlens stream`: the report comes from the log, not from what Spark still holds."""
    from crowdlens import __main__ as job

    (tmp_path / "in").mkdir()
    for part in range(4):
        (tmp_path / "in" / f"{part}.json").write_text(json.dumps(event(part)) + "\n")
    monkeypatch.setattr(job, "get_spark", lambda *a: spark)
    monkeypatch.setattr(job.stream_scoring, "run", lambda session, *a: scorer.score_stream(
        scorer.read_messages(session, str(tmp_path / "in"), max_per_batch=1), score, str(tmp_path / "out"), str(tmp_path / "ckpt")))
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        job.main(["stream", "--model", "m", "--out", str(tmp_path / "out"), "--checkpoint", "c", "--path", "p"])
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    report = spark.read.json(str(tmp_path / "out" / "run_report")).head()
    assert (report.events_scored, report.batches) == (4, 4)


# ---------------------------------------------------------------- manifest

def one_file(folder, name, lines):
    (folder / "in").mkdir(exist_ok=True)
    (folder / "in" / name).write_text("\n".join(lines) + "\n")


def test_a_batch_without_good_rows_is_entered_and_not_published(spark, tmp_path):
    sent = []

    def run():
        stream = scorer.read_messages(spark, str(tmp_path / "in"), max_per_batch=1)
        scorer.score_stream(stream, score, str(tmp_path / "out"), str(tmp_path / "ckpt"), quarantine=str(tmp_path / "bad"),
                            publish=lambda rows, batch: sent.append((batch, rows.count()))).awaitTermination()
    one_file(tmp_path, "a.json", ["{broken"])
    run()
    one_file(tmp_path, "b.json", [json.dumps(event(1)), json.dumps(event(2))])
    run()
    found = {r.batch_id: (r.rows, len(r.files)) for r in manifest.entries(spark, str(tmp_path / "out")).collect()}
    assert found[0] == (0, 0) and found[1][0] == 2 and found[1][1] >= 1 and sent == [(1, 2)]
    assert scorer.landed(spark, str(tmp_path / "out")).count() == 2 and scorer.landed(spark, str(tmp_path / "bad")).count() == 1


def test_readers_see_committed_batches_only(spark, folder, monkeypatch):
    """A crash between the write and the manifest: the rows are there, but not seen; the batch is run again and published."""
    original, sent = manifest.commit, []

    def crash(session, out, batch_id):
        if batch_id == 1 and not sent.count("crashed"):
            sent.append("crashed")
            raise RuntimeError("lost before the manifest")
        return original(session, out, batch_id)
    monkeypatch.setattr(manifest, "commit", crash)
    publish = {"publish": lambda rows, batch: sent.append(batch)}
    with pytest.raises(Exception, match="lost before the manifest"):
        start(spark, folder, **publish).awaitTermination()
    out = str(folder / "out")
    assert spark.read.parquet(out).count() == 20 and scorer.landed(spark, out).count() == 10 and sent == [0, "crashed"]
    start(spark, folder, **publish).awaitTermination()
    assert scorer.landed(spark, out).count() == 40 and sent == [0, "crashed", 1, 2, 3]
    assert {(r.batch_id, r.rows) for r in manifest.entries(spark, out).collect()} == {(i, 10) for i in range(4)}


def test_a_crash_between_manifest_and_commit_repeats_the_batch_in_place(spark, folder):
    sent, out = [], str(folder / "out")

    def publish(rows, batch):
        sent.append(batch)
        if sent == [0, 1]:
            raise RuntimeError("lost while publishing")
    with pytest.raises(Exception, match="lost while publishing"):
        start(spark, folder, publish=publish).awaitTermination()
    assert scorer.landed(spark, out).count() == 20
    start(spark, folder, publish=publish).awaitTermination()
    assert sent == [0, 1, 1, 2, 3] and scorer.landed(spark, out).count() == 40


# ---------------------------------------------------------------- message log

def messages_of(spark, ids):
    return events.as_messages(spark.createDataFrame([event(i) for i in ids]).selectExpr(
        "review_id", "business_id", "user_id", "text", "stars", "produced_at_ms"), "business_id").withColumn(
        "n", F.get_json_object("value", "$.produced_at_ms").cast("double"))


def test_log_keeps_keys_together_and_offsets_in_order(spark, tmp_path):
    path = str(tmp_path / "log")
    assert offset_log.head(path) == {}
    first = offset_log.append(messages_of(spark, range(30)), path, 3, ("n",))
    second = offset_log.append(messages_of(spark, range(30, 50)), path, 3, ("n",))
    assert sum(first.values()) == 30 and sum(second.values()) == 50 == sum(offset_log.head(path).values())
    rows = [r for files in offset_log.segments(path).values() for _, _, f in files for r in pq.ParquetFile(f).read().to_pylist()]
    by_key, by_partition = {}, {}
    for r in rows:
        by_key.setdefault(r["key"], set()).add(r["partition"])
        by_partition.setdefault(r["partition"], []).append(r)
    assert all(len(p) == 1 for p in by_key.values())
    for own in by_partition.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == list(range(len(own)))
        stamps = [json.loads(r["value"])["produced_at_ms"] for r in own]
        assert stamps == sorted(stamps)


def test_slices_of_a_partition_have_offsets_in_its_order(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    monkeypatch.setattr(offset_log, "SLICE", 10)
    rows = spark.range(60).selectExpr("'one' AS key", "CAST(id AS STRING) AS value", "60 - id AS n").repartition(3)
    assert list(offset_log.append(rows, path, 2, ("n",)).values()) == [60]
    assert list(offset_log.append(rows, path, 2, ("n",)).values()) == [120]
    (files,) = offset_log.segments(path).values()
    assert len(files) > 6 and [a for a, _, _ in files] == [0, *[b for _, b, _ in files[:-1]]]  # one task wrote all as one file
    found = [r for _, _, f in files for r in pq.ParquetFile(f).read().to_pylist()]
    assert [r["offset"] for r in found] == list(range(120))
    assert [int(r["value"]) for r in found] == [*range(59, -1, -1)] * 2
    assert not [f for f in (tmp_path / "log").rglob("*") if "tmp" in f.name]


def log_stream(spark, tmp_path, **options):
    read = {k: options.pop(k) for k in ("from_beginning", "max_per_batch", "min_per_batch", "max_delay_ms") if k in options}
    stream = scorer.read_messages(spark, log=str(tmp_path / "log"), position=str(tmp_path / "position.json"), **read)
    return scorer.score_stream(stream, score, str(tmp_path / "out"), str(tmp_path / "ckpt"), **options)


def test_earliest_and_latest(spark, tmp_path):
    offset_log.append(messages_of(spark, range(20)), str(tmp_path / "log"))
    running = log_stream(spark, tmp_path, wait="50 milliseconds")       # latest: only what comes after the start
    try:
        running.processAllAvailable()
        offset_log.append(messages_of(spark, range(20, 25)), str(tmp_path / "log"))
        running.processAllAvailable()
    finally:
        running.stop()
    assert {r.review_id for r in scorer.landed(spark, str(tmp_path / "out")).collect()} == {f"r{i}" for i in range(20, 25)}
    other = tmp_path / "other"
    other.mkdir()
    (other / "log").symlink_to(tmp_path / "log")
    log_stream(spark, other, from_beginning=True).awaitTermination()
    assert scorer.landed(spark, str(other / "out")).count() == 25
    with pytest.raises(ValueError, match="earliest or latest"):
        offset_log.LogReader({"path": "x", "startingOffsets": "middle"})


def test_lag_falls_to_zero_and_a_restart_goes_on(spark, tmp_path):
    path = str(tmp_path / "log")
    offset_log.append(messages_of(spark, range(40)), path, 3)
    log = progress.ProgressLog(head=lambda: offset_log.head(path))
    spark.streams.addListener(log)
    try:
        for bound in (20, None):
            stop = drain.Drain(bound)
            running = log_stream(spark, tmp_path, from_beginning=True, max_per_batch=10, wait="20 milliseconds", drain=stop)
            if bound is None:
                running.processAllAvailable()
                stop.request()
            stop.wait(running)
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(log)
    lags = [(rows, lag) for _, _, rows, _, lag in log.rows if rows]
    assert lags == [(10, 30), (10, 20), (10, 10), (10, 0)]
    rows = scorer.landed(spark, str(tmp_path / "out"))
    assert rows.count() == 40 and rows.select("review_id").distinct().count() == 40


def test_size_or_wait(tmp_path, spark):
    """The two sides: enough messages, or enough time."""
    path = str(tmp_path / "log")
    offset_log.append(messages_of(spark, range(4)), path, 1)
    reader = offset_log.LogReader({"path": path, "startingOffsets": "earliest", "minPerBatch": "5", "maxDelay": "3600", "maxPerBatch": "6"})
    assert reader.initialOffset() == {} and reader.latestOffset() == {}
    offset_log.append(messages_of(spark, range(4, 9)), path, 1)
    assert reader.latestOffset() == {"0": 6} == reader.latestOffset()       # three are left: too few
    reader.delay = 0.0
    assert reader.latestOffset() == {"0": 9}
    assert scorer.kafka_options({"subscribe": "t"}, True, 10, 5, 50) == {
        "subscribe": "t", "startingOffsets": "earliest", "maxOffsetsPerTrigger": "10", "minOffsetsPerTrigger": "5", "maxTriggerDelay": "50ms"}
    with pytest.raises(ValueError, match="no offsets"):
        scorer.read_messages(spark, "folder", min_per_batch=3)


def test_shares_of_a_batch_are_even():
    assert offset_log.shares({0: 5, 1: 100, 2: 1}, 0) == {0: 5, 1: 100, 2: 1}
    assert offset_log.shares({0: 5, 1: 100, 2: 1}, 20) == {2: 1, 0: 5, 1: 14}
    assert sum(offset_log.shares({p: 10 for p in range(7)}, 3).values()) == 3


# ---------------------------------------------------------------- bounded runs

def test_a_bounded_run_finishes_its_batch_and_loses_nothing(spark, folder):
    stop = drain.Drain(max_events=15)
    stop.wait(start(spark, folder, drain=stop))
    assert stop.events == 22 and scorer.landed(spark, str(folder / "out")).count() == 20
    rest = drain.Drain()
    rest.wait(start(spark, folder, drain=rest))
    assert rest.events == 22 and scorer.landed(spark, str(folder / "out")).select("review_id").distinct().count() == 40


def test_a_signal_drains_the_running_batch(spark, folder):
    stop = drain.Drain()
    restore = stop.on_signals(signal.SIGTERM)
    try:
        running = start(spark, folder, drain=stop, before_commit=lambda i: os.kill(os.getpid(), signal.SIGTERM) if i == 1 else None)
        stop.wait(running)
    finally:
        restore()
    assert not running.isActive and scorer.landed(spark, str(folder / "out")).count() == 20
    start(spark, folder).awaitTermination()
    assert scorer.landed(spark, str(folder / "out")).count() == 40


def test_other_failures_are_not_taken_for_a_stop(spark, folder):
    def fail(batch_id):
        raise RuntimeError("disk full")
    with pytest.raises(Exception, match="disk full"):
        drain.Drain().wait(start(spark, folder, before_commit=fail))


# ---------------------------------------------------------------- last N values

def test_last_n_on_a_stream_equals_the_batch_also_after_a_restart(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"k{rng.randrange(3)}" if rng.random() < 0.9 else None, i, rng.choice([None, rng.random() * 100])) for i in range(300)]
    df = spark.createDataFrame(rows, "kind string, at long, ms double")
    path, out = str(tmp_path / "log"), str(tmp_path / "out")
    offset_log.append(events.as_messages(df, "kind", ["kind", "at", "ms"]).withColumn("at", F.get_json_object("value", "$.at").cast("long")), path, 2, ("at",))
    schema = "kind string, at long, ms double"

    def run(bound):
        stop = drain.Drain(bound)
        stream = offset_log.read_log(spark, path, True, 40, position=str(tmp_path / "position.json")).select(F.from_json("value", schema).alias("e")).select("e.*")
        windows = last_values.last_n_latency(stream, "kind", ["at"], "ms", 7)

        def keep(batch, batch_id):
            scorer.write_batch(batch, batch_id, out)
            manifest.commit(spark, out, batch_id)
            return 40
        query = windows.writeStream.foreachBatch(stop.around(keep)).outputMode("append").option(
            "checkpointLocation", str(tmp_path / "ckpt")).trigger(processingTime="20 milliseconds").start()
        if bound is None:
            query.processAllAvailable()
            stop.request()
        stop.wait(query)
    run(120)
    assert 0 < scorer.landed(spark, out).count() < 130
    run(None)
    got = sorted(map(str, scorer.landed(spark, out).collect()))
    want = latency.rolling_latency(df, "kind", ["at"], "ms", 7)
    assert got == sorted(map(str, want.select("kind", "at", "n", *last_values.STATS).collect()))
