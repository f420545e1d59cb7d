"""The stateful processors over several micro-batches: back-off, guards, timers, and silence without new rows."""

import time

from pyspark.sql import functions as F

from quorumlake.streaming import web
from quorumlake.streaming.machines import freshness, status_log

HOUR = 3600 * 1000


def run(spark, base, batches, build):
    """All rows that build's stream gives over batches that arrive one after the other."""
    schema = "key long, event_id long, ts timestamp, command string"
    with web.rocks_state(spark):
        for rows in batches:
            frame = spark.createDataFrame([(k, i, float(h), c) for k, i, h, c in rows], "key long, event_id long, h double, command string")
            frame.select("key", "event_id", F.timestamp_millis((F.col("h") * HOUR).cast("long")).alias("ts"), "command").coalesce(1).write.mode("append").parquet(f"{base}/in")
            stream = spark.readStream.schema(schema).parquet(f"{base}/in").withWatermark("ts", "1 hour").withColumn("at", F.unix_millis("ts"))
            q = build(stream).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination()
    return spark.read.parquet(f"{base}/out").collect()


def test_back_off_guards_and_timers(spark, tmp_path):
    batches = [
        [(1, 1, 10, "claim"), (1, 2, 11, "fail"), (1, 3, 12, "claim"), (2, 4, 10, "finalise"), (3, 5, 10, "claim"), (3, 6, 11, "finalise"), (3, 7, 12, "finalise")],
        [(1, 8, 36, "claim"), (1, 9, 37, "fail"), (9, 10, 40, "claim")],
        [(9, 11, 90, "fail")],  # the watermark passes 61: the back-off of 1 ends without a command
        [(1, 12, 95, "claim"), (1, 13, 96, "fail"), (1, 14, 97, "claim"), (1, 15, 97, "requeue"), (1, 16, 98, "claim")],
    ]
    log = run(spark, str(tmp_path), batches, status_log)
    of = {k: [(r.event_id, r.from_status, r.status, r.attempts, r.outcome) for r in sorted(log, key=lambda r: r.seq) if r.key == k] for k in (1, 2, 3)}
    assert of[1] == [
        (1, "pending", "processing", 1, "claimed"),
        (2, "processing", "retry", 1, "failed"),
        (3, "retry", "retry", 1, "not_eligible"),
        (8, "retry", "processing", 2, "claimed"),
        (9, "processing", "retry", 2, "failed"),
        (None, "retry", "pending", 2, "backed_off"),
        (12, "pending", "processing", 3, "claimed"),
        (13, "processing", "failed_permanent", 3, "failed"),
        (14, "failed_permanent", "failed_permanent", 3, "not_eligible"),
        (15, "failed_permanent", "pending", 0, "requeued"),
        (16, "pending", "processing", 1, "claimed"),
    ]
    assert of[2] == [(4, "pending", "pending", 0, "lost_race")]
    assert of[3][-1] == (7, "completed", "completed", 1, "lost_race")


def test_silence_by_the_watermark(spark, tmp_path):
    batches = [[(1, 1, 100, ""), (2, 2, 100, "")], [(2, 3, 130, "")], [(2, 4, 300, "")]]
    got = sorted((r.key, r.at // HOUR - 100, r.state) for r in run(spark, str(tmp_path), batches, freshness))
    # a source whose next row comes before the watermark has passed its silence raises no alert
    assert got == [(1, 0, "good"), (1, 24, "warn"), (1, 168, "bad"), (2, 0, "good"), (2, 30, "good"), (2, 200, "good")]


def test_silence_by_the_clock_without_any_new_row(spark, tmp_path):
    spark.createDataFrame([(7, 1)], "key long, at long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key long, at long").parquet(str(tmp_path / "in"))
    with web.rocks_state(spark):
        q = freshness(stream, warn=2000, bad=4000, live=True).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(processingTime="1 second").start()
    try:
        states, until = [], time.time() + 120
        while len(states) < 3 and time.time() < until:
            time.sleep(2)
            if (tmp_path / "out" / "_spark_metadata").exists():
                states = [r.state for r in sorted(spark.read.schema("key long, at long, state string").parquet(str(tmp_path / "out")).collect(), key=lambda r: r.at)]
    finally:
        q.stop()
    assert states == ["good", "warn", "bad"]
