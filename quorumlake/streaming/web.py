"""Streaming twins of the web-analytics rollups: each runs over a file stream to its end and must equal its batch form."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.model import Civic
from quorumlake.operators.versions import VersionedTable, summed
from quorumlake.plans.registry import query
from quorumlake.plans.storage import new_folder
from quorumlake.streaming.machines import BAD_MS, BACK_OFF_MS, WARN_MS, freshness, status_log

DELAY = "1 day"


def event_stream(c: Civic) -> DataFrame:
    """The event log as a stream of files, with event time and watermark."""
    schema = c.table("events").schema
    stream = c.spark.readStream.schema(schema).parquet(f"{c.sf_dir}/events.parquet*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", DELAY)


def drain(frame: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there and return its result as a table.

    State, checkpoint and result go to the shared folder; no row passes through the driver. Appended rows are written by
    the file sink; a complete result overwrites the one of the batch before.
    """
    spark = frame.sparkSession
    name = new_folder(spark, "streams")
    result, schema = f"{name}/result", frame.schema
    writer = frame.writeStream.outputMode(mode).option("checkpointLocation", f"{name}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        q = writer.format("parquet").option("path", result).start()
    else:
        q = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(result)).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(result)


def drain_latest(frame: DataFrame, keys: list[str]) -> DataFrame:
    """Run a stream in update mode over what is there and return each key's last row, whichever batch it came with."""
    spark = frame.sparkSession
    name = new_folder(spark, "streams")
    result, values = f"{name}/result", [c for c in frame.columns if c not in keys]

    def store(batch: DataFrame, number: int) -> None:  # a batch that runs again writes the same folder again
        batch.write.mode("overwrite").parquet(f"{result}/batch={number}")

    writer = frame.writeStream.outputMode("update").option("checkpointLocation", f"{name}/checkpoint").trigger(availableNow=True)
    writer.foreachBatch(store).start().awaitTermination()
    rows = spark.read.schema(frame.schema.add("batch", "long")).parquet(result)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("last"))
    return last.select(*keys, *[F.col("last")[v].alias(v) for v in values])


def upsert_batches(frame: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """A stream whose micro-batches a caller merges into its tables."""
    return frame.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """State with timers is kept in RocksDB, on disk beside the executors, with its changes in the checkpoint folder."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@query("st_pageviews_tumbling", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1")
def st_pageviews_tumbling(c: Civic) -> DataFrame:
    counts = event_stream(c).filter("event_type = 'view'").groupBy(F.window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("n"))
    return drain_latest(counts.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "n"), ["hour"])


@query("st_sliding_recent", "SELECT strftime(s, '%Y-%m-%d') AS start, count(*) AS n FROM (SELECT unnest(generate_series(date_trunc('day', ts) - INTERVAL 6 DAY, date_trunc('day', ts), INTERVAL 1 DAY)) AS s FROM events) GROUP BY 1")
def st_sliding_recent(c: Civic) -> DataFrame:
    counts = event_stream(c).groupBy(F.window("ts", "7 days", "1 day")).agg(F.count(F.lit(1)).alias("n"))
    return drain_latest(counts.select(F.date_format("window.start", "yyyy-MM-dd").alias("start"), "n"), ["start"])


@query("st_sessionize", "SELECT user_id, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS hits FROM (SELECT user_id, span, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS span FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY ALL) GROUP BY 1")
def st_sessionize(c: Civic) -> DataFrame:
    """Session windows with a gap of two hours, then sessions and hits by user."""
    sessions = event_stream(c).groupBy(F.session_window("ts", "2 hours"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return drain(sessions.select("user_id", "n")).groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("hits"))


@query("st_dedup_ingest", "SELECT DISTINCT event_id FROM events")
def st_dedup_ingest(c: Civic) -> DataFrame:
    return drain(event_stream(c).dropDuplicatesWithinWatermark(["event_id"]).select("event_id"), "append")


@query("st_enrich_on_arrival", "SELECT event_id, CASE WHEN value >= 50 THEN 'high' ELSE 'low' END AS level, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def st_enrich_on_arrival(c: Civic) -> DataFrame:
    return drain(event_stream(c).select("event_id", F.when(F.col("value") >= 50, "high").otherwise("low").alias("level"), F.get_json_object("props", "$.k").try_cast("long").alias("k")), "append")


@query("st_stream_static_dim", "SELECT event_id, n_name AS place FROM events JOIN nation ON n_nationkey = user_id % 25")
def st_stream_static_dim(c: Civic) -> DataFrame:
    places = c.table("nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("place"))
    return drain(event_stream(c).select("event_id", (F.col("user_id") % 25).alias("k")).join(F.broadcast(places), "k").select("event_id", "place"), "append")


@query("st_event_props_join", "SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'purchase'")
def st_event_props_join(c: Civic) -> DataFrame:
    """Property rows joined to their event: two streams, watermarks on both, bounded by event time."""
    left = event_stream(c).filter("event_type = 'purchase'").select("event_id", "ts", "event_type")
    right = event_stream(c).select(F.col("event_id").alias("pid"), F.col("ts").alias("pts"), F.get_json_object("props", "$.k").try_cast("long").alias("k"))
    joined = left.join(right, F.expr("event_id = pid and pts >= ts - interval 1 hour and pts <= ts + interval 1 hour"))
    return drain(joined.select("event_id", "event_type", "k"), "append")


_WATERMARK_MS = "(SELECT epoch_ms(max(ts)) - 86400000 FROM events)"


@query("st_freshness_alert", f"""SELECT user_id, CASE WHEN last + {BAD_MS} <= {_WATERMARK_MS} THEN 'bad' WHEN last + {WARN_MS} <= {_WATERMARK_MS} THEN 'warn' ELSE 'good' END AS state
    FROM (SELECT user_id, epoch_ms(max(ts)) AS last FROM events GROUP BY 1)""")
def st_freshness_alert(c: Civic) -> DataFrame:
    """The last alert of each source, as of the watermark: timers fire for those that have been silent."""
    rows = event_stream(c).select(F.col("user_id").alias("key"), F.unix_millis("ts").alias("at"), "ts")
    with rocks_state(c.spark):
        alerts = drain(freshness(rows), "append")
    return alerts.groupBy(F.col("key").alias("user_id")).agg(F.max_by("state", "at").alias("state"))


@query("st_upsert_sink", "SELECT user_id, count(*) AS events, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1")
def st_upsert_sink(c: Civic) -> DataFrame:
    """Each micro-batch is merged into a table of totals by user, whose partitions it touches are written anew."""
    base = new_folder(c.spark, "upsert_stream")
    table = totals_table(c.spark, f"{base}/table")
    upsert_batches(event_stream(c), totals_merge(table), f"{base}/checkpoint").awaitTermination()
    return table.read()


def totals_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, "user_id long, events long, cents long", F.pmod(F.hash("user_id"), F.lit(16)))


def totals_merge(table: VersionedTable) -> Callable[[DataFrame, int], None]:
    """Adds a micro-batch's events to the totals as the version of the batch's number: once, however often it is run."""

    def merge(batch: DataFrame, number: int) -> None:
        cents = F.round(F.col("value") * 100).cast("long")
        table.merge(batch.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.sum(cents).alias("cents")), number, summed(["user_id"], ["events", "cents"]))

    return merge


#: Deliveries of the report below.
DELIVERIES = 4


@query("st_late_data_report", f""", dealt AS (SELECT user_id % {DELIVERIES} AS delivery, ts FROM events),
    seen AS (SELECT d.delivery, (SELECT max(ts) - INTERVAL 1 DAY FROM dealt e WHERE e.delivery < d.delivery) AS mark FROM (SELECT DISTINCT delivery FROM dealt) d)
    SELECT delivery, count(*) AS n, count(*) FILTER (WHERE epoch_ms(ts) <= epoch_ms(mark)) AS behind, count(*) FILTER (WHERE epoch_ms(ts) <= epoch_ms(mark)) AS dropped
    FROM dealt JOIN seen USING (delivery) GROUP BY 1""")
def st_late_data_report(c: Civic) -> DataFrame:
    """Rows by delivery, how many were behind the watermark when they came, and how many the engine dropped for it.

    Clients upload their logs in turn, one delivery a micro-batch, so that later ones bring old events. A side sink before
    the stateful step holds each batch against the greatest event time of the batches before; the engine's own count of
    dropped rows comes from the query's progress.
    """
    base, schema = new_folder(c.spark, "late_data"), c.table("events").schema
    for k in range(DELIVERIES):
        c.table("events").filter(F.col("user_id") % DELIVERIES == k).write.parquet(f"{base}/in/delivery={k}")
    return late_data_report(c.spark, [f"{base}/in/delivery={k}" for k in range(DELIVERIES)], schema, base)


def late_data_report(spark: SparkSession, deliveries: list[str], schema, base: str) -> DataFrame:
    """delivery, n, behind, dropped: a stream over folders that arrive one after the other, each drained before the next."""
    report, progress = f"{base}/report", []

    def side(batch: DataFrame, number: int) -> None:
        earlier = [f"{report}/delivery={k}" for k in range(len(progress))]
        if batch.isEmpty():
            return
        before = spark.read.parquet(*earlier).agg(F.max("newest").alias("mark")) if earlier else spark.createDataFrame([(None,)], "mark timestamp")
        judged = batch.join(F.broadcast(before))  # one row
        behind = F.unix_millis("ts") <= F.unix_millis(F.col("mark") - F.expr(f"interval {DELAY}"))
        judged.agg(F.count(F.lit(1)).alias("n"), F.count_if(behind).alias("behind"), F.max("ts").alias("newest")).write.mode("overwrite").parquet(f"{report}/delivery={len(progress)}")

    for k, folder in enumerate(deliveries):
        source = spark.read.schema(schema).parquet(folder)
        source.write.parquet(f"{base}/landing/{k}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/landing")
        stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
        watched = upsert_batches(stream, side, f"{base}/side")
        watched.awaitTermination()
        once = stream.withWatermark("ts", DELAY).dropDuplicatesWithinWatermark(["event_id"])
        q = once.writeStream.format("parquet").option("path", f"{base}/once").option("checkpointLocation", f"{base}/main").trigger(availableNow=True).start()
        q.awaitTermination()
        progress.append((k, sum(o["numRowsDroppedByWatermark"] for p in q.recentProgress for o in p["stateOperators"])))
    dropped = spark.createDataFrame(progress, "delivery long, dropped long")
    seen = spark.read.parquet(report).select(F.col("delivery").cast("long").alias("delivery"), "n", "behind")
    return seen.join(F.broadcast(dropped), "delivery")  # a row a delivery


_COMMANDS = [("signup", "claim"), ("view", "claim"), ("error", "fail"), ("purchase", "finalise"), ("click", "requeue")]
_COMMANDS_SQL = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _COMMANDS) + " END"


@query("st_status_machine", f""", cmd AS (SELECT user_id, epoch_ms(ts) AS t, {_COMMANDS_SQL} AS command, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS seq FROM events),
    m(user_id, seq, status, attempts, ready, outcome) AS (
        SELECT DISTINCT user_id, CAST(0 AS BIGINT), 'pending', 0, CAST(0 AS BIGINT), '' FROM events
        UNION ALL
        SELECT m.user_id, c.seq,
            CASE WHEN command = 'claim' AND (status = 'pending' OR (status = 'retry' AND t >= ready)) THEN 'processing'
                 WHEN command = 'fail' AND status = 'processing' THEN CASE WHEN attempts >= 3 THEN 'failed_permanent' ELSE 'retry' END
                 WHEN command = 'finalise' AND status = 'processing' THEN 'completed' WHEN command = 'requeue' AND status = 'failed_permanent' THEN 'pending' ELSE status END,
            CASE WHEN command = 'claim' AND (status = 'pending' OR (status = 'retry' AND t >= ready)) THEN attempts + 1 WHEN command = 'requeue' AND status = 'failed_permanent' THEN 0 ELSE attempts END,
            CASE WHEN command = 'fail' AND status = 'processing' THEN t + {BACK_OFF_MS} ELSE ready END,
            CASE WHEN command = 'claim' THEN CASE WHEN status = 'pending' OR (status = 'retry' AND t >= ready) THEN 'claimed' ELSE 'not_eligible' END
                 WHEN command = 'fail' AND status = 'processing' THEN 'failed' WHEN command = 'finalise' AND status = 'processing' THEN 'finalised'
                 WHEN command = 'requeue' AND status = 'failed_permanent' THEN 'requeued' ELSE 'lost_race' END
        FROM m JOIN cmd c ON c.user_id = m.user_id AND c.seq = m.seq + 1)
    SELECT user_id, CASE WHEN arg_max(status, seq) = 'retry' AND arg_max(ready, seq) <= {_WATERMARK_MS} THEN 'pending' ELSE arg_max(status, seq) END AS status, CAST(arg_max(attempts, seq) AS BIGINT) AS attempts,
        count(*) FILTER (WHERE outcome = 'claimed') AS claimed, count(*) FILTER (WHERE outcome = 'failed') AS failed, count(*) FILTER (WHERE outcome = 'finalised') AS finalised,
        count(*) FILTER (WHERE outcome = 'not_eligible') AS not_eligible, count(*) FILTER (WHERE outcome = 'lost_race') AS lost_race FROM m GROUP BY 1""", recursive=True)
def st_status_machine(c: Civic) -> DataFrame:
    """Where each item stands as of the watermark, its attempts, and how its commands ended.

    Events stand for commands: signups and views claim, errors fail, purchases finalise, clicks requeue."""
    command = F.coalesce(*[F.when(F.col("event_type") == a, b) for a, b in _COMMANDS])
    commands = event_stream(c).select(F.col("user_id").alias("key"), "event_id", F.unix_millis("ts").alias("at"), command.alias("command"), "ts")
    with rocks_state(c.spark):
        log = drain(status_log(commands), "append")
    outcomes = [F.count_if(F.col("outcome") == o).alias(o) for o in ("claimed", "failed", "finalised", "not_eligible", "lost_race")]
    last = F.max_by(F.struct("status", "attempts"), "seq").alias("last")
    return log.groupBy(F.col("key").alias("user_id")).agg(last, *outcomes).select("user_id", "last.status", F.col("last.attempts").cast("long").alias("attempts"), *["claimed", "failed", "finalised", "not_eligible", "lost_race"])
