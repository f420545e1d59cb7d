"""Merges and state changes as functions of frames: (current, incoming) -> next, with audit rows; and rollup refreshes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.model import AS_OF, Civic
from quorumlake.operators.aggregates import day
from quorumlake.operators.versions import VersionedTable
from quorumlake.plans.registry import query
from quorumlake.plans.storage import new_folder


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], keep_old_if_null: tuple[str, ...] = ()) -> DataFrame:
    """current with the rows of incoming written over those of equal keys, and the new ones added.

    A column of keep_old_if_null keeps its old value where the incoming one is null. Keys are unique on both sides.
    """
    new = incoming.select(*[F.col(c).alias(f"new_{c}") for c in incoming.columns])
    same = [current[k] == new[f"new_{k}"] for k in keys]
    arrives = F.col(f"new_{keys[0]}").isNotNull()
    both = current.join(new, same, "full_outer")
    columns = []
    for c in current.columns:
        fresh = F.col(f"new_{c}") if c in incoming.columns else current[c]
        value = F.coalesce(fresh, current[c]) if c in keep_old_if_null or c in keys else F.when(arrives, fresh).otherwise(current[c])
        columns.append(value.alias(c))
    return both.select(*columns)


_INCOMING = "SELECT meeting_id, CASE WHEN meeting_id % 2 = 0 THEN start_sec + 600 END AS start_sec, title || ' (revised)' AS title FROM meeting WHERE meeting_id % 5 = 0 UNION ALL SELECT -meeting_id, start_sec, title FROM meeting WHERE meeting_id % 50 = 1"


def incoming_meetings(c: Civic) -> DataFrame:
    """A later scrape: a fifth of the meetings again, some without a start, and some new ones."""
    key = F.col("meeting_id")
    again = c.meeting.filter(key % 5 == 0).select("meeting_id", F.when(key % 2 == 0, F.col("start_sec") + 600).alias("start_sec"), F.concat("title", F.lit(" (revised)")).alias("title"))
    return again.unionByName(c.meeting.filter(key % 50 == 1).select((-key).alias("meeting_id"), "start_sec", "title"))


@query("sink_upsert", f"SELECT coalesce(m.meeting_id, n.meeting_id) AS meeting_id, CASE WHEN n.meeting_id IS NOT NULL THEN n.title ELSE m.title END AS title, coalesce(n.start_sec, m.start_sec) AS start_sec FROM meeting m FULL JOIN ({_INCOMING}) n ON n.meeting_id = m.meeting_id")
def sink_upsert(c: Civic) -> DataFrame:
    """A later scrape merged into a stored table as its next version: only touched partitions are rewritten."""
    current = c.meeting.select("meeting_id", "title", "start_sec")
    table = VersionedTable(c.spark, new_folder(c.spark, "upsert"), current.schema, F.pmod(F.hash("meeting_id"), F.lit(32)))
    table.merge(current, 0, lambda held, new: new)
    table.merge(incoming_meetings(c), 1, lambda held, new: upsert(held, new, ["meeting_id"], ("start_sec",)))
    return table.read()


@query("mrg_finalize", """SELECT item_id, CASE WHEN status = 'pending' THEN 'completed' ELSE status END AS status, CASE WHEN status = 'pending' THEN least(10, significance + 1) ELSE significance END AS significance,
    CASE WHEN status = 'pending' THEN 'finalised' WHEN status = 'completed' THEN 'already_done' ELSE 'unexpected_status' END AS outcome FROM item""")
def mrg_finalize(c: Civic) -> DataFrame:
    """Scores and status of one pass, written together; only an item in the expected status changes."""
    expected = F.col("status") == "pending"
    outcome = F.when(expected, "finalised").when(F.col("status") == "completed", "already_done").otherwise("unexpected_status")
    score = F.when(expected, F.least(F.lit(10), F.col("significance") + 1)).otherwise(F.col("significance"))
    return c.item.select("item_id", F.when(expected, "completed").otherwise(F.col("status")).alias("status"), score.alias("significance"), outcome.alias("outcome"))


_ACTIONS_SQL = "SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'accept_first' WHEN 1 THEN 'accept_second' WHEN 2 THEN 'edit' ELSE 'prompt_again' END AS action FROM item WHERE significance <= 2"


@query("mrg_conflict_actions", f"""SELECT i.item_id, a.action, CASE WHEN i.status = 'completed' THEN 'lost_race' ELSE 'applied' END AS outcome,
    CASE WHEN i.status = 'completed' THEN i.status WHEN a.action = 'prompt_again' THEN 'pending' ELSE 'completed' END AS status,
    CASE WHEN i.status = 'completed' THEN i.significance WHEN a.action = 'accept_second' THEN i.consent_score WHEN a.action = 'edit' THEN 5 ELSE i.significance END AS significance
    FROM item i JOIN ({_ACTIONS_SQL}) a ON a.item_id = i.item_id""")
def mrg_conflict_actions(c: Civic) -> DataFrame:
    """A table of decisions applied to conflicts; what another has already finished is a lost race and stays."""
    names = F.when(F.col("item_id") % 4 == 0, "accept_first").when(F.col("item_id") % 4 == 1, "accept_second").when(F.col("item_id") % 4 == 2, "edit").otherwise("prompt_again")
    actions = c.item.filter("significance <= 2").select("item_id", names.alias("action"))
    rows = c.item.join(actions, "item_id")
    lost, action = F.col("status") == "completed", F.col("action")
    status = F.when(lost, F.col("status")).when(action == "prompt_again", "pending").otherwise("completed")
    score = F.when(lost, F.col("significance")).when(action == "accept_second", F.col("consent_score")).when(action == "edit", 5).otherwise(F.col("significance"))
    return rows.select("item_id", "action", F.when(lost, "lost_race").otherwise("applied").alias("outcome"), status.alias("status"), score.alias("significance"))


@query("mrg_status_flags", "SELECT coalesce(m.meeting_id, v.vote_id) AS meeting_id, m.meeting_id IS NOT NULL AS has_items, v.vote_id IS NOT NULL AS has_votes FROM (SELECT DISTINCT meeting_id FROM item WHERE NOT is_consent) m FULL JOIN (SELECT DISTINCT vote_id FROM member_vote WHERE position <> 'abstain') v ON v.vote_id = m.meeting_id")
def mrg_status_flags(c: Civic) -> DataFrame:
    """One row of stage flags a meeting, from both stages."""
    items = c.item.filter("not is_consent").select("meeting_id", F.lit(True).alias("has_items")).distinct()
    votes = c.member_vote.filter("position <> 'abstain'").select(F.col("vote_id").alias("meeting_id"), F.lit(True).alias("has_votes")).distinct()
    return items.join(votes, "meeting_id", "full_outer").select("meeting_id", *[F.coalesce(f, F.lit(False)).alias(f) for f in ("has_items", "has_votes")])


@query("mrg_reset_wave", "SELECT i.item_id, CASE WHEN ai_version = 2 THEN NULL ELSE significance END AS significance, CASE WHEN ai_version = 2 THEN 'pending' ELSE status END AS status, CASE WHEN ai_version = 2 THEN 0 ELSE coalesce(n, 0) END AS badges FROM item i LEFT JOIN (SELECT item_id, count(*) AS n FROM badge GROUP BY 1) b ON b.item_id = i.item_id")
def mrg_reset_wave(c: Civic) -> DataFrame:
    """One run's items lose what it wrote, and their badges."""
    wave = F.col("ai_version") == 2
    kept = c.badge.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    rows = c.item.join(kept, "item_id", "left")
    badges = F.when(wave, 0).otherwise(F.coalesce("n", F.lit(0)))
    return rows.select("item_id", F.when(~wave, F.col("significance")).alias("significance"), F.when(wave, "pending").otherwise(F.col("status")).alias("status"), badges.alias("badges"))


@query("mrg_cache_expire", f"SELECT item_id, CAST(generated_on AS VARCHAR) AS used FROM item WHERE generated_on >= DATE '{AS_OF}' - 90")
def mrg_cache_expire(c: Civic) -> DataFrame:
    """Cached answers used in the last ninety days stay."""
    return c.item.filter(F.col("generated_on") >= F.date_sub(day(), 90)).select("item_id", F.col("generated_on").cast("string").alias("used"))


@query("mrg_backfill_links", "SELECT m.meeting_id AS vote_id, i.item_id, 0.5::DOUBLE AS confidence FROM (SELECT meeting_id, min(item_id) AS item_id FROM item GROUP BY 1) i JOIN vote m ON m.meeting_id = i.meeting_id WHERE m.yeas <= m.nays")
def mrg_backfill_links(c: Civic) -> DataFrame:
    """Old single links become rows of the link table, with a middling confidence, unless the vote has links."""
    legacy = c.item.groupBy(F.col("meeting_id").alias("vote_id")).agg(F.min("item_id").alias("item_id"))
    linked = c.vote.filter("yeas > nays").select("vote_id")
    return legacy.join(linked, "vote_id", "left_anti").select("vote_id", "item_id", F.lit(0.5).alias("confidence"))


@query("sink_audit_append", f"SELECT item_id, 'queue' AS actor, action FROM ({_ACTIONS_SQL}) UNION ALL SELECT item_id, 'review', slug FROM badge WHERE badge_status = 'flagged'")
def sink_audit_append(c: Civic) -> DataFrame:
    """Audit rows of two change sets, appended one after the other to a table in the shared folder and read back."""
    names = F.when(F.col("item_id") % 4 == 0, "accept_first").when(F.col("item_id") % 4 == 1, "accept_second").when(F.col("item_id") % 4 == 2, "edit").otherwise("prompt_again")
    queue = c.item.filter("significance <= 2").select("item_id", F.lit("queue").alias("actor"), names.alias("action"))
    review = c.badge.filter("badge_status = 'flagged'").select("item_id", F.lit("review").alias("actor"), F.col("slug").alias("action"))
    path = new_folder(c.spark, "audit")
    for change in (queue, review):
        change.write.mode("append").parquet(path)
    return c.spark.read.schema(queue.schema).parquet(path)


@query("rollup_refresh", "SELECT CAST(date_trunc('month', generated_on) AS VARCHAR)[:7] AS month, topic, count(*) AS n FROM item GROUP BY ALL")
def rollup_refresh(c: Civic) -> DataFrame:
    """A stored rollup by month, brought up to date: only the months that new rows touch are computed and overwritten."""
    month = F.date_format("generated_on", "yyyy-MM").alias("month")
    rows = c.item.select(month, "topic", "item_id")
    rolled = lambda frame: frame.groupBy("month", "topic").agg(F.count(F.lit(1)).alias("n"))
    path = new_folder(c.spark, "rollup")
    late = rows.filter("item_id % 10 = 1 and month >= '1998-01'").select("month").distinct()
    old = rows.filter("not (item_id % 10 = 1 and month >= '1998-01')")
    rolled(old).repartition("month").write.partitionBy("month").parquet(path)
    touched = rolled(rows.join(late, "month", "left_semi"))
    touched.repartition("month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
    return c.spark.read.schema("topic string, n long, month string").parquet(path).select("month", "topic", "n")


@query("src_agenda_table_rows", f"SELECT meeting_id, string_agg(DISTINCT item_number, ',' ORDER BY item_number) AS assets FROM item JOIN meeting USING (meeting_id) WHERE meeting_date >= DATE '{AS_OF}' GROUP BY 1")
def src_agenda_table_rows(c: Civic) -> DataFrame:
    """Assets listed one a row, those of meetings since a date grouped to the meeting."""
    since = c.meeting.filter(F.col("meeting_date") >= day()).select("meeting_id")
    return c.item.join(since, "meeting_id").groupBy("meeting_id").agg(F.array_join(F.array_sort(F.collect_set("item_number")), ",").alias("assets"))


@query("src_sqlite_import", "SELECT m.meeting_id, i.item_id, CASE WHEN i.significance / 10.0 >= 0.8 THEN 'high' WHEN i.significance / 10.0 >= 0.5 THEN 'medium' ELSE 'low' END AS confidence FROM item i JOIN meeting m ON m.external_id = CAST(i.meeting_id AS VARCHAR) WHERE m.meeting_id NOT IN (SELECT vote_id FROM vote WHERE abstentions > 0)")
def src_sqlite_import(c: Civic) -> DataFrame:
    """Rows of another store, keyed by external id; meetings that hold imported votes already are left out."""
    known = c.meeting.select("meeting_id", F.col("external_id").alias("clip"))
    rows = c.item.select("item_id", F.col("meeting_id").cast("string").alias("clip"), "significance").join(known, "clip")
    done = c.vote.filter("abstentions > 0").select("meeting_id")
    sure = F.col("significance") / 10
    band = F.when(sure >= 0.8, "high").when(sure >= 0.5, "medium").otherwise("low")
    return rows.join(done, "meeting_id", "left_anti").select("meeting_id", "item_id", band.alias("confidence"))
