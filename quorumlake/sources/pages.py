"""Rows from raw pages: listings, links, index points and JSON events as column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.model import Civic
from quorumlake.plans.registry import query


@query("src_json_events", "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.start') AS BIGINT), TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k FROM events")
def src_json_events(c: Civic) -> DataFrame:
    """A value under the first of several keys that holds one."""
    parsed = F.from_json("props", "struct<start: bigint, k: bigint>")
    return c.table("events").select("event_id", F.coalesce(parsed["start"], parsed["k"]).alias("k"))


@query("sink_feed_rows", "SELECT sha256('item|' || item_id) AS guid, title, CAST(meeting_date AS VARCHAR) AS published FROM ctx WHERE title ILIKE '%ring%'")
def sink_feed_rows(c: Civic) -> DataFrame:
    """Feed rows with a stable id."""
    return c.item_context().filter(F.col("title").ilike("%ring%")).select(F.sha2(F.concat_ws("|", F.lit("item"), F.col("item_id").cast("string")), 256).alias("guid"), "title", F.col("meeting_date").cast("string").alias("published"))
