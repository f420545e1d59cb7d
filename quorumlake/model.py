"""The civic layer: cities, members, meetings, agenda items, votes, badges and web events over the driver's tables.

Every entity is a DataFrame with fixed columns; CIVIC_SQL states the same entities as SQL for the oracles.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.plans import storage

#: The date that stands for "today" in every query.
AS_OF = "1998-06-01"

_ACTION = [(0, "settlement"), (1, "zoning"), (2, "emergency_procurement"), (3, "appointment_board"), (4, "tax_abatement"), (5, "contract_award"), (6, "contract_amendment")]
_TITLES = {"1-URGENT": "Special Called Meeting", "2-HIGH": "Regular City Council Meeting", "3-MEDIUM": "Planning Commission", "4-NOT SPECIFIED": "Work Session - Cancelled by staff"}


def _sql_case(key: str, pairs, otherwise: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {a!r} THEN {b!r}" for a, b in pairs) + f" ELSE {otherwise} END"


def case(key: Column, pairs, otherwise) -> Column:
    out = F
    for a, b in pairs:
        out = out.when(key == a, b)
    return out.otherwise(otherwise)


CIVIC_SQL = {
    "city": "SELECT n_nationkey AS city_id, n_name AS city_name, lower(n_name) AS slug, r_name AS state, n_nationkey % 13 <> 12 AS active FROM nation JOIN region ON n_regionkey = r_regionkey",
    "member": """SELECT s_suppkey AS member_id, s_name AS member_name, s_nationkey AS city_id,
        CAST(DATE '1995-01-01' + CAST((s_suppkey % 5) * 200 AS INTEGER) AS DATE) AS term_start,
        CASE WHEN s_suppkey % 3 <> 0 THEN CAST(DATE '1995-01-01' + CAST((s_suppkey % 5) * 200 + 1500 AS INTEGER) AS DATE) END AS term_end,
        s_suppkey % 4 <> 0 AS active, CASE s_suppkey % 3 WHEN 0 THEN 'Democratic' WHEN 1 THEN 'Republican' ELSE 'Green' END AS party FROM supplier""",
    "meeting": f"""SELECT o_orderkey AS meeting_id, c_nationkey AS city_id, CAST(o_orderdate AS DATE) AS meeting_date,
        CASE WHEN o_orderkey % 4 <> 0 THEN CAST((9 + o_orderkey % 10) * 3600 AS BIGINT) END AS start_sec,
        {_sql_case("o_orderpriority", _TITLES.items(), "'Park Board'")} || ' (' || c_mktsegment || ')' AS title,
        o_orderkey % 29 = 0 AS is_hidden, CASE WHEN o_orderstatus = 'F' THEN CAST(CAST(o_orderdate AS DATE) + 14 AS DATE) END AS adopted_date,
        CASE WHEN o_orderkey % 7 = 0 THEN 'event-' ELSE '' END || CAST(o_orderkey AS VARCHAR) AS external_id
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "line": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity,
        l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn FROM lineitem) WHERE rn = 1""",
    "item": f"""SELECT l_orderkey * 10 + l_linenumber AS item_id, l_orderkey AS meeting_id,
        CAST(l_linenumber AS VARCHAR) || CASE WHEN l_partkey % 3 = 0 THEN 'A' ELSE '' END AS item_number,
        CASE WHEN p_size % 10 = 0 THEN 'Roll Call' WHEN p_size % 10 = 1 THEN 'Item ' || CAST(l_linenumber AS VARCHAR) || '. (Withdrawn)'
             ELSE 'A Resolution approving ' || p_name || ' with ' || p_brand || ' for $' || CAST(CAST(l_extendedprice AS DECIMAL(15,2)) AS VARCHAR)
                  || CASE WHEN l_partkey % 11 = 0 THEN ' million' ELSE '' END || ' (Submitted by ' || s_name || ')' END AS title,
        CASE WHEN p_size % 6 <> 0 THEN lower(p_type) || ' street ' || p_name || CASE WHEN l_partkey % 5 = 0 THEN ' emergency settlement' ELSE '' END END AS description,
        l_returnflag = 'A' AS is_consent, s_name AS sponsor, l_suppkey AS member_id, CAST(l_extendedprice AS DECIMAL(15,2)) AS dollars,
        lower(p_type) AS topic, CAST(p_size % 11 AS INTEGER) AS significance, CAST((p_size * 7) % 11 AS INTEGER) AS consent_score,
        CASE WHEN l_partkey % 17 = 0 THEN 'withdrawn' WHEN l_partkey % 23 = 0 THEN 'failed_permanent' WHEN l_linestatus = 'F' THEN 'completed' ELSE 'pending' END AS status,
        CASE WHEN p_size % 9 = 0 THEN 'empty' WHEN p_size % 9 = 1 THEN 'no_text_layer' WHEN p_size % 9 = 2 THEN NULL ELSE 'ok' END AS data_quality,
        CASE WHEN p_size % 4 = 0 THEN 'high' WHEN p_size % 4 = 1 THEN 'low' ELSE 'normal' END AS priority,
        CAST(l_suppkey % 5 AS INTEGER) AS ai_version, CAST(l_shipdate AS DATE) AS generated_on,
        {_sql_case("p_size % 8", _ACTION, "'other'")} AS action_type, CASE WHEN l_partkey % 4 = 0 THEN 'sole_source' ELSE 'bid' END AS procurement,
        p_name || ' ' || p_brand AS counterparty, CASE l_returnflag WHEN 'R' THEN 'yes' WHEN 'A' THEN 'nay' ELSE 'abstain' END AS position,
        CAST(l_linenumber * 600 + l_partkey % 300 AS BIGINT) AS video_sec
        FROM line JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""",
    "member_vote": "SELECT meeting_id AS vote_id, member_id, min(position) AS position FROM item GROUP BY ALL",
    "vote": """SELECT v.meeting_id AS vote_id, v.meeting_id, m.meeting_date, yeas, nays, abstentions, CASE WHEN yeas >= nays THEN 'passed' ELSE 'failed' END AS result
        FROM (SELECT meeting_id, count(*) FILTER (WHERE position = 'yes') AS yeas, count(*) FILTER (WHERE position = 'nay') AS nays,
              count(*) FILTER (WHERE position = 'abstain') AS abstentions FROM item GROUP BY meeting_id) v JOIN meeting m ON m.meeting_id = v.meeting_id""",
    "badge": """SELECT item_id, city_id, slug, kind, CAST((50 + significance * 5) / 100.0 AS DECIMAL(3,2)) AS confidence,
        CASE significance % 3 WHEN 0 THEN 'deterministic' WHEN 1 THEN 'llm' ELSE 'both' END AS source,
        CASE WHEN item_id % 5 = 0 THEN 'flagged' ELSE 'applied' END AS badge_status, generated_on AS detected_on
        FROM (SELECT item_id, meeting_id, significance, generated_on, 'high_dollar' AS slug, 'policy' AS kind FROM item WHERE dollars >= 50000
              UNION ALL SELECT item_id, meeting_id, significance, generated_on, 'sole_source', 'process' FROM item WHERE procurement = 'sole_source'
              UNION ALL SELECT item_id, meeting_id, significance, generated_on, 'hidden_on_consent', 'process' FROM item WHERE is_consent AND dollars >= 30000) b
        JOIN meeting USING (meeting_id)""",
    "web": """SELECT event_id, user_id AS session_id, ts, CAST(ts AS DATE) AS day, event_type, CASE WHEN event_type = 'view' THEN 1 ELSE 2 END AS kind, value, props,
        CASE WHEN user_id % 3 = 0 THEN '/al/town/meetings/' || CAST(event_id AS VARCHAR) WHEN user_id % 3 = 1 THEN '/al/town/items/' || CAST(event_id AS VARCHAR) || '/x' ELSE '/about' END AS url_path,
        CASE WHEN user_id % 4 = 0 THEN NULL ELSE 'ref' || CAST(user_id % 7 AS VARCHAR) || '.example' END AS referrer FROM events""",
    "ctx": """SELECT i.*, m.city_id, m.meeting_date, m.adopted_date, m.title AS meeting_title, c.slug, c.city_name
        FROM item i JOIN meeting m ON m.meeting_id = i.meeting_id JOIN city c ON c.city_id = m.city_id WHERE NOT m.is_hidden AND c.active""",
}


class Civic:
    """The civic layer of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def city(self) -> DataFrame:
        n, r = self.table("nation"), self.table("region")
        joined = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])  # five regions
        return joined.select(F.col("n_nationkey").alias("city_id"), F.col("n_name").alias("city_name"), F.lower("n_name").alias("slug"), F.col("r_name").alias("state"), (F.col("n_nationkey") % 13 != 12).alias("active"))

    @cached_property
    def member(self) -> DataFrame:
        start = ((F.col("s_suppkey") % 5) * 200).cast("int")
        base = F.lit("1995-01-01").cast("date")
        key = F.col("s_suppkey")
        return self.table("supplier").select(
            key.alias("member_id"), F.col("s_name").alias("member_name"), F.col("s_nationkey").alias("city_id"), F.date_add(base, start).alias("term_start"),
            F.when(key % 3 != 0, F.date_add(base, start + 1500)).alias("term_end"), (key % 4 != 0).alias("active"), case(key % 3, [(0, "Democratic"), (1, "Republican")], "Green").alias("party"),
        )

    @cached_property
    def meeting(self) -> DataFrame:
        o, c = self.table("orders"), self.table("customer")
        key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
        title = F.concat(case(F.col("o_orderpriority"), _TITLES.items(), "Park Board"), F.lit(" ("), F.col("c_mktsegment"), F.lit(")"))
        return o.join(c, o["o_custkey"] == c["c_custkey"]).select(
            key.alias("meeting_id"), F.col("c_nationkey").alias("city_id"), day.alias("meeting_date"), F.when(key % 4 != 0, ((9 + key % 10) * 3600).cast("long")).alias("start_sec"),
            title.alias("title"), (key % 29 == 0).alias("is_hidden"), F.when(F.col("o_orderstatus") == "F", F.date_add(day, 14)).alias("adopted_date"),
            F.concat(F.when(key % 7 == 0, "event-").otherwise(""), key.cast("string")).alias("external_id"),
        )

    @cached_property
    def item(self) -> DataFrame:
        """Agenda items, derived once for the files they come from and then read from the shared folder, column by column."""
        sources = [f"{self.sf_dir}/{t}.parquet" for t in ("lineitem", "part", "supplier")]
        return storage.stored(self.spark, "item", sources, self.derived_item) if storage.available(self.spark) else self.derived_item()

    def derived_item(self) -> DataFrame:
        line = self.table("lineitem")
        order = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
        # the smallest row of each key, found map-side; a minimum of structs sorts, but for no window and once, as items are stored
        line = line.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct(*order)).alias("r")).select("l_orderkey", "l_linenumber", "r.*")
        p, s = self.table("part"), self.table("supplier")
        joined = line.join(p, line["l_partkey"] == p["p_partkey"]).join(s, line["l_suppkey"] == s["s_suppkey"])
        size, part, number = F.col("p_size"), F.col("l_partkey"), F.col("l_linenumber").cast("string")
        dollars = F.col("l_extendedprice").cast("decimal(15,2)")
        title = F.concat(F.lit("A Resolution approving "), F.col("p_name"), F.lit(" with "), F.col("p_brand"), F.lit(" for $"), dollars.cast("string"), F.when(part % 11 == 0, " million").otherwise(""), F.lit(" (Submitted by "), F.col("s_name"), F.lit(")"))
        return joined.select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_id"), F.col("l_orderkey").alias("meeting_id"), F.concat(number, F.when(part % 3 == 0, "A").otherwise("")).alias("item_number"),
            F.when(size % 10 == 0, "Roll Call").when(size % 10 == 1, F.concat(F.lit("Item "), number, F.lit(". (Withdrawn)"))).otherwise(title).alias("title"),
            F.when(size % 6 != 0, F.concat(F.lower("p_type"), F.lit(" street "), F.col("p_name"), F.when(part % 5 == 0, " emergency settlement").otherwise(""))).alias("description"),
            (F.col("l_returnflag") == "A").alias("is_consent"), F.col("s_name").alias("sponsor"), F.col("l_suppkey").alias("member_id"), dollars.alias("dollars"), F.lower("p_type").alias("topic"),
            (size % 11).cast("int").alias("significance"), ((size * 7) % 11).cast("int").alias("consent_score"),
            F.when(part % 17 == 0, "withdrawn").when(part % 23 == 0, "failed_permanent").when(F.col("l_linestatus") == "F", "completed").otherwise("pending").alias("status"),
            F.when(size % 9 == 0, "empty").when(size % 9 == 1, "no_text_layer").when(size % 9 != 2, "ok").alias("data_quality"),
            F.when(size % 4 == 0, "high").when(size % 4 == 1, "low").otherwise("normal").alias("priority"), (F.col("l_suppkey") % 5).cast("int").alias("ai_version"),
            F.col("l_shipdate").cast("date").alias("generated_on"), case(size % 8, _ACTION, "other").alias("action_type"), F.when(part % 4 == 0, "sole_source").otherwise("bid").alias("procurement"),
            F.concat_ws(" ", "p_name", "p_brand").alias("counterparty"), case(F.col("l_returnflag"), [("R", "yes"), ("A", "nay")], "abstain").alias("position"),
            (F.col("l_linenumber") * 600 + part % 300).cast("long").alias("video_sec"),
        )

    @cached_property
    def member_vote(self) -> DataFrame:
        return self.item.groupBy(F.col("meeting_id").alias("vote_id"), "member_id").agg(F.min("position").alias("position"))

    @cached_property
    def vote(self) -> DataFrame:
        counts = self.item.groupBy("meeting_id").agg(*[F.count_if(F.col("position") == p).alias(n) for p, n in (("yes", "yeas"), ("nay", "nays"), ("abstain", "abstentions"))])
        return counts.join(self.meeting.select("meeting_id", "meeting_date"), "meeting_id").select(F.col("meeting_id").alias("vote_id"), "meeting_id", "meeting_date", "yeas", "nays", "abstentions", F.when(F.col("yeas") >= F.col("nays"), "passed").otherwise("failed").alias("result"))

    @cached_property
    def badge(self) -> DataFrame:
        return self.badge_rows.drop("significance")

    @cached_property
    def badge_rows(self) -> DataFrame:
        """Badges with the significance of their item, for those who would join it again."""
        rules = [("high_dollar", "policy", F.col("dollars") >= 50000), ("sole_source", "process", F.col("procurement") == "sole_source"), ("hidden_on_consent", "process", F.col("is_consent") & (F.col("dollars") >= 30000))]
        fired = F.array_compact(F.array(*[F.when(rule, F.struct(F.lit(slug).alias("slug"), F.lit(kind).alias("kind"))) for slug, kind, rule in rules]))
        rows = self.item.select("item_id", "meeting_id", "significance", "generated_on", F.explode(fired).alias("b")).join(self.meeting.select("meeting_id", "city_id"), "meeting_id")
        confidence = ((50 + F.col("significance") * 5) / 100).cast("decimal(3,2)")
        return rows.select("item_id", "city_id", "b.slug", "b.kind", confidence.alias("confidence"), case(F.col("significance") % 3, [(0, "deterministic"), (1, "llm")], "both").alias("source"), F.when(F.col("item_id") % 5 == 0, "flagged").otherwise("applied").alias("badge_status"), F.col("generated_on").alias("detected_on"), "significance")

    @cached_property
    def web(self) -> DataFrame:
        user, event = F.col("user_id"), F.col("event_id").cast("string")
        path = F.when(user % 3 == 0, F.concat(F.lit("/al/town/meetings/"), event)).when(user % 3 == 1, F.concat(F.lit("/al/town/items/"), event, F.lit("/x"))).otherwise("/about")
        return self.table("events").select(
            "event_id", user.alias("session_id"), "ts", F.col("ts").cast("date").alias("day"), "event_type", F.when(F.col("event_type") == "view", 1).otherwise(2).alias("kind"), "value", "props",
            path.alias("url_path"), F.when(user % 4 != 0, F.concat(F.lit("ref"), (user % 7).cast("string"), F.lit(".example"))).alias("referrer"),
        )

    def item_context(self) -> DataFrame:
        """Items with their visible meeting and active city: the common three-way join."""
        m = self.meeting.filter(~F.col("is_hidden")).withColumnRenamed("title", "meeting_title")
        return self.item.join(m, "meeting_id").join(F.broadcast(self.city.filter("active")), "city_id")  # a row a nation

