"""Windows, sorting, top-k, matching, merges, rollups and readers over the civic layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.functions import text as T
from quorumlake.model import Civic
from quorumlake.operators.aggregates import GATE_SQL, as_double, count_by, gated
from quorumlake.operators.rules import score_floors, triggers_sql
from quorumlake.plans.registry import query


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key in a total order, with their rank; Spark prunes ranks beyond n before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def asof_backward(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """left with the value of the last right row of its key at or before it (ties: the largest value).

    Both sides are united and carried forward by one window: no row is paired with many.
    """
    both = right.select(key, F.col(at).alias("_at"), F.lit(0).alias("_side"), F.col(value).alias("_value"), *[F.lit(None).cast(left.schema[c].dataType).alias(f"_l_{c}") for c in left.columns])
    mine = left.select(key, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_value"), *[F.col(c).alias(f"_l_{c}") for c in left.columns])
    over = Window.partitionBy(key).orderBy("_at", "_side", "_value").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.unionByName(mine).withColumn("_found", F.last("_value", ignorenulls=True).over(over)).filter("_side = 1")
    return carried.select(*[F.col(f"_l_{c}").alias(c) for c in left.columns], F.col("_found").alias(value))


@query("join_asof_backward", "SELECT v.meeting_id, v.video_sec, max(i.item_id) AS item_id FROM (SELECT meeting_id, CAST(1500 + meeting_id % 2000 AS BIGINT) AS video_sec FROM meeting) v LEFT JOIN item i ON i.meeting_id = v.meeting_id AND i.video_sec = (SELECT max(video_sec) FROM item j WHERE j.meeting_id = v.meeting_id AND j.video_sec <= v.video_sec) GROUP BY ALL")
def join_asof_backward(c: Civic) -> DataFrame:
    votes = c.meeting.select("meeting_id", (1500 + F.col("meeting_id") % 2000).alias("video_sec"))
    return asof_backward(votes, c.item.select("meeting_id", "video_sec", "item_id"), "meeting_id", "video_sec", "item_id")


@query("win_lag_week_delta", "SELECT action_type, CAST(week AS VARCHAR) AS week, n, n - lag(n) OVER (PARTITION BY action_type ORDER BY week) AS delta FROM (SELECT action_type, CAST(date_trunc('week', generated_on) AS DATE) AS week, count(*) AS n FROM item GROUP BY ALL HAVING count(*) >= 10)")
def win_lag_week_delta(c: Civic) -> DataFrame:
    """Weeks of low volume go before the lag is taken."""
    weeks = c.item.groupBy("action_type", F.trunc("generated_on", "week").alias("week")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 10")
    return weeks.select("action_type", F.col("week").cast("string").alias("week"), "n", (F.col("n") - F.lag("n").over(Window.partitionBy("action_type").orderBy("week"))).alias("delta"))


@query("win_drift_alert", "SELECT action_type, CAST(week AS VARCHAR) AS week FROM (SELECT action_type, week, a - lag(a) OVER w AS d, abs(n - lag(n) OVER w) / lag(n) OVER w AS v FROM (SELECT action_type, CAST(date_trunc('month', generated_on) AS DATE) AS week, count(*)::DOUBLE AS n, sum(significance)::DOUBLE / count(*) AS a FROM item GROUP BY ALL) WINDOW w AS (PARTITION BY action_type ORDER BY week)) WHERE d < -0.1 AND v < 0.3")
def win_drift_alert(c: Civic) -> DataFrame:
    months = c.item.groupBy("action_type", F.trunc("generated_on", "month").alias("week")).agg(F.count(F.lit(1)).cast("double").alias("n"), (F.sum("significance").cast("double") / F.count(F.lit(1))).alias("a"))
    w = Window.partitionBy("action_type").orderBy("week")
    moved = months.withColumn("d", F.col("a") - F.lag("a").over(w)).withColumn("v", F.abs(F.col("n") - F.lag("n").over(w)) / F.lag("n").over(w))
    return moved.filter("d < -0.1 and v < 0.3").select("action_type", F.col("week").cast("string").alias("week"))


@query("win_prevailing_vote", "SELECT member_id, vote_id, position FROM (SELECT mv.*, row_number() OVER (PARTITION BY member_id ORDER BY v.meeting_date DESC, v.vote_id DESC) AS rn FROM member_vote mv JOIN vote v ON v.vote_id = mv.vote_id) WHERE rn = 1")
def win_prevailing_vote(c: Civic) -> DataFrame:
    """The latest vote of each member: an aggregate, not a sort."""
    both = c.member_vote.join(c.vote.select("vote_id", "meeting_date"), "vote_id")
    last = both.groupBy("member_id").agg(F.max_by(F.struct("vote_id", "position"), F.struct("meeting_date", "vote_id")).alias("v"))
    return last.select("member_id", "v.vote_id", "v.position")


def dense_months(df: DataFrame, key: str, day: str, first: str, last: str) -> DataFrame:
    """Counts by key for every month of a window, 0 where there is none."""
    months = F.explode(F.sequence(F.trunc(F.lit(first).cast("date"), "month"), F.lit(last).cast("date"), F.expr("interval 1 month"))).alias("month")
    counts = df.groupBy(key, F.trunc(day, "month").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return df.select(key).distinct().select(key, months).join(counts, [key, "month"], "left").select(key, "month", F.coalesce("n", F.lit(0)).alias("n"))


DENSE = "SELECT k.city_id, m.month, count(b.item_id) AS n FROM (SELECT DISTINCT city_id FROM badge) k CROSS JOIN (SELECT CAST(unnest(generate_series(DATE '1997-01-01', DATE '1998-12-01', INTERVAL 1 MONTH)) AS DATE) AS month) m LEFT JOIN badge b ON b.city_id = k.city_id AND CAST(date_trunc('month', b.detected_on) AS DATE) = m.month GROUP BY ALL"


@query("win_dense_month_series", f"SELECT city_id, CAST(month AS VARCHAR) AS month, n FROM ({DENSE})")
def win_dense_month_series(c: Civic) -> DataFrame:
    return dense_months(c.badge, "city_id", "detected_on", "1997-01-01", "1998-12-01").withColumn("month", F.col("month").cast("string"))


@query("win_share_of_max", f"SELECT city_id, CAST(month AS VARCHAR) AS month, round(n::DOUBLE / nullif(max(n) OVER (PARTITION BY city_id), 0), 6) AS share FROM ({DENSE})")
def win_share_of_max(c: Civic) -> DataFrame:
    series = dense_months(c.badge, "city_id", "detected_on", "1997-01-01", "1998-12-01")
    peak = F.max("n").over(Window.partitionBy("city_id"))
    return series.select("city_id", F.col("month").cast("string").alias("month"), F.round(F.try_divide(F.col("n").cast("double"), peak), 6).alias("share"))


ISLANDS = "SELECT session_id, ts, sum(new) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS span FROM (SELECT session_id, event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY session_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM web)"


@query("win_gaps_islands", f"SELECT session_id, CAST(span AS BIGINT) AS span, count(*) AS hits FROM ({ISLANDS}) GROUP BY ALL")
def win_gaps_islands(c: Civic) -> DataFrame:
    """Spans of hits whose gaps are at most six hours."""
    w = Window.partitionBy("session_id").orderBy("ts", "event_id")
    new = F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("interval 6 hours"), 0).otherwise(1)
    spans = c.web.withColumn("new", new).withColumn("span", F.sum("new").over(w))
    return count_by(spans, "session_id", "span", name="hits")


@query("win_contiguous_runs", "SELECT session_id, event_type, count(*) AS length, min(event_id) AS first FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY session_id, event_type ORDER BY ts, event_id) AS g FROM web) GROUP BY session_id, event_type, g")
def win_contiguous_runs(c: Civic) -> DataFrame:
    a, b = Window.partitionBy("session_id").orderBy("ts", "event_id"), Window.partitionBy("session_id", "event_type").orderBy("ts", "event_id")
    runs = c.web.withColumn("g", F.row_number().over(a) - F.row_number().over(b))
    return runs.groupBy("session_id", "event_type", "g").agg(F.count(F.lit(1)).alias("length"), F.min("event_id").alias("first")).drop("g")


@query("win_last_valid_backward", "SELECT session_id, coalesce(arg_max(event_id, event_id) FILTER (WHERE event_type = 'purchase'), max(event_id)) AS event_id FROM web GROUP BY session_id")
def win_last_valid_backward(c: Civic) -> DataFrame:
    """The last complete record of a run, else its last."""
    return c.web.groupBy("session_id").agg(F.max_by("event_id", F.struct((F.col("event_type") == "purchase").alias("done"), "event_id")).alias("event_id"))


@query("win_top_n_per_group", "SELECT topic, item_id, rank FROM (SELECT topic, item_id, row_number() OVER (PARTITION BY topic ORDER BY dollars DESC, item_id) AS rank FROM item) WHERE rank <= 3")
def win_top_n_per_group(c: Civic) -> DataFrame:
    return top_per_key(c.item.select("topic", "item_id", "dollars"), ["topic"], [F.col("dollars").desc(), F.col("item_id")], 3).select("topic", "item_id", F.col("rank").cast("long").alias("rank"))


@query("win_best_with_margin", "SELECT meeting_id, item_id FROM (SELECT meeting_id, item_id, dollars, lead(dollars) OVER w AS second, row_number() OVER w AS rn FROM item WINDOW w AS (PARTITION BY meeting_id ORDER BY dollars DESC, item_id DESC)) WHERE rn = 1 AND (second IS NULL OR dollars >= 1.5 * second)")
def win_best_with_margin(c: Civic) -> DataFrame:
    w = Window.partitionBy("meeting_id").orderBy(F.col("dollars").desc(), F.col("item_id").desc())
    ranked = c.item.select("meeting_id", "item_id", "dollars", F.lead("dollars").over(w).alias("second"), F.row_number().over(w).alias("rn"))
    return ranked.filter("rn = 1 and (second is null or dollars >= 1.5 * second)").select("meeting_id", "item_id")


@query("win_unique_candidate", "SELECT min(meeting_id) AS meeting_id FROM meeting GROUP BY city_id, meeting_date HAVING count(*) = 1")
def win_unique_candidate(c: Civic) -> DataFrame:
    return c.meeting.groupBy("city_id", "meeting_date").agg(F.count(F.lit(1)).alias("n"), F.min("meeting_id").alias("meeting_id")).filter("n = 1").select("meeting_id")


@query("win_first_wins_dedup", "SELECT meeting_id, item_number, min(video_sec) AS video_sec FROM item GROUP BY ALL")
def win_first_wins_dedup(c: Civic) -> DataFrame:
    return c.item.groupBy("meeting_id", "item_number").agg(F.min("video_sec").alias("video_sec"))


@query("sort_natural_item_number", "SELECT item_id, row_number() OVER (PARTITION BY meeting_id ORDER BY coalesce(TRY_CAST(regexp_extract(item_number, '^([0-9]+)', 1) AS INTEGER), 999999), item_number, item_id) AS position FROM item")
def sort_natural_item_number(c: Civic) -> DataFrame:
    number = F.coalesce(F.regexp_extract("item_number", r"^(\d+)", 1).try_cast("int"), F.lit(999999))
    return c.item.select("item_id", F.row_number().over(Window.partitionBy("meeting_id").orderBy(number, "item_number", "item_id")).cast("long").alias("position"))


@query("sort_nulls", "SELECT meeting_id FROM meeting ORDER BY adopted_date DESC NULLS FIRST, meeting_id LIMIT 50")
def sort_nulls(c: Civic) -> DataFrame:
    return c.meeting.orderBy(F.col("adopted_date").desc_nulls_first(), "meeting_id").limit(50).select("meeting_id")


@query("topk_recency_dollars", "SELECT item_id FROM ctx WHERE meeting_date <= DATE '1998-06-01' ORDER BY CAST(dollars AS DOUBLE) / greatest(1, (DATE '1998-06-01' - meeting_date) / 90.0::DOUBLE) DESC, item_id LIMIT 20")
def topk_recency_dollars(c: Civic) -> DataFrame:
    day = F.lit("1998-06-01").cast("date")
    score = F.col("dollars").cast("double") / F.greatest(F.lit(1.0), F.datediff(day, "meeting_date") / 90.0)
    return c.item_context().filter(F.col("meeting_date") <= day).orderBy(score.desc(), "item_id").limit(20).select("item_id")


@query("sort_priority_rank", "SELECT item_id FROM item WHERE data_quality <> 'ok' ORDER BY CASE priority WHEN 'high' THEN 3 WHEN 'normal' THEN 2 WHEN 'low' THEN 1 ELSE 0 END DESC, generated_on DESC, item_id LIMIT 100")
def sort_priority_rank(c: Civic) -> DataFrame:
    rank = F.when(F.col("priority") == "high", 3).when(F.col("priority") == "normal", 2).when(F.col("priority") == "low", 1).otherwise(0)
    return c.item.filter("data_quality <> 'ok'").orderBy(rank.desc(), F.col("generated_on").desc(), "item_id").limit(100).select("item_id")


@query("page_offset", "SELECT meeting_id FROM meeting ORDER BY meeting_date DESC, meeting_id LIMIT 20 OFFSET 40")
def page_offset(c: Civic) -> DataFrame:
    return c.meeting.orderBy(F.col("meeting_date").desc(), "meeting_id").offset(40).limit(20).select("meeting_id")


@query("page_keyset_cursor", "SELECT meeting_id FROM meeting WHERE (meeting_date, meeting_id) < (DATE '1998-01-01', 500) ORDER BY meeting_date DESC, meeting_id DESC LIMIT 21")
def page_keyset_cursor(c: Civic) -> DataFrame:
    """The page after a cursor (base64 of date, bar, id), one row more than shown to tell whether another follows."""
    cursor = F.split(F.unbase64(F.base64(F.lit("1998-01-01|500").cast("binary"))).cast("string"), r"\|")
    before = F.struct("meeting_date", "meeting_id") < F.struct(cursor[0].cast("date").alias("meeting_date"), cursor[1].cast("long").alias("meeting_id"))
    return c.meeting.filter(before).orderBy(F.col("meeting_date").desc(), F.col("meeting_id").desc()).limit(21).select("meeting_id")


@query("topk_per_key_recent", "SELECT city_id, vote_id FROM (SELECT m.city_id, v.vote_id, row_number() OVER (PARTITION BY m.city_id ORDER BY v.meeting_date DESC, v.vote_id DESC) AS rank FROM vote v JOIN meeting m ON m.meeting_id = v.meeting_id WHERE v.nays > 0) WHERE rank <= 5")
def topk_per_key_recent(c: Civic) -> DataFrame:
    votes = c.vote.filter("nays > 0").join(c.meeting.select("meeting_id", "city_id"), "meeting_id")
    return top_per_key(votes, ["city_id"], [F.col("meeting_date").desc(), F.col("vote_id").desc()], 5).select("city_id", "vote_id")


# ---- matching ----


def prior_contracts(c: Civic, least: float = 0.6) -> DataFrame:
    """Amendments with an earlier award in the same city whose counterparty is similar.

    A set-similarity join: two trigram sets of similarity t share a trigram among the first n - ceil(t n) + 1 of both in
    a common order, here that of rising frequency, so only these prefixes are exploded and joined; sizes and places in
    the order rule most pairs out, the others are verified in full. Distinct names stand for their items and cities.
    """
    rows = c.item_context().select("item_id", "city_id", "meeting_date", "action_type", "dollars", F.lower(F.trim("counterparty")).alias("name"))
    awards = rows.filter("action_type = 'contract_award' and dollars > 0 and name <> ''").groupBy("city_id", "name").agg(F.min("meeting_date").alias("first"))
    amended = rows.filter("action_type = 'contract_amendment' and name <> ''").groupBy("city_id", "name").agg(F.max("meeting_date").alias("latest"))

    # each name's trigrams once, the rarest first: a prefix of rare ones meets few others
    names = awards.select("name").union(amended.select("name")).distinct()
    each = names.select("name", F.explode(T.trigrams(F.col("name"))).alias("gram"))
    counted = each.join(each.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram")
    ordered = counted.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "gram"))), lambda x: x["gram"]).alias("g")).withColumn("size", F.size("g"))

    def prefixed(role: str, sets: str) -> DataFrame:
        prefix = F.slice("g", F.lit(1), (F.col("size") - F.ceil(F.col("size") * least) + 1).cast("int"))
        return ordered.select(F.col("name").alias(role), F.col("size").alias(sets), F.posexplode(prefix).alias(f"at_{role}", "gram"))

    met = prefixed("a", "n_a").join(prefixed("b", "n_b"), "gram")
    # sets of very different sizes can't be similar, nor can those whose rests are too short from the shared gram on
    bound = least / (1 + least) * (F.col("n_a") + F.col("n_b"))
    rest = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) + F.least("at_a", "at_b")
    close = met.filter((F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b")) & (rest >= bound - 1e-9)).select("a", "b").distinct()
    sets = close.join(ordered.select(F.col("name").alias("a"), F.col("g").alias("x")), "a").join(ordered.select(F.col("name").alias("b"), F.col("g").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    verified = sets.filter(shared.cast("double") / (F.size("x") + F.size("y") - shared) >= least).select("a", "b")
    similar = amended.select("city_id", F.col("name").alias("a")).join(verified, "a")
    earliest = similar.join(awards.withColumnRenamed("name", "b"), ["city_id", "b"]).groupBy("city_id", F.col("a").alias("name")).agg(F.min("first").alias("first"))
    return rows.filter("action_type = 'contract_amendment'").join(earliest, ["city_id", "name"]).filter("first < meeting_date").select("item_id").distinct()


_G = "list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower(trim({0})), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query("mat_prior_contract", f"""SELECT DISTINCT a.item_id FROM (SELECT item_id, city_id, meeting_date, {_G.format('counterparty')} AS g FROM ctx WHERE action_type = 'contract_amendment' AND trim(counterparty) <> '') a
    JOIN (SELECT city_id, min(meeting_date) AS first, {_G.format('counterparty')} AS g FROM ctx WHERE action_type = 'contract_award' AND dollars > 0 AND trim(counterparty) <> '' GROUP BY city_id, counterparty) b ON a.city_id = b.city_id AND b.first < a.meeting_date
    WHERE len(list_intersect(a.g, b.g))::DOUBLE / len(list_distinct(list_concat(a.g, b.g))) >= 0.6""")
def mat_prior_contract(c: Civic) -> DataFrame:
    return prior_contracts(c)


@query("mat_adoption", "SELECT m.meeting_id, min(t.meeting_id) AS target FROM meeting m JOIN meeting t ON t.city_id = m.city_id AND t.meeting_date = m.meeting_date - 14 WHERE m.adopted_date IS NOT NULL GROUP BY 1 HAVING count(*) = 1")
def mat_adoption(c: Civic) -> DataFrame:
    """The one earlier meeting of the city on the day whose minutes are adopted."""
    named = c.meeting.filter("adopted_date is not null").select("meeting_id", "city_id", F.date_sub("meeting_date", 14).alias("day"))
    targets = c.meeting.select("city_id", F.col("meeting_date").alias("day"), F.col("meeting_id").alias("target"))
    return named.join(targets, ["city_id", "day"]).groupBy("meeting_id").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("target")).filter("n = 1").drop("n")


@query("mat_event_archive", "SELECT a.meeting_id, min(e.meeting_id) AS event_id FROM meeting a JOIN meeting e ON e.city_id = a.city_id AND e.meeting_date = a.meeting_date AND e.external_id LIKE 'event-%' WHERE a.external_id NOT LIKE 'event-%' GROUP BY 1 HAVING count(*) = 1")
def mat_event_archive(c: Civic) -> DataFrame:
    events = c.meeting.filter("external_id like 'event-%'").select("city_id", "meeting_date", F.col("meeting_id").alias("event_id"))
    single = events.groupBy("city_id", "meeting_date").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("event_id")).filter("n = 1").drop("n")
    return c.meeting.filter("external_id not like 'event-%'").join(single, ["city_id", "meeting_date"]).select("meeting_id", "event_id")


@query("mat_backfill_timestamps", "SELECT i.item_id, coalesce(CASE WHEN i.item_id % 3 <> 0 THEN i.video_sec END, f.video_sec) AS video_sec FROM item i JOIN (SELECT meeting_id, item_number, min(video_sec) AS video_sec FROM item GROUP BY ALL) f USING (meeting_id, item_number)")
def mat_backfill_timestamps(c: Civic) -> DataFrame:
    first = c.item.groupBy("meeting_id", "item_number").agg(F.min("video_sec").alias("found"))
    known = F.when(F.col("item_id") % 3 != 0, F.col("video_sec"))
    return c.item.join(first, ["meeting_id", "item_number"], "left").select("item_id", F.coalesce(known, "found").alias("video_sec"))


# ---- merges, as functions of (current, incoming) ----


def upsert(current: DataFrame, incoming: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """Incoming columns win where not null, but for those in keep, which only fill gaps."""
    new = incoming.select(F.col(key), *[F.col(x).alias(f"_{x}") for x in incoming.columns if x != key])
    pick = lambda x: F.coalesce(x, f"_{x}") if x in keep else F.coalesce(f"_{x}", x)
    return current.join(new, key, "full_outer").select(key, *[pick(x).alias(x) for x in current.columns if x != key])


@query("mrg_meetings", "SELECT meeting_id, CASE WHEN meeting_id % 2 = 0 THEN 'New ' || title ELSE title END AS title, coalesce(start_sec, CASE WHEN meeting_id % 2 = 0 THEN 1 END) AS start_sec FROM meeting UNION ALL SELECT -meeting_id - 1, 'New ' || title, CAST(1 AS BIGINT) FROM meeting WHERE meeting_id % 100 = 0")
def mrg_meetings(c: Civic) -> DataFrame:
    current = c.meeting.select("meeting_id", "title", "start_sec")
    new = lambda key: [key.alias("meeting_id"), F.concat(F.lit("New "), "title").alias("title"), F.lit(1).cast("long").alias("start_sec")]
    incoming = c.meeting.filter("meeting_id % 2 = 0").select(*new(F.col("meeting_id"))).unionByName(c.meeting.filter("meeting_id % 100 = 0").select(*new(-F.col("meeting_id") - 1)))
    return upsert(current, incoming, "meeting_id", ["start_sec"])


@query("mrg_items_insert_ignore", "SELECT item_id, 'old' AS origin FROM item WHERE item_id % 2 = 0 UNION ALL SELECT item_id, 'new' FROM item WHERE item_id % 2 <> 0 AND item_id % 3 = 0")
def mrg_items_insert_ignore(c: Civic) -> DataFrame:
    current = c.item.filter("item_id % 2 = 0").select("item_id", F.lit("old").alias("origin"))
    incoming = c.item.filter("item_id % 3 = 0").select("item_id", F.lit("new").alias("origin"))
    return current.unionByName(incoming.join(current, "item_id", "left_anti"))


@query("mrg_links_shielded", "SELECT item_id, CASE WHEN item_id % 5 = 0 THEN 0.5 ELSE 0.9 END::DOUBLE AS confidence FROM item")
def mrg_links_shielded(c: Civic) -> DataFrame:
    """Manual links never change."""
    current = c.item.select("item_id", (F.col("item_id") % 5 == 0).alias("is_manual"), F.lit(0.5).alias("confidence"))
    incoming = c.item.select("item_id", F.lit(0.9).alias("_new"))
    return current.join(incoming, "item_id", "full_outer").select("item_id", F.when(F.col("is_manual"), F.col("confidence")).otherwise(F.coalesce("_new", "confidence")).alias("confidence"))


@query("mrg_prune_retention", "SELECT event_id FROM web WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'")
def mrg_prune_retention(c: Civic) -> DataFrame:
    return c.web.filter(F.col("ts") >= F.lit("2024-01-15").cast("timestamp")).select("event_id")


@query("mrg_claim_session", "SELECT item_id, CAST((row_number() OVER (PARTITION BY topic ORDER BY item_id) - 1) // 100 AS BIGINT) AS chunk FROM item WHERE status = 'pending'")
def mrg_claim_session(c: Civic) -> DataFrame:
    """Pending items stamped with chunks of a hundred within each topic."""
    number = F.row_number().over(Window.partitionBy("topic").orderBy("item_id")) - 1
    return c.item.filter("status = 'pending'").select("item_id", F.floor(number / 100).alias("chunk"))


@query("mrg_queue_actions", "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'pending' ELSE 'escalated' END AS status, CASE WHEN item_id % 2 = 0 THEN 'retry' ELSE 'escalate' END AS action FROM item WHERE status = 'failed_permanent'")
def mrg_queue_actions(c: Civic) -> DataFrame:
    actions = c.item.filter("status = 'failed_permanent'").select("item_id", F.when(F.col("item_id") % 2 == 0, "retry").otherwise("escalate").alias("action"))
    return c.item.select("item_id").join(actions, "item_id").select("item_id", F.when(F.col("action") == "retry", "pending").otherwise("escalated").alias("status"), "action")


@query("cls_llm_only_flag", "SELECT item_id, slug, CASE WHEN kind = 'policy' AND source = 'llm' AND badge_status = 'applied' THEN 'flagged' ELSE badge_status END AS badge_status FROM badge")
def cls_llm_only_flag(c: Civic) -> DataFrame:
    hit = (F.col("kind") == "policy") & (F.col("source") == "llm") & (F.col("badge_status") == "applied")
    return c.badge.select("item_id", "slug", F.when(hit, "flagged").otherwise(F.col("badge_status")).alias("badge_status"))


_FACTS_SQL = f""", facts AS (SELECT *, CAST(consent_score AS INTEGER) AS parcels, significance * 1.5 AS acres, CASE WHEN topic = 'promo' AND priority = 'high' THEN ['public_safety_tech_privacy'] END AS suggested_badges FROM item),
    {triggers_sql('facts')}"""


def scored_items(c: Civic) -> DataFrame:
    """Items with the facts that scoring asks for, derived from the civic layer, after all rules."""
    suggested = F.when((F.col("topic") == "promo") & (F.col("priority") == "high"), F.array(F.lit("public_safety_tech_privacy")))
    facts = {"parcels": F.col("consent_score").cast("int"), "acres": F.col("significance") * 1.5, "suggested_badges": suggested}
    return score_floors(c.item.withColumns(facts))


@query("cls_score_floors", f"""{_FACTS_SQL} SELECT i.item_id, greatest(significance, coalesce(max(post) FILTER (WHERE field = 'significance'), significance)) AS significance,
    least(consent_score, coalesce(min(post) FILTER (WHERE field = 'consent_placement'), consent_score)) AS consent_score FROM item i LEFT JOIN trigger t ON t.item_id = i.item_id GROUP BY i.item_id, significance, consent_score""")
def cls_score_floors(c: Civic) -> DataFrame:
    """Floors only raise significance, ceilings only lower consent placement."""
    return scored_items(c).select("item_id", "significance", "consent_score")


def fired_rules(scored: DataFrame) -> DataFrame:
    """item_id, trigger, field, pre, post. Outer and inline: for the size of exploded lists, and for each of their fields asked for,
    the rules would run anew."""
    return scored.select("item_id", F.inline_outer("fired")).filter("trigger is not null")


@query("cls_score_triggers", f"{_FACTS_SQL} SELECT item_id, trigger, field, pre, post FROM trigger")
def cls_score_triggers(c: Civic) -> DataFrame:
    """The triggers that changed a score, with the score before and after."""
    return fired_rules(scored_items(c))


@query("agg_unnest_triggers", f"{_FACTS_SQL} SELECT trigger, field, count(*) AS n FROM trigger GROUP BY ALL")
def agg_unnest_triggers(c: Civic) -> DataFrame:
    return count_by(fired_rules(scored_items(c)), "trigger", "field")


@query("cls_badge_decision", "SELECT item_id, CASE WHEN l AND d THEN 1.0 WHEN d THEN 0.8 WHEN l THEN 0.4 END::DOUBLE AS confidence, CASE WHEN l AND d THEN 'both' WHEN d THEN 'deterministic' ELSE 'llm' END AS source FROM (SELECT item_id, item_id % 2 = 0 AS l, dollars >= 50000 AS d FROM item) WHERE l OR d")
def cls_badge_decision(c: Civic) -> DataFrame:
    llm = c.item.filter("item_id % 2 = 0").select("item_id", F.lit(True).alias("l"))
    rule = c.item.filter("dollars >= 50000").select("item_id", F.lit(True).alias("d"))
    both = F.col("l").isNotNull() & F.col("d").isNotNull()
    return llm.join(rule, "item_id", "full_outer").select("item_id", F.when(both, 1.0).when(F.col("d").isNotNull(), 0.8).otherwise(0.4).alias("confidence"), F.when(both, "both").when(F.col("d").isNotNull(), "deterministic").otherwise("llm").alias("source"))


@query("cls_infer_result", "SELECT vote_id, CASE WHEN yeas > nays THEN 'passed' WHEN nays > yeas THEN 'failed' WHEN abstentions > 0 THEN 'tabled' END AS result FROM vote")
def cls_infer_result(c: Civic) -> DataFrame:
    return c.vote.select("vote_id", F.expr("case when yeas > nays then 'passed' when nays > yeas then 'failed' when abstentions > 0 then 'tabled' end").alias("result"))


@query("cls_validate_rewrite", "SELECT item_id, concat_ws(',', CASE WHEN length(title) > 80 THEN 'title_long' END, CASE WHEN description IS NULL THEN 'no_description' END, CASE WHEN significance NOT BETWEEN 0 AND 9 THEN 'score_range' END) AS broken FROM item")
def cls_validate_rewrite(c: Civic) -> DataFrame:
    rules = [("title_long", F.length("title") > 80), ("no_description", F.col("description").isNull()), ("score_range", ~F.col("significance").between(0, 9))]
    return c.item.select("item_id", F.array_join(F.array_compact(F.array(*[F.when(broken, name) for name, broken in rules])), ",").alias("broken"))


# ---- rollups and readers ----


@query("mv_badge_volume_monthly", f"SELECT i.city_id, b.slug AS badge, CAST(CAST(date_trunc('month', i.meeting_date) AS DATE) AS VARCHAR) AS month, count(*) AS items, count(*) FILTER (WHERE i.is_consent) AS consent, CAST(sum(i.dollars) AS DOUBLE) AS dollars FROM badge b JOIN ctx i ON i.item_id = b.item_id WHERE {GATE_SQL} GROUP BY ALL")
def mv_badge_volume_monthly(c: Civic) -> DataFrame:
    return gated(c).groupBy("city_id", F.col("slug").alias("badge"), F.trunc("meeting_date", "month").cast("string").alias("month")).agg(F.count(F.lit(1)).alias("items"), F.count_if("is_consent").alias("consent"), as_double(F.sum("dollars")).alias("dollars"))


@query("mv_city_backfill_ratio", "SELECT c.slug, round(count(*) FILTER (WHERE i.status = 'completed' AND i.ai_version >= 3)::DOUBLE / nullif(count(i.item_id) FILTER (WHERE i.status <> 'failed_permanent'), 0), 6) AS ratio FROM city c LEFT JOIN meeting m ON m.city_id = c.city_id LEFT JOIN item i ON i.meeting_id = m.meeting_id GROUP BY c.slug")
def mv_city_backfill_ratio(c: Civic) -> DataFrame:
    counts = c.item.join(c.meeting.select("meeting_id", "city_id"), "meeting_id").groupBy("city_id").agg(F.count_if((F.col("status") == "completed") & (F.col("ai_version") >= 3)).alias("done"), F.count_if(F.col("status") != "failed_permanent").alias("all"))
    return c.city.join(counts, "city_id", "left").select("slug", F.round(F.try_divide(F.col("done").cast("double"), F.col("all")), 6).alias("ratio"))


@query("view_pageviews_daily", "SELECT CAST(day AS VARCHAR) AS day, regexp_replace(regexp_replace(url_path, '/meetings/[0-9]+', '/meetings/[id]'), '/items/[0-9]+', '/items/[id]') AS path, count(*) AS pageviews, count(DISTINCT session_id) AS sessions FROM web WHERE kind = 1 GROUP BY ALL")
def view_pageviews_daily(c: Civic) -> DataFrame:
    return c.web.filter("kind = 1").groupBy(F.col("day").cast("string").alias("day"), T.normalize_path(F.col("url_path")).alias("path")).agg(F.count(F.lit(1)).alias("pageviews"), F.count_distinct("session_id").alias("sessions"))


@query("view_event_counts_daily", "SELECT CAST(day AS VARCHAR) AS day, event_type, count(*) AS n, count(DISTINCT session_id) AS sessions FROM web WHERE kind = 2 GROUP BY ALL")
def view_event_counts_daily(c: Civic) -> DataFrame:
    return c.web.filter("kind = 2").groupBy(F.col("day").cast("string").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("session_id").alias("sessions"))


@query("view_referrers_daily", "SELECT CAST(day AS VARCHAR) AS day, referrer, count(*) AS n FROM web WHERE referrer IS NOT NULL GROUP BY ALL")
def view_referrers_daily(c: Civic) -> DataFrame:
    return count_by(c.web.filter("referrer is not null").withColumn("day", F.col("day").cast("string")), "day", "referrer")


@query("view_geo_daily", "SELECT CAST(day AS VARCHAR) AS day, n.n_name AS place, count(*) AS n FROM web JOIN nation n ON n.n_nationkey = session_id % 25 GROUP BY ALL")
def view_geo_daily(c: Civic) -> DataFrame:
    places = c.table("nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("place"))
    return count_by(c.web.select(F.col("day").cast("string").alias("day"), (F.col("session_id") % 25).alias("k")).join(F.broadcast(places), "k"), "day", "place")


@query("q_municipalities", "SELECT c.slug, c.state, count(m.meeting_id) AS meetings FROM city c LEFT JOIN meeting m ON m.city_id = c.city_id AND NOT m.is_hidden WHERE c.active GROUP BY ALL")
def q_municipalities(c: Civic) -> DataFrame:
    n = count_by(c.meeting.filter("not is_hidden"), "city_id")
    return c.city.filter("active").join(n, "city_id", "left").select("slug", "state", F.coalesce("n", F.lit(0)).alias("meetings"))


@query("q_votes", "SELECT vote_id, string_agg(member_id::VARCHAR || ':' || position, ',' ORDER BY member_id) AS positions FROM member_vote GROUP BY vote_id")
def q_votes(c: Civic) -> DataFrame:
    nested = F.array_sort(F.collect_list(F.struct("member_id", "position")))
    return c.member_vote.groupBy("vote_id").agg(F.array_join(F.transform(nested, lambda s: F.concat_ws(":", s["member_id"].cast("string"), s["position"])), ",").alias("positions"))


@query("q_member_history", "SELECT mv.member_id, mv.vote_id, CAST(v.meeting_date AS VARCHAR) AS meeting_date, mv.position FROM member_vote mv JOIN vote v ON v.vote_id = mv.vote_id WHERE (mv.position = 'yes') <> (v.result = 'passed') AND mv.position <> 'abstain'")
def q_member_history(c: Civic) -> DataFrame:
    """Dissent only: positions against the result."""
    against = (F.col("position") != "abstain") & ((F.col("position") == "yes") != (F.col("result") == "passed"))
    return c.member_vote.join(c.vote.select("vote_id", "meeting_date", "result"), "vote_id").filter(against).select("member_id", "vote_id", F.col("meeting_date").cast("string").alias("meeting_date"), "position")


@query("q_sponsored_count", "SELECT sponsor, count(*) AS n FROM item GROUP BY sponsor")
def q_sponsored_count(c: Civic) -> DataFrame:
    return count_by(c.item, "sponsor")


@query("q_items_by_badge", f"SELECT i.slug AS city, b.slug AS badge, b.item_id FROM badge b JOIN ctx i ON i.item_id = b.item_id WHERE {GATE_SQL} AND i.meeting_date >= DATE '1998-01-01' AND i.meeting_date < DATE '1999-01-01'")
def q_items_by_badge(c: Civic) -> DataFrame:
    return gated(c).filter("meeting_date >= date'1998-01-01' and meeting_date < date'1999-01-01'").select(F.col("city_slug").alias("city"), F.col("slug").alias("badge"), "item_id")


@query("q_calib_underscoring", "SELECT action_type, count(*) AS n, round(100.0 * count(*) FILTER (WHERE consent_score - significance > 3) / count(*), 1)::DOUBLE AS pct FROM item WHERE status = 'completed' GROUP BY 1 HAVING count(*) >= 30 AND count(*) FILTER (WHERE consent_score - significance > 3) > 0.2 * count(*)")
def q_calib_underscoring(c: Civic) -> DataFrame:
    counts = c.item.filter("status = 'completed'").groupBy("action_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("consent_score") - F.col("significance") > 3).alias("hit"))
    return counts.filter("n >= 30 and hit > 0.2 * n").select("action_type", "n", F.round(100.0 * F.col("hit") / F.col("n"), 1).cast("double").alias("pct"))


@query("q_calib_badge_volume", "SELECT city_id, CAST(CAST(date_trunc('week', detected_on) AS DATE) AS VARCHAR) AS week, count(*) AS n, round(count(*) FILTER (WHERE source = 'llm')::DOUBLE / count(*), 6) AS llm_share FROM badge WHERE kind = 'policy' GROUP BY ALL")
def q_calib_badge_volume(c: Civic) -> DataFrame:
    counts = c.badge.filter("kind = 'policy'").groupBy("city_id", F.trunc("detected_on", "week").cast("string").alias("week")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("source") == "llm").alias("l"))
    return counts.select("city_id", "week", "n", F.round(F.col("l").cast("double") / F.col("n"), 6).alias("llm_share"))


@query("q_top_pages", "SELECT url_path, count(*) AS n FROM web WHERE kind = 1 GROUP BY 1 ORDER BY n DESC, url_path LIMIT 20")
def q_top_pages(c: Civic) -> DataFrame:
    return count_by(c.web.filter("kind = 1"), "url_path").orderBy(F.col("n").desc(), "url_path").limit(20)


@query("q_data_debt", "SELECT item_id, priority FROM ctx WHERE (data_quality <> 'ok' AND data_quality IS NOT NULL) OR status = 'failed_permanent'")
def q_data_debt(c: Civic) -> DataFrame:
    return c.item_context().filter("data_quality <> 'ok' or status = 'failed_permanent'").select("item_id", "priority")


@query("q_source_health", "SELECT city_id, CASE WHEN d < 1 THEN 'good' WHEN d < 7 THEN 'warn' ELSE 'bad' END AS state FROM (SELECT city_id, DATE '2001-08-02' - max(meeting_date) AS d FROM meeting GROUP BY 1)")
def q_source_health(c: Civic) -> DataFrame:
    last = c.meeting.groupBy("city_id").agg(F.max("meeting_date").alias("d"))
    return last.select("city_id", T.age_state(F.datediff(F.lit("2001-08-02").cast("date"), "d")).alias("state"))
