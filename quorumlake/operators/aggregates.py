"""Predicates, joins, aggregates and set operations over the civic layer, each for all keys at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.model import AS_OF, Civic
from quorumlake.plans.registry import query

def day() -> Column:
    """The as-of date as a column."""
    return F.lit(AS_OF).cast("date")



def as_double(total: Column) -> Column:
    """An exact decimal sum as a double, so that its type doesn't depend on the engine."""
    return total.cast("double")


def count_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


@query("src_tables", "SELECT 'city' AS entity, count(*) AS n FROM city UNION ALL SELECT 'member', count(*) FROM member UNION ALL SELECT 'meeting', count(*) FROM meeting UNION ALL SELECT 'item', count(*) FROM item UNION ALL SELECT 'vote', count(*) FROM vote")
def src_tables(c: Civic) -> DataFrame:
    frames = [getattr(c, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("entity"), "n") for name in ("city", "member", "meeting", "item", "vote")]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@query("src_meetings_incremental", f"SELECT meeting_id, external_id, title FROM meeting WHERE meeting_date >= DATE '{AS_OF}'")
def src_meetings_incremental(c: Civic) -> DataFrame:
    return c.meeting.filter(F.col("meeting_date") >= day()).select("meeting_id", "external_id", "title")


@query("prj_item_card", "SELECT item_id, item_number, title, description, is_consent, sponsor, CAST(dollars AS DOUBLE) AS dollars, topic, significance, consent_score, status, data_quality, priority, city_name, slug FROM ctx")
def prj_item_card(c: Civic) -> DataFrame:
    return c.item_context().select("item_id", "item_number", "title", "description", "is_consent", "sponsor", F.col("dollars").cast("double").alias("dollars"), "topic", "significance", "consent_score", "status", "data_quality", "priority", "city_name", "slug")


@query("prj_conditional_excerpt", "SELECT item_id, CASE WHEN is_consent THEN NULL ELSE title END AS excerpt FROM item")
def prj_conditional_excerpt(c: Civic) -> DataFrame:
    return c.item.select("item_id", F.when(~F.col("is_consent"), F.col("title")).alias("excerpt"))


@query("flt_public_visible", "SELECT meeting_id, slug FROM meeting JOIN city USING (city_id) WHERE NOT is_hidden AND active")
def flt_public_visible(c: Civic) -> DataFrame:
    return c.meeting.filter(~F.col("is_hidden")).join(F.broadcast(c.city.filter("active")), "city_id").select("meeting_id", "slug")


@query("flt_exclude_withdrawn", "SELECT item_id FROM item WHERE status <> 'withdrawn'")
def flt_exclude_withdrawn(c: Civic) -> DataFrame:
    return c.item.filter("status <> 'withdrawn'").select("item_id")


@query("flt_upcoming", f"SELECT meeting_id, CASE WHEN CAST(meeting_date AS TIMESTAMP) + to_seconds(coalesce(start_sec, 43200) + 10800) >= TIMESTAMP '{AS_OF} 10:00:00' THEN 'upcoming' ELSE 'recent' END AS phase FROM meeting WHERE meeting_date BETWEEN DATE '{AS_OF}' - 30 AND DATE '{AS_OF}' + 365")
def flt_upcoming(c: Civic) -> DataFrame:
    """A meeting is upcoming until three hours after its start (noon if unknown); as-of is a parameter, never the clock."""
    ends = F.col("meeting_date").cast("timestamp") + F.make_dt_interval(secs=F.coalesce("start_sec", F.lit(43200)) + 10800)
    near = c.meeting.filter(F.col("meeting_date").between(F.date_sub(day(), 30), F.date_add(day(), 365)))
    return near.select("meeting_id", F.when(ends >= F.lit(f"{AS_OF} 10:00:00").cast("timestamp"), "upcoming").otherwise("recent").alias("phase"))


GATE_SQL = "b.confidence >= 0.6 AND b.badge_status = 'applied' AND i.status = 'completed' AND (b.kind <> 'policy' OR i.significance >= 3)"


def gated(c: Civic) -> DataFrame:
    """Badges that count in public: confident, applied, on a completed visible item, policy ones significant."""
    items = c.item_context().select("item_id", "meeting_id", "meeting_date", "slug", "status", "significance", "dollars", "is_consent", "title", "topic").withColumnRenamed("slug", "city_slug")
    badges = c.badge.filter("confidence >= 0.6 and badge_status = 'applied'")
    return badges.join(items.filter("status = 'completed'"), "item_id").filter("kind <> 'policy' or significance >= 3")


@query("flt_badge_gate", f"SELECT b.item_id, b.slug AS badge, i.slug AS city FROM badge b JOIN ctx i ON i.item_id = b.item_id WHERE {GATE_SQL}")
def flt_badge_gate(c: Civic) -> DataFrame:
    return gated(c).select("item_id", F.col("slug").alias("badge"), F.col("city_slug").alias("city"))


@query("flt_month_drill", "SELECT meeting_id FROM meeting WHERE date_trunc('month', meeting_date) = DATE '1998-03-01'")
def flt_month_drill(c: Civic) -> DataFrame:
    """A month as a half-open range, so that files and row groups outside it are skipped."""
    return c.meeting.filter("meeting_date >= date'1998-03-01' and meeting_date < date'1998-04-01'").select("meeting_id")


@query("flt_ilike_contains", "SELECT item_id FROM item WHERE title ILIKE '%BRAND#1%'")
def flt_ilike_contains(c: Civic) -> DataFrame:
    return c.item.filter(F.col("title").ilike("%BRAND#1%")).select("item_id")


@query("flt_like_escape", "SELECT item_id FROM item WHERE contains(lower(title), lower('Brand#2 for $1'))")
def flt_like_escape(c: Civic) -> DataFrame:
    """A literal substring needs no pattern, so nothing has to be escaped."""
    return c.item.filter(F.contains(F.lower("title"), F.lower(F.lit("Brand#2 for $1")))).select("item_id")


@query("flt_row_value", "SELECT meeting_id FROM meeting WHERE (meeting_date, meeting_id) < (DATE '1996-05-05', 5000)")
def flt_row_value(c: Civic) -> DataFrame:
    return c.meeting.filter(F.struct("meeting_date", "meeting_id") < F.struct(F.lit("1996-05-05").cast("date").alias("meeting_date"), F.lit(5000).cast("long").alias("meeting_id"))).select("meeting_id")


@query("flt_three_valued", "SELECT count(*) FILTER (WHERE data_quality <> 'ok') AS not_ok, count(*) FILTER (WHERE data_quality = 'ok') AS ok, count(*) AS n FROM item")
def flt_three_valued(c: Civic) -> DataFrame:
    return c.item.agg(F.count_if(F.col("data_quality") != "ok").alias("not_ok"), F.count_if(F.col("data_quality") == "ok").alias("ok"), F.count(F.lit(1)).alias("n"))


@query("flt_regex_exclude", "SELECT item_id FROM item WHERE NOT regexp_matches(title || ' ' || coalesce(description, ''), '(?i)(recurring|monthly invoice|annual renewal|emergency)')")
def flt_regex_exclude(c: Civic) -> DataFrame:
    return c.item.filter(~F.concat("title", F.lit(" "), F.coalesce("description", F.lit(""))).rlike("(?i)(recurring|monthly invoice|annual renewal|emergency)")).select("item_id")


@query("flt_data_debt", "SELECT item_id, data_quality FROM item WHERE (data_quality IS NOT NULL AND data_quality <> 'ok') OR status = 'failed_permanent'")
def flt_data_debt(c: Civic) -> DataFrame:
    return c.item.filter("data_quality <> 'ok' or status = 'failed_permanent'").select("item_id", "data_quality")


@query("flt_claimable_items", "SELECT item_id FROM item WHERE status = 'pending' AND (ai_version = 0 OR ai_version < 3)")
def flt_claimable_items(c: Civic) -> DataFrame:
    return c.item.filter("status = 'pending' and ai_version < 3").select("item_id")


@query("flt_claimable_since", "SELECT i.item_id, CAST(m.meeting_date AS VARCHAR) AS meeting_date FROM item i JOIN meeting m ON m.meeting_id = i.meeting_id WHERE i.status = 'pending' AND i.ai_version < 3 AND m.meeting_date >= DATE '1998-01-01'")
def flt_claimable_since(c: Civic) -> DataFrame:
    recent = c.meeting.filter("meeting_date >= date'1998-01-01'").select("meeting_id", "meeting_date")
    return c.item.filter("status = 'pending' and ai_version < 3").join(recent, "meeting_id").select("item_id", F.col("meeting_date").cast("string").alias("meeting_date"))


@query("flt_claimable_meetings", "SELECT meeting_id, 'adopted' AS pass FROM meeting WHERE adopted_date IS NOT NULL UNION ALL SELECT meeting_id, 'provisional' FROM meeting m WHERE adopted_date IS NULL AND NOT EXISTS (SELECT 1 FROM item i WHERE i.meeting_id = m.meeting_id AND i.ai_version < 2)")
def flt_claimable_meetings(c: Civic) -> DataFrame:
    behind = c.item.filter("ai_version < 2").select("meeting_id")
    adopted = c.meeting.filter("adopted_date is not null").select("meeting_id", F.lit("adopted").alias("pass"))
    return adopted.unionByName(c.meeting.filter("adopted_date is null").join(behind, "meeting_id", "left_anti").select("meeting_id", F.lit("provisional").alias("pass")))


@query("flt_ocr_eligible", f"SELECT meeting_id FROM meeting WHERE regexp_full_match(external_id, '[0-9]+') AND meeting_date BETWEEN DATE '{AS_OF}' - 60 AND DATE '{AS_OF}' AND NOT is_hidden AND meeting_id % 4 < 3")
def flt_ocr_eligible(c: Civic) -> DataFrame:
    """Numeric ids of the last 60 days with fewer than three attempts (attempts: the id modulo 4)."""
    return c.meeting.filter(F.col("external_id").rlike("^[0-9]+$") & F.col("meeting_date").between(F.date_sub(day(), 60), day()) & ~F.col("is_hidden") & (F.col("meeting_id") % 4 < 3)).select("meeting_id")


@query("flt_url_allowlist", "SELECT page_id FROM pages WHERE regexp_matches(url, '^https?://([^/?#:]+[.])?example[.]com([/?#:]|$)')")
def flt_url_allowlist(c: Civic) -> DataFrame:
    """A host passes if it or one of its dot suffixes is on the list: suffixes are exploded and semi-joined."""
    allowed = c.spark.createDataFrame([("example.com",)], "host string")
    pages = c.table("pages").filter(F.col("url").rlike("^https?://")).select("page_id", F.split(F.regexp_extract("url", r"^https?://([^/?#:]+)", 1), r"\.").alias("parts"))
    suffixes = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.array_join(F.slice("parts", i, F.size("parts")), "."))
    return pages.select("page_id", F.explode(suffixes).alias("host")).join(F.broadcast(allowed), "host", "left_semi").select("page_id").distinct()


@query("flt_audit_window", "SELECT item_id, slug AS badge FROM badge WHERE detected_on >= DATE '1998-01-01' AND detected_on < DATE '1998-04-01' AND slug = 'sole_source'")
def flt_audit_window(c: Civic) -> DataFrame:
    return c.badge.filter("detected_on >= date'1998-01-01' and detected_on < date'1998-04-01' and slug = 'sole_source'").select("item_id", F.col("slug").alias("badge"))


@query("flt_repairable_agendas", f"SELECT meeting_id FROM meeting m WHERE meeting_date BETWEEN DATE '{AS_OF}' - INTERVAL 18 MONTH AND DATE '{AS_OF}' AND NOT regexp_matches(title, '(?i)cancel') AND NOT EXISTS (SELECT 1 FROM item i WHERE i.meeting_id = m.meeting_id)")
def flt_repairable_agendas(c: Civic) -> DataFrame:
    m = c.meeting.filter(F.col("meeting_date").between(F.add_months(day(), -18), day()) & ~F.col("title").rlike("(?i)cancel"))
    return m.join(c.item.select("meeting_id"), "meeting_id", "left_anti").select("meeting_id")


@query("join_item_context", "SELECT item_id, slug, CAST(meeting_date AS VARCHAR) AS meeting_date FROM ctx")
def join_item_context(c: Civic) -> DataFrame:
    return c.item_context().select("item_id", "slug", F.col("meeting_date").cast("string").alias("meeting_date"))


@query("join_left_count_on", "SELECT c.slug, count(m.meeting_id) AS n FROM city c LEFT JOIN meeting m ON m.city_id = c.city_id AND NOT m.is_hidden AND m.meeting_date >= DATE '2001-07-01' GROUP BY c.slug")
def join_left_count_on(c: Civic) -> DataFrame:
    """The visibility test filters the counted side before the left join, so a city without meetings counts 0."""
    n = count_by(c.meeting.filter("not is_hidden and meeting_date >= date'2001-07-01'"), "city_id")
    return c.city.join(n, "city_id", "left").select("slug", F.coalesce("n", F.lit(0)).alias("n"))


@query("join_lateral_agg", "SELECT i.item_id, coalesce(string_agg(b.slug, ',' ORDER BY b.confidence DESC, b.slug), '') AS badges FROM item i LEFT JOIN badge b ON b.item_id = i.item_id GROUP BY i.item_id")
def join_lateral_agg(c: Civic) -> DataFrame:
    """Badges are gathered once an item, then joined: no lateral subquery."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("k"), "slug")))
    badges = c.badge.groupBy("item_id").agg(F.array_join(F.transform(ordered, lambda s: s["slug"]), ",").alias("badges"))
    return c.item.select("item_id").join(badges, "item_id", "left").select("item_id", F.coalesce("badges", F.lit("")).alias("badges"))


@query("join_semi_cross_filter", "SELECT item_id FROM badge WHERE slug IN ('high_dollar', 'sole_source') GROUP BY item_id HAVING count(DISTINCT slug) = 2")
def join_semi_cross_filter(c: Civic) -> DataFrame:
    wanted = ["high_dollar", "sole_source"]
    return c.badge.filter(F.col("slug").isin(wanted)).groupBy("item_id").agg(F.count_distinct("slug").alias("n")).filter(F.col("n") == len(wanted)).select("item_id")


@query("join_semi_exists", "SELECT meeting_id FROM meeting m WHERE EXISTS (SELECT 1 FROM vote v WHERE v.meeting_id = m.meeting_id AND v.result = 'passed')")
def join_semi_exists(c: Civic) -> DataFrame:
    return c.meeting.join(c.vote.filter("result = 'passed'"), "meeting_id", "left_semi").select("meeting_id")


@query("join_anti_not_exists", "SELECT item_id FROM item i WHERE NOT EXISTS (SELECT 1 FROM badge b WHERE b.item_id = i.item_id)")
def join_anti_not_exists(c: Civic) -> DataFrame:
    return c.item.join(c.badge, "item_id", "left_anti").select("item_id")


TERM_SQL = "t.term_start <= m.meeting_date AND m.meeting_date < coalesce(t.term_end, m.meeting_date + 1)"


@query("join_range_term", f"SELECT m.meeting_id, t.member_id FROM meeting m JOIN member t ON t.city_id = m.city_id AND {TERM_SQL}")
def join_range_term(c: Civic) -> DataFrame:
    """Members whose half-open term holds the meeting's day."""
    return in_office(c.meeting, c.member)


#: Parts of a city's meetings, by their day: members are copied to each.
TERM_PARTS = 32


def in_office(meetings: DataFrame, members: DataFrame) -> DataFrame:
    """meeting_id, member_id: an equi-join on the city with the range left over. Meetings of a city and a day stand together, and
    a city's are dealt over many tasks, so that no task has a whole city and equal runs of members compress where they are written."""
    part = lambda day: F.pmod(F.xxhash64(day), F.lit(TERM_PARTS))
    held = meetings.select("meeting_id", "city_id", "meeting_date", part("meeting_date").alias("part"))
    dealt = held.repartition("city_id", "part").sortWithinPartitions("city_id", "part", "meeting_date")
    copied = members.select("member_id", "city_id", "term_start", "term_end", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(TERM_PARTS - 1).cast("long"))).alias("part"))
    valid = (F.col("term_start") <= F.col("meeting_date")) & (F.col("term_end").isNull() | (F.col("meeting_date") < F.col("term_end")))
    return dealt.join(copied.hint("merge"), ["city_id", "part"]).filter(valid).select("meeting_id", "member_id")


@query("join_interval_overlap", "SELECT member_id, CAST(greatest(term_start, DATE '1997-01-01') AS VARCHAR) AS begins, CAST(least(coalesce(term_end, DATE '1999-01-01'), DATE '1999-01-01') AS VARCHAR) AS ends FROM member WHERE term_start < DATE '1999-01-01' AND coalesce(term_end, DATE '1999-01-01') > DATE '1997-01-01'")
def join_interval_overlap(c: Civic) -> DataFrame:
    """Terms clipped to a window; empty spans drop out."""
    low, high = F.lit("1997-01-01").cast("date"), F.lit("1999-01-01").cast("date")
    spans = c.member.select("member_id", F.greatest("term_start", low).alias("b"), F.least(F.coalesce("term_end", high), high).alias("e"))
    return spans.filter("b < e").select("member_id", F.col("b").cast("string").alias("begins"), F.col("e").cast("string").alias("ends"))


@query("join_left_chain_audit", "SELECT b.item_id, b.slug AS badge, i.title, c.slug FROM badge b LEFT JOIN item i ON i.item_id = b.item_id AND i.status = 'completed' LEFT JOIN meeting m ON m.meeting_id = i.meeting_id LEFT JOIN city c ON c.city_id = m.city_id")
def join_left_chain_audit(c: Civic) -> DataFrame:
    i = c.item.filter("status = 'completed'").select("item_id", "meeting_id", "title")
    out = c.badge.select("item_id", F.col("slug").alias("badge")).join(i, "item_id", "left").join(c.meeting.select("meeting_id", "city_id"), "meeting_id", "left")
    return out.join(F.broadcast(c.city.select("city_id", "slug")), "city_id", "left").select("item_id", "badge", "title", "slug")


@query("join_template_config", "SELECT c.slug, t.badge, coalesce(CASE WHEN c.city_id % 2 = 0 THEN c.city_id % 5 END, t.threshold) AS threshold FROM city c CROSS JOIN (VALUES ('high_dollar', 3), ('sole_source', 4)) t(badge, threshold)")
def join_template_config(c: Civic) -> DataFrame:
    """Templates for every city (both tables of fixed size) with the city's override where it has one."""
    templates = F.explode(F.array(*[F.struct(F.lit(b).alias("badge"), F.lit(n).alias("threshold")) for b, n in (("high_dollar", 3), ("sole_source", 4))]))
    every = c.city.select("city_id", "slug", templates.alias("t"))
    config = c.city.filter("city_id % 2 = 0").select("city_id", (F.col("city_id") % 5).alias("own"))
    return every.join(config, "city_id", "left").select("slug", "t.badge", F.coalesce("own", "t.threshold").alias("threshold"))


@query("join_update_from", "SELECT i.item_id, coalesce(i.description, m.title) AS description FROM item i JOIN meeting m ON m.meeting_id = i.meeting_id")
def join_update_from(c: Civic) -> DataFrame:
    return c.item.select("item_id", "meeting_id", "description").join(c.meeting.select("meeting_id", "title"), "meeting_id").select("item_id", F.coalesce("description", "title").alias("description"))


@query("join_self_props", "SELECT a.day::VARCHAR AS day, a.event_type, a.n, b.total FROM (SELECT day, event_type, count(*) AS n FROM web GROUP BY ALL) a JOIN (SELECT day, event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM web GROUP BY ALL) b USING (day, event_type)")
def join_self_props(c: Civic) -> DataFrame:
    """The self join on (day, event) of two aggregates is one aggregate."""
    k = F.get_json_object("props", "$.k").cast("long")
    return c.web.groupBy(F.col("day").cast("string").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"))


@query("join_polymorphic_subject", "SELECT 'item' AS subject_type, item_id AS subject_id, title AS label FROM item WHERE item_id % 50 = 0 UNION ALL SELECT 'meeting', meeting_id, title FROM meeting WHERE meeting_id % 50 = 0 UNION ALL SELECT 'member', member_id, member_name FROM member WHERE member_id % 5 = 0")
def join_polymorphic_subject(c: Civic) -> DataFrame:
    """Links to subjects of several kinds: one join for each kind, united."""
    out = None
    for kind, frame, key, label, step in (("item", c.item, "item_id", "title", 50), ("meeting", c.meeting, "meeting_id", "title", 50), ("member", c.member, "member_id", "member_name", 5)):
        subjects = frame.select(F.col(key).alias("subject_id"), F.col(label).alias("label"))
        links = frame.filter(F.col(key) % step == 0).select(F.lit(kind).alias("subject_type"), F.col(key).alias("subject_id"))
        part = links.join(subjects, "subject_id", "left").select("subject_type", "subject_id", "label")
        out = part if out is None else out.unionByName(part)
    return out


@query("agg_city_meeting_counts", "SELECT c.slug, count(m.meeting_id) AS n, CAST(max(m.meeting_date) AS VARCHAR) AS latest FROM city c LEFT JOIN meeting m ON m.city_id = c.city_id AND NOT m.is_hidden WHERE c.active GROUP BY c.slug")
def agg_city_meeting_counts(c: Civic) -> DataFrame:
    n = c.meeting.filter("not is_hidden").groupBy("city_id").agg(F.count(F.lit(1)).alias("n"), F.max("meeting_date").cast("string").alias("latest"))
    return c.city.filter("active").join(n, "city_id", "left").select("slug", F.coalesce("n", F.lit(0)).alias("n"), "latest")


@query("agg_dashboard_totals", "SELECT (SELECT count(*) FROM city WHERE active) AS cities, (SELECT count(*) FROM meeting WHERE NOT is_hidden) AS meetings, (SELECT count(*) FROM item) AS items, (SELECT count(*) FROM vote) AS votes")
def agg_dashboard_totals(c: Civic) -> DataFrame:
    parts = [("cities", c.city.filter("active")), ("meetings", c.meeting.filter("not is_hidden")), ("items", c.item), ("votes", c.vote)]
    named = None
    for name, frame in parts:
        one = frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        named = one if named is None else named.unionByName(one)
    return named.agg(*[F.max(F.when(F.col("name") == n, F.col("n"))).alias(n) for n, _ in parts])


@query("agg_topic_counts", "SELECT slug, topic, count(*) AS n FROM ctx WHERE status <> 'withdrawn' GROUP BY ALL")
def agg_topic_counts(c: Civic) -> DataFrame:
    return count_by(c.item_context().filter("status <> 'withdrawn'"), "slug", "topic")


@query("agg_member_stats", """SELECT member_id, count(*) AS total, round_even(100.0 * count(*) FILTER (WHERE mv.position <> 'abstain') / count(*), 0)::DOUBLE AS present_pct,
    round_even(100.0 * count(*) FILTER (WHERE (mv.position = 'yes') = (v.result = 'passed') AND mv.position <> 'abstain') / nullif(count(*) FILTER (WHERE mv.position <> 'abstain'), 0), 0)::DOUBLE AS aligned_pct
    FROM member_vote mv JOIN vote v ON v.vote_id = mv.vote_id GROUP BY member_id""")
def agg_member_stats(c: Civic) -> DataFrame:
    both = c.member_vote.join(c.vote.select("vote_id", "result"), "vote_id")
    present = F.col("position") != "abstain"
    aligned = present & ((F.col("position") == "yes") == (F.col("result") == "passed"))
    counts = both.groupBy("member_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(present).alias("p"), F.count_if(aligned).alias("a"))
    return counts.select("member_id", "total", F.bround(100.0 * F.col("p") / F.col("total"), 0).cast("double").alias("present_pct"), F.bround(F.try_divide(100.0 * F.col("a"), F.col("p")), 0).cast("double").alias("aligned_pct"))


@query("agg_position_tally", "SELECT member_id, count(*) FILTER (WHERE position = 'yes') AS yea, count(*) FILTER (WHERE position = 'nay') AS nay, count(*) FILTER (WHERE position = 'abstain') AS abstain FROM member_vote GROUP BY member_id")
def agg_position_tally(c: Civic) -> DataFrame:
    said = F.when(F.col("position").isin("yes", "yea"), "yea").when(F.col("position").isin("no", "nay"), "nay").otherwise(F.col("position"))
    return c.member_vote.withColumn("p", said).groupBy("member_id").pivot("p", ["yea", "nay", "abstain"]).count().na.fill(0)


@query("agg_dissent_per_item", "SELECT meeting_id, nays + abstentions AS dissent, yeas + nays + abstentions AS voting FROM vote")
def agg_dissent_per_item(c: Civic) -> DataFrame:
    return c.vote.select("meeting_id", F.expr("nays + abstentions").alias("dissent"), F.expr("yeas + nays + abstentions").alias("voting"))


@query("agg_filtered_sums", "SELECT slug, CAST(coalesce(sum(dollars) FILTER (WHERE adopted_date IS NULL), 0) AS DOUBLE) AS pending, CAST(coalesce(sum(dollars) FILTER (WHERE adopted_date IS NOT NULL), 0) AS DOUBLE) AS settled FROM ctx GROUP BY slug")
def agg_filtered_sums(c: Civic) -> DataFrame:
    total = lambda rule: as_double(F.coalesce(F.sum(F.when(rule, F.col("dollars"))), F.lit(0).cast("decimal(25,2)")))
    return c.item_context().groupBy("slug").agg(total(F.col("adopted_date").isNull()).alias("pending"), total(F.col("adopted_date").isNotNull()).alias("settled"))


YTD = f"meeting_date >= DATE '{AS_OF[:4]}-01-01' AND meeting_date <= DATE '{AS_OF}'"


@query("agg_ytd_kpis", f"""SELECT c.slug, coalesce(m.n, 0) AS meetings, coalesce(i.n, 0) AS items, coalesce(i.d, 0)::DOUBLE AS dollars, coalesce(v.n, 0) AS votes, coalesce(v.contested, 0) AS contested FROM city c
    LEFT JOIN (SELECT city_id, count(*) AS n FROM meeting WHERE NOT is_hidden AND {YTD} GROUP BY 1) m ON m.city_id = c.city_id
    LEFT JOIN (SELECT city_id, count(*) AS n, sum(dollars) AS d FROM ctx WHERE {YTD} GROUP BY 1) i ON i.city_id = c.city_id
    LEFT JOIN (SELECT m.city_id, count(*) AS n, count(*) FILTER (WHERE v.nays > 0) AS contested FROM vote v JOIN meeting m ON m.meeting_id = v.meeting_id WHERE NOT m.is_hidden AND m.{YTD.replace('AND meeting', 'AND m.meeting')} GROUP BY 1) v ON v.city_id = c.city_id WHERE c.active""")
def agg_ytd_kpis(c: Civic) -> DataFrame:
    """One grouped pass at each grain, joined on the city."""
    year = F.col("meeting_date").between(F.trunc(day(), "year"), day())
    m = c.meeting.filter(~F.col("is_hidden") & year)
    meetings = m.groupBy("city_id").agg(F.count(F.lit(1)).alias("meetings"))
    items = c.item_context().filter(year).groupBy("city_id").agg(F.count(F.lit(1)).alias("items"), as_double(F.sum("dollars")).alias("dollars"))
    votes = c.vote.drop("meeting_date").join(m.select("meeting_id", "city_id"), "meeting_id").groupBy("city_id").agg(F.count(F.lit(1)).alias("votes"), F.count_if(F.col("nays") > 0).alias("contested"))
    out = c.city.filter("active").select("city_id", "slug").join(meetings, "city_id", "left").join(items, "city_id", "left").join(votes, "city_id", "left")
    return out.select("slug", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("meetings", "items", "dollars", "votes", "contested")])


@query("agg_badge_kpis", f"SELECT i.slug AS city, b.slug AS badge, CAST(year(i.meeting_date) AS BIGINT) AS year, count(*) AS items, CAST(sum(i.dollars) AS DOUBLE) AS dollars FROM badge b JOIN ctx i ON i.item_id = b.item_id WHERE {GATE_SQL} GROUP BY ALL")
def agg_badge_kpis(c: Civic) -> DataFrame:
    return gated(c).groupBy(F.col("city_slug").alias("city"), F.col("slug").alias("badge"), F.year("meeting_date").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("items"), as_double(F.sum("dollars")).alias("dollars"))


@query("agg_badge_tally", f"""SELECT city, badge, CAST(sum(n) AS BIGINT) AS indexed, count(*) AS months, CAST(sum(d) AS DOUBLE) AS dollars, CAST(arg_max(month, n * 100000 + (year(month) * 12 + month(month))) AS VARCHAR) AS peak_month FROM
    (SELECT i.slug AS city, b.slug AS badge, CAST(date_trunc('month', i.meeting_date) AS DATE) AS month, count(*) AS n, sum(i.dollars) AS d FROM badge b JOIN ctx i ON i.item_id = b.item_id WHERE {GATE_SQL} GROUP BY ALL) GROUP BY city, badge""")
def agg_badge_tally(c: Civic) -> DataFrame:
    """Months first, then keys; the peak is the busiest month, of equal ones the later."""
    months = gated(c).groupBy(F.col("city_slug").alias("city"), F.col("slug").alias("badge"), F.trunc("meeting_date", "month").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum("dollars").alias("d"))
    return months.groupBy("city", "badge").agg(F.sum("n").alias("indexed"), F.count(F.lit(1)).alias("months"), as_double(F.sum("d")).alias("dollars"), F.max_by("month", F.struct("n", "month")).cast("string").alias("peak_month"))


@query("agg_badge_volume_year", f"SELECT city_id, slug AS badge, count(*) FILTER (WHERE year(detected_on) = 1998) AS in_year, count(*) FILTER (WHERE detected_on > DATE '{AS_OF}' - 30 AND detected_on <= DATE '{AS_OF}') AS recent FROM badge GROUP BY ALL")
def agg_badge_volume_year(c: Civic) -> DataFrame:
    recent = (F.col("detected_on") > F.date_sub(day(), 30)) & (F.col("detected_on") <= day())
    return c.badge.groupBy("city_id", F.col("slug").alias("badge")).agg(F.count_if(F.year("detected_on") == 1998).alias("in_year"), F.count_if(recent).alias("recent"))


@query("agg_having", "SELECT sponsor, count(*) AS n FROM item WHERE status = 'failed_permanent' GROUP BY sponsor HAVING count(*) >= 12")
def agg_having(c: Civic) -> DataFrame:
    return count_by(c.item.filter("status = 'failed_permanent'"), "sponsor").filter("n >= 12")


@query("agg_array_distinct_filter", "SELECT meeting_id, coalesce(string_agg(DISTINCT data_quality, ',' ORDER BY data_quality), '') AS reasons FROM item GROUP BY meeting_id")
def agg_array_distinct_filter(c: Civic) -> DataFrame:
    return c.item.groupBy("meeting_id").agg(F.array_join(F.array_sort(F.collect_set("data_quality")), ",").alias("reasons"))


@query("agg_ordered_json_array", "SELECT meeting_id, string_agg(item_id::VARCHAR, ',' ORDER BY dollars DESC, item_id DESC) AS items FROM item GROUP BY meeting_id")
def agg_ordered_json_array(c: Civic) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("dollars", "item_id")), asc=False)
    return c.item.groupBy("meeting_id").agg(F.array_join(F.transform(ordered, lambda s: s["item_id"].cast("string")), ",").alias("items"))


@query("agg_count_distinct", "SELECT CAST(day AS VARCHAR) AS day, count(DISTINCT session_id) AS sessions FROM web GROUP BY day")
def agg_count_distinct(c: Civic) -> DataFrame:
    return c.web.groupBy(F.col("day").cast("string").alias("day")).agg(F.count_distinct("session_id").alias("sessions"))


@query("agg_histogram_scores", "SELECT CASE WHEN significance <= 1 THEN '0-1' WHEN significance <= 3 THEN '2-3' WHEN significance <= 5 THEN '4-5' WHEN significance <= 7 THEN '6-7' ELSE '8-10' END AS band, count(*) AS n FROM item GROUP BY 1")
def agg_histogram_scores(c: Civic) -> DataFrame:
    s = F.col("significance")
    return count_by(c.item.select(F.when(s <= 1, "0-1").when(s <= 3, "2-3").when(s <= 5, "4-5").when(s <= 7, "6-7").when(s.isNotNull(), "8-10").otherwise("null").alias("band")), "band")


@query("agg_of_agg_density", "SELECT badges, count(*) AS items FROM (SELECT i.item_id, count(b.slug) AS badges FROM item i LEFT JOIN badge b ON b.item_id = i.item_id GROUP BY 1) GROUP BY badges")
def agg_of_agg_density(c: Civic) -> DataFrame:
    n = count_by(c.badge, "item_id", name="badges")
    return count_by(c.item.select("item_id").join(n, "item_id", "left").select(F.coalesce("badges", F.lit(0)).alias("badges")), "badges", name="items")


@query("agg_event_props", "SELECT CAST(day AS VARCHAR) AS day, event_type, 'k' AS key, json_extract_string(props, '$.k') AS value, count(*) AS n FROM web WHERE kind = 2 GROUP BY ALL")
def agg_event_props(c: Civic) -> DataFrame:
    pairs = F.explode(F.from_json("props", "map<string,string>"))
    return count_by(c.web.filter("kind = 2").select(F.col("day").cast("string").alias("day"), "event_type", pairs.alias("key", "value")), "day", "event_type", "key", "value")


@query("agg_status_breakdown", "SELECT status, data_quality, count(*) AS n FROM item GROUP BY ALL")
def agg_status_breakdown(c: Civic) -> DataFrame:
    return count_by(c.item, "status", "data_quality")


@query("agg_latest_per_city", "SELECT city_id, CAST(max(meeting_date) AS VARCHAR) AS latest, arg_max(title, ROW(meeting_date, meeting_id)) AS title FROM meeting GROUP BY city_id")
def agg_latest_per_city(c: Civic) -> DataFrame:
    return c.meeting.groupBy("city_id").agg(F.max("meeting_date").cast("string").alias("latest"), F.max_by("title", F.struct("meeting_date", "meeting_id")).alias("title"))


@query("agg_pending_counts", "SELECT count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'pending' AND ai_version < 3) AS claimable FROM item")
def agg_pending_counts(c: Civic) -> DataFrame:
    return c.item.agg(F.count_if(F.col("status") == "pending").alias("pending"), F.count_if((F.col("status") == "pending") & (F.col("ai_version") < 3)).alias("claimable"))


@query("agg_token_cost", "SELECT ai_version, CAST(sum(CAST(length(title) AS BIGINT) * CASE ai_version WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 5 END) AS BIGINT) AS cost FROM item GROUP BY ai_version")
def agg_token_cost(c: Civic) -> DataFrame:
    """Usage by model version times a price table of fixed size."""
    prices = c.spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 5), (4, 5)], "ai_version int, price int")
    return c.item.join(F.broadcast(prices), "ai_version").groupBy("ai_version").agg(F.sum(F.length("title").cast("long") * F.col("price")).alias("cost"))


@query("agg_rollup_city_topic", "SELECT slug, topic, count(*) AS n FROM ctx GROUP BY ROLLUP (slug, topic)")
def agg_rollup_city_topic(c: Civic) -> DataFrame:
    return c.item_context().rollup("slug", "topic").agg(F.count(F.lit(1)).alias("n"))


@query("agg_assets_to_meeting", "SELECT url_host AS host, max(CASE WHEN kind = 0 THEN url END) AS agenda, max(CASE WHEN kind = 1 THEN url END) AS minutes, max(CASE WHEN kind = 2 THEN url END) AS video FROM (SELECT regexp_extract(url, '^https?://([^/?#:]+)', 1) AS url_host, page_id % 3 AS kind, url FROM pages) GROUP BY url_host")
def agg_assets_to_meeting(c: Civic) -> DataFrame:
    """Links of several kinds pivoted into one row a key."""
    assets = c.table("pages").select(F.regexp_extract("url", "^https?://([^/?#:]+)", 1).alias("host"), (F.col("page_id") % 3).alias("kind"), "url")
    return assets.groupBy("host").agg(*[F.max(F.when(F.col("kind") == k, F.col("url"))).alias(n) for k, n in enumerate(("agenda", "minutes", "video"))])


@query("set_union_hearings", "SELECT meeting_id, item_id, title FROM item WHERE title ILIKE '%ring%' UNION ALL SELECT m.meeting_id, NULL, m.title FROM meeting m WHERE m.title ILIKE '%planning%' AND NOT EXISTS (SELECT 1 FROM item i WHERE i.meeting_id = m.meeting_id AND i.title ILIKE '%ring%')")
def set_union_hearings(c: Civic) -> DataFrame:
    """Item-level hits and, where a meeting has none, meeting-level ones."""
    items = c.item.filter(F.col("title").ilike("%ring%")).select("meeting_id", "item_id", "title")
    meetings = c.meeting.filter(F.col("title").ilike("%planning%")).join(items, "meeting_id", "left_anti")
    return items.unionByName(meetings.select("meeting_id", F.lit(None).cast("long").alias("item_id"), "title"))


@query("set_distinct", "SELECT DISTINCT meeting_id, topic FROM item WHERE status = 'completed'")
def set_distinct(c: Civic) -> DataFrame:
    return c.item.filter("status = 'completed'").select("meeting_id", "topic").distinct()


@query("set_union_all_badges", "SELECT slug, kind FROM (SELECT DISTINCT slug, kind FROM badge WHERE kind = 'process' UNION ALL SELECT DISTINCT slug, kind FROM badge WHERE kind = 'policy')")
def set_union_all_badges(c: Civic) -> DataFrame:
    pick = lambda kind: c.badge.filter(F.col("kind") == kind).select("slug", "kind").distinct()
    return pick("process").unionByName(pick("policy"))


@query("set_difference", "SELECT meeting_id FROM meeting WHERE adopted_date IS NOT NULL EXCEPT SELECT meeting_id FROM item WHERE is_consent")
def set_difference(c: Civic) -> DataFrame:
    return c.meeting.filter("adopted_date is not null").select("meeting_id").subtract(c.item.filter("is_consent").select("meeting_id"))
