"""More readers, merges and classification over the civic layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.functions import text as T
from quorumlake.model import AS_OF, Civic
from quorumlake.operators.aggregates import GATE_SQL, as_double, count_by, day, gated
from quorumlake.operators.sequences import DENSE, asof_backward, dense_months, prior_contracts, top_per_key
from quorumlake.plans.registry import query

def process_badges(c: Civic) -> DataFrame:
    """Badge rows of all rules at once: one frame of conditions, exploded, and the two joins that rules need."""
    items = c.item_context().filter("status = 'completed'")
    simple = [
        ("hidden_on_consent", F.col("is_consent") & (F.col("dollars") >= 30000)),
        ("sole_source", F.col("procurement") == "sole_source"),
        ("legal_settlement", F.col("action_type") == "settlement"),
        ("emergency_action", (F.col("action_type") == "emergency_procurement") | F.col("title").rlike(r"(?i)\b(emergency|exigent|expedited)")),
    ]
    fired = F.explode(F.array_compact(F.array(*[F.when(rule, F.lit(slug)) for slug, rule in simple]))).alias("badge")
    votes = c.vote.select("meeting_id", F.expr("nays + abstentions").alias("against"), F.expr("yeas + nays + abstentions").alias("voting"))
    split = items.select("item_id", "meeting_id").join(votes.filter("against > 0"), "meeting_id")
    split_badges = F.explode(F.array_compact(F.array(F.lit("split_vote"), F.when((F.col("against") >= 2) & (F.col("against") > 0.2 * F.col("voting")), "contested")))).alias("badge")
    amended = prior_contracts(c).join(items.select("item_id"), "item_id", "left_semi").select("item_id", F.lit("amends_prior_contract").alias("badge"))
    return items.select("item_id", fired).unionByName(split.select("item_id", split_badges)).unionByName(amended)


@query("cls_process_badges", """SELECT item_id, badge FROM (SELECT item_id, unnest([CASE WHEN is_consent AND dollars >= 30000 THEN 'hidden_on_consent' END, CASE WHEN procurement = 'sole_source' THEN 'sole_source' END,
    CASE WHEN action_type = 'settlement' THEN 'legal_settlement' END, CASE WHEN action_type = 'emergency_procurement' THEN 'emergency_action' END]) AS badge FROM ctx WHERE status = 'completed'
    UNION ALL SELECT i.item_id, unnest(['split_vote', CASE WHEN nays + abstentions >= 2 AND nays + abstentions > 0.2 * (yeas + nays + abstentions) THEN 'contested' END]) FROM ctx i JOIN vote v ON v.meeting_id = i.meeting_id WHERE i.status = 'completed' AND nays + abstentions > 0)
    WHERE badge IS NOT NULL""")
def cls_process_badges(c: Civic) -> DataFrame:
    """All but the prior-contract rule, which mat_prior_contract holds on its own."""
    return process_badges(c).filter("badge <> 'amends_prior_contract'")


@query("cls_process_badges_on_write", "SELECT item_id, CASE WHEN procurement = 'sole_source' THEN 'sole_source' ELSE 'legal_settlement' END AS badge FROM item WHERE procurement = 'sole_source' OR action_type = 'settlement'")
def cls_process_badges_on_write(c: Civic) -> DataFrame:
    first = F.when(F.col("procurement") == "sole_source", "sole_source").when(F.col("action_type") == "settlement", "legal_settlement")
    return c.item.select("item_id", first.alias("badge")).filter("badge is not null")


#: Hints by badge: what rules an item out (action types, phrases), and what matches it, in this order: keywords (whole words, or
#: a pattern with a label), action types, topics.
POLICY_HINTS: dict[str, dict[str, list]] = {
    "street_works": {"excluded_action_types": ["zoning"], "excluded_phrases": ["emergency settlement"], "keywords": ["economy street", ("small tools", r"small\s+(rod|gear)s?\b")]},
    "abatements": {"excluded_phrases": ["widget"], "action_types": ["tax_abatement"], "topics": ["promo"]},
    "anvils": {"excluded_action_types": ["settlement", "contract_award"], "keywords": ["anvil", "bolt"], "topics": ["standard"]},
}


def policy_badges(items: DataFrame, hints: dict[str, dict[str, list]]) -> DataFrame:
    """item_id, badge, how and what: each badge whose hints match an item, by all its matching keywords, else by its action type,
    else by its topic. All badges are judged in one pass."""
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))))
    strings = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    judged = []
    for badge, h in hints.items():
        action, topic = F.col("action_type"), F.col("topic")
        excluded = action.isin(h.get("excluded_action_types", [])) | F.exists(strings(h.get("excluded_phrases", [])), lambda p: F.contains(text, F.lower(p)))
        keywords = [(k, rf"\b\Q{k.lower()}\E\b") if isinstance(k, str) else k for k in h.get("keywords", [])]
        found = F.array_compact(F.array(*[F.when(text.rlike(pattern), F.lit(label)) for label, pattern in keywords]).cast("array<string>"))
        row = lambda how, what, b=badge: F.struct(F.lit(b).alias("badge"), F.lit(how).alias("how"), what.alias("what"))
        match = F.when(F.size(found) > 0, row("keywords", found)).when(action.isin(h.get("action_types", [])), row("action_type", F.array(action))).when(topic.isin(h.get("topics", [])), row("topic", F.array(topic)))
        judged.append(F.when(~F.coalesce(excluded, F.lit(False)), match))
    return items.select("item_id", F.explode(F.array_compact(F.array(*judged))).alias("b")).select("item_id", "b.badge", "b.how", "b.what")


def _policy_sql(hints: dict[str, dict[str, list]]) -> str:
    quoted = lambda values: "('" + "', '".join(values) + "')" if values else "(NULL)"
    text, parts = "lower(concat_ws(' ', coalesce(title, ''), coalesce(description, '')))", []
    for badge, h in hints.items():
        words = [(k, rf"\b{k}\b") if isinstance(k, str) else k for k in h.get("keywords", [])]
        found = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN '{label}' END" for label, p in words) + "]::VARCHAR[], lambda x: x IS NOT NULL)"
        ruled_out = "".join(f" AND NOT contains(t, '{p}')" for p in h.get("excluded_phrases", [])) + (f" AND action_type NOT IN {quoted(h['excluded_action_types'])}" if h.get("excluded_action_types") else "")
        parts.append(f"""SELECT item_id, '{badge}' AS badge, CASE WHEN len(found) > 0 THEN 'keywords' WHEN action_type IN {quoted(h.get('action_types'))} THEN 'action_type' WHEN topic IN {quoted(h.get('topics'))} THEN 'topic' END AS how,
            CASE WHEN len(found) > 0 THEN found WHEN action_type IN {quoted(h.get('action_types'))} THEN [action_type] ELSE [topic] END AS what FROM (SELECT *, {found} AS found FROM (SELECT *, {text} AS t FROM item)) WHERE true{ruled_out}""")
    return f"SELECT item_id, badge, how, array_to_string(what, '|') AS what FROM ({' UNION ALL '.join(parts)}) WHERE how IS NOT NULL"


@query("cls_policy_badges", _policy_sql(POLICY_HINTS))
def cls_policy_badges(c: Civic) -> DataFrame:
    return policy_badges(c.item, POLICY_HINTS).select("item_id", "badge", "how", F.array_join("what", "|").alias("what"))


CONFLICTS = "list_filter([CASE WHEN dollars >= 50000 THEN 'dollars' END, CASE WHEN action_type IN ('settlement', 'zoning') THEN 'action' END, CASE WHEN procurement = 'sole_source' THEN 'procurement' END], lambda x: x IS NOT NULL)"


def conflicts(c: Civic) -> DataFrame:
    """Facts that contradict a low score, and what to do: accept, retry once, else conflict."""
    found = F.array_compact(F.array(F.when(F.col("dollars") >= 50000, "dollars"), F.when(F.col("action_type").isin("settlement", "zoning"), "action"), F.when(F.col("procurement") == "sole_source", "procurement")))
    low = c.item.filter("significance <= 2").select("item_id", "ai_version", found.alias("kinds"))
    return low.withColumn("action", F.when(F.size("kinds") == 0, "accept").when(F.col("ai_version") == 0, "retry").otherwise("conflict"))


@query("cls_reconcile", f"SELECT item_id, array_to_string(k, ',') AS kinds, CASE WHEN len(k) = 0 THEN 'accept' WHEN ai_version = 0 THEN 'retry' ELSE 'conflict' END AS action FROM (SELECT item_id, ai_version, {CONFLICTS} AS k FROM item WHERE significance <= 2)")
def cls_reconcile(c: Civic) -> DataFrame:
    return conflicts(c).select("item_id", F.array_join("kinds", ",").alias("kinds"), "action")


@query("agg_conflict_kinds", f"SELECT kind, count(*) AS n FROM (SELECT unnest({CONFLICTS}) AS kind FROM item WHERE significance <= 2 AND ai_version <> 0) GROUP BY kind")
def agg_conflict_kinds(c: Civic) -> DataFrame:
    return count_by(conflicts(c).filter("action = 'conflict'").select(F.explode("kinds").alias("kind")), "kind")


@query("cls_cross_verify", "SELECT vote_id, CASE WHEN yeas + nays + abstentions = 0 THEN 'extraction_failed' WHEN yeas + nays + abstentions <> n THEN 'counts_mismatch' ELSE 'ok' END AS state FROM vote JOIN (SELECT vote_id, count(*) AS n FROM member_vote GROUP BY 1) USING (vote_id)")
def cls_cross_verify(c: Civic) -> DataFrame:
    total = F.expr("yeas + nays + abstentions")
    n = count_by(c.member_vote, "vote_id")
    return c.vote.join(n, "vote_id").select("vote_id", F.when(total == 0, "extraction_failed").when(total != F.col("n"), "counts_mismatch").otherwise("ok").alias("state"))


@query("agg_count_members_positions", "SELECT vote_id, count(*) FILTER (WHERE position = 'yes') AS yes, count(*) FILTER (WHERE position = 'nay') AS no, count(*) FILTER (WHERE position = 'abstain') AS abstain FROM member_vote GROUP BY 1")
def agg_count_members_positions(c: Civic) -> DataFrame:
    return c.member_vote.groupBy("vote_id").agg(*[F.count_if(F.col("position") == p).alias(n) for p, n in (("yes", "yes"), ("nay", "no"), ("abstain", "abstain"))])


@query("agg_error_patterns", "SELECT CASE WHEN data_quality = 'empty' THEN 'no text' WHEN data_quality = 'no_text_layer' THEN 'scan' ELSE 'other' END AS pattern, count(*) AS n FROM item WHERE status = 'failed_permanent' GROUP BY 1")
def agg_error_patterns(c: Civic) -> DataFrame:
    q = F.col("data_quality")
    return count_by(c.item.filter("status = 'failed_permanent'").select(F.when(q == "empty", "no text").when(q == "no_text_layer", "scan").otherwise("other").alias("pattern")), "pattern")


@query("agg_routine_clusters", "SELECT topic, count(*) AS n, string_agg(title, '|' ORDER BY title) FILTER (WHERE rn <= 3) AS samples FROM (SELECT topic, title, row_number() OVER (PARTITION BY topic ORDER BY title, item_id) AS rn FROM item WHERE significance < 6) GROUP BY topic")
def agg_routine_clusters(c: Civic) -> DataFrame:
    """Routine items by topic with three sample titles; ranks are pruned before the shuffle."""
    routine = c.item.filter("significance < 6").select("topic", "title", "item_id")
    samples = top_per_key(routine, ["topic"], [F.col("title"), F.col("item_id")], 3).groupBy("topic").agg(F.array_join(F.array_sort(F.collect_list("title")), "|").alias("samples"))
    return count_by(routine, "topic").join(samples, "topic", "left")


@query("mat_timestamp", "SELECT v.meeting_id, max(i.item_id) AS item_id, CASE WHEN v.t - max(i.video_sec) < 120 THEN 1.0 WHEN v.t - max(i.video_sec) < 600 THEN 0.8 WHEN v.t - max(i.video_sec) < 1800 THEN 0.5 ELSE 0.3 END::DOUBLE AS confidence FROM (SELECT meeting_id, CAST(1500 + meeting_id % 2000 AS BIGINT) AS t FROM meeting) v JOIN item i ON i.meeting_id = v.meeting_id AND i.video_sec = (SELECT max(video_sec) FROM item j WHERE j.meeting_id = v.meeting_id AND j.video_sec <= v.t) GROUP BY v.meeting_id, v.t")
def mat_timestamp(c: Civic) -> DataFrame:
    """The nearest preceding item with a confidence by the gap."""
    votes = c.meeting.select("meeting_id", (1500 + F.col("meeting_id") % 2000).alias("t"))
    found = asof_backward(votes, c.item.select("meeting_id", F.col("video_sec").alias("t"), "item_id"), "meeting_id", "t", "item_id").filter("item_id is not null")
    both = found.join(c.item.select("item_id", "video_sec"), "item_id")
    return both.select("meeting_id", "item_id", T.vote_confidence(F.col("t") - F.col("video_sec"), F.lit(False)).alias("confidence"))


@query("mat_member_names", "SELECT mv.vote_id, mv.member_id AS said, m.member_id FROM member_vote mv JOIN member m ON lower(m.member_name) = 'supplier#' || lpad(CAST(mv.member_id AS VARCHAR), 9, '0')")
def mat_member_names(c: Civic) -> DataFrame:
    """Names resolve through their lower-case variants, the longest first."""
    variants = c.member.select("member_id", F.explode(F.array_union(T.name_variants(F.col("member_name")), F.array(F.lower("member_name")))).alias("variant"))
    said = c.member_vote.select("vote_id", F.col("member_id").alias("said"), F.concat(F.lit("supplier#"), F.lpad(F.col("member_id").cast("string"), 9, "0")).alias("variant"))
    hits = said.join(variants, "variant").groupBy("vote_id", "said").agg(F.max_by("member_id", F.struct(F.length("variant"), -F.col("member_id"))).alias("member_id"))
    return hits


@query("mat_roster", "SELECT m.meeting_id, count(t.member_id) AS members FROM meeting m LEFT JOIN member t ON t.city_id = m.city_id AND t.active AND t.term_start <= m.meeting_date AND (t.term_end IS NULL OR m.meeting_date < t.term_end) GROUP BY 1")
def mat_roster(c: Civic) -> DataFrame:
    return c.meeting.select("meeting_id", "city_id", "meeting_date").join(roster(c.meeting, c.member.filter("active")), ["city_id", "meeting_date"], "left").select("meeting_id", F.coalesce("members", F.lit(0)).alias("members"))


def roster(meetings: DataFrame, members: DataFrame) -> DataFrame:
    """city_id, meeting_date, members: how many half-open terms hold each day with a meeting. Terms that begin and end are summed by
    day and carried forward, so that no meeting is paired with members."""
    terms = members.filter("city_id is not null and term_start is not null and (term_end is null or term_start < term_end)")
    change = F.explode(F.array(F.struct(F.col("term_start").alias("day"), F.lit(1).alias("by")), F.struct(F.col("term_end").alias("day"), F.lit(-1).alias("by"))))
    days = terms.select("city_id", change.alias("c")).filter("c.day is not null").groupBy("city_id", F.col("c.day").alias("meeting_date")).agg(F.sum("c.by").alias("by"))
    held = days.withColumn("members", F.sum("by").over(Window.partitionBy("city_id").orderBy("meeting_date")))
    asked = meetings.select("city_id", "meeting_date").distinct()
    return asof_backward(asked, held.select("city_id", "meeting_date", "members"), "city_id", "meeting_date", "members")


#: So many keys with their rows are broadcast, about half a kilobyte each.
FEW_KEYS = 10_000


def related(items: DataFrame, key: str, k: int = 3) -> DataFrame:
    """Up to k items with the same key in other meetings, the largest first, for every item.

    Whatever the meeting, these k are among the k largest items of the k + 1 meetings that have the largest, so at most
    k * (k + 1) rows a key are kept, as one row; items are joined with that row alone. Only meetings with an item of a key's floor
    are ranked: meetings are dealt into parts and the floor is the (k + 1)-th largest of the parts' maxima, which k + 1 meetings
    reach; without so many parts there is none. Few keys, by count, are broadcast.
    """
    every = items.select(key, "meeting_id", "dollars", F.col("item_id").alias("other")).filter(F.col(key).isNotNull())
    parts = every.groupBy(key, F.pmod(F.xxhash64("meeting_id"), F.lit(2 * (k + 1))).alias("_part")).agg(F.max("dollars").alias("top"))
    floors = parts.groupBy(key).agg(F.sort_array(F.collect_list("top"), asc=False).alias("_tops")).select(key, F.get("_tops", F.lit(k)).alias("_floor"))
    few = floors.limit(FEW_KEYS + 1).count() <= FEW_KEYS
    small = F.broadcast if few else lambda frame: frame
    high = every.join(small(floors), key).filter("_floor is null or dollars >= _floor").select(key, "meeting_id").distinct()
    rows = every.join(high, [key, "meeting_id"], "left_semi")
    size = F.struct((-F.col("dollars")).alias("d"), "other")
    of_meeting = Window.partitionBy(key, "meeting_id").orderBy(F.col("dollars").desc(), "other")
    kept = rows.withColumn("_r", F.row_number().over(of_meeting)).filter(F.col("_r") <= k)
    meetings = kept.filter("_r = 1").withColumn("_m", F.row_number().over(Window.partitionBy(key).orderBy(F.col("dollars").desc(), "other"))).filter(F.col("_m") <= k + 1)
    best = kept.join(meetings.select(key, "meeting_id"), [key, "meeting_id"]).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[size[f].alias(f) for f in ("d", "other")], "meeting_id"))).alias("_best"))
    asked = items.select("item_id", key, F.col("meeting_id").alias("_own")).join(small(best), key)
    chosen = F.slice(F.filter("_best", lambda x: x["meeting_id"] != F.col("_own")), 1, k)
    return asked.select("item_id", F.explode(F.transform(chosen, lambda x: x["other"])).alias("other"))


def _related_sql(key: str) -> str:
    return f"""SELECT item_id, other FROM (SELECT a.item_id, b.item_id AS other, row_number() OVER (PARTITION BY a.item_id ORDER BY b.dollars DESC, b.item_id) AS rn
        FROM item a JOIN item b ON a.{key} = b.{key} AND a.meeting_id <> b.meeting_id) WHERE rn <= 3"""


@query("mat_related_topic", _related_sql("topic"))
def mat_related_topic(c: Civic) -> DataFrame:
    return related(c.item, "topic")


@query("mat_related_sponsor", _related_sql("sponsor"))
def mat_related_sponsor(c: Civic) -> DataFrame:
    return related(c.item, "sponsor")


@query("mrg_badges_refresh", "SELECT item_id, slug AS badge, 'kept' AS origin FROM badge WHERE kind = 'policy' UNION ALL SELECT item_id, 'sole_source', 'new' FROM item WHERE procurement = 'sole_source'")
def mrg_badges_refresh(c: Civic) -> DataFrame:
    """Process badges are recomputed, the others stay; a key already held is ignored."""
    kept = c.badge.filter("kind = 'policy'").select("item_id", F.col("slug").alias("badge"), F.lit("kept").alias("origin"))
    new = c.item.filter("procurement = 'sole_source'").select("item_id", F.lit("sole_source").alias("badge"), F.lit("new").alias("origin"))
    return kept.unionByName(new.join(kept, ["item_id", "badge"], "left_anti"))


@query("mrg_ocr_votes_idempotent", "SELECT DISTINCT meeting_id, video_sec FROM item")
def mrg_ocr_votes_idempotent(c: Civic) -> DataFrame:
    return c.item.select("meeting_id", "video_sec").dropDuplicates(["meeting_id", "video_sec"])


@query("mrg_batch_results", "SELECT i.item_id, CASE WHEN i.ai_version = 0 THEN 'failed' ELSE 'completed' END AS status FROM item i WHERE i.status = 'pending' AND i.item_id % 11 <> 0")
def mrg_batch_results(c: Civic) -> DataFrame:
    """Results keyed item-<id>-<stage>; malformed keys are skipped."""
    key = F.when(F.col("item_id") % 11 == 0, "bad").otherwise(F.concat(F.lit("item-"), F.col("item_id").cast("string"), F.lit("-rewrite")))
    results = c.item.filter("status = 'pending'").select(key.alias("key"), (F.col("ai_version") != 0).alias("ok"))
    parsed = results.select(F.try_element_at(F.split("key", "-"), F.lit(2)).try_cast("long").alias("item_id"), "ok").filter("item_id is not null")
    return c.item.select("item_id").join(parsed, "item_id").select("item_id", F.when(F.col("ok"), "completed").otherwise("failed").alias("status"))


@query("mrg_hide_meeting", "SELECT meeting_id, is_hidden OR meeting_id % 50 = 0 AS is_hidden FROM meeting")
def mrg_hide_meeting(c: Civic) -> DataFrame:
    actions = c.meeting.filter("meeting_id % 50 = 0").select("meeting_id", F.lit(True).alias("_hide"))
    return c.meeting.select("meeting_id", "is_hidden").join(actions, "meeting_id", "left").select("meeting_id", F.coalesce("_hide", "is_hidden").alias("is_hidden"))


@query("mrg_rescan", "SELECT meeting_id, member_id FROM (SELECT vote_id AS meeting_id, member_id FROM member_vote) WHERE meeting_id % 50 <> 0")
def mrg_rescan(c: Civic) -> DataFrame:
    again = c.meeting.filter("meeting_id % 50 = 0").select(F.col("meeting_id").alias("vote_id"))
    return c.member_vote.join(again, "vote_id", "left_anti").select(F.col("vote_id").alias("meeting_id"), "member_id")


@query("sink_audit_append", "SELECT item_id, badge_status AS from_status, 'flagged' AS to_status FROM badge WHERE kind = 'policy' AND source = 'llm' AND badge_status = 'applied'")
def sink_audit_append(c: Civic) -> DataFrame:
    """The change set of a status change, for an append-only log: only rows that really change."""
    return c.badge.filter("kind = 'policy' and source = 'llm' and badge_status = 'applied'").select("item_id", F.col("badge_status").alias("from_status"), F.lit("flagged").alias("to_status"))


@query("view_event_props_daily", "SELECT CAST(day AS VARCHAR) AS day, event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM web GROUP BY ALL")
def view_event_props_daily(c: Civic) -> DataFrame:
    return count_by(c.web.select(F.col("day").cast("string").alias("day"), "event_type", F.get_json_object("props", "$.k").alias("k")), "day", "event_type", "k")


@query("q_meetings", "SELECT city_id, meeting_id, title, count(*) OVER (PARTITION BY city_id) AS total FROM meeting WHERE NOT is_hidden AND meeting_date >= DATE '2001-01-01'")
def q_meetings(c: Civic) -> DataFrame:
    rows = c.meeting.filter("not is_hidden and meeting_date >= date'2001-01-01'").select("city_id", "meeting_id", "title")
    return rows.join(F.broadcast(count_by(rows, "city_id", name="total")), "city_id")  # a row a city


@query("q_council_members", "SELECT m.member_id, m.member_name, c.slug FROM member m LEFT JOIN city c ON c.city_id = m.city_id WHERE m.active")
def q_council_members(c: Civic) -> DataFrame:
    return c.member.filter("active").join(F.broadcast(c.city.select("city_id", "slug")), "city_id", "left").select("member_id", "member_name", "slug")


@query("q_member_summary", "SELECT member_id, count(*) AS votes, count(*) FILTER (WHERE position = 'nay') AS nays, max(vote_id) AS latest FROM member_vote GROUP BY 1")
def q_member_summary(c: Civic) -> DataFrame:
    return c.member_vote.groupBy("member_id").agg(F.count(F.lit(1)).alias("votes"), F.count_if(F.col("position") == "nay").alias("nays"), F.max("vote_id").alias("latest"))


@query("q_items_by_topic", "SELECT topic, item_id FROM (SELECT topic, item_id, row_number() OVER (PARTITION BY topic ORDER BY meeting_date DESC, item_id) AS rn FROM ctx WHERE status <> 'withdrawn') WHERE rn <= 25")
def q_items_by_topic(c: Civic) -> DataFrame:
    items = c.item_context().filter("status <> 'withdrawn'").select("topic", "item_id", "meeting_date")
    return top_per_key(items, ["topic"], [F.col("meeting_date").desc(), F.col("item_id")], 25).select("topic", "item_id")


@query("q_city_kpis", "SELECT slug, count(*) AS items, count(DISTINCT meeting_id) AS meetings, CAST(sum(dollars) AS DOUBLE) AS dollars FROM ctx GROUP BY slug")
def q_city_kpis(c: Civic) -> DataFrame:
    return c.item_context().groupBy("slug").agg(F.count(F.lit(1)).alias("items"), F.count_distinct("meeting_id").alias("meetings"), as_double(F.sum("dollars")).alias("dollars"))


@query("q_badge_volume_series", f"SELECT city_id, CAST(month AS VARCHAR) AS month, n, CAST(sum(n) OVER (PARTITION BY city_id ORDER BY month) AS BIGINT) AS running FROM ({DENSE})")
def q_badge_volume_series(c: Civic) -> DataFrame:
    series = dense_months(c.badge, "city_id", "detected_on", "1997-01-01", "1998-12-01")
    return series.select("city_id", F.col("month").cast("string").alias("month"), "n", F.sum("n").over(Window.partitionBy("city_id").orderBy("month")).alias("running"))


@query("q_mayoral_overlay", "SELECT member_id, least(coalesce(term_end, DATE '1999-01-01'), DATE '1999-01-01') - greatest(term_start, DATE '1997-01-01') AS days FROM member WHERE term_start < DATE '1999-01-01' AND coalesce(term_end, DATE '1999-01-01') > DATE '1997-01-01'")
def q_mayoral_overlay(c: Civic) -> DataFrame:
    low, high = F.lit("1997-01-01").cast("date"), F.lit("1999-01-01").cast("date")
    days = F.datediff(F.least(F.coalesce("term_end", high), high), F.greatest("term_start", low)).cast("long")
    return c.member.select("member_id", days.alias("days")).filter("days > 0")


@query("q_calib_false_positives", "SELECT slug AS badge, count(*) AS removals, string_agg(DISTINCT source, ',' ORDER BY source) AS reasons FROM badge WHERE badge_status = 'flagged' GROUP BY 1 HAVING count(*) >= 5")
def q_calib_false_positives(c: Civic) -> DataFrame:
    return c.badge.filter("badge_status = 'flagged'").groupBy(F.col("slug").alias("badge")).agg(F.count(F.lit(1)).alias("removals"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("reasons")).filter("removals >= 5")


@query("q_category_page", f"SELECT i.slug AS city, b.slug AS badge, count(*) AS items, count(DISTINCT i.meeting_id) AS meetings, CAST(max(i.meeting_date) AS VARCHAR) AS latest FROM badge b JOIN ctx i ON i.item_id = b.item_id WHERE {GATE_SQL} GROUP BY ALL")
def q_category_page(c: Civic) -> DataFrame:
    return gated(c).groupBy(F.col("city_slug").alias("city"), F.col("slug").alias("badge")).agg(F.count(F.lit(1)).alias("items"), F.count_distinct("meeting_id").alias("meetings"), F.max("meeting_date").cast("string").alias("latest"))


@query("q_upcoming_meetings", f"SELECT city_id, min(meeting_date)::VARCHAR AS next, count(*) AS n FROM meeting WHERE NOT is_hidden AND meeting_date >= DATE '{AS_OF}' GROUP BY 1")
def q_upcoming_meetings(c: Civic) -> DataFrame:
    return c.meeting.filter(~F.col("is_hidden") & (F.col("meeting_date") >= day())).groupBy("city_id").agg(F.min("meeting_date").cast("string").alias("next"), F.count(F.lit(1)).alias("n"))


@query("txt_item_number_in_text", r"SELECT meeting_id, regexp_extract(title, 'Item ([0-9]+)', 1) AS number, min(video_sec) AS video_sec FROM item WHERE regexp_matches(title, 'Item [0-9]+') GROUP BY ALL")
def txt_item_number_in_text(c: Civic) -> DataFrame:
    number = F.regexp_extract("title", r"Item (\d+)", 1)
    return c.item.filter(F.col("title").rlike(r"Item \d+")).groupBy("meeting_id", number.alias("number")).agg(F.min("video_sec").alias("video_sec"))


@query("win_adjacent_slices", "SELECT item_id, video_sec, lead(video_sec) OVER (PARTITION BY meeting_id ORDER BY video_sec, item_id) AS ends FROM item")
def win_adjacent_slices(c: Civic) -> DataFrame:
    return c.item.select("item_id", "video_sec", F.lead("video_sec").over(Window.partitionBy("meeting_id").orderBy("video_sec", "item_id")).alias("ends"))


@query("set_intersect_words", "SELECT item_id, len(list_intersect(list_distinct(string_split(lower(counterparty), ' ')), list_distinct(string_split(lower(title), ' ')))) AS shared FROM item")
def set_intersect_words(c: Civic) -> DataFrame:
    words = lambda x: F.array_distinct(F.split(F.lower(x), " "))
    return c.item.select("item_id", F.size(F.array_intersect(words("counterparty"), words("title"))).cast("long").alias("shared"))


@query("prj_lean_facts", "SELECT item_id, action_type, CASE WHEN procurement = 'sole_source' THEN procurement END AS procurement FROM item")
def prj_lean_facts(c: Civic) -> DataFrame:
    """Facts pruned to known keys through a struct; nulls drop out of the JSON."""
    facts = F.to_json(F.struct("action_type", F.when(F.col("procurement") == "sole_source", F.col("procurement")).alias("procurement"), "counterparty"))
    lean = c.item.select("item_id", F.from_json(facts, "action_type string, procurement string").alias("f"))
    return lean.select("item_id", "f.action_type", "f.procurement")
