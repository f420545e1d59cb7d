"""Named readers: each answers for all keys at once and is a short composition of the operators; and small joins and sorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.model import AS_OF, Civic
from quorumlake.operators.aggregates import count_by, day, gated
from quorumlake.plans.registry import alias, query

for reader, operator in {
    "q_dashboard": "agg_dashboard_totals",
    "q_member_stats": "agg_member_stats",
    "q_topic_counts": "agg_topic_counts",
    "q_category_kpis": "agg_badge_kpis",
    "q_category_tally": "agg_badge_tally",
    "q_badge_volume_year": "agg_badge_volume_year",
    "q_high_dollar": "topk_recency_dollars",
    "q_upcoming_hearings": "set_union_hearings",
    "q_vote_for_item": "win_prevailing_vote",
    "q_calib_drift": "win_lag_week_delta",
    "q_contested_votes": "topk_per_key_recent",
    "q_badge_audit": "join_left_chain_audit",
    "q_referrers": "view_referrers_daily",
    "q_geo": "view_geo_daily",
}.items():
    alias(reader, operator)

# Badge templates, their kind, label and place in lists (process badges by alarm).
TEMPLATES = [("high_dollar", "policy", "High dollar", 0), ("hidden_on_consent", "process", "Hidden on consent", 1), ("sole_source", "process", "Sole source", 2)]
TEMPLATE_SQL = "(VALUES " + ", ".join(f"({slug!r}, {kind!r}, {label!r}, {place})" for slug, kind, label, place in TEMPLATES) + ") AS t(badge, kind, label, place)"
#: A city's own settings: a label and a threshold of its own, or the badge switched off.
CONFIG_SQL = f"""config AS (SELECT city_id, slug AS city, badge, kind, place, CASE WHEN city_id % 5 = 0 THEN label || ' (' || slug || ')' ELSE label END AS label,
    city_id % 4 <> 0 OR kind = 'process' AS enabled, CASE WHEN kind = 'policy' THEN CASE WHEN city_id % 3 = 0 THEN CAST(city_id % 7 AS INTEGER) ELSE 3 END END AS threshold
    FROM city CROSS JOIN {TEMPLATE_SQL} WHERE active)"""


def templates(c: Civic) -> DataFrame:
    return c.spark.createDataFrame(TEMPLATES, "badge string, kind string, label string, place int")


def badge_config(c: Civic) -> DataFrame:
    """Every active city and badge template with the city's own label, switch and threshold; policy badges start at 3."""
    both = c.city.filter("active").crossJoin(F.broadcast(templates(c)))  # a few badges for each of the nations
    city = F.col("city_id")
    label = F.when(city % 5 == 0, F.concat("label", F.lit(" ("), "slug", F.lit(")"))).otherwise(F.col("label"))
    threshold = F.when(F.col("kind") == "policy", F.when(city % 3 == 0, (city % 7).cast("int")).otherwise(3))
    enabled = (city % 4 != 0) | (F.col("kind") == "process")
    return both.select("city_id", F.col("slug").alias("city"), "badge", "kind", "place", label.alias("label"), enabled.alias("enabled"), threshold.alias("threshold"))


@query("join_cross_seed", f", {CONFIG_SQL} SELECT city_id, badge FROM config")
def join_cross_seed(c: Civic) -> DataFrame:
    return badge_config(c).select("city_id", "badge")


@query("q_significance_threshold", f", {CONFIG_SQL} SELECT city, badge, threshold FROM config")
def q_significance_threshold(c: Civic) -> DataFrame:
    return badge_config(c).select("city", "badge", "threshold")


@query("q_matcher_hints", f", {CONFIG_SQL} SELECT city, badge, CASE WHEN city_id % 5 = 0 THEN badge || ',' || city ELSE badge END AS hints FROM config WHERE enabled")
def q_matcher_hints(c: Civic) -> DataFrame:
    """The template's hints and the city's own after them."""
    own = F.when(F.col("city_id") % 5 == 0, F.col("city"))
    return badge_config(c).filter("enabled").select("city", "badge", F.concat_ws(",", "badge", own).alias("hints"))


@query("q_resolve_badges", f", {CONFIG_SQL} SELECT city, badge, label FROM config")
def q_resolve_badges(c: Civic) -> DataFrame:
    return badge_config(c).select("city", "badge", "label")


@query("q_resolved_badge", f", {CONFIG_SQL} SELECT item_id, slug AS badge, label FROM badge JOIN config ON config.city_id = badge.city_id AND config.badge = badge.slug")
def q_resolved_badge(c: Civic) -> DataFrame:
    config = badge_config(c).select("city_id", F.col("badge").alias("slug"), "label")
    return c.badge.join(F.broadcast(config), ["city_id", "slug"]).select("item_id", F.col("slug").alias("badge"), "label")  # bounded: cities x templates


def _listed(name: str, condition: str) -> None:
    @query(name, f", {CONFIG_SQL} SELECT city, string_agg(badge, ',' ORDER BY place, badge) AS badges FROM config WHERE {condition} GROUP BY city")
    def badges_in_order(c: Civic) -> DataFrame:
        """The badges of each city in display order."""
        rows = F.array_sort(F.collect_list(F.struct("place", "badge")))
        return badge_config(c).filter(condition).groupBy("city").agg(F.array_join(F.transform(rows, lambda r: r["badge"]), ",").alias("badges"))


_listed("q_policy_badges", "kind = 'policy'")
_listed("q_process_badges", "kind = 'process'")
_listed("q_enabled_badges", "enabled")


@query("sort_badges", f"SELECT item_id, string_agg(slug, ',' ORDER BY CASE WHEN kind = 'process' THEN 0 ELSE 1 END, place, confidence DESC, slug) AS badges FROM badge JOIN {TEMPLATE_SQL.replace('kind, label', 'template_kind, label')} ON badge = slug GROUP BY item_id")
def sort_badges(c: Civic) -> DataFrame:
    """An item's badges: process ones by alarm, then policy ones by falling confidence."""
    placed = c.badge.join(F.broadcast(templates(c).select(F.col("badge").alias("slug"), "place")), "slug")
    key = F.struct((F.col("kind") != "process").cast("int").alias("a"), "place", (-F.col("confidence")).alias("b"), "slug")
    rows = placed.groupBy("item_id").agg(F.array_sort(F.collect_list(key)).alias("rows"))
    return rows.select("item_id", F.array_join(F.transform("rows", lambda r: r["slug"]), ",").alias("badges"))


@query("q_apply_gate", f", {CONFIG_SQL} SELECT b.item_id, b.slug AS badge FROM badge b JOIN item i ON i.item_id = b.item_id JOIN config f ON f.city_id = b.city_id AND f.badge = b.slug WHERE coalesce(i.significance, 0) >= coalesce(f.threshold, 0)")
def q_apply_gate(c: Civic) -> DataFrame:
    """Badges on items at or above their city's threshold; a score that is null counts as 0."""
    config = F.broadcast(badge_config(c).select("city_id", F.col("badge").alias("slug"), "threshold"))  # bounded: cities x templates
    rows = c.badge_rows.select("item_id", "city_id", "slug", "significance").join(config, ["city_id", "slug"])
    return rows.filter(F.coalesce("significance", F.lit(0)) >= F.coalesce("threshold", F.lit(0))).select("item_id", F.col("slug").alias("badge"))


@query("q_municipality", "SELECT c.slug, c.city_name, c.state, count(m.meeting_id) AS meetings, CAST(max(m.meeting_date) AS VARCHAR) AS latest FROM city c LEFT JOIN meeting m ON m.city_id = c.city_id AND NOT m.is_hidden WHERE c.active GROUP BY ALL")
def q_municipality(c: Civic) -> DataFrame:
    held = c.meeting.filter(~F.col("is_hidden")).groupBy("city_id").agg(F.count(F.lit(1)).alias("n"), F.max("meeting_date").cast("string").alias("latest"))
    return c.city.filter("active").join(held, "city_id", "left").select("slug", "city_name", "state", F.coalesce("n", F.lit(0)).alias("meetings"), "latest")


@query("q_meeting", "SELECT m.meeting_id, slug, title, CAST(meeting_date AS VARCHAR) AS meeting_date, start_sec, external_id, is_hidden FROM meeting m JOIN city USING (city_id)")
def q_meeting(c: Civic) -> DataFrame:
    return c.meeting.join(F.broadcast(c.city), "city_id").select("meeting_id", "slug", "title", F.col("meeting_date").cast("string").alias("meeting_date"), "start_sec", "external_id", "is_hidden")


_CARD_BADGES = "coalesce((SELECT string_agg(slug, ',' ORDER BY slug) FROM badge b WHERE b.item_id = i.item_id AND b.badge_status = 'applied'), '')"
_NATURAL = "coalesce(TRY_CAST(regexp_extract(item_number, '^([0-9]+)', 1) AS INTEGER), 999999)"


def with_badges(items: DataFrame, c: Civic) -> DataFrame:
    """items with `badges`, the applied ones in alphabetical order, empty if none."""
    held = c.badge.filter("badge_status = 'applied'").groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_list("slug")), ",").alias("badges"))
    return items.join(held, "item_id", "left").withColumn("badges", F.coalesce("badges", F.lit("")))


def natural(number: Column) -> Column:
    return F.coalesce(F.regexp_extract(number, r"^([0-9]+)", 1).try_cast("int"), F.lit(999999))


@query("q_agenda_items", f"""SELECT i.item_id, i.meeting_id, i.title, b.badges, row_number() OVER (PARTITION BY i.meeting_id ORDER BY {_NATURAL}, item_number, i.item_id) AS place FROM ctx i
    JOIN (SELECT i.item_id, coalesce(string_agg(slug, ',' ORDER BY slug), '') AS badges FROM item i LEFT JOIN badge b ON b.item_id = i.item_id AND b.badge_status = 'applied' GROUP BY 1) b ON b.item_id = i.item_id WHERE i.status <> 'withdrawn'""")
def q_agenda_items(c: Civic) -> DataFrame:
    """The cards of each meeting in natural order of their numbers; a meeting's items are few."""
    items = with_badges(c.item_context().filter("status <> 'withdrawn'"), c)
    order = Window.partitionBy("meeting_id").orderBy(natural(F.col("item_number")), "item_number", "item_id")
    return items.select("item_id", "meeting_id", "title", "badges", F.row_number().over(order).alias("place"))


@query("q_agenda_item", "SELECT i.item_id, i.title, i.status, m.is_hidden, coalesce(b.badges, '') AS badges FROM item i JOIN meeting m ON m.meeting_id = i.meeting_id LEFT JOIN (SELECT item_id, string_agg(slug, ',' ORDER BY slug) AS badges FROM badge WHERE badge_status = 'applied' GROUP BY 1) b ON b.item_id = i.item_id")
def q_agenda_item(c: Civic) -> DataFrame:
    """Permalinks: withdrawn items too; is_hidden tells what only an administrator sees."""
    items = c.item.join(c.meeting.select("meeting_id", "is_hidden"), "meeting_id")
    return with_badges(items, c).select("item_id", "title", "status", "is_hidden", "badges")


@query("q_recent_votes", "SELECT city_id, vote_id, result FROM (SELECT m.city_id, v.vote_id, v.result, row_number() OVER (PARTITION BY m.city_id ORDER BY v.meeting_date DESC, v.vote_id DESC) AS rank FROM vote v JOIN meeting m ON m.meeting_id = v.meeting_id WHERE NOT m.is_hidden) WHERE rank <= 5")
def q_recent_votes(c: Civic) -> DataFrame:
    """The five newest votes of each city: the filter on the row number is pushed into a limit of each partition."""
    rows = c.vote.join(c.meeting.filter(~F.col("is_hidden")).select("meeting_id", "city_id"), "meeting_id")
    newest = Window.partitionBy("city_id").orderBy(F.col("meeting_date").desc(), F.col("vote_id").desc())
    return rows.withColumn("rank", F.row_number().over(newest)).filter("rank <= 5").select("city_id", "vote_id", "result")


@query("q_member", "SELECT member_id, member_name, slug, party, m.active, CAST(term_start AS VARCHAR) AS term_start, 'District ' || CAST(member_id % 9 + 1 AS VARCHAR) AS district FROM member m JOIN city USING (city_id)")
def q_member(c: Civic) -> DataFrame:
    city = F.broadcast(c.city.select("city_id", "slug"))  # a row a nation
    district = F.concat(F.lit("District "), (F.col("member_id") % 9 + 1).cast("string"))
    return c.member.join(city, "city_id").select("member_id", "member_name", "slug", "party", "active", F.col("term_start").cast("string").alias("term_start"), district.alias("district"))


@query("q_sponsored_items", "SELECT member_id, item_id, CAST(meeting_date AS VARCHAR) AS meeting_date FROM ctx WHERE (meeting_date, item_id) < (DATE '1998-01-01', 5000)")
def q_sponsored_items(c: Civic) -> DataFrame:
    """Every sponsor's items before a cursor of date and id; a caller takes a page of one sponsor."""
    before = F.struct("meeting_date", "item_id") < F.struct(F.lit("1998-01-01").cast("date").alias("meeting_date"), F.lit(5000).cast("long").alias("item_id"))
    return c.item_context().filter(before).select("member_id", "item_id", F.col("meeting_date").cast("string").alias("meeting_date"))


@query("q_recent_meetings", f"SELECT meeting_id, slug, title FROM meeting JOIN city USING (city_id) WHERE NOT is_hidden AND active AND meeting_date BETWEEN DATE '{AS_OF}' - 30 AND DATE '{AS_OF}' - 1")
def q_recent_meetings(c: Civic) -> DataFrame:
    near = c.meeting.filter(~F.col("is_hidden") & F.col("meeting_date").between(F.date_sub(day(), 30), F.date_sub(day(), 1)))
    return near.join(F.broadcast(c.city.filter("active")), "city_id").select("meeting_id", "slug", "title")


@query("q_topics_index", "SELECT slug, topic, count(*) AS n FROM ctx WHERE status <> 'withdrawn' GROUP BY ALL")
def q_topics_index(c: Civic) -> DataFrame:
    """Topics of each city that have items."""
    return count_by(c.item_context().filter("status <> 'withdrawn'"), "slug", "topic")


@query("q_backfill_ratio", """SELECT slug, ratio, CASE WHEN ratio IS NULL THEN 'none' WHEN ratio < 0.05 THEN 'start' WHEN ratio < 0.95 THEN 'partial' ELSE 'done' END AS banner FROM (
    SELECT c.slug, round(count(*) FILTER (WHERE i.status = 'completed' AND i.ai_version >= 3)::DOUBLE / nullif(count(i.item_id) FILTER (WHERE i.status <> 'failed_permanent'), 0), 6) AS ratio
    FROM city c LEFT JOIN meeting m ON m.city_id = c.city_id LEFT JOIN item i ON i.meeting_id = m.meeting_id GROUP BY c.slug)""")
def q_backfill_ratio(c: Civic) -> DataFrame:
    from quorumlake.operators.sequences import mv_city_backfill_ratio

    ratio = F.col("ratio")
    banner = F.when(ratio.isNull(), "none").when(ratio < 0.05, "start").when(ratio < 0.95, "partial").otherwise("done")
    return mv_city_backfill_ratio(c).select("slug", "ratio", banner.alias("banner"))


@query("q_failed_permanent", "SELECT i.item_id, slug, CAST(generated_on AS VARCHAR) AS since FROM item i JOIN meeting m ON m.meeting_id = i.meeting_id JOIN city USING (city_id) WHERE status = 'failed_permanent'")
def q_failed_permanent(c: Civic) -> DataFrame:
    failed = c.item.filter("status = 'failed_permanent'").join(c.meeting.select("meeting_id", "city_id"), "meeting_id")
    return failed.join(F.broadcast(c.city), "city_id").select("item_id", "slug", F.col("generated_on").cast("string").alias("since"))


@query("q_badges_on_item", "SELECT item_id, slug AS badge, kind, CAST(confidence AS DOUBLE) AS confidence, source, badge_status FROM badge")
def q_badges_on_item(c: Civic) -> DataFrame:
    return c.badge.select("item_id", F.col("slug").alias("badge"), "kind", F.col("confidence").cast("double").alias("confidence"), "source", "badge_status")


@query("q_badge_review", "SELECT b.item_id, b.slug AS badge, i.title, CAST(b.confidence AS DOUBLE) AS confidence FROM badge b JOIN ctx i ON i.item_id = b.item_id WHERE b.badge_status = 'flagged'")
def q_badge_review(c: Civic) -> DataFrame:
    flagged = c.badge.filter("badge_status = 'flagged'").select("item_id", F.col("slug").alias("badge"), F.col("confidence").cast("double").alias("confidence"))
    return flagged.join(c.item_context().select("item_id", "title"), "item_id").select("item_id", "badge", "title", "confidence")


@query("q_calib_divergence", f"SELECT item_id, significance - consent_score AS delta FROM item WHERE generated_on BETWEEN DATE '{AS_OF}' - 30 AND DATE '{AS_OF}' AND abs(significance - consent_score) > 3")
def q_calib_divergence(c: Civic) -> DataFrame:
    """Scores that the rules moved by more than three in the window before the as-of date."""
    delta = F.col("significance") - F.col("consent_score")
    return c.item.filter(F.col("generated_on").between(F.date_sub(day(), 30), day()) & (F.abs(delta) > 3)).select("item_id", delta.alias("delta"))


@query("q_calib_overscoring", "SELECT action_type, count(*) AS n, round(100.0 * count(*) FILTER (WHERE significance - consent_score > 3) / count(*), 1)::DOUBLE AS pct FROM item WHERE status = 'completed' GROUP BY 1 HAVING count(*) >= 30 AND count(*) FILTER (WHERE significance - consent_score > 3) > 0.2 * count(*)")
def q_calib_overscoring(c: Civic) -> DataFrame:
    hit = F.count_if(F.col("significance") - F.col("consent_score") > 3)
    counts = c.item.filter("status = 'completed'").groupBy("action_type").agg(F.count(F.lit(1)).alias("n"), hit.alias("hit"))
    return counts.filter("n >= 30 and hit > 0.2 * n").select("action_type", "n", F.round(100.0 * F.col("hit") / F.col("n"), 1).cast("double").alias("pct"))


@query("q_calib_summary", """SELECT count(*) AS items, count(*) FILTER (WHERE abs(significance - consent_score) > 3) AS diverging, count(*) FILTER (WHERE consent_score - significance > 3) AS under,
    count(*) FILTER (WHERE significance - consent_score > 3) AS over FROM item WHERE status = 'completed'""")
def q_calib_summary(c: Civic) -> DataFrame:
    delta = F.col("significance") - F.col("consent_score")
    checks = {"diverging": F.abs(delta) > 3, "under": delta < -3, "over": delta > 3}
    return c.item.filter("status = 'completed'").agg(F.count(F.lit(1)).alias("items"), *[F.count_if(x).alias(n) for n, x in checks.items()])


# Price of a thousand characters by model version.
PRICES = {0: 1, 1: 2, 2: 3, 3: 5, 4: 5}
_PRICE_SQL = "CASE ai_version " + " ".join(f"WHEN {v} THEN {p}" for v, p in PRICES.items()) + " END"


def ai_cost(c: Civic) -> Column:
    price = F.coalesce(*[F.when(F.col("ai_version") == v, p) for v, p in PRICES.items()])
    return F.length("title").cast("long") * price


@query("agg_ai_cost", f"SELECT CAST(generated_on AS VARCHAR) AS day, count(*) AS runs, CAST(sum(CAST(length(title) AS BIGINT) * {_PRICE_SQL}) AS BIGINT) AS cost FROM item WHERE generated_on BETWEEN DATE '{AS_OF}' - 6 AND DATE '{AS_OF}' GROUP BY 1")
def agg_ai_cost(c: Civic) -> DataFrame:
    """Runs and cost of each of the last seven days."""
    week = c.item.filter(F.col("generated_on").between(F.date_sub(day(), 6), day()))
    return week.groupBy(F.col("generated_on").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("runs"), F.sum(ai_cost(c)).alias("cost"))


@query("q_ai_panel", f"""SELECT 'pending' AS what, CAST(status AS VARCHAR) AS name, count(*) AS n FROM item WHERE status = 'pending' GROUP BY ALL
    UNION ALL SELECT 'cost', 'week', CAST(sum(CAST(length(title) AS BIGINT) * {_PRICE_SQL}) AS BIGINT) FROM item WHERE generated_on BETWEEN DATE '{AS_OF}' - 6 AND DATE '{AS_OF}'
    UNION ALL SELECT * FROM (SELECT 'run', CAST(item_id AS VARCHAR), CAST(ai_version AS BIGINT) FROM item WHERE generated_on <= DATE '{AS_OF}' ORDER BY generated_on DESC, item_id DESC LIMIT 20)""")
def q_ai_panel(c: Civic) -> DataFrame:
    """Pending items, the week's cost and the last twenty runs."""
    pending = count_by(c.item.filter("status = 'pending'"), "status").select(F.lit("pending").alias("what"), F.col("status").alias("name"), "n")
    week = c.item.filter(F.col("generated_on").between(F.date_sub(day(), 6), day()))
    cost = week.agg(F.sum(ai_cost(c)).alias("n")).select(F.lit("cost").alias("what"), F.lit("week").alias("name"), "n")
    last = c.item.filter(F.col("generated_on") <= day()).orderBy(F.col("generated_on").desc(), F.col("item_id").desc()).limit(20)
    runs = last.select(F.lit("run").alias("what"), F.col("item_id").cast("string").alias("name"), F.col("ai_version").cast("long").alias("n"))
    return pending.unionByName(cost).unionByName(runs)


#: The number that an event's properties hold: a search's results, a click's place on the page.
_PROPERTY, _PROPERTY_SQL = "try_cast(get_json_object(props, '$.k') as bigint)", "TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)"


def _web_report(name: str, kind: str, condition: str, key: str) -> None:
    @query(name, f"SELECT {key} AS name, count(*) AS hits, count(DISTINCT session_id) AS sessions FROM (SELECT *, {_PROPERTY_SQL} AS k FROM web) WHERE event_type = '{kind}' AND {condition} GROUP BY 1")
    def report(c: Civic) -> DataFrame:
        rows = c.web.withColumn("k", F.expr(_PROPERTY)).filter((F.col("event_type") == kind) & F.expr(condition))
        return rows.groupBy(F.expr(key).alias("name")).agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("session_id").alias("sessions"))


_web_report("q_zero_result_searches", "signup", "k = 0", "url_path")  # signups stand for searches
_web_report("q_outbound_sources", "click", "referrer IS NOT NULL", "referrer")
_web_report("q_banner_clicks", "click", "k >= 90", "url_path")


@query("q_meeting_context", """SELECT meeting_id, item_id, CASE WHEN n = 1 THEN 'distinct' ELSE 'routine' END AS role FROM (SELECT meeting_id, item_id, count(*) OVER (PARTITION BY meeting_id, topic, action_type) AS n FROM ctx WHERE significance > 2)""")
def q_meeting_context(c: Civic) -> DataFrame:
    """Substantive items; those that share topic and action with others of their meeting are a routine cluster."""
    rows = c.item_context().filter("significance > 2")
    n = F.count(F.lit(1)).over(Window.partitionBy("meeting_id", "topic", "action_type"))
    return rows.select("meeting_id", "item_id", F.when(n == 1, "distinct").otherwise("routine").alias("role"))


@query("join_scalar_cross", "SELECT slug, badge, n, CAST(peak AS VARCHAR) AS peak, peak_n FROM (SELECT b.slug AS badge, c.slug, count(*) AS n FROM badge b JOIN city c USING (city_id) GROUP BY ALL) JOIN (SELECT slug AS badge, arg_max(month, ROW(k, month)) AS peak, max(k) AS peak_n FROM (SELECT slug, CAST(date_trunc('month', detected_on) AS DATE) AS month, count(*) AS k FROM badge GROUP BY ALL) GROUP BY 1) USING (badge)")
def join_scalar_cross(c: Civic) -> DataFrame:
    """Each badge's peak month beside its counts by city: the peak is one row a badge, found in an aggregate."""
    months = c.badge.groupBy(F.col("slug").alias("badge"), F.trunc("detected_on", "month").alias("month")).agg(F.count(F.lit(1)).alias("k"))
    peaks = months.groupBy("badge").agg(F.max_by("month", F.struct("k", "month")).cast("string").alias("peak"), F.max("k").alias("peak_n"))
    counts = c.badge.select("city_id", F.col("slug").alias("badge")).join(F.broadcast(c.city.select("city_id", "slug")), "city_id").groupBy("badge", "slug").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(peaks), "badge").select("slug", "badge", "n", "peak", "peak_n")  # a row a template


@query("join_lookup_keys", f"SELECT mv.vote_id, mv.member_id, mv.position FROM member_vote mv JOIN meeting m ON m.meeting_id = mv.vote_id WHERE m.meeting_date >= DATE '{AS_OF}' AND NOT m.is_hidden")
def join_lookup_keys(c: Civic) -> DataFrame:
    """Details of a result set: joined to the result itself, never to a collected list of keys."""
    chosen = c.meeting.filter((F.col("meeting_date") >= day()) & ~F.col("is_hidden")).select(F.col("meeting_id").alias("vote_id"))
    return c.member_vote.join(chosen, "vote_id")


alias("join_similarity", "mat_prior_contract")


@query("page_sentinel", "SELECT city_id, count(*) FILTER (WHERE r <= 20) AS shown, count(*) > 20 AS more FROM (SELECT city_id, row_number() OVER (PARTITION BY city_id ORDER BY meeting_date DESC, meeting_id DESC) AS r FROM meeting) WHERE r <= 21 GROUP BY 1")
def page_sentinel(c: Civic) -> DataFrame:
    """Of each city one row more than the first page shows, to tell whether there is a second."""
    order = Window.partitionBy("city_id").orderBy(F.col("meeting_date").desc(), F.col("meeting_id").desc())
    page = c.meeting.withColumn("r", F.row_number().over(order)).filter("r <= 21")
    return page.groupBy("city_id").agg(F.count_if(F.col("r") <= 20).alias("shown"), (F.count(F.lit(1)) > 20).alias("more"))


@query("set_union_hosts", "SELECT DISTINCT regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages UNION SELECT DISTINCT referrer FROM web WHERE referrer IS NOT NULL")
def set_union_hosts(c: Civic) -> DataFrame:
    """Hosts of the pages and of the referrers."""
    hosts = c.table("pages").select(F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"))
    return hosts.union(c.web.filter("referrer is not null").select("referrer")).distinct()


# What facts may name.
ACTIONS = "contract_award contract_amendment ordinance resolution appointment_executive appointment_board appointment_advisory zoning demolition weed_abatement tax_abatement settlement emergency_procurement appropriation budget_amendment proclamation public_hearing_set annexation liquor_license right_of_way bid_rejection other".split()
METHODS = "competitive sole_source no_bid rfp emergency unknown not_applicable".split()


@query("cls_validate_facts", f"""SELECT item_id, concat_ws(',', CASE WHEN action_type NOT IN ({', '.join(map(repr, ACTIONS))}) THEN 'action_type' END, CASE WHEN procurement NOT IN ({', '.join(map(repr, METHODS))}) THEN 'procurement_method' END,
    CASE WHEN dollars < 0 THEN 'dollars' END, CASE WHEN counterparty IS NULL THEN 'counterparty' END) AS broken FROM item""")
def cls_validate_facts(c: Civic) -> DataFrame:
    """The names of the rules that an item's facts break: values out of their domain, negative numbers, missing names."""
    rules = {"action_type": ~F.col("action_type").isin(ACTIONS), "procurement_method": ~F.col("procurement").isin(METHODS), "dollars": F.col("dollars") < 0, "counterparty": F.col("counterparty").isNull()}
    return c.item.select("item_id", F.concat_ws(",", *[F.when(broken, name) for name, broken in rules.items()]).alias("broken"))


@query("cls_data_debt_label", "SELECT item_id, CASE WHEN data_quality IS NOT NULL AND data_quality <> 'ok' THEN CASE data_quality WHEN 'empty' THEN 'No text' WHEN 'no_text_layer' THEN 'Scanned document' ELSE 'Needs review' END WHEN status = 'failed_permanent' THEN 'Could not be processed' ELSE 'Needs review' END AS label FROM item")
def cls_data_debt_label(c: Civic) -> DataFrame:
    """Quality first, then a failed status, else the general label; unknown qualities take the general one."""
    poor = F.col("data_quality").isNotNull() & (F.col("data_quality") != "ok")
    named = F.when(F.col("data_quality") == "empty", "No text").when(F.col("data_quality") == "no_text_layer", "Scanned document").otherwise("Needs review")
    return c.item.select("item_id", F.when(poor, named).when(F.col("status") == "failed_permanent", "Could not be processed").otherwise("Needs review").alias("label"))


@query("q_conflicts", "SELECT item_id, slug, topic FROM ctx WHERE significance <= 2 AND dollars >= 30000 AND ai_version <> 0")
def q_conflicts(c: Civic) -> DataFrame:
    """Items that were scored as procedural though they carry money: both readings wait for a person."""
    return c.item_context().filter("significance <= 2 and dollars >= 30000 and ai_version <> 0").select("item_id", "slug", "topic")


@query("agg_gate_by_city", "SELECT i.slug AS city, count(*) AS n FROM badge b JOIN ctx i ON i.item_id = b.item_id WHERE b.confidence >= 0.6 AND b.badge_status = 'applied' AND i.status = 'completed' AND (b.kind <> 'policy' OR i.significance >= 3) GROUP BY 1")
def agg_gate_by_city(c: Civic) -> DataFrame:
    return count_by(gated(c), "city_slug").withColumnRenamed("city_slug", "city")
