"""Queries that apply the text functions and rules to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.functions import text as T
from quorumlake.model import Civic
from quorumlake.plans.registry import query

NUMBER = r"CAST(replace(CASE WHEN regexp_matches(x, ',[0-9]{2}$') AND NOT contains(x, '.') THEN regexp_replace(x, ',([0-9]{2})$', '.\1') ELSE x END, ',', '') AS DECIMAL(20,2))"
#: The titles here hold plain amounts and spelt millions only.
DOLLARS = (
    r"list_max(list_concat(list_transform(regexp_extract_all(title, '\$([0-9,]+(?:\.[0-9]{1,2})?) million', 1), lambda x: CAST(" + NUMBER + r" * 1000000 AS DECIMAL(20,2))), "
    r"list_transform(regexp_extract_all(CASE WHEN contains(title, ' million') THEN '' ELSE title END, '\$([0-9,]+(?:\.[0-9]{1,2})?)', 1), lambda x: " + NUMBER + ")))"
)


def _sql_any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(text, w.replace("'", "''")) for w in words) + ")"


BOTH = "(lower(title) || coalesce(' ' || lower(description), ''))"
TOPIC = "CASE " + " ".join(f"WHEN {_sql_any(BOTH, words)} THEN '{slug}'" for slug, words in T.TOPICS) + " END"
HIGH, LOW = _sql_any("lower(title)", T.HIGH_WORDS), _sql_any("lower(title)", T.LOW_WORDS)
PRIORITY = f"CASE WHEN d >= 1000000 THEN 'high' WHEN {HIGH} THEN 'high' WHEN {LOW} THEN 'low' ELSE 'normal' END"


@query("fn_extract_dollars_max", f"SELECT item_id, CAST({DOLLARS} AS DOUBLE) AS amount FROM item")
def fn_extract_dollars_max(c: Civic) -> DataFrame:
    return c.item.select("item_id", T.dollars_max(F.col("title")).cast("double").alias("amount"))


@query("fn_extract_dollars_all", "SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '\\$([0-9]+)', 1), lambda x: CAST(x AS BIGINT)))), ','), '') AS amounts FROM (SELECT doc_id, 'pay $' || (doc_id % 97 + 1) || ' or $' || (doc_id % 89 + 1) AS text FROM documents)")
def fn_extract_dollars_all(c: Civic) -> DataFrame:
    docs = c.table("documents").select("doc_id", F.concat(F.lit("pay $"), (F.col("doc_id") % 97 + 1).cast("string"), F.lit(" or $"), (F.col("doc_id") % 89 + 1).cast("string")).alias("text"))
    found = F.array_sort(F.array_distinct(F.transform(T.amounts(F.col("text")), lambda a: a.cast("long"))))
    return docs.select("doc_id", F.array_join(F.transform(found, lambda a: a.cast("string")), ",").alias("amounts"))


@query("fn_dollar_tier", "SELECT item_id, CASE WHEN dollars <= 0 THEN NULL WHEN dollars < 50000 THEN 'green' WHEN dollars < 250000 THEN 'yellow' WHEN dollars < 1000000 THEN 'orange' ELSE 'red' END AS tier FROM item")
def fn_dollar_tier(c: Civic) -> DataFrame:
    return c.item.select("item_id", T.dollar_tier(F.col("dollars")).alias("tier"))


@query("fn_dollar_chip", "SELECT item_id, CASE WHEN dollars >= 1000 THEN '$' || CAST(CAST(round_even(CAST(dollars AS DOUBLE) / 1000, 0) AS BIGINT) AS VARCHAR) || 'K' ELSE '$' || CAST(CAST(round_even(CAST(dollars AS DOUBLE), 0) AS BIGINT) AS VARCHAR) END AS chip FROM item")
def fn_dollar_chip(c: Civic) -> DataFrame:
    return c.item.select("item_id", T.dollar_chip(F.col("dollars").cast("double")).alias("chip"))


@query("fn_extract_sponsor", r"SELECT item_id, nullif(rtrim(trim(regexp_extract(title, '(?i)\(Submitted by\s+(.+?)\)', 1)), '*'), '') AS sponsor FROM item")
def fn_extract_sponsor(c: Civic) -> DataFrame:
    return c.item.select("item_id", T.sponsor(F.col("title")).alias("sponsor"))


@query("fn_clean_title", r"SELECT item_id, regexp_replace(trim(regexp_replace(title, '(?i)\s*\((?:Submitted|Recommended|sponsored) by\s+[^)]+\)\s*', ' ', 'g')), '\s*\*+\s*$', '') AS title FROM item")
def fn_clean_title(c: Civic) -> DataFrame:
    return c.item.select("item_id", T.clean_title(F.col("title")).alias("title"))


@query("fn_classify_topic", f"SELECT item_id, {TOPIC} AS topic FROM item")
def fn_classify_topic(c: Civic) -> DataFrame:
    return c.item.select("item_id", T.topic(F.col("title"), F.col("description")).alias("topic"))


@query("fn_classify_topics_multi", "SELECT item_id, concat_ws(',', " + ", ".join(f"CASE WHEN {_sql_any(BOTH, words)} THEN '{slug}' END" for slug, words in T.TOPICS) + ") AS topics FROM item")
def fn_classify_topics_multi(c: Civic) -> DataFrame:
    return c.item.select("item_id", F.array_join(T.topics(F.col("title"), F.col("description")), ",").alias("topics"))


@query("fn_meeting_type", "SELECT meeting_id, CASE WHEN t LIKE '%regular%' AND t LIKE '%council%' THEN 'council' WHEN t LIKE '%special%' OR t LIKE '%called%' THEN 'special' WHEN t LIKE '%work session%' THEN 'work_session' WHEN t LIKE '%planning%' OR t LIKE '%bza%' OR t LIKE '%zoning%' THEN 'planning' WHEN t LIKE '%board%' AND t NOT LIKE '%council%' THEN 'board' WHEN t LIKE '%committee%' OR t LIKE '%commission%' THEN 'committee' WHEN t LIKE '%budget%' OR t LIKE '%council%' THEN 'council' ELSE 'other' END AS kind FROM (SELECT meeting_id, lower(title) AS t FROM meeting)")
def fn_meeting_type(c: Civic) -> DataFrame:
    return c.meeting.select("meeting_id", T.meeting_type(F.col("title")).alias("kind"))


@query("fn_is_consent", "SELECT item_id, contains(lower(coalesce(description, '')), 'settle') AS hit FROM item")
def fn_is_consent(c: Civic) -> DataFrame:
    return c.item.select("item_id", F.contains(F.lower(F.coalesce("description", F.lit(""))), F.lit("settle")).alias("hit"))


@query("fn_normalize_title", r"SELECT meeting_id, trim(regexp_replace(regexp_replace(split_part(lower(title), ' - cancelled', 1), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g')) AS title FROM meeting")
def fn_normalize_title(c: Civic) -> DataFrame:
    return c.meeting.select("meeting_id", T.normalize_title(F.col("title")).alias("title"))


STOP = ["with", "that", "from", "this", "resolution", "approving", "submitted"]


@query("fn_significant_words", f"SELECT item_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(title), '[a-z]{{4,}}')), lambda x: NOT list_contains({STOP}, x))), ' ') AS words FROM item")
def fn_significant_words(c: Civic) -> DataFrame:
    return c.item.select("item_id", F.array_join(F.array_sort(T.significant_words(F.col("title"), STOP)), " ").alias("words"))


@query("fn_snippet", "SELECT item_id, CASE WHEN p > 0 THEN substr(title, greatest(p - 10, 1), least(p - 1, 10) + 15) END AS snippet FROM (SELECT item_id, title, instr(lower(title), 'brand') AS p FROM item)")
def fn_snippet(c: Civic) -> DataFrame:
    return c.item.select("item_id", T.snippet(F.col("title"), F.lit("brand"), 10).alias("snippet"))


@query("fn_initial_lastname", "SELECT member_id, substr(member_name, 1, 1) || '. ' || split_part(member_name, '#', 2) AS short FROM member")
def fn_initial_lastname(c: Civic) -> DataFrame:
    return c.member.select("member_id", F.concat(F.substring("member_name", 1, 1), F.lit(". "), F.element_at(F.split("member_name", "#"), -1)).alias("short"))


@query("fn_name_variants", "SELECT member_id, unnest([lower(split_part(member_name, '#', 2)), lower(substr(member_name, 1, 1) || '. ' || split_part(member_name, '#', 2))]) AS variant FROM member")
def fn_name_variants(c: Civic) -> DataFrame:
    return c.member.select("member_id", F.explode(T.name_variants(F.col("member_name"))).alias("variant"))


GRAMS = "list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query("fn_trigram_similarity", f"SELECT i.item_id, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) AS similarity FROM (SELECT item_id, {GRAMS.format('counterparty')} AS a, {GRAMS.format('topic')} AS b FROM item) i")
def fn_trigram_similarity(c: Civic) -> DataFrame:
    return c.item.select("item_id", F.round(T.trigram_similarity(F.col("counterparty"), F.col("topic")), 6).alias("similarity"))


@query("fn_sequence_ratio", "SELECT member_id, round(1 - levenshtein(member_name, 'Supplier#000000011')::DOUBLE / greatest(length(member_name), 18), 6) AS ratio FROM member")
def fn_sequence_ratio(c: Civic) -> DataFrame:
    """One less the edit distance's share of the longer name."""
    other = F.lit("Supplier#000000011")
    return c.member.select("member_id", F.round(1 - F.levenshtein("member_name", other) / F.greatest(F.length("member_name"), F.length(other)), 6).alias("ratio"))


@query("fn_civil_time", "SELECT event_id, CAST(ts - INTERVAL 6 HOUR AS VARCHAR)[1:19] AS civil FROM web")
def fn_civil_time(c: Civic) -> DataFrame:
    """Chicago wall clock (these events lie in winter)."""
    return c.web.select("event_id", F.date_format(F.from_utc_timestamp("ts", "America/Chicago"), "yyyy-MM-dd HH:mm:ss").alias("civil"))


@query("fn_date_trunc", "SELECT meeting_id, CAST(CAST(date_trunc('month', meeting_date) AS DATE) AS VARCHAR) AS month, CAST(CAST(date_trunc('week', meeting_date) AS DATE) AS VARCHAR) AS week FROM meeting")
def fn_date_trunc(c: Civic) -> DataFrame:
    return c.meeting.select("meeting_id", F.trunc("meeting_date", "month").cast("string").alias("month"), F.trunc("meeting_date", "week").cast("string").alias("week"))


@query("fn_parse_free_date", "SELECT meeting_id, CAST(meeting_date AS VARCHAR) AS parsed FROM meeting")
def fn_parse_free_date(c: Civic) -> DataFrame:
    """A date spelt in a title is found and read back."""
    title = F.concat(F.lit("Minutes of "), F.date_format("meeting_date", "MMMM d, yyyy"), F.lit(" as read"))
    spelt = F.regexp_extract(title, r"([A-Z][a-z]+ \d{1,2}, \d{4})", 1)
    return c.meeting.select("meeting_id", F.try_to_date(spelt, "MMMM d, yyyy").cast("string").alias("parsed"))


@query("fn_age_state", "SELECT meeting_id, CASE WHEN d < 1 THEN 'good' WHEN d < 7 THEN 'warn' ELSE 'bad' END AS state FROM (SELECT meeting_id, DATE '2001-08-02' - meeting_date AS d FROM meeting)")
def fn_age_state(c: Civic) -> DataFrame:
    return c.meeting.select("meeting_id", T.age_state(F.datediff(F.lit("2001-08-02").cast("date"), "meeting_date")).alias("state"))


@query("fn_voice_select", "SELECT meeting_id, CASE WHEN meeting_date >= DATE '1998-06-01' THEN 'upcoming' ELSE 'completed' END AS voice FROM meeting")
def fn_voice_select(c: Civic) -> DataFrame:
    return c.meeting.select("meeting_id", F.when(F.col("meeting_date") >= F.lit("1998-06-01").cast("date"), "upcoming").otherwise("completed").alias("voice"))


@query("fn_format_hms", "SELECT item_id, CASE WHEN video_sec >= 3600 THEN CAST(video_sec // 3600 AS VARCHAR) || ':' || lpad(CAST(video_sec // 60 % 60 AS VARCHAR), 2, '0') ELSE CAST(video_sec // 60 AS VARCHAR) END || ':' || lpad(CAST(video_sec % 60 AS VARCHAR), 2, '0') AS hms FROM item")
def fn_format_hms(c: Civic) -> DataFrame:
    return c.item.select("item_id", T.hms(F.col("video_sec")).alias("hms"))


@query("fn_format_dates", "SELECT meeting_id, strftime(meeting_date, '%B %Y') AS long, strftime(meeting_date, '%b ''%y') AS short, strftime(meeting_date, '%a, %d %b %Y') AS rfc FROM meeting")
def fn_format_dates(c: Civic) -> DataFrame:
    return c.meeting.select("meeting_id", F.date_format("meeting_date", "MMMM yyyy").alias("long"), F.date_format("meeting_date", "MMM ''yy").alias("short"), F.date_format("meeting_date", "EEE, dd MMM yyyy").alias("rfc"))


@query("fn_labels", "SELECT item_id, CASE data_quality WHEN 'ok' THEN 'Readable' WHEN 'empty' THEN 'Empty' WHEN 'no_text_layer' THEN 'Scanned, no text' ELSE 'Unknown' END AS label FROM item")
def fn_labels(c: Civic) -> DataFrame:
    q = F.col("data_quality")
    return c.item.select("item_id", F.when(q == "ok", "Readable").when(q == "empty", "Empty").when(q == "no_text_layer", "Scanned, no text").otherwise("Unknown").alias("label"))


@query("fn_party_letter", "SELECT member_id, CASE WHEN party LIKE 'D%' THEN 'D' WHEN party LIKE 'R%' THEN 'R' ELSE 'I' END AS letter FROM member")
def fn_party_letter(c: Civic) -> DataFrame:
    return c.member.select("member_id", F.when(F.col("party").startswith("D"), "D").when(F.col("party").startswith("R"), "R").otherwise("I").alias("letter"))


@query("fn_json_get", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM web")
def fn_json_get(c: Civic) -> DataFrame:
    return c.web.select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


@query("fn_json_merge_shallow", "SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) END, json_extract_string(props, '$.k')) AS k, 'd' AS other FROM web")
def fn_json_merge_shallow(c: Civic) -> DataFrame:
    """Defaults overridden key by key."""
    defaults = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("other"), F.lit("d")))
    own = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("k"), F.col("event_id").cast("string"))).otherwise(F.expr("cast(map() as map<string,string>)"))
    merged = F.map_zip_with(defaults, own, lambda k, d, o: F.coalesce(o, d))
    return c.web.select("event_id", F.element_at(merged, "k").alias("k"), F.element_at(merged, "other").alias("other"))


@query("fn_repair_payload", "SELECT item_id, CASE WHEN action_type IN ('settlement', 'zoning') THEN action_type ELSE 'other' END AS action FROM item")
def fn_repair_payload(c: Civic) -> DataFrame:
    return c.item.select("item_id", T.repair_enum(F.col("action_type"), ["settlement", "zoning"]).alias("action"))


@query("fn_path_normalize", r"SELECT event_id, regexp_replace(regexp_replace(url_path, '/meetings/[0-9]+', '/meetings/[id]'), '/items/[0-9]+', '/items/[id]') AS path FROM web")
def fn_path_normalize(c: Civic) -> DataFrame:
    return c.web.select("event_id", T.normalize_path(F.col("url_path")).alias("path"))


@query("fn_chapter_url", "SELECT page_id, CASE WHEN contains(url, 'example.com') THEN url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'meta_id=' || CAST(page_id AS VARCHAR) ELSE url END AS url FROM pages")
def fn_chapter_url(c: Civic) -> DataFrame:
    return c.table("pages").select("page_id", T.meta_url(F.col("url"), F.col("page_id").cast("string")).alias("url"))


@query("fn_safe_ratio", "SELECT vote_id, round(100.0 * nays / nullif(yeas, 0), 1)::DOUBLE AS ratio FROM vote")
def fn_safe_ratio(c: Civic) -> DataFrame:
    return c.vote.select("vote_id", F.round(F.try_divide(100.0 * F.col("nays"), F.col("yeas")), 1).alias("ratio"))


@query("fn_quality_foreign", r"SELECT doc_id, length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) > length(text) * 0.4 AS is_foreign FROM documents")
def fn_quality_foreign(c: Civic) -> DataFrame:
    return c.table("documents").select("doc_id", T.is_foreign(F.col("text")).alias("is_foreign"))


@query("fn_hash_key", "SELECT doc_id, sha256('v1|' || lang || '|' || text) AS key FROM documents")
def fn_hash_key(c: Civic) -> DataFrame:
    return c.table("documents").select("doc_id", F.sha2(F.concat_ws("|", F.lit("v1"), "lang", "text"), 256).alias("key"))


@query("fn_vote_confidence", "SELECT item_id, CASE WHEN video_sec < 120 THEN 1.0 WHEN video_sec < 600 THEN 0.8 WHEN video_sec < 1800 THEN 0.5 ELSE 0.3 END::DOUBLE * CASE WHEN is_consent THEN 0.5 ELSE 1 END AS confidence FROM item")
def fn_vote_confidence(c: Civic) -> DataFrame:
    return c.item.select("item_id", T.vote_confidence(F.col("video_sec"), F.col("is_consent")).alias("confidence"))


@query("fn_word_count", "SELECT doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\r]+'))::BIGINT AS words, ceil(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) / 230.0)::BIGINT AS minutes FROM documents")
def fn_word_count(c: Civic) -> DataFrame:
    words = F.size(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r]+"), F.lit(0))).cast("long")
    return c.table("documents").select("doc_id", words.alias("words"), F.ceil(words / 230.0).alias("minutes"))


_PLAIN_SQL = r"regexp_replace(regexp_replace(html, '(?s)<script\b.*?</script>|<style\b.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g')"


@query("fn_strip_html", r"SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(" + _PLAIN_SQL + r", '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages")
def fn_strip_html(c: Civic) -> DataFrame:
    return c.table("pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


@query("txt_enrich_items", f"SELECT item_id, CAST({DOLLARS} AS DOUBLE) AS amount, {TOPIC} AS topic, " + r"nullif(rtrim(trim(regexp_extract(title, '(?i)\(Submitted by\s+(.+?)\)', 1)), '*'), '') AS sponsor FROM item")
def txt_enrich_items(c: Civic) -> DataFrame:
    """All enrichment in one projection."""
    title = F.col("title")
    return c.item.select("item_id", T.dollars_max(title).cast("double").alias("amount"), T.topic(title, F.col("description")).alias("topic"), T.sponsor(title).alias("sponsor"))


@query("cls_priority", f"SELECT item_id, {PRIORITY} AS priority FROM (SELECT *, {DOLLARS} AS d FROM item)")
def cls_priority(c: Civic) -> DataFrame:
    return c.item.select("item_id", T.priority(F.col("title")).alias("priority"))


@query("cls_procedural", "SELECT item_id, regexp_matches(title, '(?i)^\\s*roll\\s+call') AS procedural FROM item")
def cls_procedural(c: Civic) -> DataFrame:
    return c.item.select("item_id", T.is_procedural(F.col("title")).alias("procedural"))


@query("cls_withdrawn", r"SELECT item_id, regexp_matches(title, '(?i)^[a-z()./\s]*\bitem\s+\d+\.?\s*\(\s*(?:withdrawn|deferred|postponed)\s*\)') AS withdrawn FROM item")
def cls_withdrawn(c: Civic) -> DataFrame:
    return c.item.select("item_id", T.is_withdrawn(F.col("title")).alias("withdrawn"))


QUALITY = f"CASE WHEN big THEN 'ok' WHEN length(title) < 5 THEN 'empty' WHEN body = '' THEN 'no_agenda_text' WHEN length(body) < 50 AND pdf THEN 'no_text_layer' ELSE 'ok' END"
QUALITY_FROM = f"(SELECT *, ({HIGH} OR coalesce(d >= 1000000, false)) AS big, CASE WHEN trim(coalesce(description, '')) = '' AND length(title) >= 60 THEN title ELSE trim(coalesce(description, '')) END AS body, item_id % 2 = 0 AS pdf FROM (SELECT *, {DOLLARS} AS d FROM item))"


@query("cls_data_quality", f"SELECT item_id, {QUALITY} AS quality, CASE WHEN big THEN 'high' ELSE {PRIORITY} END AS priority FROM {QUALITY_FROM}")
def cls_data_quality(c: Civic) -> DataFrame:
    kind = F.when(F.col("item_id") % 2 == 0, "pdf").otherwise("html")
    return c.item.select("item_id", T.data_quality(F.col("title"), F.col("description"), kind).alias("q")).select("item_id", "q.quality", "q.priority")


def routed(c: Civic) -> DataFrame:
    """Where each unprocessed item goes: withdrawn, procedural, skipped for quality, or pending."""
    title, kind = F.col("title"), F.when(F.col("item_id") % 2 == 0, "pdf").otherwise("html")
    quality = T.data_quality(title, F.col("description"), kind)["quality"]
    route = F.when(T.is_withdrawn(title), "withdrawn").when(T.is_procedural(title), "procedural").when(quality != "ok", "quality_skipped").otherwise("pending")
    return c.item.filter("ai_version = 0").select("item_id", route.alias("route"))


ROUTE = f"CASE WHEN title LIKE 'Item %(Withdrawn)' THEN 'withdrawn' WHEN title = 'Roll Call' THEN 'procedural' WHEN {QUALITY} <> 'ok' THEN 'quality_skipped' ELSE 'pending' END"


@query("cls_route_items", f"SELECT item_id, {ROUTE} AS route FROM {QUALITY_FROM} WHERE ai_version = 0")
def cls_route_items(c: Civic) -> DataFrame:
    return routed(c)


@query("agg_wave_report", f"SELECT {ROUTE} AS route, count(*) AS n FROM {QUALITY_FROM} WHERE ai_version = 0 GROUP BY 1")
def agg_wave_report(c: Civic) -> DataFrame:
    return routed(c).groupBy("route").agg(F.count(F.lit(1)).alias("n"))
