"""Press coverage: articles imported once, linked to subjects of four kinds, published with their first date kept, and listed.

Pages stand for the curated list of articles: a page's host is its outlet, its address without query and fragment names
the article, its language says what kind of subject the number in its address points to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.model import Civic, case
from quorumlake.operators import text_index
from quorumlake.operators.search import search_rows, search_sql
from quorumlake.plans.registry import alias, query

#: What an entry's status may be (fixed values).
STATUSES = ["draft", "proposed", "published", "rejected"]
_SUBJECTS = [("en", "agenda_item"), ("fr", "meeting"), ("de", "council_member")]
ENTRY = ["outlet", "url"]
LINK = [*ENTRY, "subject_type", "subject_id", "subject_slug"]

_TEXT = "replace(regexp_replace({0}, '<[^>]+>', '', 'g'), '&amp;', '&')"
_ARTICLES = f"""articles AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', '') AS outlet, regexp_extract(url, '^https?://([^?#]+)', 1) AS url,
        {_TEXT.format("regexp_extract(html, '<h1>(.*?)</h1>', 1)")} AS headline, substr({_TEXT.format("regexp_extract(html, '(?s)<article>.*?<p>(.*?)</p>', 1)")}, 1, 200) AS excerpt,
        regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS lang, CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) AS number FROM pages),
    known AS (SELECT *, DATE '1996-01-01' + CAST(number AS INTEGER) AS article_date, CASE WHEN url LIKE 'blog.%' THEN 'note' ELSE 'citation' END AS kind,
        CASE lang WHEN 'en' THEN 'agenda_item' WHEN 'fr' THEN 'meeting' WHEN 'de' THEN 'council_member' ELSE 'badge' END AS subject_type,
        CASE lang WHEN 'en' THEN number * 10 + 1 WHEN 'fr' THEN number WHEN 'de' THEN number % 50 END AS subject_id, CASE WHEN lang NOT IN ('en', 'fr', 'de') THEN CASE WHEN number % 2 = 0 THEN 'high_dollar' ELSE 'sole_source' END END AS subject_slug
        FROM articles WHERE number IS NOT NULL)"""
_PUBLISHED_ON = "CASE WHEN length(headline) % 3 <> 0 THEN article_date + 7 END"
COVERAGE_SQL = f""", {_ARTICLES}, firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY outlet, url ORDER BY page_id) AS r FROM known) WHERE r = 1),
    entry AS (SELECT outlet, url, kind, headline, excerpt, article_date, {_PUBLISHED_ON} AS published_on, CASE WHEN {_PUBLISHED_ON} IS NOT NULL THEN 'published' WHEN length(excerpt) < 40 THEN 'rejected' ELSE 'draft' END AS status,
        CASE WHEN {_PUBLISHED_ON} IS NOT NULL THEN 'desk of ' || outlet END AS byline FROM firsts),
    link AS (SELECT DISTINCT outlet, url, subject_type, subject_id, subject_slug FROM known)"""


def plain(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, "<[^>]+>", ""), "&amp;", "&")


def articles(pages: DataFrame) -> DataFrame:
    """The list of articles, a row a page that has a number in its address."""
    number = F.regexp_extract("url", r"/(\d+)", 1).try_cast("long")
    lang = F.regexp_extract("url", "^https?://[^/]+/([a-z]+)/", 1)
    address = F.regexp_extract("url", "^https?://([^?#]+)", 1)
    rows = pages.select(
        "page_id", F.regexp_replace(F.lower(F.regexp_extract("url", "^https?://([^/?#:]+)", 1)), r"^www\.", "").alias("outlet"), address.alias("url"),
        plain(F.regexp_extract("html", "<h1>(.*?)</h1>", 1)).alias("headline"), F.substring(plain(F.regexp_extract("html", "(?s)<article>.*?<p>(.*?)</p>", 1)), 1, 200).alias("excerpt"),
        F.date_add(F.lit("1996-01-01").cast("date"), number.cast("int")).alias("article_date"), F.when(address.startswith("blog."), "note").otherwise("citation").alias("kind"),
        case(lang, _SUBJECTS, "badge").alias("subject_type"), F.when(lang == "en", number * 10 + 1).when(lang == "fr", number).when(lang == "de", number % 50).alias("subject_id"),
        F.when(~lang.isin("en", "fr", "de"), F.when(number % 2 == 0, "high_dollar").otherwise("sole_source")).alias("subject_slug"),
    )
    return rows.filter("article_date is not null")


def import_articles(entries: DataFrame | None, links: DataFrame | None, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, links) after a list was imported: entries are drafts inserted if their (outlet, url) is new, the first of the
    list where it repeats; links are inserted if they are new. What is there stays as it is, so a second import adds nothing."""
    content = ["kind", "headline", "excerpt", "article_date"]
    first = listed.groupBy(*ENTRY).agg(F.min_by(F.struct(*content), "page_id").alias("f"))
    new = first.select(*ENTRY, *[F.col("f")[x].alias(x) for x in content], F.lit(None).cast("date").alias("published_on"), F.lit("draft").alias("status"), F.lit(None).cast("string").alias("byline"))
    found = listed.select(*LINK).distinct()
    if entries is None or links is None:
        return new, found
    return entries.unionByName(new.join(entries.select(*ENTRY), ENTRY, "left_anti")), links.unionByName(found.subtract(links.select(*LINK)))


def set_status(entries: DataFrame, actions: DataFrame) -> DataFrame:
    """entries after actions(outlet, url, to_status, on, by), at most one an entry: the status changes if it is a known one; a
    published entry keeps its first date and byline. An unknown status or entry changes nothing."""
    known = actions.filter(F.col("to_status").isin(STATUSES))
    both = entries.join(known, ENTRY, "left")
    publish = F.col("to_status") == "published"
    return both.select(
        *ENTRY, "kind", "headline", "excerpt", "article_date", F.when(publish, F.coalesce("published_on", "on")).otherwise(F.col("published_on")).alias("published_on"),
        F.coalesce("to_status", "status").alias("status"), F.when(publish, F.coalesce("byline", "by")).otherwise(F.col("byline")).alias("byline"),
    )


def desk_actions(entries: DataFrame) -> DataFrame:
    """What the desk does with drafts: long headlines are published, empty excerpts rejected."""
    published = F.length("headline") % 3 != 0
    status = F.when(published, "published").when(F.length("excerpt") < 40, "rejected")
    rows = entries.select(*ENTRY, status.alias("to_status"), F.date_add("article_date", 7).alias("on"), F.concat(F.lit("desk of "), F.col("outlet")).alias("by"))
    return rows.filter("to_status is not null")


def coverage(c: Civic) -> tuple[DataFrame, DataFrame]:
    entries, links = import_articles(None, None, articles(c.table("pages")))
    return set_status(entries, desk_actions(entries)), links


def _day(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd").alias(column)


def _day_sql(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d') AS {column}"


@query("src_coverage_import", f"{COVERAGE_SQL} SELECT outlet, url, kind, headline, {_day_sql('article_date')}, subject_type, subject_id, subject_slug FROM entry JOIN link USING (outlet, url)")
def src_coverage_import(c: Civic) -> DataFrame:
    """The list imported twice in a row: entries with their links."""
    listed = articles(c.table("pages"))
    entries, links = import_articles(*import_articles(None, None, listed), listed)
    return entries.join(links, ENTRY).select(*ENTRY, "kind", "headline", _day("article_date"), "subject_type", "subject_id", "subject_slug")


@query("mrg_coverage_state", f"{COVERAGE_SQL} SELECT outlet, url, status, {_day_sql('published_on')}, byline FROM entry")
def mrg_coverage_state(c: Civic) -> DataFrame:
    """States after the desk's actions, and after the same actions a week later: first dates and bylines stay."""
    entries, _ = coverage(c)
    later = desk_actions(entries).withColumn("on", F.date_add("on", 7)).withColumn("by", F.lit("another desk"))
    return set_status(entries, later).select(*ENTRY, "status", _day("published_on"), "byline")


@query("flt_coverage", f"{COVERAGE_SQL} SELECT outlet, url FROM entry WHERE status = 'published' AND kind = 'citation' AND outlet LIKE '%.org' AND headline ILIKE '%the%'")
def flt_coverage(c: Civic) -> DataFrame:
    entries, _ = coverage(c)
    return entries.filter((F.col("status") == "published") & (F.col("kind") == "citation") & F.col("outlet").endswith(".org") & F.col("headline").ilike("%the%")).select(*ENTRY)


@query("agg_coverage_counts", f"{COVERAGE_SQL} SELECT subject_id AS item_id, count(*) FILTER (WHERE kind = 'note') AS notes, count(*) FILTER (WHERE kind = 'citation') AS citations FROM entry JOIN link USING (outlet, url) WHERE status = 'published' AND subject_type = 'agenda_item' GROUP BY 1")
def agg_coverage_counts(c: Civic) -> DataFrame:
    """Published notes and citations of each item that has some."""
    entries, links = coverage(c)
    of_items = links.filter("subject_type = 'agenda_item'").join(entries.filter("status = 'published'"), ENTRY)
    return of_items.groupBy(F.col("subject_id").alias("item_id")).agg(F.count_if(F.col("kind") == "note").alias("notes"), F.count_if(F.col("kind") == "citation").alias("citations"))


_ORDER = "CASE kind WHEN 'note' THEN 0 ELSE 1 END, CASE kind WHEN 'note' THEN published_on ELSE article_date END DESC NULLS LAST, outlet, url"


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with their place within keys: notes first, by publication, then citations by the article's date; latest first."""
    from pyspark.sql import Window

    note = F.col("kind") == "note"
    date = F.when(note, F.col("published_on")).otherwise(F.col("article_date"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.when(note, 0).otherwise(1), date.desc_nulls_last(), *ENTRY)))


@query("sort_coverage", f"{COVERAGE_SQL} SELECT outlet, url, row_number() OVER (PARTITION BY subject_type ORDER BY {_ORDER}) AS place, subject_type FROM entry JOIN link USING (outlet, url)")
def sort_coverage(c: Civic) -> DataFrame:
    entries, links = coverage(c)
    return ranked(entries.join(links, ENTRY), ["subject_type"]).select(*ENTRY, "place", "subject_type")


@query("q_coverage_for_subject", f"{COVERAGE_SQL} SELECT subject_type, subject_id, subject_slug, row_number() OVER (PARTITION BY subject_type, subject_id, subject_slug ORDER BY {_ORDER}) AS place, kind, headline, byline FROM entry JOIN link USING (outlet, url) WHERE status = 'published'")
def q_coverage_for_subject(c: Civic) -> DataFrame:
    """Published coverage of every subject, in the order in which it is shown."""
    entries, links = coverage(c)
    shown = ranked(entries.filter("status = 'published'").join(links, ENTRY), ["subject_type", "subject_id", "subject_slug"])
    return shown.select("subject_type", "subject_id", "subject_slug", "place", "kind", "headline", "byline")


def with_labels(c: Civic, links: DataFrame) -> DataFrame:
    """links with the title or name of their subject, null where there is none: one join of all kinds. Subjects grow with the
    tables, so they meet their links in a shuffle and are never sent to the driver whole; badges have no number and are dealt
    by their address."""
    sources = [("agenda_item", c.item, "item_id", "title"), ("meeting", c.meeting, "meeting_id", "title"), ("council_member", c.member, "member_id", "member_name")]
    parts = [rows.select(F.lit(kind).alias("kind"), F.col(key).alias("number"), F.col(label).alias("name")) for kind, rows, key, label in sources]
    names = parts[0].unionByName(parts[1]).unionByName(parts[2])
    number = F.coalesce("subject_id", F.xxhash64(*ENTRY))
    found = links.join(names.hint("merge"), (F.col("subject_type") == F.col("kind")) & (number == F.col("number")), "left")
    badge = F.initcap(F.regexp_replace("subject_slug", "_", " "))
    return found.select(*LINK, F.when(F.col("subject_type") == "badge", badge).otherwise(F.col("name")).alias("label"))


_LABEL_SQL = """CASE subject_type WHEN 'agenda_item' THEN (SELECT title FROM item WHERE item_id = subject_id) WHEN 'meeting' THEN (SELECT title FROM meeting WHERE meeting_id = subject_id)
    WHEN 'council_member' THEN (SELECT member_name FROM member WHERE member_id = subject_id) ELSE CASE subject_slug WHEN 'high_dollar' THEN 'High Dollar' ELSE 'Sole Source' END END"""


@query("q_published_coverage", f"{COVERAGE_SQL} SELECT outlet, url, kind, headline, {_day_sql('published_on')}, subject_type, {_LABEL_SQL} AS label FROM entry JOIN link USING (outlet, url) WHERE status = 'published'")
def q_published_coverage(c: Civic) -> DataFrame:
    entries, links = coverage(c)
    return entries.filter("status = 'published'").join(with_labels(c, links), ENTRY).select(*ENTRY, "kind", "headline", _day("published_on"), "subject_type", "label")


@query("q_coverage_admin", f"{COVERAGE_SQL} SELECT status, kind, outlet, count(*) AS entries, strftime(max(article_date), '%Y-%m-%d') AS latest, CAST(sum(links) AS BIGINT) AS links FROM entry JOIN (SELECT outlet, url, count(*) AS links FROM link GROUP BY ALL) USING (outlet, url) GROUP BY ALL")
def q_coverage_admin(c: Civic) -> DataFrame:
    entries, links = coverage(c)
    each = entries.join(links.groupBy(*ENTRY).agg(F.count(F.lit(1)).alias("links")), ENTRY)
    return each.groupBy("status", "kind", "outlet").agg(F.count(F.lit(1)).alias("entries"), F.date_format(F.max("article_date"), "yyyy-MM-dd").alias("latest"), F.sum("links").alias("links"))


_ASKED = {0: [{"must": ["the"], "must_not": ["and"]}, {"must": ["de la"]}]}
_ENTRY_ID = "SELECT min(page_id) AS id, outlet, url FROM known GROUP BY ALL"
_SOURCE = f"SELECT id, article_date AS day, regexp_extract_all(lower(headline), {{words}}) AS a, regexp_extract_all(lower(excerpt), {{words}}) AS b FROM entry JOIN ({_ENTRY_ID}) USING (outlet, url) WHERE status = 'published'"


@query("fts_coverage", COVERAGE_SQL + search_sql(_SOURCE, _ASKED, 100) + " SELECT rank, id AS page_id, score FROM ranked")
def fts_coverage(c: Civic) -> DataFrame:
    """Published coverage by words and phrases of headline and excerpt, from a stored index."""

    def docs() -> DataFrame:
        entries, _ = coverage(c)
        numbered = articles(c.table("pages")).groupBy(*ENTRY).agg(F.min("page_id").alias("page_id"))
        return entries.filter("status = 'published'").join(numbered, ENTRY)

    index = text_index.stored(c.spark, "coverage", [f"{c.sf_dir}/pages.parquet"], docs, "page_id", {"headline": 1.0, "excerpt": 0.4}, "article_date")
    return text_index.search(index, search_rows(c, _ASKED), 100).select("rank", F.col("id").alias("page_id"), "score")


alias("q_coverage_counts", "agg_coverage_counts")
