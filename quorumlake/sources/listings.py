"""Rows from listing pages, players and agendas: a tolerant tag tokenizer and marked texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.functions.text import once
from quorumlake.model import AS_OF, Civic
from quorumlake.plans.registry import query
from quorumlake.sources.minutes import placed
from quorumlake.sources.trees import unescaped

# The marker of an agenda item, the head of an agenda's page, where a title ends and a sponsor stands.
MARKER = r"(?i)((?:CONSENT(?:\([a-z]+\))?\s+)?)ITEM\s+(\d+)\."
PAGE_HEAD = r"(?m)^[ \t]*Agenda\s*[–—\-]\s*\w+\s+\d+,\s*\d{4}\s+\d+[ \t]*$"
TITLE_END = r"(?i)\s*\((?:Submitted|Recommended)\s+by\b"
SPONSOR = r"(?i)\(Submitted\s+by\s+([^)]+?)\)"


def attribute(tag: Column, name: str) -> Column:
    """An attribute of a tag, quoted or not; null without it."""
    quoted, bare = rf"""(?is)\s{name}\s*=\s*["']([^"']*)["']""", rf"(?is)\s{name}\s*=\s*([^\s>\"']+)"
    return F.when(tag.rlike(quoted), F.regexp_extract(tag, quoted, 1)).when(tag.rlike(bare), F.regexp_extract(tag, bare, 1))


def _parts(tokens: Column, names: str) -> Column:
    """tokens cut before each tag, open or closing, of these names; what stands before the first is left out."""
    marks = F.filter(F.transform(tokens, lambda t, i: F.when(t.rlike(rf"(?i)^</?\s*(?:{names})(?![A-Za-z0-9])"), i)), lambda i: i.isNotNull())

    def cut(held: Column) -> Column:
        ends = F.concat(F.slice(held["marks"], F.lit(2), F.size(held["marks"])), F.array(F.size(held["tokens"])))
        return F.transform(F.arrays_zip(held["marks"].alias("first"), ends.alias("stop")), lambda x: F.slice(held["tokens"], x["first"] + 1, x["stop"] - x["first"]))

    return once(F.struct(tokens.alias("tokens"), marks.alias("marks")), cut)


def table_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """table, kind, cells, links: the rows of the tables on pages, with their table's id, their class, the text of each
    cell and the targets of their links. Tags may be of either case; a row or cell that is not closed ends where the next one
    begins; what is in no row is left out. Pages are cut into tables, these into rows and these into cells, so that a page of many
    rows is no list that grows with every tag."""
    tokens = F.filter(F.regexp_extract_all(html, F.lit(r"(?s)<!--.*?-->|<[^>]*>|[^<]+"), F.lit(0)), lambda t: ~t.startswith("<!--"))
    opened = lambda part: ~F.get(part, F.lit(0)).startswith("</")
    tables = pages.select(tokens.alias("t")).select(F.explode(_parts(F.col("t"), "table")).alias("t")).filter(opened("t"))
    own = F.coalesce(attribute(F.get("t", F.lit(0)), "id"), F.lit(""))
    rows = tables.select(own.alias("table"), F.explode(_parts(F.col("t"), "tr")).alias("r")).filter(opened("r"))

    def text(cell: Column) -> Column:
        said = F.array_join(F.filter(F.slice(cell, F.lit(2), F.size(cell)), lambda t: ~t.startswith("<")), "")
        return F.trim(unescaped(F.regexp_replace(said, r"\s+", " ")))

    cells = F.transform(F.filter(_parts(F.col("r"), "td|th"), opened), text)
    anchors = F.filter("r", lambda t: t.rlike(r"(?i)^<\s*a(?![A-Za-z0-9])"))
    links = F.filter(F.transform(anchors, lambda t: unescaped(attribute(t, "href"))), lambda x: x.isNotNull())
    return rows.select("table", attribute(F.get("r", F.lit(0)), "class").alias("kind"), cells.alias("cells"), links.alias("links")).filter(F.size("cells") > 0)


def listed_meetings(pages: DataFrame) -> DataFrame:
    """source, external_id, title, meeting_date and link of the meetings on listing pages(html): the union of the table of what
    is to come, keyed by event, and that of what was recorded (else a page's last table), keyed by clip. Rows that are neither even
    nor odd, or lack a key or a date, are left out."""
    rows = table_rows(pages).select(F.struct("*").alias("r")).filter("r.kind in ('even', 'odd')")
    link = F.get(F.filter("r.links", lambda x: x.rlike("(event|clip)_id=")), F.lit(0))
    event, clip = (F.nullif(F.regexp_extract(link, rf"{k}_id=(\d+)", 1), F.lit("")) for k in ("event", "clip"))
    source = F.when(F.col("r.table") == "upcoming", "upcoming").otherwise("archive")
    key = F.when(F.col("r.table") == "upcoming", F.concat(F.lit("event-"), event)).otherwise(clip)
    date = F.coalesce(*[F.expr(f"try_to_timestamp(get(r.cells, 1), '{f}')").cast("date") for f in ("MMMM d, yyyy", "MM/dd/yy")])
    date = F.when(F.year(date) > 2068, F.add_months(date, -1200)).otherwise(date)  # years of two digits from 69 on are of the last century
    return rows.select(source.alias("source"), key.alias("external_id"), F.get("r.cells", F.lit(0)).alias("title"), date.alias("meeting_date"), link.alias("link")).filter("external_id is not null and meeting_date is not null")


def listing_pages(c: Civic) -> DataFrame:
    """A page a city and month, with both tables, as sloppy as such pages are."""
    day, key = F.col("meeting_date"), F.col("meeting_id").cast("string")
    coming = day >= F.lit(AS_OF)
    odd = F.col("meeting_id") % 2 == 1
    what = F.when(coming, "event").otherwise("clip")
    date = F.when(odd, F.date_format(day, "MMMM d, yyyy")).when(F.col("meeting_id") % 10 != 0, F.date_format(day, "MM/dd/yy")).otherwise("to be announced")
    title = F.concat(F.regexp_replace("title", " - ", " &amp; "), F.lit(""))
    row = F.when(odd, F.concat(F.lit('<tr class="odd"><td>'), title, F.lit("<td>"), date, F.lit('<td><a class=x href="View.php?view_id=2&amp;'), what, F.lit("_id="), key, F.lit('">Agenda</a>')))
    row = row.otherwise(F.concat(F.lit("<TR CLASS='even'><TD><b>"), title, F.lit("</b></TD>\n<TD> "), date, F.lit(" </TD><TD><a href='/help'>?</a><A HREF=View.php?"), what, F.lit("_id="), key, F.lit(">Agenda</A></TD></TR>")))
    rows = c.meeting.select("city_id", F.date_trunc("month", day).alias("month"), coming.alias("coming"), F.struct("meeting_id", row.alias("html")).alias("r"))
    part = lambda flag: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(flag, F.col("r")))), lambda x: x["html"]), "\n")
    pages = rows.groupBy("city_id", "month").agg(part(F.col("coming")).alias("up"), part(~F.col("coming")).alias("past"))
    head = '<html><!-- <table><tr class="even"><td>no</td></tr></table> --><h1>Meetings</h1>'
    header = '<tr class="header"><th>Name</th><th>Date</th></tr>'
    return pages.select(F.concat(F.lit(f'{head}<table id="upcoming">{header}'), F.col("up"), F.lit(f"</table><p>Past</p><table class=t id=archive>{header}"), F.col("past"), F.lit("</table></html>")).alias("html"))


@query("src_html_listing_rows", f"""SELECT source, external_id, title, strftime(meeting_date, '%Y-%m-%d') AS meeting_date FROM (SELECT CASE WHEN meeting_date >= DATE '{AS_OF}' THEN 'upcoming' ELSE 'archive' END AS source,
    CASE WHEN meeting_date >= DATE '{AS_OF}' THEN 'event-' ELSE '' END || meeting_id AS external_id, replace(title, ' - ', ' & ') AS title, meeting_date FROM meeting WHERE meeting_id % 10 <> 0)""")
def src_html_listing_rows(c: Civic) -> DataFrame:
    found = listed_meetings(listing_pages(c))
    return found.select("source", "external_id", "title", F.date_format("meeting_date", "yyyy-MM-dd").alias("meeting_date"))


def index_points(pages: DataFrame) -> DataFrame:
    """clip, external_id, item_number, title and seconds of the index points of players(clip, html): points without a time are
    left out, though they count; those without an id take clip and place."""
    points = F.regexp_extract_all("html", F.lit(r"""(?is)<div\b[^>]*\bclass=["']?index-point["']?[^>]*>.*?</div>"""), F.lit(0))
    rows = pages.select("clip", F.posexplode(points).alias("place", "div"))
    tag = F.regexp_extract("div", r"(?s)^<[^>]*>", 0)
    title = F.regexp_replace(unescaped(F.regexp_replace("div", r"(?s)<[^>]*>", "")), r"^\s+|\s+$", "")
    found = rows.select("clip", F.coalesce(attribute(tag, "data-id"), F.concat_ws("-", F.col("clip").cast("string"), F.col("place").cast("string"))).alias("external_id"), (F.col("place") + 1).cast("string").alias("item_number"), title.alias("title"), attribute(tag, "time").try_cast("double").alias("seconds"))
    return found.filter("seconds is not null")


@query("src_index_points", """SELECT meeting_id AS clip, CASE WHEN priority = 'high' THEN CAST(item_id AS VARCHAR) ELSE meeting_id || '-' || (place - 1) END AS external_id, CAST(place AS VARCHAR) AS item_number, topic || ' & ' || counterparty AS title, video_sec::DOUBLE AS seconds
    FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY item_id) AS place FROM item) WHERE status <> 'withdrawn'""")
def src_index_points(c: Civic) -> DataFrame:
    """Time, id and text of the index points of each recording's player."""
    own = F.when(F.col("priority") == "high", F.concat(F.lit(' data-id="'), F.col("item_id").cast("string"), F.lit('"'))).otherwise("")
    time = F.when(F.col("status") != "withdrawn", F.concat(F.lit(" time="), F.col("video_sec").cast("string"))).otherwise("")
    div = F.concat(F.lit("<DIV"), own, F.lit(' class="index-point"'), time, F.lit(">\n <b>"), F.col("topic"), F.lit("</b> &amp; "), F.col("counterparty"), F.lit(" </DIV>"))
    players = c.item.groupBy(F.col("meeting_id").alias("clip")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", div.alias("d")))), lambda x: x["d"]), "<div class='other'>-</div>").alias("html"))
    return index_points(players)


def agenda_entries(texts: DataFrame) -> DataFrame:
    """meeting_id, place, item_number, title, body, sponsor and is_consent of the items of texts(meeting_id, text): a marker to the
    next one, without page heads, white space squeezed; the title ends where it is said who submitted or recommended it."""
    marks = placed(F.col("text"), MARKER, 2)

    def cut(m: Column) -> Column:
        ends = F.concat(F.transform(F.slice(m, F.lit(2), F.size(m)), lambda x: x["begin"]), F.array(F.length("text")))
        return F.arrays_zip(m.alias("m"), F.slice(ends, F.lit(1), F.size(m)).alias("stop"))

    # no test stands between the marks and their rows: it would be made on marks found once more
    rows = texts.select("meeting_id", "text", F.posexplode(once(marks, cut)).alias("place", "x"))
    raw = F.expr("substring(text, x.m.end + 1, x.stop - x.m.end)")
    body = F.trim(F.regexp_replace(F.regexp_replace(raw, PAGE_HEAD, ""), r"\s+", " "))
    done = rows.select("meeting_id", F.col("place").cast("long").alias("place"), F.col("x.m.g2").alias("item_number"), body.alias("body"), F.contains(F.lower("x.m.g1"), F.lit("consent")).alias("is_consent"))
    title = F.trim(F.get(F.split("body", TITLE_END, 2), F.lit(0)))
    return done.select("meeting_id", "place", "item_number", title.alias("title"), "body", F.nullif(F.regexp_extract("body", SPONSOR, 1), F.lit("")).alias("sponsor"), "is_consent")


@query("txt_agenda_items", """SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY item_id) - 1 AS place, regexp_extract(item_number, '^[0-9]+') AS item_number, topic || ' works for ' || counterparty AS title,
    topic || ' works for ' || counterparty || CASE WHEN priority = 'low' THEN ' (Recommended by staff)' ELSE '' END || CASE WHEN priority = 'high' THEN '' ELSE ' (Submitted by ' || sponsor || ')' END AS body,
    CASE WHEN priority <> 'high' THEN sponsor END AS sponsor, is_consent FROM item""")
def txt_agenda_items(c: Civic) -> DataFrame:
    """Agendas written from the civic layer, with page heads and broken lines, cut into their items again."""
    head = F.when(F.col("is_consent"), F.when(F.col("priority") == "low", "CONSENT(ph) ITEM ").otherwise("CONSENT ITEM ")).otherwise("ITEM ")
    said = F.concat(F.when(F.col("priority") == "low", " (Recommended by staff)").otherwise(""), F.when(F.col("priority") == "high", "").otherwise(F.concat(F.lit(" (Submitted by\n "), F.col("sponsor"), F.lit(")"))))
    broken = F.when(F.col("significance") > 5, "\nAgenda – May 19, 2026 12\n").otherwise(" ")
    text = F.concat(head, F.regexp_extract("item_number", "^([0-9]+)", 1), F.lit("."), broken, F.col("topic"), F.lit("  works\nfor "), F.col("counterparty"), said, F.lit("\n"))
    texts = c.item.groupBy("meeting_id").agg(F.concat(F.lit("CITY COUNCIL\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", text.alias("t")))), lambda x: x["t"]), "")).alias("text"))
    return agenda_entries(texts)


def archived_meetings(pages: DataFrame) -> DataFrame:
    """source, external_id, title, meeting_date, agenda and minutes of archive pages(url, html): links to PDF files whose names begin with
    MMDDYY, grouped by date and by the body that the page's address names. The last link of a kind counts; a name with
    `special` makes the meeting a special one. Links without a date are left out."""
    anchors = F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*>.*?</a>"), F.lit(0))
    rows = pages.select("url", F.posexplode(anchors).alias("place", "a"))
    href = unescaped(attribute(F.regexp_extract("a", r"(?s)^<[^>]*>", 0), "href"))
    named = rows.select("url", "place", href.alias("href"), F.upper(F.trim(unescaped(F.regexp_replace("a", r"(?s)<[^>]*>", "")))).alias("said")).filter(F.lower("href").contains(".pdf"))
    name = F.coalesce(F.try_url_decode(F.regexp_extract("href", r"([^/]*)$", 1)), F.regexp_extract("href", r"([^/]*)$", 1))
    digits = F.regexp_replace(F.regexp_extract("name", r"^(\d{2}\s*\d{2}\s*\d{2})", 1), r"\s", "")
    date = F.expr("try_to_timestamp(digits, 'MMddyy')").cast("date")
    body = F.initcap(F.regexp_replace(F.regexp_extract("url", r"([^/?#]*)/?$", 1), "-", " "))
    dated = named.withColumn("name", name).withColumn("digits", digits).withColumn("date", date).withColumn("body", body).filter("date is not null")
    day = F.when(F.year("date") > 2068, F.add_months("date", -1200)).otherwise(F.col("date"))
    last = lambda word: F.max_by(F.when(F.contains("said", F.lit(word)), F.col("href")), F.when(F.contains("said", F.lit(word)), F.col("place")))
    grouped = dated.groupBy("url", "body", day.alias("meeting_date")).agg(F.bool_or(F.contains(F.lower("name"), F.lit("special"))).alias("special"), last("AGENDA").alias("agenda"), last("INUTE").alias("minutes"))
    key = F.concat_ws("-", F.date_format("meeting_date", "yyyy-MM-dd"), "body")
    return grouped.select(F.col("url").alias("source"), key.alias("external_id"), F.when(F.col("special"), F.concat(F.lit("Special Called "), "body")).otherwise(F.col("body")).alias("title"), "meeting_date", "agenda", "minutes")


def archive_pages(c: Civic) -> DataFrame:
    """A page a city, body and year, with links to agendas and to the minutes of adopted meetings."""
    body = F.regexp_replace(F.lower(F.regexp_replace("title", r" (\(|- ).*$", "")), " ", "-")
    name = F.concat(F.date_format("meeting_date", "MM'%20'ddyy"), F.when(F.col("title").startswith("Special"), "%20Special").otherwise(""), F.lit("%20"), F.col("meeting_id").cast("string"))
    agenda = F.concat(F.lit('<li><a class=doc href="/docs/a&amp;b/'), name, F.lit('.PDF"><b>Agenda</b></a>'))
    minutes = F.when(F.col("adopted_date").isNotNull(), F.concat(F.lit("<A HREF='/docs/"), name, F.lit(".pdf'>Draft minutes </A><a href='/notes.pdf'>notes</a><a href='/x.html'>Agenda</a>"))).otherwise("")
    rows = c.meeting.join(F.broadcast(c.city.select("city_id", "slug")), "city_id")  # a row a nation
    rows = rows.select(F.concat(F.lit("https://www."), F.regexp_replace("slug", " ", "-"), F.lit(".example/archive/"), F.year("meeting_date").cast("string"), F.lit("/"), body).alias("url"), F.struct("meeting_id", F.concat(agenda, minutes).alias("html")).alias("r"))
    return rows.groupBy("url").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["html"]), "\n").alias("html"))


@query("src_link_archive_rows", """SELECT external_id, title, strftime(meeting_date, '%Y-%m-%d') AS meeting_date, agenda, minutes FROM (
    SELECT strftime(meeting_date, '%Y-%m-%d') || '-' || body AS external_id, CASE WHEN bool_or(special) THEN 'Special Called ' ELSE '' END || body AS title, meeting_date, arg_max('/docs/a&b/' || name || '.PDF', meeting_id) AS agenda,
        arg_max('/docs/' || name || '.pdf', meeting_id) FILTER (WHERE adopted_date IS NOT NULL) AS minutes FROM (
        SELECT *, regexp_replace(title, ' (\\(|- ).*$', '') AS body, starts_with(title, 'Special') AS special, strftime(meeting_date, '%m') || '%20' || strftime(meeting_date, '%d%y') || CASE WHEN title LIKE 'Special%' THEN '%20Special' ELSE '' END || '%20' || meeting_id AS name FROM meeting)
    GROUP BY city_id, meeting_date, body)""")
def src_link_archive_rows(c: Civic) -> DataFrame:
    return archived_meetings(archive_pages(c)).select("external_id", "title", F.date_format("meeting_date", "yyyy-MM-dd").alias("meeting_date"), "agenda", "minutes")
