"""Rows from the text of minutes: roll calls, vote blocks, names, resolution numbers, proper nouns and matches on them.

The tables hold no minutes, so `minutes` writes them from the civic layer, one text a meeting; everything else here only
reads text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.functions.text import any_of, once
from quorumlake.model import Civic
from quorumlake.plans.registry import query

# A surname, alone and in a list; vote blocks after their preamble and bare ones; the roll call; numbered resolutions and
# ordinances, narrow and broad; months; the words that open a tally; windows around a block, and how near two blocks may be.
NAME = "^[A-Z][A-Za-z'’‘-]+$"
LISTED_NAME = r"(?<![^,\s])([A-Z][A-Za-z'’‘-]+)\.*(?![^,\s])"
BARE = r"(?i)Ayes?:\s*([^\n]+?)\n\s*Nays?:\s*([^\n]+?)\n(?:\s*Abstain(?:ing|ed)?:\s*([^\n]+?)\n)?"
FULL = r"(?is)(?:the\s+vote\s+was\s+as\s+follows|upon\s+the\s+roll\s+being\s+called)[:\s]*\n?\s*Ayes?:\s*(.+?)\n\s*Nays?:\s*(.+?)\n(?:\s*Abstain(?:ing|ed)?:\s*(.+?)\n)?"
PRESENT = r"Present on Roll Call:\s*(?:Councilmembers? )?([^\n]*)\n"
ABSENT = r"\nAbsent:[ \t]*([^\n]*)\n"
NARROW = r"(?i)(?:RESOLUTION|ORDINANCE)\s+(?:NO\.\s*)?(\d[\d-]*)"
NUMBERED = r"(?i)\b(?:RESOLUTION|ORDINANCE)\s+(?:NO\.?\s*)?([A-Z]?-?[0-9][0-9-]*)"
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
TALLY = r"(?i)\bayes?:"
PHRASE = r"[A-Z][a-zA-Z]+(?:(?:\s+&\s+|\s+)[A-Z][a-zA-Z]+){1,6}"
BEFORE, AFTER, APART = 1500, 200, 50
#: Phrases that mark a vote on the consent agenda (fixed values).
CONSENT_PHRASES = [
    "the resolutions and ordinances introduced as consent agenda matters",
    "consent agenda matters were read by the city clerk",
    "all items on the consent agenda",
    "items on consent",
]
#: Capitalised phrases of procedure, which name nobody (fixed values).
PROCEDURAL = [
    "City Clerk", "Presiding Officer", "Council Chamber", "City Council", "City Hall", "Mayor's Office", "The City", "The Council", "The Mayor", "City of", "City of Birmingham",
    "Birmingham As Made", "Roll Call", "Roll Being", "Roll Being Called", "Unanimous Consent", "Ayes None", "Nays None", "Councilmember Smitherman", "Councilmember Tate", "Presiding Officer declared",
]

_WHO = "'M' || translate(CAST(member_id AS VARCHAR), '0123456789', 'abcdefghij')"
_SAID = "coalesce(string_agg({0}, ', ' ORDER BY {0}) FILTER (WHERE {1}), 'None')"
_FILLER = "The clerk then read a message from the staff on streets. "
_ABSENT_SQL, _ABSTAIN_SQL = "position = 'abstain' AND member_id % 2 = 1", "position = 'abstain' AND member_id % 2 = 0"
_CALLED = ", and upon the roll being called, the vote was as follows:"
_CONSENT_TEXT = "The resolutions and ordinances introduced as consent agenda matters were read by the City Clerk"

AGENDA_SQL = """, agenda AS (SELECT *, coalesce(description, '') || CASE WHEN priority = 'high' THEN ' Resolution No. ' || item_id ELSE '' END
        || CASE WHEN significance >= 4 THEN ' by ' || vendor ELSE '' END AS details
    FROM (SELECT item_id, meeting_id, item_number, title, description, dollars, priority, significance, is_consent,
        array_to_string(list_transform(string_split(regexp_extract(counterparty, '^[a-z]+ [a-z]+'), ' '), lambda w: upper(w[1]) || w[2:]), ' ') || ' Works' AS vendor FROM item))"""
MINUTES_SQL = AGENDA_SQL + f""", spoken AS (SELECT *, CASE WHEN priority = 'high' THEN 'RESOLUTION NO. ' || item_id || ' was read' WHEN priority = 'low' THEN 'Item No. ' || regexp_extract(item_number, '^[0-9]+') || ' was called'
        WHEN significance >= 5 THEN 'A contract with ' || vendor || ' for $' || CAST(dollars AS VARCHAR) || ' was read' ELSE 'A matter of ' || regexp_replace(lower(title), '\\$[0-9.]+', '') || ' came up' END AS said,
        row_number() OVER (PARTITION BY meeting_id, is_consent ORDER BY item_id) AS place FROM agenda),
    rolls AS (SELECT vote_id AS meeting_id, {_SAID.format(_WHO, "position <> 'abstain'")} AS present, {_SAID.format(_WHO, _ABSENT_SQL)} AS absent, {_SAID.format(_WHO, _ABSTAIN_SQL)} AS abstained,
        {_SAID.format(_WHO, "position = 'yes'")} AS ayes, {_SAID.format(_WHO, "position = 'nay'")} AS nays, list({_WHO}) AS surnames FROM member_vote GROUP BY vote_id),
    parts AS (SELECT meeting_id, max(CASE WHEN NOT is_consent AND place = 1 THEN said END) AS one, max(CASE WHEN NOT is_consent AND place = 2 THEN said END) AS two,
        string_agg(CASE WHEN priority = 'high' THEN ', with RESOLUTION NO. ' || item_id || ' of item ' || item_number WHEN significance >= 7 THEN ', with ' || lower(title) ELSE '' END, '' ORDER BY item_id) FILTER (WHERE is_consent) AS named FROM spoken GROUP BY 1),
    minutes AS (SELECT meeting_id, surnames,
        CASE WHEN ayes <> 'None' OR nays = 'None' THEN 'Present on Roll Call: Councilmembers ' || present || chr(10) || 'Absent: ' || absent || chr(10) || chr(10) ELSE 'The Council met.' || chr(10) || chr(10) END
        || CASE WHEN one IS NOT NULL THEN one || '{_CALLED}' || chr(10) || 'Ayes: ' || ayes || chr(10) || 'Nays: ' || nays || chr(10) || CASE WHEN abstained <> 'None' THEN 'Abstaining: ' || abstained || chr(10) ELSE '' END || chr(10) ELSE '' END
        || CASE WHEN two IS NOT NULL THEN two || '. Those in favour spoke before those against it did.' || chr(10) || 'Ayes: ' || nays || chr(10) || 'Nays: ' || ayes || chr(10) || chr(10) ELSE '' END
        || CASE WHEN named IS NOT NULL THEN repeat('{_FILLER}', 27) || chr(10) || '{_CONSENT_TEXT}' || named || '{_CALLED}' || chr(10) || 'Ayes: ' || present || chr(10) || 'Nays: None' || chr(10) ELSE '' END
        || 'Adjourned in April Session' AS text FROM rolls JOIN parts USING (meeting_id))"""


def agenda(c: Civic) -> DataFrame:
    """Items as an agenda states them: with the number of their resolution and their vendor, where they have one."""
    vendor = F.concat(F.initcap(F.regexp_extract("counterparty", "^([a-z]+ [a-z]+)", 1)), F.lit(" Works"))
    items = c.item.select("item_id", "meeting_id", "item_number", "title", "description", "dollars", "priority", "significance", "is_consent", vendor.alias("vendor"))
    number = F.when(F.col("priority") == "high", F.concat(F.lit(" Resolution No. "), F.col("item_id").cast("string"))).otherwise("")
    by = F.when(F.col("significance") >= 4, F.concat(F.lit(" by "), F.col("vendor"))).otherwise("")
    return items.withColumn("details", F.concat(F.coalesce("description", F.lit("")), number, by))


def minutes(c: Civic) -> DataFrame:
    """meeting_id, surnames and text of the minutes of each meeting with votes: a roll call in most; a vote after its
    preamble and a bare one on the first items; and one on the consent agenda, which names some of its items."""
    who = F.concat(F.lit("M"), F.translate(F.col("member_id").cast("string"), "0123456789", "abcdefghij"))

    position, odd = F.col("position"), F.col("member_id") % 2 == 1
    sides = {"present": position != "abstain", "absent": (position == "abstain") & odd, "abstained": (position == "abstain") & ~odd, "ayes": position == "yes", "nays": position == "nay"}
    lists = c.member_vote.groupBy(F.col("vote_id").alias("meeting_id")).agg(*[F.collect_list(F.when(condition, who)).alias(n) for n, condition in sides.items()], F.collect_list(who).alias("surnames"))
    # each list is sorted and joined once, by the plain order of strings
    rolls = lists.select("meeting_id", *[F.when(F.size(n) == 0, "None").otherwise(F.array_join(F.sort_array(n), ", ")).alias(n) for n in sides], "surnames")
    items, line = agenda(c), F.lit("\n")
    spoken = (
        F.when(F.col("priority") == "high", F.concat(F.lit("RESOLUTION NO. "), F.col("item_id").cast("string"), F.lit(" was read")))
        .when(F.col("priority") == "low", F.concat(F.lit("Item No. "), F.regexp_extract("item_number", "^([0-9]+)", 1), F.lit(" was called")))
        .when(F.col("significance") >= 5, F.concat(F.lit("A contract with "), F.col("vendor"), F.lit(" for $"), F.col("dollars").cast("string"), F.lit(" was read")))
        .otherwise(F.concat(F.lit("A matter of "), F.regexp_replace(F.lower("title"), r"\$[0-9.]+", ""), F.lit(" came up")))
    )
    mention = F.when(F.col("priority") == "high", F.concat(F.lit(", with RESOLUTION NO. "), F.col("item_id").cast("string"), F.lit(" of item "), F.col("item_number"))).when(F.col("significance") >= 7, F.concat(F.lit(", with "), F.lower("title"))).otherwise("")
    # a meeting's items in order, as one row
    firsts = F.array_sort(F.collect_list(F.when(~F.col("is_consent"), F.struct("item_id", spoken.alias("said")))))
    listed = F.array_sort(F.collect_list(F.when(F.col("is_consent"), F.struct("item_id", mention.alias("said")))))
    parts = items.groupBy("meeting_id").agg(firsts.alias("f"), listed.alias("n"))
    one, two = (F.get("f", F.lit(i))["said"] for i in (0, 1))
    named = F.when(F.size("n") > 0, F.array_join(F.transform("n", lambda x: x["said"]), ""))
    text = F.concat(
        F.when((F.col("ayes") != "None") | (F.col("nays") == "None"), F.concat(F.lit("Present on Roll Call: Councilmembers "), F.col("present"), F.lit("\nAbsent: "), F.col("absent"), F.lit("\n\n"))).otherwise("The Council met.\n\n"),
        F.coalesce(F.concat(one, F.lit(f"{_CALLED}\nAyes: "), F.col("ayes"), F.lit("\nNays: "), F.col("nays"), line, F.when(F.col("abstained") != "None", F.concat(F.lit("Abstaining: "), F.col("abstained"), line)).otherwise(""), line), F.lit("")),
        F.coalesce(F.concat(two, F.lit(". Those in favour spoke before those against it did.\nAyes: "), F.col("nays"), F.lit("\nNays: "), F.col("ayes"), F.lit("\n\n")), F.lit("")),
        F.coalesce(F.concat(F.lit(_FILLER * 27 + "\n" + _CONSENT_TEXT), named, F.lit(f"{_CALLED}\nAyes: "), F.col("present"), F.lit("\nNays: None\n")), F.lit("")),
        F.lit("Adjourned in April Session"),
    )
    return rolls.join(parts, "meeting_id").select("meeting_id", "surnames", text.alias("text"))


def only_at(pattern: str, letters: str) -> str:
    """A pattern with flags whose matches begin with one of some letters, tried only where such a letter stands: a look at one
    letter costs much less than each of the pattern's choices."""
    flags, rest = pattern.split(")", 1)
    return f"{flags})(?=[{letters}]){rest}"


def names_of(raw: Column) -> Column:
    """The surnames in a list of names; `None` holds none."""
    return F.when(F.lower(F.trim(raw)) == "none", F.expr("cast(array() as array<string>)")).otherwise(F.regexp_extract_all(raw, F.lit(LISTED_NAME), F.lit(1)))


_NAMES_SQL = f"CASE WHEN lower(trim({{0}})) = 'none' THEN CAST([] AS VARCHAR[]) ELSE list_filter(regexp_split_to_array({{0}}, '[,\\s]+'), lambda x: regexp_matches(x, '{NAME.replace(chr(39), chr(39) * 2)}')) END"


def placed(text: Column, pattern: str, groups: int) -> Column:
    """The matches of a pattern in order, each with its place: begin and end (from 0, exclusive) and its groups g1, g2, ...

    A match is looked up behind the one before it: a pattern that doesn't look around itself, has no anchors and matches no empty text
    has no earlier place with the same text. So the pattern reads the text once; groups are found in a match alone."""
    fields = ", ".join(f"g{k}: string" for k in range(1, groups + 1))
    none = F.expr(f"cast(array() as array<struct<begin: int, end: int, {fields}>>)")

    def add(rows: Column, m: Column) -> Column:
        last = F.coalesce(F.try_element_at(rows, F.lit(-1))["end"], F.lit(0))
        found = [F.regexp_extract(m, pattern, k).alias(f"g{k}") for k in range(1, groups + 1)]
        begin = F.call_function("locate", m, text, last + 1) - 1
        return once(begin, lambda b: F.concat(rows, F.array(F.struct(b.alias("begin"), (b + F.length(m)).alias("end"), *found))))

    return F.aggregate(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), none, add)


def _stripped(text: Column) -> Column:
    """Without white space at both ends; no pattern, since one that ends in `$` is tried at every space."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def vote_blocks(texts: DataFrame, *keep: str) -> DataFrame:
    """meeting_id, block, begin, ayes, nays, abstentions, result, resolution, context, raw_text and consent of each vote in
    texts(meeting_id, text), with the columns of texts to keep.

    Blocks after their preamble come first, then the bare ones whose place is not near one taken before. A tie passes. The
    context is the window before a block, raw_text also holds the block and the window after it; a resolution's number is
    the last one in the context, else the last one before a tally in the raw text.
    """
    def take(kept: Column, m: Column) -> Column:
        near = F.exists(kept, lambda x: F.abs(x["begin"] - m["begin"]) < APART)
        return F.when(near, kept).otherwise(F.concat(kept, F.array(m)))

    every = F.aggregate(placed(F.col("text"), BARE, 3), placed(F.col("text"), only_at(FULL, "tu"), 3), take)
    rows = texts.select("meeting_id", "text", *keep, F.posexplode(every).alias("block", "m"))
    begin, first = F.col("m.begin"), F.greatest(F.col("m.begin") - BEFORE, F.lit(0))
    last = F.least(F.length("text"), F.col("m.end") + AFTER)
    # the names are a generated row, found once: bare columns would be found again in the filter on them
    sides = F.struct(*[names_of(F.col(f"m.g{k}")).alias(n) for k, n in ((1, "ayes"), (2, "nays"), (3, "abstentions"))])
    known = rows.select("*", F.explode(F.array(sides)).alias("sides")).filter("size(sides.ayes) > 0 or size(sides.nays) > 0")
    cut = known.select(
        "meeting_id", "block", *keep, begin.alias("begin"), "sides.ayes", "sides.nays", "sides.abstentions",
        _stripped(F.substring("text", first + 1, begin - first)).alias("context"), _stripped(F.substring("text", first + 1, last - first)).alias("raw_text"),
    )
    inside = F.when(_names_number(F.col("context")), F.try_element_at(F.regexp_extract_all("context", F.lit(only_at(NARROW, "ro")), F.lit(1)), F.lit(-1)))
    resolution = F.coalesce(inside, last_number(F.col("raw_text")))
    result = F.when(F.size("ayes") >= F.size("nays"), "passed").otherwise("failed")
    return cut.select("*", resolution.alias("resolution"), result.alias("result"), is_consent_text(F.col("raw_text")).alias("consent"))


def is_consent_text(text: Column) -> Column:
    return once(F.lower(text), lambda t: any_of(t, CONSENT_PHRASES))


def _names_number(text: Column) -> Column:
    """Whether a number of a resolution or an ordinance can be in a text: plain search is much faster than a pattern."""
    return any_of(F.lower(text), ["resolution", "ordinance"])


def last_number(text: Column) -> Column:
    """The last numbered resolution or ordinance before the first tally."""
    found = F.try_element_at(F.regexp_extract_all(F.get(F.split(text, only_at(TALLY, "a"), 2), F.lit(0)), F.lit(only_at(NUMBERED, "ro")), F.lit(1)), F.lit(-1))
    return F.when(_names_number(text), found)


def _places_sql(kind: str, pattern: str) -> str:
    lengths = lambda x: f"coalesce(list_sum(list_transform({x}, lambda x: length(x))), 0)"
    return f"""{kind}_rows AS (SELECT meeting_id, text, i, ms[i] AS g0, a[i] AS a, n[i] AS n, x[i] AS x, CAST({lengths("gap[1:i]")} + {lengths("ms[1:i - 1]")} AS BIGINT) AS start FROM (
        SELECT meeting_id, text, regexp_extract_all(text, '{pattern}', 0) AS ms, regexp_extract_all(text, '{pattern}', 1) AS a, regexp_extract_all(text, '{pattern}', 2) AS n, regexp_extract_all(text, '{pattern}', 3) AS x,
            regexp_split_to_array(text, '{pattern}') AS gap, unnest(range(1, len(regexp_extract_all(text, '{pattern}', 0)) + 1)) AS i FROM minutes))"""


_LAST_SQL = f"regexp_extract_all(regexp_split_to_array({{0}}, '{TALLY}')[1], '{NUMBERED}', 1)[-1]"
_PHRASES_SQL = " OR ".join(f"contains(lower({{0}}), '{p}')" for p in CONSENT_PHRASES)
BLOCKS_SQL = f"""{MINUTES_SQL}, {_places_sql("full", FULL)}, {_places_sql("bare", BARE)},
    taken AS (SELECT 0 AS kind, * FROM full_rows UNION ALL SELECT 1, * FROM bare_rows b WHERE NOT EXISTS (SELECT 1 FROM full_rows f WHERE f.meeting_id = b.meeting_id AND abs(f.start - b.start) < {APART})),
    windows AS (SELECT meeting_id, CAST(row_number() OVER (PARTITION BY meeting_id ORDER BY kind, i) - 1 AS INTEGER) AS block, start, {_NAMES_SQL.format('a')} AS ayes, {_NAMES_SQL.format('n')} AS nays, {_NAMES_SQL.format("coalesce(x, '')")} AS abstentions,
        regexp_replace(substr(text, greatest(start - {BEFORE}, 0) + 1, start - greatest(start - {BEFORE}, 0)), '^\\s+|\\s+$', '', 'g') AS context,
        regexp_replace(substr(text, greatest(start - {BEFORE}, 0) + 1, least(length(text), start + length(g0) + {AFTER}) - greatest(start - {BEFORE}, 0)), '^\\s+|\\s+$', '', 'g') AS raw_text FROM taken),
    blocks AS (SELECT *, coalesce(regexp_extract_all(context, '{NARROW}', 1)[-1], {_LAST_SQL.format('raw_text')}) AS resolution, CASE WHEN len(ayes) >= len(nays) THEN 'passed' ELSE 'failed' END AS result,
        {_PHRASES_SQL.format('raw_text')} AS consent FROM windows WHERE len(ayes) > 0 OR len(nays) > 0)"""


@query("txt_vote_blocks", BLOCKS_SQL + " SELECT meeting_id, block, start, len(ayes) AS n_ayes, len(nays) AS n_nays, len(abstentions) AS n_abstained, result, resolution, length(context) AS n_context, sha256(raw_text) AS raw_sha256, consent FROM blocks")
def txt_vote_blocks(c: Civic) -> DataFrame:
    sizes = [F.size(a).cast("long").alias(n) for a, n in (("ayes", "n_ayes"), ("nays", "n_nays"), ("abstentions", "n_abstained"))]
    rows = vote_blocks(minutes(c))
    return rows.select("meeting_id", "block", F.col("begin").cast("long").alias("start"), *sizes, "result", "resolution", F.length("context").cast("long").alias("n_context"), F.sha2("raw_text", 256).alias("raw_sha256"), "consent")


@query("txt_vote_members", BLOCKS_SQL + f""", absent AS (SELECT meeting_id, {_NAMES_SQL.format(f"regexp_extract(text, '{ABSENT}', 1)")} AS gone FROM minutes)
    SELECT meeting_id, block, unnest(ayes) AS name, 'yea' AS vote FROM blocks UNION ALL SELECT meeting_id, block, unnest(nays), 'nay' FROM blocks UNION ALL SELECT meeting_id, block, unnest(abstentions), 'abstain' FROM blocks
    UNION ALL SELECT meeting_id, block, name, 'absent' FROM (SELECT meeting_id, block, ayes, nays, abstentions, unnest(gone) AS name FROM blocks JOIN absent USING (meeting_id)) WHERE NOT list_contains(ayes || nays || abstentions, name)""")
def txt_vote_members(c: Civic) -> DataFrame:
    """Who voted how in the minutes' vote blocks; who was absent at the roll call and is in no list counts as absent."""
    texts = minutes(c)
    sides = [F.transform(side, _marked(how)) for side, how in (("ayes", "yea"), ("nays", "nay"), ("abstentions", "abstain"))]
    rows = vote_blocks(texts)
    said = rows.select("meeting_id", "block", F.explode(F.concat(*sides)).alias("m")).select("meeting_id", "block", "m.name", "m.state")
    gone = attendance(texts).filter("state = 'absent'").select("meeting_id", "name", "state")
    silent = rows.select("meeting_id", "block").join(gone, "meeting_id").join(said, ["meeting_id", "block", "name"], "left_anti")
    return said.unionByName(silent.select("meeting_id", "block", "name", "state")).withColumnRenamed("state", "vote")


def _marked(state: str):
    return lambda x: F.struct(x.alias("name"), F.lit(state).alias("state"))


@query("txt_attendance", f"""{MINUTES_SQL} SELECT meeting_id, unnest({_NAMES_SQL.format(f"regexp_extract(text, '{PRESENT}', 1)")}) AS name, 'present' AS state FROM minutes
    UNION ALL SELECT meeting_id, unnest({_NAMES_SQL.format(f"regexp_extract(text, '{ABSENT}', 1)")}), 'absent' FROM minutes""")
def txt_attendance(c: Civic) -> DataFrame:
    return attendance(minutes(c))


def attendance(texts: DataFrame) -> DataFrame:
    """meeting_id, name, state of the last roll call of each text: who was present, who absent."""
    last = lambda pattern: F.try_element_at(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), F.lit(-1))
    rolls = texts.select("meeting_id", names_of(last(PRESENT)).alias("present"), names_of(last(ABSENT)).alias("absent"))
    both = F.concat(*[F.coalesce(F.transform(side, _marked(side)), F.array()) for side in ("present", "absent")])
    return rolls.select("meeting_id", F.explode(both).alias("m")).select("meeting_id", "m.name", "m.state")


@query("fn_resolution_number", f"{MINUTES_SQL} SELECT meeting_id, regexp_extract_all(regexp_split_to_array(text, '{TALLY}')[1], '{NUMBERED}', 1)[-1] AS number FROM minutes")
def fn_resolution_number(c: Civic) -> DataFrame:
    return minutes(c).select("meeting_id", last_number(F.col("text")).alias("number"))


def phrases(text: Column, surnames: Column) -> Column:
    """Distinct capitalised phrases of two words or more and their shorter ends of at least two words: none of procedure, none
    with a month or a surname."""
    found = F.transform(F.regexp_extract_all(text, F.lit(PHRASE), F.lit(0)), lambda p: F.split(p, r"\s+"))
    ends = F.flatten(F.transform(found, lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.slice(w, i, F.size(w)))))
    months, deny = F.array(*map(F.lit, MONTHS)), F.array(*map(F.lit, PROCEDURAL))
    kept = F.filter(ends, lambda w: ~F.arrays_overlap(w, months) & ~F.arrays_overlap(w, surnames) & ~F.array_contains(deny, F.array_join(w, " ")))
    return F.array_distinct(F.transform(kept, lambda w: F.array_join(w, " ")))


def proper_nouns(text: Column, surnames: Column) -> Column:
    """The phrases of a text in order."""
    return F.array_sort(phrases(text, surnames))


def nouns_sql(text: str, surnames: str = "surnames") -> str:
    quoted = lambda names: "[" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + "]"
    words = f"list_transform(regexp_extract_all({text}, '{PHRASE}'), lambda p: regexp_split_to_array(p, '\\s+'))"
    ends = f"flatten(list_transform({words}, lambda w: list_transform(range(1, len(w)), lambda i: w[i:])))"
    good = f"list_filter({ends}, lambda w: NOT list_has_any(w, {quoted(MONTHS)}) AND NOT list_has_any(w, {surnames}) AND NOT list_contains({quoted(PROCEDURAL)}, array_to_string(w, ' ')))"
    return f"list_sort(list_distinct(list_transform({good}, lambda w: array_to_string(w, ' '))))"


@query("fn_proper_nouns", f"{MINUTES_SQL} SELECT meeting_id, array_to_string({nouns_sql('text')}, ',') AS nouns FROM minutes")
def fn_proper_nouns(c: Civic) -> DataFrame:
    return minutes(c).select("meeting_id", F.array_join(proper_nouns(F.col("text"), F.col("surnames")), ",").alias("nouns"))


@query("flt_garbage_names", f"{MINUTES_SQL} SELECT meeting_id, w AS name FROM (SELECT meeting_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z]+'))) AS w FROM minutes) WHERE length(w) BETWEEN 3 AND 20 AND regexp_matches(w, '^[A-Z]') AND NOT (upper(w) = w AND length(w) > 2) AND w NOT IN ('None', 'Approving', 'Street', 'Councilmembers', 'Roll', 'Call', 'Ayes', 'Nays', 'Present', 'Absent', 'April')")
def flt_garbage_names(c: Civic) -> DataFrame:
    """Words of the minutes that may be names: of 3 to 20 letters, capitalised, not all capitals, not on the stop list."""
    stop = ["None", "Approving", "Street", "Councilmembers", "Roll", "Call", "Ayes", "Nays", "Present", "Absent", "April"]
    words = minutes(c).select("meeting_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1)))).alias("name"))
    good = F.length("name").between(3, 20) & F.col("name").rlike("^[A-Z]") & ~((F.upper("name") == F.col("name")) & (F.length("name") > 2))
    return words.filter(good & ~F.col("name").isin(stop))


@query("cls_vote_kind", BLOCKS_SQL + f" SELECT meeting_id, block, CASE WHEN {_PHRASES_SQL.format("raw_text || ' ' || context")} THEN 'consent_block' ELSE 'substantive' END AS kind FROM blocks")
def cls_vote_kind(c: Civic) -> DataFrame:
    return vote_blocks(minutes(c)).select("meeting_id", "block", vote_kind().alias("kind"))


def vote_kind() -> Column:
    """consent_block where a canonical phrase stands in the raw text or the context of a vote, else substantive."""
    return F.when(is_consent_text(F.concat_ws(" ", "raw_text", "context")), "consent_block").otherwise("substantive")


@query("txt_consent_phrase", f"{MINUTES_SQL} SELECT meeting_id, {_PHRASES_SQL.format('text')} AS hit FROM minutes")
def txt_consent_phrase(c: Civic) -> DataFrame:
    """Whether the minutes hold a canonical phrase of the consent agenda."""
    return minutes(c).select("meeting_id", is_consent_text(F.col("text")).alias("hit"))


@query("txt_consent_enumeration", f"{MINUTES_SQL} SELECT meeting_id, unnest(regexp_extract_all(text, 'RESOLUTION NO\\. ([A-Z0-9-]+) ([^\\n]+)', 1)) AS number, unnest(regexp_extract_all(text, 'RESOLUTION NO\\. ([A-Z0-9-]+) ([^\\n]+)', 2)) AS description FROM minutes")
def txt_consent_enumeration(c: Civic) -> DataFrame:
    """Pairs of a resolution's number and text."""
    pattern = F.lit(r"RESOLUTION NO\. ([A-Z0-9-]+) ([^\n]+)")
    pairs = F.arrays_zip(*[F.regexp_extract_all("text", pattern, F.lit(k)).alias(n) for k, n in ((1, "number"), (2, "description"))])
    return minutes(c).select("meeting_id", F.explode(pairs).alias("p")).select("meeting_id", "p.number", "p.description")


@query("mrg_vote_context_refresh", BLOCKS_SQL + " SELECT v.vote_id, coalesce(b.resolution, CAST(v.vote_id AS VARCHAR)) AS number, right(b.context, 200) AS context FROM vote v LEFT JOIN (SELECT * FROM blocks WHERE block = 0) b ON b.meeting_id = v.meeting_id")
def mrg_vote_context_refresh(c: Civic) -> DataFrame:
    """Votes take number and the end of their context from the minutes parsed again; a number that isn't found stays."""
    parsed = vote_blocks(minutes(c)).filter("block = 0").select("meeting_id", "resolution", "context")
    joined = c.vote.join(parsed, "meeting_id", "left")
    return joined.select("vote_id", F.coalesce("resolution", F.col("vote_id").cast("string")).alias("number"), F.right("context", F.lit(200)).alias("context"))
