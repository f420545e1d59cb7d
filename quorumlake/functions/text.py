"""Text functions as column expressions: money, sponsors, titles, topics, names, numbers, dates, labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Topics with their keywords, in order; the first match is the main topic.
TOPICS = [
    ("zoning", ["rezon", "zoning", "planning approval", "planned unit development", "land use", "subdivision", "plat", "variance", "certificate of occupancy", "building permit", "annexation"]),
    ("public_safety", ["police", "fire department", "public safety", "law enforcement", "surveillance", "emergency", "nuisance", "demolition", "demolish", "abatement", "inoperable motor vehicle", "code enforcement", "animal shelter", "stray"]),
    ("public_works", ["resurfacing", "drainage", "sidewalk", "road", "street", "infrastructure", "water", "sewer", "paving", "traffic signal", "street sweeper", "sanitation", "garbage", "recycling"]),
    ("budget", ["budget", "appropriat", "transfer funds", "fiscal year", "general fund", "expense account", "payment to", "purchase order", "lump sum bid"]),
    ("grants", ["grant", "federal funding", "hud", "cdbg", "fema", "department of justice", "department of transportation", "safe streets", "cops hiring"]),
    ("contracts", ["contract with", "agreement between", "execute and deliver", "amendment to the agreement", "purchase order", "bid of", "procurement"]),
    ("legal", ["settlement", "city attorney", "lawsuit", "litigation", "workers' compensation", "mutual release", "general code"]),
    ("parks_culture", ["park", "recreation", "library", "museum", "arts", "folk festival", "cultural", "pool", "ballfield"]),
    ("licensing", ["license", "liquor", "beer", "wine", "abc board", "certificate of public convenience", "noise ordinance", "waiver"]),
    ("appointments", ["appointing", "appointment", "employee of the month", "special bonus", "board member"]),
    ("routine", ["roll call", "pledge of allegiance", "invocation", "approval of minutes", "minutes not ready", "adjournment", "consent agenda", "old and new business", "request from the public", "communications from", "presentations"]),
]
# Words that raise or lower the priority of a title.
HIGH_WORDS = ["settlement", "sole source", "sole-source", "no-bid", "no bid", "emergency", "flock", "surveillance", "litigation", "department head", "police chief", "city attorney", "annexation", "rezoning", "variance", "easement"]
LOW_WORDS = ["fleet", "fuel", "tires", "maintenance", "office supplies", "mileage", "travel reimbursement", "minutes", "travel authorization", "membership dues", "notary bond"]
# Titles of procedural and of withdrawn items.
PROCEDURAL = [
    r"^\s*roll\s+call", r"^\s*(call\s+to|opening\s+of)\s+(public\s+)?comments?", r"^\s*pledge\s+of\s+allegiance", r"^\s*invocation", r"^\s*moment\s+of\s+silence", r"^\s*motion\s+to\s+adjourn",
    r"^\s*adjournment", r"^\s*recess", r"^\s*approval\s+of\s+(prior|previous|the)?\s*minutes", r"^\s*minutes\s+(not\s+)?(yet\s+)?(ready|available|received)\b", r"^\s*reading\s+of\s+(the\s+)?minutes",
    r"^\s*proclamations?\s*$", r"^\s*public\s+comment\s+period", r"^\s*executive\s+session", r"^\s*(vouchers?|bills?|payroll)\s+for\s+payment", r"^\s*approval\s+of\s+claims", r"^\s*recognition\s+of\s+(visitors?|guests?)",
    r"^\s*(awards?\s+and\s+)?presentations?\s*$", r"^\s*reading\s+of\s+(communications?|petitions?)", r"^\s*communications\s+from\s+the\s+(mayor|council)", r"^\s*consideration\s+of\s+(ordinances?|resolutions?)",
    r"^\s*(old|new)(\s+and\s+(old|new))?\s+business\s*$", r"^\s*requests?\s+from\s+the\s+public", r"^\s*(introduction|first\s+reading)(\s+and\s+first\s+reading)?\s+of\s+(ordinances?|resolutions?)", r"^\s*announcements?\s+of\s+boards?\s+and\s+agencies?\s+expirations?",
]
WITHDRAWN = [
    r"^[a-z()./\s]*\bitem\s+\d+\.?\s+\b(?:withdrawn|deferred|postponed)\b", r"^\s*\b(?:withdrawn|deferred|postponed)\b[a-z()./\s]*\bitem\s+\d+\b", r"^[a-z()./\s]*\bitem\s+\d+\.?\s*\(\s*(?:withdrawn|deferred|postponed)\s*\)",
    r"^[a-z()./\s]*\bitem\s+\d+\.?\s+requested\s+to\s+be\s+(?:withdrawn|deferred|postponed)\b", r"^[a-z()./\s]+\b(?:withdrawn|deferred|postponed)\b[a-z()./\s]*\bitem\s+\d+\b", r"^[a-z()./\s]*\bitem\s+\d+\.?\s*[-–—]\s*\b(?:withdrawn|deferred|postponed)\b",
]
# Endings that a meeting title is cut at.
TITLE_ENDINGS = [" - cancelled", " - rescheduled", " - postponed", " - deferred"]


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where value is computed once a row, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def any_of(text: Column, words: list[str]) -> Column:
    """Whether any word occurs, as plain substrings."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def _number(raw: Column) -> Column:
    """A number with commas; a last comma before two digits stands for the decimal point when there is none."""
    cents = raw.rlike(r",\d{2}$") & ~F.contains(raw, F.lit("."))
    mended = F.when(cents, F.regexp_replace(raw, r",(\d{2})$", ".$1")).otherwise(raw)
    return F.regexp_replace(mended, ",", "").try_cast("decimal(20,2)")


def amounts(text: Column) -> Column:
    """All positive dollar amounts of a text: spelt or lettered millions and thousands, and plain ones."""
    forms = [
        (r"(?i)\$\s*([\d,]+(?:\.\d{1,2})?)\s*million", 1_000_000), (r"\$\s*([\d,]+(?:\.\d)?)\s*M\b", 1_000_000),
        (r"(?i)\$\s*([\d,]+(?:\.\d{1,2})?)\s*thousand", 1_000), (r"\$\s*([\d,]+(?:\.\d)?)\s*K\b", 1_000),
        # a plain amount is one that no unit follows; possessive, so that it isn't found again in part
        (r"\$\s*+([\d,]++(?:\.\d{1,2}+)?+)(?!\s*(?i:m\b|k\b|b\b|million|thousand|billion))", 1),
    ]

    def scaled(unit: int):
        return lambda raw: (_number(raw) * unit).cast("decimal(20,2)")

    parts = [F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), scaled(unit)) for pattern, unit in forms]
    found = F.filter(F.concat(*parts), lambda a: a.isNotNull() & (a > 0))
    return F.when(F.contains(text, F.lit("$")), found)


def dollars_max(text: Column) -> Column:
    return F.array_max(amounts(text))


def dollar_tier(amount: Column) -> Column:
    return F.when(amount <= 0, F.lit(None)).when(amount < 50_000, "green").when(amount < 250_000, "yellow").when(amount < 1_000_000, "orange").when(amount.isNotNull(), "red")


def dollar_chip(amount: Column) -> Column:
    """$487K or $2.4M; undisclosed if unknown. Halves go to the even neighbour."""
    millions = F.concat(F.lit("$"), F.bround(amount / 1_000_000, 1).cast("decimal(12,1)").cast("string"), F.lit("M"))
    thousands = F.concat(F.lit("$"), F.bround(amount / 1000, 0).cast("long").cast("string"), F.lit("K"))
    return F.when(amount.isNull(), "undisclosed").when(amount >= 1_000_000, millions).when(amount >= 1000, thousands).otherwise(F.concat(F.lit("$"), F.bround(amount, 0).cast("long").cast("string")))


def _group(text: Column, pattern: str) -> Column:
    """The first group of the first match, null without one."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def sponsor(text: Column) -> Column:
    found = F.coalesce(_group(text, r"(?i)\(Submitted by\s+(.+?)\)"), _group(text, r"(?i)\(sponsored by\s+(.+?)\)"))
    return F.regexp_replace(F.trim(found), r"\*+$", "")


def clean_title(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"(?i)\s*\((?:Submitted|Recommended|sponsored) by\s+[^)]+\)\s*", " ")), r"\s*\*+\s*$", "")


def _both(title: Column, description: Column) -> Column:
    return F.concat(F.lower(F.coalesce(title, F.lit(""))), F.when(F.length(description) > 0, F.concat(F.lit(" "), F.lower(description))).otherwise(""))


def topic(title: Column, description: Column) -> Column:
    def first(text: Column) -> Column:
        out = F
        for slug, words in TOPICS:
            out = out.when(any_of(text, words), slug)
        return out

    return once(_both(title, description), first)


def topics(title: Column, description: Column) -> Column:
    return once(_both(title, description), lambda text: F.array_compact(F.array(*[F.when(any_of(text, words), slug) for slug, words in TOPICS])))


def meeting_type(title: Column) -> Column:
    t = F.lower(title)
    has = lambda w: F.contains(t, F.lit(w))
    return (
        F.when(has("regular") & has("council"), "council").when(has("special") | has("called"), "special").when(has("work session"), "work_session")
        .when(has("planning") | has("bza") | has("zoning"), "planning").when(has("board") & ~has("council"), "board").when(has("committee") | has("commission"), "committee")
        .when(has("budget") | has("council"), "council").otherwise("other")
    )


def normalize_title(title: Column) -> Column:
    t = F.lower(title)
    cut = t
    for ending in reversed(TITLE_ENDINGS):
        at = F.locate(ending, t)
        cut = F.when(at > 0, F.substring(t, F.lit(1), at - 1)).otherwise(cut)
    return F.trim(F.regexp_replace(F.regexp_replace(cut, r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))


def priority(title: Column) -> Column:
    words = once(F.lower(title), lambda t: F.when(any_of(t, HIGH_WORDS), "high").when(any_of(t, LOW_WORDS), "low").otherwise("normal"))
    return F.when(dollars_max(title) >= 1_000_000, "high").otherwise(words)


def is_big_fish(title: Column) -> Column:
    return F.coalesce(any_of(F.lower(title), HIGH_WORDS), F.lit(False)) | F.coalesce(dollars_max(title) >= 1_000_000, F.lit(False))


def is_procedural(title: Column) -> Column:
    return F.coalesce(title.rlike("(?i)" + "|".join(PROCEDURAL)), F.lit(False))


def is_withdrawn(title: Column) -> Column:
    return F.coalesce(title.rlike("(?i)" + "|".join(WITHDRAWN)), F.lit(False))


def is_foreign(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[\x00-\x7F]", "")) > F.length(text) * 0.4


def data_quality(title: Column, description: Column, source_type: Column) -> Column:
    """struct(quality, priority): gates in order; a long title stands in for a missing body."""
    plain = F.trim(F.coalesce(title, F.lit("")))
    body = F.trim(F.coalesce(description, F.lit("")))
    stands_in = (body == "") & (F.length(plain) >= 60)
    body = F.when(stands_in, plain).otherwise(body)
    same = ~stands_in & (F.lower(body) == F.lower(plain)) & (F.length(body) < 200)
    quality = (
        F.when(is_big_fish(title), "ok").when(F.length(plain) < 5, "empty").when(body == "", "no_agenda_text")
        .when((F.length(body) < 50) & (source_type == "pdf"), "no_text_layer").when(same, "no_text_layer").when(is_foreign(body), "foreign_language").otherwise("ok")
    )
    return F.struct(quality.alias("quality"), F.when(is_big_fish(title), "high").otherwise(F.coalesce(priority(title), F.lit("normal"))).alias("priority"))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of a text's words, each with two spaces before and one after, in lower case."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")

    def of(word: Column) -> Column:
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words, of)))


def trigram_similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(F.trim(a)), trigrams(F.trim(b))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y))), F.lit(0.0))


def significant_words(text: Column, stop: list[str]) -> Column:
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]{4,}"), F.lit(0)))
    return F.array_except(words, F.array(*[F.lit(w) for w in stop]))


def snippet(text: Column, word: Column, around: int = 100) -> Column:
    at = F.instr(F.lower(text), F.lower(word))
    return F.when(at > 0, F.substring(text, F.greatest(at - around, F.lit(1)), F.least(at - 1, F.lit(around)) + F.length(word) + around))


def vote_confidence(gap: Column, needs_review: Column) -> Column:
    base = F.when(gap < 0, 0.0).when(gap < 120, 1.0).when(gap < 600, 0.8).when(gap < 1800, 0.5).otherwise(0.3)
    return F.when(needs_review, base * 0.5).otherwise(base)


def hms(seconds: Column) -> Column:
    h, m, s = F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60
    pad = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), pad(m), pad(s))).otherwise(F.concat_ws(":", m.cast("string"), pad(s)))


def normalize_path(path: Column) -> Column:
    return (
        F.when(path.rlike(r"^/al/[^/]+/meetings/\d+"), F.regexp_replace(path, r"/meetings/\d+", "/meetings/[id]"))
        .when(path.rlike(r"^/al/[^/]+/items/\d+"), F.regexp_replace(path, r"/items/\d+", "/items/[id]"))
        .when(path.rlike(r"^/coverage/\d+"), "/coverage/[id]").when(path.rlike(r"^/items/\d+/badges$"), "/items/[id]/badges").otherwise(path)
    )


def name_variants(name: Column) -> Column:
    """Last name, initial with last name, both without apostrophes, lower-cased."""
    last = F.element_at(F.split(F.trim(name), r"[ #]+"), -1)
    short = F.concat(F.substring(F.trim(name), 1, 1), F.lit(". "), last)
    return F.array_distinct(F.transform(F.array(last, short, F.regexp_replace(last, "'", "")), lambda v: F.lower(v)))


def strip_html(html: Column) -> Column:
    """Tags out, the five named entities back, spaces squeezed."""
    text = F.regexp_replace(F.regexp_replace(html, r"(?s)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def age_state(days: Column) -> Column:
    return F.when(days.isNull(), "unknown").when(days < 1, "good").when(days < 7, "warn").otherwise("bad")


def repair_enum(value: Column, allowed: list[str], otherwise: str = "other") -> Column:
    """null for a spelt null, the value if allowed, else the stand-in."""
    return F.when(F.lower(value).isin("null", "none", ""), F.lit(None)).when(value.isin(allowed), value).when(value.isNotNull(), otherwise)


def meta_url(url: Column, meta: Column) -> Column:
    return F.when(F.contains(url, F.lit("example.com")), F.concat(url, F.when(F.contains(url, F.lit("?")), "&").otherwise("?"), F.lit("meta_id="), meta)).otherwise(url)
