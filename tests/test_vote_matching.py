"""Votes parsed from literal minutes, and matched with literal items, tier by tier."""

import pytest

from quorumlake.operators import vote_matching as V
from quorumlake.sources import minutes as M

CONSENT = """Item 12 is a paving contract of ordinance 1854-25.

The resolutions and ordinances introduced as consent agenda matters were read by the
City Clerk, and upon the roll being called, the vote was as
follows:
Ayes: Alba, Stone, O'Quinn
Nays: None
"""
PLAIN = """A Resolution for an agreement with Harbor Paving Group for $2,300,000.

The resolution was read, and upon the roll being
called, the vote was as follows:
Ayes: Alba, Stone
Nays: Reed, Vale.
Abstaining: Holt
"""


def parsed(spark, *texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "meeting_id long, text string")
    return sorted(M.vote_blocks(frame).withColumn("kind", M.vote_kind()).collect(), key=lambda r: (r.meeting_id, r.block))


def test_blocks(spark):
    long = "X " * 800 + PLAIN
    near = "upon the roll being called:Ayes: Alba\nNays: None\nAyes: Reed\nNays: None\n" + "." * 60 + "\nAyes: Vale, reed, 7\nNays: None\n"
    empty = "Ayes: none\nNays: NONE\n"
    consent, plain, after, *rest = parsed(spark, CONSENT, PLAIN, long, near, empty, "", None)
    assert (consent.ayes, consent.nays, consent.consent, consent.kind, consent.resolution) == (["Alba", "Stone", "O'Quinn"], [], True, "consent_block", "1854-25")
    assert (plain.ayes, plain.nays, plain.abstentions, plain.result, plain.consent, plain.kind) == (["Alba", "Stone"], ["Reed", "Vale"], ["Holt"], "passed", False, "substantive")
    assert plain.resolution is None and plain.raw_text.endswith("Holt") and plain.context.endswith("called,")
    assert "Harbor Paving Group" in after.context and len(after.context) <= 1500 and after.begin == PLAIN.index("the vote was") + 1600
    # the bare block inside the first is the first; the next one begins within 50 characters, the last does not
    assert [(r.meeting_id, r.block, r.ayes) for r in rest] == [(3, 0, ["Alba"]), (3, 1, ["Vale"])]


def test_places_of_matches(spark):
    frame = spark.createDataFrame([("éa1 b22 c",), ("",), ("none",)], "text string")
    got = [[tuple(m) for m in r[0]] for r in frame.select(M.placed(M.F.col("text"), r"([a-z])(\d+)", 2)).collect()]
    assert got == [[(1, 3, "a", "1"), (4, 7, "b", "22")], [], []]


def test_who_was_absent_did_not_vote(spark):
    text = "Present on Roll Call: Councilmembers Alba, Stone\nAbsent: Reed, Holt\n\nAyes: Alba, Holt\nNays: Stone\n"
    roll = M.attendance(spark.createDataFrame([(1, text), (2, "no roll call")], "meeting_id long, text string")).collect()
    assert sorted((r.name, r.state) for r in roll) == [("Alba", "present"), ("Holt", "absent"), ("Reed", "absent"), ("Stone", "present")]


def test_names_without_procedure_months_and_surnames(spark):
    text = "Pay Shield Works LLC at City Hall in June Session. Councilmember Tate met Tom Tate & Sons Works. Roll Call"
    got = spark.createDataFrame([(text, ["Tate"])], "text string, surnames array<string>").select(M.proper_nouns(M.F.col("text"), M.F.col("surnames"))).first()[0]
    assert got == ["& Sons Works", "Pay Shield Works LLC", "Shield Works LLC", "Sons Works", "Works LLC"]


def match(spark, tier, text, items, resolution=None, surnames=(), context=""):
    votes = spark.createDataFrame([(1, 0, resolution, text, context, list(surnames), "substantive")], "meeting_id long, block int, resolution string, raw_text string, context string, surnames array<string>, kind string")
    rows = [(i, 1, n, t, f"{t} {d}", False) for i, n, t, d in items]
    agenda = spark.createDataFrame([*rows, (99, 2, "4", text, text, False)], "item_id long, meeting_id long, item_number string, title string, hay string, is_consent boolean")
    if tier is None:
        return [(r.item_id, r.method) for r in V.cascade(votes, agenda).collect()]
    return [(r.item_id, r.confidence) for r in tier(votes, agenda).collect()]


ITEMS = [(7, "1", "Deed to Shield Works", "sold for $11,155.25"), (8, "2", "Paving of harbor streets", "by Harbor Paving Group"), (9, "3A", "Library budget amendment", "Resolution 1854-25 of June")]


@pytest.mark.parametrize(
    ("tier", "text", "kwargs", "want"),
    [
        (V.by_resolution, "x", {"resolution": "1854-25"}, [(9, 0.9)]),
        (V.by_resolution, "x", {"resolution": "185"}, []),
        (V.by_resolution, "x", {"resolution": "1854"}, [(9, 0.9)]),
        (V.by_resolution, "x", {}, []),
        (V.by_item_number, "on Item No. 2 and #1", {}, [(8, 0.7)]),
        (V.by_item_number, "see #1 or ITEM 3", {}, []),
        (V.by_item_number, "see #1", {}, [(7, 0.7)]),
        (V.by_item_number, "", {"context": "Item 1"}, [(7, 0.7)]),
        (V.by_facts, "sold to Shield Works for $11,155.25", {}, [(7, 0.9)]),
        (V.by_facts, "sold to Shield Works for $1", {}, [(7, 0.8)]),
        (V.by_facts, "something for $11,155.25", {}, []),
        (V.by_facts, "Shield Works and Paving Group", {}, []),
        (V.by_facts, "sold to Shield Works", {"surnames": ["Shield"]}, []),
        (V.by_words, "the paving of all harbor streets was approved", {}, [(8, 0.75)]),
        (V.by_words, "ordinance resolution council motion", {}, []),
        (V.by_words, "deed to shield works, paving harbor streets", {}, []),
        (None, "Shield Works, on Item No. 2", {}, [(8, "item_number")]),
        (None, "Shield Works, on Item No. 2", {"resolution": "1854-25"}, [(9, "resolution_number")]),
        (None, "library budget changes", {}, [(9, "text_similarity")]),
        (None, "", {}, []),
    ],
)
def test_tiers(spark, tier, text, kwargs, want):
    assert match(spark, tier, text, ITEMS, **kwargs) == want


def test_words_of_a_single_item(spark):
    assert match(spark, V.by_words, "paving streets tomorrow", ITEMS[1:2]) == [(8, 0.7)]
    assert match(spark, V.by_words, "streets tomorrow again", [(8, "2", "paving of harbor streets with ninety workers today", "")]) == []


def test_consent_links(spark):
    votes = spark.createDataFrame([(1, 0, "read with Item no. 12 and paving of harbor streets", "", "consent_block"), (1, 1, "Item 13", "", "substantive")], "meeting_id long, block int, raw_text string, context string, kind string")
    rows = [(1, "12", "Roads", True), (2, "13", "Parks", True), (3, "1", "Paving of harbor streets", True), (4, "14", "Harbor streets", False), (5, "", "", True)]
    items = spark.createDataFrame([(i, 1, n, t, c) for i, n, t, c in rows], "item_id long, meeting_id long, item_number string, title string, is_consent boolean")
    got = {r.item_id: (r.block, r.association, r.confidence) for r in V.consent_links(votes, items).collect()}
    assert got == {1: (0, "consent_named", 1.0), 2: (0, "consent_implicit", 0.8), 3: (0, "consent_named", 1.0), 5: (0, "consent_implicit", 0.8)}


def test_strict_reparse(spark):
    votes = spark.createDataFrame([(m, 0, "consent_block") for m in (1, 2)] + [(1, 1, "substantive")], "meeting_id long, block int, kind string")
    links = spark.createDataFrame([(1, 0, 10, False), (1, 0, 11, False), (1, 0, 12, True), (2, 0, 20, False)], "meeting_id long, block int, item_id long, is_manual boolean")
    listed = spark.createDataFrame([(1, 10), (1, 13)], "meeting_id long, item_id long")
    once = V.strict_reparse(links, listed, votes)
    assert sorted((r.meeting_id, r.item_id, r.change) for r in once.collect()) == [(1, 10, "promote"), (1, 11, "deactivate"), (1, 12, "keep"), (1, 13, "insert"), (2, 20, "keep")]


def test_enumerated_items(spark):
    texts = spark.createDataFrame([(1, "RESOLUTION NO. 77-1 A grant\nORDINANCE 5 paving harbor streets soon\nRESOLUTION 6 two words"), (2, "none")], "meeting_id long, text string")
    rows = [(1, "a", "Grant", "Grant 77-1", True), (2, "b", "Paving harbor streets", "", True), (3, "c", "Paving harbor streets soon", "", False), (4, "d", "two words", "", True)]
    items = spark.createDataFrame([(i, 1, n, t, h, c) for i, n, t, h, c in rows], "item_id long, meeting_id long, item_number string, title string, hay string, is_consent boolean")
    assert sorted(r.item_id for r in V.enumerated_items(texts, items).collect()) == [1, 2]


def test_matching_shuffles_no_text_twice(spark):
    """Numbers meet their meeting's items as one row: neither words nor texts are copied, and no tier is joined with hits."""
    votes = spark.createDataFrame([(1, 0, "12-5", "x", "", ["Reed"], "substantive"), (1, 1, "-7", "Item 3", "", ["Reed"], "substantive"), (1, 2, "A-12", "y", "", ["Reed"], "substantive")], "meeting_id long, block int, resolution string, raw_text string, context string, surnames array<string>, kind string")
    items = spark.createDataFrame([(1, 10, "3", "t", "No. 12-5 and 112-5"), (1, 11, "4", "t", "No. 112-5 or 12-55"), (1, 12, "5", "t", "A-12, b-7")], "meeting_id long, item_id long, item_number string, title string, hay string")
    assert sorted((r.block, r.item_id) for r in V.by_resolution(votes, items).collect()) == [(0, 10), (1, 12), (2, 12)]
    plan = V.by_resolution(votes, items)._jdf.queryExecution().optimizedPlan().toString()
    assert "\\w+" not in plan and plan.count("Join") == 1
    whole = V.cascade(votes, items)
    assert sorted((r.block, r.item_id, r.method) for r in whole.collect()) == [(0, 10, "resolution_number"), (1, 12, "resolution_number"), (2, 12, "resolution_number")]
    assert "LeftAnti" not in whole._jdf.queryExecution().optimizedPlan().toString()


def test_parsed_votes_need_no_join(spark):
    texts = spark.createDataFrame([(1, ["Alba"], CONSENT)], "meeting_id long, surnames array<string>, text string")
    rows = M.vote_blocks(texts, "surnames")
    assert [r.surnames for r in rows.collect()] == [["Alba"]]
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
