"""Steps whose work must grow no faster than their input: results on literal rows, and plans without the costly form."""

import datetime

from pyspark.sql import functions as F

import __spark_entry__
from quorumlake.functions import text as T
from quorumlake.operators import aggregates, coverage, text_index, vote_matching
from quorumlake.operators.readers import related, roster
from quorumlake.sources import listings, minutes

SF = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def civic(spark, name):
    return __spark_entry__._civic()[0][name](spark, SF)


def test_texts_are_joined_once_an_item(spark):
    frame = spark.createDataFrame([("Zoning of a Park", "Police"), ("x", None), (None, None)], "title string, description string")
    asked = frame.select(T.topics(F.col("title"), F.col("description")).alias("all"), T.topic(F.col("title"), F.col("description")).alias("one"), T.priority(F.col("title")).alias("p"))
    assert [tuple(r) for r in asked.collect()] == [(["zoning", "public_safety", "parks_culture"], "zoning", "normal"), ([], None, "normal"), ([], None, "normal")]
    assert plan(asked).count("lower(title") <= 1 and plan(asked).count("lower(coalesce(title") == 2
def test_listing_rows_are_no_growing_list(spark):
    row = '<tr class=odd><td>M{0}<TD>05/07/24<td><a href="V?clip_id={0}&amp;x">A</a>'
    html = "<tr class=even><td>out</tr><table id='archive'><thead><tr class=header><th>x</th></tr>" + "".join(row.format(i) for i in range(3000)) + "<table><td>no</td></table><tr class=odd><td>out</td></tr>"
    pages = spark.createDataFrame([(html,), (None,), ("",), ("<table id=a><tr class=even><td> a <b>b</b></td>no<th>c&lt;</table>",)], "html string")
    rows = listings.table_rows(pages)
    got = rows.collect()
    assert [tuple(r) for r in got[:2]] == [("archive", "header", ["x"], []), ("archive", "odd", ["M0", "05/07/24", "A"], ["V?clip_id=0&x"])]
    assert len(got) == 3002 and tuple(got[-1]) == ("a", "even", ["a b", "c<"], [])
    assert " aggregate(" not in plan(rows)


def test_roster_pairs_no_meeting_with_members(spark):
    d = lambda n: datetime.date(2024, 1, n)
    meetings = spark.createDataFrame([(1, d(1)), (1, d(5)), (1, d(5)), (1, d(9)), (2, d(5)), (None, d(5))], "city_id long, meeting_date date")
    members = spark.createDataFrame([(1, d(5), d(9)), (1, d(2), None), (1, d(6), d(6)), (1, d(8), d(3)), (1, None, d(9)), (1, None, None), (None, d(1), None)], "city_id long, term_start date, term_end date")
    got = {(r.city_id, r.meeting_date): r.members or 0 for r in roster(meetings, members).collect()}
    assert got == {(1, d(1)): 0, (1, d(5)): 2, (1, d(9)): 1, (2, d(5)): 0, (None, d(5)): 0}
    assert "Join" not in plan(roster(meetings, members))


def test_rules_run_once_an_item(spark):
    for name in ("agg_unnest_triggers", "cls_score_triggers"):
        text = plan(civic(spark, name))
        assert text.count("citizen") == 1 and text.count("red_plus_10m") == 1


def test_gate_reads_items_once(spark):
    assert plan(civic(spark, "q_apply_gate")).count("procurement") > 0 and plan(civic(spark, "q_apply_gate")).count("Join Inner") <= 5
    assert plan(civic(spark, "q_apply_gate")).count("Relation [item_id") <= 1


def test_postings_shuffle_nothing(spark):
    docs = spark.createDataFrame([(1, "b a b", "a c"), (2, None, "b"), (3, "", None)], "id long, t string, d string")
    rows = text_index.postings(docs, "id", {"t": 1.0, "d": 0.4})
    far = text_index.FIELD
    assert sorted((r.id, r.term, r.tf, r.places) for r in rows.collect()) == [(1, "a", 1.4, [1, far]), (1, "b", 2.0, [0, 2]), (1, "c", 0.4, [far + 1]), (2, "b", 0.4, [far])]
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_texts_of_consent_votes_are_not_shuffled(spark):
    votes = [(1, 0, "consent_block", "Item  no. 3A, item 12\nitem\titem 7", "paving streets downtown"), (1, 1, "consent_block", " ", ""), (2, 0, "consent_block", "items 3, item 33. no item", None), (3, 0, "substantive", "item 3", "")]
    items = [(10, 1, "3a", "x"), (11, 1, "1", "x"), (12, 1, "12", "x"), (13, 1, "7", "x"), (14, 1, "", "Downtown paving"), (15, 1, None, "Downtown"), (20, 2, "3", "x"), (21, 2, "33.", "x"), (22, 2, "33", "x"), (30, 3, "3", "x")]
    v = spark.createDataFrame(votes, "meeting_id long, block int, kind string, raw_text string, context string")
    i = spark.createDataFrame([(*r, True) for r in items] + [(40, 1, "12", "x", False)], "item_id long, meeting_id long, item_number string, title string, is_consent boolean")
    links = vote_matching.consent_links(v, i)
    assert {r.item_id: r.association == "consent_named" for r in links.collect()} == {10: True, 11: False, 12: True, 13: True, 14: True, 15: False, 20: False, 21: False, 22: True}
    assert "RLIKE(said" not in plan(links)


def test_item_numbers_are_found_once_a_vote(spark):
    votes = spark.createDataFrame([(1, 0, "Item No. 4, #5", ""), (1, 1, "of #5", None), (1, 2, "", "ITEM 4"), (1, 3, None, None)], "meeting_id long, block int, raw_text string, context string")
    items = spark.createDataFrame([(9, 1, "4"), (8, 1, "4"), (7, 1, "5"), (6, 2, "4")], "item_id long, meeting_id long, item_number string")
    hits = vote_matching.by_item_number(votes, items)
    assert {(r.block, r.item_id) for r in hits.collect()} == {(0, 8), (1, 7), (2, 8)}
    assert plan(hits).count("Item|ITEM") == 1


def test_matches_are_placed_in_one_reading(spark):
    frame = spark.createDataFrame([("ab1 b1 cb1b22",), ("",), (None,)], "text string")
    placed = frame.select(minutes.placed(F.col("text"), r"(?i)(B)(\d)", 2).alias("m"))
    assert [[tuple(m) for m in r.m or []] for r in placed.collect()] == [[(1, 3, "b", "1"), (4, 6, "b", "1"), (8, 10, "b", "1"), (10, 12, "b", "2")], [], []]
    assert "split(" not in plan(placed)


def test_agenda_marks_are_found_once(spark):
    texts = spark.createDataFrame([(1, "x ITEM 1. a CONSENT ITEM 2. b (Submitted by C D) ITEM 3."), (2, "none"), (3, None)], "meeting_id long, text string")
    rows = listings.agenda_entries(texts)
    assert [(r.place, r.item_number, r.title, r.sponsor, r.is_consent) for r in rows.orderBy("place").collect()] == [(0, "1", "a", None, False), (1, "2", "b", "C D", True), (2, "3", "", None, False)]
    assert plan(rows).count("regexp_extract_all(") == 1


def test_related_ranks_only_high_meetings(spark):
    rows = [(i, i // 2 % 40, "few" if i % 9 == 0 else "a" if i % 3 else "b", i * 7919 % 23 or None) for i in range(400)] + [(900, 1, "one", 5), (901, 1, "one", 6), (902, 2, None, 9)]
    items = spark.createDataFrame(rows, "item_id long, meeting_id long, topic string, dollars long")
    want = set()
    for i, m, t, _ in rows:
        others = sorted((r for r in rows if t is not None and r[2] == t and r[1] != m), key=lambda r: (-(r[3] or -1), r[0]))
        want |= {(i, r[0]) for r in others[:3]}
    frame = related(items, "topic")
    assert {tuple(r) for r in frame.collect()} == want
    assert "_floor" in plan(frame) and "strategy=broadcast" in plan(frame)


def test_labels_of_subjects_are_shuffled_never_broadcast(spark):
    c = type("C", (), {})()
    c.item = spark.createDataFrame([(7, "A"), (7, "A again"), (8, None)], "item_id long, title string")
    c.meeting = spark.createDataFrame([(7, "M")], "meeting_id long, title string")
    c.member = spark.createDataFrame([(7, "N")], "member_id long, member_name string")
    rows = [("o", f"u{n}", kind, number, slug) for n, (kind, number, slug) in enumerate([("agenda_item", 7, None), ("agenda_item", 9, None), ("agenda_item", 8, None), ("meeting", 7, None), ("council_member", 7, None), ("badge", None, "high_dollar")])]
    found = coverage.with_labels(c, spark.createDataFrame(rows, "outlet string, url string, subject_type string, subject_id long, subject_slug string"))
    assert sorted((r.url, r.label or "") for r in found.collect()) == [("u0", "A"), ("u0", "A again"), ("u1", ""), ("u2", ""), ("u3", "M"), ("u4", "N"), ("u5", "High Dollar")]
    assert plan(found).count("Join") == 1 and "strategy=merge" in plan(found)


def test_terms_deal_a_city_over_parts(spark):
    d = lambda n: datetime.date(2024, 1, n)
    meetings = [(i, i % 3 or None, d(1 + i % 9) if i % 11 else None) for i in range(60)] + [(7, 1, d(2))]
    members = [(i, i % 4 or None, d(1 + i % 7), d(1 + i % 12) if i % 3 else None) for i in range(40)] + [(99, 1, None, None), (4, 1, d(1), None), (4, 1, d(1), None)]
    got = aggregates.in_office(spark.createDataFrame(meetings, "meeting_id long, city_id long, meeting_date date"), spark.createDataFrame(members, "member_id long, city_id long, term_start date, term_end date"))
    want = sorted((i, m) for i, c, day in meetings for m, t, a, b in members if c is not None and c == t and day and a and a <= day and (b is None or day < b))
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 100
    assert "(city_id" in plan(got) and "part#" in plan(got) and "strategy=merge" in plan(got)


def test_words_of_texts_are_found_once(spark):
    votes = spark.createDataFrame([(1, 0, "paving of harbor streets tonight", ""), (1, 1, "two words", "")], "meeting_id long, block int, raw_text string, context string")
    items = spark.createDataFrame([(7, 1, "Paving harbor streets"), (8, 1, "of the"), (9, 1, None)], "item_id long, meeting_id long, title string")
    hits = vote_matching.by_words(votes, items)
    assert [tuple(r) for r in hits.collect()] == [(1, 0, 7, 0.75)]
    assert plan(hits).count("[a-z]{4,}") == 2


def test_consent_items_are_judged_once(spark):
    votes = spark.createDataFrame([(1, 0, "consent_block", "Item 3 and paving harbor streets", ""), (1, 1, "consent_block", "", " ")], "meeting_id long, block int, kind string, raw_text string, context string")
    items = spark.createDataFrame([(7, 1, "3", "x", True), (8, 1, "4", "Harbor paving", True), (9, 1, "5", "Parks", True)], "item_id long, meeting_id long, item_number string, title string, is_consent boolean")
    links = vote_matching.consent_links(votes, items)
    assert sorted(tuple(r) for r in links.collect()) == [(1, 0, 7, "consent_named", 1.0), (1, 0, 8, "consent_named", 1.0), (1, 0, 9, "consent_implicit", 0.8)]
    assert plan(links).count("array_intersect") == 1 and plan(links).count("concat_ws") == 1


def test_lists_of_minutes_are_read_once(spark):
    texts = spark.createDataFrame([(1, "RESOLUTION NO. 7 grant\nordinance 5 paving harbor streets soon\nResolution 9 harbor streets paving"), (2, None)], "meeting_id long, text string")
    rows = [(1, "Grant", "No. 7", True), (2, "Paving harbor streets", "", True), (3, "Paving harbor streets too", "and 5", True), (4, "Paving harbor streets", "", False), (5, "paving harbor streets now", "17", True)]
    items = spark.createDataFrame([(i, 1, t, h, c) for i, t, h, c in rows], "item_id long, meeting_id long, title string, hay string, is_consent boolean")
    found = vote_matching.enumerated_items(texts, items)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1), (1, 2), (1, 3)]
    assert plan(found).count("Join") == 1 and plan(found).count("regexp_extract_all(text") == 1


def test_names_of_a_block_are_found_once(spark):
    texts = spark.createDataFrame([(1, "the Ordinance No. 12 was read, Upon the roll being called:\nAyes: Alba\nNays: None\n"), (2, "Ayes: none\nNays: 7\n")], "meeting_id long, text string")
    rows = minutes.vote_blocks(texts)
    assert [(r.meeting_id, r.ayes, r.nays, r.abstentions, r.resolution) for r in rows.collect()] == [(1, ["Alba"], [], [], "12")]
    assert plan(rows).count("(?<![^,") == 3


def test_amounts_are_found_once_a_text_not_once_a_name(spark):
    votes = spark.createDataFrame([(1, 0, "Shield Works and Harbor Group for $5.00", "", ["Reed"])], "meeting_id long, block int, raw_text string, context string, surnames array<string>")
    items = spark.createDataFrame([(7, 1, "Shield Works of Harbor Group, $5.00"), (8, 1, "Harbor Group $5.00"), (9, 1, "Shield Works and Harbor Group")], "item_id long, meeting_id long, hay string")
    hits = vote_matching.by_facts(votes, items)
    assert [tuple(r) for r in hits.collect()] == [(1, 0, 7, 0.9)]
    assert plan(hits).index("explode(names") < plan(hits).index("million")
