"""Cases that the synthetic tables lack, on literal rows."""

from decimal import Decimal

from pyspark.sql import functions as F

from quorumlake.functions import text as T
from quorumlake.operators.rules import score_floors
from quorumlake.operators.sequences import asof_backward, upsert


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).head()[0]


def test_dollar_forms(spark):
    cases = {"$1,234.56": "1234.56", "$1.2 million": "1200000", "$1.2M more": "1200000", "$500 thousand": "500000", "$500K": "500000", "$225,000,00": "225000.00", "$2,372.21, M Street": "2372.21", "a $10 and a $30": "30"}
    for text, want in cases.items():
        assert one(spark, text, T.dollars_max) == Decimal(want), text
    for text in ("none", "$", "$0", None):
        assert one(spark, text, T.dollars_max) is None


def test_titles(spark):
    assert one(spark, "Buy it (Submitted by the Mayor)*", T.sponsor) == "the Mayor"
    assert one(spark, "Buy it (Submitted by the Mayor) **", T.clean_title) == "Buy it"
    assert one(spark, "Regular City Council - Cancelled today!", T.normalize_title) == "regular city council"
    assert one(spark, "ITEM 4. (WITHDRAWN)", T.is_withdrawn) is True
    assert one(spark, "Old and new business", T.is_procedural) is True


def test_floors_only_raise(spark):
    rows = [(1, "t", "d", Decimal("2000000"), "settlement", "sole_source", True, 3, 8), (2, "facial recognition", None, Decimal("1"), "other", "bid", False, 9, 1)]
    items = spark.createDataFrame(rows, "item_id long, title string, description string, dollars decimal(15,2), action_type string, procurement string, is_consent boolean, significance int, consent_score int")
    got = {r.item_id: (r.significance, r.consent_score, [f.trigger for f in r.fired]) for r in score_floors(items).collect()}
    assert got[1] == (8, 1, ["red_1m", "orange_settlement", "red_consent", "settlement_consent"])
    assert got[2] == (9, 1, [])


def test_asof_takes_the_last_at_or_before(spark):
    left = spark.createDataFrame([(1, 5), (1, 0), (2, 9)], "k long, t long")
    right = spark.createDataFrame([(1, 5, 10), (1, 5, 11), (1, 1, 12), (2, 10, 13)], "k long, t long, v long")
    got = sorted((r.k, r.t, r.v) for r in asof_backward(left, right, "k", "t", "v").collect())
    assert got == [(1, 0, None), (1, 5, 11), (2, 9, None)]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "k long, x string, y int")
    new = spark.createDataFrame([(2, "c", 9), (3, "d", 1)], "k long, x string, y int")
    once = upsert(old, new, "k", ["y"])
    twice = upsert(once, new, "k", ["y"])
    assert sorted(once.collect()) == sorted(twice.collect()) == [(1, "a", None), (2, "c", 5), (3, "d", 1)]


def test_streams_keep_rows_off_the_driver(spark, tmp_path):
    """A drained stream is read from files, in append and in complete mode."""
    from pyspark.sql import functions as F

    from quorumlake.streaming.web import drain

    spark.range(100).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    rows, sums = drain(stream(), "append"), drain(stream().groupBy((F.col("id") % 2).alias("odd")).agg(F.count(F.lit(1)).alias("n")))
    assert rows.inputFiles() and sums.inputFiles()
    assert sorted(r.id for r in rows.collect()) == list(range(100))
    assert sorted(tuple(r) for r in sums.collect()) == [(0, 50), (1, 50)]


def test_large_rezonings_and_suggested_badges(spark):
    rows = [(1, 5, None, None), (2, 4, 9.9, None), (3, None, 10.0, None), (4, None, None, ["public_safety_tech_privacy"]), (5, None, None, ["other"])]
    schema = "item_id long, parcels int, acres double, suggested_badges array<string>"
    items = spark.createDataFrame(rows, schema).selectExpr("*", "'t' as title", "null as description", "1.0 as dollars", "'zoning' as action_type", "'bid' as procurement", "true as is_consent", "3 as significance", "8 as consent_score")
    got = {r.item_id: (r.significance, r.consent_score, [f.trigger for f in r.fired]) for r in score_floors(items).collect()}
    large, tech = (7, 8, ["zoning_large"]), (7, 2, ["surveillance_alpr_significance", "surveillance_alpr_consent"])
    assert got == {1: large, 2: (3, 8, []), 3: large, 4: tech, 5: (3, 8, [])}


def test_policy_hints(spark):
    from quorumlake.operators.readers import policy_badges

    hints = {
        "a": {"excluded_action_types": ["zoning"], "excluded_phrases": ["Mock"], "keywords": ["C++ (new)", "Road", ("label", r"st\w+t")], "action_types": ["award"], "topics": ["parks"]},
        "b": {"topics": ["parks"]},
    }
    rows = [(1, "The road", "a street", "x", "y"), (2, "road", None, "zoning", "y"), (3, "a mock road", None, "x", "y"), (4, "broad", None, "award", "parks"), (5, None, None, None, "parks"), (6, "none", "", "x", None), (7, "road", "", None, None)]
    items = spark.createDataFrame(rows, "item_id long, title string, description string, action_type string, topic string")
    got = sorted((r.item_id, r.badge, r.how, r.what) for r in policy_badges(items, hints).collect())
    assert got == [(1, "a", "keywords", ["Road", "label"]), (4, "a", "action_type", ["award"]), (4, "b", "topic", ["parks"]), (5, "a", "topic", ["parks"]), (5, "b", "topic", ["parks"]), (7, "a", "keywords", ["Road"])]


def test_manual_badges_and_reviews(spark):
    from quorumlake.operators import badge_actions as B

    badges = spark.createDataFrame([(1, "a", "llm", "flagged", Decimal("0.50")), (2, "a", "llm", "applied", Decimal("0.60"))], "item_id long, badge string, source string, status string, confidence decimal(3,2)")
    actions = spark.createDataFrame([(1, "a", True, "x"), (2, "a", False, "x"), (3, "a", True, "x"), (3, "zzz", True, "x"), (4, "a", False, "x")], "item_id long, badge string, add boolean, actor string")
    after, audit = B.manual_badges(badges, actions, ["a"])
    assert sorted((r.item_id, r.source, str(r.confidence)) for r in after.collect()) == [(1, "llm", "0.50"), (3, "manual", "0.95")]
    assert sorted((r.item_id, r.action) for r in audit.collect()) == [(2, "removed"), (3, "added")]
    again, none = B.manual_badges(after, actions, ["a"])
    assert none.count() == 0 and sorted(again.collect()) == sorted(after.collect())
    decisions = spark.createDataFrame([(1, "a", "rejected"), (2, "a", "rejected"), (9, "a", "applied")], "item_id long, badge string, decision string")
    got = sorted((r.item_id, r.outcome, r.status) for r in B.review(badges, decisions).collect())
    assert got == [(1, "ok", "rejected"), (2, "already_triaged", "applied"), (9, "missing", None)]


def test_votes_of_a_meeting_come_once(spark):
    from quorumlake.operators.badge_actions import new_votes

    votes = spark.createDataFrame([(1, 0, ["A"], ["B"], []), (2, 0, ["C"], [], ["D"])], "meeting_id long, block int, ayes array<string>, nays array<string>, abstentions array<string>")
    scanned = spark.createDataFrame([(1,), (1,)], "meeting_id long")
    assert sorted(map(tuple, new_votes(votes, scanned).collect())) == [(2, 0, "C", "yea"), (2, 0, "D", "abstain")]
