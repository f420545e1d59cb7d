"""Scoring rules as data: floors that only raise a score and ceilings that only lower it, with an audit list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Name, condition, bound; in the order in which they fire.
FLOORS = [
    ("red_plus_10m", "dollars >= 10000000", 9),
    ("red_1m", "dollars >= 1000000", 7),
    ("orange_sole_source", "dollars >= 250000 and procurement = 'sole_source'", 7),
    ("orange_settlement", "dollars >= 250000 and action_type = 'settlement'", 8),
    ("yellow_sole_source", "dollars >= 50000 and procurement = 'sole_source'", 6),
    ("yellow_settlement", "dollars >= 50000 and action_type = 'settlement'", 6),
    ("any_settlement", "action_type = 'settlement'", 6),
    ("zoning_large", "action_type = 'zoning' and (coalesce(parcels, 0) >= 5 or coalesce(acres, 0) >= 10)", 7),
    ("emergency_proc", "action_type = 'emergency_procurement'", 7),
    ("appt_executive", "action_type = 'appointment_executive'", 7),
    ("appt_board", "action_type = 'appointment_board'", 5),
    ("tax_abatement_orange", "action_type = 'tax_abatement' and dollars >= 250000", 7),
]
CEILINGS = [
    ("red_consent", "dollars >= 1000000 and is_consent", 2),
    ("sole_source_consent", "procurement = 'sole_source' and is_consent", 2),
    ("settlement_consent", "action_type = 'settlement' and is_consent", 1),
    ("appt_executive_consent", "action_type = 'appointment_executive' and is_consent", 2),
]
# Subjects, their pattern, the floor of significance and the ceiling of consent placement.
SUBJECTS = [
    ("surveillance_alpr", r"(?i)\b(flock|alpr|license\s+plate\s+reader|predictive\s+policing|facial\s+recognit|surveillance\s+camera|gunshot\s+detect|shotspotter|audit\s+log)\b", 7, 2),
    ("police_oversight", r"(?i)\b(citizen\s+review\s+board|use\s+of\s+force|police\s+misconduct|complaint\s+review|police\s+(accountab|oversight)|internal\s+affairs)\b", 8, 2),
    ("eminent_domain", r"(?i)\b(eminent\s+domain|condemnation\s+for\s+public\s+use|compulsory\s+acquisition|taking\s+by\s+the\s+city)\b", 8, 2),
]
#: The subject that a suggested badge calls up as well as its pattern (fixed values).
SUGGESTED = {"surveillance_alpr": "public_safety_tech_privacy"}
#: Facts that a frame of items may lack: then nothing is known of them.
FACTS = {"parcels": "int", "acres": "double", "suggested_badges": "array<string>"}


def _audited(score: Column, field: str, rules: list[tuple[str, Column, int]], raises: bool) -> Column:
    """struct(score, fired): the rules applied in order; a rule fires only where it changes the score."""
    bounds = F.array(*[F.when(rule, F.struct(F.lit(name).alias("trigger"), F.lit(bound).alias("bound"))) for name, rule, bound in rules])
    none = F.expr("cast(array() as array<struct<trigger: string, field: string, pre: int, post: int>>)")

    def apply(held: Column, rule: Column) -> Column:
        better = rule["bound"] > held["score"] if raises else rule["bound"] < held["score"]
        row = F.struct(rule["trigger"].alias("trigger"), F.lit(field).alias("field"), held["score"].alias("pre"), rule["bound"].alias("post"))
        return F.when(held["score"].isNull() | better, F.struct(rule["bound"].alias("score"), F.array_append(held["fired"], row).alias("fired"))).otherwise(held)

    return F.aggregate(F.array_compact(bounds), F.struct(score.cast("int").alias("score"), none.alias("fired")), apply)


def score_floors(items: DataFrame) -> DataFrame:
    """items with significance and consent_score after all rules, and `fired`, the audit list."""
    known = items.withColumns({name: F.lit(None).cast(kind) for name, kind in FACTS.items() if name not in items.columns})
    text = F.concat_ws(" ", "title", "description")

    def found(name: str, pattern: str) -> Column:
        held = text.rlike(pattern)
        return held | F.coalesce(F.array_contains("suggested_badges", SUGGESTED[name]), F.lit(False)) if name in SUGGESTED else held

    known = known.withColumns({f"_{n}": found(n, p) for n, p, _, _ in SUBJECTS})  # both scores ask for them
    floors = [(n, F.expr(rule), b) for n, rule, b in FLOORS] + [(f"{n}_significance", F.col(f"_{n}"), b) for n, _, b, _ in SUBJECTS]
    ceilings = [(n, F.expr(rule), b) for n, rule, b in CEILINGS] + [(f"{n}_consent", F.col("is_consent") & F.col(f"_{n}"), b) for n, _, _, b in SUBJECTS]
    done = known.withColumn("_s", _audited(F.col("significance"), "significance", floors, True)).withColumn("_c", _audited(F.col("consent_score"), "consent_placement", ceilings, False))
    scored = done.withColumns({"significance": F.col("_s.score"), "consent_score": F.col("_c.score"), "fired": F.concat("_s.fired", "_c.fired")})
    return scored.select(*items.columns, "fired")


def triggers_sql(source: str) -> str:
    """Common table expressions `rule` and `trigger(item_id, trigger, field, pre, post)` by plain SQL over source, which has the
    columns that the rules ask for: a rule fires where its bound is beyond those of all rules before it."""
    text = "concat_ws(' ', title, description)"

    def subject(name: str, pattern: str) -> str:
        held = f"regexp_matches({text}, '{pattern}')"
        return f"({held} OR list_contains(suggested_badges, '{SUGGESTED[name]}'))" if name in SUGGESTED else held

    rows = [("significance", n, rule, b) for n, rule, b in FLOORS] + [("significance", f"{n}_significance", subject(n, p), b) for n, p, b, _ in SUBJECTS]
    rows += [("consent_placement", n, rule, b) for n, rule, b in CEILINGS] + [("consent_placement", f"{n}_consent", f"is_consent AND {subject(n, p)}", b) for n, p, _, b in SUBJECTS]
    parts = [f"SELECT item_id, {k} AS k, '{field}' AS field, '{name}' AS trigger, {bound} AS bound, {'significance' if field == 'significance' else 'consent_score'} AS start FROM {source} WHERE {rule}" for k, (field, name, rule, bound) in enumerate(rows)]
    held = "rows between unbounded preceding and 1 preceding"
    return f"""rule AS ({' UNION ALL '.join(parts)}), trigger AS (SELECT item_id, k, trigger, field, CAST(pre AS INTEGER) AS pre, bound AS post FROM (
        SELECT *, CASE field WHEN 'significance' THEN greatest(start, coalesce(max(bound) OVER w, start)) ELSE least(start, coalesce(min(bound) OVER w, start)) END AS pre FROM rule
        WINDOW w AS (PARTITION BY item_id, field ORDER BY k {held})) WHERE CASE field WHEN 'significance' THEN bound > pre ELSE bound < pre END)"""
