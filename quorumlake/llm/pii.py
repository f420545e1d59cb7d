"""Personal data by weak supervision. DataFrame and SQL functions only.

Base spans (email, ip, card, phone) are the leftmost non-overlapping matches of each kind's pattern that pass its
check; they always stay. Candidates are these matches, valid or not, and two looser kinds: `local` phone numbers without
a plus and `secret` keys. Regex, check, gazetteer, context and edge labelers vote on each candidate. Expectation-
maximisation over the counts of vote patterns (a table of at most 2^8 rows a kind, whatever the corpus) estimates each
labeler's reliability and each pattern's posterior; a logistic span classifier is then trained on these posteriors. It
sees the votes, the kind and the span itself (FEATURES: its length, its digits, the letters beside it), so spans of one
vote pattern can differ; its weights go back into a column expression. It alone decides on looser candidates: one that
it accepts and that overlaps no base span or accepted one before it is added, whatever the check said.

Positions are code points, end exclusive. Null text: empty, no spans. Rows that repeat stay; other columns are ignored;
an empty table gives an empty result. No shuffle but the summing of the vote patterns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

#: Kinds in the order in which equal starts are listed; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "local", "secret")
BASE = KINDS[:4]
#: Possessive groups and the anchors at a run's start only keep long runs linear; they match what the plain forms do.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "local": r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "secret": r"(?i)(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)[ \t]{0,3}[=:][ \t]{0,3}[\"']?[a-z0-9+/_=-]{12,}+[\"']?",
}
#: What a text must hold before its pattern is tried.
NEEDS = {"email": "@", "phone": "+"}
#: Gazetteers: common top-level domains; first digits of card networks; country calling codes (fixed values).
DOMAINS = "com|org|net|edu|gov|info|io|co|de|fr|es|uk|us|eu|it|nl|ch|at|be|ca|au|jp|cn|in|br|ru"
CALLING = "1|7|20|27|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
GAZETTEER = {
    "email": rf"(?i)\.(?:{DOMAINS})$",
    "ip": r"^(?!0|127\.|255)",
    "card": r"^[3-6]",
    "phone": rf"^\+(?:{CALLING})",
    "local": r"^\(?[2-9]",
    "secret": r"(?i)^(?:token|api|access|secret|pass)",
}
#: Words near a span that speak for its kind (fixed values).
CONTEXT = {
    "email": r"(?i)mail|contact|write|@|from|to",
    "ip": r"(?i)\bip\b|host|server|addr|client|login",
    "card": r"(?i)card|visa|master|amex|pay|credit|debit",
    "phone": r"(?i)phone|call|tel|fax|mobile|contact",
    "local": r"(?i)phone|call|tel\b|fax|mobile",
    "secret": r"(?i)token|key|secret|pass",
}
LABELERS = ("shape", "check", "gazetteer", "context", "edge")
#: What the classifier sees of a span itself; bits that follow the votes.
FEATURES = ("long", "digits", "mixed")
ROUNDS = 30
#: Matches that are gathered in one array before it is laid beside the others; characters before a match that a labeler sees.
BLOCK, NEAR = 256, 24
#: Kind, votes and feature bits of a candidate.
Cell = tuple[str, tuple[int, ...]]


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _folded(items: Column, kind: str, start: Column, step) -> Column:
    """The rows that step makes of items, in order: step(at, item) gives the next state and an array of rows (of type kind). Rows are
    gathered by blocks of BLOCK, so that long arrays are not copied with every item."""

    def empty(of: str) -> Column:
        return F.expr(f"cast(array() as {of})")

    def within(held: Column, item: Column) -> Column:
        at, rows = step(held["at"], item)
        return F.struct(at.alias("at"), F.concat(held["rows"], rows).alias("rows"))

    def block(held: Column, k: Column, bound: Column) -> Column:
        done = F.aggregate(F.slice(bound, k * BLOCK + 1, F.lit(BLOCK)), F.struct(held["at"].alias("at"), empty(f"array<{kind}>").alias("rows")), within)
        return _let(done, lambda own: F.struct(own["at"].alias("at"), F.concat(held["parts"], F.array(own["rows"])).alias("parts")))

    def folded(bound: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.ceil(F.size(bound) / BLOCK).cast("int") - 1)
        first = F.struct(start.alias("at"), empty(f"array<array<{kind}>>").alias("parts"))
        rows = F.aggregate(numbers, first, lambda held, k: block(held, k, bound), lambda held: F.flatten(held["parts"]))
        return F.when(F.size(bound) > 0, rows).otherwise(empty(f"array<{kind}>"))

    return _let(items, folded)


_SPAN = "struct<start: int, end: int, match: string, before: string, after: string>"


def _spans(text: Column, kind: str) -> Column:
    """The matches of a kind with their places and neighbours, all from the gaps between them, so that no text is walked through again
    for a match: before holds up to NEAR characters (from the match before, at most), after the character that follows."""
    pattern = PATTERNS[kind]
    some = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else F.lit(True)
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, match: F.struct(gap.alias("gap"), match.alias("match")))
    none = F.expr(f"cast(array() as array<{_SPAN}>)")

    def with_neighbours(ps: Column) -> Column:
        def row(p: Column, i: Column) -> Column:
            last, following = F.get(ps, i - 1), F.get(ps, i + 1)
            before = F.right(F.concat(F.right(F.coalesce(last["gap"], F.lit("")), F.lit(NEAR)), F.coalesce(last["match"], F.lit("")), p["gap"]), F.lit(NEAR))
            after = F.left(F.concat(F.left(F.coalesce(following["gap"], F.lit("")), F.lit(1)), F.coalesce(following["match"], F.lit(""))), F.lit(1))
            return F.struct(F.length(p["gap"]).alias("gap"), p["match"].alias("match"), before.alias("before"), after.alias("after"))

        return F.filter(F.transform(ps, row), lambda p: p["match"].isNotNull())

    def step(at: Column, p: Column) -> tuple[Column, Column]:
        end = at + p["gap"] + F.length(p["match"])
        return end, F.array(F.struct((at + p["gap"]).alias("start"), end.alias("end"), p["match"].alias("match"), p["before"].alias("before"), p["after"].alias("after")))

    found = _let(_let(pairs, with_neighbours), lambda ps: _folded(ps, _SPAN, F.lit(0), step))
    return F.when(some & text.rlike(pattern), found).otherwise(none)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    """The check of a kind."""
    digits = _digits(match)
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "local":
        return F.length(digits) == 10
    if kind == "secret":
        return match.rlike(r"(?i)[=:][ \t]*[\"']?(?=[a-z0-9+/_=-]{16})(?=[^0-9]*[0-9])(?=[^a-z]*[a-z])")
    return F.lit(True)


def _votes(kind: str, span: Column) -> Column:
    """The labelers' votes on a span and its feature bits, 1 or 0 each."""
    match, before = span["match"], span["before"]
    around = F.concat(F.right(before, F.lit(1)), F.lit(" "), span["after"])
    shape = F.lit(True) if kind in BASE else match.rlike(r"[\"']$") if kind == "secret" else match.rlike(r"^\(|-[0-9]{3}-")
    length = F.length(match) <= 254 if kind == "email" else F.lit(True)
    context = (match if kind == "secret" else before).rlike(CONTEXT[kind])
    votes = (shape, _valid(kind, match) & length, match.rlike(GAZETTEER[kind]), context, ~around.rlike(r"[\p{L}\p{N}]"))
    features = (F.length(match) >= 20, F.length(_digits(match)) >= 8, match.rlike(r"[a-z]") & match.rlike(r"[A-Z]"))
    return F.array(*[v.cast("int") for v in (*votes, *features)])


def candidates(text: Column) -> Column:
    """All candidates of a text: array<struct<start, order, end, kind, valid, votes>>."""
    text = F.coalesce(text, F.lit(""))
    parts = []

    def row_of(order: int, kind: str):
        def row(s: Column) -> Column:
            return F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"), _valid(kind, s["match"]).alias("valid"), _votes(kind, s).alias("votes"))

        return row

    for order, kind in enumerate(KINDS):
        parts.append(F.transform(_spans(text, kind), row_of(order, kind)))
    return F.concat(*parts)


def estimate(cells: dict[Cell, int], rounds: int = ROUNDS) -> tuple[dict[str, float], list[tuple[float, float]], dict[Cell, float]]:
    """Expectation-maximisation over counts of (kind, votes and features): priors by kind, (true, false) positive rates by labeler,
    posteriors by cell."""
    n_votes = len(LABELERS)
    posterior = {c: (0.05, 0.1, 0.25, 0.5, 0.9, 0.97)[sum(c[1][:n_votes])] for c in cells}
    prior: dict[str, float] = {}
    rates: list[tuple[float, float]] = []
    for _ in range(rounds):
        good = sum(n * posterior[c] for c, n in cells.items())
        bad = sum(n * (1 - posterior[c]) for c, n in cells.items())
        for kind in {c[0] for c in cells}:
            own = [(n, posterior[c]) for c, n in cells.items() if c[0] == kind]
            prior[kind] = (sum(n * p for n, p in own) + 1) / (sum(n for n, _ in own) + 2)
        rates = []
        for j in range(len(LABELERS)):
            hit = sum(n * posterior[c] for c, n in cells.items() if c[1][j])
            miss = sum(n * (1 - posterior[c]) for c, n in cells.items() if c[1][j])
            rates.append(((hit + 1) / (good + 2), (miss + 0.5) / (bad + 2)))
        for c in cells:
            odds = math.log(prior[c[0]] / (1 - prior[c[0]]))
            for vote, (t, f) in zip(c[1][:n_votes], rates, strict=True):
                odds += math.log(t / f) if vote else math.log((1 - t) / (1 - f))
            posterior[c] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return prior, rates, posterior


def fit(cells: dict[Cell, int], posterior: dict[Cell, float], steps: int = 400) -> dict[str, float]:
    """Weights of the logistic span classifier, from the cells' posteriors and counts."""
    names = ["bias", *LABELERS, *FEATURES, *KINDS]
    weights = dict.fromkeys(names, 0.0)
    total = sum(cells.values()) or 1
    for _ in range(steps):
        slope = {name: 0.01 * w for name, w in weights.items()}
        for (kind, votes), n in cells.items():
            on = ["bias", kind, *[name for name, v in zip(LABELERS + FEATURES, votes, strict=True) if v]]
            p = 1 / (1 + math.exp(-sum(weights[x] for x in on)))
            for name in on:
                slope[name] += (p - posterior[(kind, votes)]) * n / total
        for name in names:
            weights[name] -= 2.0 * slope[name]
    return weights


def train(docs: DataFrame) -> dict[str, float]:
    """The classifier's weights, from the votes on all candidates of docs(text)."""
    found = docs.select(F.explode(candidates(docs["text"])).alias("c")).groupBy("c.kind", "c.votes").agg(F.count(F.lit(1)).alias("n"))
    cells = {(r["kind"], tuple(r["votes"])): r["n"] for r in found.collect()}  # at most 2^8 rows a kind
    return fit(cells, estimate(cells)[2])


def accepted(found: Column, weights: dict[str, float]) -> Column:
    """Base spans, and the looser candidates that the classifier accepts and that overlap none, in order."""
    def score(s: Column) -> Column:
        total = F.lit(weights["bias"])
        for j, name in enumerate(LABELERS + FEATURES):
            total = total + F.lit(weights[name]) * F.element_at(s["votes"], j + 1)
        for kind in KINDS[len(BASE) :]:
            total = total + F.when(s["kind"] == kind, weights[kind]).otherwise(0.0)
        return total

    # sorted by place; of a loose one it is enough to know where the next base span begins and where the kept ones so far end
    usable = F.filter(found, lambda s: (s["valid"] & (s["order"] < len(BASE))) | ((s["order"] >= len(BASE)) & (score(s) > 0)))
    placed = F.array_sort(F.transform(usable, lambda s: F.struct(*[s[x].alias(x) for x in ("start", "order", "end", "kind")])))
    is_base = lambda s: s["order"] < len(BASE)

    def look_ahead(following: Column, s: Column) -> tuple[Column, Column]:
        return F.when(is_base(s), s["start"]).otherwise(following), F.array(F.struct(s.alias("s"), following.alias("next")))

    def keep(end: Column, x: Column) -> tuple[Column, Column]:
        s = x["s"]
        kept = is_base(s) | ((end <= s["start"]) & (x["next"] >= s["end"]))
        return F.when(kept, F.greatest(end, s["end"])).otherwise(end), F.filter(F.array(s), lambda _: kept)

    row = "struct<start: int, order: int, end: int, kind: string>"

    def sifted(all_spans: Column) -> Column:
        ahead = _folded(F.reverse(all_spans), f"struct<s: {row}, next: int>", F.lit(2147483647), look_ahead)
        return _let(F.reverse(ahead), lambda spans: _folded(spans, row, F.lit(0), keep))

    loose = lambda spans: F.exists(spans, lambda s: ~is_base(s))
    return _let(placed, lambda spans: F.when(loose(spans), sifted(spans)).otherwise(spans))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """doc_id, counts by base kind, base_sha256, spans and the number of added spans of each row of docs(doc_id, text)."""
    weights = weights or train(docs)
    found = docs.select(docs["doc_id"].cast("long").alias("doc_id"), accepted(candidates(docs["text"]), weights).alias("all"))
    base = F.filter("all", lambda s: s["order"] < len(BASE))
    kinds = F.transform("all", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"), (F.size("all") - F.size(base)).cast("long").alias("n_extra"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span's characters replaced by its kind in angle brackets; of overlapping spans the first. Spans go by
    blocks: a block's own stretch of the text is cut out once, and its spans are cut from that."""

    def of_block(held: Column, own: Column) -> Column:
        base = held["at"]
        last = F.greatest(base, F.array_max(F.transform(own, lambda s: s["end"])))
        stretch = F.substring(text, base + 1, last - base)

        def in_stretch(piece: Column) -> Column:
            def cut(inner: Column, s: Column) -> Column:
                gap = F.substring(piece, inner["at"] - base + 1, s["start"] - inner["at"])
                mark = F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))
                joined = F.struct(s["end"].alias("at"), F.concat(inner["out"], gap, mark).alias("out"))
                return F.when(s["start"] >= inner["at"], joined).otherwise(F.struct(F.greatest(inner["at"], s["end"]).alias("at"), inner["out"].alias("out")))

            return F.aggregate(own, F.struct(base.alias("at"), F.lit("").alias("out")), cut)

        done = _let(stretch, in_stretch)
        return _let(done, lambda x: F.struct(x["at"].alias("at"), F.concat(held["parts"], F.array(x["out"])).alias("parts")))

    def all_blocks(ps: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.ceil(F.size(ps) / BLOCK).cast("int") - 1)
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("parts"))
        return F.aggregate(numbers, start, lambda held, k: of_block(held, F.slice(ps, k * BLOCK + 1, F.lit(BLOCK))), lambda held: F.concat(F.array_join(held["parts"], ""), F.substring(text, held["at"] + 1, F.length(text))))

    return F.when(F.size(spans) > 0, _let(spans, all_blocks)).otherwise(text)


def redact(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """docs with personal data in `text` replaced by its kind."""
    weights = weights or train(docs)
    text = redacted(docs["text"], accepted(candidates(docs["text"]), weights))
    return docs.select(*[text.alias(c) if c == "text" else docs[c] for c in docs.columns])


def op1_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(read_table(spark, sf_dir, "documents"))
