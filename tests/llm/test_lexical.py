"""Ranked search against brute force: ties, copies, nulls, repeated items, blocks, long texts and clashing columns."""

import math
import random
import re
from collections import Counter

import pytest

from quorumlake.llm import lexical
from quorumlake.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import spark_rows, sql_rows

SCHEMA = "doc_id long, text string, item long, score string, class int, place string, row int, n int, m int, hash long, bag string"
EXTRA = (1, "s", 2, "p", 3, 4, 5, 6, "b")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def split(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    held = [(i, Counter(t), len(t)) for i, t in ((i, split(t)) for i, t in docs) if t]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(w for _, own, _ in held for w in own)
    out = []
    for item_id, text in items:
        rows = []
        for i, own, length in held:
            m = 100 - 75 + (75 * length * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1000000000 * own[w]) // (1000 * own[w] + 8 * m)) for w in split(text) if own[w])
            if s > 0:
                rows.append((-s, i is None, i))
        out += [(item_id, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(rows, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def frames(spark, docs, items):
    return spark.createDataFrame([(*r, *EXTRA) for r in docs], SCHEMA).repartition(5), spark.createDataFrame(items, "item_id long, text string")


def data(seed):
    rng = random.Random(seed)
    words = ["Ab", "ab", "ÀB", "àb", "x9", "漢字", "the", "the", "the", "zu", "q-w", "l'm", "a_b", "\x7f", "ı"]
    make = lambda n: " ".join(rng.choice(words) for _ in range(rng.randint(0, n)))
    copies = [make(12) for _ in range(8)]
    docs = [(rng.choice([None, i, i, i % 20]), rng.choice(copies) if rng.random() < 0.5 else make(30)) for i in range(150)]
    docs += [(200, None), (201, ""), (202, "--"), (203, "the " * 3), (204, "x" * 300_000 + " zu")]
    items = [(i, make(8)) for i in range(12)] + [(3, "the x9"), (3, "the x9"), (None, "zu"), (20, None), (21, ""), (22, "nowhere")]
    return docs, items


@pytest.mark.parametrize(("item_bytes", "item_rows"), [(10**6, 10**6), (60, 5)])
def test_against_brute_force(spark, item_bytes, item_rows):
    docs, items = data(item_rows)
    got = lexical.ranked_search(*frames(spark, docs, items), item_bytes=item_bytes, item_rows=item_rows).collect()
    assert sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in got], key=repr) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = data(1)
    a, b = frames(spark, docs, items)
    assert lexical.ranked_search(a.limit(0), b).count() == 0
    assert lexical.ranked_search(a, b.limit(0)).count() == 0


def test_long_texts_in_slices():
    text = "Ab, c9 é" * 400_000
    assert [w.decode() for part in lexical.terms(text) for w in part] == split(text)
    assert list(lexical.terms("")) == []


def test_classes_keep_their_smallest_members(spark):
    docs = spark.range(5000).selectExpr("5000 - id as doc_id", "if(id % 3 = 0, 'b a', concat('a ', id % 7)) as text")
    bags = lexical.document_bags(docs.repartition(3), [b"a", b"b"])
    rows = lexical.classes_of(bags, 5000, 10_000, 10).groupBy("class", "bag").agg({"doc_id": "max", "place": "max"}).collect()
    # the words outside the vocabulary make no difference: two classes
    assert len(rows) == 2 and all(r["max(place)"] == 10 and r["max(doc_id)"] <= 40 for r in rows)
    plan = lexical.classes_of(bags, 5000, 10_000, 10)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_same_rows_as_sql(spark, sf):
    assert spark_rows(QUERIES["op13_bag_search"](spark, sf)) == sql_rows(sf, ORACLE_SQL["op13_bag_search"])
