"""Exact duplicates against brute force: collisions, splits, ties, nulls, long texts and clashing columns."""

import hashlib
import random
import re

import pytest

from quorumlake.llm import exact_dedup
from quorumlake.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import spark_rows, sql_rows

SCHEMA = "doc_id long, text string, entry string, key int, bucket string, members string, n int, _place int"


def brute(rows):
    norm = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in rows]
    groups = {}
    for (i, _), t in zip(rows, norm, strict=True):
        groups.setdefault(t, []).append(i)
    out = []
    for (i, _), t in zip(rows, norm, strict=True):
        ids = [x for x in groups[t] if x is not None]
        out.append((i, min(ids, default=None), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr), len(groups)


def rows_of(seed, n=200):
    rng = random.Random(seed)
    pool = ["", " ", None, "\t \n", "a b", "a  b", "a\x0bb", "A b", "é x", "é x", "x" * 300_000, "x" * 300_000 + "y", " ", "\x1c", "a\x1cb"] + ["w%d" % i for i in range(60)]
    return [(rng.choice([None, rng.randint(0, 150), i]), rng.choice(pool)) for i in range(n)]


@pytest.mark.parametrize(("bits", "capacity", "memory"), [(64, 20_000, 16_000_000), (2, 10, 50), (0, 5, 1000), (16, 1, 0)])
def test_against_brute_force(spark, bits, capacity, memory):
    rows = rows_of(bits)
    docs = spark.createDataFrame([(*r, "e", 1, "b", "m", 2, 3) for r in rows], SCHEMA).repartition(3)
    got = exact_dedup.deduplicated(docs, capacity, bits, memory).collect()
    want, groups = brute(rows)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=repr) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == groups == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_empty_table(spark):
    assert exact_dedup.deduplicated(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_copies_make_bounded_entries(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "'same  text' as text").repartition(3)
    assert exact_dedup.combined_entries(docs).selectExpr("max(size(members))").first()[0] <= exact_dedup.MEMBERS
    got = exact_dedup.deduplicated(docs).groupBy("keep_id", "group_size", "kept").count().collect()
    assert {(r.keep_id, r.group_size, r.kept, r["count"]) for r in got} == {(0, 20_000, True, 1), (0, 20_000, False, 19_999)}


def test_directory_doubles_and_splits():
    top = exact_dedup.DEPTH
    one = exact_dedup.grow_directory({5: 10}, 10)
    assert (one.depth, one.slots) == (0, [0])
    # all entries in the first eighth: three splits, the other buckets keep their own depths
    eighth = 1 << (top - 3)
    d = exact_dedup.grow_directory({0: 6, eighth - 1: 6, 1 << (top - 1): 3}, 12)
    assert d.depth == 1 and sorted(d.depths) == [1, 1]
    d = exact_dedup.grow_directory({0: 8, eighth: 8, 1 << (top - 1): 3}, 12)
    assert d.depth == 3 and sorted(d.depths) == [1, 2, 3, 3]
    assert [d.slots[i] for i in range(4, 8)] == [d.slots[4]] * 4 and d.slots[2] == d.slots[3] and len(set(d.slots)) == 4
    # equal keys cannot be split: the directory stops at its greatest depth
    assert exact_dedup.grow_directory({7: 100}, 12).depth == top


def test_buckets_are_key_ranges_on_files(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('t', id % 1000) as text").repartition(4)
    index = exact_dedup.build_index(docs, capacity=100)
    assert len(index.directory.depths) > 8
    ranges = index.chains.selectExpr("bucket", "shiftrightunsigned(key, 48) as p").groupBy("bucket").agg({"p": "min", "bucket": "count"}).collect()
    assert max(r["count(bucket)"] for r in ranges) <= 100 and sum(r["count(bucket)"] for r in ranges) == index.entries.count()
    known = index.directory.of_prefixes()
    assert all(known[r["min(p)"]] == r["bucket"] for r in ranges)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_same_rows_as_sql(spark, sf):
    assert spark_rows(QUERIES["op12_exact_index"](spark, sf)) == sql_rows(sf, ORACLE_SQL["op12_exact_index"])
