"""Tables of versions: replayed and interrupted merges, untouched partitions, and a restart in a new process."""

import os
import subprocess
import sys

from pyspark.sql import functions as F

from quorumlake.operators.versions import VersionedTable, summed
from quorumlake.streaming import web


def table(spark, path, parts=4):
    return VersionedTable(spark, str(path), "k long, n long", F.pmod("k", F.lit(parts)))


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k long, n long")


def held(t, version=None):
    return sorted(map(tuple, t.read(version).collect()))


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    t, add = table(spark, tmp_path), summed(["k"], ["n"])
    assert held(t) == []
    assert t.merge(rows(spark, (1, 5), (2, 1)), 0, add)
    assert t.merge(rows(spark, (2, 10), (7, 3)), 1, add)
    want = [(1, 5), (2, 11), (7, 3)]
    assert held(t) == want
    assert not t.merge(rows(spark, (2, 10), (7, 3)), 1, add)
    assert held(t) == want and held(t, 0) == [(1, 5), (2, 1)]


def test_a_merge_that_failed_before_its_commit_starts_again(spark, tmp_path):
    t, add = table(spark, tmp_path), summed(["k"], ["n"])
    t.merge(rows(spark, (1, 5)), 0, add)
    t.merge(rows(spark, (1, 2)), 1, add)
    os.remove(tmp_path / "manifests" / "000000000001")  # its data lies there, its manifest doesn't
    again = table(spark, tmp_path)
    assert held(again) == [(1, 5)]
    assert again.merge(rows(spark, (1, 2)), 1, add) and held(again) == [(1, 7)]


def test_only_touched_partitions_are_written(spark, tmp_path):
    t, add = table(spark, tmp_path), summed(["k"], ["n"])
    t.merge(rows(spark, *[(i, 1) for i in range(8)]), 0, add)
    t.merge(rows(spark, (5, 1)), 1, add)
    first, second = t.manifest(0), t.manifest(1)
    assert [p for p in first if first[p] != second[p]] == ["1"]
    assert sorted(p.name for p in (tmp_path / second["1"]).iterdir() if p.name.startswith("part=")) == ["part=1"]


def test_rows_may_leave_a_partition(spark, tmp_path):
    t = table(spark, tmp_path)
    t.merge(rows(spark, (1, 1), (2, 2)), 0, lambda old, new: new)
    t.merge(rows(spark, (1, 0)), 1, lambda old, new: old.join(new, "k", "left_anti"))
    assert held(t) == [(2, 2)]
    assert len(t.vacuum(keep=1)) == 1 and held(t) == [(2, 2)]


PROGRAM = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from quorumlake.streaming import web
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
table = web.totals_table(spark, {base!r} + "/table")
stream = spark.readStream.schema("user_id long, value double").parquet({base!r} + "/in")
web.upsert_batches(stream, web.totals_merge(table), {base!r} + "/checkpoint").awaitTermination()
"""


def test_a_restart_in_a_new_process_goes_on_from_the_table(spark, tmp_path):
    base = str(tmp_path)

    def deliver(*pairs):
        spark.createDataFrame(list(pairs), "user_id long, value double").coalesce(1).write.mode("append").parquet(f"{base}/in")

    def run():
        subprocess.run([sys.executable, "-c", PROGRAM.format(repo=os.getcwd(), base=base)], check=True, timeout=180, capture_output=True)

    def totals():
        return sorted(map(tuple, web.totals_table(spark, f"{base}/table").read().collect()))

    deliver((1, 1.0), (2, 0.5))
    run()
    deliver((1, 2.0))
    run()
    assert totals() == [(1, 2, 300), (2, 1, 50)]
    commits = tmp_path / "checkpoint" / "commits"
    last = max(int(p.name) for p in commits.iterdir() if p.name.isdigit())
    for name in (f"{last}", f".{last}.crc"):  # as if the driver had been lost between the merge and the stream's commit
        (commits / name).unlink(missing_ok=True)
    run()
    assert totals() == [(1, 2, 300), (2, 1, 50)]
