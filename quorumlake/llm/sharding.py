"""Balanced label propagation: linked documents gather in common shards under row quotas. DataFrame operations only.

Documents with equal texts are linked. Labels begin as ranges of a salted rank, so every shard starts within its quota.
In each round a linked document looks, through a join on its group, at how many of its neighbours each shard holds and
asks to move to the one with the most. A shard takes the askers of the largest groups first, up to its quota less those
that stay; the others wait for the next round, when shards that filled up no longer attract them. Documents without
links cost no cut edge wherever they are, so they only fill what the quotas leave. A group larger than a shard's quota
overflows into the next shards one after the other, which cuts it as seldom as can be.

Law `rows`: counts differ by one at most. Ties go by group hash, doc_id, size and checksum; rows that are equal in all
of these may swap places. A null text has size 8 and checksum 0 and is linked with nothing. An empty table gives an
empty result. Only compact rows (no texts) are shuffled; a group's rows are never in one task: counts by group and
shard are summed map-side, ranks are salted, and the join on groups is salted on the documents' side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, read_table, salted_rank

SHARDS = 24
ROUNDS = 3
SALTS = 16


def compact(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and a hash of the text (null for a null text) of each document."""
    text = docs["text"]
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.when(text.isNotNull(), F.xxhash64(text, F.octet_length(text))).alias("_group"),
    )


def _ranges(total: int, shards: int) -> list[int]:
    """Row quota of each shard."""
    return [total // shards + (s < total % shards) for s in range(shards)]


def _shard_of_rank(rank: F.Column, total: int, shards: int) -> F.Column:
    """The shard of a global rank when shard after shard is filled to its quota."""
    low, more = total // shards, total % shards
    edge = more * (low + 1)
    first = F.floor(rank / F.lit(low + 1))
    return F.when(rank < edge, first).otherwise(more + F.floor((rank - edge) / F.lit(max(low, 1)))).cast("int")


def _counts(df: DataFrame, column: str, shards: int) -> list[int]:
    """Rows by shard; at most `shards` rows come to the driver."""
    held = {r[0]: r[1] for r in df.groupBy(column).count().collect()}
    return [held.get(s, 0) for s in range(shards)]


def _by_shard(values: list[int], column: F.Column) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), column + 1)


def propagate(linked: DataFrame, quotas: list[int], rounds: int, buckets: int) -> DataFrame:
    """Rounds of label propagation over linked(doc_id, size, text_crc32, _group, _n, shard); shard null: no place yet."""
    shards = len(quotas)
    order = [F.col("_n").desc(), F.col("_group"), F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    base = linked.columns
    for _ in range(rounds):
        held = linked.filter(F.col("shard").isNotNull()).groupBy("_group", "shard").agg(F.count(F.lit(1)).alias("_here"))
        best = held.groupBy("_group").agg(F.max_by("shard", F.struct("_here", -F.col("shard"))).alias("_goal"))
        salted = best.select("_group", "_goal", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
        asked = linked.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "_group"), F.lit(SALTS)).cast("int")).join(salted, ["_group", "_salt"], "left")
        asked = asked.select(*base, F.coalesce("_goal", "shard").alias("_goal"))
        # within a shard, larger groups come first: whole groups settle, and the last one is cut at the quota
        ranked = salted_rank_ordered(asked, "_goal", order, buckets)
        linked = cut_lineage(ranked.select(*[F.col(c) for c in base if c != "shard"], F.when(F.col("_rank") < _by_shard(quotas, F.col("_goal")), F.col("_goal")).alias("shard")).select(*base))
    return linked


def salted_rank_ordered(df: DataFrame, key: str, order: list, buckets: int) -> DataFrame:
    """Add _rank within key in the order of group size, then group; a group's own rows in any order.

    Groups are ranked by their summed sizes (one row a group and key), their rows by a salted rank inside the group.
    """
    cells = df.groupBy(key, "_group", "_n").agg(F.count(F.lit(1)).alias("_cell"))
    starts = _prefix(cells, key, buckets)
    inside = salted_rank(df, [key, "_group"], [F.col("doc_id"), F.col("size"), F.col("text_crc32")], "_inside_rank", SALTS)
    both = inside.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "_group"), F.lit(SALTS)).cast("int")).join(
        starts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed(key, "_key"),
        ["_group", "_salt"],
        "inner",
    )
    both = both.filter(F.col(key).eqNullSafe(F.col("_key")))
    return both.select(*df.columns, (F.col("_start") + F.col("_inside_rank")).alias("_rank"))


def _prefix(cells: DataFrame, key: str, buckets: int) -> DataFrame:
    """_start: rows of the key's groups before this one, larger groups first; by size class and hash bucket, so that no
    task gets all groups of a key."""
    from pyspark.sql import Window

    cells = cells.withColumn("_class", -F.floor(F.log2(F.col("_n"))).cast("int")).withColumn("_bucket", F.pmod("_group", F.lit(buckets)).cast("int"))
    sums = cells.groupBy(key, "_class", "_bucket").agg(F.sum("_cell").alias("_sum"))
    over = Window.partitionBy(key).orderBy("_class", "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(over), F.lit(0))).drop("_sum").withColumnRenamed(key, "_k2")
    within = Window.partitionBy(key, "_class", "_bucket").orderBy(F.col("_n").desc(), "_group").rowsBetween(Window.unboundedPreceding, -1)
    inside = cells.withColumn("_in", F.coalesce(F.sum("_cell").over(within), F.lit(0)))
    joined = inside.join(sums, [inside["_class"] == sums["_class"], inside["_bucket"] == sums["_bucket"], inside[key].eqNullSafe(sums["_k2"])], "inner")
    return joined.select(inside[key].alias(key), inside["_group"], (F.col("_base") + F.col("_in")).alias("_start"))


def balanced_shards(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row of docs(doc_id, text)."""
    rows = cut_lineage(compact(docs))
    total = rows.count()
    quotas = _ranges(total, shards)
    buckets = min(4096, max(64, total // 100_000))
    groups = rows.filter(F.col("_group").isNotNull()).groupBy("_group").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    marked = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "_group"), F.lit(SALTS)).cast("int")).join(salted, ["_group", "_salt"], "left").drop("_salt")
    order = [F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    first = salted_rank(marked.withColumn("_all", F.lit(0)), ["_all"], order, "_rank", buckets).drop("_all")
    first = first.withColumn("shard", _shard_of_rank(F.col("_rank"), total, shards)).drop("_rank")
    labelled = cut_lineage(first)
    linked = propagate(labelled.filter("_n is not null"), quotas, rounds, buckets)
    singles = labelled.filter("_n is null")
    # what found no place: overflow of groups in group order, then documents without links, fill the quotas in turn
    placed = linked.filter("shard is not null")
    taken = _counts(placed, "shard", shards)
    free = [q - t for q, t in zip(quotas, taken, strict=True)]
    overflow = linked.filter("shard is null")
    n_overflow = linked.count() - sum(taken)
    over_ranked = salted_rank_ordered(overflow.withColumn("_all", F.lit(0)), "_all", order, buckets).drop("_all")
    single_ranked = salted_rank(singles.withColumn("_all", F.lit(0)), ["_all"], order, "_rank", buckets).drop("_all")
    single_ranked = single_ranked.withColumn("_rank", F.col("_rank") + n_overflow)
    filled = F.lit(None).cast("int")
    edges, at = [], 0
    for s in sorted(range(shards), key=lambda s: -free[s]):
        edges.append((at, at + free[s], s))
        at += free[s]
    for low, high, s in reversed(edges):
        filled = F.when((F.col("_rank") >= low) & (F.col("_rank") < high), F.lit(s)).otherwise(filled)
    columns = ["doc_id", "size", "text_crc32", "_group", "shard"]
    rest = over_ranked.select(*[F.col(c) for c in [*columns, "_rank"]]).unionByName(single_ranked.select(*[F.col(c) for c in [*columns, "_rank"]]))
    rest = rest.withColumn("shard", filled).drop("_rank")
    final = cut_lineage(placed.select(*columns).unionByName(rest.select(*columns)))
    slotted = salted_rank(final, ["shard"], order, "slot", buckets)
    return slotted.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op3_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(read_table(spark, sf_dir, "documents"))
