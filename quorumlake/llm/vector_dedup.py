"""Near-duplicate vectors by sorted projection passes.

Vectors with equal label and equal components are one class. In each pass the classes of a label are ordered by their
concatenated random hashes (the signs of BITS random projections), by range partitioning, and their places in that order
dealt into blocks of BLOCK. Each row is compared with its WINDOW predecessors, also those of the block before, and beyond
that with all rows that share its first REGION hashes: each pair of blocks of such a region is a task's group of its own,
so a dense region has no cap on partners and spreads over many tasks. The cosine of a near pair is
computed in double precision; verified pairs are united across the passes, links are counted with the classes'
sizes, and components come from the distributed union-find.

Vectors that are null, zero or of null or non-finite components, and rows with a null label or vec_id, link with
nothing: n_links 0, a component of their own. Vectors of different lengths never link. Rows of one vec_id count as one
row each. An empty table gives an empty result.

A pair at the threshold shares a sign with probability 0.936; with 12 passes and this window at least 0.99 of the pairs
are found among a hundred thousand vectors of a label, and 0.9 among a thousand million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, read_table
from .components import SALTS, connected_components

COSINE = 0.98
PASSES = 12
BITS = 32
REGION = 20
WINDOW = 64
BLOCK = 2048
TILE = 512
SEED = 11


def projected(vectors: DataFrame, passes: int = PASSES) -> DataFrame:
    """label, vec_id, the vector as bytes of doubles, and a sort code for each pass; only rows that can link."""
    import pyarrow as pa

    names = ["vec_id", "label", "vector", "codes"]
    types = [pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64())]
    planes: dict[int, np.ndarray] = {}
    weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            ids, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            by_length: dict[int, list[int]] = {}
            whole = []
            for i, v in enumerate(batch.column(2)):
                own = v.values
                if ids[i] is None or labels[i] is None or own is None or own.null_count or not len(own):
                    whole.append(None)
                    continue
                x = own.to_numpy().astype(np.float64)
                good = np.isfinite(x).all() and x.any()
                whole.append(x + 0.0 if good else None)  # -0.0 becomes 0.0
                if good:
                    by_length.setdefault(len(x), []).append(i)
            for length, rows in by_length.items():
                if length not in planes:
                    planes[length] = np.random.default_rng(SEED + length).standard_normal((length, passes * BITS))
                x = np.stack([whole[i] for i in rows])
                scale = np.abs(x).max(1, keepdims=True)
                signs = ((x / scale) @ planes[length] > 0).reshape(len(rows), passes, BITS)
                codes = (signs * weights).sum(2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i] for i in rows], types[0]), pa.array([f"{labels[i]}/{length}" for i in rows]), pa.array([r.tobytes() for r in x], types[2]), pa.array(codes.tolist(), types[3])],
                    names,
                )

    picked = vectors.select(vectors["vec_id"].cast("long"), vectors["label"].cast("string"), vectors["embedding"].cast("array<double>"))
    return picked.mapInArrow(run, "vec_id long, label string, vector binary, codes array<long>")


def _linked(x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    """Which pairs of rows are similar enough, in double precision and without overflow."""
    x, y = x / np.abs(x).max(1, keepdims=True), y / np.abs(y).max(1, keepdims=True)
    dots = np.einsum("ij,ij->i", x, y)
    return dots / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y))) >= cosine


def placed(classes: DataFrame) -> DataFrame:
    """pass, label, region, key and place (from 0 in the order of the pass and label) of classes(key, label, codes)."""
    order = ["pass", "label", "code", "key"]
    rows = classes.select("label", F.posexplode("codes").alias("pass", "code"), "key").select(*order)
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the order is written first, so that a row's partition and place in it stay as they are
    ordered = cut_lineage(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order))
    ordered = ordered.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    counts = ordered.groupBy("pass", "label", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))
    before = Window.partitionBy("pass", "label").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("pass", "label", "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_from")).alias("_shift"))
    both = ordered.join(offsets, ["pass", "label", "_part"])
    return both.select("pass", "label", F.shiftright("code", BITS - REGION).alias("region"), "key", (F.col("_at") + F.col("_shift")).alias("place"))


def block_rows(classes: DataFrame, block: int) -> DataFrame:
    """The placed rows once for each pair of blocks (hi, lo) in which they are compared."""
    rows = cut_lineage(placed(classes))
    of = F.floor(F.col("place") / block).cast("long")
    group = ["pass", "label", "region"]
    wide = rows.groupBy(*group).agg(F.floor(F.min("place") / block).cast("long").alias("_first"), F.floor(F.max("place") / block).cast("long").alias("_last")).filter("_first < _last")
    own = rows.withColumn("hi", of).withColumn("lo", of)
    guests = rows.filter(F.col("place") % block >= block - WINDOW).withColumn("hi", of + 1).withColumn("lo", of + 1)
    across = rows.join(wide, group).withColumn("_own", of).withColumn("_other", F.explode(F.sequence("_first", "_last"))).filter("_own <> _other")
    across = across.select(*rows.columns, F.greatest("_own", "_other").alias("hi"), F.least("_own", "_other").alias("lo"))
    return own.unionByName(guests).unionByName(across)


def window_pairs(classes: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """Distinct pairs a < b of classes(rep, label, vector, codes) that are linked."""
    import pyarrow as pa

    block = max(block, WINDOW)
    keyed = classes.withColumn("key", F.xxhash64("label", "vector"))
    vectors = keyed.select("key", "label", "rep", "vector")
    rows = block_rows(keyed.select("key", "label", "codes"), block).join(vectors, ["key", "label"]).select("pass", "label", "hi", "lo", "place", "region", "rep", "vector")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(table):
        """All pairs of a block, or of two blocks of a region, that are within a window or a region."""
        table = table.sort_by("place")
        place, region, rep = (table.column(c).to_numpy() for c in ("place", "region", "rep"))
        x = np.frombuffer(b"".join(table.column("vector").to_pylist())).reshape(len(rep), -1)
        unit = x / np.abs(x).max(1, keepdims=True)
        unit /= np.sqrt(np.einsum("ij,ij->i", unit, unit))[:, None]
        hi, lo = table.column("hi")[0].as_py(), table.column("lo")[0].as_py()
        split = int(np.searchsorted(place, hi * block)) if hi != lo else 0  # of two blocks, only pairs across
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for begin in range(split, len(rep), TILE):
            end = min(begin + TILE, len(rep))
            for base in range(0, split or end, TILE):
                top = min(base + TILE, split or end)
                a, b = np.nonzero(unit[begin:end] @ unit[base:top].T >= cosine - 1e-9)
                a, b = a + begin, b + base
                near = (b < a) & ((place[a] - place[b] <= WINDOW) | (region[a] == region[b])) & (rep[a] != rep[b])
                a, b = a[near], b[near]
                if len(a):
                    good = _linked(x[a], x[b], cosine)
                    left, right = rep[a[good]], rep[b[good]]
                    found.append((np.minimum(left, right), np.maximum(left, right)))
        a, b = (np.concatenate(side) for side in zip(*found, strict=True))
        return pa.Table.from_arrays([pa.array(a), pa.array(b)], schema=schema)

    return rows.groupBy("pass", "label", "hi", "lo").applyInArrow(compare, "a long, b long").distinct()


def near_vectors(vectors: DataFrame, cosine: float = COSINE, passes: int = PASSES) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors(vec_id, embedding, label)."""
    rows = cut_lineage(projected(vectors, passes))
    classes = cut_lineage(rows.groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("_n"), F.first("codes").alias("codes")))
    pairs = cut_lineage(window_pairs(classes, cosine))
    sizes = classes.select("rep", "_n")
    both = pairs.select(F.col("a").alias("rep"), F.col("b").alias("_other")).unionByName(pairs.select(F.col("b").alias("rep"), F.col("a").alias("_other")))
    partners = both.join(sizes.select(F.col("rep").alias("_other"), "_n"), "_other").groupBy("rep").agg(F.sum("_n").alias("_linked"))
    labels = connected_components(pairs)
    whole = sizes.join(partners, "rep", "left").join(labels, sizes["rep"] == labels["node"], "left")
    whole = whole.select("rep", (F.col("_n") - 1 + F.coalesce("_linked", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    # each row's class by its vector: hot vectors are salted
    spread = classes.select("label", "vector", "rep").join(whole, "rep").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).drop("rep")
    salted = rows.select("vec_id", "label", "vector", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int").alias("_salt"))
    members = salted.join(spread, ["label", "vector", "_salt"]).groupBy("vec_id").agg(F.max("n_links").alias("_links"), F.min("component_id").alias("_component"))
    ids = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"))
    out = ids.join(members, "vec_id", "left")
    component = F.coalesce("_component", "vec_id")
    return out.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def op5_sorted_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))
