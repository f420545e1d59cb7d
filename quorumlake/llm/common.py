"""Helpers that several training-data operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Where a vocabulary file lies: in `folder`, which must be the same on every machine, or where the installed package
    public_tokenizers has it."""
    if folder is None:
        try:
            import public_tokenizers
        except ModuleNotFoundError:
            folder = TOKENIZER_DIR
        else:
            return public_tokenizers.path(name)
    return os.path.join(folder, name)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all machines see.

    It is the cluster's spark.checkpoint.dir; one of our own is used only in local mode (tests), where none is set.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = folder or tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it from there. A checkpoint keeps the size that was estimated for
    df, so loops take `written` instead."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write df as a table to the shared checkpoint folder and read it from there.

    Unlike a checkpoint's, the table's size is that of its files. In a loop of joins the estimates of checkpoints are
    multiplied in each round, to numbers whose digits alone fill the driver's memory.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def salted_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, buckets: int) -> DataFrame:
    """Add a gapless rank from 0 within keys, without bringing a key's rows into one task.

    Rows of a key are dealt over buckets by a hash of the order columns; a bucket is ranked on its own, and the counts
    of a key's earlier buckets (at most `buckets` rows a key) are added. Rows that tie on all order columns may take
    each other's ranks.
    """
    bucket = F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")
    dealt = df.withColumn("_bucket", bucket)
    counts = dealt.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    ranked = dealt.withColumn("_inside", F.row_number().over(inside) - 1)
    on = [ranked["_bucket"] == offsets["_bucket"], *[ranked[k].eqNullSafe(offsets[k]) for k in keys]]
    both = ranked.join(offsets, on, "inner")
    return both.select(*[ranked[c] for c in df.columns], (F.col("_inside") + F.col("_before")).alias(name))


def block_pairs(rows: DataFrame, keys: Sequence[str], item: str, block: int) -> DataFrame:
    """rows of the groups (by keys) that hold more than one `component`, once for each pair of blocks that they are in.

    A group's rows are dealt over blocks of about `block` rows by a hash of item; _hi and _lo name the pair, _own the
    row's block. Any two rows of a group meet in exactly one pair, and no task has to hold a whole group.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("component").alias("_least"), F.max("component").alias("_most"))
    mixed = sizes.filter("_least <> _most").select(*keys, F.ceil(F.col("_n") / block).cast("int").alias("_blocks"))
    dealt = rows.join(mixed, list(keys)).withColumn("_own", F.pmod(F.xxhash64(item), F.col("_blocks")).cast("int"))
    each = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return each.select(*rows.columns, "_own", F.greatest("_own", "_other").alias("_hi"), F.least("_own", "_other").alias("_lo"))


def unused(name: str, columns: list[str]) -> str:
    """name, or name after as many underscores as make it differ from all columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def arrow_texts(batches: Iterator) -> Iterator[tuple[list, list[str]]]:
    """From Arrow batches (key, text): bounded lists of keys and texts, a null text as an empty one."""
    for batch in batches:
        keys, texts = batch.column(0).to_pylist(), batch.column(1)
        held_keys, held, size = [], [], 0
        for key, text in zip(keys, texts, strict=True):
            value = text.as_py() or ""
            if held and size + len(value) > 1_000_000:
                yield held_keys, held
                held_keys, held, size = [], [], 0
            held_keys.append(key)
            held.append(value)
            size += len(value)
        if held:
            yield held_keys, held
