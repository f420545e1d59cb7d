"""The corpus pipeline: language, lines, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and reread as the next one's docs. All but the
last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.llm import language_id, line_dedup, near_dedup, packing, pii
from quorumlake.llm.common import cut_lineage, shared_folder, unused

#: No SQL form: tokenizers, signatures and trained models.
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents of unknown language: null texts and texts without a letter. Each row stands for itself."""
    return language_id.with_language(docs, language_id.learnt(docs))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each group of equal or similar lines stays; a document that loses all its lines goes."""
    n_lines, n_kept = (unused(c, docs.columns) for c in ("n_lines", "n_kept"))
    done = line_dedup.without_repeats(docs, n_lines, n_kept)
    return done.filter((F.col(n_kept) > 0) | (F.col(n_lines) == 0)).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, whatever the doc_ids: rows are numbered, and the table written with
    its numbers, so that a lost executor can't change them."""
    row, kept = (unused(c, docs.columns) for c in ("_row", "_kept"))
    numbered = cut_lineage(docs.withColumn(row, F.monotonically_increasing_id()))
    judged = near_dedup.near_components(numbered.select(F.col(row).alias("doc_id"), "text"))
    gone = cut_lineage(judged.filter(~F.col("kept")).select(F.col("doc_id").alias(kept)))
    # what goes is the smaller side, and no text is compared: an anti join on numbers
    return numbered.join(gone, numbered[row] == gone[kept], "left_anti").select(*docs.columns)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind; n_chars follows."""
    done = pii.redact(docs)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", language_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_stage),
    ("PII", personal_data_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; results between stages lie in the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_folder(spark)}/corpus_pipeline/{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        out.write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
