"""Exact duplicates by an extendible-hash index on shared files.

Map side. A text is normalised, its key is the first 64 bits of its SHA-256, and the copies that a task meets are
combined: an entry holds the text once, with the ids of up to MEMBERS copies. A task remembers MEMORY characters of
texts, then forgets them all, so one text may have several entries; every entry is a row of a table in the shared folder.

Directory. Entries are counted by the key's first DEPTH bits, a histogram of at most 2^DEPTH numbers whatever the input.
From it the directory grows as in extendible hashing: it begins with one bucket; a bucket of more than `capacity` entries
is split by the next bit; a bucket that already uses all bits of the directory doubles it first. Buckets at the greatest
depth stay as they are and are longer.

Owners. Every bucket is a range of keys. Entries go to the bucket's owner task, sorted by key, and stream through it: the
texts of equal key form a chain, whose heads, the different texts met so far, are compared byte by byte with the next. An
owner holds one text for each head of one chain and eight bytes for each entry of it. Its rows, one an entry, are the
index: Parquet files in the shared folder, one folder a bucket. Ids come back to their entries by the entry's number, which
no two rows share, so a text that a third of all rows hold is dealt out evenly: it comes to its owner once a map task.

Null text: empty. Of equal texts the row with the smallest doc_id stays, a null id after all others; of rows that tie one
stays. Texts without a copy form a group of one. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, shared_folder, written

DEPTH = 16
CAPACITY = 2000
MEMBERS = 4096
MEMORY = 16_000_000
_WHITE = re.compile("[\x20\x09-\x0d]+")
#: White space that is not one single space.
_MENDS = re.compile("[\x09-\x0d]|\x20\x20")

SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM d WINDOW same AS (PARTITION BY t)
"""


def normalised(text: str) -> str:
    return _WHITE.sub(" ", text) if _MENDS.search(text) else text


def text_key(digest: bytes, bits: int = 64) -> int:
    """The first `bits` bits of a digest as a signed long whose unused low bits are 0."""
    value = int.from_bytes(digest[:8], "big") >> (64 - bits) << (64 - bits)
    return value - (1 << 64) if value >> 63 else value


def combined_entries(docs: DataFrame, bits: int = 64, memory: int = MEMORY) -> DataFrame:
    """entry, key, prefix, text, sha256, members (doc_ids, smallest first, nulls last) of docs(doc_id, text)."""
    import pyarrow as pa
    from pyspark import TaskContext

    kinds = {"entry": pa.int64(), "key": pa.int64(), "prefix": pa.int32(), "text": pa.large_string(), "sha256": pa.string(), "members": pa.list_(pa.int64())}

    def run(batches: Iterator) -> Iterator:
        number = TaskContext.get().partitionId() << 33
        held: dict[str, list] = {}
        size = 0

        def emit(items: list[tuple[str, list]]) -> Iterator:
            nonlocal number
            rows, chars = [], 0
            for k, (text, ids) in enumerate(items):
                digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()
                key = text_key(digest, bits)
                rows.append((number, key, (key >> (64 - DEPTH)) & ((1 << DEPTH) - 1), text, digest.hex(), sorted(ids, key=lambda x: (x is None, x or 0))))
                number += 1
                chars += len(text) + 8 * len(ids)
                if k + 1 == len(items) or chars > 4_000_000 or len(rows) >= 10_000:
                    columns = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds.values(), strict=True)], list(kinds))
                    rows, chars = [], 0

        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = normalised(value.as_py() or "")
                ids = held.get(text)
                if ids is None:
                    if size > memory:
                        yield from emit(list(held.items()))
                        held, size = {}, 0
                    held[text] = [doc_id]
                    size += len(text) + 200
                else:
                    ids.append(doc_id)
                    if len(ids) == MEMBERS:
                        yield from emit([(text, ids)])
                        held[text] = []
        yield from emit([x for x in held.items() if x[1]])

    schema = "entry long, key long, prefix int, text string, sha256 string, members array<long>"
    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, schema)


@dataclass
class Directory:
    """2^depth slots; slot i holds the number of its bucket. A bucket's depth is the number of its keys' fixed bits."""

    depth: int
    slots: list[int]
    depths: list[int]

    def of_prefixes(self) -> list[int]:
        """The bucket of each prefix of DEPTH bits."""
        return [self.slots[p >> (DEPTH - self.depth)] for p in range(1 << DEPTH)]


def grow_directory(counts: dict[int, int], capacity: int) -> Directory:
    """The directory for entries counted by prefix: overfull buckets are split, and the directory doubled where it must."""
    before = [0] * ((1 << DEPTH) + 1)
    for p in range(1 << DEPTH):
        before[p + 1] = before[p] + counts.get(p, 0)
    directory, firsts, queue = Directory(0, [0], [0]), [0], [0]  # firsts: the smallest prefix of a bucket
    while queue:
        b = queue.pop()
        width = 1 << (DEPTH - directory.depths[b])
        if directory.depths[b] == DEPTH or before[firsts[b] + width] - before[firsts[b]] <= capacity:
            continue
        if directory.depths[b] == directory.depth:  # doubling: each slot becomes two of the same bucket
            directory.slots = [x for x in directory.slots for _ in range(2)]
            directory.depth += 1
        new = len(firsts)
        directory.depths[b] += 1
        directory.depths.append(directory.depths[b])
        firsts.append(firsts[b] + width // 2)
        shift = DEPTH - directory.depth
        for slot in range(firsts[new] >> shift, (firsts[b] + width) >> shift):
            directory.slots[slot] = new
        queue += [b, new]
    return directory


def chained(rows: DataFrame) -> DataFrame:
    """bucket, key, entry, keep_entry, keep_id, group_size from rows(bucket, key, entry, text, least, n) that are dealt by
    bucket and sorted by key: a stream in which the texts of one key are compared byte by byte."""
    import pyarrow as pa

    kinds = {"bucket": pa.int32(), "key": pa.int64(), "entry": pa.int64(), "keep_entry": pa.int64(), "keep_id": pa.int64(), "group_size": pa.int64()}

    def run(batches: Iterator) -> Iterator:
        key, chain = None, []  # a head: [text, (null id?, id, entry), copies, entries]
        out: list[tuple] = []

        def close() -> None:
            for _, (blank, least, keep), n, entries in chain:
                out.extend((*key, e, keep, None if blank else least, n) for e in entries)

        def flush() -> object:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds.values(), strict=True)], list(kinds))

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5)]
            for (bucket, own, entry, least, n), text in zip(zip(*columns, strict=True), batch.column(3), strict=True):
                if (bucket, own) != key:
                    close()
                    key, chain = (bucket, own), []
                    if len(out) > 50_000:
                        yield flush()
                data, mark = text.as_buffer().to_pybytes(), (least is None, least or 0, entry)
                for head in chain:
                    if head[0] == data:
                        head[1] = min(head[1], mark)
                        head[2] += n
                        head[3].append(entry)
                        break
                else:
                    chain.append([data, mark, n, [entry]])
        close()
        if out:
            yield flush()

    return rows.select("bucket", "key", "entry", "text", "least", "n").mapInArrow(run, "bucket int, key long, entry long, keep_entry long, keep_id long, group_size long")


@dataclass
class Index:
    """entries: the map side's table; directory: its buckets; chains: the rows of the bucket files, one an entry."""

    entries: DataFrame
    directory: Directory
    chains: DataFrame
    path: str


def build_index(docs: DataFrame, capacity: int = CAPACITY, bits: int = 64, memory: int = MEMORY) -> Index:
    """The index of docs(doc_id, text) in the session's shared folder. bits: how many bits of the key count; fewer make
    collisions, which cost time and change no result."""
    spark = docs.sparkSession
    entries = written(combined_entries(docs, bits, memory))
    counts = {r["prefix"]: r["n"] for r in entries.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 2^DEPTH rows
    directory = grow_directory(counts, capacity)
    buckets = spark.createDataFrame(list(enumerate(directory.of_prefixes())), "prefix int, bucket int")
    least = F.get("members", F.lit(0)).alias("least")
    rows = entries.join(F.broadcast(buckets), "prefix").select("bucket", "key", "entry", "text", least, F.size("members").cast("long").alias("n"))  # 2^DEPTH rows
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(len(directory.depths) / 16))
    dealt = rows.repartition(owners, "bucket").sortWithinPartitions("bucket", "key")
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    chains = chained(dealt)
    chains.write.partitionBy("bucket").parquet(path)
    return Index(entries, directory, spark.read.schema(chains.schema).parquet(path), path)


def deduplicated(docs: DataFrame, capacity: int = CAPACITY, bits: int = 64, memory: int = MEMORY) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row of docs(doc_id, text)."""
    index = build_index(docs, capacity, bits, memory)
    chains = index.chains.select(F.col("entry").alias("_entry"), "keep_entry", "keep_id", "group_size")
    both = index.entries.select("entry", "sha256", "members").join(chains, F.col("entry") == F.col("_entry"))
    each = both.select("*", F.posexplode("members").alias("_place", "doc_id"))
    kept = (F.col("entry") == F.col("keep_entry")) & (F.col("_place") == 0)
    return each.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha256").alias("text_sha256"))


def op12_exact_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(read_table(spark, sf_dir, "documents"))
