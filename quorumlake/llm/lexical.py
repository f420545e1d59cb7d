"""Ranked lexical search for a set of items (queries) with bag deduplication.

Documents are restricted to the items' vocabulary: a bag is a document's vocabulary terms, by rising number, with their
frequencies. Documents of equal bag and equal length factor m score alike for every item, so they form a class: they
are dealt by a hash of both and verified by the whole bag. Classes are scored once, inside tasks, against all items as a
sparse product, and each task keeps the k best classes of an item. At last the classes that are left are expanded into
their members by ascending doc_id. Since no more than k members of a class can be among an item's k best, a class keeps its k
smallest doc_ids; this limit is applied before the shuffle too, so a class that a third of all documents share is small.

Nothing is lost by the per-item cuts: the order is score, then doc_id; a class outside the k best by (score, smallest
doc_id) has k documents before its first one.

Items are taken in blocks of about ITEM_BYTES characters and ITEM_ROWS items, each a pass over the documents: what is sent to
tasks (a block's vocabulary and weights) is bounded whatever the number of items.

Null text: no terms. A document without terms counts for nothing; an item without terms has no rows. Null doc_ids rank
after all others of equal score. Rows that repeat, of documents or of items, stand each for itself; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, written

TOP = 10
ITEM_BYTES = 4_000_000
ITEM_ROWS = 10_000
#: Cells of a task's score matrix.
CELLS = 2_000_000
SLICE = 1_000_000

SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), sized AS (
  SELECT doc_id, len(w) AS n FROM words WHERE len(w) > 0
), totals AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sized
), postings AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM words) GROUP BY doc_id, term
), asked AS (
  SELECT item_id, term, count(*) AS r FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM postings, totals GROUP BY term
), scored AS (
  SELECT item_id, doc_id, sum(r * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN sized USING (doc_id), totals GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER best AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER best <= 10
"""


def _letters() -> bytes:
    keep = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
    return bytes(b if b in keep else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


_TABLE = _letters()


def terms(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in lists of bounded size."""
    data = text.encode("utf-8", "surrogatepass").translate(_TABLE)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + SLICE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def document_bags(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, row (unique), n (terms, over 0), bag of docs(doc_id, text); a bag is pairs of term number and frequency, four
    bytes each."""
    import pyarrow as pa
    from pyspark import TaskContext

    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # a block's vocabulary: ITEM_BYTES
    kinds = {"doc_id": pa.int64(), "row": pa.int64(), "n": pa.int64(), "bag": pa.binary()}

    def run(batches: Iterator) -> Iterator:
        number_of = {term: i for i, term in enumerate(sent.value)}.get
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            out = []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, found = 0, Counter()
                for part in terms(value.as_py() or ""):
                    n += len(part)
                    found.update(map(number_of, part))
                if n:
                    found.pop(None, None)
                    pairs = np.array(sorted(found.items()), "<u4")
                    out.append((doc_id, row, n, pairs.tobytes()))
                row += 1
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds.values(), strict=True)], list(kinds))

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, "doc_id long, row long, n long, bag binary")


def _unpacked(bags: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whose bag, term number, frequency) of the bags laid end to end."""
    flat = np.frombuffer(b"".join(bags), "<u4").reshape(-1, 2)
    return np.repeat(np.arange(len(bags)), [len(b) // 8 for b in bags]), flat[:, 0], flat[:, 1].astype(np.int64)


def document_frequencies(bags: DataFrame, size: int) -> dict[int, int]:
    """How many documents hold each of the vocabulary's terms: at most `size` numbers."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        n = np.zeros(size, np.int64)
        for batch in batches:
            n += np.bincount(_unpacked(batch.column(0).to_pylist())[1], minlength=size)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["term", "n"])

    summed = bags.select("bag").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"]: r["n"] for r in summed.collect()}


@dataclass
class Items:
    """The items of a block by term: item numbers, and weight times the term's repeats in the item."""

    by_term: dict[int, tuple[np.ndarray, np.ndarray]]
    size: int


def classes_of(bags: DataFrame, docs: int, total: int, k: int) -> DataFrame:
    """class, m, bag, doc_id, place: of each class of equal bag and m the k smallest doc_ids, by place from 1."""
    m = F.lit(25) + F.expr(f"(75 * n * {docs}L) div {max(total, 1)}L")
    keyed = bags.filter(F.length("bag") > 0).select("doc_id", "row", m.alias("m"), "bag")
    keyed = keyed.withColumn("hash", F.xxhash64("m", "bag"))
    # the hash spreads and sorts the rows; the whole bag, compared where hashes are equal, makes the class
    same = Window.partitionBy("hash", "m", "bag").orderBy(F.col("doc_id").asc_nulls_last(), "row")
    few = keyed.withColumn("place", F.row_number().over(same)).filter(F.col("place") <= k)  # applied before the shuffle too
    return few.select(F.first("row").over(same).alias("class"), "m", "bag", "doc_id", "place")


def best_classes(classes: DataFrame, items: Items, k: int) -> DataFrame:
    """item, score, class, doc_id: at least each item's k best of classes(class, doc_id, m, bag), at most k a task."""
    import pyarrow as pa

    sent = classes.sparkSession.sparkContext.broadcast(items)  # a block's items: ITEM_BYTES
    step = max(1, min(4096, CELLS // max(items.size, 1)))

    def score(bags: list[bytes], m: np.ndarray, held: Items) -> np.ndarray:
        """The product of the classes' values and the items' weights, class by item, term by term."""
        whose, term, tf = _unpacked(bags)
        value = (1_000_000_000 * tf) // (1000 * tf + 8 * m[whose])
        order = np.argsort(term, kind="stable")
        whose, term, value = whose[order], term[order], value[order]
        out = np.zeros((len(bags), held.size), np.int64)
        cuts = np.flatnonzero(np.diff(term, prepend=-1)) if len(term) else np.zeros(0, np.int64)
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(term)], strict=True):
            at, weight = held.by_term[int(term[a])]
            out[whose[a:b, None], at] += value[a:b, None] * weight
        return out

    def run(batches: Iterator) -> Iterator:
        held = sent.value
        top = np.zeros((0, 5), np.int64)  # item, -score, null id?, id, class
        for batch in batches:
            blank = np.asarray(batch.column(1).is_null())
            rows = np.stack([blank, np.asarray(batch.column(1).fill_null(0)), np.asarray(batch.column(0))], 1).astype(np.int64)
            m, bags = np.asarray(batch.column(2)), batch.column(3).to_pylist()
            for at in range(0, len(bags), step):
                scores = score(bags[at : at + step], m[at : at + step], held)
                least = np.ones(held.size, np.int64)
                if len(scores) > k:
                    least = np.maximum(least, np.partition(scores, -k, 0)[-k])
                own, item = np.nonzero(scores >= least)
                more = np.column_stack([item, -scores[own, item], rows[at + own]])
                top = np.concatenate([top, more])
                top = top[np.lexsort(top.T[::-1])]
                first = np.searchsorted(top[:, 0], top[:, 0])
                top = top[np.arange(len(top)) - first < k]
        ids = pa.array(top[:, 3], pa.int64(), mask=top[:, 2].astype(bool))
        yield pa.RecordBatch.from_arrays([pa.array(top[:, 0]), pa.array(-top[:, 1]), pa.array(top[:, 4]), ids], ["item", "score", "class", "doc_id"])

    found = classes.select("class", "doc_id", "m", "bag").mapInArrow(run, "item long, score long, class long, doc_id long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "class")
    return found.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= k).drop("_place")


def search_block(docs: DataFrame, items: list[tuple], k: int) -> DataFrame:
    """item_id, rank, doc_id, score for items (item_id, text) whose vocabulary fits in memory."""
    spark = docs.sparkSession
    asked = [Counter(w for part in terms(text or "") for w in part) for _, text in items]
    vocabulary = sorted({w for own in asked for w in own})
    bags = written(document_bags(docs, vocabulary))
    n, total = bags.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = document_frequencies(bags, len(vocabulary))
    number = {w: i for i, w in enumerate(vocabulary)}
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for t, df in frequency.items()}
    by_term: dict[int, list[tuple[int, int]]] = {}
    for i, own in enumerate(asked):
        for w, repeats in own.items():
            if number[w] in weight:
                by_term.setdefault(number[w], []).append((i, repeats * weight[number[w]]))
    held = Items({t: (np.array([i for i, _ in rows]), np.array([w for _, w in rows], np.int64)) for t, rows in by_term.items()}, len(items))
    members = written(classes_of(bags, n, total, k))
    best = best_classes(members.filter("place = 1"), held, k).select("item", "score", "class")
    expanded = best.join(members.select("class", "doc_id", "place"), "class")  # k classes an item, k members each
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "class", "place")
    ranked = expanded.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(items)], "item long, item_id long")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # ITEM_ROWS rows


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP, item_bytes: int = ITEM_BYTES, item_rows: int = ITEM_ROWS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best of docs(doc_id, text) for each row of items(item_id, text)."""
    asked = items.select(items["item_id"].cast("long"), items["text"]).filter("text is not null")
    asked = written(asked.withColumn("row", F.monotonically_increasing_id()))
    rows, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, math.ceil(rows / item_rows), math.ceil(size / item_bytes))
    block = F.pmod(F.xxhash64("row"), F.lit(blocks))
    parts = [search_block(docs, [(r["item_id"], r["text"]) for r in asked.filter(block == b).orderBy("row").collect()], k) for b in range(blocks)]
    return reduce(DataFrame.unionByName, parts)


def op13_bag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
