"""Packing documents into sequences of bounded length: dominance reduction, then best-fit decreasing.

The packing depends on lengths alone, so it is computed from their histogram (at most `capacity` rows, whatever the
corpus): Martello and Toth's reduction first fixes sets that provably dominate every other set holding the same longest
item, for whole groups of equal items at once; best-fit decreasing then places the rest. The outcome is a list of runs
"the items of this length with ranks from a to b go, one each, into sequences from s at this offset". Every document
piece finds its run by its length and its rank among pieces of that length; ranks are salted, so a length that holds
a third of all pieces is spread over many tasks.

The number of runs is bounded by capacity: each either ends a length or moves a whole group of equal sequences.

Null or empty text: one piece of length 1 (the closing id). Rows that repeat are packed each. An empty table gives an
empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import bisect
import functools
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_texts, cut_lineage, read_table, salted_rank, tokenizer_path
from .pieces import Joined, PieceTable, slices

CAPACITY = 4096
END_ID = 1
RANK_BITS = 44


@functools.cache
def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    vocabulary = plain.get_vocab()
    closes = np.zeros(max(vocabulary.values()) + 1, bool)
    closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def encode(words: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            ids = np.array(plain.encode(" ".join(part), add_special_tokens=False).ids, np.uint32)
            got = np.split(ids, np.flatnonzero(closes[ids]) + 1)[:-1]
            assert len(got) == len(part)
            out += got
        return out

    return tokenizer, special, PieceTable(encode)


def normal_form(text: str) -> str:
    """The vocabulary's own normal form, but for white space, which no piece holds."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def token_ids(texts: list[str], path: str) -> list[np.ndarray]:
    """The ids of each text as the library gives them."""
    tokenizer, special, table = _library(path)
    parts, owner = [], []
    direct = {i for i, text in enumerate(texts) if "<|" in text and any(s in text for s in special)}
    for i, text in enumerate(texts):
        if i not in direct and text:
            for part in slices(normal_form(text)):
                parts.append(part)
                owner.append(i)
    counts = np.zeros(len(texts), np.int64)
    flat = np.zeros(0, np.uint32)
    if parts:
        joined = Joined(parts)
        begins, ends = joined.word_spans()
        if len(begins):
            rows = table.rows(joined, begins, ends)
            flat = table.tokens(rows)
            whose = np.asarray(owner)[np.searchsorted(joined.ends, begins, "right")]
            counts = np.bincount(whose, table.length[rows], len(texts)).astype(np.int64)
    out = np.split(flat, np.cumsum(counts)[:-1])
    for i in direct:
        out[i] = np.array(tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32)
    return out


def tokenize_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each piece of each document's ids and the closing id."""
    import pyarrow as pa

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int64())] * keep_ids
    ending = np.array([END_ID], "<u4")

    def run(batches: Iterator) -> Iterator:
        for keys, texts in arrow_texts(batches):
            rows: list[tuple] = []
            for key, own in zip(keys, token_ids(texts, path), strict=True):
                ids = np.concatenate([own.astype("<u4"), ending])
                for k, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((key, k, start, len(part), zlib.crc32(part.data)) + ((part.tolist(),) if keep_ids else ()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * keep_ids
    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, schema)


class Plan:
    """Runs (length, first rank, items, first sequence, offset), built from counts by length."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity = capacity
        self.left = {length: n for length, n in counts.items() if n}
        self.taken = dict.fromkeys(self.left, 0)
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        self.fixed = 0

    def place(self, length: int, n: int, sequence: int, offset: int) -> None:
        self.runs.append((length, self.taken[length], n, sequence, offset))
        self.taken[length] += n
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]

    def _open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def _partner(self, sizes: list[int], room: int, length: int) -> int | None:
        """The longest length left that fits beside one item of this length."""
        at = bisect.bisect_right(sizes, room) - 1
        while at >= 0:
            if sizes[at] != length or self.left[length] > 1:
                return sizes[at]
            at -= 1
        return None

    def _smallest_sum(self, sizes: list[int], length: int, items: int) -> int:
        """The sum of so many shortest items beside one of this length; over capacity if there are fewer."""
        total = 0
        for size in sizes:
            n = min(items, self.left[size] - (size == length))
            total, items = total + n * size, items - n
            if not items:
                return total
        return self.capacity + 1

    def _best_pair(self, sizes: list[int], room: int, length: int) -> int:
        """The greatest sum within room of two items beside one of this length; 0 if none."""
        free = lambda size: self.left[size] - (size == length)
        usable = [size for size in sizes[: bisect.bisect_right(sizes, room)] if free(size) > 0]
        best, low, high = 0, 0, len(usable) - 1
        while low <= high:
            total = usable[low] + usable[high]
            if total > room:
                high -= 1
                continue
            if low < high or free(usable[low]) > 1:
                best = max(best, total)
            low += 1
        return best

    def reduce(self) -> None:
        """Fix dominating sets: for each length from the longest, the set that dominates all others that hold it.

        {j}: nothing fits beside j. {j, k}, with k the longest item that fits: it fills the sequence, or no two items
        fit beside j, or no three do and no two are together longer than k.
        """
        for length in sorted(self.left, reverse=True):
            while self.left.get(length):
                sizes = sorted(self.left)
                room = self.capacity - length
                partner = self._partner(sizes, room, length)
                if partner is None:
                    n = self.left[length]
                    if sizes[0] <= room:  # the only item that fits is this one itself
                        n = 1
                    self.place(length, n, self._open(n), 0)
                    self.fixed += n
                    continue
                dominates = partner == room or self._smallest_sum(sizes, length, 2) > room
                if not dominates and self._smallest_sum(sizes, length, 3) > room:
                    dominates = self._best_pair(sizes, room, length) <= partner
                if not dominates:
                    break
                n = self.left[length] // 2 if partner == length else min(self.left[length], self.left[partner])
                # fewer items left only make rival sets rarer, so the dominance holds until one of the two runs out
                n = max(1, n)
                first = self._open(n)
                self.place(length, n, first, 0)
                self.place(partner, n, first, length)
                self.fixed += n

    def best_fit(self) -> None:
        """Best-fit decreasing over groups of sequences with equal room."""
        groups: dict[int, list[tuple[int, int]]] = {}
        rooms: list[int] = []

        def put(room: int, first: int, n: int) -> None:
            if not n or not room:
                return
            if room not in groups:
                bisect.insort(rooms, room)
                groups[room] = []
            groups[room].append((first, n))

        for length in sorted(self.left, reverse=True):
            while self.left.get(length):
                at = bisect.bisect_left(rooms, length)
                if at < len(rooms):
                    room = rooms[at]
                    first, n = groups[room].pop()
                    if not groups[room]:
                        del groups[room]
                        rooms.pop(at)
                else:
                    room, n = self.capacity, -(-self.left[length] // (self.capacity // length))
                    first = self._open(n)
                each = room // length
                whole = min(n, self.left[length] // each)
                rest = self.left[length] - whole * each if whole < n else 0
                for k in range(each):
                    if whole:
                        self.place(length, whole, first, self.capacity - room + k * length)
                put(room - each * length, first, whole)
                if rest:  # the last items go into one more sequence
                    for k in range(rest):
                        self.place(length, 1, first + whole, self.capacity - room + k * length)
                    put(room - rest * length, first + whole, 1)
                put(room, first + whole + bool(rest), n - whole - bool(rest))

    def solve(self) -> Plan:
        self.reduce()
        self.best_fit()
        return self


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces(doc_id, piece, start, length, ids_crc32, ...)."""
    import pyarrow as pa

    spark = pieces.sparkSession
    pieces = cut_lineage(pieces)
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = Plan(counts, capacity).solve()
    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 5)
    held = spark.sparkContext.broadcast(((runs[:, 0] << RANK_BITS) + runs[:, 1], runs[:, 1], runs[:, 3], runs[:, 4]))
    total = sum(counts.values())
    order = [F.col("doc_id"), F.col("piece"), F.col("start"), F.col("ids_crc32")]
    ranked = salted_rank(pieces, ["length"], order, "_rank", min(4096, max(64, total // 100_000)))
    names = pieces.columns

    def place(batches: Iterator) -> Iterator:
        keys, first_rank, first_sequence, offset = held.value
        for batch in batches:
            rank = batch.column(len(names)).to_numpy()
            length = batch.column(names.index("length")).to_numpy()
            at = np.searchsorted(keys, (length << RANK_BITS) + rank, "right") - 1
            sequence = first_sequence[at] + rank - first_rank[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset[at])], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """The pieces of docs(doc_id, text) with their places; keep_ids adds each piece's ids."""
    return pack(tokenize_pieces(docs, path or tokenizer_path("word_bpe_49k.json"), capacity, keep_ids), capacity)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
